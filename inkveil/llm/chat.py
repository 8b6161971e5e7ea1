"""Multi-party perspective rotation of conversations, with DataFrame functions alone.

Method: for every participant of a conversation the whole dialogue is rendered once with
that speaker as assistant and all others as named users; system turns stay system turns
and have no view of their own. Only the speaker's own words and their closing mark are
trained on. A view is a row for each turn with its place in the rendered text, so a
conversation of any length is never gathered in one task: places are sums within ranges
of 1,024 turns, moved up by the ranges before.

Null roles are the speaker "unknown", null texts are empty; marks within a text are
broken by a space, so that no text can pose as a turn. Turns with the same number follow
each other by role and text; rows alike in all are turns of their own. Turns without a
number follow all others of their conversation; rows without a conv_id are one
conversation. A turn of any length is one row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_BITS = 10
_LAST = 1 << 62  # the range of turns without a number, after all others


def perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, turn, role (in the view), name, segment, start, end, train_start, train_end.

    start and end: characters of the turn in the view's text, the segments joined in order.
    train_start and train_end: what is trained on; both at start for the turns of others.
    """
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("name"), said.alias("said"))
    speakers = turns.where("name <> 'system'").select("conv_id", F.col("name").alias("speaker")).distinct()
    rows = turns.join(speakers.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("name") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("name") == "system", "system").otherwise("user")
    head = F.concat(F.lit("<|"), role, F.when(role == "user", F.concat(F.lit(" "), F.col("name"))).otherwise(""), F.lit("|>\n"))
    rows = rows.withColumn("role", role).withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("said"), F.lit("<|end|>\n")))
    rows = rows.withColumn("size", F.length("segment").cast("long")).withColumn("range", F.coalesce(F.shiftright(F.col("turn").cast("long"), RANGE_BITS), F.lit(_LAST)))
    view = Window.partitionBy("conv_id", "speaker")
    sums = rows.groupBy("conv_id", "speaker", "range").agg(F.sum("size").alias("s"))
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("range").alias("_range"), (F.sum("s").over(view.orderBy("range")) - F.col("s")).alias("before"))
    upto = Window.partitionBy("conv_id", "speaker", "range").orderBy(F.asc_nulls_last("turn"), "name", "said").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("speaker") == F.col("_speaker")) & (F.col("range") == F.col("_range"))
    rows = rows.withColumn("within", F.sum("size").over(upto)).join(sums, same)
    end = F.col("before") + F.col("within")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return rows.select(
        "conv_id", "speaker", "turn", "role", F.when(F.col("role") == "user", F.col("name")).alias("name"), "segment", "start", "end",
        F.when(F.col("role") == "assistant", F.col("start") + F.col("head")).otherwise(F.col("start")).alias("train_start"), F.when(F.col("role") == "assistant", F.col("end") - 1).otherwise(F.col("start")).alias("train_end"),
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
v AS (SELECT t.conv_id, speaker, turn, name AS n, said, CASE WHEN name = speaker THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END AS role FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, '<|' || role || CASE WHEN role = 'user' THEN ' ' || n ELSE '' END || '|>' || chr(10) AS head FROM v),
g AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment FROM h),
e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn, n, said ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM g)
SELECT conv_id, speaker, turn, role, CASE WHEN role = 'user' THEN n END AS name, segment, CAST("end" - length(segment) AS BIGINT) AS start, "end",
CASE WHEN role = 'assistant' THEN CAST("end" - length(segment) + length(head) AS BIGINT) ELSE CAST("end" - length(segment) AS BIGINT) END AS train_start, CASE WHEN role = 'assistant' THEN CAST("end" - 1 AS BIGINT) ELSE CAST("end" - length(segment) AS BIGINT) END AS train_end FROM e
"""
