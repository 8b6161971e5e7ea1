"""Document fingerprints by winnowing, with DataFrame functions alone.

Method: words (letters and digits, lower-cased) are hashed to 1 .. P - 1; every k = 4 consecutive
words give a rolling hash, the polynomial of their hashes in BASE modulo the prime P (31
bits; fewer words give one, with zeros for the missing). Array functions carry no running
sum, so the k terms are added up at each place: the value is the one that rolling gives.
In each window of w = 12
such hashes the least is chosen, the rightmost of equal ones, and kept with its
position. Two texts that share w + k - 1 = 15 consecutive words share a mark, and the
positions say where. The likeness of two fingerprints is the Jaccard similarity of
their hashes; two empty ones are alike.

A mark is one number, hash and position together, built so that the least number is
the rightmost least hash; window minima come from doubling spans.

Nulls and texts without words have an empty fingerprint. A null doc_id comes before all others. Rows with the same doc_id
follow each other by hash of text; rows alike in both are one document with one
result for each row. A text is read whole, as an array of its words in its row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import partitions, stored

K, W = 4, 12
P, BASE = (1 << 31) - 1, 1_000_003
_LOW = 0xFFFFFFFF


def with_marks(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add `out`: the marks of a text column, by position.

    One projection for each step: the steps refer to the step before several times, so Spark
    computes each once.
    """
    a, b = f"_a_{out}", f"_b_{out}"
    at = lambda name, i: F.get(F.col(name), i)
    hashed = F.transform(F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), ""), lambda x: F.pmod(F.xxhash64(x), F.lit(P - 1)) + 1)
    df = df.withColumn(a, hashed)
    gram = lambda h, i: reduce(lambda x, j: (x * BASE + F.coalesce(at(a, i + j), F.lit(0))) % P, range(1, k), h)
    one = lambda h, i: F.shiftleft(gram(h, i), 32) + (F.lit(_LOW) - i)
    df = df.withColumn(b, F.slice(F.transform(a, one), F.lit(1), F.greatest(F.size(a) - (k - 1), F.least(F.size(a), F.lit(1))))).drop(a)
    df = df.withColumn(f"_n_{out}", F.size(b))
    least_with = lambda step: lambda x, i: F.least(x, at(b, i + step))
    span = 1
    while span < w:
        step = min(span, w - span)
        df = df.withColumn(a, F.transform(b, least_with(step))).drop(b).withColumnRenamed(a, b)
        span += step
    size = F.col(f"_n_{out}")
    return df.withColumn(out, F.array_distinct(F.slice(b, F.lit(1), F.greatest(size - (w - 1), F.least(size, F.lit(1)))))).drop(b, f"_n_{out}")


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 32)))


def printed(marks: Column) -> Column:
    """Marks as text: hash in hexadecimal, @, position."""
    one = lambda m: F.concat(F.hex(F.shiftright(m, 32)), F.lit("@"), (F.lit(_LOW) - m.bitwiseAND(_LOW)).cast("string"))
    return F.array_join(F.transform(marks, one), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_marks(rows, "text", "marks").select("doc_id", printed(F.col("marks")).alias("fingerprint"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """doc_id, h, n_prev, prev_id, prev_h for each distinct (doc_id, h), in a circle by doc_id.

    Numbered by ranges of doc_id: ranks within ranges, moved up by the sizes of the ranges before.
    """
    ids = rows.select("doc_id", "h", "n").distinct()
    dealt = stored(ids.repartitionByRange(4 * partitions(rows.sparkSession), "doc_id", "h").withColumn("b", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("b").agg(F.count("*").alias("c"))
    before = sizes.select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("before"))  # a row for each range
    pos = (F.row_number().over(Window.partitionBy("b").orderBy("doc_id", "h")) - 1 + F.col("before")).alias("pos")
    placed = stored(dealt.join(before, "b").select("doc_id", "h", "n", pos), "places")
    total = placed.count()
    prev = placed.select(F.col("doc_id").alias("prev_id"), F.col("h").alias("prev_h"), F.col("n").alias("n_prev"), F.pmod(F.col("pos") + 1, F.lit(max(1, total))).alias("pos"))
    return placed.join(prev, "pos").select("doc_id", "h", "n_prev", "prev_id", "prev_h")


def _same(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Joined on doc_id, null or not, and h."""
    more = more.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    return rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).drop("_id", "_h")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last half replaced by the start of the next document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n"))
    places = stored(_neighbours(rows), "neighbours")
    marked = with_marks(rows.drop("n"), "text", "marks")  # both joins below take the same columns of it, so one exchange serves both
    base = _same(marked, places)
    head = F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_prev") / 2).cast("int"))
    heads = base.select(F.col("prev_id").alias("doc_id"), F.col("prev_h").alias("h"), head.alias("head"), F.transform("marks", lambda m: F.shiftright(m, 32).cast("int")).alias("next"))
    if rows.count() > places.count():
        heads = heads.dropDuplicates(["doc_id", "h"])
    n = F.length("text").cast("long")
    kept = F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int"))
    both = _same(marked, heads).withColumn("n", n).withColumn("edited", F.concat(kept, F.col("head")))
    both = both.select("doc_id", "n", "marks", "next", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    both = with_marks(both, "edited", "edited_marks").drop("edited")
    both = both.select("doc_id", "n", "edited_sha256", "marks", "edited_marks", hashes(F.col("marks")).alias("own"), hashes(F.col("edited_marks")).alias("ed"), F.array_distinct(F.transform("next", lambda x: x.cast("long"))).alias("nx"))
    return both.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", printed(F.col("marks")).alias("fingerprint"), printed(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness("own", "ed").alias("near_edited"), likeness("own", "nx").alias("near_next"),
    )
