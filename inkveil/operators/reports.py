"""Reports over detected papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import out_name
from ..schema import types_table
from .detect import exploded


def legend(detected: DataFrame) -> DataFrame:
    """paper_id, type, title, ord, total, enabled_n: findings of each type in each paper."""
    counts = exploded(detected).groupBy("paper_id", "type").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled_n"))
    return counts.join(F.broadcast(types_table(detected.sparkSession)), "type").select("paper_id", "type", "title", "ord", "total", "enabled_n")  # 16 types


#: What is said of each state; {n} is a count, {more} a detail.
WORDS = {
    "clean": "no findings",
    "open": "findings: none masked",
    "masked": "masked findings: {n}",
    "queued": "queued",
    "running": "in progress",
    "failed": "unreadable: {more}",
    "whole": "papers: all of {n} ready",
    "part": "papers: {n} ready, {more} unreadable",
    "none": "papers: none ready, {more} unreadable",
}


def said(state: Column, n: Column, more: Column) -> Column:
    """The words for a state."""
    words = F.try_element_at(F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair]), state)
    return F.replace(F.replace(words, F.lit("{n}"), n.cast("string")), F.lit("{more}"), F.coalesce(more.cast("string"), F.lit("")))


def paper_summary(detected: DataFrame) -> DataFrame:
    """paper_id, total, enabled_n, state (clean, open or masked), summary."""
    total, on = F.size("findings"), F.size(F.filter("findings", lambda f: f["enabled"]))
    state = F.when(total == 0, "clean").when(on == 0, "open").otherwise("masked")
    return detected.select("paper_id", total.cast("long").alias("total"), on.cast("long").alias("enabled_n"), state.alias("state"), said(state, on, F.lit("")).alias("summary"))


def batch_status(detected: DataFrame) -> DataFrame:
    done, bad = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "error")
    return detected.groupBy("batch_id").agg(done.alias("done_n"), bad.alias("error_n"), F.sum(F.size("findings")).alias("findings_n"))


def batch_text(status: DataFrame) -> DataFrame:
    """batch_id, state (whole, part or none), title from the counts of `batch_status`."""
    state = F.when(F.col("done_n") == 0, "none").when(F.col("error_n") == 0, "whole").otherwise("part")
    return status.select("batch_id", state.alias("state"), said(state, F.col("done_n"), F.col("error_n")).alias("title"))


def row_text(papers: DataFrame, found: DataFrame) -> DataFrame:
    """paper_id, state, n (masked findings), scanned (to be compared with the original), line: what a batch's row says of its paper.

    State by status: queued (waiting), running (scanning), failed (error), else clean or masked. scanned is the column ocr, where there is one.
    """
    counts = found.where("enabled").groupBy("paper_id").agg(F.count("*").alias("_n"))
    n, scan = F.coalesce("_n", F.lit(0)).cast("long"), F.coalesce("ocr", F.lit(False)) if "ocr" in papers.columns else F.lit(False)
    state = F.when(F.col("status") == "waiting", "queued").when(F.col("status") == "scanning", "running").when(F.col("status") == "error", "failed")
    state = state.when(n > 0, "masked").otherwise("clean")
    return papers.join(counts, "paper_id", "left").select("paper_id", state.alias("state"), n.alias("n"), scan.alias("scanned"), said(state, n, F.col("error")).alias("line"))


def next_done(papers: DataFrame) -> DataFrame:
    """paper_ord and the next one that is done, by ranges of papers (65,536 each) and the first done one of each range."""
    rows = papers.select("batch_id", "paper_ord", "status", F.shiftright("paper_ord", 16).alias("range"))
    done = F.when(F.col("status") == "done", F.col("paper_ord"))
    near = F.min(done).over(Window.partitionBy("batch_id", "range").orderBy("paper_ord").rowsBetween(1, Window.unboundedFollowing))
    heads = rows.groupBy("batch_id", "range").agg(F.min(done).alias("head"))
    heads = heads.withColumn("later", F.min("head").over(Window.partitionBy("batch_id").orderBy("range").rowsBetween(1, Window.unboundedFollowing)))
    return rows.withColumn("near", near).join(heads.drop("head"), ["batch_id", "range"]).select("paper_ord", F.coalesce("near", "later").alias("next_ord"))


def output_names(papers: DataFrame, extension: str = "txt") -> DataFrame:
    """paper_ord, out_name for each done paper; the second of a name gets (2), and so on."""
    rows = papers.where("status = 'done'").select("paper_ord", out_name(F.col("name"), extension).alias("plain"), F.shiftright("paper_ord", 16).alias("range"))
    sizes = rows.groupBy("plain", "range").agg(F.count("*").alias("c"))
    sizes = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("plain").orderBy("range")) - F.col("c")).drop("c")
    rank = F.row_number().over(Window.partitionBy("plain", "range").orderBy("paper_ord"))
    rows = rows.withColumn("r", rank).join(sizes, ["plain", "range"]).withColumn("k", F.col("r") + F.col("before"))
    numbered = F.concat(F.regexp_replace("plain", rf"\.{extension}\z", ""), F.lit(" ("), F.col("k").cast("string"), F.lit(f").{extension}"))
    return rows.select("paper_ord", F.when(F.col("k") == 1, F.col("plain")).otherwise(numbered).alias("out_name"))


def findings_export(detected: DataFrame) -> DataFrame:
    return exploded(detected).select("paper_id", "id", "type", "surface", F.round("score", 3).alias("score"), "source", "enabled")
