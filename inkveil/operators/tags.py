"""Tags: one number for each distinct value across the batch; scrubbing and its reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tag
from ..schema import placeholder
from .spans import cut, once, slabs

#: Papers whose first values one task numbers: 2 ** this.
RANGE_BITS = 16


def numbered_values(values: DataFrame) -> DataFrame:
    """batch_id, type, key, n, n_distinct, tag from rows batch_id, type, key, paper_ord, start.

    Numbers follow first appearance. Values are distinct before they are ranked, and ranked by
    ranges of papers, moved up by the sizes of the ranges before: no task sees a whole type.
    """
    first = values.groupBy("batch_id", "type", "key").agg(F.min(F.struct("paper_ord", "start")).alias("at"))
    first = first.withColumn("range", F.shiftright(F.col("at.paper_ord"), RANGE_BITS))
    sizes = first.groupBy("batch_id", "type", "range").agg(F.count("*").alias("c"))
    group = Window.partitionBy("batch_id", "type")
    sizes = sizes.withColumn("before", F.sum("c").over(group.orderBy("range")) - F.col("c")).withColumn("n_distinct", F.sum("c").over(group)).drop("c")
    within = F.row_number().over(Window.partitionBy("batch_id", "type", "range").orderBy("at", "key"))
    out = first.withColumn("r", within).join(sizes, ["batch_id", "type", "range"])
    out = out.withColumn("n", (F.col("r") + F.col("before")).cast("long"))
    return out.select("batch_id", "type", "key", "n", "n_distinct", tag(placeholder(F.col("type")), F.col("n"), F.col("n_distinct")).alias("tag"))


def assign_tags(found: DataFrame) -> DataFrame:
    """The tag dictionary of a batch, from its findings (detect.findings): disabled ones count too, so that numbers stay."""
    return numbered_values(found)


def tagged(found: DataFrame, tags: DataFrame) -> DataFrame:
    """A row for each finding with its tag."""
    return found.join(tags.select("batch_id", "type", "key", "tag"), ["batch_id", "type", "key"])


def hits(found: DataFrame, tags: DataFrame) -> DataFrame:
    """paper_id, hits: the enabled findings of a paper in order, as (start, end, tag); what rewriting texts and Word files takes."""
    one = F.struct("start", "end", "tag")
    return tagged(found, tags).where("enabled").groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))


def scrub(papers: DataFrame, found: DataFrame, tags: DataFrame) -> DataFrame:
    """papers with n_findings and scrubbed: enabled findings replaced by their tags.

    Of detected papers (detect.kept) those without findings pass through where they are; only the texts of
    the others are exchanged, to meet their hits. findings isn't in the result.
    """
    if "findings" not in papers.columns:
        return _scrubbed(papers, found, tags)
    rows = [c for c in papers.columns if c != "findings"]
    plain = papers.where(F.size("findings") == 0).select(*rows, F.lit(0).cast("long").alias("n_findings"), F.col("text").alias("scrubbed"))
    return plain.unionByName(_scrubbed(papers.where(F.size("findings") > 0).select(*rows), found, tags))


def _scrubbed(papers: DataFrame, found: DataFrame, tags: DataFrame) -> DataFrame:
    one = F.when(F.col("enabled"), F.struct("start", "end", "tag"))
    each = tagged(found, tags).groupBy("paper_id").agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_list(one)).alias("hits"))
    df = papers.join(each, "paper_id", "left")
    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("tag"))

    def rewritten(parts: Column) -> Column:
        places = F.concat(F.array(first), "hits")

        def of(ps: Column) -> Column:
            def piece(h: Column, i: Column) -> Column:
                after = F.coalesce(F.try_element_at(ps, i + 2)["start"], F.length("text"))
                return F.concat(h["tag"], cut(parts, h["end"], after - h["end"]))

            return F.array_join(F.transform(ps, piece), "")

        return once(places, of)

    scrubbed = F.when(F.size("hits") > 0, once(slabs(F.col("text")), rewritten)).otherwise(F.col("text"))
    return df.withColumn("scrubbed", scrubbed).withColumn("n_findings", F.coalesce("n_findings", F.lit(0)).cast("long")).drop("hits")


def tag_map(found: DataFrame, tags: DataFrame, scope: str = "batch", snapshots: DataFrame | None = None) -> DataFrame:
    """scope, ord, start, tag, original: for each tag its first enabled surface, over the batch or in each paper.

    snapshots: maps of papers as they were exported (paper_id, ord, start, tag, original, as `exported` makes them);
    a paper that has one is taken by it, as replies know the tags that were handed out.
    """
    rows = tagged(found, tags).where("enabled and status = 'done'").select("batch_id", "paper_id", F.col("paper_ord").alias("ord"), "start", "tag", F.col("surface").alias("original"))
    if snapshots is not None:
        batches = rows.select("batch_id", "paper_id").distinct()
        old = snapshots.join(batches, "paper_id")
        rows = rows.join(snapshots.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(old.select(*rows.columns))
    key = F.col("paper_id") if scope == "paper" else F.col("batch_id")
    first = rows.groupBy(key.alias("scope"), "tag").agg(F.min_by(F.struct("ord", "start", "original"), F.struct("ord", "start")).alias("f"))
    return first.select("scope", F.col("f.ord").alias("ord"), F.col("f.start").alias("start"), "tag", F.col("f.original").alias("original"))


def exported(found: DataFrame, tags: DataFrame) -> DataFrame:
    """The map of each paper to keep beside its export: paper_id, ord, start, tag, original."""
    return tag_map(found, tags, "paper").withColumnRenamed("scope", "paper_id")


def export_version(papers: DataFrame, found: DataFrame, tags: DataFrame, export_id: int) -> tuple[DataFrame, DataFrame]:
    """What an export adds to the log: its papers (export_id, batch_id, paper_id), those without tags too, and their maps (export_id, batch_id, paper_id, ord, start, tag, original)."""
    done = papers.where("status = 'done'").select(F.lit(export_id).cast("long").alias("export_id"), "batch_id", "paper_id").distinct()
    return done, done.join(exported(found, tags), "paper_id").select("export_id", "batch_id", "paper_id", "ord", "start", "tag", "original")


def timeline(exports: DataFrame, maps: DataFrame) -> DataFrame:
    """batch_id, export_id, tag, ord, start, original: what each tag of a batch stands for from that export on, until the next one.

    A paper counts by its latest export up to then, whole: tags that it had before and has no more are gone. Of several papers
    with the tag the first one counts. A map is repeated for the exports of its batch that leave its paper alone, before tags are
    reduced where they are; a batch has few exports, papers and tags are many.
    """
    own = Window.partitionBy("batch_id", "paper_id").orderBy("export_id")
    spans = exports.distinct().withColumn("until", F.lead("export_id").over(own))
    every = exports.groupBy("batch_id").agg(F.collect_set("export_id").alias("all"))
    live = maps.join(spans, ["batch_id", "paper_id", "export_id"]).join(every, "batch_id")
    at = F.filter("all", lambda e: (e >= F.col("export_id")) & (F.col("until").isNull() | (e < F.col("until"))))
    live = live.select("batch_id", F.explode(at).alias("export_id"), "tag", "ord", "start", "original")
    first = live.groupBy("batch_id", "export_id", "tag").agg(F.min_by(F.struct("ord", "start", "original"), F.struct("ord", "start")).alias("f"))
    return first.select("batch_id", "export_id", "tag", "f.*")


def unscrub_as_of(replies: DataFrame, exports: DataFrame, maps: DataFrame) -> DataFrame:
    """reply_id, text of replies (reply_id, batch_id, at, text) by the tags that were handed out at that time: the batch's latest export with export_id <= at.

    A reply from before the first export stays as it is.
    """
    known = timeline(exports, maps)
    when = exports.groupBy("batch_id").agg(F.array_sort(F.collect_set("export_id")).alias("all"))
    latest = F.array_max(F.filter("all", lambda e: e <= F.col("at")))
    scope = F.concat_ws(" ", F.coalesce(latest, F.lit(-1)).cast("string"), "batch_id")
    placed = replies.join(when, "batch_id", "left").select("reply_id", scope.alias("scope"), "text")
    return unscrub(placed, known.select(F.concat_ws(" ", F.col("export_id").cast("string"), "batch_id").alias("scope"), "ord", "start", "tag", "original"))


TAG = r"\[[A-Z]+(?: \d+)?\]"


def unscrub(replies: DataFrame, tags: DataFrame) -> DataFrame:
    """reply_id, text with the tags of its scope put back, as if one after the other in order of appearance.

    Only tags that the reply has are joined to it. The text is split at its tags once and joined with what they stand for. Only where that could make
    a new tag (an original with a bracket, or a tag behind an open one) they are replaced one after the other over the whole text.
    """
    hits = F.regexp_extract_all("text", F.lit(TAG), F.lit(0))
    used = replies.select("reply_id", "scope", F.explode(F.array_distinct(hits)).alias("tag")).join(tags, ["scope", "tag"])
    each = used.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "tag", "original"))).alias("m"))
    between = F.split("text", TAG, -1)
    open_ = F.exists(F.slice(between, F.lit(1), F.size(hits)), lambda b: b.rlike(r"\[[A-Z0-9 ]*\z"))
    chained = F.exists("m", lambda x: x["original"].rlike(r"[\[\]]")) | open_
    one_by_one = F.aggregate("m", F.col("text"), lambda acc, x: F.replace(acc, x["tag"], x["original"]))

    def at_once(known: Column) -> Column:
        back = F.transform(hits, lambda h: F.coalesce(F.try_element_at(known, h), h))
        return F.array_join(F.flatten(F.zip_with(between, back, lambda b, h: F.array(b, F.coalesce(h, F.lit(""))))), "")

    known = F.map_from_entries(F.transform("m", lambda x: F.struct(x["tag"], x["original"])))
    text = F.when(F.col("m").isNull(), F.col("text")).when(chained, one_by_one).otherwise(once(known, at_once))
    return replies.join(each, "reply_id", "left").select("reply_id", text.alias("text"))
