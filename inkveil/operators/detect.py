"""Detection: text to findings, one row for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..functions.text import tag_key
from ..storage import stored
from . import names, spans, tagging
from .chunks import chunk_text


def detect(papers: DataFrame, tagger: tagging.Tagger | None = None) -> DataFrame:
    """papers with findings (id, type, start, end, score, source, enabled, surface), in one pass over the text.

    All steps are local to the row, the tagger's too: nothing is exchanged and the text is read once. Only the text of documents with a
    name goes through Python, and what a tagger that is a UDF reads.
    """
    found, parts, text = unused("found", papers.columns), unused("parts", papers.columns), F.col("text")
    df, rules = papers, spans.all_rule_matches(text)
    if tagger is not None:
        df = df.withColumn(parts, chunk_text(text))
        rules = F.concat(tagging.model_findings(F.col(parts), tagger), rules)
    df = df.withColumn(found, rules)
    # each step looks twice at what it is given, so that the optimizer leaves a step with a UDF to itself
    some = lambda made, otherwise: F.when(F.size(F.col(found)) > 0, made).otherwise(otherwise)
    df = df.withColumn(found, some(spans.merge(text, spans.resolve(spans.expand(text, F.col(found)))), F.col(found)))
    df = df.withColumn(found, names.settled(text, F.col(found)))
    return df.withColumn("findings", some(spans.finished(text, F.col(found)), F.array().cast(spans.KEPT))).drop(found, parts)


def kept(papers: DataFrame, tagger: tagging.Tagger | None = None) -> DataFrame:
    """detect, written once to the shared folder: numbering reads its findings alone, scrubbing its texts, and no step detects again."""
    return stored(detect(papers, tagger), "detected")


def findings(papers: DataFrame, tagger: tagging.Tagger | None = None) -> DataFrame:
    """A row for each finding: batch_id, paper_ord, paper_id, status, the finding's fields, surface and key, without the text.

    papers: detected ones (`kept`), or ones to detect, which is then done once and kept.
    """
    done = papers if "findings" in papers.columns else kept(papers.select([c for c in _KEYS if c in papers.columns] + ["text"]), tagger)
    return exploded(done).withColumn("key", tag_key(F.col("surface")))


_KEYS = ["batch_id", "paper_ord", "paper_id", "status"]


def exploded(detected: DataFrame) -> DataFrame:
    """A row for each finding, with its surface."""
    keys = [c for c in _KEYS if c in detected.columns]
    # outer, as the filter that an inner explode would infer repeats all steps of detection
    return detected.select(*keys, F.explode_outer("findings").alias("f")).where("f is not null").select(*keys, "f.*")


def with_overrides(detected: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings with enabled taken from overrides (paper_id, id, enabled) where they have it.

    Of several rows for one finding the one with the greatest `seq` counts, or, where there is no such column, one that disables it.
    Null ids and values change nothing.
    """
    latest = F.max_by("enabled", "seq") if "seq" in overrides.columns else F.bool_and("enabled")
    each = overrides.where("id is not null and enabled is not null").groupBy("paper_id", "id").agg(latest.alias("enabled"))
    each = each.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "enabled"))).alias("o"))
    chosen = unused("chosen", detected.columns)
    df = detected.join(each.withColumnRenamed("o", chosen), "paper_id", "left")
    switched = F.transform("findings", lambda f: f.withField("enabled", F.coalesce(F.try_element_at(chosen, f["id"]), f["enabled"])))
    return df.withColumn("findings", switched).select(*detected.columns)


def toggle_category(detected: DataFrame, kind: str) -> DataFrame:
    """All findings of a type off if all are on, else all on, paper by paper."""
    on = F.forall("findings", lambda f: (f["type"] != kind) | f["enabled"])
    return detected.withColumn("findings", F.transform("findings", lambda f: F.when(f["type"] == kind, f.withField("enabled", ~on)).otherwise(f)))


def replayed(detected: DataFrame, events: DataFrame) -> DataFrame:
    """detected after a log of switches: events (paper_id, seq, id, type), in the order of seq.

    An event with an id flips that finding; one with a type alone switches the whole category by the state that
    earlier events have left: off if all of it is on, else on. So order matters, and the log is folded in the paper's row.
    Unknown ids and types change nothing; events with neither are none. Of events with the same seq, flips come
    first by id, then types by name. A paper's log is one row in memory, 30 bytes an event; papers without events aren't exchanged for them.

    State: whether each category was last set as a whole, and which findings were flipped since: a category
    event clears its flips, so each event costs what it changes.
    """
    log = events.where("paper_id is not null and (id is not null or type is not null)")
    one = F.struct("seq", F.col("id").isNull().alias("whole"), F.coalesce("id", F.lit(-1)).cast("int").alias("id"), F.coalesce("type", F.lit("")).alias("type"))
    log = log.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("log"))
    name = unused("log", detected.columns)
    df = detected.join(log.withColumnRenamed("log", name), "paper_id", "left")

    def step(state, e):
        every = F.forall(state, lambda f: (f["type"] != e["type"]) | f["enabled"])
        whole = spans.once(every, lambda on: F.transform(state, lambda f: F.when(f["type"] == e["type"], f.withField("enabled", ~on)).otherwise(f)))
        flip = F.transform(state, lambda f: F.when(f["id"] == e["id"], f.withField("enabled", ~f["enabled"])).otherwise(f))
        return F.when(e["whole"], whole).otherwise(flip)

    after = F.aggregate(name, F.col("findings"), step)
    return df.withColumn("findings", F.when(F.col(name).isNull(), F.col("findings")).otherwise(after)).select(*detected.columns)
