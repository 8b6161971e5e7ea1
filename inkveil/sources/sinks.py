"""Writing scrubbed papers: text and Word files, findings and the tag maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tags as T
from ..operators.reports import output_names
from . import formats


def batch_files(papers: DataFrame, found: DataFrame, tags: DataFrame, word_files: DataFrame | None = None) -> DataFrame:
    """paper_ord, out_name, content, error of every done paper: its scrubbed text, or Word file where it is one (word_files: paper_id, content).

    A Word file that can't be rewritten, or isn't given, has an error and no content.
    """
    from .docx import scrubbed

    done = T.scrub(papers.where("status = 'done'"), found, tags)
    texts = done.where("kind <> 'docx'") if word_files is not None else done
    none = F.lit(None).cast("string").alias("error")
    files = texts.join(output_names(texts), "paper_ord").select("paper_ord", "out_name", F.encode("scrubbed", "UTF-8").alias("content"), none)
    if word_files is None:
        return files
    word = done.where("kind = 'docx'")
    made = scrubbed(word_files.join(word.select("paper_id"), "paper_id").join(T.hits(found, tags), "paper_id", "left"))
    made = word.select("paper_id", "paper_ord").join(made, "paper_id", "left").join(output_names(word, "docx"), "paper_ord")
    error = F.coalesce("error", F.when(F.col("content").isNull(), F.lit("no Word file is given for this paper")))
    return files.unionByName(made.select("paper_ord", "out_name", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error")))


def write_batch(papers: DataFrame, found: DataFrame, tags: DataFrame, path: str, word_files: DataFrame | None = None) -> DataFrame:
    """The export of a batch: its files, committed together, and tag_maps/ (each paper's map, for later replies).

    Returns the manifest as committed: a row for each done paper, with an error for a Word file that couldn't be rewritten.
    """
    T.exported(found, tags).write.mode("overwrite").parquet(f"{path}/tag_maps")
    return formats.write(batch_files(papers, found, tags, word_files), path)


def write_findings(found: DataFrame, path: str, kind: str = "json") -> None:
    """Findings as JSON lines (or csv, parquet) for other tools."""
    found.select("paper_id", "id", "type", "surface", F.round("score", 3).alias("score"), "source", "enabled").write.mode("overwrite").format(kind).save(path)
