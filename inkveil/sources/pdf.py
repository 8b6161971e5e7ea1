"""Text of PDF pages from positioned fragments. Extraction itself needs a PDF library and is a plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, trailing_blanks

BLOCK = 128  # fragments whose text is joined at once
ITEMS = "array<struct<str: string, x: double, y: double, width: double, has_eol: boolean>>"


def page_text(items: Column) -> Column:
    """Fragments in order: a new line where y moves by more than 2, a space where a gap of more than 1.5 has no blank beside it.

    Pieces of a block are joined before the next one begins, so the work is linear in the fragments.
    """
    none, nothing = F.lit(None).cast("double"), F.array().cast("array<string>")
    start = F.struct(nothing.alias("out"), F.lit(False).alias("blank"), none.alias("y"), none.alias("end"), nothing.alias("done"))

    def step(acc: Column, i: Column) -> Column:
        line = F.coalesce(F.abs(i["y"] - acc["y"]) > 2, F.lit(False))
        gap = F.coalesce(i["x"] - acc["end"] > 1.5, F.lit(False)) & (i["str"] != "") & ~i["str"].rlike(f"^[{WS}]") & ~acc["blank"]
        eol = F.coalesce(i["has_eol"], F.lit(False))
        piece = F.concat(F.when(line, "\n").when(gap, " ").otherwise(""), i["str"], F.when(eol, "\n").otherwise(""))
        return F.struct(
            F.concat(acc["out"], F.array(piece)).alias("out"),
            (eol | F.when(i["str"] == "", line | acc["blank"]).otherwise(i["str"].rlike(rf"[{WS}]\z"))).alias("blank"),  # what is there so far ends with one
            F.when(eol, none).otherwise(i["y"]).alias("y"), F.when(eol, none).otherwise(i["x"] + F.coalesce(i["width"], F.lit(0.0))).alias("end"), acc["done"].alias("done"),
        )

    def joined(acc: Column) -> Column:
        done = F.concat(acc["done"], F.array(F.array_join(acc["out"], "")))
        return F.struct(nothing.alias("out"), acc["blank"].alias("blank"), acc["y"].alias("y"), acc["end"].alias("end"), done.alias("done"))

    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).when(F.size(items) == 0, F.array().cast("array<int>"))
    return F.aggregate(firsts, start, lambda acc, k: F.aggregate(F.slice(items, k, F.lit(BLOCK)), acc, step, joined), lambda acc: F.array_join(acc["done"], ""))


#: Errors of extractors and what they mean to those who read the batch.
ERRORS = {"password": "this PDF is password-protected; remove the password and try again", "invalid": "this does not look like a working PDF"}


def error_text(error: Column) -> Column:
    """The message for an extractor's error, which names a password or an invalid file; others stay as they are."""
    return F.when(error.rlike("(?i)password"), ERRORS["password"]).when(error.rlike("(?i)invalid"), ERRORS["invalid"]).otherwise(error)


def document_text(fragments: DataFrame) -> DataFrame:
    """paper_id, text from rows paper_id, page, items."""
    pages = fragments.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page", page_text(F.col("items")).alias("t")))).alias("p"))
    return pages.select("paper_id", trailing_blanks(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("text"))
