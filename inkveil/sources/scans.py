"""Scanned papers page by page: rendered to a row for each page, read there, and put together again.

Rendering and reading are plug-ins. A paper of many pages is spread over tasks, and a page that fails is tried again by
itself; only if it fails `tries` times the paper has an error. What reads print is made in the task, by `engine_for`, for the
languages of the mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from .intake import NO_PRINT, Reader, enough_text, ocr_languages

LONGEST = 2400  # a fixed value: the longest side of what is read, in pixels
Render = Callable[[bytes], Iterator[tuple[bytes, int, int]]]  # a file's pages: image, width, height
Engine = Callable[[bytes, int, int], str]  # an image, and the width and height to read it at: its text
PAGE = "paper_id string, page int, image binary, width int, height int, error string"


def fitted(width: Column, height: Column, longest: int = LONGEST) -> tuple[Column, Column]:
    """Width and height so that the longer one is at most `longest`, neither is less than 1, and nothing is made larger."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height, F.lit(1)))
    side = lambda n: F.greatest(F.lit(1), F.floor(n * scale + 0.5)).cast("int")
    return side(width), side(height)


def pages_of(files: DataFrame, render: Render) -> DataFrame:
    """A row for each page of rows paper_id, content, as it is rendered; a file that can't be opened is one row with an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(paper: str, page: int, image: bytes | None, width: int, height: int, error: str | None) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((paper, page, image, width, height, error), kinds, strict=True)], ["paper_id", "page", "image", "width", "height", "error"])

        for batch in batches:
            for paper, content in zip(batch.column("paper_id"), batch.column("content"), strict=True):
                n = 0
                try:
                    for image, width, height in render(content.as_py()):
                        n += 1
                        yield row(paper.as_py(), n, image, width, height, None)
                except Exception as e:  # one file never fails the batch
                    yield row(paper.as_py(), n + 1, None, 0, 0, str(e) or type(e).__name__)

    made = files.select("paper_id", "content").mapInArrow(work, PAGE)
    width, height = fitted(F.col("width"), F.col("height"))
    return made.withColumns({"width": width, "height": height})


def read_pages(pages: DataFrame, engine_for: Callable[[], Engine], tries: int = 3) -> DataFrame:
    """paper_id, page, text, error: each page read by itself, wherever it is dealt to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for batch in batches:
            texts, errors = [], []
            for image, width, height, error in zip(*(batch.column(c) for c in ("image", "width", "height", "error")), strict=True):
                text, why = None, error.as_py()
                for _ in range(0 if why else tries):
                    try:
                        engine = engine or engine_for()
                        text, why = engine(image.as_py(), width.as_py(), height.as_py()), None
                        break
                    except Exception as e:
                        engine, why = None, str(e) or type(e).__name__  # the next try has a new one
                texts.append(text)
                errors.append(why)
            yield pa.RecordBatch.from_arrays([batch.column("paper_id"), batch.column("page"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["paper_id", "page", "text", "error"])

    return pages.repartition("paper_id", "page").mapInArrow(work, "paper_id string, page int, text string, error string")


def papers_of(read: DataFrame, least: int = 20) -> DataFrame:
    """paper_id, text, ocr, error: pages in order with an empty line between; the first page's error, or too little print, is the paper's."""
    one = F.struct("page", F.coalesce("text", F.lit("")).alias("t"))
    whole = read.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("p"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"))
    text = ws_trim(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"))
    short = F.when(~enough_text(F.col("text"), least), NO_PRINT)
    whole = whole.select("paper_id", text.alias("text"), "error")
    return whole.select("paper_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.lit(True).alias("ocr"), F.coalesce("error", short).alias("error"))


def scan_reader(render: Render, engine_for: Callable[[str], Engine], mode: str = "standard", tries: int = 3, least: int = 20) -> Reader:
    """The reader of scanned files. A file without pages has too little print."""
    languages = ocr_languages(mode)

    def read(files: DataFrame) -> DataFrame:
        got = papers_of(read_pages(pages_of(files, render), lambda: engine_for(languages), tries), least)
        none = files.select("paper_id").join(got.select("paper_id"), "paper_id", "left_anti")
        return got.unionByName(none.select("paper_id", F.lit("").alias("text"), F.lit(True).alias("ocr"), F.lit(NO_PRINT).alias("error")))

    return read
