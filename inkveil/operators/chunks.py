"""Chunks of bounded length that end at a line, a sentence or a word where they can."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CHUNK_CHARS

CHUNKS = "array<struct<start: int, text: string>>"
LEAST_SHARE = 0.35  # a fixed value: a break counts behind this share of a chunk
_sentence_end = re.compile(r".*(?:\n|[.!?](?= ))", re.S).match


def cuts(text: str, most: int) -> list[int]:
    """Where the chunks start, and the end of the text; every character is looked at a bounded number of times."""
    least, at = int(most * LEAST_SHARE), [0] if text else []
    while at and len(text) - at[-1] > most:
        piece = text[at[-1] : at[-1] + most]
        end, blank = _sentence_end(piece), piece.rfind(" ")
        size = end.end() if end and end.end() - 1 > least else blank if blank > least else most
        at.append(at[-1] + size)
    return [*at, len(text)] if at else []


def chunk_text(text: Column, most: int = CHUNK_CHARS) -> Column:
    """array<struct<start, text>>; together they are the text. An Arrow UDF that slices each text once."""

    def sliced(texts: pd.Series) -> pd.Series:
        rows = (("" if t is None else t, cuts(t or "", most)) for t in texts)
        return pd.Series([[{"start": a, "text": t[a:b]} for a, b in zip(at, at[1:], strict=False)] for t, at in rows])

    # declared so, lest the optimizer folds this projection into one with another UDF, which it then can't take apart
    return F.pandas_udf(sliced, CHUNKS).asNondeterministic()(text)
