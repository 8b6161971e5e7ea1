"""Best-fit decreasing packing of token sequences into windows of a fixed size.

Method: documents longer than the window are first cut into full windows; the rests
are placed longest first, each into the tightest open window that still has room,
found through a segment tree indexed by remaining capacity. As the plan depends on
the number of pieces of each length alone, it is made once from the histogram of
lengths (at most `window` rows, whatever the corpus): runs of like windows are
filled together, and the result says for each length which ranks go to which
windows. Spark numbers the pieces within their length and looks the ranks up. A text is encoded whole in its task,
chunk by chunk, and cut into windows there.

Nulls: a null text has the end id alone. Repeated rows are packed each. Ties: pieces of
one length are interchangeable. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from ._common import numbered, stored, texts

WINDOW = 4096


class CapacityTree:
    """Segment tree over remaining capacities 0 ... window: the smallest one >= c that has open windows."""

    def __init__(self, window: int):
        self.n = 1 << (window + 1).bit_length()
        self.open = [0] * (2 * self.n)

    def add(self, capacity: int, windows: int) -> None:
        i = capacity + self.n
        while i:
            self.open[i] += windows
            i >>= 1

    def tightest(self, capacity: int) -> int | None:
        i = capacity + self.n
        if self.open[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.open[i + 1]:  # the right sibling holds larger capacities
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of histogram[length] pieces of each length.

    Returns runs (length, first rank, windows, pieces a window, first window, offset):
    rank r of that length in the run lies in window first + (r - rank) // pieces, at
    offset + ((r - rank) % pieces) * length.
    """
    tree, runs_of, out, made = CapacityTree(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs_of.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # open as many new windows as the rest of this length fills
                capacity, each = window, window // length
                first, n = made, -(-left // each)
                made += n
            else:
                each = capacity // length
                first, n = runs_of[capacity].pop()
                tree.add(capacity, -n)
            full = min(n, left // each)
            if full:
                out.append((length, rank, full, each, first, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than `each` are left: one window takes them all
                out.append((length, rank, 1, left, first + full, window - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            if capacity < window or full < n:
                put(capacity, first + full, n - full)
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces with a column length (1 ... window)."""
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    runs = np.array(plan(sizes, window) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] << 44 | runs[:, 1]  # its size depends on the window alone
    ranked = numbered(pieces, ["length"], [F.col(c) for c in pieces.columns], "_rank").select(*pieces.columns, "_rank")
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            run = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            at = rank - run[:, 1]
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(run[:, 4] + at // run[:, 3]), pa.array(run[:, 5] + at % run[:, 3] * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, spaces: str = "dropped", end: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (with the end id) into full windows and a rest.

    doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            rows, ids_out = [], []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc, ids in zip(doc_ids, tokens.encode_rows(batch.column("text").to_pylist(), path, spaces, end), strict=True):
                n = len(ids) // 4
                for a in range(0, n, window):
                    piece = ids[4 * a : 4 * (a + window)]
                    rows.append((doc, a, len(piece) // 4, tokens.crc(piece), n))
                    if with_ids:
                        ids_out.append(piece)
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids_out, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return texts(docs).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, path: str, spaces: str = "dropped", end: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: one row for each piece."""
    pieces = stored(token_pieces(docs, path, spaces, end, window, with_ids), "pieces")
    return pack(pieces, window)


def sequences(placed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids array<int>, segments, padded to the window.

    A sequence whose pieces end at a power of two is left at that length.
    """
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("parts"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column("parts").to_pylist():
                raw = b"".join(p["ids"] for p in parts)
                n = len(raw) // 4
                ids.append(np.frombuffer(raw + (b"" if n & (n - 1) == 0 else struct.pack("<I", pad) * (window - n)), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return parts.mapInArrow(build, "sequence_id long, ids array<int>")
