"""Removal of byte strings that an earlier document has already, by merging shard suffix arrays.

A byte goes when a string of 50 bytes that covers it also starts in a document with a
smaller doc_id. Strings are judged on the input; matches never cross documents.

Method: (1) Equal texts are one class; all but its first document go whole. (2) Every
window of 50 bytes has an anchor, the least hash of its 16-byte strings. Half of the
other 34 bytes, at least, lie on one side of it; anchors that several classes have with the
17 bytes before, or with the 17 after, are found by one exchange of hashes. The windows of
such an anchor make a piece of text, and pieces go to tasks by their anchor, so equal
windows meet wherever they stand, and no task sees more than its range of anchors.
(3) In a task equal pieces are one, with the smallest doc_id. Where an anchor has several
different pieces, these form two shards with a suffix array and a Burrows-Wheeler
transform each. The transforms are merged by iterative interleave refinement: starting
from the order of short prefixes, each round moves every entry behind the two symbols
before it, which sorts by two bytes more; the round in which neighbours part is their
common prefix. No suffix is sorted again. After 50 bytes, the intervals that remain are the
repeated strings; each keeps its smallest doc_id.

An anchor that very many classes have, by a sample of them, never goes to one task: its windows of 50
bytes are told apart by 128-bit hashes, merged where they are read, and their smallest
doc_id is found by an aggregation. The sample settles the way alone, not the result.

Nulls and empty texts have no bytes. Rows without a doc_id are neither before nor after
others: they stay whole and remove nothing. Rows with the same doc_id never remove each other's
bytes. Classes are told apart by 64 bits of SHA-256. An empty table gives an empty result.
Extra columns are ignored by `removed_digest` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import unused
from ._bytes import _BASE, _INV, binaries, give_back, mix, packed, powers, slices, span_hash, unpacked
from ._common import passing, stored

#: Bytes that make a repeat, of an anchor and of a segment of a long text; anchors that a task compares; bytes of one merge and its shards.
WINDOW, ANCHOR, SEGMENT, BUCKET_ANCHORS, MERGE_BYTES, SHARDS = 50, 16, 1 << 22, 100_000, 1 << 20, 4
#: Occurrences from which an anchor is spread over tasks, and the sample of classes (one in so many) that counts them.
HOT, SAMPLE = 5_000, 16


# --- anchors ---------------------------------------------------------------


def anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows within rows, their hashes, 16 bits each for what stands before and after, and reach.

    reach: how far before the anchor its windows start, and 256 times how many there are after the first.
    """
    n, w = len(data), window - k + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=run[1:])
    value = mix((run[k:] - run[:-k]) * powers(_INV, n + 1)[: n - k + 1])
    low, at = value, np.arange(len(value), dtype=np.int32)
    span = 1
    while span < w:  # leftmost least of growing spans
        step = min(span, w - span)
        a, b = low[: len(low) - step], low[step:]
        less = b < a
        low = np.where(less, b, a)
        at = np.where(less, at[step:], at[: len(at) - step])
        span += step
    inside = np.ones(len(at), bool)  # windows that cross rows are none
    for e in off[1:-1].tolist():
        inside[max(0, e - window + 1) : e] = False
    first = np.flatnonzero(inside)
    at = at[inside]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    last = first[np.r_[new[1:], len(at)] - 1] if len(at) else first
    at, first, side = at[new].astype(np.int64), first[new], (window - k) // 2
    reach = (at - first + (last - first) * 256).astype(np.uint16)
    row = np.searchsorted(off, at, "right") - 1
    inv = powers(_INV, n + 1)
    some = lambda a, b: mix((run[b] - run[a]) * inv[a] + (b - a).astype(np.uint64)) >> np.uint64(48)
    before, after = some(np.maximum(off[row], at - side), at), some(at + k, np.minimum(off[row + 1], at + k + side))
    return at, value[at], (before << np.uint64(16) | after).astype(np.uint32), reach


def row_anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, position in the row, hash, sides and reach of the anchors; a longer row than a segment is taken by overlapping segments.

    Every window lies whole in one segment, so all are found; an anchor between two has a reach in each.
    """
    if len(off) == 2 and len(data) > segment + window:
        for x in range(0, len(data) - window + 1, segment):
            part = data[x : x + segment + window - 1]
            pos, *rest = anchors(part, np.array([0, len(part)]), window)
            yield np.zeros(len(pos), np.int64), pos + x, *rest
    else:
        pos, *rest = anchors(data, off, window)
        row = np.searchsorted(off, pos, "right") - 1
        yield row, pos - off[row], *rest


def _keyed(docs: DataFrame, clashing: list[str] | None = None) -> DataFrame:
    """doc_id, text, sha, sig: 64 bits that stand for the text: of its SHA-256, or of a hash of that where texts would clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    sig = F.conv(F.substring("sha", 1, 16), 16, -10).cast("long")
    return rows.withColumn("sig", F.when(F.col("sha").isin(clashing), F.xxhash64("sha")).otherwise(sig) if clashing else sig)


def _hot(keyed: DataFrame, window: int) -> np.ndarray:
    """Hashes (ascending) of anchors with about HOT occurrences or more among the classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in slices(batch, "text"):
                for found in row_anchors(data, off, window):
                    h, n = np.unique(found[2], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
        give_back()

    some = keyed.where(F.pmod("sig", F.lit(SAMPLE)) == 0).select("sig", "text").dropDuplicates(["sig"])
    found = some.mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLE >= HOT)
    return np.sort(np.array([r["h"] for r in found.collect()], np.int64).view(np.uint64))  # at most one for each HOT anchors


def _among(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(h), bool)
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h


def _range(key: np.ndarray, n: int) -> np.ndarray:
    """Which of n even ranges of 64 bits each key lies in."""
    return ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


_DEALT = [("sigs", "<i8"), ("hashes", "<u4"), ("sides", "<u4"), ("positions", "<u4"), ("reaches", "<u2")]
_PLACES = [("sigs", "<i8"), ("positions", "<u4"), ("reaches", "<u2")]
_SPANS = [("sigs", "<i8"), ("starts", "<u4"), ("ends", "<u4")]
_PIECES = [("sigs", "<i8"), ("docs", "<i8"), ("starts", "<u4"), ("reaches", "<u2")]


def _schema(key: str, columns: list[tuple[str, str]], *more: str) -> str:
    return ", ".join([f"{key} int", *(f"{c} binary" for c, _ in columns), *(f"{c} binary" for c in more)])


def _dealt(keyed: DataFrame, buckets: int, hot: np.ndarray, window: int) -> DataFrame:
    """Anchors by ranges of their hash: bucket and packed columns; hot ones by ranges of their class, to buckets from `buckets` on.

    The bucket stands for the upper bits of a hash, so only the lower 32 go there. Different anchors that agree in
    them, and in a side, are merely looked at further: windows are told apart by their bytes.
    """

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        sig, h, side, pos, reach = (np.concatenate(c) for c in zip(*parts, strict=True))
        spread = _among(h, hot)
        to = _range(np.where(spread, sig.view(np.uint64), h), buckets) + spread * buckets
        return packed("bucket", to, _DEALT, (sig, h, side, pos, reach))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, size = set(), [], 0
        for batch in batches:
            sigs = batch.column("sig").to_numpy()
            for a, b, data, off in slices(batch, "text"):
                new = np.array([not (x in seen or seen.add(x)) for x in sigs[a:b].tolist()])  # a class once
                for row, pos, h, side, reach in row_anchors(data, off, window):
                    own = new[row]
                    parts.append((sigs[a + row[own]], h[own], side[own], pos[own], reach[own]))
                    size += int(own.sum())
                    if size > 400_000:
                        yield pack(parts)
                        parts, size = [], 0
                if len(seen) > 100_000:
                    seen = set()
        if size:
            yield pack(parts)
        parts = []
        give_back()

    return keyed.select("sig", "text").mapInArrow(work, _schema("bucket", _DEALT))


def _repeated(dealt: DataFrame, parts: int) -> DataFrame:
    """Anchors that another class has too, and all hot ones, by ranges of the class: part and packed columns."""

    def several(key: np.ndarray, sig: np.ndarray) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        many = np.minimum.reduceat(sig[order], start) != np.maximum.reduceat(sig[order], start)
        out = np.empty(len(key), bool)
        out[order] = np.repeat(many, np.diff(np.r_[start, len(key)]))
        return out

    def work(key: tuple, table: pa.Table) -> pa.Table:
        sig, h, side, pos, reach = (unpacked(table, *c) for c in _DEALT)
        again = np.full(len(h), key[0].as_py() >= parts)
        for k, s in enumerate(() if again.all() else (side >> np.uint32(16), side & np.uint32(0xFFFF))):
            again |= several(h.astype(np.uint64) + (s.astype(np.uint64) << np.uint64(1) | np.uint64(k)) * np.uint64(_BASE), sig)
        del h, side
        keep = np.flatnonzero(again)
        keep = keep[np.lexsort((reach[keep], pos[keep], sig[keep]))]
        sig, pos, reach = sig[keep], pos[keep], reach[keep]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (pos[1:] != pos[:-1]) | (reach[1:] != reach[:-1])][: len(sig)]
        sig, pos, reach = sig[new], pos[new], reach[new]  # the same class from several batches
        out = pa.Table.from_batches([packed("part", _range(sig, parts), _PLACES, (sig, pos, reach))])
        del again, keep, table
        give_back()
        return out

    return dealt.groupBy("bucket").applyInArrow(work, _schema("part", _PLACES))


def _by_class(repeated: DataFrame) -> DataFrame:
    """sig, positions (ascending), reaches (packed)."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        sig, pos, reach = (unpacked(table, *c) for c in _PLACES)
        order = np.lexsort((reach, pos, sig))
        sig, pos, reach = sig[order], pos[order], reach[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
        cuts = np.r_[first, len(sig)]
        out = pa.table({"sig": sig[first], "positions": binaries(pos, cuts), "reaches": binaries(reach, cuts)})
        give_back()
        return out

    return repeated.groupBy("part").applyInArrow(work, "sig long, positions binary, reaches binary")


# --- pieces ----------------------------------------------------------------


def _pieces(found: DataFrame, tasks: int, hot: np.ndarray, window: int) -> DataFrame:
    """Pieces by ranges of their anchor's hash: task, packed columns, blob (their bytes).

    The windows of hot anchors go by ranges of their own hashes to tasks from `tasks` on; the blob
    has 16 bytes of hashes for each. Of equal windows in a batch only one with the smallest doc_id
    goes there; what that one removes at once goes, as pieces, to tasks from 2 * `tasks` on.
    """

    def cold(parts: list[tuple]) -> pa.RecordBatch:
        sig, doc, start, reach, h = (np.concatenate([p[i] for p in parts]) for i in range(5))
        body, size = np.concatenate([p[5] for p in parts]), (reach >> 8).astype(np.int64) + window
        to = _range(h, tasks)
        return packed("task", to, _PIECES, (sig, doc, start, reach), ("blob", body, size))

    def warm(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig, doc, start, one, two = (np.concatenate(c) for c in zip(*parts, strict=True))
        kind, _ = _alike(one, two)
        order = np.lexsort((doc, kind))
        first = order[np.r_[True, kind[order][1:] != kind[order][:-1]]]
        least = np.empty(len(first), np.int64)
        least[kind[first]] = doc[first]
        gone = doc > least[kind]
        rest = first
        x, y = runs(sig[gone], start[gone])
        if len(x):
            s = sig[gone][x]
            yield packed("task", _range(s, tasks) + 2 * tasks, _PIECES, (s, start[gone][x].astype(np.int64), (start[gone][y] + window).astype(np.uint32), np.zeros(len(x), np.uint16)), ("blob", np.zeros(0, np.uint8), np.zeros(len(x), np.int64)))
        same = (doc == least[kind]) & ~np.isin(np.arange(len(doc)), rest)  # the same document has it again: as the first, wherever a smaller one is found
        rest = np.r_[rest, np.flatnonzero(same)]
        both = np.stack([one[rest], two[rest]], 1).astype("<u8").view(np.uint8).ravel()
        yield packed("task", _range(one[rest], tasks) + tasks, _PIECES, (sig[rest], doc[rest], start[rest], np.zeros(len(rest), np.uint16)), ("blob", both, np.full(len(rest), 16, np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, hots, many = [], 0, [], 0
        for batch in batches:
            for a, b, data, off in slices(batch, "text"):
                part = batch.slice(a, b - a)
                n = pc.binary_length(part.column("positions")).to_numpy() // 4
                row = np.repeat(np.arange(b - a), n)
                pos, reach = unpacked(part, "positions", "<u4").astype(np.int64), unpacked(part, "reaches", "<u2")
                sig, doc, at = part.column("sig").to_numpy()[row], part.column("doc").to_numpy()[row], pos + off[row]
                symbols = data.astype(np.uint64) + np.uint64(1)
                h, start = span_hash(symbols, at, at + ANCHOR), at - (reach & 255)
                spread = _among(h, hot)
                own = ~spread
                count = (reach[own] >> 8).astype(np.int64) + window
                body = data[np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                parts.append((sig[own], doc[own], (start - off[row])[own].astype(np.uint32), reach[own], h[own], body))
                size += len(count)
                if spread.any():
                    count = (reach[spread] >> 8).astype(np.int64) + 1
                    first = np.repeat(start[spread] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    of = np.repeat(np.flatnonzero(spread), count)
                    hots.append((sig[of], doc[of], (first - off[row[of]]).astype(np.uint32), span_hash(symbols, first, first + window), span_hash(mix(symbols), first, first + window)))
                    many += len(first)
                if size > 100_000:
                    yield cold(parts)
                    parts, size = [], 0
                if many > 300_000:
                    yield from warm(hots)
                    hots, many = [], 0
        if size:
            yield cold(parts)
        if many:
            yield from warm(hots)
        parts, hots = [], []
        give_back()

    return found.select("sig", "doc", "text", "positions", "reaches").mapInArrow(work, _schema("task", _PIECES, "blob"))


def runs(sig: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last rows of runs of the next place of the same class."""
    new = np.r_[True, (sig[1:] != sig[:-1]) | (start[1:] != start[:-1] + start.dtype.type(1))][: len(sig)]
    x = np.flatnonzero(new)
    return x, np.r_[x[1:], len(sig)][: len(x)] - 1


# --- shard suffix arrays and their merge -----------------------------------


class Shard(NamedTuple):
    """Rotations of a text in sorted order: the two symbols before each (its Burrows-Wheeler transform, two columns of it), and where it stands."""

    before: np.ndarray
    at: np.ndarray


def suffix_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """Rotations sorted by their first `depth` bytes, by prefix doubling.

    Every fragment ends with a separator; what follows it never counts as a match.
    """
    n, have = len(text), 4
    padded = np.concatenate([text, np.resize(text, 3)]).astype(np.int64)
    key = padded[:n] << 24 | padded[1 : n + 1] << 16 | padded[2 : n + 2] << 8 | padded[3 : n + 3]
    order = np.argsort(key, kind="stable")
    key = key[order]
    while have < depth:
        new = np.r_[False, key[1:] != key[:-1]]
        if new[1:].all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        both = rank * n + np.roll(rank, -have)
        order = np.argsort(both, kind="stable")
        key, have = both[order], 2 * have
    return order


def shard(text: np.ndarray, base: int = 0) -> Shard:
    """The shard of a text that starts at `base` among all texts of its task."""
    order = suffix_order(text)
    return Shard(text[order - 2].astype(np.uint16) << np.uint16(8) | text[order - 1], (order + base).astype(np.int32))


def interleave(a: Shard, b: Shard, depth: int = WINDOW) -> tuple[Shard, np.ndarray]:
    """Merge two shards by refining their interleave, and the common prefix of each entry with the one before.

    At first all of a stand before all of b. Each round moves every entry behind the two
    symbols before it, which sorts by two bytes more; no suffix is compared or sorted. The
    round in which neighbours part is their common prefix (rounded down to an even number;
    `depth` also stands for longer ones). Of an odd depth the last round takes one symbol.
    """
    source = np.r_[np.zeros(len(a.at), bool), np.ones(len(b.at), bool)]
    edge = np.arange(len(source)) == 0
    common = np.full(len(source), depth, np.uint8)
    common[:1] = 0
    symbol = np.empty(len(source), np.uint16)
    for h in range(0, depth, 2):
        last = np.uint16(0xFF if depth - h == 1 else 0xFFFF)
        symbol[~source], symbol[source] = a.before & last, b.before & last
        moved = np.argsort(symbol, kind="stable")  # a counting sort of 16 bits
        block = np.cumsum(edge, dtype=np.int32)[moved]
        sorted_ = symbol[moved]
        source = source[moved]
        now = np.r_[True, (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])][: len(source)]
        common[now & ~edge] = h
        edge = now | edge
    at = np.empty(len(source), np.int32)
    symbol[~source], symbol[source] = a.before, b.before
    at[~source], at[source] = a.at, b.at
    return Shard(symbol, at), common


def merged(shards: list[Shard], depth: int = WINDOW) -> tuple[Shard, np.ndarray]:
    """All shards merged pairwise up a tree, with the common prefixes of the last merge."""
    while len(shards) > 2:
        shards = [interleave(*pair, depth)[0] if len(pair) == 2 else pair[0] for pair in (shards[i : i + 2] for i in range(0, len(shards), 2))]
    return interleave(*shards, depth)


def least_documents(docs: np.ndarray, text: np.ndarray, ends: np.ndarray, window: int = WINDOW, shards: int = SHARDS) -> np.ndarray:
    """For each place of a text of pieces, each closed by a separator: the smallest document of a piece that has the window there.

    docs: the document of each piece; ends: where its separator stands. A place without a whole window has the greatest number.
    """
    sizes = np.diff(np.r_[-1, ends])
    doc = np.repeat(docs, sizes)
    doc[np.repeat(ends, sizes) - np.arange(len(text)) < window] = np.iinfo(np.int64).max
    cuts = np.unique(np.searchsorted(ends, len(text) * np.arange(1, shards) / shards))
    cuts = [0, *(ends[cuts[cuts < len(ends) - 1]] + 1).tolist(), len(text)]
    all_ = [shard(text[x:y], x) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    order, common = merged(all_ if len(all_) > 1 else [*all_, Shard(np.zeros(0, np.uint16), np.zeros(0, np.int32))], window)
    starts = np.flatnonzero(common < window)  # intervals of equal windows
    low = np.minimum.reduceat(doc[order.at], starts)
    least = np.empty(len(text), np.int64)
    least[order.at] = np.repeat(low, np.diff(np.r_[starts, len(text)]))
    return least


def _alike(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a pair of hashes the number of its kind, and the first row of each kind."""
    order = np.lexsort((other, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])][: len(h)]
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(new) - 1
    return kind, order[new]


def _cuts(size: np.ndarray, most: int, same: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; rows of one value of `same` stay together."""
    edge = np.flatnonzero(np.r_[True, same[1:] != same[:-1]][: len(size)]) if same is not None else np.arange(len(size))
    before = np.r_[0, np.cumsum(size)][edge]
    first = edge[np.r_[True, before[1:] // most != before[:-1] // most][: len(edge)]].tolist()
    return list(zip(first, [*first[1:], len(size)], strict=False))


def _resolve(sig, doc, start, reach, text: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed runs (sig, start, end) of the pieces of one task; text: their bytes one after the other.

    Anchors are merged in groups of about MERGE_BYTES: what has another anchor has no window in common.
    """
    size = (reach >> 8).astype(np.int64) + window
    ends = np.cumsum(size)
    begin = ends - size
    hashed, other, anchor = (np.empty(len(size), np.uint64) for _ in "123")
    for x, y in _cuts(size, MERGE_BYTES):
        symbols, here = text[begin[x] : ends[y - 1]].astype(np.uint64) + np.uint64(1), slice(x, y)
        a, b, at = begin[here] - begin[x], ends[here] - begin[x], begin[here] - begin[x] + (reach[here] & 255)
        hashed[here], other[here], anchor[here] = span_hash(symbols, a, b), span_hash(mix(symbols), a, b), span_hash(symbols, at, at + ANCHOR)
    which, first = _alike(hashed, other)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    by = np.argsort(anchor[first], kind="stable")  # kinds, those of one anchor together
    own = anchor[first][by]
    more = ~(np.r_[True, own[1:] != own[:-1]] & np.r_[own[1:] != own[:-1], True])[: len(own)]
    many = np.zeros(len(first), bool)
    many[by] = more
    gone = ~many[which] & (least[which] < doc)  # an anchor with one kind of piece
    out = [(sig[gone], start[gone], start[gone] + size[gone])]
    by, own = by[more], own[more]
    rank = np.full(len(first), len(by))
    rank[by] = np.arange(len(by))
    members = np.argsort(rank[which], kind="stable")
    ranks, sizes = rank[which][members], size[first][by]
    for x, y in _cuts(sizes, MERGE_BYTES, own):
        close = np.cumsum(sizes[x:y] + 1) - 1
        head = close - sizes[x:y]
        body = text[np.minimum(np.arange(close[-1] + 1) + np.repeat(begin[first][by[x:y]] - head, sizes[x:y] + 1), len(text) - 1)]
        body[close] = 0
        low = least_documents(least[by[x:y]], body, close, window)
        a, b = np.searchsorted(ranks, [x, y])
        for m in range(a, b, 50_000):
            piece = members[m : min(b, m + 50_000)]
            n = size[piece] - window + 1
            owner = np.repeat(np.arange(len(piece)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            gone = low[head[ranks[m : m + len(piece)] - x][owner] + place] < doc[piece][owner]
            owner, place = owner[gone], place[gone]
            first_, last = runs(owner, place)
            at = start[piece][owner[first_]]
            out.append((sig[piece][owner[first_]], at + place[first_], at + place[last] + window))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _resolve_windows(sig, doc, start, both: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed runs of windows told apart by two hashes."""
    kind, first = _alike(both[:, 0], both[:, 1])
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    gone = least[kind] < doc
    sig, start = sig[gone], start[gone].astype(np.int64)
    return sig, start, start + window


def _spans(pieces: DataFrame, tasks: int, window: int) -> DataFrame:
    """sig, spans (sorted, disjoint): what goes from each first document."""

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        (sig, doc, start, reach), blob = (unpacked(table, *c) for c in _PIECES), unpacked(table, "blob", "u1")
        kind = key[0].as_py() // tasks
        if kind == 2:
            sig, a, b = sig, doc, start
        elif kind == 1:
            sig, a, b = _resolve_windows(sig, doc, start, blob.view("<u8").reshape(-1, 2), window)
        else:
            sig, a, b = _resolve(sig, doc, start.astype(np.int64), reach, blob, window)
        out = pa.Table.from_batches([packed("part", _range(sig, tasks), _SPANS, (sig, a.astype("<u4"), b.astype("<u4")))])
        del doc, start, reach, blob, table
        give_back()
        return out

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        sig, a, b = (unpacked(table, *c) for c in _SPANS)
        order = np.lexsort((b, a, sig))
        sig, a, b = sig[order], a[order].astype(np.int64), b[order].astype(np.int64)
        lift = np.cumsum(np.r_[False, sig[1:] != sig[:-1]][: len(sig)]) << 33  # classes one after the other on a line
        far = np.maximum.accumulate(b + lift) if len(sig) else b
        new = np.flatnonzero(np.r_[True, (a + lift)[1:] > far[:-1]][: len(sig)])
        a, b, sig = a[new], (far - lift)[np.r_[new[1:], len(far)][: len(new)] - 1], sig[new]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
        each = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"])
        return pa.table({"sig": sig[first], "spans": pa.ListArray.from_arrays(pa.array(np.r_[first, len(sig)], pa.int32()), each)})

    found = pieces.groupBy("task").applyInArrow(resolve, _schema("part", _SPANS))
    return found.groupBy("part").applyInArrow(unite, "sig long, spans array<struct<start: long, end: long>>")


def _analysed(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (doc_id, sig, n_bytes, sha, first), removed spans (sig, spans) of first documents, and clashing SHA-256s."""
    if not ANCHOR + 2 <= window <= 64:  # suffixes are sorted by 64 bytes
        raise ValueError(f"window: {window} is not between {ANCHOR + 2} and 64 bytes")
    keyed = _keyed(docs)
    rows = stored(keyed.select("doc_id", "sig", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    firsts = stored(rows.groupBy("sig", "sha").agg(F.min("doc_id").alias("first"), F.max("n_bytes").alias("n"), F.count("*").alias("copies")), "firsts")
    clash = firsts.withColumn("least", F.min("sha").over(Window.partitionBy("sig"))).where("sha <> least").select("sha")
    clash = [r["sha"] for r in clash.collect()]  # by chance some 25 among 3 * 10**10 texts
    if clash:
        keyed = _keyed(docs, clash)
        sig = lambda df: df.withColumn("sig", F.when(F.col("sha").isin(clash), F.xxhash64("sha")).otherwise(F.col("sig")))
        rows, firsts = sig(rows), sig(firsts)
    total, copies = firsts.agg(F.sum("n"), F.max("copies")).first()
    buckets = max(8, -(-(total or 0) * 2 // (window - ANCHOR + 2) // BUCKET_ANCHORS))
    hot = _hot(keyed, window)
    with passing(_by_class(_repeated(_dealt(keyed, buckets, hot, window), buckets)), "anchors") as again:
        again = again.join(firsts.select("sig", F.col("first").alias("doc")), "sig")
        found = again.join(keyed.select("sig", "doc_id", "text"), "sig").where("doc_id = doc")
        if rows.count() > rows.select("doc_id").distinct().count():
            found = found.dropDuplicates(["sig"])
        cut = stored(_spans(_pieces(found, 2 * buckets, hot, window), 2 * buckets, window), "spans")
    return rows.join(firsts.select("sig", "first"), "sig"), cut, clash


def removed_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows, spans, clash = _analysed(docs, window)
    rows = rows.join(spans.select("sig", F.lit(True).alias("some")), "sig", "left")
    copy = (F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= window)
    own = (F.col("doc_id") == F.col("first")) & F.col("some")
    empty = hashlib.sha256(b"").hexdigest()
    plain = rows.where(~F.coalesce(own, F.lit(False))).select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(copy, 1).otherwise(0).cast("long").alias("n_spans"), F.when(copy, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                cut, kept, at = [(x["start"], x["end"]) for x in spans.as_py()], hashlib.sha256(), 0
                for a, b in cut:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((doc.as_py(), len(data), sum(b - a for a, b in cut), len(cut), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    firsts = rows.where(own).select("sig", "first").distinct()
    cut = _keyed(docs, clash).select("sig", "doc_id", "text").join(spans.join(firsts, "sig"), "sig").where("doc_id = first").select("doc_id", "text", "spans")
    return plain.unionByName(cut.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with repeated bytes cut out of text, and n_chars to match where it is there.

    A cut never parts a character: its partial bytes stay. A text that was repeated whole
    drops out; a text that was empty or null at first stays.
    """
    rows, spans, clash = _analysed(docs, window)
    own_, id_, sig_, spans_ = (unused(c, docs.columns) for c in ("_own", "_id", "_sig", "_spans"))
    marks = rows.join(spans, "sig", "left").select("sig", "doc_id", "first", "n_bytes", "spans").dropDuplicates(["sig", "doc_id"])
    marks = marks.withColumn("whole", F.coalesce((F.col("doc_id") != F.col("first")) & (F.col("n_bytes") >= window), F.lit(False)))
    marks = marks.where("not whole").select(F.col("sig").alias(sig_), F.col("doc_id").alias(id_), F.when(F.col("doc_id") == F.col("first"), F.col("spans")).alias(spans_))

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if s is None or not len(s):
                out.append(t)
                continue
            data, parts, at = t.encode("utf-8", "surrogatepass"), [], 0
            for a, b in ((x["start"], x["end"]) for x in s):
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(data[at:a])
                at = b
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    sig = F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")
    sig = F.when(sha.isin(clash), F.xxhash64(sha)).otherwise(sig) if clash else sig
    joined = docs.withColumn(own_, sig).join(marks, (F.col(own_) == F.col(sig_)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    touched = joined.where(F.col(spans_).isNotNull()).withColumn("text", kept("text", spans_)).where("text <> ''")
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.where(F.col(spans_).isNull()).select(*docs.columns).unionByName(touched.select(*docs.columns))
