"""Language-model scores by online logistic context mixing over bits.

The text is its tokens (A-Z lower-cased, runs without white space), each with a closing
byte, then one end: a closing byte alone. The commonest training tokens (CODED of them, that occur LEAST times or more) stand as words of one to three
bytes, whose closing byte no token has; all others are spelt. So each text has one form and each form one text,
and the probability of the form is that of the text; it has half the bytes or less. Every byte of this running text is predicted bit by bit. Predictors are tables of counts
in hashed contexts: the last 1, 2, 3 or 4 bytes of the text, whatever tokens they belong to (in a spelt token, beyond its first byte, those of the token); the whole token so far,
which is kept in two tables of which the one with fewer counts is believed; and the token before with the token so far. Their
stretched probabilities are combined by weights that two gates choose (how much the
whole-token and 4-byte contexts have seen, and the place in the token), learned
online; an adaptive map of the mixed probability corrects what is left. On top, each token's probability
by the mixer is blended, half and half, with discounted counts of whole tokens that leave their rest to it, and
each document adapts online to its own tokens: the blend is the base of two urns of
different weight, and of one model for each class of training documents (hashed lang, at most
16). The mixer alone, the blend and these are mixed by how well they did so
far in the document; a document's own lang is not looked at.

All learning runs over the running text of all training documents: one pass for the count
tables; one in which the weights take steps along the text, each bit predicted as if it had not been counted itself; and
one that counts the map, under the weights that it is applied to. Count tables and map are
sums over partitions, weights their means. The bit tables have a fixed size (BITS) at any input; the
table of tokens grows with the corpus. The discounted counts need each token's count:
coded tokens (`common` of them) are looked up in a broadcast of that bounded
size, all others by a join.

Nulls are empty texts: one end token. Repeated rows are scored each. Of tokens with as many occurrences
the first by bytes gets a word. Without training tokens N is 0 and base scores are
those of the formula with c = 0. A text is read whole; the bits of a text of more than LONG bytes are taken part by part, with the
contexts of the whole. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice, product, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _BASE, _INV, powers
from ._common import stored, texts

#: log2 of the slots of each context's table: orders 1 to 4, whole token twice, the token before and this one.
BITS = (16, 18, 19, 20, 20, 20, 20)
CONF, PLACES, STEPS, BLOCK = 8, 4, 33, 1 << 14
URNS = (3000.0, 300.0)
TASK_BYTES = 64 << 20  # text of one training task
LONG = 1 << 17  # bytes of a text above which it is taken part by part
TOGETHER = 1 << 15  # bytes of shorter texts whose bits are looked at together
STEP = 1 << 14  # bits of one step of the weights
COMMON_BYTES = 1 << 18  # of common tokens whose predictions are made once a task, 40 bytes for each
CODED, LEAST = 1 << 18, 16  # of the commonest training tokens, those that get a word of the code, and how often they occur at least: fewer, and spelt tokens would be too rare in training
N_IN = 7  # five predictors, a constant, and the predictor by the token before
_SEED = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

_BITS_OF = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.int8)  # the bits of each byte, the highest first
_NODES = np.stack([1 << b % 4 | (np.arange(256) >> (4 - 4 * (b // 4)) & 15) >> (4 - b % 4) for b in range(8)], 1).astype(np.int32)  # what is known of a half before each bit

_FREE = [*range(9, 14), *range(65, 91), 0xC0, 0xC1, *range(0xF5, 256)]  # bytes that no token has
_LEADS = [*range(9), *range(14, 32), *range(0x80, 0xC0)]  # bytes that few tokens begin with, so that words are hardly taken for spelt tokens
_SPACE = np.arange(256) == 32
_CLOSING = _SPACE | np.isin(np.arange(256), _FREE)  # bytes that end a token in coded text
_WORDS = np.isin(np.arange(256), [*_FREE, *_LEADS])  # bytes that a word begins with
_DIGIT = np.full(256, -1, np.int64)  # of a byte among its kind
_DIGIT[_FREE], _DIGIT[_LEADS] = np.arange(len(_FREE)), np.arange(len(_LEADS))
_FIRST_OF = np.cumsum([0, len(_FREE), len(_LEADS) * len(_FREE), len(_LEADS) ** 2 * len(_FREE)])  # words of 1, 2, 3 bytes


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def running(toks: list[bytes]) -> bytes:
    """The text that is predicted, but for its last byte (the end's closing one), which every item gets."""
    return b" ".join([*toks, b""])


class Code(dict):
    """For the commonest training tokens the bytes that stand for them, ended by a byte that no token has; every other token is itself, closed by a space."""

    def __missing__(self, token: bytes) -> bytes:
        return token + b" "

    def running(self, toks: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, toks))


def words() -> Iterator[bytes]:
    """The words of the code, the shortest first: none begins another, nor a token closed by a space."""
    for n in range(len(_FIRST_OF) - 1):
        for lead in product(_LEADS, repeat=n):
            for end in _FREE:
                yield bytes((*lead, end))


def code_of(common: list[bytes], kinds: list[int] | None = None) -> Code:
    """Words for the tokens, the shortest for the commonest, unless they would be longer than the token with its space. Of words of one length, those with one end are for tokens of one kind."""
    sizes = np.diff(_FIRST_OF).tolist()
    taken: list[list[int]] = [[] for _ in sizes]
    n = 0
    for i, token in enumerate(common):
        if len(taken[n]) == sizes[n]:
            n += 1
            if n == len(sizes):
                break
        if token and n <= len(token):
            taken[n].append(i)
    order = []
    for part in taken:
        place = np.lexsort((np.arange(len(part)), np.arange(len(part)) % len(_FREE)))
        own = np.empty(len(part), np.int64)
        own[place] = sorted(part, key=kinds.__getitem__) if kinds else part
        order += own.tolist()
    return Code(zip((common[i] for i in order), words(), strict=False))


def ranks(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The number of the word at each start in coded text; -1 for a token that is itself."""
    out = np.full(len(starts), -1)
    last = data.take(starts + length - 1)
    end, closed = _DIGIT.take(last), (_CLOSING & ~_SPACE).take(last)
    for n in range(1, len(_FIRST_OF)):
        own = np.flatnonzero(closed & (length == n))
        at = np.zeros(len(own), np.int64)
        for j in range(n - 1):
            at = at * len(_LEADS) + _DIGIT.take(data.take(starts[own] + j))
        out[own] = _FIRST_OF[n - 1] + at * len(_FREE) + end[own]
    return out


# --- counts over the corpus ------------------------------------------------


def class_of(docs: DataFrame):
    """A number below 16 for a training document's lang; 0 without such a column."""
    if "lang" not in docs.columns:
        return F.lit(0)
    return F.pmod(F.xxhash64(F.coalesce(F.col("lang").cast("string"), F.lit(""))), F.lit(16)).cast("int")


def token_counts(docs: DataFrame, classes: list[int]) -> DataFrame:
    """token (the end is empty), c (in training documents), n (in all), and c of each class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: dict[tuple[int, bool], Counter]) -> Iterator[pa.RecordBatch]:
            for (kind, held), counter in found.items():
                n = np.fromiter(counter.values(), np.int64, len(counter))
                yield pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(np.full(len(n), kind, np.int32)), pa.array(n * (not held)), pa.array(n)], ["token", "kind", "c", "n"])

        found: dict[tuple[int, bool], Counter] = {}
        for batch in batches:
            for text, held, kind in zip(batch.column("text"), batch.column("held_out").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                found.setdefault((kind, held), Counter()).update([*tokens(text.as_py()), b""])
                if sum(map(len, found.values())) > 1_000_000:
                    yield from out(found)
                    found = {}
        yield from out(found)

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"), class_of(docs).alias("kind"))
    each = rows.mapInArrow(work, "token binary, kind int, c long, n long")
    own = [F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in classes]
    return each.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), *own)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1


# --- bits of texts and their contexts ----------------------------------------


class Piece(NamedTuple):
    """A part of a long text: its bytes (with the closing one at the end), the four before, its place in its token and the hash of that token so far, its place in the text and the hash of the token before."""

    data: bytes
    last: bytes
    place: int
    hashed: int
    at: int = 0
    before: int = 0


def _hashed(part: bytes) -> int:
    return int(((np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part))).sum(dtype=np.uint64))


_OTHER_END = 0xD6E8FEB86659FD93  # a token before has its end in its hash, where that isn't a space


def pieces(text: bytes, size: int, coded: bool = False) -> Iterator[Piece]:
    """A text part by part, so that its bits need no more memory than those of `size` bytes."""
    closing = _CLOSING if coded else _SPACE
    closed, place, hashed, before = text + b" ", 0, 0, 0
    for a in range(0, len(closed), size):
        part = closed[a : a + size]
        yield Piece(part, closed[max(0, a - 4) : a], place, hashed, a, before)
        begin, cut = [0, 0, *(np.flatnonzero(closing.take(np.frombuffer(part, np.uint8)))[-2:] + 1).tolist()][-2:]
        if cut:  # the token before the one that goes on
            own = _hashed(part[begin : cut - 1])
            before = own if begin else (hashed + own * pow(_BASE, place, 1 << 64)) % (1 << 64)
            before = (before + cut - 1 - begin + (0 if begin else place) + (part[cut - 1] - 32) * _OTHER_END) % (1 << 64)
            place, hashed = 0, 0
        hashed = (hashed + _hashed(part[cut:]) * pow(_BASE, place, 1 << 64)) % (1 << 64)
        place += len(part) - cut


def _entries(context: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, upper: np.ndarray | None = None) -> np.ndarray:
    """For each byte and half of it: sixteen times the line of table k, plus the half itself. upper: of the lines, those of the upper half of the table, and all others of the lower one."""
    context = context + np.uint64(k + 1)
    context *= _SEED[k]
    x = context >> np.uint64(29)
    context ^= x
    out, shifted = np.empty((len(context), 2), np.uint64), np.empty_like(context)
    bits = BITS[k] - (upper is not None)
    top = upper.astype(np.uint64) << np.uint64(bits) if upper is not None else None
    for half, own in enumerate((high, low)):
        if half:
            context += high
            context += np.uint64(1)
        np.multiply(context, _SEED[6 - k], out=x)
        x ^= np.right_shift(x, np.uint64(31), out=shifted)
        x *= _SEED[k]
        x >>= np.uint64(64 - bits)
        x &= np.uint64(0xFFFFFFFFFFFFFFF0)
        if top is not None:
            x |= top
        np.bitwise_or(x, own, out=out[:, half])
    return out.view(np.int64)


_PAIRS = np.arange(1 << 16, dtype=np.uint64)  # the byte before and this one
_FIRST = _entries(_PAIRS >> np.uint64(8), _PAIRS >> np.uint64(4) & np.uint64(15), _PAIRS & np.uint64(15), 0)  # table 0, whose context is one byte


class Contexts(NamedTuple):
    """The bytes of texts, or of one piece, and for each: its place in its token, the byte before and itself, and its entries in the tables (bytes x 2; NONE[6] in the last one where there is no token before; None for tables not asked for).

    With `common`, tables 4 and 5 have entries only for the bytes in `rest`; the others have rows.
    """

    data: np.ndarray
    place: np.ndarray
    pair: np.ndarray
    entries: list[np.ndarray | None]
    size: np.ndarray
    rows: np.ndarray | None
    rest: np.ndarray | None


NONE = [1 << b for b in BITS]  # the entry after all others


def contexts_of(batch: list[bytes] | list[Piece], which: tuple[int, ...] = tuple(range(len(BITS))), common: dict[bytes, int] | np.ndarray | None = None, coded: bool = False, closed: bool = False) -> Contexts:
    """Contexts reach across tokens to the start of the text. common: the row of the first byte of tokens that are looked up whole, or of words by rank; coded: the texts are in the code; closed: they have their last closing byte."""
    piece = batch[0] if batch and isinstance(batch[0], Piece) else None
    text = piece.data if piece else b"".join(batch) if closed else b" ".join([*batch, b""])
    data = np.frombuffer(text, np.uint8)
    size = np.array([len(piece.data)] if piece else [len(t) + (not closed) for t in batch])
    first = np.cumsum(size) - size
    begins = np.zeros(len(data), bool)
    begins[1:] = (_CLOSING if coded else _SPACE).take(data[:-1])
    begins[first] = True
    starts = np.flatnonzero(begins)  # of tokens
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, length)
    if piece:
        place[: length[0]] += piece.place
    wide = data.astype(np.uint64)
    longer = np.concatenate([np.frombuffer((b"\0" * 4 + piece.last)[-4:] if piece else b"\0" * 4, np.uint8).astype(np.uint64), wide])
    last = [longer[4 - k : len(longer) - k] for k in (1, 2, 3, 4)]
    if len(size) > 1:  # nothing reaches into another text
        last = [v.copy() for v in last]
        for k, v in enumerate(last):
            for j in range(k + 1):
                v[(first + j)[j < size]] = 0
    spelt = None
    if coded:  # beyond the first byte, spelt tokens have contexts and lines of their own: letters are few and would be lost among the words
        itself = ~_WORDS.take(data.take(starts))
        if piece and piece.place:
            itself[0] = piece.place >= len(_FIRST_OF) - 1 or not _WORDS[piece.last[-piece.place]]
        spelt = np.repeat(itself, length) & (place > 0)
        last = [np.where(spelt & (place <= k), np.uint64(0), v) for k, v in enumerate(last)]
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((wide + np.uint64(1)) * powers(_BASE, len(data)), out=run[1:])
    whole = run[:-1] - np.repeat(run[starts], length)
    whole *= np.repeat(powers(_INV, len(data) + 1)[starts], length)
    if piece:
        whole[: length[0]] = whole[: length[0]] * np.uint64(pow(_BASE, piece.place, 1 << 64)) + np.uint64(piece.hashed)
    whole += place.view(np.uint64)
    # the token before: what the whole token was at its closing byte; none for the first token of a text
    before = np.zeros(len(starts), np.uint64)
    before[1:] = whole[starts[1:] - 1] + (wide[starts[1:] - 1] - np.uint64(32)) * np.uint64(_OTHER_END)
    alone = np.searchsorted(starts, first)
    before[alone] = np.uint64(piece.before if piece else 0)
    high, low = wide >> np.uint64(4), wide & np.uint64(15)
    pair = (last[0] << np.uint64(8) | wide).view(np.int64)
    entries: list[np.ndarray | None] = [None] * len(BITS)
    if 0 in which:
        entries[0] = _FIRST.take(pair, axis=0)
    context = last[0]
    for k in (1, 2, 3):
        context = context << np.uint64(8) | last[k]
        if k in which:
            entries[k] = _entries(context, high, low, k, spelt)
    if 6 in which:
        entries[6] = _entries(whole + np.repeat((before + np.uint64(1)) * _SEED[5], length), high, low, 6, spelt)
        for i in alone.tolist():
            if not piece or piece.at == piece.place:
                entries[6][starts[i] : starts[i] + length[i]] = NONE[6]
    rows = rest = None
    if common is not None and len(common) and not piece:
        if isinstance(common, dict):
            row = np.fromiter(map(common.get, text.split(b" "), repeat(-1)), np.int64, len(starts))
        else:
            row = ranks(data, starts, length)
            row = np.where((row >= 0) & (row < len(common)), common.take(row, mode="clip"), -1)
        rows = np.arange(len(data)) + np.repeat(row - starts, length)
        rest = np.flatnonzero(np.repeat(row < 0, length))
        whole, high, low, spelt = whole[rest], high[rest], low[rest], spelt if spelt is None else spelt[rest]
    for k in (4, 5):
        if k in which:
            entries[k] = _entries(whole, high, low, k, spelt)
    return Contexts(data, place, pair, entries, size, rows, rest)


def bit_slots(batch: list[bytes] | list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all bits of the texts, or of one piece: slots (7 tables x bits), the bits, places in the token, and the text each belongs to.

    In the last table slot 0 stands for no token before.
    """
    data, place, _, entries, size, *_ = contexts_of(batch)
    nodes = _NODES[data].reshape(-1, 2, 4)
    slots = np.stack([((e & -16)[..., None] + nodes) * (e < none)[..., None] for e, none in zip(entries, NONE, strict=True)]).astype(np.int32)
    return slots.reshape(len(BITS), -1), _BITS_OF[data].ravel(), np.repeat(np.minimum(place, PLACES - 1), 8), np.repeat(np.repeat(np.arange(len(batch)), size), 8)


def _sum_blocks(parts: DataFrame) -> list:
    """Blocks of numbers (name, block, data as doubles) added up over partitions."""

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, "<f4").astype(np.float64) for x in pdf["data"]], axis=0)
        return pd.DataFrame({"name": [key[0]], "block": [key[1]], "data": [total.astype("<f4").tobytes()]})

    return parts.groupBy("name", "block").applyInPandas(add, "name int, block int, data binary").toArrow().to_pylist()  # the tables' fixed size


def _partial(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].astype("<f4").tobytes() for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["name", "block", "data"])


_BLOCKS = "name int, block int, data binary"


def _batches(batches: Iterator[pa.RecordBatch], size: int = 2048, coded: bool = False) -> Iterator[tuple[list[bytes] | list[Piece], np.ndarray]]:
    for batch in batches:
        toks, c = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
        a = 0
        while a < len(toks):
            b, n = a, 0
            while b < len(toks) and b - a < size and (b == a or n + len(toks[b]) < min(LONG, TOGETHER)):
                n += len(toks[b])
                b += 1
            if n > LONG:  # one text, part by part
                yield from (([piece], c[a:b]) for piece in pieces(toks[a], LONG, coded))
            else:
                yield toks[a:b], c[a:b]
            a = b


def nodes_of(halves: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 in each slot (slots x 2) from those of each half of a byte in each line."""
    halves = halves.reshape(-1, 16)
    out = np.zeros((len(halves), 16, 2), np.float32)
    for b in range(4):
        out[:, 1 << b : 2 << b] = halves.reshape(len(halves), 1 << b, 2, -1).sum(3)
    return out.reshape(-1, 2)


def running_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The running text of each text, with 1; made where it is used, as a worker more for it costs memory."""
    for batch in batches:
        text = [running(tokens(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(np.ones(len(text), np.int64))], ["running", "c"])


def count_tables(train: DataFrame, counts: DataFrame, code: Broadcast[Code] | None = None) -> list[np.ndarray]:
    """For each context the counts of 0 and 1 in its slots (slots x 2). A half of a byte is counted once, for its four bits, and a whole token with its number in `counts`.

    code: of the training texts (coded, c); its tokens are spelt once each too, so that others are spelt as they would be.
    """
    coded = code is not None

    def recoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(code.value.__getitem__, batch.column(0).to_pylist()), pa.binary()), batch.column(1)], ["token", "c"])

    def by_half(which: tuple[int, ...], made=iter, closed: bool = False):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = {k: np.zeros(NONE[k] + 1) for k in which}
            for toks, c in _batches(made(batches), coded=coded):
                found = contexts_of(toks, which, coded=coded, closed=closed)
                times = 1.0 if (c == 1).all() else np.repeat(c, found.size * 2)
                for k, t in tables.items():
                    np.add.at(t, found.entries[k].ravel(), times)
            for k, t in tables.items():
                for b in range(0, NONE[k], BLOCK):
                    if t[b : b + BLOCK].any():
                        yield _partial([(k, b // BLOCK, t[b : b + BLOCK])])

        return work

    own, each = (by_half((0, 1, 2, 3, 6)), by_half((4, 5), recoded, True)) if coded else (by_half((0, 1, 2, 3, 6), running_texts), by_half((4, 5)))
    parts = train.mapInArrow(own, _BLOCKS).unionByName(counts.mapInArrow(each, _BLOCKS))
    tables = [np.zeros(none) for none in NONE]
    for r in _sum_blocks(parts):
        block = np.frombuffer(r["data"], "<f4")
        tables[r["name"]][r["block"] * BLOCK :][: len(block)] = block
    spelt = list(code.value) if coded else []
    for a in range(0, len(spelt), 2048):
        for k, entries in enumerate(contexts_of(spelt[a : a + 2048], tuple(range(6)), coded=True).entries[:6]):
            np.add.at(tables[k], entries.ravel(), 1.0)
    return [nodes_of(t) for t in tables]


# --- mixing ------------------------------------------------------------------


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


_CELLS = PLACES * CONF**2  # a cell: the bit, the place and both confidences
_PLACE_CELLS = (_BITS_OF.astype(np.int32) * _CELLS + np.arange(PLACES, dtype=np.int32)[:, None, None] * CONF**2).reshape(-1, 8).view("V32").ravel()  # by place and byte
_BIT_MAPS = (_BITS_OF.astype(np.int32) * (CONF * STEPS)).view("V32").ravel()
_HALF_NODES = _NODES[:16, 4:].astype(np.int64) * 2 + _BITS_OF[:16, 4:]  # in a line, the slots and bits that make a half


def bounded(common: list[bytes]) -> list[bytes]:
    """The first tokens that have COMMON_BYTES with their closing bytes."""
    return common[: int(np.searchsorted(np.cumsum([len(t) + 1 for t in common]), COMMON_BYTES, "right"))]


class Inputs(NamedTuple):
    """The predictions for the bits of texts, times -1 where the bit is 0 (predictors x bits), so that a sum is for the bit that came; cells, confidence of the whole token, and bytes."""

    x: np.ndarray
    cell: np.ndarray
    sure: np.ndarray
    data: np.ndarray
    size: np.ndarray


def confidence(seen: np.ndarray) -> np.ndarray:
    """The whole logarithm to base 2 of counts (one is the least), below CONF: their exponents. The counts are overwritten."""
    sure = seen.view(np.int32)
    sure >>= 23
    np.minimum(sure, 127 + CONF - 1, out=sure)
    sure -= 127
    return sure


class Mixer:
    """Gated weights over the predictors and the map that corrects them."""

    def __init__(self, tables: list[np.ndarray], common: list[bytes] | None = None, coded: int | None = None):
        """common: tokens whose predictions by the whole token are made once, which changes no result; coded: texts are coded with so many words, and those are the common ones."""
        self.tables, self.coded = tables, coded is not None
        self.common = list(islice(words(), coded)) if self.coded else common or []
        self.weights = [np.full((CONF * PLACES, N_IN), 0.12), np.full((CONF * PLACES, N_IN), 0.12)]
        self.map = None
        self.looked: dict[bool, list[np.ndarray]] = {}
        self.made: dict[bool, tuple[dict[bytes, int] | np.ndarray, np.ndarray, np.ndarray]] = {}

    def look_up(self, leave_out: bool, last: bool = False) -> list[np.ndarray]:
        """For each table, by entry, the four stretched predictions (by pairs of bytes the eight, in table 0), in tables 3 to 5 with one more than the counts behind them. leave_out: as if each bit had been seen once less; last: the counts are given up."""
        if leave_out not in self.looked:
            found = []
            for k in range(len(BITS)):
                t = self.tables[k].astype(np.float32, copy=False)
                if last:
                    self.tables[k] = None
                rows = np.zeros((len(t) + 1, 8 if 3 <= k <= 5 else 4), np.float32)  # the last: no token before
                for a in range(0, len(t), BLOCK):  # a few at a time, as workers keep what they once took
                    part = t[a : a + BLOCK]
                    value, count = np.empty_like(part), np.empty_like(part)
                    for bit in (0, 1):
                        own, other = np.maximum(part[:, bit] - np.float32(leave_out), 0), part[:, 1 - bit]
                        value[:, bit] = np.log((own + np.float32(0.02)) / (other + np.float32(0.02)))
                        count[:, bit] = own + other + 1
                    for b in range(0, rows.shape[1], 4):
                        rows[a : a + len(part), b : b + 4] = (count if b else value).reshape(-1, 32).take(_HALF_NODES, axis=1).reshape(-1, 4)
                del t
                rows = rows.take(_FIRST, axis=0).reshape(-1, 8) if k == 0 else rows
                found.append(rows.view(f"V{4 * rows.shape[1]}").ravel())
            self.looked[leave_out] = found
        return self.looked[leave_out]

    def whole(self, found: Contexts, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Predictions by the whole token and its confidence (bits of the bytes that have entries)."""
        own, other = (self.look_up(leave_out)[k].take(found.entries[k].ravel(), mode="clip").view(np.complex128).reshape(-1, 2) for k in (4, 5))  # four predictions, four counts
        (x, seen), (change, less) = ([v[:, j].copy().view(np.float32) for j in (0, 1)] for v in (own, other))
        # the second table of the whole token, where it has seen less; by a mask, as that is half of them
        change, bits = change.view(np.int32), x.view(np.int32)
        change ^= bits
        change &= np.negative((less < seen).view(np.int8)).astype(np.int32)
        bits ^= change
        return x, confidence(np.minimum(seen, less, out=seen))

    def whole_of(self, leave_out: bool) -> tuple[dict[bytes, int] | np.ndarray, np.ndarray, np.ndarray]:
        """For the common tokens with their closing bytes: the row of the first byte of each, and by row what `whole` has for its eight bits."""
        if leave_out not in self.made:
            toks, end = self.common, np.cumsum([len(t) + (not self.coded) for t in self.common])
            first = [0, *map(int, end)]
            x, sure = np.empty(8 * first[-1], np.float32), np.empty(8 * first[-1], np.int8)
            for a in range(0, len(toks), 2048):
                place = slice(8 * first[a], 8 * first[min(a + 2048, len(toks))])
                x[place], sure[place] = self.whole(contexts_of(toks[a : a + 2048], (4, 5), coded=self.coded, closed=self.coded), leave_out)
            self.made[leave_out] = np.array(first[:-1]) if self.coded else dict(zip(toks, first, strict=False)), x.view("V32"), sure.view(np.int64)
        return self.made[leave_out]

    def inputs(self, toks: list[bytes] | list[Piece], leave_out: bool) -> Inputs:
        """leave_out: as if each bit had been seen once less."""
        common, known, known_sure = self.whole_of(leave_out)
        found, tables = contexts_of(toks, common=common, coded=self.coded), self.look_up(leave_out)
        data, entries = found.data, found.entries
        x = np.empty((N_IN - 1, len(data) * 8), np.float32)
        tables[0].take(found.pair, out=x[0].view("V32"), mode="clip")
        for k, row in ((1, 1), (2, 2), (6, 5)):
            tables[k].take(entries[k].ravel(), out=x[row].view("V16"), mode="clip")
        fourth = tables[3].take(entries[3].ravel(), mode="clip").view(np.complex128).reshape(-1, 2)
        x[3].view(np.complex128)[:] = fourth[:, 0]
        rest, sure = self.whole(found, leave_out)
        if found.rows is None:
            x[4] = rest
        else:
            known.take(found.rows, out=x[4].view("V32"), mode="clip")
            x[4].reshape(-1, 8)[found.rest] = rest.reshape(-1, 8)
            rest_sure, sure = sure, known_sure.take(found.rows, mode="clip").view(np.int8).astype(np.int32)
            sure.reshape(-1, 8)[found.rest] = rest_sure.reshape(-1, 8)
        cell = confidence(fourth[:, 1].copy().view(np.float32))
        cell += sure * CONF
        cell += _PLACE_CELLS.take(np.minimum(found.place, PLACES - 1) * 256 + data, mode="clip").view(np.int32)
        return Inputs(x, cell.astype(np.intp), sure, data, found.size)

    def by_cell(self) -> np.ndarray:
        """The sum of both gates' weights (inputs x cells), the constant's times -0.3 or 0.3 by the bit."""
        first, second = (w.reshape(CONF, PLACES, N_IN) for w in self.weights)
        both = (first.transpose(2, 1, 0)[:, :, :, None] + second.transpose(2, 1, 0)[:, :, None]).reshape(N_IN, -1)
        both = np.concatenate([both, both], 1)
        both[5] *= np.repeat([-0.3, 0.3], _CELLS)
        return both.astype(np.float32)

    def mixed(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The mixed prediction of the bit that came, stretched."""
        both = self.by_cell()
        z, w = both[5].take(cell, mode="clip"), np.empty(len(cell), np.float32)
        for row, k in enumerate((0, 1, 2, 3, 4, 6)):
            both[k].take(cell, out=w, mode="clip")
            w *= x[row]
            z += w
        return z

    def learn(self, batches: Iterator[tuple[list[bytes], np.ndarray]], rate: float = 0.03) -> float:
        """Online steps along the texts; returns the weight seen."""
        total, sums = 0.0, [np.full(w.shape, 1e-3) for w in self.weights]
        for toks, c in batches:
            every = self.inputs(toks, True)
            for a in range(0, len(every.cell), STEP):
                x, cell = every.x[:, a : a + STEP], every.cell[a : a + STEP]
                d = squash(self.mixed(x, cell)) - 1
                sums_of = [np.bincount(cell, d * v, minlength=2 * _CELLS) for v in x]
                constant = np.bincount(cell, d, minlength=2 * _CELLS) * np.repeat([-0.3, 0.3], _CELLS)
                slope = np.stack([*sums_of[:5], constant, sums_of[5]], 1).reshape(2, PLACES, CONF, CONF, N_IN).sum(0)
                size = np.bincount(cell, minlength=2 * _CELLS).reshape(2, PLACES, CONF, CONF).sum(0)
                for w, s, axis in zip(self.weights, sums, (2, 1), strict=True):
                    n = size.sum(axis).T.reshape(-1, 1)
                    grad = slope.sum(axis).transpose(1, 0, 2).reshape(w.shape) / np.maximum(n, 1)
                    s += grad**2
                    w -= rate * grad / np.sqrt(s) * (n > 0)
            total += c.sum()
        return total

    def after(self, batches: Iterator[tuple[list[bytes], np.ndarray]]) -> np.ndarray:
        """For the map: how often 0 and 1 came at each step of the mixed prediction, over all bits of the texts."""
        times, parts = np.zeros((2, 2 * CONF * STEPS + 1))
        for toks, _ in batches:
            found = self.inputs(toks, True)
            at, part = self.steps(self.mixed(found.x, found.cell), found)
            times += np.bincount(at, minlength=len(times))
            parts += np.bincount(at, part, minlength=len(parts))
        seen = (times - parts)[:-1] + np.append(0, parts[:-2])
        zeros, ones = seen.reshape(2, CONF, STEPS)
        return np.stack([zeros[:, ::-1].ravel(), ones.ravel()])  # of a 0 that came the steps lie the other way

    def steps(self, z: np.ndarray, found: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Where in the map (bit, confidence, step) each bit lies, and how far towards the next step."""
        part = np.clip(z, -12, 12)
        part += 12
        part *= (STEPS - 1) / 24
        low = np.minimum(part.astype(np.int32), STEPS - 2)
        part -= low
        low += found.sure * STEPS
        low += _BIT_MAPS.take(found.data, mode="clip").view(np.int32)
        return low.astype(np.intp), part

    def costs(self, toks: list[bytes] | list[Piece]) -> tuple[np.ndarray, np.ndarray]:
        """log2 probability of each byte, and each text's bytes."""
        found = self.inputs(toks, False)
        z = self.mixed(found.x, found.cell)
        p = squash(z)
        if self.map is not None:
            at, part = self.steps(z, found)
            flat = np.stack([1 - self.map[:, ::-1], self.map]).ravel()
            part *= np.append(np.diff(flat), 0).astype(np.float32).take(at, mode="clip")
            p += part
            p += flat.astype(np.float32).take(at, mode="clip")
            p *= 0.5
        np.clip(p, np.float32(1e-7), np.float32(1 - 1e-7), out=p)
        for _ in range(2):  # four bits together, which is 1e-28 at least
            p = p[::2] * p[1::2]
        cost = np.log2(p.astype(np.float64))
        return cost[::2] + cost[1::2], found.size

    def log2p(self, toks: list[bytes] | list[Piece]) -> np.ndarray:
        """log2 probability of each text with its closing byte."""
        cost, size = self.costs(toks)
        return np.bincount(np.repeat(np.arange(len(toks)), size), cost, minlength=len(toks))

    def token_log2p(self, batches: Iterator[tuple[list[bytes] | list[Piece], np.ndarray]]) -> np.ndarray:
        """log2 probability of each token with its closing byte, given the text before, for all texts one after the other."""
        out = []
        for toks, _ in batches:
            data = np.frombuffer(toks[0].data if isinstance(toks[0], Piece) else b" ".join([*toks, b""]), np.uint8)
            token = np.concatenate([[0], np.cumsum((_CLOSING if self.coded else _SPACE).take(data))[:-1]])
            own = np.bincount(token, self.costs(toks)[0])
            if isinstance(toks[0], Piece) and toks[0].place:  # the same token goes on
                out[-1][-1] += own[0]
                own = own[1:]
            if len(own):
                out.append(own)
        return np.concatenate(out) if out else np.zeros(0)


def fit(train: DataFrame, counts: DataFrame, code: Broadcast[Code]) -> Mixer:
    """Counts, then weights, then the map, each over the running text of all training documents (coded, and 1); counts: (token, c) of their tokens."""
    context, n = train.sparkSession.sparkContext, len(code.value)
    mixer = Mixer(count_tables(train, counts, code), coded=n)
    shared = context.broadcast(mixer.tables)  # their size is fixed by BITS

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(shared.value, coded=n)
        total = own.learn(_batches(batches, coded=True))
        if total:
            yield _partial([(0, 0, np.array([1.0])), (0, 1, own.weights[0].ravel()), (0, 2, own.weights[1].ravel())])

    parts = {r["block"]: np.frombuffer(r["data"], "<f4").astype(float) for r in _sum_blocks(train.mapInArrow(weigh, _BLOCKS))}
    if parts:
        mixer.weights = [(parts[k] / parts[0][0]).reshape(CONF * PLACES, N_IN) for k in (1, 2)]
        weights = mixer.weights

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Mixer(shared.value, coded=n)
            own.weights = weights
            yield _partial([(0, 0, own.after(_batches(batches, coded=True)).ravel())])

        n0, n1 = np.frombuffer(_sum_blocks(train.mapInArrow(count, _BLOCKS))[0]["data"], "<f4").astype(float).reshape(2, CONF, STEPS)
        mixer.map = (n1 + 20 * squash(np.linspace(-12, 12, STEPS))) / (n0 + n1 + 20)
    shared.unpersist()
    return mixer


# --- scores --------------------------------------------------------------------


def rising(m: np.ndarray, x: np.ndarray, ln_x: np.ndarray) -> np.ndarray:
    """ln of x (x+1) ... (x+m-1), with ln x given."""
    out = ln_x.copy()
    more = np.flatnonzero(m > 1)
    for j in range(1, 8):
        more = more[m[more] > j]
        out[more] += np.log(x[more] + j)
    big = np.flatnonzero(m > 8)
    a, b = x[big] + 8, x[big] + m[big]
    stirling = lambda v: (v - 0.5) * np.log(v) - v + 1 / (12 * v) - 1 / (360 * v**3)
    out[big] += stirling(b) - stirling(a)
    return out


def seen_of(c: np.ndarray, law: tuple[int, float, float]) -> np.ndarray:
    """ln of the discounted share of tokens with count c."""
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(c - law[1], 0) / law[0])


def experts(q: np.ndarray, seen: list[np.ndarray], laws: list[tuple[int, float, float]], earlier: np.ndarray) -> list[np.ndarray]:
    """ln probability of each token by the counts, the blend, each class and (but for their totals) the urns.

    q: ln probability by the mixer; seen: ln of the discounted share, of all and of each class; earlier: the same token's occurrences before, in its document.
    """
    counted = np.logaddexp(seen[0], np.log(laws[0][2]) + q)
    blend = np.logaddexp(counted, q) - np.log(2)
    classes = [np.logaddexp(s, np.log(law[2]) + blend) for s, law in zip(seen[1:], laws[1:], strict=True)]
    with np.errstate(divide="ignore"):
        before = np.log(earlier)
    return [counted, blend, *classes, *(np.logaddexp(before, np.log(a) + blend) for a in URNS)]


def earlier_of(group: np.ndarray, token: np.ndarray) -> np.ndarray:
    """How often the same token came before in its group."""
    order = np.lexsort((token, group))  # stable
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(token[order]) != 0)
    first = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return out


def training_text(docs: DataFrame, *columns) -> DataFrame:
    return docs.where(held_out(F.col("doc_id").cast("long")) == F.lit(False)).select(*columns or [F.coalesce("text", F.lit("")).alias("text")])


def coded_texts(docs: DataFrame, code: Broadcast[Code]) -> DataFrame:
    """doc_id, held_out, row, bytes, and the running text in the code."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [code.value.running(tokens(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "row", "bytes")), pa.array(text, pa.binary())], ["doc_id", "held_out", "row", "bytes", "coded"])

    rows = texts(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.octet_length("text").alias("bytes"))
    return rows.mapInArrow(work, "doc_id long, held_out boolean, row long, bytes int, coded binary")


def score_documents(docs: DataFrame, common: int = CODED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row. common: of the coded tokens, those whose counts are looked up in a broadcast."""
    spark = docs.sparkSession
    classes = sorted(r[0] for r in docs.select(class_of(docs)).distinct().collect())  # at most 16
    names = ["c", *(f"c{k}" for k in classes)]
    counts = stored(token_counts(docs, classes), "tokens")
    each = [f(F.col(x)) for x in names for f in (F.sum, lambda c: F.count_if(c > 0), lambda c: F.count_if(c == 1), lambda c: F.count_if(c == 2))]
    long = F.sum(F.col("c") * (F.octet_length("token") + 1))
    vocabulary, size, *sums = (x or 0 for x in counts.agg(F.count("*"), long, *each).first())
    total, kinds = sums[0], sums[1]
    laws = []  # tokens, discount, and what the discount leaves, of the whole and of each class
    for all_, some, once, twice in zip(*[iter(sums)] * 4, strict=True):
        discount = once / (once + 2 * twice) if twice else 0.75  # leave-one-out estimate
        laws.append((max(all_, 1), discount, discount * some / all_ if all_ else 1.0))
    top = counts.where((F.col("c") >= LEAST) & (F.octet_length("token") > 0)).orderBy(F.desc("c"), "token").limit(CODED).toArrow()  # at most CODED rows
    found = top.column("token").to_pylist()
    share = np.array([top.column(x).to_numpy() / law[0] for x, law in zip(names[1:], laws[1:], strict=True)])
    code = code_of(found, share.argmax(0).tolist() if len(share) else None)
    number = dict(zip(found, range(len(found)), strict=True))
    top = top.select(names).take(pa.array([number[t] for t in code][:common], pa.int64()))
    later = list(code)[common:]
    top = pa.concat_tables([top, counts.where(F.octet_length("token") == 0).select(*names).toArrow()])  # and the end
    shared_code = spark.sparkContext.broadcast(code)
    coded = stored(coded_texts(docs, shared_code), "coded")
    tasks = max(8, size // TASK_BYTES)
    tokens_of = counts.where("c > 0").select("token", "c").coalesce(tasks)
    shared = spark.sparkContext.broadcast(fit(training_text(coded, "coded", F.lit(1).alias("c")).coalesce(tasks), tokens_of, shared_code))
    shared_code.unpersist()
    looked = spark.sparkContext.broadcast((top.column("c").to_numpy(), [seen_of(top.column(x).to_numpy(), law) for x, law in zip(names, laws, strict=True)], later))
    stills = [f"still{i}" for i in range(len(names) + 1)]
    grown = [*stills, *(f"urn{i}" for i in range(len(URNS)))]
    unit = np.log10(total + 0.5 * (kinds + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen, later = looked.value
        base, known, model = np.log10(c + 0.5) - unit, c > 0, shared.value
        model.look_up(False, last=True)
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            own = batch.column("coded").to_pylist()
            ones = pa.array(np.ones(len(own), np.int64))
            q = model.token_log2p(_batches(iter([pa.RecordBatch.from_arrays([batch.column("coded"), ones], ["coded", "c"])]), coded=True)) * np.log(2)
            text = b" ".join([*own, b""])
            data = np.frombuffer(text, np.uint8)
            stop = np.flatnonzero(_CLOSING.take(data)) + 1
            start = np.concatenate([[0], stop[:-1]])
            n = np.diff(np.searchsorted(stop, np.cumsum([len(t) + 1 for t in own]), "right"), prepend=0)
            first, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            rank = ranks(data, start, stop - start)
            at = np.where(rank < len(c) - 1, rank, -1)
            at[(stop - start == 1) & (data.take(start) == 32)] = len(c) - 1  # the ends
            here = np.flatnonzero(at >= 0)
            add = lambda v: np.bincount(doc[here], v, minlength=len(n))
            i = at[here]
            grow = [add(v) for v in experts(q[here], [s[i] for s in seen], laws, earlier_of(doc[here], i))]
            for k, a in enumerate(URNS):
                grow[k - len(URNS)] -= rising(n, np.full(len(n), a), np.full(len(n), np.log(a)))
            tails: list[dict[bytes, list[float]]] = [{} for _ in own]
            for j in np.flatnonzero(at < 0).tolist():
                token = text[start[j] : stop[j] - 1] if rank[j] < 0 else later[rank[j] - len(c) + 1]
                tails[doc[j]].setdefault(token, []).append(q[j])
            cols = [n, add(known[i]).astype(np.int64), add(base[i]), np.add.reduceat(q, first), *grow]
            out = [batch.column(x) for x in ("doc_id", "held_out", "row", "bytes")] + [pa.array(v) for v in cols]
            out += [pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "row", "bytes", "n_tokens", "n_known", "base", "mixer", *grown, "tail", "qs"])

    def score_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs = batch.column("qs")
            m = np.diff(qs.offsets.to_numpy()).astype(np.int64)
            first = np.cumsum(m) - m
            if not len(m):
                continue
            earlier = np.arange(m.sum()) - np.repeat(first, m)
            seen = [np.repeat(seen_of(batch.column(x).to_numpy(), law), m) for x, law in zip(names, laws, strict=True)]
            c = batch.column("c").to_numpy()
            cols = [m * (c > 0), m * (np.log10(c + 0.5) - unit)] + [np.add.reduceat(v, first) for v in experts(qs.flatten().to_numpy(), seen, laws, earlier)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(v) for v in cols)], ["row", "k2", "b2", *(f"{x}b" for x in grown)])

    sums = f"n_tokens long, n_known long, base double, mixer double, {', '.join(f'{x} double' for x in grown)}"
    first = stored(coded.mapInArrow(score, f"doc_id long, held_out boolean, row long, bytes int, {sums}, tail array<binary>, qs array<array<double>>"), "partial")

    rest = first.select("row", F.explode(F.arrays_zip("tail", "qs")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.qs").alias("qs"))
    rest = rest.join(counts.select("token", *names), "token").select("row", "qs", *names)
    added = ["k2", "b2", *(f"{x}b" for x in grown)]
    rest = rest.mapInArrow(score_rest, f"row long, k2 long, {', '.join(f'{x} double' for x in added[1:])}").groupBy("row").agg(*[F.sum(x).alias(x) for x in added])
    all_ = first.drop("tail", "qs").join(rest, "row", "left").fillna(0, added)
    each = [F.col("mixer"), *(F.col(x) + F.col(f"{x}b") for x in grown)]
    most = F.greatest(*each)
    ln = most + F.log(sum((F.exp(e - most) for e in each), F.lit(0.0)) / len(each))
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("k2")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("b2")).alias("base_score"), (ln / float(np.log(10))).alias("score"),
        (-ln / float(np.log(2)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
