"""A trained sequence tagger, and how models of any kind run in tasks.

The tagger is an averaged perceptron over hashed features of words with label transitions, fitted in numpy on a bounded
sample of labelled rows and decoded by Viterbi, many chunks of like length at once.

`model_tagger` makes a tagger (operators.tagging) of any model with `tag(texts)`: an iterator UDF that loads the model once in each Python worker
and keeps it for later batches and tasks; a model that fails is evicted, loaded anew and tried once more before the task
fails. The chunks of all rows of a batch are sorted by length and given to the model by groups of at most `most_chars`
characters (a longer chunk comes alone), so what it holds at once is bounded; results go back to the rows they came from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tagging import TOKENS, Tagger

SLOTS = 1 << 17
_WORD = re.compile(r"\w+|[^\w\s]").finditer
Token = tuple[str, str, float, int, int]  # word, label, score, start, end


class Model(Protocol):
    def tag(self, texts: list[str]) -> list[list[Token]]: ...


# --- features ----------------------------------------------------------------------


def shape(word: str) -> str:
    """Kinds of characters, each run once: `Mill-7b` is `Xx-9x`."""
    kinds = ["9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)


def features(words: list[str]) -> np.ndarray:
    """Slots of the features of each word (words x features)."""
    low, kind = ["<", *(w.lower() for w in words), ">"], ["<", *map(shape, words), ">"]
    rows = []
    for i in range(1, len(words) + 1):
        named = (
            "b", f"w{low[i]}", f"s{kind[i]}", f"3{low[i][:3]}", f"e{low[i][-3:]}", f"p{low[i - 1]}", f"n{low[i + 1]}", f"q{kind[i - 1]}|{kind[i]}",
            f"m{kind[i]}|{kind[i + 1]}", f"r{low[i - 1]}|{kind[i]}", f"t{kind[i]}|{low[i + 1]}",
        )
        rows.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % SLOTS for x in named])
    return np.array(rows, np.int64).reshape(len(words), 11)


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of several texts at once: scores (texts, words, labels), moves from label to label; behind a text's length they are 0."""
    n, most, labels = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((n, most, labels), np.int16)
    for t in range(1, most):
        ways = best[:, :, None] + moves
        back[:, t] = ways.argmax(1)
        on = (lengths > t)[:, None]
        best = np.where(on, ways.max(1) + scores[:, t], best)
    out = np.zeros((n, most), np.int64)
    now = best.argmax(1)
    for t in range(most - 1, -1, -1):
        out[:, t] = np.where(lengths > t, now, 0)
        if t:
            now = np.where(lengths > t, back[np.arange(n), t, now], now)
    return out


@dataclass
class Perceptron:
    """labels[0] is O. weights: (SLOTS, labels); moves: (labels, labels)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def tag(self, texts: list[str]) -> list[list[Token]]:
        places = [[m.span() for m in _WORD(t)] for t in texts]
        words = [[t[a:b] for a, b in p] for t, p in zip(texts, places, strict=True)]
        lengths = np.array([len(w) for w in words])
        if not lengths.sum():
            return [[] for _ in texts]
        scores = np.zeros((len(texts), int(lengths.max()), len(self.labels)), np.float32)
        for i, w in enumerate(words):
            if w:
                scores[i, : len(w)] = self.weights[features(w)].sum(1)
        labels = viterbi(scores, self.moves, lengths)
        shares = np.exp(scores - scores.max(2, keepdims=True))
        shares /= shares.sum(2, keepdims=True)
        out = []
        for i, (w, p) in enumerate(zip(words, places, strict=True)):
            out.append([(x, self.labels[k], float(shares[i, j, k]), a, b) for j, (x, (a, b), k) in enumerate(zip(w, p, labels[i].tolist(), strict=False)) if k])
        return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 4, seed: int = 3) -> Perceptron:
    """From texts with labelled spans (start, end, label): the averaged weights of all steps."""
    rng = np.random.default_rng(seed)
    labels = ["O", *sorted({x[2] for _, spans in rows for x in spans})]
    number = {x: i for i, x in enumerate(labels)}
    data = []
    for text, spans in rows:
        places = [m.span() for m in _WORD(text)]
        gold = np.array([next((number[x] for a, b, x in spans if a <= s and e <= b), 0) for s, e in places], np.int64)
        if places:
            data.append((features([text[a:b] for a, b in places]), gold))
    w, m = np.zeros((SLOTS, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32)
    w_late, m_late, step = np.zeros_like(w), np.zeros_like(m), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)).tolist():
            ids, gold = data[i]
            step += 1
            got = viterbi(w[ids].sum(1)[None], m, np.array([len(gold)]))[0]
            wrong = np.flatnonzero(got != gold)
            if not len(wrong):
                continue
            for y, sign in ((gold, 1.0), (got, -1.0)):
                at = (ids[wrong].ravel(), np.repeat(y[wrong], ids.shape[1]))
                np.add.at(w, at, sign)
                np.add.at(w_late, at, sign * step)
                np.add.at(m, (y[:-1], y[1:]), sign)
                np.add.at(m_late, (y[:-1], y[1:]), sign * step)
    return Perceptron(labels, w - w_late / (step + 1), m - m_late / (step + 1))


def fit(labelled: DataFrame, sample: int = 1000) -> Perceptron:
    """Train on at most `sample` rows (text, spans: array of start, end, label), those whose hash is least; texts of up to CHUNK_CHARS characters."""
    from ..schema import CHUNK_CHARS

    some = labelled.where((F.length("text") <= CHUNK_CHARS) & F.col("spans").isNotNull()).orderBy(F.xxhash64("text"), "text").limit(sample)
    return train([(r["text"], [(s["start"], s["end"], s["label"]) for s in r["spans"]]) for r in some.select("text", "spans").collect()])


# --- models in tasks -----------------------------------------------------------------


_LOADED: dict[str, Any] = {}


def loaded(key: str, load: Callable[[], Any]) -> Any:
    """The worker's model of that key, loaded at its first use; a load that fails leaves nothing."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def evict(key: str) -> None:
    _LOADED.pop(key, None)


def by_length(texts: list[str], most_chars: int) -> Iterator[list[int]]:
    """Numbers of the texts in groups of like length, each of at most most_chars when padded to its longest."""
    group: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (len(texts[i]), i)):
        if group and (len(group) + 1) * len(texts[i]) > most_chars:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def tag_all(texts: list[str], key: str, load: Callable[[], Model], most_chars: int) -> list[list[Token]]:
    """Tokens of each text; a model that fails is evicted, loaded anew and asked once more."""
    out: list[list[Token]] = [[] for _ in texts]
    for group in by_length(texts, most_chars):
        some = [texts[i] for i in group]
        try:
            found = loaded(key, load).tag(some)
        except Exception:
            evict(key)
            try:
                found = loaded(key, load).tag(some)
            except Exception:
                evict(key)
                raise
        for i, tokens in zip(group, found, strict=True):
            out[i] = tokens
    return out


def model_tagger(key: str, load: Callable[[], Model], most_chars: int = 1 << 16) -> Tagger:
    """A tagger of the model that `load` makes in a worker; `key` tells models apart there."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            sizes = [0 if r is None else len(r) for r in rows]
            found = iter(tag_all([c["text"] for r in rows if r is not None for c in r], key, load, most_chars))
            names = ("word", "label", "score", "start", "end")
            yield pd.Series([[[dict(zip(names, t, strict=True)) for t in next(found)] for _ in range(n)] for n in sizes])

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(work, f"array<{TOKENS}>").asNondeterministic()  # so that it isn't folded into a projection with other UDFs
    return lambda parts: udf(parts)


def perceptron_tagger(spark, model: Perceptron) -> Tagger:
    """The tagger of a fitted perceptron; what is broadcast has the fixed size of its weights (a few megabytes)."""
    shared = spark.sparkContext.broadcast(model)
    return model_tagger(f"perceptron-{zlib.crc32(model.weights.tobytes()):08x}", lambda: shared.value)


def spans_from(parts: Column) -> Column:
    """Text and labelled spans from an array of (text, label), label null for plain text: what `fit` takes."""
    def step(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["text"])
        one = F.when(p["label"].isNull(), F.array().cast(SPANS)).otherwise(F.array(F.struct(acc["at"].alias("start"), end.alias("end"), p["label"].alias("label"))))
        return F.struct(end.alias("at"), F.concat(acc["spans"], one).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")), step, lambda acc: acc["spans"])


SPANS = "array<struct<start: int, end: int, label: string>>"
