"""Convolutional text classifier for toxicity, trained in numpy, applied to whole texts.

Method: every word (a run of letters; other ASCII splits) has a hashed embedding, the sum
of one for the whole word and one each for its first 4 and 5 bytes, so that inflected
forms share. Filters over 1, 2 and 3 words are max-pooled over the whole text and
go into a logistic output. Training is sparse Adagrad on minibatches over all labelled rows that may be
learned from: `rounds` passes, in which every task takes its steps from the same model and
what they changed is averaged (an embedding over the tasks that touched it). Only where the passes start
comes from a bounded sample (`fit`: at most `sample` rows of each label and `most_bytes` of text, so
that what the driver gets is bounded): it saves passes. A fifth of all rows (by a hash of doc_id) is kept
from both for calibration: for each
language with 20 rows of each label a threshold on the output is chosen from the counts of all those rows at each 256th of the output, and the score is shifted so that the
threshold lies at 0.7. The language that picks the threshold is guessed from the text's
own words, as all rows have them (at most `MOST_LANGUAGES` languages, the commonest); lang, source, doc_id and labels are never inputs of a score.

Nulls and texts without words get the rate of label 1 among the rows to learn from (at
most 0.5). Labels that are null are no labels; repeated labels count once. Repeated
rows are scored each. Ties: equal texts have equal scores. An empty table gives an
empty result; without labels of both kinds every score is the rate. Extra columns are
ignored by `score_documents`.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bytes import LOWER, give_back, slices, span_hash, words
from ._common import passing, small_batches, texts

SLOT_BITS, WIDTH, FILTERS, WIDTHS, CUT = 17, 8, 8, (1, 2, 3), 0.7
SLOTS, LEAST = 1 << SLOT_BITS, 3  # an embedding is learned from words of this many training texts on
FINE, MOST_LANGUAGES, TASKS = 256, 32, 8  # steps of the output to one; languages told apart; tasks of a training pass
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (words x 3) and the number of words of each row."""
    starts, ends, n = words(data, off, _SEPARATOR)
    low = LOWER[data].astype(np.uint64) + np.uint64(1)
    out = np.empty((len(starts), 3), np.int32)
    for j, to in enumerate((ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 5))):
        out[:, j] = (span_hash(low, starts, to) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) + j * SLOTS
    return out, n


@dataclass
class Model:
    table: np.ndarray  # embeddings
    filters: dict[int, np.ndarray]  # width: (width, WIDTH, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_words: np.ndarray  # (SLOTS, languages)
    shift: np.ndarray  # threshold on the output for each language
    prior: float

    def pooled(self, ids: np.ndarray, n: np.ndarray, where: bool = False):
        """Max-pooled filters of each row (rows x filters); where: also the word of each maximum."""
        e = self.table[ids].sum(1)
        starts = np.cumsum(n) - n
        tops, ats = [], []
        row_of = np.repeat(np.arange(len(n)), n)
        for w in WIDTHS:
            x = np.repeat(self.bias[w][None], len(e), 0)
            for j in range(w):
                y = e[j:] @ self.filters[w][j]
                if j:  # a word counts for earlier positions of its own row alone
                    y[row_of[j:] != row_of[: len(row_of) - j]] = 0
                x[: len(y)] += y
            np.maximum(x, 0, out=x)
            top = np.maximum.reduceat(x, starts[n > 0], axis=0) if (n > 0).any() else np.zeros((0, FILTERS), np.float32)
            full = np.zeros((len(n), FILTERS), np.float32)
            full[n > 0] = top
            tops.append(full)
            if where:
                at = np.zeros((len(n), FILTERS), np.int64)
                for r in np.flatnonzero(n).tolist():
                    at[r] = starts[r] + x[starts[r] : starts[r] + n[r]].argmax(0)
                ats.append(at)
        return np.concatenate(tops, 1), ats, row_of

    def logits(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of each row before calibration, and its language's number."""
        z = self.pooled(ids, n)[0] @ self.out + self.out_bias
        votes = np.zeros((len(n), len(self.languages)))
        if len(ids):
            starts = (np.cumsum(n) - n)[n > 0]
            votes[n > 0] = np.add.reduceat(self.language_words[ids[:, 0]], starts, axis=0)
        return z, votes.argmax(1)

    def score(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        z, lang = self.logits(ids, n)
        s = 1 / (1 + np.exp(-np.clip(z - self.shift[lang] + np.log(CUT / (1 - CUT)), -30, 30)))
        return np.where(n > 0, s, self.prior)


def _new(prior: float, languages: list[str], rng: np.random.Generator) -> Model:
    f32 = np.float32
    return Model(
        rng.normal(0, 0.1, (3 * SLOTS, WIDTH)).astype(f32),
        {w: rng.normal(0, 0.5 / np.sqrt(w), (w, WIDTH, FILTERS)).astype(f32) for w in WIDTHS}, {w: np.zeros(FILTERS, f32) for w in WIDTHS},
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(f32), -1.0, languages, np.zeros((SLOTS, max(1, len(languages)))), np.zeros(max(1, len(languages))), prior,
    )


class Steps:
    """Adagrad on a model's parameters, an embedding's only where `texts_with` its words are LEAST at least."""

    def __init__(self, m: Model, texts_with: np.ndarray, rate: float):
        self.m, self.texts_with, self.rate = m, texts_with, rate
        self.g_table, self.g_bias = np.full(len(m.table), 1e-8), 1e-8
        self.g = {id(x): np.full(x.shape, 1e-8) for x in [*m.filters.values(), *m.bias.values(), m.out]}

    def step(self, x: np.ndarray, grad: np.ndarray) -> None:
        self.g[id(x)] += grad**2
        x -= (self.rate * grad / np.sqrt(self.g[id(x)])).astype(x.dtype)

    def take(self, ids: np.ndarray, n: np.ndarray, label: np.ndarray) -> None:
        """One step on rows with words."""
        m, texts_with = self.m, self.texts_with
        pool, ats, row_of = m.pooled(ids, n, True)
        p = 1 / (1 + np.exp(-np.clip(pool @ m.out + m.out_bias, -30, 30)))
        d = (p - label) / len(n)
        d_pool = d[:, None] * m.out[None]
        for k, w in enumerate(WIDTHS):
            dk, at = d_pool[:, k * FILTERS : (k + 1) * FILTERS] * (pool[:, k * FILTERS : (k + 1) * FILTERS] > 0), ats[k]
            d_filter, touched, grads = np.zeros_like(m.filters[w]), [], []
            for j in range(w):
                pos = np.minimum(at + j, len(ids) - 1)
                same = (at + j < len(ids)) & (row_of[pos] == np.arange(len(n))[:, None])
                e = m.table[ids[pos]].sum(2) * same[..., None]  # rows x filters x WIDTH
                d_filter[j] = np.einsum("rf,rfd->df", dk, e)
                de = (dk * same)[..., None] * m.filters[w][j].T[None]
                touched.append(ids[pos].reshape(-1, 3))
                grads.append(de.reshape(-1, WIDTH))
            self.step(m.bias[w], dk.sum(0))
            self.step(m.filters[w], d_filter)
            which, back = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
            total = np.zeros((len(which), WIDTH))
            np.add.at(total, back, np.repeat(np.concatenate(grads), 3, 0))
            which, total = which[texts_with[which] >= LEAST], total[texts_with[which] >= LEAST]
            self.g_table[which] += (total**2).mean(1)
            m.table[which] -= (self.rate * total / np.sqrt(self.g_table[which])[:, None]).astype(np.float32)
        self.step(m.out, pool.T @ d)
        self.g_bias += d.sum() ** 2
        m.out_bias -= self.rate * d.sum() / np.sqrt(self.g_bias)


def train(rows: list[tuple[np.ndarray, int, str]], prior: float, epochs: int = 10, batch: int = 32, rate: float = 0.08) -> Model:
    """rows: (embedding rows, label, language) of the sample. The last fifth is for calibration."""
    rng = np.random.default_rng(7)
    languages = sorted({r[2] for r in rows}) or [""]
    m = _new(prior, languages, rng)
    rows = [r for r in rows if len(r[0])]
    if len({r[1] for r in rows}) < 2:
        m.out[:], m.out_bias, m.shift[:] = 0, 0.0, np.log(CUT / (1 - CUT)) - np.log(max(prior, 1e-6) / (1 - prior))
        return m
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fit, held = rows[: -(len(rows) // 5) or None], rows[-(len(rows) // 5) or len(rows) :]
    texts_with = np.zeros(len(m.table), np.int32)
    for r in fit:
        texts_with[np.unique(r[0])] += 1
    m.table[texts_with < LEAST] = 0
    for r in rows:
        m.language_words[:, languages.index(r[2])] += np.bincount(r[0][:, 0], minlength=SLOTS)
    m.language_words = np.log((m.language_words + 0.1) / (m.language_words.sum(0) + 0.1 * SLOTS))
    steps = Steps(m, texts_with, rate)
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for a in range(0, len(order), batch):
            part = [fit[i] for i in order[a : a + batch]]
            steps.take(np.concatenate([r[0] for r in part]), np.array([len(r[0]) for r in part]), np.array([r[1] for r in part]))
    _calibrate(m, held or fit)
    return m


def _calibrate(m: Model, rows: list[tuple[np.ndarray, int, str]]) -> None:
    """The threshold with the best F1 for each language, in the middle of the gap around it."""
    z, lang = zip(*(m.logits(r[0], np.array([len(r[0])])) for r in rows), strict=True)
    z, lang, label = np.concatenate(z), np.concatenate(lang), np.array([r[1] for r in rows])

    def best(z: np.ndarray, label: np.ndarray) -> float:
        order = np.argsort(-z)
        z, label = z[order], label[order]
        return _best(np.append(z, z[-1]), label, np.ones(len(z)))

    m.shift[:] = best(z, label)
    for k in range(len(m.languages)):
        here = lang == k
        if label[here].sum() >= 20 and (1 - label[here]).sum() >= 20:
            m.shift[k] = best(z[here], label[here])


def _best(z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The threshold with the best F1: outputs from high to low (and one more below), how many rows have each, and how many of label 1."""
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2)


def _learned(doc_id: str) -> Column:
    """Whether labels of this document may be learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) != 1


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text, lang, toxic, calibrates of the documents in `known`.

    Of the documents only those that may be learned from are exchanged; the join is the same
    at every size, so what is moved grows with the texts and in no step.
    """
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.cast("string").alias("lang"))
    return rows.where(_learned("doc_id")).join(known.hint("merge"), "doc_id").drop("doc_id")


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, calibrates (a fifth, by hash) of all labelled documents to learn from."""
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(_learned("doc_id"))
    return known.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0)


def _sums(parts: DataFrame) -> list[dict]:
    """Packed numbers (name, number, n, where, data) added up by name and number over tasks, each at its place; n becomes how many (or the weight of what) was added there."""

    def add(key, pdf):
        import pandas as pd

        where = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["where"]])
        spread = np.repeat(pdf["n"].to_numpy(), [len(x) // 4 for x in pdf["where"]])
        data = np.concatenate([np.frombuffer(x, "<f4") for x in pdf["data"]]).astype(np.float64)
        data = data.reshape(len(where), len(data) // max(1, len(where)))
        which, back = np.unique(where, return_inverse=True)
        total, times = np.zeros((len(which), data.shape[1])), np.bincount(back, spread, minlength=len(which))
        np.add.at(total, back, data * spread[:, None])
        return pd.DataFrame({"name": [key[0]], "n": [times.astype("<f8").tobytes()], "where": [which.astype("<i4").tobytes()], "data": [total.astype("<f8").tobytes()]})

    rows = parts.groupBy("name").applyInPandas(add, "name string, n binary, where binary, data binary").toArrow().to_pylist()  # sizes are fixed by the model
    out = []
    for r in rows:
        where, data = np.frombuffer(r["where"], "<i4"), np.frombuffer(r["data"], "<f8")
        out.append({"name": r["name"], "n": np.frombuffer(r["n"], "<f8"), "where": where, "data": data.reshape(len(where), len(data) // max(1, len(where)))})
    return out


_PARTS = "name string, n double, where binary, data binary"


def _packed(rows: list[tuple[str, float, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([float(r[1]) for r in rows]), pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[3].astype("<f4").tobytes() for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["name", "n", "where", "data"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Embedding rows, numbers of words, labels and languages of about 128 KB of texts at a time, those without words left out."""
    label, lang = batch.column("toxic").to_numpy(), batch.column("language").to_numpy()
    for a, b, data, off in slices(batch, "text", 1 << 17):
        ids, n = features(data, off)
        some = n > 0
        if some.any():
            yield ids, n[some], label[a:b][some], lang[a:b][some]


def count_words(rows: DataFrame, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each embedding's word stands, and each language's words, over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within, spoken = np.zeros(3 * SLOTS), np.zeros((SLOTS, languages))
        for batch in batches:
            for ids, n, _, lang in _runs(batch):
                text = np.repeat(np.arange(len(n)), n)
                for j in range(3):
                    within += np.bincount(np.unique(text * (3 * SLOTS) + ids[:, j]) % (3 * SLOTS), minlength=3 * SLOTS)
                for k in np.unique(lang).tolist():
                    spoken[:, k] += np.bincount(ids[np.repeat(lang, n) == k, 0], minlength=SLOTS)
        a, b = np.flatnonzero(within), np.flatnonzero(spoken.any(1))
        yield _packed([("within", 1, a, within[a]), ("spoken", 1, b, spoken[b])])

    within, spoken = np.zeros(3 * SLOTS), np.zeros((SLOTS, languages))
    for r in _sums(rows.mapInArrow(work, _PARTS)):
        if r["name"] == "within":
            within[r["where"]] = r["data"][:, 0] if len(r["where"]) else 0
        elif len(r["where"]):
            spoken[r["where"]] = r["data"]
    return within, spoken


def train_pass(rows: DataFrame, m: Model, texts_with: np.ndarray, rate: float) -> None:
    """Every task takes steps from `m` over all its rows; their mean by rows, or by touches for embeddings, is the new `m`."""
    shared = rows.sparkSession.sparkContext.broadcast((m, texts_with))

    def dense(x: Model) -> np.ndarray:
        return np.concatenate([*(x.filters[w].ravel() for w in WIDTHS), *(x.bias[w] for w in WIDTHS), x.out, [x.out_bias]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, within = shared.value
        own = copy.deepcopy(start)
        steps, seen = Steps(own, within, rate), 0
        for batch in batches:
            for ids, n, label, _ in _runs(batch):
                steps.take(ids, n, label)
                seen += len(n)
        if seen:
            which = np.flatnonzero((own.table != start.table).any(1))
            yield _packed([("dense", seen, np.zeros(1), dense(own) - dense(start)), ("table", 1, which, own.table[which] - start.table[which])])

    for r in _sums(rows.mapInArrow(work, _PARTS)):
        if r["name"] == "table" and len(r["where"]):
            m.table[r["where"]] += (r["data"] / r["n"][:, None]).astype(np.float32)
        elif r["name"] == "dense":
            moved, at = (dense(m) + r["data"][0] / r["n"][0]), 0
            for group in (m.filters, m.bias):
                for w in WIDTHS:
                    group[w][...] = moved[at : at + group[w].size].reshape(group[w].shape)
                    at += group[w].size
            m.out[...], m.out_bias = moved[at:-1], float(moved[-1])
    shared.destroy()  # nothing made from it is read later


def calibrate_all(rows: DataFrame, m: Model) -> None:
    """_calibrate from all rows: their number and labels at each FINE part of the output are counted."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, label, _ in _runs(batch):
                z, lang = shared.value.logits(ids, n)
                fine = np.floor(np.clip(z, -60, 60) * FINE).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(fine), pa.array(label.astype(np.int64))], ["lang", "fine", "label"])

    found = rows.mapInArrow(work, "lang long, fine long, label long").groupBy("lang", "fine").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    lang, fine, n, hits = (c.to_numpy() for c in found.orderBy(F.desc("fine"), "lang").toArrow().columns)  # at most 120 * FINE for a language
    shared.destroy()  # nothing made from it is read later

    def best(here: np.ndarray) -> float:
        z, at = np.unique(-fine[here], return_inverse=True)
        z = (0.5 - z) / FINE  # middles, from high to low
        return _best(np.append(z, z[-1] - 1 / FINE), np.bincount(at, hits[here]), np.bincount(at, n[here]))

    if hits.sum() and (n - hits).sum():
        m.shift[:] = best(np.ones(len(n), bool))
        for k in range(len(m.languages)):
            here = lang == k
            if hits[here].sum() >= 20 and (n - hits)[here].sum() >= 20:
                m.shift[k] = best(here)


def fit_all(docs: DataFrame, labels: DataFrame, sample: int = 3000, rounds: int = 2, rate: float = 0.02) -> Model:
    """The classifier of all labelled rows with crc32(doc_id) mod 3 not 1: words counted, trained on and calibrated over all of them."""
    known = labelled(labels)
    m = fit(docs, known.where(~F.col("calibrates")), sample)  # where training starts
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    m.prior = min(0.5, float(prior))
    with passing(labelled_texts(docs, known), "labelled") as rows:
        _fit_all(rows, m, rounds, rate)
    give_back()  # what training took of the driver's memory
    return m


def _fit_all(rows: DataFrame, m: Model, rounds: int, rate: float) -> None:
    """Counts, training and thresholds of `m` over all rows (text, lang, toxic, calibrates)."""
    spoken = [(r["lang"], r["n"], r["hits"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    if not sum(r[2] for r in spoken) or not sum(r[1] - r[2] for r in spoken) or not m.out.any():
        return  # no rows, or one label alone
    m.languages = sorted(r[0] for r in spoken)
    number = F.lit(0)
    for k, name in enumerate(m.languages):
        number = F.when(F.col("lang") == name, k).otherwise(number)
    rows = rows.select("text", "toxic", "calibrates", number.cast("int").alias("language"))
    texts_with, words_of = count_words(rows.coalesce(TASKS), len(m.languages))
    m.language_words, m.shift = np.log((words_of + 0.1) / (words_of.sum(0) + 0.1 * SLOTS)), np.full(len(m.languages), float(m.shift.mean()))
    m.table[texts_with < LEAST] = 0
    for _ in range(rounds):
        train_pass(rows.where("not calibrates").coalesce(TASKS), m, texts_with, rate)
    calibrate_all(rows.where("calibrates"), m)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_bytes: int = 64 << 20) -> Model:
    """Train on at most `sample` rows of each label and `most_bytes` of text; learns only where crc32(doc_id) mod 3 is not 1."""
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    rate = known.agg(F.avg("toxic")).first()[0] or 0.0
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    pick = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    pick = pick[0].unionByName(pick[1])  # at most 2 * sample rows
    size = rows.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.octet_length("text")).alias("size"))
    long = F.when(F.col("size") > most_bytes // 64, F.col("size")).otherwise(0)
    upto = F.sum("size").over(Window.orderBy(long, F.xxhash64("doc_id"), "doc_id"))
    rows = rows.join(F.broadcast(size.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "toxic")), "doc_id")
    out = []
    picked = rows.orderBy("doc_id", F.xxhash64("text")).select("text", "toxic", "lang").toArrow()
    for text, toxic, lang in zip(*picked.columns, strict=True):  # one text at a time: the driver has little memory
        data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
        out.append((features(data, np.array([0, len(data)]))[0], toxic.as_py(), lang.as_py()))
    del picked
    return train(out, min(0.5, float(rate)))


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the parameters above

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(*features(data, off)) for _, _, data, off in slices(batch, "text", 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return texts(docs).mapInArrow(work, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = apply(docs, fit_all(docs, labels, sample))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """The rows that are not predicted toxic, all columns kept, whatever their names.

    Null and empty texts have the prior as score and stay; repeated rows stay or go together; without rows or labels nothing goes. Texts are read whole.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit_all(docs, labels, sample))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            filled = batch.set_column(at, "text", batch.column("text").fill_null(""))
            scores = [shared.value.score(*features(data, off)) for _, _, data, off in slices(filled, "text", 1 << 18)]
            yield batch.filter(pa.array(np.concatenate(scores) < CUT)) if scores else batch
        give_back()

    return docs.mapInArrow(clean, docs.schema)
