"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Method: (1) Statistics of a text are Spark column expressions (`STATISTICS`): counts of kinds of runs and
their shares of words, lines and characters. (2) Boosted trees of depth 3 are grown in numpy over the
statistics of a bounded sample of labelled rows; every path from a root is a rule, a conjunction of
`statistic <= t` and `statistic > t`. (3) Lasso logistic regression (accelerated proximal
gradient, the penalty chosen on a fifth of the sample) gives most rules weight 0. (4) The rules that stay are compiled
into one column expression; scoring is a projection in the JVM, without Python and without a shuffle.

The sample: at most `sample` labelled rows of each label, those whose hashed doc_id is least; the driver gets their
statistics, a row of a fixed number of doubles each, never a text. The threshold with the best sum of hit rates on the
held fifth is shifted to a score of 0.3. labels, lang, source and doc_id are never inputs of a score.

Nulls are empty texts, whose statistics are all 0; they are scored as such. Labels that are null are no labels; repeated labels count once, as
the greatest. Repeated rows are scored each; equal texts have equal scores. Texts of any length are read whole. An empty
table gives an empty result; without labels of both kinds every score is the rate of label 1, or 0 without labels. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = 0.3
TREES, DEPTH, BINS, LEAST_ROWS = 60, 3, 48, 12
PENALTIES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)

#: What is counted in a text: name and Java regex.
COUNTS = {
    "words": r"[^\s]++",
    "letter_runs": r"\p{L}++",
    "capitals": r"\b\p{Lu}{2,}+\b",
    "titles": r"\b\p{Lu}\p{Ll}++",
    "digits": r"\d++",
    "ends": r"[.!?…]++(?=\s|\z)",
    "shouts": r"[!?]{2,}+",
    "signs": r"[#$%&*+=<>~^|\\@{}\[\]_/]++",
    "doubled": r"([^\p{L}\d\s])\1",
    "bars": r" \| ",
    "commas": r",",
    "long_words": r"\p{L}{18,}+",
    "short_words": r"\b\p{L}{1,2}\b",
    "links": r"https?://|www\.",
    "wide": r"[ \t]{2,}+",
}


def _counts(text: Column) -> list[Column]:
    lines, parts = F.split(text, "\n", -1), F.split(text, " ", -1)
    plain = [F.regexp_count(text, F.lit(rule)).cast("double").alias(name) for name, rule in COUNTS.items()]
    return [
        *plain, F.length(text).cast("double").alias("chars"), F.octet_length(text).cast("double").alias("bytes"), F.size(lines).cast("double").alias("lines"),
        F.size(F.array_distinct(lines)).cast("double").alias("kinds_of_lines"), F.size(parts).cast("double").alias("parts"), F.size(F.array_distinct(parts)).cast("double").alias("kinds_of_parts"),
    ]


#: Statistics from the counts: a name, a count and what it is a share of.
SHARES = [
    *((c, c, "words") for c in ("letter_runs", "capitals", "titles", "digits", "ends", "shouts", "signs", "doubled", "bars", "commas", "long_words", "short_words", "links", "wide")),
    ("word_length", "chars", "words"), ("byte_length", "bytes", "chars"), ("line_length", "chars", "lines"), ("new_lines", "kinds_of_lines", "lines"), ("new_parts", "kinds_of_parts", "parts"),
]
STATISTICS = ["chars", "words", "lines", *(f"{name}_share" for name, _, _ in SHARES)]


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the STATISTICS of each row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(*keep, *_counts(text))
    shares = [(F.col(c) / F.greatest(F.col(of), F.lit(1.0))).alias(f"{name}_share") for name, c, of in SHARES]
    return counted.select(*keep, "chars", "words", "lines", *shares)


# --- trees and their rules -----------------------------------------------------------


Condition = tuple[int, bool, float]  # statistic, whether it is at most (else above), value
Rule = tuple[Condition, ...]


def merged(path: list[Condition]) -> Rule:
    """A path with at most one upper and one lower bound for each statistic."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, low, value in path:
        have = bounds.get((k, low), value)
        bounds[k, low] = min(have, value) if low else max(have, value)
    return tuple((k, low, v) for (k, low), v in sorted(bounds.items()))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.2, seed: int = 11) -> list[Rule]:
    """All paths of boosted trees, each over half of the rows: splits by the gain of the logistic loss over quantile bins."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)  # bin b: at most edge b
    margin, out = np.zeros(len(y)), {}

    def split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
        best = (1e-6, -1, -1)
        whole = grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
        for k, e in enumerate(edges):
            b = binned[rows, k]
            g, h, n = (np.bincount(b, w, len(e) + 1).cumsum()[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            if not len(g):
                continue
            gain = g**2 / (h + 1) + (grad[rows].sum() - g) ** 2 / (hess[rows].sum() - h + 1) - whole
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1
            if gain.max() > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
        return best

    def node(rows: np.ndarray, every: np.ndarray, path: list[Condition], grad: np.ndarray, hess: np.ndarray) -> None:
        _, k, b = split(rows, grad, hess) if len(path) < depth else (0, -1, -1)
        if k < 0:
            margin[every] -= rate * grad[rows].sum() / (hess[rows].sum() + 1)
            return
        for low in (True, False):
            side = path + [(k, low, float(edges[k][b]))]
            out.setdefault(merged(side))
            node(rows[(binned[rows, k] <= b) == low], every[(binned[every, k] <= b) == low], side, grad, hess)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        node(rows, np.arange(len(y)), [], p - y, p * (1 - p))
    return list(out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, low, value in rule:
        out &= (x[:, k] <= value) == low
    return out


# --- lasso -------------------------------------------------------------------------------


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, weights: np.ndarray, bias: float, rounds: int = 2000, near: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the least mean logistic loss plus `penalty` times the sum of absolute weights (the bias is free), from a start."""
    one = np.concatenate([r, np.ones((len(r), 1), r.dtype)], 1)
    v = np.ones(one.shape[1], r.dtype)
    for _ in range(30):  # the largest eigenvalue, by powers
        v = one.T @ (one @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(np.linalg.norm(one @ v) ** 2) / 1.05
    w = np.r_[weights, bias].astype(r.dtype)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slope = one.T @ (1 / (1 + np.exp(-np.clip(one @ ahead, -30, 30))) - y) / len(y)
        new = ahead - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if (ahead - new) @ (new - w) > 0:  # too far ahead: start anew
            t_new, ahead = 1.0, new.copy()
        else:
            ahead = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < near
        w, t = new, t_new
        if done:
            break
    return w[:-1], float(w[-1])


@dataclass
class Ensemble:
    """Rules with weights; z = bias + the weights of the rules that hold."""

    rules: list[Rule]
    weights: list[float]
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))

    def column(self) -> Column:
        """The score as an expression over the STATISTICS."""

        def one(rule: Rule) -> Column:
            tests = [F.col(STATISTICS[k]) <= value if low else F.col(STATISTICS[k]) > value for k, low, value in rule]
            return reduce(lambda a, b: a & b, tests)

        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(one(rule), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def text(self) -> list[str]:
        """The rules as text, the heaviest first."""
        said = [" and ".join(f"{STATISTICS[k]} {'<=' if low else '>'} {v:.6g}" for k, low, v in r) for r in self.rules]
        return [f"{w:+.3f} if {s}" for w, s in sorted(zip(self.weights, said, strict=True), key=lambda x: -abs(x[0]))]


def constant(rate: float) -> Ensemble:
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    return Ensemble([], [], float(np.log(rate / (1 - rate))))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    """The ensemble of a sample's statistics and labels. A fifth is held for the penalty and the threshold."""
    if len(np.unique(y)) < 2:
        return constant(float(y.mean()) if len(y) else 0.0)
    order = np.random.default_rng(seed).permutation(len(y))
    x, y = x[order], y[order].astype(float)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    fit, test = ~held, held if held.any() else ~held
    seen: dict[bytes, Rule] = {}
    for rule in grow(x[fit], y[fit]):
        on = holds(rule, x[fit])
        if LEAST_ROWS // 2 <= on.sum() <= len(on) - LEAST_ROWS // 2:
            seen.setdefault(np.packbits(on).tobytes(), rule)
    rules = list(seen.values())
    if not rules:
        return constant(float(y.mean()))
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(np.float32)
    scale = r[fit].std(0)
    r /= scale
    weights, bias = np.zeros(len(rules)), float(np.log(y[fit].mean() / (1 - y[fit].mean())))
    top = float(np.abs(r[fit].T @ (y[fit] - y[fit].mean())).max()) / fit.sum()
    tried = []
    for share in PENALTIES:
        weights, bias = lasso(r[fit], y[fit], share * top, weights, bias)
        z = r[test] @ weights + bias
        tried.append((float(np.mean(np.logaddexp(0, np.where(y[test] > 0, -z, z)))), weights, bias))
    least = min(t[0] for t in tried)
    _, weights, bias = next(t for t in tried if t[0] <= 1.02 * least + 1e-4)  # the sparsest of the good ones
    z = r[test] @ weights + bias
    bias += float(np.log(CUT / (1 - CUT))) - threshold(z, y[test])
    kept = np.flatnonzero(weights)
    return Ensemble([rules[i] for i in kept], [float(weights[i] / scale[i]) for i in kept], bias)


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Where the share of label 1 at or above and of label 0 below are largest in sum; in the middle of the gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    gain = np.cumsum(y) / y.sum() - np.cumsum(1 - y) / (1 - y).sum()
    gain[:-1][z[:-1] == z[1:]] = -2  # equal outputs stay on one side
    i = int(gain.argmax())
    return float((z[i] + z[min(i + 1, len(z) - 1)]) / 2)


# --- on Spark ------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Ensemble:
    """Train on at most `sample` labelled rows of each label; learns only where crc32(doc_id) mod 5 is not 0."""
    key = F.col("doc_id").cast("long")
    known = labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    pick = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]))  # at most 2 * sample rows of two numbers
    rows = docs.select(key.alias("doc_id"), "text").join(pick, "doc_id")
    got = with_statistics(rows, "doc_id", "quality").groupBy("doc_id", "quality").agg(*[F.max(c).alias(c) for c in STATISTICS]).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x = np.stack([got.column(c).to_numpy() for c in STATISTICS], 1)[order]
    return train(x, got.column("quality").to_numpy()[order])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels, sample)
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").select("doc_id", model.column().alias("score"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
