"""The rule ensemble: statistics, rules and lasso against plain versions, accuracy on held-out rows."""

import math
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from inkveil.llm import quality

from .conftest import SF


def plain_statistics(text):
    text = text or ""
    n = {name: float(len(regex.findall(rule.replace(r"\z", r"\Z"), text, flags=regex.V0))) for name, rule in quality.COUNTS.items()}
    lines, parts = text.split("\n"), text.split(" ")
    n |= {"chars": len(text), "bytes": len(text.encode()), "lines": len(lines), "kinds_of_lines": len(set(lines)), "parts": len(parts), "kinds_of_parts": len(set(parts))}
    return [n["chars"], n["words"], n["lines"], *(n[c] / max(n[of], 1) for _, c, of in quality.SHARES)]


def test_statistics(spark, corpus, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.with_statistics(docs, "doc_id").collect():
        assert np.allclose(list(r)[1:], plain_statistics(texts[r.doc_id])), r


def test_column_is_the_ensemble(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert 1 <= len(model.rules) and all(1 <= len(r) <= quality.DEPTH for r in model.rules)
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.score_documents(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        x = plain_statistics(text)
        z = model.bias + sum(w for rule, w in zip(model.rules, model.weights) if all((x[k] <= v) == low for k, low, v in rule))
        score = 1 / (1 + math.exp(-z))
        assert got[d][0] == (zlib.crc32(str(d).encode()) % 5 == 0) and abs(got[d][1] - score) < 1e-9
        assert got[d][2] == int(score >= 0.3)


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    r = (rng.random((400, 30)) < 0.4).astype(float)
    y = (r[:, 3] + r[:, 7] - r[:, 9] + rng.normal(0, 0.5, 400) > 0.5).astype(float)
    for penalty in (0.002, 0.02):
        w, b = quality.lasso(r, y, penalty, np.zeros(30), 0.0, 20000, 1e-10)
        p = 1 / (1 + np.exp(-(r @ w + b)))
        slope = r.T @ (p - y) / 400
        assert abs((p - y).mean()) < 1e-6
        assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-6) and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-6)
        assert 0 < np.count_nonzero(w) < 30


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(2)
    x = np.stack([rng.random(300), rng.random(300), np.ones(300)], 1)
    y = (x[:, 1] > 0.6).astype(float)
    rules = quality.grow(x, y, trees=1, depth=1)
    assert sorted(low for ((_, low, _),) in rules) == [False, True]
    assert all(k == 1 and abs(v - 0.6) < 0.03 for ((k, _, v),) in rules)
    for rule in quality.grow(x, y, trees=3):
        assert quality.holds(rule, x).tolist() == [all((row[k] <= v) == low for k, low, v in rule) for row in x]


def test_threshold():
    z, y = np.array([3, 2, 2, 1, 0.0]), np.array([1, 1, 0, 0, 0.0])
    assert quality.threshold(z, y) in (1.5, 2.5)
    assert quality.threshold(np.array([5, 4, 1.0]), np.array([1, 1, 0.0])) == 2.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = {q: [r.predicted for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(hit[1]) / len(hit[1]) > 0.95 and 1 - sum(hit[0]) / len(hit[0]) > 0.9  # always 1 would have 0 of the second


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(2, 1), (3, 1), (3, 0), (6, 0), (8, None), (9, 0), (99, 1)], "doc_id long, quality int")
    clashing = odd.selectExpr("*", "1 as words", "2 as chars", "3 as score", "4 as quality")
    got = quality.score_documents(clashing, labels).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 11)) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[5] == by[1] and by[2] == by[3] and by[6] == by[7]
    assert quality.score_documents(nothing, labels).collect() == []
    assert {r.predicted for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0}
    ones = labels.where("quality = 1 and doc_id < 4")
    assert {r.predicted for r in quality.score_documents(odd, ones).collect()} == {1}
