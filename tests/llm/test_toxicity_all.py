"""Toxicity is learned from all labelled rows, not from a sample of them."""

import os
import zlib

import numpy as np
import pytest

from inkveil import storage
from inkveil.llm import toxicity


def data(spark, n=900):
    known = [i for i in range(3 * n) if zlib.crc32(str(i).encode()) % 3 != 1][:n]
    word = lambda i: "idiot" if i % 2 else "kind"
    rows = [(i, f"the day {word(i)} was {'long' if i % 7 else 'short'} here {i % 11}", "en" if i % 4 else "de", i % 2) for i in known]
    return rows, spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def test_every_labelled_row_is_counted_trained_on_and_calibrates(spark, monkeypatch):
    rows, docs, labels = data(spark)
    seen = {}
    for name in ("count_words", "train_pass", "calibrate_all"):
        real = getattr(toxicity, name)
        monkeypatch.setattr(toxicity, name, lambda df, *a, real=real, name=name: (seen.setdefault(name, df.count()), real(df, *a))[1])
    m = toxicity.fit_all(docs, labels, sample=20)
    assert seen["count_words"] == len(rows) and seen["train_pass"] + seen["calibrate_all"] == len(rows) and seen["calibrate_all"] > 100
    got = toxicity.apply(docs, m).collect()
    want = {r[0]: r[3] for r in rows}
    assert np.mean([(r.score >= toxicity.CUT) == want[r.doc_id] for r in got]) > 0.95


def test_words_are_counted_over_all_texts(spark):
    rows, docs, labels = data(spark, 60)
    df = docs.join(labels, "doc_id").selectExpr("text", "toxic", "0 as language")
    within, spoken = toxicity.count_words(df.repartition(3), 1)
    a, b = np.zeros(3 * toxicity.SLOTS), np.zeros((toxicity.SLOTS, 1))
    for _, text, _, _ in rows:
        d = np.frombuffer(text.encode(), np.uint8)
        ids = toxicity.features(d, np.array([0, len(d)]))[0]
        a[np.unique(ids)] += 1
        b[:, 0] += np.bincount(ids[:, 0], minlength=toxicity.SLOTS)
    assert np.array_equal(within, a) and np.array_equal(spoken, b)


def test_thresholds_from_counts_are_those_of_the_rows(spark):
    rows, docs, labels = data(spark, 300)
    m = toxicity.fit(docs, labels, 20)
    df = docs.join(labels, "doc_id").selectExpr("text", "case when doc_id % 13 = 0 then 1 - toxic else toxic end as toxic", "0 as language").localCheckpoint()
    toxicity.calibrate_all(df, m)
    z, y, lang = [], [], []
    for r in df.collect():
        d = np.frombuffer(r.text.encode(), np.uint8)
        a, k = m.logits(*toxicity.features(d, np.array([0, len(d)])))
        z.append(a[0]), y.append(r.toxic), lang.append(k[0])
    z, y, lang = np.array(z), np.array(y), np.array(lang)
    f1 = lambda t, on: 2 * (y[on] * (z[on] >= t)).sum() / ((z[on] >= t).sum() + y[on].sum())
    for k in range(len(m.languages)):
        on = lang == k
        if y[on].sum() >= 20 and (1 - y[on]).sum() >= 20:
            assert f1(m.shift[k], on) == pytest.approx(max(f1(t, on) for t in z[on]), abs=0.02)


def test_labelled_texts_are_exchanged_alike_at_every_size_and_kept_no_longer_than_needed(spark, monkeypatch):
    rows, docs, labels = data(spark, 60)
    more = docs.unionByName(spark.range(300, 900).selectExpr("id as doc_id", "'other' as text", "'en' as lang"))
    got = toxicity.labelled_texts(more, toxicity.labelled(labels))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # a small table too is joined as a large one
    assert sorted((r.text, r.toxic) for r in got.collect()) == sorted((r[1], r[3]) for r in rows)
    made, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: made.append(new_path(s, name)) or made[-1])
    m = toxicity.fit_all(more, labels, sample=20)
    assert made and not any(os.path.exists(p.removeprefix("file://")) for p in made)  # the later stages of a pipeline need the disk
    assert m.out.any() and len(toxicity.apply(more, m).collect()) == more.count()
