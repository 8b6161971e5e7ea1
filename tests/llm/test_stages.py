"""Stages on odd rows, empty tables and clashing columns; windows other than 50; bounds of samples; names of sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import decontaminate, ngram_join, sharding, suffix_dedup, toxicity

from .conftest import SF
from .test_operators import cut


CLASHING = ["_id", "_key", "_sig", "_own", "_spans", "_whole", "sig", "key", "first", "spans", "component_id", "score"]


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.drop("sig").selectExpr("*", *(f"'{c}' as `{c}`" for c in CLASHING))


@pytest.fixture(scope="module")
def stages(spark):
    labels = spark.createDataFrame([(2, 0), (6, 1), (9, None), (10, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (2, None), (3, "")], "item_id long, text string")
    return {
        "toxic": lambda d: toxicity.drop_toxic(d, labels), "join": ngram_join.keep_one, "repeats": suffix_dedup.remove_repeats,
        "benchmark": lambda d: decontaminate.drop_contaminated(d, items),
    }


@pytest.mark.parametrize("name, kept", [("toxic", None), ("join", {1, 2, 5, 6, 8, 9, 10}), ("repeats", set(range(1, 11)) - {3}), ("benchmark", {1, 5, 6, 7, 8, 9, 10})])
def test_stage_on_odd_rows(stages, odd, clashing, nothing, name, kept):
    stage = stages[name]
    plain = stage(odd)
    assert plain.columns == odd.columns
    ids = {r.doc_id for r in plain.collect()}
    assert {1, 5} <= ids and (kept is None or ids == kept)
    wide = stage(clashing)
    assert wide.columns == clashing.columns
    rows = wide.collect()
    assert {r.doc_id for r in rows} == ids and all(r[c] == c for r in rows for c in CLASHING)
    twice = stage(odd.unionByName(odd)).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in twice} == ids and {r["count"] for r in twice} == {2}
    assert stage(nothing).collect() == [] and stage(nothing).columns == nothing.columns


def test_no_items_and_no_documents(spark, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, items).collect() == []
    assert decontaminate.drop_contaminated(nothing, items).collect() == []


@pytest.mark.parametrize("window", [20, 51, 64])
def test_windows(spark, corpus, window):
    some = [(d, t) for d, t in corpus if len(t) < 3000][:60]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_digest(docs, window).collect()}
    assert got == cut(some, window)


@pytest.mark.parametrize("window", [17, 65])
def test_windows_that_are_refused(nothing, window):
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.removed_digest(nothing, window)


def test_a_long_text_keeps_no_other_out_of_the_sample(spark):
    rows = [(i, ("idiot clown " if i % 2 else "good day ") * 3, i % 2) for i in range(60)]
    docs = [(i, t) for i, t, _ in rows] + [(j, "x " * 5000) for j in range(1000, 1030)]
    labels = [(i, y) for i, _, y in rows] + [(j, 0) for j in range(1000, 1030)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), most_bytes=6400)
    assert model.out.any() and model.out_bias != 0.0  # trained, not constant


def test_sources_that_begin_alike(spark):
    rows = [(i, "t" * 50, f"commoncrawl-{2019 + i % 5}") for i in range(100)]
    got = sharding._coordinates(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("text", F.concat("text", F.col("doc_id").cast("string"))))
    assert got.select("d_source").distinct().count() == 5
    assert got.columns.count("d_source") == 1 and got.count() == 100
    placed = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 4)
    assert placed.count() == 100


# --- toxicity: a plain forward pass, slopes by differences, thresholds ---------------------


def small_model():
    rng = np.random.default_rng(4)
    m = toxicity._new(0.3, ["de", "en"], rng)
    m.language_words = rng.normal(0, 1, m.language_words.shape)
    m.shift = np.array([0.4, -0.2])
    return m, rng


def plain_output(m, ids):
    """One text's output, word by word."""
    e = [sum(m.table[j] for j in word).astype(float) for word in ids]
    out = m.out_bias
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            values = []
            for i in range(len(e)):
                v = float(m.bias[w][f])
                for j in range(w):
                    if i + j < len(e):
                        v += float(e[i + j] @ m.filters[w][j][:, f])
                values.append(max(v, 0.0))
            out += m.out[k * toxicity.FILTERS + f] * max(values)
    return out


def test_forward_pass():
    m, rng = small_model()
    n = np.array([4, 0, 1, 7, 2])
    ids = rng.integers(0, toxicity.SLOTS, (n.sum(), 3)) + np.arange(3) * toxicity.SLOTS
    scores, at = m.score(ids, n), 0
    for i, k in enumerate(n):
        own = ids[at : at + k]
        at += k
        if not k:
            assert scores[i] == 0.3
            continue
        lang = int(m.language_words[own[:, 0]].sum(0).argmax())
        z = plain_output(m, own) - m.shift[lang] + np.log(0.7 / 0.3)
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_a_step_goes_down_the_slope():
    """The first step of Adagrad moves each filter weight by the rate against the sign of its slope."""
    rng = np.random.default_rng(9)
    rows = [(rng.integers(0, 50, (6, 3)) + np.arange(3) * toxicity.SLOTS, i % 2, "en") for i in range(40)]
    model = toxicity.train(rows, 0.5, epochs=0)
    fitted = toxicity.train(rows, 0.5, epochs=1, batch=32, rate=1e-3)
    order = np.random.default_rng(7)
    start = toxicity._new(0.5, ["en"], order)
    mixed = [rows[i] for i in order.permutation(len(rows))]
    first = [mixed[:32][i] for i in order.permutation(32)][:32]
    seen = np.zeros(len(start.table), int)
    for r in mixed[:32]:
        seen[np.unique(r[0])] += 1
    start.table[seen < toxicity.LEAST] = 0

    def loss(m):
        z = np.array([plain_output(m, ids) for ids, _, _ in first])
        y = np.array([label for _, label, _ in first])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for w in (1, 2):
        for j, d, f in ((0, 1, 2), (w - 1, 5, 3)):
            x = start.filters[w]
            kept = x[j, d, f]
            x[j, d, f] = kept + 1e-2
            high = loss(start)
            x[j, d, f] = kept - 1e-2
            low = loss(start)
            x[j, d, f] = kept
            moved = fitted.filters[w][j, d, f] - model.filters[w][j, d, f]
            if abs(high - low) > 1e-5:
                assert np.sign(moved) == -np.sign(high - low)


def test_thresholds_are_the_best_of_each_language():
    m, rng = small_model()
    rows = [(rng.integers(0, 200, (5, 3)) + np.arange(3) * toxicity.SLOTS, int(i % 3 == 0), "en") for i in range(240)]
    toxicity._calibrate(m, rows)
    z, lang = zip(*(m.logits(r[0], np.array([len(r[0])])) for r in rows), strict=True)
    z, lang, y = np.concatenate(z), np.concatenate(lang), np.array([r[1] for r in rows])

    def f1(t, k):
        hit = ((z >= t) & (lang == k) & (y == 1)).sum()
        return 2 * hit / (((z >= t) & (lang == k)).sum() + y[lang == k].sum())

    for k in range(2):
        if y[lang == k].sum() >= 20 and (1 - y[lang == k]).sum() >= 20:
            assert f1(m.shift[k], k) == pytest.approx(max(f1(t, k) for t in z[lang == k]))
