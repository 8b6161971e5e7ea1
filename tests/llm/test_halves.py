"""Halves of bytes stand for their four bits: the same counts, weights and map as bit by bit, in less time."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import mixing

TEXTS = ["One two, three one two", "", "été one three " * 40, "x" * 300 + " two", "two"]


@pytest.fixture(scope="module")
def batches():
    rng = np.random.default_rng(1)
    words = [rng.bytes(int(n)).replace(b" ", b"_") for n in rng.integers(1, 12, 300)]
    texts = [mixing.running(mixing.tokens(t)) for t in TEXTS] + [b" ".join([*rng.choice(words, 900).tolist(), b""]) for _ in range(4)]
    return list(mixing._batches(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([1] * len(texts))], ["running", "c"])])))


def by_bits(batches):
    tables = [np.zeros(2 << b) for b in mixing.BITS]
    for toks, _ in batches:
        slots, bits, _, _ = mixing.bit_slots(toks)
        for t, own in zip(tables, slots, strict=True):
            np.add.at(t, own * 2 + bits, 1.0)
    return [t.reshape(-1, 2) for t in tables]


def by_halves(batches):
    tables = [np.zeros(none + 1) for none in mixing.NONE]
    for toks, _ in batches:
        for t, entries in zip(tables, mixing.contexts_of(toks).entries, strict=True):
            np.add.at(t, entries.ravel(), 1.0)
    return [mixing.nodes_of(t[:-1]) for t in tables]


def test_halves_count_all_bits(batches):
    for k, (one, other) in enumerate(zip(by_halves(batches), by_bits(batches), strict=True)):
        assert np.array_equal(one[k == 6 :], other[k == 6 :])  # slot 0 of the last table stands for no token before


def test_counts_of_a_table_with_times(spark):
    rows = [(mixing.running(mixing.tokens(t)), i + 1) for i, t in enumerate(TEXTS)]
    texts = [(t,) for i, t in enumerate(TEXTS) for _ in range(i + 1)]
    counts = collections.Counter()
    for t, c in rows:
        counts.update({w: c * n for w, n in collections.Counter([*t.split(), b""]).items()})
    got = mixing.count_tables(spark.createDataFrame(texts, "text string"), spark.createDataFrame(list(counts.items()), "token binary, c long"))
    want = by_bits([([t], None) for t, c in rows for _ in range(c)])
    assert all(np.array_equal(g[k == 6 :], w[k == 6 :]) for k, (g, w) in enumerate(zip(got, want, strict=True)))


@pytest.mark.parametrize("leave_out", [False, True])
def test_common_tokens_change_no_input(batches, leave_out):
    tables = [t.astype(np.float32) for t in by_bits(batches)]
    words = collections.Counter(w for toks, _ in batches for t in toks for w in [*t.split(b" ")[:-1], b""])
    plain = mixing.Mixer(tables)
    for common in ([w for w, _ in words.most_common(50)], list(words), [b"never"]):
        mixer = mixing.Mixer(tables, common)
        for toks, _ in batches:
            one, other = mixer.inputs(toks, leave_out), plain.inputs(toks, leave_out)
            assert all(np.array_equal(a, b) for a, b in zip(one, other, strict=True))


def test_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "COMMON_BYTES", 8)
    assert mixing.bounded([b"abc", b"", b"de", b"f"]) == [b"abc", b"", b"de"] and mixing.bounded([]) == [] and mixing.bounded([b"x" * 9]) == []


def plain_inputs(mixer, toks):
    """Predictors (bits x 7), both gates and bits, as if each bit had been seen once less."""
    slots, bits, places, _ = mixing.bit_slots(toks)
    x, seen, at = np.zeros((len(bits), 7)), [], np.arange(len(bits))
    for k, t in enumerate(mixer.tables):
        pairs = t[slots[k]].astype(float)
        pairs[at, bits] = np.maximum(pairs[at, bits] - 1, 0)
        value = np.log((pairs[:, 1] + 0.02) / (pairs[:, 0] + 0.02))
        seen.append(pairs.sum(1))
        if k == 5:
            x[:, 4] = np.where(seen[5] < seen[4], value, x[:, 4])
            seen[4] = np.minimum(seen[4], seen[5])
        else:
            x[:, k] = value * (k < 6 or slots[k] > 0)
    x[:, 5] = 0.3
    return x, [np.minimum(np.log2(1 + seen[k]).astype(int), 7) * 4 + places for k in (4, 3)], bits


def test_weights_and_map_as_bit_by_bit(batches):
    mixer = mixing.Mixer([t.astype(np.float32) for t in by_bits(batches)])
    weights, sums = [w.copy() for w in mixer.weights], [np.full(w.shape, 1e-3) for w in mixer.weights]
    mixer.learn(iter(batches))
    for toks, _ in batches:
        x_all, gates_all, bits_all = plain_inputs(mixer, toks)
        for a in range(0, len(bits_all), mixing.STEP):
            x, gates, bits = x_all[a : a + mixing.STEP], [g[a : a + mixing.STEP] for g in gates_all], bits_all[a : a + mixing.STEP]
            d = mixing.squash((x * (weights[0][gates[0]] + weights[1][gates[1]])).sum(1)) - bits
            for w, s, g in zip(weights, sums, gates, strict=True):
                grad, n = np.zeros(w.shape), np.bincount(g, minlength=len(w))[:, None]
                np.add.at(grad, g, d[:, None] * x)
                grad /= np.maximum(n, 1)
                s += grad**2
                w -= 0.03 * grad / np.sqrt(s) * (n > 0)
    assert all(np.abs(a - b).max() < 1e-4 for a, b in zip(mixer.weights, weights, strict=True)) and np.abs(weights[0] - 0.12).max() > 0.05
    want, steps = np.zeros((2, mixing.CONF, mixing.STEPS)), mixing.STEPS - 1
    for toks, _ in batches:
        x, gates, bits = plain_inputs(mixer, toks)
        z = (x * (mixer.weights[0][gates[0]] + mixer.weights[1][gates[1]])).sum(1)
        at = (np.clip(z, -12, 12) + 12) / 24 * steps
        low = np.minimum(at.astype(int), steps - 1)
        np.add.at(want, (bits, gates[0] // 4, low), 1 - at + low)
        np.add.at(want, (bits, gates[0] // 4, low + 1), at - low)
    got = mixer.after(iter(batches))
    assert got.sum() == pytest.approx(want.sum()) and np.abs(got.reshape(want.shape) - want).max() < 0.05


def test_counting_halves_takes_less_time(batches):
    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    halves, whole = [np.zeros(n + 1) for n in mixing.NONE], [np.zeros(2 << b) for b in mixing.BITS]
    slots = [mixing.bit_slots(toks)[:2] for toks, _ in batches]
    mixer = mixing.Mixer([t.reshape(-1, 2).astype(np.float32) for t in whole])
    mixer.look_up(True)

    def by_half():
        for toks, _ in batches:
            for t, e in zip(halves, mixing.contexts_of(toks).entries, strict=True):
                np.add.at(t, e.ravel(), 1.0)

    def by_bit():
        for own, bits in slots:
            for t, s in zip(whole, own, strict=True):
                np.add.at(t, s * 2 + bits, 1.0)

    assert least(by_half) < 0.8 * least(by_bit)  # contexts and all against the counting alone


def test_a_training_pass_needs_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert "MapInArrow" not in mixing.training_text(docs)._jdf.queryExecution().toString()
