"""Tokens of any length: parts have the contexts of the whole, and bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import mixing


@pytest.mark.parametrize("token", [b"a", b"abcdefghij", bytes(range(33, 127)) * 3])
@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_parts_have_the_contexts_of_the_whole(token, size):
    slots, bits, places, _ = mixing.bit_slots([token])
    parts = [mixing.bit_slots([p]) for p in mixing.pieces(token, size)]
    assert np.array_equal(slots, np.concatenate([p[0] for p in parts], 1))
    assert np.array_equal(bits, np.concatenate([p[1] for p in parts]))
    assert np.array_equal(places, np.concatenate([p[2] for p in parts]))


def test_a_long_token_is_scored_as_one(spark, monkeypatch):
    long = "q" * 300 + "xyz" * 200
    rows = [(i, f"some words here {i % 7} and there {long if i % 9 == 0 else ''}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.score for r in mixing.score_documents(docs).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([b"ab", long.encode(), b"c"], pa.binary()), pa.array([1, 2, 3])], ["token", "c"])
    monkeypatch.setattr(mixing, "LONG", 64)
    got = list(mixing._batches(iter([batch])))
    assert [len(t) for t, _ in got] == [1] * (2 + len(list(mixing.pieces(long.encode(), 64)))) and [c.tolist() for _, c in got[1:-1]] == [[2.0]] * (len(got) - 2)
    parts = {r.doc_id: r.score for r in mixing.score_documents(docs).collect()}
    assert set(whole) == set(parts) and all(np.isfinite(v) and v < 0 for v in parts.values())
    assert np.corrcoef([whole[d] for d in whole], [parts[d] for d in whole])[0, 1] > 0.999


def test_memory_of_a_token_of_eight_megabytes():
    mixer = mixing.Mixer([np.zeros((1 << b, 2), np.float32) for b in mixing.BITS])
    batch = pa.RecordBatch.from_arrays([pa.array([b"Zm9v" * (1 << 21)], pa.binary()), pa.array([1])], ["token", "c"])
    mixing.powers(mixing._BASE, mixing.LONG + 1), mixing.powers(mixing._INV, mixing.LONG + 1)
    tracemalloc.start()
    for toks, _ in mixing._batches(iter([batch])):
        assert np.isfinite(mixer.log2p(toks)).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
