"""Common tokens stand as short words: one form for each text, every token predicted bit by bit, in half the bytes."""

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import mixing

TOKENS = [b"the", b"of", b"a", b"b", b"\x01odd", b"\x80", b"longer-token", "été".encode(), *(f"word{i}".encode() for i in range(6000))]


@pytest.fixture(scope="module")
def code():
    return mixing.code_of(TOKENS[:5000], [i % 3 for i in range(5000)])


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(4)
    return [[rng.choice(TOKENS) for _ in range(n)] for n in (0, 1, 2, 40, 700)]


def by_closing(text: bytes) -> list[bytes]:
    cuts = np.flatnonzero(mixing._CLOSING[np.frombuffer(text, np.uint8)]) + 1
    return [text[a:b] for a, b in itertools.pairwise([0, *cuts.tolist()])]


def test_words_are_short_and_apart():
    own = list(itertools.islice(mixing.words(), 1 << 17))
    assert len(set(own)) == len(own) and [len(w) for w in own] == sorted(len(w) for w in own) and len(own[-1]) == 3
    assert all(by_closing(w) == [w] and w[-1] != 32 for w in own)
    data = np.frombuffer(b"".join(own), np.uint8)
    length = np.array([len(w) for w in own])
    assert np.array_equal(mixing.ranks(data, np.cumsum(length) - length, length), np.arange(len(own)))


def test_a_form_is_one_text(code, lists):
    back = {w: t for t, w in code.items()}
    assert len(back) == len(code) > 4900 and b"a" in code and all(len(w) <= len(t) + 1 for t, w in code.items())
    for toks in lists:
        text = code.running(toks)
        assert [back.get(w, w[:-1]) for w in by_closing(text)] == toks
        data = np.frombuffer(text, np.uint8)
        stop = np.cumsum([len(w) for w in by_closing(text)], dtype=int)
        start = np.concatenate([[0], stop])[: len(stop)].astype(int)
        number = {t: i for i, t in enumerate(code)}
        assert mixing.ranks(data, start, stop - start).tolist() == [number.get(t, -1) for t in toks]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 64])
def test_parts_of_a_coded_text_have_the_contexts_of_the_whole(code, lists, size):
    for text in map(code.running, lists):
        whole = mixing.contexts_of([text], coded=True)
        parts = [mixing.contexts_of([p], coded=True) for p in mixing.pieces(text, size, True)]
        assert np.array_equal(whole.place, np.concatenate([p.place for p in parts]))
        assert all(np.array_equal(w, np.concatenate([p.entries[k] for p in parts])) for k, w in enumerate(whole.entries))


@pytest.mark.parametrize("leave_out", [False, True])
def test_words_looked_up_whole_change_no_input(code, lists, leave_out):
    rng = np.random.default_rng(3)
    tables = [rng.integers(0, 9, (1 << b, 2)).astype(np.float32) for b in mixing.BITS]
    texts = list(map(code.running, lists))
    plain = mixing.Mixer(tables, coded=0).inputs(texts, leave_out)
    for n in (1, 44, 500, len(code)):
        assert all(np.array_equal(a, b) for a, b in zip(mixing.Mixer(tables, coded=n).inputs(texts, leave_out), plain, strict=True))


def test_tokens_share_out_the_bits_of_a_coded_text(code, lists, monkeypatch):
    rng = np.random.default_rng(3)
    mixer = mixing.Mixer([rng.integers(0, 9, (1 << b, 2)).astype(np.float32) for b in mixing.BITS], coded=len(code))
    texts = list(map(code.running, lists))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([1] * len(texts))], ["coded", "c"])
    whole = mixer.token_log2p(mixing._batches(iter([batch]), coded=True))
    assert len(whole) == sum(len(x) + 1 for x in lists) and whole.sum() == pytest.approx(mixer.log2p(texts).sum())
    monkeypatch.setattr(mixing, "LONG", 16)
    assert mixer.token_log2p(mixing._batches(iter([batch]), coded=True)).tolist() == pytest.approx(whole.tolist(), rel=1e-5)


def test_tables_of_coded_texts_as_counted_at_once(spark, code, lists):
    texts = list(map(code.running, lists))
    counts = collections.Counter(t for x in lists for t in [*x, b""])
    want = [np.zeros(n + 1) for n in mixing.NONE]
    found = mixing.contexts_of(texts, coded=True)
    for k in range(7):
        np.add.at(want[k], found.entries[k].ravel(), 1.0)
    for k, entries in enumerate(mixing.contexts_of(list(code), coded=True).entries[:6]):  # each spelt once
        np.add.at(want[k], entries.ravel(), 1.0)
    train = spark.createDataFrame([(t, 1) for t in texts], "coded binary, c int").repartition(3)
    got = mixing.count_tables(train, spark.createDataFrame(list(counts.items()), "token binary, c long"), spark.sparkContext.broadcast(code))
    assert all(np.array_equal(g, mixing.nodes_of(w[:-1])) for g, w in zip(got, want, strict=True))


def test_a_text_is_predicted_in_half_its_bytes(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(120)], "doc_id long, text string")
    stored = mixing.stored
    sizes = {}

    def watched(df, name):
        sizes[name] = out = stored(df, name)
        return out

    monkeypatch.setattr(mixing, "stored", watched)
    got = {r.doc_id: r for r in mixing.score_documents(docs).collect()}
    assert sum(len(r.coded) for r in sizes["coded"].collect()) < 0.5 * sum(len(r.text) for r in docs.collect())
    held = [r for r in got.values() if r.held_out]
    assert len(got) == 120 and all(r.n_tokens == 201 for r in got.values()) and sum(r.score for r in held) > sum(1.02 * r.base_score for r in held)
