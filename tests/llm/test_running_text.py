"""The bit predictors run over the whole text: contexts reach across tokens, and the order of words counts."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import mixing


def test_contexts_reach_across_tokens():
    one, other = mixing.bit_slots([b"red fox"])[0], mixing.bit_slots([b"elk fox"])[0]
    alone = mixing.bit_slots([b"fox"])[0]
    fox = slice(4 * 8, 7 * 8)
    assert np.array_equal(one[4:6, fox], other[4:6, fox]) and np.array_equal(one[4:6, fox], alone[4:6, : 3 * 8])  # the token alone
    for k in (0, 1, 2, 3):  # the last k + 1 bytes: what still reaches into the token before
        reach = slice(4 * 8, (4 + k) * 8)
        assert k == 0 or not np.array_equal(one[k, reach], other[k, reach])
        assert np.array_equal(one[k, (4 + k + 1) * 8 :], other[k, (4 + k + 1) * 8 :])
    assert (one[6, fox] != other[6, fox]).all() and (one[6, fox] > 0).all() and not alone[6].any() and not one[6, : 4 * 8].any()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 64])
def test_parts_of_a_text_have_the_contexts_of_the_whole(size):
    text = mixing.running(mixing.tokens("One two, three a b c and some longertoken " * 3 + "end"))
    whole = mixing.bit_slots([text])
    parts = [mixing.bit_slots([p]) for p in mixing.pieces(text, size)]
    for i in range(3):
        assert np.array_equal(whole[i], np.concatenate([p[i] for p in parts], -1))
    together = mixing.bit_slots([b"x y", text, b""])[0]
    assert np.array_equal(together[:, 4 * 8 : -8], whole[0])


def test_tokens_share_out_the_bits_of_a_text(monkeypatch):
    rng = np.random.default_rng(3)
    mixer = mixing.Mixer([rng.integers(0, 9, (1 << b, 2)).astype(np.float32) for b in mixing.BITS])
    texts = [mixing.running(mixing.tokens(t)) for t in ("ab cd ab", "", "x" * 50 + " y " + "z" * 40, "last")]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([1] * 4)], ["running", "c"])
    whole = mixer.token_log2p(mixing._batches(iter([batch])))
    assert len(whole) == 4 + 1 + 4 + 2
    assert [whole[:4].sum(), whole[4], whole[5:9].sum(), whole[9:].sum()] == pytest.approx(mixer.log2p(texts).tolist(), rel=1e-5)
    monkeypatch.setattr(mixing, "LONG", 16)
    assert mixer.token_log2p(mixing._batches(iter([batch]))).tolist() == pytest.approx(whole.tolist(), rel=1e-5)


def test_order_of_words_counts(spark):
    rng = random.Random(5)
    follow = {w: rng.sample("oak elm ash fir yew bay fig box".split(), 2) for w in "oak elm ash fir yew bay fig box".split()}

    def walk(n):
        w = ["oak"]
        while len(w) < n:
            w.append(rng.choice(follow[w[-1]]))
        return w

    rows = [(i, " ".join(walk(60))) for i in range(200)]
    given = walk(60)
    shuffled = rng.sample(given, 60)
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows += [(held[0], " ".join(given)), (held[1], " ".join(shuffled))]
    got = {r.doc_id: r for r in mixing.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = got[held[0]], got[held[1]]
    assert a.base_score == pytest.approx(b.base_score) and a.held_out and b.held_out
    assert a.score > b.score + 5


def test_blend_and_urns_against_plain_python():
    q, seen, laws = np.log([0.1, 0.2, 0.05]), [np.log([0.3, 0.1, 1e-9]), np.log([0.5, 0.01, 1e-9])], [(10, 0.5, 0.2), (7, 0.4, 0.3)]
    earlier = mixing.earlier_of(np.array([0, 0, 0]), np.array([4, 2, 4]))
    assert earlier.tolist() == [0, 0, 1]
    got = mixing.experts(q, seen, laws, earlier)
    for i in range(3):
        counted = math.exp(seen[0][i]) + 0.2 * math.exp(q[i])
        blend = (counted + math.exp(q[i])) / 2
        want = [counted, blend, math.exp(seen[1][i]) + 0.3 * blend, *(earlier[i] + a * blend for a in mixing.URNS)]
        assert [math.exp(v[i]) for v in got] == pytest.approx(want)


def test_rare_tokens_by_the_join_score_as_looked_up_ones(spark):
    rows = [(i, " ".join(f"w{(i * j) % 13} rare{i % 5}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some, all_ = ({r.doc_id: r for r in mixing.score_documents(docs, common=c).collect()} for c in (2, 1 << 16))
    assert len(some) == 60 and all(some[d].score == pytest.approx(r.score) and some[d].base_score == pytest.approx(r.base_score) for d, r in all_.items())
    assert collections.Counter(r.n_tokens for r in some.values()) == {41: 60}
