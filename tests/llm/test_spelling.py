"""Spelling variants against a plain version over all pairs."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from inkveil.llm import spelling

from .conftest import SF


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_words(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_deletion(n):
    """Near words from words with one letter masked or taken out."""
    masked, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            masked[w[:i] + "*" + w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in n:
                near[w].add(short)
                near[short].add(w)
    for ws in masked.values():
        for w in ws:
            near[w] |= ws - {w}
    return near


def plain(rows):
    n = plain_words(rows)
    near = by_deletion(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def collected(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("cell", [20_000, 150, 7])
def test_documents(spark, corpus, cell):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert collected(spelling.variants(docs, cell)) == plain(corpus)


def test_pairs_of_a_cell():
    rng = random.Random(3)
    for size in (5, 6, 9, 140):
        words = list({"".join(rng.choice("abcé") for _ in range(size)) for _ in range(300 if size < 100 else 3)})
        words += [w[:2] + c + w[3:] for w in words[:40] for c in "az"]
        words = list(dict.fromkeys(words))
        shorter = list(dict.fromkeys([w[:i] + w[i + 1 :] for w in words[:60] for i in (0, 2, size - 1)] + ["".join(rng.choice("abcé") for _ in range(size - 1)) for _ in range(100)]))
        m, q = spelling.codes_of(words, size), spelling.codes_of(shorter, size - 1)
        got = {(words[a], words[b]) for a, b in zip(*spelling.near_pairs(m, m, False, 4), strict=True)}
        assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
        got = [(shorter[a], words[b]) for a, b in zip(*spelling.near_pairs(m, q, True, 4), strict=True)]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in shorter for b in words if one_edit(a, b)}


def test_reached_cells():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(6)) for _ in range(200)]
    tree = {1: (97, 1), 2: (98, 0), 3: (97, 2), 5: (99, 1), 6: (100, 0)}
    cells = spelling.home(spelling.codes_of(words, 6), tree)
    reach = {(node, i) for node, at in spelling.reached(spelling.codes_of(words, 6), tree, 1, 1) for i in at.tolist()}
    for i, w in enumerate(words):
        assert (cells[i], i) in reach
        for j, x in enumerate(words):
            if one_edit(w, x):
                assert (cells[j], i) in reach
    shorter = [w[1:] for w in words]
    reach = {(node, i) for node, at in spelling.reached(spelling.codes_of(shorter, 5), tree, 0, 1) for i in at.tolist()}
    assert all((cells[j], i) in reach for i, w in enumerate(shorter) for j, x in enumerate(words) if one_edit(w, x))


def test_slices_of_long_texts(monkeypatch):
    text = "abc " * 50 + "x" * 70 + ". Éa " * 30 + "dÀ"
    whole = spelling.runs(spelling.lowered(text))
    for size in (1, 7, 64):
        monkeypatch.setattr(spelling, "SLICE", size)
        assert spelling.runs(spelling.lowered(text)) == whole
    assert whole["x" * 70] == 1 and whole["Éa"] == 30


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "Hello hello HELLO hellos hallo hallo hallo hallo hallo hallo")] + [(9, "anagram granama ramagan " * 3), (9, "anagram granama ramagan " * 3)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, word int, n int, length int")
    assert collected(spelling.variants(docs)) == plain(rows)
    assert collected(spelling.variants(docs, 1)) == plain(rows)  # every cell is split, or dealt by hash
    assert spelling.variants(nothing).collect() == []
    assert np.array_equal(spelling.ordered_short(spelling.codes_of(["aab"], 3), spelling.codes_of(["aaab"], 4)), [True])
