"""Each operator against a brute-force version on a small corpus, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkveil.llm import chat, decontaminate, fingerprints, mixing, ngram_join, packing, queries, records, sharding, suffix_dedup, tokens, toxicity
from inkveil.llm._bytes import words as byte_words

from .conftest import SF


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- fingerprints ------------------------------------------------------------


def winnowed(text, k=4, w=12):
    """Marks (hash, position) by the plain rule: a hash that rolls over the words, the least of each window, the rightmost of equal ones."""
    p, base = fingerprints.P, fingerprints.BASE
    ws = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    ws = [((x - (1 << 64) if x >> 63 else x) % (p - 1)) + 1 for x in ws]
    if not ws:
        return []
    h = 0
    for x in (ws + [0] * k)[:k]:
        h = (h * base + x) % p
    grams = [h]
    for i in range(k, len(ws)):
        h = ((h - ws[i - k] * pow(base, k - 1, p)) * base + ws[i]) % p
        grams.append(h)
    windows = [range(i, min(i + w, len(grams))) for i in range(max(1, len(grams) - w + 1))]
    return sorted({min((grams[j], -j) for j in win) for win in windows}, key=lambda m: -m[1])


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, corpus):
    got = rows(queries.QUERIES["op1_fingerprints"](spark, SF))
    printed = lambda marks: " ".join(f"{h:X}@{-i}" for h, i in marks)
    plain = [winnowed(t) for _, t in corpus]
    for i, (d, t) in enumerate(corpus):
        nxt, half = corpus[(i + 1) % len(corpus)][1], len(t) // 2
        r, edited = got[d], t[: len(t) - half] + nxt[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == printed(plain[i]) and r.edited_fingerprint == printed(winnowed(edited))
        assert r.near_edited == pytest.approx(alike(plain[i], winnowed(edited))) and r.near_next == pytest.approx(alike(plain[i], plain[(i + 1) % len(corpus)]))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


@pytest.mark.parametrize("text", ["a b", "a b c d", "a b c d e", "x " * 40, "x y " * 30, " ".join(f"w{i % 7}" for i in range(60)), "The END. the_end, THE end!"])
def test_marks_of_repeating_and_short_texts(spark, text):
    """Ties all along a text, fewer words than one gram, fewer grams than one window."""
    (r,) = fingerprints.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.fingerprint == " ".join(f"{h:X}@{-i}" for h, i in winnowed(text))


def test_fingerprints_share_long_passages(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(i, " ".join(f"{i}x{j}" for j in range(20 * i)) + " " + passage + " " + " ".join(f"{i}y{j}" for j in range(9))) for i in (1, 2)], "doc_id long, text string")
    a, b = ({m.split("@")[0] for m in r.fingerprint.split()} for r in fingerprints.fingerprints(df).collect())
    assert a & b


def test_fingerprints_odd(spark, odd, nothing):
    got = rows(fingerprints.edit_report(odd))
    assert len(got) == 10 and got[5].fingerprint == got[1].fingerprint == "" and got[2].fingerprint == got[3].fingerprint
    assert fingerprints.edit_report(odd.unionByName(odd)).count() == 20
    assert fingerprints.edit_report(nothing).count() == 0


# --- decontamination -----------------------------------------------------------


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def matches(docs, items, n=10):
    out = {}
    for d, t in docs:
        w, hit, ids = word_list(t), set(), set()
        for i, x in items:
            v = word_list(x)
            k = min(n, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    ids.add(str(i))
        near = {str(i) for i, x in items if in_place(w, word_list(x), n)}
        out[d] = (len(w), len(hit), *listed(ids), bool(hit), *listed(near))
    return out


def listed(ids):
    return len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def in_place(w, v, n, replaced=2):
    """The most words that a window of v has in place anywhere in w, if they suffice; every window is laid at every place."""
    k = min(n, len(v))
    sums = (sum(0 <= p + x < len(w) and w[p + x] == v[s + x] for x in range(k)) for s in range(len(v) - k + 1) for p in range(-k, len(w))) if k else ()
    best = max(sums, default=0)
    return best if best and best >= k - k * replaced // n else 0


CASES = [(1, "A b c"), (2, "q w e r t y u i o p a s"), (3, "x"), (4, None), (5, ""), (6, "É é"), (7, "the the the the the the the the the the the")]
TEXTS = [(1, "a B, c! a b"), (2, "Q w e r t y u i o p a s d"), (3, "w e r t y u i o p a s"), (4, None), (5, "x"), (6, "É é"), (7, "é é"), (8, "the " * 30), (9, "r t y u i o p a s")]


@pytest.mark.parametrize("literals", [20_000, 0])
def test_decontamination_small(spark, literals):
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(CASES, "item_id long, text string")
    want = matches(TEXTS, CASES)
    runs = decontaminate.phrase_matches(docs, items, most_literals=literals).collect()
    hit = collections.defaultdict(set)
    for r in runs:
        hit[r.doc_id].update(range(r["first"], r["last"] + 1))
    assert {d: len(hit[d]) for d, _ in TEXTS} == {d: w[1] for d, w in want.items()}
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs, items).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {d for d, w in want.items() if not w[4]}


def test_decontamination_odd(spark, odd, nothing):
    items = spark.createDataFrame(CASES, "item_id long, text string")
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, items.limit(0)).collect())
    assert decontaminate.proximity_matches(spark.createDataFrame(TEXTS, "doc_id long, text string"), items).where("item_id = '2'").count() >= 2


@pytest.mark.parametrize("literals", [20_000, 0])
def test_near_matches(spark, literals):
    """Random texts of few words against windows at every place: replaced words, short items, windows over a text's ends, one block over and over."""
    rng = np.random.default_rng(5)
    text = lambda n, of: " ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"[:of]), n))
    items = [(i, text(n, 26)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 25, 10])] + [(99, "the " * 15), (98, None), (97, "")]
    docs = []
    for d in range(60):
        words_ = items[rng.integers(3, 14)][1].split()
        for at in rng.integers(0, len(words_), d % 4):
            words_[at] = "new"
        docs.append((d, f"{text(6, 26)} {' '.join(words_)} {text(4, 26)}" if d % 5 else " ".join(words_[1:])))
    docs += [(100, "the " * 400), (101, text(300, 3)), (102, None)]
    got = decontaminate.near_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_literals=literals).collect()
    want = {(d, str(i)): best for d, t in docs for i, x in items if (best := in_place(word_list(t), word_list(x), 10))}
    assert {(r.doc_id, r.item_id): r.same for r in got} == want and len(got) == len(want) > 40
    source, target = dict(docs), {str(i): word_list(x) for i, x in items}
    for r in got:  # what `first` says is there
        w, v = word_list(source[r.doc_id]), target[r.item_id]
        k = min(10, len(v))
        assert any(sum(0 <= r["first"] + x < len(w) and w[r["first"] + x] == v[s + x] for x in range(k)) == r.same for s in range(len(v) - k + 1))


def test_proximity(spark):
    """A copy with its rarest word replaced, words out of order, and a window of one word over and over."""
    items = spark.createDataFrame([(1, "q w e r t y u i o p"), (2, "the " * 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b q w e r NEW y u i o p c"), (2, "p o i u y t r e w q"), (3, "q w e other words"), (4, "the " * 30), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.near for r in decontaminate.proximity_matches(docs.where("doc_id in (1, 3, 4, 5)"), items).collect()}
    assert got == {(1, "1"): 9, (4, "2"): 1}
    assert {(r.doc_id, r.item_id) for r in decontaminate.proximity_matches(docs, items).collect()} == {(1, "1"), (2, "1"), (4, "2")}


# --- suffix arrays ----------------------------------------------------------------


def cut(docs, n=50):
    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen.setdefault(b[i : i + n], d) < d:
                gone[i : i + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        edges = np.diff(np.r_[0, gone.astype(int)])
        out[d] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, corpus):
    got = queries.QUERIES["op3_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == cut(corpus)


def test_suffix_dedup_odd(spark, odd, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_digest(odd).collect()}
    assert got == cut([(r.doc_id, r.text) for r in odd.collect()])
    assert suffix_dedup.removed_digest(nothing).count() == 0
    kept = rows(suffix_dedup.remove_repeats(odd))
    assert set(kept) == {1, 2, 4, 5, 6, 7, 8, 9, 10} and kept[5].text is None and kept[4].n_chars == len(kept[4].text)


@pytest.mark.parametrize("hot", [30, 10**9])
def test_suffix_dedup_hot_anchor(spark, monkeypatch, hot):
    """A passage that most documents share in different surroundings, met by its windows or by its anchors: the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage, line = word(110), word(70)
    docs = [(int(d), word(int(rng.integers(0, 40))) + passage[: 110 - d % 3 * 20] + word(int(rng.integers(0, 60))) + (line if d % 9 == 0 else "") + word(9)) for d in rng.permutation(120)]
    docs.append((500, "ab" * 400))
    docs.append((501, "ab" * 300))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed_digest(df).collect()} == cut(docs)


@pytest.mark.parametrize("shards", [1, 2, 3, 5])
def test_merged_order_and_prefixes(shards):
    """The tree of merges gives the order and the common prefixes that sorting gives."""
    rng = np.random.default_rng(shards)
    texts = [np.r_[rng.choice(np.frombuffer(b"ab", np.uint8), 300), np.uint8(0)] for _ in range(shards)]
    texts[-1][50:200] = texts[0][100:250]
    whole, base = b"".join(map(bytes, texts)), np.cumsum([0, *map(len, texts)])
    cut_ = [suffix_dedup.shard(t, b) for t, b in zip(texts, base, strict=False)]
    empty = suffix_dedup.Shard(np.zeros(0, np.uint16), np.zeros(0, np.int32))
    order, common = suffix_dedup.merged(cut_ if shards > 1 else [*cut_, empty], 50)
    at = lambda p: next((bytes(t) * 2)[p - b :][:50] for t, b in zip(texts, base, strict=False) if b <= p < b + len(t))
    got = [at(p) for p in order.at.tolist()]
    assert got == sorted(got) and sorted(order.at.tolist()) == list(range(len(whole)))
    for x, y, c in zip(got, got[1:], common[1:], strict=False):
        same = next((i for i in range(50) if x[i] != y[i]), 50)
        assert c == same // 2 * 2


def test_long_text_by_segments():
    """Every window of a text taken by segments belongs to an anchor, with the hash it has in the text as a whole."""
    data = np.random.default_rng(4).integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 5000])
    whole = {(int(p), int(h)) for _, pos, h, *_ in suffix_dedup.row_anchors(data, off) for p, h in zip(pos, h, strict=True)}
    parts = [(int(p), int(h), int(r)) for _, pos, h, _, reach in suffix_dedup.row_anchors(data, off, segment=700) for p, h, r in zip(pos, h, reach, strict=True)]
    assert {(p, h) for p, h, _ in parts} == whole
    assert sorted(x for p, _, r in parts for x in range(p - r % 256, p - r % 256 + r // 256 + 1)) == list(range(4951))


def test_clashing_classes(spark, monkeypatch):
    """Texts whose short keys clash are told apart by their whole SHA-256."""
    real = suffix_dedup._keyed
    short = lambda docs, clash=None: real(docs, clash).withColumn("sig", F.when(F.col("sha").isin(clash or []), F.col("sig")).otherwise(F.col("sig") % 2))
    monkeypatch.setattr(suffix_dedup, "_keyed", short)
    docs = [(i, f"{i % 3} some text that is long enough to have windows of fifty bytes {i % 3}" * 2) for i in range(9)]
    got = suffix_dedup.removed_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == cut(docs)


# --- language model ------------------------------------------------------------------


def test_mixing(spark, corpus):
    got = rows(queries.QUERIES["op4_context_mixing"](spark, SF))
    count = collections.Counter()
    for d, t in corpus:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update([*mixing.tokens(t), b""])
    n, v = sum(count.values()), len(count)
    for d, t in corpus:
        own, r = [*mixing.tokens(t), b""], got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own))
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    uniform = sum(8 * len(t.encode()) for d, t in corpus if got[d].held_out)
    assert -sum(r.score for r in held) / math.log10(2) < 0.4 * uniform


def test_mixing_is_a_distribution():
    tables = [np.random.default_rng(2).integers(0, 9, (1 << b, 2)).astype(np.float32) for b in mixing.BITS]
    m = mixing.Mixer(tables)
    ends = np.exp2(m.log2p([b"a"]))[0]  # a, then the closing byte
    slots, bits, _, owner = mixing.bit_slots([bytes([c]) for c in range(256) if c != 32])
    total = np.exp2(m.log2p([bytes([c]) for c in range(33, 256)])).sum()
    assert 0 < ends < 1 and total < 1 and len(bits) == 16 * 255 and slots.max() < 1 << max(mixing.BITS) and owner.max() == 254


def test_mixing_against_plain_python():
    """Mixer and map, bit by bit in plain Python."""
    rng = np.random.default_rng(7)
    m = mixing.Mixer([rng.integers(0, 9, (1 << b, 2)).astype(np.float32) for b in mixing.BITS])
    m.weights = [rng.normal(0.2, 0.1, w.shape) for w in m.weights]
    m.map = np.sort(rng.random((mixing.CONF, mixing.STEPS)), axis=1)
    toks = [b"alpha", b"b", "é".encode(), b"", b"alphabet" * 9]
    for tok, got in zip(toks, m.log2p(toks), strict=True):
        slots, bits, places, _ = mixing.bit_slots([tok])
        total = 0.0
        for i, bit in enumerate(bits.tolist()):
            pairs = [m.tables[k][slots[k, i]] for k in range(6)]
            whole = min(pairs[4], pairs[5], key=lambda p: p.sum())
            x = [math.log((p[1] + 0.02) / (p[0] + 0.02)) for p in (*pairs[:4], whole)] + [0.3]
            conf = [min(int(math.log2(1 + p.sum())), mixing.CONF - 1) for p in (whole, pairs[3])]
            z = sum(a * (m.weights[0][conf[0] * 4 + places[i]][j] + m.weights[1][conf[1] * 4 + places[i]][j]) for j, a in enumerate(x))
            at = (max(-12.0, min(12.0, z)) + 12) / 24 * (mixing.STEPS - 1)
            low = min(int(at), mixing.STEPS - 2)
            row = m.map[conf[0]]
            p = (1 / (1 + math.exp(-z)) + row[low] * (1 - at + low) + row[low + 1] * (at - low)) / 2
            total += math.log2(p if bit else 1 - p)
        assert got == pytest.approx(total, rel=1e-5)


def test_mixing_odd(spark, odd, nothing):
    got = rows(mixing.score_documents(odd, common=3))
    assert got[5].n_tokens == 1 and got[2].score == pytest.approx(got[3].score) and all(math.isfinite(r.score) for r in got.values())
    wide = rows(mixing.score_documents(odd))
    assert all(wide[d].score == pytest.approx(r.score) and wide[d].n_known == r.n_known for d, r in got.items())
    assert mixing.score_documents(nothing).count() == 0


# --- chat -------------------------------------------------------------------------


def test_perspectives(spark):
    rows_ = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|user|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 2000, None, "x"), (2, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows_], "conv_id long, turn long, role string, text string, start long, name string")
    got = chat.perspectives(df).collect()
    views = collections.defaultdict(list)
    for r in got:
        views[r.conv_id, r.speaker].append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown")}
    for (_, speaker), parts in views.items():
        parts.sort(key=lambda r: r.turn)
        text = "".join(r.segment for r in parts)
        for r, (_, _, role, said) in zip(parts, rows_, strict=False):
            assert text[r.start : r.end] == r.segment
            own = (role or "unknown") == speaker
            assert r.role == ("assistant" if own else "system" if role == "system" else "user")
            assert r.name == (None if r.role != "user" else role or "unknown")
            want = (said or "").replace("<|", "< |") + "<|end|>"
            assert text[r.train_start : r.train_end] == (want if own else "")
    assert chat.perspectives(df.limit(0)).count() == 0


def test_perspectives_without_numbers(spark):
    """Null turns come last in every view, and rows without a conv_id are one conversation."""
    given = [(1, None, "ann", "later"), (1, 0, "ann", "hi"), (1, 1500, "bob", "yes"), (1, None, "bob", None), (None, 0, "eve", "who"), (None, 1, "dan", "me"), (None, None, "eve", "end")]
    got = chat.perspectives(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")).collect()
    views = collections.defaultdict(list)
    for r in got:
        views[r.conv_id, r.speaker].append(r)
    assert {k: len(v) for k, v in views.items()} == {(1, "ann"): 4, (1, "bob"): 4, (None, "eve"): 3, (None, "dan"): 3}
    for parts in views.values():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [0, *(r.end for r in parts[:-1])]
        turns = [r.turn for r in parts]
        assert turns == sorted(turns, key=lambda t: (t is None, t or 0)) and all(r.end - r.start == len(r.segment) for r in parts)


# --- packing and records ----------------------------------------------------------------


def test_encoder_is_exact():
    texts = ["Hello, world's  end.\nThe ab́c d²x «q» é, 12.5a _x__ 'tis \t\n x", "a\x1cb c", "  lead", " trail  ", "x y", "it'sn't we'REally", "", "#'s 's'", "é̈ ëx ﬁne", "日本語 text、です", "don't<|endoftext|>x", "Ⅷ ½a 3² İx"]
    for file, spaces in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        enc = tokens.Encoder(P.path(file), spaces)
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.choice([7, 16, 100]))
    sizes = {int(x): int(rng.integers(1, 30)) for x in rng.integers(1, window + 1, 12)}
    runs = packing.plan(sizes, window)
    filled, count = collections.defaultdict(int), collections.Counter()
    for length, _, n, each, first, offset in runs:
        count[length] += n * each
        for w in range(first, first + n):
            assert filled[w] == offset
            filled[w] += each * length
    rest = []
    for length in sorted(sizes, reverse=True):
        for _ in range(sizes[length]):
            fits = [r for r in rest if r >= length]
            best = min(fits) if fits else window
            if fits:
                rest.remove(best)
            rest.append(best - length)
    assert count == sizes and max(filled.values()) <= window and len(filled) == len(rest)


def test_packing(spark, corpus):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = queries.QUERIES["op6_packing"](spark, SF).collect()
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in corpus}
    seen, room = collections.Counter(), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        room[r.sequence_id].append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in ids.items()}
    for parts in room.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_odd(spark, odd, nothing):
    path = P.path("word_bpe_49k.json")
    placed = packing.pack_documents(odd, path, with_ids=True)
    assert placed.where("doc_id = 5").first().doc_tokens == 1
    assert {len(r.ids) for r in packing.sequences(placed).collect()} <= {4096} | {2**k for k in range(12)}
    assert packing.pack_documents(nothing, path).count() == 0


def test_records(spark, corpus):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, at = rows(queries.QUERIES["op7_records"](spark, SF)), 0
    for d, t in corpus:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_records_odd(spark, odd, nothing, tmp_path):
    path = P.path("byte_bpe_50k.json")
    assert rows(records.write_and_read(odd, path))[5].n_tokens == 1
    assert records.write_and_read(nothing, path).count() == 0
    records.write_records(odd, f"file://{tmp_path}/r", path)
    r = spark.read.parquet(f"file://{tmp_path}/r/index").where("doc_id = 6").first()
    data = next((tmp_path / "r" / "ids").glob(f"{r.file}*")).read_bytes()
    doc, ids = records.read_at(data, r.offset)
    assert doc == 6 and len(ids) == r.n_tokens
    bad = bytearray(data)
    bad[r.offset + 14] ^= 1
    with pytest.raises(ValueError):
        records.read_at(bytes(bad), r.offset)


# --- toxicity -----------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w" * 100) for i in range(40)] + [(1, "w" * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda rows, prior: taken.append(len(rows)))
    for most in (64 << 20, 1000, 0):
        toxicity.fit(docs, labels, most_bytes=most)
    known = [d for d in [*range(40), 1] if zlib.crc32(str(d).encode()) % 3 != 1]
    assert taken[0] == len(known) and taken[1] in (9, 10) and taken[2] == 0


def test_toxicity_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 11)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.score_documents(odd, labels))
    assert len(got) == 10 and got[2].score == got[3].score and got[5].predicted == got[1].predicted == 0
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert toxicity.score_documents(odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


# --- sharding -------------------------------------------------------------------------------


def test_sharding(spark, corpus):
    got, text = rows(sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"))), dict(corpus)
    sums, slots, places = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for d, r in got.items():
        assert r["size"] == len(text[d].encode()) + 1 and r.text_crc32 == zlib.crc32(text[d].encode())
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        places[text[d]].add(r.shard)
    assert set(sums) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) < 2 * max(len(t.encode()) for t in text.values())


def test_sharding_follows_a_plain_tree(spark):
    """Against a k-d tree built row by row: the same dimension and, but for what is too light to part, the same side of the median."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows(sharding.kd_shards(docs, 8))
    points = sharding._coordinates(docs).collect()
    full = {d: max(1, max(r[d] for r in points) - min(r[d] for r in points)) for d in sharding.DIMENSIONS}
    want = {}

    def split(part, first, k):
        if k == 1:
            want.update({r.doc_id: first for r in part})
            return
        spread = lambda d: (max(r[d] for r in part) - min(r[d] for r in part)) / full[d]
        by = max(sharding.DIMENSIONS, key=spread)
        part = sorted(part, key=lambda r: (r[by], r.d_hash, r.tie))
        sums = np.cumsum([r["size"] for r in part])
        cut_ = int(np.argmin(np.abs(sums - sums[-1] * (k // 2) / k))) + 1
        split(part[:cut_], first, k // 2)
        split(part[cut_:], first + k // 2, k - k // 2)

    split(points, 0, 8)
    assert np.mean([got[d].shard == x for d, x in want.items()]) > 0.9
    weight = collections.Counter()
    for r in got.values():
        weight[r.shard] += r["size"]
    assert len(weight) == 8 and max(weight.values()) - min(weight.values()) < 2 * max(r["size"] for r in points)
    small = sharding.kd_shards(docs, target_bytes=100_000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(small) == -(-sum(r["size"] for r in points) // 100_000)


def test_equal_texts_of_several_sources(spark):
    df = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i}", "abc"[i % 3], f"s{i % 5}") for i in range(60)], "doc_id long, text string, lang string, source string")
    same = sharding._coordinates(df).where("doc_id % 2 = 1").select("d_source", "d_lang").distinct()
    assert same.count() == 1


def test_components_say_when_they_are_not_settled(spark):
    from inkveil.llm._common import components

    chain = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_files_beyond_five_digits(spark):
    df = spark.createDataFrame([(f"part-{n}", 0, n, 10, n) for n in ("00000", "99999", "100000")], "file string, record long, doc string, n_tokens long, crc string")
    got = records.with_starts(df.selectExpr("file", "record", "cast(doc AS long) AS doc_id", "n_tokens", "cast(crc AS long) AS ids_crc32"))
    assert {r.doc_id: r.start for r in got.collect()} == {0: 0, 99999: 10, 100000: 20}


def test_sharding_odd(spark, odd, nothing):
    got = sharding.shard_documents(odd.unionByName(odd), 4).collect()
    assert len(got) == 20 and {r.shard for r in got} <= set(range(4))
    assert sharding.shard_documents(nothing).count() == 0


# --- near duplicates ---------------------------------------------------------------------------


def linked(docs, num=3, den=4):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree, ids = collections.Counter(), list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                degree[a] += 1
                degree[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), degree[d]) for d in sets}


def test_ngram_join(spark, corpus):
    got = queries.QUERIES["op10_ngram_join"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == linked(corpus)


@pytest.mark.parametrize("chunk,frequent", [(4096, 20), (7, 2), (4096, 1000)])
def test_ngram_join_large_group(spark, monkeypatch, chunk, frequent):
    """Many near copies, also where a block is cut into chunks; with all, some and none of the shared shingles frequent."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for d in range(60):
        w = list(base)
        for i in rng.integers(0, 80, rng.integers(0, 4)):
            w[i] = f"x{d}_{i}"
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in ngram_join.near_duplicates(df).collect()} == linked(docs)


def test_ngram_join_frequent_shingles(spark, monkeypatch):
    """A passage in all texts: its shingles come last in every set, dealt by text, from a sample or from all."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(d, passage + " " + " ".join(f"d{d % 60}w{i}" for i in range(rng.integers(1, 40)))) for d in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    h, n = ngram_join._frequent(df, 5, len(docs))
    assert len(h) == 26 and (n >= 100).all() and (np.diff(h.astype(object)) > 0).all()
    want = linked(docs)
    assert {r.doc_id: tuple(r)[1:] for r in ngram_join.near_duplicates(df).collect()} == want
    monkeypatch.setattr(ngram_join, "SAMPLE", 60)
    monkeypatch.setattr(ngram_join, "FREQUENT", 10)
    assert {r.doc_id: tuple(r)[1:] for r in ngram_join.near_duplicates(df).collect()} == want


def test_ngram_join_odd(spark, odd, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.near_duplicates(odd).collect()}
    assert got == linked([(r.doc_id, r.text) for r in odd.collect()])
    assert ngram_join.near_duplicates(nothing).count() == 0
    assert {r.doc_id for r in ngram_join.keep_one(odd).collect()} == {1, 2, 5, 6, 8, 9, 10}


@pytest.fixture(scope="module")
def unnamed(spark):
    """Rows without a doc_id, clean ones, copies of others, and one with words of item 2."""
    rows_ = [(None, "q w e r t y u i o p a s d"), (None, "clean words of no other row"), (None, None), (1, "w1 " * 40 + "end"), (None, "w1 " * 40 + "end"), (2, "some other text")]
    return spark.createDataFrame(rows_, "doc_id long, text string")


def test_no_doc_id_stays(spark, unnamed):
    count = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    every = count(unnamed)
    assert count(suffix_dedup.remove_repeats(unnamed)) == every
    assert count(ngram_join.keep_one(unnamed)) == every
    items = spark.createDataFrame(CASES, "item_id long, text string").where("item_id = 2")
    bad = (None, "q w e r t y u i o p a s d")
    assert count(decontaminate.drop_contaminated(unnamed, items)) == collections.Counter({k: n for k, n in every.items() if k != bad})


def test_no_doc_id_is_reported(unnamed):
    got = collections.Counter((r.doc_id, r.n_chars) for r in fingerprints.edit_report(unnamed).collect())
    assert got == collections.Counter((r.doc_id, len(r.text or "")) for r in unnamed.collect())
    back = records.write_and_read(unnamed, P.path("byte_bpe_50k.json")).collect()
    assert sorted(r.doc_id or 0 for r in back) == [0, 0, 0, 0, 1, 2] and sum(r.doc_id is None for r in back) == 4
    assert records.unframe(records.frame(None, b"\1\0\0\0") + b"\n")[0] is None and records.unframe(records.frame(0, b"") + b"\n")[0] == 0


def test_words_never_cross_rows():
    data = np.frombuffer(b"ab" + b"cd e", np.uint8)
    starts, ends, n = byte_words(data, np.array([0, 2, 2, 6]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 2), (2, 4), (5, 6)] and n.tolist() == [1, 0, 2]
