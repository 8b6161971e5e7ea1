"""Ranks, switches, replies, versions of exports and the trained tagger against plain versions."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.operators import chunks, detect, names, perceptron, ranking, spans, tagging, tags
from inkveil.plans import notes
from inkveil.sources import intake

from .test_detect import papers

SF = "/root/testdata/sf0.001"


# --- ranks ------------------------------------------------------------------------


def test_ranks_and_sums(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate((random.Random(i).choice(["a", "b", None]), random.Random(-i).randrange(20)) for i in range(500))]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = {r.i: (r.k, r.n) for r in ranking.ranked(df, ["g"], [F.col("v").desc(), F.col("i")], "k", "n").collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(k, len(own)) for k in range(len(own))]
    total = {r.i: r.s for r in ranking.running_total(df, [F.col("i")], "v", "s").collect()}
    assert [total[i] for i in range(500)] == np.cumsum([0] + [v for _, v, _ in rows])[:-1].tolist()
    assert ranking.ranked(df.limit(0), ["g"], [F.col("i")], "k").collect() == []


def test_batch_order_is_the_same_in_every_run(spark):
    names_ = ["b.txt", "B.txt", "a.txt", "Á.txt", "á.txt", "z.txt", "10.txt", "9.txt", "_.txt", "Zebra", "é"]
    rows = [(f"p{i}", random.Random(i).choice(names_)) for i in range(3000)]
    df = spark.createDataFrame(rows, "paper_id string, name string")
    one = {r.paper_id: r.paper_ord for r in intake.in_batch_order(df.repartition(16), "b").collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        two = {r.paper_id: r.paper_ord for r in intake.in_batch_order(df.repartition(5).orderBy(F.rand()), "b").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert one == two and sorted(one.values()) == list(range(3000))
    name = dict(rows)
    ordered = [name[p] for p in sorted(one, key=one.get)]
    assert list(dict.fromkeys(ordered)) == ["_.txt", "10.txt", "9.txt", "a.txt", "á.txt", "Á.txt", "b.txt", "B.txt", "é", "z.txt", "Zebra"]
    same = [p for p in sorted(one, key=one.get) if name[p] == "b.txt"]
    assert same == sorted(same)


def test_skipped_is_bounded(spark):
    df = spark.createDataFrame([(f"f{i:03}.exe",) for i in range(100)] + [("a.txt",)], "name string")
    r = intake.skipped(df, 3).first()
    assert (r.skipped_n, r.names, r.only_doc) == (100, "f000.exe, f001.exe, f002.exe", False)
    assert intake.rejected(df).count() == 100
    old = intake.skipped(spark.createDataFrame([("x.DOC",)], "name string")).first()
    assert (old.skipped_n, old.names, old.only_doc) == (1, "x.DOC", True)
    assert intake.skipped(df.limit(0)).first().skipped_n == 0


# --- switches ------------------------------------------------------------------------


def test_replay_against_a_plain_loop(spark):
    rng = random.Random(1)
    texts = ["1234567 a@b.co 7654321 c@d.ef 502-555-0187", "none", "a@b.co"]
    done = detect.detect(papers(spark, texts)).cache()
    log = [(str(rng.randrange(4)), i, rng.choice([None, 0, 1, 2, 4, 99]), rng.choice(["ID", "EMAIL", "PHONE", "NOPE", None])) for i in range(80)] + [(None, 1, 1, None), ("0", 3, None, None)]
    events = spark.createDataFrame(rng.sample(log, len(log)), "paper_id string, seq long, id int, type string")
    state = {r.paper_id: [[f.type, True] for f in r.findings] for r in done.collect()}
    for p, _, i, kind in sorted(log[:-2], key=lambda e: e[1]):
        fs = state.get(p, [])
        if i is not None:
            if i < len(fs):
                fs[i][1] = not fs[i][1]
        elif kind is not None:
            own = [f for f in fs if f[0] == kind]
            on = not all(f[1] for f in own)
            for f in own:
                f[1] = on
    got = detect.replayed(done, events)
    assert got.columns == done.columns
    assert {r.paper_id: [[f.type, f.enabled] for f in r.findings] for r in got.collect()} == state


def test_repeated_overrides(spark):
    done = detect.detect(papers(spark, ["1234567 a@b.co 7654321"]))
    rows = [("0", 1, False, 1), ("0", 1, True, 2), ("0", 0, True, 1), ("0", 0, False, 2), ("0", 2, None, 3), ("0", None, False, 3)]
    chosen = spark.createDataFrame(rows, "paper_id string, id int, enabled boolean, seq long")
    assert [f.enabled for f in detect.with_overrides(done, chosen).first().findings] == [False, True, True]
    assert [f.enabled for f in detect.with_overrides(done, chosen.drop("seq")).first().findings] == [False, False, True]
    assert detect.with_overrides(done.withColumn("o", F.lit(1)), chosen).columns == [*done.columns, "o"]


# --- detection -----------------------------------------------------------------------


def test_many_findings_take_linear_time(spark):
    text = " é; ".join(f"12345{i:06d}" for i in range(100_000))
    detect.detect(papers(spark, ["1234567"])).collect()
    began = time.time()
    done = detect.kept(papers(spark, [text]))
    found = detect.findings(done)
    out = tags.scrub(done, found, tags.assign_tags(found)).first()
    assert out.n_findings == 100_000 and out.scrubbed.endswith("[ID 100000]") and time.time() - began < 100


def test_folds_across_blocks(spark):
    """More findings than a block holds, with overlaps and neighbours at the edges of blocks."""
    rng = random.Random(2)
    text = "x" * 40_000
    found, at = [], 0
    for _ in range(3 * spans.BLOCK + 5):
        at += rng.randrange(0, 6)
        found.append(("NAME" if rng.random() < 0.6 else "ID", at, at + rng.randrange(1, 9), rng.random(), rng.choice(["model", "regex"])))
    df = spark.createDataFrame([(text, found)], f"text string, f {spans.FINDINGS}")
    weigh = lambda f: (1e9 if f[4] == "regex" else 0) + (f[2] - f[1]) * 100 + f[3]
    kept = []
    for f in sorted(found, key=lambda f: (f[1], -f[2])):
        if kept and f[1] < kept[-1][2]:
            if weigh(f) > weigh(kept[-1]):
                kept[-1] = f
        else:
            kept.append(f)
    df = df.withColumn("r", spans.resolve(F.col("f")))
    r = df.withColumn("m", spans.merge(F.translate("text", "x", " "), F.col("r"))).first()
    assert [tuple(x) for x in r.r] == kept
    assert [f.asDict() for f in r.m] == names.joined(" " * 40_000, [f.asDict() for f in r.r])


def test_cutting_slabs(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "🦆" for i in range(1000))
    places = [(0, 5), (250, 10), (255, 1), (256, 0), (256, 256), (100, 900), (999, 1), (1000, 0), (990, 10)]
    df = spark.createDataFrame([(text, a, n) for a, n in places], "t string, a int, n int")
    assert [r[0] for r in df.select(spans.cut(spans.slabs(F.col("t")), F.col("a"), F.col("n"))).collect()] == [text[a : a + n] for a, n in places]


def test_no_exchange_of_texts(spark, tmp_path):
    """Detection with a tagger reads the texts once and exchanges nothing; scrubbing exchanges texts with findings alone."""
    papers(spark, ["a@b.co", "none"]).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    plan = detect.detect(rows, tagging.each_chunk(tagging.pattern_tagger))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    done = detect.kept(rows)
    found = detect.findings(done)
    out = {r.paper_id: (r.n_findings, r.scrubbed) for r in tags.scrub(done, found, tags.assign_tags(found)).collect()}
    assert out == {"0": (1, "[EMAIL]"), "1": (0, "none")}


# --- replies ---------------------------------------------------------------------------


def one_by_one(text, known):
    for tag, original in known:
        text = text.replace(tag, original)
    return text


def test_unscrub_equals_one_after_the_other(spark):
    rng = random.Random(4)
    words = ["[NAME 1]", "[NAME 2]", "[NAME 12]", "[EMAIL]", "[", "]", "NAME ", "1", "N", " x ", "[NAME", "AME 2]", "[]", "\n"]
    replies, maps, want = [], [], {}
    for i in range(150):
        tags_ = rng.sample(["[NAME 1]", "[NAME 2]", "[NAME 12]", "[EMAIL]"], rng.randrange(5))
        known = [(t, rng.choice(["Ann", "N", "[NAME 2]", "x[", "1", ""]) if i % 2 else rng.choice(["Ann", "Bo"])) for t in tags_]
        text = "".join(rng.choice(words) for _ in range(rng.randrange(14)))
        replies.append((str(i), f"s{i}", text))
        maps += [(f"s{i}", k, 0, t, o) for k, (t, o) in enumerate(known)]
        want[str(i)] = one_by_one(text, [(t, o) for t, o in known if t in re.findall(tags.TAG, text)])
    got = tags.unscrub(spark.createDataFrame(replies, "reply_id string, scope string, text string"), spark.createDataFrame(maps, "scope string, ord long, start int, tag string, original string"))
    assert {r.reply_id: r.text for r in got.collect()} == want


def test_ten_thousand_tags_in_a_reply(spark):
    n = 10_000
    reply = spark.createDataFrame([("r", "s", " ".join(f"[NAME {i}]" for i in range(n)))], "reply_id string, scope string, text string")
    known = spark.range(n).selectExpr("'s' as scope", "id as ord", "0 as start", "concat('[NAME ', id, ']') as tag", "concat('w', id) as original")
    began = time.time()
    assert tags.unscrub(reply, known).first().text == " ".join(f"w{i}" for i in range(n)) and time.time() - began < 60


def test_versions_of_exports(spark):
    exports = spark.createDataFrame([(1, "b", "p"), (1, "b", "q"), (3, "b", "p"), (5, "b", "q"), (2, "c", "p")], "export_id long, batch_id string, paper_id string")
    maps = spark.createDataFrame(
        [(1, "b", "p", 0, 0, "[EMAIL]", "old@p"), (1, "b", "q", 1, 0, "[EMAIL]", "q@q"), (1, "b", "q", 1, 9, "[NAME]", "Q"), (3, "b", "p", 0, 4, "[EMAIL 1]", "new@p"), (2, "c", "p", 0, 0, "[EMAIL]", "c@c")],
        "export_id long, batch_id string, paper_id string, ord long, start int, tag string, original string",
    )
    replies = spark.createDataFrame([(f"{b}{at}", b, at, "[EMAIL] [EMAIL 1] [NAME]") for b, at in (("b", 0), ("b", 1), ("b", 2), ("b", 4), ("b", 5), ("b", 99), ("c", 2), ("d", 1))], "reply_id string, batch_id string, at long, text string")
    got = {r.reply_id: r.text for r in tags.unscrub_as_of(replies, exports, maps).collect()}
    plain, first = "[EMAIL] [EMAIL 1] [NAME]", "old@p [EMAIL 1] Q"
    # after 3 the paper p has no [EMAIL] any more, so that of q counts; 5 exports q without any tag
    assert got == {"b0": plain, "b1": first, "b2": first, "b4": "q@q new@p Q", "b5": "[EMAIL] new@p [NAME]", "b99": "[EMAIL] new@p [NAME]", "c2": "c@c [EMAIL 1] [NAME]", "d1": plain}


# --- tagger ------------------------------------------------------------------------------


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(5)
    scores, moves, lengths = rng.normal(size=(4, 5, 3)), rng.normal(size=(3, 3)), np.array([5, 1, 3, 4])
    for i in range(4):
        scores[i, lengths[i] :] = 0
    got = perceptron.viterbi(scores, moves, lengths)
    for i, n in enumerate(lengths):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[i, t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[i, :n]) == best and not got[i, n:].any()


def test_held_out_f1(spark):
    """Names and places that the tagger wasn't trained on, in notes of the same kinds."""
    rows = [(r.text, [(s.start, s.end, s.label) for s in r.spans]) for r in notes.labelled_notes(spark, SF).collect()]
    new = lambda r: any(w in r[0] for w in ("Blue", "Gear", "Asia"))
    model = perceptron.train([r for r in rows if not new(r)])
    test = [r for r in rows if new(r)]
    assert len(test) > 20
    hit = found = gold = 0
    for (_, want), got in zip(test, model.tag([t for t, _ in test]), strict=True):
        got = {(a, b, label) for _, label, _, a, b in got}
        hit, found, gold = hit + len(got & set(want)), found + len(got), gold + len(want)
    assert 2 * hit / (found + gold) > 0.9


class Counting:
    """A model that counts its loads and fails at given calls."""

    loads, calls, fails = 0, 0, ()

    @classmethod
    def load(cls):
        cls.loads += 1
        return cls()

    def tag(self, texts):
        Counting.calls += 1
        if Counting.calls in Counting.fails:
            raise MemoryError("gone")
        return [[(t[:1], "B-CITY", 0.9, 0, 1)] for t in texts]


def test_a_model_is_loaded_once_and_evicted_when_it_fails():
    Counting.loads, Counting.calls, Counting.fails = 0, 0, (3,)
    texts = ["a", "bbb", "cc", "dddddddd"]
    for _ in range(2):
        assert [t[0][0] for t in perceptron.tag_all(texts, "k", Counting.load, 6)] == ["a", "b", "c", "d"]
    assert Counting.loads == 2  # once at first, once after the third call
    Counting.fails = tuple(range(100))
    with pytest.raises(MemoryError):
        perceptron.tag_all(texts, "k", Counting.load, 6)
    assert "k" not in perceptron._LOADED

    def broken():
        raise OSError("no weights")

    with pytest.raises(OSError):
        perceptron.tag_all(texts, "other", broken, 6)
    assert "other" not in perceptron._LOADED


def test_groups_by_length():
    texts = ["x" * n for n in (5, 1, 9, 30, 2, 2)]
    groups = list(perceptron.by_length(texts, 10))
    assert sorted(i for g in groups for i in g) == list(range(6)) and groups[-1] == [3]
    assert all(len(g) == 1 or len(g) * max(len(texts[i]) for i in g) <= 10 for g in groups)


def test_a_model_loads_once_in_each_worker(spark, tmp_path):
    """Several batches and tasks, one load a worker process; chunks come back to the rows they are of."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return Echo()

    class Echo:
        def tag(self, texts):
            return [[(t[:9], "B-CITY", 0.9, 0, min(9, len(t)))] for t in texts]

    rows = spark.range(400).selectExpr("id", "repeat(concat('n', id, '. '), cast(id % 60 * 10 + 1 as int)) as text").repartition(8)
    parts = rows.withColumn("parts", chunks.chunk_text(F.col("text")))
    got = parts.select("id", "parts", perceptron.model_tagger("echo-test", load)(F.col("parts")).alias("t")).collect()
    assert all([c.text[:9] for c in r.parts] == [t[0].word for t in r.t] for r in got)
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert pids and len(pids) == len(set(pids))


def test_special_tokens_and_short_findings(spark):
    tokens = [("[CLS]", "B-CITY", 0.9, 0, 5), ("Paris", "B-CITY", 0.9, None, None), ("</s>", "I-CITY", 0.9, None, None), ("Q", "B-FIRSTNAME", 0.9, None, None)]
    tagger = lambda parts: F.transform(parts, lambda c: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("word", "label", "score", "start", "end"), t)]) for t in tokens]).cast(tagging.TOKENS))
    found = detect.findings(papers(spark, ["in Paris, Q, at"]), tagger).collect()
    assert [(r.type, r.surface) for r in found] == [("CITY", "Paris")]
