import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkveil.operators import chunks, detect, names, reports, spans, tagging, tags
from inkveil.sources import docx, intake, pdf

PAPER = "batch_id string, paper_ord long, paper_id string, name string, kind string, text string, status string, error string"


def papers(spark, texts):
    return spark.createDataFrame([("b", i, str(i), "n.txt", "text", t, "done", None) for i, t in enumerate(texts)], PAPER)


def surfaces(spark, texts):
    rows = detect.detect(papers(spark, texts)).orderBy("paper_ord").collect()
    return [[(f.type, r.text[f.start : f.end]) for f in r.findings] for r in rows]


def test_rules_and_expansion(spark):
    cases = {
        "Call 5025550187 now": [("ID", "5025550187")],
        "9502-555-0187": [("PHONE", "9502-555-0187")],
        "12345678-ABC": [("ID", "12345678-ABC")],
        "12345678901234567": [],
        "$1234567.89": [("ID", "1234567")],
        "write a@b.co.": [("EMAIL", "a@b.co")],
        "see a@b.co/x?y=1 ok": [("EMAIL", "a@b.co/x?y=1")],
        "1234567 7654321": [("ID", "1234567 7654321")],
        "1234567\n7654321": [("ID", "1234567"), ("ID", "7654321")],
        "id 123-45-6789.": [("SSN", "123-45-6789")],
        "🦆 to Harbor Middle School, ok": [("ORG", "Harbor Middle School")],
        "": [],
    }
    assert surfaces(spark, list(cases)) == list(cases.values())


def test_native_and_python_span_logic_agree(spark):
    texts = ["a 1234567 12345678 b@c.de f", "x 502-555-0187 1234567", "1234567, 1234567 and a@b.co b@c.co"]
    df = papers(spark, texts).withColumn("raw", spans.expand(F.col("text"), spans.all_rule_matches(F.col("text"))))
    df = df.withColumn("out", spans.merge(F.col("text"), spans.resolve(F.col("raw"))))
    df = df.withColumn("one", spans.resolve(F.col("raw")))
    for r in df.collect():
        assert [f.asDict() for f in r.out] == names.joined(r.text, [f.asDict() for f in r.one])


def found(text, kind, word):
    a = text.index(word)
    return [{"type": kind, "start": a, "end": a + len(word), "score": 0.9, "source": "model"}]


@pytest.mark.parametrize(
    ("text", "kind", "word", "out"),
    [
        ("Robin Alder\nx", "NAME", "Robin", ["Robin Alder"]),
        ("Robin Alder. My Aunt", "NAME", "Robin", ["Robin Alder. My Aunt"]),
        ("Harlow Essex. Write soon", "CITY", "Harlow", ["Harlow Essex."]),
        ("77 Mill Pond Road in", "ADDRESS", "Mill", ["77 Mill Pond Road"]),
        ("Nils O'Hara", "NAME", "Nils", ["Nils"]),
        ("Núñez came. Núñez left", "NAME", "Núñez", ["Núñez", "Núñez"]),
        ("Zoé came. later Zoé left", "NAME", "Zoé", ["Zoé"]),
        ("Robin came, robin left", "NAME", "Robin", ["Robin"]),
        ("Mrs. Quill spoke. then Mrs. Reed", "NAME", "Mrs. Quill", ["Mrs. Quill"]),
    ],
)
def test_extension_and_echo(text, kind, word, out):
    assert [text[f["start"] : f["end"]] for f in names.settle(text, found(text, kind, word))] == out


def test_heavier_finding_wins(spark):
    df = spark.range(1).select(spans.resolve(F.expr("array(named_struct('type', 'NAME', 'start', 0, 'end', 10, 'score', 0.9D, 'source', 'model'), named_struct('type', 'ID', 'start', 5, 'end', 12, 'score', 1D, 'source', 'regex'))")).alias("f"))
    assert [(f.type, f.start) for f in df.first().f] == [("ID", 5)]


def test_overlapping_echoes():
    text = "Anne-Marie Lou. Then Anne-Marie-Lou, Anne and Marie"
    names_ = [{"type": "NAME", "start": 0, "end": 14, "score": 0.9, "source": "model"}]
    assert [text[f["start"] : f["end"]] for f in names.echoes(text, names_)] == ["Anne-Marie", "Lou"]
    assert names.echoes("no names", []) == []


@pytest.mark.parametrize("filler", ["a" * 1_000_000, "A-" * 100_000, "9" * 1_000_000, "x y. " * 200_000, "a@" * 100_000])
def test_long_texts_take_linear_time(spark, filler):
    import time

    began = time.time()
    got = detect.detect(papers(spark, [filler + " x@b.co " + filler[:1000] + " 1234567 b " + filler])).first()
    assert {"EMAIL", "ID"} <= {f.type for f in got.findings} and time.time() - began < 60


def test_entities(spark):
    text = "Ro bin Alder\nParis Rome Chef"
    toks = [("B-FIRSTNAME", "Ro"), ("I-LASTNAME", "##bin"), ("I-LASTNAME", "Alder"), ("I-CITY", "Paris"), ("B-CITY", "Rome"), ("B-JOBTITLE", "Chef")]
    parts = spark.createDataFrame([("p", 0, 0, text)], "paper_id string, chunk_ord int, start int, text string")
    rows = spark.createDataFrame([("p", 0, i, w, lab, 0.8, None, None) for i, (lab, w) in enumerate(toks)], "paper_id string, chunk_ord int, tok_ord int, word string, label string, score double, start int, end int")
    got = tagging.entities(tagging.with_tokens(parts, rows)).orderBy("start").collect()
    assert [(r.type, text[r.start : r.end]) for r in got] == [("NAME", "Ro bin Alder"), ("CITY", "Paris"), ("CITY", "Rome")]


def test_threshold_keeps_the_mean_that_equals_it(spark):
    rows = spark.createDataFrame([("p", 0, 0, "a b", [(w, "I-CITY", s, None, None) for w, s in (("a", 0.3), ("b", 0.5))])], f"paper_id string, chunk_ord int, start int, text string, tokens {tagging.TOKENS}")
    assert tagging.entities(rows).count() == 1 and tagging.entities(rows, 0.41).count() == 0


def test_list_tagger(spark):
    rows = papers(spark, ["Ann lives in Paris. Later Smith saw Ann Smith"])
    tagger = tagging.each_chunk(tagging.list_tagger({"B-FIRSTNAME": ["Ann"], "B-CITY": ["Paris"]}))
    found = detect.findings(rows, tagger).orderBy("start").collect()
    assert [(r.type, r.surface, r.source) for r in found] == [("NAME", "Ann", "model"), ("CITY", "Paris", "model"), ("NAME", "Smith", "echo"), ("NAME", "Ann Smith", "model")]


def test_tags_and_unscrub(spark):
    df = papers(spark, ["a@b.co and A@B.co. then c@d.ef", "c@d.ef 1234567"])
    found_ = detect.findings(df)
    known = tags.assign_tags(found_)
    assert {(r.key, r.tag) for r in known.collect()} == {("a@b.co", "[EMAIL 1]"), ("c@d.ef", "[EMAIL 2]"), ("1234567", "[ID]")}
    out = [r.scrubbed for r in tags.scrub(df, found_, known).orderBy("paper_ord").collect()]
    assert out == ["[EMAIL 1] and [EMAIL 1]. then [EMAIL 2]", "[EMAIL 2] [ID]"]
    off = found_.withColumn("enabled", F.col("id") > 0)
    assert tags.scrub(df, off, tags.assign_tags(off)).orderBy("paper_ord").first().scrubbed.startswith("a@b.co and [EMAIL 1]")
    replies = spark.createDataFrame([("r", "b", "[EMAIL 2], [EMAIL 10]"), ("s", "b", "none")], "reply_id string, scope string, text string")
    back = {r.reply_id: r.text for r in tags.unscrub(replies, tags.tag_map(found_, known)).collect()}
    assert back == {"r": "c@d.ef, [EMAIL 10]", "s": "none"}


def test_chunks(spark):
    cases = ["a" * 1300, "a" * 2000, "a" * 1000 + ". " + "a" * 998, "a" * 900 + " " + "a" * 1099, "a" * 400 + "\n" + "a" * 1599, "a" * 455 + "\n" + "a" * 1544, "a" * 454 + "\n" + "a" * 1545, ""]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    got = [[len(c.text) for c in r.c] for r in df.select("i", chunks.chunk_text(F.col("text")).alias("c")).orderBy("i").collect()]
    assert [g[:1] for g in got] == [[1300], [1300], [1001], [900], [1300], [456], [1300], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n🦆é", max_size=60), min_size=1, max_size=4))
def test_chunks_join_to_the_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("text", chunks.chunk_text(F.col("text"), 10).alias("c")).collect():
        assert "".join(c.text for c in r.c) == r.text
        assert all(r.text[c.start : c.start + len(c.text)] == c.text for c in r.c)


def word_file(*paragraphs, **parts):
    ns = docx.NAMESPACE
    body = lambda ps: f'<w:x xmlns:w="{ns}">' + "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in ps) + "</w:x>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body(paragraphs))
        for name, ps in parts.items():
            z.writestr(f"word/{name}.xml", body(ps))
    return out.getvalue()


def test_docx(spark):
    file = word_file(("Ro", "bin Alder"), (), ("B",), header1=[("h",)])
    assert docx.parts(file)[0] == "Robin Alder\nB\nh"
    new = docx.rewrite(file, [{"start": 0, "end": 11, "tag": "[NAME]"}])
    assert docx.parts(new)[0] == "[NAME]\nB\nh"
    two = docx.rewrite(file, [{"start": 1, "end": 4, "tag": "[A]"}, {"start": 5, "end": 7, "tag": "[B]"}, {"start": 12, "end": 15, "tag": "[C]"}])
    assert docx.parts(two)[0] == "R[A]n[B]lder\n[C]\n"
    given = spark.createDataFrame([("a", file, [(0, 11, "[NAME]")]), ("b", file, None), ("c", b"junk", None)], "paper_id string, content binary, hits array<struct<start: int, end: int, tag: string>>")
    made = {r.paper_id: r for r in docx.scrubbed(given).collect()}
    assert docx.parts(bytes(made["a"].content))[0] == "[NAME]\nB\nh" and docx.parts(bytes(made["b"].content))[0] == "Robin Alder\nB\nh" and made["c"].error and made["c"].content is None
    rows = docx.read(spark.createDataFrame([("a", file), ("b", b"junk")], "paper_id string, content binary")).orderBy("paper_id").collect()
    assert rows[0].text.startswith("Robin") and rows[1].error


def test_pdf_fragments_across_blocks(spark):
    rows = [("a" if i % 7 else "", float(i % 50) * 10, float(i // 50) * 12, 5.0, i % 90 == 89) for i in range(5 * pdf.BLOCK + 3)]
    text, y, end = "", None, None
    for s, x, at, width, eol in rows:
        if y is not None and abs(at - y) > 2:
            text += "\n"
        elif end is not None and x - end > 1.5 and s and text[-1:] not in (" ", "\n"):
            text += " "
        text += s + ("\n" if eol else "")
        y, end = (None, None) if eol else (at, x + width)
    df = spark.createDataFrame([("p", rows), ("q", []), ("r", None)], f"paper_id string, items {pdf.ITEMS}")
    got = {r[0]: r[1] for r in df.select("paper_id", pdf.page_text(F.col("items"))).collect()}
    assert got == {"p": text, "q": "", "r": None}


def test_pdf_fragments(spark):
    rows = [("A", 0.0, 0.0, 10.0, False), ("B", 11.6, 0.0, 5.0, False), ("C", 18.1, 2.0, 5.0, False), ("D", 0.0, 4.1, 5.0, True), ("E", 0.0, 4.1, 5.0, False)]
    df = spark.createDataFrame([("p", 1, rows)], f"paper_id string, page int, items {pdf.ITEMS}")
    assert pdf.document_text(df).first().text == "A BC\nD\nE"


def test_handoff_and_intake(spark):
    bad = ["#gdoc=!!", "x", "#gdoc=" + "e30="]
    df = spark.createDataFrame([(str(i), f) for i, f in enumerate(bad)], "paper_id string, fragment string")
    assert intake.from_handoff(df).count() == 0
    files = spark.createDataFrame([("a.PDF",), ("b.doc",), ("c.jpeg",)], "name string")
    assert [r[0] for r in files.select(intake.kind_of(F.col("name"))).collect()] == ["pdf", "text", "image"]
    assert intake.skipped(files).first().names == "b.doc"


def test_output_names(spark):
    df = papers(spark, ["x", "y"]).withColumn("name", F.when(F.col("paper_ord") == 0, "a.pdf").otherwise("a.txt"))
    assert [r.out_name for r in reports.output_names(df).orderBy("paper_ord").collect()] == ["a-scrubbed.txt", "a-scrubbed (2).txt"]


def test_toggle_and_overrides(spark):
    got = detect.detect(papers(spark, ["1234567 a@b.co 7654321"]))
    off = detect.toggle_category(got, "ID")
    assert reports.paper_summary(off).first().enabled_n == 1
    assert reports.paper_summary(detect.toggle_category(off, "ID")).first().enabled_n == 3
    chosen = spark.createDataFrame([("0", 1, False)], "paper_id string, id int, enabled boolean")
    assert reports.paper_summary(detect.with_overrides(got, chosen)).first().enabled_n == 2


def test_stream(spark, tmp_path):
    from inkveil.streaming.detect import write_findings

    papers(spark, ["a@b.co", "none"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAPER).parquet(str(tmp_path / "in"))
    write_findings(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("call 502-555-0187")
    (tmp_path / "b.docx").write_bytes(word_file(("hi",)))
    (tmp_path / "c.docx").write_bytes(b"junk")
    (tmp_path / "d.txt").write_text(" \n")
    (tmp_path / "e.txt").write_bytes(b"caf\xe9 ok")
    files = intake.read_files(spark, str(tmp_path)).where(intake.accepted(F.col("name")))
    got = {r.name: (r.status, r.text) for r in intake.load_text(files, {"docx": docx.read}).collect()}
    assert got["a.txt"][0] == got["b.docx"][0] == "done" and got["c.docx"][0] == got["d.txt"][0] == "error" and got["e.txt"] == ("done", "caf\ufffd ok")


def test_export(spark, tmp_path):
    from inkveil.sources import sinks

    word = word_file(("Mail a@b.co",))
    rows = papers(spark, ["call 502-555-0187, a@b.co", "Mail a@b.co", "none"]).withColumn("kind", F.when(F.col("paper_ord") == 1, "docx").otherwise("text"))
    found_ = detect.findings(rows)
    known = tags.assign_tags(found_)
    files = spark.createDataFrame([("1", word)], "paper_id string, content binary")
    manifest = sinks.write_batch(rows, found_, known, f"file://{tmp_path}/out", files).collect()
    assert {r.out_name for r in manifest} == {"n-scrubbed.txt", "n-scrubbed (2).txt", "n-scrubbed.docx"} == {p.name for p in (tmp_path / "out/files").rglob("n-*")}
    at = {r.out_name: tmp_path / "out" / r.folder / r.out_name for r in manifest}
    assert at["n-scrubbed.txt"].read_text() == "call [PHONE], [EMAIL]"
    assert docx.parts(at["n-scrubbed.docx"].read_bytes())[0] == "Mail [EMAIL]"
    old = spark.read.parquet(f"file://{tmp_path}/out/tag_maps").withColumn("original", F.upper("original"))
    assert {(r.tag, r.original) for r in tags.tag_map(found_, known, snapshots=old).collect()} == {("[PHONE]", "502-555-0187"), ("[EMAIL]", "A@B.CO")}
    sinks.write_findings(found_, f"file://{tmp_path}/findings")
    assert spark.read.json(f"file://{tmp_path}/findings").count() == 3


def test_readers(spark):
    ok = lambda text, error=None: lambda files: files.select("paper_id", F.lit(text).cast("string").alias("text"), F.lit(error).cast("string").alias("error"))
    files = spark.createDataFrame([("a.pdf", b""), ("b.heic", b"")], "paper_id string, content binary")
    one = lambda reader: [(r.ocr, r.error) for r in reader(files).orderBy("paper_id").collect()][0]
    assert one(intake.pdf_reader(ok("word " * 9))) == (False, None)
    assert one(intake.pdf_reader(ok("few"))) == (True, intake.NO_PRINT)
    assert one(intake.pdf_reader(ok("few"), ok("print " * 5))) == (True, None)
    assert one(intake.pdf_reader(ok(None, "PasswordException"))) == (False, pdf.ERRORS["password"])
    assert one(intake.pdf_reader(ok(None, "InvalidPDFException"))) == (False, pdf.ERRORS["invalid"])
    assert [r.error for r in intake.image_reader(ok(None, "cannot open"))(files).orderBy("paper_id").collect()] == [intake.NO_IMAGE, intake.HEIC]
    assert intake.ocr_languages("max") == "eng+spa"
    assert intake.from_text(spark.createDataFrame([("x", " \n"), ("y", "hi")], "paper_id string, text string")).count() == 1
    assert {r.type for r in detect.findings(intake.sample(spark)).collect()} == {"ORG", "EMAIL", "PHONE", "ID"}


def test_batch_texts(spark):
    rows = papers(spark, ["a@b.co", "none"]).withColumn("status", F.when(F.col("paper_ord") == 1, "error").otherwise("done")).withColumn("error", F.lit("damaged"))
    got = detect.detect(rows)
    lines = [(r.state, r.n, r.scanned, r.line) for r in reports.row_text(rows.withColumn("ocr", F.col("paper_ord") == 0), detect.exploded(got)).orderBy("paper_id").collect()]
    assert lines == [("masked", 1, True, "masked findings: 1"), ("failed", 0, False, "unreadable: damaged")]
    waiting = rows.withColumn("status", F.when(F.col("paper_ord") == 1, "waiting").otherwise("scanning"))
    assert [r.line for r in reports.row_text(waiting, detect.exploded(got)).orderBy("paper_id").collect()] == ["in progress", "queued"]
    status = reports.batch_status(got)
    assert tuple(reports.batch_text(status).first())[1:] == ("part", "papers: 1 ready, 1 unreadable")
    assert reports.batch_text(status.withColumn("error_n", F.lit(0))).first().title == "papers: all of 1 ready"
    assert reports.batch_text(status.withColumn("done_n", F.lit(0))).first().title == "papers: none ready, 1 unreadable"
