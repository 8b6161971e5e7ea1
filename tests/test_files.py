"""Word files, file sets with commits, archives and scanned pages."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect, tags
from inkveil.sources import archive, docx, formats, intake, scans, sinks

from .test_detect import papers, word_file

NS = f'xmlns:w="{docx.NAMESPACE}"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in members.items():
            z.writestr(f"word/{name}.xml" if name != "other" else "other.bin", raw)
    return out.getvalue()


CASES = {
    "tab first, no line end before the first text": ("<w:p><w:r><w:tab/><w:t>a</w:t></w:r></w:p><w:p><w:t>b</w:t></w:p>", "\ta\nb"),
    "breaks and empty elements": ("<w:p><w:t>a</w:t><w:br/><w:t/><w:t></w:t><w:cr/><w:t>b</w:t></w:p>", "a\n\nb"),
    "a paragraph within a paragraph": ("<w:p><w:t>a</w:t><w:x><w:p><w:t>b</w:t></w:p></w:x><w:t>c</w:t></w:p>", "a\nb\nc"),
    "text outside paragraphs": ("<w:t>a</w:t><w:t>b</w:t><w:p><w:t>c</w:t></w:p>", "ab\nc"),
    "entities and sections": ("<w:p><w:t>a &amp; b &lt;<![CDATA[<c>]]>&#233;</w:t></w:p>", "a & b <<c>é"),
    "another namespace": ('<w:p><v:t xmlns:v="urn:v">no</v:t><w:t>a</w:t></w:p>', "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_text_of_a_part(name):
    body, text = CASES[name]
    assert docx.parts(packed(document=f"<w:d {NS}>{body}</w:d>"))[0] == text


def test_parts_and_damage():
    body = lambda t: f"<w:d {NS}><w:p><w:t>{t}</w:t></w:p></w:d>"
    whole, found = docx.parts(packed(header1=body("h"), document=body(""), document2=body("two"), footer1="<broken", endnotes=body("e")))
    assert whole == "two\ne\nh" and [p.path for p in found] == ["word/document.xml", "word/document2.xml", "word/endnotes.xml", "word/header1.xml"]
    with pytest.raises(ValueError):
        docx.parts(packed(header1=body("h")))
    wide = f'<?xml version="1.0" encoding="utf-16"?><w:d {NS}><w:p><w:t>Zoë</w:t></w:p></w:d>'.encode("utf-16")
    assert docx.parts(docx.rewrite(packed(document=wide), [{"start": 0, "end": 3, "tag": "[NAME]"}]))[0] == "[NAME]"


def test_rewriting_leaves_all_else():
    xml = f"""<?xml version="1.0"?><w:d {NS} xmlns:q='urn:q'><!-- c --><w:p q:k='a>b'><w:r><w:t xml:space="default" q:z="1>2">Ann &amp; Bo</w:t></w:r></w:p><q:keep  a = "1"/></w:d>"""
    file = packed(document=xml, other="\0raw")
    new = docx.rewrite(file, [{"start": 0, "end": 3, "tag": "[A&B]"}])
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("other.bin") == b"\0raw"
        assert z.read("word/document.xml").decode() == xml.replace('<w:t xml:space="default" q:z="1>2">Ann &amp; Bo', '<w:t q:z="1>2" xml:space="preserve">[A&amp;B] &amp; Bo')
    with zipfile.ZipFile(io.BytesIO(docx.rewrite(file, []))) as z:
        assert z.read("word/document.xml").decode() == xml
    assert docx.parts(new)[0] == "[A&B] & Bo"


@pytest.mark.parametrize(
    ("name", "safe"),
    [("../../escaped.txt", "_.._escaped.txt"), ("a/b\\c.txt", "a_b_c.txt"), (None, "paper"), ("", "paper"), ("...", "paper"), ("con.txt", "paper-con.txt"), (".hidden", "hidden"), ("x" * 300 + ".txt", "x" * 196 + ".txt"), ("é\n.txt", "é_.txt")],
)
def test_safe_names(name, safe):
    assert formats.safe_name(name) == safe


def rows_to_write(spark, rows):
    return spark.createDataFrame(rows, "paper_ord long, out_name string, content binary, error string")


def files_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_file_set_commits(spark, tmp_path):
    where = f"file://{tmp_path}/out"
    got = formats.write(rows_to_write(spark, [(1, "a.txt", b"one", None), (2, "../../up.txt", b"two", None), (3, "c.docx", None, "damaged"), (4, "A.txt", b"four", None)]).coalesce(1), where).orderBy("paper_ord").collect()
    assert [(r.paper_ord, r.out_name, r.bytes, r.error) for r in got] == [(1, "a.txt", 3, None), (2, "_.._up.txt", 3, None), (3, "c.docx", None, "damaged"), (4, "A (2).txt", 4, None)]
    assert not (tmp_path / "up.txt").exists() and (tmp_path / "out" / got[0].folder / "a.txt").read_bytes() == b"one"
    again = formats.write(rows_to_write(spark, [(1, "b.txt", b"new", None)]), where).collect()
    assert [r.out_name for r in again] == ["b.txt"] and {f.rpartition("/")[2] for f in files_of(tmp_path / "out")} == {"b.txt"}  # nothing of the first write
    more = formats.write(rows_to_write(spark, [(2, "c.txt", b"more", None)]), where, "append").collect()
    assert {r.out_name for r in more} == {"b.txt", "c.txt"}
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]


def test_a_write_that_fails_leaves_what_was_there(spark, tmp_path):
    where = f"file://{tmp_path}/out"
    formats.write(rows_to_write(spark, [(1, "a.txt", b"one", None)]), where)
    bad = rows_to_write(spark, [(i, f"{i}.txt", b"x", None) for i in range(8)]).repartition(4).withColumn("out_name", F.when(F.col("paper_ord") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("out_name")))
    with pytest.raises(Exception, match="no"):
        formats.write(bad, where)
    assert [r.out_name for r in spark.read.format("inkveil_files").load(where).collect()] == ["a.txt"]
    assert {f.rpartition("/")[2] for f in files_of(tmp_path / "out")} == {"a.txt"} and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]


def test_repeated_and_speculative_tasks(tmp_path):
    """Two attempts of a task: only the one whose message is committed is there."""
    from pyspark.sql import Row

    writer = formats.FileWriter(f"file://{tmp_path}/out", True)
    row = Row(paper_ord=1, out_name="a.txt", content=b"one", error=None)
    first, second = writer.write(iter([row])), writer.write(iter([row]))
    assert first.folder != second.folder
    writer.commit([second, None])
    assert len(files_of(tmp_path / "out")) == 1 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]
    other = formats.FileWriter(f"file://{tmp_path}/out", True)
    other.abort([other.write(iter([row]))])
    assert len(files_of(tmp_path / "out")) == 1


def test_word_reader(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.docx").write_bytes(word_file(("Ann",)))
    (tmp_path / "in/deep/b.DOCX").write_bytes(b"junk")
    (tmp_path / "in/c.txt").write_text("no")
    formats.register(spark)
    for size in (1, 1 << 20):
        got = {r["name"]: r for r in spark.read.format("inkveil_docx").option("bytesPerPartition", size).load(f"file://{tmp_path}/in").collect()}
        assert set(got) == {"a.docx", "b.DOCX"} and got["a.docx"].text == "Ann" and got["b.DOCX"].error and got["b.DOCX"].text is None


def test_batch_with_a_damaged_word_file(spark, tmp_path):
    rows = papers(spark, ["Mail a@b.co", "x", "y"]).withColumn("kind", F.lit("docx"))
    done = detect.kept(rows)
    found = detect.findings(done)
    files = spark.createDataFrame([("0", word_file(("Mail a@b.co",))), ("1", b"junk")], "paper_id string, content binary")
    got = {r.paper_ord: r for r in sinks.write_batch(done, found, tags.assign_tags(found), f"file://{tmp_path}/out", files).collect()}
    assert got[0].error is None and got[1].error and "no Word file" in got[2].error and len(got) == 3


@pytest.mark.parametrize("n", [0, 1, 40])
def test_archive(spark, tmp_path, n):
    rows = [(i, f"d/{i % 7}.txt" if i % 3 else f"é{i}.txt", (b"text %d " % i) * (i * 50)) for i in range(n)]
    files = spark.createDataFrame(rows, "paper_ord long, out_name string, content binary").repartition(5)
    got = archive.write_zip(files, f"file://{tmp_path}/all.zip").orderBy("paper_ord").collect()
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert z.testzip() is None and z.namelist() == [r["name"] for r in got] and len(set(z.namelist())) == n
        assert [z.read(x) for x in z.namelist()] == [c for _, _, c in rows]
    assert {p.name for p in tmp_path.iterdir()} == {"all.zip"}
    with pytest.raises(ValueError):
        archive.write_zip(files, "s3://bucket/all.zip")


def test_archive_records_beyond_four_gigabytes():
    """The directory and end of an archive of more than 4 GB, read by zipfile behind a hole."""
    import os
    import tempfile
    import zlib

    raw = b"late"
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = pack.compress(raw) + pack.flush()
    offset = 5 << 30
    with tempfile.TemporaryFile() as f:  # sparse
        f.seek(offset)
        f.write(archive.local_header(b"a.txt", zlib.crc32(raw), len(data), len(raw)) + data)
        begin = f.tell()
        entry = archive.directory_entry(b"a.txt", zlib.crc32(raw), len(data), len(raw), offset)
        f.write(entry + archive.end_record(1, len(entry), begin))
        f.seek(0, os.SEEK_SET)
        with zipfile.ZipFile(f) as z:
            assert z.read("a.txt") == raw


def test_sizes(spark):
    df = spark.createDataFrame([(4800, 2400), (100, 50), (9600, 1), (0, 0), (2401, 2400), (1, 9000)], "w int, h int")
    w, h = scans.fitted(F.col("w"), F.col("h"))
    assert [tuple(r) for r in df.select(w, h).collect()] == [(2400, 1200), (100, 50), (2400, 1), (1, 1), (2400, 2399), (1, 2400)]


def test_scanned_pages(spark, tmp_path):
    """Pages in order, one that fails twice and is read at the third try, one that always fails, a file that can't be opened, one without pages."""
    tried = str(tmp_path)

    def render(content):
        if content == b"bad":
            raise ValueError("cannot open")
        for p in content.decode().split("|") if content else []:
            yield p.encode(), 4800, 100

    def engine_for(languages):
        assert languages == "eng+spa"

        def read(image, width, height):
            import os
            import uuid

            text = image.decode()
            assert (width, height) == (2400, 50)
            if text.startswith("flaky"):
                open(f"{tried}/{uuid.uuid4().hex}", "w").close()
                if len(os.listdir(tried)) < 3:
                    raise OSError("again")
            if text.startswith("never"):
                raise OSError("no print here")
            return text

        return read

    long = "|".join(f"page number {i}" for i in range(30))
    files = spark.createDataFrame([("a", long.encode()), ("b", b"first page of print|flaky second page"), ("c", b"fine page of some print|never"), ("d", b"bad"), ("e", b""), ("f", b"few")], "paper_id string, content binary")
    got = {r.paper_id: r for r in scans.scan_reader(render, engine_for, "max")(files).collect()}
    assert got["a"].text == long.replace("|", "\n\n") and got["a"].error is None and got["a"].ocr
    assert got["b"].text == "first page of print\n\nflaky second page"
    assert got["c"].error == "no print here" and got["d"].error == "cannot open" and got["e"].error == got["f"].error == intake.NO_PRINT
