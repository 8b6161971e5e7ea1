"""Files to papers: intake, kinds, plain text, hand-off fragments, pasted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_handoff, is_blank, non_space_length
from ..operators.ranking import ranked
from .pdf import error_text

# Extensions that are read, and those of images.
_IMAGES = "png|jpe?g|webp|bmp|heic|heif"
_ACCEPTED = rf"(?i)\.(?:docx|pdf|txt|md|text|{_IMAGES})\z"

Reader = Callable[[DataFrame], DataFrame]  # rows paper_id, content -> paper_id, text, ocr, error


def accepted(name: Column, mime: Column | None = None) -> Column:
    ok = name.rlike(_ACCEPTED)
    return ok if mime is None else ok | F.coalesce(mime.startswith("image/"), F.lit(False))


def kind_of(name: Column, mime: Column | None = None) -> Column:
    image = name.rlike(rf"(?i)\.(?:{_IMAGES})\z")
    if mime is not None:
        image = image | F.coalesce(mime.startswith("image/"), F.lit(False))
    return F.when(name.rlike(r"(?i)\.docx\z"), "docx").when(name.rlike(r"(?i)\.pdf\z"), "pdf").when(image, "image").otherwise("text")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """paper_id (the path), name, kind, content of every file below the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    return files.select(F.col("path").alias("paper_id"), name.alias("name"), kind_of(name).alias("kind"), "content")


def skipped(files: DataFrame, most: int = 20) -> DataFrame:
    """skipped_n, names, only_doc: what intake leaves out; names are the first `most` (rejected has all); only_doc where nothing is accepted and an old .doc is there."""
    ok = accepted(F.col("name"))
    counts = files.agg(F.count_if(~ok).alias("skipped_n"), F.coalesce(F.bool_or(F.col("name").rlike(r"(?i)\.doc\z")), F.lit(False)).alias("old"), F.count_if(ok).alias("ok_n"))
    first = rejected(files).orderBy("name").limit(most).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))  # one row each
    both = counts.withColumn("one", F.lit(1)).join(first.withColumn("one", F.lit(1)), "one")
    return both.select("skipped_n", "names", (F.col("old") & (F.col("ok_n") == 0)).alias("only_doc"))


def rejected(files: DataFrame) -> DataFrame:
    """The files that intake leaves out, one row each."""
    return files.where(~accepted(F.col("name")))


def in_batch_order(files: DataFrame, batch_id: str) -> DataFrame:
    """Files with batch_id and paper_ord: 0, 1, ... by name in Unicode collation, the path breaking ties. The same numbers in every run: ranks by stored ranges."""
    return ranked(files.withColumn("batch_id", F.lit(batch_id)), ["batch_id"], [F.collate("name", "UNICODE"), F.col("paper_id")], "paper_ord")


def load_text(files: DataFrame, readers: dict[str, Reader]) -> DataFrame:
    """Papers with text, status and error. Each kind has its own branch, so no reader runs over another's files.

    A file without a reader, or whose reader fails, has status error; the batch goes on.
    """
    plain = files.where("kind = 'text'").select("paper_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(False).alias("ocr"), F.lit(None).cast("string").alias("error"))
    parts = [plain] + [reader(files.where(F.col("kind") == kind).select("paper_id", "content")) for kind, reader in readers.items()]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    out = files.join(got, "paper_id", "left")
    blank = is_blank(F.coalesce("text", F.lit("")))
    error = F.coalesce("error", F.when(F.col("text").isNull(), "this kind of file can't be read here"), F.when(blank, "file appears to be empty"))
    return out.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("error")).withColumn("text", F.coalesce("text", F.lit("")))


def enough_text(text: Column, least: int) -> Column:
    return non_space_length(text) >= least


NO_PRINT = "no readable print was found: a clear, straight scan of a typed paper works best"
HEIC = "HEIC photos can't be read here: share the photo as a JPEG"
NO_IMAGE = "this image couldn't be read: a .png or .jpg photo works best"


def ocr_languages(mode: str) -> str:
    """Languages of print that are read: with the multilingual tagger ("max") Spanish too."""
    return "eng+spa" if mode == "max" else "eng"


def with_fallback(pages: DataFrame, ocr: Reader | None = None, least: int = 30, least_ocr: int = 20) -> DataFrame:
    """PDF rows (paper_id, content, text, error): those with too little text go to OCR, if there is one; errors are told."""
    text = F.coalesce("text", F.lit(""))
    bad = pages.where("error is not null").select("paper_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("ocr"), error_text(F.col("error")).alias("error"))
    well = pages.where("error is null")
    good = well.where(enough_text(text, least)).select("paper_id", "text", F.lit(False).alias("ocr"), F.lit(None).cast("string").alias("error"))
    poor = well.where(~enough_text(text, least))
    if ocr is None:
        return bad.unionByName(good).unionByName(poor.select("paper_id", F.lit("").alias("text"), F.lit(True).alias("ocr"), F.lit(NO_PRINT).alias("error")))
    return bad.unionByName(good).unionByName(read_print(poor.select("paper_id", "content"), ocr, least_ocr))


def read_print(files: DataFrame, ocr: Reader, least: int = 20) -> DataFrame:
    """paper_id, text, ocr, error of what OCR reads; too little print is an error."""
    read = ocr(files)
    short = F.when(~enough_text(F.coalesce("text", F.lit("")), least), NO_PRINT)
    return read.select("paper_id", "text", F.lit(True).alias("ocr"), F.coalesce("error", short).alias("error"))


def pdf_reader(extract: Reader, ocr: Reader | None = None) -> Reader:
    """The reader of PDF files from an extractor of their text layer (paper_id, text, error) and an OCR reader for scans."""

    def read(files: DataFrame) -> DataFrame:
        return with_fallback(files.join(extract(files).select("paper_id", "text", "error"), "paper_id"), ocr)

    return read


def image_reader(ocr: Reader) -> Reader:
    """The reader of images. What the OCR reader can't open has an error by its kind; files need a name for that."""

    def read(files: DataFrame) -> DataFrame:
        heic = F.col("paper_id").rlike(r"(?i)\.hei[cf]\z")
        got = read_print(files, ocr)
        opened = F.col("error").isNull() | (F.col("error") == NO_PRINT)
        return got.withColumn("error", F.when(opened, F.col("error")).otherwise(F.when(heic, HEIC).otherwise(NO_IMAGE)))

    return read


def from_text(texts: DataFrame) -> DataFrame:
    """Pasted texts (paper_id, text) as papers of a batch of their own each; a blank one is no paper."""
    rows = texts.where(~is_blank(F.coalesce("text", F.lit(""))))
    return rows.select(
        F.concat(F.lit("pasted-"), F.col("paper_id")).alias("batch_id"), F.lit(0).cast("long").alias("paper_ord"), "paper_id", F.lit("").alias("name"),
        F.lit("text").alias("kind"), "text", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"),
    )


#: A made-up paper to try things on.
SAMPLE = (
    "Robin Alder\nMs. Quill, English 8\nHarbor Middle School\n\nMy name is Robin Alder, and I live at 77 Mill Pond Road. "
    "Write to robin.alder@example.com or call (555) 555-0187; my number is 30817264.\n"
)


def sample(spark: SparkSession) -> DataFrame:
    return from_text(spark.createDataFrame([("sample", SAMPLE)], "paper_id string, text string"))


def from_handoff(fragments: DataFrame) -> DataFrame:
    """paper_id, name, text of well-formed fragments; others are left out."""
    got = fragments.withColumn("g", decode_handoff(F.col("fragment"))).where("g is not null")
    return got.select("paper_id", F.coalesce("g.t", F.lit("document")).alias("name"), F.col("g.x").alias("text"))
