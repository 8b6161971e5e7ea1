"""Length-delimited binary records of token ids, with an offset index beside them.

Method: each document is one frame: payload length (8 bytes), masked checksum of the
length (4), payload, masked checksum of the payload (4), and a closing byte 0x0A, which
is part of the frame. Payload: doc_id (8), number of ids (4), bytes for each id (1: 2 where
all are below 65536, else 4; 128 more where doc_id is missing, which is written as 0), then the ids. All numbers little-endian. The mask rotates a crc32 by 15 bits and adds a constant, so that
a checksum stored inside checked data does not check itself.

Documents are dealt to files by ranges of doc_id, sorted within; the file's number in
its name follows the ranges. Spark's own text writer puts the frames down (as raw
bytes), so any store that Spark reaches will do, and the commit protocol discards
what lost tasks have left. The files are then read back once, with every checksum verified; that
makes the index (file, record, byte offset and length, doc_id, number of ids, crc32 of the ids), a Parquet
table of its own for shuffled reads, from which reports are made too.

A text of any length is one record, made in its row. Nulls: a null text has the end id alone; a null doc_id comes first and is read back as null. Repeated rows are written each. Ties on doc_id
follow the text. An empty table gives empty files. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from ._common import new_path, partitions, texts

#: Bytes of text for each file, about; a file is read whole by one task (a record that is longer makes its file longer).
FILE_BYTES = 32 << 20
_MASK_ADD = 0xA282EAD8  # fixed value of the record format


_NO_ID = 128  # in the byte of the width
_INDEX = "file string, record long, offset long, bytes long, doc_id long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record without its closing byte."""
    wide = np.frombuffer(ids, "<u4")
    width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
    head = (0, len(wide), width | _NO_ID) if doc_id is None else (doc_id, len(wide), width)
    payload = struct.pack("<qIB", *head) + (wide.astype("<u2").tobytes() if width == 2 else ids)
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, bytes, int]:
    """doc_id, ids and the next record's offset; raises ValueError where a checksum differs."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"length at byte {at} is damaged")
    (n,) = struct.unpack("<Q", head)
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"record at byte {at} is damaged")
    doc, count, width = struct.unpack_from("<qIB", payload)
    doc, width = None if width & _NO_ID else doc, width & ~_NO_ID
    return doc, np.frombuffer(payload, f"<u{width}", count, 13).astype("<u4").tobytes(), at + 17 + n


def write_records(docs: DataFrame, where: str, path: str, spaces: str = "leading", end: int = 0) -> None:
    """Tokenize and write all documents below `where`: ids/ (binary files) and index/ (Parquet)."""
    spark = docs.sparkSession
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    files = max(partitions(spark), -(-size // FILE_BYTES))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = tokens.encode_rows(part.column("text").to_pylist(), path, spaces, end)
                out = [frame(d, i) for d, i in zip(part.column("doc_id").to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    dealt = rows.repartitionByRange(int(files), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{where}/ids")
    read_back(spark, where).write.parquet(f"{where}/index")


def read_back(spark: SparkSession, where: str) -> DataFrame:
    """Every record of the files: file, record, offset, bytes, doc_id, n_tokens, ids_crc32; checksums are verified."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
                data, at, rows, n = memoryview(content.as_buffer()), 0, [], 0
                while at < len(data):
                    doc, ids, after = unframe(data, at)
                    rows.append((n, at, after - at, doc, len(ids) // 4, tokens.crc(ids)))
                    at, n = after, n + 1
                if rows:
                    cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * n, pa.string()), *cols], ["file", "record", "offset", "bytes", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{where}/ids")
    named = files.select(F.regexp_extract("path", r"(part-\d+)", 1).alias("file"), "content")
    return named.mapInArrow(parse, _INDEX)


def read_at(data: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset from the index."""
    doc, ids, _ = unframe(data, offset)
    return doc, np.frombuffer(ids, "<u4")


def write_and_read(docs: DataFrame, path: str, spaces: str = "leading", end: int = 0) -> DataFrame:
    """Write all documents, read the files and give doc_id, start, n_tokens, ids_crc32 of each."""
    spark = docs.sparkSession
    where = new_path(spark, "records")
    write_records(docs, where, path, spaces, end)
    return with_starts(spark.read.schema(_INDEX).parquet(f"{where}/index"))


def with_starts(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from records (file, record, ...): files in the order of their numbers, records in theirs."""
    each = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))  # one row for each file
    number = F.regexp_extract("file", r"(\d+)", 1).cast("long")  # names have five digits, more from file 100,000 on
    before = each.withColumn("_before", F.sum("_n").over(Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("record")) - F.col("n_tokens")
    return (
        rows.withColumn("_within", within).join(before.select("file", "_before"), "file")
        .select("doc_id", (F.coalesce("_before", F.lit(0)) + F.col("_within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )
