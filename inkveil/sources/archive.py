"""One zip archive written by many tasks.

Members are deflated where they are and written to the shared folder; running sums of their lengths give each one's place in the archive, and
that of its entry in the central directory. Then tasks write members and entries at their places in one file, which all tasks open: the same
bytes at the same place, however often a task runs. The driver adds the end record, some hundred bytes. Offsets of 4 GB and
more are in zip64 fields. The file gets its name when it is whole.

The archive's folder has to be one that all executors see as a file system (file://); object stores take no writes at a place.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked, running_total
from ..storage import stored
from .formats import safe_name

# Fixed values of the format: flags for names in UTF-8, method of deflate, the earliest date, sizes from which zip64 fields are used.
_UTF8, _DEFLATE, _DATE, _LARGE, _MANY = 0x800, 8, 33, 0xFFFFFFFF, 0xFFFF


def local_header(name: bytes, crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, _UTF8, _DEFLATE, 0, _DATE, crc, packed, size, len(name), 0) + name


def directory_entry(name: bytes, crc: int, packed: int, size: int, offset: int) -> bytes:
    more = struct.pack("<HHQ", 1, 8, offset) if offset >= _LARGE else b""
    head = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45 if more else 20, _UTF8, _DEFLATE, 0, _DATE, crc, packed, size, len(name), len(more), 0, 0, 0, 0, min(offset, _LARGE))
    return head + name + more


def end_record(count: int, length: int, offset: int) -> bytes:
    """What closes the archive; with zip64 records where counts or places need them."""
    large = b""
    if count >= _MANY or length >= _LARGE or offset >= _LARGE:
        large = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, offset) + struct.pack("<4sIQI", b"PK\x06\x07", 0, offset + length, 1)
    few = min(count, _MANY)
    return large + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, few, few, min(length, _LARGE), min(offset, _LARGE), 0)


def _deflated(files: DataFrame) -> DataFrame:
    """paper_ord, plain (a safe name), crc, size, data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one at a time: contents may be long
                order, name, content = (batch.column(c)[i] for c in ("paper_ord", "out_name", "content"))
                raw = content.as_py()
                pack = zlib.compressobj(6, zlib.DEFLATED, -15)
                data = pack.compress(raw) + pack.flush()
                cols = [[order.as_py()], [safe_name(name.as_py())], [zlib.crc32(raw)], [len(raw)], [data]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["paper_ord", "plain", "crc", "size", "data"])

    rows = files.select(F.col("paper_ord").cast("long").alias("paper_ord"), "out_name", F.col("content").cast("binary").alias("content"))
    return rows.where("content is not null").mapInArrow(work, "paper_ord long, plain string, crc long, size long, data binary")


def _named(packed: DataFrame) -> DataFrame:
    """With `name`: the second of a safe name gets (2) before its ending, and so on."""
    rows = packed.select("paper_ord", "plain", F.lower("plain").alias("low"))
    k = ranked(rows, ["low"], [F.col("paper_ord")], "k").select("paper_ord", "k")
    ending = F.regexp_extract("plain", r"(?:\.[^.]{0,10})?\z", 0)
    numbered = F.concat(F.regexp_replace("plain", r"(?:\.[^.]{0,10})?\z", ""), F.lit(" ("), (F.col("k") + 1).cast("string"), F.lit(")"), ending)
    return packed.join(k, "paper_ord").withColumn("name", F.when(F.col("k") == 0, F.col("plain")).otherwise(numbered)).drop("plain", "k")


def write_zip(files: DataFrame, path: str) -> DataFrame:
    """Rows paper_ord (unique), out_name, content as members, in order, of the archive at path; rows without content are left out.

    Returns paper_ord, name, size, packed, offset of each member. Without rows it is an empty archive.
    """
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError("an archive is written to a shared file system (file://), where tasks can write at a place")
    target = unquote(where.path)
    rows = stored(_named(stored(_deflated(files), "deflated")), "named")
    length = F.octet_length("name").cast("long")
    sizes = rows.select("paper_ord", "name", "crc", "size", F.octet_length("data").cast("long").alias("packed"), (30 + length + F.octet_length("data")).alias("whole"))
    placed = running_total(sizes, [F.col("paper_ord")], "whole", "offset")
    placed = placed.withColumn("entry", 46 + length + F.when(F.col("offset") >= _LARGE, 12).otherwise(0))
    placed = stored(running_total(placed, [F.col("paper_ord")], "entry", "at"), "members")
    count, begin, directory = (x or 0 for x in placed.agg(F.count("*"), F.sum("whole"), F.sum("entry")).first())

    part = f"{target}.{uuid.uuid4().hex[:12]}.part"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(part, "wb") as out:
        out.truncate(begin + directory)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(part, "r+b") as out:
            for batch in batches:
                for i in range(len(batch)):
                    name, crc, packed, size, offset, at, data = (batch.column(c)[i].as_py() for c in ("name", "crc", "packed", "size", "offset", "at", "data"))
                    out.seek(offset)
                    out.write(local_header(name.encode(), crc, packed, size))
                    out.write(data)
                    out.seek(begin + at)
                    out.write(directory_entry(name.encode(), crc, packed, size, offset))
                yield pa.RecordBatch.from_arrays([batch.column("paper_ord")], ["paper_ord"])

    both = placed.join(rows.select("paper_ord", "data"), "paper_ord")
    written = both.select("paper_ord", "name", "crc", "packed", "size", "offset", "at", "data").mapInArrow(work, "paper_ord long").count()
    if written != count:
        os.remove(part)
        raise RuntimeError(f"{written} of {count} members were written: is paper_ord unique?")
    with open(part, "r+b") as out:
        out.seek(begin + directory)
        out.write(end_record(count, directory, begin))
    os.replace(part, target)
    return placed.select("paper_ord", "name", "size", "packed", "offset")
