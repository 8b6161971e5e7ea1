"""Files as Spark data sources: a writer of single files that commits all or nothing, and a reader of Word files.

    spark.dataSource.register(FileSet)
    rows.write.format("inkveil_files").mode("overwrite").save(path)      # paper_ord, out_name, content, error

A task writes into a folder of its own below `_staging-<write>`; the folders of the tasks that Spark accepts are moved, one
move a task, to `files/<write>-<task>` at commit, and only then does `_current.json` name them. What a failed, repeated or speculative task has written is
in a folder that no commit names, and goes with the staging folder. Overwriting drops what the write before had named; appending adds. A write that fails
leaves the current files as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "paper_ord long, out_name string, folder string, bytes long, sha256 string, error string"
_FORBIDDEN = re.compile(r"[\x00-\x1f\x7f/\\:*?\"<>|]")
_RESERVED = re.compile(r"\.*\Z|(?:con|prn|aux|nul|com\d|lpt\d)(?:\.|\Z)", re.I)


def safe_name(name: str | None) -> str:
    """A name for a file in its folder: no separators or signs that file systems refuse, not hidden, not reserved, at most 200 bytes, the ending kept."""
    out = _FORBIDDEN.sub("_", name or "").strip().lstrip(".")
    if _RESERVED.match(out):
        out = f"paper-{out}" if out else "paper"
    if len(out.encode("utf-8", "replace")) > 200:
        stem, dot, ending = out.rpartition(".")
        ending = dot + ending if stem and len(ending) <= 10 else ""
        out = (stem if ending else out).encode("utf-8", "replace")[: 200 - len(ending.encode())].decode("utf-8", "ignore") + ending
    return out


@dataclass
class Written(WriterCommitMessage):
    folder: str
    rows: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.write_id = path, overwrite, uuid.uuid4().hex[:12]

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        return store, root.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        store, root = self._store()
        name = uuid.uuid4().hex[:12]
        folder = f"{root}/_staging-{self.write_id}/{name}"
        store.create_dir(folder, recursive=True)
        used: set[str] = set()
        manifest = []
        for row in rows:
            r = row.asDict()
            out, content, error = safe_name(r["out_name"]), r["content"], r.get("error")
            if content is None or error:
                manifest.append({"paper_ord": r["paper_ord"], "out_name": out, "bytes": None, "sha256": None, "error": error or "no content"})
                continue
            k, plain = 1, out
            while out.lower() in used:  # names that only differed in what is refused
                k += 1
                stem, dot, ending = plain.rpartition(".")
                out = f"{stem} ({k}){dot}{ending}" if dot else f"{plain} ({k})"
            used.add(out.lower())
            content = bytes(content)
            with store.open_output_stream(f"{folder}/{out}") as to:
                to.write(content)
            manifest.append({"paper_ord": r["paper_ord"], "out_name": out, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "error": None})
        with store.open_output_stream(f"{folder}/_manifest.jsonl") as to:
            for line in manifest:
                to.write((json.dumps(line) + "\n").encode())
        return Written(name, len(manifest))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        before = current(store, root)
        store.create_dir(f"{root}/files", recursive=True)
        folders = []
        for m in messages:
            if m is not None and m.rows:
                folders.append(f"files/{self.write_id}-{m.folder}")
                store.move(f"{root}/_staging-{self.write_id}/{m.folder}", f"{root}/{folders[-1]}")
        named = folders if self.overwrite else before + folders
        with store.open_output_stream(f"{root}/_current-{self.write_id}.json") as to:
            to.write(json.dumps({"folders": named}).encode())
        if store.get_file_info(f"{root}/_current.json").type != fs.FileType.NotFound and store.type_name != "local":
            store.delete_file(f"{root}/_current.json")
        store.move(f"{root}/_current-{self.write_id}.json", f"{root}/_current.json")
        for old in before if self.overwrite else []:
            store.delete_dir(f"{root}/{old}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_staging-{self.write_id}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_staging-{self.write_id}")


def current(store: fs.FileSystem, root: str) -> list[str]:
    """The folders that the last commit names."""
    if store.get_file_info(f"{root}/_current.json").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{root}/_current.json") as f:
        return json.loads(f.read())["folders"]


class FileSet(DataSource):
    """Write: rows paper_ord, out_name, content, error as files. Read: the manifest of what is committed."""

    @classmethod
    def name(cls) -> str:
        return "inkveil_files"

    def schema(self) -> str:
        return MANIFEST

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        missing = {"paper_ord", "out_name", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows to write have no {', '.join(sorted(missing))}")
        return FileWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(self.options["path"])


class ManifestReader(DataSourceReader):
    """A partition for each committed folder."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        return [InputPartition(f) for f in current(store, root.rstrip("/"))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{root.rstrip('/')}/{partition.value}/_manifest.jsonl") as f:
            for line in f.read().decode().splitlines():
                r = json.loads(line)
                yield r["paper_ord"], r["out_name"], partition.value, r["bytes"], r["sha256"], r["error"]


class WordFiles(DataSource):
    """spark.read.format("inkveil_docx").load(folder): paper_id (the path), name, text, error of every .docx below the folder."""

    @classmethod
    def name(cls) -> str:
        return "inkveil_docx"

    def schema(self) -> str:
        return "paper_id string, name string, text string, error string"

    def reader(self, schema: StructType) -> WordReader:
        return WordReader(self.options["path"], int(self.options.get("bytesPerPartition", 32 << 20)))


class WordReader(DataSourceReader):
    """Files dealt to partitions by their bytes. A file that is damaged or gone has an error and fails no other."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = sorted((f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".docx"))
        groups: list[list[str]] = []
        size = self.most + 1
        for path, n in found:
            if size + n > self.most:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [InputPartition(g) for g in groups] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch | tuple]:
        from .docx import parts

        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.value:
            name = path.rpartition("/")[2]
            try:
                with store.open_input_stream(path) as f:
                    yield path, name, parts(f.read())[0], None
            except Exception as e:  # one file never fails the batch
                yield path, name, None, str(e) or type(e).__name__


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSet)
    spark.dataSource.register(WordFiles)


def write(files: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Rows paper_ord, out_name, content, error as files below path; returns the manifest as committed."""
    spark = files.sparkSession
    register(spark)
    files.write.format("inkveil_files").mode(mode).save(path)
    return spark.read.format("inkveil_files").load(path)
