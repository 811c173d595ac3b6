"""Shard files as a Spark data source: one JSON object a shard, `{"documents": [...], "manifest": {...}}`, in `<shard_id>.json`.

Reading gives a partition a file, and only the files of the shards that are asked for by name are opened. (The names are an option of
the reader and not a filter pushed down to it: Spark 4.1 keeps what it pushed to a Python source for later scans of the same frame,
and a scan without the filter then lacks rows.) Documents stand a
line each within the object, so files are read and written as streams, whatever their size; other layouts of the same object are
read whole. Writing puts each shard beside its place and names it when all tasks have succeeded; a failed job leaves nothing, and a
shard that reached two tasks is refused.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

NAME = "lanewright_shards"
COLUMNS = "shard_id string, dataset string, doc_id long, text string"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _shards(path: str) -> list[str]:
    files, at = _place(path)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(x.base_name.removesuffix(".json") for x in found if x.is_file and x.base_name.endswith(".json") and not x.base_name.startswith((".", "_")))


@dataclass
class Shard(InputPartition):
    shard_id: str


class ShardReader(DataSourceReader):
    def __init__(self, path: str, only: set[str] | None) -> None:
        self.path, self.only = path, only

    def partitions(self) -> list[Shard]:
        found = [Shard(x) for x in _shards(self.path) if self.only is None or x in self.only]
        return found or [Shard("")]

    def read(self, partition: Shard) -> Iterator[tuple]:
        if not partition.shard_id:
            return
        files, at = _place(self.path)
        with files.open_input_stream(f"{at}/{partition.shard_id}.json") as raw:
            for d in _documents(raw):
                yield partition.shard_id, d.get("dataset"), d.get("doc_id"), d.get("text")


def _lines(raw) -> Iterator[bytes]:  # noqa: ANN001
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    yield rest


def _documents(raw) -> Iterator[dict]:  # noqa: ANN001
    lines = _lines(raw)
    first = next(lines)
    if first != b'{"documents": [':
        yield from json.loads(b"\n".join([first, *lines]))["documents"]
        return
    for line in lines:
        if line.startswith(b"]"):
            return
        yield json.loads(line.rstrip(b","))


@dataclass
class Written(WriterCommitMessage):
    shards: list[tuple[str, str]]


class ShardWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        files, at = _place(self.path)
        files.create_dir(f"{at}/_parts", recursive=True)
        done: list[tuple[str, str]] = []
        out = shard = None
        for row in iterator:
            if row["shard_id"] != shard:
                self._close(out, shard)
                shard = row["shard_id"]
                if shard is None or "/" in shard or shard.startswith((".", "_")):
                    raise ValueError(f"{shard} cannot name a shard")
                if shard in dict(done):
                    raise ValueError(f"the rows of {shard} do not follow each other; write with write_shard_files")
                done.append((shard, part := f"{at}/_parts/{uuid.uuid4().hex}"))
                out, self.n, self.hash, self.dataset = files.open_output_stream(part), 0, hashlib.sha256(), row["dataset"]
                out.write(b'{"documents": [')
            text = json.dumps({"doc_id": row["doc_id"], "dataset": row["dataset"], "text": row["text"]}, ensure_ascii=False)
            out.write(((",\n" if self.n else "\n") + text).encode("utf-8", "surrogatepass"))
            self.n += 1
            self.hash.update(hashlib.sha256((row["text"] or "").encode("utf-8", "surrogatepass")).digest())
        self._close(out, shard)
        return Written(done)

    def _close(self, out, shard: str | None) -> None:  # noqa: ANN001
        if out is not None:
            manifest = {"shard_id": shard, "dataset": self.dataset, "document_count": self.n, "content_hash": self.hash.hexdigest()}
            out.write(f'\n], "manifest": {json.dumps(manifest)}}}\n'.encode())
            out.close()

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _place(self.path)
        found = [x for m in messages if m for x in m.shards]
        if len(dict(found)) < len(found):
            self.abort(messages)
            raise ValueError("a shard reached two tasks; write with write_shard_files")
        old = set(_shards(self.path)) if self.overwrite else set()
        for shard, part in found:
            files.move(part, f"{at}/{shard}.json")
        for shard in old - set(dict(found)):
            files.delete_file(f"{at}/{shard}.json")
        if found:
            files.delete_dir(f"{at}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        files, at = _place(self.path)
        if files.get_file_info(f"{at}/_parts").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/_parts")


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> ShardReader:
        shards = self.options.get("shards")
        return ShardReader(self.options["path"], None if shards is None else set(json.loads(shards)))

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShardSource)


def write_shard_files(docs: DataFrame, path: str) -> None:
    """Documents (the columns of COLUMNS) as shard files in the place of those that are there: a task gets whole shards, in order of their ids."""
    register(docs.sparkSession)
    rows = docs.select("shard_id", "dataset", "doc_id", "text").repartition("shard_id").sortWithinPartitions("shard_id", "doc_id", "text")
    rows.write.format(NAME).mode("overwrite").save(path)


def read_shard_files(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """The documents of all shard files, or of the named ones: no other file is opened."""
    register(spark)
    reader = spark.read.format(NAME)
    return (reader if shards is None else reader.option("shards", json.dumps(shards))).load(path)
