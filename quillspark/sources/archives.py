"""Markdown results as a sink that replaces atomically, and archives of folders.

Every task of a write packs its files into one ZIP shard in ``data``. Only the commit makes them count: it adds a
numbered manifest in ``writes`` that names the write's shards, put in place by one rename. A write that is killed or
aborted leaves no manifest, so readers go on seeing what stood before; its shards are dropped on abort, or stay unread until
:func:`compact`. Of several writes of one path the newest counts, so writing a job again replaces its file and a rerun of the
same rows changes nothing that readers see.

Reading gives a row for each file with the number of its write; :func:`current` keeps the newest of each path, by an
aggregate in the JVM. A manifest holds one name a task, never one a file.

Defined results: a null path is refused; a null text is an empty file; a path repeated within one write keeps the
greatest text; without any write there are no rows.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .remote import names, opened

#: Files in an archive carry no clock, so equal rows give equal shards.
EPOCH = (1980, 1, 1, 0, 0, 0)


@dataclass
class Shard(WriterCommitMessage):
    name: str | None
    files: int


@dataclass
class WrittenShard(InputPartition):
    write: int
    name: str


def _manifests(path: str) -> list[tuple[int, dict]]:
    out = []
    for n in names(f"{path}/writes"):
        if n.endswith(".json"):
            system, at = opened(f"{path}/writes/{n}")
            with system.open_input_file(at) as f:
                out.append((int(n[:-5]), json.loads(f.read())))
    return out


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str):
        self._path, self._id = path.rstrip("/"), uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        held: dict[str, str] = {}
        name, count = f"{self._id}-{uuid.uuid4().hex}.zip", 0
        system, at = opened(f"{self._path}/data")
        system.create_dir(at, recursive=True)
        out = archive = None
        for r in rows:  # sorted by path inside the task, so repeats follow each other
            if r["path"] is None:
                raise ValueError("a result without a path")
            if archive is None:
                out = system.open_output_stream(f"{at}/{name}")
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
            if held and r["path"] not in held:
                count += _put(archive, held)
                held = {}
            held[r["path"]] = max(held.get(r["path"], ""), r["markdown"] or "")
        if archive is None:
            return Shard(None, 0)
        count += _put(archive, held)
        archive.close()
        out.close()
        return Shard(name, count)

    def commit(self, messages: list[Shard | None]) -> None:
        done = _manifests(self._path)
        number = done[-1][0] + 1 if done else 0
        body = {"shards": sorted(m.name for m in messages if m is not None and m.name), "files": sum(m.files for m in messages if m is not None)}
        system, at = opened(f"{self._path}/writes")
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/.{self._id}") as f:
            f.write(json.dumps(body).encode())
        system.move(f"{at}/.{self._id}", f"{at}/{number:08d}.json")

    def abort(self, messages: list[Shard | None]) -> None:
        _drop(self._path, [n for n in names(f"{self._path}/data") if n.startswith(self._id)])


def _put(archive: zipfile.ZipFile, files: dict[str, str]) -> int:
    for path, text in files.items():
        archive.writestr(zipfile.ZipInfo(path, EPOCH), text.encode(), zipfile.ZIP_DEFLATED)
    return len(files)


def _drop(path: str, shards: list[str]) -> None:
    for n in shards:
        system, at = opened(f"{path}/data/{n}")
        system.delete_file(at)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        return [WrittenShard(number, n) for number, body in _manifests(self._path) for n in body["shards"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, WrittenShard):  # what Spark passes where there are none
            return
        system, at = opened(f"{self._path}/data/{partition.name}")
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as archive:
            for info in archive.infolist():
                yield partition.write, info.filename, archive.read(info).decode()


class MarkdownArchive(DataSource):
    """``format("markdown_archive")``: writes rows (path, markdown), reads rows (write, path, markdown)."""

    @classmethod
    def name(cls) -> str:
        return "markdown_archive"

    def schema(self) -> str:
        return "write int, path string, markdown string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options["path"])


def write_results(rows: DataFrame, path: str, shards: int | None = None) -> None:
    """Write or replace files (path, markdown), all or none. Repeats of a path meet in one shard."""
    spark = rows.sparkSession
    spark.dataSource.register(MarkdownArchive)
    rows = rows.select("path", "markdown")
    dealt = rows.repartition(shards, "path") if shards else rows.repartition("path")
    dealt.sortWithinPartitions("path").write.format("markdown_archive").mode("append").save(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """path, markdown as they stand: the newest write of each path."""
    spark.dataSource.register(MarkdownArchive)
    rows = spark.read.format("markdown_archive").load(path)
    return rows.groupBy("path").agg(F.max(F.struct("write", "markdown"))["markdown"].alias("markdown"))


def compact(spark: SparkSession, path: str) -> None:
    """One write that holds what stands; the shards before it go. Not beside another writer or a running reader."""
    before = names(f"{path}/data")
    old = names(f"{path}/writes")
    write_results(current(spark, path), path)
    for n in old:
        system, at = opened(f"{path}/writes/{n}")
        system.delete_file(at)
    _drop(path, before)
