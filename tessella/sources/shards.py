"""Tar shards and single files as Python data sources: members read by ranges, files written with a commit."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessella.sources import stores

#: Bytes of a shard that one task reads, of members in one batch, and of a written shard.
SPLIT_BYTES, BATCH_BYTES, SHARD_BYTES = 128 << 20, 16 << 20, 1 << 30
MEMBERS = "shard string, key string, suffix string, position long, data binary"
#: Name of the list that a finished write leaves beside its files.
MANIFEST = "_manifest.json"


@dataclass
class Range(InputPartition):
    """Members of a shard whose headers begin in [begin, end)."""

    shard: str
    size: int
    begin: int
    end: int


class TarReader(DataSourceReader):
    """Plans ranges from file sizes alone; a task walks the headers, seeking over data, and reads the members of its range."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.suffixes = [s for s in options.get("suffixes", "").split(",") if s]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.tries, self.wait, self.how = int(options.get("tries", stores.TRIES)), float(options.get("firstwait", stores.FIRST_WAIT)), options.get("opener")

    def partitions(self) -> list[Range]:
        out = []
        for shard, size in stores.listed(self.path, ".tar"):
            edges = [*range(0, size, self.split), size] if size else [0, 0]
            out += [Range(shard, size, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(5)]
        held = 0
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if part.size:
            file = stores.Steady(part.shard, part.size, self.tries, self.wait, stores.opener(self.how))
            with tarfile.open(fileobj=io.BufferedReader(file, 512 if part.begin else 1 << 16), mode="r:") as tar:
                position = -1
                while (member := tar.next()) is not None and member.offset < part.end:
                    tar.members = []  # tarfile keeps all headers otherwise
                    if not member.isfile():
                        continue
                    position += 1
                    key, _, suffix = member.name.partition(".")
                    if member.offset < part.begin or (self.suffixes and suffix not in self.suffixes):
                        continue
                    for c, v in zip(columns, (part.shard, key, suffix, position, tar.extractfile(member).read()), strict=True):
                        c.append(v)
                    held += member.size
                    if held >= BATCH_BYTES:
                        yield batch()
                        columns, held = [[] for _ in range(5)], 0
        if columns[0] or not part.size:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    """Paths that a task has written, relative to the target, with their sizes."""

    files: list[tuple[str, int]]


class _Committed(DataSourceWriter):
    """Files appear one by one, each whole; the list of all of them is written when every task is done.

    A task that fails leaves no half file.  A job that is given up deletes what its finished tasks wrote, and no list names the rest.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        stores.write_whole(f"{self.path}/{MANIFEST}", json.dumps({"data_list": [f for f, _ in files], "bytes": [n for _, n in files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f, _ in m.files if m else []:
                stores.delete(f"{self.path}/{f}")


class TarWriter(_Committed):
    """Rows (key, suffix, data) as members ``key.suffix`` of tar files of about ``shardBytes`` each."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.most = int(options.get("shardbytes", SHARD_BYTES))

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task, out, file, tar = TaskContext.get().partitionId(), [], None, None
        try:
            for row in rows:
                if tar is None:
                    name = f"part-{task:05d}-{len(out):05d}.tar"
                    file = stores.WholeFile(f"{self.path}/{name}")
                    tar = tarfile.open(fileobj=file, mode="w|", format=tarfile.GNU_FORMAT)
                member = tarfile.TarInfo(f"{row.key}.{row.suffix}")
                member.size = len(row.data)
                tar.addfile(member, io.BytesIO(row.data))
                tar.members = []
                if tar.offset >= self.most:
                    tar.close()
                    out.append((name, file.tell()))
                    file.done()
                    tar = file = None
            if tar is not None:
                tar.close()
                out.append((name, file.tell()))
                file.done()
                file = None
        except BaseException:
            if file is not None:
                file.drop()
            for f, _ in out:
                stores.delete(f"{self.path}/{f}")
            raise
        return Written(out)


class FileWriter(_Committed):
    """One file for each row (path, content); content is text or bytes.  Rows with a null path or content write nothing."""

    def write(self, rows: Iterator) -> Written:
        out = []
        try:
            for row in rows:
                if row.path is None or row.content is None:
                    continue
                if row.path.startswith("/") or ".." in row.path.split("/"):
                    raise ValueError(f"{row.path} isn't below the target")
                data = row.content.encode() if isinstance(row.content, str) else bytes(row.content)
                stores.write_whole(f"{self.path}/{row.path}", data)
                out.append((row.path, len(data)))
        except BaseException:
            for f, _ in out:
                stores.delete(f"{self.path}/{f}")
            raise
        return Written(out)


class TarShards(DataSource):
    """``spark.read.format("tar_shards")`` and its writer.

    Options: ``path`` (files and folders by commas), ``suffixes``, ``splitBytes``, ``tries``, ``firstWait``, ``opener``; for writing ``shardBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options)


class SampleFiles(DataSource):
    """``df.write.format("sample_files")``: one file a row (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "sample_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to the session."""
    for source in (TarShards, SampleFiles):
        spark.dataSource.register(source)


def read_shards(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """(shard, key, suffix, position, data): members of tar files, streamed by ranges of bytes, whatever a shard's size.

    A shard of many GB is read by many tasks; a task holds a batch of members.  Reads that fail go on where they stopped (see
    ``stores.Steady``).  A member over 2 GB doesn't fit a cell and is an error.
    """
    register(spark)
    return spark.read.format("tar_shards").options(path=path, **options).load()


def write_shards(samples: DataFrame, path: str, **options: str | int) -> None:
    """Write (key, suffix, data) as tar shards and a manifest of them."""
    register(samples.sparkSession)
    samples.select("key", "suffix", "data").write.format("tar_shards").mode("append").options(path=path, **options).save()


def write_files(rows: DataFrame, path: str) -> None:
    """Write every row (path, content) as a file below ``path`` and a manifest of them.

    Paths are taken to be unique: of rows with one path any one stays, but whole.
    """
    register(rows.sparkSession)
    rows.select("path", "content").write.format("sample_files").mode("append").options(path=path).save()


def manifest(path: str) -> list[str] | None:
    """The files that a finished write lists, or None if it hasn't finished."""
    store, inner = stores.filesystem(f"{path.rstrip('/')}/{MANIFEST}")
    if store.get_file_info(inner).type != stores.fs.FileType.File:
        return None
    with store.open_input_stream(inner) as f:
        return json.loads(f.read())["data_list"]
