"""Readers and writers by format, trajectory datasets, tar shards, captions, cameras."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.captions import first_caption
from tessella.operators.transforms import check_list
from tessella.sources.stores import uri_parts  # noqa: F401

#: Formats whose content runs code when loaded.
REFUSED = {"pickle", "pkl", "pt", "pth", "ckpt", "jit"}
BINARY = {"png", "jpg", "jpeg", "mp4", "webm", "obj", "ply", "tar", "gz", "byte"}
_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def extension(path: str) -> str:
    return path.rstrip("/*").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "*" not in path and fs.exists(at) and fs.getFileStatus(at).isDirectory()


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read by extension: Parquet, JSON, JSON lines, CSV, text or raw bytes.  Pickles and model files are refused, other
    extensions are a TypeError."""
    kind = (kind or extension(path)).lower()
    if kind in REFUSED:
        raise TypeError(f"{kind} files run code when loaded; they aren't read")
    readers = {
        "parquet": spark.read.parquet,
        "json": spark.read.option("multiLine", kind == "json" and not is_folder(spark, path)).json,  # folders hold lines, as ``write_any`` writes them
        "jsonl": spark.read.json,
        "csv": spark.read.option("header", True).csv,
        "txt": spark.read.text,
        "npy": lambda p: read_arrays(spark, p),
        "npz": lambda p: read_arrays(spark, p),
        "yaml": spark.read.option("wholetext", True).text,
        "yml": spark.read.option("wholetext", True).text,
    }
    if kind in readers:
        return readers[kind](path)
    if kind in BINARY:
        return spark.read.format("binaryFile").load(path)
    raise TypeError(f"no reader for {kind or 'files without an extension'}")


def write_any(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Write by extension: Parquet, JSON lines, CSV or text (one string column)."""
    kind = (kind or extension(path)).lower()
    writers = {"parquet": df.write.parquet, "json": df.write.json, "jsonl": df.write.json, "csv": df.write.option("header", True).csv, "txt": df.write.text}
    if kind not in writers:
        raise TypeError(f"no writer for {kind or 'files without an extension'}")
    writers[kind](path)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Make a dataset known by name."""
    _registry[name] = reader


def dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in _registry:
        raise KeyError(f"unknown dataset {name}; known: {', '.join(sorted(_registry)) or 'none'}")
    return _registry[name](spark, path)


def trajectory_dataset(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of a trajectory dataset folder: episodes, tasks, info and steps with their file's episode index."""
    index = F.regexp_extract(F.col("_metadata.file_path"), r"episode_(\d+)\.parquet$", 1).cast("long")
    steps = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/data")
    return {
        "episodes": spark.read.schema("episode_index bigint, length bigint").json(f"{root}/meta/episodes.jsonl"),
        "tasks": spark.read.schema("task_index bigint, task string").json(f"{root}/meta/tasks.jsonl"),
        "info": spark.read.option("multiLine", True).json(f"{root}/meta/info.json"),
        "steps": steps.withColumn("episode_index", index),
    }


def trajectory_roots(spark: SparkSession, spec: str) -> list[str]:
    """Roots of a comma list: a folder that has ``meta`` is a dataset, else each of its children is one."""
    jvm, out = spark.sparkContext._jvm, []
    for root in filter(None, (r.strip() for r in spec.split(","))):
        at = jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/meta")):
            out.append(root)
        else:
            out += sorted(str(s.getPath().toString()) for s in fs.listStatus(at) if s.isDirectory())
    return out


def tar_shards(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """(shard, key, suffix, position, data): members of the tar files under ``path``, keyed by the name before its first
    dot.  With ``suffixes`` other members aren't emitted.  A task holds one shard at a time; files come through Spark,
    so any store that it reads will do."""

    def expand(batches):
        for pdf in batches:
            for shard, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for n, member in enumerate(m for m in tar if m.isfile()):
                        key, _, suffix = member.name.partition(".")
                        if not suffixes or suffix in suffixes:
                            rows.append((shard, key, suffix, n, tar.extractfile(member).read()))
                yield pd.DataFrame(rows, columns=["shard", "key", "suffix", "position", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(expand, "shard string, key string, suffix string, position long, data binary")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, values): the numeric arrays of .npy files, and each member of .npz files, as flat doubles by rows.

    Arrays of objects would run code when loaded and are an error.
    """

    def load(batches):
        for batch in batches:
            for at, raw in zip(batch.column("path"), batch.column("content"), strict=True):
                got = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                for name in got.files if hasattr(got, "files") else [""]:
                    a = got[name] if name else got
                    yield pa.RecordBatch.from_arrays([pa.array([at.as_py()]), pa.array([name]), pa.array([list(a.shape)], pa.list_(pa.int64())), pa.array([a.astype(float).ravel()])], names=["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(load, "path string, name string, shape array<bigint>, values array<double>")


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, question, answer, contains, must_pass): the question checks of YAML files, one file a configuration, in order.

    Must-pass checks come first (see ``check_list``).  Needs a YAML parser on the executors.
    """

    def load(batches):
        import yaml

        for pdf in batches:
            rows = [(at, k, c["question"], c["answer"], c["contains"], c["must_pass"]) for at, raw in zip(pdf["path"], pdf["content"], strict=True) for k, c in enumerate(check_list(yaml.safe_load(raw) or {}))]
            yield pd.DataFrame(rows, columns=["path", "at", "question", "answer", "contains", "must_pass"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(load, "path string, at int, question string, answer string, contains array<string>, must_pass boolean")


def caption_dataset(spark: SparkSession, root: str, kind: str = "auto", prompt: str | None = None) -> DataFrame:
    """(video, caption): the videos below ``root``/videos with their captions; a video without one has null.

    ``kind`` json reads captions/*.json and takes the caption of type ``prompt`` (see ``captions.first_caption``), text reads metas/*.txt;
    auto takes json if there is any such file, else text, else it is an error.
    """
    folders = {"json": ("captions", "*.json"), "text": ("metas", "*.txt")}
    there = lambda k: is_folder(spark, f"{root}/{folders[k][0]}") and not list_files(spark, f"{root}/{folders[k][0]}", folders[k][1]).isEmpty()
    if kind == "auto":
        kind = next((k for k in folders if there(k)), None)
        if not kind:
            raise ValueError(f"neither captions/*.json nor metas/*.txt in {root}")
    elif kind not in folders:
        raise ValueError(f"unknown caption format {kind}")
    elif not is_folder(spark, f"{root}/{folders[kind][0]}"):
        raise ValueError(f"no folder {folders[kind][0]} in {root}")
    folder, pattern = folders[kind]
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]*$", 1)
    body = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/{folder}").select(stem("path").alias("stem"), F.decode("content", "UTF-8").alias("body"))
    text = first_caption(F.col("body"), prompt or "") if kind == "json" else F.regexp_replace("body", r"^\s+|\s+$", "")
    videos = list_files(spark, f"{root}/videos", "*.mp4").select("path", stem("path").alias("stem"))
    return videos.join(body, "stem", "left").select(F.col("path").alias("video"), text.alias("caption"))


def samples(shards: DataFrame, suffixes: list[str]) -> DataFrame:
    """One row per complete sample: a column per suffix; repeated keys count once, incomplete samples are left out."""
    one = shards.where(F.col("suffix").isin(suffixes)).groupBy("key").pivot("suffix", suffixes).agg(F.min_by("data", F.struct("shard", "position")))
    return one.dropna(subset=[f"`{s}`" for s in suffixes])


def camera_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """4 x 4 matrices of text lines with 12 numbers: [0, 0, 0, 1] is appended."""
    v = F.transform(F.split(F.trim(value), r"\s+"), lambda x: x.cast("double"))
    return lines.select("*", F.concat(v, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))).alias("matrix"))


def rescaled_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Intrinsics scaled by 1280 / 768 across and 704 / 432 down."""
    return [fx * 1280 / 768, fy * 704 / 432, cx * 1280 / 768, cy * 704 / 432]
