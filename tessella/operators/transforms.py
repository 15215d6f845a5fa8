"""Composable transforms with inverses and modes, augmentor and decoder registries, dataset kinds."""

from __future__ import annotations

import importlib
import io
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V


class Transform:
    """A step over a table: ``apply``, and ``unapply`` where it has an inverse; ``mode`` is train or eval."""

    mode = "train"

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def unapply(self, df: DataFrame) -> DataFrame:
        raise TypeError(f"{type(self).__name__} has no inverse")

    def set_mode(self, mode: str) -> Transform:
        if mode not in ("train", "eval"):
            raise ValueError(f"unknown mode {mode}")
        self.mode = mode
        return self


@dataclass
class Normalize(Transform):
    """Normalize a vector column by a statistics struct column."""

    column: str
    stats: str
    kind: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, V.normalize(F.col(self.column), F.col(self.stats), self.kind))

    def unapply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, V.denormalize(F.col(self.column), F.col(self.stats), self.kind))


@dataclass
class Concat(Transform):
    """Vector columns with declared sizes into one, in order; the inverse splits it."""

    parts: dict[str, int]
    out: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, V.concat_checked([(F.col(c), n) for c, n in self.parts.items()]))

    def unapply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(self.parts, V.split(F.col(self.out), list(self.parts.values())), strict=True)))


@dataclass
class Perturb(Transform):
    """Seeded noise while training; nothing in eval mode."""

    column: str
    seed: str
    std: float

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, V.perturbed(F.col(self.column), F.col(self.seed), self.std)) if self.mode == "train" else df


@dataclass
class Composed(Transform):
    """Steps in order; undone in reverse order."""

    steps: list[Transform] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.apply(df)
        return df

    def unapply(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            df = s.unapply(df)
        return df

    def set_mode(self, mode: str) -> Composed:
        super().set_mode(mode)
        for s in self.steps:
            s.set_mode(mode)
        return self


class Registry(dict):
    """Named functions; a name is given once."""

    def add(self, name: str) -> Callable:
        def put(f):
            if name in self:
                raise KeyError(f"{name} is registered already")
            self[name] = f
            return f

        return put


augmentors, decoders = Registry(), Registry()


@decoders.add("txt")
def decoded_text(data: Column) -> Column:
    """Bytes as text."""
    return F.decode(data, "UTF-8")


@decoders.add("json")
def decoded_json(data: Column) -> Column:
    """Bytes as a parsed JSON value (variant); null where they aren't JSON."""
    return F.try_parse_json(F.decode(data, "UTF-8"))


@decoders.add("npy")
def decoded_array(data: Column) -> Column:
    """Bytes of an .npy file as flat doubles by rows; arrays of objects are an error."""

    @F.pandas_udf("array<double>")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.load(io.BytesIO(b), allow_pickle=False).astype(float).ravel())

    return run(data)


def decoded(samples: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns of bytes replaced by what the named decoders make of them; an unknown decoder is an error."""
    unknown = sorted({k for k in kinds.values() if k not in decoders})
    if unknown:
        raise KeyError(f"no decoder {', '.join(unknown)}; known: {', '.join(sorted(decoders))}")
    return samples.withColumns({c: decoders[k](F.col(f"`{c}`")) for c, k in kinds.items()})


def augmented(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Apply registered augmentors (table to table) in order."""
    for n in names:
        df = df.transform(augmentors[n])
    return df


def load_callable(name: str) -> Callable:
    """A function by its dotted name."""
    module, _, attr = name.rpartition(".")
    f = getattr(importlib.import_module(module), attr)
    if not callable(f):
        raise TypeError(f"{name} can't be called")
    return f


def is_kind(keys: dict[str, list[str]], signature: set[str]) -> bool:
    """Whether a dataset's state and action keys together have all keys of a kind's signature."""
    return signature <= {*keys.get("state", []), *keys.get("action", [])}


def check_keys(known: dict[str, list[str]], asked: list[str]) -> None:
    """Every asked ``modality.key`` must be known."""
    lacking = [k for k in asked if k.partition(".")[2] not in known.get(k.partition(".")[0], [])]
    if lacking:
        raise KeyError(f"unknown keys: {', '.join(lacking)}")


def replayed(df: DataFrame, times: int) -> DataFrame:
    """The same rows ``times`` times, with the pass they belong to; the input is kept in memory and on disk."""
    return df.persist().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def matched_captions(videos: DataFrame, captions: DataFrame, path: str = "path") -> DataFrame:
    """Videos with the caption file of the same stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]*$", 1)
    return videos.withColumn("stem", stem(F.col(path))).join(captions.select(stem(F.col(path)).alias("stem"), F.col("value").alias("caption")), "stem")


def check_list(spec: dict) -> list[dict]:
    """Question checks of a parsed YAML document: must-pass ones first; answers default to empty, keywords to none."""
    out = []
    for key, must in (("must_pass_checks", True), ("vqa_checks", False)):
        for c in spec.get(key) or []:
            words = c.get("contains") or []
            out.append({"question": c["question"], "answer": str(c.get("answer") or ""), "contains": [words] if isinstance(words, str) else list(words), "must_pass": must})
    return out


def stalled(last: Column, now: Column, minutes: float) -> Column:
    """Whether the last report is older than so many minutes."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last) > minutes * 60e6, F.lit(True))
