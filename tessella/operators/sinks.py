"""What jobs leave behind: prompt files, result files, telemetry by iteration."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessella.sources import shards


def _public(value: Column, kind: StructType, dropped: set[str]) -> Column:
    """A struct without fields that begin with an underscore or are ``dropped``, at any depth of structs and arrays."""
    out = []
    for f in kind.fields:
        if f.name.startswith("_") or f.name in dropped:
            continue
        own = value.getField(f.name)
        if isinstance(f.dataType, StructType):
            own = F.when(own.isNotNull(), _public(own, f.dataType, dropped))
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            own = F.transform(own, partial(_public_or_null, f.dataType.elementType, dropped))
        out.append(own.alias(f.name))
    return F.struct(*out)


def _public_or_null(kind: StructType, dropped: set[str], x: Column) -> Column:
    return F.when(x.isNotNull(), _public(x, kind, dropped))


def result_json(rows: DataFrame, columns: list[str], dropped: set[str] = frozenset({"l1_per_frame", "ssim_per_frame"})) -> Column:
    """The columns as one JSON object, without arrays by frame (``dropped``) and without names that begin with an underscore."""
    kept = rows.select(*columns).schema
    return F.to_json(_public(F.struct(*columns), StructType(kept.fields), set(dropped)))


def write_prompts(rows: DataFrame, path: str, name: Column, text: Column) -> None:
    """A text file for each sample, named after it; rows without a name or text write none."""
    shards.write_files(rows.select(name.alias("path"), text.alias("content")), path)


def write_results(rows: DataFrame, path: str, name: Column, columns: list[str]) -> None:
    """A JSON file for each row, of the given columns (see ``result_json``)."""
    shards.write_files(rows.select(name.alias("path"), result_json(rows, columns).alias("content")), path)


def check_results(checks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., total_checks, passed, failed, results): a video's checks in order, each as it was asked and answered.

    ``checks`` has question, expected_answer, actual_answer, expected_keywords, found_keywords, must_pass and validation_passed.
    A video has as many rows as its configuration has questions.
    """
    fields = ["question", "expected_answer", "actual_answer", "expected_keywords", "validation_passed", "found_keywords", "must_pass"]
    kept = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("r"))))
    passed = F.count_if("validation_passed")
    return checks.groupBy(*by).agg(F.count("*").alias("total_checks"), passed.alias("passed"), (F.count("*") - passed).alias("failed"), F.transform(kept, lambda x: x["r"]).alias("results"))


def append_telemetry(rows: DataFrame, path: str, iteration: str = "iteration") -> None:
    """Add rows to a folder of CSV files with headers, one folder an iteration.

    An iteration that is written again replaces its own files alone, so a step that is retried leaves each iteration once; all
    others stay as they are.  Rows go to as many files as there are iterations and tasks that hold them.
    """
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(iteration)
    out.option("header", True).csv(path)


def read_telemetry(spark, path: str, schema: str) -> DataFrame:
    """All iterations written so far, with the iteration as a column; ``schema`` names the others."""
    return spark.read.option("header", True).schema(schema).csv(path)


def telemetry_summary(rows: DataFrame, metrics: list[str], iteration: str = "iteration") -> DataFrame:
    """(iteration, metric, avg, max, min) over the ranks of every iteration."""
    return rows.unpivot([iteration], metrics, "metric", "value").groupBy(iteration, "metric").agg(F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"))
