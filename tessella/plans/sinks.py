"""Queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog import table
from tessella.operators import sinks as K
from tessella.operators.transforms import decoded
from tessella.plans.text import PAIRS, answers
from tessella.registry import query
from tessella.shared import new_path
from tessella.sources import readers, shards


def file_name(c):
    return F.substring_index(c, "/", -1)


def texts(spark, path: str, suffix: str):
    """(file, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(file_name("path").alias("file"), F.decode("content", "UTF-8").alias("content"))


@query("sc8_tar_shards", """SELECT printf('%09d', doc_id) AS key, 'txt' AS suffix, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(text, '')) AS digest FROM documents
UNION ALL SELECT printf('%09d', doc_id), 'meta.json', octet_length(encode(j)), md5(j) FROM (SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS j FROM documents)""")
def sc8(spark, sf):
    """Every document as two members of tar shards, written by tasks and read back by ranges of bytes."""
    docs = table(spark, sf, "documents").withColumn("key", F.format_string("%09d", "doc_id"))
    text = docs.select("key", F.lit("txt").alias("suffix"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    meta = docs.select("key", F.lit("meta.json").alias("suffix"), F.encode(F.to_json(F.struct("lang", "source")), "UTF-8").alias("data"))
    path = new_path(spark, "shards")
    shards.write_shards(text.unionByName(meta), path)
    return shards.read_shards(spark, path).select("key", "suffix", F.length("data").cast("long").alias("bytes"), F.md5("data").alias("digest"))


@query("ud3_decoded_samples", "SELECT printf('%09d', doc_id) AS key, length(text) AS letters, lang, source FROM documents WHERE text IS NOT NULL")
def ud3(spark, sf):
    """Documents as samples of two members, read from shards, put together by key, decoded by suffix."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("key", F.format_string("%09d", "doc_id"))
    parts = [docs.select("key", F.lit("txt").alias("suffix"), F.encode("text", "UTF-8").alias("data")), docs.select("key", F.lit("json").alias("suffix"), F.encode(F.to_json(F.struct("lang", "source")), "UTF-8").alias("data"))]
    path = new_path(spark, "samples")
    shards.write_shards(parts[0].unionByName(parts[1]), path)
    whole = decoded(readers.samples(shards.read_shards(spark, path), ["txt", "json"]), {"txt": "txt", "json": "json"})
    field = lambda n: F.try_variant_get("json", f"$.{n}", "string").alias(n)
    return whole.select("key", F.length("txt").cast("long").alias("letters"), field("lang"), field("source"))


@query("sk1_dump_formats", "SELECT k AS kind, s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier CROSS JOIN (VALUES ('csv'), ('json'), ('jsonl'), ('parquet'), ('txt')) t(k)")
def sk1(spark, sf):
    """Suppliers written and read again in every format that the dispatch knows."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), F.round("s_acctbal", 2).alias("s_acctbal"))
    at, out = new_path(spark, "dump"), None
    for kind in ("csv", "json", "jsonl", "parquet", "txt"):
        path = f"{at}/suppliers.{kind}"
        readers.write_any(rows.select(F.to_json(F.struct("*")).alias("value")) if kind == "txt" else rows, path)
        back = readers.read_any(spark, path)
        if kind == "txt":
            back = back.select(F.from_json("value", "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").alias("v")).select("v.*")
        back = back.select(F.lit(kind).alias("kind"), *(F.col(f.name).cast(f.dataType) for f in rows.schema))
        out = back if out is None else out.unionByName(back)
    return out


@query("sk2_prompt_file_sink", "SELECT s_name || '.txt' AS file, 'a robot at ' || n_name AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sk2(spark, sf):
    """A prompt file for every supplier, read back from its folder."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = new_path(spark, "prompts")
    K.write_prompts(rows, path, F.concat("s_name", F.lit(".txt")), F.concat(F.lit("a robot at "), "n_name"))
    return texts(spark, path, ".txt")


@query("sk5_results_files", """WITH f AS (SELECT l_suppkey AS episode, l_returnflag AS label, abs(l_quantity / 50 - l_discount) AS l1 FROM lineitem), e AS (SELECT label, episode, count(*) AS n, avg(l1) AS m FROM f GROUP BY 1, 2)
SELECT label || '/' || episode AS name, label, episode, n AS num_frames, round(m, 6) AS mean_l1, false AS leaks FROM e""")
def sk5(spark, sf):
    """A results file for every checkpoint and supplier (its lines are the frames): nested figures stay, arrays by frame and private names don't."""
    l1 = F.abs(F.col("l_quantity") / 50 - F.col("l_discount"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("episode")).agg(F.count("*").alias("num_frames"), F.round(F.avg(l1), 6).alias("mean"), F.collect_list(l1).alias("each"))
    rows = rows.select("label", "episode", F.struct("num_frames", F.col("mean").alias("mean_l1"), F.col("each").alias("l1_per_frame")).alias("frame_decay"), F.lit("x").alias("_frames"))
    path = new_path(spark, "results")
    K.write_results(rows, path, F.format_string("%s/%d.json", "label", "episode"), ["label", "episode", "frame_decay", "_frames"])
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select("path", F.decode("content", "UTF-8").alias("j"))
    v = back.select(F.substring_index(F.regexp_replace("path", r"\.json$", ""), "/", -2).alias("name"), "j", F.from_json("j", "label string, episode long, frame_decay struct<num_frames: long, mean_l1: double>").alias("v"))
    return v.select("name", "v.label", "v.episode", "v.frame_decay.num_frames", "v.frame_decay.mean_l1", F.col("j").rlike("per_frame|\"_").alias("leaks"))


@query("sk6_telemetry_csv", """WITH t AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS iteration, user_id % 8 AS rank, sum(CAST(round(value * 100) AS BIGINT)) AS util, max(value) AS power FROM events GROUP BY 1, 2)
SELECT iteration, m AS metric, round(avg(v), 5) AS avg, round(max(v), 5) AS max, round(min(v), 5) AS min FROM (SELECT iteration, 'util' AS m, util::DOUBLE AS v FROM t UNION ALL SELECT iteration, 'power', power FROM t) GROUP BY 1, 2""")
def sk6(spark, sf):
    """Telemetry of ranks by iteration (a day of events), appended in three writes of which one repeats iterations; summed up from the files."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").groupBy(F.floor(F.unix_seconds(ts) / 86400).alias("iteration"), (F.col("user_id") % 8).alias("rank")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("util"), F.max("value").alias("power"))
    path = new_path(spark, "telemetry")
    for part in ("iteration % 2 = 0", "iteration % 2 = 1", "iteration % 4 = 0"):
        K.append_telemetry(rows.where(part), path)
    back = K.telemetry_summary(K.read_telemetry(spark, path, "rank long, util double, power double, iteration long"), ["util", "power"])
    return back.select("iteration", "metric", *(F.round(c, 5).alias(c) for c in ("avg", "max", "min")))


OK = "CASE WHEN turn % 4 = 1 THEN contains(lower(answer), 'the') WHEN turn % 4 = 3 THEN contains(lower(answer), 'an') ELSE true END"


@query("sk8_check_result_files", f"WITH {PAIRS}, r AS (SELECT conv_id, turn, {OK} AS ok FROM q JOIN (SELECT conv_id AS c, turn AS t FROM conversations WHERE role = 'user') u ON c = conv_id AND t = turn WHERE next_role = 'assistant') SELECT conv_id || '.json' AS file, count(*) AS total_checks, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, string_agg(CAST(ok AS VARCHAR), ',' ORDER BY turn) AS results FROM r GROUP BY conv_id")
def sk8(spark, sf):
    """A file of check results for every conversation: its turns are the questions, in order."""
    t = F.col("turn") % 4
    expected = F.when(t == 1, "the").when(t == 3, "an").otherwise("")
    ok = F.contains(F.lower("answer"), expected)
    checks = answers(spark, sf).select("conv_id", "turn", "question", expected.alias("expected_answer"), F.col("answer").alias("actual_answer"), F.lit(None).cast("array<string>").alias("expected_keywords"), F.lit(None).cast("array<string>").alias("found_keywords"), (t == 1).alias("must_pass"), ok.alias("validation_passed"))
    path = new_path(spark, "checks")
    K.write_results(K.check_results(checks, ["conv_id"], ["turn"]), path, F.format_string("%d.json", "conv_id"), ["total_checks", "passed", "failed", "results"])
    v = texts(spark, path, ".json").select("file", F.from_json("content", "total_checks long, passed long, failed long, results array<struct<validation_passed: boolean>>").alias("v"))
    return v.select("file", "v.total_checks", "v.passed", "v.failed", F.array_join(F.transform("v.results", lambda r: r["validation_passed"].cast("string")), ",").alias("results"))
