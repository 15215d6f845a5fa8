"""Queries over captions, prompts and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.catalog import table
from tessella.functions import strings as T
from tessella.operators import captions as C
from tessella.registry import query

#: Sample phrases to exclude; the operator takes any list from its caller.
EXCLUDE = ["trash", "idiot", "lens swings", "slow glide past", "viewpoint drifts"]
WORDS = ["idiot", "moron", "scum", "loser", "disgusting", "license"]


def docs(spark, sf):
    return table(spark, sf, "documents")


def sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


DROPPED = f"coalesce(trim(text) <> '' AND len(list_filter({sql_list(EXCLUDE)}, lambda w: contains(lower(text), w))) > 0, false)"


@query("pf10_tx18_caption_filter", f"SELECT doc_id FROM documents WHERE NOT ({DROPPED}) OR source = 'src1'")
def pf10(spark, sf):
    """Captions without excluded phrases; one source bypasses the filter."""
    return docs(spark, sf).where(~T.caption_excluded(F.col("text"), [], EXCLUDE) | (F.col("source") == "src1")).select("doc_id")


@query("pf11_filter_stats", f"SELECT count(*) AS total, count(*) FILTER ({DROPPED}) AS filtered, count(*) FILTER (NOT {DROPPED}) AS passed, round(100.0 * count(*) FILTER ({DROPPED}) / count(*), 4) AS rate FROM documents WHERE source <> 'src1'")
def pf11(spark, sf):
    drop = T.caption_excluded(F.col("text"), [], EXCLUDE)
    rows = docs(spark, sf).where("source <> 'src1'").agg(F.count("*").alias("total"), F.count_if(drop).alias("filtered"))
    return rows.select("total", "filtered", (F.col("total") - F.col("filtered")).alias("passed"), F.round(100 * F.col("filtered") / F.col("total"), 4).alias("rate"))


@query("pf10_include_filter", "SELECT doc_id FROM documents WHERE text IS NULL OR trim(text) = '' OR contains(lower(text), 'the') OR contains(lower(text), 'und')")
def pf10i(spark, sf):
    return docs(spark, sf).where(~T.caption_excluded(F.col("text"), ["the", "und"], [])).select("doc_id")


COLLAPSED = "lower(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g'), '\\s+', ' ', 'g')))"


@query("tx5_blocklist_exact", f"SELECT doc_id, NULLIF(regexp_extract({COLLAPSED}, '\\b(disgusting|license|idiot|moron|loser|scum)\\b', 1), '') AS word FROM documents")
def tx5(spark, sf):
    return docs(spark, sf).select("doc_id", T.blocked_word(T.ascii_fold(F.col("text")), WORDS).alias("word"))


@query("tx6_blocklist_fuzzy")
def tx6(spark, sf):
    """Captions that resemble a listed word, after the exact check let them pass."""
    exact = T.blocked_word(T.ascii_fold(F.col("text")), WORDS)
    rows = docs(spark, sf).select("doc_id", "text", exact.alias("exact"))
    fuzzy = T.fuzzy_blocked(["disgusting", "pathetic", "license"]).asNondeterministic()  # else the filter's own evaluation takes a second Python worker a task
    return rows.where("exact IS NULL").select("doc_id", fuzzy("text").alias("word")).where("word IS NOT NULL")


@query("tx7_censor", "SELECT doc_id, md5(regexp_replace(text, '\\b(idiot|moron|scum|disgusting|license)\\b', '****', 'gi')) AS digest FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*', 's')")
def tx7(spark, sf):
    ascii_only = docs(spark, sf).where(F.octet_length("text") == F.char_length("text"))
    return ascii_only.select("doc_id", F.md5(T.censored(F.col("text"), WORDS, ["loser"])).alias("digest"))


@query("tx8_ascii_fold", "SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g')) AS digest FROM documents")
def tx8(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.ascii_fold(F.col("text"))).alias("digest"))


@query("tx9_keyword_list", "SELECT DISTINCT trim(text) AS word FROM benchmark WHERE trim(text) <> ''")
def tx9(spark, sf):
    return table(spark, sf, "benchmark").select(F.trim("text").alias("word")).where("word <> ''").distinct()


@query("tx10_guard_chain", f"SELECT doc_id, coalesce(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' END, CASE WHEN {DROPPED} THEN 'phrase' END, CASE WHEN n_chars > 20000 THEN 'long' END, 'safe') AS verdict FROM documents")
def tx10(spark, sf):
    empty = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty")
    phrase = F.when(T.caption_excluded(F.col("text"), [], EXCLUDE), "phrase")
    long = F.when(F.col("n_chars") > 20000, "long")
    return docs(spark, sf).select("doc_id", F.coalesce(T.first_reason(empty, phrase, long), F.lit("safe")).alias("verdict"))


@query("tx11_moderation_parse", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 'S' || turn ELSE 'unknown' END AS category FROM conversations")
def tx11(spark, sf):
    reply = F.when(F.col("turn") % 3 == 0, "safe").when(F.col("turn") % 3 == 1, F.concat(F.lit("unsafe\nS"), F.col("turn").cast("string"))).otherwise("unsafe")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.moderation(reply).alias("category"))


PAIRS = "q AS (SELECT conv_id, turn, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) "


def answers(spark, sf):
    """Each user turn with the assistant turn that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' AND next_role = 'assistant'")


CHECK = "(CASE WHEN turn % 4 = 1 THEN contains(lower(answer), 'the') WHEN turn % 4 = 3 THEN contains(lower(answer), 'an') AND (contains(lower(answer), 'und') OR contains(lower(answer), 'of')) ELSE turn % 4 = 0 END)"
USER = "SELECT *, " + CHECK + " AS ok FROM q JOIN (SELECT conv_id AS c, turn AS t FROM conversations WHERE role = 'user') u ON c = conv_id AND t = turn WHERE next_role = 'assistant'"


def checked(spark, sf):
    t = F.col("turn") % 4
    expected = F.when(t == 1, "the").when(t == 3, "An").otherwise("")
    keywords = F.when(t == 3, F.array(F.lit("Und"), F.lit("of"))).when(t == 2, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return answers(spark, sf).select("conv_id", "turn", T.answer_valid(F.col("answer"), expected, keywords).alias("ok"))


@query("tx12_answer_checks", f"WITH {PAIRS} SELECT conv_id, turn, ok FROM ({USER})")
def tx12(spark, sf):
    return checked(spark, sf)


@query("ag12_check_metrics", f"""WITH {PAIRS}, r AS ({USER}) SELECT count(*) AS total, count(*) FILTER (ok) AS passed, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS rate, count(*) FILTER (turn = 1) AS must, count(*) FILTER (turn = 1 AND ok) AS must_passed,
100.0 * count(*) FILTER (ok) / count(*) >= 40 AND count(*) FILTER (turn = 1 AND NOT ok) = 0 AS gate FROM r""")
def ag12(spark, sf):
    """Success rate and must-pass counts with the threshold gate."""
    must = F.col("turn") == 1
    rows = checked(spark, sf).agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(must).alias("must"), F.count_if(must & F.col("ok")).alias("must_passed"))
    rate = 100 * F.col("passed") / F.col("total")
    return rows.select("total", "passed", F.round(rate, 4).alias("rate"), "must", "must_passed", ((rate >= 40) & (F.col("must") == F.col("must_passed"))).alias("gate"))


@query("sk8_check_results_json", f"WITH {PAIRS}, r AS ({USER}) SELECT conv_id, '[' || string_agg('{{\"turn\":' || turn || ',\"ok\":' || ok || '}}', ',' ORDER BY turn) || ']' AS results FROM r GROUP BY 1")
def sk8(spark, sf):
    rows = checked(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ok"))).alias("r"))
    return rows.select("conv_id", F.to_json("r").alias("results"))


@query("j12_check_mapping", "SELECT p.page_id, n.n_name AS config FROM pages p JOIN nation n ON n.n_nationkey = p.page_id % 40")
def j12(spark, sf):
    """Check configuration of each video; unmapped ones are skipped."""
    configs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("config"))
    return table(spark, sf, "pages").withColumn("k", F.col("page_id") % 40).join(configs, "k").select("page_id", "config")


@query("tx1_window_caption", "WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS w FROM conversations GROUP BY 1) SELECT conv_id, i AS idx, md5(CASE WHEN i < len(w) THEN w[i + 1] WHEN i = len(w) THEN w[i] END) AS digest FROM c CROSS JOIN range(6) t(i) WHERE i <= len(w)")
def tx1(spark, sf):
    """The caption window of each chunk index; an index beyond one past the end is dropped."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("w"))
    rows = rows.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return rows.select("conv_id", "idx", F.md5(C.window_caption(F.col("w"), F.col("idx"))).alias("digest")).where("digest IS NOT NULL")


@query("tx2_caption_styles", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'long,short' WHEN conv_id % 3 = 1 THEN 'medium' ELSE 'long' END AS styles FROM (SELECT DISTINCT conv_id FROM conversations)")
def tx2(spark, sf):
    k = F.col("conv_id") % 3
    names = F.when(k == 0, F.array(F.lit("qwen"), F.lit("qwen_short"))).when(k == 1, F.array(F.lit("qwen_medium"), F.lit("vila_short"), F.lit("qwen_odd"))).otherwise(F.array(F.lit("qwen")))
    caps = F.map_from_arrays(names, F.transform(names, lambda x: F.lit("text")))
    return table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(C.styles(caps, "qwen"), ",").alias("styles"))


@query("st11_weighted_style")
def st11(spark, sf):
    options = F.array(F.lit("long"), F.lit("short"), F.lit("medium"))
    return docs(spark, sf).select("doc_id", C.weighted_pick(options, {"long": 0.7, "short": 0.2, "medium": 0.1}, F.col("doc_id")).alias("style"))


@query("tx3_image_caption", "SELECT doc_id, md5(coalesce(CASE WHEN n_chars % 5 <> 0 THEN text END, source)) AS digest FROM documents")
def tx3(spark, sf):
    """A caption whose parse failed falls back to the source's name."""
    return docs(spark, sf).select("doc_id", F.md5(C.image_caption(F.col("text"), F.col("n_chars") % 5 != 0, F.col("source"))).alias("digest"))


@query("tx4_caption_mix")
def tx4(spark, sf):
    """Human or generated captions by a seeded draw, the other where one is missing."""
    human, made = F.when(F.col("n_chars") % 7 != 0, F.col("text")), F.col("source")
    return docs(spark, sf).select("doc_id", C.caption_mix(human, made, 0.6, F.col("doc_id"), F.lit(11)).alias("caption"))


@query("tx14_aspect_ratio", "SELECT page_id, replace(NULLIF(regexp_extract('s3://b/aspect_ratio_' || CASE page_id % 3 WHEN 0 THEN '16_9' WHEN 1 THEN '1_1' ELSE 'x' END || '/' || url, 'aspect_ratio_([0-9]+_[0-9]+)', 1), ''), '_', ',') AS aspect FROM pages")
def tx14(spark, sf):
    k = F.col("page_id") % 3
    path = F.concat(F.lit("s3://b/aspect_ratio_"), F.when(k == 0, "16_9").when(k == 1, "1_1").otherwise("x"), F.lit("/"), "url")
    return table(spark, sf, "pages").select("page_id", T.aspect_ratio(path).alias("aspect"))


@query("tx15_iteration_parse", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 1000 ELSE p_partkey END AS BIGINT) AS iteration FROM part")
def tx15(spark, sf):
    k = F.col("p_partkey").cast("string")
    label = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("exp-"), k, F.lit("k"))).otherwise(F.concat(F.lit("run2-tune-"), k))
    return table(spark, sf, "part").select("p_partkey", T.iteration(label).alias("iteration"))


@query("tx16_after_colon", "SELECT page_id, trim(regexp_extract(url, '([^:]*)$', 1)) AS tail FROM pages")
def tx16(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.after_colon(F.col("url")).alias("tail"))


@query("tx17_path_template", "SELECT user_id, printf('videos/chunk-%03d/cam/episode_%06d.mp4', user_id // 1000, user_id) AS path FROM (SELECT DISTINCT user_id FROM events)")
def tx17(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", F.format_string("videos/chunk-%03d/cam/episode_%06d.mp4", F.floor(F.col("user_id") / 1000), "user_id").alias("path"))


@query("pf13_extension_strip", "SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS key FROM pages")
def pf13(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.without_extension(F.col("url")).alias("key"))


@query("pf14_pf15_sample_names", "SELECT p_partkey, 'root/' || p_name AS path, replace(replace('d/' || p_partkey, '/', '_'), '.', '-') || '-x.caption.json' AS file FROM part")
def pf15(spark, sf):
    name = F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".x.json"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws("/", F.lit("root"), "p_name").alias("path"), T.sample_file(name, "caption").alias("file"))


@query("sc17_last_caption_per_view", "SELECT role AS view, CASE WHEN turn % 3 = 0 THEN 'long' ELSE 'tag' || turn % 3 END AS tag, md5(max_by(text, conv_id * 100 + turn)) AS digest FROM conversations GROUP BY 1, 2")
def sc17(spark, sf):
    tag = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("tag"), (F.col("turn") % 3).cast("string")))
    rows = table(spark, sf, "conversations").select(F.col("role").alias("view"), tag.alias("tag"), F.col("text").alias("caption"), (F.col("conv_id") * 100 + F.col("turn")).alias("row_no"))
    return C.last_per_tag(rows).select("view", "tag", F.md5("caption").alias("digest"))


@query("sc16_json_caption", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'first' END AS caption FROM events")
def sc16(spark, sf):
    """Caption of a JSON body: the asked prompt type, else the model's first; bare bodies are wrapped."""
    inner = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":"x","long":"'), "event_type", F.lit('"}'))).otherwise(F.lit('{"b":"first","c":"y"}'))
    body = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("{")).otherwise(F.lit("")), F.lit('"m":'), inner, F.when(F.col("event_id") % 3 == 0, F.lit("}")).otherwise(F.lit("")))
    return table(spark, sf, "events").select("event_id", C.first_caption(body, "long").alias("caption"))


@query("sc21_legacy_csv", "SELECT doc_id, 'pre_' || replace(split_part(text, ',', 1), '\"', '') AS head, length(text) - length(split_part(text, ',', 1)) - 1 AS rest FROM documents WHERE contains(text, ',')")
def sc21(spark, sf):
    """Lines split at their first comma only."""
    parts = F.split("text", ",", 2)
    rows = docs(spark, sf).where(F.contains("text", F.lit(",")))
    return rows.select("doc_id", F.concat(F.lit("pre_"), F.regexp_replace(parts[0], '"', "")).alias("head"), F.length(parts[1]).cast("long").alias("rest"))


@query("tx19_token_trim", "SELECT doc_id, least(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), 77) AS n FROM documents WHERE text IS NOT NULL")
def token_trim(spark, sf):
    """Captions cut to 77 tokens."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.size(F.slice(words, 1, 77)).cast("long").alias("n"))
