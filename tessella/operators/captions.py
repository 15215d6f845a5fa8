"""Caption windows, styles and mixes; question checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_caption(windows: Column, index: Column) -> Column:
    """The window of a chunk index; one past the end takes the last, further is null."""
    n = F.size(windows)
    return F.when((index >= 0) & (index <= n), F.get(windows, F.least(index, n - 1)))


def styles(captions: Column, kind: str) -> Column:
    """Styles of a caption map's keys for a type: the key without the type and underscores, empty meaning ``long``;
    unknown styles are left out."""
    known = F.array(F.lit("long"), F.lit("short"), F.lit("medium"), F.lit("user"))
    own = F.filter(F.map_keys(captions), lambda k: F.startswith(k, F.lit(kind)))
    named = F.transform(own, lambda k: F.replace(F.replace(k, F.lit(kind), F.lit("")), F.lit("_"), F.lit("")))
    return F.array_sort(F.array_intersect(F.transform(named, lambda s: F.when(s == "", "long").otherwise(s)), known))


def weighted_pick(options: Column, weights: dict[str, float], seed: Column) -> Column:
    """One of the options by weight and a hash of ``seed``; unknown options weigh nothing, no weight gives null."""
    w = F.transform(options, lambda o: F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[o], F.lit(0.0)))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    u = F.pmod(F.xxhash64(seed), F.lit(1 << 30)) / float(1 << 30) * total
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick"))
    step = lambda acc, x: F.struct((acc["sum"] + x["w"]).alias("sum"), F.coalesce(acc["pick"], F.when((u < acc["sum"] + x["w"]) & (x["w"] > 0), x["o"])).alias("pick"))
    return F.aggregate(F.zip_with(options, w, lambda o, x: F.struct(o.alias("o"), x.alias("w"))), state, step)["pick"]


def image_caption(caption: Column, parsed: Column, fallback: Column) -> Column:
    """An image's caption where it could be parsed and is there, else the fallback."""
    return F.coalesce(F.when(parsed, caption), fallback)


def caption_mix(human: Column, made: Column, share: float, *seed: Column) -> Column:
    """The human caption with probability ``share`` (a hash of ``seed``), else the generated one; where the chosen one is missing, the other."""
    u = F.pmod(F.xxhash64(*seed), F.lit(1000)) / 1000.0
    return F.when(u < share, F.coalesce(human, made)).otherwise(F.coalesce(made, human))


def last_per_tag(rows: DataFrame) -> DataFrame:
    """(view, tag, caption) of the last row (by ``row_no``) for each view and tag; a null tag is ``long``."""
    tag = F.coalesce("tag", F.lit("long"))
    return rows.groupBy("view", tag.alias("tag")).agg(F.max_by("caption", "row_no").alias("caption"))


def first_caption(body: Column, kind: str) -> Column:
    """From JSON {model: {prompt type: text}}: the first model's caption of the type, else its first; a bare body is
    wrapped in braces."""
    text = F.when(F.startswith(F.trim(body), F.lit("{")), body).otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    model = F.get(F.map_values(F.from_json(text, "map<string,map<string,string>>")), F.lit(0))
    return F.coalesce(F.try_element_at(model, F.lit(kind)), F.get(F.map_values(model), F.lit(0)))
