"""String expressions: captions, paths, keys, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.fuzzy import fuzzy_blocked  # noqa: F401


def ascii_fold(text: Column) -> Column:
    """Every run of non-ASCII characters becomes one space."""
    return F.regexp_replace(text, r"[^\x00-\x7F]+", " ")


def collapsed(text: Column) -> Column:
    """White space collapsed to single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def blocked_word(text: Column, words: list[str]) -> Column:
    """The first listed word that stands in the text as a whole word, else null.

    One alternation is compiled once; words are literals.
    """
    if not words:
        return F.lit(None).cast("string")
    pattern = "\\b(" + "|".join("\\Q" + w.lower() + "\\E" for w in sorted(words, key=len, reverse=True)) + ")\\b"
    return F.nullif(F.regexp_extract(collapsed(text), pattern, 1), F.lit(""))


def censored(text: Column, words: list[str], allowed: list[str]) -> Column:
    """Listed words as asterisks, but for those allowed."""
    banned = [w for w in words if w not in allowed]
    if not banned:
        return text
    return F.regexp_replace(text, "(?i)\\b(" + "|".join("\\Q" + w + "\\E" for w in banned) + ")\\b", "****")


def without_extension(key: Column) -> Column:
    """The key without its last dot and what follows."""
    return F.regexp_replace(key, r"\.[^.]*$", "")


def sample_file(name: Column, key: str) -> Column:
    """``a.b.json`` as ``a-b.<key>.json``, slashes as underscores."""
    stem = F.regexp_replace(without_extension(name), r"\.", "-")
    return F.regexp_replace(F.concat(stem, F.lit(f".{key}."), F.regexp_extract(name, r"\.([^.]*)$", 1)), "/", "_")


def after_colon(text: Column) -> Column:
    """What follows the last colon, trimmed."""
    return F.trim(F.element_at(F.split(text, ":"), -1))


def aspect_ratio(path: Column) -> Column:
    """``16,9`` from ``.../aspect_ratio_16_9/...``, else null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(path, r"aspect_ratio_(\d+_\d+)", 1), "_", ","), F.lit(""))


def iteration(label: Column) -> Column:
    """The iteration of a label such as ``exp-30k`` or ``run-1200``: its last part of digits with an optional k."""
    part = F.regexp_extract(label, r"(?:^|[-_ ])(\d+k?)(?!.*[-_ ]\d+k?$)", 1)
    number = F.regexp_extract(part, r"^(\d+)", 1)
    return F.when(number != "", number.cast("long") * F.when(part.endswith("k"), 1000).otherwise(1))


def caption_excluded(caption: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a keyword filter drops the caption: it holds an excluded word, or none of the included; null and blank
    captions pass."""
    low = F.lower(caption)
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)) if words else F.lit(False)
    drop = has(exclude) | (~has(include) if include else F.lit(False))
    return F.coalesce(F.trim(caption) != "", F.lit(False)) & F.coalesce(drop, F.lit(False))


def answer_valid(output: Column, answer: Column, keywords: Column) -> Column:
    """Whether a reply holds the answer and, where there are keywords, at least one of them; keywords without an answer
    always fail.  Comparison ignores case."""
    low = F.lower(output)
    some = F.size(keywords) > 0
    hit = F.exists(keywords, lambda k: F.contains(low, F.lower(k)))
    return F.coalesce(F.when(F.trim(answer) == "", ~some).otherwise(F.contains(low, F.lower(answer)) & (~some | hit)), F.lit(False))


def first_reason(*reasons: Column) -> Column:
    """The first guard's objection, null if all are silent."""
    return F.coalesce(*reasons)


def moderation(output: Column) -> Column:
    """Category of a moderation model's reply: the line after ``unsafe``; null for ``safe``."""
    lines = F.split(F.trim(output), r"\n")
    return F.when(F.lower(F.trim(lines[0])) == "unsafe", F.coalesce(F.trim(F.get(lines, F.lit(1))), F.lit("unknown")))
