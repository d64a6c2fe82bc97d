"""The tokeniser as one Spark expression of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on: words that are never indexed.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "can", "it", "its", "that", "this",
]
#: A raw token is a run of [A-Za-z0-9_.-/].
MIN_LENGTH = 2


def tokens(content: Column, min_length: int = MIN_LENGTH, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case terms of a line: whole tokens, and parts of paths, dotted names and hyphenated words.

    Stop words drop a token with its parts, but only hyphenated parts are themselves tested for stop words.
    """
    words = F.array(*(F.lit(w) for w in ["", *STOP_WORDS, *(stop_words or [])]))
    # most tokens are plain words: they are found, lowered and freed of stop words in a few calls a line
    plain = F.regexp_extract_all(content, F.lit(rf"(?<![\w.\-/])\w{{{min_length},}}+(?![\w.\-/])"), F.lit(0))
    plain = F.array_except(F.split(F.lower(F.array_join(plain, " ")), " "), words)
    # the others have parts; a lambda sees only these
    compound = F.regexp_extract_all(content, F.lit(r"(?<!\w)\w*+[.\-/][\w.\-/]*+"), F.lit(0))
    stopped = lambda t: F.array_contains(words, F.lower(t))
    long_enough = lambda p: F.length(p) >= min_length
    none = F.array().cast("array<string>")

    def parts(t: Column) -> Column:
        by_slash = F.when(F.contains(t, F.lit("/")), F.filter(F.split(t, "/"), long_enough)).otherwise(none)
        dotted = F.split(t, r"\.")
        named = F.contains(t, F.lit(".")) & ~F.startswith(t, F.lit(".")) & (F.size(dotted) >= 3) & F.forall(dotted, lambda p: p != "")
        by_dot = F.when(named, F.filter(dotted, lambda p: long_enough(p) & ~p.rlike("^[0-9]+$"))).otherwise(none)
        hyphenated = F.contains(t, F.lit("-")) & (F.length(t) > 4)
        by_hyphen = F.when(hyphenated, F.filter(F.split(t, "-"), lambda p: long_enough(p) & ~stopped(p))).otherwise(none)
        return F.concat(F.array(t), by_slash, by_dot, by_hyphen)

    kept = F.filter(compound, lambda t: long_enough(t) & (F.translate(t, ".-/", "") != "") & ~(stopped(t) if stop_words else F.lit(False)))
    broken = F.transform(F.flatten(F.transform(kept, parts)), F.lower)
    return F.when(F.size(compound) == 0, plain).otherwise(F.array_distinct(F.concat(plain, broken)))
