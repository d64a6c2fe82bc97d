"""Jaro-Winkler similarity: half transpositions count as halves, and the prefix bonus always applies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    if reach < 0 or not a or not b:
        return 0.0
    free = dict.fromkeys(range(len(b)))  # places of b that nothing matches yet
    pairs = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j in free and b[j] == c), None)
        if j is not None:
            del free[j]
            pairs.append((i, j))
    m = len(pairs)
    if not m:
        return 0.0
    swapped = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(j for _, j in pairs), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def may_reach(term: Column, target: str, threshold: float) -> Column:
    """A bound that every term of at least this similarity keeps; evaluated without Python.

    No more characters match than either word has that occur in the other; the common prefix is known exactly.
    """
    n, size = max(len(target), 1), F.length(term)
    shared = size - F.length(F.translate(term, "".join(dict.fromkeys(target)), "")) if target else F.lit(0)
    matched = F.least(shared, F.lit(n))
    jaro = (matched / size + matched / n + 1) / 3
    prefix = F.lit(0)
    for k in range(1, min(4, len(target)) + 1):
        prefix = F.when(F.startswith(term, F.lit(target[:k])), k).otherwise(prefix)
    return (size > 0) & (matched > 0) & (jaro + prefix * 0.1 * (1 - jaro) >= threshold - 1e-9)


def similarity(column: Column, target: str) -> Column:
    """Similarity of each string to the target, in Arrow batches."""

    @F.pandas_udf("double")
    def run(terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else jaro_winkler(target, t) for t in terms], dtype="float64")

    return run(column)


def similar_in(terms: Column, target: str, threshold: float) -> Column:
    """Whether any string of an array has at least this similarity; most are ruled out by their length before Python."""

    @F.pandas_udf("boolean")
    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([any(jaro_winkler(target, t) >= threshold for t in a) for a in arrays], dtype="bool")

    near = F.filter(terms, lambda t: may_reach(t, target, threshold))
    return F.when(F.size(near) > 0, run(near)).otherwise(False)


def fuzzy_matches(content: Column, target: str, threshold: float = 0.85) -> Column:
    """Tokens between white space whose word characters are similar: array of token, score, start and end."""
    target = target.lower()

    @F.pandas_udf("array<struct<token:string,score:double,start:int,end:int>>")
    def run(lines: pd.Series) -> pd.Series:
        def of(line: str | None) -> list[dict]:
            found = ((m, jaro_winkler(target, re.sub(r"[^A-Za-z0-9_]", "", m[0].lower()))) for m in re.finditer(r"\S+", line or ""))
            return [{"token": m[0], "score": s, "start": m.start(), "end": m.end()} for m, s in found if s >= threshold]

        return pd.Series([of(line) for line in lines])

    return run(content)
