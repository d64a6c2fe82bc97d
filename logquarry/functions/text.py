"""Relevance, spans and times of lines as Column expressions."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that scores depend on: saturation, length normalisation and the length where there are no lines.
K1, B, DEFAULT_LENGTH = 1.5, 0.75, 200.0
#: Fixed patterns of times, statuses and sizes in a line.
ISO_TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
STATUS, SIZE = r'"\s+(\d{3})\s+', r"\s(\d+)$"


def occurrences(lowered: Column, term: str) -> Column:
    """Non-overlapping occurrences of a lower-case term."""
    if not term:
        return F.lit(0)
    return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(term), F.lit("")))) / len(term)).cast("int")


def score(content: Column, terms: list[str], average_length: Column | float = DEFAULT_LENGTH) -> Column:
    """Saturating term frequency with length normalisation, summed over the terms; no inverse document frequency."""
    lowered, average = F.lower(content), average_length if isinstance(average_length, Column) else F.lit(float(average_length))
    total = F.lit(0.0)
    for term in terms:
        tf = occurrences(lowered, term.lower())
        total = total + F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * (F.length(content) / average)))).otherwise(0.0)
    return total


def spans(content: Column, terms: list[str], ignore_case: bool = True) -> Column:
    """[start, end) of every non-overlapping occurrence of every term, by start; not merged.

    The text between occurrences gives their places: a split by the literal term never overlaps.
    """
    searched = F.lower(content) if ignore_case else content
    kind = "array<struct<start:int,end:int>>"

    def of(term: str) -> Column:
        between, size = F.split(searched, quoted(term), -1), len(term)
        before = lambda i: F.aggregate(F.slice(between, 1, i), F.lit(0), lambda a, p: a + F.length(p))
        span = lambda start: F.struct(start.alias("start"), (start + size).alias("end"))
        found = F.transform(F.sequence(F.lit(1), F.size(between) - 1), lambda i: span(before(i) + (i - 1) * size))
        return F.when(F.size(between) > 1, found.cast(kind)).otherwise(F.array().cast(kind))

    found = [F.array().cast(kind), *(of(t.lower() if ignore_case else t) for t in terms if t)]
    return F.array_sort(F.concat(*found))


def quoted(literal: str) -> str:
    r"""The literal as a Java pattern."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def merge_spans(ranges: Column) -> Column:
    """Union of ranges sorted by start; those that touch are joined."""
    kind = "array<struct<start:int,end:int>>"

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        apart = F.concat(done, F.array(F.struct(r["start"].alias("start"), r["end"].alias("end"))))
        return F.when((F.size(done) > 0) & (r["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined.cast(kind)).otherwise(apart.cast(kind))

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add)


def marked(content: str, ranges: list[tuple[int, int]], before: str = "\x1b[1;33m", after: str = "\x1b[0m") -> str:
    """A fetched line with its merged ranges marked, for printing."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [content[at:start], before, content[start:end], after]
        at = end
    return "".join([*out, content[at:]])


def line_time(content: Column) -> Column:
    """The first ISO time of a line, to the second, read as UTC whatever zone follows; null if there is none."""
    return F.try_to_timestamp(F.replace(F.nullif(F.regexp_extract(content, ISO_TIME, 0), F.lit("")), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))


def number(content: Column, field: str) -> Column:
    """Epoch milliseconds, status or size of a line; null where it has none or for another field."""
    if field == "timestamp":
        return F.unix_millis(line_time(content)).cast("double")
    if field in ("status", "size"):
        return F.nullif(F.regexp_extract(content, STATUS if field == "status" else SIZE, 1), F.lit("")).cast("double")
    return F.lit(None).cast("double")


def moment(value: str | datetime | None) -> Column | None:
    """A bound of a time range; a date or time without a zone is UTC. Raises ValueError for what is no time."""
    if value is None:
        return None
    at = value if isinstance(value, datetime) else datetime.fromisoformat(re.sub(r"Z$", "+00:00", value))
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000)))


def level_tag(content: Column) -> Column:
    """ERROR, WARN or INFO by the first level word of a line; null if it has none."""
    word = F.upper(F.regexp_extract(content, r"(?i)\b(ERROR|FATAL|CRITICAL|WARNING|WARN|INFO|DEBUG|TRACE)\b", 1))
    return F.when(word.isin("ERROR", "FATAL", "CRITICAL"), "ERROR").when(word.isin("WARN", "WARNING"), "WARN").when(word != "", "INFO")


def shortened(content: Column, width: int) -> Column:
    return F.when(F.length(content) > width, F.concat(F.substring(content, 1, width - 3), F.lit("..."))).otherwise(content)


def readable_bytes(n: int) -> str:
    units = ("B", "KB", "MB", "GB")
    power = min(3, max(0, (int(n).bit_length() - 1) // 10)) if n else 0
    return f"{n} B" if not power else f"{n / 1024**power:.1f} {units[power]}"
