"""Search over lines: match, filter by time and level, rank, page, then add spans and context."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.tokens import tokens
from ..plans.lowering import bounds, decided, index_hits, is_fuzzy, predicate
from ..plans.query import Node, parse, terms
from ..sources.index_store import Index
from ..sources.lines import average_length, let

KEY = ["file", "line_no"]
#: Rows of a page that are computed once and broadcast.
PAGE = 10_000


@dataclass(frozen=True)
class SearchOptions:
    ignore_case: bool = True
    is_regex: bool = False
    strict: bool = False
    contains: bool = False  # search for the query as a substring
    mode: str = "token"
    since: str | None = None
    until: str | None = None
    level: str | None = None
    sort_by: str = "line"  # line, score or timestamp
    descending: bool | None = None  # by default best first for score, else ascending
    offset: int = 0
    limit: int | None = 1000
    context: int = 0
    most_chars: int | None = None  # characters of a line that are returned; spans are of the whole line
    stop_words: list[str] = field(default_factory=list)


def tokenised(lines: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``lines`` with their terms, computed once however often a plan uses them: an explode of one element is not copied into what reads it."""
    return lines if "terms" in lines.columns else lines.select("*", F.explode_outer(F.array(tokens(F.col("content"), stop_words=stop_words))).alias("terms"))


def in_time(content: Column, since: str | None, until: str | None) -> Column:
    """Inclusive; lines without a time stay."""
    at, low, high = text.line_time(content), text.moment(since), text.moment(until)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (at.isNull() | (at >= low))
    if high is not None:
        keep = keep & (at.isNull() | (at <= high))
    return keep


def of_level(content: Column, level: str) -> Column:
    """A substring of the upper-cased line, so WARN also finds WARNING."""
    return F.contains(F.upper(content), F.lit(level.upper()))


def matches(lines: DataFrame, query: str | Node, options: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """The lines that the query and the options' filters keep, by a scan."""
    content = F.col("content")
    if options.contains:
        kept = lines.where(F.contains(F.lower(content), F.lit(str(query).lower())))
    else:
        node = parse(query, options.ignore_case, options.is_regex, options.strict) if isinstance(query, str) else query
        if "terms" in lines.columns:
            kept = lines.where(predicate(node, options.mode))
        elif is_fuzzy(node):
            kept = tokenised(lines, options.stop_words).where(predicate(node, options.mode)).drop("terms")
        else:  # patterns rule out most lines; the others are tokenised, once
            above = bounds(node, options.stop_words)[0] if options.mode == "token" else F.lit(True)
            kept = lines.where(above & let(tokens(content, stop_words=options.stop_words), lambda found: predicate(node, options.mode, found)))
    kept = kept.where(in_time(content, options.since, options.until))
    return kept.where(of_level(content, options.level)) if options.level else kept


def indexed_matches(index: Index, query: str | Node, options: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """The same lines by the postings: candidates first, their content after, and the scan's predicate where postings do not decide.

    Lines are those terms' that the index was built with; other stop words are refused.
    """
    told = index.options.get("stop_words") or []
    if options.stop_words and sorted(options.stop_words) != sorted(told):
        raise ValueError(f"the index was built with the stop words {told}, not {options.stop_words}")
    node = parse(query, options.ignore_case, options.is_regex, options.strict) if isinstance(query, str) else query
    hits = None if options.contains or options.mode == "column" else index_hits(node, index.postings, index.vocabulary)
    if hits is None:
        return matches(index.lines, query if options.contains else node, options)
    # a search for all lines joins by shuffling beyond the adaptive limit; a rare term's hits are broadcast by it
    lines = index.lines.join(hits, KEY, "left_semi")
    if not decided(node):
        return matches(lines, node, options)
    kept = lines.where(in_time(F.col("content"), options.since, options.until))
    return kept.where(of_level(F.col("content"), options.level)) if options.level else kept


def sort_keys(options: SearchOptions) -> list[Column]:
    """A total order: the wanted key, then file and line."""
    down = options.descending if options.descending is not None else options.sort_by == "score"
    way = F.desc if down else F.asc
    if options.sort_by == "score":
        return [way("match_score"), F.asc("file"), F.asc("line_no")]
    if options.sort_by == "timestamp":
        return [F.desc(text.line_time(F.col("content"))) if down else F.asc(text.line_time(F.col("content"))), F.asc("file"), F.asc("line_no")]
    return [way("file"), way("line_no")]


def ordered(found: DataFrame, query_terms: list[str], options: SearchOptions) -> DataFrame:
    """One page of the ranked lines. With a limit this is a top-k, not a sort of everything."""
    page = found.withColumn("match_score", text.score(F.col("content"), query_terms, average_length())).orderBy(*sort_keys(options))
    page = page.offset(options.offset) if options.offset else page
    return page.limit(options.limit) if options.limit is not None else page


def rank_page(page: DataFrame, query_terms: list[str], best_first: bool = True) -> DataFrame:
    """Order the lines of one page by score."""
    scored = page.withColumn("match_score", text.score(F.col("content"), query_terms, average_length()))
    return scored.orderBy(F.desc("match_score") if best_first else F.asc("match_score"), F.asc("line_no") if best_first else F.desc("line_no"))


def with_context(lines: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """context_before and context_after of each hit: up to n lines of its file on either side.

    A hit asks for 2 n + 1 line numbers, so the lines meet hits in an equi-join; the lines themselves are
    neither windowed nor sorted, however many there are beside a page of hits. Up to PAGE hits are computed
    once and broadcast; beyond, the join shuffles.
    """
    found = hits.limit(PAGE + 1).collect()
    hits = lines.sparkSession.createDataFrame(found, hits.schema) if len(found) <= PAGE else hits
    wanted = hits.select("file", F.col("line_no").alias("hit"), F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no"))
    wanted = F.broadcast(wanted) if len(found) <= PAGE else wanted
    near = lines.select("file", "line_no", "content").join(wanted, KEY)
    side = lambda rows: F.transform(F.array_sort(F.collect_list(F.when(rows, F.struct("line_no", "content")))), lambda x: x["content"])
    around = near.groupBy("file", "hit").agg(side(F.col("line_no") < F.col("hit")).alias("context_before"), side(F.col("line_no") > F.col("hit")).alias("context_after"))
    return around.withColumnRenamed("hit", "line_no").join(hits, KEY, "right")


def search(source: DataFrame | Index, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:  # noqa: B008
    """file, line_no, byte_offset, content, match_score, highlights and, if asked for, the context of one page of matches."""
    indexed = isinstance(source, Index)
    found = indexed_matches(source, query, options) if indexed else matches(source, query, options)
    wanted = [query] if options.contains else terms(parse(query, options.ignore_case, options.is_regex, options.strict))
    page = ordered(found, wanted, options).withColumn("highlights", text.spans(F.col("content"), wanted, options.ignore_case))
    if options.most_chars is not None:
        page = page.withColumn("content", F.substring("content", 1, options.most_chars))
    if options.context:
        page = with_context(source.lines if indexed else source, page, options.context).orderBy(*sort_keys(options))  # the join keeps no order
    columns = ["file", "line_no", "byte_offset", "content", "match_score", "highlights"]
    return page.select(*columns, *(["context_before", "context_after"] if options.context else []))


def numbered(page: DataFrame, width: int = 120) -> DataFrame:
    """A page as a table: rank, place, score and shortened content."""
    rank = F.row_number().over(Window.orderBy(F.desc("match_score"), "file", "line_no"))
    return page.select(rank.alias("rank"), "file", "line_no", F.round("match_score", 3).alias("score"), text.shortened(F.col("content"), width).alias("content"))


def counted(source: DataFrame | Index, query: str, options: SearchOptions) -> dict[str, int]:
    """Matches in all, and on the page."""
    total = (indexed_matches(source, query, options) if isinstance(source, Index) else matches(source, query, options)).count()
    left = max(0, total - options.offset)
    return {"total_hits": total, "returned": left if options.limit is None else min(left, options.limit)}
