"""Queries over whole tables for every operator, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import views
from .functions import text
from .functions.similarity import fuzzy_matches, may_reach, similarity
from .functions.tokens import tokens
from .operators import alerts, formats, ranges, setops
from .operators.search import SearchOptions, indexed_matches, matches, ordered, rank_page, search, tokenised, with_context
from .plans.lowering import phrase_candidates, predicate
from .plans.query import Phrase, parse, terms
from .sources.index_store import Index, compact, metadata_of, postings_of, vocabulary_of
from .sources.lines import average_length, last_lines, line_at, shared_folder
from .streaming.watch import level_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "(ci OR tion) AND que NOT la"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pairs(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = ordered(matches(views.doc_lines(spark, sf_dir), FLAGSHIP), terms(parse(FLAGSHIP)), SearchOptions(sort_by="score", limit=100))
    return page.select(F.col("file").alias("doc_id"), "line_no", "byte_offset", "content", F.round("match_score", 6).alias("match_score"))


def _hits(spark: SparkSession, sf_dir: str, text_query: str, **options) -> DataFrame:
    return matches(views.doc_lines(spark, sf_dir), text_query, SearchOptions(**options)).select("file", "line_no", "byte_offset")


def _hit_sql(condition: str) -> str:
    return f"WITH {views.DOC_TOKENS} SELECT file, line_no, byte_offset FROM tokens WHERE {condition}"


has = "list_contains(terms, '{}')".format


def _score_sql(wanted: list[str]) -> str:
    one = "CASE WHEN contains(lower(content), '{t}') THEN tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (length(content) / (file_bytes / file_lines)))) ELSE 0 END"
    return " + ".join(one.replace("tf", f"((length(content) - length(replace(lower(content), '{t}', ''))) // {len(t)})").format(t=t) for t in wanted)


_FLAGSHIP_WHERE = f"({has('ci')} OR {has('tion')}) AND {has('que')} AND NOT {has('la')}"
_FLAGSHIP_SCORE = _score_sql(["ci", "tion", "que", "la"])


@query(f"WITH {views.DOC_TOKENS} SELECT file AS doc_id, line_no, byte_offset, content, round({_FLAGSHIP_SCORE}, 6) AS match_score FROM tokens WHERE {_FLAGSHIP_WHERE} ORDER BY {_FLAGSHIP_SCORE} DESC, doc_id, line_no LIMIT 100")
def bm25_topk(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {views.PAGE_TOKENS} SELECT file, line_no, array_to_string(list_sort(terms), ' ') AS terms FROM tokens")
def tokenize(spark, sf_dir):
    return views.page_lines(spark, sf_dir).select("file", "line_no", F.array_join(F.array_sort(tokens(F.col("content"))), " ").alias("terms"))


@query(f"WITH {views.DOC_TOKENS} SELECT unnest(terms) AS term, file, line_no, byte_offset FROM tokens")
def postings(spark, sf_dir):
    return postings_of(views.doc_lines(spark, sf_dir))


@query(f"WITH {views.DOC_TOKENS}, p AS (SELECT unnest(terms) AS term, file, byte_offset FROM tokens) SELECT file, term, array_to_string(list_sort(list(byte_offset)), ',') AS offsets FROM p GROUP BY ALL")
def posting_lists(spark, sf_dir):
    return compact(postings_of(views.doc_lines(spark, sf_dir))).select("file", "term", F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


@query(f"WITH {views.DOC_TOKENS}, p AS (SELECT unnest(terms) AS term FROM tokens) SELECT term, count(*) AS df FROM p GROUP BY term")
def vocab_df(spark, sf_dir):
    return vocabulary_of(postings_of(views.doc_lines(spark, sf_dir).select("file", "line_no", "byte_offset", "content")))


@query(f"WITH {views.DOC_TOKENS}, t AS (SELECT file, count(DISTINCT term) AS unique_terms FROM (SELECT file, unnest(terms) AS term FROM tokens) GROUP BY file) SELECT f.file, f.total_lines, coalesce(t.unique_terms, 0) AS unique_terms, f.file_size, round(f.file_size / f.total_lines, 6) AS avg_line_len FROM (SELECT file, count(*) AS total_lines, max(file_bytes) AS file_size FROM tokens GROUP BY file) f LEFT JOIN t USING (file)")
def meta_stats(spark, sf_dir):
    lines = views.doc_lines(spark, sf_dir)
    return metadata_of(lines, postings_of(lines)).withColumn("avg_line_len", F.round("avg_line_len", 6))


@query(_hit_sql(has("tion")))
def term_lookup(spark, sf_dir):
    return _hits(spark, sf_dir, "tion")


@query(_hit_sql(f"{has('que')} AND {has('de')}"))
def and_query(spark, sf_dir):
    return _hits(spark, sf_dir, "que AND de")


@query(_hit_sql(f"{has('schtz')} OR {has('licensed')}"))
def or_query(spark, sf_dir):
    return _hits(spark, sf_dir, "schtz OR licensed")


@query(_hit_sql(f"{has('licensed')} AND NOT {has('apache')} AND NOT {has('gnu')}"))
def not_query(spark, sf_dir):
    return _hits(spark, sf_dir, "licensed NOT apache AND NOT gnu")


@query(_hit_sql(_FLAGSHIP_WHERE))
def nested_bool(spark, sf_dir):
    return _hits(spark, sf_dir, FLAGSHIP)


@query(_hit_sql(f"{has('version')} AND {has('license')}"))
def implicit_and(spark, sf_dir):
    return _hits(spark, sf_dir, "version license")


@query(_hit_sql(f"{has('license')} AND {has('version')}"))
def phrase_terms(spark, sf_dir):
    lines = tokenised(views.doc_lines(spark, sf_dir))
    return lines.where(phrase_candidates(Phrase("License version"))).select("file", "line_no", "byte_offset")


@query(_hit_sql("contains(lower(content), 'under the apache license')"))
def phrase_exact(spark, sf_dir):
    return _hits(spark, sf_dir, '"under the Apache License"')


@query(_hit_sql("regexp_matches(content, '(?i)licen[cs]e.*[0-9]')"))
def regex_query(spark, sf_dir):
    return _hits(spark, sf_dir, "/licen[cs]e.*[0-9]/")


@query(_hit_sql("contains(lower(content), 'reserved')"))
def contains_query(spark, sf_dir):
    return _hits(spark, sf_dir, "Reserved", contains=True)


@query(f"WITH {views.EVENT_LOG},\n{views.tokens_sql('event_log')} SELECT file, line_no FROM tokens WHERE {has('error')}")
def level_query(spark, sf_dir):
    return matches(views.event_log(spark, sf_dir), "level:error").select("file", "line_no")


@query(f"WITH {views.EVENT_LOG},\n{views.tokens_sql('event_log')} SELECT file, line_no FROM tokens WHERE {has('purchase')}")
def field_query(spark, sf_dir):
    return matches(views.event_log(spark, sf_dir), 'type:"purchase"').select("file", "line_no")


@query(f"WITH {views.ACCESS_LOG} SELECT file, line_no FROM access_log WHERE (o_status >= 500) AND regexp_extract(content, '- user1 ', 0) <> ''".replace("o_status", "CAST(regexp_extract(content, '\" ([0-9]{3}) ', 1) AS INT)"))
def column_query(spark, sf_dir):
    parsed = formats.parse_nginx(views.access_log(spark, sf_dir))
    return matches(parsed, "level:ERROR AND remote_user:user1", SearchOptions(mode="column")).select("file", "line_no")


def _similar_sql(words: str, target: str, threshold: float) -> str:
    """CTEs: ``near`` has the distinct words w of ``words`` with score at least the threshold. Places of matches come one character of the target a step."""
    n = len(target)
    reach = f"greatest(length(w), {n}) // 2 - 1"
    return f"""steps AS (SELECT DISTINCT w, 0 AS i, CAST([] AS BIGINT[]) AS js FROM {words} WHERE w <> '' AND (2 + least(length(w), {n}) / greatest(length(w), {n})) / 3 >= {(threshold - 0.4) / 0.6 - 1e-9}
UNION ALL SELECT w, i + 1, list_append(js, coalesce(list_filter(range(greatest(1, i + 1 - ({reach})), least(length(w), i + 1 + {reach}) + 1), lambda j: w[j] = substr('{target}', i + 1, 1) AND NOT list_contains(js, j))[1], 0)) FROM steps WHERE i < {n}),
paired AS (SELECT w, list_filter(js, lambda j: j > 0) AS bs, list_filter(range(1, {n} + 1), lambda k: js[k] > 0) AS xs FROM steps WHERE i = {n}),
jaro AS (SELECT w, len(bs) AS m, len(list_filter(range(1, len(bs) + 1), lambda k: substr('{target}', xs[k], 1) <> w[list_sort(bs)[k]])) AS swapped FROM paired WHERE len(bs) > 0),
scored AS (SELECT w, (m / {n} + m / length(w) + (m - swapped / 2) / m) / 3 AS jaro, coalesce(list_filter(range(1, 5), lambda k: length(w) < k OR {n} < k OR w[k] <> substr('{target}', k, 1))[1] - 1, 4) AS prefix FROM jaro),
near AS (SELECT w, CASE WHEN w = '{target}' THEN 1.0 ELSE jaro + prefix * 0.1 * (1 - jaro) END AS score FROM scored WHERE w = '{target}' OR jaro + prefix * 0.1 * (1 - jaro) >= {threshold})"""


_TERMS = "v AS (SELECT DISTINCT unnest(terms) AS w FROM tokens)"


@query(f"WITH RECURSIVE {views.DOC_TOKENS}, {_TERMS}, {_similar_sql('v', 'licensed', 0.9)} SELECT file, line_no, byte_offset FROM tokens WHERE list_has_any(terms, (SELECT coalesce(list(w), CAST([] AS VARCHAR[])) FROM near))")
def fuzzy_query(spark, sf_dir):
    return _hits(spark, sf_dir, "~licensed:0.9")


@query(f"WITH RECURSIVE {views.DOC_TOKENS}, p AS (SELECT unnest(terms) AS w FROM tokens), {_similar_sql('p', 'connection', 0.8)} SELECT w AS term, count(*) AS df, round(max(score), 6) AS score FROM p JOIN near USING (w) GROUP BY w")
def fuzzy_vocabulary(spark, sf_dir):
    vocabulary = vocabulary_of(postings_of(views.doc_lines(spark, sf_dir)))
    near = vocabulary.where(may_reach(F.col("term"), "connection", 0.8)).withColumn("score", similarity(F.col("term"), "connection"))
    return near.where("score >= 0.8").withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {views.DOC_LINES}, raw AS (SELECT file, line_no, regexp_extract_all(content, '[^ \t\n\x0b\f\r]+') AS found FROM doc_lines),
each AS (SELECT file, line_no, unnest(found) AS token, generate_subscripts(found, 1) AS i FROM raw), words AS (SELECT *, regexp_replace(lower(token), '[^A-Za-z0-9_]', '', 'g') AS w FROM each),
{_similar_sql('words', 'license', 0.9)} SELECT file, line_no, token, round(score, 6) AS score, i FROM words JOIN near USING (w)""")
def fuzzy_spans(spark, sf_dir):
    """Every similar token of each line, by its place among the line's tokens."""
    lines = views.doc_lines(spark, sf_dir)
    found = lines.select("file", "line_no", "content", F.inline(fuzzy_matches(F.col("content"), "license", 0.9)))
    place = F.regexp_count(F.substring("content", F.lit(1), F.col("end")), F.lit(r"\S+")).cast("long")
    return found.select("file", "line_no", "token", F.round("score", 6).alias("score"), place.alias("i"))


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no FROM tokens WHERE {has('licensed')} AND ({has('apache')} OR {has('gnu')})")
def index_search(spark, sf_dir):
    """A stored index: candidates by postings, then the lines."""
    index = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}").build(views.doc_lines(spark, sf_dir))
    return indexed_matches(index, "licensed AND (apache OR gnu)").select("file", "line_no")


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no, byte_offset, file_lines FROM tokens WHERE {has('que')} AND NOT {has('la')}")
def index_append(spark, sf_dir):
    """An index of half the documents to which all are appended."""
    lines = views.doc_lines(spark, sf_dir)
    index = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}").build(lines.where("file % 2 = 0"))
    index.append(lines)
    return indexed_matches(index, "que NOT la").select("file", "line_no", "byte_offset", "file_lines")


@query(f"WITH {views.EVENT_LOG} SELECT file, line_no FROM event_log WHERE substr(content, 1, 19) BETWEEN '2024-01-05T00:00:00' AND '2024-01-07T12:00:00'")
def time_range(spark, sf_dir):
    return ranges.filter_time(views.event_log(spark, sf_dir), "2024-01-05", "2024-01-07T12:00:00").select("file", "line_no")


@query(f"WITH {views.EVENT_LOG} SELECT file, line_no FROM event_log WHERE contains(upper(content), 'WARN')")
def level_filter(spark, sf_dir):
    lines = views.event_log(spark, sf_dir)
    return matches(lines, "type", SearchOptions(contains=True, level="warn")).select("file", "line_no")


@query(f"""WITH {views.ACCESS_LOG} SELECT file, line_no, CAST(regexp_extract(content, '"\\s+([0-9]{{3}})\\s+', 1) AS BIGINT) AS status FROM access_log WHERE CAST(regexp_extract(content, '"\\s+([0-9]{{3}})\\s+', 1) AS BIGINT) BETWEEN 400 AND 599""")
def range_status(spark, sf_dir):
    found = ranges.filter_range(views.access_log(spark, sf_dir), "status", 400, 599)
    return ranges.with_number(found, "status").select("file", "line_no", F.col("status").cast("long").alias("status"))


@query(f"WITH {views.ACCESS_LOG} SELECT file, line_no, CAST(regexp_extract(content, '\\s([0-9]+)$', 1) AS BIGINT) AS size FROM access_log WHERE try_cast(regexp_extract(content, '\\s([0-9]+)$', 1) AS BIGINT) <= 5000")
def range_size(spark, sf_dir):
    found = ranges.filter_range(views.access_log(spark, sf_dir), "size", high=5000)
    return ranges.with_number(found, "size").select("file", "line_no", F.col("size").cast("long").alias("size"))


def _lists(spark, sf_dir):
    lines = tokenised(views.doc_lines(spark, sf_dir))
    return [lines.where(F.array_contains("terms", t)).select("file", "line_no") for t in ("que", "de")]


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no FROM tokens WHERE {has('que')} AND {has('de')}")
def set_intersect(spark, sf_dir):
    return setops.intersect(_lists(spark, sf_dir))


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no FROM tokens WHERE {has('que')} OR {has('de')}")
def set_union(spark, sf_dir):
    return setops.union(_lists(spark, sf_dir))


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no FROM tokens WHERE {has('que')} AND NOT {has('de')}")
def set_subtract(spark, sf_dir):
    return setops.subtract(*_lists(spark, sf_dir))


@query(f"""WITH {views.DOC_TOKENS}, p AS (SELECT file, list(byte_offset) FILTER (WHERE {has("que")}) AS a, list(byte_offset) FILTER (WHERE {has("de")}) AS b FROM tokens GROUP BY file)
SELECT file, coalesce(array_to_string(list_sort(list_intersect(coalesce(a, []), coalesce(b, []))), ','), '') AS both, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ','), '') AS either, coalesce(array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ','), '') AS only_first FROM p""")
def posting_algebra(spark, sf_dir):
    lines = tokenised(views.doc_lines(spark, sf_dir))
    lists = lines.groupBy("file").agg(*(F.collect_list(F.when(F.array_contains("terms", t), F.col("byte_offset"))).alias(n) for n, t in (("a", "que"), ("b", "de"))))
    a, b, shown = F.col("a"), F.col("b"), lambda x: F.array_join(x.cast("array<string>"), ",")
    return lists.select("file", shown(setops.intersect_arrays(a, b)).alias("both"), shown(setops.union_arrays(a, b)).alias("either"), shown(setops.subtract_arrays(a, b)).alias("only_first"))


@query(f"WITH {views.DOC_LINES} SELECT file, line_no, physical_line_no FROM doc_lines")
def line_numbers(spark, sf_dir):
    return views.doc_lines(spark, sf_dir).select("file", "line_no", "physical_line_no")


@query(f"WITH {views.DOC_LINES} SELECT file, line_no, byte_offset, CAST(strlen(content) AS BIGINT) AS n_bytes FROM doc_lines")
def byte_offsets(spark, sf_dir):
    return views.doc_lines(spark, sf_dir).select("file", "line_no", "byte_offset", F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"WITH {views.DOC_LINES} SELECT file, least(count(*) FILTER (WHERE byte_offset < 1000) + 1, count(*)) AS line_no FROM doc_lines GROUP BY file")
def line_of_offset(spark, sf_dir):
    return line_at(views.doc_lines(spark, sf_dir), 1000)


@query(f"""WITH {views.DOC_TOKENS}, w AS (SELECT file, line_no, terms, array_to_string(list(content) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)) AS context_before, array_to_string(list(content) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), chr(10)) AS context_after FROM tokens)
SELECT file, line_no, coalesce(context_before, '') AS context_before, coalesce(context_after, '') AS context_after FROM w WHERE {has("licensed")}""")
def context_lines(spark, sf_dir):
    lines = views.doc_lines(spark, sf_dir)
    found = with_context(lines, matches(lines, "licensed").select("file", "line_no"), 2)
    return found.select("file", "line_no", *(F.array_join(c, "\n").alias(c) for c in ("context_before", "context_after")))


def _span_sql(term: str) -> str:
    pieces = f"string_split(lower(content), '{term}')"
    start = f"CAST(list_sum(list_transform({pieces}[1:i], lambda p: length(p))) + (i - 1) * {len(term)} AS BIGINT)"
    return f"list_transform(range(1, len({pieces})), lambda i: {{'s': {start}, 'e': {start} + {len(term)}}})"


_SPANS = f"list_sort(list_concat({_span_sql('license')}, {_span_sql('under')}))"
_SHOWN = "array_to_string(list_transform({}, lambda x: concat(x.s, '-', x.e)), ',')"


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no, {_SHOWN.format(_SPANS)} AS highlights FROM tokens WHERE {has('license')} AND {has('under')}")
def highlights(spark, sf_dir):
    found = matches(views.doc_lines(spark, sf_dir), "license AND under")
    return found.select("file", "line_no", pairs(text.spans(F.col("content"), ["license", "under"])).alias("highlights"))


@query(f"""WITH {views.DOC_TOKENS}, r AS (SELECT file, line_no, unnest(list_concat({_span_sql("tion")}, {_span_sql("on")})) AS x FROM tokens WHERE {has("tion")}),
s AS (SELECT file, line_no, x.s AS s, x.e AS e, max(x.e) OVER (PARTITION BY file, line_no ORDER BY x.s, x.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY file, line_no ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM s),
m AS (SELECT file, line_no, g, min(s) AS s, max(e) AS e FROM g GROUP BY ALL) SELECT file, line_no, string_agg(concat(s, '-', e), ',' ORDER BY s) AS merged FROM m GROUP BY ALL""")
def merge_ranges(spark, sf_dir):
    found = matches(views.doc_lines(spark, sf_dir), "tion")
    return found.select("file", "line_no", pairs(text.merge_spans(text.spans(F.col("content"), ["tion", "on"]))).alias("merged"))


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no, round({_score_sql(['tion', 'que'])}, 6) AS match_score FROM tokens WHERE {has('tion')} OR {has('que')}")
def bm25_score(spark, sf_dir):
    found = matches(views.doc_lines(spark, sf_dir), "tion OR que")
    return found.select("file", "line_no", F.round(text.score(F.col("content"), ["tion", "que"], average_length()), 6).alias("match_score"))


_PAGE = f"(SELECT *, {_score_sql(['que'])} AS score FROM tokens WHERE {has('que')} ORDER BY file, line_no OFFSET 40 LIMIT 25)"


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no, row_number() OVER (ORDER BY score DESC, file, line_no) AS rank, round(score, 6) AS match_score FROM {_PAGE}")
def ranked_page(spark, sf_dir):
    page = ordered(matches(views.doc_lines(spark, sf_dir), "que"), ["que"], SearchOptions(offset=40, limit=25))
    ranked = rank_page(page, ["que"])
    order = F.row_number().over(Window.orderBy(F.desc("match_score"), "file", "line_no")).cast("long")  # 25 rows
    return ranked.select("file", "line_no", order.alias("rank"), F.round("match_score", 6).alias("match_score"))


@query(f"WITH {views.DOC_TOKENS} SELECT file, line_no, byte_offset FROM tokens WHERE {has('de')} ORDER BY file DESC, line_no DESC OFFSET 10 LIMIT 50")
def page_offset_limit(spark, sf_dir):
    options = SearchOptions(offset=10, limit=50, descending=True)
    return search(views.doc_lines(spark, sf_dir), "de", options).select("file", "line_no", "byte_offset")


@query(f"WITH {views.EVENT_LOG} SELECT file, line_no, content FROM event_log ORDER BY file DESC, line_no DESC LIMIT 50")
def tail_n(spark, sf_dir):
    return last_lines(views.event_log(spark, sf_dir), 50)


_NGINX_DUCK = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*?)"\s+([0-9]+)\s+([0-9]+)(?:\s+"([^"]*?)"\s+"([^"]*?)")?'


def _x(i: int, pattern: str = _NGINX_DUCK) -> str:
    return f"regexp_extract(content, '{pattern}', {i})"


_STATUS_LEVEL = f"CASE WHEN CAST({_x(6)} AS INT) >= 500 THEN 'ERROR' WHEN CAST({_x(6)} AS INT) >= 400 THEN 'WARN' ELSE 'INFO' END"


@query(f"""WITH {views.ACCESS_LOG} SELECT line_no, {_x(1)} AS remote_addr, replace({_x(3)}, '-', '') AS remote_user, strftime(strptime({_x(4)}, '%d/%b/%Y:%H:%M:%S +0000'), '%Y-%m-%d %H:%M:%S') AS ts, string_split({_x(5)}, ' ')[1] AS method, string_split({_x(5)}, ' ')[2] AS path, string_split({_x(5)}, ' ')[3] AS protocol,
CAST({_x(6)} AS BIGINT) AS status, CAST({_x(7)} AS BIGINT) AS bytes, replace({_x(8)}, '-', '') AS referer, {_x(9)} AS user_agent, {_STATUS_LEVEL} AS level, concat(string_split({_x(5)}, ' ')[1], ' ', string_split({_x(5)}, ' ')[2], ' ', {_x(6)}) AS message FROM access_log""")
def parse_nginx(spark, sf_dir):
    found = formats.parse_nginx(views.access_log(spark, sf_dir)).withColumns({"ts": stamp("ts"), "status": F.col("status").cast("long")})
    return found.select("line_no", "remote_addr", "remote_user", "ts", "method", "path", "protocol", "status", "bytes", "referer", "user_agent", "level", "message")


@query(f"""WITH {views.ACCESS_LOG} SELECT line_no, {_x(1)} AS remote_host, replace({_x(2)}, '-', '') AS ident, replace({_x(3)}, '-', '') AS auth_user, strftime(strptime({_x(4)}, '%d/%b/%Y:%H:%M:%S +0000'), '%Y-%m-%d %H:%M:%S') AS ts, string_split({_x(5)}, ' ')[2] AS path,
CAST({_x(6)} AS BIGINT) AS status, CAST({_x(7)} AS BIGINT) AS response_size, {_STATUS_LEVEL} AS level FROM access_log""")
def parse_apache(spark, sf_dir):
    found = formats.parse_apache(views.access_log(spark, sf_dir)).withColumns({"ts": stamp("ts"), "status": F.col("status").cast("long")})
    return found.select("line_no", "remote_host", "ident", "auth_user", "ts", "path", "status", "response_size", "level")


@query(f"""WITH {views.EVENT_JSON} SELECT line_no, strftime(strptime(content ->> '$.timestamp', '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S') AS ts, upper(content ->> '$.level') AS level, content ->> '$.message' AS message, CAST(content ->> '$.user_id' AS BIGINT) AS user_id, CAST(content ->> '$.props.k' AS BIGINT) AS k FROM event_json""")
def parse_json(spark, sf_dir):
    found = formats.parse_json(views.event_json(spark, sf_dir))
    own = lambda path: F.try_variant_get("fields", path, "long")
    return found.select("line_no", stamp("ts").alias("ts"), "level", "message", own("$.user_id").alias("user_id"), own("$.props.k").alias("k"))


_SEVERITY = "['EMERG','ALERT','CRITICAL','ERROR','WARN','NOTICE','INFO','DEBUG'][CAST(regexp_extract(content, '^<([0-9]+)>', 1) AS INT) % 8 + 1]"
_FACILITY = "['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','security','console','clockd'][CAST(regexp_extract(content, '^<([0-9]+)>', 1) AS INT) // 8 + 1]"


@query(f"""WITH {views.SYSLOG}, k AS (SELECT *, CASE WHEN regexp_matches(content, '^<[0-9]+>1 ') THEN 0 WHEN starts_with(content, '<') THEN 1 ELSE 2 END AS kind FROM syslog)
SELECT line_no, CASE kind WHEN 0 THEN strftime(strptime(split_part(content, ' ', 2), '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(strptime(concat('2024 ', regexp_extract(content, '>(.{{15}})', 1)), '%Y %b %d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') ELSE replace(substr(content, 1, 19), 'T', ' ') END AS ts,
CASE WHEN kind < 2 THEN {_SEVERITY} ELSE regexp_extract(content, '\\[(\\w+)\\]', 1) END AS level, CASE WHEN kind = 0 THEN coalesce({_FACILITY}, 'user') END AS facility, CASE WHEN kind < 2 THEN regexp_extract(content, ' (host[0-9])', 1) END AS hostname, CASE WHEN kind = 0 THEN 'app' END AS app_name, regexp_extract(content, 'user=.*') AS message FROM k""")
def parse_syslog(spark, sf_dir):
    found = formats.parse_syslog(views.syslog_lines(spark, sf_dir), 2024)
    return found.select("line_no", stamp("ts").alias("ts"), "level", "facility", "hostname", "app_name", "message")


@query(f"WITH {views.EVENT_LOG} SELECT line_no, replace(substr(content, 1, 19), 'T', ' ') AS ts, regexp_extract(content, '\\[(\\w+)\\]', 1) AS level, CAST(len(string_split(content, ' ')) AS BIGINT) AS n_fields FROM event_log")
def parse_generic(spark, sf_dir):
    found = formats.parse_generic(views.event_log(spark, sf_dir))
    return found.select("line_no", stamp("ts").alias("ts"), "level", F.size("fields").cast("long").alias("n_fields"))


_APACHE_DUCK = _NGINX_DUCK.replace("\\s+([0-9]+)(?:", "\\s+(\\S+)(?:")
_SYSLOG_DUCK = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{8}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?\s+|^(<[0-9]+>)?\w{3}\s+[0-9]{1,2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}\s+\S+\s+|^<[0-9]+>[0-9]+\s+(\S+\s+){5}"


@query(f"""WITH {views.EVENT_LOG}, {views.EVENT_JSON}, {views.ACCESS_LOG},
a AS (SELECT 'access' AS source, content FROM access_log UNION ALL SELECT 'events', content FROM event_log UNION ALL SELECT 'json', content FROM event_json),
s AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE starts_with(trim(content), '{{') AND ends_with(trim(content), '}}')) AS json, count(*) FILTER (WHERE regexp_matches(content, '{_NGINX_DUCK}')) AS nginx,
count(*) FILTER (WHERE regexp_matches(content, '{_APACHE_DUCK}')) AS apache, count(*) FILTER (WHERE regexp_matches(content, '{_SYSLOG_DUCK}')) AS syslog FROM a GROUP BY source)
SELECT *, CASE greatest(json, nginx, apache, syslog) WHEN json THEN 'json' WHEN nginx THEN 'nginx' WHEN apache THEN 'apache' ELSE 'syslog' END AS best,
CASE WHEN json >= total / 4 THEN 'json' WHEN nginx >= total / 4 THEN 'nginx' WHEN apache >= total / 4 THEN 'apache' WHEN syslog >= total / 4 THEN 'syslog' ELSE 'generic' END AS "first" FROM s""")
def detect_format(spark, sf_dir):
    sources = {"access": views.access_log, "events": views.event_log, "json": views.event_json}
    out = None
    for name, view in sources.items():
        scores = formats.format_scores(view(spark, sf_dir))
        both = formats.first_format(formats.best_format(scores).withColumnRenamed("format", "best"))
        row = both.select(F.lit(name).alias("source"), "total", "json", "nginx", "apache", "syslog", "best", F.col("format").alias("first"))
        out = row if out is None else out.unionAll(row)
    return out


RULES = [{"name": "errors", "pattern": "/\\[(ERROR|FATAL)\\]/", "severity": "critical", "cooldown": 3600}, {"name": "purchases", "pattern": "TYPE=PURCHASE", "cooldown": 7200}]
_ALERTS = f"""{views.EVENT_LOG}, alerts AS (SELECT 'errors' AS rule, 'critical' AS severity, 3600 AS cooldown, * FROM event_log WHERE regexp_matches(content, '\\[(ERROR|FATAL)\\]')
UNION ALL SELECT 'purchases', 'warning', 7200, * FROM event_log WHERE contains(lower(content), 'type=purchase')),
timed AS (SELECT *, CAST(replace(substr(content, 1, 19), 'T', ' ') AS TIMESTAMP) AS ts FROM alerts)"""


@query(f"WITH {_ALERTS} SELECT rule, severity, file, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, content[1:200] AS line FROM timed")
def alert_match(spark, sf_dir):
    found = alerts.match_rules(views.event_log(spark, sf_dir), alerts.rules(RULES))
    return found.select("rule", "severity", "file", "line_no", stamp("ts").alias("ts"), "line")


@query(f"""WITH RECURSIVE {_ALERTS}, d AS (SELECT DISTINCT rule, severity, cooldown, CAST(epoch(ts) AS BIGINT) AS t FROM timed),
n AS (SELECT rule, severity, cooldown, min(t) AS t FROM d GROUP BY ALL
UNION ALL SELECT rule, severity, cooldown, (SELECT min(d.t) FROM d WHERE d.rule = n.rule AND d.severity = n.severity AND d.t >= n.t + n.cooldown) AS t FROM n WHERE t IS NOT NULL)
SELECT rule, severity, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS ts FROM n WHERE t IS NOT NULL""")
def alert_cooldown_batch(spark, sf_dir):
    found = alerts.match_rules(views.event_log(spark, sf_dir), alerts.rules(RULES))
    return alerts.notified(found).select("rule", "severity", stamp("ts").alias("ts"))


@query(f"WITH {views.EVENT_LOG} SELECT strftime(date_trunc('day', CAST(replace(substr(content, 1, 19), 'T', ' ') AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS start, CASE regexp_extract(content, '\\[(\\w+)\\]', 1) WHEN 'DEBUG' THEN 'INFO' ELSE regexp_extract(content, '\\[(\\w+)\\]', 1) END AS level, count(*) AS lines FROM event_log GROUP BY ALL")
def daily_levels(spark, sf_dir):
    return level_counts(views.event_log(spark, sf_dir)).withColumn("start", stamp("start"))


@query(f"WITH {views.EVENT_LOG}, {views.ACCESS_LOG}, a AS (SELECT file, line_no, content FROM event_log UNION ALL SELECT file, line_no, content FROM access_log) SELECT file, count(*) AS hits FROM a WHERE contains(lower(content), 'user1 ') OR contains(lower(content), 'user=1 ') GROUP BY file")
def multi_file_search(spark, sf_dir):
    every = views.event_log(spark, sf_dir).unionByName(views.access_log(spark, sf_dir))
    found = every.where(predicate(parse("/user=?1 /")))
    return found.groupBy("file").agg(F.count("*").alias("hits"))


@query(f"WITH {views.DOC_LINES} SELECT file, line_no, md5(content) AS md5, sha256(content) AS sha256, CASE WHEN length(content) > 60 THEN concat(content[1:57], '...') ELSE content END AS shown FROM doc_lines")
def line_digests(spark, sf_dir):
    return views.doc_lines(spark, sf_dir).select("file", "line_no", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), text.shortened(F.col("content"), 60).alias("shown"))

