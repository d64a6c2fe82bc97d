"""Line views over the star-schema tables, each in Spark and as the DuckDB common table expressions that equal it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokens import STOP_WORDS
from .sources.lines import lines_of_column, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("text", F.concat_ws("\n", "url", "html"))
    return lines_of_column(pages, "page_id", "text")


_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
_REST = "concat('user=', user_id, ' type=', event_type, ' value=', CAST(CAST(value AS DECIMAL(12,2)) AS {string}))"
_STATUS = "CASE o_orderkey % 7 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 301 WHEN 6 THEN 503 ELSE 200 END"
_AUTH = "CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE concat('user', o_custkey % 10) END"
_TAIL = "CASE WHEN o_orderkey % 2 = 0 THEN ' \"-\" \"agent/1.0\"' ELSE '' END"
_ACCESS = f"concat('10.0.', o_custkey % 256, '.', o_orderkey % 256, ' - ', {_AUTH}, ' [', {{time}}, ' +0000] \"GET /api/orders/', o_orderkey, ' HTTP/1.1\" ', {_STATUS}, ' ', (o_orderkey * 37) % 100000, {_TAIL})"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each day, one line for each event."""
    content = f"concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ' [', {_LEVEL}, '] ', {_REST.format(string='STRING')})"
    return table(spark, sf_dir, "events").selectExpr("date_format(ts, 'yyyy-MM-dd') AS file", "event_id AS line_no", f"{content} AS content")


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = f"""concat('{{"timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","level":"', lower({_LEVEL}), '","message":"', {_REST.format(string="STRING")}, '","user_id":', user_id, ',"props":', coalesce(props, 'null'), '}}')"""
    return table(spark, sf_dir, "events").selectExpr("date_format(ts, 'yyyy-MM-dd') AS file", "event_id AS line_no", f"{content} AS content")


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirds of RFC 5424, RFC 3164 and application lines."""
    rest = _REST.format(string="STRING")
    content = f"""CASE event_id % 3
      WHEN 0 THEN concat('<', event_id % 192, '>1 ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' host', user_id % 9, ' app - - ', {rest})
      WHEN 1 THEN concat('<', event_id % 192, '>', date_format(ts, 'MMM dd HH:mm:ss'), ' host', user_id % 9, ' ', {rest})
      ELSE concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' [', {_LEVEL}, '] ', {rest}) END"""
    return table(spark, sf_dir, "events").selectExpr("date_format(ts, 'yyyy-MM-dd') AS file", "event_id AS line_no", f"{content} AS content")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _ACCESS.format(time="date_format(o_orderdate, 'dd/MMM/yyyy:HH:mm:ss')")
    return table(spark, sf_dir, "orders").selectExpr("'access.log' AS file", "o_orderkey AS line_no", f"{content} AS content")


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_DUCK_REST = _REST.format(string="VARCHAR")


def _split(source: str, file: str, text: str, name: str) -> str:
    return f"""{name}_all AS (SELECT {file} AS file, strlen({text}) AS file_bytes, unnest(string_split({text}, chr(10))) AS content, generate_subscripts(string_split({text}, chr(10)), 1) AS physical_line_no FROM {source}),
{name}_placed AS (SELECT *, sum(strlen(content) + 1) OVER (PARTITION BY file ORDER BY physical_line_no ROWS UNBOUNDED PRECEDING) - strlen(content) - 1 AS byte_offset FROM {name}_all),
{name} AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY physical_line_no) AS line_no, physical_line_no, CAST(byte_offset AS BIGINT) AS byte_offset, content, file_bytes, count(*) OVER (PARTITION BY file) AS file_lines FROM {name}_placed WHERE content <> '')"""


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_NONE = "CAST([] AS VARCHAR[])"


def tokens_sql(lines: str, name: str = "tokens") -> str:
    """CTE with every line's terms."""
    parts = f"""list_concat(list_concat([t], CASE WHEN contains(t, '/') THEN list_filter(string_split(t, '/'), lambda p: length(p) >= 2) ELSE {_NONE} END),
    list_concat(CASE WHEN contains(t, '.') AND NOT starts_with(t, '.') AND len(string_split(t, '.')) >= 3 AND NOT list_contains(string_split(t, '.'), '') THEN list_filter(string_split(t, '.'), lambda p: length(p) >= 2 AND NOT regexp_full_match(p, '[0-9]+')) ELSE {_NONE} END,
    CASE WHEN contains(t, '-') AND length(t) > 4 THEN list_filter(string_split(t, '-'), lambda p: length(p) >= 2 AND NOT list_contains({_STOPS}, lower(p))) ELSE {_NONE} END))"""
    kept = f"list_filter(regexp_extract_all(content, '[\\w.\\-/]+'), lambda t: length(t) >= 2 AND NOT list_contains({_STOPS}, lower(t)) AND NOT regexp_full_match(t, '[.\\-/]+'))"
    return f"{name} AS (SELECT *, list_distinct(list_transform(flatten(list_transform({kept}, lambda t: {parts})), lambda x: lower(x))) AS terms FROM {lines})"


DOC_LINES = _split("documents", "doc_id", "text", "doc_lines")
PAGE_LINES = _split("(SELECT page_id, concat_ws(chr(10), url, html) AS text FROM pages)", "page_id", "text", "page_lines")
DOC_TOKENS = DOC_LINES + ",\n" + tokens_sql("doc_lines")
PAGE_TOKENS = PAGE_LINES + ",\n" + tokens_sql("page_lines")
EVENT_LOG = f"event_log AS (SELECT strftime(ts, '%Y-%m-%d') AS file, event_id AS line_no, concat({_ISO}, ' [', {_LEVEL}, '] ', {_DUCK_REST}) AS content FROM events)"
EVENT_JSON = f"""event_json AS (SELECT strftime(ts, '%Y-%m-%d') AS file, event_id AS line_no, concat('{{"timestamp":"', {_ISO}, '","level":"', lower({_LEVEL}), '","message":"', {_DUCK_REST}, '","user_id":', user_id, ',"props":', coalesce(props, 'null'), '}}') AS content FROM events)"""
SYSLOG = f"""syslog AS (SELECT event_id AS line_no, CASE event_id % 3
  WHEN 0 THEN concat('<', event_id % 192, '>1 ', {_ISO}, ' host', user_id % 9, ' app - - ', {_DUCK_REST})
  WHEN 1 THEN concat('<', event_id % 192, '>', strftime(ts, '%b %d %H:%M:%S'), ' host', user_id % 9, ' ', {_DUCK_REST})
  ELSE concat({_ISO}, ' [', {_LEVEL}, '] ', {_DUCK_REST}) END AS content FROM events)"""
ACCESS_LOG = f"access_log AS (SELECT 'access.log' AS file, o_orderkey AS line_no, {_ACCESS.format(time="strftime(o_orderdate, '%d/%b/%Y:%H:%M:%S')")} AS content FROM orders)"
