"""Log formats: parsers as columns of built-in expressions, and detection by one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: patterns, names and field lists that decide what a line is read as
NGINX = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*?)"\s+(\d+)\s+(\d+)(?:\s+"([^"]*?)"\s+"([^"]*?)")?'
APACHE = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*?)"\s+(\d+)\s+(\S+)(?:\s+"([^"]*?)"\s+"([^"]*?)")?'
ISO_ZONED = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
RFC5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)"
RFC3164 = r"^(?:<(\d+)>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)"
COMMON = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(?:\[?(\w+)\]?\s+)?(.*)"
CONTAINER = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z"
GENERIC_LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|ERR|FATAL|CRITICAL|SEVERE)\b"
FACILITIES = ["kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "clockd"]
SEVERITIES = ["EMERG", "ALERT", "CRITICAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
TIME_KEYS = ["timestamp", "time", "@timestamp", "ts", "date", "datetime"]
LEVEL_KEYS = ["level", "severity", "log.level", "logLevel"]
MESSAGE_KEYS = ["message", "msg", "text", "body", "content"]
# ---- end of fixed values

FORMATS = ["json", "nginx", "apache", "kubernetes", "docker", "syslog"]


def group(content: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(content, pattern, i)


def groups(content: Column, pattern: str, n: int) -> Column:
    """An array that holds the pattern's n groups as one array, or nothing if the line does not match: one evaluation for all of them.

    The groups are written with a separator between them; a line that holds the separator itself is read group by group.
    """
    text = "array<array<string>>"
    parts = F.split(F.regexp_replace(content, pattern + r"[\s\S]*+", "\x1f".join(f"${i}" for i in range(1, n + 1))), "\x1f", -1)
    slow = F.when(content.rlike(pattern), F.array(F.array(*(F.regexp_extract(content, pattern, i) for i in range(1, n + 1)))).cast(text)).otherwise(F.array().cast(text))
    return F.when(F.contains(content, F.lit("\x1f")), slow).otherwise(F.filter(F.array(parts), lambda g: F.size(g) == n))


def present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def dash_empty(value: Column) -> Column:
    return F.when(value == "-", F.lit("")).otherwise(value)


def dash_null(value: Column) -> Column:
    return F.when(value != "-", value)


def access_time(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def iso_time(value: Column) -> Column:
    """An ISO time with or without fraction and zone; UTC where there is none."""
    return F.try_to_timestamp(F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def status_level(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def is_json(content: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(content, r"^\s+|\s+$", ""))
    return F.startswith(trimmed, F.lit("{")) & F.endswith(trimmed, F.lit("}"))


def tests(content: Column) -> dict[str, Column]:
    """What each format says of a line, most specific first."""
    syslog = content.rlike(RFC5424) | content.rlike(RFC3164) | content.rlike(COMMON)
    return dict(zip(FORMATS, [is_json(content), content.rlike(NGINX), content.rlike(APACHE), content.rlike(CONTAINER + r"\s+\w+"), content.rlike(CONTAINER), syslog], strict=True))


def parse_nginx(lines: DataFrame) -> DataFrame:
    found = lines.select("*", F.explode_outer(groups(F.col("content"), NGINX, 9)).alias("_g")).where("_g IS NOT NULL")
    g = lambda i: F.col("_g")[i - 1]
    parts = F.split(g(5), " ", -1)
    whole = F.size(parts) == 3
    status = g(6).cast("int")
    part = lambda i: F.when(whole, F.element_at(parts, i))
    return found.withColumns({
        "format": F.lit("nginx"), "ts": access_time(g(4)), "remote_addr": g(1), "remote_user": dash_empty(g(3)), "time_local": g(4), "request": g(5),
        "method": part(1), "path": part(2), "protocol": part(3), "status": status, "bytes": g(7).cast("long"), "referer": dash_empty(g(8)), "user_agent": g(9), "level": status_level(status),
    }).withColumn("message", F.concat_ws(" ", "method", "path", F.col("status").cast("string"))).drop("_g")


def parse_apache(lines: DataFrame) -> DataFrame:
    found = lines.select("*", F.explode_outer(groups(F.col("content"), APACHE, 9)).alias("_g")).where("_g IS NOT NULL")
    g = lambda i: F.col("_g")[i - 1]
    parts = F.split(g(5), " ", -1)
    part = lambda i: F.when(F.size(parts) >= 2, F.element_at(parts, i))
    status = g(6).cast("int")
    return found.withColumns({
        "format": F.lit("apache"), "ts": access_time(g(4)), "remote_host": g(1), "ident": dash_empty(g(2)), "auth_user": dash_empty(g(3)), "request": g(5), "method": part(1), "path": part(2),
        "status": status, "response_size": F.when(g(7) == "-", F.lit(0)).otherwise(F.expr("try_cast(_g[6] AS bigint)")), "level": status_level(status),
    }).withColumn("message", F.concat_ws(" ", "method", "path", F.col("status").cast("string"))).drop("_g")


def parse_json(lines: DataFrame) -> DataFrame:
    """Objects only; the parsed object stays whole beside the normalised columns, as column ``fields``."""
    parsed = lines.where(F.startswith(F.ltrim("content"), F.lit("{"))).withColumn("fields", F.try_parse_json(F.trim("content"))).where("fields IS NOT NULL")
    get = lambda key, kind: F.try_variant_get("fields", f"$['{key}']", kind)
    kind = lambda key: F.schema_of_variant(F.try_variant_get("fields", f"$['{key}']", "variant"))

    def moment(key: str) -> Column:
        number = F.when(kind(key).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), get(key, "double"))
        return F.coalesce(iso_time(F.when(kind(key) == "STRING", get(key, "string"))), F.when(number != 0, F.timestamp_millis(number.cast("long"))))

    number = lambda key: get(key, "double")
    banded = lambda n: F.when(n <= 10, "TRACE").when(n <= 20, "DEBUG").when(n <= 30, "INFO").when(n <= 40, "WARN").when(n <= 50, "ERROR").otherwise("FATAL")
    level = lambda k: F.when(kind(k) == "STRING", F.upper(get(k, "string"))).when(kind(k).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), banded(number(k)))
    return parsed.withColumns({
        "format": F.lit("json"), "ts": F.coalesce(*map(moment, TIME_KEYS)), "level": F.coalesce(*map(level, LEVEL_KEYS)),
        "message": F.coalesce(*(F.when(kind(k) == "STRING", get(k, "string")) for k in MESSAGE_KEYS)),
    })


def parse_syslog(lines: DataFrame, year: int) -> DataFrame:
    """RFC 5424, RFC 3164 (whose times get ``year``) or a line that begins with an ISO time."""
    c = F.col("content")
    named = lambda k: lambda g: F.struct(F.lit(k).alias("kind"), g.alias("g"))
    tried = [F.transform(groups(c, p, n), named(k)) for k, (p, n) in enumerate(((RFC5424, 8), (RFC3164, 4), (COMMON, 3)))]
    first = F.when(F.size(tried[0]) > 0, tried[0]).when(F.size(tried[1]) > 0, tried[1]).otherwise(tried[2])
    found = lines.select("*", F.inline_outer(first).alias("_kind", "_g")).where("_g IS NOT NULL")
    g = lambda i: F.try_element_at("_g", F.lit(i))
    new, old = F.col("_kind") == 0, F.col("_kind") == 1
    priority = F.coalesce(F.when(new | old, F.expr("try_cast(nullif(try_element_at(_g, 1), '') AS int)")), F.when(old, F.lit(0)))
    names = lambda values, i: F.try_element_at(F.array(*map(F.lit, values)), i + 1)
    severity = names(SEVERITIES, priority.bitwiseAND(F.lit(7)))
    old_time = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(g(2), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    either = lambda a, b, z: F.when(new, a).when(old, b).otherwise(z)
    none = F.lit(None).cast("string")
    return found.withColumns({
        "format": F.lit("syslog"),
        "ts": either(iso_time(g(3)), old_time, iso_time(g(1))),
        "level": either(severity, severity, F.upper(present(g(2)))),
        "facility": F.when(new, F.coalesce(names(FACILITIES, F.shiftright(priority, 3)), F.lit("user"))),
        "severity": F.when(new, severity),
        "hostname": either(dash_null(g(4)), g(3), none),
        "app_name": F.when(new, dash_null(g(5))), "proc_id": F.when(new, dash_null(g(6))), "msg_id": F.when(new, dash_null(g(7))),
        "message": either(g(8), g(4), g(3)),
    }).drop("_kind", "_g")


def parse_generic(lines: DataFrame, year: int = 1970) -> DataFrame:
    """Every line: its first time (one without a year gets ``year``), level word and fields between white space."""
    c = F.col("content")
    level = F.upper(present(group(c, GENERIC_LEVEL, 1)))
    day = F.try_to_timestamp(group(c, r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}", 0), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    month = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(group(c, r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", 0), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return lines.withColumns({
        "format": F.lit("generic"), "ts": F.coalesce(iso_time(group(c, ISO_ZONED, 0)), day, month),
        "level": F.when(level == "WARNING", "WARN").when(level.isin("ERR", "SEVERE"), "ERROR").otherwise(level),
        "message": c, "fields": F.filter(F.split(c, r"\s+"), lambda f: f != ""),
    })


def parse_container(lines: DataFrame, kind: str = "docker") -> DataFrame:
    """Container lines: a time with a fraction, an optional level word and the rest."""
    c, pattern = F.col("content"), rf"({CONTAINER[1:]})\s*(?:\[?(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\]?\s+)?(.*)"
    return lines.where(c.rlike(CONTAINER)).withColumns({"format": F.lit(kind), "ts": iso_time(group(c, pattern, 1)), "level": present(group(c, pattern, 2)), "message": group(c, pattern, 3)})


def format_scores(lines: DataFrame) -> DataFrame:
    """One row: lines that are not blank, and how many of them each format reads."""
    shown = lines.where(F.regexp_replace("content", r"\s", "") != "")
    return shown.agg(F.count("*").alias("total"), *(F.count_if(t).alias(f) for f, t in tests(F.col("content")).items()))


def best_format(scores: DataFrame) -> DataFrame:
    """Column ``format``: the highest score of at least 30 % of the lines, the more specific of equals; else generic."""
    order = [F.struct(F.col(f).alias("score"), F.lit(-i).alias("rank"), F.lit(f).alias("name")) for i, f in enumerate(FORMATS)]
    best = F.array_max(F.filter(F.array(*order), lambda s: (s["score"] > 0) & (s["score"] >= F.col("total") * 0.3)))
    return scores.select("*", F.coalesce(best["name"], F.lit("generic")).alias("format"))


def first_format(scores: DataFrame) -> DataFrame:
    """Column ``format``: the most specific that reads a quarter of the lines and one at least; else generic."""
    need = F.greatest(F.lit(1.0), F.col("total") * 0.25)
    return scores.select("*", F.coalesce(*(F.when(F.col(f) >= need, f) for f in FORMATS), F.lit("generic")).alias("format"))


def detect_format(lines: DataFrame, sample: int = 200) -> str:
    """The format of lines by the first ``sample`` of them."""
    return best_format(format_scores(lines.where(F.col("line_no") <= sample))).first().format


PARSERS = {"nginx": parse_nginx, "apache": parse_apache, "json": parse_json, "generic": parse_generic, "docker": parse_container, "kubernetes": lambda lines: parse_container(lines, "kubernetes")}


def parse_as(lines: DataFrame, kind: str, year: int = 1970) -> DataFrame:
    return {"syslog": parse_syslog, "generic": parse_generic}[kind](lines, year) if kind in ("syslog", "generic") else PARSERS[kind](lines)
