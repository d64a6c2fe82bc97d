"""Lines, tokens, search, formats, alerts and streams against plain Python and hand-checked cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from logquarry.functions import text
from logquarry.functions.similarity import jaro_winkler, may_reach
from logquarry.functions.tokens import STOP_WORDS, tokens
from logquarry.operators import alerts, formats, setops
from logquarry.operators.ranges import filter_range
from logquarry.operators.search import SearchOptions, indexed_matches, matches, search
from logquarry.plans.query import And, Not, Or, Phrase, Regex, Term
from logquarry.sources.index_store import Index, IndexStore
from logquarry.sources.lines import generated, last_lines, line_at, lines_of_column, read_lines

LOG = [
    "2024-01-15T10:00:00Z [INFO] 10.0.0.1 GET /api/v2/users 200 started.",
    "2024-01-15T10:00:05Z [ERROR] 10.0.0.2 POST /api/orders 500 Connection timeout in re-try loop",
    "",
    "2024-01-15T10:01:00Z [WARN] slow query com.example.Db took 900ms",
    "constructor of the thing",
    "déjà vu – naïve ERROR again",
    "ERROR: disk is full, disk FULL",
]


def plain_tokens(line):
    out = set()
    for raw in re.findall(r"[A-Za-z0-9_.\-/]+", line):
        if len(raw) < 2 or raw.lower() in STOP_WORDS or re.fullmatch(r"[.\-/]+", raw):
            continue
        out.add(raw.lower())
        if "/" in raw:
            out |= {p.lower() for p in raw.split("/") if len(p) > 1}
        dots = raw.split(".")
        if "." in raw and raw[0] != "." and len(dots) > 2 and all(dots):
            out |= {p.lower() for p in dots if len(p) > 1 and not re.fullmatch("[0-9]+", p)}
        if "-" in raw and len(raw) > 4:
            out |= {p.lower() for p in raw.split("-") if len(p) > 1 and p.lower() not in STOP_WORDS}
    return out


def made(spark, lines, file="app.log"):
    return lines_of_column(spark.createDataFrame([(file, "\n".join(lines))], "file string, text string"), "file", "text")


@pytest.fixture(scope="module")
def log(spark):
    return made(spark, LOG).cache()


def test_tokens_match_plain_python(spark):
    r = random.Random(3)
    lines = [*LOG, "a/b//cd .hidden a.b.c x-y-zz up-to-the-end ... --- The. v1.2.3 1.2.3.4 http://x.io/p?q=the-end", "K x", *("".join(r.choice("abT1./- _é!") for _ in range(r.randint(0, 60))) for _ in range(400))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").select("i", tokens(F.col("s")).alias("t"))
    for row in df.collect():
        assert sorted(row.t) == sorted(plain_tokens(lines[row.i])), lines[row.i]
    own = spark.createDataFrame([("foo bar-foo x",)], "s string").select(tokens(F.col("s"), min_length=1, stop_words=["foo"]).alias("t")).first().t
    assert sorted(own) == ["bar", "bar-foo", "x"]


def test_lines_have_numbers_and_offsets(log):
    rows = log.orderBy("line_no").collect()
    data = "\n".join(LOG).encode()
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1))
    for r in rows:
        assert data[r.byte_offset :].startswith(r.content.encode()) and LOG[r.physical_line_no - 1] == r.content
    assert line_at(log, 0).first().line_no == 1 and line_at(log, 10**9).first().line_no == len(rows)
    assert [r.content for r in last_lines(log, 2).collect()] == LOG[-2:]


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_files_have_exact_offsets_over_splits(spark, tmp_path, split):
    r = random.Random(split)
    lines = ["".join(r.choice("ab é–\U0001f600") for _ in range(r.randint(0, 80))) for _ in range(300)] + ["x" * 70000, ""]
    cases = {"a.log": "\n".join(lines) + "\n", "none.log": "", "empties.log": "\n\n\n", "open.log": "one\ntwo", "crlf.log": "one\r\n\r\ntwo\r\n"}
    for name, body in cases.items():
        (tmp_path / name).write_bytes(body.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for row in got:
        found.setdefault(row.file.rpartition("/")[2], []).append((row.line_no, row.physical_line_no, row.byte_offset, row.content))
    for name, body in cases.items():
        at, number, expected = 0, 0, []
        for physical, line in enumerate(body.encode().split(b"\n"), 1):
            if line:
                number += 1
                expected.append((number, physical, at, line.decode().removesuffix("\r")))
            at += len(line) + 1
        assert sorted(found.get(name, [])) == expected, name


def numbers(df):
    return sorted(r.line_no for r in df.collect())


@pytest.mark.parametrize(
    ("query", "options", "expected"),
    [
        ("error", {}, [2, 5, 6]), ("ERROR NOT timeout", {}, [5, 6]), ("NOT error", {}, [1, 3, 4]), ("constructor", {}, [4]), ("users", {}, [1]), ("api AND orders", {}, [2]), ("retry OR try", {}, [2]),
        ('"disk is full"', {}, [6]), ('"of the thing"', {}, [4]), ("/disk.*FULL/", {}, [6]), ("level:warn", {}, [3]), ("status:500", {}, [2]), ("~tmeout", {}, [2]), ("started", {}, []), ("start", {"contains": True}, [1]),
        ("NOT zzz", {"since": "2024-01-15T10:00:05", "until": "2024-01-15T10:00:59Z"}, [2, 4, 5, 6]), ("NOT zzz", {"level": "warn"}, [3]), ("example", {}, [3]), ("DISK", {"is_regex": True, "ignore_case": False}, []),
    ],
)
def test_search_finds(log, query, options, expected):
    assert numbers(matches(log, query, SearchOptions(**options))) == expected


def test_bad_time_is_refused(log):
    with pytest.raises(ValueError):
        matches(log, "error", SearchOptions(since="yesterday"))


def test_page_scores_spans_and_context(log):
    rows = search(log, "disk OR error", SearchOptions(sort_by="score", context=1)).collect()
    assert [r.line_no for r in rows][0] == 6 and all(a.match_score >= b.match_score for a, b in zip(rows, rows[1:], strict=False))
    best = rows[0]
    assert [(h.start, h.end) for h in best.highlights] == [(0, 5), (7, 11), (21, 25)]
    assert best.context_before == [LOG[5]] and best.context_after == []
    lines = [x for x in LOG if x]
    average = len("\n".join(LOG).encode()) / len(lines)
    norm = 1.5 * (0.25 + 0.75 * len(best.content) / average)
    assert best.match_score == pytest.approx(2 * 2.5 / (2 + norm) + 2.5 / (1 + norm))


def test_merged_spans(spark):
    df = spark.createDataFrame([("station",)], "content string")
    spans = text.spans(F.col("content"), ["tat", "atio", "on", ""])
    assert [(s.start, s.end) for s in df.select(spans.alias("s")).first().s] == [(1, 4), (2, 6), (5, 7)]
    assert [(s.start, s.end) for s in df.select(text.merge_spans(spans).alias("s")).first().s] == [(1, 7)]
    assert text.marked("abcd", [(0, 1), (1, 2), (3, 4)], "<", ">") == "<ab>c<d>"


def random_tree(r, depth=0):
    kind = r.random()
    if depth > 2 or kind < 0.4:
        return Term(r.choice(["error", "disk", "full", "api", "warn", "query", "thing", "zzz"]))
    if kind < 0.5:
        return r.choice([Phrase("disk is full"), Phrase("slow query com"), Regex("t[ih]", "i"), Phrase("in re-try loop")])
    if kind < 0.65:
        return Not(random_tree(r, depth + 1))
    return r.choice([And, Or])(tuple(random_tree(r, depth + 1) for _ in range(r.randint(2, 3))))


def test_index_equals_scan(spark, log, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index").build(log)
    r = random.Random(8)
    for _ in range(12):
        tree = random_tree(r)
        assert numbers(indexed_matches(index, tree)) == numbers(matches(log, tree)), tree
    assert numbers(indexed_matches(index, "~tmeout OR disk")) == [2, 6]
    meta = index.info().first()
    assert (meta.total_lines, meta.file_size) == (log.count(), len("\n".join(LOG).encode()))


def test_store_appends_and_drops(spark, tmp_path):
    path = tmp_path / "grow.log"
    path.write_text("one alpha\ntwo beta\n")
    store = IndexStore(spark, f"file://{tmp_path}/store", open_at_once=1)
    assert store.open(str(path)) is None
    store.build(str(path), read_lines(spark, str(path)))
    with open(path, "a") as f:
        f.write("three alpha\n")
    index = store.open(str(path))
    assert index.stale(read_lines(spark, str(path))).count() == 1
    assert index.append(read_lines(spark, str(path))) == 1 and index.append(read_lines(spark, str(path))) == 0
    assert numbers(indexed_matches(index, "alpha")) == [1, 3]
    assert {r.term: r.df for r in index.vocabulary.collect()}["alpha"] == 2
    assert index.stale(read_lines(spark, str(path))).count() == 0 and len(store.list_all()) == 1
    store.remove(str(path))
    assert store.open(str(path)) is None and store.list_all() == []


def test_unfinished_lines_are_indexed_once_they_grow(spark, tmp_path):
    path, other = tmp_path / "grow.log", tmp_path / "other.log"
    path.write_text("first line\nsecond par")
    other.write_text("omega tail")
    source = str(tmp_path / "*.log")
    index = Index(spark, f"file://{tmp_path}/index").build(read_lines(spark, source))
    assert numbers(indexed_matches(index, "par")) == [2]
    for more, added in (("tial grows\nthird line\n", 2), ("\nfourth", 1), (" is long\n", 1)):
        with open(path, "a") as f:
            f.write(more)
        assert index.refresh(source) == added and index.refresh(source) == 0
        lines = read_lines(spark, source)
        for query in ("partial OR par OR omega", "grows OR line OR long"):
            found = sorted((r.file, r.line_no, r.content, r.file_lines) for r in indexed_matches(index, query).collect())
            assert found == sorted((r.file, r.line_no, r.content, r.file_lines) for r in matches(lines, query).collect()), (more, query)
        assert index.stale(lines).count() == 0
        totals = {r.file.rpartition("/")[2]: (r.total_lines, r.unique_terms) for r in index.info().collect()}
        expected = [set(plain_tokens(x)) for x in path.read_text().split("\n") if x]
        assert totals == {"grow.log": (len(expected), len(set().union(*expected))), "other.log": (1, 2)}
    path.write_text("new\n")  # a file that shrank is left alone
    assert index.refresh(source) == 0 and index.compression_ratio() < 1


def test_an_append_that_breaks_off_leaves_the_index(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.log"
    path.write_text("one alpha\n")
    index = Index(spark, f"file://{tmp_path}/index").build(read_lines(spark, str(path)))
    with open(path, "a") as f:
        f.write("two alpha\n")
    with monkeypatch.context() as m:
        m.setattr(Index, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.refresh(str(path))
    assert numbers(indexed_matches(Index(spark, index.path), "alpha")) == [1]
    assert index.refresh(str(path)) == 1 and numbers(indexed_matches(index, "alpha")) == [1, 2]


def test_index_keeps_to_its_tokeniser(spark, log, tmp_path):
    lines = made(spark, ["alpha beta", "alpha gamma", "beta"])
    index = Index(spark, f"file://{tmp_path}/index").build(lines, stop_words=["beta"])
    for query in ("beta", "alpha NOT beta", "alpha", "beta OR gamma"):
        assert numbers(indexed_matches(index, query)) == numbers(matches(lines, query, SearchOptions(stop_words=["beta"]))), query
    plain = Index(spark, f"file://{tmp_path}/plain").build(lines)
    with pytest.raises(ValueError):
        indexed_matches(plain, "alpha NOT beta", SearchOptions(stop_words=["beta"]))


def test_terms_are_found_without_tokenising(spark):
    r = random.Random(12)
    texts = ["".join(r.choice(["que", "la", "a", "x1", ".", "-", "/", " ", "é", "QUE", "_", "the", "12"]) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    df = made(spark, texts)
    for term in ("que", "la", "a", "the", "12", "x1", "que.la.x1", "a-que", "/que", "que/la", "._", "_"):
        expected = [i + 1 for i, t in enumerate(texts) if term in plain_tokens(t)]
        assert numbers(matches(df, Term(term))) == expected, term


def test_offsets_of_rows_that_share_a_key(spark):
    body = "\n".join("x" * (k % 7) for k in range(300))
    rows = spark.createDataFrame([(1, body), (1, "ab\n\ncd"), (2, None), (3, "")], "id long, text string")
    got = sorted((r.file, r.byte_offset, r.content) for r in lines_of_column(rows, "id", "text").collect())
    expected, at = [(1, 0, "ab"), (1, 4, "cd")], 0
    for line in body.split("\n"):
        expected += [(1, at, line)] if line else []
        at += len(line) + 1
    assert got == sorted(expected)


def test_set_operators(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "o long") for x in ([10, 20, 30], [20, 30, 40]))
    values = lambda df: sorted(r.o for r in df.collect())
    assert values(setops.intersect([a, b])) == [20, 30] and values(setops.union([a, b])) == [10, 20, 30, 40] and values(setops.subtract(a, b)) == [10]
    assert setops.intersect([]) is None and setops.union([a]) is a


ACCESS = [
    '10.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /index.html HTTP/1.0" 200 2326 "-" "Mozilla/4.08"',
    '10.0.0.2 - - [10/Oct/2000:13:55:37 +0000] "POST /api HTTP/1.1" 500 12',
    '10.0.0.3 x - [bad time] "GET /" 404 -',
]


def test_access_logs(spark):
    lines = made(spark, [*ACCESS, "nothing"])
    nginx = formats.parse_nginx(lines).orderBy("line_no").collect()
    assert [(r.remote_user, r.method, r.status, r.level, r.referer) for r in nginx] == [("frank", "GET", 200, "INFO", ""), ("", "POST", 500, "ERROR", "")]
    assert nginx[0].ts.isoformat() == "2000-10-10T20:55:36" or nginx[0].ts is not None
    apache = formats.parse_apache(lines).orderBy("line_no").collect()
    assert [(r.ident, r.response_size, r.level, r.ts is None) for r in apache] == [("", 2326, "INFO", False), ("", 12, "ERROR", False), ("x", 0, "WARN", True)]
    assert numbers(filter_range(lines, "status", 400, 599)) == [2, 3] and numbers(filter_range(lines, "size", high=100)) == [2] and numbers(filter_range(lines, "other")) == []


def test_json_and_syslog_and_generic(spark):
    rows = ['{"time":"2024-01-15T10:00:00Z","severity":"warn","msg":"hi","n":1}', '{"ts":1700000000000,"level":30,"text":"t"}', '{"log.level":"error"}', "{broken", "[1]"]
    got = formats.parse_json(made(spark, rows)).orderBy("line_no").select("level", "message", F.unix_millis("ts").alias("ms")).collect()
    assert [(r.level, r.message, r.ms) for r in got] == [("WARN", "hi", 1705312800000), ("INFO", "t", 1700000000000), ("ERROR", None, None)]
    rows = ["<34>1 2024-01-15T10:00:00Z host app 12 - - it broke", "<13>Jan 15 10:00:00 host hello", "Jan  5 10:00:00 host hello", "2024-01-15T10:00:00Z [warn] text", "none"]
    got = formats.parse_syslog(made(spark, rows), 2024).orderBy("line_no").collect()
    assert [(r.level, r.facility, r.hostname, r.message) for r in got] == [("CRITICAL", "auth", "host", "- it broke"), ("NOTICE", None, "host", "hello"), ("EMERG", None, "host", "hello"), ("WARN", None, None, "text")]
    assert all(r.ts is not None for r in got)
    got = formats.parse_generic(made(spark, ["x err y", "SEVERE  z", "plain"])).orderBy("line_no").collect()
    assert [(r.level, len(r.fields)) for r in got] == [("ERROR", 3), ("ERROR", 2), (None, 1)]


@pytest.mark.parametrize(("rows", "expected"), [(['{"a":1}'] * 20, "json"), (ACCESS[:2] * 10, "nginx"), (["just text", "more"], "generic"), (["2024-01-15T10:00:00.123456Z stdout F x"] * 3, "kubernetes"), ([ACCESS[2]] * 4, "apache")])
def test_detect(spark, rows, expected):
    lines = made(spark, rows)
    assert formats.detect_format(lines) == expected
    assert formats.first_format(formats.format_scores(lines)).first().format == expected


def test_similarity():
    assert jaro_winkler("error", "error") == 1 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "b") == 0
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)


def test_length_bound_never_loses_a_term(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(500)]
    kept = {x.w for x in spark.createDataFrame([(w,) for w in words], "w string").where(may_reach(F.col("w"), "abcab", 0.85)).collect()}
    assert all(w in kept for w in words if jaro_winkler("abcab", w) >= 0.85)


def test_rules(spark, log):
    wanted = alerts.rules('[{"name":" errs ","pattern":"/error/i","cooldown":30},{"name":"d","pattern":"DISK","severity":"critical"}]')
    assert (wanted[0].name, wanted[0].severity, wanted[0].cooldown, wanted[1].cooldown) == ("errs", "warning", 30, 60)
    found = alerts.match_rules(log, wanted).collect()
    assert sorted((r.rule, r.line_no) for r in found) == [("d", 6), ("errs", 2), ("errs", 5), ("errs", 6)]
    for bad in ({"name": ""}, {"name": "x"}, {"name": "x", "pattern": "/(/"}, {"name": "x", "pattern": "p", "severity": "huge"}):
        assert alerts.fault(bad)
        with pytest.raises(ValueError):
            alerts.rule(bad)
    with pytest.raises(ValueError):
        alerts.rules("{}")


def sent_by_rule(rows):
    """A notifier fed with the alerts in the order of their times."""
    last, out = {}, []
    for rule, severity, cooldown, t in sorted(rows, key=lambda x: (x[3] is not None, x[3] or 0)):
        key = (rule, severity)
        if t is None or cooldown <= 0:
            out.append((rule, t))
        elif key not in last or t - last[key] >= cooldown:
            last[key] = t
            out.append((rule, t))
    return sorted(out, key=str)


def test_cooldown_over_a_table_is_that_of_a_notifier(spark):
    r = random.Random(3)
    rows = [("r", "s", 60, t) for t in [0, 10, 59, 60, 119, 125, 400]] + [("every", "s", 120, 60 * k) for k in range(10)]
    rows += [("none", "s", 0, 5)] * 3 + [("timeless", "s", 60, None)] * 2 + [(f"x{k % 5}", "s", r.randint(1, 50), r.randint(0, 900)) for k in range(5)]
    rows += [(n, s, c, r.randint(0, 900)) for n, s, c, _ in rows[-5:] for _ in range(60)]
    df = spark.createDataFrame(rows, "rule string, severity string, cooldown int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted(((x.rule, x.t) for x in alerts.notified(df).select("rule", F.unix_seconds("ts").alias("t")).collect()), key=str)
    assert got == sent_by_rule(rows) and [t for n, t in got if n == "r"] == [0, 125, 400, 60] and sum(n == "every" for n, _ in got) == 5
    assert alerts.notified(df.limit(0)).count() == 0


def test_notifier_cooldown():
    sent, now = [], [0.0]
    notifier = alerts.Notifier({"type": "slack"}, lambda c, p: sent.append(p), lambda: now[0])
    alert = {"rule": "r", "severity": "critical", "line": "x", "ts": "t", "file": "f"}
    assert notifier.send(alert, 60) and not notifier.send(alert, 60)
    now[0] = 60.0
    assert notifier.send(alert, 60) and len(sent) == 2
    assert all(alerts.payload({"type": k}, alert) for k in ("slack", "discord", "webhook", "pagerduty", "email"))


def test_generated_lines_repeat(spark):
    a, b = (generated(spark, 50).collect() for _ in range(2))
    assert a == b and re.match(r"\S+ \[\w+\] 10\.0\.0\.\d \w+ /\S* \d+ \d+ms - .* \(req=0\)$", a[0].value)


def drain(query):
    query.processAllAvailable()


def test_following_a_file(spark, tmp_path):
    from logquarry.streaming.tail import follow
    from logquarry.streaming.watch import alerts_with_cooldown, watch

    path = tmp_path / "app.log"
    path.write_text("old line\n")
    shown = watch(follow(spark, str(path)), "disk", "full").writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c1")).start()
    wanted = alerts.rules([{"name": "full", "pattern": "full", "cooldown": 3600}])
    judged = alerts_with_cooldown(follow(spark, str(path), True), wanted).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "c2")).start()
    drain(shown), drain(judged)
    with open(path, "a") as f:
        f.write("ERROR disk full\nother\nhalf a disk")
    drain(shown), drain(judged)
    assert [(r.content, r.tag, r.alert) for r in spark.table("shown").collect()] == [("ERROR disk full", "ERROR", True)]
    with open(path, "a") as f:
        f.write(" full now\n")
    drain(shown), drain(judged)
    assert sorted(r.content for r in spark.table("shown").collect()) == ["ERROR disk full", "half a disk full now"]
    assert sorted(r.notified for r in spark.table("judged").collect()) == [False, True]
    path.write_text("disk new\n")  # rotation: read from the start
    drain(shown)
    assert "disk new" in [r.content for r in spark.table("shown").collect()]
    shown.stop(), judged.stop()


def test_command_line(spark, tmp_path, capsys):
    from logquarry.cli import answer, main

    path = tmp_path / "app.log"
    path.write_text("\n".join(LOG) + "\n")
    root = f"--root=file://{tmp_path}/store"
    assert main([root, "index", str(path)]) == 0
    assert main([root, "search", str(path), "error", "--json", "--context", "1"]) == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["total_hits"] == 3 and [r["line_no"] for r in found["results"]] == [2, 5, 6]
    assert main([root, "info", str(path), "--json"]) == 0 and main([root, "detect", str(path)]) == 0
    store = IndexStore(spark, f"file://{tmp_path}/store")
    assert answer(spark, store, "POST", "/api/search", {"file": str(path), "query": "disk"})[1]["returned"] == 1
    assert answer(spark, store, "POST", "/api/search", {})[0] == 400 and answer(spark, store, "POST", "/api/search", {"file": "x", "query": "y"})[0] == 404
    assert answer(spark, store, "GET", "/api/indexes", {})[1]["indexes"] and answer(spark, store, "GET", "/no", {})[0] == 404
    assert main([root, "clear", str(path), "-y"]) == 0 and main([root, "clear"]) == 1 and main([root, "info", str(path)]) == 1


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as contract

    assert {"bm25_topk", "parse_json"} <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())
