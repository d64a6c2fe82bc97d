"""Command line: python -m logquarry.cli search|index|info|watch|clear|serve|detect ...; a bare FILE QUERY searches."""

from __future__ import annotations

import argparse
import json
import sys
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.text import marked, readable_bytes
from .operators.formats import detect_format
from .operators.search import SearchOptions, counted, numbered, search
from .sources.index_store import IndexStore
from .sources.lines import last_lines, read_lines

COMMANDS = ("search", "index", "info", "watch", "clear", "serve", "detect")
ROOT = str(Path.home() / ".logquarry" / "indexes")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="logquarry")
    top.add_argument("--root", default=ROOT, help="folder of the indexes")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("file")
    s.add_argument("query")
    for flag in ("--case-sensitive", "--regex", "--strict", "--contains", "--no-index", "--json", "--table", "--descending"):
        s.add_argument(flag, action="store_true")
    for option in ("--since", "--until", "--level"):
        s.add_argument(option)
    for option, default in (("--limit", 100), ("--offset", 0), ("--context", 0)):
        s.add_argument(option, type=int, default=default)
    s.add_argument("--sort", choices=["line", "score", "timestamp"], default="line")
    i = sub.add_parser("index")
    i.add_argument("file")
    i.add_argument("--force", action="store_true")
    for name in ("info", "detect"):
        one = sub.add_parser(name)
        one.add_argument("file")
        one.add_argument("--json", action="store_true")
    w = sub.add_parser("watch")
    w.add_argument("file")
    w.add_argument("query", nargs="?")
    w.add_argument("--alert")
    w.add_argument("--tail", type=int, default=50)
    w.add_argument("--seconds", type=float, help="stop after so long")
    c = sub.add_parser("clear")
    c.add_argument("file", nargs="?")
    c.add_argument("--all", action="store_true")
    c.add_argument("-y", "--yes", action="store_true")
    v = sub.add_parser("serve")
    v.add_argument("--port", type=int, default=7777)
    return top


def options_of(a: argparse.Namespace) -> SearchOptions:
    return SearchOptions(
        ignore_case=not a.case_sensitive, is_regex=a.regex, strict=a.strict, contains=a.contains, since=a.since, until=a.until, level=a.level,
        sort_by=a.sort, descending=True if a.descending else None, offset=a.offset, limit=a.limit, context=a.context,
    )


def run_search(spark: SparkSession, store: IndexStore, file: str, query: str, options: SearchOptions, use_index: bool = True) -> dict:
    """The page as plain values. It is bounded by the limit, so it may come to the driver."""
    began = time.perf_counter()
    index = store.open(file) if use_index else None
    if index is not None:
        index.refresh(file)
    source = index or read_lines(spark, file)
    rows = [r.asDict(recursive=True) for r in search(source, query, options).collect()]
    return {"query": query, "file": file, **counted(source, query, options), "seconds": round(time.perf_counter() - began, 3), "results": rows}


def show(found: dict, context: int) -> None:
    for r in found["results"]:
        for line in r.get("context_before") or []:
            print(f"      | {line}")
        print(f"{r['line_no']:>6}: {marked(r['content'], [(h['start'], h['end']) for h in r['highlights']])}")
        for line in r.get("context_after") or []:
            print(f"      | {line}")
        if context:
            print("--")
    print(f"{found['returned']} of {found['total_hits']} matches in {found['seconds']} s", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if len(argv) >= 2 and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "search")
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("logquarry").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    store = IndexStore(spark, a.root)
    if a.command == "search":
        options = options_of(a)
        if a.table:
            numbered(search(read_lines(spark, a.file), a.query, options)).show(a.limit, truncate=False)
            return 0
        found = run_search(spark, store, a.file, a.query, options, not a.no_index)
        if a.json:
            print(json.dumps(found, default=str, ensure_ascii=False))
        else:
            show(found, a.context)
    elif a.command == "index":
        index = None if a.force else store.open(a.file)
        lines = read_lines(spark, a.file)
        added = index.refresh(a.file) if index else None
        index = index or store.build(a.file, lines)
        print(f"{index.path}: " + (f"{added} new lines" if added is not None else f"format {detect_format(lines)}"))
    elif a.command in ("info", "detect"):
        if a.command == "detect":
            print(detect_format(read_lines(spark, a.file)))
            return 0
        index = store.open(a.file)
        if index is None:
            print(f"no index for {a.file}", file=sys.stderr)
            return 1
        stale = {r.file for r in index.stale(read_lines(spark, a.file)).collect()}
        for r in index.info().collect():
            row = r.asDict() | {"stale": r.file in stale}
            print(json.dumps(row, default=str) if a.json else f"{r.file}: {r.total_lines} lines, {r.unique_terms} terms, {readable_bytes(r.file_size)}" + ", stale" * row["stale"])
    elif a.command == "watch":
        from .streaming.tail import follow
        from .streaming.watch import watch

        for r in last_lines(read_lines(spark, a.file), a.tail).collect():
            print(r.content)
        stream = watch(follow(spark, a.file), a.query, a.alert)
        running = stream.writeStream.foreachBatch(lambda df, n: [print(("! " if r.alert else "") + r.content) for r in df.toLocalIterator()]).start()
        running.awaitTermination(a.seconds)
        running.stop()
    elif a.command == "clear":
        if not a.file and not a.all:
            print("name a file or give --all", file=sys.stderr)
            return 1
        if a.yes or input("remove the index? [y/N] ").strip().lower() == "y":
            if a.all:
                from .sources.index_store import Index

                for path in store.list_all():
                    Index(spark, path).clear()
            else:
                store.remove(a.file)
    elif a.command == "serve":
        serve(spark, store, a.port)
    return 0


def answer(spark: SparkSession, store: IndexStore, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and JSON of a request: POST /api/search and /api/index, GET /api/indexes and /api/info?file=..."""
    try:
        if (method, path) == ("POST", "/api/search"):
            if not body.get("file") or not body.get("query"):
                return 400, {"error": "file and query are needed"}
            if store.open(body["file"]) is None:
                return 404, {"error": "no index for this file"}
            known = {k: v for k, v in (body.get("options") or {}).items() if k in SearchOptions.__dataclass_fields__}
            return 200, run_search(spark, store, body["file"], body["query"], SearchOptions(**{"limit": 200} | known))
        if (method, path) == ("POST", "/api/index"):
            if not body.get("file"):
                return 400, {"error": "file is needed"}
            index = store.build(body["file"], read_lines(spark, body["file"]))
            return 200, {"path": index.path, "files": [r.asDict() for r in index.info().collect()]}
        if (method, path) == ("GET", "/api/indexes"):
            return 200, {"indexes": store.list_all()}
        if method == "GET" and path.startswith("/api/info?file="):
            index = store.open(path.partition("=")[2])
            return (404, {"error": "no index for this file"}) if index is None else (200, {"files": [r.asDict() for r in index.info().collect()]})
        return 404, {"error": "no such path"}
    except Exception as e:  # a request's fault is its answer, not the server's end
        return 500, {"error": str(e)[:500]}


def serve(spark: SparkSession, store: IndexStore, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = answer(spark, store, method, self.path, json.loads(raw or b"{}"))
            data = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self.reply("GET")

        def do_POST(self) -> None:  # noqa: N802
            self.reply("POST")

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()


if __name__ == "__main__":
    sys.exit(main())
