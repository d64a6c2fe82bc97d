"""The index on disk: tokenised lines, postings, vocabulary and metadata as Parquet, and a registry of indexes.

An index is a folder of parts, each written once, and of ``meta-N`` folders. The newest whole one names the parts
that count, so a build or an append that breaks off leaves the index as it was. A file's last line without a newline
is unfinished: it is in a part of its own, which the next append replaces when the file has grown.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter, OrderedDict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import tokens

VERSION = 2
#: Columns of the lines of a part, before their terms.
STORED = ["file", "line_no", "physical_line_no", "byte_offset", "content", "file_bytes", "next_offset"]
#: Files of an index up to which their totals are broadcast; beyond, they are joined by shuffling.
BROADCAST_FILES = 200_000


def tokenised(lines: DataFrame, **options) -> DataFrame:
    return lines.withColumn("terms", tokens(F.col("content"), **options))


def postings_of(lines: DataFrame) -> DataFrame:
    """A row for each distinct term of a line; tokenises lines that are not tokenised yet."""
    own = lines if "terms" in lines.columns else tokenised(lines)
    return own.select(F.explode_outer("terms").alias("term"), "file", "line_no", "byte_offset").where("term IS NOT NULL")  # the outer form computes the terms once


def vocabulary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def metadata_of(lines: DataFrame, postings: DataFrame) -> DataFrame:
    """A row for each file: lines, distinct terms, bytes and mean bytes of a line."""
    files = lines.groupBy("file").agg(F.count("*").alias("total_lines"), F.max("file_bytes").alias("file_size"))
    terms = postings.groupBy("file").agg(F.count_distinct("term").alias("unique_terms"))
    joined = files.join(terms, "file", "left")
    return joined.select("file", "total_lines", F.coalesce("unique_terms", F.lit(0)).alias("unique_terms"), "file_size", (F.col("file_size") / F.col("total_lines")).alias("avg_line_len"))


def compact(postings: DataFrame, span: int | None = None) -> DataFrame:
    """Posting lists of each file: term and sorted byte offsets. span: bytes of a file that one list covers, so that none grows with its file."""
    keys = ["file", "term", *([] if span is None else [F.floor(F.col("byte_offset") / span).alias("block")])]
    return postings.groupBy(*keys).agg(F.sort_array(F.collect_set("byte_offset")).alias("offsets"))


class Index:
    """An index in one folder. Postings are range-partitioned and sorted by term, so a search reads few row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: tuple[int, list[str], dict, int] | None = None

    def _fs(self, name: str = ""):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _newest(self) -> int:
        """Number of the newest whole metadata, 0 if there is none."""
        target, fs = self._fs()
        if not fs.exists(target):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        whole = [int(n[5:]) for n in names if n.startswith("meta-") and n[5:].isdecimal() and fs.exists(self._fs(f"{n}/_SUCCESS")[0])]
        return max(whole, default=0)

    def _state(self) -> tuple[int, list[str], dict, int]:
        """Number of the metadata, the parts, the tokeniser's options and the number of files."""
        now = self._newest()
        if self._known is None or self._known[0] != now:
            row = self.spark.read.parquet(f"{self.path}/meta-{now}").agg(F.first("parts").alias("parts"), F.first("options").alias("options"), F.count("*").alias("files")).first()
            self._known = now, list(row.parts or []), json.loads(row.options or "{}"), row.files
        return self._known

    @property
    def options(self) -> dict:
        """What the tokeniser was told when the index was built: min_length and stop_words."""
        return self._state()[2]

    @property
    def meta(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/meta-{self._state()[0]}").where("file IS NOT NULL")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{p}/{name}" for p in self._state()[1]))

    postings = property(lambda self: self._read("postings"))

    @property
    def lines(self) -> DataFrame:
        """The lines with their terms and their file's totals."""
        totals = self.meta.select("file", F.col("file_size").alias("file_bytes"), F.col("total_lines").alias("file_lines"))
        return self._read("lines").drop("file_bytes", "next_offset").join(F.broadcast(totals) if self._state()[3] <= BROADCAST_FILES else totals, "file")

    @property
    def vocabulary(self) -> DataFrame:
        return self._read("vocab").groupBy("term").agg(F.sum("df").alias("df"))

    def exists(self) -> bool:
        return self._newest() > 0

    def _put(self, lines: DataFrame, options: dict, compression: str) -> str:
        """Write a part; its lines are tokenised once, and the rest comes from them."""
        part = f"part-{uuid.uuid4().hex}"
        put = lambda df, name: df.write.option("compression", compression).parquet(f"{self.path}/{part}/{name}")
        read = lambda name: self.spark.read.parquet(f"{self.path}/{part}/{name}")
        put(tokenised(lines.select(*STORED), **options), "lines")
        put(postings_of(read("lines")).repartitionByRange("term", "file", "line_no").sortWithinPartitions("term", "file", "line_no"), "postings")
        put(vocabulary_of(read("postings")), "vocab")
        return part

    def _commit(self, totals: DataFrame, parts: list[str], options: dict, compression: str) -> None:
        """Write the metadata, which makes the parts count, and remove what no longer does."""
        before = self._newest()
        columns = {"version": F.lit(VERSION), "built_at": F.lit(datetime.now(UTC).isoformat()), "options": F.lit(json.dumps(options)), "parts": F.array(*map(F.lit, parts)).cast("array<string>")}
        none = self.spark.createDataFrame([(None,)], "file string").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in totals.schema))  # so that an empty index names its parts too
        totals.unionByName(none).withColumns(columns).write.option("compression", compression).parquet(f"{self.path}/meta-{before + 1}")
        target, fs = self._fs()
        for status in fs.listStatus(target):
            name = status.getPath().getName()
            if name not in parts and name != f"meta-{before + 1}":
                fs.delete(status.getPath(), True)
        self._known = None

    def build(self, lines: DataFrame, compression: str = "zstd", **options) -> Index:
        """Index these lines in place of all earlier ones. options: the tokeniser's, which searches and appends then keep to."""
        whole, rest = self._split(lines)
        parts = [self._put(whole, options, compression)]
        if rest is not None:
            parts.append(self._put(rest, options, compression))
        self._commit(self._totals(self._lines_of(parts)), parts, options | {"_tail": rest is not None}, compression)
        return self

    def _lines_of(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{p}/lines" for p in parts))

    @staticmethod
    def _split(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Finished lines, and the unfinished ones if there are any."""
        if "next_offset" not in lines.columns:
            return lines.withColumn("next_offset", F.col("file_bytes")), None
        rest = lines.where("next_offset > file_bytes")
        return lines.where("next_offset <= file_bytes"), None if rest.isEmpty() else rest

    @staticmethod
    def _totals(stored: DataFrame) -> DataFrame:
        """A row for each file. indexed: bytes of finished lines, from which an append goes on."""
        ends = stored.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("next_offset") <= F.col("file_bytes"), F.col("next_offset"))), F.lit(0)).cast("long").alias("indexed"))
        return metadata_of(stored, postings_of(stored)).join(ends, "file")

    def append(self, lines: DataFrame, compression: str = "zstd") -> int:
        """Index what files gained, and files not known yet; returns the number of lines that are new or have changed.

        lines: of all files or of some; those whose size is the indexed one cost nothing more, those that shrank are left
        alone. Lines before a file's ``indexed`` bytes are not tokenised again.
        """
        _, parts, options, _ = self._state()
        told = {k: v for k, v in options.items() if k != "_tail"}
        known = self.meta.select("file", "indexed", F.col("file_size").alias("size"))
        grown = lines.join(known, "file", "left").where("size IS NULL OR file_bytes > size")
        new = grown.where(F.col("byte_offset") >= F.coalesce("indexed", F.lit(0))).drop("indexed", "size")
        files = grown.select("file").distinct()
        whole, rest = self._split(new)
        fresh = self._put(whole, told, compression)
        tail = parts[-1:] if options.get("_tail") else []
        made = [p for p in parts if p not in tail] + [fresh]
        added, changed = self._lines_of([fresh]).count(), 0 if rest is None else rest.count()
        if not added and not changed:
            target, fs = self._fs(fresh)
            fs.delete(target, True)
            return 0
        left = [] if rest is None else [rest.select(*STORED)]  # unfinished lines, also of files that did not grow
        if tail and not (old := self._lines_of(tail).select(*STORED).join(files, "file", "left_anti")).isEmpty():
            left.append(old)
        if left:
            made.append(self._put(left[0] if len(left) == 1 else left[0].unionByName(left[1]), told, compression))
        totals = self._totals(self._lines_of(made).join(files, "file", "left_semi"))
        others = self.meta.select(*totals.columns).join(files, "file", "left_anti")
        self._commit(others.unionByName(totals), made, told | {"_tail": bool(left)}, compression)
        return added + changed

    def refresh(self, source: str) -> int:
        """Append what the files of a path or glob gained: sizes come from a listing, and only files that grew are read."""
        from .lines import file_sizes, read_lines

        sizes = file_sizes(self.spark, source)
        grown = sizes.join(self.meta.select("file", "file_size"), "file", "left").where("file_size IS NULL AND size > 0 OR size > file_size").select("path")
        paths = [r.path for r in grown.collect()]  # of files, which a listing has on the driver anyway
        return self.append(read_lines(self.spark, paths)) if paths else 0

    def check(self) -> None:
        found = self.meta.agg(F.max("version")).first()[0]
        if found is not None and found != VERSION:
            raise ValueError(f"index version {found}, expected {VERSION}")

    def info(self) -> DataFrame:
        return self.meta.drop("parts")

    def compression_ratio(self) -> float:
        """The share of the files' bytes that the index saves; below 0 if it is larger than they are."""
        target, fs = self._fs()
        size = self.meta.agg(F.sum("file_size")).first()[0] or 0
        return round(1 - fs.getContentSummary(target).getLength() / size, 2) if size else 0.0

    def stale(self, lines: DataFrame) -> DataFrame:
        """Files whose present size is not the indexed one."""
        now = lines.groupBy("file").agg(F.max("file_bytes").alias("now"))
        return self.meta.join(now, "file", "left").where(~F.col("file_size").eqNullSafe(F.col("now"))).select("file", "file_size", "now")

    def clear(self) -> None:
        target, fs = self._fs()
        fs.delete(target, True)


def index_path(root: str, source: str) -> str:
    """A folder for the index of a source, named after it and its hash."""
    return f"{root.rstrip('/')}/{source.rstrip('/').rpartition('/')[2]}-{hashlib.md5(source.encode()).hexdigest()[:8]}"


class IndexStore:
    """Registry of indexes under a root, with a small cache of open ones, least recently used dropped first."""

    def __init__(self, spark: SparkSession, root: str, open_at_once: int = 10):
        self.spark, self.root, self.most = spark, root.rstrip("/"), open_at_once
        self.cache: OrderedDict[str, Index] = OrderedDict()
        self.hits = 0
        self.uses: Counter[str] = Counter()

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def list_all(self) -> list[str]:
        """Folders that hold a whole index; broken ones are not listed."""
        target, fs = self._fs(self.root)
        if not fs.exists(target):
            return []
        folders = [str(s.getPath().toString()) for s in fs.listStatus(target)]
        return sorted(f for f in folders if Index(self.spark, f).exists())

    def open(self, source: str) -> Index | None:
        path = index_path(self.root, source)
        if path in self.cache:
            self.cache.move_to_end(path)
            self.hits += 1
            self.uses[path] += 1
            return self.cache[path]
        index = Index(self.spark, path)
        if not index.exists():
            return None
        index.check()
        self.cache[path] = index
        while len(self.cache) > self.most:
            self.cache.popitem(last=False)
        return index

    def build(self, source: str, lines: DataFrame, **options) -> Index:
        self.cache.pop(index_path(self.root, source), None)
        return Index(self.spark, index_path(self.root, source)).build(lines, **options)

    def remove(self, source: str) -> None:
        self.cache.pop(index_path(self.root, source), None)
        Index(self.spark, index_path(self.root, source)).clear()

    def stats(self) -> dict:
        return {"open": len(self.cache), "most": self.most, "hits": self.hits, "uses": dict(self.uses)}
