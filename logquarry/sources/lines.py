"""Lines with exact numbers and byte offsets, from text files of any size or from a text column."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines whose bytes are summed up as one when offsets are computed.
CHUNK = 64
#: Splits from which a scan is never dealt anew, so that no more than a few gigabytes ever are.
SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, dealt over all cores if it has fewer splits than these and than SPLITS, so that most would idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = not df.isStreaming and df._jdf.queryExecution().toRdd().getNumPartitions() < min(cores, SPLITS)
    return df.repartition(cores) if few else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on a single machine that sets none, one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="logquarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is computed once, however often and inside whatever lambdas it is used."""
    return F.element_at(F.transform(F.array(value), result), 1)


def lines_of_column(df: DataFrame, file: str, text: str) -> DataFrame:
    """file, line_no, physical_line_no, byte_offset, content, file_bytes and file_lines of the non-empty lines of a text column.

    Numbers and offsets come from places in the row's own array, so nothing is shuffled and rows that share a key
    do not mix. A line's offset is the sum of the chunks before its own and of the lines before it in its chunk.
    """
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    chunks = lambda sizes: F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda k: total(F.slice(sizes, k * CHUNK + 1, CHUNK)))
    starts = lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, 1, k)))

    def numbered(split: Column, sizes: Column, first: Column) -> Column:
        offset = lambda i: first[F.floor(i / CHUNK).cast("int")] + total(F.slice(sizes, i - i % CHUNK + 1, i % CHUNK))
        placed = F.transform(split, lambda line, i: F.struct(i.alias("i"), line.alias("line"), F.when(line != "", offset(i)).alias("at")))
        return F.filter(placed, lambda x: x["line"] != "")

    sizes = lambda split: F.transform(split, lambda line: (F.octet_length(line) + 1).cast("long"))
    kept = let(F.split(F.col(text), "\n", -1), lambda split: let(sizes(split), lambda size: let(chunks(size), lambda sums: let(starts(sums), lambda first: numbered(split, size, first)))))
    whole = df.select(F.col(file).alias("file"), F.octet_length(text).cast("long").alias("file_bytes"), kept.alias("kept"))
    rows = whole.select("file", "file_bytes", F.size("kept").cast("long").alias("file_lines"), F.posexplode_outer("kept").alias("rank", "x")).where("x IS NOT NULL")  # the outer form computes the array once
    return rows.select(
        "file", (F.col("rank") + 1).cast("long").alias("line_no"), (F.col("x.i") + 1).cast("long").alias("physical_line_no"),
        F.col("x.at").alias("byte_offset"), F.col("x.line").alias("content"), "file_bytes", "file_lines",
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same columns for text files, and next_offset, beyond the file's bytes where no newline ends the line.

    Globs, directories and many files at once are fine.

    Rows of a split keep their order under monotonically_increasing_id. Offsets run inside each split, whose
    size is bounded, and the splits' totals, one row each, are summed up file by file.
    """
    read = spark.read.option("lineSep", "\n").text(paths)
    raw = read.select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_bytes"), F.monotonically_increasing_id().alias("at"),
    )
    size, full = (F.octet_length("value") + 1).cast("long"), (F.col("value") != "").cast("long")
    totals = raw.groupBy("file", "block").agg(F.sum(size).alias("bytes"), F.count("*").alias("lines"), F.sum(full).alias("full"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"first_{c}")
    starts = totals.select("file", "block", start("bytes"), start("lines"), start("full"), F.sum("full").over(Window.partitionBy("file")).alias("file_lines"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    placed = raw.select(
        "file", "block", "value", "file_bytes", (F.sum(size).over(inside) - size).alias("own_bytes"), F.row_number().over(inside).alias("own_lines"), F.sum(full).over(inside).alias("own_full"),
    ).where("value <> ''")
    return placed.join(starts, ["file", "block"]).select(
        "file", (F.col("first_full") + F.col("own_full")).alias("line_no"), (F.col("first_lines") + F.col("own_lines")).alias("physical_line_no"),
        (F.col("first_bytes") + F.col("own_bytes")).alias("byte_offset"), F.regexp_replace("value", "\r$", "").alias("content"), "file_bytes", "file_lines",
        (F.col("first_bytes") + F.col("own_bytes") + size).alias("next_offset"),
    )


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, file (as in ``read_lines``) and size of files, by a listing alone."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, size and the SHA-256 of each file's first 64 KB, last 64 KB and size, which tells a changed file of the same size."""
    ends = F.concat(F.substring("content", 1, 65536), F.substring("content", -65536, 65536), F.col("length").cast("string").cast("binary"))
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.sha2(ends, 256).alias("digest"))


def average_length() -> Column:
    """Bytes of a line on average, newline included, of the line's file; the fixed default where there are none."""
    return F.when(F.col("file_lines") > 0, F.col("file_bytes") / F.col("file_lines")).otherwise(F.lit(200.0))


def last_lines(lines: DataFrame, n: int = 50) -> DataFrame:
    """The last n lines over all files, in order; a bounded top-k, not a sort."""
    return lines.orderBy(F.desc("file"), F.desc("line_no")).limit(n).orderBy("file", "line_no")


def line_at(lines: DataFrame, offset: int) -> DataFrame:
    """For each file the number that a byte offset falls on: that of the line there, else of the next one, at most the last."""
    return lines.groupBy("file").agg(F.least(F.count_if(F.col("byte_offset") < offset) + 1, F.count("*")).alias("line_no"))


def generated(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """``value``: synthetic access and application lines, the same for the same seed."""
    levels, methods = ["ERROR", "INFO", "NOTICE", "WARN"], ["GET", "HEAD", "PATCH", "POST"]
    paths, statuses = ["/basket", "/catalogue/books", "/feed.xml", "/maps/tiles", "/reports/daily"], ["200", "204", "302", "418", "502"]
    messages = ["basket emptied", "map tile drawn", "printer out of ink – job waits", "report mailed", "stock counted", "two copies differ"]
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(values))) + 1).cast("int"))
    amount = lambda most, salt: F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(most)).cast("string")
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    address = F.concat(F.lit("10.0.0."), amount(4, 7))
    return spark.range(rows).select(F.concat_ws(" ", at, F.concat(F.lit("["), pick(levels, 1), F.lit("]")), address, pick(methods, 2), pick(paths, 3), pick(statuses, 4), F.concat(amount(900, 5), F.lit("ms")), F.lit("-"), pick(messages, 6), F.concat(F.lit("(req="), F.col("id").cast("string"), F.lit(")"))).alias("value"))
