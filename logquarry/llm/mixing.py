"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

A document's size is its number of words. Sources in code-point order, null last, weigh 1, 2, 3,
repeating; targets share all words by weight and stop at three times their source, the excess shared
again. Blocks of equally many words go to sources by the highest quotients target / (2 k + 1); within a
source its shards get their integer quotas the same way, with their words as votes. A shard lays its
documents end to end in a seeded order and takes as many blocks from the start, over and over, so a
document is taken at most three times.

Defined results: a null text has size 0; a null source is a source of its own; documents of size 0 take
nothing; texts of any length are counted whole; repeated rows count each for itself, rows that tie in id and size are
laid in any order, which changes no sum; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_batches, texts

#: No target exceeds so many times its source, and no document is taken more often.
MOST = 3
#: Sources, of about a hundred bytes each, up to which their totals are broadcast; beyond, they are joined by shuffling.
BROADCAST_SOURCES = 50_000


def targets(sizes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Share sum(sizes) by weight; what exceeds MOST * size is shared again among the others until none is above."""
    limit, target, open_ = MOST * sizes.astype(float), np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        rest = float(sizes.sum()) - limit[~open_].sum()
        target[open_] = rest * weights[open_] / weights[open_].sum()
        above = open_ & (target > limit)
        if not above.any():
            break
        target[above], open_ = limit[above], open_ & ~above
    return target


def sainte_lague(votes: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1), at most ``most`` each; ties go to the first.

    A divisor d gives everyone the quotients of at least 1 / d. It is found by bisection, just short of
    all seats, so that only the last few seats are dealt one by one, however many there are.
    """
    votes, most = votes.astype(float), most.astype(np.int64)
    seats = int(min(seats, most[votes > 0].sum()))

    def dealt(d: float) -> np.ndarray:
        return np.minimum(np.floor(votes * d / 2 + 0.5).astype(np.int64), most)

    low, high = 0.0, 1.0 / max(float(votes.max(initial=0)), 1e-300)
    while dealt(high).sum() < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if dealt(middle).sum() <= seats else (low, middle)
    got = dealt(low)
    for _ in range(seats - int(got.sum())):
        got[int(np.argmax(np.where(got < most, votes / (2 * got + 1), -1.0)))] += 1
    return got


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, the words of each text as ``size`` and the source as the never-null key ``source_key``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pa.array([len(t.encode().split()) for t in texts(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), sizes, batch.column("source_key")], [*columns, "size", "source_key"])

    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    read = docs.select(*dict.fromkeys([*columns, "text"]), key.alias("source_key"))
    kinds = StructType([*(read.schema[c] for c in columns), StructField("size", LongType()), StructField("source_key", StringType())])
    return map_batches(read, kinds, count)


def plan(totals: pd.DataFrame, block: int | None = None) -> tuple[pd.DataFrame, int]:
    """Target and number of blocks of each source. totals: source_key, source_size.

    block: words in a block; None takes a hundredth of the smallest target, from 1 to 1024 words.
    """
    order = sorted(range(len(totals)), key=lambda i: (totals.source_key[i] == "", totals.source_key[i]))
    totals = totals.iloc[order].reset_index(drop=True)
    sizes = totals.source_size.to_numpy(np.int64)
    target = targets(sizes, np.arange(len(sizes)) % 3 + 1.0)
    if block is None:
        block = int(np.clip(target[target > 0].min(initial=1e9) // 100, 1, 1024))
    quota = sainte_lague(target, MOST * sizes // block, round(float(target.sum()) / block)) if len(sizes) else sizes
    return totals.assign(target=target, blocks=quota), block


def mix(docs: DataFrame, keep: list[str] | None = None, block: int | None = None, shard_words: int = 50_000, most_shards: int = 4096, seed: int = 42) -> DataFrame:
    """``keep`` columns (doc_id by default), size, source_size, target and taken of every document.

    Only the sources' totals reach the driver. shard_words: words in a shard of a source, more where that
    would give over most_shards; so quotas of one source are at most most_shards rows in one task.
    """
    spark, keep = docs.sparkSession, keep or ["doc_id"]
    rows = sized(docs, keep if "doc_id" in keep else ["doc_id", *keep])
    totals = sized(docs, ["doc_id"]).groupBy("source_key").agg(F.sum("size").alias("source_size")).toPandas()
    planned, block = plan(totals, block)
    planned["shards"] = np.clip(-(-planned.source_size // shard_words), 1, most_shards).astype(np.int64)
    sources = spark.createDataFrame(planned, "source_key string, source_size long, target double, blocks long, shards long")
    # hashed ids choose the shard and the order in it: reruns agree wherever the rows lie
    # the totals have been on the driver; of a checked number of sources they are broadcast, so that no source is one task
    rows = rows.join(F.broadcast(sources) if len(planned) <= BROADCAST_SOURCES else sources, "source_key").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "shards"))
    shards = rows.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))

    def quotas(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        sizes = part.shard_size.to_numpy(np.int64)
        return part[["source_key", "shard", "shard_size"]].assign(quota=block * sainte_lague(sizes, MOST * sizes // block, int(part.blocks.iloc[0])))

    dealt = shards.groupBy("source_key").applyInPandas(quotas, "source_key string, shard long, shard_size long, quota long")
    laid = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum("size").over(laid)).join(dealt, ["source_key", "shard"])
    start, rest = F.col("end") - F.col("size"), F.expr("CASE WHEN shard_size > 0 THEN quota % shard_size ELSE 0 END")
    whole = F.expr("CASE WHEN shard_size > 0 THEN quota div shard_size ELSE 0 END")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select(*keep, "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: each document as often as it is taken, a part taken rounding to the nearest whole; columns as in ``docs``."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))  # so no name of theirs clashes
    counted = mix(packed, ["_row"], **parameters)
    times = F.expr("CASE WHEN size > 0 THEN cast(round(taken / size) AS int) ELSE 0 END")
    return counted.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
