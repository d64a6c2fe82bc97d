"""SimHash near-duplicates with pigeonring filtering.

A text's words, A-Z in lower case, give three-word shingles (fewer words: the whole sequence; none: no
shingle and fingerprint zero). A bit of the 64-bit fingerprint is set if over half of the shingles'
XXH64 (seed 42) have it. Fingerprints link at ``DISTANCE`` or fewer differing bits.

Candidates by the pigeonring principle: cut the fingerprint into a ring of four 16-bit segments. If two
differ in 3 bits at most, then some segment starts a chain of consecutive segments whose cumulative
differences stay within the proportional budgets 3/4, 6/4, 9/4, 12/4, that is 0, 1, 2, 3. So the first
two segments of a chain make a 32-bit key: each fingerprint is at home under its own four keys and
visits those keys whose second segment has one bit more. Home rows meet home rows and visitors;
the budget of the chain's third segment prunes, and the full Hamming check decides.

Only distinct fingerprints take part, so exact copies cost nothing. A key's members are compared in one
task up to MEMBERS; more are dealt in blocks, a task for each pair of blocks. Tasks return spanning
trees of the links they find, not the links. Components come from star contraction on written tables.

Defined results: a null text counts as the empty text; empty and wordless texts have fingerprint zero
and are linked like any other; texts of any length are read whole; repeated rows and texts that tie share a component; a null doc_id is never a component's
id unless its component has no other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_batches, remove, texts, written

WIDTH, DISTANCE, SEGMENTS, BITS, SEED = 3, 3, 4, 16, 42
#: Members of a key that one task compares.
MEMBERS = 1024
#: Copies from which a fingerprint is hot, and rows of hot ones up to which they are broadcast.
HOT, BROADCAST_ROWS = 256, 1_000_000
ONES = np.array([bin(x).count("1") for x in range(1 << BITS)], np.uint8)


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()  # bytes: only A-Z change, and only the six ASCII spaces split
    if not words:
        return 0
    if len(words) <= WIDTH:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        flat = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :])]  # noqa: B905
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
    over = bits.sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, fp long", run)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the fingerprints under them and whether they are at home there."""
    keys, owners, homes = [], [], []
    bits = fp.view(np.uint64)
    segment = [(bits >> np.uint64(48 - BITS * i)) & np.uint64(0xFFFF) for i in range(SEGMENTS)]
    for i in range(SEGMENTS):
        first, second = segment[i], segment[(i + 1) % SEGMENTS]
        own = np.uint64(i) << np.uint64(32) | first << np.uint64(16) | second
        keys.append(own), owners.append(fp), homes.append(np.ones(len(fp), bool))
        for j in range(BITS):
            bit = np.uint64(1 << j)
            visits = (second & bit) == 0
            keys.append(own[visits] | bit), owners.append(fp[visits]), homes.append(np.zeros(int(visits.sum()), bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(homes)


def linked(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs keep the budget of the chain that the key begins, and the whole distance."""
    x = (a ^ b).view(np.uint64)
    ones = np.stack([ONES[(x >> np.uint64(48 - BITS * i)) & np.uint64(0xFFFF)] for i in range(SEGMENTS)])
    start = key >> 32
    every = np.arange(len(x))
    chain = sum(ones[(start + k) % SEGMENTS, every].astype(int) for k in range(SEGMENTS - 1))
    return (chain <= (SEGMENTS - 1) * DISTANCE // SEGMENTS) & (ones.sum(0, dtype=int) <= DISTANCE)


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of n nodes' components."""
    label = np.arange(n) if label is None else label
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def forest(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, as pairs that connect what is connected."""
    label, first = np.arange(len(key)), np.arange(len(key))
    for shift in range(1, len(key)):
        first = first[first + shift < len(key)]
        first = first[key[first] == key[first + shift]]
        if not len(first):
            break
        a = first[(home[first] | home[first + shift]) & (label[first] != label[first + shift])]
        a = a[linked(key[a], fp[a], fp[a + shift])]
        label = roots(len(key), a, a + shift, label)
    moved = np.flatnonzero((label != np.arange(len(key))) & (fp != fp[label]))
    return fp[moved], fp[label[moved]]


def compare(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, home) to links (key null) and, of keys with over MEMBERS members, the rows themselves."""

    def out(key, a, b, home) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(home, pa.bool_())], ["key", "fp", "other", "home"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))  # the last key's rows: more may follow
        large: int | None = None  # the key whose rows are passed on
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "home")]
            key, fp, home = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(key):
                continue
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[begins, len(key)])
            open_ = np.zeros(len(begins), bool)
            open_[-1] = True
            over = (sizes > MEMBERS) | (key[begins] == large if large is not None else False)
            large = int(key[-1]) if over[-1] else None
            pass_on, wait = np.repeat(over, sizes), np.repeat(open_ & ~over, sizes)
            if pass_on.any():
                yield out(key[pass_on], fp[pass_on], np.zeros(int(pass_on.sum()), np.int64), home[pass_on])
            now = ~pass_on & ~wait
            a, b = forest(key[now], fp[now], home[now])
            yield out(pa.nulls(len(a), pa.int64()), a, b, np.zeros(len(a), bool))
            held = (key[wait], fp[wait], home[wait])
        a, b = forest(*held)
        yield out(pa.nulls(len(a), pa.int64()), a, b, np.zeros(len(a), bool))

    return rows.mapInArrow(run, "key long, fp long, other long, home boolean")


def large_keys(rows: DataFrame) -> DataFrame:
    """Links among the members of keys with many: blocks of a key meet in pairs, a task for each pair."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / (MEMBERS // 2))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = rows.join(sizes.withColumn("blocks", blocks), "key").withColumn("own", own)
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", meets).select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, fp, home = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("key", "fp", "home"))
            x, y = forest(key, fp, home)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["fp", "other"])

        parts, at = [], None
        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy() for c in ("key", "a", "b")])
            begins = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(begins[:-1], begins[1:], strict=True):
                if lo == hi:
                    continue
                if parts and at != tuple(cells[:, lo]):
                    yield done(parts)
                    parts = []
                at = tuple(cells[:, lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield done(parts)

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "fp long, other long")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, of all nodes of ``edges`` (a, b), by star contraction.

    A round lets every node's larger neighbours, then its smaller ones, point to the least of them; rounds
    grow with the logarithm of a component's width. Each is written, so a lost executor costs a round at most.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        new, new_path = written(small.where("a <> b").distinct(), "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = new, new_path
        if seen == mark or not seen[0]:
            break
        mark = seen
    leaf = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaf.unionByName(leaf.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    rows, _ = written(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in chain_keys(batch.column("fp").to_numpy(zero_copy_only=False).copy())], ["key", "fp", "home"])

    under = distinct.select("fp").mapInArrow(keys, "key long, fp long, home boolean")
    found, path = written(compare(under.repartition("key").sortWithinPartitions("key")), "links")
    links = found.where("key IS NULL").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    many = large_keys(found.where("key IS NOT NULL").select("key", "fp", "home"))
    joined = components(links.unionByName(many.select(F.col("fp").alias("a"), F.col("other").alias("b"))))
    remove(spark, path)
    member = joined.join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    group = member.groupBy("root").agg(F.min("least").alias("component"))
    of = member.join(group, "root").select(F.col("node").alias("fp"), "component")
    each, _ = written(distinct.join(of, "fp", "left").select("fp", "copies", F.coalesce("component", "least").alias("component_id")), "components")
    # rows of a fingerprint with many copies meet it by broadcast, so that they never lie in one task
    hot = each.where(F.col("copies") > HOT).select("fp", "component_id", F.lit(True).alias("hot"))
    met = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, "fp", "left")
    cold = met.where("hot IS NULL").select("doc_id", "fp").join(each.where(F.col("copies") <= HOT).drop("copies"), "fp")
    found = met.where("hot").select("doc_id", "fp", "component_id").unionByName(cold.select("doc_id", "fp", "component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller doc_id. Of rows that share a doc_id one stays; rows without one stay."""
    found, _ = written(near_duplicates(docs), "components")
    dropped = found.where("component_id < doc_id").select("doc_id").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    once = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
