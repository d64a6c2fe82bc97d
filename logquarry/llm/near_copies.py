"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates by SimHash and the pigeonring principle, none of which is lost. One fingerprint of a whole text bounds no
similarity of sets, so a ring of boxes is laid over the shingles' hashes and each box has a SimHash of its own. Sets x and y
that are similar enough differ in at most (|x| + |y|) / 9 shingles and the larger is at most 5/4 of the smaller. A shingle
changes one box, so of the first so many and one more boxes with a shingle one is the same in both: its fingerprint is
equal. Hence these fingerprints are a text's ``ring_keys``. The number of boxes goes with the larger text's size,
by powers of two; small texts have a box for each shingle, and so have all texts of a size of which one has too few boxes with a
shingle. Every pair under a key is decided by the exact similarity of its shingles, so nothing else is ever linked.
Before texts meet, their sketches do: the parity of the number of shingles in each of so many places by hash. Sets that differ in d
shingles differ in at most d parities, so what the sketches part is not similar. Then each text is compared under its most
common key, and after that under those keys whose members are not all connected yet.

``band_keys`` are those of MinHash, for line templates, which only group copies by them: BANDS keys of ROWS minima each. A pair
of similarity s shares none with probability (1 - s**ROWS)**BANDS, at 0.8 about 3 in a million.

Words are those of SimHash: only A-Z change case, only the six ASCII spaces split. A text of fewer than
five words has its whole sequence as its shingle, and wordless texts have one in common. Only distinct texts
that share a key with another take part, and keys with the same members count once. A key's members beyond
MEMBERS meet in pairs of blocks. Tasks return spanning trees of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_batches, remove, texts, written
from .simhash import components, roots

WIDTH, BANDS, ROWS, SEED = 5, 24, 4, 42
#: Similarity at which texts link, as a fraction.
OVER, UNDER = 4, 5
#: Members of a key that one task compares.
MEMBERS = 1024
#: Shingles up to which each has a box for itself, and from which boxes have more on average (1.5 to 3 instead of 1 to 2).
ALONE, CROWDED = 31, 256
#: Rows of one or two numbers up to which a table is broadcast; beyond, it is joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bytes and shingles that are hashed at once; a longer text goes by itself.
BYTES, SHINGLES = 1 << 18, 1 << 16
_NUMBERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS + WIDTH + ROWS + BANDS + 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA, _WORDS, _KEYS, _BAND, _BYTE = np.split(_NUMBERS, np.cumsum([BANDS * ROWS, WIDTH, ROWS, BANDS]))
_MINIMA = (_MINIMA >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, all words at once: polynomials over the bytes, from running sums."""
    raw = np.frombuffer(data.lower(), np.uint8)
    edge = np.diff(np.r_[np.int8(1), _SPACE[raw].astype(np.int8), np.int8(1)])
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + BYTES, "right")))
        n = int(ends[to - 1] - first)
        up, down = powers(max(BYTES, 1 << (n - 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[first : first + n]] * up[:n], out=total[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (total[b] - total[a]) * down[a]
        at = to
    return mixed(out), starts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sequence_hash(words: np.ndarray) -> int:
    return xxh64_intdigest(words.tobytes(), SEED)


def shingles(batch: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each text its identity (equal for texts with the same words) and the hashes of its shingles, repeated ones included."""
    nodes, found, at = np.zeros(len(batch), np.uint64), [], 0
    while at < len(batch):
        parts, size = [], 0
        while at + len(parts) < len(batch) and (not parts or size < BYTES):
            parts.append(batch[at + len(parts)].encode())
            size += len(parts[-1]) + 1
        words, starts = word_hashes(b"\n".join(parts))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)])).tolist()
        n = max(0, len(words) - WIDTH + 1)
        total = np.zeros(n, np.uint64)
        for k in range(WIDTH if n else 0):
            total += words[k : k + n] * _WORDS[k]
        total = mixed(total)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            nodes[at + i] = sequence_hash(words[a:b])
            found.append(total[a : b - WIDTH + 1] if b - a >= WIDTH else nodes[at + i : at + i + 1])
        at += len(parts)
    return nodes.view(np.int64), found


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The BANDS keys of each text with these shingles; the upper half of a shingle's hash is ranked."""
    least, at = np.zeros((len(sets), BANDS * ROWS), np.uint32), 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= SHINGLES):
            size += len(sets[to])
            to += 1
        half = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        ranked = np.empty_like(half)
        for k, by in enumerate(_MINIMA):
            np.multiply(half, by, out=ranked)
            least[at:to, k] = np.minimum.reduceat(ranked, starts)
        at = to
    return mixed((mixed(least.astype(np.uint64)).reshape(-1, BANDS, ROWS) * _KEYS).sum(2, dtype=np.uint64) + _BAND).view(np.int64)


def key_lists(keys: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))


def box_fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of each box of shingles: a bit is 1 if set in over half of its hashes."""
    sizes = np.diff(np.r_[starts, len(hashes)])
    out = hashes[starts]
    several = sizes > 1
    if several.any():
        flat, size = hashes[np.repeat(several, sizes)], sizes[several]
        begins = np.r_[0, np.cumsum(size)[:-1]]
        found = np.zeros(len(size), np.uint64)
        for bit in np.arange(64, dtype=np.uint64):
            ones = np.add.reduceat((flat >> bit) & np.uint64(1), begins).astype(np.int64)
            found |= (2 * ones > size).astype(np.uint64) << bit
        out[several] = found
    return out


def ring_of(size: int, plain: frozenset[int]) -> int:
    """Boxes on the ring of texts of a class of sizes (all of so many bits); 0: one for each shingle."""
    top = 1 << size
    return 0 if top <= ALONE + 1 or size in plain else top // 3 if top > CROWDED else top // 2


def ring_keys(sets: list[np.ndarray], plain: frozenset[int] = frozenset()) -> tuple[list[np.ndarray], list[list[int]]]:
    """Of each text with these shingles its keys, and the classes of sizes in which it has too few boxes with a shingle.

    Texts of similarity 0.8 or more have a key in common. plain: classes in which each shingle has a box.
    """
    keys: list[list[np.ndarray]] = [[] for _ in sets]
    sparse: list[list[int]] = [[] for _ in sets]
    parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def done() -> None:
        sizes = [len(hashes) for _, hashes, _, _ in parts]
        offsets = np.cumsum([0, *sizes[:-1]])
        found = box_fingerprints(np.concatenate([h for _, h, _, _ in parts]), np.concatenate([b + o for (_, _, b, _), o in zip(parts, offsets, strict=True)]))
        found, at = mixed(mixed(found) + np.concatenate([place for *_, place in parts])).view(np.int64), 0
        for i, _, begins, _ in parts:
            keys[i].append(found[at : at + len(begins)])
            at += len(begins)
        parts.clear()

    classes, held = np.arange(64, dtype=np.uint64) * _KEYS[1], 0
    for i, found in enumerate(sets):
        own = np.unique(found)
        n = len(own)
        most = (n + n * 5 // 4) // 9 + 1  # one more than similar texts differ in
        for size in sorted({n.bit_length(), (n * 5 // 4).bit_length()}):
            ring = ring_of(size, plain)
            if ring:
                box = (own >> np.uint64(32)) * np.uint64(ring) >> np.uint64(32)
                begins = np.flatnonzero(np.r_[True, box[1:] != box[:-1]])
                if len(begins) < most:
                    sparse[i].append(size)
                box = box[begins[:most]] + np.uint64(1)
            else:
                begins = np.arange(n)
                box = np.zeros(min(n, most), np.uint64)
            to = begins[most] if len(begins) > most else n
            parts.append((i, own[:to], begins[:most], box * _KEYS[0] + classes[size]))
            held += int(to)
        if held > SHINGLES:
            done()
            held = 0
    if parts:
        done()
    return [np.concatenate(k) for k in keys], sparse


def sketch(own: np.ndarray) -> bytes:
    """Parities of the number of these shingles in 2 to 4 times as many places, 64 at least; the place is the hash modulo their number."""
    places = max(64, 1 << (len(own).bit_length() + 1))
    odd = np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def unparted(sizes: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """For each text the least member of its component, if those link whose sizes and sketches allow a similarity of 0.8."""
    least = min(map(len, sketches))
    rows = []
    for x in sketches:
        parity = np.frombuffer(x, np.uint64)
        rows.append(np.bitwise_xor.reduce(parity.reshape(-1, least // 8), 0))  # the places modulo a smaller number of them
    rows, label = np.array(rows), np.arange(len(sizes))
    for i in range(len(sizes) - 1):
        apart = np.bitwise_count(rows[i] ^ rows[i + 1 :]).sum(1, dtype=np.int64)
        low, high = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        close = (9 * apart <= low + high) & (OVER * high <= UNDER * low) & (label[i + 1 :] != label[i])
        other = np.flatnonzero(close) + i + 1
        if len(other):
            label = roots(len(sizes), np.full(len(other), i), other, label)
    return label


def pruned(cells: DataFrame) -> DataFrame:
    """Rows (key, node) of smaller cells, with those members of each cell of (key, x, y) whose sketches do not part them from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            label = unparted(np.array([h[1] for h in held], np.int64), [h[2] for h in held])
            left = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            keys = [xxh64_intdigest(repr((at, int(label[i]))), SEED) for i in left]
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([held[i][0] for i in left], pa.int64())], ["key", "node"])

        for batch in batches:
            for *cell, node, size, bits in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", "node", "size", "sketch")), strict=True):
                if cell != at:
                    if len(held) > 1:
                        yield done()
                    at, held = cell, []
                held.append((node, size, bits))
        if len(held) > 1:
            yield done()

    return cells.select("key", "x", "y", "node", "size", "sketch").mapInArrow(run, "key long, node long")


def dealt(members: DataFrame) -> DataFrame:
    """Rows (key, x, y, node): a key's members in one cell or, if many, in one for each pair of blocks."""
    blocks = F.when(F.col("members") > MEMBERS, F.ceil(F.col("members") / (MEMBERS // 2))).otherwise(F.lit(1).cast("long"))
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node")


def counted(shared: DataFrame) -> DataFrame:
    """key, node and the key's number of members; of keys with the same members one stays."""
    buckets = shared.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("which"))
    once = buckets.groupBy("members", "which").agg(F.min("key").alias("key")).drop("which")
    return shared.join(once, "key").select("key", "node", "members")


def ring_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, node, the ring's keys, size and sketch of every row, in a written table."""

    def table(plain: frozenset[int]) -> tuple[DataFrame, str]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sets = shingles(texts(batch))
            keys, sparse = ring_keys(sets, plain)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(nodes), pa.array(keys, pa.list_(pa.int64())), pa.array(sparse, pa.list_(pa.int32()))]
            own = [np.unique(x) for x in sets]
            columns += [pa.array([len(x) for x in own], pa.int64()), pa.array([sketch(x) for x in own], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "keys", "sparse", "size", "sketch"])

        return written(map_batches(docs.select("doc_id", "text"), "doc_id long, node long, keys array<long>, sparse array<int>, size long, sketch binary", run), "keyed")

    rows, path = table(frozenset())
    if few := [r[0] for r in rows.select(F.explode("sparse")).distinct().collect()]:  # at most 64 classes
        remove(docs.sparkSession, path)
        return table(frozenset(few))
    return rows, path


def noded(docs: DataFrame) -> DataFrame:
    """node and text of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shingles(texts(batch))[0]), batch.column("text")], ["node", "text"])

    return map_batches(docs.select("text"), "node long, text string", run)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sets that are similar enough, as many as connect what is connected."""
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    label, pairs = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        if (label == label[0]).all():
            break
        mark = np.zeros(int(flat.max()) + 1, np.int64)
        mark[flat[starts[i] : starts[i + 1]]] = 1
        both = np.add.reduceat(mark[flat[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
        close = UNDER * both >= OVER * (sizes[i] + sizes[i + 1 :] - both)
        other = np.flatnonzero(close & (label[i + 1 :] != label[i])) + i + 1
        if len(other):
            pairs += [(i, int(j)) for j in other]
            label = roots(len(sets), np.full(len(other), i), other, label)
    return pairs


def compared(cells: DataFrame) -> DataFrame:
    """Links (a, b) among the texts of each cell of (key, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            pairs = forest(sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "x", "y", "node")]
            seen, sets_ = shingles(texts(batch))
            for *cell, node, own, found in zip(*columns, seen.tolist(), sets_, strict=True):
                if own != node:  # another row of the same id
                    continue
                if cell != at:
                    if len(sets) > 1:
                        yield done()
                    at, nodes, sets = cell, [], []
                nodes.append(node)
                sets.append(np.unique(found))
        yield done()

    return cells.mapInArrow(run, "a long, b long")


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, broadcast if its checked number of rows allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_keys(under: DataFrame) -> DataFrame:
    """The distinct rows (key, node) whose key has several nodes; each is shuffled once and a key's rows pass by one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it has been passed on
        for batch in batches:
            key, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node"))
            sent = False
            if last is not None:
                key, node, sent = np.r_[last[0], key], np.r_[last[1], node], last[2]
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[new], node[new]
            same = key[1:] == key[:-1]
            out = np.r_[False, same] | np.r_[same, False]
            last = (key[-1], node[-1], bool(out[-1]) or (sent and len(key) == 1))
            out[0] &= not sent
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], ["key", "node"])

    return under.select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def links_of(members: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among the texts of each key of ``members`` (key, node, members). wanted: node and _id, a row's doc_id, of all of them."""
    # a text is read again by one of its ids (those without one by their words); other rows of that id are told apart by their words
    wanted = wanted.join(members.select("node").distinct(), "node", "left_semi")
    found = docs.select("doc_id", "text").join(small(wanted.where("_id IS NOT NULL")), F.col("doc_id") == F.col("_id")).select("node", "text")
    found = found.unionByName(noded(docs.where("doc_id IS NULL")).join(wanted.where("_id IS NULL").select("node"), "node", "left_semi"))
    found = found.withColumn("_hash", F.xxhash64("text")).repartition("node").dropDuplicates(["node", "_hash"]).drop("_hash")
    cells = dealt(members).join(found, "node")
    return compared(cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"))


def linked_nodes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """node and root of the texts that are near copies of another; rows: doc_id, node and keys of rows of ``docs``, and size and sketch if they have any."""
    spark = docs.sparkSession
    once = rows.groupBy("node").agg(F.first("keys").alias("keys"))  # so that copies do not meet under every key
    shared, shared_path = written(shared_keys(once.select("node", F.explode("keys").alias("key"))), "shared")
    if "sketch" in rows.columns:
        each, each_path = written(counted(shared), "shared")
        sketches = rows.select("node", "size", "sketch").join(each.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        cells = dealt(each).join(sketches, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        remove(spark, shared_path)
        shared, shared_path = written(pruned(cells), "shared")
        remove(spark, each_path)
    members, path = written(counted(shared), "members")
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("_id"))
    wanted, wanted_path = written(ids.join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    best = members.groupBy("node").agg(F.max(F.struct("members", "key")).alias("best"))
    best, best_path = written(best.select("best.key").distinct(), "best")
    links, links_path = written(links_of(members.join(best, "key", "left_semi"), wanted, docs), "copy-links")
    first, first_path = written(components(links), "connected")
    root = F.coalesce("root", "node")
    open_ = members.join(best, "key", "left_anti").join(first, "node", "left").groupBy("key").agg(F.min(root).alias("low"), F.max(root).alias("high"))
    rest, rest_path = written(members.join(open_.where("low <> high").select("key"), "key", "left_semi"), "rest")
    joined, more_path = first, None
    if rest.limit(1).count():
        more, more_path = written(links_of(rest, wanted, docs), "copy-links")
        joined = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    for p in (shared_path, path, wanted_path, best_path, links_path, rest_path, more_path):
        if p:
            remove(spark, p)
    return joined


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that have a near copy of smaller doc_id, directly or over others.

    Of rows that share a doc_id one stays, that with the least text; rows without one stay. Documents that tie share their component's smallest id.
    """
    spark = docs.sparkSession
    rows, path = ring_keyed(docs)
    linked, linked_path = written(linked_nodes(rows, docs), "copies")
    of = rows.select("doc_id", "node").join(small(linked), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    least, least_path = written(of.groupBy("root").agg(F.min("doc_id").alias("component"), F.count("*").alias("members")).where("members > 1").drop("members"), "least")
    each = of.where("doc_id IS NOT NULL").join(small(least), "root", "left").groupBy("doc_id").agg(F.min("component").alias("component"), F.count("*").alias("copies"))
    marked, _ = written(each.where("component < doc_id OR copies > 1").selectExpr("doc_id AS _id", "coalesce(component < doc_id, false) AS _gone"), "marked")
    for p in (path, linked_path, least_path):
        remove(spark, p)
    packed = docs.select("doc_id", F.struct(*docs.columns).alias("_row")).join(small(marked), F.col("doc_id") == F.col("_id"), "left")  # so no name of theirs clashes
    once = packed.where("_id IS NULL").select("_row.*")
    return once.unionByName(packed.where("NOT _gone").groupBy("doc_id").agg(F.min_by("_row", F.coalesce("_row.text", F.lit(""))).alias("_row")).select("_row.*"))
