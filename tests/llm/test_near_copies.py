"""Near copies against brute force over five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from logquarry.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n)]


def brute_kept(rows):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted({i for (i, _), x in zip(rows, label, strict=True) if i is not None and least[x] == i})


def corpus():
    r = random.Random(31)
    rows = []
    for _ in range(50):
        words = prose(r, r.choice([3, 12, 60, 300]))
        for _ in range(r.choice([1, 2, 5])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 3, 6, 12])):
                copy[r.randrange(len(copy))] = "changed" + str(r.random())
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (900, ""), (901, None), (902, " \n"), (3, rows[3][1]), (None, "no id"), (None, rows[5][1])]


def test_stage_drops_near_copies_by_similarity(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == brute_kept(rows) and ids.count(None) == 2
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_large_keys_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 8)  # on the driver: the number of blocks
    r = random.Random(7)
    base = prose(r, 200)
    rows = [(i, " ".join([*base[: 5 * i], f"changed{i}", *base[5 * i + 1 :]])) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert [x.doc_id for x in near_copies.near_dedup(docs).collect()] == [0] == brute_kept(rows)


def pair_of(r, n, inside):
    """Sets of numbers of similarity 0.8 or barely more: one replaced or, ``inside``, one within the other."""
    x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
    if inside:
        return x, x[np.sort(r.sample(range(n), -(-4 * n // 5)))]
    gone = n // 9
    return x, np.unique(np.r_[x[np.sort(r.sample(range(n), n - gone))], np.array([r.getrandbits(64) for _ in range(gone)], np.uint64)])


def test_no_similar_pair_is_without_a_common_key():
    r = random.Random(3)
    for k in range(4000):
        x, y = pair_of(r, r.choice([1, 2, 4, 5, 9, 25, 31, 32, 40, 63, 64, 80, 127, 128, 255, 256, 300, 511, 512]), k % 2)
        both = len(np.intersect1d(x, y))
        assert 5 * both >= 4 * (len(x) + len(y) - both)
        for plain in (frozenset(), frozenset({7, 8})):
            (a, b), sparse = near_copies.ring_keys([x, y], plain)
            assert len(np.intersect1d(a, b)) and not any(sparse)
        assert near_copies.unparted(np.array([len(x), len(y)]), [near_copies.sketch(x), near_copies.sketch(y)]).tolist() == [0, 0]


def test_the_least_similar_pairs_link_however_many(spark):
    # similarity 0.8 exactly, 8 of 10 shingles: MinHash keys would find each with near certainty only; here by construction all
    r = random.Random(4)
    rows = []
    for k in range(300):
        words = prose(r, 14)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:12]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(x.doc_id for x in near_copies.near_dedup(docs).collect()) == [i for i, _ in rows if i % 2 == 0] == brute_kept(rows)


def test_crowded_shingles_get_boxes_for_themselves(spark):
    # all hashes in one box: too few boxes to be sure of a common one, so the class is done again without boxes
    x = np.arange(100, dtype=np.uint64)
    keys, sparse = near_copies.ring_keys([x])
    assert sparse == [[7]] and len(keys[0]) == 1
    (a, b), sparse = near_copies.ring_keys([x, x[10:]], frozenset({7}))
    assert sparse == [[], []] and len(np.intersect1d(a, b))


def test_box_fingerprints_are_majorities():
    r = random.Random(6)
    hashes = np.array([r.getrandbits(64) for _ in range(40)], np.uint64)
    starts = np.array([0, 1, 3, 6, 20])
    for got, a, b in zip(near_copies.box_fingerprints(hashes, starts).tolist(), starts, [1, 3, 6, 20, 40], strict=True):
        assert got == sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes[a:b].tolist()) * 2 > b - a)


def test_shared_keys_over_batches(spark):
    r = random.Random(8)
    rows = [(r.randrange(60), r.randrange(40)) for _ in range(300)] + [(1000, k) for k in range(50)] + [(1001, 5)] * 30
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = [tuple(x) for x in near_copies.shared_keys(spark.createDataFrame(rows, "key long, node long")).collect()]
            assert sorted(found) == sorted((k, n) for k, ns in nodes.items() if len(ns) > 1 for n in ns)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
