"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from logquarry.llm import bpe, line_templates, mixing, quality, simhash
from logquarry.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n))


ODD = [None, "", " \t\n", "a", "A b", "x y z", "é b \x1cq", "long " * 30000, "tie one", "tie one", "a\nb\na\n\na", "\U0001f600 # | <> 5%"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD)]
    return docs_of(spark, [*rows, rows[3], (None, "no id", None), (None, None, None)])


def with_clashes(df):
    from pyspark.sql import functions as F

    for name in ("size", "target", "taken", "shard", "template", "tokens", "key", "fp", "component_id", "count", "score", "kept", "quality", "label", "row", "leaf", "features", "end", "copy", "node", "root"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_rule_statistics_match_brute_force():
    r = random.Random(5)
    made = ["".join(r.choice("ab  \n|#\té") for _ in range(r.randint(0, 200))) for _ in range(300)]
    for text in [*made, *[t or "" for t in ODD if t is None or len(t) < 1000]]:
        assert quality.statistics(text)[0] == brute_statistics(text), text


def test_quality_rules_reject_junk_and_keep_clean(spark, odd):
    good = [(i, prose(i, 120), "s") for i in range(200)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(i, 120).split()), "s") for i in range(40)]
    docs = docs_of(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in [*good, *bad] if i % 2 == 0] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.quality_rules(with_clashes(docs), labels).collect()}
    assert len(found) == 240
    assert all(found[i].kept for i, _, _ in good) and not any(found[i].kept for i, _, _ in bad)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in good}
    rows = quality.quality_rules(odd, labels.limit(0)).collect()  # no labels: only the base rules
    assert len(rows) == odd.count() and not any(r.kept for r in rows)  # all under 50 words or repeated
    assert quality.quality_rules(odd.limit(0), labels).count() == 0


def brute_components(rows):
    fps = []
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append((i, sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))))
    label = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 3 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(fps, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return Counter((i, f"{fp:016x}", least.get(x)) for (i, fp), x in zip(fps, label, strict=True))


def near_corpus():
    r = random.Random(11)
    rows = []
    for k in range(60):
        words = prose(k, r.choice([2, 5, 30, 200])).split()
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(words)
            if r.random() < 0.7:
                copy[r.randrange(len(copy))] = "changed" + str(r.random())
            rows.append((len(rows), " ".join(copy), "s"))
    return rows


def test_simhash_matches_brute_force(spark, odd):
    docs = docs_of(spark, near_corpus()).unionByName(odd.selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars"))
    found = simhash.near_duplicates(with_clashes(docs).drop("component_id")).collect()
    expected = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in expected if c is not None})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_large_keys_and_pigeonring(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for a, b, c in rng.integers(0, 64, (12, 3))])).view(np.int64)
    key, fp, home = simhash.chain_keys(fps)
    order = np.argsort(key, kind="stable")
    a, b = simhash.forest(key[order], fp[order], home[order])
    n = len(fps)
    at = {int(x): i for i, x in enumerate(fps)}
    got = simhash.roots(n, np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    pairs = [(i, j) for i in range(n) for j in range(i) if bin(int(fps[i]) & (2**64 - 1) ^ int(fps[j]) & (2**64 - 1)).count("1") <= 3]
    assert len(pairs) > 100
    assert (got == simhash.roots(n, *np.array(pairs).T)).all()
    monkeypatch.setattr(simhash, "MEMBERS", 4)  # on the driver: the number of blocks; the rows meet in pairs of blocks
    hot = [(7, int(x), bool(h)) for x, h in zip(fps, rng.random(n) < 2, strict=True)]
    rows = spark.createDataFrame(hot, "key long, fp long, home boolean")
    got = simhash.large_keys(rows).collect()
    linked = simhash.linked(np.full(1, 7), fps[:1], fps[:1])
    assert linked.all()
    pairs = [(i, j) for i, j in pairs if simhash.linked(np.full(1, 7), fps[i : i + 1], fps[j : j + 1])[0]]
    found = simhash.roots(n, np.array([at[r.fp] for r in got], int), np.array([at[r.other] for r in got], int))
    assert (found == simhash.roots(n, *np.array(pairs).T)).all()


def test_compare_passes_on_large_keys(spark):
    many = [(1, i * 7919, True) for i in range(simhash.MEMBERS + 40)]
    rows = spark.createDataFrame([*many, (2, 5, True), (2, 4, False)], "key long, fp long, home boolean")
    found = simhash.compare(rows.repartition(1, "key").sortWithinPartitions("key")).collect()
    assert sum(r.key == 1 for r in found) == len(many)
    assert {(r.fp, r.other) for r in found if r.key is None} in ({(4, 5)}, {(5, 4)})


def test_components_of_a_long_chain(spark):
    n = 300
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:], strict=True)) + [(1000, 1001), (1002, 1001), (2000, 2000)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in ids} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert simhash.components(edges.limit(0)).count() == 0


def test_targets_and_quotas():
    sizes = np.array([1, 10, 1000, 50, 0])
    target = mixing.targets(sizes, np.arange(5) % 3 + 1.0)
    assert abs(target.sum() - sizes.sum()) < 1e-6 and (target <= 3 * sizes + 1e-9).all()
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes, seats = rng.integers(0, 500, 6).astype(float), int(rng.integers(0, 200))
        most = rng.integers(0, 90, 6)
        got, dealt = mixing.sainte_lague(votes, most, seats), np.zeros(6, int)
        for _ in range(min(seats, int(most[votes > 0].sum()))):
            dealt[int(np.argmax(np.where(dealt < most, votes / (2 * dealt + 1), -1.0)))] += 1
        assert (got == dealt).all()


def test_mix_meets_targets(spark, odd):
    rows = [(i, prose(i, 5 + i % 90), f"src{i % 7}" if i % 2 else "src0") for i in range(900)]
    docs = docs_of(spark, rows)
    found = mixing.mix(with_clashes(docs), shard_words=900).toPandas()
    assert len(found) == 900 and (found["size"] == [5 + i % 90 for i in found.doc_id]).all()
    assert (found.taken <= 3 * found["size"]).all() and (found.taken >= 0).all()
    source = found.doc_id.map(lambda i: rows[i][2])
    for _, part in found.groupby(source):
        assert part["size"].sum() == part.source_size.iloc[0]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= max(0.02 * part.target.iloc[0], 20)
    again = mixing.mix(docs.repartition(7), shard_words=900).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    copies = mixing.mixed(with_clashes(docs), shard_words=900)
    assert copies.columns == with_clashes(docs).columns and max(Counter(r.doc_id for r in copies.collect()).values()) <= 3
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0


def test_bpe_equals_the_reference_library(spark, odd):
    import tiktoken

    path, pattern = tokenizer()
    own = bpe.encoder(open(path, "rb").read(), pattern)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    made = ["".join(r.choice("abc thei\né\U0001f600!'s1") for _ in range(r.randint(0, 90))) for _ in range(400)]
    made += ["a" * 3000, "ab" * 900, "".join(r.choice("etaoin") for _ in range(2000)), "", " " * 500, "<|endoftext|>"]
    got = own.encode_batch(made)
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in made]
    assert [own.decode(x).decode() for x in got] == made
    for row, text in zip(bpe.token_digests(odd, path, pattern).collect(), [r.text for r in odd.collect()], strict=True):
        ids = library.encode_ordinary(text or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, path, pattern), path, pattern).collect()
    assert [r.text for r in back] == [r.text or "" for r in odd.collect()]
    assert bpe.token_digests(odd.limit(0), path, pattern).count() == 0


def test_line_templates(spark, odd):
    rows = []
    for i in range(60):
        lines = [prose(1000 + 10 * i + k, 9) for k in range(3)]
        if i % 2:
            lines.insert(i % 3, "Licensed under the public license version 2 of the project.")
        if i % 3 == 0:
            lines.append(f"session opened for user {prose(5000 + i, 1)} who logged in from terminal {i} just today")
        rows.append((i, "\n".join(lines), "s"))
    copy = "\n".join(prose(9000 + k, 12) for k in range(4))
    rows += [(100 + i, copy, "s") for i in range(30)]
    near = [prose(9100 + k, 12) for k in range(12)]
    rows += [(200 + i, "\n".join([*near[: i % 12], near[i % 12] + " changed", *near[i % 12 + 1 :]]), "s") for i in range(30)]
    docs = docs_of(spark, rows)
    found = line_templates.drop_recurring_lines(with_clashes(docs))
    assert found.columns == with_clashes(docs).columns
    got = {r.doc_id: r for r in found.collect()}
    for i, text, _ in rows:
        expected = "\n".join(x for x in text.split("\n") if not x.startswith(("Licensed", "session opened")))
        assert got[i].text == expected and got[i].n_chars == len(expected)
    report = {r.doc_id: r for r in line_templates.line_report(docs).collect()}
    assert report[1].n_dropped == 1 and report[3].n_dropped == 2 and report[100].n_dropped == 0
    same = line_templates.drop_recurring_lines(odd)
    assert Counter((r.doc_id, r.text) for r in same.collect()) == Counter((r.doc_id, r.text) for r in odd.collect())
    assert line_templates.drop_recurring_lines(odd.limit(0)).count() == 0


def test_threshold_is_infinite_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, labels) == (None, math.inf)


def test_threshold_is_of_least_error():
    r = random.Random(14)
    for _ in range(50):
        clean, junk = [np.array([round(r.gauss(m, 0.1), 2) for _ in range(r.randint(1, 40))]) for m in (0.4, 0.7)]
        error = lambda t, c=clean, j=junk: 10 * (c >= t).mean() + (j < t).mean()
        t = quality.calibrated(clean, junk, 10.0)
        assert error(t) <= min([error(x + d) for x in [*clean, *junk] for d in (-1e-6, 1e-6)] + [error(math.inf)]) + 1e-9
    clean = np.r_[np.linspace(0.3, 0.6, 200), 0.9]
    assert 0.6 < quality.calibrated(clean, np.full(50, 0.8), 10.0) < 0.8  # one odd good row among many


def test_all_labelled_documents_count(spark):
    r = random.Random(15)
    rows = [(i, " ".join([*(f"w{k}" for k in range(60)), *["a#"] * (i % 3)]), "s") for i in range(5000)]
    docs = docs_of(spark, [*rows, rows[7], (9000, "too short", "s")])
    labels = spark.createDataFrame([(i, int(r.random() < 0.8), 0) for i in [*range(5000), 9000, 9001]], "doc_id long, quality int, toxic int")
    known = quality.labelled(quality.measured(docs), labels)
    assert known.count() == 5000 and known.where("good").count() == labels.where("quality > 0 AND doc_id < 5000").count()
    # each tree draws its own rows from all that may grow it
    drawn = quality.subsamples(known, 5000, 20, 50, 3)
    ids = {q.doc_id: q.features for q in known.collect()}
    every = np.array(sorted(ids))
    for t, found in enumerate(drawn):
        first = every[np.argsort(quality.ranks(every, t, 3))[:50]]
        assert found.tolist() == [ids[i] for i in first.tolist()]
    # an only bad row that looks odd is found among thousands, whatever its hash
    for i in (1, 2500, 4999):
        bad = docs_of(spark, [(j, t + " ###" * 60 * (j == i), s) for j, t, s in rows])
        one = spark.createDataFrame([(j, int(j != i), 0) for j in range(5000)], "doc_id long, quality int, toxic int")
        forest, threshold = quality.fit(bad, one, trees=16)
        assert forest and forest.score(np.array([quality.statistics(rows[0][1] + " ###" * 60)[1]]))[0] >= threshold


def test_threshold_over_a_table_is_that_over_arrays(spark):
    r = random.Random(16)
    for digits, n in ((2, 300), (9, 300), (1, 1)):
        clean, junk = [np.array([min(1.0, abs(round(r.gauss(m, 0.15), digits))) for _ in range(n)]) for m in (0.4, 0.6)]
        scored = spark.createDataFrame([(float(x), True) for x in clean] + [(float(x), False) for x in junk], "score double, good boolean")
        assert quality.calibrated_over(scored, 3.0) == quality.calibrated(clean, junk, 3.0)
