"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows.

Rule statistics of each whole text come first (words are runs of characters other than space and
\\x09-\\x0D). Seeded random splits over a bounded sample of good labelled rows make the trees; a
document that few splits isolate has short paths and a high anomaly score. The threshold is calibrated on labelled
rows that grew no tree: it has the least sum of the share of bad rows kept and ``clean_weight`` times the share
of good rows rejected, so that one odd good row does not let all the bad ones pass.

Defined results: a null text counts as the empty text; empty and wordless texts have zero statistics and
fail the base rule; texts of any length are measured whole; repeated rows and ties get equal results, of rows that
share a labelled doc_id that with the least features is the label's; an empty table gives an empty result; without
usable labels no document is rejected by the forest; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remove, texts, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_rate", "upper_rate", "exclaim_rate", "dup_line_rate", "repeat_rate")
#: A rate of this size is halfway between none and certain: most good texts have a rate of nil.
HALF_RATE = 0.05
#: Ranges of scores whose cuts are compared side by side, and bits of a hash of which the most even one halves the good rows.
BINS, SPLITS = 4096, 16
#: What ``measured`` returns.
MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, features array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Positions that lie in a three-word window found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, window, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics in the order of BASE, and the forest's features in the order of FEATURES."""
    words = text.encode().split()  # bytes split at exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    base = [n, chars, symbols, dup_lines, repeat]
    if not n:
        return base, [0.0] * len(FEATURES)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    rates = (symbols / n, upper / n, text.count("!") / n)
    return base, [*(r / (r + HALF_RATE) for r in rates), dup_lines / len(lines), repeat / n]


def base_failed(base: list[int]) -> bool:
    return base[0] < 50 or 100 * base[4] > 50 * base[0]


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows in a random binary tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits in flat arrays; ``score`` is in (0, 1], higher for rows isolated sooner."""

    def __init__(self, samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, seed: int = 42):
        """samples: of each tree, rows of what counts as normal. low, high: the box that splits are drawn from; it also covers values no normal row has."""
        most = max(map(len, samples))
        self.norm = float(mean_path(most)) or 1.0
        self.trees = [self._grow(rows, low, high, np.random.default_rng([seed, k]), math.ceil(math.log2(max(most, 2)))) for k, rows in enumerate(samples)]

    @staticmethod
    def _grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, most: int) -> tuple[np.ndarray, ...]:
        feature, cut, child, length = [], [], [], []

        def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(-1), cut.append(0.0), child.append((0, 0)), length.append(depth + float(mean_path(len(part))))
            usable = np.flatnonzero(high > low)
            if depth < most and len(part) > 1 and len(usable):
                f = int(rng.choice(usable))
                c = float(rng.uniform(low[f], high[f]))
                below, above = high.copy(), low.copy()
                below[f] = above[f] = c
                feature[at], cut[at] = f, c
                child[at] = (node(part[part[:, f] <= c], low, below, depth + 1), node(part[part[:, f] > c], above, high, depth + 1))
            return at

        node(rows, low, high, 0)
        return np.array(feature), np.array(cut), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (feature[at] >= 0).any():
                f = feature[at]
                right = rows[every, np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, child[at, right.astype(np.int64)], at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and the features of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts(batch)]
        columns = [pa.array([b[i] for b, _ in found], pa.int64()) for i in range(len(BASE))]
        failed, features = pa.array([base_failed(b) for b, _ in found], pa.bool_()), pa.array([f for _, f in found], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns, failed, features], ["doc_id", *BASE, "base_failed", "features"])

    return map_batches(docs.select("doc_id", "text"), MEASURED, run)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, features and ``good`` of every labelled document. rows: what ``measured`` returns.

    Those that fail the base rules are left out: the forest judges only what the base rules pass.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    passed = rows.where("doc_id IS NOT NULL AND NOT base_failed").select("doc_id", "features").join(known, "doc_id")
    return passed.groupBy("doc_id").agg(F.min("features").alias("features"), F.min("good").alias("good"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(FEATURES))


def ranks(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A seeded random number for each id in a tree's draw."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1342543DE82EF95) % (1 << 64))
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def subsamples(rows: DataFrame, n: int, trees: int, sample: int, seed: int) -> list[np.ndarray]:
    """For each tree the features of those ``sample`` of all n rows that its draw ranks first."""
    most = min(sample, n)
    cut = min(1.0, (most + 8 * math.sqrt(most) + 8) / n) * 2.0**64  # ranked below it by chance: never too few, and seldom many more

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        drawn = [(t, at, r[at]) for t in range(trees) for r in [ranks(ids, t, seed)] for at in [np.flatnonzero(r.astype(float) < cut) if cut < 2.0**64 else np.arange(len(r))]]
        tree = np.concatenate([np.full(len(at), t, np.int32) for t, at, _ in drawn])
        rank = np.concatenate([r for _, _, r in drawn]).view(np.int64)
        at = pa.array(np.concatenate([at for _, at, _ in drawn]))
        return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(rank), batch.column("doc_id").take(at), batch.column("features").take(at)], ["tree", "rank", "doc_id", "features"])

    got = map_batches(rows.select("doc_id", "features"), "tree int, rank long, doc_id long, features array<double>", run).toArrow()  # some trees * sample rows
    tree, rank, ids = (got.column(c).to_numpy() for c in ("tree", "rank", "doc_id"))
    order, features = np.lexsort((ids, rank.view(np.uint64), tree)), matrix(got.column("features"))
    begins = np.searchsorted(tree[order], np.arange(trees))
    return [features[order[b:e][:most]] for b, e in zip(begins, [*begins[1:], len(order)], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, **parameters) -> tuple[IsolationForest | None, float]:
    """Forest and score threshold from all labelled documents."""
    return fitted(measured(docs), labels, **parameters)


def fitted(rows: DataFrame, labels: DataFrame, clean_weight: float = 10.0, trees: int = 128, sample: int = 256, seed: int = 42) -> tuple[IsolationForest | None, float]:
    """As ``fit``, from what ``measured`` returns: half of the good rows grow the trees, all other labelled rows calibrate."""
    known, path = written(labelled(rows, labels).withColumn("hash", F.xxhash64("doc_id", F.lit(seed))), "labelled")
    halves = [F.count_if(F.col("good") & (F.shiftright("hash", k).bitwiseAND(1) == 0)).alias(f"half{k}") for k in range(SPLITS)]
    box = [f(F.col("features")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(len(FEATURES))]
    total = known.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), *halves, *box).first()
    if total.good < 8 or not total.bad:
        remove(rows.sparkSession, path)
        return None, math.inf
    bit = min(range(SPLITS), key=lambda k: abs(2 * total[f"half{k}"] - total.good))
    grows = F.col("good") & (F.shiftright("hash", bit).bitwiseAND(1) == 0)
    low, high = (np.array([total[f"{name}{k}"] for k in range(len(FEATURES))]) for name in ("low", "high"))
    forest = IsolationForest(subsamples(known.where(grows), total[f"half{bit}"], trees, sample, seed), low, high, seed)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(forest.score(matrix(batch.column("features")))), batch.column("good")], ["score", "good"])

    scored = map_batches(known.where(~grows).select("features", "good"), "score double, good boolean", score)
    threshold = calibrated_over(scored, clean_weight)
    remove(rows.sparkSession, path)
    return forest, threshold


def best_cut(scores: np.ndarray, clean: np.ndarray, junk: np.ndarray, before: tuple[int, int], total: tuple[int, int], after: float, clean_weight: float) -> tuple[float, float]:
    """Least weighted error and its threshold among those above the given scores, midway to the next one; of equals the highest.

    scores: distinct and in order; clean, junk: rows of each; before: rows of less score; after: the next score, or infinity.
    """
    following = np.r_[scores[1:], after]
    cuts = (scores + following) / 2
    cuts = np.where(cuts > scores, cuts, following)
    rejected = 1 - (before[0] + np.cumsum(clean)) / max(total[0], 1)
    kept = (before[1] + np.cumsum(junk)) / max(total[1], 1)
    error = clean_weight * rejected + kept
    at = len(cuts) - 1 - int(error[::-1].argmin())
    return float(error[at]), float(cuts[at])


def calibrated(clean: np.ndarray, junk: np.ndarray, clean_weight: float) -> float:
    """The threshold of least weighted error over the scores of good and bad rows; rejecting nothing counts too."""
    scores, at = np.unique(np.r_[clean, junk], return_inverse=True)
    counts = [np.bincount(x, minlength=len(scores)) for x in (at[: len(clean)], at[len(clean) :])]
    return best_cut(scores, *counts, (0, 0), (len(clean), len(junk)), math.inf, clean_weight)[1]


def calibrated_over(scored: DataFrame, clean_weight: float) -> float:
    """``calibrated`` over the rows (score, good) of a table: ranges of scores side by side, each knowing what lies below it."""
    each = scored.groupBy("score").agg(F.count_if("good").alias("clean"), F.count_if(~F.col("good")).alias("junk"))
    each, path = written(each.withColumn("bin", F.floor(F.col("score") * BINS).cast("int")), "scores")
    bins = each.groupBy("bin").agg(F.sum("clean").alias("clean"), F.sum("junk").alias("junk"), F.min("score").alias("least")).orderBy("bin").collect()  # at most BINS + 1
    sums = np.cumsum([(0, 0), *((b.clean, b.junk) for b in bins)], 0).tolist()
    after = [*(b.least for b in bins[1:]), math.inf]
    known = {b.bin: (tuple(sums[k]), tuple(sums[-1]), after[k]) for k, b in enumerate(bins)}

    def run(group: pa.Table) -> pa.Table:
        score, clean, junk, at = (group.column(c).to_numpy() for c in ("score", "clean", "junk", "bin"))
        order = np.argsort(score)
        error, cut = best_cut(score[order], clean[order], junk[order], *known[int(at[0])], clean_weight)
        return pa.table({"error": pa.array([error]), "cut": pa.array([cut])})

    found = each.groupBy("bin").applyInArrow(run, "error double, cut double").collect()
    remove(scored.sparkSession, path)
    return min(((r.error, -r.cut) for r in found), default=(0.0, -math.inf))[1] * -1


class Rules:
    """Base rules and forest over measured texts."""

    def __init__(self, rows: DataFrame, labels: DataFrame, **parameters):
        self.forest, self.threshold = fitted(rows, labels, **parameters)

    def __call__(self, failed: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and kept."""
        score = self.forest.score(features) if self.forest and len(features) else np.zeros(len(features))
        return score, ~failed & (score < self.threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row for each document: the base statistics, base_failed, the anomaly score and the verdict ``kept``; texts are read once."""
    rows, _ = written(measured(docs), "measured")
    rules = Rules(rows, labels, **parameters)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, kept = rules(batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool), matrix(batch.column("features")))
        columns = [batch.column(c) for c in ("doc_id", *BASE, "base_failed")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(kept)], ["doc_id", *BASE, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return map_batches(rows, schema, judge)


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; judged beside the row, so no text is shuffled."""
    rules = Rules(measured(docs), labels, **parameters)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t) for t in texts(batch)]
        failed = np.array([base_failed(b) for b, _ in found], bool)
        return batch.filter(pa.array(rules(failed, np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))[1], pa.bool_()))

    return map_batches(docs, docs.schema, judge)
