"""Line dedup by a log-template tree: lines whose template recurs across documents are dropped.

A line's tokens that hold a digit are variable fields. The tree has a fixed depth: under the token count
and then the first ``DEPTH`` tokens come the leaves, named by a hash of that path, so that a level is a grouped
aggregation and no node of the tree is ever in one task. In a leaf, tokens that enough contexts share at
their position stay and the others are generalised too, provided that enough of the tokens stay; the
result is the line's template, which other lines of the leaf have too that recur as they are.

A template recurs if documents of ``min_docs`` contexts or more hold it, of ``long_docs`` if it has ``LONG`` tokens
or more: so long a line is no coincidence. A document's context is its group of near copies (``near_copies``:
five-word Jaccard of 0.8 or more, directly or over others that hold such lines), whatever lines recur beside it.
So copies count once: they are for document dedup. A line of fewer than ``SHORT`` tokens goes only beside a line that goes.

Contexts are at most as many as texts. So texts are counted first, and only lines of leaves that enough texts hold
go on, only their documents are sought copies of, and only their tokens are read.

Defined results: a null text stays null and an empty one empty; lines of any length are whole; a document whose
lines all go becomes empty but stays; rows without a doc_id stay as they are and do not count; rows that share a
doc_id count each by its text and lose the same templates; templates that tie are independent of one another; an
empty table gives an empty result; columns of other names, whatever they are, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from . import near_copies
from .common import map_batches, remove, texts, written

DEPTH, FIELD, SHORT, LONG = 3, "<*>", 3, 50
_DIGIT = re.compile(r"[0-9]")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(line: str) -> list[str]:
    """The line's tokens, variable fields as FIELD."""
    tokens = line.split()
    return [FIELD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def template_of(tokens: list[str]) -> int:
    return signed(xxh64_intdigest(" ".join(tokens)))


def leaf_of(tokens: list[str]) -> int:
    return signed(xxh64_intdigest(f"{len(tokens)} " + " ".join(tokens[:DEPTH])))


def parsed(docs: DataFrame) -> DataFrame:
    """A row for each document: its id, node (its text's identity), keys for copies, and its templates with their leaves and token counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sets = near_copies.shingles(texts(batch))
        rows = []
        for text in texts(batch):
            found: dict[int, tuple[int, int]] = {}
            for line in text.split("\n"):
                if (tokens := masked(line)) and (template := template_of(tokens)) not in found:
                    found[template] = leaf_of(tokens), len(tokens)
            rows.append(found)
        ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        flat = ([t for r in rows for t in r], [x for r in rows for x, _ in r.values()], [n for r in rows for _, n in r.values()])
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in zip(flat, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(nodes), near_copies.key_lists(near_copies.band_keys(sets)), *lists], ["doc_id", "node", "keys", "template", "leaf", "n"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, node long, keys array<long>, template array<long>, leaf array<long>, n array<int>", run)


def enough(min_docs: int, long_docs: int) -> Column:
    """Contexts from which a template of ``n`` tokens recurs."""
    return F.when(F.col("n") >= LONG, long_docs).otherwise(min_docs)


def recurring(rows: DataFrame, key: str, by: str, least: Column) -> DataFrame:
    """key and n of what enough values of ``by`` hold."""
    return rows.select(key, "n", by).distinct().groupBy(key, "n").count().where(F.col("count") >= least).select(key, "n")


def numbers(df: DataFrame) -> np.ndarray | None:
    """The one column of ``df`` in order, if its checked number of rows allows to send it to every task."""
    if df.count() > near_copies.BROADCAST_ROWS:
        return None
    return np.sort(np.array([r[0] for r in df.collect()], np.int64))


def among(values: list[int], known: np.ndarray) -> np.ndarray:
    own = np.array(values, np.int64)
    if not len(known):
        return np.zeros(len(own), bool)
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def places_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """template and its tokens' places (a token at its position in its leaf as one number). wanted: template and the id of a document that has it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [t for t in map(masked, {line: None for text in texts(batch) for line in text.split("\n")}) if t]
        known: dict[str, int] = {}
        hashes = [[known[w] if w in known else known.setdefault(w, xxh32_intdigest(w) - (1 << 31)) for w in t] for t in tokens]
        columns = [pa.array(list(map(f, tokens)), pa.int64()) for f in (template_of, leaf_of)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.list_(pa.int32()))], ["template", "leaf", "tokens"])

    few = docs.select("doc_id", "text").join(near_copies.small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").select("text")
    own = map_batches(few, "template long, leaf long, tokens array<int>", run).join(near_copies.small(wanted.select("template")), "template", "left_semi").dropDuplicates(["template"])
    return own.select("template", F.transform("tokens", lambda token, i: F.xxhash64("leaf", i, token)).alias("places"))


def recurring_templates(docs: DataFrame, min_docs: int, long_docs: int, similarity: float) -> DataFrame:
    """Column ``template``, a written table: masked lines that recur themselves or whose generalised template does."""
    spark, least, paths = docs.sparkSession, enough(min_docs, long_docs), []

    def put(df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        paths.append(path)
        return df

    docs = docs.where("doc_id IS NOT NULL")
    all_ = put(parsed(docs), "parsed")
    lines = all_.select("doc_id", "node", F.inline(F.arrays_zip("template", "leaf", "n")))
    leaves = put(recurring(lines, "leaf", "node", least).select("leaf"), "leaves")
    held = put(lines.join(near_copies.small(leaves), "leaf", "left_semi").groupBy("template", "leaf", "n", "node").agg(F.min("doc_id").alias("doc_id")), "held")
    seen = all_.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).join(held.select("node").distinct(), "node", "left_semi")
    copies = put(near_copies.linked_nodes(seen, docs), "copies")
    own = held.join(near_copies.small(copies), "node", "left").select("template", "leaf", "n", "doc_id", F.coalesce("root", "node").alias("context"))
    exact = put(recurring(own, "template", "context", least).select("template"), "exact")
    few = own.join(near_copies.small(exact), "template", "left_anti").join(recurring(own, "leaf", "context", least).select("leaf"), "leaf", "left_semi")
    contexts = put(few.groupBy("template", "leaf", "n", "context").agg(F.min("doc_id").alias("doc_id")), "contexts")  # of a template these are fewer than recur
    known = own.join(near_copies.small(exact), "template", "left_semi").join(contexts.select("leaf").distinct(), "leaf", "left_semi")
    wanted = put(contexts.unionByName(known).groupBy("template", "leaf", "n").agg(F.min("doc_id").alias("doc_id")), "wanted")
    placed = put(places_of(docs, wanted).join(near_copies.small(wanted.drop("doc_id")), "template"), "placed")
    models = placed.join(near_copies.small(exact), "template", "left_semi").select("leaf", "places")
    variants = contexts.select("template", "n", "context").join(placed.select("template", "places"), "template")
    # a place's support is the number of contexts that hold it, over all templates; a template that recurs supports its places by itself
    counted = recurring(variants.select("n", "context", F.explode("places").alias("place")), "place", "context", least).select("place")
    shared = counted.unionByName(models.select(F.explode("places").alias("place"))).distinct()
    each = placed.join(near_copies.small(exact), "template", "left_anti").select("template", "leaf", "n", F.explode("places").alias("place"))
    stays = each.join(shared, "place", "left_semi").groupBy("template", "leaf", "n").agg(F.sort_array(F.collect_list("place")).alias("constant"))
    general = put(stays.where(F.size("constant") >= F.ceil(F.col("n") * similarity)).withColumn("general", F.xxhash64("n", "constant")), "general")
    many = recurring(general.select("template", "general").join(contexts, "template"), "general", "context", least).select("general")
    # a generalised template that a recurring line has too recurs: lines meet at the form's first place by hash, and must hold them all
    forms = general.select("general", "constant").dropDuplicates(["general"]).join(many, "general", "left_anti").withColumn("place", F.col("constant")[0])
    fits = models.withColumn("place", F.explode("places")).join(forms, "place").where(F.size(F.array_except("constant", "places")) == 0).select("general").distinct()
    found, _ = written(exact.unionByName(general.join(many.unionByName(fits).distinct(), "general", "left_semi").select("template")).distinct(), "templates")
    for path in paths:
        remove(spark, path)
    return found


def without(text: str, is_dropped: Callable[[list[int]], np.ndarray]) -> str:
    """The text without the lines of dropped templates; short lines of theirs go beside others that go."""
    lines = text.split("\n")
    tokens = [masked(line) for line in lines]
    full = [i for i, t in enumerate(tokens) if t]
    gone = [len(tokens[i]) if g else 0 for i, g in zip(full, is_dropped([template_of(tokens[i]) for i in full]).tolist(), strict=True)]
    if not any(n >= SHORT for n in gone):
        return text
    beside = np.zeros(len(full), bool)
    for way in (1, -1):
        before = False
        for k in range(len(full))[::way]:
            before = gone[k] >= SHORT or (before and gone[k] > 0)
            beside[k] |= before
    dropped = {full[k] for k in np.flatnonzero(beside)}
    return "\n".join(line for i, line in enumerate(lines) if i not in dropped)


def cleaned(docs: DataFrame, schema, result: Callable[[pa.RecordBatch, list[str | None], list[str | None]], pa.RecordBatch], min_docs: int, long_docs: int, similarity: float) -> DataFrame:
    """``result`` of every batch with its texts before and after lines went."""
    found = recurring_templates(docs, min_docs, long_docs, similarity)
    known = numbers(found)
    if known is not None:
        rows = docs
    else:  # too many to send to every task: documents get their own
        pairs = map_batches(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "_id long, template long", own_templates)
        own = pairs.join(found, "template", "left_semi").groupBy("_id").agg(F.collect_set("template").alias("_own"))
        packed = docs.select(F.struct(*docs.columns).alias("_row"))  # so no name of theirs clashes
        rows = packed.join(own, F.col("_row.doc_id") == F.col("_id"), "left").select("_row", "_own")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = None
        if known is None:
            own = batch.column("_own").to_pylist()
            batch = pa.RecordBatch.from_struct_array(batch.column("_row"))
        old = batch.column("text").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        new = []
        for i, (doc, text) in enumerate(zip(ids, old, strict=True)):
            templates = known if own is None else np.sort(np.array(own[i] or [], np.int64))
            new.append(text if doc is None or not text else without(text, lambda found, known=templates: among(found, known)))
        return result(batch, old, new)

    return map_batches(rows, schema, run)


def own_templates(batch: pa.RecordBatch) -> pa.RecordBatch:
    pairs = [(i, x) for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True) for x in {template_of(t) for t in map(masked, text.split("\n")) if t}]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["_id", "template"])


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, long_docs: int = 3, similarity: float = 0.7) -> DataFrame:
    """``docs`` without lines of recurring templates; n_chars, where there is one, follows the text."""
    names = docs.columns

    def result(batch: pa.RecordBatch, old: list[str | None], new: list[str | None]) -> pa.RecordBatch:
        columns = {n: batch.column(n) for n in names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in columns:
            lengths = [n if a is b or b is None else len(b) for a, b, n in zip(old, new, columns["n_chars"].to_pylist(), strict=True)]
            columns["n_chars"] = pa.array(lengths, batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return cleaned(docs, docs.schema, result, min_docs, long_docs, similarity)


def line_report(docs: DataFrame, min_docs: int = 10, long_docs: int = 3, similarity: float = 0.7) -> DataFrame:
    """doc_id, n_lines (lines with a token), n_dropped and the text that remains, of every document."""

    def result(batch: pa.RecordBatch, old: list[str | None], new: list[str | None]) -> pa.RecordBatch:
        count = lambda t: sum(1 for line in (t or "").split("\n") if line and not line.isspace())
        lines = [count(t) for t in old]
        dropped = [0 if a is b else n - count(b) for a, b, n in zip(old, new, lines, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(new, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return cleaned(docs.select("doc_id", "text"), "doc_id long, n_lines long, n_dropped long, text string", result, min_docs, long_docs, similarity)
