"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each page: the likelihood of its text under byte-trigram
models, the language its markup declares, its address suffix, and a prior from its host. The trigram
models are fitted on at most ``fit_rows`` labelled documents for all languages together, chosen by a
seeded hash. Text-only posteriors of all pages are then counted (in integer millionths, so that sums do
not depend on their order) by declared language, suffix, registered domain and host; a host's prior is
smoothed towards its domain's, that towards the whole table's. A page's own part is taken out of every
count before it is used.

Defined results: null html is the empty page, whose text says nothing; a missing or unknown declaration
is evidence like any other; a page without a host has the whole table's prior; without labelled rows the
language is null; texts of any length are read whole, their evidence counting as MOST_OBSERVATIONS independent
observations at most, since words of one text repeat one another; repeated rows get equal results; an empty table
gives an empty result; other columns are not read. Ties go to the first language in code-point order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remove, texts, written
from .html_text import host_of, read_page

BUCKETS, MILLION = 1 << 16, 1_000_000
#: Trigrams that count as one independent observation, and the most that a text can count for.
PER_OBSERVATION, MOST_OBSERVATIONS = 8.0, 200.0
#: Labels under which countries register names.
SECOND_LEVEL = {"ac", "co", "com", "edu", "gov", "gob", "gouv", "mil", "ne", "net", "or", "org"}
#: Times the sample's rows that are to pass the hash cutoff.
SPARE = 4
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"""\s(?:xml:)?lang\s*=\s*["']?([a-zA-Z]+)""", re.I)


def declared_language(page: str) -> str:
    """What the page's html element declares, in lower case; empty where it declares nothing."""
    element = _HTML.search(page)
    found = _LANG.search(element[0]) if element else None
    return found[1].lower() if found else ""


def domain_of(host: str) -> str:
    """The part of a host that one owner registered: two labels, three under a country's own kinds such as co.uk; an address is its own."""
    labels = host.split(".")
    if labels[-1].isdecimal() or ":" in host:
        return host
    shared = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL
    return ".".join(labels[-3 if shared else -2 :])


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's byte trigrams, A-Z in lower case."""
    raw = np.frombuffer(text.encode().lower(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return (((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def labelled_sample(documents: DataFrame, fit_rows: int, seed: int) -> DataFrame:
    """The ``fit_rows`` labelled rows (all, if there are fewer) with the least seeded hashes of their ids.

    A cutoff that about SPARE times as many rows pass is applied first, so that the task which orders the texts gets
    so many whatever the number of partitions. Should too few pass, as when ids repeat, all rows are ordered.
    """
    labelled = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", "doc_id")
    chance = F.xxhash64("doc_id", F.lit(seed))
    least = lambda rows: rows.orderBy(chance, "doc_id", "lang", F.md5("text")).limit(fit_rows)
    total = documents.where("lang IS NOT NULL").count()
    if total <= SPARE * fit_rows:
        return least(labelled)
    cutoff = SPARE * fit_rows * (1 << 64) // total - (1 << 63)
    sample, path = written(least(labelled.where(chance < cutoff)), "sample")
    if sample.count() == fit_rows:
        return sample
    remove(documents.sparkSession, path)
    return least(labelled)


def fit(documents: DataFrame, fit_rows: int = 4000, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and log likelihoods [bucket, language], from at most ``fit_rows`` labelled documents."""
    sample = labelled_sample(documents, fit_rows, seed)
    langs: dict[str, np.ndarray] = {}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:  # texts become sparse counts on the executors
        found = [np.unique(trigrams(t), return_counts=True) for t in texts(batch)]
        columns = [batch.column("lang"), pa.array([b.tolist() for b, _ in found], pa.list_(pa.int32())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "buckets", "counts"])

    counted = map_batches(sample, "lang string, buckets array<int>, counts array<long>", count)
    pairs = counted.select("lang", F.explode(F.arrays_zip("buckets", "counts")).alias("c")).groupBy("lang", "c.buckets").agg(F.sum("c.counts").alias("n"))
    for row in pairs.collect():  # at most BUCKETS rows for each language of the sample
        langs.setdefault(row.lang, np.zeros(BUCKETS))[row.buckets] = row.n
    names = sorted(langs)
    if not names:
        return [], np.zeros((BUCKETS, 0))
    counts = np.stack([langs[n] for n in names], 1) + 0.5
    return names, np.log(counts / counts.sum(0))


def posterior(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def text_log_likelihood(text: str, table: np.ndarray) -> np.ndarray:
    """Summed log likelihoods, tempered: neighbouring trigrams overlap and repeat one another's evidence."""
    found = trigrams(text)
    if not len(found):
        return np.zeros(table.shape[1])
    return table[found].mean(0) * min(len(found) / PER_OBSERVATION, MOST_OBSERVATIONS)


def evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """page_id, url, host, domain, suffix, declared, text log likelihoods and the text-only posterior in millionths."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        html, urls = texts(batch, "html"), batch.column("url").to_pylist()
        log = np.array([text_log_likelihood(" ".join(t for _, t in read_page(p)), table) for p in html]).reshape(len(html), len(languages))
        own = np.rint(posterior(log) * MILLION).astype(np.int64) if len(html) else log.astype(np.int64)
        hosts = [host_of(u) for u in urls]
        declared = [d if d in languages else "(other)" if d else "" for d in map(declared_language, html)]
        columns = [
            batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(hosts, pa.string()), pa.array(list(map(domain_of, hosts)), pa.string()),
            pa.array([h.rpartition(".")[2] for h in hosts], pa.string()), pa.array(declared, pa.string()), pa.array(log.tolist(), pa.list_(pa.float64())), pa.array(own.tolist(), pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "domain", "suffix", "declared", "log", "own"])

    return map_batches(pages.select("page_id", "url", "html"), "page_id long, url string, host string, domain string, suffix string, declared string, log array<double>, own array<long>", run)


def counted(rows: DataFrame, keys: list[str], of: str, name: str, k: int) -> DataFrame:
    """Sum of the array column ``of``, element by element, by the keys."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col(of)[i]) for i in range(k))).alias(name))


def identify(pages: DataFrame, documents: DataFrame, fit_rows: int = 4000, strength: float = 20.0, seed: int = 42) -> DataFrame:
    """page_id, url, host, declared, suffix, text_lang, lang and its probability of every page.

    strength: pages that the smoothing counts for, at each level.
    """
    languages, table = fit(documents, fit_rows, seed)
    k = len(languages)
    if not k:
        empty = evidence(pages, ["und"], np.zeros((BUCKETS, 1)))
        return empty.select("page_id", "url", "host", "declared", "suffix", *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")), F.lit(None).cast("double").alias("probability"))
    rows, _ = written(evidence(pages, languages, table), "evidence")
    hosts = counted(rows, ["host", "domain", "suffix"], "own", "host_counts", k)
    domains = counted(hosts, ["domain"], "host_counts", "domain_counts", k)
    suffixes = counted(hosts, ["suffix"], "host_counts", "suffix_counts", k)
    # at most one row for each language, one for others and one for none
    declarations = {r.declared: np.array(r.counts, float) / MILLION for r in counted(rows, ["declared"], "own", "counts", k).collect()}
    total = sum(declarations.values(), np.zeros(k))
    n_suffixes = suffixes.count()
    # the levels above the host join the far smaller table of hosts first
    known = hosts.join(domains, "domain").join(suffixes, "suffix").select("host", "host_counts", "domain_counts", "suffix_counts")

    def fuse(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        matrix = lambda c: np.array(batch.column(c).to_pylist(), float).reshape(n, k)
        own, log = matrix("own") / MILLION, matrix("log")
        host, domain, suffix = (matrix(c) / MILLION - own for c in ("host_counts", "domain_counts", "suffix_counts"))
        others = total - own
        prior = (others + 1) / (others.sum(1, keepdims=True) + k)
        for level in (domain, host):
            prior = (level + strength * prior) / (level.sum(1, keepdims=True) + strength)
        declared = batch.column("declared").to_pylist()
        said = np.array([declarations[d] for d in declared]).reshape(n, k) - own
        log_declared = np.log((said + 0.5) / (others + 0.5 * (k + 2)))
        log_suffix = np.log((suffix + strength / n_suffixes) / (others + strength))
        p = posterior(log + log_declared + log_suffix + np.log(prior)) if n else log
        best, text = p.argmax(1) if n else [], log.argmax(1) if n else []
        columns = [
            *(batch.column(c) for c in ("page_id", "url", "host", "declared", "suffix")), pa.array([languages[i] if np.ptp(r) > 0 else None for i, r in zip(text, log, strict=True)], pa.string()),
            pa.array([languages[i] for i in best], pa.string()), pa.array([round(float(r[i]), 6) for i, r in zip(best, p, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "declared", "suffix", "text_lang", "lang", "probability"])

    return map_batches(rows.join(known, "host"), "page_id long, url string, host string, declared string, suffix string, text_lang string, lang string, probability double", fuse)
