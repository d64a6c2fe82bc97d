"""HTML main text: a structural reading of the page, and a host suffix array that finds what pages repeat.

Each page is read once: scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and
reader comments go by their elements, roles and class names; what is left is in the article (article, main
or a declared article body), undecided, or suspect: in the article, but named as only some boilerplate is. The pages of a host are concatenated into one stream of tokens,
whose suffixes are sorted by rank doubling up to RUN tokens: neighbours of equal rank share a substring
of at least RUN tokens. Tokens covered by a substring that distinct pages share are boilerplate. In
undecided parts they go and the unique runs stay; a suspect block goes if more than half of it is covered; an
article's own paragraphs stay though other pages of the host quote them, since they are its text. Pages with the
same stream count as one page; of pages that are nearly the same and have no article, what differs stays.

No task holds a whole large host. Its pages are dealt by their content in shards of about PAGES pages or CHARS characters,
an array for each. What shards share is found in two rounds. Each shard sends 32 bits of the anchors of its runs (of a
run's substrings of ANCHOR tokens the one of least hash, so that equal runs have equal anchors) and gets back those that
another shard has too; then it sends its runs at these anchors, as 128-bit hashes, and gets back those that another shard
has in another content. So all results cover the whole host whatever its size: PAGES and CHARS only say how it is dealt.

Defined results: null html counts as the empty page, whose text is empty; a null url is a host of its
own; cut-off markup is read as far as it goes; texts of any length are kept whole; repeated rows get
equal results; pages that tie do not affect one another but by their runs; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, map_batches, texts, written

#: Tokens of the shortest substring that counts as repeated, tokens of its anchor, and pages and characters in a shard.
RUN, ANCHOR, PAGES, CHARS = 8, 5, 512, 6_000_000
#: Large hosts, and contents with many copies, of about a hundred bytes each, up to which they are broadcast; beyond, they are joined by shuffling.
BROADCAST_HOSTS = 50_000
ARTICLE, UNDECIDED, SUSPECT = 0, 1, 2
#: The result's rows.
ROWS = "page_id long, url string, host string, text string, n_chars long, n_repeated long, n_removed long"
#: What shards send to one another: numbers of a host's bucket that a shard has.
PARTS = "home string, bucket long, shard long, data binary"

RAW = "script style noscript template textarea title iframe svg math object select noframes noembed xmp".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav header footer aside form button dialog menu head label fieldset".split())
BLOCKS = set("address article blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "comment comments disqus replies respond related recommended share sharing social widget toolbar pagination pager login search hidden".split()
)
#: Of these, the ones that an article's own blocks also have.
WEAK = set("share sharing social notice notices notification related recommended header masthead footer banner search login widget promo promotion".split())
#: Names that also rule out an article element: reader comments and teasers are often articles too.
NOT_ARTICLE = set("comment comments reply ad ads advert sponsored promo related teaser".split())
#: Elements that end when a sibling or a block begins.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""" % "|".join(RAW), re.S | re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def judged(name: str, found: dict[str, str], inside: bool) -> int | None:
    """What an element's name and attributes say of it: None if it goes, SUSPECT or ARTICLE (nothing against it). inside: in an article."""
    if name in DROPPED:
        return SUSPECT if inside and name == "header" else None
    if not found:
        return ARTICLE
    names = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
    if name in ("article", "main", "body", "html"):
        return None if name == "article" and names & NOT_ARTICLE else ARTICLE
    if found.get("role", "").lower() in ROLES or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
        return None
    bad = names & NAMES
    return ARTICLE if not bad else SUSPECT if inside and bad <= WEAK else None


def is_article(name: str, found: dict[str, str]) -> bool:
    return name in ("article", "main") or found.get("role", "").lower() == "main" or "articlebody" in found.get("itemprop", "").lower()


def read_page(page: str) -> list[tuple[int, str]]:
    """(ARTICLE, UNDECIDED or SUSPECT, text) of the page's blocks in page order, white space and references resolved."""
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped here or above, zone
    opened: Counter[str] = Counter()
    dropped, zone = False, UNDECIDED

    def end_block() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                blocks.append((zone, text))
            parts.clear()

    def leave(k: int) -> None:
        """Close the stack's elements from the k-th on."""
        nonlocal dropped, zone
        now = stack[k - 1][1:] if k else (False, UNDECIDED)
        if now != (dropped, zone):
            end_block()
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        dropped, zone = now

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if not dropped:
                parts.append(html.unescape(text) if "&" in text else text)  # a reference never runs across a tag
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in BLOCKS:
                end_block()
            if opened[name] > 0:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in BLOCKS:
            end_block()
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        while stack and name in CLOSED_BY.get(stack[-1][0], ()):
            leave(len(stack) - 1)
        found = attributes(m["attributes"])
        verdict = judged(name, found, zone != UNDECIDED)
        inner = SUSPECT if zone == SUSPECT or verdict == SUSPECT else ARTICLE if zone == ARTICLE or is_article(name, found) else UNDECIDED
        drop = dropped or verdict is None
        if (drop, inner) != (dropped, zone):
            end_block()
        if not (m["attributes"] or "").endswith("/") or name in BLOCKS:
            stack.append((name, drop, inner))
            opened[name] += 1
            dropped, zone = drop, inner
    end_block()
    return blocks


def host_of(url: str | None) -> str:
    """Host of an address in lower case, without user and port; empty where there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower().rstrip(".") if m else ""


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, content: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which tokens lie in a substring of RUN or more that distinct contents of a group share.

    tokens: of all pages end to end; page, content, group: of each token. A suffix array by rank doubling,
    as deep as RUN tokens; suffixes that cross into another page get ranks of their own.
    """
    n = len(tokens)
    if n < RUN:
        return np.zeros(n, bool)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    rank = np.unique(rank * (int(group.max()) + 1) + group, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < RUN:
        step = min(depth, RUN - depth)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = np.where(page[step:] == page[: n - step], rank[step:], -1)
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    whole = np.zeros(n, bool)
    whole[: n - RUN + 1] = page[RUN - 1 :] == page[: n - RUN + 1]
    suffixes = np.flatnonzero(whole)
    if not len(suffixes):
        return np.zeros(n, bool)
    order = suffixes[np.lexsort((content[suffixes], rank[suffixes]))]  # the suffix array
    begins = np.flatnonzero(np.r_[True, rank[order[1:]] != rank[order[:-1]]])
    ends = np.r_[begins[1:], len(order)] - 1
    shared = np.repeat(content[order[begins]] != content[order[ends]], ends - begins + 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, order[shared], 1)
    np.add.at(change, order[shared] + RUN, -1)
    return np.cumsum(change[:-1]) > 0


def content_of(blocks: list[str]) -> int:
    """A page's content as a number: pages that agree in it are copies."""
    return xxh64_intdigest("\n".join(blocks)) - (1 << 63)


def mixed(values: np.ndarray, length: int, starts: np.ndarray, factor: int) -> np.ndarray:
    """64-bit hashes of the ``length`` values from each start on."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(length):
        h = (h ^ values[starts + k]) * np.uint64(factor)
        h ^= h >> np.uint64(29)
    return h


class Flow:
    """The tokens of pages end to end."""

    def __init__(self, blocks: list[list[str]]) -> None:
        self.words = [[b.split() for b in page] for page in blocks]
        self.page = np.repeat(np.arange(len(blocks)), np.array([sum(map(len, page)) for page in self.words], np.int64))
        self.known: dict[str, int] = {}
        flat = (w for page in self.words for block in page for w in block)
        self.tokens = np.fromiter((self.known.setdefault(w, len(self.known)) for w in flat), np.int64, len(self.page))
        self._hashes: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = np.array([xxh64_intdigest(w) for w in self.known], np.uint64)[self.tokens]
        return self._hashes

    def starts(self) -> np.ndarray:
        """Where RUN tokens of one page begin."""
        n = len(self.page) - RUN + 1
        return np.flatnonzero(self.page[RUN - 1 :] == self.page[:n]) if n > 0 else np.zeros(0, np.int64)

    def runs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The RUN tokens from each start on, as 128-bit hashes in two halves."""
        return mixed(self.hashes(), RUN, starts, 0x9E3779B97F4A7C15), mixed(self.hashes(), RUN, starts, 0xC2B2AE3D27D4EB4F)

    def anchors(self, starts: np.ndarray, buckets: int) -> np.ndarray:
        """Bucket and 32 bits of each run's anchor, of its substrings of ANCHOR tokens the one of least hash: equal runs have equal anchors."""
        n = len(self.page) - ANCHOR + 1
        if not len(starts):
            return np.zeros(0, np.uint64)
        parts = mixed(self.hashes(), ANCHOR, np.arange(n), 0x165667B19E3779F9)
        least = parts[starts]
        for k in range(1, RUN - ANCHOR + 1):
            least = np.minimum(least, parts[starts + k])
        least = least * np.uint64(0x9E3779B97F4A7C15)
        least ^= least >> np.uint64(32)
        return (least >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | least & np.uint64(0xFFFFFFFF)


def main_texts(groups: list[tuple], zones: list[list[int]], blocks: list[list[str]], met: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """Text, repeated tokens and removed tokens of each page; met: both halves of the runs that these pages share with others of their group."""
    flow = Flow(blocks)
    counts = np.bincount(flow.page, minlength=len(blocks))
    content = np.unique(np.array([content_of(page) for page in blocks], np.int64), return_inverse=True)[1]
    keys: dict[tuple, int] = {}
    group = np.array([keys.setdefault(g, len(keys)) for g in groups], np.int64)
    repeated = repeated_tokens(flow.tokens, flow.page, np.repeat(content, counts), np.repeat(group, counts))
    if met is not None:
        starts = flow.starts()
        high, low = flow.runs(starts)
        found = starts[np.isin(high, met[0]) & np.isin(low, met[1])]
        for k in range(RUN):
            repeated[found + k] = True
    ends = np.cumsum(counts).tolist()
    return [kept_text(page, zone, repeated[a:b]) for page, zone, a, b in zip(flow.words, zones, [0, *ends[:-1]], ends, strict=True)]


def kept_text(page: list[list[str]], zone: list[int], own: np.ndarray) -> tuple[str, int, int]:
    """Text, repeated tokens and removed tokens of a page whose tokens ``own`` marks as repeated."""
    whole = ARTICLE in zone or SUSPECT in zone  # beside an article, undecided blocks are not part of it
    kept, k, removed = [], 0, 0
    for b, z in zip(page, zone, strict=True):
        gone = own[k : k + len(b)]
        k += len(b)
        if z == ARTICLE or (z == SUSPECT and 2 * int(gone.sum()) <= len(b)):
            kept.append(" ".join(b))
        elif z == SUSPECT:
            removed += len(b)
        elif not whole:
            unique = [w for w, g in zip(b, gone, strict=True) if not g]
            removed += int(gone.sum())
            if unique:
                kept.append(" ".join(unique))
    return " ".join(kept), int(own.sum()), removed


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed_page(page: list[tuple[int, str]]) -> bytes:
    return squeezed("\n".join(["".join(str(z) for z, _ in page), *(t for _, t in page)]).encode())  # no block has a line end


def unpacked_page(data: bytes) -> tuple[list[int], list[str]]:
    zones, *blocks = unsqueezed(data).decode().split("\n")
    return [int(z) for z in zones], blocks


def packed_ascending(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, byte by byte."""
    return squeezed(np.diff(values.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_ascending(data: bytes) -> np.ndarray:
    steps = np.frombuffer(unsqueezed(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint32).ravel(), dtype=np.uint64)


def packed_columns(*columns: np.ndarray) -> bytes:
    return squeezed(b"".join(c.astype(np.uint64).tobytes() for c in columns))


def unpacked_columns(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(unsqueezed(data), np.uint64).reshape(n, -1)


def buckets_of(shards: int) -> int:
    """Parts of a host's runs, so many that neither their number for a shard nor the runs in one grow faster than the root of the shards."""
    return 4 * math.ceil(math.sqrt(shards))


def parts_table(home: str, shard: int, found: list[tuple[int, int | None, bytes]]) -> pa.Table:
    """Rows of PARTS: (bucket, shard or None for the given one, data)."""
    n = len(found)
    columns = [pa.array([home] * n, pa.string()), pa.array([b for b, _, _ in found], pa.int64()), pa.array([shard if s is None else s for _, s, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.binary())]
    return pa.Table.from_arrays(columns, ["home", "bucket", "shard", "data"])


def by_bucket(buckets: np.ndarray) -> list[tuple[int, slice]]:
    """Each value of an ascending array and where it is."""
    begins = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(buckets) else np.zeros(0, np.int64)
    return [(int(buckets[a]), slice(a, b)) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(buckets)], strict=True)] if len(buckets) else []


def first(table: pa.Table, column: str):
    return table.column(column)[0].as_py()


def shard_anchors(shard: pa.Table) -> pa.Table:
    """The anchors of a shard of a large host, in PARTS."""
    home, number = first(shard, "home"), first(shard, "shard")
    if not home:
        return parts_table("", 0, [])
    flow = Flow([unpacked_page(d)[1] for d in distinct_pages(shard)[0]])
    found = np.unique(flow.anchors(flow.starts(), buckets_of(first(shard, "shards"))))
    return parts_table(home, number, [(b, None, packed_ascending(found[at] & np.uint64(0xFFFFFFFF))) for b, at in by_bucket(found >> np.uint64(32))])


def distinct_pages(shard: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """One page of each content, the contents, and whether other shards have them too."""
    contents = shard.column("content").to_numpy()
    kept, at = np.unique(contents, return_index=True)
    data = shard.column("data")
    return [data[k].as_py() for k in at.tolist()], kept, shard.column("hot").to_numpy()[at]


def met_anchors(bucket: pa.Table) -> pa.Table:
    """Of a bucket's anchors, for each shard those that another shard has too."""
    shards = bucket.column("shard").to_pylist()
    own = [unpacked_ascending(d) for d in bucket.column("data").to_pylist()]
    values, counts = np.unique(np.concatenate(own), return_counts=True)
    met = values[counts > 1]
    kept = [(s, v[np.isin(v, met, assume_unique=True)]) for s, v in zip(shards, own, strict=True)]
    number = first(bucket, "bucket")
    return parts_table(first(bucket, "home"), 0, [(number, s, packed_ascending(v)) for s, v in kept if len(v)])


def shard_runs(shard: pa.Table, anchors: pa.Table) -> pa.Table:
    """The shard's runs at these anchors in PARTS: their halves, and the content if they are in but one that other shards have too, else 0."""
    if not anchors.num_rows or not shard.num_rows:
        return parts_table("", 0, [])
    home, number, buckets = first(shard, "home"), first(shard, "shard"), buckets_of(first(shard, "shards"))
    wanted = np.concatenate([np.uint64(b << 32) | unpacked_ascending(d) for b, d in zip(anchors.column("bucket").to_pylist(), anchors.column("data").to_pylist(), strict=True)])
    data, contents, hot = distinct_pages(shard)
    flow = Flow([unpacked_page(d)[1] for d in data])
    starts = flow.starts()
    starts = starts[np.isin(flow.anchors(starts, buckets), wanted)]
    if not len(starts):
        return parts_table("", 0, [])
    (high, low), page = flow.runs(starts), flow.page[starts]
    order = np.lexsort((page, low, high, high % np.uint64(buckets)))
    high, low, page = high[order], low[order], page[order]
    begins = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    ends = np.r_[begins[1:], len(high)] - 1
    alone = (page[begins] == page[ends]) & hot[page[begins]]
    mark = np.where(alone, np.maximum(contents[page[begins]].astype(np.int64).view(np.uint64), np.uint64(1)), np.uint64(0))
    high, low = high[begins], low[begins]
    return parts_table(home, number, [(b, None, packed_columns(high[at], low[at], mark[at])) for b, at in by_bucket(high % np.uint64(buckets))])


def met_runs(bucket: pa.Table) -> pa.Table:
    """Of a bucket's runs, for each shard those that another shard has in another content."""
    shards = bucket.column("shard").to_pylist()
    own = [unpacked_columns(d, 3) for d in bucket.column("data").to_pylist()]
    high, low, mark = np.concatenate(own, axis=1)
    order = np.lexsort((mark, low, high))
    h, l, m = high[order], low[order], mark[order]
    begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (l[1:] != l[:-1])])
    ends = np.r_[begins[1:], len(h)] - 1
    met = np.zeros(len(h), bool)
    met[order] = np.repeat((ends > begins) & ((m[begins] == 0) | (m[begins] != m[ends])), ends - begins + 1)
    found, k, number = [], 0, first(bucket, "bucket")
    for s, columns in zip(shards, own, strict=True):
        kept = columns[:2, met[k : k + columns.shape[1]]]
        k += columns.shape[1]
        if kept.shape[1]:
            found.append((number, s, packed_columns(*kept)))
    return parts_table(first(bucket, "home"), 0, found)


def shard_texts(shard: pa.Table, runs: pa.Table | None) -> pa.Table:
    """The rows of ``main_text`` for a shard whose pages share ``runs`` with other shards."""
    pages = [unpacked_page(d) for d in shard.column("data").to_pylist()]
    met = np.concatenate([unpacked_columns(d, 2) for d in runs.column("data").to_pylist()], axis=1) if runs is not None and runs.num_rows else None
    found = main_texts([(h,) for h in shard.column("host").to_pylist()], [z for z, _ in pages], [b for _, b in pages], met)
    made = [pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())]
    return pa.Table.from_arrays([*(shard.column(c) for c in ("page_id", "url", "host")), *made], ["page_id", "url", "host", "text", "n_chars", "n_repeated", "n_removed"])


def page_contents(pages: DataFrame) -> DataFrame:
    """host, content and number of characters of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts = [host_of(u) for u in batch.column("url").to_pylist()]
        blocks = [[t for _, t in read_page(p)] for p in texts(batch, "html")]
        columns = [pa.array(hosts, pa.string()), pa.array([content_of(b) for b in blocks], pa.int64()), pa.array([sum(map(len, b)) for b in blocks], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["host", "content", "chars"])

    return map_batches(pages.select("url", "html"), "host string, content long, chars long", run)


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content and the packed zones and blocks of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [read_page(p) for p in texts(batch, "html")]
        columns = [
            batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string()),
            pa.array([content_of([t for _, t in f]) for f in found], pa.int64()), pa.array([packed_page(f) for f in found], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "content", "data"])

    return map_batches(pages.select("page_id", "url", "html"), "page_id long, url string, host string, content long, data binary", run)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host, and the numbers of repeated and removed tokens of every page."""
    bounded_batches(pages.sparkSession)
    shards_of = F.greatest(F.col("pages") / PAGES, F.col("chars") / CHARS)
    counted, _ = written(page_contents(pages).groupBy("host", "content").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars")), "contents")
    hosts = counted.groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
    large, _ = written(hosts.where(shards_of > 1).select("host", F.ceil(shards_of).alias("shards")), "shards")
    hot, _ = written(counted.where(shards_of > 1).select("host", "content", F.ceil(shards_of).alias("parts")), "hot")
    n_large, n_hot = large.count(), hot.count()
    small = int(hosts.where(shards_of <= 1).agg(F.sum(shards_of)).first()[0] or 0) + 1  # shards of whole hosts
    # of checked numbers of large hosts and hot contents the tables are broadcast, so that texts are shuffled but once
    joined = page_blocks(pages).join(F.broadcast(large) if n_large <= BROADCAST_HOSTS else large, "host", "left")
    joined = joined.join(F.broadcast(hot) if n_hot <= BROADCAST_HOSTS else hot, ["host", "content"], "left")
    among = F.pmod(F.xxhash64("content", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))), "shards")
    dealt = joined.select(
        F.when(F.col("shards").isNull(), "").otherwise(F.concat(F.lit("h"), "host")).alias("home"),
        F.when(F.col("shards").isNull(), F.pmod(F.xxhash64("host"), F.lit(small))).otherwise(among).alias("shard"),
        F.coalesce("shards", F.lit(1)).alias("shards"), F.col("parts").isNotNull().alias("hot"), "page_id", "url", "host", "content", "data",
    )
    # every step below groups the same rows by the same columns, so Spark shuffles the texts once and reads them again
    shards = dealt.groupBy("home", "shard")
    if not n_large:
        return shards.applyInArrow(lambda shard: shard_texts(shard, None), ROWS)
    anchors = shards.applyInArrow(shard_anchors, PARTS).groupBy("home", "bucket").applyInArrow(met_anchors, PARTS)
    runs = shards.cogroup(anchors.groupBy("home", "shard")).applyInArrow(shard_runs, PARTS).groupBy("home", "bucket").applyInArrow(met_runs, PARTS)
    return shards.cogroup(runs.groupBy("home", "shard")).applyInArrow(shard_texts, ROWS)
