"""Byte-level BPE encoding and decoding over length-bucketed padded numpy matrices.

A text is cut by the tokenizer's pattern; every piece is merged by itself. Pieces that a batch has in
common are merged once: they are put in buckets of similar length, each a padded matrix of token ids.
In each round a hashed lookup ranks all adjacent pairs, every row merges its leftmost pair of least
rank, and the matrix is compacted: rows that are done leave, the others close the gap. A piece that is
itself a token is taken whole, as the reference library does. Rows so long that rounds over a matrix
would cost the square of their length (over LONG bytes) keep the same rounds on a heap.

Defined results: a null text counts as the empty text, which has no tokens; a text of any length is
encoded whole; pairs that tie in rank merge from the left; repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: Bytes above which a piece is merged on a heap, and pieces that a worker remembers between batches.
LONG, REMEMBERED = 256, 500_000
NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing over flat arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, self_rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        keys = left << 32 | right
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several that want a slot the last stays
            placed = self.keys[slot[todo]] == keys[todo]
            self.rank[slot[todo[placed]]] = self_rank[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NO_RANK where there is none (an id under 0 is padding)."""
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        keys[(right < 0).ravel()] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.rank[slot], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(left.shape)


class Numbering(dict):
    """Numbers pieces as they are first looked up; ``new`` lists those not yet merged."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class BytePairEncoder:
    """Encoder and decoder of one rank file; made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.forget()

    def forget(self) -> None:
        """Drop the remembered pieces: their numbers, and the tokens of each in one array."""
        self.known, self.flat = Numbering(), np.zeros(0, np.int32)
        self.start = self.length = np.zeros(0, np.int64)

    @classmethod
    def from_ranks(cls, ranks: bytes, pattern: str) -> BytePairEncoder:
        """ranks: the contents of a rank file."""
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}, pattern)

    def merge_matrix(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces of similar length, one piece after another, and how many each has."""
        length = np.array([len(p) for p in pieces])
        width = int(length.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < length[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        merged, count = np.full((len(pieces), width), -1, np.int32), np.zeros(len(pieces), np.int64)
        row = np.arange(len(pieces))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(1)  # the first of equals: the leftmost
            least = rank[np.arange(len(row)), at]
            done = least == NO_RANK
            if done.any():
                merged[row[done], : ids.shape[1]] = ids[done][:, :width]
                count[row[done]] = length[done]
                row, ids, rank, at, least, length = row[~done], ids[~done], rank[~done], at[~done], least[~done], length[~done]
                if not len(row):
                    break
            # each row closes its gap; every row loses a token a round, so the longest sets the width
            every, width = np.arange(len(row)), int(length.max())
            behind = np.arange(width) > at[:, None]
            ids[every, at] = least
            ids = np.where(behind, ids[:, 1 : width + 1], ids[:, :width])
            rank = np.where(behind[:, : width - 1], rank[:, 1:width], rank[:, : width - 1])
            length -= 1
            for shift in (-1, 0):  # only the pairs beside the merge are new
                p = at + shift
                own = np.flatnonzero((p >= 0) & (p + 1 < length))
                rank[own, p[own]] = self.pairs.find(ids[own, p[own]], ids[own, p[own] + 1])
            last = np.flatnonzero(at + 1 >= length)
            rank[last, length[last] - 1] = NO_RANK
        return merged[np.arange(merged.shape[1]) < count[:, None]], count

    def merge_heap(self, piece: bytes) -> np.ndarray:
        """The same merges, least rank and then leftmost first, in n log n steps."""
        ids: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        pair = lambda i: int(self.pairs.find(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
        rank = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] >= 0 and (new := pair(p)) != NO_RANK:
                    heapq.heappush(heap, (new, p, ids[p], ids[after[p]]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces in one array, where each piece's begin, and how many it has."""
        buckets: dict[int, list[int]] = {}
        parts, order = [], []
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is None and len(p) <= LONG:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
            else:
                parts.append(np.array([whole], np.int32) if whole is not None else self.merge_heap(p))
                order.append(i)
        counts = [np.array([len(x) for x in parts], np.int64)]
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(members), step):
                flat, count = self.merge_matrix([pieces[i] for i in members[k : k + step]])
                parts.append(flat), counts.append(count), order.extend(members[k : k + step])
        flat, count = np.concatenate([*parts, np.zeros(0, np.int32)]), np.concatenate(counts)
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        start[order], length[order] = np.cumsum(count) - count, count
        return flat, start, length

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        find, piece = self.pattern.findall, self.known
        cut = [[piece[p] for p in find(t)] for t in batch]
        if piece.new:
            flat, start, length = self.merge([p.encode() for p in piece.new])
            self.start, self.length = np.concatenate([self.start, start + len(self.flat)]), np.concatenate([self.length, length])
            self.flat, piece.new = np.concatenate([self.flat, flat]), []
        out = []
        for pieces in cut:
            own = np.array(pieces, np.int64)
            length = self.length[own]
            ends = np.cumsum(length)
            out.append(self.flat[np.repeat(self.start[own] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_made: dict[tuple[bytes, str], BytePairEncoder] = {}


def encoder(ranks: bytes, pattern: str) -> BytePairEncoder:
    """The worker's encoder for these ranks."""
    if (ranks, pattern) not in _made:
        _made[ranks, pattern] = BytePairEncoder.from_ranks(ranks, pattern)
    return _made[ranks, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every whole text. path: a rank file on the driver, whose contents go to the executors with the tasks."""
    ranks = Path(path).read_bytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x.tolist() for x in encoder(ranks, pattern).encode_batch(texts(batch))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, ids array<int>", run)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids give the empty text, bytes that are not UTF-8 the replacement character."""
    ranks = Path(path).read_bytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(ranks, pattern)
        got = [own.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(got, pa.string())], ["doc_id", "text"])

    return map_batches(tokens.select("doc_id", "ids"), "doc_id long, text string", run)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the digest of the ids and that of the bytes they decode to: encoded and decoded in one pass."""
    ranks = Path(path).read_bytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(ranks, pattern)
        ids = own.encode_batch(texts(batch))
        columns = [
            batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
