"""FLAC media columns: encode bytes as 8-bit samples, decode them, verify every checksum, write PCM blocks.

The encoder makes real FLAC streams (one channel, 8 bits, fixed blocks of BLOCK samples): STREAMINFO with
the MD5 of the samples, a SEEKTABLE with a point for each frame, and frames whose subframe is constant,
verbatim, a fixed predictor of order 0 to 4 or a quantised linear predictor, with partitioned Rice codes.
The decoder reads any stream of that kind. It checks each frame's header CRC-8 and frame CRC-16, walks the
Rice codes of all frames of a batch in lockstep (a table of the next set bit turns a unary code into one
lookup; escaped partitions hold plain numbers), restores fixed predictors by running sums and linear ones in lockstep, and checks the MD5.

``read_samples`` decodes from the seek table: only the frames that hold the wanted samples are read. The table has a point
for each frame up to 900,000 frames (a metadata block holds no more); beyond, a read looks for the frames between points.

Defined results: a null text counts as the empty text; texts of any length are stored whole; equal texts
give equal streams whatever else is in their batch; repeated rows and ties get equal results; an empty table gives
an empty result; other columns are not read. A damaged stream raises ValueError, in memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, map_batches, texts

BLOCK, RATE, ORDER, PRECISION, PARTITION = 1024, 8000, 8, 8, 256
#: Samples coded or decoded at once.
CHUNK = 1 << 20
#: Bytes of the longest slice whose checksum is taken at once; longer ones, as of damaged streams, go in pieces of so many.
STRIDE = 1 << 13


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


@lru_cache
def _crc_by_distance(poly: int, bits: int, length: int) -> np.ndarray:
    """[d, b]: checksum of byte b followed by d zero bytes. A message's checksum is the xor over its bytes."""
    table = _crc_table(poly, bits)
    rows = [table]
    for _ in range(length - 1):
        x = rows[-1]
        rows.append((x << 8 ^ table[x >> (bits - 8)]) & ((1 << bits) - 1))
    return np.array(rows, np.uint16)


def _continued(crc: int, data: np.ndarray, poly: int, bits: int) -> int:
    """The checksum after more bytes: what was before them is folded into the first ones, STRIDE bytes at a time."""
    for at in range(0, len(data), STRIDE):
        part = np.r_[np.zeros(0, np.uint8), data[at : at + STRIDE]]
        if len(part) * 8 < bits:  # a byte beside two of the checksum
            table = _crc_table(poly, bits)
            crc = int(table[(crc >> 8) ^ int(part[0])]) ^ (crc << 8 & 0xFFFF)
            continue
        for k in range(bits // 8):
            part[k] ^= crc >> (bits - 8 - 8 * k) & 0xFF
        terms = _crc_by_distance(poly, bits, STRIDE)[np.arange(len(part))[::-1], part]
        crc = int(np.bitwise_xor.reduce(terms))
    return crc


def checksums(data: np.ndarray, start: np.ndarray, length: np.ndarray, poly: int, bits: int) -> np.ndarray:
    """Checksums of the slices of ``data``, all lengths positive."""
    if int(length.max(initial=1)) > STRIDE:
        return np.array([_continued(0, data[s : s + n], poly, bits) for s, n in zip(start.tolist(), length.tolist(), strict=True)], np.uint16)
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    size = 1 << int(length.max(initial=1)).bit_length()
    terms = _crc_by_distance(poly, bits, size)[np.repeat(length, length) - 1 - at, data[np.repeat(start, length) + at]]
    return np.bitwise_xor.reduceat(terms, ends - length) if len(ends) else np.zeros(0, np.uint16)


def crc8(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return checksums(data, start, length, 0x07, 8)


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return checksums(data, start, length, 0x8005, 16)


# ---------------------------------------------------------------- encoder


def frame_header(number: int, size: int) -> bytes:
    """Without its CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:  # the frame number in the extended UTF-8 form
        more = next(k for k in range(1, 7) if number < 1 << (6 * k + 6 - k))
        lead = (0xFF << (7 - more) & 0xFF) | number >> (6 * more)
        coded = bytes([lead, *(0x80 | number >> (6 * k) & 0x3F for k in reversed(range(more)))])
    whole = size == BLOCK
    return b"\xff\xf8" + bytes([(BLOCK.bit_length() - 1 if whole else 0x7) << 4 | 4, 0x02]) + coded + (b"" if whole else (size - 1).to_bytes(2, "big"))


def linear_coefficients(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor of order ORDER of every row, and its shift. Sums of squares are exact, so rows do not affect each other."""
    n = x.shape[1]
    auto = np.stack([(x[:, : n - k] * x[:, k:]).sum(1, dtype=np.int64) for k in range(ORDER + 1)]).astype(float)
    error, a = np.maximum(auto[0], 1e-9) * (1 + 1e-9), np.zeros((ORDER, len(x)))
    for i in range(ORDER):
        k = auto[i + 1].copy()
        for j in range(i):
            k -= a[j] * auto[i - j]
        k /= error
        old = a[:i].copy()
        a[i] = k
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.abs(a).max(0)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-9))).astype(np.int64), 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -limit - 1, limit).astype(np.int32).T, shift.astype(np.int32)


def linear_residual(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    predicted = sum(coefficients[:, j : j + 1] * x[:, ORDER - 1 - j : n - 1 - j] for j in range(ORDER))
    return x[:, ORDER:] - (predicted >> shift[:, None])


def zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def rice_plan(u: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bits of each row, the parameter of each of its partitions, and the number of partitions."""
    parts = size // PARTITION if size % PARTITION == 0 and size // PARTITION in (1, 2, 4) else 1
    cuts = np.maximum(np.arange(parts) * (size // parts) - order, 0)
    counts = np.diff(np.r_[cuts, size - order])
    mean = np.add.reduceat(u, cuts, 1, dtype=np.int64) / counts
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.693, 1))), 0, 14).astype(np.int32)
    quotients = np.add.reduceat(u >> np.repeat(rice, counts, 1), cuts, 1, dtype=np.int64)
    return (quotients + counts * (rice + 1)).sum(1) + 4 * parts, rice, parts


class Fields(NamedTuple):
    """Numbers and their widths in bits, a row for each frame; a width beyond 16 bits means leading zeros."""

    value: np.ndarray
    width: np.ndarray


def encode_frames(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subframes of equally long blocks as (rows, bits): which rows, and their bits one row after another with lengths."""
    count, size = x.shape
    residual, residuals, cost = x, {}, {}
    for order in range(min(5, size - 1)):
        residuals[order] = residual
        cost[order] = (size - order) * np.log2(np.abs(residual).sum(1, dtype=np.int64) / (size - order) + 0.5) + 8 * order
        residual = np.diff(residual, axis=1)
    if size > 4 * ORDER:
        coefficients, shift = linear_coefficients(x)
        residuals[99] = linear_residual(x, coefficients, shift)
        extra = (8 + PRECISION) * ORDER + 9
        cost[99] = (size - ORDER) * np.log2(np.abs(residuals[99]).sum(1, dtype=np.int64) / (size - ORDER) + 0.5) + extra
    kind = np.array(list(cost))[np.stack(list(cost.values())).argmin(0)]
    kind[(x == x[:, :1]).all(1)] = -2
    plans = {}
    for k in np.unique(kind[kind >= 0]):
        rows = np.flatnonzero(kind == k)
        order = ORDER if k == 99 else int(k)
        u = zigzag(residuals[k][rows])
        bits, rice, parts = rice_plan(u, order, size)
        smaller = bits + 8 * order + 6 + (9 + PRECISION * ORDER) * (k == 99) < 8 * size
        kind[rows[~smaller]] = -1  # verbatim
        plans[k] = (u[smaller], rice[smaller], parts)
    out = []
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        part = x[rows]
        eight = np.full((len(rows), 1), 8)
        if k == -2:
            fields = Fields(np.concatenate([np.zeros_like(part[:, :1]), part[:, :1] & 0xFF], 1), np.repeat(eight, 2, 1))
        elif k == -1:
            fields = Fields(np.concatenate([np.full_like(part[:, :1], 2), part & 0xFF], 1), np.repeat(eight, size + 1, 1))
        else:
            order = ORDER if k == 99 else int(k)
            u, parameters, parts = plans[k]
            values, widths = [np.full((len(rows), 1), (32 + order - 1 if k == 99 else 8 + order) << 1), part[:, :order] & 0xFF], [8, 8]
            if k == 99:
                values += [np.full((len(rows), 1), PRECISION - 1), shift[rows][:, None], coefficients[rows] & ((1 << PRECISION) - 1)]
                widths += [4, 5, PRECISION]
            values.append(np.full((len(rows), 1), parts.bit_length() - 1))
            widths.append(6)
            value = np.concatenate(values, 1)
            width = np.concatenate([np.full(v.shape, w) for v, w in zip(values, widths, strict=True)], 1)
            cuts = np.maximum(np.arange(parts) * (size // parts) - order, 0)
            for p, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], size - order], strict=True)):
                rice = parameters[:, p : p + 1]
                own = u[:, lo:hi]
                value = np.concatenate([value, rice, 1 << rice | own & (1 << rice) - 1], 1)
                width = np.concatenate([width, np.full_like(rice, 4), (own >> rice) + 1 + rice], 1)
            fields = Fields(value, width)
        out.append((rows, fields))
    return out


def pack(fields: Fields) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows, each padded to whole bytes, one after another, and their lengths."""
    bits = fields.width.sum(1)
    sizes = -(-bits // 8)
    starts = (np.cumsum(sizes) - sizes) * 8
    ends = (starts[:, None] + np.cumsum(fields.width, 1)).ravel()
    value, width = fields.value.ravel(), fields.width.ravel()
    flat = np.zeros(int(sizes.sum()) * 8, np.uint8)
    for j in range(int(value.max(initial=0)).bit_length()):  # no value is wider than its field
        flat[ends[(value >> j & 1).astype(bool)] - 1 - j] = 1
    return np.packbits(flat), sizes


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a payload's bytes are its samples plus 128."""
    samples = [np.frombuffer(p, np.uint8).astype(np.int16) - 128 for p in payloads]
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, s in enumerate(samples):
        for at in range(0, len(s), BLOCK):
            by_size.setdefault(min(BLOCK, len(s) - at), []).append((i, at // BLOCK))
    frames: list[list[bytes]] = [[b""] * -(-len(s) // BLOCK) for s in samples]
    for size, members in by_size.items():
        step = max(1, CHUNK // size)
        for k in range(0, len(members), step):
            part = members[k : k + step]
            x = np.stack([samples[i][n * BLOCK : n * BLOCK + size] for i, n in part]).astype(np.int32)
            for rows, fields in encode_frames(x):
                body, sizes = pack(fields)
                ends = np.cumsum(sizes).tolist()
                heads = [frame_header(part[r][1], size) for r in rows]
                flat, lengths = np.frombuffer(b"".join(heads), np.uint8), np.array([len(h) for h in heads])
                marks = crc8(flat, np.cumsum(lengths) - lengths, lengths)
                raw = body.tobytes()
                made = [h + bytes([int(m)]) + raw[a:b] for h, m, a, b in zip(heads, marks, [0, *ends[:-1]], ends, strict=True)]
                flat, lengths = np.frombuffer(b"".join(made), np.uint8), np.array([len(f) for f in made])
                for r, f, c in zip(rows, made, crc16(flat, np.cumsum(lengths) - lengths, lengths), strict=True):
                    frames[part[r][0]][part[r][1]] = f + int(c).to_bytes(2, "big")
    return [stream(p, f) for p, f in zip(payloads, frames, strict=True)]


def stream(payload: bytes, frames: list[bytes]) -> bytes:
    lengths = [len(f) for f in frames]
    digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + min(lengths, default=0).to_bytes(3, "big") + max(lengths, default=0).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
    points, at = [], 0
    for i, n in enumerate(lengths):
        points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(payload) - i * BLOCK).to_bytes(2, "big"))
        at += n
    table = b"".join(points)
    if len(table) >= 1 << 24:  # more than a metadata block holds: thinned, the frames between are found by their CRCs
        thin = -(-len(table) // (18 * 900_000))
        table = b"".join(points[::thin])
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


# ---------------------------------------------------------------- decoder


class Frame(NamedTuple):
    media: int
    start: int  # byte of the frame in the joined media
    end: int  # byte after its CRC-16
    number: int
    size: int
    body: int  # byte of the subframe header


def read_metadata(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int]]]:
    """First byte of the frames, samples, MD5 and seek points (sample, byte offset, samples)."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, digest, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        data = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(data[10:18], "big")
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise ValueError("only one channel of 8 bits")
            total, digest = packed & (1 << 36) - 1, data[18:34]
        elif kind == 3:
            points = [(int.from_bytes(data[i : i + 8], "big"), int.from_bytes(data[i + 8 : i + 16], "big"), int.from_bytes(data[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
    return at, total, digest, points


def read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Frame number, samples and the byte of the CRC-8."""
    if data[at] != 0xFF or data[at + 1] != 0xF8:
        raise ValueError("no frame where one should be")
    code, lead, p = data[at + 2] >> 4, data[at + 4], at + 5
    number, more = lead, 0
    if lead & 0x80:
        more = 8 - (~lead & 0xFF).bit_length() - 1
        number = lead & (1 << (6 - more)) - 1
        for k in range(more):
            number = number << 6 | data[p + k] & 0x3F
    p += more
    if code == 6:
        return number, data[p] + 1, p + 1
    if code == 7:
        return number, int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    return number, 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8), p


def find_frames(media: list[bytes]) -> tuple[np.ndarray, list[Frame], list[tuple[int, bytes]]]:
    """The joined media, its frames with both checksums verified, and each stream's samples and MD5."""
    joined, frames, infos, base = b"".join(media), [], [], 0
    for i, one in enumerate(media):
        first, total, digest, points = read_metadata(one)
        infos.append((total, digest))
        offsets = sorted({o for s, o, _ in points if s != (1 << 64) - 1} | ({0} if total else set()))
        if sum(n for _, _, n in points) != total:  # no point for every frame: look for headers whose frame checks out
            offsets = _scan(one, first, total)
        ends = [*(first + o for o in offsets[1:]), len(one)]
        for o, end in zip(offsets, ends, strict=True):
            number, size, p = read_header(one, first + o)
            frames.append(Frame(i, base + first + o, base + end, number, size, base + p + 1))
        base += len(one)
    data = np.frombuffer(joined, np.uint8)
    _verify(data, frames)
    return data, frames, infos


def _verify(data: np.ndarray, frames: list[Frame]) -> None:
    """Raise ValueError if a frame's checksum is wrong."""
    if frames:
        start, end, body = (np.array([getattr(f, k) for f in frames]) for k in ("start", "end", "body"))
        if (crc8(data, start, body - start - 1) != data[body - 1]).any():
            raise ValueError("a frame header's CRC-8 is wrong")
        for k in range(0, len(frames), 256):  # a bounded number of bytes at once
            s, e = start[k : k + 256], end[k : k + 256]
            if (crc16(data, s, e - s - 2) != data[e - 2].astype(np.uint16) << 8 | data[e - 1]).any():
                raise ValueError("a frame's CRC-16 is wrong")


def _scan(one: bytes, first: int, total: int) -> list[int]:
    """Offsets of the frames without a seek table: a sync code with the next number, and the frame before it has a right CRC-16."""
    starts, at, seen, number = [], first, 0, 0
    while seen < total:
        number_, size, p = read_header(one, at)
        if number_ != number:
            raise ValueError("frames are out of order")
        starts.append(at - first)
        seen, number = seen + size, number + 1
        at = _frame_end(one, at, p) if seen < total else len(one)
    return starts


def decode_frames(data: np.ndarray, frames: list[Frame]) -> list[np.ndarray]:
    """Samples of the frames, whose bits are walked in lockstep."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(frames)
    coded, todo = [], sorted(range(len(frames)), key=lambda i: -frames[i].size)
    for i in todo:
        f, kind = frames[i], int(data[frames[i].body]) >> 1
        if kind == 0:
            out[i] = np.full(f.size, int(data[f.body + 1].view(np.int8)), np.int64)
        elif kind == 1:
            out[i] = data[f.body + 1 : f.body + 1 + f.size].view(np.int8).astype(np.int64)
        elif 8 <= kind <= 12 or kind >= 32:
            coded.append((i, kind))
        else:
            raise ValueError("reserved subframe type")
    if not coded:
        return out
    size = np.array([frames[i].size for i, _ in coded])
    kind = np.array([k for _, k in coded])
    order = np.where(kind >= 32, kind - 31, kind - 8)
    lanes = np.arange(len(coded))
    # the frames' bytes end to end, then their bits
    starts = np.array([frames[i].body for i, _ in coded])
    lengths = np.array([frames[i].end for i, _ in coded]) - starts
    joined = np.concatenate([data[s : s + n] for s, n in zip(starts, lengths, strict=True)])
    bits, packed = np.unpackbits(joined), np.r_[joined, np.zeros(3, np.uint8)].astype(np.int32)
    at = (np.cumsum(lengths) - lengths) * 8 + 8

    def take(position: np.ndarray, width: int) -> np.ndarray:
        value = np.zeros(position.shape, np.int64)
        for j in range(width):
            value = value << 1 | bits[position + j]
        return value

    def signed(value: np.ndarray, width: int) -> np.ndarray:
        return value - ((value >> (width - 1) & 1) << width)

    widest = int(size.max())
    x = np.zeros((len(coded), widest), np.int32)
    for j in range(int(order.max(initial=0))):
        own = lanes[order > j]
        x[own, j] = signed(take(at[own], 8), 8)
        at[own] += 8
    linear = np.flatnonzero(kind >= 32)
    shift, coefficients = np.zeros(len(coded), np.int64), np.zeros((len(coded), int(order.max(initial=0))), np.int64)
    if len(linear):
        precision = take(at[linear], 4) + 1
        shift[linear] = signed(take(at[linear] + 4, 5), 5)
        at[linear] += 9
        for p in np.unique(precision):
            for j in range(int(order[linear].max())):
                own = linear[(precision == p) & (order[linear] > j)]
                coefficients[own, j] = signed(take(at[own], int(p)), int(p))
                at[own] += int(p)
    if take(at, 2).any():
        raise ValueError("unknown residual coding")
    partition = size >> take(at + 2, 4)
    at += 6
    # the next set bit from every position: one lookup ends a unary code
    ones = np.flatnonzero(bits).astype(np.int32)
    following = np.full(len(bits) + 1, len(bits) - 1, np.int32)
    following[: len(bits)] = ones[np.minimum(np.cumsum(bits, dtype=np.int32) - bits, len(ones) - 1)]
    begin, end_of_unary, rice = (np.zeros((len(coded), widest), np.int32) for _ in range(3))
    first_step: dict[int, list[np.ndarray]] = {}
    for n, o in {(int(a), int(b)) for a, b in zip(partition, order, strict=True)}:
        own = lanes[(partition == n) & (order == o)]
        for step in {max(o, k) for k in range(0, widest, n)}:
            first_step.setdefault(step, []).append(own)
    parameter, raw_width = np.zeros(len(coded), np.int64), np.full(len(coded), -1)
    escaped: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # lanes, step, first bit and width of residuals kept as they are
    active = np.searchsorted(-size, -np.arange(widest), side="left")  # lanes are sorted by size: so many reach a step
    at = at.astype(np.int64)
    started = int(order.max(initial=0))
    for step in range(widest):
        m = int(active[step])
        for own in first_step.get(step, ()):
            own = own[own < m]
            parameter[own], raw_width[own] = take(at[own], 4), -1
            at[own] += 4
            escapes = own[parameter[own] == 15]
            if len(escapes):
                raw_width[escapes], parameter[escapes] = take(at[escapes], 5), 0
                at[escapes] += 5
        raw = np.flatnonzero((raw_width[:m] >= 0) & (order[:m] <= step)) if (raw_width[:m] >= 0).any() else lanes[:0]
        first = at[raw]
        if step < started:
            use = lanes[:m][order[:m] <= step]
            begin[use, step], end = at[use], following[at[use]]
            end_of_unary[use, step], rice[use, step] = end, parameter[use]
            at[use] = end + 1 + parameter[use]
        else:
            begin[:m, step] = at[:m]
            end = following[at[:m]]
            end_of_unary[:m, step], rice[:m, step] = end, parameter[:m]
            at[:m] = end + 1 + parameter[:m]
        if len(raw):
            end_of_unary[raw, step], at[raw] = first, first + raw_width[raw]
            escaped.append((raw, step, first, raw_width[raw]))
    folded = end_of_unary - begin
    position = end_of_unary + 1  # at most 14 low bits: they lie in three bytes
    byte = position >> 3
    three = packed[byte] << 16 | packed[byte + 1] << 8 | packed[byte + 2]
    low = three >> (24 - (position & 7) - rice) & (1 << rice) - 1
    folded = folded << rice | low
    residual = folded >> 1 ^ -(folded & 1)
    for raw, step, first, width in escaped:
        for w in np.unique(width[width > 0]):
            own = width == w
            residual[raw[own], step] = signed(take(first[own], int(w)), int(w))
    for o in np.unique(order[kind < 32]):
        own = np.flatnonzero((kind < 32) & (order == o))
        warm, y = x[own, :o], residual[own]
        y[:, :o] = 0
        for k in reversed(range(o)):  # undo one difference after another, each from its first known value
            y[:, o - 1] = np.diff(warm, n=k, axis=1)[:, -1]
            y[:, o - 1 :] = np.cumsum(y[:, o - 1 :], 1)
        y[:, :o] = warm
        x[own] = y
    for o in np.unique(order[linear]) if len(linear) else ():
        own = linear[order[linear] == o]
        y, r, c, s = x[own].T.copy(), residual[own].T.copy(), coefficients[own, :o][:, ::-1].T.copy(), shift[own]
        for step in range(int(o), widest):
            y[step] = r[step] + ((c * y[step - o : step]).sum(0) >> s)
        x[own] = y.T
    for lane, (i, _) in enumerate(coded):
        out[i] = x[lane, : size[lane]]
    return out


def decode_media(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(sample offset, byte offset of the frame, samples as unsigned bytes) of every frame of each stream, all checksums verified."""
    data, frames, infos = find_frames(media)
    samples: list[np.ndarray] = []
    k = 0
    while k < len(frames):
        end, total = k, 0
        while end < len(frames) and (total < CHUNK or end == k):
            total, end = total + frames[end].size, end + 1
        samples += decode_frames(data, frames[k:end])
        k = end
    base = np.cumsum([0, *map(len, media)])
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in media]
    for f, s in zip(frames, samples, strict=True):
        at = out[f.media][-1][0] + len(out[f.media][-1][2]) if out[f.media] else 0
        out[f.media].append((at, f.start - int(base[f.media]), (s + 128).astype(np.uint8)))
    for blocks, (total, digest) in zip(out, infos, strict=True):
        pcm = np.concatenate([b for _, _, b in blocks]) if blocks else np.zeros(0, np.uint8)
        if len(pcm) != total or hashlib.md5((pcm ^ 128).tobytes()).digest() != digest:
            raise ValueError("the samples' MD5 is wrong")
    return out


def read_samples(media: list[bytes], first: list[int], count: list[int]) -> list[bytes]:
    """So many samples (unsigned bytes) of each stream from the first wanted one on, decoded from the seek points before them alone."""
    frames, skips, base = [], [], 0
    for i, (one, lo, n) in enumerate(zip(media, first, count, strict=True)):
        start, total, _, points = read_metadata(one)
        points = sorted((s, o) for s, o, _ in points if s != (1 << 64) - 1) or [(0, 0)]
        if lo < 0 or n < 0 or lo + n > total:
            raise ValueError("no such samples")
        k = max((j for j, (s, _) in enumerate(points) if s <= lo), default=0)
        at, offset = points[k] if points[k][0] <= lo else (0, 0)
        skips.append(lo - at)
        own = base + start + offset
        while n and at < lo + n:  # frame by frame: the next point, else a search for the frame's end
            number, size, p = read_header(one, own - base)
            k += 1
            known = k < len(points) and points[k][0] == at + size
            end = len(one) if at + size >= total else start + points[k][1] if known else _frame_end(one, own - base, p)
            frames.append(Frame(i, own, base + end, number, size, base + p + 1))
            at, own = at + size, base + end
            k -= not known
        base += len(one)
    data = np.frombuffer(b"".join(media), np.uint8)
    _verify(data, frames)
    parts: list[list[np.ndarray]] = [[] for _ in media]
    k = 0
    while k < len(frames):
        end, total = k, 0
        while end < len(frames) and (total < CHUNK or end == k):
            total, end = total + frames[end].size, end + 1
        for f, s in zip(frames[k:end], decode_frames(data, frames[k:end]), strict=True):
            parts[f.media].append((s + 128).astype(np.uint8))
        k = end
    return [np.concatenate([*p, np.zeros(0, np.uint8)])[skip : skip + n].tobytes() for p, skip, n in zip(parts, skips, count, strict=True)]


def _frame_end(one: bytes, at: int, p: int) -> int:
    """The byte after the frame that begins at ``at``: the next sync code before which its CRC-16 is right."""
    data, crc, done, q = np.frombuffer(one, np.uint8), 0, at, p + 1
    while True:
        q = one.find(b"\xff\xf8", q)
        q = len(one) if q < 0 else q
        if q - 2 > p:
            crc, done = _continued(crc, data[done : q - 2], 0x8005, 16), q - 2
            if crc == int.from_bytes(one[q - 2 : q], "big"):
                return q
        if q == len(one):
            raise ValueError("a frame's CRC-16 is wrong")
        q += 1


# ---------------------------------------------------------------- columns


def payload(text: str) -> bytes:
    """UTF-8, padded with zero bytes to a positive multiple of 64."""
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``, the FLAC stream of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = texts(batch)
        media = encode_payloads([payload(t) for t in raw])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", run)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, frame_offset (byte in the stream) and pcm (unsigned bytes): a row for each frame; null media gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [(i, m) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if m is not None]
            rows = [(i, at, byte, pcm.tobytes()) for (i, _), blocks in zip(have, decode_media([m for _, m in have]), strict=True) for at, byte, pcm in blocks]
            kinds = [("doc_id", pa.int64()), ("sample_offset", pa.int64()), ("frame_offset", pa.int64()), ("pcm", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    bounded_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, frame_offset long, pcm binary")


def feature(pcm: np.ndarray) -> str:
    """Mean, root mean square, zero crossings and peak of the samples, from exact sums."""
    x = pcm.astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def media_digests(docs: DataFrame) -> DataFrame:
    """Every whole text stored as FLAC and read back: digests of the payload that was read, of the stream, and a feature."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, raw = [], texts(batch)
        sizes = [len(t.encode()) for t in raw]
        at = 0
        while at < len(raw):  # a bounded number of bytes at once
            end, total = at, 0
            while end < len(raw) and (end == at or total < 4 * CHUNK):
                total, end = total + sizes[end], end + 1
            media = encode_payloads([payload(t) for t in raw[at:end]])
            decoded = [np.concatenate([b for _, _, b in blocks]) for blocks in decode_media(media)]
            tails = read_samples(media, [len(pcm) - 64 for pcm in decoded], [64] * len(decoded))
            for n, m, pcm, last in zip(sizes[at:end], media, decoded, tails, strict=True):
                rows.append((n, len(pcm), hashlib.sha256(pcm.tobytes()).hexdigest(), zlib.crc32(last), len(m), hashlib.sha256(m).hexdigest(), feature(pcm)))
            at = end
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)
