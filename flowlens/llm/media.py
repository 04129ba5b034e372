"""Media columns: baseline JPEG in numpy.

``encode`` keeps bytes losslessly in a baseline JPEG whose blocks are flat: with a DC quantizer of 8 the DC coefficient of a block is the
byte less 128, and the DC-only luminance thumbnail (one pixel a block) gives the bytes back. ``thumbnails`` parses markers, Huffman-decodes
scans and rebuilds that thumbnail for any baseline JPEG with interleaved components; all restart intervals of a batch advance together.

Defined cases: a null text counts as empty and is stored as 576 bytes of padding; payloads of more than ``FRAME_BYTES`` become several JPEGs
one after the other; media that is no baseline JPEG gives null features; equal texts give equal media and features, so repeated rows and ties
are alike; very long texts are stored whole; an empty table gives no rows. Only the named column is read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 576
ROW = 24
FRAME_BYTES = 341 * UNIT
BATCH_BYTES = 1 << 20

#: Fixed values of the JPEG standard: number of codes of each length and symbols of the luminance DC table. The AC table has only the end of block.
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
AC_COUNTS, AC_SYMBOLS = (1, *[0] * 15), (0,)


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), assigned in order of length."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: tuple, symbols: tuple) -> np.ndarray:
    """For any 16 bits the length (high byte) and symbol (low byte) of the code they begin with; length 0 where there is none."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in huffman_codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


@lru_cache(maxsize=64)
def flat_blocks(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For any 16 bits that begin with a whole flat block (a DC code, its bits, the end of block): how many bits it has, and its difference.

    0 bits where the block is not flat, or longer, or where there is no code.
    """
    patterns = np.arange(1 << 16, dtype=np.int64)
    found = lookup(*dc).astype(np.int64)
    bits, used = found & 255, (found >> 8) + (found & 255)
    inside = (found >= 256) & (used < 16)
    used = np.where(inside, used, 0)
    low = (patterns >> (16 - used)) & ((1 << bits) - 1)
    stop = lookup(*ac).astype(np.int64)[(patterns << used) & 0xFFFF]
    inside &= (stop >= 256) & (stop & 255 == 0) & (used + (stop >> 8) <= 16)
    diff = np.where(low < (1 << bits) >> 1, low - (1 << bits) + 1, low)
    return np.where(inside, used + (stop >> 8), 0), np.where(inside, diff, 0)


@lru_cache(maxsize=1)
def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of the whole flat block for each difference from -255 to 255, and how many they are; the end of block is a single 0."""
    codes = huffman_codes(DC_COUNTS, DC_SYMBOLS)
    code, size = (np.array([codes[s][k] for s in DC_SYMBOLS], np.int64) for k in (0, 1))
    diff = np.arange(-255, 256)
    category = np.array([int(abs(d)).bit_length() for d in diff.tolist()])
    low = np.where(diff < 0, diff + (1 << category) - 1, diff)
    return ((code[category] << category) | low) << 1, size[category] + category + 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    frame = struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, bytes([0, 8, *[1] * 63])), _segment(0xC0, frame),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])), _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])), _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def _scans(payload: np.ndarray, rows_of: list[int]) -> list[bytes]:
    """Entropy-coded data of frames whose bytes stand one after the other in ``payload``; each row of blocks is a restart interval."""
    symbols, lengths = _block_codes()
    value = payload.reshape(-1, ROW).astype(np.int16) - 128
    diff = np.diff(value, axis=1, prepend=np.int16(0)) + 255
    symbol, length = symbols[diff], lengths[diff]
    end = np.cumsum(length, axis=1)
    offset = end - length
    whole = np.ascontiguousarray((symbol << (24 - (offset & 7) - length)).T.astype(np.uint32))
    buffer, line = np.zeros((len(value), 48), np.uint8), np.arange(len(value))
    flat, first = buffer.ravel(), np.ascontiguousarray((line[:, None] * 48 + (offset >> 3)).T)
    for at, bits in zip(first, whole):
        for k, shift in enumerate((16, 8, 0)):
            flat[at + k] |= (bits >> np.uint32(shift)).astype(np.uint8)
    used = -(-end[:, -1] // 8)
    buffer[line, used - 1] |= ((1 << (-end[:, -1] % 8)) - 1).astype(np.uint8)
    flat, owner = buffer[np.arange(48) < used[:, None]], np.repeat(line, used)
    number = np.concatenate([np.arange(n) for n in rows_of])
    final = np.zeros(len(value), bool)
    final[np.cumsum(rows_of) - 1] = True
    closing = np.zeros(len(flat), bool)
    closing[np.cumsum(used) - 1] = ~final
    stuffed = flat == 255
    at = np.arange(len(flat)) + np.cumsum(stuffed + 2 * closing) - (stuffed + 2 * closing)
    out = np.zeros(len(flat) + int(stuffed.sum() + 2 * closing.sum()), np.uint8)
    out[at] = flat
    mark = at[closing] + 1 + stuffed[closing]
    out[mark], out[mark + 1] = 255, 0xD0 + number[owner[closing]] % 8
    ends = np.cumsum(used)[np.cumsum(rows_of) - 1] - 1
    stops = at[ends] + 1 + stuffed[ends]
    return [out[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops)]


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Media for each payload, whose length is a positive multiple of ``UNIT``."""
    frames = [p[a : a + FRAME_BYTES] for p in payloads for a in range(0, len(p), FRAME_BYTES)]
    scans: list[bytes] = []
    group, size = [], 0
    for k, frame in enumerate(frames):
        group.append(frame)
        size += len(frame)
        if size >= BATCH_BYTES or k + 1 == len(frames):
            scans += _scans(np.frombuffer(b"".join(group), np.uint8), [len(f) // ROW for f in group])
            group, size = [], 0
    made = iter(_header(len(f) // ROW) + s + b"\xff\xd9" for f, s in zip(frames, scans))
    return [b"".join(next(made) for _ in range(0, len(p), FRAME_BYTES)) for p in payloads]


@dataclass
class Frame:
    """What the markers of one JPEG say. components: (id, horizontal, vertical, quantizer of DC); coders: (component, DC, AC table) in scan order.

    data: the scan without stuffing and restart markers; cuts: where its restart intervals begin, and its end.
    """

    width: int
    height: int
    components: list[tuple[int, int, int, int]]
    coders: list[tuple[int, tuple, tuple]]
    interval: int
    data: np.ndarray
    cuts: np.ndarray
    end: int


def parse(media: bytes, at: int = 0) -> Frame:
    """The baseline JPEG that starts at ``at``; ValueError where there is none."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    quantizers: dict[int, int] = {}
    tables: dict[int, tuple[tuple, tuple]] = {}
    shape, components, interval = None, [], 0
    while True:
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("no marker")
        marker = media[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        body = media[at + 4 : at + 2 + int.from_bytes(media[at + 2 : at + 4], "big")]
        at += 4 + len(body)
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, slot = divmod(body[k], 16)
                quantizers[slot] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8:
                raise ValueError("not 8 bits a sample")
            shape = struct.unpack(">HH", body[1:5])
            components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xD9:
            raise ValueError("no scan")
        elif marker == 0xDA:
            break
    if shape is None or not all(shape) or body[0] != len(components):
        raise ValueError("no frame, or components not in one scan")
    by_id = {c[0]: i for i, c in enumerate(components)}
    coders = [(by_id[body[1 + 2 * i]], tables[body[2 + 2 * i] >> 4], tables[16 | body[2 + 2 * i] & 15]) for i in range(body[0])]
    clean, cuts, stop = _scan(np.frombuffer(media, np.uint8, offset=at))
    if media[at + stop + 1] != 0xD9:
        raise ValueError("more than one scan")
    return Frame(shape[1], shape[0], [(*c[:3], quantizers[c[3]]) for c in components], coders, interval, clean, cuts, at + stop + 2)


def _scan(data: np.ndarray, size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, int]:
    """(entropy-coded bytes, starts of the restart intervals with the end, where the marker after the scan stands); read in slices up to that marker."""
    parts, cuts, held, begin = [], [0], 0, 0
    while begin < len(data) - 1:
        part = data[begin : begin + size + 1]  # with the byte after, which tells what a last 255 is
        marks = np.flatnonzero(part[:-1] == 255)
        after = part[marks + 1]
        ends = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
        stop = int(ends[0]) if len(ends) else len(part) - 1
        restarts = marks[(after >= 0xD0) & (after <= 0xD7) & (marks < stop)]
        plain = np.ones(len(part), bool)
        plain[marks[(after == 0) & (marks < stop)] + 1] = False
        plain[restarts], plain[restarts + 1] = False, False
        if begin and data[begin - 1] == 255 and (data[begin] == 0 or 0xD0 <= data[begin] <= 0xD7):
            plain[0] = False  # the second byte of a pair that began in the slice before
        plain = plain[:stop]
        upto = np.concatenate([[0], np.cumsum(plain)])
        cuts += (held + upto[restarts]).tolist()
        parts.append(part[:stop][plain])
        held += int(upto[-1])
        if len(ends):
            return np.concatenate(parts), np.array([*cuts, held]), begin + stop
        begin += len(part) - 1
    raise ValueError("no end of scan")


def thumbnails(frames: list[Frame]) -> list[np.ndarray]:
    """The DC-only luminance (first component) of each frame, one pixel for each of its blocks."""
    out: list[np.ndarray] = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((tuple(f.components), tuple(f.coders)), []).append(i)
    for (components, coders), members in groups.items():
        part, size = [], 0
        for i in members:
            part.append(i)
            size += len(frames[i].data)
            if size >= BATCH_BYTES or i == members[-1]:
                for k, image in zip(part, _lockstep([frames[k] for k in part], components, coders)):
                    out[k] = image
                part, size = [], 0
    return out


def _lockstep(frames: list[Frame], components: tuple, coders: tuple) -> list[np.ndarray]:
    wide, high = max(c[1] for c in components), max(c[2] for c in components)
    if len(components) == 1:
        wide = high = 1  # a scan of one component is not interleaved: its unit is one block
    grids = [(-(-f.height // (8 * high)), -(-f.width // (8 * wide))) for f in frames]
    per_unit = [(c, dc, ac, *((1, 1) if len(components) == 1 else components[c][1:3])) for c, dc, ac in coders]
    v0, h0 = (1, 1) if len(components) == 1 else (components[0][2], components[0][1])
    images = [np.zeros(rows * cols * v0 * h0, np.int64) for rows, cols in grids]
    base = np.cumsum([0, *[len(x) for x in images]])
    flat = np.zeros(base[-1], np.int64)
    counts = np.array([len(f.cuts) - 1 for f in frames])
    owner = np.repeat(np.arange(len(frames)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    total = np.array([rows * cols for rows, cols in grids])[owner]
    step = np.where((every := np.array([f.interval for f in frames])[owner]) > 0, every, total)
    first = number * step
    units = np.clip(total - first, 0, step)
    cols = np.array([c for _, c in grids])[owner]
    origin = base[owner]
    data = np.concatenate([*[f.data for f in frames], np.zeros(64, np.uint8)]).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    sizes = np.concatenate([np.diff(f.cuts) for f in frames])
    at = (np.cumsum(sizes) - sizes) * 8
    limit = (len(window) - 1) * 8
    predicted = np.zeros((len(components), len(owner)), np.int64)

    def peek(where: np.ndarray) -> np.ndarray:
        where = np.minimum(where, limit)
        return ((window[where >> 3] >> (16 - (where & 7)).astype(np.uint32)) & np.uint32(0xFFFF)).astype(np.int64)

    # One component of one block a unit: a flat block, if it is one, is read by one look at 16 bits.
    single = len(per_unit) == 1 and per_unit[0][3:] == (1, 1)
    flat_bits, flat_diff = flat_blocks(*per_unit[0][1:3]) if single else (None, None)
    least, place = int(units.min(initial=0)), origin + first
    for t in range(int(units.max(initial=0))):
        live = slice(None) if t < least else np.flatnonzero(units > t)
        if single:
            seen = peek(at[live])
            bits = flat_bits[seen]
            if bits.all():
                at[live] += bits
                predicted[0, live] += flat_diff[seen]
                flat[place[live] + t] = predicted[0, live]
                continue
        live = np.flatnonzero(units > t)
        for c, dc, ac, h, v in per_unit:
            dc_table, ac_table = lookup(*dc), lookup(*ac)
            for b in range(h * v):
                found = dc_table[peek(at[live])].astype(np.int64)
                if (found < 256).any():
                    raise ValueError("no such code")
                bits = found & 255
                at[live] += found >> 8
                low = peek(at[live]) >> (16 - bits)
                at[live] += bits
                predicted[c, live] += np.where(low < (1 << bits) >> 1, low - (1 << bits) + 1, low)
                if c == 0:
                    row, col = np.divmod(first[live] + t, cols[live])
                    flat[origin[live] + (row * v0 + b // h) * cols[live] * h0 + col * h0 + b % h] = predicted[0, live]
                todo, k = live, np.ones(len(live), np.int64)
                while len(todo):
                    found = ac_table[peek(at[todo])].astype(np.int64)
                    if (found < 256).any():
                        raise ValueError("no such code")
                    run, bits = (found >> 4) & 15, found & 15
                    at[todo] += (found >> 8) + bits
                    k += run + 1
                    on = ((bits > 0) | (run == 15)) & (k < 64)
                    todo, k = todo[on], k[on]
    pixels = np.clip(np.floor(flat * components[0][3] / 8 + 0.5) + 128, 0, 255).astype(np.uint8)
    out = []
    for i, (f, (rows, cols_)) in enumerate(zip(frames, grids)):
        image = pixels[base[i] : base[i + 1]].reshape(rows * v0, cols_ * h0)
        out.append(image[: -(-f.height * v0 // (8 * high)), : -(-f.width * h0 // (8 * wide))])
    return out


def decode(media: list[bytes]) -> list[list[np.ndarray] | None]:
    """The thumbnails of each medium's frames; None where it is null or no baseline JPEG."""
    parsed: list[list[Frame] | None] = []
    for m in media:
        try:
            frames, at = [], 0
            while m is not None and at < len(m):
                frames.append(parse(m, at))
                at = frames[-1].end
            parsed.append(frames or None)
        except (ValueError, KeyError, IndexError, struct.error):
            parsed.append(None)
    try:
        images = iter(thumbnails([f for p in parsed for f in p or ()]))
        return [None if p is None else [next(images) for _ in p] for p in parsed]
    except ValueError:  # damaged data in one of them: each by itself
        if len(media) == 1:
            return [None]
        return [x for m in media for x in decode([m])]


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each cell of the thumbnail averaged to 8 x 8 is above their mean."""
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in image.shape)
    if min(image.shape) >= 8:
        sums = np.add.reduceat(np.add.reduceat(image, rows[:-1], axis=0, dtype=np.int64), cols[:-1], axis=1)
        cell = sums / (np.diff(rows)[:, None] * np.diff(cols))
        return np.packbits(cell > cell.mean()).tobytes().hex()
    padded_sum = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    padded_sum[1:, 1:] = image.astype(float).cumsum(0).cumsum(1)
    lo_r, hi_r, lo_c, hi_c = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    lo_r, hi_r = np.minimum(lo_r, image.shape[0] - 1), np.minimum(hi_r, image.shape[0])
    lo_c, hi_c = np.minimum(lo_c, image.shape[1] - 1), np.minimum(hi_c, image.shape[1])
    area = (hi_r - lo_r)[:, None] * (hi_c - lo_c)
    cell = (padded_sum[np.ix_(hi_r, hi_c)] - padded_sum[np.ix_(lo_r, hi_c)] - padded_sum[np.ix_(hi_r, lo_c)] + padded_sum[np.ix_(lo_r, lo_c)]) / area
    return np.packbits(cell > cell.mean()).tobytes().hex()


def _slices(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Successive slices of values whose sizes sum to about ``most`` at most, or of one value."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def store_column(text: str | Column = "text") -> Column:
    """The medium (binary) that holds a text's padded UTF-8 bytes. Texts of a batch are encoded about ``BATCH_BYTES`` at a time."""

    @F.pandas_udf("binary")
    def store(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            values = [t if isinstance(t, str) else "" for t in texts]
            out: list[bytes] = []
            for s in _slices([len(t) for t in values]):
                out += encode([padded(t.encode("utf-8", "surrogatepass")) for t in values[s]])
            yield pd.Series(out, dtype=object)

    return store(text)


_FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _features(media: list[bytes | None]) -> list[list]:
    rows = []
    for m, images in zip(media, decode(media)):
        if images is None:
            rows.append([None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None])
            continue
        payload = b"".join(i.tobytes() for i in images)
        feature = ";".join(f"{i.shape[1]}x{i.shape[0]}:{thumbnail_hash(i)}" for i in images)
        rows.append([len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature])
    return rows


def features_column(media: str | Column) -> Column:
    """What the stored bytes hold: frames, payload size and hashes, the medium's size and hash, and per frame its dimensions with a thumbnail hash."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = [None if m is None else bytes(m) for m in part]
            rows = [row for s in _slices([len(m or b"") for m in values]) for row in _features(values[s])]
            yield pd.DataFrame(rows, columns=_FEATURES)

    return features(media)
