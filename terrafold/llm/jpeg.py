"""Baseline JPEG: a parser and Huffman decoder in numpy, DC-only thumbnails, and an encoder.

The decoder reads markers, tables and frames, then decodes the entropy-coded segments between
restart markers side by side: one step decodes one symbol of every segment of a batch of images.
The thumbnail takes each 8x8 luminance block's DC coefficient, one sample a block.

Payloads are stored as grey images whose blocks have a DC coefficient only. With a DC quantiser
of 8 a block's level is its byte less 128, so the thumbnail holds the payload without loss.
Each block row is a restart interval. Images are ROW blocks wide and at most 8190 block rows
high; a longer payload becomes several images, one after the other.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pieces

UNIT = 192
ROW = 64
PIECE = UNIT * (ROW * 8190 // UNIT)

#: Codes of the payload images: DC categories 0-8 in four bits each, end of block in one bit.
_DC_BITS, _DC_VALUES = (0, 0, 0, 9) + (0,) * 12, tuple(range(9))
_AC_BITS, _AC_VALUES = (1,) + (0,) * 15, (0,)
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(height: int, width: int, interval: int) -> bytes:
    table = bytes([0, 8]) + bytes([1] * 63)
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
            _segment(0xDB, table),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, bytes([0x00, *_DC_BITS, *_DC_VALUES])),
            _segment(0xC4, bytes([0x10, *_AC_BITS, *_AC_VALUES])),
            _segment(0xDD, struct.pack(">H", interval)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """JPEG files for payloads of a multiple of ROW bytes, each one or more images."""
    cuts = [(i, p[a : a + PIECE]) for i, p in enumerate(payloads) for a in range(0, len(p), PIECE)]
    if not cuts:
        return [b""] * len(payloads)
    levels = np.frombuffer(b"".join(c for _, c in cuts), np.uint8).astype(np.int16).reshape(-1, ROW) - 128
    diff = np.diff(levels, axis=1, prepend=np.int16(0)).astype(np.int64)
    category = _CATEGORY[diff + 255]
    size = category + 5
    bits = (category << (category + 1)) | (np.where(diff < 0, diff + (1 << category) - 1, diff) << 1)
    ends = np.cumsum(size, axis=1)
    used = ends[:, -1]
    length = -(-used // 8)
    pad = length * 8 - used
    base = np.concatenate([[0], np.cumsum(length)])
    at = (ends - size) + base[:-1, None] * 8
    word = bits << (24 - size - (at & 7))
    place = (at >> 3).ravel()
    total = int(base[-1])
    raw = np.zeros(total + 3, np.int64)
    for k in range(3):  # bits of different codes never overlap, so their sum is their union
        raw += np.bincount(place + k, ((word >> (16 - 8 * k)) & 255).ravel(), total + 3).astype(np.int64)
    raw = raw[:total].astype(np.uint8)
    raw[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # stuffing after 0xFF, and a restart marker after every row but an image's last
    rows = np.array([len(c) // ROW for _, c in cuts])
    first = np.concatenate([[0], np.cumsum(rows)])
    number = np.arange(len(levels)) - np.repeat(first[:-1], rows)
    last = np.zeros(len(levels), bool)
    last[first[1:] - 1] = True
    extra = (raw == 255).astype(np.int64)
    extra[base[1:] - 1] += np.where(last, 0, 2)
    spot = np.arange(total) + np.cumsum(extra) - extra
    out = np.zeros(total + int(extra.sum()), np.uint8)
    out[spot] = raw
    mark = spot[base[1:] - 1] + 1 + (raw[base[1:] - 1] == 255)
    out[mark[~last]] = 0xFF
    out[mark[~last] + 1] = 0xD0 + number[~last] % 8
    starts = spot[base[first[:-1]]]
    stops = np.append(starts[1:], len(out))
    files: list[list[bytes]] = [[] for _ in payloads]
    data = out.tobytes()
    for (i, c), a, b in zip(cuts, starts.tolist(), stops.tolist()):
        files[i].append(_header(len(c) // ROW * 8, ROW * 8, ROW) + data[a:b] + b"\xff\xd9")
    return [b"".join(f) for f in files]


class Frame:
    """What the markers of one image say, and where its entropy-coded segments lie."""

    __slots__ = ("height", "width", "parts", "quant", "dc", "ac", "interval", "spans", "scan")


def parse(data: bytes) -> list[Frame]:
    """The frames of one or more baseline images, one after the other."""
    frames, at = [], 0
    frame = Frame()
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = data[at + 1]
        at += 2
        if marker == 0xFF:
            at -= 1
        elif marker == 0xD8:
            frame = Frame()
            frame.interval, frame.quant, frame.dc, frame.ac = 0, {}, {}, {}
        elif marker == 0xD9:
            frames.append(frame)
        elif 0xD0 <= marker <= 0xD7 or marker == 0x01:
            pass
        else:
            (length,) = struct.unpack_from(">H", data, at)
            body = data[at + 2 : at + length]
            at += length
            if marker == 0xDB:
                while body:
                    wide, slot = body[0] >> 4, body[0] & 15
                    size = 128 if wide else 64
                    frame.quant[slot] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8)
                    body = body[1 + size :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (frame.ac if body[0] >> 4 else frame.dc)[body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                depth, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("samples must have 8 bits")
                frame.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                (frame.interval,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                frame.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                if len(frame.scan) != len(frame.parts):
                    raise ValueError("all parts must share one scan")
                spans, start, look = [], at, at
                while True:
                    look = data.find(b"\xff", look)
                    if look < 0 or look + 1 >= len(data):
                        raise ValueError("the scan has no end")
                    code = data[look + 1]
                    if 0xD0 <= code <= 0xD7:
                        spans.append((start, look))
                        start = look = look + 2
                    elif code == 0:
                        look += 2
                    elif code == 0xFF:
                        look += 1
                    else:
                        break
                spans.append((start, look))
                frame.spans, at = spans, look
    return frames


_lookups: dict[tuple, np.ndarray] = {}


def _lookup(bits: tuple, values: tuple) -> np.ndarray:
    """For any 16 bits to come: the code's length * 256 + its value; 0 where there is no code."""
    key = (bits, values)
    if key not in _lookups:
        table, code, k = np.zeros(1 << 16, np.int64), 0, 0
        for length, n in enumerate(bits, 1):
            for _ in range(n):
                a = code << (16 - length)
                table[a : a + (1 << (16 - length))] = length * 256 + values[k]
                code, k = code + 1, k + 1
            code <<= 1
        _lookups[key] = table
    return _lookups[key]


def _segments(data: bytes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the segments without stuffing, and where each begins."""
    parts = [np.frombuffer(data, np.uint8, b - a, a) for a, b in spans]
    raw = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    begins = np.concatenate([[0], np.cumsum([b - a for a, b in spans])])[:-1]
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    moved = np.concatenate([[0], np.cumsum(stuffed)])
    return raw[~stuffed], begins - moved[begins]


def decode_dc(images: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """For each file its frames, each with its luminance DC coefficients, dequantised, by block."""
    parsed = [parse(x) for x in images]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, frames in enumerate(parsed):
        for j, f in enumerate(frames):
            key = (tuple(f.parts), tuple(f.scan), tuple(sorted(f.dc.items())), tuple(sorted(f.ac.items())))
            groups.setdefault(key, []).append((i, j))
    out: list[list] = [[None] * len(frames) for frames in parsed]
    for members in groups.values():
        for (i, j), dc in zip(members, _decode_alike([(images[i], parsed[i][j]) for i, j in members])):
            out[i][j] = (parsed[i][j], dc)
    return out


def _decode_alike(items: list[tuple[bytes, Frame]]) -> list[np.ndarray]:
    """Luminance DC of frames with equal parts and tables."""
    frame = items[0][1]
    tall, wide = max(p[2] for p in frame.parts), max(p[1] for p in frame.parts)
    single = len(frame.parts) == 1  # the blocks of a lone part come row by row, whatever its factors
    order = []  # per block of a unit: part, DC table, AC table
    for k, (name, dc, ac) in enumerate(frame.scan):
        part = next(p for p in frame.parts if p[0] == name)
        order += [(k, _lookup(*frame.dc[dc]), _lookup(*frame.ac[ac]))] * (1 if single else part[1] * part[2])
    luma = frame.parts[0]
    raws, begins, units, place = [], [], [], 0
    shapes = []
    for data, f in items:
        rows, cols = (-(-f.height // 8), -(-f.width // 8)) if single else (-(-f.height // (8 * tall)), -(-f.width // (8 * wide)))
        total = rows * cols
        raw, begin = _segments(data, f.spans)
        step = f.interval or total
        count = np.full(-(-total // step), step)
        count[-1] = total - step * (len(count) - 1)
        if len(count) != len(begin):
            raise ValueError("restart markers are missing")
        raws.append(raw)
        begins.append(begin + place)
        units.append(count)
        place += len(raw)
        shapes.append((rows, cols, len(count), total))
    raw = np.concatenate([*raws, np.full(16, 255, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        window |= raw[k : len(raw) - 8 + k] << np.uint64(56 - 8 * k)
    pos = np.concatenate(begins).astype(np.int64) * 8
    left = np.concatenate(units)
    lanes = len(pos)
    longest = int(left.max())
    first = sum(1 for o in order if o[0] == 0)
    dc_out = np.zeros((longest * first, lanes), np.int32)
    level = np.zeros((len(frame.parts), lanes), np.int64)
    active = np.arange(lanes)
    even = bool((left == longest).all())

    def symbols(at, table):
        """(run and size of the next code, its extra bits' value, position behind) for the lanes at."""
        p = pos[at]
        ahead = window[p >> 3] << (p & 7).astype(np.uint64)
        found = table[(ahead >> np.uint64(48)).astype(np.int64)]
        length, value = found >> 8, found & 255
        bits = value & 15
        extra = ((ahead << length.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - bits.astype(np.uint64))).astype(np.int64)
        pos[at] = p + length + bits
        if not length.all():
            raise ValueError("a code that the tables do not have")
        return value, np.where(extra < (1 << bits >> 1), extra - (1 << bits) + 1, extra)

    for unit in range(longest):
        if not even:
            active = np.flatnonzero(left > unit)
        k = 0
        for part, dc, ac in order:
            value, extra = symbols(active, dc)
            level[part, active] += extra
            if part == 0:
                dc_out[unit * first + k, active] = level[0, active]
                k += 1
            busy, filled = active, np.ones(len(active), np.int64)
            while len(busy):
                value, _ = symbols(busy, ac)
                filled = filled + (value >> 4) + 1
                more = (value != 0) & (filled < 64)
                if not more.any():
                    break
                busy, filled = busy[more], filled[more]
    results, lane = [], 0
    for (_, f), (rows, cols, n, total) in zip(items, shapes):
        blocks = dc_out[:, lane : lane + n].T.reshape(-1, first)
        if n > 1 and longest * n != total:
            step = int(units[len(results)][0])
            blocks = dc_out[:, lane : lane + n].T.reshape(n, longest, first)[:, :step].reshape(-1, first)
        blocks = blocks[:total] * int(f.quant[luma[3]][0])
        lane += n
        h, v = (1, 1) if single else (luma[1], luma[2])
        grid = blocks.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
        own_rows = -(-(-(-f.height * luma[2] // tall)) // 8)
        own_cols = -(-(-(-f.width * luma[1] // wide)) // 8)
        results.append(grid[:own_rows, :own_cols])
    return results


def thumbnail(dc: np.ndarray) -> np.ndarray:
    """Mean grey of each block from its dequantised DC coefficient."""
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(grey: np.ndarray) -> int:
    """64 bits: whether each cell of an 8x8 grid over the thumbnail is brighter than its mean."""
    h, w = grey.shape
    r = np.linspace(0, h, 9).astype(int)
    c = np.linspace(0, w, 9).astype(int)
    sums = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, 0, dtype=np.int64), 1, out=sums[1:, 1:])
    low_r, high_r = np.minimum(r[:-1], h - 1), np.maximum(r[1:], np.minimum(r[:-1], h - 1) + 1)
    low_c, high_c = np.minimum(c[:-1], w - 1), np.maximum(c[1:], np.minimum(c[:-1], w - 1) + 1)
    cell = sums[high_r][:, high_c] - sums[low_r][:, high_c] - sums[high_r][:, low_c] + sums[low_r][:, low_c]
    cell /= (high_r - low_r)[:, None] * (high_c - low_c)[None]
    return int.from_bytes(np.packbits(cell.ravel() > grey.mean()).tobytes(), "big")


def _payload(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store_media(docs: DataFrame) -> DataFrame:
    """docs(text, ...) without text, plus n_bytes and media, the text stored as JPEG.

    The payload is the text in UTF-8 (null: empty), filled with spaces to a positive multiple
    of 192 bytes. Equal texts give equal media; other columns pass through, but for ones named
    as the results. An empty table gives an empty table.
    """
    passed = [c for c in docs.columns if c not in ("text", "n_bytes", "media")]

    def run(batches):
        for batch in pieces(batches, len(passed), 1 << 21):
            texts = [(x or "").encode("utf-8") for x in batch.column(len(passed)).to_pylist()]
            media = encode_payloads([_payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [*passed, "n_bytes", "media"]
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in passed] + ["n_bytes bigint, media binary"])
    return docs.select(*[f"`{c}`" for c in passed], "text").mapInArrow(run, schema)


def _decode_each(files: list[bytes]):
    """The frames of each file; None for a file that cannot be decoded."""
    try:
        return list(decode_dc(files))
    except (ValueError, IndexError, KeyError, OverflowError, struct.error):
        if len(files) == 1:
            return [None]
        return [frames for data in files for frames in _decode_each([data])]


def media_features(media: DataFrame) -> DataFrame:
    """media(media, ...) without media, plus what is read back from the stored bytes: width,
    height, frames, thumbnail (binary, the thumbnails' samples), thumbnail_hash (hexadecimal, one a
    frame, joined by commas), media_bytes and media_sha256.

    Null or empty media have no frames; of media that cannot be decoded, frames and thumbnail are
    null too, and the others are not affected. Repeated rows give equal results. Other columns pass
    through, but for ones named as the results, which are replaced. An empty table gives an empty
    table."""
    new = ("width", "height", "frames", "thumbnail", "thumbnail_hash", "media_bytes", "media_sha256")
    passed = [c for c in media.columns if c != "media" and c not in new]

    def run(batches):
        for batch in pieces(batches, len(passed), 1 << 22):
            files = [x or b"" for x in batch.column(len(passed)).to_pylist()]
            rows = []
            for data, frames in zip(files, _decode_each(files)):
                if frames is None:
                    rows.append((None, None, None, None, None, len(data), hashlib.sha256(data).hexdigest()))
                    continue
                greys = [thumbnail(dc) for _, dc in frames]
                first = frames[0][0] if frames else None
                rows.append(
                    (
                        first.width if first else None, sum(f.height for f, _ in frames) if first else None, len(frames), b"".join(g.tobytes() for g in greys),
                        ",".join(f"{thumbnail_hash(g):016x}" for g in greys) or None, len(data), hashlib.sha256(data).hexdigest(),
                    )
                )
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], [*passed, *new])

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name in passed]
        + ["width bigint, height bigint, frames bigint, thumbnail binary, thumbnail_hash string, media_bytes bigint, media_sha256 string"]
    )
    return media.select(*[f"`{c}`" for c in passed], "media").mapInArrow(run, schema)

