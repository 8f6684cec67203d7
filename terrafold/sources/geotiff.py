"""GeoTIFF files as a Spark data source, and a writer, without a raster library.

    spark.dataSource.register(GeoTiffSource)
    spark.read.format("geotiff").option("bands", "1,4").load("/data/scenes/*.tif")

A partition is one file and band group; a row is one block of one band. Reads classic TIFF in
either byte order, striped or tiled, uncompressed, LZW or deflate, with the horizontal predictor.
Samples equal to the file's nodata value, and NaN, are null to the engine: NaN in the float32
data, which pixels() turns to null.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, date string, band int, row0 int, col0 int, h int, w int, epsg int, transform array<double>, data binary"
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
_DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


def lzw_decode(data: bytes) -> bytes:
    out, table, width, at, bits, have, before = bytearray(), [], 9, 0, 0, 0, b""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    while True:
        while have < width and at < len(data):
            bits = (bits << 8) | data[at]
            at, have = at + 1, have + 8
        if have < width:
            return bytes(out)
        have -= width
        code = (bits >> have) & ((1 << width) - 1)
        bits &= (1 << have) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, before = list(fresh), 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
            if len(table) in (511, 1023, 2047):
                width += 1
        before = entry


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, n, w = 9, 0, b""

    def put(code):
        nonlocal bits, have
        bits = (bits << width) | code
        have += width
        while have >= 8:
            have -= 8
            out.append((bits >> have) & 255)
        bits &= (1 << have) - 1

    def reset():
        nonlocal table, width, n
        table, n = {bytes([i]): i for i in range(256)}, 258
        put(256)
        width = 9

    width = 9
    reset()
    for b in data:
        c = w + bytes([b])
        if c in table:
            w = c
            continue
        put(table[w])
        table[c] = n
        n += 1
        if n in (512, 1024, 2048):
            width += 1
        w = bytes([b])
        if n == 4094:
            put(table[w])
            w = b""
            reset()
    if w:
        put(table[w])
    put(257)
    if have:
        out.append((bits << (8 - have)) & 255)
    return bytes(out)


class GeoTiff:
    """Header and blocks of one file."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.order = {b"II": "<", b"MM": ">"}[raw[:2]]
        magic, at = struct.unpack_from(self.order + "HI", raw, 2)
        if magic != 42:
            raise ValueError("not a classic TIFF")
        self.tags: dict[int, tuple] = {}
        (n,) = struct.unpack_from(self.order + "H", raw, at)
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(self.order + "HHII", raw, at + 2 + 12 * i)
            fmt, size = _TYPES.get(kind, ("B", 1))
            where = at + 10 + 12 * i
            if size * count > 4:
                (where,) = struct.unpack_from(self.order + "I", raw, where)
            self.tags[tag] = (raw[where : where + count],) if kind == 2 else struct.unpack_from(self.order + (fmt * count if kind != 5 else "II" * count), raw, where)
        g = lambda tag, default=None: self.tags.get(tag, default)
        self.width, self.height = g(256)[0], g(257)[0]
        self.count = g(277, (1,))[0]
        self.dtype = np.dtype(self.order + _DTYPES[g(339, (1,))[0], g(258, (8,))[0]])
        self.compression, self.predictor, self.planar = g(259, (1,))[0], g(317, (1,))[0], g(284, (1,))[0]
        self.tiled = 322 in self.tags
        self.bw, self.bh = (g(322)[0], g(323)[0]) if self.tiled else (self.width, min(g(278, (self.height,))[0], self.height))
        self.offsets, self.sizes = (g(324), g(325)) if self.tiled else (g(273), g(279))
        text = g(42113, (b"",))[0].rstrip(b"\0 ")
        self.nodata = float(text) if text else None
        if 34264 in self.tags:
            m = g(34264)
            self.transform = [m[0], m[1], m[3], m[4], m[5], m[7]]
        else:
            sx, sy = g(33550, (1.0, 1.0))[:2]
            i, j, _, x, y, _ = g(33922, (0.0,) * 6)[:6]
            self.transform = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
        keys = g(34735, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        self.epsg = found.get(3072) or found.get(2048) or 0

    def block(self, index: int, samples: int) -> np.ndarray:
        data = self.raw[self.offsets[index] : self.offsets[index] + self.sizes[index]]
        data = {1: lambda d: d, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress}[self.compression](data)
        rows = len(data) // (self.bw * samples * self.dtype.itemsize)
        out = np.frombuffer(data, self.dtype, rows * self.bw * samples).reshape(rows, self.bw, samples)
        if self.predictor == 2:
            out = np.cumsum(out, axis=1, dtype=self.dtype)
        elif self.predictor != 1:
            raise ValueError("predictor not supported")
        return out

    def blocks(self, bands: list[int]):
        """(band, row0, col0, float32 array) of each block; nodata is NaN."""
        across, down = -(-self.width // self.bw), -(-self.height // self.bh)
        for r in range(down):
            for c in range(across):
                at = r * across + c
                whole = None if self.planar == 2 else self.block(at, self.count)
                for b in bands:
                    x = self.block((b - 1) * across * down + at, 1)[:, :, 0] if whole is None else whole[:, :, b - 1]
                    x = x[: self.height - r * self.bh, : self.width - c * self.bw].astype(np.float32)
                    if self.nodata is not None:
                        x = np.where(x == np.float32(self.nodata), np.float32(np.nan), x)
                    yield b, r * self.bh, c * self.bw, x


def read_array(path: str, bands: list[int] | None = None) -> tuple[np.ndarray, GeoTiff]:
    """A whole file as float32 [bands, height, width], and its header."""
    with open(path, "rb") as f:
        t = GeoTiff(f.read())
    bands = bands or list(range(1, t.count + 1))
    out = np.zeros((len(bands), t.height, t.width), np.float32)
    for b, r, c, x in t.blocks(bands):
        out[bands.index(b), r : r + x.shape[0], c : c + x.shape[1]] = x
    return out, t


def write_array(path: str, data: np.ndarray, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 0.0), epsg: int = 0, nodata: float | None = None, compress: str = "lzw", tile: int = 256) -> None:
    """Bands of one type as a tiled file; a 2-d array is one band."""
    data = data[None] if data.ndim == 2 else data
    n, h, w = data.shape
    code = next(k for k, v in _DTYPES.items() if np.dtype(v) == data.dtype.newbyteorder("="))
    pack = {"none": (1, bytes), "lzw": (5, lzw_encode), "deflate": (8, zlib.compress)}[compress]
    blocks = []
    for b in range(n):
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                x = np.zeros((tile, tile), data.dtype.newbyteorder("<"))
                part = data[b, r : r + tile, c : c + tile]
                x[: part.shape[0], : part.shape[1]] = part
                blocks.append(pack[1](x.tobytes()))
    a, b, c, d, e, f = transform
    entries: list[tuple[int, int, tuple]] = [
        (256, 4, (w,)), (257, 4, (h,)), (258, 3, (code[1],) * n), (259, 3, (pack[0],)), (262, 3, (1,)), (277, 3, (n,)), (284, 3, (2,)),
        (322, 4, (tile,)), (323, 4, (tile,)), (324, 4, (0,) * len(blocks)), (325, 4, tuple(map(len, blocks))), (339, 3, (code[0],) * n),
        (34264, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if epsg:
        geographic = 4000 <= epsg < 5000
        entries.append((34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg)))
    if nodata is not None:
        entries.append((42113, 2, (f"{nodata!r}\0".encode(),)))
    entries.sort()
    size = lambda k, v: len(v[0]) if k == 2 else _TYPES[k][1] * len(v)
    extra = 8 + 2 + 12 * len(entries) + 4
    data_at = extra + sum(size(k, v) + size(k, v) % 2 for _, k, v in entries if size(k, v) > 4)
    starts = np.cumsum([data_at] + [len(x) for x in blocks])[:-1]
    head, tail = [struct.pack("<2sHIH", b"II", 42, 8, len(entries))], []
    for tag, kind, v in entries:
        v = tuple(int(s) for s in starts) if tag == 324 else v
        raw = v[0] if kind == 2 else struct.pack("<" + _TYPES[kind][0] * len(v), *v)
        count = len(v[0]) if kind == 2 else len(v)
        if len(raw) > 4:
            head.append(struct.pack("<HHII", tag, kind, count, extra))
            raw += b"\0" * (len(raw) % 2)
            tail.append(raw)
            extra += len(raw)
        else:
            head.append(struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0"))
    with open(path, "wb") as out:
        out.write(b"".join([*head, struct.pack("<I", 0), *tail, *blocks]))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for q in options.get("path", "").split(",") for p in glob.glob(q.removeprefix("file:")))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None
        if not self.paths:
            raise FileNotFoundError(options.get("path", ""))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        from .files import date_in_name

        with open(partition.path, "rb") as f:
            t = GeoTiff(f.read())
        for b, r, c, x in t.blocks(self.bands or list(range(1, t.count + 1))):
            yield partition.path, date_in_name(os.path.basename(partition.path)), b, r, c, x.shape[0], x.shape[1], int(t.epsg), [float(v) for v in t.transform], x.astype("<f4").tobytes()


class GeoTiffSource(DataSource):
    """Blocks of GeoTIFF files that every worker can open by path."""

    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def decode_blocks(files: DataFrame, bands: list[int] | None = None) -> DataFrame:
    """Blocks from a binaryFile table(path, content), for stores that only Spark reads."""
    import pandas as pd

    def run(frames):
        from .files import date_in_name

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                t = GeoTiff(content)
                rows = [
                    (path, date_in_name(os.path.basename(path)), b, r, c, x.shape[0], x.shape[1], int(t.epsg), [float(v) for v in t.transform], x.astype("<f4").tobytes())
                    for b, r, c, x in t.blocks(bands or list(range(1, t.count + 1)))
                ]
                yield pd.DataFrame(rows, columns=["path", "date", "band", "row0", "col0", "h", "w", "epsg", "transform", "data"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def pixels(blocks: DataFrame) -> DataFrame:
    """(path, date, band, row, col, v) with missing samples as null."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for b in frame.itertuples():
                v = np.frombuffer(b.data, "<f4")
                at = np.arange(len(v))
                yield pd.DataFrame({"path": b.path, "date": b.date, "band": b.band, "row": b.row0 + at // b.w, "col": b.col0 + at % b.w, "v": v.astype(float)})

    out = blocks.mapInPandas(run, "path string, date string, band int, row int, col int, v double")
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def clip_blocks(blocks: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Blocks that touch a map rectangle: the coarse step of clipping to a boundary."""
    t = lambda i: F.col("transform")[i]
    x0, y0 = t(2) + F.col("col0") * t(0), t(5) + F.col("row0") * t(4)
    x1, y1 = x0 + F.col("w") * t(0), y0 + F.col("h") * t(4)
    return blocks.where((F.greatest(x0, x1) >= min_x) & (F.least(x0, x1) <= max_x) & (F.greatest(y0, y1) >= min_y) & (F.least(y0, y1) <= max_y))
