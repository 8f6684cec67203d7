"""Stupid-backoff scores from n-gram count tables partitioned by hash.

    S(w | u) = c(u w) / c(u)               if c(u w) reaches its order's cutoff
             = ALPHA * S(w | u less its first word)   otherwise;   S(w) = c(w) / N

Texts are gathered to chunks of about CHUNK bytes; a chunk's distinct words are its dictionary.
The distinct n-grams of a chunk, with their counts there, go to the count table's partition for
their hash, as packed sorted blocks. A partition adds its blocks up, which gives its part of
the count tables, and joins the sums back to each block. A chunk then looks its n-grams up and
adds the scores of each text. All texts count; the tables grow with the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import grouped, pieces, shared_dir
from .wordhash import _PLACE, mix, words

CHUNK = 1 << 22
ALPHA = 0.4


def _pack(h: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences of a fixed number of bytes. The few differences of a
    block that are wider have their place and value listed before them."""
    gaps = np.diff(h, prepend=np.uint64(0))
    width, wide = 8, np.zeros(0, np.uint32)
    for w in range(1, 8):
        over = np.flatnonzero(gaps >> np.uint64(8 * w)).astype(np.uint32)
        if 12 * len(over) < len(gaps):
            width, wide = w, over
            break
    low = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + len(wide).to_bytes(4, "little") + wide.tobytes() + gaps[wide].tobytes() + low.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    wide = np.frombuffer(data, np.uint32, n, 5)
    values = np.frombuffer(data[5 + 4 * n : 5 + 12 * n], np.uint64)
    low = np.frombuffer(data, np.uint8, -1, 5 + 12 * n).reshape(-1, width)
    gaps = np.zeros((len(low), 8), np.uint8)
    gaps[:, :width] = low
    gaps = gaps.view(np.uint64).ravel()
    gaps[wide] = values
    return np.cumsum(gaps, dtype=np.uint64)


def _pack_codes(codes: np.ndarray) -> bytes:
    """Word numbers by byte planes; frequent words have small numbers, so the planes compress."""
    return zlib.compress(np.ascontiguousarray(codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack_codes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _ngrams(dictionary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n-gram that ends at each word, and whether it lies within one text."""
    w = dictionary[codes]
    h = np.zeros(len(w), np.uint64)
    for j in range(n):  # the last word has place 0
        h[j:] += w[: len(w) - j] * _PLACE[j]
    place = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return mix(h + np.uint64(n)), place >= n - 1


def _chunks(docs: DataFrame) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def gather(batches):
        ids, hashes, sizes, size, k = [], [], [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def out():
            h = np.concatenate(hashes)
            dictionary, codes, uses = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.argsort(-uses, kind="stable")
            place = np.empty(len(rank), np.uint32)
            place[rank] = np.arange(len(rank))
            dictionary, codes = dictionary[rank], place[codes]
            id_list = pa.concat_arrays(ids)
            column = pa.ListArray.from_arrays(pa.array([0, len(id_list)], pa.int32()), id_list)
            n = np.concatenate(sizes).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + k]), column, pa.array([n.tobytes()]), pa.array([len(h)], pa.int64()), pa.array([dictionary.tobytes()]), pa.array([_pack_codes(codes)])],
                ["chunk", "ids", "sizes", "total", "dictionary", "codes"],
            )

        for batch in pieces(batches, 1, CHUNK):
            h, n = words(batch.column(1))
            ids.append(batch.column(0))
            hashes.append(h)
            sizes.append(n)
            size += len(h) * 6 + len(n)
            if size >= CHUNK:
                yield out()
                ids, hashes, sizes, size, k = [], [], [], 0, k + 1
        if ids:
            yield out()

    spark = docs.sparkSession
    made = docs.select("id", "text").mapInArrow(gather, f"chunk bigint, ids array<{kind}>, sizes binary, total bigint, dictionary binary, codes binary")
    import uuid

    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["dictionary"], np.uint64), _unpack_codes(row["codes"]), np.frombuffer(row["sizes"], np.int32)


def score_texts(docs: DataFrame, order: int = 2, cutoffs: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(id, n_tokens, n_found, score) for each row of docs(id, text).

    Words are runs without white space, A-Z as a-z. Counts are over all rows of docs, repeated
    rows included; an n-gram of order k is in the table if it occurs cutoffs[k - 1] times.
    score is the sum of the natural logarithms of S over the words, each with the words before
    it in the text as far as order goes; n_found is how many words were scored without backing
    off from the longest context they have. Null, empty and wordless texts: 0, 0 and 0.0. A null id stays. An empty table gives
    an empty table; other columns are not read.
    """
    if len(cutoffs) != order or cutoffs[0] != 1:
        raise ValueError("cutoffs must have one number an order, 1 for single words")
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    chunks = _chunks(docs)
    found = chunks.agg(F.count("*"), F.sum("total")).head()
    bits = max(4, int(found[0]).bit_length() - 1)
    n_all = max(1, found[1] or 0)
    parts = 1 << bits

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dictionary, codes, sizes = _read(row)
                for n in range(1, order + 1):
                    if n == 1:
                        by_hash = np.argsort(dictionary)
                        at, counts = dictionary[by_hash], np.bincount(codes, minlength=len(dictionary))[by_hash]
                    else:
                        h, inside = _ngrams(dictionary, codes, sizes, n)
                        at, counts = np.unique(h[inside], return_counts=True)
                    cuts = np.append(np.searchsorted(at, np.arange(parts, dtype=np.uint64) << np.uint64(64 - bits)), len(at))
                    rows = [(p + (n - 1) * parts, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([r[0] for r in rows], pa.int32()), pa.array([row["chunk"]] * len(rows), pa.int64()),
                                pa.array([_pack(at[a:b]) for _, a, b in rows], pa.binary()), pa.array([zlib.compress(counts[a:b].astype(np.uint32).tobytes(), 1) for _, a, b in rows], pa.binary()),
                            ],
                            ["part", "chunk", "grams", "counts"],
                        )

    def count(batches):
        for group in grouped(batches, ["part"]):
            grams = [_unpack(x.as_py()) for x in group.column("grams")]
            counts = [np.frombuffer(zlib.decompress(x.as_py()), np.uint32) for x in group.column("counts")]
            table, inverse = np.unique(np.concatenate(grams), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(counts), len(table)).astype(np.uint64)[inverse]
            ends = np.cumsum([len(g) for g in grams])
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("chunk").combine_chunks(), group.column("part").combine_chunks(),
                    pa.array([zlib.compress(sums[e - len(g) : e].tobytes(), 1) for g, e in zip(grams, ends)], pa.binary()),
                ],
                ["chunk", "part", "counts"],
            )

    asked = chunks.select("chunk", "sizes", "dictionary", "codes").mapInArrow(ask, "part int, chunk bigint, grams binary, counts binary")
    told = asked.repartition("part").sortWithinPartitions("part").mapInArrow(count, "chunk bigint, part int, counts binary")

    def add(batches):
        for group in grouped(batches, ["chunk"]):
            rows = group.to_pylist()
            if rows[0]["part"] != -1:
                raise ValueError("counts without their chunk")
            dictionary, codes, sizes = _read(rows[0])
            counts = [np.frombuffer(b"".join(zlib.decompress(r["counts"]) for r in rows[1:] if r["part"] // parts == n), np.uint64) for n in range(order)]
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            single = np.empty(len(dictionary), np.int64)
            single[np.argsort(dictionary)] = counts[0]
            c = [single[codes]]
            for n in range(2, order + 1):
                h, inside = _ngrams(dictionary, codes, sizes, n)
                _, inverse = np.unique(h[inside], return_inverse=True)
                full = np.zeros(len(codes), np.int64)
                full[inside] = counts[n - 1][inverse]
                c.append(full)
            score = np.log(c[0] / n_all) if len(codes) else np.zeros(0)
            hit = place == 0
            for n in range(2, order + 1):
                before = np.concatenate([[1], c[n - 2][:-1]]) if len(codes) else np.zeros(0, np.int64)
                known = (place >= n - 1) & (c[n - 1] >= cutoffs[n - 1])
                backed = np.where(place >= n - 1, score + np.log(ALPHA), score)
                score = np.where(known, np.log(np.maximum(c[n - 1], 1) / np.maximum(before, 1)), backed)
                hit = np.where(place >= n - 1, known, hit)
            ends = np.cumsum(sizes)
            total = np.concatenate([[0.0], np.cumsum(score)])
            hits = np.concatenate([[0], np.cumsum(hit)])
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("ids").combine_chunks()[:1].flatten(), pa.array(sizes.astype(np.int64)),
                    pa.array((hits[ends] - hits[ends - sizes]).astype(np.int64)), pa.array([float(score[e - s : e].sum()) for s, e in zip(sizes.tolist(), ends.tolist())], pa.float64()),
                ],
                ["id", "n_tokens", "n_found", "score"],
            )

    none = lambda t: F.lit(None).cast(t)
    left = chunks.select("chunk", F.lit(-1).alias("part"), none("binary").alias("counts"), "ids", "sizes", "dictionary", "codes")
    right = told.select("chunk", "part", "counts", none(f"array<{kind}>").alias("ids"), none("binary").alias("sizes"), none("binary").alias("dictionary"), none("binary").alias("codes"))
    both = left.union(right).repartition("chunk").sortWithinPartitions("chunk", "part")
    return both.mapInArrow(add, f"id {kind}, n_tokens bigint, n_found bigint, score double")
