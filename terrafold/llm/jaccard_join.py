"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes.

1. A pass over all texts counts every shingle in a table of 2^SKETCH_BITS counters of four bits.
   The table only orders tokens (rare first) and splits them into a rare and a frequent class;
   collisions cost time, never results. Its size is fixed, so its broadcast is bounded. It
   orders well while the corpus has no more than about two shingles a counter.
2. Each set is sorted by (counter, hash). With tau = n - ceil(t n) a set can lose at most tau
   tokens to a similar partner. Rare tokens are indexed singly; frequent ones belong to one of
   CLASSES subclasses by hash, and pairs of tokens within a subclass are indexed. The prefix is
   extended until rare + sum(max(0, n_j - 1)) > tau: killing every signature would take more
   than tau mismatches, so two similar sets share one. Sets below SMALL tokens could run out of
   tokens that way and use single tokens throughout; sets that a small one may match use both.
   A counter of 1 proves that no other text has the token: such signatures are left out. A
   second pass counts the signatures that remain in the same way, and those that one text
   alone has are left out too; texts without any left cannot be similar to another.
3. Equal sets are merged first, by a fingerprint. Sets that share a signature are gathered to
   home groups (the least leader of a set's signatures). The sets of a group, and those of two
   groups that meet in a bucket, are verified in blocks of about BLOCK sets by a matrix
   product, which tests every pair of the blocks exactly and returns a spanning forest of the
   links.
4. Components over the links label the classes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import grouped, pieces, stored
from .wordhash import mix, shingles

SKETCH_BITS = 26
MOST = 15
SLOTS = 64
RARE = MOST - 1
CLASSES = 64
SMALL = 96
BLOCK = 256
_SLOT_BITS = SKETCH_BITS - 6
_FLUSH = 1 << 22
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _distinct(column, width):
    """The distinct shingles of each row, sorted."""
    h, counts = shingles(column, width)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        yield np.unique(h[a:b]) if b - a > 1 else h[a:b]


def _sketch_rows(indices: list[np.ndarray]) -> pa.RecordBatch:
    at, n = np.unique(np.concatenate(indices), return_counts=True)
    n = np.minimum(n, MOST).astype(np.uint8)
    slots, cuts = np.arange(SLOTS), np.searchsorted(at, np.arange(SLOTS + 1, dtype=np.uint64) << np.uint64(_SLOT_BITS))
    rows = []
    for s, a, b in zip(slots, cuts, cuts[1:]):
        if a < b:
            inside = (at[a:b] - np.uint32(s << _SLOT_BITS)).astype(np.uint32)
            rows.append((int(s), zlib.compress(np.diff(inside, prepend=np.uint32(0)).tobytes(), 1), zlib.compress(n[a:b].tobytes(), 1)))
    s, g, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(g, pa.binary()), pa.array(c, pa.binary())], ["slot", "gaps", "counts"])


def sketch_of(rows: DataFrame, hashes) -> np.ndarray:
    """Counts up to MOST of the hashes of all rows, two counters a byte. hashes: from the one
    column to arrays of hashes, each distinct in itself."""
    is_text = rows.dtypes[0][1] == "string"

    def count(batches):
        held, size = [], 0
        for batch in pieces(batches) if is_text else batches:
            for d in hashes(batch.column(0)):
                held.append(_place(d).astype(np.uint32))
                size += len(d)
                if size >= _FLUSH:
                    yield _sketch_rows(held)
                    held, size = [], 0
        if size:
            yield _sketch_rows(held)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, g, c in zip(*(x.to_pylist() for x in batch.columns)):
                at = np.cumsum(np.frombuffer(zlib.decompress(g), np.uint32))
                have = sums.setdefault(s, np.zeros(1 << _SLOT_BITS, np.uint8))
                more = np.frombuffer(zlib.decompress(c), np.uint8)
                have[at] = np.minimum(have[at] + more, MOST)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([zlib.compress((x[::2] | x[1::2] << 4).tobytes(), 1) for x in sums.values()], pa.binary())], ["slot", "sums"]
            )

    parts = (
        rows.mapInArrow(count, "slot int, gaps binary, counts binary")
        .repartition(SLOTS, "slot")
        .mapInArrow(merge, "slot int, sums binary")
    )
    out = np.zeros(1 << SKETCH_BITS - 1, np.uint8)
    half = _SLOT_BITS - 1
    for slot, sums in parts.toLocalIterator():  # at most SLOTS rows
        out[slot << half : (slot + 1) << half] = np.frombuffer(zlib.decompress(sums), np.uint8)
    return out


def signatures(tokens: np.ndarray, counts: np.ndarray, t100: int) -> np.ndarray:
    """Signatures of a sorted distinct token set; counts: the counters of its tokens."""
    n = len(tokens)
    tau = n - -(-n * t100 // 100)
    order = np.argsort(counts, kind="stable")
    # most sets have far more rare tokens than they need
    tokens, counts = tokens[order], counts[order]
    rare = int(np.searchsorted(counts, RARE, "right"))
    single = tokens[: tau + 1][counts[: tau + 1] != 1]
    if rare > tau or n < SMALL:
        return single
    rest = tokens[rare:]
    kind = (rest % np.uint64(CLASSES)).astype(np.int64)
    seen = np.zeros(CLASSES, np.int64)
    gain, stop = rare, len(rest)
    for i, j in enumerate(kind.tolist()):
        gain += seen[j] > 0
        seen[j] += 1
        if gain > tau:
            stop = i + 1
            break
    rest, kind = rest[:stop], kind[:stop]
    pairs = []
    for j in np.flatnonzero(seen > 1).tolist():
        mine = np.sort(rest[kind == j])
        a, b = np.triu_indices(len(mine), 1)
        pairs.append(mix(mine[a] * _ONE + mine[b] * _TWO))
    out = [tokens[:rare][counts[:rare] != 1], *pairs]
    if n * t100 <= SMALL * 100:
        out.append(single)
    return np.unique(np.concatenate(out))


def _fingerprint(d: np.ndarray) -> int:
    sums = np.array([np.bitwise_xor.reduce(mix(d)), np.sum(d), len(d)], np.uint64)
    return int(mix(mix(sums * np.array([1, _ONE, _TWO], np.uint64)).sum(keepdims=True)).view(np.int64)[0])


def _place(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SKETCH_BITS)


def _counts(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h)
    return table[at >> np.uint64(1)] >> ((at & np.uint64(1)) << np.uint64(2)).astype(np.uint8) & np.uint8(MOST)


def _bits(counts: np.ndarray, least: int) -> np.ndarray:
    """One bit a counter: whether it is at least so much."""
    return np.concatenate([np.packbits(np.stack([c & MOST >= least, c >> 4 >= least], axis=1).ravel(), bitorder="little") for c in counts.reshape(SLOTS, -1)])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def _text_signatures(width: int, t100: int, sketch):
    def make(column):
        for d in _distinct(column, width):
            yield signatures(d, _counts(sketch.value, d), t100)

    return make


def _sets(docs: DataFrame, width: int, t100: int, sketch, shared) -> DataFrame:
    """(id, n, fp, sigs, toks): sigs and toks are null where no other text can be similar.
    shared: bit p is 0 where at most one text has a signature of place p."""

    def make(batches):
        table, bits = sketch.value, shared.value
        for batch in pieces(batches, 1):
            n, fp, sigs, toks = [], [], [], []
            for d in _distinct(batch.column(1), width):
                n.append(len(d))
                if not len(d):
                    fp.append(None), sigs.append(None), toks.append(None)
                    continue
                fp.append(_fingerprint(d))
                s = signatures(d, _counts(table, d), t100)
                s = s[_has(bits, s)]
                sigs.append(s.view(np.int64) if len(s) else None)
                toks.append(d.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(toks, pa.binary())],
                ["id", "n", "fp", "sigs", "toks"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(make, f"id {kind}, n bigint, fp bigint, sigs array<bigint>, toks binary")


def _verify(t100: int):
    """Links of one pair of blocks, as a spanning forest. All pairs across the two sides (within
    the one, for a block against itself) are tested exactly, in blocks of columns."""

    def links(group: pa.Table):
        side = group.column("side").to_numpy()
        fp = group.column("fp").to_numpy()
        n = group.column("n").to_numpy().astype(np.int64)
        m = len(fp)
        if m < 2:
            return []
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("toks").combine_chunks()]
        row = np.repeat(np.arange(m), [len(x) for x in tokens])
        values, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        shared = counts > 1
        column = np.cumsum(shared) - 1
        keep = shared[inverse]
        row, col = row[keep], column[inverse[keep]]
        width = int(shared.sum())
        one = side.min() == side.max()
        left = np.arange(m) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        inter = np.zeros((len(left), len(right)), np.float64)
        where = np.empty(m, np.int64)
        where[right] = np.arange(len(right))
        by_col = np.argsort(col, kind="stable")
        row, col = row[by_col], col[by_col]
        for a in range(0, width, 4096):
            i, j = np.searchsorted(col, [a, a + 4096])
            dense = np.zeros((m, min(4096, width - a)), np.float32)
            dense[row[i:j], col[i:j] - a] = 1
            inter += dense[left] @ dense[right].T
        union = n[left][:, None] + n[right][None, :] - inter
        hit = 100 * inter >= t100 * union
        if one:
            hit = np.triu(hit, 1)
        root = list(range(m))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for a, b in zip(*(x.tolist() for x in np.nonzero(hit))):
            ra, rb = find(left[a]), find(right[b])
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((int(fp[left[a]]), int(fp[right[b]])))
        return out

    def run(batches):
        a, b = [], []
        for group in grouped(batches, ["ga", "gb", "ba", "bb"]):
            for x, y in links(group):
                a.append(x), b.append(y)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def similar_classes(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs(id, text).

    Rows link when 100 * intersection >= similarity * union of their distinct word shingles;
    component_id is the smallest id in the row's connected component.

    Null or wordless text: no shingles, component_id is the row's own id. Fewer words than width:
    the whole sequence is the one shingle. Repeated rows and ties are classed alike and each
    keeps its row. A null id never names a class unless its class has no other. An empty table
    gives an empty table; columns other than id and text are not read.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select("text")
    sketch = context.broadcast(sketch_of(texts, lambda column: _distinct(column, width)))
    shared = context.broadcast(_bits(sketch_of(texts, _text_signatures(width, similarity, sketch)), 2))
    sets = stored(_sets(docs, width, similarity, sketch, shared), "sets")
    sketch.unpersist()
    shared.unpersist()
    nodes = sets.where("fp is not null").groupBy("fp").agg(F.min("id").alias("first"))

    # equal sets have equal signatures, so one row a set is exploded
    one = sets.where("sigs is not null").groupBy("fp").agg(F.first("sigs").alias("sigs"), F.first("n").alias("n"), F.min("id").alias("id"))
    postings = one.select("fp", "id", "n", F.explode("sigs").alias("sig"))
    # leaders are aggregated and joined back: a signature that very many sets have is then a
    # large join partition, which can be split, and no window's group
    leaders = postings.groupBy("sig").agg(F.min("fp").alias("leader"), F.count("*").alias("mates")).where("mates > 1")
    postings = stored(postings.join(leaders.drop("mates"), "sig"), "postings")
    homes = postings.groupBy("fp", "id", "n").agg(F.min("leader").alias("home"))
    sizes = postings.groupBy("fp").agg(F.min("leader").alias("home")).groupBy("home").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    homes = homes.join(sizes, "home").withColumn("blk", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    homes = stored(homes.withColumn("nb", blocks), "homes")

    # which sets to verify against each other: narrow rows only. Within a group all its sets;
    # across two groups those that meet the other one in a bucket, at a length that can match
    met = postings.select("sig", "fp").join(homes.select("fp", "n", "home", "blk", "nb"), "fp")
    seen = met.groupBy("sig", F.col("home").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("nb").alias("other_nb"))
    across = met.join(seen, "sig").where(f"home <> other and n * 100 >= low * {similarity} and high * 100 >= n * {similarity}")
    across = across.groupBy("fp", "home", "other").agg(F.max("blk").alias("blk"), F.max("other_nb").alias("nb"))
    within = homes.where("members > 1").select("fp", "home", F.col("home").alias("other"), "blk", "nb")
    # a set stands in its own block, against every block of the other side
    rows = across.unionByName(within).withColumn("other_blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    first = F.struct("home", "blk") <= F.struct("other", "other_blk")
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    tasks = rows.select(
        "fp", side("home", "other").alias("ga"), side("other", "home").alias("gb"), side("blk", "other_blk").alias("ba"), side("other_blk", "blk").alias("bb"),
        F.when(first, 0).otherwise(1).alias("side"),
    )
    tasks = stored(tasks, "tasks")

    # token sets move to their tasks. A bitmap of fixed size names the one row of each set that
    # has a mate, so that no other row's tokens are shuffled; what it lets by in error, the
    # join and the aggregate drop. The join is a merge join at every size of input.
    bits = context.broadcast(_bits(sketch_of(homes.select(F.xxhash64("fp", "id").alias("h")), lambda column: [np.unique(column.to_numpy().view(np.uint64))]), 1))

    def wanted(batches):
        for batch in batches:
            keep = _has(bits.value, batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(keep)).drop_columns(["h"])

    toks = sets.where("toks is not null").select(F.xxhash64("fp", "id").alias("h"), "fp", "n", "toks").mapInArrow(wanted, "fp bigint, n bigint, toks binary")
    toks = toks.groupBy("fp").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
    both = tasks.join(toks.hint("merge"), "fp").select("ga", "gb", "ba", "bb", "side", "fp", "n", "toks")
    both = both.repartition("ga", "gb", "ba", "bb").sortWithinPartitions("ga", "gb", "ba", "bb")
    links = stored(both.mapInArrow(_verify(similarity), "a bigint, b bigint"), "links")

    labels = connected_components(links)
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("fp", "component_id")
    return sets.select("id", "n", "fp").join(named, "fp", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
