"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is split in halves again and again (two means, cut at the median), which gives
centroids of equally full cells. Every vector goes to the list of its nearest centroid. Where it
is nearer to the plane between that cell and others than all but BOUNDARY of the sample are, it
also goes to their lists. Nearest centroids are found by beam search in a neighbour graph over the
centroids, which is small and goes to every worker.

A query reads the lists whose centroids are at most `ratio` times as far as its nearest one, however
many these are. The ratio is no constant, as distances spread little in many dimensions: it is the
least that reaches RECALL of the true neighbours of TRIALS vectors, which are found exactly, by
one pass over all vectors. Lists longer than BLOCK are cut into blocks, so no list is one task's
burden. Vectors of each length have an index of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import grouped, stored

#: Vectors that place the centroids, as many as SAMPLE_BYTES hold at most; so there are SAMPLE / 8
#: lists at most, and beyond LIST times as many vectors lists grow with the table, block by block.
SAMPLE, SAMPLE_BYTES = 65_536, 1 << 26
LIST = 256
REPLICAS = 4
BOUNDARY = 0.2
RECALL = 0.95
TRIALS = 256
BLOCK = 2048
HELD = 1 << 20
DEGREE = 24


def balanced_centroids(points: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Centroids of cells of nearly equal size: recursive two-means with median cuts."""
    rng = np.random.default_rng(seed)
    done, todo = [], [(np.arange(len(points)), cells)]
    while todo:
        index, k = todo.pop()
        if k <= 1 or len(index) <= 1:
            done.append(points[index].mean(axis=0))
            continue
        x = points[index]
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            side = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
            near = side <= np.median(side)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        order = np.argsort(side, kind="stable")
        left = k // 2
        cut = max(1, min(len(x) - 1, round(len(x) * left / k)))
        todo += [(index[order[:cut]], left), (index[order[cut:]], k - left)]
    return np.array(done)


class CentroidGraph:
    """Centroids with a neighbour graph, searched by best-first beams for many points at once."""

    def __init__(self, centroids: np.ndarray, seed: int = 6):
        #: How near to a plane a vector gets a replica, and how far a query's lists may be. An index
        #: fits both to its vectors; until then there are no replicas and half as far again is read.
        self.margin, self.ratio = 0.0, 1.5
        self.c = np.ascontiguousarray(centroids, np.float64)
        self.norm = (self.c**2).sum(1)
        k = len(self.c)
        degree = min(DEGREE, k - 1)
        rng = np.random.default_rng(seed)
        links = []
        for a in range(0, k, 512):
            d = self.norm[a : a + 512, None] + self.norm[None] - 2 * self.c[a : a + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links.append(np.argsort(d, axis=1)[:, :degree])
        near = np.concatenate(links) if k > 1 else np.zeros((1, 0), int)
        far = rng.integers(0, k, (k, 4))  # long edges keep the graph connected
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))

    def search(self, x: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the beam nearest centroids of each row, nearest first."""
        n, k = len(x), len(self.c)
        beam = min(beam, k)
        norm = (x**2).sum(1)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)

        def distance(ids):
            return np.maximum(self.norm[ids] + norm[:, None] - 2 * np.einsum("nd,nmd->nm", x, self.c[ids]), 0)

        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[rows, ids] = True
        d = distance(ids)
        open_ = np.ones(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, open_ = (np.take_along_axis(v, order, 1) for v in (ids, d, open_))
            waiting = np.where(open_, d, np.inf)
            if not np.isfinite(waiting).any():
                return ids, np.sqrt(d)
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :at_once]
            live = np.isfinite(np.take_along_axis(waiting, pick, 1))
            np.put_along_axis(open_, pick, np.take_along_axis(open_, pick, 1) & ~live, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)]
            new = np.where(live[:, :, None], new, -1).reshape(n, -1)
            new = np.sort(new, axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[rows, np.maximum(new, 0)]
            width = int(fresh.sum(1).max())
            if width == 0:
                continue
            first = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            fresh = np.take_along_axis(fresh, first, 1)
            new = np.where(fresh, np.take_along_axis(new, first, 1), 0)
            at = np.nonzero(fresh)
            seen[at[0], new[at]] = True
            d = np.concatenate([d, np.where(fresh, distance(new), np.inf)], 1)
            ids = np.concatenate([ids, new], 1)
            open_ = np.concatenate([open_, fresh], 1)

    def edges(self, x: np.ndarray, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances to the planes between the nearest cell and these); the first is it."""
        ids, d = self.search(x, beam)
        gap = np.sqrt(((self.c[ids] - self.c[ids[:, :1]]) ** 2).sum(2))
        apart = (d**2 - d[:, :1] ** 2) / np.maximum(2 * gap, 1e-300)
        apart[:, 0] = -1.0
        return ids, np.where(gap > 0, apart, np.where(np.arange(ids.shape[1]) == 0, -1.0, np.inf))

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector and each of its lists: that of the nearest centroid, and of
        the nearest planes within the margin, REPLICAS in all."""
        ids, apart = self.edges(x)
        order = np.argsort(apart, axis=1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(apart, order, 1) <= self.margin
        near[:, 0] = True
        rows, cols = np.nonzero(near)
        return rows, np.take_along_axis(ids, order, 1)[rows, cols]

    def reads(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query reads: all that the ratio admits. Beams widen
        until they reach beyond it; what most centroids are within is compared with all."""
        at, lists, todo, beam = [], [], np.arange(len(x)), 64
        while len(todo):
            if 4 * beam >= len(self.c):
                d = np.sqrt(np.maximum(self.norm[None] + (x[todo] ** 2).sum(1)[:, None] - 2 * x[todo] @ self.c.T, 0))
                ids, done = np.broadcast_to(np.arange(len(self.c)), d.shape), np.ones(len(todo), bool)
                least = d.min(axis=1)
            else:
                ids, d = self.search(x[todo], beam, max(4, beam // 16))
                least, done = d[:, 0], d[:, -1] > self.ratio * d[:, 0]
            rows, cols = np.nonzero((d <= self.ratio * least[:, None]) & done[:, None])
            at.append(todo[rows])
            lists.append(ids[rows, cols])
            todo, beam = todo[~done], 4 * beam
        return (np.concatenate(at), np.concatenate(lists)) if at else (np.zeros(0, int), np.zeros(0, int))

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector."""
        return _by_row(*self.places(x), len(x))

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads."""
        return _by_row(*self.reads(x), len(x))


def _by_row(rows: np.ndarray, lists: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(rows, kind="stable")
    return np.split(lists[order], np.searchsorted(rows[order], np.arange(1, n)))


def best_of(found: pa.Table, most: int) -> pa.Table:
    """The most rows of least (score, lead) of each key of found(key, lead, ids, score); a pair of
    key and lead counts once."""

    def starts(*names):
        new = np.ones(found.num_rows, bool)
        same = np.ones(max(found.num_rows - 1, 0), bool)
        for name in names:
            c = found[name].combine_chunks()
            same &= pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = ~same
        return new

    found = found.sort_by([("key", "ascending"), ("lead", "ascending")])
    found = found.filter(pa.array(starts("key", "lead")))
    found = found.sort_by([("key", "ascending"), ("score", "ascending"), ("lead", "ascending")])
    at = np.arange(found.num_rows)
    return found.filter(pa.array(at - np.maximum.accumulate(np.where(starts("key"), at, 0)) < most))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


_USABLE = (
    "id is not null and v is not null and size(v) > 0 and exists(v, x -> x <> 0) and "
    "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
)


def _trial_neighbours(entries: DataFrame, trials: np.ndarray, k: int) -> list[np.ndarray]:
    """The k vectors of entries(v) nearest to each trial vector, the trial itself left out, exactly:
    each task keeps its best, and of these the best are collected (tasks merge in one reducer, which
    holds no more than tasks * trials * k rows in batches)."""

    def best(d, v, most):
        take = np.argsort(d, kind="stable")[:most]
        return d[take], v[take]

    def scan(batches):
        held = [(np.zeros(0), np.zeros((0, trials.shape[1])))] * len(trials)
        norm = (trials**2).sum(1)
        for batch in batches:
            x = _matrix(batch.column(0))
            d = np.maximum(norm[:, None] + (x**2).sum(1)[None] - 2 * trials @ x.T, 0)
            near = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, : k + 1] if d.shape[1] else np.zeros((len(trials), 0), int)
            for i, at in enumerate(near):
                at = at[d[i, at] > 1e-12 * norm[i]]
                held[i] = best(np.concatenate([held[i][0], d[i, at]]), np.concatenate([held[i][1], x[at]]), k)
        rows = [(i, float(s), v.tolist()) for i, (d, x) in enumerate(held) for s, v in zip(d, x)]
        if rows:
            t, s, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(s, pa.float64()), pa.array(v, pa.list_(pa.float64()))], ["trial", "score", "v"])

    found = entries.select("v").mapInArrow(scan, "trial int, score double, v array<double>")
    first = F.row_number().over(Window.partitionBy("trial").orderBy("score", "v"))
    rows = found.withColumn("r", first).where(f"r <= {k}").select("trial", "v").collect()  # TRIALS * k rows at most
    out: list[list] = [[] for _ in trials]
    for r in rows:
        out[r["trial"]].append(r["v"])
    return [np.array(v, float).reshape(len(v), trials.shape[1]) for v in out]


def fit_ratio(graph: CentroidGraph, trials: np.ndarray, near: list[np.ndarray], recall: float = RECALL) -> float:
    """The least ratio whose lists hold `recall` of the trials' neighbours."""
    need = []
    for t, v in zip(trials, near):
        if not len(v):
            continue
        d = np.sqrt(np.maximum(graph.norm + (t**2).sum() - 2 * graph.c @ t, 0))
        rows, lists = graph.places(v)
        least = np.full(len(v), np.inf)
        np.minimum.at(least, rows, d[lists] / max(d.min(), 1e-300))
        need += least.tolist()
    return float(np.quantile(need, recall)) * (1 + 1e-9) if need else np.inf


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows of vectors(id, v) to each row of
    queries(id, v) that the search finds, by Euclidean distance, ties to the smaller id.

    A query's own id is not returned to it. Null, empty and zero vectors, vectors with null or
    non-finite parts, and null ids take no part on either side; vectors of one length are searched
    among themselves. Repeated rows count once; equal vectors share one entry of the index, with
    their k + 1 smallest ids, which are all that a result can hold. An empty side gives no rows;
    other columns are not read.
    """
    vectors = vectors.select("id", "v").where(_USABLE)
    queries = queries.select("id", "v").where(_USABLE)
    id_kind = vectors.schema["id"].dataType.simpleString()
    out = None
    # an index for each length that is asked for: of these a table of embeddings has one or a few
    for r in queries.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():
        same = f"size(v) = {r['dim']}"
        part = _search(vectors.where(same), queries.where(same), k, r["dim"])
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], f"query_id {id_kind}, rank int, id {id_kind}, score double") if out is None else out


def build_graph(entries: DataFrame, dim: int, k: int) -> CentroidGraph:
    """Centroids of entries(v) of one length, with the margin and the ratio that fit them."""
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(max(1024, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("v").toArrow()  # bounded
    x = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((1, dim))
    cells = max(1, min(-(-entries.count() // LIST), len(x) // 8))
    graph = CentroidGraph(balanced_centroids(x, cells))
    if cells > 1:
        _, apart = graph.edges(x[:4096])
        graph.margin = float(np.quantile(apart[:, 1:].min(axis=1), BOUNDARY))
        trials = x[:: max(1, len(x) // TRIALS)][:TRIALS]
        graph.ratio = fit_ratio(graph, trials, _trial_neighbours(entries, trials, k))
    return graph


def _search(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.simpleString()
    id_kind = vectors.schema["id"].dataType.simpleString()
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = vectors.distinct().withColumn("r", first).where(f"r <= {k + 1}").groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = stored(entries, "entries")
    asked = stored(queries.distinct(), "asked")
    points = asked.groupBy("v").agg(F.min("id").alias("key"))
    index = spark.sparkContext.broadcast(build_graph(entries, dim, k))

    def deal(pick, step=512):
        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    rows, lists = pick(index.value, _matrix(part.column(0)))
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *[c.take(pa.array(rows)) for c in part.columns]], ["list", *part.schema.names])

        return run

    posted = stored(entries.select("v", "ids").mapInArrow(deal(CentroidGraph.places), f"list int, v {kind}, ids array<{id_kind}>"), "posted")
    blocks = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = stored(blocks, "blocks")
    members = posted.join(blocks, "list").withColumn("blk", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    probing = points.select("v", "key").mapInArrow(deal(CentroidGraph.reads, 64), f"list int, v {kind}, key {id_kind}")
    probing = probing.join(blocks, "list").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    no_key, no_ids = F.lit(None).cast(id_kind), F.lit(None).cast(f"array<{id_kind}>")
    both = members.select("list", "blk", no_key.alias("key"), "v", "ids").union(probing.select("list", "blk", "key", "v", no_ids.alias("ids")))
    both = both.repartition("list", "blk").sortWithinPartitions("list", "blk", "key")

    def nearest(batches):
        held: list[pa.RecordBatch] = []
        for found in pairs_of(batches):
            held.append(found)
            if sum(h.num_rows for h in held) > HELD:
                kept = best_of(pa.Table.from_batches(held), k + 1)
                held = kept.to_batches()
                if kept.num_rows > HELD // 2:
                    yield from held
                    held = []
        if held:
            yield from best_of(pa.Table.from_batches(held), k + 1).to_batches()

    def pairs_of(batches):
        for group in grouped(batches, ["list", "blk"]):
            is_query = group.column("ids").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            vectors = _matrix(group.column("v").combine_chunks())
            m, q = vectors[~is_query], vectors[is_query]
            if not len(m) or not len(q):
                continue
            ids = group.column("ids").combine_chunks().filter(pa.array(~is_query))
            keys = group.column("key").combine_chunks().filter(pa.array(is_query))
            lead = np.array([i[0].as_py() for i in ids])
            at_query, at_member, scores = [], [], []
            want = min(k + 1, len(m))
            some = min(want + 4, len(m))  # room for what rounding and ties put beside the last one
            for a in range(0, len(q), 128):
                part = q[a : a + 128]
                d = (m**2).sum(1)[None] + (part**2).sum(1)[:, None] - 2 * part @ m.T
                near = np.argpartition(d, some - 1, axis=1)[:, :some]
                rough = np.sort(np.take_along_axis(d, near, 1), axis=1)
                unsure = (rough[:, -1] <= rough[:, want - 1] + 1e-9 * (1 + np.abs(d).max(axis=1))) & (some < len(m))
                exact = np.sqrt(((m[near] - part[:, None]) ** 2).sum(2))
                order = np.lexsort((lead[near], exact), axis=1)[:, :want]
                near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
                for i in np.flatnonzero(unsure):  # more ties than room: all members are compared
                    full = np.sqrt(((m - part[i]) ** 2).sum(1))
                    near[i] = np.lexsort((lead, full))[:want]
                    exact[i] = full[near[i]]
                at_query += np.repeat(np.arange(a, a + len(part)), want).tolist()
                at_member.append(near.ravel())
                scores.append(exact.ravel())
            at = pa.array(np.concatenate(at_member))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(at_query)), pa.array(lead).take(at).cast(keys.type), ids.take(at), pa.array(np.concatenate(scores))], ["key", "lead", "ids", "score"]
            )

    found = both.mapInArrow(nearest, f"key {id_kind}, lead {id_kind}, ids array<{id_kind}>, score double").dropDuplicates(["key", "lead"])
    best = F.row_number().over(Window.partitionBy("key").orderBy("score", "lead"))
    found = found.withColumn("r", best).where(f"r <= {k + 1}").select("key", F.explode("ids").alias("id"), "score")
    own = points.join(asked.withColumnRenamed("id", "query_id"), "v").select("key", "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    hits = found.join(own, "key").where("id <> query_id").withColumn("rank", rank).where(f"rank <= {k}")
    return hits.select("query_id", "rank", "id", "score")
