"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's rows are dealt by hash to shards of about SHARD_ROWS rows; a shard's rows, in
seeded order, form one stream of words, cut to blocks of BLOCK_WORDS. Targets come from the
weights (no source above max_repeats times its size; what is cut is reshared). The blocks that
the targets hold in all go to the sources, a source's blocks to its lots, and a lot's blocks to
its shards, by the highest quotients target / (2 k + 1). A source's largest shard also gets, in
words, what the rounding to blocks leaves of its target, or gives it back. A shard takes its quota
of words as whole passes over its stream and, for the rest, blocks in a seeded random order, the
last one in part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, give_back, stored

#: Lots that a source's rows are dealt to; beyond LOTS * SHARD_ROWS rows a lot has several shards.
LOTS = 4096
SHARD_ROWS = 512
BLOCK_WORDS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above most * its size; the excess is reshared by
    weight among the others until none is above."""
    cap = most * sizes.astype(float)
    out = np.zeros(len(cap))
    open_ = np.ones(len(cap), bool)
    left = float(sizes.sum())
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0)
        over = open_ & (share >= cap)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return out


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Integer seats by the highest quotients weight / (2 k + 1); ties to the earlier party."""
    w = np.asarray(weights, float)
    got = np.zeros(len(w), np.int64)
    if seats <= 0 or not (w > 0).any():
        return got
    low, high = 0.0, (seats + len(w)) / w.sum() * 2
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(w * mid + 0.5).sum() <= seats:
            low = mid
        else:
            high = mid
    got = np.floor(w * low + 0.5).astype(np.int64)
    while got.sum() < seats:  # parties that tie at the border
        got[np.argmax(np.where(w > 0, w / (2 * got + 1), -1))] += 1
    return got


def _quotas(per_source: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row a source: source_size, target, seats (blocks), lots, and subs (shards a lot).
    The only single-task step; it holds one short row a source, some 100 bytes."""

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [(s is None, b"" if s is None else s.encode("utf-8")) for s in rows["source"]]
        rows = rows.iloc[sorted(range(len(keys)), key=keys.__getitem__)].reset_index(drop=True)
        sizes = rows["words"].to_numpy(np.int64)
        w = np.resize(np.array(weights, float), len(rows))
        goal = targets(sizes, w, most)
        seats = sainte_lague(goal, int(round(goal.sum() / BLOCK_WORDS)))
        shards = (2 ** np.ceil(np.log2(np.maximum(1, rows["n"].to_numpy(float) / SHARD_ROWS)))).astype(np.int64)
        lots = np.minimum(shards, LOTS)
        return pd.DataFrame({"source": rows["source"], "source_size": sizes, "target": goal, "seats": seats, "lots": lots, "subs": shards // lots})

    return per_source.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(plan, "source string, source_size bigint, target double, seats bigint, lots bigint, subs bigint")


def _deal(parties: DataFrame, keys: list[str], party: str) -> DataFrame:
    """parties plus quota: the seats of each group of keys over its parties, by their words."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(party).reset_index(drop=True)
        rows["quota"] = sainte_lague(rows["words"].to_numpy(), int(rows["seats"].iloc[0]))
        return rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parties.schema)
    return parties.groupBy(*keys).applyInPandas(deal, schema + ", quota bigint")


def _shard_quotas(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, lot, sub, words, quota in words, source_size, target): a source's blocks over its
    lots, of which there are LOTS at most, and each lot's over its shards."""
    joined = sized.join(quotas, sized["source"].eqNullSafe(quotas["source"])).select(
        quotas["source"], *_shard("ordered", "lots", "subs"), "size", "seats", "source_size", "target"
    )
    per = joined.groupBy("source", "lot", "sub", "seats", "source_size", "target").agg(F.sum("size").alias("words"))
    per = stored(per, "shards")
    lots = _deal(per.groupBy("source", "lot", "seats").agg(F.sum("words").alias("words")), ["source"], "lot")
    lots = lots.select(F.col("source").alias("s"), F.col("lot").alias("l"), F.col("quota").alias("lot_seats"))
    dealt = per.join(lots, per["source"].eqNullSafe(lots["s"]) & (per["lot"] == lots["l"])).drop("s", "l")
    dealt = _deal(dealt.withColumnsRenamed({"seats": "source_seats", "lot_seats": "seats"}), ["source", "lot"], "sub")
    # what is left of the target goes to the shard with the most words, ties to the first
    largest = dealt.groupBy("source").agg(F.max_by(F.struct("lot", "sub"), F.struct("words", -F.col("lot"), -F.col("sub"))).alias("first"))
    largest = largest.select(F.col("source").alias("s"), "first")
    rest = F.round("target").cast("bigint") - F.col("source_seats") * BLOCK_WORDS
    mine = F.coalesce((F.col("first.lot") == F.col("lot")) & (F.col("first.sub") == F.col("sub")), F.lit(False))
    dealt = dealt.join(largest, dealt["source"].eqNullSafe(largest["s"]))
    quota = F.greatest(F.lit(0), F.col("quota") * BLOCK_WORDS + F.when(mine, rest).otherwise(0))
    return dealt.select("source", "lot", "sub", "words", quota.alias("quota"), "source_size", "target")


def _shard(ordered: str, lots: str, subs: str):
    """lot and sub of a row from its seeded hash, by the numbers of its source."""
    h = F.xxhash64(ordered)
    lot = F.pmod(F.pmod(h, F.lit(LOTS)), F.col(lots)).cast("int")
    return lot.alias("lot"), F.pmod(F.shiftright(h, 20), F.col(subs)).cast("int").alias("sub")


def _extra(seed: int, source, shard: tuple[int, int], words: int, block: int, rest: int) -> np.ndarray:
    """Words taken from the start of each block when rest words are to be taken in all."""
    name = f"{seed}|{shard[0]}.{shard[1]}|" + ("" if source is None else f"s{source}")
    order = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")).permutation(-(-words // block))
    sizes = np.minimum(block, words - order * block)
    take = np.clip(rest - (np.cumsum(sizes) - sizes), 0, sizes)
    out = np.zeros(len(order), np.int64)
    out[order] = take
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17, keep_text: bool = True) -> DataFrame:
    """docs(text, source, ...) plus size, source_size, target, taken, copies and parts.

    taken words are copies whole passes over the row's text plus the words of parts, an array of
    (begin, end) word positions. Sources in order of code points, null last, take the weights in
    turn. Null or wordless texts have size 0 and take nothing; a null source is a source of its
    own. Repeated rows are rows like others, and rows of one doc_id and text may change places.
    Reruns agree, however the input is partitioned.
    Other columns pass through, but for ones that bear a name of the results, which are replaced.
    An empty table gives an empty table. keep_text=False leaves the texts out before rows move.
    """
    return _mix(docs, weights, max_repeats, seed, keep_text)


_NEW = ("size", "source_size", "target", "taken", "copies", "parts")


def _mix(docs: DataFrame, weights, max_repeats: int, seed: int, keep_text: bool, then=None) -> DataFrame:
    """mix(); then: (function over its batches, schema), which runs in the same Python worker."""
    passed = [c for c in docs.columns if c not in _NEW and (keep_text or c != "text")]
    own = {n: free_name([*docs.columns, *_NEW], n) for n in ("ordered", "lots", "subs", "lot", "sub", "words", "quota", "s", "key")}
    o = own["ordered"]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in ("doc_id", "text") if c in docs.columns], F.lit(seed))
    rows = docs.select(*[f"`{c}`" for c in passed], word_count(F.col("text")).alias("size"), hashed.alias(o))
    if not keep_text:  # narrow rows: texts are read once
        rows = stored(rows, "sized")
    sized = rows.select("source", F.col(o).alias("ordered"), "size")
    sized = stored(sized, "sizes") if keep_text else sized
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    quotas = stored(_quotas(per_source, tuple(weights), float(max_repeats)), "quotas")
    shards = stored(_shard_quotas(sized, quotas), "quotas")

    counts = quotas.select(F.col("source").alias(own["s"]), F.col("lots").alias(own["lots"]), F.col("subs").alias(own["subs"]))
    lot, sub = _shard(o, own["lots"], own["subs"])
    rows = rows.join(counts, rows["source"].eqNullSafe(counts[own["s"]])).drop(own["s"]).withColumns({own["lot"]: lot, own["sub"]: sub})
    dealt = shards.select(
        F.col("source").alias(own["s"]), F.col("lot").alias("l"), F.col("sub").alias("b"), F.col("words").alias(own["words"]), F.col("quota").alias(own["quota"]), "source_size", "target"
    )
    rows = rows.join(dealt, rows["source"].eqNullSafe(dealt[own["s"]]) & (rows[own["lot"]] == dealt["l"]) & (rows[own["sub"]] == dealt["b"]))
    key = F.xxhash64("source", own["lot"], own["sub"]).alias(own["key"])
    rows = rows.select(*[f"`{c}`" for c in passed], "size", "source_size", "target", o, own["lot"], own["sub"], own["words"], own["quota"], key)
    rows = rows.repartition(own["key"]).sortWithinPartitions(own["key"], own["lot"], own["sub"], "source", o)
    blk = BLOCK_WORDS

    def take(batches):
        state: tuple = (None,)
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            source, lot, sub, size, words, quota = (col(c) for c in ("source", own["lot"], own["sub"], "size", own["words"], own["quota"]))
            n = batch.num_rows
            change = np.ones(n, bool)
            change[1:] = (lot[1:] != lot[:-1]) | (sub[1:] != sub[:-1]) | (source[1:] != source[:-1])
            cuts = [*np.flatnonzero(change).tolist(), n]
            taken, copies, parts = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for a, b in zip(cuts, cuts[1:]):
                key = (source[a], (int(lot[a]), int(sub[a])))
                if state[0] != key:
                    t = int(words[a])
                    want = min(int(quota[a]), max_repeats * t)
                    passes, rest = divmod(want, t) if t else (0, 0)
                    extra = _extra(seed, *key, t, blk, rest)
                    state = (key, passes, extra, np.concatenate([[0], np.cumsum(extra)]), np.append(extra, 0), 0)
                key, passes, extra, before, padded, at = state
                ends = at + np.cumsum(size[a:b])
                begins = ends - size[a:b]
                got = lambda x: before[x // blk] + np.minimum(x % blk, padded[x // blk])
                copies[a:b] = np.where(size[a:b] > 0, passes, 0)
                taken[a:b] = passes * size[a:b] + got(ends) - got(begins)
                for i in np.flatnonzero(got(ends) > got(begins)).tolist():
                    x, y = int(begins[i]), int(ends[i])
                    spans = []
                    for k in range(x // blk, -(-y // blk)):
                        p, q = max(x, k * blk), min(y, k * blk + int(extra[k]))
                        if p < q:
                            if spans and spans[-1]["end"] == p - x:
                                spans[-1]["end"] = q - x
                            else:
                                spans.append({"begin": p - x, "end": q - x})
                    parts[a + i] = spans
                state = (*state[:5], int(ends[-1]))
            cols = [batch.column(i) for i in range(len(passed) + 3)]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(taken), pa.array(copies), pa.array([p or [] for p in parts], kind)], [*passed, "size", "source_size", "target", "taken", "copies", "parts"]
            )

    if then is not None:
        after, schema = then(passed)
        return rows.mapInArrow(lambda batches: after(take(batches)), schema)
    return rows.mapInArrow(take, _schema(docs, passed) + ", size bigint, source_size bigint, target double, taken bigint, copies bigint, parts array<struct<begin:bigint,end:bigint>>")


def _schema(docs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The texts that mix() takes: one row for each whole pass over a row and one for its parts, cut
    from the text with the white space inside kept; rows that nothing is taken from go. Other
    columns pass through, but for ones named as mix()'s results."""
    import re

    pattern = re.compile(WORD)

    def then(passed):
        place = passed.index("text")
        n = len(passed)

        def cut(batches):
            for batch in batches:
                index, texts = [], []
                for i, (t, copies, parts) in enumerate(zip(batch.column(place).to_pylist(), batch.column(n + 4).to_pylist(), batch.column(n + 5).to_pylist())):
                    index += [i] * copies
                    texts += [t] * copies
                    if parts:
                        spans = [m.span() for m in pattern.finditer(t)]
                        index.append(i)
                        texts.append("\n".join(t[spans[p["begin"]][0] : spans[p["end"] - 1][1]] for p in parts))
                cols = [c.take(pa.array(index, pa.int64())) for c in batch.columns[:n]]
                cols[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, passed)
            give_back()

        return cut, _schema(docs, passed)

    return _mix(docs, tuple(weights), max_repeats, seed, True, then)
