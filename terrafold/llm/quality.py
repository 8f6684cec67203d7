"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

Heuristic labellers vote bad (1) or abstain (0) on every text; hand labels, where a document
has them, are one more labeller, which also votes good (2). One of the labellers knows no list of
words: its terms, and what each weighs, come from the hand labels by association, whatever the
language. Expectation-maximisation over the counts of vote patterns estimates each labeller's
accuracy in either class, and the share of good texts, without trusting any one of them. The
posterior of each pattern is the soft label of its texts. On a sample of at most SAMPLE rows,
those with hand labels first, these train a logistic scorer over hashed words and binned text
statistics; it then scores every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, stored
from .wordhash import buffers, mix, words

BITS = 18
#: Rows that the scorer is fitted on, and the least number of them that must have a feature.
SAMPLE = 12_000
LEAST_ROWS = 3
BIN_COPIES = 4
#: Weight of what is held of the labellers beforehand, and accuracy of hand labels.
PRIOR, TRUST = 0.05, 0.98
#: Labelled documents whose words are counted, and the most terms that the counts may give.
LABELLED = 200_000
LEXICON = 8192
#: A term of bad texts stands in so many of them at least, and so many times as often as in others.
TERM_ROWS, TERM_LIFT = 4, 10.0
#: Marks that do not count at either end of a word.
TRIM = b".,;:!?\"'()[]{}"
#: How many terms may be there by chance.
TERM_CHANCE = 50
#: What the terms of a text weigh to make a vote: EVIDENCE at least, and what errs least on the
#: labelled documents that no term was learned from (one in HELD), where a good document that the
#: vote is against counts as much as WRONG bad ones that it misses.
EVIDENCE, MOST_EVIDENCE, HELD, WRONG = 4.5, 64.0, 5, 2.0
LABELLERS = ("symbols", "capitals", "repeats", "variety", "stops", "terms", "length", "labels")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]=~^_\\@")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".?")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[33] = True


class Lexicon:
    """Terms of bad texts as sorted hashes, with the logarithm of each one's lift; enough is what
    their sum must reach to make a vote."""

    def __init__(self, hashes=(), lifts=(), enough: float = EVIDENCE):
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes = np.array(hashes, np.uint64)[order]
        self.lifts = np.array(lifts, float)[order]
        self.enough = enough

    def weights(self, h: np.ndarray) -> np.ndarray:
        """The weight of each hash; 0 for words that are no terms."""
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.lifts[at], 0.0)


def statistics(column: pa.Array, lexicon: Lexicon):
    """Per row: the matrix of statistics, and the hash of each word with the rows' word counts.
    Statistics: symbols a byte, capitals a letter, shouts a word, words equal to the one before,
    distinct words a word, sentence ends a word, summed lifts of the distinct terms in parts of
    what makes a vote, words."""
    raw, off = buffers(column)
    h, n = words(column, trim=TRIM)
    lengths = np.diff(off)

    def share(table):
        sums = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])
        return sums[off[1:]] - sums[off[:-1]]

    ends = np.cumsum(n)
    begins = ends - n
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[2:] = h[1:] == h[:-1]
        first = begins[(n > 0) & (begins > 0)]
        same[first + 1] = 0
    same = np.cumsum(same)
    distinct = [np.unique(h[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
    sizes = np.array([len(d) for d in distinct], np.int64)
    lifts = np.concatenate([[0.0], np.cumsum(lexicon.weights(np.concatenate(distinct)))]) if len(distinct) else np.zeros(1)
    last = np.cumsum(sizes)
    some = np.maximum(n, 1)
    capitals, small = share(_CAPITAL), share(_SMALL)
    stats = np.stack(
        [
            share(_SYMBOL) / np.maximum(lengths, 1),
            capitals / np.maximum(capitals + small, 1),
            share(_SHOUT) / some,
            (same[ends] - same[begins]) / some,
            sizes / some,
            share(_STOP) / some,
            (lifts[last] - lifts[last - sizes]) / lexicon.enough,
            n,
        ],
        axis=1,
    )
    return stats, distinct


def votes(stats: np.ndarray) -> np.ndarray:
    """The heuristic labellers' votes: 1 bad, 0 none. Each knows one kind of bad text only, so
    none votes good: many silent labellers must not outvote the one that knows. The terms' lifts
    count in parts of what makes a vote."""
    symbols, capitals, shouts, repeats, variety, stops, lifts, n = stats.T
    return np.stack(
        [
            symbols > 0.05,
            (capitals > 0.5) | (shouts > 0.3),
            repeats > 0.15,
            (variety < 0.3) & (n > 20),
            (stops < 0.005) & (n > 60),
            lifts >= 1,
            n < 1,
        ],
        axis=1,
    ).astype(np.int64)


def least_errors(spread) -> float:
    """The evidence from which a vote errs least, from counts of bad and good documents by quarters
    of evidence; EVIDENCE at least, and of equal ones the smallest."""
    steps = range(int(4 * EVIDENCE), int(4 * MOST_EVIDENCE) + 1)
    errors = [sum(WRONG * r["good"] if r["step"] >= k else r["bad"] for r in spread) for k in steps]
    return steps[int(np.argmin(errors))] / 4


def learn_terms(docs: DataFrame, marked: DataFrame) -> Lexicon:
    """The terms of docs(doc_id, text) that set marked(doc_id, bad) documents apart: the share of
    the bad documents that have one, over that of the others, is TERM_LIFT at least, and so many
    of the words that were counted would not do so by chance (log-likelihood ratio). marked is
    bounded and goes to every worker; counts are combined in each task before they move."""

    def count(batches):
        held, flags = [], []
        size = 0

        def out():
            h, inverse = np.unique(np.concatenate(held), return_inverse=True)
            bad = np.bincount(inverse, np.concatenate(flags), len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(h)) - bad)], ["h", "bad", "other"])

        for batch in pieces(batches):
            h, n = words(batch.column(0), trim=TRIM)
            ends = np.cumsum(n)
            for a, b, flag in zip((ends - n).tolist(), ends.tolist(), batch.column(1).to_pylist()):
                d = np.unique(h[a:b])
                held.append(d)
                flags.append(np.full(len(d), float(flag)))
                size += len(d)
            if size > 1 << 21:
                yield out()
                held, flags, size = [], [], 0
        if size:
            yield out()

    sizes = marked.agg(F.sum(F.col("bad").cast("int")), F.count("*")).head()
    n_bad, n_all = sizes[0] or 0, sizes[1]
    if not n_bad:
        return Lexicon()
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "bad")
    found = texts.mapInArrow(count, "h bigint, bad bigint, other bigint").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("other").alias("other"))
    found = stored(found, "terms")
    tested = found.count()
    lift = (F.col("bad") / n_bad) / ((F.col("other") + 1) / (n_all - n_bad + 2))
    share, both = n_bad / n_all, F.col("bad") + F.col("other")
    gain = lambda n, p: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * p))).otherwise(0.0)
    chance = gain("bad", share) + gain("other", max(1 - share, 1e-9))
    found = found.where(F.col("bad") >= TERM_ROWS).withColumn("lift", lift).where((F.col("lift") >= TERM_LIFT) & (chance >= np.log(max(tested / TERM_CHANCE, 1))))
    rows = found.orderBy(F.desc(F.log("lift") * F.col("bad")), "h").limit(LEXICON).collect()  # at most LEXICON rows
    return Lexicon([r["h"] & ((1 << 64) - 1) for r in rows], [float(np.log(r["lift"])) for r in rows])


def posteriors(patterns: np.ndarray, table: np.ndarray, share: np.ndarray) -> np.ndarray:
    """P(class) of each row of votes, given the labellers' vote distributions in each class."""
    logs = np.log(table)
    score = np.log(share) + sum(logs[j].T[patterns[:, j]] for j in range(len(table)))
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000, settled: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good | pattern), vote distributions [labeller, class, vote], class shares) from distinct
    vote patterns.

    Bad texts are of several kinds, and the labellers that know one are silent on the others, so
    one bad class would not do: there is one for each heuristic labeller, one for what only hand
    labels show, and the good class, which is the last. The start holds each labeller to know
    its own kind and seldom to be wrong on good texts, with the weight of PRIOR times the texts.
    The last labeller, the hand labels, is right TRUST of the time and is not estimated: it
    anchors the others. Rounds end when no number moves by more than `settled`."""
    m = patterns.shape[1]
    k = m + 1
    total = counts.sum()
    table = np.empty((m, k, 3))
    table[:] = (0.94, 0.05, 0.01)
    table[:, -1] = (0.985, 0.01, 0.005)
    for j in range(m - 1):
        table[j, j] = (0.1, 0.89, 0.01)
    covered = float(np.clip(counts[patterns[:, -1] > 0].sum() / max(total, 1), 1e-3, 1 - 1e-3))
    table[-1] = (1 - covered, covered * TRUST, covered * (1 - TRUST))
    table[-1, -1] = (1 - covered, covered * (1 - TRUST), covered * TRUST)
    start, share = table.copy(), np.append(np.full(k - 1, 0.2 / (k - 1)), 0.8)
    prior = share.copy()
    post = posteriors(patterns, table, share)
    for _ in range(rounds if total else 0):
        post = posteriors(patterns, table, share)
        weight = post * counts[:, None]
        before = table.copy(), share
        share = weight.sum(axis=0) + PRIOR * total * prior
        share /= share.sum()
        for j in range(m - 1):
            got = np.stack([np.bincount(patterns[:, j], w, 3) for w in weight.T]) + PRIOR * total * prior[:, None] * start[j]
            table[j] = got / got.sum(axis=1, keepdims=True)
        if max(np.abs(table - before[0]).max(), np.abs(share - before[1]).max()) < settled:
            break
    return post[:, -1], table, share


def _feature_ids(stats: np.ndarray, distinct: list[np.ndarray]) -> list[np.ndarray]:
    """Hashed features of each row: its distinct words, and its statistics by bin. A bin stands
    under BIN_COPIES hashes, so that it outweighs the words of the few texts it is fitted on."""
    bins = np.stack([np.digitize(stats[:, k], e) for k, e in enumerate(_EDGES)], axis=1).astype(np.uint64)
    salt = np.arange(len(_EDGES), dtype=np.uint64) * np.uint64(1000) + np.uint64(7)
    own = np.concatenate([mix(bins + salt + np.uint64(100_000 * k)) for k in range(BIN_COPIES)], axis=1)
    return [np.unique((np.concatenate([d, o]) >> np.uint64(64 - BITS)).astype(np.int32)) for d, o in zip(distinct, own)]


_EDGES = (
    (0.01, 0.02, 0.04, 0.06, 0.1, 0.2),
    (0.05, 0.1, 0.2, 0.35, 0.5, 0.8),
    (0.02, 0.05, 0.1, 0.3, 0.6),
    (0.02, 0.05, 0.1, 0.15, 0.3, 0.6),
    (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    (0.01, 0.02, 0.04, 0.1, 0.3, 0.5),
    (0.4, 0.7, 1, 1.5, 3),
    (1, 5, 20, 100),
)


def fit_scorer(ids: list[np.ndarray], target: np.ndarray, rounds: int = 150, ridge: float = 2.0) -> np.ndarray:
    """Logistic weights over hashed features, the intercept last; features of fewer than
    LEAST_ROWS rows keep weight 0."""
    n = len(ids)
    weights = np.zeros((1 << BITS) + 1)
    if not n:
        weights[-1] = 1.0  # nothing is known against any text
        return weights
    column = np.concatenate(ids)
    row = np.repeat(np.arange(n), [len(x) for x in ids])
    known = np.bincount(column, minlength=1 << BITS) >= min(LEAST_ROWS, n)
    keep = known[column]
    column, row = column[keep], row[keep]
    used, column = np.unique(column, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column], n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / n
        g = np.bincount(column, error[row], len(used)) + ridge * w / n
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * (1 - (t - 1) / rounds) * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        bias -= step * mb / (vb**0.5 + 1e-8)
    weights[used] = w
    weights[-1] = bias
    return weights


def classify(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...) plus weak_label (posterior by the heuristic labellers alone), score and keep.

    labels(doc_id, quality, toxic): a document counts as labelled good if it has quality 1 and
    toxic 0 in all its label rows; rows with null values or ids are not used. Terms are learned
    from at most LABELLED labelled documents, toxic ones against the others. score is the linear
    scorer's probability that the text is good, keep is score >= threshold. Null and empty texts
    are scored as texts without words. Repeated rows get equal results. Other columns pass
    through, but for ones named as the results, which are replaced. An empty table gives an
    empty table; with nothing to fit on, every text is kept.
    """
    spark = docs.sparkSession
    passed = [c for c in docs.columns if c not in ("weak_label", "score", "keep")]
    docs = docs.select(*[f"`{c}`" for c in passed])
    kind = docs.schema["doc_id"].dataType.simpleString()
    m = len(LABELLERS) - 1

    lexicon = Lexicon()
    if labels is not None:
        gold = labels.where("doc_id is not null and quality is not null and toxic is not null")
        good = (F.min("quality") >= 1) & (F.max("toxic") <= 0)
        gold = stored(gold.groupBy("doc_id").agg(F.when(good, 2).otherwise(1).cast("bigint").alias("gold"), (F.max("toxic") > 0).alias("bad")), "gold")
        # of equal texts one counts, so that a group of copies neither makes terms nor sets the vote
        marked = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).select("doc_id", "bad")
        marked = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(marked), "doc_id")
        marked = stored(marked.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("bad").alias("bad")), "marked")
        held = F.pmod("h", F.lit(HELD)) == 0
        lexicon = learn_terms(docs, marked.where(~held).select("doc_id", "bad"))
    terms = spark.sparkContext.broadcast(lexicon)

    place = LABELLERS.index("terms")

    def vote(batches):
        for batch in pieces(batches, 1):
            stats = statistics(batch.column(1), terms.value)[0]
            v = votes(stats)
            v[:, place] = 0  # what makes a vote is known once all texts are weighed
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v @ 3 ** np.arange(m)), pa.array(stats[:, -2] * terms.value.enough)], ["doc_id", "code", "lifts"])

    voted = docs.select("doc_id", "text").mapInArrow(vote, f"doc_id {kind}, code bigint, lifts double")
    if labels is not None:
        voted = voted.join(gold.select("doc_id", "gold"), "doc_id", "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    else:
        voted = voted.withColumn("gold", F.lit(0).cast("bigint"))
    voted = stored(voted.withColumn("code", F.col("code") + 3**m * F.col("gold")), "votes")
    if len(lexicon.hashes):
        steps = F.floor(F.least(F.col("lifts"), F.lit(MOST_EVIDENCE)) * 4)
        spread = voted.select("doc_id", "lifts").join(F.broadcast(marked.where(held)), "doc_id").distinct()
        spread = spread.groupBy(steps.alias("step")).agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
        lexicon.enough = least_errors(spread.collect())  # at most 4 * MOST_EVIDENCE + 1 rows
    terms = spark.sparkContext.broadcast(lexicon)
    voted = voted.withColumn("code", F.col("code") + F.when(F.col("lifts") >= lexicon.enough, 3**place).otherwise(0))

    found = voted.groupBy("code").agg(F.count("*").alias("n")).collect()  # at most 3 ** 8 patterns
    found = sorted(found, key=lambda r: r["code"])  # so that sums, and the fit after them, agree in every run
    codes = np.array([r["code"] for r in found], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(m + 1) % 3
    post, table, kinds = expectation_maximisation(patterns, np.array([r["n"] for r in found], float))
    posterior = dict(zip(codes.tolist(), post.tolist()))

    known = voted.where("doc_id is not null").groupBy("doc_id").agg(F.max("code").alias("code"), F.max(F.col("gold") > 0).alias("told"))
    chosen = stored(known.orderBy(F.desc("told"), F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "code"), "sample")

    def featurise(batches):
        for batch in pieces(batches, 1):
            ids = _feature_ids(*statistics(batch.column(1), terms.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([posterior[c] for c in batch.column(2).to_pylist()], pa.float64())],
                ["doc_id", "ids", "target"],
            )

    def train(batches):
        ids, target, seen = [], [], []
        for batch in batches:
            seen += batch.column(0).to_pylist()
            ids += [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            target += batch.column(2).to_pylist()
        order = sorted(range(len(seen)), key=lambda i: (seen[i], ids[i].tobytes()))
        weights = fit_scorer([ids[i] for i in order], np.array([target[i] for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["weights"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the sample is bounded
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("code").alias("code"))
    rows = rows.mapInArrow(featurise, f"doc_id {kind}, ids binary, target double")
    fitted = rows.repartition(1).mapInArrow(train, "weights binary").collect()
    weights = np.frombuffer(fitted[0]["weights"], np.float32).copy() if fitted else fit_scorer([], np.zeros(0))
    shared = spark.sparkContext.broadcast((weights, table[:m], kinds))

    def score(batches):
        place = passed.index("text")
        for batch in pieces(batches, place):
            w, accuracies, share = shared.value
            stats, distinct = statistics(batch.column(place), terms.value)
            ids = _feature_ids(stats, distinct)
            sizes = np.array([len(x) for x in ids])
            sums = np.concatenate([[0], np.cumsum(w[np.concatenate(ids)].astype(np.float64))]) if len(ids) else np.zeros(1)
            at = np.cumsum(sizes)
            z = sums[at] - sums[at - sizes] + float(w[-1])
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            weak = posteriors(votes(stats), accuracies, share)[:, -1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(weak, pa.float64()), pa.array(p), pa.array(p >= threshold)], [*passed, "weak_label", "score", "keep"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", weak_label double, score double, keep boolean"
    return docs.mapInArrow(score, schema)
