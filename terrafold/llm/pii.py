"""Personal data in texts, and information-theoretic sanitisation of what gives it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value
that is found is a protected entity. Over the whole corpus, the terms in a window around an
entity's mentions are counted with it; with N tokens in all, n(t) of term t and n(t, e) of t
within the windows of e, which hold n(e) tokens, a mention of t discloses

    pmi(t, e) = log2( n(t, e) * N / (n(t) * n(e)) ) - D / n(t, e)   bits about e, at most
    ic(e)     = log2( N / n(e) ),

where D = `doubt` bits, shared by the times that a pair was seen, stand for what chance may have put
together: an entity mentioned once is judged too, but only by terms that are rare in the corpus. All
counts are over all rows, repeated texts included, so a repeated row is one more mention: where
every row is repeated, no term that was found is lost, and doubt about others may fall.

A term within the window of e whose pmi / ic is at least `remove` is removed; from
`generalise` on it is generalised to its kind of word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, pieces, stored
from .wordhash import words

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "generalise", "remove")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its first digit only: a later start reaches the same end.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = 0
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        free = max(end, at + 1)
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) in code points, by kind, then start."""
    if not _HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out.append((3, *m.span()))
    return out


def _entity(kind: int, value: str) -> int:
    value = value.lower() if kind == 0 else re.sub(r"[^0-9.]", "", value) if kind == 1 else re.sub("[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _contexts(text: str, spans: list[tuple[int, int, int]], window: int):
    """For each base span: its entity, and the (start, end) of up to window words on either side
    that touch no base span."""
    taken = sorted((a, b) for _, a, b in spans)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([b for _, b in taken]))

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b)) - 1
        return i < 0 or reach[i] <= a

    for kind, a, b in spans:
        near = []
        for m in _WORD.finditer(text, b):
            if free(*m.span()) and m.start() > b:
                near.append(m.span())
            if len(near) == window:
                break
        left = a
        got = 0
        # words before the span, walking back a bounded stretch at a time
        while got < window and left > 0:
            stop = left
            while stop > 0 and text[stop - 1] in " \t\n\x0b\x0c\r":
                stop -= 1
            start = stop
            while start > 0 and text[start - 1] not in " \t\n\x0b\x0c\r":
                start -= 1
            if start == stop:
                break
            if stop < a and free(start, stop):
                near.append((start, stop))
                got += 1
            left = start
        yield _entity(kind, text[a:b]), near


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TRIM = ".,;:!?\"'()[]{}"


def _term(word: str) -> str:
    return word.translate(_FOLD).strip(_TRIM)


def _near_terms(docs: DataFrame, window: int) -> DataFrame:
    """(key, entity, term, n) of docs(text, key): how often a term stands in the windows of an
    entity in all rows of a text; the empty term counts the windows' words."""

    def run(batches):
        for batch in pieces(batches):
            rows: list[tuple] = []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans := base_spans(text or ""):
                    seen: Counter = Counter()
                    for entity, near in _contexts(text, spans, window):
                        seen[entity, ""] += len(near)
                        seen.update((entity, t) for a, b in near if (t := _term(text[a:b])))
                    rows += [(key, e, t, n) for (e, t), n in seen.items()]
            if rows:
                k, e, t, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(e, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["key", "entity", "term", "n"])

    found = docs.select("text", "key").mapInArrow(run, "key bigint, entity bigint, term string, n bigint")
    return found.groupBy("key", "entity", "term").agg(F.sum("n").alias("n"))


_ALL = -(1 << 63)


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all words of all docs for the given distinct terms; the empty term has
    the number of all words.

    Words are counted before the shuffle under the hash of their stripped, folded form, which is
    what a term is.
    """

    def count(batches):
        held, size = [], 0
        for batch in pieces(batches):
            h, _ = words(batch.column(0), trim=_TRIM.encode())
            held.append(h)
            size += len(h)
            if size > 1 << 22:
                yield out(held, size)
                held, size = [], 0
        if size:
            yield out(held, size)

    def out(held, size):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), _ALL)), pa.array(np.append(n, size).astype(np.int64))], ["h", "n"])

    def spell(batches):
        for batch in batches:
            h, _ = words(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64))], ["term", "h"])

    counts = docs.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    wanted = terms.select("term").mapInArrow(spell, "term string, h bigint")
    wanted = wanted.union(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(_ALL).alias("h")))
    return wanted.join(counts, "h", "left").select("term", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


_LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "remove": ""}


def _general(word: str) -> str:
    """The kind of word that stands for a generalised term."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def _clean(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced; of spans that overlap the first, then the longest, counts,
    and what it leaves of the others is removed."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1])):
        if a >= at:
            name = KINDS[kind]
            out.append(text[at:a])
            out.append(_general(text[a:b]) if name == "generalise" else _LABELS[name])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def sanitise(docs: DataFrame, window: int = 6, doubt: float = 7.0, generalise: float = 0.5, remove: float = 0.8) -> DataFrame:
    """docs plus spans (array of kind, start, end, by kind, then start) and clean (the sanitised text).

    Kinds are email, ip, card, phone, generalise and remove; positions are code points, ends
    exclusive. Null text: no spans, clean is null. Empty text: no spans. Repeated rows and equal
    texts get equal results; each row counts in the statistics. Ties in pmi do not matter, as each pair is held against its thresholds alone. Other columns pass through, but for
    ones named spans or clean, which are replaced. An empty table gives an empty table.
    Texts without a digit or @ hold no base span and never leave the JVM.
    """
    passed = [c for c in docs.columns if c not in ("spans", "clean")]
    docs = docs.select(*[f"`{c}`" for c in passed])
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    hint = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    plain = docs.where(~hint).withColumns({"spans": F.array().cast(span), "clean": F.col("text")})
    key = F.xxhash64("text", F.length("text"))
    some = docs.where(hint)

    near = stored(_near_terms(some.select("text", key.alias("key")), window), "near")
    pairs = near.groupBy("entity", "term").agg(F.sum("n").alias("n"))
    sizes = pairs.where("term = ''").select("entity", F.col("n").alias("n_e"))
    likely = stored(pairs.where("term <> ''"), "pairs")
    counts = stored(term_counts(docs, likely.select("term").distinct()), "terms")
    total = counts.where("term = ''").head()
    n_all = F.lit(float(max(total["n"], 1)))
    told = (
        likely.join(sizes, "entity")
        .join(counts.withColumnRenamed("n", "n_t"), "term")
        .withColumn("ic", F.log2(n_all / F.col("n_e")))
        .withColumn("pmi", F.log2(F.col("n") * n_all / (F.greatest("n_t", "n") * F.col("n_e"))) - F.lit(float(doubt)) / F.col("n"))
        .where(f"ic > 0 and pmi >= {float(generalise)} * ic")
        .select("entity", "term", (F.col("pmi") >= F.lit(float(remove)) * F.col("ic")).alias("gone"))
    )
    per_text = near.select("key", "entity", "term").join(told, ["entity", "term"]).groupBy("key").agg(F.collect_list(F.struct("entity", "term", "gone")).alias("told"))
    at, said = free_name(passed, "key"), free_name(passed, "told")
    tagged = some.withColumn(at, key).join(per_text.withColumnsRenamed({"key": at, "told": said}), at, "left")

    def run(batches):
        for batch in pieces(batches, passed.index("text")):
            spans, clean = [], []
            texts, tolds = batch.column(passed.index("text")).to_pylist(), batch.column(len(passed)).to_pylist()
            for text, told in zip(texts, tolds):
                found = base_spans(text)
                if told:
                    gone = {(x["entity"], x["term"]): x["gone"] for x in told}
                    more: dict[tuple[int, int], int] = {}
                    for entity, near in _contexts(text, found, window):
                        for a, b in near:
                            if (g := gone.get((entity, _term(text[a:b])))) is not None:
                                more[a, b] = max(more.get((a, b), 4), 5 if g else 4)
                    found = found + sorted((k, a, b) for (a, b), k in more.items())
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found])
                clean.append(_clean(text, found) if found else text)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(spans, kind), pa.array(clean, pa.string())], [*passed, "spans", "clean"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", spans {span}, clean string"
    return plain.unionByName(tagged.select(*[f"`{c}`" for c in passed], said).mapInArrow(run, schema))
