"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are inserted into a trie over byte symbols, which is laid out as
its words in order. A depth-first walk keeps, for every prefix on the path, the last token of
that prefix's encoding: it is the one vocabulary token ending there that is compatible with the
last token of the prefix before it.
A prefix shared by many words is thus encoded once; a word's ids follow by stepping back over
last tokens.

Two adjacent tokens are compatible when no merge across their border fires while the two are
being built; merges have unique ranks, so this is read off the merge tree's two inner spines.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import give_back, pieces

_NEVER = 1 << 60
#: Letters, numbers and the rest where no character is a number but 0-9.
_PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s\x85]|_)+")
_OTHER_NUMBERS = regex.compile(r"[^\P{N}0-9]|[\x1c-\x1f]")
#: Outside the long-settled scripts.
_UNSURE = re.compile("[^\x00-\u036f\u0384-\u0481\u048a-\u0527\u1e00-\u1fff\u2010-\u206f\u20a0-\u20b5\u2100-\u214f\u2190-\u23f3\u2460-\u26ff\u3041-\u30ff\u4e00-\u9fcb\uac00-\ud7a3]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The usual printable stand-ins of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBPE:
    """Encoder and decoder for a tokenizer file with byte-level symbols and word-end suffix."""

    def __init__(self, path: str, cache_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.symbols = _byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.numbers = {i: str(i) for i in self.token}
        # the merge tree
        self.merge: dict[tuple[int, int], int] = {}  # pair -> rank
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merge[a, b] = rank
            self.made.setdefault(c, (rank, a, b))
        self.right_spine: dict[int, list[tuple[int, int]]] = {}
        self.left_spine: dict[int, list[tuple[int, int]]] = {}
        self.compatible_cache: dict[tuple[int, int], bool] = {}
        self.longest = 1
        reach: dict[int, tuple[str, ...]] = {}
        ends = {s + self.suffix for s in self.symbols}
        for text, i in self.vocab.items():
            if i not in self.made and (len(text) == 1 or text in ends):
                reach[i] = (text,)
        for c, (rank, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]):
            if a in reach and b in reach and self._clash(a, b, rank) is False:
                reach[c] = reach[a] + reach[b]
        # tokens by their symbols, within words and at their end; those that the merges cannot
        # reach never occur
        self.longest = max(map(len, reach.values()), default=1)
        at_end = {i for i, k in reach.items() if self.suffix and k[-1].endswith(self.suffix)}
        self.plain = {"".join(k): i for i, k in reach.items() if i not in at_end}
        self.closing = {"".join(reach[i])[: -len(self.suffix)]: i for i in at_end}
        self.width = {i: len(k) for i, k in reach.items()}
        self.right_spine.clear()
        self.left_spine.clear()
        #: The ids and tokens of known words, joined by spaces; special tokens stand under a mark
        #: that no word can be. The old ones are those of the last turn.
        self.marks = {f" {t}": str(i) for t, i in self.special.items()}
        self.ids_of: dict[str, str] = dict(self.marks)
        self.names_of: dict[str, str] = {m: m[1:] for m in self.marks}
        self.old_ids: dict[str, str] = {}
        self.old_names: dict[str, str] = {}
        self.silent: set[str] = set()  # words without any token
        self.split_pattern = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), None)
        self.library = None
        self.cache_words = cache_words
        self.table = {b: self.symbols[b] for b in range(256)}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at the inner border while token is being built, each with the rank of
        the merge that absorbs it, from the single symbol upward."""
        store = self.right_spine if side == 2 else self.left_spine
        found = store.get(token)
        if found is None:
            found, until, at = [], _NEVER, token
            while True:
                found.append((at, until))
                if at not in self.made:
                    break
                until = self.made[at][0]
                at = self.made[at][side]
            found.reverse()
            store[token] = found
        return found

    def _clash(self, a: int, b: int, below: int) -> bool:
        """Does a merge across the border of a and b, of a rank less than below, come first?"""
        left, right = self._spine(a, 2), self._spine(b, 1)
        i = j = 0
        merge = self.merge
        while True:
            x, gone_x = left[i]
            y, gone_y = right[j]
            rank = merge.get((x, y))
            # of equal ranks the leftmost fires first: before y's, but after x's
            if rank is not None and rank < below and rank < gone_x and rank <= gone_y:
                return True
            if gone_x == _NEVER and gone_y == _NEVER:
                return False
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self.compatible_cache.get(key)
        if found is None:
            if len(self.compatible_cache) > 200_000:
                self.compatible_cache.clear()
                self.right_spine.clear()
                self.left_spine.clear()
            found = self.compatible_cache[key] = not self._clash(a, b, _NEVER)
        return found

    def learn(self, words: list[str]) -> None:
        """Encode words and keep them in the cache. words are non-empty piece texts.

        The trie lies in its words in order: going through them is its depth-first walk, and
        what a word shares with the one before is the path that both have from the root. last
        is the stack of last-token states along the path, cut back to the shared part."""
        table = self.table
        plain, closing = self.plain, self.closing if self.suffix else self.plain
        known, longest, width = self.compatible_cache, self.longest, self.width
        ids_of, names_of = self.ids_of, self.names_of
        names, numbers = self.token, self.numbers
        ordered = sorted([(w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(table), w) for w in words])
        last, before = [-1], ""
        for symbols, word in ordered:
            n = len(symbols)
            end = closing.get(symbols)
            if end is not None:
                ids_of[word], names_of[word] = numbers[end], names[end]
                continue
            k, m = 0, min(n, len(before), len(last) - 1)
            while k < m and symbols[k] == before[k]:
                k += 1
            del last[k + 1 :]
            before = symbols
            for i in range(k + 1, n + 1):
                tokens = closing if i == n else plain
                found = -1
                for j in range(i - 1, max(0, i - longest) - 1, -1):
                    t = tokens.get(symbols[j:i])
                    if t is not None:
                        if j == 0:
                            found = t
                            break
                        previous = last[j]
                        if previous >= 0:
                            fits = known.get((previous, t))
                            if fits is None:
                                fits = self.compatible(previous, t)
                            if fits:
                                found = t
                                break
                if i == n:
                    end = found
                else:
                    last.append(found)
            ids, at = [], n
            while at > 0 and end >= 0:
                ids.append(end)
                at -= width[end]
                end = last[at] if at else -1
            if at:  # a symbol outside the vocabulary, which the model leaves out
                ids = self._plain_merge(symbols)
            else:
                ids.reverse()
            ids_of[word], names_of[word] = " ".join([numbers[i] for i in ids]), " ".join([names[i] for i in ids])
            if not ids:
                self.silent.add(word)

    def _plain_merge(self, symbols: str) -> list[int]:
        parts = [self.vocab.get(s) for s in [*symbols[:-1], symbols[-1] + self.suffix]]
        parts = [p for p in parts if p is not None]
        while True:
            best = min(((self.merge.get(p, _NEVER), k) for k, p in enumerate(zip(parts, parts[1:]))), default=(_NEVER, 0))
            if best[0] == _NEVER:
                return parts
            k = best[1]
            c = next(c for c, (r, _, _) in self.made.items() if r == best[0])
            parts[k : k + 2] = [c]

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised as the tokenizer file says."""
        if not text.isascii():
            if _UNSURE.search(text):
                return self._library_split(text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:
                text = text.replace("\u03a3", "\u03c3")  # lower case is by code point, whatever stands around it
            if _OTHER_NUMBERS.search(text):
                return self.pieces.findall(text.lower())
        return _PLAIN_PIECES.findall(text.lower())

    def _library_split(self, text: str) -> list[str]:
        """As split, by the library's own character tables, for scripts on which the tables of
        different Unicode versions differ."""
        if self.library is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self.library = (
                normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]),
                pre_tokenizers.Split(Regex(self.split_pattern), "removed", invert=True),
            )
        normal, pieces = self.library
        return [w for w, _ in pieces.pre_tokenize_str(normal.normalize_str(text))]

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by a space, decoded text) of each text."""
        parts: list[list[str]] = []
        for text in texts:
            if self.special_pattern is not None and "<|" in text and self.special_pattern.search(text):
                items, at = [], 0
                for m in self.special_pattern.finditer(text):
                    items += self.split(text[at : m.start()])
                    items.append(f" {m[0]}")
                    at = m.end()
                parts.append(items + self.split(text[at:]))
            else:
                parts.append(self.split(text))
        if len(self.ids_of) > self.cache_words:  # words not met since the last turn go
            self.old_ids, self.old_names = self.ids_of, self.names_of
            self.ids_of, self.names_of, self.silent = dict(self.marks), {m: m[1:] for m in self.marks}, set()
        young, old = self.ids_of, self.old_ids
        new = []
        for w in set().union(*parts).difference(young):
            found = old.get(w)
            if found:
                young[w], self.names_of[w] = found, self.old_names[w]
            else:
                new.append(w)
        if new:
            self.learn(new)
        if self.silent:
            parts = [[w for w in p if w not in self.silent] for p in parts]
        ids, names = young.__getitem__, self.names_of.__getitem__
        out = []
        for p in parts:
            line = " ".join(map(ids, p))
            out.append((line.count(" ") + 1 if line else 0, line, " ".join(map(names, p))))
        return out

    def forget(self) -> None:
        """Let go of the words met so far."""
        self.ids_of, self.names_of, self.silent = dict(self.marks), {m: m[1:] for m in self.marks}, set()
        self.old_ids, self.old_names = {}, {}

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.batch([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special ones included; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_loaded: dict[tuple[str, int], WordBPE] = {}


def loaded(path: str, cache_words: int = 200_000) -> WordBPE:
    """One encoder a Python worker, until unload."""
    key = (path, cache_words)
    if key not in _loaded:
        _loaded[key] = WordBPE(path, cache_words)
    return _loaded[key]


def unload() -> None:
    """Let go of the encoders: a Python worker serves other stages next, within the same limit."""
    for encoder in _loaded.values():
        encoder.forget()
    _loaded.clear()
    gc.collect()


def encode_texts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", texts: bool = True, chunk_bytes: int = 1 << 21) -> DataFrame:
    """docs plus ids (array<int>), decoded (string), n_tokens, ids_sha256 and decoded_sha256.

    vocabulary: a file's path, or its name in the package of public tokenizers on the workers.
    texts=False leaves text, ids and decoded out, for callers that need the digests alone.
    Null or empty text: no ids, digests of the empty string. Repeated rows give equal results.
    Other columns pass through unchanged, but for ones that bear a name of the results,
    which are replaced. Whole texts are encoded, a bounded number of bytes at a time. An empty
    table gives an empty table.
    """
    new = ([("ids", "array<int>"), ("decoded", "string")] if texts else []) + [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    names = {n for n, _ in new} | {"ids", "decoded"}
    passed = [c for c in docs.columns if c not in names]
    kept = [c for c in passed if texts or c != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept] + [f"{n} {t}" for n, t in new])

    def run(batches):
        path = vocabulary if os.sep in vocabulary else vocabulary_path(vocabulary)
        bpe = loaded(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in pieces(batches, passed.index("text"), chunk_bytes):
            done = bpe.batch([x or "" for x in batch.column(passed.index("text")).to_pylist()])
            cols = [batch.column(passed.index(c)) for c in kept]
            if texts:
                cols += [pa.array([[int(i) for i in d[1].split()] for d in done], pa.list_(pa.int32())), pa.array([d[2] for d in done], pa.string())]
            cols += [pa.array([d[0] for d in done], pa.int64()), pa.array([sha(d[1]) for d in done], pa.string()), pa.array([sha(d[2]) for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, kept + [n for n, _ in new])
        del bpe
        unload()
        give_back()

    return docs.select(*[f"`{c}`" for c in passed]).mapInArrow(run, schema)
