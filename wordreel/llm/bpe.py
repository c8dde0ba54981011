"""Byte-pair encoding by merge rounds over many words at once.

The symbols of all new words of a batch stand in one flat array. In each round
the rank of every neighbouring pair is found by binary search over the sorted
pair keys, each word's lowest-ranked pair is merged, and words without a pair
that merges drop out. Words that were encoded before come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from wordreel.llm.base import attach, tokenizer_file
from wordreel.llm.packing import _byte_of_char
from wordreel.llm.words import Splitter, odd

CACHE_WORDS = 400_000       # words a task remembers before it starts anew
BATCH_WORDS = 100_000       # new words encoded together, at most
NEVER = np.iinfo(np.int64).max


class Vocabulary:
    """Pair ranks of a tokenizer file with byte-level letters and word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model.get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.vocab.items()} | {
            i: t for t, i in self.special.items()}
        self.size = max(self.token) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        # all places of a pair may merge in one round if no pair ranks before
        # the merges that make its parts
        created = np.full(self.size, -1, np.int64)
        np.maximum.at(created, made, np.arange(len(made)))
        self.together = bool((np.arange(len(made)) > np.maximum(created[left], created[right]))
                             .all())
        of_byte = {b: c for c, b in _byte_of_char().items()}
        self.inner = np.array([self.vocab[of_byte[b]] for b in range(256)], np.int64)
        self.last = np.array([self.vocab[of_byte[b] + self.end] for b in range(256)], np.int64)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word; an empty word has none."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(size)
        tail = ends[size > 0] - 1
        symbol[tail] = self.last[data[tail]]
        word = np.repeat(np.arange(len(words)), size)
        done_symbol, done_word = [], []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            same = (word[:-1] == word[1:]) & (self.key[at] == key)
            rank = np.where(same, self.rank[at], NEVER)
            best = np.full(len(words), NEVER, np.int64)
            np.minimum.at(best, word[:-1][same], rank[same])
            active = best[word] < NEVER
            hit = np.flatnonzero(same & (rank == best[word[:-1]]))
            if self.together:
                hit = _apart(hit)
            else:
                hit = hit[np.unique(word[hit], return_index=True)[1]]
            symbol[hit] = self.made[at[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            out = keep & ~active
            done_symbol.append(symbol[out])
            done_word.append(word[out])
            keep &= active
            symbol, word = symbol[keep], word[keep]
        if not done_word:
            return [np.zeros(0, np.int64)] * len(words)
        owner = np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(done_symbol)[order]
        return np.split(ids, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of runs of neighbouring places every other one, from the left."""
    if len(hit) < 2:
        return hit
    start = np.ones(len(hit), bool)
    start[1:] = hit[1:] != hit[:-1] + 1
    first = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
    return hit[(np.arange(len(hit)) - first) % 2 == 0]


class Encoder:
    """Texts to words to ids, with the words of earlier texts remembered."""

    def __init__(self, path: str, odd_chars: str | None = None):
        import regex

        self.vocabulary = Vocabulary(path)
        self.words_of = Splitter(path, odd(path) if odd_chars is None else odd_chars).words
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split \
            if special else None
        self.cache: dict[str, tuple[int, str, str]] = {}

    def words(self, text: str) -> list[str]:
        """Normalised words; special tokens stand for themselves, marked by a leading NUL."""
        parts = [text]
        if self.split and any(s in text for s in self.vocabulary.special):
            parts = self.split(text)
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append("\0" + part)
                continue
            out += self.words_of(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: count of ids, decimal ids, decoded tokens."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        new = sorted(w for w in words if w not in self.cache)
        token = self.vocabulary.token
        for i in range(0, len(new), BATCH_WORDS):
            part = new[i: i + BATCH_WORDS]
            for w, ids in zip(part, self.vocabulary.encode(part)):
                got = ids.tolist()
                if w[0] == "\0" and w[1:] in self.vocabulary.special:
                    got = [self.vocabulary.special[w[1:]]]
                self.cache[w] = (len(got), " ".join(map(str, got)),
                                 " ".join(map(token.__getitem__, got)))

    def encoded(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """Per text its words' entries. Texts are taken in groups of some megabytes."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.words(text))
            size += len(text)
            if size > 1 << 22:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[list[tuple[int, str, str]]]:
        self.learn({w for ws in group for w in ws if w not in self.cache}
                   if self.cache else {w for ws in group for w in ws})
        for ws in group:
            missing = {w for w in ws if w not in self.cache}     # gone if the cache was cleared
            if missing:
                self.learn(set(ws))
            yield [self.cache[w] for w in ws]


def encode(docs: DataFrame, text: str = "text", path: str | None = None,
           name: str = "ids") -> DataFrame:
    """`docs` with an array of token ids of a text; a null text has none, like an empty one."""
    path = path or tokenizer_file("word_bpe_49k.json")
    odd_chars = odd(path)

    def make():
        encoder = Encoder(path, odd_chars)

        def run(texts: list) -> list:
            return [[[int(i) for _, ids, _ in words for i in ids.split()]
                     for words in encoder.encoded([t or "" for t in texts])]]

        return run

    return attach(docs, text, make, [T.StructField(name, T.ArrayType(T.IntegerType()))])


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None,
           name: str = "decoded") -> DataFrame:
    """`docs` with the tokens of an array of ids, joined by spaces as the file names no decoder.

    Ids that the vocabulary does not have are left out; null decodes as empty.
    """
    path = path or tokenizer_file("word_bpe_49k.json")

    def make():
        token = Vocabulary(path).token
        return lambda rows: [[" ".join(token[i] for i in r or [] if i in token) for r in rows]]

    return attach(docs, ids, make, [T.StructField(name, T.StringType())])


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256 of a text.

    Digests are of the decimal ids joined by spaces and of the decoded text. A
    null text is an empty one: no tokens, digests of nothing. Repeated rows have
    equal digests.
    """
    path = path or tokenizer_file("word_bpe_49k.json")
    odd_chars = odd(path)

    def make():
        encoder = Encoder(path, odd_chars)

        def run(texts: list) -> tuple[list, list, list]:
            n, ids, decoded = [], [], []
            for words in encoder.encoded([t or "" for t in texts]):
                n.append(sum(w[0] for w in words))
                ids.append(_sha(" ".join([w[1] for w in words])))
                decoded.append(_sha(" ".join([w[2] for w in words])))
            return n, ids, decoded

        return run

    return attach(docs, text, make, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
