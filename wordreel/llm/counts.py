"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a word form a linked list, its neighbouring pairs a heap by rank
and place. The lowest-ranked pair is taken from the heap and merged as long as
there is one; pairs that have lost a side meanwhile are passed over. A word has as
many tokens as it had bytes, less one for every merge; no list of identifiers
is ever made. A word of n bytes costs n log n, whatever it looks like.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame, functions as F, types as T

from wordreel.llm.base import attach, tokenizer_file
from wordreel.llm.words import Splitter, byte_of_char, odd, segments

LIMIT = 2048                # tokens beyond which a text is marked
CACHE_CHARS = 16 << 20      # code points of words whose counts a task remembers
CACHED_WORD = 64            # longer words are counted anew every time


class Merges:
    """The merges of a tokenizer file: symbol pair -> rank and the symbol they make."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        of_byte = {b: c for c, b in byte_of_char().items()}
        end = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.inner = [ids[of_byte[b]] for b in range(256)]
        self.last = [ids[of_byte[b] + end] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(ids.values()) + 1
        self.rank = {ids[a] * self.width + ids[b]: (rank, ids[a + b])
                     for rank, (a, b) in reversed(list(enumerate(pairs)))}

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        n = len(word)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, width = self.rank, self.width
        heap = []
        for i in range(n - 1):
            pair = symbol[i] * width + symbol[i + 1]
            if pair in rank:
                heap.append((rank[pair][0], i, pair))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            # symbols that are merged away hold -1 and match no pair
            if symbol[i] < 0 or j >= n or symbol[i] * width + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = rank[pair][1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                pair = symbol[i] * width + symbol[k]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair][0], i, pair))
            h = before[i]
            if h >= 0:
                pair = symbol[h] * width + symbol[i]
                if pair in rank:
                    heapq.heappush(heap, (rank[pair][0], h, pair))
        return left


class TokenCounter:
    """text -> number of tokens; counts of short words are remembered up to a bound."""

    def __init__(self, path: str, odd_chars: str):
        self.merges = Merges(path)
        self.splitter = Splitter(path, odd_chars)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}
        self.held = 0

    def __call__(self, text: str) -> int:
        return sum(self._segment(s) for s in segments(text))

    def _segment(self, text: str) -> int:
        if self.special:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        words = self.splitter.words(text)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            return sum(self._word(w) for w in words)

    def _word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.merges.count(word.encode("utf-8"))
            if len(word) <= CACHED_WORD:
                if self.held > CACHE_CHARS:
                    self.known.clear()
                    self.held = 0
                self.known[word] = n
                self.held += len(word) + 8
        return n


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None,
                 limit: int = LIMIT, prefix: str = "") -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit of a text, behind `prefix`.

    Tokens are those that the tokenizers library gives for the file, without
    tokens put around a text, truncation or padding. A special token's spelling
    inside a text is that token, as is the library's default. A null text is an
    empty one: no bytes, no tokens. Every row has its own result, repeated rows
    and null keys too; all other columns stay, and a new column takes the place
    of one that has its name. An empty table stays empty.
    """
    path = path or tokenizer_file("word_bpe_49k.json")
    odd_chars = odd(path)
    new = [f"{prefix}n_bytes", f"{prefix}n_tokens", f"{prefix}over_limit"]
    if text in new:
        raise ValueError(f"the text column cannot be called {text!r}; give a prefix")

    def make():
        counter = TokenCounter(path, odd_chars)
        return lambda texts: [[counter(t) if t else 0 for t in texts]]

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    done = attach(kept, text, make, [T.StructField(new[1], T.LongType())])
    n = F.col(f"`{new[1]}`")
    return done.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias(new[0]),
        n, (n > limit).alias(new[2]))
