"""Language by compression: the language whose text helps most to compress a text.

For every language a zstandard compressor holds raw text of that language as
dictionary. A text is lower-cased, reduced to letters and spaces and compressed
in blocks with each of them; the smallest total wins. Blocks keep the dictionary
in reach all through a long text. Sizes are whole bytes, which says little about a
short text: where they tie, the bits that the trigrams of the same dictionaries give
to its bytes decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wordreel.llm.base import attach, bounded_sample

UNKNOWN = "und"
DICTIONARY_BYTES = 112_640      # raw text per language, sent to every task
SAMPLE_DOCS = 400               # training documents per language, about
SAMPLE_CHARS = 4_096            # of each of them, of which the dictionary takes a share
LEAST_DOCS = 16                 # of each language, however many there are
MODEL_BYTES = 48 << 20          # raw text of all languages together; many share it
BLOCK = 4_096
LEVEL = 6
MIN_MARGIN = 0.004              # relative size difference below which a text is rejected

_DROP = bytes(b for b in range(128) if not chr(b).isalpha() and b not in b" \n\r\t")
_SPACE = bytes.maketrans(b"\n\r\t", b"   ")
_LETTER = re.compile(r"[^\W\d_]")


def letters(text: str) -> bytes:
    """Lower case, without ASCII digits and signs, white space as spaces."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE, _DROP)


class Trigrams:
    """Bits of a text by how often its three-byte strings stand in a dictionary."""

    def __init__(self, raw: bytes):
        code = self.codes(raw)
        self.three, self.n_three = np.unique(code, return_counts=True)
        self.two, self.n_two = np.unique(code >> 8, return_counts=True)

    @staticmethod
    def codes(data: bytes) -> np.ndarray:
        x = np.frombuffer(b"  " + data + b" ", np.uint8).astype(np.int64)
        return (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]

    @staticmethod
    def _count(names: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(names, of), len(names) - 1)
        return np.where(names[at] == of, n[at], 0)

    def bits(self, data: bytes) -> float:
        code = self.codes(data)
        three = self._count(self.three, self.n_three, code)
        two = self._count(self.two, self.n_two, code >> 8)
        return float(-np.log2((three + 1 / 8) / (two + 32)).sum())


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, most frequent language first (it wins ties)."""

    dictionaries: tuple[tuple[str, bytes], ...]


def train(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text",
          key: str = "doc_id", sample_docs: int = SAMPLE_DOCS,
          dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries from a bounded sample of the rows that may be learned from.

    About `sample_docs` documents of each language and `SAMPLE_CHARS` characters of
    each document reach the driver; all of them share the dictionary of their
    language. Every language has one: where there are so many that the dictionaries
    would be more than `MODEL_BYTES` together, they and the samples are smaller.
    """
    rows = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_"), F.col(lang).alias("l_"),
                       learn.alias("learn_"))
    rows = rows.filter("learn_ AND l_ IS NOT NULL AND t_ IS NOT NULL").drop("learn_")
    # the counts that rank languages come from all rows, the text from the sample
    ranked = rows.groupBy("l_").count().orderBy(F.desc("count"), "l_").collect()
    share = min(1.0, MODEL_BYTES / (max(1, len(ranked)) * dictionary_bytes))
    dictionary_bytes = max(64, int(dictionary_bytes * share))
    sample = bounded_sample(rows.filter(rows.t_.rlike(r"\p{L}")), "l_", F.col("k_"),
                            max(LEAST_DOCS, int(sample_docs * share)), max(1, len(ranked)))
    got: dict[str, list[tuple[int, str]]] = {}
    # a slice from anywhere in the text, so that what long texts hold later is learned too
    room = F.greatest(F.length("t_") - SAMPLE_CHARS, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64("k_", F.lit("slice")), room) + 1).cast("int")
    for k, t, l in sample.select(F.xxhash64("k_").alias("k"),
                                 F.substring(F.col("t_"), begin, F.lit(SAMPLE_CHARS)),
                                 "l_").collect():
        got.setdefault(l, []).append((k, t))
    out = []
    for l in (r["l_"] for r in ranked):
        text_of = shared([letters(t) for _, t in sorted(got.get(l, []))], dictionary_bytes)
        if text_of:
            out.append((l, text_of))
    return Model(tuple(out))


def shared(texts: list[bytes], room: int) -> bytes:
    """The texts side by side within `room` bytes: all have a part of it, and what short ones
    leave goes to the longer ones."""
    part, left = [0] * len(texts), room
    for n, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        part[i] = max(min(len(texts[i]), left // (len(texts) - n) - 1), 0)
        left -= part[i] + 1
    return b" ".join(t[:k] for t, k in zip(texts, part))[:room]


def predictor(model: Model, min_margin: float = MIN_MARGIN):
    """A function from texts to (language, score, margin, rejected) columns."""
    import zstandard

    named = []
    for lang, raw in model.dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        named.append((lang, zstandard.ZstdCompressor(
            level=LEVEL, dict_data=d, write_content_size=False)))

    trigrams: dict[int, Trigrams] = {}      # of the languages that a tie has asked for

    def bits(i: int, data: bytes) -> float:
        if i not in trigrams:
            trigrams[i] = Trigrams(model.dictionaries[i][1])
        return trigrams[i].bits(data)

    def one(text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not named or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = letters(text)
        sizes = [0] * len(named)
        for at in range(0, max(len(data), 1), BLOCK):
            block = data[at: at + BLOCK]
            for i, (_, c) in enumerate(named):
                sizes[i] += len(c.compress(block))
        order = sorted(range(len(named)), key=sizes.__getitem__)
        if len(order) == 1:
            return named[order[0]][0], 1.0, 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / second
        if margin < min_margin and best * min_margin < 1:       # less than a byte apart
            fine = {i: bits(i, data) for i in order if (sizes[i] - best) / sizes[i] < min_margin}
            order = sorted(sorted(fine), key=fine.__getitem__)
            best, second = fine[order[0]], fine[order[1]]
            margin = (second - best) / second
        return named[order[0]][0], min(1.0, 0.5 + 2.5 * margin), margin, margin < min_margin

    def many(texts: list) -> tuple[list, ...]:
        return tuple(zip(*map(one, texts))) if texts else ([], [], [], [])

    return many


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "",
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` with lang_pred, score, margin and rejected (names after `prefix`).

    Null texts and texts without a letter are ``und``, score 0, rejected; so is
    every text if nothing could be learned. Where sizes below 1 / min_margin bytes
    tie, margin is that of the trigram bits. What ties then too goes to the language
    with more training rows, with margin 0 (rejected). Score is 0.5 for no margin and
    1 from a fifth on. Repeated rows are predicted each.
    """
    fields = [T.StructField(f"{prefix}lang_pred", T.StringType()),
              T.StructField(f"{prefix}score", T.DoubleType()),
              T.StructField(f"{prefix}margin", T.DoubleType()),
              T.StructField(f"{prefix}rejected", T.BooleanType())]
    return attach(docs, text, lambda: predictor(model, min_margin), fields)
