"""Probability of a text with a lattice of subwords.

A word is its bytes behind a mark for the word's start. Every path of vocabulary
pieces through it is a segmentation, weighted by the product of the pieces'
unigram probabilities; a forward recursion in log space gives the sum of all of
them. The pieces are those of an existing vocabulary, with single bytes so that
any text has a path. Their weights start from the vocabulary's own order and are
fitted to the training words by expectation maximisation, that is by how often
each piece is expected to be used.

A training word is a piece of its own besides: its count, less a discount, is the
weight of the path that takes it whole, and the discounts together are the weight
of the paths through subwords. Groups of training documents (languages) have
weights of their own in the same way, above those of all; a document's
probability is the sum over groups, so nothing need be known of its group. All of
it is one distribution over texts, a text being its words and one end.

Words are counted once; what is computed for a word is computed once per
distinct word. The words that make up most of a corpus are sent to all tasks (how
many there can be is bounded by their share), the rest is joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordreel.llm.base import MIX1, MIX2, U64, Powers, tokenizer_file
from wordreel.session import settle

START = b"\xff"             # never part of UTF-8
SHARE = 2_000_000           # a word with more than 1/SHARE of all tokens is sent to all tasks
FLUSH = 300_000             # distinct words that a task counts before it hands them on
GROUPS = 7                  # groups of training documents with weights of their own
ROUNDS = 2
ELSEWHERE = 0.15            # part of a group's spare weight that goes to the words of all groups
SMOOTH = 0.1                # added to every piece's expected count


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


class Pieces:
    """The pieces of a sentencepiece file by hash, and their log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        named: list[tuple[float, bytes]] = []
        for i in range(model.vocab_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            text = model.id_to_piece(i)
            start = text.startswith("▁")
            rest = text[1:] if start else text
            raw = (START if start else b"") + rest.encode("utf-8").lower()
            if "▁" not in rest:
                named.append((-model.get_score(i), raw))
        best: dict[bytes, float] = {}
        for score, raw in sorted(named):
            best.setdefault(raw, score)
        for b in range(256):
            best.setdefault(bytes([b]), max(best.values(), default=0.0) + 1)
        self.pieces = list(best)
        self.longest = max(map(len, self.pieces))
        order = np.array(list(best.values()))
        weight = 1 / (order - order.min() + 10)         # the scores rank the pieces
        self.log_p = np.log(weight / weight.sum())
        self.powers = Powers()
        self.powers.reach(1 << 10)
        self.hash = np.array([self._raw(p) for p in self.pieces], U64)
        self._index()

    def _raw(self, piece: bytes) -> int:
        data = np.frombuffer(piece, np.uint8).astype(U64) + U64(1)
        return int((data * self.powers.up[: len(data)]).sum(dtype=U64))

    def _index(self) -> None:
        self.taken = np.zeros(1 << 20, bool)
        self.first = np.full(1 << 20, -1, np.int32)
        self.second = np.full(1 << 16, -1, np.int32)
        a, b = self._places(self.hash)
        for i in range(len(self.hash)):
            if self.first[a[i]] < 0:
                self.first[a[i]] = i
            elif self.second[b[i]] < 0:
                self.second[b[i]] = i
            else:
                raise ValueError("two pieces share both places of the index")
        self.taken[a] = True

    @staticmethod
    def _places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((raw * MIX1) >> U64(44)).view(np.int64), ((raw * MIX2) >> U64(48)).view(np.int64)

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a flat array holds hashes of pieces, and the numbers of those pieces."""
        at = np.flatnonzero(self.taken[((raw * MIX1) >> U64(44)).view(np.int64)])
        raw = raw[at]
        a, b = self._places(raw)
        piece, other = self.first[a], self.second[b]
        piece = np.where(self.hash[piece] == raw, piece, other)
        ok = (piece >= 0) & (self.hash[piece] == raw)
        return at[ok], piece[ok]

    def lattice(self, words: list[bytes]) -> Lattice:
        """All pieces in words of one length."""
        n, size = len(words), len(words[0]) + 1
        data = np.empty((size, n), U64)
        data[0] = START[0]
        data[1:] = np.frombuffer(b"".join(words), np.uint8).reshape(n, size - 1).T
        self.powers.reach(size + 1)
        sums = np.zeros((size + 1, n), U64)
        np.cumsum((data + U64(1)) * self.powers.up[:size, None], axis=0, dtype=U64, out=sums[1:])
        start, end, piece = [], [], []
        for l in range(1, min(size, self.longest) + 1):
            raw = (sums[l:] - sums[: size + 1 - l]) * self.powers.down[: size + 1 - l, None]
            at, found = self.find(raw.ravel())
            start.append(at)
            end.append(at + l * n)
            piece.append(found)
        end_of = np.concatenate(end)
        order = np.argsort(end_of, kind="stable")
        return Lattice(n, size, self.longest, np.concatenate(start)[order], end_of[order],
                       np.concatenate(piece)[order])


@dataclass(frozen=True)
class Lattice:
    """Pieces between places of n words of one size; place = position * n + word."""

    n: int
    size: int
    longest: int            # bytes of the longest piece
    start: np.ndarray
    end: np.ndarray         # ascending; single bytes reach every place
    piece: np.ndarray

    def _first(self) -> np.ndarray:
        """Where the pieces of every place but the words' starts begin, and the end of all."""
        return np.searchsorted(self.end, np.arange(self.n, self.n * (self.size + 1) + 1))

    def forward(self, log_p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths to every place."""
        n = self.n
        alpha = np.zeros(n * (self.size + 1))
        weight = log_p[self.piece]
        for t in range(self.size):
            a, b = first[t * n], first[(t + 1) * n]
            own = first[t * n: (t + 1) * n] - a
            x = alpha[self.start[a:b]] + weight[a:b]
            top = np.maximum.reduceat(x, own)
            x -= top[self.end[a:b] - (t + 1) * n]
            alpha[(t + 1) * n: (t + 2) * n] = top + np.log(np.add.reduceat(np.exp(x), own))
        return alpha

    def log_likelihood(self, *log_p: np.ndarray) -> list[np.ndarray]:
        """Log weight of every word, under each of several sets of weights."""
        first = self._first()
        return [self.forward(w, first)[-self.n:] for w in log_p]

    def expected(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over words that occur `times` times."""
        n, first = self.n, self._first()
        alpha = self.forward(log_p, first)
        share = np.exp(alpha[self.start] + log_p[self.piece] - alpha[self.end])
        visits = np.zeros(n * (self.size + 1))
        visits[-n:] = times
        for t in range(self.size - 1, -1, -1):
            a, b = first[t * n], first[(t + 1) * n]
            share[a:b] *= visits[self.end[a:b]]
            # a piece begins at most its own length before
            low = max(0, t + 1 - self.longest) * n
            visits[low: (t + 1) * n] += np.bincount(self.start[a:b] - low, share[a:b],
                                                    minlength=(t + 1) * n - low)
        return np.bincount(self.piece, share, minlength=len(log_p))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Batches put together, so that words of one length are many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def same_length(words: list[bytes], rows: int = 4_096) -> Iterator[np.ndarray]:
    """Indexes of words of one length, as many at a time as make a small lattice."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, cut):
        if not len(part):
            continue
        step = max(1, min(rows, 20 * rows // (int(size[part[0]]) + 1)))
        for i in range(0, len(part), step):
            yield part[i: i + step]


# --- counting and fitting -------------------------------------------------

def word_counts(docs: DataFrame, groups: int) -> DataFrame:
    """(word, everywhere, trained, c0, c1, ...) of (text, grp): tokens counted in tasks first.

    A null grp is held out: its words count in `everywhere` only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = [Counter() for _ in range(groups + 1)]       # the last is held out

        def flush() -> Iterator[pa.RecordBatch]:
            for g, c in enumerate(uses):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c.keys()), pa.binary()), pa.array([g] * len(c), pa.int32()),
                     pa.array(list(c.values()), pa.int64())], names=["word", "grp", "n"])
                c.clear()

        for batch in batches:
            for text, g in zip(batch.column(0), batch.column(1).to_pylist()):
                uses[-1 if g is None else g].update(tokens(text.as_py() or ""))
                if sum(map(len, uses)) > FLUSH:
                    yield from flush()
        yield from flush()

    counted = docs.select("text", "grp").mapInArrow(run, "word binary, grp int, n bigint")
    own = lambda g: F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0))
    return counted.groupBy("word").agg(
        F.sum("n").alias("everywhere"),
        F.sum(F.when(F.col("grp") < groups, F.col("n")).otherwise(0)).alias("trained"),
        *[own(g).alias(f"c{g}") for g in range(groups)])


def fit(words: DataFrame, path: str, groups: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces in each group, from its distinct trained words.

    Each round is one pass over the words; the driver gets one number per group
    and piece of the vocabulary.
    """
    start = Pieces(path).log_p
    log_p = np.tile(start, (max(groups, 1), 1))
    names = [f"c{g}" for g in range(groups)]
    for _ in range(rounds if groups else 0):
        sent = words.sparkSession.sparkContext.broadcast(log_p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(path)
            sums = np.zeros_like(sent.value)
            for batch in gathered(batches):
                ws = batch.column(0).to_pylist()
                for g in range(groups):
                    own = np.flatnonzero(batch.column(g + 1).to_numpy() > 0)
                    mine = [ws[i] for i in own]
                    for part in same_length(mine):
                        sums[g] += pieces.lattice([mine[i] for i in part]).expected(
                            sent.value[g], np.ones(len(part)))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(sums.ravel()[at])],
                names=["place", "uses"])

        got = (words.filter("trained > 0").select("word", *names)
               .mapInArrow(run, "place int, uses double")
               .groupBy("place").agg(F.sum("uses").alias("uses")).collect())
        uses = np.full(log_p.size, SMOOTH)
        for r in got:
            uses[r["place"]] += r["uses"]
        uses = uses.reshape(log_p.shape)
        log_p = np.log(uses / uses.sum(axis=1, keepdims=True))
    return log_p


def word_paths(words: DataFrame, log_p: np.ndarray, path: str) -> DataFrame:
    """`words` with q0, q1, ...: log10 of the sum over a word's segmentations, by group."""
    sent = words.sparkSession.sparkContext.broadcast(log_p)
    names = [f"q{g}" for g in range(len(log_p))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in gathered(batches):
            ws = batch.column(0).to_pylist()
            out = np.zeros((len(names), len(ws)))
            for part in same_length(ws):
                out[:, part] = pieces.lattice([ws[i] for i in part]).log_likelihood(*sent.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x / math.log(10)) for x in out]],
                names=[*batch.schema.names, *names])

    return words.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in words.dtypes)
                            + "".join(f", {n} double" for n in names))


def _log10_sum(terms: list[tuple[float, Column]]) -> Column:
    """log10 of the sum of weight * 10 ** column, without underflow."""
    top = F.greatest(*[c for _, c in terms]) if len(terms) > 1 else terms[0][1]
    return top + F.log10(sum((F.lit(w) * F.pow(F.lit(10.0), c - top) for w, c in terms[1:]),
                             F.lit(terms[0][0]) * F.pow(F.lit(10.0), terms[0][1] - top)))


@dataclass(frozen=True)
class Weights:
    """Totals behind the weights of whole words, of all training text and per group."""

    docs: tuple[int, ...]           # training documents per group
    tokens: tuple[int, ...]         # per group, ends included
    kinds: tuple[int, ...]          # distinct tokens per group
    all_kinds: int
    discount: float

    def all_tokens(self) -> int:
        return sum(self.tokens)

    def spare(self) -> float:
        """Weight of the paths through subwords."""
        return self.discount * self.all_kinds / self.all_tokens() if self.all_tokens() else 0.5

    def columns(self) -> list[Column]:
        """log10 weight of a word in each group (s0, s1, ...).

        A word seen in the group has its discounted count; the spare weight goes
        to the group's own paths and, for a part, to the weight that the word has
        in all training text, where all groups' paths share the spare weight.
        """
        d, n = self.discount, max(self.all_tokens(), 1)
        paths = _log10_sum([(c / max(sum(self.docs), 1), F.col(f"q{g}"))
                            for g, c in enumerate(self.docs)] or [(1.0, F.col("q0"))])
        paths = paths + math.log10(self.spare())
        general = F.when(F.col("trained") > 0, F.log10(
            (F.col("trained") - d) / n + F.pow(F.lit(10.0), paths))).otherwise(paths)
        if not self.docs:
            return [general.alias("s")]
        out = []
        for g, (t, k) in enumerate(zip(self.tokens, self.kinds)):
            rest = _log10_sum([(d * k / t * ELSEWHERE, general),
                               (d * k / t * (1 - ELSEWHERE), F.col(f"q{g}"))])
            out.append(F.when(F.col(f"c{g}") > 0, F.log10(
                (F.col(f"c{g}") - d) / t + F.pow(F.lit(10.0), rest))).otherwise(rest)
                .alias(f"s{g}"))
        return out

    def ends(self) -> list[float]:
        """log10 weight of the end in each group."""
        n, d = self.all_tokens(), self.discount
        every = max(sum(self.docs) - d, 0) / n if n else 0.5
        return [math.log10(max(c - d, 0) / t + d * k / t * ELSEWHERE * every)
                for c, t, k in zip(self.docs, self.tokens, self.kinds)]


def weights_of(words: DataFrame, docs: list[int]) -> tuple[Weights, int]:
    """Weights from counted words, and the number of all tokens, held out ones too."""
    groups = range(len(docs))
    got = words.agg(
        F.sum("everywhere").alias("all"), F.count_if(F.col("trained") > 0).alias("v"),
        F.count_if(F.col("trained") == 1).alias("n1"),
        F.count_if(F.col("trained") == 2).alias("n2"),
        *[F.sum(f"c{g}").alias(f"t{g}") for g in groups],
        *[F.count_if(F.col(f"c{g}") > 0).alias(f"v{g}") for g in groups]).first()
    n1, n2 = got["n1"], got["n2"]
    discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 else 0.5
    return Weights(tuple(docs), tuple((got[f"t{g}"] or 0) + docs[g] for g in groups),
                   tuple(got[f"v{g}"] + 1 for g in groups), got["v"] + (sum(docs) > 0),
                   discount), got["all"] or 0


# --- scoring --------------------------------------------------------------

def score(docs: DataFrame, held_out: Column, group: str | None = None, path: str | None = None,
          text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Only rows that are not `held_out` are learned from; `group` names a column
    that groups them (its most frequent values and one group for the rest), which
    is not looked at when a document is scored. n_tokens counts the words and one
    end; n_known those that occur in training, train_tokens all training tokens.
    base_score is the add-one unigram log10 probability, score the model's. A null
    text is an empty one: only its end counts. Without training rows only the
    vocabulary's own weights count. Repeated rows are scored each.
    """
    path = path or tokenizer_file("piece_bpe_32k.model")
    sc = docs.sparkSession.sparkContext
    named = F.lit("") if group is None else F.coalesce(F.col(group).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"),
                       held_out.alias("held_out"), named.alias("name"))
    by_name = rows.filter(~F.col("held_out")).groupBy("name").count()
    top = by_name.orderBy(F.desc("count"), "name").limit(GROUPS).collect()
    rest = (by_name.agg(F.sum("count")).first()[0] or 0) - sum(r["count"] for r in top)
    docs_of = [r["count"] for r in top] + [rest] * (rest > 0)
    docs_n = sum(docs_of)
    number = F.lit(len(top))
    for i, r in enumerate(top):
        number = F.when(F.col("name") == r["name"], F.lit(i)).otherwise(number)
    rows = rows.withColumn("grp", F.when(~F.col("held_out"), number).cast("int"))

    counts = settle(word_counts(rows, len(docs_of)), "words")
    model, all_tokens = weights_of(counts, docs_of)
    train_tokens = model.all_tokens()
    base_log = math.log10(train_tokens + model.all_kinds + 1)
    names = ["known", "base", *([f"s{g}" for g in range(len(docs_of))] or ["s"])]
    scored = settle(word_paths(counts, fit(counts, path, len(docs_of), rounds), path).select(
        "word", "everywhere", (F.col("trained") > 0).cast("double").alias("known"),
        (F.log10(F.col("trained") + 1) - base_log).alias("base"), *model.columns()
    ).select("word", "everywhere", *names), "word-scores")

    # fewer than SHARE words can each have more than 1/SHARE of the tokens
    often = F.col("everywhere") * SHARE > F.lit(all_tokens)
    local = scored.filter(often).drop("everywhere").toArrow()
    table = sc.broadcast((local["word"].to_pylist(),
                          np.column_stack([local[n].to_numpy() for n in names])
                          if local.num_rows else np.zeros((0, len(names)))))
    end = np.array([float(docs_n > 0), math.log10(docs_n + 1) - base_log,
                    *(model.ends() or [math.log10(0.5)])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, value = table.value
        place = {w: i for i, w in enumerate(words)}
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                n, sums, rare, times = [], [], [], []
                for t in batch.column(2):
                    uses = Counter(tokens(t.as_py() or ""))
                    at = np.fromiter((place.get(w, -1) for w in uses), np.int64, len(uses))
                    c = np.fromiter(uses.values(), np.int64, len(uses))
                    hit = at >= 0
                    n.append(int(c.sum()) + 1)
                    sums.append((end + c[hit] @ value[at[hit]]).tolist())
                    left = np.flatnonzero(~hit)
                    all_words = list(uses)
                    rare.append([all_words[j] for j in left])
                    times.append(c[left].tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                     pa.array(sums, pa.list_(pa.float64())), pa.array(rare, pa.list_(pa.binary())),
                     pa.array(times, pa.list_(pa.int64()))],
                    names=["doc_id", "held_out", "n_tokens", "sums", "rare", "times"])

    kind = dict(docs.select(F.col(key).alias("k")).dtypes)["k"]
    parts = settle(rows.select("doc_id", "held_out", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, sums array<double>, "
             "rare array<binary>, times array<bigint>")
        .withColumn("rid", F.monotonically_increasing_id()), "document-parts")

    rare = parts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "rid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(scored.filter(~often).drop("everywhere"), "word").groupBy("rid").agg(
        *[F.sum(F.col("times") * F.col(n)).alias(f"r_{n}") for n in names])
    total = {n: F.element_at("sums", i + 1) + F.coalesce(f"r_{n}", F.lit(0.0))
             for i, n in enumerate(names)}
    shares = [math.log10(c / docs_n) for c in docs_of] or [0.0]
    of_group = F.array(*[total[n] + s for n, s in zip(names[2:], shares)])
    out = parts.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", total["known"].cast("bigint").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        total["base"].alias("base_score"), of_group.alias("of_group"))
    top_of = F.array_max("of_group")
    return out.withColumn("score", top_of + F.log10(F.aggregate(
        "of_group", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - top_of)))
    ).drop("of_group")
