"""Spelling variants: words of a corpus that are one edit apart, found by k-d trees.

A word is a point: how often it has each letter. One replaced letter moves the
point by two steps, one down and one up; one letter more moves it by one step up.
So the words near a given one lie in a small range around it, and a k-d tree over
the points is searched by ranges, leaving out every box that the range does not
meet. Words are searched among those of their own length and of the next one, so
each pair is found once; the order of the letters decides in the end.

The tree has two levels. A tree for each length, fitted on a bounded sample of its
words, cuts the words into cells of some thousands; it only says which cell a word
lives in and which cells its range meets, so the result does not depend on the
sample. In each cell, one group of rows, a second tree leads to leaves of some
tens of words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordreel.session import settle

MIN_LENGTH = 6          # code points of a word
MIN_COUNT = 5           # occurrences of a word
RATIO = 5               # a form is at least so many times as frequent
SLIP = 199              # one run in so many loses a letter
HELD_WORDS = 200_000    # words whose counts a task holds before it hands them on
SAMPLE_WORDS = 200_000  # words that the upper trees are fitted on, in expectation
SAMPLE_LENGTH = 256     # longer words are in no sample: their lengths have no tree
CELL = 8192             # words to a cell, about
MAX_CELLS = 1 << 14     # beyond so many, cells grow: the trees go to every task
LEAF = 32               # words to a leaf of the tree in a cell
PAIR_BYTES = 1 << 24    # letters compared at once

# fixed value: the letters of a run, U+0041-005A, U+0061-007A, U+00C0-00FF, as Latin-1
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_LETTERS) else 32
              for b in range(256))
_DIMS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]     # letters after folding
_DIM_OF = np.zeros(256, np.int64)
_DIM_OF[_DIMS] = np.arange(len(_DIMS))


# --- counting words -------------------------------------------------------

def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters as Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_FOLD).split(b" ")


def utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def slipped(doc: str, run: bytes, modulus: int = SLIP) -> bytes:
    """The run, or what is left if the hash of document and run takes a letter."""
    h = zlib.crc32(utf8(run), zlib.crc32(f"{doc}:".encode()))
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of whole texts and their occurrences, counted in tasks first.

    A null text has no words; a null key counts as the empty string. Repeated
    rows are texts of their own.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("doc"),
                       F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            counts = pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1)):
                if not t.is_valid:
                    continue
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                found = Counter(w for w in runs_of(t.as_py()) if len(w) >= min_length)
                for w, n in found.items():
                    h = zlib.crc32(w if w.isascii() else utf8(w), start)
                    if h % SLIP == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_length:
                            continue
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield out()
        if held:
            yield out()

    counted = rows.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- points and trees -----------------------------------------------------

def letters(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def points(rows: np.ndarray) -> np.ndarray:
    """How often each letter stands in every row."""
    out = np.zeros((len(rows), len(_DIMS)), np.int32)
    for i in range(0, len(rows), step := max(1, (1 << 22) // max(1, rows.shape[1]))):
        part = rows[i: i + step]
        at = _DIM_OF[part] + np.arange(len(part))[:, None] * len(_DIMS)
        out[i: i + step] = np.bincount(at.ravel(), minlength=len(part) * len(_DIMS)).reshape(
            len(part), len(_DIMS))
    return out


@dataclass
class Node:
    """A box of points; a leaf has a number and the rows that it was made of."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    dim: int = -1
    at: int = 0
    leaf: int = -1
    sides: list[Node] = field(default_factory=list)


TOP = np.iinfo(np.int32).max


def grow(data: np.ndarray, leaf: int) -> tuple[Node, int]:
    """A tree over points with at most `leaf` to a box, if they can be told apart; its leaves."""
    root = Node(np.zeros(data.shape[1], np.int32), np.full(data.shape[1], TOP, np.int32),
                np.arange(len(data)))
    todo, leaves = [root], 0
    while todo:
        node = todo.pop()
        cut = _cut(data[node.rows]) if len(node.rows) > leaf else None
        if cut is None:
            node.leaf, leaves = leaves, leaves + 1
            continue
        node.dim, node.at = cut
        below = data[node.rows, node.dim] <= node.at
        for side in (below, ~below):
            child = Node(node.low.copy(), node.high.copy(), node.rows[side])
            if side is below:
                child.high[node.dim] = node.at
            else:
                child.low[node.dim] = node.at + 1
            node.sides.append(child)
        node.rows = node.rows[:0]
        todo += node.sides
    return root, leaves


def _cut(data: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the points most evenly; None if all are equal."""
    best, found = 0, None
    for at in range(min(int(data.max()), 4)):
        below = (data <= at).sum(axis=0)
        even = np.minimum(below, len(data) - below)
        dim = int(even.argmax())
        if even[dim] > best:
            best, found = int(even[dim]), (dim, at)
    if found:
        return found
    spread = data.max(axis=0) - data.min(axis=0)
    dim = int(spread.argmax())
    return (dim, int(data[:, dim].min())) if spread[dim] else None


def home(root: Node, data: np.ndarray) -> np.ndarray:
    """The leaf whose box holds each point."""
    out = np.zeros(len(data), np.int64)
    todo = [(root, np.arange(len(data)))]
    while todo:
        node, at = todo.pop()
        if node.leaf >= 0:
            out[at] = node.leaf
        elif len(at):
            below = data[at, node.dim] <= node.at
            todo += [(node.sides[0], at[below]), (node.sides[1], at[~below])]
    return out


def meets(root: Node, data: np.ndarray, down: int, up: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves and, for each, the points from which its box is at most `down` steps down
    and `up` steps up."""
    zero = np.zeros(len(data), np.int8)
    todo = [(root, np.arange(len(data)), zero, zero)]
    while todo:
        node, at, lost, won = todo.pop()
        if not len(at):
            continue
        if node.leaf >= 0:
            yield node, at
            continue
        x = data[at, node.dim]
        # what this letter has cost on the way here, and what it costs on either side
        old_down = np.maximum(x - node.high[node.dim], 0)
        old_up = np.maximum(node.low[node.dim] - x, 0)
        for side in node.sides:
            a = lost + np.maximum(x - side.high[node.dim], 0) - old_down
            b = won + np.maximum(side.low[node.dim] - x, 0) - old_up
            keep = (a <= down) & (b <= up)
            todo.append((side, at[keep], a[keep].astype(np.int8), b[keep].astype(np.int8)))


_TIMES = 3      # counts up to this have bits of their own


def bits(data: np.ndarray) -> np.ndarray:
    """128 bits to a point; two points differ in at most as many bits as they are steps apart.

    A bit is on if a letter stands at least so many times; where several share a
    bit it is their sum modulo two, so that every step still turns one bit at most.
    """
    out = np.zeros((len(data), 2), np.uint64)
    shared = 0
    for t in range(_TIMES):
        for dim in range(data.shape[1]):
            if dim < 26:        # a to z have bits of their own
                bit = 26 * t + dim
            else:
                bit = 26 * _TIMES + shared % (128 - 26 * _TIMES)
                shared += 1
            out[:, bit // 64] ^= (data[:, dim] > t).astype(np.uint64) << np.uint64(bit % 64)
    return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of `b`, as long or one longer, are rows of `a` after one edit."""
    n = a.shape[1]
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), step := max(1, PAIR_BYTES // max(1, n))):
        x, y = a[i: i + step], b[i: i + step]
        if b.shape[1] == n:
            out[i: i + step] = (x != y).sum(axis=1) == 1
        else:
            head, tail = x == y[:, :n], (x == y[:, 1:])[:, ::-1]
            same = lambda e: np.where(e.all(axis=1), n, e.argmin(axis=1))
            out[i: i + step] = same(head) + same(tail) >= n
    return out


def near_in_cell(queries: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (query, word) one edit apart; queries have one length, words that or one more."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not queries or not words:
        return none
    same = len(queries[0]) == len(words[0])
    q_rows, w_rows = letters(queries, len(queries[0])), letters(words, len(words[0]))
    q, w = points(q_rows), points(w_rows)
    q_bits, w_bits = bits(q), bits(w)
    left, right = [], []
    for node, at in meets(grow(w, LEAF)[0], q, 1 if same else 0, 1):
        for i in range(0, len(at), step := max(1, (1 << 20) // len(node.rows))):
            part = at[i: i + step]
            apart = np.bitwise_count(q_bits[part, 0][:, None] ^ w_bits[node.rows, 0])
            apart += np.bitwise_count(q_bits[part, 1][:, None] ^ w_bits[node.rows, 1])
            a, b = np.nonzero(apart <= (2 if same else 1))
            a, b = part[a], node.rows[b]
            ok = one_edit(q_rows[a], w_rows[b])
            left.append(a[ok])
            right.append(b[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else none


# --- cells of all words ---------------------------------------------------

_LEAVES = 1 << 20       # cells of a length have numbers below


class Cells:
    """Where words live and where their neighbours may: trees by length, and crowded cells."""

    def __init__(self, trees: dict[int, Node], crowded: dict[int, int]):
        self.trees, self.crowded = trees, crowded

    def homes(self, words: list[bytes], length: int) -> np.ndarray:
        tree = self.trees.get(length)
        leaf = home(tree, points(letters(words, length))) if tree else np.zeros(len(words), int)
        return length * _LEAVES + leaf

    def ranges(self, words: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray]]:
        """Cells, and the words that may have a neighbour there."""
        data = None
        for goal, down in ((length, 1), (length + 1, 0)):
            tree = self.trees.get(goal)
            if tree is None:
                yield goal * _LEAVES, np.arange(len(words))
                continue
            data = points(letters(words, length)) if data is None else data
            for node, at in meets(tree, data, down, 1):
                yield goal * _LEAVES + node.leaf, at


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
    n = batch.column(1).to_numpy()
    size = np.array([len(w) for w in words], np.int64)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        yield int(length), [words[i] for i in at], n[at]


def fit_cells(words: DataFrame, cell: int = CELL, sample: int = SAMPLE_WORDS) -> Cells:
    """Trees for the lengths with more words than a cell holds, from a sample by hash.

    What comes to the driver: a count for each length up to `SAMPLE_LENGTH`, about
    `sample` words, and the crowded cells (words that letters alone cannot part),
    each of which stands for many words.
    """
    size = F.length("word")
    short = words.filter(size <= SAMPLE_LENGTH)
    counts = {r["size"]: r["n"] for r in
              short.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cell = max(cell, sum(counts.values()) // MAX_CELLS)
    large = [s for s, n in counts.items() if n > cell]
    trees: dict[int, Node] = {}
    if large:
        share = min(1.0, sample / sum(counts[s] for s in large))
        spread = F.pmod(F.xxhash64("word"), F.lit(1_000_000))
        picked = short.filter(size.isin(large) & (spread < F.lit(int(share * 1e6) or 1)))
        seen: dict[int, list[bytes]] = {}
        for r in picked.select("word").collect():
            w = r["word"].encode("latin-1")
            seen.setdefault(len(w), []).append(w)
        for s, ws in seen.items():
            tree, leaves = grow(points(letters(ws, s)), max(1, int(len(ws) * cell / counts[s])))
            if leaves > 1:
                for node in _nodes(tree):
                    node.rows = node.rows[:0]
                trees[s] = tree
    cells = Cells(trees, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, ws, _ in _by_length(batch):
                at, n = np.unique(cells.homes(ws, length), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["cell", "n"])

    crowds = words.select("word", "n").mapInArrow(run, "cell bigint, n bigint").groupBy(
        "cell").agg(F.sum("n").alias("n")).filter(F.col("n") > 4 * cell)
    return Cells(trees, {r["cell"]: -(-r["n"] // cell) for r in crowds.collect()})


def _nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += node.sides


def _dealt(words: DataFrame, cells: Cells) -> DataFrame:
    """(cell, part, word, n, home): each word where it lives and where its range leads.

    A crowded cell has parts; a word lives in one of them and is looked for in all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, ws, n in _by_length(batch):
                texts = np.array([w.decode("latin-1") for w in ws], object)
                own = cells.homes(ws, length)
                salt = np.array([zlib.crc32(w) for w in ws], np.int64)
                parts = np.array([cells.crowded.get(c, 1) for c in own.tolist()], np.int64)
                yield _rows(own, salt % parts, texts, n, True)
                for cell, at in cells.ranges(ws, length):
                    for part in range(cells.crowded.get(cell, 1)):
                        # where a word lives its home row does the looking
                        go = at[(own[at] != cell) | (salt[at] % parts[at] != part)]
                        if len(go):
                            yield _rows(np.full(len(go), cell), np.full(len(go), part),
                                        texts[go], n[go], False)

    return words.select("word", "n").mapInArrow(
        run, "cell bigint, part bigint, word string, n bigint, home boolean")


def _rows(cell, part, texts, n, lives: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int64()), pa.array(part, pa.int64()), pa.array(texts, pa.string()),
         pa.array(n, pa.int64()), pa.array(np.full(len(n), lives))],
        ["cell", "part", "word", "n", "home"])


_FOUND = "word string, n_near bigint, best_n bigint, best string"


def _in_cell(table: pa.Table) -> pa.Table:
    """For every word of a cell's rows how many neighbours it has here and the best of them."""
    words = np.array([w.encode("latin-1") for w in table["word"].to_pylist()], object)
    n, lives = table["n"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
    size = np.array([len(w) for w in words], np.int64)
    own = np.flatnonzero(lives)
    left, right = [], []
    if len(own):
        goal = int(size[own[0]])
        for length in (goal, goal - 1):
            looking = np.flatnonzero(size == length)
            a, b = near_in_cell(words[looking].tolist(), words[own].tolist())
            a, b = looking[a], own[b]
            if length == goal:
                # two words of one length find each other twice if both live here, and
                # in each other's cell or part if not: one direction counts
                one = words[a] < words[b]
                a, b = a[one], b[one]
            left.append(a)
            right.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    of, to = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)       # by falling n, then by letters
    rank[np.lexsort((np.argsort(np.argsort(words, kind="stable"), kind="stable"), -n))] = \
        np.arange(len(words))
    order = np.lexsort((rank[to], of))
    of, to = of[order], to[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    many = np.diff(np.append(first, len(of)))
    text = lambda at: pa.array([words[i].decode("latin-1") for i in at], pa.string())
    return pa.table({"word": text(of[first]), "n_near": pa.array(many, pa.int64()),
                     "best_n": pa.array(n[to[first]]), "best": text(to[first])})


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) for the words of a written table (word, n) that have
    neighbours: how many, and the most frequent (of several the first by code points)."""
    cells = fit_cells(words, cell, sample)
    found = _dealt(words, cells).groupBy("cell", "part").applyInArrow(_in_cell, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): for a table (word, form) the end of every word's chain of forms.

    Every round doubles the steps looked ahead. A form is more frequent by a
    factor, so chains are as short as a logarithm of the largest count.
    """
    at = settle(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        went = settle(at.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "variant-roots")
        at = went.drop("moved")
        if went.filter("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                   cell: int = CELL, sample: int = SAMPLE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of all texts.

    Words are runs of letters with the hashed slips of `slipped`, at least
    `min_length` code points long and `min_count` times there. `n_near` counts
    words one edit away. `form` is the most frequent of them, if `ratio` times as
    frequent as the word; `root` the end of the chain of forms, the word itself
    if it has none. Null and empty texts and tables have no words; null keys
    count as the empty string; repeated rows count each time; words of any length
    take part whole. Other columns of `docs` are not read.
    """
    words = settle(word_counts(docs, key, text, min_length, min_count), "variant-words")
    near = near_words(words, cell, sample)
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "variant-forms")
    roots = follow(known.filter(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
