import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wordreel.llm import variants

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rows, min_length=6, min_count=5):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows):
    n = words_of(rows)
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def made_rows():
    """Chains of spellings, ties, anagrams, words of one letter set, long words."""
    base = {"colour": 700, "color": 900, "colors": 150, "colorz": 30, "colorzz": 6, "colours": 140,
            "centre": 40, "center": 40, "centrs": 8, "listen": 50, "silent": 50, "enlist": 9,
            "tinsel": 5, "ÀÉîõü÷": 60, "àÉîõü÷": 12, "théâtre": 30, "theâtre": 6, "aaaaaa": 5,
            "aaaaaaa": 25, "aaaaaaaa": 125, "x" * 700: 5, "x" * 699 + "y": 25, "x" * 701: 6}
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(base.items())]
    rows += [(None, "Colour, COLOUR! 1centre2 naïveté" * 3), (5, None), (6, ""), (7, "... 12"),
             (8, "the colourful colours"), (8, "the colourful colours")]
    return rows


@pytest.mark.parametrize("cell", [variants.CELL, 2])
def test_made_words(spark, cell):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = variants.group_variants(docs, cell=cell).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == expected(rows)
    assert any(r["form"] and r["root"] != r["form"] for r in got)       # chains of two and more


def test_anagrams_that_no_letter_count_parts(spark):
    """Hundreds of words with the same letters crowd one cell, which is cut into parts."""
    rng = np.random.default_rng(3)
    letters = list("aabbccdd")
    rows = [(i, " ".join(["".join(rng.permutation(letters))] * 5)) for i in range(400)]
    rows += [(i, t.replace("a", "b", 1)) for i, t in rows[:100]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = variants.settle(variants.word_counts(docs), "t")
    cells = variants.fit_cells(words, cell=16)
    assert cells.crowded
    got = variants.group_variants(docs, cell=16).collect()
    assert {tuple(r) for r in got} == expected(rows)
    assert sum(r["n_near"] for r in got) > 0


def test_pairs_in_a_cell():
    rng = np.random.default_rng(0)
    made = sorted({bytes(rng.choice(list(b"abcde\xe9"), rng.integers(6, 9)).tolist())
                   for _ in range(1500)})
    by = {n: [w for w in made if len(w) == n] for n in (6, 7, 8)}
    for n, m in ((6, 6), (6, 7), (7, 8)):
        a, b = variants.near_in_cell(by[n], by[m])
        want = {(x, y) for x in by[n] for y in by[m] if is_near(x, y)}
        pairs = [(by[n][i], by[m][j]) for i, j in zip(a, b)]
        assert set(pairs) == want and len(pairs) == len(want) > 0
    assert len(variants.near_in_cell([], by[6])[0]) == 0


def test_bits_are_a_lower_bound():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 6, (60, 90)).astype(np.int32)
    data[1::2] = data[::2] + (rng.random((30, 90)) < 0.03)
    b = variants.bits(data)
    for i in range(0, 60, 2):
        steps = abs(data[i] - data[i + 1]).sum()
        assert np.bitwise_count(b[i] ^ b[i + 1]).sum() <= steps


def test_trees_hold_every_point_once():
    data = np.random.default_rng(2).integers(0, 3, (500, 90)).astype(np.int32)
    root, leaves = variants.grow(data, 10)
    at = variants.home(root, data)
    assert set(at) == set(range(leaves))
    for node in variants._nodes(root):
        if node.leaf >= 0:
            assert (at[node.rows] == node.leaf).all() and len(node.rows) <= 10
            assert ((data[node.rows] >= node.low) & (data[node.rows] <= node.high)).all()


def test_no_words_and_other_columns(spark, odd, empty):
    assert variants.group_variants(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in variants.group_variants(odd).collect()} == expected(rows)


def test_slip_takes_the_letter_its_hash_names():
    for i in range(2000):
        h = zlib.crc32(f"{i}:naïveté".encode())
        want = "naïveté" if h % 199 else "naïveté"[:h % 7] + "naïveté"[h % 7 + 1:]
        assert variants.slipped(str(i), "naïveté".encode("latin-1")) == want.encode("latin-1")
