import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wordreel.llm import align
from wordreel.llm.base import tokenizer_file
from wordreel.llm.words import byte_of_char

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
STRANGE = ["<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "▁", " ", "   x  y   ",
           "\0 a\0", "日本語 テキスト", "😀👩‍👩‍👧 é ﬁ", "tab\there\n\nand  there", "　x y",
           "a" * 3000, "՘₏ \U00010940", "x ", " \n", "é eࢗ̕"]


@pytest.fixture(scope="module")
def brute():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    of = byte_of_char()
    spell_a = {i: bytes(of[c] for c in t)
               for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}

    def spell_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def ends(ids, spell):
        out, n = {}, 0
        for i, x in enumerate(ids):
            n += len(spell(x))
            out[n] = i
        return out

    def one(text):
        """(ids of A and B group by group, links); none without tokens."""
        if not text:
            return [], [], 0, 0
        xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if (b"".join(map(spell_a.__getitem__, xs)) != whole
                or b"".join(map(spell_b, ys)) != whole):
            return [], [], 0, 0
        end_a, end_b = ends(xs, spell_a.__getitem__), ends(ys, spell_b)
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(end_a) & set(end_b)):
            groups.append((xs[i: end_a[e] + 1], ys[j: end_b[e] + 1]))
            i, j = end_a[e] + 1, end_b[e] + 1
            links.append((xs[i - 1], ys[j - 1]))
        return groups, links, len(xs), len(ys)

    def all_of(texts):
        each = [one(t) for t in texts]
        count = Counter(x for _, links, _, _ in each for x in links)
        most = Counter()
        for (_, y), n in count.items():
            most[y] = max(most[y], n)
        text = lambda g: ";".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        return [(n_a, n_b, len(g), len(links), sum(count[x] == most[x[1]] for x in links),
                 sum(count[x] for x in links),
                 hashlib.sha256(text(g).encode()).hexdigest() if g else "")
                for g, links, n_a, n_b in each], count, most

    return one, all_of


def figures(df):
    return {r["doc_id"]: tuple(r[c] for c in align.NEW) for r in df.collect()}


def check(spark, texts, all_of, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = align.Alignment(docs.repartition(4), **kw)
    want, count, most = all_of(texts)
    got = figures(made.documents())
    assert [got[i] for i in range(len(texts))] == want
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in made.pairs().collect()} == {
        k: (n, n == most[k[1]]) for k, n in count.items()}
    return made


def test_as_brute_force(spark, brute, documents):
    texts = STRANGE + [None, ""] + [r["text"] for r in documents.collect()]
    check(spark, texts, brute[1])


def test_many_small_blocks_and_levels(spark, brute, documents):
    """A block for every few records, so that runs are merged in several levels and
    answered in several groups."""
    texts = [r["text"][:300] for r in documents.filter("text IS NOT NULL").limit(60).collect()]
    made = check(spark, texts + ["the same words"] * 50, brute[1], slots=3, fan=3, block=40)
    assert made.blocks > 9


def test_levels(monkeypatch):
    monkeypatch.setattr(align, "FRAME", 2)
    rng = random.Random(2)
    runs, want = [], Counter()
    for _ in range(20):
        part = Counter(rng.choices(range(40), k=25))
        want.update(part)
        keys = sorted(part)
        runs.append(align.framed(*map(np.array, (keys, [part[k] for k in keys]))))
    assert dict(align.merged(runs)) == want
    assert [k for k, _ in align.merged(runs)] == sorted(want)
    once = [align.framed(*map(np.array, zip(*align.merged(runs[i: i + 6]))))
            for i in range(0, 20, 6)]
    assert dict(align.merged(once)) == want


def test_stretches_change_nothing(brute):
    one, _ = brute
    whole = align.Pair(A, B)
    texts = [" ".join(f"word{i} and  two" for i in range(200)), "a b" * 50 + " ", *STRANGE,
             " lead and trail ", "x\n y \n z w v"]
    for size in (1, 5, 64):
        cut = align.Pair(A, B, stretch=size)
        for t in texts:
            assert cut.measure(t)[0] == whole.measure(t)[0], t[:40]
            assert (cut.measure(t)[1] == whole.measure(t)[1]).all()
            assert cut.groups(t) == one(t)[0]


def test_every_code_point_of_the_first_plane(brute):
    one, _ = brute
    pair = align.Pair(A, B)
    chars = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000 and c != 0x2581]
    for i in range(0, len(chars), 400):
        text = "".join(f"a{c}b {c}{c}" for c in chars[i: i + 400])
        assert pair.groups(text) == one(text)[0], hex(ord(chars[i]))


def test_rows(spark, odd, empty, brute):
    out = align.align(odd)
    assert out.columns == [c for c in odd.columns if c != "text"] + list(align.NEW)
    want, _, _ = brute[1]([r["text"] for r in odd.collect()])
    assert sorted(tuple(r[c] for c in align.NEW) for r in out.collect()) == sorted(want)
    assert align.align(empty).count() == 0
    assert align.align(odd.select("text")).columns == list(align.NEW)
    clash = odd.withColumnRenamed("score", "n_best")
    assert align.align(clash).columns.count("n_best") == 1
    assert align.align(clash).filter("n_best < 0").isEmpty()
    shown = {r["text"]: r["groups"] for r in align.groups(odd).collect()}
    assert shown["a b c d"] == [(a, b) for a, b in brute[0]("a b c d")[0]] and shown[None] == []
