import random

import pytest
from tokenizers import Tokenizer

from wordreel.llm import counts, words
from wordreel.llm.base import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
ODD = ["", "   ", "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>x", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ",
       "a" * 5000, "İstanbul ǅ ﬁ é Å", "it's we'll 'S DON'T", "\x85\xa0 x​y\x1cz",
       "😀👩‍👩‍👧 12345 ½ ٣", "a\0b \0<|endoftext|>", "e̖ࢗ̕", "՘₏",
       "\U00010940\U00018d80 x", "\U00031350\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return counts.TokenCounter(PATH, words.odd(PATH))


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_as_many_as_the_library_has(library, counter, documents):
    rng = random.Random(4)
    ranges = [(32, 127), (160, 0x250), (0x370, 0x500), (0x4e00, 0x4e80), (0x10900, 0x11400)]
    texts = ["".join(chr(32 if rng.random() < 0.2 else rng.randrange(*rng.choice(ranges)))
                     for _ in range(120)) for _ in range(300)]
    for text in ODD + texts + [r["text"] for r in documents.limit(100).collect()]:
        assert counter(text) == n_tokens(library, text), text[:50]


def test_every_code_point(library, counter):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}{c}b " for c in chars[i: i + 64]) for i in range(0, len(chars), 64)]
    encoded = library.encode_batch(texts, add_special_tokens=False)
    assert [counter(t) for t in texts] == [len(e.ids) for e in encoded]


def test_a_count_is_symbols_less_merges(library):
    merges = counts.Merges(PATH)
    for word in ("internationalisation", "zzzzzzzzzzzzzzzzzzz", "x", "banana", "日本語", "qxjk"):
        got = merges.count(word.encode())
        assert got == n_tokens(library, word)


def test_long_words_and_texts_are_cut_at_spaces_only(library, counter, monkeypatch):
    text = " ".join(ODD) + " " + "ab" * 40_000 + " " + "the house " * 300
    whole = counter(text)
    assert whole == n_tokens(library, text)
    for size in (1, 7, 100):
        assert "".join(words.segments(text, size)) == text
        assert sum(counter._segment(s) for s in words.segments(text, size)) == whole


def test_a_cache_that_overflows_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(counts, "CACHE_CHARS", 40)
    small = counts.TokenCounter(PATH, words.odd(PATH))
    text = "one two three four five six seven one two three eight nine ten " * 3
    assert small(text) == n_tokens(library, text)
    assert small.held < 100


def test_rows(odd, empty, library):
    out = counts.count_tokens(odd, prefix="t_")
    assert out.columns == [*odd.columns, "t_n_bytes", "t_n_tokens", "t_over_limit"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        n = n_tokens(library, r["text"])
        assert (r["t_n_bytes"], r["t_n_tokens"], r["t_over_limit"]) == (
            len((r["text"] or "").encode()), n, n > 2048)
    assert any(r["t_over_limit"] for r in rows)
    assert counts.count_tokens(empty).count() == 0
    clash = odd.withColumnRenamed("node", "n_tokens").withColumnRenamed("th", "over_limit")
    assert counts.count_tokens(clash).columns.count("n_tokens") == 1
    assert counts.count_tokens(clash).filter("n_tokens < 0 OR over_limit IS NULL").isEmpty()
    with pytest.raises(ValueError):
        counts.count_tokens(odd.withColumnRenamed("text", "n_tokens"), text="n_tokens")
