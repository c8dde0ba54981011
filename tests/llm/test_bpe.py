import hashlib
import random

import pytest
from tokenizers import Tokenizer

from wordreel.llm import bpe
from wordreel.llm.base import tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")
ODD = ["", "   ", "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|>x", "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ",
       "aaaaaaaaaaaaaaaaaa" * 50, "İstanbul ǅ ﬁ é Å", "it's we'll 'S DON'T", "\x85\xa0 x​y\x1cz",
       "😀👩‍👩‍👧 12345 ½ ٣", "a\0b \0<|endoftext|>", "é É", " ﻿|!!??"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    ranges = [(32, 127), (160, 0x250), (0x370, 0x500), (0x4e00, 0x4e80), (0x1f600, 0x1f640)]
    return ["".join(chr(32 if rng.random() < 0.3 else rng.randrange(*rng.choice(ranges)))
                    for _ in range(150)) for _ in range(n)]


def test_ids_and_text_as_the_library_has_them(library, documents):
    texts = ODD + random_texts(150) + [r["text"] for r in documents.limit(80).collect()]
    for text, words in zip(texts, bpe.Encoder(PATH).encoded(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for _, s, _ in words for i in s.split()] == ids
        assert " ".join(w[2] for w in words) == library.decode(ids, skip_special_tokens=False)


def test_a_cache_that_overflows_changes_nothing(monkeypatch):
    texts = ODD + random_texts(30, seed=2)
    whole = [[w[1] for w in words] for words in bpe.Encoder(PATH).encoded(texts)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "BATCH_WORDS", 7)
    assert [[w[1] for w in words] for words in bpe.Encoder(PATH).encoded(texts)] == whole


def test_one_merge_at_a_time_gives_the_same():
    v = bpe.Vocabulary(PATH)
    words = ["banana", "aaaa", "internationalisation", "x", "", "日本"] * 2
    together = [x.tolist() for x in v.encode(words)]
    v.together = False
    assert [x.tolist() for x in v.encode(words)] == together


def test_encode_and_decode(spark, library, odd, empty):
    out = bpe.decode(bpe.encode(odd))
    assert out.columns == [*odd.columns, "ids", "decoded"]
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty)).count() == 0
    strange = spark.createDataFrame([([10**6, -1, 5],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(strange).collect()] == [
        library.id_to_token(5), ""]


def test_digests(odd, library):
    for r in bpe.round_trip(odd).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_every_code_point_between_two_letters(library):
    """Also those that Python's Unicode tables and the library's class differently."""
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    chars += [chr(c) for c in range(0x20000, 0x110000, 4099)]
    texts = ["".join(f"a{c}b " for c in chars[i: i + 64]) for i in range(0, len(chars), 64)]
    encoded = library.encode_batch(texts, add_special_tokens=False)
    for words, want in zip(bpe.Encoder(PATH).encoded(texts), encoded):
        assert [int(i) for _, s, _ in words for i in s.split()] == want.ids
