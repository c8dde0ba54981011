import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from wordreel.llm import packing
from wordreel.llm.base import tokenizer_file


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_runs_hold_every_rank_once_and_bins_are_gapless(lengths):
    counts = np.bincount(lengths, minlength=41)
    bins, seen = {}, set()
    for r in packing.best_two_fit(counts, 40):
        for rank in range(r.first, r.last):
            i = rank - r.first
            assert (r.length, rank) not in seen
            seen.add((r.length, rank))
            bins.setdefault(r.bin + i // r.each, []).append(
                (r.offset + i % r.each * r.length, r.length))
    assert len(seen) == len(lengths)
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 40


def test_smallest_gives_way_to_a_tighter_pair():
    # greedy: 6 + 3 leaves 1; 2 + 2 fills the gap of 4 that 3 leaves behind
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    first = {r.length: r for r in packing.best_two_fit(counts, 10) if r.bin == 0}
    assert set(first) == {6, 2} and first[2].each == 2


def test_pieces_of_a_long_document_are_whole_but_the_first():
    assert packing.piece_bounds(5, 2) == [(0, 1), (1, 3), (3, 5)]
    assert packing.piece_bounds(4, 2) == [(0, 2), (2, 4)]
    assert packing.piece_bounds(1, 2) == [(0, 1)]


def check(rows, docs, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = []
    for doc, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                 for i, (a, b) in enumerate(packing.piece_bounds(len(ids), size))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(r["length"] for r in rows)


def test_odd_rows(odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs.append((10, "ends <|endoftext|> early"))
    df = odd.select("doc_id", "text").unionByName(
        odd.sparkSession.createDataFrame(docs[-1:], "doc_id bigint, text string"))
    bins, ids = check(packing.pack(df, size=256).collect(), docs, 256)
    assert bins <= -(-ids // 256) + 1


def test_given_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    bins, ids = check(packing.pack(documents).collect(), docs, 2048)
    assert bins <= 1.02 * ids / 2048 + 1


def test_empty_table(empty):
    assert packing.pack(empty).collect() == []


def test_vocabulary_out_of_order_is_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_file("byte_bpe_50k.json")))
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        packing.byte_encoder(str(path))
