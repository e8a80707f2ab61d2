from __future__ import annotations

import hashlib
import random

import pytest

from scoreline.llm import bpe_codec, token_counts
from scoreline.llm.bpe_merge import merge_symbols
from scoreline.llm.pretokens import chunks
from scoreline.llm.queries import vocabulary_path
from tests.llm.fixtures import awkward, nothing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def random_texts():
    draw = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "中", "1", "\x1c", "\x85", "!", "<|endoftext|>", "՘",
             "࢏", "\U0001f600", "'ll", "\r", "\x00", "Ⅷ", " a", "the", "THE"]
    yield from ("".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(800))
    yield from ("", "a" * 5000, "ab " * 150_000, "  " * 200_000 + "x")


def test_counts_and_codes_are_those_of_the_library(library):
    counter, codec = token_counts.Counter(vocabulary_path()), bpe_codec.Codec(vocabulary_path())
    for text in random_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert counter.count(text) == len(ids)
        assert codec.encode(text) == ids and codec.decode(ids) == decoded
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        assert codec.digests(text) == (len(ids), *want)


def test_merging_takes_the_lowest_rank_first_and_the_leftmost_of_equals():
    ranks, merged = {1 << 16 | 2: 0, 9 << 16 | 1: 1, 9 << 16 | 9: 2}, [9, 8, 7]
    ids = [1, 2, 1, 2, 1]
    assert merge_symbols(ids, ranks, merged) == 3
    assert [i for i in ids if i >= 0] == [9, 8]


def test_chunks_join_to_the_text():
    for text in random_texts():
        assert "".join(p for parts in chunks(text) for p in parts) == text


def test_awkward_rows(spark, library):
    rows = awkward(spark)
    want = sorted((r.doc_id or -1, len(library.encode(r.text or "").ids)) for r in rows.collect())
    found = token_counts.token_counts(rows, vocabulary_path(), limit=5).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in found)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in bpe_codec.digests(rows, vocabulary_path()).collect()) == want
    round_trip = bpe_codec.decode(bpe_codec.encode(rows, vocabulary_path()), vocabulary_path()).collect()
    assert sorted((r[0] or -1, r[1]) for r in round_trip) == sorted((r.doc_id or -1, r.text or "") for r in rows.collect())
    for f in (token_counts.token_counts, bpe_codec.encode, bpe_codec.digests):
        assert f(nothing(spark), vocabulary_path()).count() == 0
