from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import count

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from scoreline.llm import common, near_copies, simhash, suffix_dedup
from scoreline.llm.components import connected_components
from tests.llm.fixtures import awkward, documents, nothing


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_a_long_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)]
    edges += [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(5, 5), (3000, 3000)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    assert found == {x: sets.find(x) for x in sets.up if x != 3000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_groups_are_those_of_all_pairs(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(60):
        base = [draw.choice(words) for _ in range(draw.randint(40, 400))]
        for _ in range(draw.randint(1, 8)):
            copy = list(base)
            for _ in range(draw.randint(0, 2)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "one", "one two", "One  two"]
    prints = [fingerprint(t) for t in texts]
    sets = Sets(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                sets.join(i, j)
    rows = documents(spark, texts)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(rows).collect()}
    assert found == {i: (f"{prints[i]:016x}", sets.find(i)) for i in range(len(texts))}
    kept = simhash.first_of_groups(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({sets.find(i) for i in range(len(texts))})


def test_a_bucket_full_of_fingerprints_links_all_of_them():
    free = np.arange(1 << 16, dtype=np.uint64)[::-1].copy()
    a, b = simhash.local_links(np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), free)
    assert len(a) == (1 << 16) - 1 and set(b) == {0}


def test_simhash_awkward_rows(spark):
    rows = awkward(spark)
    found = simhash.simhash_components(rows).collect()
    assert len(found) == rows.count()
    empty = [r for r in found if r.fingerprint == "0" * 16]
    assert len(empty) == 4 and {r.component_id for r in empty} == {1}
    assert sum(r.doc_id == 7 for r in simhash.first_of_groups(rows).collect()) == 2
    assert simhash.simhash_components(nothing(spark)).count() == 0
    assert simhash.first_of_groups(nothing(spark)).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def test_edited_copies_go_from_the_pipeline_and_less_similar_texts_stay(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts, far = [], 0
    for _ in range(40):
        base = [draw.choice(words) for _ in range(draw.randint(60, 400))]
        texts.append(" ".join(base))
        for share in (0.01, 0.015, 0.02, 0.06):
            copy = list(base)
            for at in draw.sample(range(len(copy)), max(1, round(share * len(copy)))):
                copy[at] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0], "", None, "one two", "One  two", "one three"]
    sets = [shingles(t) for t in texts]
    groups = Sets(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                groups.join(i, j)
                far += (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > simhash.DISTANCE
    assert far > 50
    rows = documents(spark, texts)
    kept = corpus_pipeline.near_duplicates(spark, rows, "")
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({groups.find(i) for i in range(len(texts))})


def near_groups(texts):
    """Kept ids by brute force: components of 5-word Jaccard of 0.8 or more over all pairs."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        size = min(5, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return label


@pytest.mark.parametrize("small, block", [(64, 256), (3, 5), (1, 4)])
def test_no_near_copies_stay_in_large_groups(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    texts = []
    for _ in range(90):  # a group about the limit of similarity, so that many stay in one bucket
        text = list(base)
        for at in draw.sample(range(120), draw.randint(1, 9)):
            text[at] = draw.choice(words)
        texts.append(" ".join(text))
    texts += [" ".join(draw.choices(words, k=60)) for _ in range(20)]
    rows = documents(spark, texts)
    kept = sorted(r.doc_id for r in near_copies.first_of_near_copies(rows).collect())
    label = near_groups(texts)
    alone = [i for i in range(len(texts)) if label[i] == i]
    assert set(alone) <= set(kept)  # the first of each component stays
    again = near_groups([texts[i] for i in kept])
    assert again == list(range(len(kept)))  # and no two that stay are similar


@pytest.mark.parametrize("seed", [3, 5, 7])
def test_groups_about_the_limit_keep_the_first_of_each_component(spark, seed):
    """Variants of one text, many of them similar to others only through a chain: what stays is
    the first of each component of all similar pairs, as brute force finds them, not what the order
    of the bucket leaders leaves."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    texts = []
    for _ in range(60):
        text = list(base)
        for at in draw.sample(range(120), draw.randint(1, 12)):
            text[at] = draw.choice(words)
        texts.append(" ".join(text))
    kept = sorted(r.doc_id for r in near_copies.first_of_near_copies(documents(spark, texts)).collect())
    label = near_groups(texts)
    assert kept == [i for i in range(len(texts)) if label[i] == i]


def test_tables_between_steps_go(spark, tmp_path, monkeypatch):
    made = count()
    monkeypatch.setattr(common, "fresh_dir", lambda spark, name: f"{tmp_path}/{name}-{next(made)}")
    rows = spark.createDataFrame([(i, f"{i % 3} b c d e f {i % 3} h i {i % 3}") for i in range(9)], "doc_id long, text string")
    assert near_copies.first_of_near_copies(rows).count() == 3
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"]
    with pytest.raises(ZeroDivisionError), common.passing(spark):
        common.cut(rows, "first")
        common.cut(rows, "second", stays=True)
        raise ZeroDivisionError
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["kept", "second"]


def test_near_copies_awkward_rows(spark):
    kept = near_copies.first_of_near_copies(awkward(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 7, 7, 8, 9] and len(kept) == 8
    assert near_copies.first_of_near_copies(nothing(spark)).count() == 0


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found_in(rows):
    return [
        (r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        for r in suffix_dedup.suffix_digests(rows).collect()
    ]


def test_suffix_dedup_removes_what_brute_force_removes(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdé ") for _ in range(draw.randint(150, 700))) for _ in range(8)]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(draw.randint(0, 4)):
            b, i = draw.choice(base), draw.randint(0, 60)
            parts += [b[i : len(b) - draw.randint(0, 60)], "".join(draw.choice("xy\n") for _ in range(draw.randint(0, 5)))]
        texts.append("".join(parts))
    texts += ["a" * 2000, "The " * 300, base[0], base[0], None, "", "é" * 100, "é" * 99]
    assert sorted(found_in(documents(spark, texts))) == sorted(enumerate(brute(texts)))


def test_suffix_dedup_awkward_rows(spark):
    rows = awkward(spark)
    key = lambda x: (x[0] or -1, x[1])
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    want = list(zip([i for i, _ in texts], brute([t for _, t in texts])))
    assert sorted(found_in(rows), key=key) == sorted(want, key=key)
    cut = suffix_dedup.without_repeats(rows)
    assert cut.columns == rows.columns and cut.count() == rows.count()
    assert suffix_dedup.suffix_digests(nothing(spark)).count() == 0


def test_long_texts_come_in_pieces_that_share_windows():
    draw = random.Random(1)
    text = bytes(draw.choice(b"abcdefgh") for _ in range(3 * suffix_dedup.SLICE_BYTES // 2))
    starts = []
    for _, offsets, pieces in suffix_dedup._pieces([text]):
        _, _, _, first, last = suffix_dedup.anchors_of(pieces)
        starts += [s + offsets[0] for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == list(range(len(text) - 199))
