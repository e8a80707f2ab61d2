from __future__ import annotations

import random

from scoreline.llm import suffix_dedup


def test_a_long_text_is_cut_whatever_stands_beside_it():
    draw = random.Random(2)
    texts = [b"", draw.randbytes(3_000_000), b"", draw.randbytes(300), draw.randbytes(400), b"short"]
    starts = {i: [] for i in range(len(texts))}
    for rows, offsets, pieces in suffix_dedup._pieces(texts):
        assert sum(map(len, pieces)) <= suffix_dedup.SLICE_BYTES + suffix_dedup.LENGTH - 1
        data, piece, _, first, last = suffix_dedup.anchors_of(pieces)
        begins = [sum(map(len, pieces[:k])) for k in range(len(pieces))]
        for k, a, b in zip(piece.tolist(), first.tolist(), last.tolist()):
            starts[rows[k]] += [s - begins[k] + offsets[k] for s in range(a, b + 1)]
    assert all(sorted(starts[i]) == list(range(max(0, len(t) - 199))) for i, t in enumerate(texts))
