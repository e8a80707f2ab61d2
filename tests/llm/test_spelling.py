from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from scoreline.llm import spelling
from tests.llm.fixtures import awkward, documents, nothing


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    forms = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 10 * words[w]:
                forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words[forms[w]] if w in forms else None))
    return sorted(out)


def found_in(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, spelling.spelling_variants(df).collect()))


def edited(draw, word, letters):
    at, kind = draw.randrange(len(word)), draw.randrange(3)
    new = draw.choice(letters)
    return word[:at] + (new if kind < 2 else "") + word[at + (kind != 0) :]


def test_all_near_words_of_a_small_alphabet(spark):
    draw = random.Random(5)
    for letters in ("ab", "aéèz÷", "abcdefghijklmnopqrstuvwxyzàÿ"):
        words = ["".join(draw.choices(letters, k=draw.randint(7, 10))) for _ in range(150)]
        words += [edited(draw, w, letters) for w in words]
        rows = [(i, " ".join(draw.choices(words, k=60))) for i in range(60)] + [(None, " ".join(words[:40]))] * 2
        want = brute_force(rows)
        assert len(want) > 60 and sum(r[4] for r in want) > 20
        assert found_in(spark, rows) == want


def test_words_longer_than_those_that_are_carried(spark):
    draw = random.Random(6)
    base = ["".join(draw.choices("xyz", k=k)) for k in (62, 63, 64, 65, 66, 500)]
    words = base + [edited(draw, w, "xyz") for w in base for _ in range(4)] + ["a" * 20_000, "a" * 20_001]
    rows = [(i, " ".join(words)) for i in range(3)]
    want = brute_force(rows)
    assert sum(r[4] for r in want) >= 20 and any(len(r[0]) == 20_000 and r[4] for r in want)
    assert found_in(spark, rows) == want


def test_forms_are_followed_to_the_root(spark):
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdkfji", "abldkfji"]  # each ten times as frequent as the next
    rows = [(10 * i + k, f"{w} " * n) for k, w in enumerate(chain) for i, n in enumerate([20_000 // 10**k])]
    got = found_in(spark, rows)
    assert got == brute_force(rows)
    assert {r[2] for r in got if r[0] in chain} == {"abcdefgh"}


def test_ties_take_the_smallest_word(spark):
    rows = [(1, "bcdefgh " * 40 + "acdefgh " * 40 + "écdefgh " * 40 + "ccdefgh ccdefgh")]
    got = {r[0]: r for r in found_in(spark, rows)}
    assert got["ccdefgh"][1] == "acdefgh" and got["ccdefgh"][4] == 3
    assert sorted(got.values()) == brute_force(rows)


def test_spelling_awkward_rows(spark):
    rows = awkward(spark)
    assert sorted(map(tuple, spelling.spelling_variants(rows).collect())) == brute_force(
        [(r.doc_id, r.text) for r in rows.collect()]
    )
    assert spelling.spelling_variants(nothing(spark)).count() == 0
    one = documents(spark, ["Nothing twice", None, ""])
    assert spelling.spelling_variants(one).count() == 0
