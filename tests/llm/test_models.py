from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from scoreline.llm import lm, quality_rules, toxicity, weak_labels
from scoreline.llm.boosting import fit_trees
from scoreline.llm.statistics import statistics, statistics_of
from tests.llm.fixtures import awkward, nothing

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_statistics_are_those_of_brute_force(spark):
    draw = random.Random(4)
    parts = ["a", "b ", " ", "\n", "#", "é", "\x0b", " ", "a b c ", "|", "\x1c"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += [r.text for r in read(spark, "documents").limit(200).collect()]
    assert all(statistics_of(t)[0] == slow_counts(t) for t in texts)


def test_trees_respect_the_constraints_and_the_flat_arrays_agree():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 4))
    y = (x[:, 0] + 0.6 * np.sin(9 * x[:, 1]) - x[:, 2] + 0.3 * draw.standard_normal(3000) > 0).astype(float)
    trees = fit_trees(x, y, [1, 0, -1, 0], trees=30)
    assert ((trees.margin(x) > 0) == y).mean() > 0.85
    for f, sign in ((0, 1), (2, -1)):
        probe = np.repeat(draw.random((100, 1, 4)), 50, axis=1)
        probe[:, :, f] = np.linspace(0, 1, 50)
        steps = np.diff(trees.margin(probe.reshape(-1, 4)).reshape(100, 50), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_quality_rules_on_given_labels(spark):
    found = quality_rules.quality_rules(read(spark, "documents"), read(spark, "labels")).toPandas()
    assert len(found) == read(spark, "documents").count()
    assert (found.base_failed == ((found.n_words < 50) | (100 * found.n_repeat_words > 50 * found.n_words))).all()
    assert not (found.kept & found.base_failed).any()
    both = found.merge(read(spark, "labels").toPandas(), on="doc_id")
    fine = both[~both.base_failed]
    assert fine[fine.quality == 1].kept.mean() > 0.95 and fine[fine.quality == 0].kept.mean() < 0.1
    kept = quality_rules.good_documents(read(spark, "documents"), read(spark, "labels")).toPandas()
    assert sorted(kept.doc_id) == sorted(found[found.kept].doc_id)


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(awkward(spark), labels).count() == 13
    assert quality_rules.quality_rules(nothing(spark), labels).count() == 0
    assert quality_rules.good_documents(nothing(spark), labels).count() == 0
    assert statistics(nothing(spark)).count() == 0
    found = weak_labels.weak_quality(awkward(spark))
    assert found.count() == 13 and found.where("score IS NULL OR kept IS NULL").count() == 0
    assert weak_labels.weak_quality(nothing(spark)).count() == 0


def test_em_finds_the_accuracies_of_overlapping_labellers():
    draw = np.random.default_rng(1)
    truth = draw.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.8, 0.75]
    votes = np.stack([np.where(draw.random(20_000) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    votes[draw.random(votes.shape) < 0.3] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table = weak_labels.fit_votes(patterns, counts.astype(float))
    assert ((posterior[at.ravel()] > 0.5) == truth).mean() > 0.93
    found = table[:, 1, 2] / (table[:, 1, 0] + table[:, 1, 2])
    assert np.abs(found - accuracy).max() < 0.05


def test_weak_labels_agree_with_given_ones(spark):
    found = weak_labels.weak_quality(read(spark, "documents")).toPandas()
    both = found.merge(read(spark, "labels").toPandas(), on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.95 and both[both.quality == 0].kept.mean() < 0.15


def test_toxicity_on_held_out_rows(spark):
    found = toxicity.toxicity(read(spark, "documents"), read(spark, "labels")).toPandas()
    assert len(found) == read(spark, "documents").count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    both = found[found.held_out].merge(read(spark, "labels").toPandas(), on="doc_id")
    assert both[both.toxic == 1].predicted.mean() > 0.5 and both[both.toxic == 0].predicted.mean() < 0.02


def test_swapped_identity_terms_get_like_scores():
    draw = random.Random(0)
    rows = []
    for _ in range(2000):
        words = {f"w{draw.randint(0, 300)}" for _ in range(20)}
        toxic = draw.random() < 0.3
        if toxic:
            words.add(draw.choice(["vile", "awful"]))
        if draw.random() < (0.6 if toxic else 0.1):  # one group is named mostly in toxic sentences
            words.add("women")
        rows.append((np.array([zlib.crc32(w.encode()) for w in sorted(words)], np.uint32), int(toxic)))
    term = {t: zlib.crc32(t.encode()) for t in ("women", "men", "vile")}
    free, _ = toxicity.fit(rows, penalty=0.0)
    held, bias = toxicity.fit(rows)
    assert abs(held[term["women"]] - held[term["men"]]) < 0.3 * abs(free[term["women"]] - free[term["men"]])
    assert bias + held[term["women"]] < 0 < bias + held[term["vile"]]


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(awkward(spark), labels)
    assert found.count() == 13 and found.where("NOT score BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert toxicity.toxicity(nothing(spark), labels).count() == 0
    assert toxicity.toxicity(awkward(spark), labels.limit(0)).count() == 13


def base_scores(rows):
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    split = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    counts = Counter(w for i, ws in split if fold(i) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (-1 if i is None else i, fold(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5))
        for i, ws in split
    )


def lm_rows(df):
    return sorted(
        (-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
        for r in df.collect()
    )


def test_lm_base_scores_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 200)  # most tokens go through the join
    docs = read(spark, "documents")
    found = lm.lm_scores(docs).cache()
    assert lm_rows(found) == base_scores([(r.doc_id, r.text) for r in docs.collect()])
    held = found.where("held_out").toPandas()
    assert (held.score > held.base_score).mean() > 0.95


def test_lm_awkward_rows(spark):
    rows = awkward(spark)
    assert lm_rows(lm.lm_scores(rows)) == base_scores([(r.doc_id, r.text) for r in rows.collect()])
    assert lm.lm_scores(nothing(spark)).count() == 0


def test_lm_score_is_the_models_log_probability(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    texts = [(i, f"the cat {i % 7} sat on Mat{i % 3} and the {'dog' if i % 2 else 'кот'} ran\n") for i in range(60)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    train = rows.where("doc_id % 5 <> 0")
    model, counts = lm.fit(train)
    c = {bytes(r.token): r.c for r in counts.collect()}
    found = {r.doc_id: r for r in lm.score(rows.withColumn("held_out", rows.doc_id % 5 == 0), model, counts).collect()}
    for i, text in texts:
        tokens = text.encode().lower().split() + [lm.END]
        classes = lm.classes_of(*lm.joined(tokens), model.pairs)
        p = lm.Slice(next(lm.units([text])), model.pairs).probabilities(model.weights)
        want = 0.0
        for at, (t, k) in enumerate(zip(tokens, classes)):
            inside = (c.get(t, 0) + 0.5) / (model.class_tokens[k] + 0.5 * (model.class_types[k] + 1))
            want += math.log10(p[at, k]) + math.log10(inside)
        assert abs(found[i].score - want) < 1e-3 and found[i].n_known == sum(t in c for t in tokens)


@pytest.mark.parametrize("text", ["", " ", "Ab c", "a\n\n b\x0b", "é x" * 200_000, "  lead", "x" * 1_200_000])
def test_letter_pairs_of_a_text_are_those_of_its_words(text):
    words = text.encode().lower().split()
    want = np.bincount(lm.letter_pairs(lm.joined(words)[0]), minlength=lm.PAIRS) if words else np.zeros(lm.PAIRS)
    assert (lm.pair_counts(text) == want).all()


def test_class_softmax_is_a_distribution():
    pairs = np.log(np.random.default_rng(0).dirichlet(np.ones(lm.PAIRS), lm.CLASSES)).T
    group = next(lm.units(["a bc def a", "x"]))
    weights = np.random.default_rng(1).standard_normal((lm.BUCKETS, lm.CLASSES + 1)).astype(np.float32)
    assert np.allclose(lm.Slice(group, pairs).probabilities(weights).sum(1), 1, atol=1e-5)


