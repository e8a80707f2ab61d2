from __future__ import annotations

import random
import zlib

import numpy as np

from scoreline.llm import language_id
from scoreline.llm.common import id_text
from tests.llm.fixtures import awkward, nothing

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, held_out int, k1 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 1, "k") for i, t, lang in rows], SCHEMA).repartition(3)


def slow_features(words):
    """Subwords of counted words, with their shares, without arrays."""
    found = {}
    for w, times in words.items():
        marked = f"<{w}>"
        for n in range(1, language_id.LONGEST + 1):
            for i in range(len(marked) - n + 1):
                h = 0
                for c in marked[i : i + n]:
                    h = (h + ord(c) + 1) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 31
                bucket = (h * 0xBF58476D1CE4E5B9 % 2**64 >> 48) % language_id.BUCKETS
                found[bucket] = found.get(bucket, 0) + times
    return found


def test_subwords_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(language_id, "LETTERS_AT_ONCE", 7)
    for text in ("Où est l'ÉCOLE école ?", "a 12 ß\U0001f600x", "x" * 50, "日本語 テキスト", "1 2 ²"):
        counts = language_id.word_counts(text)
        want = slow_features(counts)
        buckets, shares = language_id.features_of(counts)
        assert dict(zip(buckets.tolist(), np.round(shares * sum(want.values()), 6))) == want


def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.language(docs).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    both = found.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99
    assert held.accepted.mean() > 0.95


def test_scores_are_those_of_the_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).cache()
    rows = language_id.labelled_rows(id_text(docs, lang=docs.lang), 200)
    model = language_id.fit(rows)
    scorer = language_id.Scorer(model)
    texts = [r.text for r in docs.collect()] + ["", "1 2 3"]
    for text, lang, score, accepted in zip(texts, *scorer(texts)):
        counts = language_id.word_counts(text)
        if not counts:
            assert (lang, score, accepted) == ("und", 0.0, False)
            continue
        p = model.probabilities(model.mean(*language_id.features_of(counts))[None])[0]
        assert lang == model.languages[p.argmax()] and abs(score - p.max()) < 1e-4
    small = language_id.Scorer(model)
    language_id.REMEMBERED, before = 50, language_id.REMEMBERED  # words are forgotten all the time
    try:
        for i in range(0, 40, 7):
            assert np.allclose(small(texts[i : i + 7])[1], scorer(texts[i : i + 7])[1], atol=1e-6)
    finally:
        language_id.REMEMBERED = before


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"
    changed = docs.selectExpr("doc_id", "text", f"CASE WHEN {held} THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    one, two = (sorted(map(tuple, language_id.language(d).collect())) for d in (docs, changed))
    assert one == two


def test_unlike_texts_are_turned_away(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(3)
    odd = [(10**6 + i, " ".join("".join(draw.choices("кдитош", k=6)) for _ in range(30)), None) for i in range(40)]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    found = language_id.language(both).where("doc_id >= 1000000").toPandas()
    assert len(found) == 40 and not found.accepted.any()


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(1, "the same words", "en")] * 500 + [(i, f"word number {i}", "en") for i in range(2, 300)]
    rows += [(None, f"mot {i}", "fr") for i in range(200)] + [(i, "ein wort", "de") for i in range(5)]
    docs = frame(spark, rows)
    found = language_id.labelled_rows(id_text(docs, lang=docs.lang), 60)
    assert len(found) <= 2 * 60
    by = {lang: sum(not piece and r == lang for r, _, _, piece in found) for lang in ("en", "fr", "de")}
    assert by == {"en": 20, "fr": 20, "de": 5}


def test_language_awkward_rows(spark):
    rows = awkward(spark).withColumnRenamed("row", "lang")
    found = language_id.language(rows)
    assert found.count() == 13 and found.where("lang_pred IS NULL OR score IS NULL OR accepted IS NULL").count() == 0
    assert found.where("lang_pred = 'und'").count() == 4  # null, null, empty and blank
    assert language_id.language(nothing(spark).withColumnRenamed("row", "lang")).count() == 0
    none = frame(spark, [(1, "words without a label", None), (2, "", "en"), (3, "123", "en"), (None, None, None)])
    assert {tuple(r)[2:] for r in language_id.language(none).collect()} == {("und", 0.0, False)}
    assert language_id.language(frame(spark, [(1, "one label", "en"), (2, "one", None)])).first().lang_pred == "en"
