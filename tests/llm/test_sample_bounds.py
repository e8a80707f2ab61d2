from __future__ import annotations

from scoreline.llm import lm, toxicity, weak_labels
from scoreline.llm.common import id_text


def test_null_ids_and_repeated_rows_do_not_fill_the_scorers_sample(spark, monkeypatch):
    sizes = []
    fit = weak_labels.fit_scorer
    monkeypatch.setattr(weak_labels, "SAMPLE", 50)
    monkeypatch.setattr(weak_labels, "fit_scorer", lambda x, y: sizes.append(len({r.tobytes() for r in x})) or fit(x, y))
    rows = [(None, f"text without an id {i}") for i in range(300)] + [(1, "the same row")] * 300
    rows += [(i, f"some text {i}") for i in range(2, 300)]
    assert weak_labels.weak_quality(spark.createDataFrame(rows, "doc_id long, text string")).count() == 898
    assert 40 < sizes[0] <= 50


def test_null_ids_and_repeated_rows_do_not_fill_the_sample_of_the_classes(spark, monkeypatch):
    sizes = []
    centres = lm._centres
    monkeypatch.setattr(lm, "CLUSTER_SAMPLE", 40)
    monkeypatch.setattr(lm, "_centres", lambda x: sizes.append(len(x)) or centres(x))
    rows = [(None, f"text without an id {i}") for i in range(300)] + [(1, "the same row")] * 300
    pairs = lm.letter_classes(id_text(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sizes == [40] and pairs.shape == (lm.PAIRS, lm.CLASSES)


def test_a_repeated_labelled_id_does_not_lift_the_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LABELLED", 40)
    rows = [(1, f"text {i}") for i in range(300)] + [(2, "equal")] * 300 + [(i, f"other {i}") for i in range(3, 100)]
    docs = id_text(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 100)], "doc_id long, toxic int")
    assert len(toxicity.labelled_rows(docs, labels, "toxic", "doc_id")) == 40
