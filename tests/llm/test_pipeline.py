from __future__ import annotations

import hashlib

import corpus_pipeline
from scoreline.llm import bpe_codec, decontaminate, quality_rules, suffix_dedup
from scoreline.llm.queries import vocabulary_path
from tests.llm.test_dedup import near_groups

SF = "/root/testdata/sf0.001"


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    verdict = quality_rules.quality_rules(docs, labels).where("kept").select("doc_id")
    good = docs.join(verdict, "doc_id", "left_semi").select(docs.columns).cache()
    texts = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())
    label = near_groups([t for _, t in texts])  # all pairs, ids in order: the first of a group stays
    first = [(i,) for k, (i, _) in enumerate(texts) if label[k] == k]
    alone = good.join(spark.createDataFrame(first, "doc_id long"), "doc_id", "left_semi").select(docs.columns).cache()
    near = corpus_pipeline.near_duplicates(spark, good, SF)
    assert sorted(r.doc_id for r in near.collect()) == [i for i, in first]
    digests = {r.doc_id: r.kept_sha256 for r in suffix_dedup.suffix_digests(alone).collect()}
    cut = corpus_pipeline.repeated_passages(spark, alone, SF).cache()
    assert cut.columns == docs.columns
    same = sum(hashlib.sha256(r.text.encode()).hexdigest() == digests[r.doc_id] for r in cut.collect())
    assert same >= 0.9 * len(digests) and set(digests) == {r.doc_id for r in cut.collect()}
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    leaks = decontaminate.matches(cut, items).select("doc_id").distinct()
    want = bpe_codec.digests(cut.join(leaks, "doc_id", "left_anti"), vocabulary_path())
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
