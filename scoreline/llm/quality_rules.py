"""Quality rules: boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.boosting import Trees, fit_trees
from scoreline.llm.common import column, cut, portions
from scoreline.llm.statistics import COUNTS, SHARES, statistics, statistics_of

INPUTS = ("n_words", *SHARES)
#: The verdict may only fall as these rise.
FALLING = ("symbol_share", "symbol_words", "repeat_share", "dup_line_share", "mark_share", "bar_share")
#: Labelled rows that the trees are fitted on, those of smallest id hash.
LABELLED = 20_000
FEWEST_WORDS = 50


def fit_rules(stats: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> Trees | None:
    """Trees from at most LABELLED labelled documents; None without labels of both values."""
    known = labels.groupBy(labels[id_col].alias("doc_id")).agg(F.max(labels[label]).alias("label"))
    rows = stats.join(known.where("label IS NOT NULL"), "doc_id")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    rows = rows.select(F.col("label").cast("double"), *INPUTS, order.alias("h")).orderBy("h", *INPUTS)
    found = np.array([list(r)[:-1] for r in rows.limit(LABELLED).collect()], np.float64)
    if not len(found) or found[:, 0].min() == found[:, 0].max():
        return None
    return fit_trees(found[:, 1:], found[:, 0], [-1 if f in FALLING else 0 for f in INPUTS])


def base_failed(n_words, n_repeat_words):
    """For columns as for arrays."""
    return (n_words < FEWEST_WORDS) | (100 * n_repeat_words > 50 * n_words)


def verdicts(stats: DataFrame, trees: Trees | None) -> DataFrame:
    """Adds base_failed, score (the probability of good quality) and kept."""
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    if trees is None:
        rows = stats.withColumn("score", F.lit(None).cast("double"))
        return rows.withColumn("base_failed", failed).withColumn("kept", ~failed)
    sent = stats.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in INPUTS]
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in at], 1)
            score = 1 / (1 + np.exp(-sent.value.margin(x)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score)], [*batch.schema.names, "score"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    rows = stats.mapInArrow(run, f"{fields}, score double")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= 0.5))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"
) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the score, for every row of docs.

    Null and empty texts fail the base rules. Labels with a null id or value aren't used; of an id
    with several labels the largest holds. Without labels of both values the base rules alone
    decide. Rows with a repeated or null id keep a row each.
    """
    stats = cut(statistics(docs, id_col, text_col), "quality-stats")
    rows = verdicts(stats, fit_rules(stats, labels, label))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "score")


def good_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"
) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps. Each is judged where it is read."""
    stats = cut(statistics(docs, id_col, text_col), "quality-stats")
    sent = docs.sparkSession.sparkContext.broadcast(fit_rules(stats, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [statistics_of(t or "") for t in column(batch, text_col)]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            shares = np.array([s for _, s in found], np.float64).reshape(-1, len(SHARES))
            kept = ~base_failed(counts[:, 0], counts[:, 4])
            if sent.value is not None:
                margin = sent.value.margin(np.column_stack([counts[:, 0], shares]))
                kept &= 1 / (1 + np.exp(-margin)) >= 0.5
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
