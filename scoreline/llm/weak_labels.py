"""Quality by weak labels: heuristic labellers, their accuracies by EM, and a linear scorer.

The labellers overlap and may abstain. Expectation-maximisation over the counts of their vote
patterns estimates how often each votes either way on good and bad documents; the posterior of a
pattern is the soft label that trains a hashed linear scorer. No given label is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import SLICE_BYTES, column, id_text, row_sample
from scoreline.llm.statistics import COUNTS, SHARES, statistics_of

#: Share of bad documents that EM starts from.
BAD_SHARE = 0.15
BUCKETS = 2048
#: The scorer is trained on at most this many documents, those of smallest hash of id and text; of
#: equal rows one.
SAMPLE = 6000


def votes(stats: dict[str, float]) -> tuple[int, ...]:
    """-1 bad, 1 good, 0 abstains. Each looks at another trait, most at one side of it."""
    s = stats
    plain = s["symbol_words"] < 0.05 and s["mark_share"] < 0.1
    bad = (
        s["symbol_share"] > 0.08,
        s["symbol_words"] > 0.3,
        s["mark_share"] > 0.3,
        s["upper_share"] > 0.4,
        s["bar_share"] > 0.2,
        s["bar_share"] > 0.05 and s["stop_share"] < 0.2,
        s["repeat_share"] > 0.4,
        s["distinct_share"] < 0.15 and s["n_words"] > 50,
        s["dup_line_share"] > 0.3 and s["n_words"] > 20,
        s["digit_share"] > 0.25,
        s["n_words"] < 2,
    )
    good = (
        s["symbol_share"] < 0.01 and s["bar_share"] < 0.02 and s["upper_share"] < 0.2,
        0.05 < s["stop_share"] < 0.4 and plain,
        s["repeat_share"] < 0.15 and 2.5 < s["mean_word"] < 9 and s["symbol_share"] < 0.02,
    )
    return tuple(-int(t) for t in bad) + tuple(int(t) for t in good)


def votes_of(text: str) -> tuple[int, ...]:
    counts, shares = statistics_of(text)
    return votes(dict(zip(COUNTS + SHARES, counts + shares)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and the (labeller, class, vote) probabilities."""
    m, n = patterns.shape
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    balance = (patterns == 1).sum(1) - 1.5 * (patterns == -1).sum(1)
    posterior = np.clip(0.5 + 0.4 * np.tanh(balance), 0.02, 0.98)
    share = 1 - BAD_SHARE
    table = np.zeros((n, 2, 3))
    for _ in range(rounds):
        for k, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            table[:, k] = np.einsum("m,mnv->nv", weight, onehot) + 0.5
        table /= table.sum(2, keepdims=True)
        share = np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.02, 0.98)
        log = np.einsum("mnv,nkv->mk", onehot, np.log(table)) + np.log([1 - share, share])
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(before - posterior).max() < 1e-6:
            break
    return posterior, table


def hashed(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of hashed byte triples of each whole text, and one for the bias."""
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        total = np.zeros(BUCKETS)
        for at in range(0, max(1, len(data) - 2), SLICE_BYTES):
            b = np.frombuffer(data[at : at + SLICE_BYTES + 2], np.uint8).astype(np.uint32)
            if len(b) > 2:
                key = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
                total += np.bincount(key >> np.uint32(21), minlength=BUCKETS)
        if total.any():
            out[i, :-1] = np.sqrt(total / total.sum())
        out[i, -1] = 1
    return out


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps with momentum."""
    weights, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        error = 1 / (1 + np.exp(-(x @ weights))) - target
        speed = 0.9 * speed - (error @ x / len(x) + 1e-5 * weights) * 8
        weights += speed
    return weights


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior (of good quality, from the votes), score (the linear scorer's, 0 to 1) and
    kept (score at least 0.5) for every row of docs. Null and empty texts are scored like any text
    without byte triples. Rows with a repeated or null id keep a row each.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    context = rows.sparkSession.sparkContext

    def run_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(votes_of(t) for t in column(b, "text"))
            found = pa.array(list(map(list, seen)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    def run_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = column(b.slice(i, 256), "text")
                x = pa.array([r.tobytes() for r in hashed(texts).astype(np.float16)], pa.binary())
                y = pa.array([list(votes_of(t)) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([x, y], ["x", "votes"])

    patterns = rows.select("text").mapInArrow(run_votes, "votes array<int>, n long")
    counted = patterns.groupBy("votes").agg(F.sum("n")).collect()  # patterns, not documents
    counted = sorted((tuple(r[0]), r[1]) for r in counted)
    table = np.array([p for p, _ in counted], np.int64)
    good = fit_votes(table, np.array([n for _, n in counted], float))[0] if counted else []
    known = {p: float(q) for (p, _), q in zip(counted, good)}
    found = row_sample(rows, SAMPLE).mapInArrow(run_sample, "x binary, votes array<int>").collect()
    found = sorted((bytes(x), tuple(v)) for x, v in found)
    x = np.array([np.frombuffer(x, np.float16) for x, _ in found], np.float32).reshape(len(found), BUCKETS + 1)
    weights = fit_scorer(x, np.array([known[v] for _, v in found]))
    sent = context.broadcast((known, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = sent.value
        for b in batches:
            texts = column(b, "text")
            posterior = [known[votes_of(t)] for t in texts]
            margin = np.concatenate([hashed(texts[i : i + 256]) @ weights for i in range(0, len(texts), 256)] or [np.zeros(0)])
            score = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(posterior, pa.float64()), pa.array(score)], ["doc_id", "posterior", "score"]
            )

    out = rows.mapInArrow(run, f"doc_id {kind}, posterior double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)
