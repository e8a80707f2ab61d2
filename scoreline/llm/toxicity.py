"""Toxicity: a counterfactual-regularised linear classifier on words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import column, cut, fold, id_text, portions, row_keys

#: Terms of one row name members of one kind of group and may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
)
#: The classifier is fitted on at most this many labelled rows, those of smallest hash of id and text,
#: of equal rows one; training and scoring read whole texts.
LABELLED = 20_000
#: A word is a feature if so many labelled documents hold it and its log odds ratio between the labels
#: is so many standard deviations from 0; identity terms always are.
FEWEST, DEVIATIONS = 3, 3.0
EDGES = b".,;:!?\"'()[]{}#*$%&|<>-_/\\=+~`"


def words_of(text: str) -> set[bytes]:
    """Distinct words without marks at their ends, A-Z lower-cased."""
    found = set(text.encode("utf-8", "surrogatepass").lower().split())
    found = {w.strip(EDGES) for w in found}
    found.discard(b"")
    return found


def hashed(words: set[bytes]) -> list[int]:
    return list({zlib.crc32(w) for w in words})


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[int, list[int]]:
    """For the hash of an identity term, the hashes of the terms that may stand in its place."""
    out: dict[int, list[int]] = {}
    for group in groups:
        for term in group:
            out[zlib.crc32(term.encode())] = [zlib.crc32(t.encode()) for t in group if t != term]
    return out


def telling_words(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    names, at = np.unique(np.concatenate([np.zeros(0, np.uint32), *docs]), return_inverse=True)
    label = np.repeat(y, [len(d) for d in docs]).astype(bool)
    counts = [np.bincount(at[side], minlength=len(names)) for side in (~label, label)]
    b, a = counts[0] + 0.5, counts[1] + 0.5
    not_b, not_a = len(y) - y.sum() + 1 - b, y.sum() + 1 - a
    ratio = np.log(a / not_a) - np.log(b / not_b)
    apart = np.abs(ratio) >= DEVIATIONS * np.sqrt(1 / a + 1 / b + 1 / not_a + 1 / not_b)
    return names[apart & (sum(counts) >= FEWEST)]


def fit(
    rows: list[tuple[np.ndarray, int]],
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    penalty: float = 5.0,
    l2: float = 1e-5,
    epochs: int = 40,
    batch: int = 256,
) -> tuple[dict[int, float], float]:
    """rows: word hashes and label. Returns weights by word hash and the bias. Minimises the logistic loss, plus `penalty` times the mean
    squared change of the margin when an identity term of a document is swapped for another of its
    group, by AdaGrad."""
    y = np.array([label for _, label in rows], np.float64)
    hashes = [np.asarray(words, np.uint32) for words, _ in rows]
    other = swaps(groups)
    terms = np.array(sorted(other), np.uint32)
    held = [np.intersect1d(words, terms) for words in hashes]
    wanted = {t for words in held for w in words.tolist() for t in (w, *other[w])}
    names = np.union1d(telling_words(hashes, y), np.array(sorted(wanted), np.uint32)).astype(np.uint32)
    docs = [np.searchsorted(names, np.intersect1d(words, names)) for words in hashes]
    place = {t: int(np.searchsorted(names, t)) for t in wanted}
    pairs = [[(place[w], place[t]) for w in words.tolist() for t in other[w]] for words in held]
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-4)
    bias, bias_squares = float(np.log(share / (1 - share))), 1e-4
    order = np.random.default_rng(0)
    for _ in range(epochs if len(names) else 0):
        shuffled = order.permutation(len(docs))
        for at in np.array_split(shuffled, max(1, len(docs) // batch)):
            index = np.concatenate([docs[i] for i in at])
            owner = np.repeat(np.arange(len(at)), [len(docs[i]) for i in at])
            margin = bias + np.bincount(owner, weights[index], len(at))
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[at]
            gradient = np.bincount(index, error[owner], len(names)) / len(at) + l2 * weights
            both = [p for i in at for p in pairs[i]]
            if both:
                a, b = np.array(both).T
                change = 2 * penalty * (weights[a] - weights[b]) / len(at)
                gradient += np.bincount(a, change, len(names)) - np.bincount(b, change, len(names))
            squares += gradient**2
            weights -= 0.3 * gradient / np.sqrt(squares)
            bias_squares += error.mean() ** 2
            bias -= 0.1 * error.mean() / np.sqrt(bias_squares)
    return dict(zip(names.tolist(), weights.tolist())), bias


def chosen_keys(keyed: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """k1, k2 and label of the n smallest row keys among labelled rows. Rows below a bound on their key
    meet the labels; the bound is raised where that leaves too few."""
    share = min(1.0, 4 * n / max(1, known.count()))
    while True:
        bound = int(share * (1 << 64)) - (1 << 63) - (share == 1)
        met = keyed.where(F.col("k1") <= F.lit(bound)).join(known, "doc_id")
        met = cut(met.groupBy("k1", "k2").agg(F.max("label").alias("label")), "labelled")
        if share == 1 or met.count() >= n:
            return met.orderBy("k1", "k2").limit(n)
        share = min(1.0, 8 * share)


def labelled_rows(rows: DataFrame, labels: DataFrame, label: str, id_col: str) -> list[tuple[np.ndarray, int]]:
    """Hashed words and label of at most LABELLED rows. Labels meet keys, not texts; texts are read
    again for the chosen keys, whose table is small by LABELLED, and leave their task as hashes."""
    known = labels.groupBy(labels[id_col].alias("doc_id")).agg(F.max(labels[label]).cast("int").alias("label"))
    keyed = rows.select("doc_id", "text", *row_keys(F.col("doc_id"), F.col("text")))
    chosen = chosen_keys(keyed.drop("text"), known.where("doc_id IS NOT NULL AND label IS NOT NULL"), LABELLED)
    found = keyed.drop("doc_id").join(F.broadcast(chosen), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in portions(batches):
            keys = list(zip(column(b, "k1"), column(b, "k2")))
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            texts, y = b.column(b.schema.get_field_index("text")), column(b, "label")
            words = [np.array(sorted(hashed(words_of(texts[i].as_py()))), np.uint32).tobytes() for i in new]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i][0] for i in new], pa.int64()), pa.array([keys[i][1] for i in new], pa.int32()),
                    pa.array(words, pa.binary()), pa.array([y[i] for i in new], pa.int32()),
                ],
                ["k1", "k2", "w", "y"],
            )

    out = found.select("k1", "k2", "text", "label").mapInArrow(run, "k1 long, k2 int, w binary, y int")
    out = out.groupBy("k1", "k2").agg(F.first("w").alias("w"), F.first("y").alias("y")).collect()
    rows_found = sorted((bytes(r.w), int(r.y > 0)) for r in out)
    return [(np.frombuffer(w, np.uint32), y) for w, y in rows_found]


def score(rows: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """rows: doc_id, text and held_out. Adds score and predicted."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, bias))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for b in portions(batches):
            margin = np.array(
                [bias + sum(weights.get(w, 0.0) for w in hashed(words_of(t))) for t in column(b, "text")]
            )
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            held = b.column(b.schema.get_field_index("held_out"))
            yield pa.RecordBatch.from_arrays([b.column(0), held, pa.array(p)], ["doc_id", "held_out", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    held_out: Column | None = None,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row; labels of held-out rows (fold 0
    unless given) aren't read. Null and empty texts get the score of a text without words, about
    the share of label 1; without labels every score is the smallest. Labels with a null id or value
    aren't used; of several labels for an id the largest holds.
    """
    rows = id_text(docs, id_col, text_col, held_out=F.lit(False) if held_out is None else held_out)
    if held_out is None:
        rows = rows.withColumn("held_out", fold(F.col("doc_id")) == 0)
    weights, bias = fit(labelled_rows(rows.where(~F.col("held_out")), labels, label, id_col))
    return score(rows, weights, bias)
