"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import ascii_lower_words, batches_of, column, cut, id_text, portions, row_keys
from scoreline.llm.components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 2
SHINGLES_AT_ONCE = 1 << 16
#: The 64 bits are 8 segments of a byte. Fingerprints at most DISTANCE bits apart agree in all
#: segments but some two, so each table leaves two segments free and is keyed by the other six.
FREE = list(combinations(range(8), DISTANCE))
#: The small Hamming ball of the free 16 bits.
BALL = np.array([1 << i for i in range(16)] + [1 << i | 1 << j for i, j in combinations(range(16), 2)])


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints_of(texts: list[str]) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if set in over half the shingles' XXH64."""
    out = np.zeros(len(texts), np.uint64)
    for i, j in batches_of(map(len, texts)):
        hashes, sizes = [], []
        for text in texts[i:j]:
            words = ascii_lower_words(text)
            if len(words) >= SHINGLE:
                shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
                found = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
            else:
                found = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
            hashes.append(found)
            sizes.append(len(found))
        one, n = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(sizes)
        owner = np.repeat(np.arange(len(sizes)), n)
        ones = np.zeros((len(sizes), 64), np.int64)
        for k in range(0, len(one), SHINGLES_AT_ONCE):
            rows = owner[k : k + SHINGLES_AT_ONCE]
            begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            part = np.add.reduceat(_bits(one[k : k + SHINGLES_AT_ONCE]), begins, axis=0, dtype=np.int64)
            ones[rows[begins]] += part
        packed = np.packbits(2 * ones > n[:, None], axis=1)
        out[i:j] = packed.view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as signed long) and two hashes k1, k2 of id and text."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", *row_keys(F.col("doc_id"), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            fp = pa.array(fingerprints_of(column(b, "text")).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(2), b.column(3)], ["doc_id", "fp", "k1", "k2"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long, k1 long, k2 int")


def _free_values(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    first, second = np.array(FREE)[table].T
    low = (fp >> (first * 8).astype(np.uint64)) & np.uint64(255)
    high = (fp >> (second * 8).astype(np.uint64)) & np.uint64(255)
    return (low | high << np.uint64(8)).astype(np.int64)


def local_links(key: np.ndarray, table: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (key, table), whole buckets: for each fingerprint that has a partner within
    DISTANCE in its bucket, itself and the smallest one of its component in the bucket.

    A bucket holds at most 2**16 fingerprints, those that differ in the free bits alone. Each looks
    up the values of the ball around its own; what it meets is verified on all 64 bits.
    """
    begins = np.r_[True, (key[1:] != key[:-1]) | (table[1:] != table[:-1])]
    run = np.cumsum(begins) - 1
    size = np.bincount(run)
    many = size[run] > 1
    if not many.any():
        return fp[:0], fp[:0]
    run, fp, table = run[many], fp[many], table[many]
    place = run << 16 | _free_values(fp, table)
    order = np.argsort(place, kind="stable")
    place, fp = place[order], fp[order]
    left, right = [], []
    for flip in BALL:
        target = place ^ flip
        up = np.flatnonzero(target > place)
        at = np.searchsorted(place, target[up])
        found = np.flatnonzero(place[np.minimum(at, len(place) - 1)] == target[up])
        left.append(up[found])
        right.append(at[found])
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE
    a, b = a[near], b[near]
    label = np.arange(len(fp))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fp[linked], fp[label[linked]]


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp. Edges (a, b) whose components are those of all pairs within DISTANCE bits;
    no more rows than entries of the tables."""
    entries = []
    for k, free in enumerate(FREE):
        mask = ~reduce(lambda m, s: m | 255 << 8 * s, free, 0) & (1 << 64) - 1
        signed = mask - (1 << 64) if mask >> 63 else mask
        masked = F.col("fp").bitwiseAND(F.lit(signed))
        entries.append(F.struct(F.xxhash64(masked, F.lit(k)).alias("key"), F.lit(k).alias("t")))
    rows = fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.key", "e.t", "fp")
    rows = rows.repartition("key").sortWithinPartitions("key", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = local_links(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key, table, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = [key, table.astype(np.int64), fp.astype(np.int64).view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= 1 << 16:
                last = np.searchsorted(held[0], held[0][-1])  # the last bucket may go on
                if last:
                    yield out([x[:last] for x in held])
                    held = [x[last:] for x in held]
        if len(held[0]):
            yield out(held)

    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, k1, k2 and the first row of the component (smallest id, nulls last) as
    first.doc_id, first.k1, first.k2, for every row of docs."""
    rows = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    fps = cut(rows.groupBy("fp").agg(F.min(row).alias("first")), "fps")
    found = cut(connected_components(links(fps.select("fp"))), "components")
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = cut(named.select("fp", "first", F.coalesce("component", "fp").alias("component")), "named")
    low = cut(named.groupBy("component").agg(F.min("first").alias("first")), "firsts")
    named = cut(named.drop("first").join(low, "component").select("fp", "first"), "named")
    return rows.join(named, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    Null and empty texts have fingerprint zero and link to each other like any others. component_id
    is the smallest id that can be reached, the own one included; null ids don't count, and a
    component of such rows alone has none. Rows with a repeated id are rows of their own.
    """
    found = groups(docs, id_col, text_col)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that come first in their component: smallest id, nulls last,
    of a repeated id one row."""
    found = groups(docs, id_col, text_col)
    kept = cut(found.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2")).distinct(), "kept")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    k1, k2 = row_keys(docs[id_col], text)
    rows = docs.withColumns({"__k1": k1, "__k2": k2}).join(kept, ["__k1", "__k2"], "left_semi")
    return rows.dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
