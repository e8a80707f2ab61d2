"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are a query set: they are taken in blocks of bounded size, and each block meets every
document. A first pass counts in how many documents each seed (an n-gram of an item) occurs; a
second one collects the seeds of an item that lie close together in a document and aligns the item
with every passage that has enough of them, those of the rarest seeds first. Nothing is shuffled but
the counts, so a passage that very many documents share costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scoreline.llm.common import batches_of, column, id_text, portions

SEED = 3
BLOCK_BYTES = 4 << 20  # of items, in expectation
MATCH, MISMATCH, GAP = 2, -1, -1
#: The alignment's score over that of the whole item.
SIMILARITY = 0.5
FEWEST = 2  # seeds in a passage, or all that the item has
#: ASCII marks and control characters separate words; other characters are part of them.
_SEPARATE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


@dataclass
class Items:
    """A block of items as numbers: word ids begin at 1, seeds are sorted keys of up to SEED ids."""

    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    keys: np.ndarray
    begins: np.ndarray  # of each seed's items
    members: np.ndarray
    sizes: list[int]  # seed lengths that occur

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def seeds_at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and seed numbers of all seeds in a sequence of word ids."""
        places, seeds = [], []
        for size in self.sizes:
            n = max(0, len(ids) - size + 1)
            known = ids[:n] > 0
            for k in range(1, size):
                known &= ids[k : k + n] > 0
            some = np.flatnonzero(known)
            key = _keys([ids[some + k] for k in range(size)], self.base)
            at = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            places.append(some[hit])
            seeds.append(at[hit])
        return np.concatenate(places), np.concatenate(seeds)


def _keys(words: list[np.ndarray], base: int) -> np.ndarray:
    """Keys of n-grams given by their first, second, ... word ids; shorter ones are filled with 0."""
    key = np.zeros(len(words[0]), np.int64)
    for k in range(SEED):
        key = key * base + (words[k] if k < len(words) else 0)
    return key


def items_of(texts: list[str]) -> Items:
    split = [words_of(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}), 1)}
    assert len(vocabulary) < 1 << 20, "a block of items holds too many different words"
    arrays = [np.array([vocabulary[w] for w in ws], np.int64) for ws in split]
    pairs, sizes = set(), set()
    for i, a in enumerate(arrays):
        size = min(SEED, len(a))
        if size:
            sizes.add(size)
            grams = [a[k : len(a) - size + 1 + k] for k in range(size)]
            pairs.update((int(k), i) for k in _keys(grams, len(vocabulary) + 1))
    table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    keys, begins = np.unique(table[:, 0], return_index=True)
    return Items(vocabulary, arrays, keys, np.r_[begins, len(table)], table[:, 1], sorted(sizes))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and where in the passage it begins and ends. A row at a
    time; gaps along the row are a running maximum."""
    n = len(passage)
    ramp = -GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        new, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = np.maximum(diagonal, up)
        begin[1:] = np.where(take > 0, np.where(diagonal >= up, start[:-1], start[1:]), begin[1:])
        new[1:] = np.maximum(take, 0)
        # the cell to the left that a gap along the row comes from
        lifted = new + ramp
        highest = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == highest, np.arange(n + 1), 0))
        along = highest - ramp
        begin = np.where(along > new, begin[source], begin)
        score, start = np.maximum(new, along), begin
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(start[end]), end)
    return best


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that the two share, each as often as in both."""
    words, n = np.unique(a, return_counts=True)
    at = np.searchsorted(words, b)
    at = at[words[np.minimum(at, len(words) - 1)] == b]
    return int(np.minimum(n, np.bincount(at, minlength=len(words))).sum())


def _sequence(items: Items, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of several texts, SEED zeros between them, and where each text begins."""
    parts, begins, at = [], [], 0
    for t in texts:
        ids = items.numbers(words_of(t))
        begins.append(at)
        parts += [ids, np.zeros(SEED, np.int64)]
        at += len(ids) + SEED
    return np.concatenate(parts), np.array(begins)


def seed_counts(rows: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each seed, over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n = sent.value, 0
        total = np.zeros(len(items.keys), np.int64)
        for b in portions(batches):
            texts = column(b, "text")
            n += len(texts)
            for i, j in batches_of(map(len, texts)):
                if i == j:
                    continue
                ids, begins = _sequence(items, texts[i:j])
                places, seeds = items.seeds_at(ids)
                row = np.searchsorted(begins, places, side="right")
                once = np.unique(row * len(items.keys) + seeds)
                total += np.bincount(once % len(items.keys), minlength=len(items.keys))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], ["seed", "n"])

    found = rows.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n"))
    counts = np.zeros(len(items.keys) + 1, np.int64)
    for seed, n in found.collect():  # no more rows than seeds in a block
        counts[seed] = n
    return int(counts[-1]), counts[:-1]


def matches_in(
    items: Items, weights: np.ndarray, ids: np.ndarray, one: bool = False
) -> Iterator[tuple[int, float, int, int]]:
    """Items found in a text: number, similarity, first word, end. Passages of rare seeds are looked
    at first; if `one` match is enough, no more are aligned."""
    places, seeds = items.seeds_at(ids)
    if not len(places):
        return
    n = np.diff(items.begins)[seeds]
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = items.members[np.repeat(items.begins[seeds], n) + offset]
    place, weight = np.repeat(places, n), np.repeat(weights[seeds], n)
    order = np.lexsort((place, item))
    item, place, weight = item[order], place[order], weight[order]
    length = np.fromiter(map(len, items.words), np.int64, len(items.words))[item]
    new = np.r_[True, (item[1:] != item[:-1]) | (place[1:] - place[:-1] > length[1:])]
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight, first)
    last = np.r_[first[1:], len(item)] - 1
    enough = last - first + 1 >= np.minimum(FEWEST, np.maximum(1, length[first] - SEED + 1))
    best: dict[int, tuple[float, int, int]] = {}
    passages = np.flatnonzero(enough)
    for k in passages[np.argsort(-total[passages], kind="stable")]:
        words = items.words[item[first[k]]]
        low = max(0, int(place[first[k]]) - 2 * len(words))
        # a long run of seeds is aligned in overlapping stretches
        high = min(len(ids), int(place[last[k]]) + 2 * len(words))
        step = 64 * max(SEED, len(words))
        for at in range(low, high, step):
            passage = ids[at : min(high, at + step + 4 * len(words))]
            if _common(words, passage) < SIMILARITY * len(words):  # each match takes one word of either
                continue
            score, start, end = align(words, passage)
            share = score / (MATCH * len(words))
            held = best.get(int(item[first[k]]), (0.0, 0, 0))
            if share >= SIMILARITY and (share, -at - start) > (held[0], -held[1]):
                best[int(item[first[k]])] = (share, at + start, at + end)
                if one:
                    yield int(item[first[k]]), *best[int(item[first[k]])]
                    return
    for i, found in best.items():
        yield i, *found


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == k)
        rows = part.collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def _fitted(rows: DataFrame, queries: DataFrame) -> Iterator[tuple[list, Items, np.ndarray]]:
    """For each block of items: ids, the items, and the weights of their seeds."""
    for ids, texts in _blocks(queries):
        block = items_of(texts)
        if len(block.keys):
            total, counts = seed_counts(rows, block)
            yield ids, block, np.maximum(1.0, np.log(max(1, total) / np.maximum(counts, 1)))


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, score (0 to 1, that of the
    best passage), first_word and end_word.

    Null and empty texts match nothing, items without words are never found, items of fewer than
    SEED words are their own seed. Repeated documents or items give a row each.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    queries = id_text(items, item_id, item_text).distinct()
    item_kind = queries.schema["doc_id"].dataType.simpleString()
    schema = [f"doc_id {kind}", f"item_id {item_kind}", "score double", "first_word long", "end_word long"]
    item_type = to_arrow_type(queries.schema["doc_id"].dataType)
    out = None
    for fitted in _fitted(rows, queries):
        sent = rows.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            item_ids, block, weights = sent.value
            for b in portions(batches):
                at, found = [], []
                for k, text in enumerate(column(b, "text")):
                    for match in matches_in(block, weights, block.numbers(words_of(text))):
                        at.append(k)
                        found.append(match)
                taken = b.take(pa.array(at, pa.int64()))
                names = [item_ids[m[0]] for m in found]
                numbers = [pa.array([m[k] for m in found], t) for k, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))]
                arrays = [taken.column(0), pa.array(names, item_type), *numbers]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = rows.mapInArrow(run, ", ".join(schema))
        out = part if out is None else out.union(part)
    return rows.sparkSession.createDataFrame([], ", ".join(schema)) if out is None else out


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found. Each is judged where it is read."""
    out = docs
    queries = id_text(items, "item_id", "text").distinct()
    for fitted in _fitted(id_text(docs, id_col, text_col), queries):
        sent = docs.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            _, block, weights = sent.value
            for b in portions(batches):
                texts = column(b, text_col)
                found = [any(True for _ in matches_in(block, weights, block.numbers(words_of(t or "")), one=True)) for t in texts]
                yield b.filter(pa.array([not f for f in found], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
