"""Spelling variants: words one edit apart, found by their words over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import column, cut, id_text, portions

#: What a word is, how often one of its letters is lost, and when a word is a form.
RUN = re.compile("[a-zÀ-ÿ]{7,}")
LOST = 31
FEWEST_LETTERS, FEWEST, TIMES = 7, 2, 10
#: Letters are hashed to so many symbols. Half of a word is matched letter by letter as well, so more
#: symbols would add neighbours without leaving out many candidates.
SYMBOLS = 3
#: Words of more letters stay behind ids until their candidates are known.
CARRIED = 64
COUNTED_AT_ONCE = 1 << 17
ENTRIES_AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(doc_id: object, text: str) -> Iterator[tuple[str, int]]:
    """Words of a text and how often it has them. The run's crc32 with the id decides about a lost
    letter, so equal runs of one document become equal words."""
    start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    start = zlib.crc32(b":", start)
    # bytes.lower() knows only A-Z
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % LOST == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < FEWEST_LETTERS:
                continue
        yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of every word with at least FEWEST_LETTERS letters and FEWEST occurrences. Tasks send
    each word once for every COUNTED_AT_ONCE different ones, however often it occurs."""
    rows = id_text(docs, id_col, text_col).select(F.col("doc_id").cast("string"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            sent = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )
            counts.clear()
            return sent

        for b in portions(batches):
            for doc_id, text in zip(b.column(0), b.column(1)):
                for word, n in words_of(doc_id.as_py(), text.as_py()):
                    counts[word] += n
                if len(counts) >= COUNTED_AT_ONCE:
                    yield out()
        yield out()

    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= FEWEST)


def reduced(letters: np.ndarray) -> np.ndarray:
    """Symbols 1 to SYMBOLS of code points."""
    return (letters.astype(np.uint64) * _MIX[0] >> np.uint64(33)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of one length as hashes: of their reduced words, and of the letters of either half."""

    def __init__(self, letters: np.ndarray):
        self.n, self.length = letters.shape
        self.symbols = reduced(letters)
        self.power = _powers(_BASE, self.length + 2)
        self.sums = self._sums(self.symbols)
        self.letter_sums = self._sums((letters.astype(np.uint64) + np.uint64(7)) * _MIX[1] ^ _MIX[2])

    def _sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.length + 1), np.uint64)
        np.cumsum(values * self.power[: self.length], axis=1, out=out[:, 1:])
        return out

    def keys(self, reduced_hash: np.ndarray, length: int, front: np.ndarray | bool) -> np.ndarray:
        """Of neighbours (or the words themselves) of this length: the reduced word with the letters of
        its front half, or with those of its back half."""
        half = length // 2
        back = self.length - (length - half)
        front_hash = self.letter_sums[:, half] * _MIX[2]
        shift = np.uint64(pow(int(_INVERSE), back, 1 << 64))
        back_hash = (self.letter_sums[:, -1] - self.letter_sums[:, back]) * shift * _MIX[3]
        one = np.where(front, front_hash[:, None] + _MIX[0], back_hash[:, None] + _MIX[1])
        mixed = (reduced_hash * _MIX[1]) ^ (one + np.uint64(length) * _MIX[2:3])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
        return mixed ^ (mixed >> np.uint64(32))

    def own(self) -> np.ndarray:
        """Two keys a word: with its front and with its back half."""
        whole = np.repeat(self.sums[:, -1:], 2, axis=1)
        return self.keys(whole, self.length, np.array([True, False]))

    def neighbours(self) -> Iterator[np.ndarray]:
        """Keys of all reduced words at most one edit away, in blocks of positions. An edit in the back
        half leaves the letters of the front half as they are, and the other way round; only a letter
        replaced by one of the same symbol may be in either, so the unedited word comes with both."""
        yield self.own()
        total, symbols = self.sums[:, -1:], np.arange(1, SYMBOLS + 1, dtype=np.uint64)
        step = max(1, ENTRIES_AT_ONCE // (self.n * (2 * SYMBOLS + 1)))
        for i in range(0, self.length + 1, step):
            at = np.arange(i, min(i + step, self.length))
            before, power = self.sums[:, at], self.power[at]
            found = []
            if len(at):
                shorter = before + (total - self.sums[:, at + 1]) * _INVERSE
                found.append(self.keys(shorter, self.length - 1, at >= (self.length - 1) // 2))
                other = (self.symbols[:, at][:, :, None] + symbols[:-1] - np.uint64(1)) % np.uint64(SYMBOLS) + np.uint64(1)
                change = (other - self.symbols[:, at][:, :, None]) * power[:, None]
                same = np.repeat(at >= self.length // 2, SYMBOLS - 1)
                found.append(self.keys((total[:, :, None] + change).reshape(self.n, -1), self.length, same))
            at = np.arange(i, min(i + step, self.length + 1))
            before, power = self.sums[:, at], self.power[at]
            longer = before[:, :, None] + symbols * power[:, None] + ((total - before) * _BASE)[:, :, None]
            same = np.repeat(at >= (self.length + 1) // 2, SYMBOLS)
            found.append(self.keys(longer.reshape(self.n, -1), self.length + 1, same))
            yield np.concatenate(found, axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, Words]]:
    """Rows and Words of each length, few enough at a time."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        some = max(1, ENTRIES_AT_ONCE // int((2 * SYMBOLS + 1) * (length + 1)))
        for i in range(0, len(rows), some):
            part = rows[i : i + some]
            letters = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32)
            yield part, Words(letters.reshape(len(part), length))


def _entries(words: DataFrame, name: str, own: bool) -> DataFrame:
    """words: word and the columns to carry, of which `name` is the first. Adds key: one row for each
    different key of a word."""
    carried = [f for f in words.schema.fields if f.name != "word" or name == "word"]
    places = [words.columns.index(f.name) for f in carried]
    at = words.columns.index("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1 << 13):
            for rows, group in _by_length(b.column(at).to_pylist()):
                for keys in [group.own()] if own else group.neighbours():
                    keys = np.sort(keys, axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    taken = pa.array(np.repeat(rows, new.sum(1)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new].view(np.int64)), *[b.column(k).take(taken) for k in places]],
                        ["key", *[f.name for f in carried]],
                    )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)
    return words.mapInArrow(run, f"key long, {kinds}")


def _near(words: DataFrame) -> DataFrame:
    """words: word and n. word, other and n of the other for all pairs exactly one edit apart; a pair
    may come more than once."""
    one = F.levenshtein("word", "other", 1) == 1
    short = words.where(F.length("word") <= CARRIED)
    left = _entries(short.select("word"), "word", own=False)
    right = _entries(short, "word", own=True).withColumnsRenamed({"word": "other", "key": "own"})
    # Spark takes the neighbours for as small as the words they come from and would broadcast them
    found = left.hint("merge").join(right.hint("merge"), (F.col("key") == F.col("own")) & one).select("word", "other", "n")
    long = words.where(F.length("word") >= CARRIED)
    if long.isEmpty():
        return found
    named = cut(long.withColumn("id", F.monotonically_increasing_id()), "long-words")
    left = _entries(named.select("word", "id"), "id", own=False)
    right = _entries(named.select("word", "id"), "id", own=True).withColumnsRenamed({"id": "to", "key": "own"})
    same = (F.col("key") == F.col("own")) & (F.col("id") != F.col("to"))
    ids = left.hint("merge").join(right.hint("merge"), same).select("id", "to").distinct()
    others = named.select(F.col("id").alias("to"), F.col("word").alias("other"), "n")
    texts = ids.join(named.select("id", "word"), "id").join(others, "to").where(one)
    return found.union(texts.select("word", "other", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms: word and form. word and root, the last of the forms. n grows TIMES-fold at every form, so
    no chain is longer than the digits of the largest n; every round halves what is left of it."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if now.where("next IS NOT NULL").isEmpty():
            return now.select("word", "root")
        now = now.drop("next")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n, one row a word.

    Words are runs of letters (A-Z, a-z and U+00C0 to U+00FF) with A-Z lower-cased, of which some lose a
    letter by a hash of document id and run, with at least 7 letters and 2 occurrences in all. A word's
    form is the near word (one inserted, deleted or replaced letter) of largest n, of equal ones the
    smallest, if it is 10 times as frequent as the word. Null texts have no words, a null id counts as
    the empty text, repeated rows count each time; tables without words give no rows.

    Candidates: every word's reduced neighbourhood meets the reduced words that share one half with it
    letter by letter; the join compares the words themselves. Both sides grow with the vocabulary, and
    a word's partners are bounded by its length.
    """
    words = cut(vocabulary(docs, id_col, text_col), "vocabulary")
    pairs = _near(words).repartition("word").dropDuplicates(["word", "other"])
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("other")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    is_form = -F.col("best.n") >= F.lit(TIMES) * F.col("n")
    found = found.select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n"),
    )
    found = cut(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
