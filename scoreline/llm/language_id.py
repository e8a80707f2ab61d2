"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import batches_of, column, fold, id_text, portions, row_keys, ship

#: The model is fitted on at most this many labelled rows (one a language, if there are more languages),
#: as many of each language: those of the smallest hash of id and text, of equal rows one.
LABELLED = 2000
BUCKETS, DIMENSIONS, LONGEST = 1 << 16, 16, 4
EPOCHS, BATCH, RATE = 4, 32, 0.3
#: One labelled row in so many sets the temperature and the threshold instead of the weights.
CALIBRATION = 5
#: The share of rightly named calibration rows that the threshold turns away.
TURNED_AWAY = 0.01
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
LETTERS_AT_ONCE = 1 << 16
#: Words whose vectors a worker remembers.
REMEMBERED = 1 << 17


def word_counts(text: str) -> Counter[str]:
    """Lower-cased runs of letters; empty without a letter."""
    counts = Counter(m[0] for m in WORD.finditer(text.lower()))
    return counts if any(c.isalpha() for w in counts for c in w) else Counter()


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and buckets of their subwords: all runs of 1 to LONGEST characters of the word
    between its marks, for any length of word."""
    marked = "".join(f"<{w}>" for w in words)
    letters = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    for i in range(0, len(letters), LETTERS_AT_ONCE):
        end = min(i + LETTERS_AT_ONCE, len(letters))
        places, buckets = [], []
        h = np.zeros(end - i, np.uint64)
        for n in range(LONGEST):
            last = min(end, len(letters) - n)
            if last <= i:
                break
            h = (h[: last - i] + letters[i + n : last + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            inside = owner[i:last] == owner[i + n : last + n]
            places.append(owner[i:last][inside])
            buckets.append((h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48))[inside])
        yield np.concatenate(places), np.concatenate(buckets).astype(np.int64) % BUCKETS


def features_of(counts: Counter[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of each among all its subwords."""
    total, words = np.zeros(BUCKETS), list(counts)
    times = np.array(list(counts.values()), float)
    for at, buckets in subwords(words):
        total += np.bincount(buckets, times[at], BUCKETS)
    held = np.flatnonzero(total)
    return held, total[held] / max(total.sum(), 1.0)


def a_piece(text: str, key: int) -> str:
    """A few words from a place that the key chooses, so that short texts are learnt as well."""
    words = text.split()
    n = 4 + key % 17
    at = key // 17 % max(1, len(words) - n)
    return " ".join(words[at : at + n])


def labelled_rows(rows: DataFrame, n: int) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """rows: doc_id, text and lang, none of the latter two null. Language, buckets, shares and whether a
    piece, of at most n // languages rows of each language, and of a piece of each.

    Rows below a bound on their hash are looked at; where repeated rows leave a language short the
    bound is raised. Neither tasks nor driver hold more than the rows asked for.
    """
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return []
    per = max(1, n // len(sizes))
    keyed = rows.select("lang", "text", *row_keys(F.col("doc_id"), F.col("text")))
    share = {lang: min(1.0, 4 * per / size) for lang, size in sizes.items()}
    last: dict[str, tuple[int, int]] = {}
    while missing := [lang for lang in sizes if lang not in last]:
        bounds = {lang: int(share[lang] * (1 << 64)) - (1 << 63) - (share[lang] == 1) for lang in missing}
        below = F.col("k1") <= _of_language(bounds)
        keys = keyed.where(below).select("lang", "k1", "k2").distinct()
        key = F.struct("k1", "k2")
        least = keys.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(key)), 1, per).alias("k"))
        found = {r.lang: [tuple(k) for k in r.k] for r in least.collect()}
        for lang in missing:
            if len(found.get(lang, [])) >= per or share[lang] == 1:
                last[lang] = found[lang][-1]
            else:
                share[lang] = min(1.0, 8 * share[lang])
    k1 = _of_language({lang: k[0] for lang, k in last.items()})
    k2 = _of_language({lang: k[1] for lang, k in last.items()})
    chosen = keyed.where((F.col("k1") < k1) | ((F.col("k1") == k1) & (F.col("k2") <= k2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in portions(batches):
            for lang, text, k1, k2 in zip(*(b.column(i) for i in range(4))):
                key = (k1.as_py(), k2.as_py())
                if key in seen:
                    continue
                seen.add(key)
                text = text.as_py()
                made = [features_of(word_counts(t)) for t in (text, a_piece(text, abs(key[0])))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang.as_py()] * 2), pa.array([key[0]] * 2), pa.array([key[1]] * 2, pa.int32()),
                        pa.array([False, True]), pa.array([m[0].astype("<u2").tobytes() for m in made], pa.binary()),
                        pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
                    ],
                    ["lang", "k1", "k2", "piece", "buckets", "shares"],
                )

    kinds = "lang string, k1 long, k2 int, piece boolean, buckets binary, shares binary"
    made = chosen.mapInArrow(run, kinds).groupBy("lang", "k1", "k2", "piece")
    out = made.agg(F.first("buckets").alias("buckets"), F.first("shares").alias("shares")).collect()
    out = sorted(out, key=lambda r: (r.k1, r.k2, r.lang, r.piece))
    return [
        (r.lang, np.frombuffer(r.buckets, "<u2").astype(np.int64), np.frombuffer(r.shares, "<f4"), r.piece)
        for r in out
        if len(r.buckets)
    ]


def _of_language(values: dict[str, int]) -> Column:
    """The value of the row's language; null for others."""
    pairs = [F.lit(x) for lang, value in sorted(values.items()) for x in (lang, int(value))]
    kinds = F.create_map(*pairs).cast("map<string,bigint>")
    return F.element_at(kinds, F.col("lang"))


class Model:
    """Embeddings of buckets, weights and biases of languages, the temperature and the threshold."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.embedding = np.zeros((BUCKETS, DIMENSIONS))
        self.weights = np.random.default_rng(0).standard_normal((DIMENSIONS, len(languages)))
        self.bias = np.zeros(len(languages))
        self.temperature, self.threshold = 1.0, 0.0

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Rows of language probabilities for rows of averaged embeddings."""
        logits = (means @ self.weights + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def mean(self, buckets: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return shares @ self.embedding[buckets]


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, bool]]) -> Model:
    """Minimises the cross-entropy by stochastic gradient steps over small batches (AdaGrad), then sets
    the temperature by the likelihood of rows left aside and the threshold by their scores."""
    languages = sorted({lang for lang, *_ in rows})
    model = Model(languages)
    y = np.array([languages.index(lang) for lang, *_ in rows], int)
    aside = np.arange(len(rows)) // 2 % CALIBRATION == CALIBRATION - 1  # a text and its piece together
    learnt = np.flatnonzero(~aside)
    squares = [np.full(a.shape, 1e-6) for a in (model.embedding, model.weights, model.bias)]
    order = np.random.default_rng(0)

    def step(into: np.ndarray, squares: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        squares[at] += gradient**2
        into[at] -= RATE * gradient / np.sqrt(squares[at])

    for _ in range(EPOCHS if len(languages) > 1 else 0):
        for at in np.array_split(order.permutation(learnt), -(-len(learnt) // BATCH)):
            buckets = np.concatenate([rows[i][1] for i in at])
            shares = np.concatenate([rows[i][2] for i in at])
            owner = np.repeat(np.arange(len(at)), [len(rows[i][1]) for i in at])
            begins = np.searchsorted(owner, np.arange(len(at)))
            means = np.add.reduceat(model.embedding[buckets] * shares[:, None], begins, axis=0)
            error = model.probabilities(means)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = error @ model.weights.T
            by_bucket = np.argsort(buckets, kind="stable")
            own = buckets[by_bucket]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            gradient = np.add.reduceat(back[owner[by_bucket]] * shares[by_bucket, None], first, axis=0)
            step(model.embedding, squares[0], gradient, own[first])
            step(model.weights, squares[1], means.T @ error)
            step(model.bias, squares[2], error.sum(axis=0))
    if aside.any() and len(languages) > 1:
        means = np.array([model.mean(*rows[i][1:3]) for i in np.flatnonzero(aside)])
        logits, right = means @ model.weights + model.bias, y[aside]

        def loss(temperature: float) -> float:
            scaled = logits / temperature
            top = scaled.max(axis=1)
            return float((top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[np.arange(len(right)), right]).mean())

        model.temperature = min(np.exp(np.linspace(-3, 3, 121)), key=loss)
        p = model.probabilities(means)
        good = p.argmax(axis=1) == right
        model.threshold = float(np.quantile(p.max(axis=1)[good], TURNED_AWAY)) if good.any() else 0.0
    return model


class Scorer:
    """Scores texts, remembering the summed subword vectors of words."""

    def __init__(self, model: Model):
        self.model = model
        self.table = model.embedding.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, DIMENSIONS), np.float32)
        self.sizes = np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        sums, sizes = np.zeros((len(words), DIMENSIONS), np.float32), np.zeros(len(words))
        for at, buckets in subwords(words):
            order = np.argsort(at, kind="stable")
            at, buckets = at[order], buckets[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sums[at[first]] += np.add.reduceat(self.table[buckets], first, axis=0)
            sizes += np.bincount(at, minlength=len(words))
        for k, w in enumerate(words, len(self.place)):
            self.place[w] = k
        self.sums, self.sizes = np.concatenate([self.sums, sums]), np.r_[self.sizes, sizes]

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        counts = [word_counts(t) for t in texts]
        wanted = dict.fromkeys(w for c in counts for w in c)
        if unknown := [w for w in wanted if w not in self.place]:
            if len(self.place) + len(unknown) > REMEMBERED:
                self._forget()
                unknown = list(wanted)
            self._learn(unknown)
        means = np.zeros((len(texts), DIMENSIONS))
        for i, c in enumerate(counts):
            at = np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))
            times = np.fromiter(c.values(), np.float64, len(c))
            means[i] = times @ self.sums[at] / max(times @ self.sizes[at], 1.0)
        p = self.model.probabilities(means)
        best = p.argmax(axis=1)
        score = p[np.arange(len(texts)), best]
        known = [bool(c) for c in counts]
        return (
            [self.model.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
            [float(s) if k else 0.0 for s, k in zip(score, known)],
            [bool(k and s >= self.model.threshold) for s, k in zip(score, known)],
        )


def language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: Column | None = None,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row of docs.

    The model learns from rows that aren't held out (fold 2 of 4 unless given) and have a language, a
    text and a letter; of equal probabilities the language first in order is taken. accepted is false
    where the calibrated probability, score, is below the threshold. Null texts and texts without a
    letter are `und`, of score 0 and not accepted, as all texts are if there is nothing to learn from.
    Null ids count as the empty text; rows with a repeated id are rows of their own.
    """
    ship(docs.sparkSession)
    held = F.lit(False) if held_out is None else held_out
    rows = id_text(docs, id_col, text_col, lang=docs[lang_col].cast("string"), held_out=held)
    if held_out is None:
        rows = rows.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    learnt = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & (F.col("text") != ""))
    model = fit(labelled_rows(learnt.select("doc_id", "text", "lang"), LABELLED))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size and a row a language
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value) if sent.value.languages else None
        for b in portions(batches):
            texts = column(b, "text")
            parts = [score(texts[i:j]) for i, j in batches_of(map(len, texts)) if j > i] if score else []
            found = [sum((p[k] for p in parts), []) for k in range(3)]
            if not score:
                found = [[UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(b.schema.get_field_index("held_out")),
                    pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    out = rows.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean"
    )
    return out
