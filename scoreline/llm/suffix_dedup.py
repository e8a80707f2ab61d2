"""Removal of byte strings that occur more than once, by sorting sampled suffixes.

A string of LENGTH bytes is repeated if it starts at two places of the table. Every such window has
an anchor, the place of the smallest hash among the grams of GRAM bytes inside it; equal windows
have their anchors at equal offsets, so only windows of equal anchors need to be compared, and one
suffix in some 85 stands for all. Three steps leave little to sort:

1. Anchors are counted by gram. A gram that occurs once owns no repeated window.
2. If all occurrences of a gram stand in equal surroundings (the bytes of all windows it owns), all
   these windows are repeated.
3. Of the others, one suffix for each distinct surroundings is dealt out by ranges of its leading
   bytes, with splitters that Spark samples. Buckets are sorted by multikey quicksort, and equal
   neighbours are repeated windows. A gram at the edge of a bucket may go on in the next one: its
   windows are compared across the boundary by hash, so a gram of any size is split.

Hashes only choose anchors and name surroundings (64 bits within one gram).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import SLICE_BYTES, batches_of, column, cut, id_text, passing, portions, ship

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a window
PLACE_BITS = 21
BUCKET_BYTES = 8 << 20
WINDOWS_AT_ONCE = 1 << 19
#: Offsets [low, high] of windows: an equal window has the same `low` bytes before the anchor and
#: the same LENGTH - high bytes from it on.
LEVELS = [(0, 1), (2, 7), (8, 23), *((k, min(k + 24, SPAN) - 1) for k in range(24, SPAN, 24))]
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _words(data: bytes | np.ndarray, order: str) -> np.ndarray:
    """The eight bytes at every place as one number; a view."""
    return np.ndarray((len(data) - 7,), f"{order}u8", data, strides=(1,))


def _gram_hashes(data: bytes) -> np.ndarray:
    eight = _words(data, "<").astype(np.uint64)
    n = len(data) - GRAM + 1
    h = eight[:n] * _FACTORS[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += eight[8 * k : 8 * k + n] * _FACTORS[k]
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    return h ^ (h >> np.uint64(29))


def anchors_of(pieces: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined pieces, and for each anchor its piece, its place in the joined bytes, and the
    first and last window start that it owns."""
    data = b"".join(pieces)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, none, none, none, none
    assert len(data) < 1 << PLACE_BITS
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (_gram_hashes(data) & ~low) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    n = len(data) - LENGTH + 1
    owner = (np.minimum(key[:n], key[SPAN - width : SPAN - width + n]) & low).astype(np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(pieces)), lengths)[:n]
    starts = np.flatnonzero(np.arange(n) + LENGTH <= (begins + lengths)[piece])
    if not len(starts):
        return data, none, none, none, none
    owner, piece = owner[starts], piece[starts]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    return data, piece[new], owner[new], starts[new], starts[last]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of rows, offsets and bytes of some SLICE_BYTES; a longer text comes in pieces that
    share LENGTH - 1 bytes, so each window is in one piece. Texts without a window are left out."""
    for i, text in enumerate(texts):
        if len(text) > SLICE_BYTES:
            for at in range(0, len(text) - LENGTH + 1, SLICE_BYTES):
                yield [i], [at], [text[at : at + SLICE_BYTES + LENGTH - 1]]
    rows = [i for i, text in enumerate(texts) if LENGTH <= len(text) <= SLICE_BYTES]
    for i, j in batches_of(len(texts[k]) for k in rows):
        if rows[i:j]:
            yield rows[i:j], [0] * (j - i), [texts[k] for k in rows[i:j]]


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column(batch, "text")]


def anchors(rows: DataFrame) -> DataFrame:
    """rows: text, k1, k2. For each anchor: g (hash of its gram), c (of its surroundings), the row's
    keys, and p = place << 16 | bytes from the first owned start << 8 | from the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch in portions(batches):
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for rows, offsets, pieces in _pieces(_encoded(batch)):
                data, piece, place, first, last = anchors_of(pieces)
                lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
                begins = np.cumsum(lengths) - lengths
                hi, lo = place - first, place - last
                g = [h(data[a : a + GRAM]) for a in place.tolist()]
                ends = (last + LENGTH).tolist()
                shape = (hi << 8 | lo).tolist()
                c = [h(data[a:b], s) for a, b, s in zip(first.tolist(), ends, shape)]
                row = np.array(rows, np.int64)[piece]
                at = place - begins[piece] + np.array(offsets, np.int64)[piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(g, np.uint64).view(np.int64)),
                        pa.array(np.array(c, np.uint64).view(np.int64)),
                        pa.array(k1[row]),
                        pa.array(k2[row]),
                        pa.array(at << 16 | hi << 8 | lo),
                    ],
                    ["g", "c", "k1", "k2", "p"],
                )

    return rows.select("text", "k1", "k2").mapInArrow(run, "g long, c long, k1 long, k2 int, p long")


def repeated_windows(view: np.ndarray, starts: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows equal another one of the same label, and the first of each such class:
    multikey quicksort, eight bytes of the key at a time over all windows that still have an equal
    neighbour."""
    out, one = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    order = np.argsort(label, kind="stable")
    at, label = order, label[order]
    for depth in range(0, LENGTH, 8):
        new = np.r_[True, label[1:] != label[:-1]]
        label = np.cumsum(new) - 1
        keep = np.bincount(label)[label] > 1
        at, label = at[keep], label[keep]
        if not len(at):
            return out, one
        new = np.r_[True, label[1:] != label[:-1]]
        label = np.cumsum(new) - 1
        word = view[starts[at] + depth].astype(np.uint64)
        differ = word != word[np.flatnonzero(new)][label]
        mixed = np.bincount(label, differ)[label] > 0
        if mixed.any():  # only these classes fall apart
            a, w, k = at[mixed], word[mixed], label[mixed]
            order = np.lexsort((w, k))
            a, w, k = a[order], w[order], k[order]
            k = np.cumsum(np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])]) + label[-1]
            at, label = np.r_[at[~mixed], a], np.r_[label[~mixed], k]
    new = np.r_[True, label[1:] != label[:-1]]
    label = np.cumsum(new) - 1
    many = np.bincount(label)[label] > 1
    out[at[many]] = True
    one[at[many & new]] = True
    return out, one


def _blocks(gram: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and offsets of windows, whole grams of some WINDOWS_AT_ONCE; a larger gram by offsets.
    gram: ascending numbers."""
    sizes = np.bincount(gram, hi - lo + 1).astype(np.int64)
    ends = np.cumsum(np.bincount(gram))
    for i, j in batches_of(sizes.tolist(), WINDOWS_AT_ONCE):
        rows = np.arange(ends[i - 1] if i else 0, ends[j - 1])
        if not len(rows):
            continue
        step = 256 if sizes[i:j].sum() <= 2 * WINDOWS_AT_ONCE else max(1, WINDOWS_AT_ONCE // len(rows))
        for o in range(0, SPAN, step):
            a, b = np.maximum(lo[rows], o), np.minimum(hi[rows], o + step - 1)
            n = np.maximum(b - a + 1, 0)
            owner = np.repeat(rows, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            yield owner, offset


def sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of distinct surroundings: kind 0, the runs [a, b] of offsets whose windows are
    repeated; kind 1, for the grams at the bucket's edges the hash of what a partner in another
    bucket must share, by level."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    g, c, n, p = (table.column(k).to_numpy() for k in ("g", "c", "n", "p"))
    text = table.column("ctx").to_pylist()
    order = np.lexsort((c, g))
    order = order[np.r_[True, (g[order][1:] != g[order][:-1]) | (c[order][1:] != c[order][:-1])]]
    g, c, n, p, text = g[order], c[order], n[order], p[order], [text[i] for i in order]
    hi, lo = p >> 8 & 255, p & 255
    data = np.frombuffer(b"".join(text) + bytes(8), np.uint8)
    lengths = np.fromiter(map(len, text), np.int64, len(text))
    base = np.cumsum(lengths) - lengths
    view = _words(data, ">")
    gram = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1

    def out(kind: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray, windows: list | None = None) -> pa.RecordBatch:
        arrays = [np.full(len(rows), kind, np.int32), g[rows], c[rows], a.astype(np.int64), b.astype(np.int64)]
        bits = pa.array(windows if windows is not None else [None] * len(rows), pa.binary())
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays), bits], ["kind", "g", "c", "a", "b", "windows"])

    suffix = [t[h:] for t, h in zip(text, hi.tolist())]
    edges = {int(gram[suffix.index(min(suffix))]), int(gram[suffix.index(max(suffix))])}
    at_edge = np.flatnonzero(np.isin(gram, list(edges)))
    number = np.full(len(gram), -1)
    number[at_edge] = np.arange(len(at_edge))
    # windows of these that stand for themselves or for their class in the other buckets
    open_windows = np.zeros((len(at_edge), SPAN), bool)
    all_repeated = np.flatnonzero(n > 1)
    yield out(0, all_repeated, lo[all_repeated], hi[all_repeated])
    for owner, offset in _blocks(gram, hi, lo):
        start = base[owner] + hi[owner] - offset
        again, one = repeated_windows(view, start, gram[owner] << 8 | offset)
        left = np.flatnonzero((number[owner] >= 0) & (one | ~again))
        open_windows[number[owner[left]], offset[left]] = True
        found = np.flatnonzero(again)
        if len(found):
            o, k = offset[found], owner[found]
            new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1] + 1)]
            first = np.flatnonzero(new)
            yield out(0, k[first], o[first], o[np.r_[first[1:], len(o)] - 1])
    for i in range(0, len(at_edge), 4096):
        at, level, around = [], [], []
        for r in at_edge[i : i + 4096].tolist():
            for j, (low, high) in enumerate(LEVELS):
                if open_windows[number[r], low : high + 1].any():
                    part = text[r][hi[r] - low : hi[r] + LENGTH - high]
                    at.append(r)
                    level.append(j)
                    around.append(xxhash.xxh3_64_intdigest(part, low))
        bits = np.packbits(open_windows[number[np.array(at, np.int64)]], axis=1)
        yield out(
            1, np.array(at, np.int64), np.array(level), np.array(around, np.uint64).view(np.int64), list(map(bytes, bits))
        )


def across_edges(contexts: DataFrame, edge: DataFrame) -> DataFrame:
    """Runs [a, a] of windows that are repeated in another bucket. edge: kind 1 of sort_bucket.

    A partner of a window must share the bytes of its level; only windows that have one there, and
    of those that are equal within a bucket one, are looked at one by one. Both times equal hashes are counted first, and joined from a table, so a
    hash that very many surroundings share is split.
    """
    counts = cut(edge.groupBy("g", "a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "levels")
    some = edge.join(counts, ["g", "a", "b"]).groupBy("g", "c").agg(
        F.collect_set("a").alias("levels"), F.max("windows").alias("windows")
    )
    rows = contexts.dropDuplicates(["g", "c"]).join(some, ["g", "c"]).select("g", "c", "p", "ctx", "levels", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, c, p = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at, offsets, hashes = [], [], []
            for i, (text, levels, bits) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5)))):
                hi = int(p[i]) >> 8 & 255
                still = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                for j in levels:
                    for o in still[(still >= LEVELS[j][0]) & (still <= LEVELS[j][1])].tolist():
                        at.append(i)
                        offsets.append(o)
                        hashes.append(xxhash.xxh3_64_intdigest(text[hi - o : hi - o + LENGTH]))
            at = np.array(at, np.int64)
            w = np.array(hashes, np.uint64).view(np.int64)
            arrays = [pa.array(x) for x in (g[at], c[at], np.array(offsets, np.int64), w)]
            yield pa.RecordBatch.from_arrays(arrays, ["g", "c", "o", "w"])

    windows = cut(rows.mapInArrow(run, "g long, c long, o long, w long"), "windows")
    often = cut(windows.groupBy("g", "o", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "windows")
    found = windows.join(often, ["g", "o", "w"])
    return found.select("g", "c", F.col("o").alias("a"), F.col("o").alias("b"))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """row (a struct of all columns but the text), two hashes of row and text, and the text."""
    others = [docs[c] for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        row.alias("row"), F.xxhash64(row, text).alias("k1"), F.hash(text, row).alias("k2"), text.alias("text")
    )


def _packed(docs: DataFrame, text_col: str) -> DataFrame:
    """row, the keys, and the text as compressed UTF-8."""
    keyed = _keyed(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in portions(batches):
            z = pa.array([pack(t) for t in _encoded(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), z], ["row", "k1", "k2", "z"])

    return keyed.mapInArrow(run, f"row {keyed.schema['row'].dataType.simpleString()}, k1 long, k2 int, z binary")


def _contexts(packed: DataFrame, mixed: DataFrame) -> DataFrame:
    """g, c, n (occurrences), p and the bytes of one occurrence for each distinct surroundings."""
    one = mixed.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("r"))
    wanted = one.groupBy("r.k1", "r.k2").agg(F.collect_list(F.struct("g", "c", "n", "r.p")).alias("wanted"))
    rows = packed.select("k1", "k2", "z").join(cut(wanted, "wanted"), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            wanted, z = b.column(1), b.column(0)
            for i in range(b.num_rows):
                data = unpack(z[i].as_py())
                g, c, n, p = (wanted[i].values.field(k) for k in range(4))
                places = p.to_numpy()
                at, hi, lo = places >> 16, places >> 8 & 255, places & 255
                ctx = [data[x:y] for x, y in zip((at - hi).tolist(), (at - lo + LENGTH).tolist())]
                yield pa.RecordBatch.from_arrays([g, c, n, p, pa.array(ctx, pa.binary())], ["g", "c", "n", "p", "ctx"])

    return rows.select("z", "wanted").mapInArrow(run, "g long, c long, n long, p long, ctx binary")


def repeats(packed: DataFrame, rows: DataFrame) -> DataFrame:
    """k1, k2 and spans, the byte ranges [s, e) of every row that repeated windows cover."""
    with passing(packed.sparkSession):
        return cut(_spans(packed, rows), "spans", stays=True)


def _spans(packed: DataFrame, rows: DataFrame) -> DataFrame:
    spark = packed.sparkSession
    found = anchors(rows)
    counts = found.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    counts = cut(counts.where("n > 1").select("g", (F.col("least") == F.col("most")).alias("same")), "grams")
    again = cut(found.join(counts, "g"), "repeats")
    mixed = again.where("NOT same")
    contexts = cut(_contexts(packed, mixed), "contexts")
    size = contexts.agg(F.sum(F.octet_length("ctx")).cast("long")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    leading = F.expr("substring(ctx, int((p >> 8) & 255) + 1)")
    dealt = contexts.repartitionByRange(buckets, leading, "c")
    runs = cut(dealt.mapInArrow(sort_bucket, "kind int, g long, c long, a long, b long, windows binary"), "runs")
    inside = runs.where("kind = 0").select("g", "c", "a", "b")
    runs = cut(inside.union(across_edges(contexts, runs.where("kind = 1"))), "runs")
    place = F.expr("p >> 16")
    some = mixed.join(runs, ["g", "c"]).select(
        "k1", "k2", (place - F.col("b")).alias("s"), (place - F.col("a") + LENGTH).alias("e")
    )
    whole = again.where("same").select(
        "k1", "k2", F.expr("(p >> 16) - ((p >> 8) & 255)").alias("s"), F.expr(f"(p >> 16) - (p & 255) + {LENGTH}").alias("e")
    )
    return whole.union(some).groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _united(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching ranges as one."""
    s, e = (spans.values.field(k).to_numpy() for k in (0, 1))
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:], len(e)] - 1]


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row (a struct of all other columns), kept_sha256 (of the remaining bytes), kept_text (without
    the bytes of a character that was cut in two), n_bytes, n_removed, n_spans for every row of docs. Matches never cross rows; rows that are repeated as a whole count as each
    other's copies. Texts under LENGTH bytes, null and empty ones included, lose nothing.
    """
    ship(docs.sparkSession)
    packed = _packed(docs, text_col)
    rows = packed.join(repeats(packed, _keyed(docs, text_col)), ["k1", "k2"], "left").select("row", "z", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            kept, texts, n_bytes, n_removed, n_spans = [], [], [], [], []
            for i in range(b.num_rows):
                data = unpack(b.column(1)[i].as_py())
                left, gone, n = data, 0, 0
                if b.column(2)[i].is_valid:
                    s, e = _united(b.column(2)[i])
                    n, gone = len(s), int((e - s).sum())
                    left = b"".join(data[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(data)]))
                kept.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "ignore"))
                n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(n)
            numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.string()), pa.array(texts, pa.string()), *numbers],
                ["row", "kept_sha256", "kept_text", "n_bytes", "n_removed", "n_spans"],
            )

    kind = packed.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, kept_sha256 string, kept_text string, n_bytes long, n_removed long, n_spans long")


def suffix_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    found = remove_repeats(id_text(docs, id_col, text_col))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with kept_text for the text."""
    found = remove_repeats(docs, text_col)
    columns = [F.col("kept_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)
