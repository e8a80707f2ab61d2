"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import cut, ship

COMPONENTS = 4
#: An entry c becomes the whole number floor(SCALE * c).
SCALE = 256
#: Bytes of a block of vectors; a task holds one block as doubles at a time.
BLOCK_BYTES = 1 << 18
#: Relative size under which a product counts as zero, and the bound on the error of a component at
#: which no further steps are taken.
ZERO, CLOSE = 1e-13, 1e-13
#: Beyond this the sum of squares is added up without machine words.
SAFE = 2.0**62


def whole_numbers(vector: Column) -> Column:
    """The vector's whole numbers without the zeros at its end; null if it is null or has entries that
    are null or not finite."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(entries, lambda c: F.floor(c * F.lit(float(SCALE))))
    last = F.aggregate(
        whole, F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")),
        lambda at, x: F.struct((at.i + 1).alias("i"), F.when(x != 0, at.i + 1).otherwise(at["last"]).alias("last")),
        lambda at: at["last"],
    )
    return F.when(finite, F.slice(whole, 1, last))


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix of longs, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """Bytes of a matrix of longs in the narrowest type that holds them, and the bytes of a number."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return x.astype(f"<i{width}").tobytes(), width


def blocks_of(vectors: DataFrame, width: int) -> DataFrame:
    """vectors: x, no row twice. Blocks of at most BLOCK_BYTES as rows and data."""
    some = max(1, BLOCK_BYTES // (8 * max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width), np.int64)

        def out(part: np.ndarray) -> pa.RecordBatch:
            data, size = _packed(part)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int32()), pa.array([size], pa.int32()), pa.array([data], pa.binary())],
                ["rows", "size", "data"],
            )

        for b in batches:
            for i in range(0, b.num_rows, some):
                held = np.concatenate([held, _padded(b.column(0).slice(i, some), width)])
                while len(held) >= some:
                    yield out(held[:some])
                    held = held[some:]
        if len(held):
            yield out(held)

    return vectors.select("x").mapInArrow(run, "rows int, size int, data binary")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for b in batches:
        for rows, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            yield np.frombuffer(data.as_buffer(), f"<i{size}").reshape(rows, width)


def moments(blocks: DataFrame, width: int) -> tuple[int, list[int], int]:
    """n, the sum of each dimension and the sum of all squares, exact."""

    def exact(x: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        top = float(np.abs(x.astype(np.float64)).max(initial=0.0))
        y = x.astype(np.int64) if top * (top if times is not None else 1) * max(x.size, 1) < SAFE else x.astype(object)
        return y * y if times is not None else y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * width, 0
        for x in _matrices(batches, width):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, exact(x).sum(axis=0))]
            squares += int(exact(x, x).sum())
        parts = []  # (place, digit, value) of whole numbers of any size in digits of 40 bits
        for k, v in enumerate([n, squares, *sums]):
            digit = 0
            while not -(1 << 40) < v < 1 << 40:
                parts.append((k, digit, v & (1 << 40) - 1))
                v, digit = v >> 40, digit + 1
            parts.append((k, digit, v))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*parts)], ["k", "digit", "v"])

    rows = blocks.mapInArrow(run, "k long, digit long, v long").groupBy("k", "digit").agg(F.sum("v").alias("v"))
    totals = [0] * (width + 2)
    for r in rows.collect():  # a few rows for each dimension
        totals[r.k] += r.v << 40 * r.digit
    return totals[0], totals[2:], totals[1]


def _summed(blocks: DataFrame, width: int, of, size: int) -> np.ndarray:
    """The sum over all blocks of of(block), `size` doubles. Tasks send their sums to be added up by
    place, so that the driver receives one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _matrices(batches, width):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    rows = blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.k] = r.v
    return out


def products(blocks: DataFrame, width: int, mean: np.ndarray):
    """A function that gives, for a vector w, Xᵀ(Xw) and the squared length of Xw, X the centred rows:
    one pass over the blocks, each of which makes its part of u = Xw and of Xᵀu."""

    def both(w: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ w
            return np.r_[centred.T @ u, u @ u]

        found = _summed(blocks, width, of, width + 1)
        return found[:-1], float(found[-1])

    return both


def _orthogonal(r: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        r = r - basis @ (basis.T @ r)
    return r


def bidiagonalise(both, width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of X and their right singular vectors as columns.

    Steps alternate u = Xv and v = Xᵀu. The left vectors have a row for each row of X and stay there:
    each is X times a vector w, so that w and Xᵀu, both of `width` entries, are all that is kept of it,
    and its products with the earlier ones are w · Xᵀu. Both sides are reorthogonalised against all
    earlier vectors, twice. Where a side comes to its end, the next vector is a new one orthogonal to
    all. Steps end when the bound on the error of the wanted vectors is met, or with the dimensions.
    """
    draw = np.random.default_rng(0)
    right = np.zeros((width, 0))  # v
    made = np.zeros((width, 0))  # w
    back = np.zeros((width, 0))  # Xᵀu
    alphas: list[float] = []
    betas: list[float] = []
    start, _ = both(draw.standard_normal(width))
    scale = float(np.linalg.norm(start))
    if scale == 0:
        return np.zeros(0), np.zeros((width, 0))
    v = start / scale
    for k in range(width):
        right = np.c_[right, v]
        w = v - (betas[-1] * made[:, -1] if betas else 0)
        for _ in range(2):
            w = w - made @ (back.T @ w)
        z, square = both(w)
        alpha = float(np.sqrt(square))
        biggest = max(alphas + betas + [alpha])
        if alpha <= ZERO * biggest:
            alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            w, z = w / alpha, z / alpha
        alphas.append(alpha)
        made, back = np.c_[made, w], np.c_[back, z]
        r = _orthogonal(z - alpha * v, right)
        beta = float(np.linalg.norm(r))
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, rows = np.linalg.svd(small)
        if k + 1 >= min(width, wanted + 2):
            # the residual of the i-th triple is beta times the last entry of its left vector
            gaps = np.abs(values[:wanted, None] - values[None, :])
            gaps[np.arange(min(wanted, len(values))), np.arange(min(wanted, len(values)))] = np.inf
            error = beta * np.abs(left[-1, :wanted]) / np.maximum(gaps.min(axis=1), ZERO * values[0])
            if (error <= CLOSE).all():
                break
        if k + 1 == width:
            break
        if beta <= ZERO * biggest:
            beta = 0.0
            r = _orthogonal(draw.standard_normal(width), right)
            r = _orthogonal(r / np.linalg.norm(r), right)
        betas.append(beta)
        v = r / np.linalg.norm(r)
    keep = values > ZERO * values[0]
    return values[keep][:wanted], (right @ rows.T)[:, keep][:, :wanted]


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)²; null where it is no long."""
    about = n * x.astype(np.float64) - sums.astype(np.float64)
    if max((about * about).sum(axis=1).max(initial=0.0), np.abs(about).max(initial=0.0)) < SAFE and (
        n * np.abs(x.astype(np.float64)).max(initial=0.0) < SAFE and max(map(abs, sums), default=0) < SAFE
    ):
        d = n * x - sums.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each row with a
    usable vector and each component.

    Rows whose vector is null, or holds a null or an entry that isn't finite, are left out; ids may be
    null or repeated. Entries become whole numbers x (those beyond a long its nearest). Components are
    those of the distinct x-vectors, each counted once; a shorter vector counts as one with zeros at its
    end. There are no more components than dimensions with variance, so one distinct vector, or none,
    gives no rows; of equal variances any basis is taken. deviation is null where it exceeds a long.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].alias("vec_id"), whole_numbers(vectors[vector_col]).alias("x"))
    rows = rows.where("x IS NOT NULL")
    distinct = cut(rows.select("x").distinct(), "whole-vectors")
    width = int(distinct.agg(F.max(F.size("x"))).first()[0] or 0)
    # read in every step; an executor that is lost makes its part again from the table
    blocks = cut(blocks_of(distinct, width), "vector-blocks").persist(StorageLevel.MEMORY_AND_DISK)
    n, sums, squares = moments(blocks, width)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    trace = n * squares - sum(s * s for s in sums)  # n² times the trace of the covariance
    if not trace:
        blocks.unpersist()
        return vectors.sparkSession.createDataFrame([], schema)
    mean = np.array([s / n for s in sums])
    values, axes = bidiagonalise(products(blocks, width, mean), width, components)
    found = len(values)
    deviations = values / np.sqrt(n)

    def spread(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ axes / deviations
        return np.r_[y.sum(axis=0), (y.T @ y).ravel()]

    total = _summed(blocks, width, spread, found + found * found) / n
    blocks.unpersist()
    covariance = total[found:].reshape(found, found) - np.outer(total[:found], total[:found])
    identity_error = float(np.abs(covariance - np.eye(found)).max())
    explained = values**2 / n / (trace / n**2)
    exact_sums = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                x = _padded(b.column(1), width)
                y = (x - mean) @ axes / deviations
                places = pa.array(np.repeat(np.arange(len(x)), found))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(places),
                        pa.array(np.tile(np.arange(1, found + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(places), n)),
                        pa.array(_deviation(x, n, exact_sums), pa.int64()).take(places),
                        pa.array(y.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(places), identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
