"""Embedding whitening from a bit-sliced scatter matrix.

Components become integers. A first pass finds each dimension's smallest and largest
integer; shifted by the smallest they have few bits. The second pass slices a batch of rows
into bit planes, one bit a row, 64 rows a word: the sum over rows of x_i * x_j is the sum
over pairs of planes of 2^(p+q) times the number of ones in their AND. Products are thus
exact, and so is n * sum(x_i * x_j) - S_i * S_j, which is centred before anything becomes a
floating number and goes to the eigensolver. Only matrices of dimension by dimension reach the driver.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that are sliced at a time (whole words), and bits of a component at most, so that sums of products fit 38 digits.
ROWS, BITS = 1 << 13, 48


def vectors(batch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x) of the rows of (id, vector) whose vector is whole and finite; missing last dimensions are zeros."""
    import pyarrow.compute as pc

    column = batch.column(1)
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    valid = np.array(column.is_valid())
    size = np.where(valid, np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    sound = valid & (np.bincount(row, ~np.isfinite(values), minlength=len(size)) == 0)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x = np.zeros((len(size), dims))
    inside = sound[row] & (at < dims)
    x[row[inside], at[inside]] = values[inside]
    place = np.flatnonzero(sound)
    whole = np.floor(x[place] * SCALE) + OFFSET
    if np.abs(whole).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large for its integer")
    return place, whole.astype(np.int64)


def planes(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of non-negative integers (rows, dims): one row a plane, dimension by dimension, 64 rows of ``x`` a word."""
    words = -(-len(x) // 64)
    out = np.zeros((sum(bits), words), np.uint64)
    k = 0
    for d, n in enumerate(bits):
        for p in range(n):
            packed = np.packbits((x[:, d] >> p & 1).astype(np.uint8), bitorder="little")
            out[k].view(np.uint8)[: len(packed)] = packed
            k += 1
    return out


def products(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums over rows of x_i * x_j for i <= j (the rest is zero), from ANDs of bit planes and counts of their ones.

    ``x`` has ROWS rows at most. 64-bit whole numbers for up to 20 bits, Python's beyond.
    """
    kind = np.int64 if max(bits, default=0) <= 20 else object
    out = np.zeros((len(bits), len(bits)), kind)
    live = [d for d, n in enumerate(bits) if n]  # constant dimensions have no planes
    edges = np.cumsum([0, *[bits[d] for d in live]])
    weight = np.array([2**q for d in live for q in range(bits[d])], kind)
    sliced = planes(x, bits)
    for k, i in enumerate(live):
        rest, starts = sliced[edges[k] :], edges[k:-1] - edges[k]
        for p in range(bits[i]):
            ones = np.bitwise_count(rest & rest[p]).sum(axis=1, dtype=np.int64)
            out[i, live[k:]] += np.add.reduceat(ones.astype(kind) * weight[edges[k] :], starts) * 2**p
    return out


def extent(own: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray, list[int]]:
    """n, dimensions, smallest and largest integers, exact sums. One row a task and dimension is summed in Spark."""
    dims = own.agg(F.max(F.size("v"))).first()[0]
    dims = max(dims or 0, 0)

    def run(batches):
        import pyarrow as pa

        n, low, high, total = 0, np.full(dims, 2**62), np.full(dims, -(2**62)), [0] * dims
        for b in slices(batches, ROWS):
            place, x = vectors(b, dims)
            if len(place):
                n += len(place)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
                # Shifted by the batch's smallest, so that a batch's sum fits 64 bits.
                least = x.min(axis=0)
                total = [t + int(s) + len(x) * int(m) for t, s, m in zip(total, (x - least).sum(axis=0, dtype=object) if (x.max(axis=0) - least).max(initial=0) >= 2**49 else (x - least).sum(axis=0), least, strict=True)]
        columns = [pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(low), pa.array(high), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([c if n else c[:0] for c in columns], ["d", "n", "low", "high", "total"])

    found = own.mapInArrow(run, "d int, n long, low long, high long, total decimal(38,0)").groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    rows = sorted(found.collect())  # one row a dimension
    if not rows:
        return 0, dims, np.zeros(dims, np.int64), np.zeros(dims, np.int64), [0] * dims
    return rows[0]["n"], dims, np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]), [int(r["total"]) for r in rows]


def scatter(own: DataFrame, dims: int, low: np.ndarray, high: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sums of (x_i - low_i) * (x_j - low_j) over all rows, for i <= j."""
    bits = [int(b - a).bit_length() for a, b in zip(low, high, strict=True)]
    if max(bits, default=0) > BITS:
        raise ValueError(f"a dimension spans over 2^{BITS} integers")

    def run(batches):
        import pyarrow as pa

        total: dict[tuple[int, int], int] = {}
        held, n = 0, 0

        def add():
            for i, row in enumerate(held.tolist() if n else ()):
                for j, v in enumerate(row[i:], i):
                    if v:
                        total[i, j] = total.get((i, j), 0) + v

        for b in slices(batches, ROWS):
            place, x = vectors(b, dims)
            if len(place):
                held, n = held + products(x - low, bits), n + 1
                if n == 512:  # 2^13 rows of 40 bits each: 64 bits hold the sum
                    add()
                    held, n = 0, 0
        add()
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([Decimal(total[k]) for k in keys], pa.decimal128(38, 0))], ["i", "j", "v"])

    sums = own.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}  # dimension by dimension


def components(n: int, dims: int, low: np.ndarray, totals: list[int], products: dict[tuple[int, int], int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, explained shares) of the covariance, largest first, ``k`` at most."""
    shifted = [t - n * int(a) for t, a in zip(totals, low, strict=True)]
    v = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - shifted[i] * shifted[j]) / n**2  # a quotient of whole numbers, rounded once
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    trace = float(np.trace(v))
    e = np.where(e > max(trace, 0.0) * dims * np.finfo(float).eps, e, 0.0)
    return e, w, e / trace if trace > 0 else np.zeros(len(e))


def centred(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """x - S / n: a whole number of 1/n, rounded once."""
    base = [t // n for t in totals]
    rest = np.array([(t - n * b) / n for t, b in zip(totals, base, strict=True)])
    return (x - np.array(base, np.int64)) - rest


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int]:
    """Sums over dimensions of (n * x - S)^2, exact."""
    base = np.array([t // n for t in totals], np.int64)
    rest = np.array([t - n * int(b) for t, b in zip(totals, base, strict=True)], np.int64)
    near = x - base
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    if most**2 * max(1, x.shape[1]) < 2**63:
        return ((near * n - rest) ** 2).sum(axis=1).tolist()
    return [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in near]


def whiten(df: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every sound vector and component up to ``k``.

    Rows whose vector is null or holds nulls or non-finite entries go. A vector shorter than
    the longest counts as ending in zeros (an empty one is all zeros). Repeated rows, ties and null ids are
    ordinary rows; between equal eigenvalues any orthonormal choice may come, the same for
    all rows. A component without variance (fewer vectors than dimensions, or a constant) has
    ``whitened`` null and no part in ``identity_error``. ``deviation`` is null where it passes 64 bits.
    Without sound vectors there are no rows. Other columns are not read; ``df`` is read five times.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(own.dtypes)["id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, dims, low, high, totals = extent(own)
    if not n:
        return own.sparkSession.createDataFrame([], schema)
    e, w, share = components(n, dims, low, totals, scatter(own, dims, low, high), k)
    live = e > 0
    turn = w[:, live] / np.sqrt(e[live])
    error = identity_error(own, n, dims, totals, turn)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 1024):
            place, x = vectors(b, dims)
            if not len(place):
                continue
            out = np.full((len(place), len(e)), np.nan)
            out[:, live] = centred(x, n, totals) @ turn
            far = [v if v < 2**63 else None for v in deviations(x, n, totals)]
            each = np.repeat(np.arange(len(place)), len(e))
            flat, size = out.ravel(), len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(place)).take(pa.array(each)), pa.array(np.tile(np.arange(1, len(e) + 1, dtype=np.int32), len(place))), pa.array(np.full(size, n)),
                    pa.array(far, pa.int64()).take(pa.array(each)), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(share, len(place))), pa.array([error] * size, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, schema)


def identity_error(own: DataFrame, n: int, dims: int, totals: list[int], turn: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured over all rows; null without components."""
    k = turn.shape[1]
    if not k:
        return None

    def run(batches):
        import pyarrow as pa

        first, second = np.zeros(k), np.zeros((k, k))
        for b in slices(batches, ROWS):
            place, x = vectors(b, dims)
            if len(place):
                y = centred(x, n, totals) @ turn
                first, second = first + y.sum(axis=0), second + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1), dtype=np.int32)), pa.array(np.concatenate([first, second.ravel()]))], ["i", "v"])

    rows = own.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # (k + 1) * k numbers
    flat = np.array([r["v"] for r in rows]) / n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())
