"""Whitening of vectors by exact covariances from bit planes.

Entries become integers. Within a block of rows each dimension is shifted to start at zero and its bits are packed
across the rows into words, one row of words a bit plane. The cross-product of two dimensions is the sum over their
planes of the AND's popcount times both bits' weights; shifts are put back as integers, and a last dimension of ones
gives sums and the number of rows by the same means. Sums of all blocks are exact, are centred as integers, and only then
become doubles for ``eigh``. The driver receives one number per pair of dimensions, never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import stored

SCALE = 256
BLOCK = 4096  # rows whose planes are held at once
LIMB = 32  # bits of the digits in which exact sums travel
SAFE = 62  # bits that fit a signed word with room for a sign


def entries(vector: str, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of each entry as a long."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * float(scale)).cast("long"))


def usable(vector: str) -> Column:
    """No null vector, no null, infinite or undefined entry."""
    finite = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def planes(x: np.ndarray):
    """``(words, dimension of each plane, weight exponent of each plane, shift of each dimension)``; a dimension of ones is last."""
    low = x.min(axis=0)
    up = x.astype(np.uint64) - low.astype(np.uint64)
    up = np.hstack([up, np.ones((len(x), 1), np.uint64)])
    bits = [int(top).bit_length() for top in up.max(axis=0)]
    words, dims, powers = [], [], []
    for j, count in enumerate(bits):
        for power in range(count):
            packed = np.packbits((up[:, j] >> np.uint64(power)).astype(np.uint8) & 1)
            words.append(np.pad(packed, (0, -len(packed) % 8)).view(np.uint64))
            dims.append(j)
            powers.append(power)
    return np.array(words), np.array(dims), np.array(powers), [*low.tolist(), 0]


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of dimensions of ``x`` and a last one of ones, as Python integers."""
    words, dims, powers, low = planes(x)
    size, rows = x.shape[1] + 1, len(x)
    first = np.flatnonzero(np.append(True, dims[1:] != dims[:-1]))
    live = dims[first]
    fits = 2 * int(powers.max()) + 2 + rows.bit_length() <= SAFE
    kind = np.int64 if fits else object
    weights = np.array([1 << int(p) for p in powers], kind)
    total = np.zeros((size, size), kind)
    for p, (j, weight) in enumerate(zip(dims, weights)):
        counts = np.bitwise_count(words & words[p]).sum(axis=1, dtype=np.int64).astype(kind)
        total[j, live] += weight * np.add.reduceat(counts * weights, first)
    total, low = total.astype(object), np.array(low, object)
    sums = total[-1].copy()
    return total + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)


def digits(value: int):
    """Signed digits of ``LIMB`` bits, least first; sums of a billion of them fit a long."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & (1 << LIMB) - 1)
        value, place = value >> LIMB, place + 1


def scatter(vectors: DataFrame, column: str = "x") -> tuple[int, list[int], list[list[int]]]:
    """Exact ``(rows, sums, sums of products)`` of a column of long arrays; the driver gets width squared numbers."""
    width = vectors.agg(F.max(F.size(column))).first()[0] or 0

    def sums(batches):
        total = None
        for batch in batches:
            x = matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                part = cross_products(x[at : at + BLOCK])
                total = part if total is None else total + part
        if total is not None:
            out = [(j, k, *digit) for j in range(width + 1) for k in range(j, width + 1) for digit in digits(int(total[j, k]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["j", "k", "place", "value"])

    found = vectors.select(column).mapInArrow(sums, "j int, k int, place int, value long")
    total = [[0] * (width + 1) for _ in range(width + 1)]
    for row in found.groupBy("j", "k", "place").agg(F.sum("value").alias("value")).collect():
        total[row["j"]][row["k"]] += row["value"] << LIMB * row["place"]
    for j in range(width + 1):
        for k in range(j):
            total[j][k] = total[k][j]
    return total[width][width], total[width][:width], [row[:width] for row in total[:width]]


def components(n: int, sums: list[int], products: list[list[int]], most: int):
    """``(eigenvectors as columns, eigenvalues, trace)`` of the covariance, largest first.

    The covariance is centred as integers; an eigenvalue that is zero to double precision is given as 0.
    """
    width = len(sums)
    square = n * n
    centred = np.array([[(n * products[j][k] - sums[j] * sums[k]) / square for k in range(width)] for j in range(width)], float)
    values, vectors = np.linalg.eigh(centred.reshape(width, width))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    trace = sum(n * products[j][j] - sums[j] ** 2 for j in range(width)) / square
    return vectors, np.where(values > values.max() * width * np.finfo(float).eps, values, 0.0), trace


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: longs where they fit, else Python integers."""
    widest = max([abs(int(x.min())), abs(int(x.max()))], default=0) if x.size else 0
    fits = n * widest + max(map(abs, sums), default=0) < 1 << SAFE
    return n * x.astype(np.int64 if fits else object) - np.array(sums, np.int64 if fits else object)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 4, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    The fit is on each distinct vector once. ``deviation`` is exact, as decimal(38, 0); ``identity_error`` is measured on
    the whitened fit list. Rows with a null vector or with null, infinite or undefined entries are left out; repeated rows
    and null ids keep their rows. Of vectors of several lengths the shorter ones are filled with zeros after distinct
    ones were told apart. There are no more components than dimensions; one without variance has null ``whitened`` values
    and takes no part in ``identity_error``. An empty table, or vectors without entries, give no row.
    """
    rows = vectors.where(usable(vector)).select(F.col(vec_id).alias("vec_id"), entries(vector, scale).alias("x"))
    fit = stored(rows.select("x").distinct(), "vectors")
    n, sums, products = scatter(fit)
    width, shape = len(sums), "vec_id {}, deviation string, whitened array<double>".format(rows.schema["vec_id"].dataType.simpleString())
    if not n or not width:
        empty = rows.where("false").select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"))
        return empty.withColumns({"deviation": F.lit(None).cast("decimal(38,0)"), **{
            name: F.lit(None).cast("double") for name in ("whitened", "explained", "identity_error")}})
    axes, values, trace = components(n, sums, products, most)
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(values > 0, axes / np.sqrt(values) / n, np.nan)

    def project(x):
        off = centre(x, n, sums)
        return off, off.astype(float) @ axes

    def check(batches):
        for batch in batches:
            white = np.nan_to_num(project(matrix(batch.column(0), width))[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([white.sum(axis=0).tolist()], pa.list_(pa.float64())), pa.array([(white.T @ white).ravel().tolist()], pa.list_(pa.float64()))],
                names=["sums", "products"])

    def apply(batches):
        for batch in batches:
            off, white = project(matrix(batch.column(1), width))
            if off.dtype != object and width * max(abs(int(off.min())), abs(int(off.max()))) ** 2 >= 1 << SAFE:
                off = off.astype(object)
            dev = (off * off).sum(axis=1)
            white = pa.array(white.ravel(), mask=np.isnan(white).ravel())
            at = pa.array(np.arange(len(off) + 1, dtype=np.int32) * len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(d) for d in dev.tolist()], pa.string()), pa.ListArray.from_arrays(at, white)],
                                             names=["vec_id", "deviation", "whitened"])

    k = len(values)
    seen = fit.mapInArrow(check, "sums array<double>, products array<double>").agg(
        *[F.sum(F.col("sums")[i]) for i in range(k)], *[F.sum(F.col("products")[i]) for i in range(k * k)]).first()
    mean = np.array(seen[:k]) / n
    off = np.abs(np.array(seen[k:]).reshape(k, k) / n - np.outer(mean, mean) - np.eye(k))[np.ix_(values > 0, values > 0)]
    share = F.array(*[F.lit(float(v / trace) if trace else None).cast("double") for v in values])
    return rows.mapInArrow(apply, shape).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(float(off.max(initial=0.0))).alias("identity_error"))
