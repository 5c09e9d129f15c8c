"""Whitening of embeddings from an exact scatter: bit planes of a chunk of rows, packed into words, ANDed and counted."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from leafmill.llm.common import ship

#: Rows whose bit planes are packed together; only the work of a task depends on it.
CHUNK_ROWS = 8192
#: Entries are scaled by this and rounded down; beyond +-2^62 they are held at it.
SCALE = 64
LIMIT = 1 << 62
#: Added to the scaled entries in the definition of x; covariances do not depend on it.
SHIFT = 1_000_000
#: Exact sums travel as limbs of so many bits, so that Spark can add them as longs.
LIMB, LIMBS = 40, 4
#: Bits of one factor in a product of doubles that stays exact.
DIGIT = 15


def digits_of(vectors: np.ndarray) -> np.ndarray:
    """``floor(64 c)`` of finite doubles, as longs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -float(LIMIT), float(LIMIT)).astype(np.int64)


def valid_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the rows that have ``dims`` entries, none of them null or non-finite, and the digits of these rows."""
    mask = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    values = column.filter(mask).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    keep = mask.to_numpy(zero_copy_only=False).copy()
    keep[keep] = finite
    return keep, digits_of(values[finite])


def pack_row(digits: np.ndarray) -> bytes:
    """One vector of longs in the narrowest integers that hold it; equal vectors give equal bytes."""
    for code, kind in enumerate(("<i1", "<i2", "<i4")):
        info = np.iinfo(kind)
        if digits.min() >= info.min and digits.max() <= info.max:
            return bytes([code]) + digits.astype(kind).tobytes()
    return b"\x03" + digits.astype("<i8").tobytes()


def unpack_row(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=("<i1", "<i2", "<i4", "<i8")[packed[0]], offset=1).astype(np.int64)


def cross_products(digits: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of ``digits`` and of a last column of ones, as Python integers.

    Each column is shifted by its least value in the chunk and split into bit planes. A plane
    is a row of 64-bit words, one bit for each vector. The product sum of two columns is the
    sum over their planes of 2^(a + b) times the ones in the AND of plane a and plane b.
    The last column gives sums and the number of rows.
    """
    rows, dims = digits.shape
    low = digits.min(axis=0)
    shifted = (digits - low).view(np.uint64)  # wraps to the right difference
    bits = [int(m).bit_length() for m in shifted.max(axis=0)]
    width = -(-rows // 64) * 64
    planes, owner, power = [], [], []
    for b in range(max(bits)):
        own = [k for k in range(dims) if bits[k] > b]
        plane = np.zeros((len(own), width), dtype=np.uint8)
        plane[:, :rows] = ((shifted[:, own] >> np.uint64(b)) & np.uint64(1)).T
        planes.append(np.packbits(plane, axis=1).view(np.uint64))
        owner += own
        power += [b] * len(own)
    ones = np.zeros((1, width), dtype=np.uint8)
    ones[:, :rows] = 1
    planes.append(np.packbits(ones, axis=1).view(np.uint64))
    owner.append(dims)
    power.append(0)
    words = np.concatenate(planes)
    counts = np.zeros((len(words), len(words)))
    for p in range(len(words)):
        counts[p, p:] = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        counts[p:, p] = counts[p, p:]
    # powers of two are applied fifteen bits at a time: products of doubles that are exact
    total = np.zeros((dims + 1, dims + 1), dtype=object)
    sides = []
    for g in range(max(power) // DIGIT + 1):
        side = np.zeros((dims + 1, len(words)))
        for p, (k, b) in enumerate(zip(owner, power)):
            if b // DIGIT == g:
                side[k, p] = 1 << (b - DIGIT * g)
        sides.append(side)
    for g, a in enumerate(sides):
        left = a @ counts
        for h, b in enumerate(sides):
            total += (left @ b.T).astype(np.int64).astype(object) << (DIGIT * (g + h))
    base = np.array([*map(int, low), 0], dtype=object)
    sums = total[:, dims]  # of the shifted columns; for the ones their number
    return total + np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)


def to_limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def from_limbs(limbs) -> int:
    return sum(int(v) << (LIMB * k) for k, v in enumerate(limbs))


@dataclass(frozen=True)
class Whitening:
    """A fitted map: ``n`` distinct vectors of ``dims`` entries with sums ``sums`` of ``floor(64 c)``; components by falling eigenvalue."""

    dims: int
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray  # dims x components, unit columns
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None


def _extended(matrix: np.ndarray, divisor: int) -> np.ndarray:
    """Integers over ``divisor`` in extended precision."""
    out = np.zeros(matrix.shape, dtype=np.longdouble)
    for at, value in np.ndenumerate(matrix):
        exact = Fraction(int(value), divisor)
        head = float(exact)
        out[at] = np.longdouble(head) + np.longdouble(float(exact - Fraction(head)))
    return out


def eigen(v: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a covariance in extended precision.

    ``eigh`` in doubles errs by a part of the largest eigenvalue; where small ones would
    suffer, rotations in extended precision follow until no two components are correlated
    by more than 1e-15. For matrices of ordinary spread there is nothing left to rotate.
    """
    _, start = np.linalg.eigh(v.astype(np.float64))
    axes = start[:, ::-1].astype(np.longdouble)
    m = axes.T @ v @ axes
    m = (m + m.T) / 2
    floor = np.trace(m) * np.longdouble(1e-30)
    for _ in range(sweeps):
        scale = np.sqrt(np.maximum(np.diag(m), floor))
        loose = np.argwhere(np.triu(np.abs(m) > np.longdouble(1e-15) * np.outer(scale, scale), 1))
        if not len(loose):
            break
        for p, q in loose:
            if m[p, q] == 0:
                continue
            theta = (m[q, q] - m[p, p]) / (2 * m[p, q])
            t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            turn = np.array([[c, t * c], [-t * c, c]], dtype=np.longdouble)
            m[:, [p, q]] = m[:, [p, q]] @ turn
            m[[p, q], :] = turn.T @ m[[p, q], :]
            axes[:, [p, q]] = axes[:, [p, q]] @ turn
    values = np.maximum(np.diag(m), 0)
    order = np.argsort(-values, kind="stable")
    return values[order], axes[:, order] / np.sqrt((axes[:, order] ** 2).sum(axis=0))


def scatter(vectors: DataFrame, vector: str, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number, sums and sums of products of the distinct vectors of ``floor(64 c)``, all exact.

    Vectors travel in the narrowest integers that hold them; equal ones are combined before
    the shuffle. Every task gives one row per pair of dimensions, which Spark adds up, so
    what the driver gets depends on the dimensions only.
    """

    def digitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, digits = valid_rows(batch.column(0), dims)
            yield pa.RecordBatch.from_arrays([pa.array([pack_row(r) for r in digits], pa.binary())], ["x"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), dtype=object)
        held: list[np.ndarray] = []
        seen = False
        for batch in batches:
            for packed in batch.column(0):
                held.append(unpack_row(packed.as_py()))
                if len(held) == CHUNK_ROWS:
                    total, seen, held = total + cross_products(np.stack(held)), True, []
        if held:
            total, seen = total + cross_products(np.stack(held)), True
        if seen:
            at = [(i, j) for i in range(dims + 1) for j in range(i, dims + 1)]
            limbs = [to_limbs(int(total[i, j])) for i, j in at]
            columns = [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32())]
            columns += [pa.array([v[k] for v in limbs], pa.int64()) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    limbs = ", ".join(f"l{k} long" for k in range(LIMBS))
    fit = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(digitise, "x binary").distinct()
    added = fit.mapInArrow(multiply, f"i int, j int, {limbs}").groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    whole = np.zeros((dims + 1, dims + 1), dtype=object)
    for r in added.collect():  # one row per pair of dimensions
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = from_limbs([r[f"l{k}"] for k in range(LIMBS)])
    return int(whole[dims, dims]), [int(s) for s in whole[dims, :dims]], whole[:dims, :dims]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Learns the map from all vectors; None if there is no valid one.

    ``dims`` is the most frequent length (the longer of two equally frequent ones).
    """
    ship(vectors.sparkSession)
    lengths = vectors.select(F.size(vector).alias("d")).where("d > 0").groupBy("d").count()
    top = lengths.agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()["d"]
    if top is None:
        return None
    n, sums, products = scatter(vectors, vector, top)
    if n == 0:
        return None
    s = np.array(sums, dtype=object)
    centred = n * products - np.outer(s, s)  # n^2 times the covariance, in integers
    v = _extended(centred, n * n)
    values, axes = eigen(v)
    count = min(components, top)
    trace = sum(int(centred[i, i]) for i in range(top))
    whole = np.longdouble(float(Fraction(trace, n * n)))
    found = values > whole * np.longdouble(1e-24)
    explained = values / whole if trace else np.zeros(top, dtype=np.longdouble)
    values, axes = np.where(found, values, 0)[:count], axes[:, :count]
    live = axes[:, found[:count]] / np.sqrt(values[found[:count]])
    error = float(np.abs(live.T @ v @ live - np.eye(live.shape[1])).max()) if live.shape[1] else None
    return Whitening(top, n, tuple(sums), axes.astype(np.float64), values.astype(np.float64), explained[:count].astype(np.float64), error)


def apply(vectors: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every valid row and component; no shuffle."""
    identity = StructField("vec_id", vectors.schema[vec_id].dataType)
    schema = StructType(
        [
            identity,
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", DecimalType(38, 0)),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n, count = model.dims, model.n, len(model.eigenvalues)
    sums = np.array(model.sums, dtype=object)
    live = model.eigenvalues > 0
    scaled = model.axes / np.sqrt(np.where(live, model.eigenvalues, np.nan))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, digits = valid_rows(batch.column(1), dims)
            m = len(digits)
            if not m:
                continue
            reach = n * int(max(-int(digits.min()), int(digits.max()), 0)) + max(abs(int(x)) for x in sums)
            if reach * reach * dims < 1 << 63:
                away = n * digits - sums.astype(np.int64)
                deviation = pa.array((away * away).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                away = n * digits.astype(object) - sums
                exact = [int(x) for x in (away * away).sum(axis=1)]
                deviation = pa.array([Decimal(x) if x < 10**38 else None for x in exact], pa.decimal128(38, 0))
            white = (away.astype(np.float64) / n) @ scaled
            take = pa.array(np.repeat(np.arange(m), count))
            lit = np.ones(m * count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(keep)).take(take),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n, dtype=np.int64)),
                    deviation.take(take),
                    pa.array(white.ravel(), pa.float64(), mask=np.tile(~live, m)),
                    pa.array(np.tile(model.explained, m)),
                    pa.array(lit * (model.identity_error or 0.0), pa.float64(), mask=lit < (2 if model.identity_error is None else 0)),
                ],
                schema.fieldNames(),
            )

    return rows.mapInArrow(project, schema)


def whiten_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Every valid vector on the first ``components`` axes of the covariance of the distinct ones, with unit variances.

    ``x = floor(64 c) + 1000000`` for every entry ``c`` as a double; entries beyond 2^62 / 64 are
    held there. Sums and products over the distinct x are exact integers (``scatter``), centred
    as integers, and only then divided; what the driver decomposes is one matrix of the
    dimensions. Columns: ``vec_id``; ``component`` from 1; ``n`` distinct vectors; ``deviation``,
    the exact sum over dimensions of ``(n x - S)^2`` (null from 10^38 on); ``whitened``;
    ``explained``; ``identity_error``. A component without variance (10^-24 of the whole or less) has null ``whitened`` and
    does not count in ``identity_error`` (null if there is none with variance).

    Rows whose vector is null, empty, of another length than the most frequent one, or holds
    null or non-finite entries are left out (a missing entry counts as null). Repeated
    vectors count once in the fit and come back for each row; null and repeated ids stay;
    other columns are not read; an empty table gives an empty one. Any share of the rows may
    hold one vector: equal ones are combined before the shuffle.
    """
    return apply(vectors, fit(vectors, vector, components), vec_id, vector)
