"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are made integers, so that counts, sums and the scatter are exact however large the table is. Each vector is
centred on the rounded mean before it is multiplied, and the scatter is then moved to the exact mean in exact integers.
The tasks hold one matrix of dimension x dimension each, summed in Spark by its cells; the driver holds one such matrix.
There the pivoted Cholesky factor and its rotation run in extended precision: rotated column norms give the
eigenvalues, normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import settle, unused_name

COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Integers beyond this size saturate.
MOST = 1 << 52

#: Bits of a limb, and rows multiplied at once: products of limbs then sum exactly in doubles.
_LIMB, _ROWS = 20, 1 << 12
#: Cells of sums that a task holds before it hands them on, where vectors have many lengths.
_CELLS = 1 << 20


class Whitening(NamedTuple):
    """What whitening needs to know: n vectors of the length `len(middle)`, whose sums are n * middle + rest.

    values: the eigenvalues of their covariance, falling; vectors: unit columns, in the order of values; trace: that of
    the covariance.
    """

    n: int
    middle: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this length without null and non-finite entries, and their integers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == length)
    entries = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), length)
    fine = np.isfinite(entries).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(entries[fine] * SCALE), -MOST, MOST).astype(np.int64)
    return at[fine], whole + SHIFT


def _summed(vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}  # by length: the count, then the sums

        def out():
            for length, sums in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
                    names=["length", "pos", "s"],
                )
            held.clear()

        for batch in batches:
            column = batch.column(0)
            for length in pc.unique(pc.list_value_length(column).drop_null()).to_pylist():
                _, x = whole_vectors(column, length)
                if not len(x):
                    continue
                # in two halves, so that no sum overflows
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                new = [len(x), *((h << 26) + b for h, b in zip(high.tolist(), low.tolist(), strict=True))]
                held[length] = [a + b for a, b in zip(held.get(length, [0] * len(new)), new, strict=True)]
                if sum(map(len, held.values())) > _CELLS:
                    yield from out()
        yield from out()

    return run


def totals(df: DataFrame, vector: str = "embedding") -> tuple[int, list[int]]:
    """The number and the exact sums of the whole vectors of the commonest length (ties: the longer); (0, []) if there are none."""
    cells = df.select(vector).mapInArrow(_summed(vector), "length int, pos int, s decimal(38, 0)")
    cells = settle(cells.groupBy("length", "pos").agg(F.sum("s").alias("s")))
    top = cells.where("pos = -1").orderBy(F.desc("s"), F.desc("length")).first()
    if top is None:
        return 0, []
    sums = cells.where((F.col("length") == top["length"]) & (F.col("pos") >= 0)).orderBy("pos").collect()
    return int(top["s"]), [int(r["s"]) for r in sums]


def _limbs(z: np.ndarray) -> list[np.ndarray]:
    """Doubles, each of at most _LIMB bits, of which the k-th counts 2 ** (k * _LIMB)."""
    parts, sign, rest = [], np.sign(z), np.abs(z)
    while not parts or rest.any():
        parts.append((sign * (rest & ((1 << _LIMB) - 1))).astype(np.float64))
        rest = rest >> _LIMB
    return parts


def exact_products(z: np.ndarray) -> np.ndarray:
    """z transposed times z, as Python integers."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for low in range(0, len(z), _ROWS):
        parts = _limbs(z[low : low + _ROWS])
        for a, one in enumerate(parts):
            for b, other in enumerate(parts):
                total = total + ((one.T @ other).astype(np.int64).astype(object) << ((a + b) * _LIMB))
    return total


def _scattered(middle: np.ndarray):
    size = len(middle)
    rows, columns = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((size, size), object), False
        for batch in batches:
            _, x = whole_vectors(batch.column(0), size)
            if len(x):
                total, met = total + exact_products(x - middle), True
        if met:
            cells = pa.array([Decimal(v) for v in total[rows, columns]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), cells], names=["i", "j", "s"])

    return run


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Columns l, so many as a has rank, with a = l @ l.T; in the order of the pivots their rows make a lower triangle.

    A pivot counts as zero once it is lost in the rounding of its own diagonal element, so that dimensions of very
    different scales keep their precision.
    """
    size = len(a)
    own = np.diag(a).copy()
    left, factor = own.copy(), np.zeros((size, 0), a.dtype)
    least, done = 4 * size * np.finfo(a.dtype).eps * own, np.zeros(size, bool)
    while True:
        free = np.where(~done & (left > least), left, 0)
        if not size or not (free > 0).any():
            return factor
        p = int(free.argmax())
        column = (a[:, p] - factor @ factor[p]) / np.sqrt(left[p])
        column[done] = 0
        factor = np.concatenate([factor, column[:, None]], axis=1)
        left, done[p] = left - column * column, True


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    seats = np.arange(n + n % 2)
    for _ in range(len(seats) - 1):
        one, other = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
        real = (one < n) & (other < n)
        yield one[real], other[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of factor @ factor.T, falling, and their unit vectors: columns are rotated in pairs until all are orthogonal."""
    c, least = factor.copy(), np.finfo(factor.dtype).eps * max(len(factor), 1)
    turned = c.shape[1] > 1
    while turned:
        turned = False
        for p, q in _rounds(c.shape[1]):
            a, b = c[:, p], c[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > least * np.sqrt(aa) * np.sqrt(bb)
            if not turn.any():
                continue
            turned = True
            zeta = (bb - aa) / (2 * np.where(turn, ab, 1))
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            cos = 1 / np.sqrt(1 + t * t)
            c[:, p], c[:, q] = cos * a - cos * t * b, cos * t * a + cos * b
    norms = np.sqrt((c * c).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = c[:, order] / norms[order]
    # of the two signs, the one whose largest entry is positive
    largest = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, int)
    return norms[order] ** 2, vectors * np.where(vectors[largest, np.arange(len(largest))] < 0, -1, 1)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of df, with as many components as their covariance has rank, at most `components`.

    Vectors that are null, hold null or non-finite entries, or have another length than the commonest (ties: the
    longer) have no part in it. None where no vector is left. Repeated rows count as often as they stand there.
    """
    n, sums = totals(df, vector)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest, size = [s - n * m for s, m in zip(sums, middle, strict=True)], len(sums)
    middle = np.array(middle, np.int64)
    cells = df.select(vector).mapInArrow(_scattered(middle), "i int, j int, s decimal(38, 0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    scatter = np.zeros((size, size), object)
    for r in cells.collect():  # a cell a pair of dimensions
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = n * int(r["s"]) - rest[r["i"]] * rest[r["j"]]
    covariance = scatter.astype(np.longdouble) / np.longdouble(n) ** 2
    values, vectors = jacobi(pivoted_cholesky(covariance))
    return Whitening(n, middle, rest, values[:components].astype(np.float64), vectors[:, :components].astype(np.float64), float(np.trace(covariance)) if size else 0.0)


def _deviations(model: Whitening, z: np.ndarray) -> list[int | None]:
    """The squared distance of n * x from the sums, exact; null beyond the range of a long."""
    most = model.n * int(np.abs(z).max(initial=0)) + max(map(abs, model.rest), default=0)
    if most * most * max(z.shape[1], 1) < 1 << 62:
        far = z * model.n - np.array(model.rest, np.int64)
        return (far * far).sum(axis=1).tolist()
    far = z.astype(object) * model.n - np.array(model.rest, object)
    return [s if s < 1 << 63 else None for s in (far * far).sum(axis=1).tolist()]


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of df whose vectors have part in a fit, with all their columns and two more: deviation (long, the exact
    squared distance of n * x from the sums; null beyond the range of a long) and whitened (one double a component).

    Where df has columns of these names, the new ones get an underscore at the end.
    """
    names = [unused_name(df, "deviation"), unused_name(df, "whitened")]
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))])
    mean = np.array([float(r) / model.n for r in model.rest])
    onto, size, place = model.vectors / np.sqrt(model.values), len(model.middle), df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_vectors(batch.column(place), size)
            if not len(at):
                continue
            z = x - model.middle
            out = (z - mean) @ onto
            ends = pa.array(np.arange(len(at) + 1) * out.shape[1], pa.int32())
            more = [pa.array(_deviations(model, z), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(out.ravel(), pa.float64()))]
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, *names])

    return df.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, n: int, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity; 0 without components.

    Whitened vectors are centred up to rounding, so their products need no further centring; what is left of the means
    is taken off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            w = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    cells = whitened.select(column).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = max((r["i"] for r in cells), default=0)
    cov = np.zeros((size + 1, size + 1))
    for r in cells:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / n
    means = cov[:size, size]
    return float(np.abs(cov[:size, :size] - np.outer(means, means) - np.eye(size)).max(initial=0.0))


def report(df: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each remaining vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Components whose eigenvalue is zero do not exist: constant vectors, one vector, or an empty table give no rows. A
    null id stays null, repeated rows stay; other columns of df are not read.
    """
    few = df.select(F.col(id_column), F.col(vector))
    model = fit(few, vector, components)
    if model is None or not len(model.values):
        empty = f"component int, n long, deviation long, whitened double, explained double, identity_error double"
        return few.select(id_column).where(F.lit(False)).join(df.sparkSession.createDataFrame([], empty), how="cross")
    rows = whiten(few, model, vector)
    error = identity_error(rows, model.n)
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values])
    each = rows.select(id_column, "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        id_column, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
