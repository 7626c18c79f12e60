"""Whitening of embeddings by their leading principal components, without ever forming the covariance.

A vector's entries c become integers x = floor(64 c) + 1000000, so that equal vectors are equal exactly. The fit list holds each
distinct vector once; a hot vector is merged before the shuffle. Components are found by block subspace iteration: a pass over the
fit list gives V Q = X'(X Q) / n for a block Q of directions, X being the rows less their mean (an integer is taken off exactly and
the rest of the mean then, so nothing cancels). QR adds the block to the directions so far, Rayleigh-Ritz over all of them gives the
components and their residuals |V q - e q|, and the residuals are the next block. It ends when the residuals of all ``k`` components
are at the level of rounding. Spectra of embeddings are flat, so a block alone would take hundreds of passes; with the earlier
blocks kept it takes a few, and d / block at most while ``BASIS`` directions hold all d. Beyond, the best are kept and it goes on.

The driver holds d x ``BASIS`` numbers and a task d x block; sums of tasks are merged by rows of that matrix. No vector goes to the
driver.

Cases: rows whose vector is null or has null or non-finite entries are dropped, and so are those of another length than most have
(ties: the greater length), as they can't be compared; entries beyond 2^53 / 64 count as that; null ids stay; repeated rows are
fitted once and whitened each; components of no variance (fewer distinct rows or dimensions than ``k``) are left out; no rows give
no rows; a deviation beyond 64 bits is null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK = 32  # directions a pass
BASIS = 256  # directions kept, at least
RESIDUAL = 1e-14  # of the first eigenvalue
PASSES = 500
_LARGEST = float(1 << 53)
_KINDS = (np.int16, np.int32, np.int64)


@dataclass
class Whitening:
    """What a fit found; ``vectors`` has a column a component."""

    n: int
    sums: list[int]  # of x - OFFSET, by dimension
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def usable(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that can be whitened, and their vectors' length."""
    v = F.col(vector)
    fine = df.where(_finite(v))
    lengths = fine.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return fine.where(F.size(v) == d), d


def _entries(column: pa.Array, d: int) -> np.ndarray:
    """x - OFFSET of each entry."""
    c = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)
    return np.clip(np.floor(c * SCALE), -_LARGEST, _LARGEST).astype(np.int64)


def _packed(x: np.ndarray) -> pa.Array:
    """Each row in the fewest bytes an entry, which the first byte tells: equal rows have equal bytes."""
    most = np.abs(x).max(axis=1, initial=0)
    kind = np.searchsorted([1 << 15, 1 << 31], most, side="right")
    out = np.empty(len(x), object)
    for k, dtype in enumerate(_KINDS):
        at = np.flatnonzero(kind == k)
        raw = np.concatenate([np.full((len(at), 1), k, np.uint8), np.ascontiguousarray(x[at].astype(dtype)).view(np.uint8).reshape(len(at), x.shape[1] * np.dtype(dtype).itemsize)], axis=1)
        out[at] = [r.tobytes() for r in raw]
    return pa.array(out, pa.binary())


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    x = np.empty((len(column), d), np.int64)
    rows = column.to_pylist()
    kind = np.array([r[0] for r in rows], np.int8)
    for k, dtype in enumerate(_KINDS):
        at = np.flatnonzero(kind == k)
        x[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), dtype).reshape(len(at), d)
    return x


def fit_list(df: DataFrame, vector: str, d: int) -> DataFrame:
    """Each distinct vector once, packed, as a table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([_packed(_entries(b.column(0), d))], ["x"])

    return store.saved(df.select(vector).mapInArrow(pack, "x binary").distinct(), "fit-list")


class _Rows:
    """Passes over the fit list."""

    def __init__(self, table: DataFrame, d: int) -> None:
        self.table, self.d = table, d
        self.n = table.count()
        halves = self._merged(lambda x: np.stack([(x & 0xFFFFF).sum(axis=0), (x >> 20).sum(axis=0)], axis=1), (d, 2), "i8")  # exact: no sum passes 64 bits
        self.sums = [int(a) + (int(b) << 20) for a, b in halves.tolist()]

    def _merged(self, make, shape: tuple[int, int], kind: str = "f8") -> np.ndarray:
        """The sum of what ``make`` gives for batches of rows. A task sends its sum by rows of the matrix, which are added up apart, so
        the driver gets one matrix."""
        d = self.d

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, kind)
            for b in batches:
                if b.num_rows:
                    total += make(_unpacked(b.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for row, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[row] = sums.get(row, 0) + np.frombuffer(part, kind)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["row", "part"])

        sent = self.table.mapInArrow(local, "row long, part binary").repartition("row")
        out = np.zeros(shape, kind)
        for r in sent.mapInArrow(add, "row long, part binary").collect():  # a row a row of the matrix
            out[r["row"]] = np.frombuffer(r["part"], kind)
        return out

    def centred(self):
        """x -> the rows less their mean."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - whole).astype(np.float64) - rest

    def product(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and the trace of V."""
        centre, d = self.centred(), self.d

        def make(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.concatenate([c.T @ (c @ q), (c * c).sum(axis=0)[:, None]], axis=1)

        out = self._merged(make, (d, q.shape[1] + 1)) / self.n
        return out[:, :-1], float(out[:, -1].sum())

    def identity_error(self, to: np.ndarray) -> float:
        """The largest entry of the covariance of the rows times ``to``, less the identity: measured, not derived."""
        centre, k = self.centred(), to.shape[1]

        def make(x: np.ndarray) -> np.ndarray:
            w = centre(x) @ to
            return np.concatenate([w.T @ w, w.sum(axis=0)[:, None]], axis=1)

        out = self._merged(make, (k, k + 1)) / self.n
        return float(np.abs(out[:, :k] - np.outer(out[:, k], out[:, k]) - np.eye(k)).max(initial=0.0))


def _added(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``block`` that ``basis`` lacks."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def fit(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """Mean, components and eigenvalues of the distinct vectors of ``df``; none if there is no usable row."""
    rows, d = usable(df, vector)
    if d < 1:
        return None
    table = fit_list(rows, vector, d)
    data = _Rows(table, d)
    block, kept = min(d, max(BLOCK, k)), max(BASIS, 4 * max(BLOCK, k))
    rng = np.random.default_rng(7)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q, last = _added(basis, rng.standard_normal((d, block))), np.inf
    for passes in range(1, PASSES + 1):
        made, trace = data.product(q)
        basis, image = np.concatenate([basis, q], axis=1), np.concatenate([image, made], axis=1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found, left = basis @ turn, image @ turn - (basis @ turn) * values
        residuals = np.linalg.norm(left, axis=0)
        worst = residuals[:k].max() / max(values[0], 1e-300)
        q = _added(basis, left[:, : max(block, k)]) if basis.shape[1] < d else np.zeros((d, 0))
        if worst <= RESIDUAL or not q.shape[1] or (worst <= 1e-12 and worst >= last / 2):
            break
        last = worst
        if basis.shape[1] + q.shape[1] > max(kept, 2 * block) and d > kept:
            keep = 2 * block
            basis, image = found[:, :keep], image @ turn[:, :keep]
            q = _added(basis, q)
    else:
        raise ValueError(f"components not certified after {PASSES} passes: residual {worst:.1e}")
    real = np.flatnonzero(values[:k] > max(values[0], 0.0) * d * 1e-14)
    vectors = found[:, real]
    top = np.abs(vectors).argmax(axis=0) if len(real) else np.zeros(0, int)
    vectors = vectors * np.where(vectors[top, np.arange(len(real))] < 0, -1.0, 1.0)
    model = Whitening(data.n, data.sums, values[real], vectors, trace, residuals[real], passes)
    if len(real):
        model.identity_error = data.identity_error(vectors / np.sqrt(values[real]))
    store.delete(table)
    return model


def whitened(df: DataFrame, model: Whitening | None, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns ``keep``, ``deviation`` and ``whitened``, an array with a number a component, of each usable row."""
    fields = [df.schema[c] for c in keep] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    if model is None:
        return df.select(*keep, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
    d, n, sums = len(model.sums), model.n, model.sums
    to = model.vectors / np.sqrt(model.values)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _entries(b.column(b.num_columns - 1), d)
            c = (x - whole).astype(np.float64) - rest
            with np.errstate(over="ignore"):
                away = x * np.int64(n) - wrapped  # sums modulo 2^64 are exact where the result fits
                squares = (away * away).sum(axis=1)
            fits = (c * c).sum(axis=1) * float(n) * float(n) < 2.0**62
            deviation = [int(s) if f else _exact(row, n, sums) for s, f, row in zip(squares, fits, x, strict=True)]
            w = c @ to
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(deviation, pa.int64()), lists], [f.name for f in fields])

    v = F.col(vector)
    return df.where(_finite(v) & (F.size(v) == d)).select(*keep, v.alias("_entries")).mapInArrow(turn, T.StructType(fields))


def _exact(row: np.ndarray, n: int, sums: list[int]) -> int | None:
    total = sum((int(x) * n - s) ** 2 for x, s in zip(row, sums, strict=True))
    return total if total < 1 << 63 else None
