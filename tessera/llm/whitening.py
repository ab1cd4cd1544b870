"""Whitened embeddings: principal components by incremental eigendecomposition, refined by one Rayleigh-Ritz step.

Every task keeps the spectrum (mean, eigenvalues, eigenvectors) of what it has read and adds its vectors one by one: the
centred scatter changes by a multiple of v v', so its new eigenvalues are the roots of a secular equation between the old
ones, and its new eigenvectors follow from them. Equal eigenvalues and directions that v does not have are deflated.
Spectra of tasks are joined in a tree, a bounded number at a time, by the same updates: one for each eigenpair of the
smaller and one for the distance of the means. A last pass over all vectors takes their scatter in the joint basis
(Rayleigh-Ritz over the whole basis), which gives the components to the accuracy of doubles.

The fit list holds each distinct vector once, so copies weigh as one and a hot vector is no hot task: it is dealt by its
whole content and combined before it is sent. What is kept is a few d x d matrices, whatever the number of rows.

Rows: null vectors and those with null or non-finite entries are dropped; entries missing at the end of a shorter vector
count as 0. Components whose eigenvalue is not above rounding (fewer distinct directions than components, a single
distinct vector) are left out; an empty table has no rows. Ties of eigenvalues may have any basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import parts
from tessera.operators.graph import cut

COMPONENTS, SCALE = 4, 256
#: Spectra that one task joins.
FAN = 8
#: Rounds of the secular equation's search at most; it ends in about ten.
ROUNDS = 80
EPS = np.finfo(float).eps
SPECTRUM = "grp int, n long, mean array<double>, sums array<long>, values array<double>, basis array<double>"


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(pole, distance): each root of 1 + rho * sum(z2 / (d - x)) = 0 as the nearer d and its distance from it; d rises, z2 > 0, rho > 0.

    Root k lies between d[k] and d[k + 1], the last one up to rho * sum(z2) above. All roots are searched at once, by the
    model s + a / (left pole - x) + b / (right pole - x) that fits both sides, and by halving where that leaves the bracket.
    """
    k = len(d)
    gap = np.append(np.diff(d), rho * z2.sum())
    right = np.append(d[1:], d[-1] + gap[-1])
    middle = d + gap / 2
    f = 1 + rho * (z2 / (d[None, :] - middle[:, None])).sum(1)
    pole = np.where((f >= 0) | (np.arange(k) == k - 1), np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    base = d[pole]
    delta = d[None, :] - base[:, None]  # exact where the poles are close
    own = pole == np.arange(k)
    low, high = np.where(own, 0.0, -gap / 2), np.where(own, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    x = (low + high) / 2
    to_left, to_right = d - base, right - base
    lower = np.tri(k, dtype=bool)  # poles at or left of the root
    last = np.arange(k) == k - 1
    for _ in range(ROUNDS):
        apart = delta - x[:, None]
        terms = rho * z2 / apart
        below, above = np.where(lower, terms, 0).sum(1), np.where(lower, 0, terms).sum(1)
        f = 1 + below + above
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        slopes = terms / apart
        fall, rise = np.where(lower, slopes, 0).sum(1), np.where(lower, 0, slopes).sum(1)
        bound = EPS * k * (1 + np.abs(below) + np.abs(above))
        if (done := (np.abs(f) <= bound) | (high - low <= EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
        l, r = to_left - x, to_right - x
        a, b = fall * l * l, np.where(last, 0, rise * r * r)
        s = f - fall * l - np.where(last, 0, rise * r)
        # s * (l - e) * (r - e) + a * (r - e) + b * (l - e) = 0
        p, q, w = s, -(s * (l + r) + a + b), s * l * r + a * r + b * l
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(q * q - 4 * p * w, 0))
            half = -(q + np.where(q >= 0, root, -root)) / 2
            one, two = half / p, w / half
            one = np.where(last, l + a / s, one)
        best = np.where((x + one > low) & (x + one < high), x + one, np.where((x + two > low) & (x + two < high), x + two, (low + high) / 2))
        x = np.where(done, x, np.where(np.isfinite(best), best, (low + high) / 2))
    return pole, x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of basis diag(values) basis' + v v'."""
    z = v @ basis
    rho = float(z @ z)
    if rho <= 0 or not np.isfinite(rho):
        return values, basis
    z = z / np.sqrt(rho)
    limit = 8 * EPS * max(float(np.abs(values).max()), rho)
    order = np.argsort(values, kind="stable")
    values, basis, z = values[order], basis[:, order], z[order]
    # equal values: one direction of their space takes all of v
    starts = np.flatnonzero(np.append(True, np.diff(values) > limit))
    if len(starts) < len(values):
        basis, values = basis.copy(), values.copy()
        for a, b in zip(starts, np.append(starts[1:], len(values)), strict=True):
            size = float(np.linalg.norm(z[a:b]))
            if b - a > 1 and size > 0:
                h = z[a:b].copy()
                h[-1] += size if h[-1] >= 0 else -size
                scale = float(h @ h)
                basis[:, a:b] -= np.outer(basis[:, a:b] @ h, h) * (2 / scale)
                z[a:b], z[b - 1] = 0, -size if z[b - 1] >= 0 else size
                values[a:b] = values[a:b].mean()
    on = np.flatnonzero(rho * np.abs(z) > limit)
    if not len(on):
        return values, basis
    d, z = values[on], z[on]
    pole, x = secular_roots(d, z * z, rho)
    apart = (d[None, :] - d[pole][:, None]) - x[:, None]  # d - root, of root k in row k
    # the z for which these roots are exact, so that the eigenvectors are orthogonal:
    # z_i^2 = (root_i - d_i) * product over k != i of (root_k - d_i) / (d_k - d_i), over rho
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1)
    z = np.sqrt(np.abs(apart / between).prod(0) / rho) * np.where(z < 0, -1, 1)
    turn = z[None, :] / apart
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    basis, values = basis.copy(), values.copy()
    basis[:, on] = basis[:, on] @ turn.T
    values[on] = d[pole] + x
    return values, basis


class Spectrum:
    """n, mean, exact sums and the eigenpairs of the centred scatter of the vectors added so far."""

    def __init__(self, d: int):
        self.n, self.mean, self.sums, self.values, self.basis = 0, np.zeros(d), np.zeros(d, np.int64), np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n
        self.sums += x

    def join(self, other: Spectrum) -> None:
        """The spectrum of both, by an update for each eigenpair of the other and one for the means."""
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector * np.sqrt(value))
        away, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = rank_one(self.values, self.basis, away * np.sqrt(self.n * (other.n / n)))
        self.mean = self.mean + away * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self, grp: int) -> dict:
        return {"grp": grp, "n": self.n, "mean": self.mean.tolist(), "sums": self.sums.tolist(), "values": self.values.tolist(), "basis": self.basis.ravel().tolist()}

    @staticmethod
    def read(row) -> Spectrum:
        out = Spectrum(d := len(row["mean"]))
        out.n, out.mean, out.sums = int(row["n"]), np.array(row["mean"], float), np.array(row["sums"], np.int64)
        out.values, out.basis = np.array(row["values"], float), np.array(row["basis"], float).reshape(d, d)
        return out


def vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with a usable vector, as _x: floor(256 c) of each entry c."""
    entries = F.transform(F.col(f"`{column}`"), lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(F.col(f"`{column}`").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("_x", F.transform(entries, lambda c: F.floor(c * SCALE).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as int64, zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    lengths = np.diff(ends)
    if len(lengths) and (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat
    return out


def _spectra(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(d)
        for batch in batches:
            for x in _matrix(batch.column(0), d):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())], pa.schema([("grp", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("sums", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("basis", pa.list_(pa.float64()))]))

    return run


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    first, *others = (Spectrum.read(r) for _, r in rows.sort_values(["n", "grp"], ascending=False).iterrows())
    for other in others:
        first.join(other)
    return pd.DataFrame([first.row(int(rows["grp"].iloc[0]) // FAN)])


def spectrum(fit: DataFrame, d: int) -> Spectrum:
    """The joint spectrum of the vectors in column _x: a row for each task, joined FAN at a time."""
    states = cut(fit.select("_x").mapInArrow(_spectra(d), SPECTRUM))
    while states.count() > 1:
        group = F.expr(f"grp div {FAN}").alias("g")
        states = cut(states.groupBy(group).applyInPandas(_joined, SPECTRUM))
    row = states.first()
    return Spectrum.read(row) if row else Spectrum(d)


def _scatter(basis: np.ndarray, n: int, sums: list[int]) -> Callable:
    """Rows (i, the i-th row of Y'Y) of a task's vectors, Y = (x - sums / n) basis."""
    d, k = basis.shape
    low = np.array([s // n for s in sums], np.int64)  # whole and broken part of the mean, so that x - mean keeps its digits
    part = np.array([s % n for s in sums], float) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = ((_matrix(batch.column(0), d) - low) - part) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def scatter(fit: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Y'Y over all vectors, summed entry by entry."""
    k = basis.shape[1]
    rows = fit.select("_x").mapInArrow(_scatter(basis, n, sums), "i int, row array<double>")
    got = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((k, k))
    for r in got:
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def components(fit: DataFrame, d: int, most: int = COMPONENTS) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """n, the sums, eigenvalues (falling) and unit eigenvectors of the covariance of column _x, and its trace."""
    joint = spectrum(fit, d)
    if not joint.n:
        return 0, [0] * d, np.zeros(0), np.zeros((d, 0)), 0.0
    sums = [int(s) for s in joint.sums]
    basis = np.linalg.qr(joint.basis)[0]
    projected = scatter(fit, basis, joint.n, sums) / joint.n
    values, turn = np.linalg.eigh(projected)
    trace = float(np.trace(projected))
    best = [i for i in np.argsort(-values, kind="stable")[:most] if values[i] > 4 * d * EPS * trace]
    return joint.n, sums, values[best], basis @ turn[:, best], trace


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n x - sums)^2 of each row; None where it is no 64-bit number."""
    s = np.array(sums, float)
    if len(x) and float(((n * x.astype(float) - s) ** 2).sum(1).max()) < 2.0**62 and float(np.abs(x).max(initial=0)) * n < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(c) - t) ** 2 for c, t in zip(row, sums, strict=True)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(table: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    usable = vectors(table, column)
    d = usable.agg(F.max(F.size("_x"))).first()[0] or 0
    pad = F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("_x")))
    fit = cut(usable.select(pad.alias("_x")).distinct().repartition(parts(table)))
    n, sums, values, basis, trace = components(fit, d, most) if d else (0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    k = len(values)
    axes = basis / np.sqrt(values)
    error = float(np.abs(scatter(fit, axes, n, sums) / n - np.eye(k)).max()) if k else 0.0
    low, part = (np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], float) / n) if n else (np.zeros(d, np.int64), np.zeros(d))
    explained = [float(v) / trace for v in values]
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            rows = len(x)
            if not rows or not k:
                continue
            y = ((x - low) - part) @ axes
            who = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(who)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(who)),
                    pa.array(y.ravel()), pa.array(np.tile(np.array(explained), rows)), pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.select(F.col(f"`{key}`").alias("vec_id"), "_x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
