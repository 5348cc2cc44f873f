"""Embedding whitening: principal components and deviations by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become integers x = floor(scale * c) + offset. The *fit list* X holds each distinct vector once; its n rows are centred by the integer sums
S as (n x - S) / n before anything is multiplied.

*Bidiagonalisation.* From a start vector v the products ``X v`` and ``X' u`` alternate: u_k = (X v_k - b u_(k-1)) / a_k and v_(k+1) = (X' u_k - a_k v_k) / b.
One scan does both, because u_k is X w_k for a vector w_k of as many entries as there are dimensions: a task computes z = X p for its rows and adds up X' z at
once, so no vector as long as the table is ever stored, and a lost task is simply run again. Both sides are fully reorthogonalised,
twice: v_k against all v before it, u_k against all u before it through u_i' u_k = w_i' (X' X w_k). Where a or b vanishes (copies of
an eigenvalue, or too few dimensions in use) a new direction orthogonal to all before it goes on with b = 0.

*Components.* The small bidiagonal matrix is decomposed after each step on the driver (``dims`` entries a row, ``steps`` rows). The scans end when the residuals of all
wanted components are below ``tolerance`` of the largest one, at the latest after ``dims`` steps, when the decomposition is complete. Right
singular vectors are the components, singular values squared over n their variances.

What the driver holds grows with dims squared, never with rows. Scans read columns of the fit list, which is written once to the shared folder.

Defined cases: vectors that are null, or hold null or non-finite entries, take no part; ids may be null or repeated; a shorter (or empty) vector counts as padded with
c = 0; x saturates at +-2**52; ``deviation`` is null if it does not fit a long; components without variance do not exist, so a fit list of one vector, or an empty table, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoloom.llm.tables import stored

LIMIT = 1 << 52
HALF = 26


def sound_vectors(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(vec_id, x)`` for the rows that take part."""
    c = F.col("embedding").cast("array<double>")
    sound = F.forall(c, lambda e: F.coalesce((e > float("-inf")) & (e < float("inf")), F.lit(False)))

    def whole(e: Column) -> Column:
        return F.least(F.greatest(F.floor(e * scale), F.lit(-LIMIT)), F.lit(LIMIT)) + offset

    return vectors.where(c.isNotNull() & sound).select("vec_id", F.transform(c, whole).alias("x"))


def _matrix(column: pa.Array, dims: int, offset: int) -> np.ndarray:
    """Rows of an array<long> column; shorter ones are filled with c = 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.full((len(sizes), dims), offset, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


class Frame:
    """Exact sums of the fit list, and rows centred by them."""

    def __init__(self, n: int, sums: list[int], offset: int):
        self.n, self.sums, self.offset = n, sums, offset

    @property
    def dims(self) -> int:
        return len(self.sums)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n x - S as exact integers: int64 where they fit, else Python integers."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        kind = np.int64 if most < 1 << 61 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n

    def rows(self, column: pa.Array) -> np.ndarray:
        return _matrix(column, self.dims, self.offset)


def _totals(df: DataFrame, task, width: int) -> np.ndarray:
    """Sum over all rows of ``task(array of x)``, a vector of ``width`` numbers: one partial result per task, added up by Spark."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += task(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["at", "part"])

    rows = df.mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    out = np.zeros(width)
    for row in rows:
        out[row["at"]] = row["part"]
    return out


def fit_frame(fit: DataFrame, offset: int = 1_000_000) -> Frame:
    """Row count and exact per-dimension sums: entries are added up in two halves, so no partial sum can overflow."""
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return Frame(0, [], offset)

    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims, offset)
            n, high, low = n + len(x), high + (x >> HALF).sum(axis=0), low + (x & ((1 << HALF) - 1)).sum(axis=0)
        columns = [np.arange(dims + 1, dtype=np.int32), np.append(high, 0), np.append(low, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {r["at"]: (r["high"] << HALF) + r["low"] for r in parts.collect()}
    return Frame(found.get(dims, 0), [found[i] for i in range(dims)] if found else [], offset)


class Bidiagonal:
    """The state of the iteration; ``scan(p)`` has to return X' (X p)."""

    def __init__(self, dims: int, scan, seed: int = 13):
        self.dims, self.scan, self.rng = dims, scan, np.random.default_rng(seed)
        self.v, self.w, self.g = (np.zeros((0, dims)) for _ in range(3))  # right vectors, w with u = X w, X' u
        self.alphas, self.betas = [], []

    def _fresh(self) -> np.ndarray | None:
        """A random direction orthogonal to all right vectors; None if they span everything."""
        if len(self.v) == self.dims:
            return None
        x = self.rng.standard_normal(self.dims)
        for _ in range(3):
            x -= self.v.T @ (self.v @ x)
            x /= np.linalg.norm(x)
        return x

    def step(self) -> bool:
        """One right vector more; False if there is none left."""
        scale = max([*self.alphas, *self.betas], default=0.0)
        beta, v = 0.0, None
        if len(self.v):
            v = self.g[-1] - self.alphas[-1] * self.v[-1]
            for _ in range(2):
                v -= self.v.T @ (self.v @ v)
            beta = float(np.linalg.norm(v))
        if v is None or beta <= 1e-12 * scale * self.dims:
            beta, v = 0.0, self._fresh()
        elif len(self.v) < self.dims:
            v = v / beta
        else:
            v = None
        if v is None:
            return False
        if len(self.v):
            self.betas.append(beta)
        p = v - beta * self.w[-1] if len(self.w) else v.copy()
        g = self.scan(p)
        for _ in range(2):  # u against all u before it
            c = self.w @ g
            p, g = p - self.w.T @ c, g - self.g.T @ c
        alpha = float(np.sqrt(max(p @ g, 0.0)))
        self.v = np.vstack([self.v, v])
        if alpha <= 1e-12 * max(scale, alpha) * self.dims:
            alpha, p, g = 0.0, np.zeros(self.dims), np.zeros(self.dims)
        else:
            p, g = p / alpha, g / alpha
        self.w, self.g = np.vstack([self.w, p]), np.vstack([self.g, g])
        self.alphas.append(alpha)
        return True

    def small_svd(self):
        """(singular values falling, right singular vectors as rows, residuals)."""
        k = len(self.alphas)
        b = np.diag(self.alphas) + np.diag(self.betas, 1)
        left, sigma, right = np.linalg.svd(b)
        # What the next right vector would add: X' u_k - a_k v_k.
        rest = self.g[-1] - self.alphas[-1] * self.v[-1]
        rest -= self.v.T @ (self.v @ rest)
        return sigma, right @ self.v, np.abs(left[k - 1]) * np.linalg.norm(rest)


class Whitening:
    """Components as rows, their variances falling, and what identifies the fit."""

    def __init__(self, frame: Frame, components: np.ndarray, variances: np.ndarray, trace: float):
        self.frame, self.components, self.variances, self.trace = frame, components, variances, trace
        self.identity_error = 0.0
        self.scans = 0

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.frame.centred(x) @ self.components.T / np.sqrt(self.variances)


def fit_whitening(vectors: DataFrame, wanted: int = 16, offset: int = 1_000_000, tolerance: float = 1e-13) -> Whitening:
    """Fits on the distinct ``x`` of ``vectors(x)``."""
    fit = stored(vectors.select("x").distinct(), "whitening-fit")
    frame = fit_frame(fit, offset)
    none = Whitening(frame, np.zeros((0, frame.dims)), np.zeros(0), 0.0)
    if frame.n < 2:
        return none

    def product(p):
        def task(column):
            y = frame.centred(frame.rows(column))
            return y.T @ (y @ p)

        return _totals(fit, task, frame.dims)

    trace = float(_totals(fit, lambda column: np.array([(frame.centred(frame.rows(column)) ** 2).sum()]), 1)[0]) / frame.n
    if trace == 0:
        return none
    work = Bidiagonal(frame.dims, product)
    while work.step():
        if len(work.v) >= min(wanted + 2, frame.dims):
            sigma, _, residual = work.small_svd()
            # A vanishing step may hide copies of an eigenvalue: only a finished or a plainly converged run ends.
            if (residual[:wanted] <= tolerance * sigma[0]).all() and all(b > 0 for b in work.betas[-2:]) and work.alphas[-1] > 0:
                break
    sigma, right, _ = work.small_svd()
    variances = sigma**2 / frame.n
    used = variances[:wanted] > 1e-20 * max(variances[0], trace)
    used &= variances[:wanted] > (1e-13 * frame.dims) ** 2 * variances[0]
    out = Whitening(frame, right[:wanted][used], variances[:wanted][used], trace)
    out.scans = len(work.v)
    k = len(out.variances)

    def spread(column):
        y = out.project(frame.rows(column))
        return (y.T @ y).ravel()

    out.identity_error = float(np.abs(_totals(fit, spread, k * k).reshape(k, k) / frame.n - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vectors(vec_id, x)`` -> one row per vector and component."""
    frame, k = model.frame, len(model.variances)
    explained = model.variances / model.trace if k else np.zeros(0)
    # The id passes through Python as it is.
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = frame.rows(part.column(1))
                spread = frame.spread(x)
                kind = np.int64 if frame.dims * int(np.abs(spread).max(initial=0)) ** 2 < 1 << 62 else object
                square = (spread.astype(kind) ** 2).sum(axis=1)
                deviation = pa.array([int(s) if s < 1 << 63 else None for s in square], pa.int64())
                y = spread.astype(np.float64) / frame.n @ model.components.T / np.sqrt(model.variances)
                rows = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        deviation.take(pa.array(rows)),
                        pa.array(y.ravel()),
                        pa.array(np.tile(explained, len(x))),
                    ],
                    ["vec_id", "component", "deviation", "whitened", "explained"],
                )

    rows = vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, component int, deviation long, whitened double, explained double")
    return rows.select(
        "vec_id", "component", F.lit(frame.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
