"""Embedding whitening by incremental eigendecomposition (operator 12).

1. A partition keeps the spectrum of what it has seen: rows n, mean, and the eigenvalues and eigenvectors of the centred scatter. A block
   of rows is folded by QR to at most d rows of the same scatter; each of them, and the shift between the block's mean and the mean so
   far, is a centred rank-one update: the secular equation 1 + sum z_i^2 / (d_i - x) = 0 gives the new eigenvalues, bisected from the
   nearer pole; tiny and repeated entries are deflated first, and the vectors come from the weights that fit the found values exactly
   (Loewner's formula), so they stay orthogonal.
2. Spectra combine likewise: each eigenpair of one is a rank-one update of the other, and the difference of the means is one more. They
   combine in a tree of shuffled groups, sixteen at a time; the driver sees one spectrum of d x d values.
3. Rayleigh-Ritz: one more pass sums the centred rows' products in that basis (again a tree), and the small dense problem turns the
   basis to the eigenvectors at double precision.
4. A last pass measures how far the covariance of the whitened rows is from the identity; then rows are projected.

Means come from exact integer sums. Deviations are exact integers.

Defined results: rows whose vector is null, empty or holds null or non-finite entries (or entries so large that 1024 times them passes
2**49) are dropped; so are vectors of another length than most (ties: the longer). Null ids and repeated rows count as rows of their own.
A component of no variance (below 1e-12 of the trace) has a null whitened value and an explained share as measured; it takes no part in
identity_error. A deviation that no long can hold is null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import written

SPECTRUM = "part bigint, n bigint, mean binary, values binary, vectors binary, sums array<decimal(38,0)>"
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
BLOCK, FAN = 4096, 16


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + z z': d strictly ascending, no entry of z zero."""
    k = len(d)
    z2 = z * z
    gap = np.append(np.diff(d), z2.sum())
    apart = d[None, :] - d[:, None]  # apart[i, j] = d_j - d_i
    # Which half of its interval holds each root decides the pole that it is measured from.
    middle = 1 + (z2 / (apart - gap[:, None] / 2)).sum(1)
    right = middle < 0
    right[-1] = False
    base = np.where(right, np.arange(k) + 1, np.arange(k))
    off = apart[base]  # d_j - d_base
    lo, hi = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    hi[-1] = gap[-1]
    work = np.empty_like(off)
    for _ in range(64):
        x = (lo + hi) / 2
        np.subtract(off, x[:, None], out=work)
        np.divide(z2, work, out=work)
        up = 1 + work.sum(1) < 0
        lo, hi = np.where(up, x, lo), np.where(up, hi, x)
    x = np.where(right, lo, hi)  # never the pole itself
    x = np.where(x == 0, np.where(right, -1, 1) * np.finfo(float).tiny, x)
    diff = off - x[:, None]  # d_j - lambda_i, to high relative accuracy
    # Loewner: the z for which these roots are exact. Factors pair root i with pole i (below j) or i + 1.
    ratio = -diff.copy()  # lambda_i - d_j
    zhat = np.empty(k)
    for j in range(k):
        num = ratio[:, j]
        below, above = num[:j] / (d[:j] - d[j]), num[j:-1] / (d[j + 1 :] - d[j])
        zhat[j] = np.sqrt(abs(np.prod(below) * np.prod(above) * num[-1]))
    vectors = (np.copysign(zhat, z)[None, :] / diff).T
    return d[base] + x, vectors / np.sqrt((vectors * vectors).sum(0))


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of vectors diag(values) vectors' + v v', values ascending before and after."""
    z = vectors.T @ v
    tol = 8 * np.finfo(float).eps * max(np.abs(values).max(initial=0), float(z @ z))
    if tol == 0:
        return values, vectors
    size = float(np.sqrt(z @ z))
    near = np.flatnonzero(np.diff(values) * 1.0 <= tol)
    if len(near):  # equal values: turn each pair so that only the second meets the update
        vectors = vectors.copy()
        for i in near:
            h = np.hypot(z[i], z[i + 1])
            if h > 0:
                c, s = z[i + 1] / h, z[i] / h
                a, b = vectors[:, i].copy(), vectors[:, i + 1].copy()
                vectors[:, i], vectors[:, i + 1] = c * a - s * b, s * a + c * b
                z[i], z[i + 1] = 0.0, h
    live = np.abs(z) * size > tol
    new = values.copy()
    if live.any():
        at = np.flatnonzero(live)
        if len(at) > 1 and np.diff(values[at]).min() <= 0:
            values = values.copy()
            values[at] = np.maximum.accumulate(values[at]) + np.arange(len(at)) * np.finfo(float).eps * np.abs(values).max()
        found, turn = secular(values[at], z[at])
        vectors = vectors.copy()
        new[at] = found
        vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(new, kind="stable")
    return new[order], vectors[:, order]


class Spectrum:
    """n rows' mean and the eigenpairs of their centred scatter."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def shift(self, n: int, mean: np.ndarray) -> None:
        """Take in n rows at this mean: their distance from the mean so far is one centred rank-one update."""
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n * (n / (self.n + n))))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, rows: np.ndarray) -> None:
        mean = rows.mean(0)
        for v in np.linalg.qr(rows - mean, mode="r"):
            if v.any():
                self.update(v)
        self.shift(len(rows), mean)

    def merge(self, other: Spectrum) -> None:
        for e, q in zip(other.values, other.vectors.T, strict=True):
            if e > 0:
                self.update(np.sqrt(e) * q)
        self.shift(other.n, other.mean)

    def row(self, part: int, sums: list[int]) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tobytes(), "values": self.values.tobytes(), "vectors": np.ascontiguousarray(self.vectors).tobytes(), "sums": [Decimal(s) for s in sums]}

    @classmethod
    def of(cls, row) -> Spectrum:
        mean = np.frombuffer(row["mean"])
        s = cls(len(mean))
        s.n, s.mean, s.values, s.vectors = int(row["n"]), mean, np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(len(mean), -1)
        return s


def _blocks(batches):
    """Arrow batches of x as matrices of at most BLOCK rows."""
    for b in batches:
        for lo in range(0, len(b), BLOCK):
            part = b.iloc[lo : lo + BLOCK]
            yield part, np.array(part["x"].tolist(), np.int64)


def _spectra(d: int):
    def run(batches):
        s, sums = Spectrum(d), [0] * d
        for _, x in _blocks(batches):
            s.add(x.astype(np.float64))
            sums = [a + int(b) for a, b in zip(sums, x.sum(0), strict=True)]
        if s.n:
            yield pd.DataFrame([s.row(TaskContext.get().partitionId(), sums)])

    return run


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    s, sums = Spectrum.of(rows.iloc[0]), [int(x) for x in rows["sums"].iloc[0]]
    for _, r in rows.iloc[1:].iterrows():
        s.merge(Spectrum.of(r))
        sums = [a + int(b) for a, b in zip(sums, r["sums"], strict=True)]
    return pd.DataFrame([s.row(int(rows["part"].iloc[0]) // FAN, sums)])


TOTAL = "part bigint, total binary"


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN], "total": [sum(np.frombuffer(t) for t in rows["total"]).tobytes()]})


def _tree(parts: DataFrame, combine, schema: str):
    """One row out of one a partition, sixteen at a time; every level is a shuffle of small rows. None where there is no row."""
    parts = written(parts, "whitening-parts")
    top = parts.agg(F.max("part")).first()[0]
    if top is None:
        return None
    while True:
        parts, top = parts.groupBy(F.floor(F.col("part") / FAN).alias("_g")).applyInPandas(combine, schema), top // FAN
        if top == 0:
            return parts.first()


def _centred(x: np.ndarray, n: int, sums: list[int], exact: bool) -> np.ndarray:
    """n x - S, as exact integers; Python's own where 64 bits could overflow."""
    return x * n - np.array(sums, np.int64) if exact else x.astype(object) * n - np.array(sums, object)


def _products(n: int, sums: list[int], basis: np.ndarray, exact: bool):
    """Per partition the summed outer products of (1, the centred rows in a basis)."""

    def run(batches):
        total, seen = np.zeros((basis.shape[1] + 1,) * 2), False
        for _, x in _blocks(batches):
            y = (_centred(x, n, sums, exact) / n).astype(np.float64) @ basis
            y = np.hstack([np.ones((len(y), 1)), y])
            total, seen = total + y.T @ y, True
        if seen:
            yield pd.DataFrame([{"part": TaskContext.get().partitionId(), "total": total.tobytes()}])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(1024 c) + 100000 of every entry c of the rows that take part."""
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 2.0**39)  # noqa: E731 (also false for infinities)
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e"))
    v = v.where((F.size("e") > 0) & F.forall("e", fit))
    return v.select("vec_id", F.transform("e", lambda c: F.floor(c * 1024.0).cast("bigint") + 100000).alias("x"))


class Whitener:
    """The model of a table: n, exact sums, eigenvalues and unit eigenvectors by falling eigenvalue."""

    def __init__(self, x: DataFrame):
        """x: integers() of a table."""
        most = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.n = 0
        if most is None:
            return
        self.d = most["d"]
        self.x = x.where(F.size("x") == self.d)
        top = _tree(self.x.mapInPandas(_spectra(self.d), SPECTRUM), _combine, SPECTRUM)
        self.n, self.sums = top["n"], [int(s) for s in top["sums"]]
        ends = self.x.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
        self.exact = 2 * self.n * ends < 2**62
        # Rayleigh-Ritz in the whole basis of the combined spectrum.
        basis = np.linalg.qr(Spectrum.of(top).vectors)[0]
        h = self._total(basis)
        values, turn = np.linalg.eigh((h + h.T) / 2)
        self.values, self.vectors = np.maximum(values[::-1], 0), (basis @ turn)[:, ::-1]
        self.trace = float(self.values.sum())

    def _total(self, basis: np.ndarray) -> np.ndarray:
        """Covariance of the centred rows in a basis, divisor n."""
        row = _tree(self.x.mapInPandas(_products(self.n, self.sums, basis, self.exact), TOTAL), _summed, TOTAL)
        t = np.frombuffer(row["total"]).reshape(basis.shape[1] + 1, -1) / self.n
        return t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:])

    def project(self, components: int = 8) -> DataFrame:
        """One row a vector and component."""
        spark = self.x.sparkSession
        n, sums, exact, k = self.n, self.sums, self.exact, min(components, self.d)
        has = self.values[:k] > 1e-12 * self.trace
        scale = np.where(has, 1 / np.sqrt(np.where(has, self.values[:k], 1)), np.nan)
        explained = self.values[:k] / self.trace if self.trace else np.zeros(k)
        basis = self.vectors[:, :k] * np.where(has, scale, 0)
        live = basis[:, has]
        error = float(np.abs(self._total(live) - np.eye(live.shape[1])).max()) if has.any() else 0.0

        def run(batches):
            for part, x in _blocks(batches):
                c = _centred(x, n, sums, exact)
                small = exact and float(np.abs(c).max()) ** 2 * c.shape[1] < 2**62
                dev = (c * c).sum(1) if small else (c.astype(object) ** 2).sum(1)
                dev = [int(v) if v < 2**63 else None for v in dev]
                w = (c / n).astype(np.float64) @ basis
                w[:, ~has] = np.nan
                rows = len(part)
                out = {"vec_id": part["vec_id"].astype("Int64").repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), rows), "n": n, "deviation": pd.array(dev, "Int64").repeat(k)}
                yield pd.DataFrame(out | {"whitened": pd.Series(w.ravel()).astype(object).where(~np.isnan(w.ravel()), None), "explained": np.tile(explained, rows), "identity_error": error})

        return self.x.mapInPandas(run, OUT) if n else spark.createDataFrame([], OUT)


def op12_whitening(vectors: DataFrame) -> DataFrame:
    """The contract's query: fit on all vectors, return each one's first eight whitened components."""
    x = integers(vectors)
    model = Whitener(x)
    return model.project(8) if model.n else x.sparkSession.createDataFrame([], OUT)
