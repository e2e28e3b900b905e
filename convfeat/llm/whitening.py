"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become integer rows x = floor(256 * c). The fit list is every distinct x once (n rows,
column sums S, mean m = S / n); the centred matrix X has rows x - m. Bidiagonalisation builds
orthonormal v_1, v_2, ... in the dimension space and u_1, u_2, ... in the row space with
X v_j = alpha_j u_j + beta_{j-1} u_{j-1}. Every left vector is kept as u = X a for a known
dimension-space vector a, so that one distributed pass over the fit list gives both alternating
products at once: each row forms its entry of X a, and the rows sum X^T (X a). Inner products of
left vectors, needed for full re-orthogonalisation, follow from the same sum, so no row-length
vector is ever held anywhere. The small bidiagonal matrix is decomposed by SVD on the driver; its
right singular vectors, mapped through the v_j, are the components, sigma^2 / n their eigenvalues.
The bidiagonalisation runs its full d steps (d passes), so that it is exact up to rounding: a
Krylov space stopped early holds one vector per eigenvalue and misses repeated ones. A step that
breaks down restarts with the unit vector least covered by the basis, so components of repeated
or vanishing eigenvalues are found too.

Cases: rows with a null vector, or a null, NaN or infinite entry, take no part; so do extra columns.
Vectors shorter than the longest valid one are filled with zeros to its length. Repeated vectors
enter the fit once but are all whitened and returned. An empty table, a single distinct vector or
vectors that are all equal have no component of positive variance and give an empty result; only
components of positive eigenvalue are returned (at most four). Entries beyond +-2^55 saturate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convfeat.llm.common import written

#: Components returned per row.
COMPONENTS = 4


def valid_rows(embeddings: DataFrame, *carried: str) -> DataFrame:
    """vec_id, ``carried`` columns and x (array<long>, floor(256 * c)) of rows whose vector is whole and finite."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(math.inf)))
    kept = embeddings.where(F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", *carried, F.transform("embedding", lambda e: F.floor(F.lit(256.0) * e.cast("double")).cast("long")).alias("x"))


def padded(rows: DataFrame, width: int) -> DataFrame:
    """x filled with zeros to ``width`` entries."""
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def _entry(i: int) -> Column:
    return F.col("x")[i]


class Products:
    """G a = X^T (X a) for the centred fit list, one Spark job per call."""

    def __init__(self, fit: DataFrame, mean: np.ndarray):
        self.fit, self.mean, self.passes = fit, mean, 0

    def __call__(self, a: np.ndarray) -> np.ndarray:
        d = len(a)
        centred = [_entry(i).cast("double") - F.lit(float(self.mean[i])) for i in range(d)]
        u = sum((c * F.lit(float(a[i])) for i, c in enumerate(centred)), F.lit(0.0))
        row = self.fit.select(*[c.alias(f"c{i}") for i, c in enumerate(centred)], u.alias("u"))
        sums = row.agg(*[F.sum(F.col(f"c{i}") * F.col("u")).alias(f"g{i}") for i in range(d)]).first()
        self.passes += 1
        return np.array([sums[f"g{i}"] or 0.0 for i in range(d)], np.float64)


def bidiagonalise(product, d: int, scale: float):
    """Singular values and right singular vectors (columns) of X from products ``product(a) = X^T X a``.

    ``scale`` bounds the largest singular value (the Frobenius norm of X); below 1e-12 of it a
    step counts as broken down.
    """
    tiny = 1e-12 * scale
    vs, lefts, lefts_g, alphas, betas = [], [], [], [], []
    v = np.ones(d) / math.sqrt(d)
    beta = 0.0
    for step in range(d):
        a = v - beta * lefts[-1] if lefts else v.copy()
        g = product(a)
        if lefts_g:
            for _ in range(2):  # full re-orthogonalisation of u = X a against all earlier u_i = X a_i
                basis, images = np.array(lefts), np.array(lefts_g)
                c = basis @ g
                a, g = a - c @ basis, g - c @ images
        alpha = math.sqrt(max(float(a @ g), 0.0))
        if alpha <= tiny:
            alpha, a, g = 0.0, np.zeros(d), np.zeros(d)
        else:
            a, g = a / alpha, g / alpha
        vs.append(v), lefts.append(a), lefts_g.append(g), alphas.append(alpha)
        r = g - alpha * v
        basis = np.array(vs)
        for _ in range(2):
            r = r - (basis @ r) @ basis
        beta = float(np.linalg.norm(r))
        k = step + 1
        if k == d:
            break
        if beta <= tiny:  # the basis spans an invariant subspace: go on with the least covered unit vector
            residual = np.eye(d) - basis.T @ basis
            pick = int(np.argmax(np.linalg.norm(residual, axis=0)))
            r = residual[:, pick]
            for _ in range(2):
                r = r - (basis @ r) @ basis
            v, beta = r / np.linalg.norm(r), 0.0
        else:
            v = r / beta
        betas.append(beta)
    _, sigma, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    return sigma, np.array(vs).T @ qt.T


def _fit(rows: DataFrame, width: int):
    fit = written(rows.select("x").distinct(), "whitening-fit")
    sums = fit.agg(F.count(F.lit(1)).alias("n"), *[F.sum(_entry(i)).alias(f"s{i}") for i in range(width)],
                   F.sum(F.aggregate("x", F.lit(0).cast("long"), lambda acc, e: acc + e * e)).alias("sq")).first()
    n = int(sums["n"])
    totals = [int(sums[f"s{i}"] or 0) for i in range(width)]
    return fit, n, totals, int(sums["sq"] or 0)


def whitened(embeddings: DataFrame) -> DataFrame:
    """Per valid row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = written(valid_rows(embeddings), "whitening-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if width == 0:
        return spark.createDataFrame([], schema)
    rows = padded(rows, width)
    fit, n, totals, squares = _fit(rows, width)
    # n^2 trace(V) = n * sum |x|^2 - |S|^2, exact in integers
    trace = (n * squares - sum(s * s for s in totals)) / (n * n) if n else 0.0
    if trace <= 0:
        return spark.createDataFrame([], schema)
    mean = np.array(totals, np.float64) / n
    sigma, right = bidiagonalise(Products(fit, mean), width, math.sqrt(n * trace))
    eigen = sigma**2 / n
    keep = [k for k in range(min(COMPONENTS, len(eigen))) if eigen[k] > 1e-12 * trace]
    if not keep:
        return spark.createDataFrame([], schema)
    vectors = [right[:, k] * (1.0 if right[np.argmax(np.abs(right[:, k])), k] > 0 else -1.0) for k in keep]

    def projection(frame_col_mean: np.ndarray, vector: np.ndarray, value: float) -> Column:
        terms = [(_entry(i).cast("double") - F.lit(float(frame_col_mean[i]))) * F.lit(float(vector[i])) for i in range(width)]
        return sum(terms, F.lit(0.0)) / F.lit(math.sqrt(value))

    projected = [projection(mean, vectors[j], float(eigen[k])) for j, k in enumerate(keep)]
    # covariance of the whitened fit list against the identity, in one pass
    names = [f"w{j}" for j in range(len(keep))]
    white = fit.select(*[p.alias(c) for p, c in zip(projected, names)])
    moments = white.agg(*[F.sum(c).alias(f"m_{c}") for c in names],
                        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a in names for b in names]).first()
    error = 0.0
    for a in names:
        for b in names:
            cov = moments[f"p_{a}_{b}"] / n - (moments[f"m_{a}"] / n) * (moments[f"m_{b}"] / n)
            error = max(error, abs(cov - (1.0 if a == b else 0.0)))
    deviation = sum(((F.lit(n) * _entry(i) - F.lit(totals[i])) * (F.lit(n) * _entry(i) - F.lit(totals[i])) for i in range(width)), F.lit(0).cast("long"))
    parts = F.array(*[F.struct(F.lit(j + 1).alias("component"), p.alias("whitened"), F.lit(float(eigen[k] / trace)).alias("explained")) for j, (k, p) in enumerate(zip(keep, projected))])
    out = rows.select("vec_id", deviation.alias("deviation"), F.explode(parts).alias("c"))
    return out.select(
        "vec_id",
        F.col("c.component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
