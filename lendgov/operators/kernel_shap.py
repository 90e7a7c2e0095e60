"""KernelSHAP (E1, E2, J11): Shapley estimates by weighted least squares over coalitions.

Coalitions and weights are shared by every row, so the solve is a constant matrix P, computed once on the driver (size
(M-1) x C). With the last feature eliminated by the efficiency constraint:

  phi_j = sum_c P[j,c] * v_c(x) - E[f] * s_j - (f(x) - E[f]) * t_j,  j < M
  phi_M = f(x) - E[f] - sum_{j<M} phi_j

with s_j = sum_c P[j,c], t_j = sum_c P[j,c] z_cM, and v_c(x) the mean model output over background rows b of the
row mixing x on coalition c with b elsewhere. ``kernel_shap`` takes any model that is a numpy function of columns,
``additive_shap`` models with additive log-odds, for many features and background rows. In both, what does not depend
on the row is sent with the tasks; rows are dealt evenly over all cores (``prep.spread``), without a join with the background.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import split_hash, spread


def coalitions(m: int, n_samples: int | None = None, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Coalition masks (C x M, excluding empty and full) and Shapley kernel weights.

    ``n_samples`` None enumerates all of them; a number draws that many, whatever m is: sizes by
    their kernel mass, members uniformly, each with its complement (which lowers the variance).
    """
    if n_samples is None:
        masks = [s for k in range(1, m) for s in itertools.combinations(range(m), k)]
        z = np.zeros((len(masks), m))
        for i, s in enumerate(masks):
            z[i, list(s)] = 1
        k = z.sum(1)
        w = (m - 1) / (np.array([math.comb(m, int(x)) for x in k]) * k * (m - k))
        return z, w
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, m)
    mass = (m - 1) / (sizes * (m - sizes))
    mass = mass / mass.sum()
    half = np.zeros(((n_samples + 1) // 2, m))
    for row in half:
        row[rng.choice(m, size=rng.choice(sizes, p=mass), replace=False)] = 1
    z = np.concatenate((half, 1 - half))[:n_samples] if n_samples > 1 else half
    return z, np.ones(len(z)) / len(z)


def solve_matrix(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """P = (E'WE)^-1 E'W with E = z[:, :M-1] - z[:, M-1]."""
    e = z[:, :-1] - z[:, -1:]
    ew = e.T * w
    return np.linalg.solve(ew @ e, ew)


#: Background rows that an explanation may use: they are held by every task.
MAX_BACKGROUND = 1000
#: Log-odds up to which exponentials are multiplied; a product of two stays within a double.
EXP_LIMIT = 300.0


def background_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Deterministic sample of n rows, in the order of a fixed integer hash of the id."""
    return df.orderBy(split_hash(id_col), id_col).limit(n)


def additive_shap(rows: DataFrame, background: DataFrame, id_col: str | Sequence[str], features: Sequence[str], bias: float,
                  n_coalitions: int = 2048, seed: int = 42) -> DataFrame:
    """E1 for models whose log-odds are a sum of one part for each feature (``parts``: array in feature order).

    The value of a coalition is the mean probability over the background rows. What does not depend on
    the row (coalitions, their background sums, the solve matrix) is computed once and sent with the tasks; a
    row costs coalitions x background probabilities in numpy. ``background`` (``parts``) is bounded by ``MAX_BACKGROUND``.
    Returns (id, fx, expected_value, phi: array in feature order).
    """
    m = len(features)
    bg = np.array([r["parts"] for r in background.select("parts").limit(MAX_BACKGROUND + 1).collect()], float).reshape(-1, m)
    if not 0 < len(bg) <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
    z, w = coalitions(m, n_coalitions, seed)
    p = solve_matrix(z, w)
    s, t = p.sum(1), p @ z[:, -1]
    # a coalition that was drawn several times is worth the same each time
    z, drawn = np.unique(z, axis=0, return_inverse=True)
    p = np.stack([np.bincount(drawn.ravel(), row, len(z)) for row in p])
    rest = (1 - z) @ bg.T + bias

    def prob(x):
        return 1.0 / (1.0 + np.exp(-x))

    expected = float(prob(bg.sum(1) + bias).mean())
    # exp(-(rest + own)) is a product, so a row takes an exponential for each coalition and none for each background row
    factors = np.exp(-np.clip(rest, -EXP_LIMIT, EXP_LIMIT))
    bounded = bool((np.abs(rest) <= EXP_LIMIT).all())

    def worth(own):
        """The mean probability of every coalition over the background; ``own``: what the row gives to each."""
        if not bounded or not (np.abs(own) <= EXP_LIMIT).all():
            return prob(rest + own[:, None]).mean(1)
        odds = factors * np.exp(-own)[:, None]
        odds += 1.0
        return np.divide(1.0, odds, out=odds).mean(1)

    @F.arrow_udf("struct<fx: double, phi: array<double>>")
    def explain(parts: pa.Array) -> pa.Array:
        x = np.array(parts.to_pylist(), float).reshape(-1, m)
        fx = prob(x.sum(1) + bias)
        phi = np.empty((len(x), m))
        for i, row in enumerate(x):
            phi[i, :-1] = p @ worth(z @ row) - expected * s - (fx[i] - expected) * t
        phi[:, -1] = fx - expected - phi[:, :-1].sum(1)
        return pa.StructArray.from_arrays([pa.array(fx), pa.array(phi.tolist(), pa.list_(pa.float64()))], ["fx", "phi"])

    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    return spread(rows.select(*keys, "parts")).select(*keys, explain.asNondeterministic()("parts").alias("r")).select(
        *keys, "r.fx", F.lit(expected).alias("expected_value"), "r.phi")


#: Model outputs that a task computes at once.
BLOCK_OUTPUTS = 1 << 18


def kernel_shap(rows: DataFrame, background: DataFrame, id_col: str, features: Sequence[str],
                model: Callable[[np.ndarray], np.ndarray], n_coalitions: int | None = None, seed: int = 42) -> DataFrame:
    """Shapley estimates of ``model`` for every row: id, fx, expected_value, phi (array in feature order).

    ``model`` maps values (features, n) to n outputs; with ``n_coalitions`` None all coalitions are used and the values are exact.
    ``background`` has at most ``MAX_BACKGROUND`` rows (e.g. from ``background_sample``). Features are read as doubles, null as NaN.
    """
    m = len(features)
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).alias("x")
    bg = np.array([r["x"] for r in background.select(values).limit(MAX_BACKGROUND + 1).collect()], float).reshape(-1, m)
    if not 0 < len(bg) <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
    z, w = coalitions(m, n_coalitions, seed)
    p = solve_matrix(z, w) if m > 1 else np.zeros((0, len(z)))
    s, t, member = p.sum(1), p @ z[:, -1], z.astype(bool)
    expected = float(model(bg.T).mean())
    at_once = max(1, BLOCK_OUTPUTS // max(1, len(z) * len(bg)))

    @F.arrow_udf("struct<fx: double, phi: array<double>>")
    def explain(given: pa.Array) -> pa.Array:
        x = given.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
        fx, phi = model(x.T), np.empty((len(x), m))
        for i in range(0, len(x), at_once):
            own = x[i:i + at_once]
            mixed = np.where(member[None, :, None, :], own[:, None, None, :], bg[None, None])
            v = model(mixed.reshape(-1, m).T).reshape(len(own), len(z), len(bg)).mean(2)
            phi[i:i + at_once, :-1] = v @ p.T - expected * s - (fx[i:i + at_once, None] - expected) * t
        phi[:, -1] = fx - expected - phi[:, :-1].sum(1)
        return pa.StructArray.from_arrays([pa.array(fx), pa.array(phi.tolist(), pa.list_(pa.float64()))], ["fx", "phi"])

    return spread(rows.select(id_col, values)).select(id_col, explain.asNondeterministic()("x").alias("r")).select(
        id_col, "r.fx", F.lit(expected).alias("expected_value"), "r.phi")
