"""Tensor-train matrices: parameter count, dense form, product with vectors, gradients. Cores have shape (r, out, in, r')."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(cores: list[np.ndarray]) -> None:
    if not cores or cores[0].shape[0] != 1 or cores[-1].shape[3] != 1 or any(a.shape[3] != b.shape[0] for a, b in zip(cores, cores[1:])):
        raise ValueError("ranks of neighbouring cores must agree, and be 1 at both ends")


def parameter_count(cores: list[np.ndarray]) -> int:
    return sum(c.size for c in cores)


def dense(cores: list[np.ndarray]) -> np.ndarray:
    """The full matrix, (product of outs) x (product of ins)."""
    check(cores)
    out = np.ones((1, 1, 1))
    for c in cores:
        out = np.einsum("mip,pojq->moijq", out, c)
        m, o, i, j, q = out.shape
        out = out.reshape(m * o, i * j, q)
    return out[:, :, 0]


def matvec(cores: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (batch x ins) times the matrix, without forming it."""
    check(cores)
    t = x.reshape(len(x), 1, 1, -1)  # batch, outs so far, rank, ins left
    for c in cores:
        b, m, r, rest = t.shape
        t = t.reshape(b, m, r, c.shape[2], rest // c.shape[2])
        t = np.einsum("bmrij,rois->bmosj", t, c)
        b, m, o, s, j = t.shape
        t = t.reshape(b, m * o, s, j)
    return t[:, :, 0, 0]


def gradients(cores: list[np.ndarray], x: np.ndarray, dy: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of sum(dy * matvec(cores, x)) with respect to the cores and to x."""
    check(cores)
    full = np.einsum("bo,bi->oi", dy, x)  # gradient of the dense matrix
    outs, ins = [c.shape[1] for c in cores], [c.shape[2] for c in cores]
    k = len(cores)
    g = full.reshape(outs + ins).transpose([v for p in range(k) for v in (p, k + p)])  # o1 i1 o2 i2 ...
    result = []
    for p in range(k):
        left = np.ones((1, 1))
        for c in cores[:p]:
            left = np.einsum("ar,rois->aois", left, c).reshape(-1, c.shape[3])
        right = np.ones((1, 1))
        for c in reversed(cores[p + 1 :]):
            right = np.einsum("rois,sz->roiz", c, right).reshape(c.shape[0], -1)
        shaped = g.reshape(left.shape[0], outs[p] * ins[p], right.shape[1])
        result.append(np.einsum("ar,aez,sz->res", left, shaped, right).reshape(cores[p].shape))
    return result, dy @ dense(cores)


def apply(df: DataFrame, key: str, vector: str, cores: list[np.ndarray]) -> DataFrame:
    """key, y: each row's vector times the matrix; null vectors stay null."""
    check(cores)

    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        there = [x is not None for x in v]
        y = iter(matvec(cores, np.stack([np.asarray(x, float) for x, t in zip(v, there) if t])) if any(there) else ())
        return pd.Series([next(y) if t else None for t in there], index=v.index, dtype=object)

    return df.select(key, product(F.col(vector)).alias("y"))


def gradient_check(df: DataFrame, key: str, vector: str, cores: list[np.ndarray], step: float = 1e-6) -> DataFrame:
    """key, worst, agree: for each row's vector x, gradients of half the squared length of the product against central differences.

    All entries of the cores are compared; worst is the largest difference relative to the largest gradient. Null vectors
    have null results.
    """
    check(cores)

    def value(changed: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return (matvec(changed, x) ** 2).sum(1) / 2

    @F.pandas_udf("worst double, agree boolean")
    def compare(v: pd.Series) -> pd.DataFrame:
        there = np.array([x is not None for x in v])
        out = pd.DataFrame({"worst": [None] * len(v), "agree": [None] * len(v)}, dtype=object)
        if not there.any():
            return out
        x = np.stack([np.asarray(a, float) for a, t in zip(v, there) if t])
        y = matvec(cores, x)
        slopes = []
        for k, c in enumerate(cores):
            for at in np.ndindex(c.shape):
                up, down = [a.copy() for a in cores], [a.copy() for a in cores]
                up[k][at] += step
                down[k][at] -= step
                slopes.append((value(up, x) - value(down, x)) / (2 * step))
        exact = np.stack([np.concatenate([g.ravel() for g in gradients(cores, x[i : i + 1], y[i : i + 1])[0]]) for i in range(len(x))])
        worst = np.abs(np.stack(slopes, 1) - exact).max(1) / np.maximum(1e-12, np.abs(exact).max(1))
        out.loc[there, "worst"] = worst
        out.loc[there, "agree"] = worst < 1e-5
        return out

    return df.select(key, compare(F.col(vector)).alias("c")).select(key, "c.*")
