"""Exact vector search and prototypes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, floor: float = -1.0, rows_per_block: int = 32_768) -> DataFrame:
    """query_id, id, cosine, rank: the k most similar rows of ``base`` (id, v) for each of ``queries`` (id, v), itself left out.

    Both sides are cut into blocks by hash; each pair of blocks is one matrix product, which keeps the best k for each
    query, and a window over these (k for each block of the base) gives the result. A row of the base is sent once for
    each block of queries, so the blocks are as large as a task can hold. Rows without vector or with zero length have no
    neighbours; ties go to the smaller id.
    """
    n_base, n_queries = max(1, -(-base.count() // rows_per_block)), max(1, -(-queries.count() // rows_per_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    b = base.where("v is not null").select("id", "v", block(n_base).alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    q = queries.where("v is not null").select("id", "v", block(n_queries).alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))))

    def unit(rows: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(x, np.float64) for x in rows])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        out = [(none, none, np.zeros(0))]
        if len(left) and len(right):
            left = left.sort_values("id")
            x, y, ids, asked = unit(right["v"]), unit(left["v"]), left["id"].to_numpy(), right["id"].to_numpy()
            for at in range(0, len(x), 256):
                s = x[at : at + 256] @ y.T
                own = asked[at : at + 256]
                s[np.isnan(s) | (own[:, None] == ids)] = -np.inf
                if k < len(ids):
                    # All that reach the k-th value, so that ties at the edge are decided by id.
                    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
                else:
                    i, j = np.nonzero(s > -np.inf)
                order = np.lexsort((j, -s[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[place < k], j[place < k]
                out.append((own[i], ids[j], s[i, j]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "id", "cosine"), zip(*out))})

    found = b.groupBy("bb", "qb").cogroup(q.groupBy("bb", "qb")).applyInPandas(best, "query_id bigint, id bigint, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.where(F.col("cosine") >= floor).withColumn("rank", place).where(F.col("rank") <= k)


def pairs_between(rows: DataFrame, least: float, below: float = float("inf"), rows_per_block: int = 8192) -> DataFrame:
    """a, b, score: all pairs of ``rows`` (id, v) with a < b and a cosine in [least, below).

    Rows are cut into blocks by hash; each pair of blocks is one matrix product, and all of its pairs in the band are
    kept. Rows without vector or with zero length are in no pair.
    """
    n = max(1, -(-rows.count() // rows_per_block))
    r = rows.where("v is not null").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "v", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def band(cell: pd.DataFrame) -> pd.DataFrame:
        m = np.stack([np.asarray(x, np.float64) for x in cell["v"]])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)
        ids, block = cell["id"].to_numpy(), cell["block"].to_numpy()
        first, last = cell["p"].iloc[0], cell["q"].iloc[0]
        x, y = np.flatnonzero(block == first), np.flatnonzero(block == last)
        a, b, score = [ids[:0]], [ids[:0]], [np.zeros(0)]
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            s = m[part] @ m[y].T
            ok = (s >= least) & (s < below)
            ok &= ids[part][:, None] < ids[y] if first == last else ids[part][:, None] != ids[y]
            i, j = np.nonzero(ok)
            a.append(np.minimum(ids[part[i]], ids[y[j]]))
            b.append(np.maximum(ids[part[i]], ids[y[j]]))
            score.append(s[i, j])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "score": np.concatenate(score)})

    return r.groupBy("p", "q").applyInPandas(band, "a bigint, b bigint, score double")


def cohesion(rows: DataFrame, members: DataFrame) -> DataFrame:
    """grp, cohesion: mean cosine over all pairs of members (grp, id) of ``rows`` (id, v), from the length of the sum of unit vectors, without making pairs."""
    flat = members.join(rows.where("v is not null"), "id").select("grp", "id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    flat = flat.withColumn("size", size).where("size > 0").select("grp", F.posexplode(F.transform("v", lambda x: x / F.col("size"))).alias("pos", "x"))
    sums = flat.groupBy("grp", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    n = F.max("n").cast("double")
    return sums.groupBy("grp").agg(F.try_divide(F.sum(F.col("x") * F.col("x")) - n, n * (n - 1)).alias("cohesion"))


def prototypes(members: DataFrame) -> DataFrame:
    """grp, v, n: mean vector of each group of ``members`` (grp, v), component by component."""
    flat = members.where("v is not null").select("grp", F.posexplode("v").alias("pos", "x"))
    means = flat.groupBy("grp", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return means.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))


def split_in_two(members: DataFrame, key: str, v: str, most_alike: float = 0.85, seed: int = 3) -> tuple[DataFrame, float, bool]:
    """(rows with side 0 or 1, cosine of the two centres, whether the split counts): k-means with two clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = members.where(F.col(v).isNotNull()).withColumn("features", array_to_vector(F.transform(v, lambda x: x.cast("double"))))
    model = KMeans(k=2, seed=seed, maxIter=20).fit(rows)
    a, b = (np.asarray(c) for c in model.clusterCenters())
    cosine = float(a @ b / max(1e-12, np.linalg.norm(a) * np.linalg.norm(b)))
    return model.transform(rows).select(key, F.col("prediction").alias("side")), cosine, cosine < most_alike


