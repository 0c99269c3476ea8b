"""All pairs of records whose sets overlap enough (set-F1 = 2 * common / sum of sizes).

One-bit minhash codes can't give the required result here: at a set-F1 of 0.75 (Jaccard 0.6) two codes agree in 80 % of
their bits and unrelated ones in 50 %, so code segments short enough to lose no pair join nearly everything (figures in
the README). Instead the pigeonhole is applied to the sets themselves, where it is exact. Elements are ordered by rarity;
two sets that must share c elements share k of them among the first (size - c + k) of each. Each set emits the k-subsets
of that prefix (k = 3, 2 for the smallest sets, 1 for pairs of large ones) and equal subsets are joined. A packed 64-bit
code of each set (one hashed bit per element) then drops candidates beyond the Hamming radius that the threshold allows,
which is an exact bound, and the original sets are verified. Up to there only numbers travel: the hash of the subset (two
subsets of one hash are one more candidate), the class, the code and the sizes; the sets meet the surviving pairs alone.

Defined results: null or blank elements don't count, elements count once, a null or empty set is similar to none, a
record given in several rows has the union of their sets, records with equal sets are joined once as a class and expanded
at the end; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts

#: Pairs with both sizes above this are found by single elements, all others by subsets of two or three.
LARGE = 12
#: Signatures made at once, and the odd number that mixes element hashes.
HELD, MIX = 1 << 16, np.uint64(0x9E3779B97F4A7C15)


def _needed(a: int, b: int, f1: float) -> int:
    """Least number of common elements of sets of sizes a and b."""
    return math.ceil(f1 * (a + b) / 2 - 1e-9)


def subsets(size: int, f1: float) -> list[tuple[int, int]]:
    """(k, length of the prefix) of the signatures that a set of a size emits; every similar partner shares one of them."""
    partners = range(max(1, math.ceil(size * f1 / (2 - f1) - 1e-9)), math.floor(size * (2 - f1) / f1 + 1e-9) + 1)
    longest: dict[int, int] = {}
    for b in partners:
        c = _needed(size, b, f1)
        if c > min(size, b):
            continue
        k = 1 if min(size, b) > LARGE else min(3, c)
        longest[k] = max(longest.get(k, 0), size - c + k)
    return sorted((k, min(n, size)) for k, n in longest.items())


def _signatures(f1: float):
    """sig, class_id, code, n of every signature of a set, given as 64-bit element hashes in order of rarity."""
    schema = pa.schema([("sig", pa.int64()), ("class_id", pa.int64()), ("code", pa.int64()), ("n", pa.int32())])
    plans: dict[int, np.ndarray | list] = {}

    def plan(size: int) -> list[np.ndarray]:
        out = plans.get(size)
        if out is None:
            out = plans[size] = [np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k) for k, n in subsets(size, f1)]
        return out

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranked = batch.column("ranked")
            values, offsets = ranked.flatten().to_numpy().view(np.uint64), ranked.offsets.to_numpy()
            offsets = offsets - offsets[0]
            sizes, ids = np.diff(offsets), batch.column("class_id").to_numpy()
            bits = np.uint64(1) << (values & np.uint64(63))
            for size in np.unique(sizes):
                if not size:
                    continue
                of = np.flatnonzero(sizes == size)
                items = values[offsets[of][:, None] + np.arange(size)]
                code = np.bitwise_or.reduceat(bits, offsets[:-1][sizes > 0])[np.searchsorted(np.flatnonzero(sizes > 0), of)]
                for picks in plan(int(size)):
                    step = max(1, HELD // max(1, len(picks)))
                    for at in range(0, len(of), step):
                        part = items[at : at + step][:, picks]
                        sig = np.full(part.shape[:2], picks.shape[1], np.uint64)
                        for j in range(picks.shape[1]):
                            sig = (sig ^ part[:, :, j]) * MIX
                            sig ^= sig >> np.uint64(31)
                        n = part.shape[1]
                        own = slice(at, at + step)
                        columns = [sig.ravel().view(np.int64), np.repeat(ids[of[own]], n), np.repeat(code[own].view(np.int64), n), np.full(sig.size, size, np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return emit


def classes(cuts: Cuts, rows: DataFrame, sets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(classes: class_id, the distinct combinations of sets, n_ids; membership: class_id, id).

    ``rows`` has id and the array columns ``sets``, already cleaned. The sets of an id are the unions over its rows. An id
    finds its class by 128 bits of its sets.
    """
    one = rows.where("id is not null").groupBy("id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(s, F.array().cast("array<string>")))))).alias(s) for s in sets])
    full = F.lit(True)
    for s in sets:
        full = full & (F.size(s) > 0)
    digest = F.struct(F.xxhash64(*sets).alias("x"), F.xxhash64(F.lit("second"), *sets).alias("y"))
    one = cuts.cut(one.where(full).withColumn("digest", digest))
    kinds = cuts.cut(one.groupBy("digest", *sets).agg(F.count("*").alias("n_ids")).withColumn("class_id", F.monotonically_increasing_id()))
    return kinds, one.select("id", "digest").join(kinds.select("digest", "class_id"), "digest").select("class_id", "id")


def class_pairs(cuts: Cuts, kinds: DataFrame, main: str, f1: dict[str, float]) -> DataFrame:
    """class_a < class_b of the different classes that are similar in every set; ``main`` makes the candidates."""
    items = cuts.cut(kinds.select(F.explode(main).alias("item")).groupBy("item").agg(F.count("*").alias("n")))
    # Rarest first. The rank is (count, hash), a number made of both keeps the order without a global sort.
    flat = kinds.select("class_id", F.explode(main).alias("item")).join(items, "item").select("class_id", "n", F.xxhash64("item").alias("h"))
    ranked = flat.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("r"))
    ranked = ranked.select("class_id", F.transform("r", lambda x: x["h"]).alias("ranked"))
    sigs = cuts.cut(ranked.mapInArrow(_signatures(f1[main]), "sig bigint, class_id bigint, code bigint, n int"))
    a = sigs.select("sig", F.col("class_id").alias("class_a"), F.col("code").alias("code_a"), F.col("n").alias("n_a"))
    b = sigs.select("sig", F.col("class_id").alias("class_b"), F.col("code").alias("code_b"), F.col("n").alias("n_b"))
    total = F.col("n_a") + F.col("n_b")
    radius = total - 2 * F.ceil(F.lit(f1[main]) * total / 2 - 1e-9)
    near = (F.col("class_a") < F.col("class_b")) & (F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= radius)
    near = cuts.cut(a.join(b, "sig").where(near).select("class_a", "class_b").distinct())
    for side in ("a", "b"):
        near = near.join(kinds.select(F.col("class_id").alias(f"class_{side}"), *[F.col(s).alias(f"{side}_{s}") for s in f1]), f"class_{side}")
    good = F.lit(True)
    for s, least in f1.items():
        common = F.size(F.array_intersect(f"a_{s}", f"b_{s}"))
        good = good & (2 * common >= F.lit(least) * (F.size(f"a_{s}") + F.size(f"b_{s}")) - 1e-9)
    return near.where(good).select("class_a", "class_b")


def similar_pairs(spark, rows: DataFrame, main: str, f1: dict[str, float]) -> DataFrame:
    """id_a < id_b: all pairs of different ids whose sets reach the thresholds ``f1`` (column -> least set-F1)."""
    cuts = Cuts(spark, "sets")
    kinds, members = classes(cuts, rows, list(f1))
    links = cuts.cut(class_pairs(cuts, kinds, main, f1))
    left, right = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x")), members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    between = links.join(left, "class_a").join(right, "class_b").select("x", "y")
    repeated = kinds.where("n_ids > 1").select(F.col("class_id").alias("class_a"))
    same = left.join(repeated, "class_a", "left_semi")
    within = same.join(right, (F.col("class_a") == F.col("class_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def class_report(spark, rows: DataFrame, main: str, f1: dict[str, float]) -> DataFrame:
    """id, class_id (smallest id with equal sets) and n_links: how many other ids the id is similar to."""
    cuts = Cuts(spark, "sets")
    kinds, members = classes(cuts, rows, list(f1))
    links = cuts.cut(class_pairs(cuts, kinds, main, f1))
    sizes = kinds.select(F.col("class_id").alias("other"), F.col("n_ids").alias("n_other"))
    both = links.select("class_a", F.col("class_b").alias("other")).unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("other")))
    degree = both.join(sizes, "other").groupBy(F.col("class_a").alias("class_id")).agg(F.sum("n_other").alias("n_far"))
    least = members.groupBy("class_id").agg(F.min("id").alias("least"))
    full = kinds.join(degree, "class_id", "left").join(least, "class_id").select("class_id", "least", (F.coalesce("n_far", F.lit(0)) + F.col("n_ids") - 1).alias("n_links"))
    return members.join(full, "class_id").select("id", F.col("least").alias("class_id"), "n_links")
