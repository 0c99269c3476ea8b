"""Chains of pointers followed to their ends by doubling, in a number of joins logarithmic in the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts


def follow(spark, pointers: DataFrame, rounds: int = 40) -> DataFrame:
    """id, current, hops for ``pointers`` (id, next): where the chain that begins at id ends, and how far that is.

    A null next, or one that is no id, ends a chain (an unknown next is itself the end). Chains that never end within
    2**rounds steps, and cycles, have a null current.
    """
    cuts = Cuts(spark, "chains")
    known = pointers.select(F.col("id").alias("_id"), F.col("next").alias("_next"))
    start = pointers.select("id", F.coalesce("next", "id").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("hops"), F.col("next").isNull().alias("done"))
    known = known.select("_id")
    start = start.join(known, F.col("at") == F.col("_id"), "left").select("id", "at", "hops", (F.col("done") | F.col("_id").isNull()).alias("done"))
    state, path = cuts.write(start)
    size, longest = state.count(), 0
    for _ in range(rounds):
        if longest > size or not state.where("not done").count():
            break  # longer than there are ids: a cycle
        goal = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = state.where("not done").join(goal, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        old = path
        state, path = cuts.write(state.where("done").unionByName(moved))
        cuts.drop(old)
        longest = state.agg(F.max("hops")).first()[0] or 0
    return state.select("id", F.when(F.col("done"), F.col("at")).alias("current"), F.when(F.col("done"), F.col("hops")).alias("hops"))
