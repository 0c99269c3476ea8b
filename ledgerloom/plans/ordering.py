"""Order within groups of any size, without a task for each group.

A range partition by (group, order) splits a group over as many partitions as its rows need. What a window over the group
would give is then computed within partitions, and the few facts that cross a border come from a table of one row for
each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts


def ranged(cuts: Cuts, df: DataFrame, *keys: str) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions, written, with pid (the partition) and seq (increasing in the order)."""
    ordered = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return cuts.cut(ordered.withColumns({"pid": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))


def last_before(df: DataFrame, group: str, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add, for each name -> (condition, value), the value of the last earlier row of the group that meets the condition.

    ``df`` comes from ``ranged`` with ``group`` as first key. Null where there is none.
    """
    names = list(values)
    fact = {n: F.when(values[n][0], F.struct(F.col("seq").alias("s"), F.col(group).alias("g"), values[n][1].alias("v"))) for n in names}
    df = df.withColumns({f"_f_{n}": fact[n] for n in names})
    ends = df.groupBy("pid").agg(*[F.max(f"_f_{n}").alias(f"_e_{n}") for n in names])
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    carry = ends.select("pid", *[F.max(f"_e_{n}").over(before).alias(f"_c_{n}") for n in names])
    within = Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_l_{n}": F.last(f"_f_{n}", ignorenulls=True).over(within) for n in names}).join(carry, "pid", "left")
    out = {}
    for n in names:
        found = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
        out[n] = F.when(found["g"] == F.col(group), found["v"])
    return df.withColumns(out).drop(*[f"_{x}_{n}" for x in "flc" for n in names])


def rank_in_group(df: DataFrame, group: str, name: str) -> DataFrame:
    """Add the row's number within its group, from 1, in the order of ``ranged``."""
    sizes = df.groupBy(group, "pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition the group touches
    base = sizes.select(F.col(group).alias("_g"), F.col("pid").alias("_pid"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("pid", group).orderBy("seq"))
    df = df.withColumn("_local", local)
    return df.join(base, (df[group] == base["_g"]) & (df["pid"] == base["_pid"])).withColumn(name, F.col("_local") + F.col("_base")).drop("_g", "_pid", "_base", "_local")


def numbered(cuts: Cuts, df: DataFrame, groups: list[str], by: list[str], name: str) -> DataFrame:
    """Add the row's number, from 1, within ``groups`` in the order of ``by``, which must tell all rows of a group apart."""
    keyed = df.withColumn("_g", F.to_json(F.struct(*groups)))
    return rank_in_group(ranged(cuts, keyed, "_g", *by), "_g", name).drop("_g", "pid", "seq")


def running_sum(cuts: Cuts, df: DataFrame, groups: list[str], by: list[str], value: str, name: str, place: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of ``groups`` up to each row in the order of ``by``, and its number from 1.

    As ``numbered``: what stands before a partition's part of a group comes from a table of one row for each part.
    """
    df = ranged(cuts, df.withColumn("_g", F.to_json(F.struct(*groups))), "_g", *by)
    parts = df.groupBy("_g", "pid").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select(F.col("_g").alias("_pg"), F.col("pid").alias("_pp"), zero("_s").alias("_base"), zero("_n").alias("_from"))
    here = Window.partitionBy("pid", "_g").orderBy("seq")
    df = df.withColumns({"_sum": F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, 0)), "_row": F.row_number().over(here)})
    df = df.join(parts, (F.col("_g") == F.col("_pg")) & (F.col("pid") == F.col("_pp")))
    return df.withColumns({name: F.col("_sum") + F.col("_base"), place: F.col("_row") + F.col("_from")}).drop("_g", "pid", "seq", "_pg", "_pp", "_base", "_from", "_sum", "_row")
