"""Identity of nodes: gates and bands over similarities, splits, redistribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import cosine
from ledgerloom.operators.vectors import split_in_two, top_k

#: Bounds of the two-view gate and of the three bands.
LABEL, SEMANTIC, COMBINED, MARGIN, FLOOR, AUTO = 0.92, 0.90, 0.91, 0.04, 0.72, 0.85


def _unit(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.try_divide(x, size))


def gate(asked: DataFrame, base: DataFrame) -> DataFrame:
    """query_id, id, label_score, semantic_score, margin, decision for ``asked`` against ``base`` (id, name, v1, v2 each).

    The candidate is the one of the highest mean of both cosines. It is merged if its name is evidence (equal), both scores
    and their mean reach their bounds, and it leads the second by the margin; no score alone merges. Below the floor the
    node is new, all else is ambiguous. The mean of two cosines is the cosine of the joined unit vectors, so the search is
    one; it keeps an asked id apart from the same id of the base. Rows without one of the vectors have no result.
    """
    joined = lambda x: x.where("v1 is not null and v2 is not null").select(F.col("id"), F.concat(_unit(F.col("v1")), _unit(F.col("v2"))).alias("v"))
    far = F.lit(-1).cast("bigint") - F.col("id")  # asked and base may share ids
    found = top_k(joined(base), joined(asked).withColumn("id", far), 2)
    best = found.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("id", "cosine"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("cosine"))).alias("second"))
    best = best.select((F.lit(-1).cast("bigint") - F.col("query_id")).alias("query_id"), F.col("one.id").alias("id"), F.col("one.cosine").alias("c"), (F.col("one.cosine") - F.coalesce("second", F.lit(-1.0))).alias("margin"))
    side = lambda x, p: x.select(F.col("id").alias("query_id" if p == "q" else "id"), *[F.col(c).alias(f"{p}_{c}") for c in ("name", "v1", "v2")])
    rows = best.join(side(asked, "q"), "query_id").join(side(base, "b"), "id")
    rows = rows.withColumns({"label_score": cosine(F.col("q_v1"), F.col("b_v1")), "semantic_score": cosine(F.col("q_v2"), F.col("b_v2"))})
    sure = (F.col("q_name") == F.col("b_name")) & (F.col("label_score") >= LABEL) & (F.col("semantic_score") >= SEMANTIC) & (F.col("c") >= COMBINED) & (F.col("margin") >= MARGIN)
    return rows.select("query_id", "id", "label_score", "semantic_score", "margin", F.when(F.col("c") < FLOOR, "new").when(F.coalesce(sure, F.lit(False)), "merge").otherwise("ambiguous").alias("decision"))


def bands(asked: DataFrame, base: DataFrame, most: int = 50) -> DataFrame:
    """query_id, id, n_sure, band for ``asked`` against ``base`` (id, v): alias, ambiguous, similar or new.

    n_sure counts candidates above the upper bound, up to ``most``; one makes an alias, more an ambiguous case.
    """
    far = F.lit(-1).cast("bigint") - F.col("id")
    found = top_k(base, asked.withColumn("id", far), most)
    r = found.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("id", "cosine"))).alias("one"), F.count_if(F.col("cosine") > AUTO).alias("n_sure"))
    band = F.when(F.col("n_sure") == 1, "alias").when(F.col("n_sure") > 1, "ambiguous").when(F.col("one.cosine") >= FLOOR, "similar").otherwise("new")
    return r.select((F.lit(-1).cast("bigint") - F.col("query_id")).alias("query_id"), F.when(F.col("one.cosine") >= FLOOR, F.col("one.id")).alias("id"), "n_sure", band.alias("band"))


def split_plan(members: DataFrame, key: str, v: str, least: int = 6, shown: int = 5) -> DataFrame:
    """side, size, valid, representatives: a split in two, which counts if its centres differ and both sides have ``least`` members.

    Representatives are the members most like their side's mean, ties by key.
    """
    rows, _, apart = split_in_two(members, key, v)
    placed = rows.join(members, key)
    flat = placed.select("side", F.posexplode(v).alias("pos", "x")).groupBy("side", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = flat.groupBy("side").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))
    scored = placed.join(F.broadcast(centre), "side").select("side", key, cosine(F.col(v), F.col("centre")).alias("c"))  # two rows
    sizes = scored.groupBy("side").agg(F.count("*").alias("size"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("c"), key))
    best = scored.withColumn("place", place).where(F.col("place") <= shown).groupBy("side").agg(F.array_sort(F.collect_list(F.struct("place", key))).alias("r"))
    both = F.min("size").over(Window.partitionBy()) >= least
    return sizes.join(best, "side").select("side", "size", (F.lit(apart) & both & (F.count("*").over(Window.partitionBy()) == 2)).alias("valid"), F.transform("r", lambda x: x[key]).alias("representatives"))


def redistribute(members: DataFrame, group: str, member: str, capacity: int) -> DataFrame:
    """group, member, into: members of groups beyond ``capacity`` that also lie in a group within it; the least loaded takes them."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n"))
    sized = members.join(sizes, group)
    full = sized.where(F.col("n") > capacity).select(group, member)
    room = sized.where(F.col("n") <= capacity).select(member, F.struct(F.col("n"), F.col(group).alias("g")).alias("t"))
    return full.join(room, member).groupBy(group, member).agg(F.min("t").alias("t")).select(group, member, F.col("t.g").alias("into"))
