"""Evaluation statistics and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coherence(incidence: DataFrame, sets: DataFrame) -> DataFrame:
    """grp, n_members, n_pairs, coherence: the mean set-F1 over all pairs of members of a group, without making pairs.

    The sum of 2 * |a n b| / (|a| + |b|) over pairs is, element by element, the sum over pairs that share the element of
    2 / (|a| + |b|), which only needs how many members of each size have it. So the work is linear in the incidences and
    quadratic in the distinct set sizes only. ``incidence`` has grp and member, ``sets`` member and items; repeats don't
    count; members without row in ``sets`` are left out, those with empty sets are similar to none; groups of one have
    null coherence.
    """
    one = sets.where("member is not null").groupBy("member").agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("items", F.array().cast("array<string>"))))).alias("items"))
    pairs = incidence.where("grp is not null and member is not null").select("grp", "member").distinct().join(one, "member")
    pairs = pairs.withColumn("size", F.size("items").cast("bigint"))
    total = pairs.groupBy("grp").agg(F.count("*").alias("n_members"))
    have = pairs.select("grp", "size", F.explode("items").alias("item")).groupBy("grp", "item", "size").agg(F.count("*").alias("n"))
    per = have.groupBy("grp", "item").agg(F.collect_list(F.struct("size", "n")).alias("h"))  # as many as there are sizes
    same = F.aggregate("h", F.lit(0.0), lambda s, x: s + x["n"] * (x["n"] - 1) / 2.0 / x["size"])
    mixed = F.aggregate("h", F.lit(0.0), lambda s, x: s + F.aggregate("h", F.lit(0.0), lambda t, y: t + F.when(x["size"] < y["size"], x["n"] * y["n"] * 2.0 / (x["size"] + y["size"])).otherwise(0.0)))
    sums = per.groupBy("grp").agg(F.sum(same + mixed).alias("f1"))
    n_pairs = F.floor(F.col("n_members") * (F.col("n_members") - 1) / 2).cast("bigint")
    out = total.join(sums, "grp", "left").withColumn("n_pairs", n_pairs)
    return out.select("grp", "n_members", "n_pairs", F.try_divide(F.coalesce("f1", F.lit(0.0)), F.col("n_pairs")).alias("coherence"))


def kappa(pairs: DataFrame, categories: list) -> DataFrame:
    """n, agreement, expected, kappa of two raters' labels (x, y) over fixed categories; pairs with a null don't count.

    Where chance alone gives full agreement kappa is 1 if they agree always, else null.
    """
    p = pairs.where("x is not null and y is not null")
    n = F.count("*").cast("double")
    cols = [F.count("*").alias("n"), (F.sum((F.col("x") == F.col("y")).cast("int")) / n).alias("agreement")]
    expected = sum(((F.sum((F.col("x") == c).cast("int")) / n) * (F.sum((F.col("y") == c).cast("int")) / n) for c in categories), F.lit(0.0))
    out = p.agg(*cols, expected.alias("expected"))
    k = F.when(F.abs(1 - F.col("expected")) < 1e-12, F.when(F.col("agreement") > 1 - 1e-12, 1.0)).otherwise(F.try_divide(F.col("agreement") - F.col("expected"), 1 - F.col("expected")))
    return out.withColumn("kappa", k)


def sign_flip(spark, values: DataFrame, most: int = 20) -> DataFrame:
    """n, mean, p: exact one-sided sign-flip test of the column ``value``, over all 2**n sign masks (n <= ``most``)."""
    rows = values.where("value is not null").orderBy("value").limit(most + 1)
    agg = rows.agg(F.sort_array(F.collect_list("value")).alias("v"))
    n = agg.select(F.size("v")).first()[0]
    if n > most:
        raise ValueError(f"more than {most} values: the exact test has too many masks")
    masks = spark.range(1 << n, numPartitions=max(1, min(64, (1 << n) >> 12)))
    bit = lambda i: F.call_function("shiftright", F.col("id"), i.cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    flipped = F.aggregate(F.transform("v", lambda x, i: F.when(bit(i) == 1, x).otherwise(-x)), F.lit(0.0), lambda s, x: s + x)
    seen = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    hits = masks.join(F.broadcast(agg)).select((flipped >= seen - 1e-12).cast("int").alias("hit"), (seen / F.greatest(F.size("v"), F.lit(1))).alias("mean"))  # one row of at most 20 values
    return hits.agg(F.lit(n).cast("bigint").alias("n"), F.max("mean").alias("mean"), (F.sum("hit") / F.count("*")).alias("p"))


def null_summary(nulls: DataFrame, observed: Column) -> DataFrame:
    """observed, null_mean, difference, q025, q975, z, p of a null table (value, obs); z is infinite without spread.

    ``observed`` is an aggregate over the null table that gives the observed value, which stands in each row as obs.
    """
    a = nulls.agg(observed.alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("sd"), F.percentile("value", F.lit(0.025)).alias("q025"), F.percentile("value", F.lit(0.975)).alias("q975"), ((1.0 + F.sum((F.col("value") >= F.col("obs")).cast("int"))) / (F.count("*") + 1)).alias("p"))
    z = F.coalesce(F.try_divide(F.col("observed") - F.col("null_mean"), F.col("sd")), F.when(F.col("observed") > F.col("null_mean"), float("inf")).when(F.col("observed") < F.col("null_mean"), float("-inf")).otherwise(0.0))
    return a.select("observed", "null_mean", (F.col("observed") - F.col("null_mean")).alias("difference"), "q025", "q975", z.alias("z"), "p")


def runs(df: DataFrame, group: str, order: list[str], value: str, reset: Column | None = None) -> DataFrame:
    """group, run, value, n, first, last: runs of equal values in order; a row that meets ``reset`` begins a new run."""
    w = Window.partitionBy(group).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    if reset is not None:
        new = new | reset
    marked = df.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run").agg(F.first(value).alias("value"), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
