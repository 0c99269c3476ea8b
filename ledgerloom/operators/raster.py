"""Pixels in long form (image, x, y, and values): masks, bands of columns, connected regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.graph import components


def colour_distance(colour: list[Column], wanted: list[float]) -> Column:
    """Euclidean distance of a pixel's channels from a colour."""
    return F.sqrt(sum((F.pow(c - F.lit(float(w)), 2) for c, w in zip(colour, wanted, strict=True)), F.lit(0.0)))


def column_bands(pixels: DataFrame, gap: int = 1) -> DataFrame:
    """image, band, first, last, n: runs of columns with pixels, at most ``gap`` apart, numbered from 0."""
    columns = pixels.groupBy("image", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image").orderBy("x")
    new = F.coalesce(F.col("x") - F.lag("x").over(w) > gap, F.lit(True)).cast("int")
    marked = columns.withColumn("new", new).withColumn("band", F.sum("new").over(w) - 1)
    return marked.groupBy("image", "band").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.sum("n").alias("n"))


def regions(spark, pixels: DataFrame) -> DataFrame:
    """image, region (smallest pixel of it), n, first_x, last_x, first_y, last_y: regions of pixels that touch, corners included."""
    name = lambda x, y: F.concat_ws(":", F.col("image").cast("string"), F.lpad(F.col(x).cast("string"), 9, "0"), F.lpad(F.col(y).cast("string"), 9, "0"))
    p = pixels.select("image", "x", "y").distinct()
    # Each pixel looks at itself and half of its neighbours; the others look at it.
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))])
    seen = p.select("image", "x", "y", F.inline(steps)).select("image", name("x", "y").alias("s"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    touching = seen.join(p, ["image", "x", "y"]).select("s", F.lit("touches").alias("p"), name("x", "y").alias("o"))
    c = components(spark, touching)
    part = lambda k: F.split("path", ":")[k]
    rows = c.select(part(0).alias("image"), "component", part(1).cast("int").alias("x"), part(2).cast("int").alias("y"))
    return rows.groupBy("image", F.col("component").alias("region")).agg(F.count("*").alias("n"), F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.min("y").alias("first_y"), F.max("y").alias("last_y"))
