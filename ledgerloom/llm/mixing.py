"""Mixing sources to target weights, in tokens.

The mix is divided into blocks of equal tokens. Blocks go to sources by Sainte-Lague (the next block to the highest
weight / (2 * blocks so far + 1)), then in the same way to the shards of a source; so each shard has a whole number of
blocks to give. Within a shard documents stand in a seeded order, which is cut into blocks; the shard gives its first
blocks, after whole passes over all documents where it has to repeat. A block is never more than a thousandth of a shard,
and a shard holds 1,024 documents of mean size at least, so neither rounding is felt at any size of the corpus.

Defined results: only sources with a target and tokens take part; the target of a source without tokens goes to the others
in proportion, and it is reported with a share of 0. Null, empty and blank-source documents give nothing. Without
``total_tokens`` the mix is the largest in which every source reaches its share within its repeats; with more, sources at
their cap stay there and the others share the rest. No document is used more than max_repeats times. Targets given
twice are added up (the smaller cap counts).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.materialise import Cuts


def apportion(parties: DataFrame, group: str, party: str) -> DataFrame:
    """Add ``blocks`` to parties (group, party, weight, cap, seats): the seats of the group by Sainte-Lague, at most ``cap`` each.

    A party has min(cap, round(level * weight)) seats for some level of its group. Over n parties rounding moves the sum
    by n / 2 at most, so the level lies between those at which unrounded parts, cut at the caps, sum to seats - n / 2 and
    seats + n / 2. Both are exact from sums in the order of cap / weight. Only quotients between the two levels compete,
    2 n of them at most, whatever the number of seats. Equal quotients go to the smaller party. Where all caps together
    are less than the seats, all parties get their cap.
    """
    all_ = Window.partitionBy(group)
    order = all_.orderBy("ratio", party)
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    p = parties.where("weight > 0 and cap > 0").withColumn("ratio", F.col("cap") / F.col("weight"))
    p = p.withColumns({
        "n": F.count("*").over(all_),
        "cap_before": F.coalesce(F.sum("cap").over(up), F.lit(0)),
        "weight_left": F.sum("weight").over(all_.orderBy(F.desc("ratio"), F.desc(party)).rowsBetween(Window.unboundedPreceding, 0)),
    })
    for name, side in (("low", -0.5), ("high", 0.5)):
        level = (F.col("seats") + side * F.col("n") - F.col("cap_before")) / F.col("weight_left")
        # Of the first party that isn't at its cap there; null where all are.
        p = p.withColumn(name, F.min(F.when(F.col("ratio") > level, F.struct("ratio", F.col(party), level.alias("level")))).over(all_)["level"])
    part = lambda level, slack: F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.greatest(level, F.lit(0.0)) * F.col("weight") * slack + 0.5))).cast("bigint")
    p = p.withColumns({"base": part(F.col("low"), 1 - 1e-9), "top": part(F.col("high"), 1 + 1e-9)})
    p = p.withColumn("rest", F.col("seats") - F.sum("base").over(all_))
    tries = p.where("top > base").select(group, party, "weight", "rest", F.explode(F.sequence(F.col("base"), F.col("top") - 1)).alias("k"))
    place = F.row_number().over(all_.orderBy((F.col("weight") / (2 * F.col("k") + 1)).desc(), party))
    won = tries.withColumn("place", place).where("place <= rest")
    extra = won.groupBy(F.col(group).alias("_g"), F.col(party).alias("_p")).agg(F.count("*").alias("extra"))
    p = p.join(extra, (F.col(group) == F.col("_g")) & (F.col(party) == F.col("_p")), "left")
    return p.select(*parties.columns, (F.col("base") + F.coalesce("extra", F.lit(0))).alias("blocks"))


def mix(
    spark, docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, blocks: int = 20_000, shard_tokens: int = 4_000_000, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """(mix: doc_id, source, copies, n_tokens; report per source).

    ``docs`` has doc_id, source, n_tokens; ``targets`` source, target_share, max_repeats. The report has the target, the
    share the source should have among those that have documents, the tokens drawn, and the share reached. ``blocks`` is
    the least number of blocks; more are taken where a block would exceed a thousandth of ``shard_tokens``.
    """
    cuts = Cuts(spark, "mix")
    targets = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    docs = docs.where("n_tokens > 0 and doc_id is not null").select("doc_id", "source", "n_tokens").join(targets.select("source", "max_repeats"), "source")
    docs = cuts.cut(docs)
    supply = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    supply = cuts.cut(supply.join(targets.where("target_share > 0 and max_repeats > 0"), "source"))
    facts = supply.agg(F.sum("target_share"), F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()
    if facts[0] is None:
        none = docs.limit(0)
        return none.select("doc_id", "source", F.lit(0).cast("bigint").alias("copies"), "n_tokens"), targets.select("source", "target_share", F.lit(0.0).alias("wanted_share"), *[F.lit(0).cast("bigint").alias(c) for c in ("tokens_available", "tokens_drawn", "n_docs", "most_copies")], F.lit(0.0).alias("actual_share"))
    total = float(total_tokens) if total_tokens is not None else facts[1] * facts[0]
    seats = max(blocks, math.ceil(total * 1000 / shard_tokens))
    block = total / seats
    one = F.lit("all").alias("whole")
    sources = apportion(
        supply.select(one, "source", (F.col("target_share") / facts[0]).alias("weight"), F.ceil(F.col("tokens") * F.col("max_repeats") / block - 1e-6).cast("bigint").alias("cap"), F.lit(seats).alias("seats")),
        "whole", "source",
    )
    n_shards = F.greatest(F.lit(1), F.floor(F.col("tokens") / F.greatest(F.lit(float(shard_tokens)), 1024 * F.col("tokens") / F.col("n_docs"))))
    sources = cuts.cut(sources.select("source", F.col("blocks").alias("seats")).join(supply.select("source", n_shards.alias("n_shards")), "source"))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_shards")).cast("int")
    placed = docs.join(sources, "source").withColumn("shard", shard)
    masses = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("mass"), F.first("seats").alias("seats"), F.first("max_repeats").alias("max_repeats"))
    quotas = apportion(
        masses.select("source", "shard", F.col("mass").cast("double").alias("weight"), F.ceil(F.col("mass") * F.col("max_repeats") / block - 1e-6).cast("bigint").alias("cap"), "seats", "mass"),
        "source", "shard",
    ).select("source", "shard", "mass", "blocks")
    quotas = cuts.cut(quotas)
    ordered = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    drawn = placed.select("doc_id", "source", "shard", "n_tokens", "max_repeats").join(quotas, ["source", "shard"])
    middle = F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)) + F.col("n_tokens") / 2
    wanted = F.col("blocks") * F.lit(block)
    passes = F.least(F.floor(wanted / F.col("mass") + 1e-9), F.col("max_repeats").cast("bigint"))
    drawn = drawn.withColumns({"middle": middle, "passes": passes, "rest": wanted - passes * F.col("mass")})
    more = ((F.col("passes") < F.col("max_repeats")) & (F.col("middle") < F.col("rest"))).cast("bigint")
    mixed = cuts.cut(drawn.select("doc_id", "source", (F.col("passes") + more).alias("copies"), "n_tokens").where("copies > 0"))
    used = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    whole = used.agg(F.sum("tokens_drawn")).first()[0] or 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = targets.join(supply.select("source", F.col("tokens").alias("tokens_available")), "source", "left").join(used, "source", "left")
    report = report.select(
        "source", "target_share", F.when(F.col("tokens_available") > 0, F.col("target_share") / facts[0]).otherwise(0.0).alias("wanted_share"),
        zero("tokens_available"), zero("tokens_drawn"), zero("n_docs"), zero("most_copies"), (F.coalesce("tokens_drawn", F.lit(0)) / whole).alias("actual_share"),
    )
    return mixed, report
