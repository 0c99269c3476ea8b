"""Consensus of several annotators' labels, agreement per item, reliability per annotator.

Take one label against the rest. If annotator j says it with a rate t_j where it is true and f_j where it isn't, two
annotators agree on it beyond chance in proportion to (t_j - f_j) * (t_k - f_k). So the leading eigenvector of the label's
chance-centred agreement matrix gives t - f of every annotator, and with the annotator's share of the label both rates.
Agreements and overlaps are counted as Gram matrices of (item, label) and item baskets; each entry is a rate over the items
both labelled, less the product of their shares, shrunk where these items are few; the eigenvectors come from power
iteration by joins of the sparse entries with the vectors, all labels at once. The rates weight the votes by their log
odds; so an annotator who always says one label counts for nothing, and one who inverts labels counts the other way.

Defined results: of repeated votes of an annotator on an item the last counts (of equal times the greatest label); votes
with a null annotator or item or a label outside ``labels`` are ignored; equal scores go to the first label of ``labels``;
without votes the result is empty; a single annotator has skill 0, and votes decide where all skills are 0.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.cooccurrence import pair_counts
from ledgerloom.plans.materialise import Cuts

LABELS = ("A", "B", "tie")
#: What every vote adds to its own label: decides only where all annotators' weights say nothing.
FAITH = 1e-3


def clean_votes(raw: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """judge, item, label of the valid votes in ``raw`` (judge, item, label, at)."""
    name = lambda c: F.lower(F.btrim(F.col(c), F.lit(" \t\n\r\x0b\x0c 　")))
    label = None
    for x in labels:
        label = F.when(name("label") == x.lower(), x) if label is None else label.when(name("label") == x.lower(), x)
    votes = raw.select(name("judge").alias("judge"), "item", label.alias("label"), "at").where("judge is not null and item is not null and label is not null")
    return votes.groupBy("judge", "item").agg(F.max(F.struct("at", "label")).alias("v")).select("judge", "item", F.col("v.label").alias("label"))


def label_shares(votes: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """judge, n_votes, label, share for every judge and every label."""
    counts = votes.groupBy("judge").agg(F.count("*").alias("n_votes"), *[F.count_if(F.col("label") == z).alias(f"n{k}") for k, z in enumerate(labels)])
    each = F.array(*[F.struct(F.lit(z).alias("label"), (F.col(f"n{k}") / F.col("n_votes")).alias("share")) for k, z in enumerate(labels)])
    return counts.select("judge", "n_votes", F.inline(each))


def agreement_matrices(spark, cuts: Cuts, votes: DataFrame, shares: DataFrame, shrink: float = 20.0) -> DataFrame:
    """label, i, j, x: the chance-centred agreement of two annotators on a label, both ways, shrunk by overlap / (overlap + shrink)."""
    kinds = F.explode(F.array(F.lit(""), F.concat(F.lit("="), F.col("label"))))  # the overlap, and the agreement on a label
    baskets = votes.select(kinds.alias("kind"), F.col("item").cast("string").alias("basket"), F.col("judge").alias("item"))
    counts = cuts.cut(pair_counts(spark, baskets, least=1, repeats=False).select("kind", F.col("item_a").alias("i"), F.col("item_b").alias("j"), F.col("n_ab").alias("n")))
    over = counts.where("kind = ''").select("i", "j", "n")
    agree = counts.where("kind <> ''").select(F.expr("substr(kind, 2)").alias("label"), "i", "j", F.col("n").alias("same"))
    left = shares.select("label", F.col("judge").alias("i"), F.col("share").alias("p"))
    right = shares.select("label", F.col("judge").alias("j"), F.col("share").alias("q"))
    x = (F.coalesce("same", F.lit(0)) / F.col("n") - F.col("p") * F.col("q")) * F.col("n") / (F.col("n") + shrink)
    half = over.join(left, "i").join(right, ["label", "j"]).join(agree, ["label", "i", "j"], "left").select("label", "i", "j", x.alias("x"))
    return cuts.cut(half.unionByName(half.select("label", F.col("j").alias("i"), F.col("i").alias("j"), "x")))


def leading_vectors(cuts: Cuts, matrix: DataFrame, judges: DataFrame, steps: int = 4, rounds: int = 20, tolerance: float = 1e-6) -> tuple[DataFrame, dict, set[str]]:
    """(label, judge, v: for each label the unit eigenvector of the largest eigenvalue; label -> facts of ``_along``; labels whose vector did not settle).

    ``judges`` has label and judge, ``matrix`` label, i, j, x. Power iteration with ``steps`` joins between two cuts. Where
    it ends at a negative eigenvalue, or doesn't settle, it is done again with the norm of the matrix on the diagonal: no
    eigenvalue is below minus the norm, so the largest positive one leads then.
    """
    shift: dict[str, float] = {}
    for _ in range(2):
        m = matrix
        vector, path = cuts.write(judges.select("label", "judge", F.lit(1.0).alias("v")))
        if shift:
            diagonal = judges.select("label", F.col("judge").alias("i"), F.col("judge").alias("j"), _by_label(shift, F.col("label")).alias("x")).where("x is not null")
            m = cuts.cut(matrix.unionByName(diagonal))
        left: set[str] = set()
        for _ in range(rounds):
            new = vector
            for _ in range(steps):
                new = m.alias("m").join(new.alias("n"), (F.col("m.label") == F.col("n.label")) & (F.col("m.j") == F.col("n.judge"))).groupBy("m.label", "m.i").agg(F.sum(F.col("x") * F.col("v")).alias("v")).select("label", F.col("i").alias("judge"), "v")
            new, fresh = cuts.write(new)
            both = vector.withColumnRenamed("v", "old").join(new, ["label", "judge"], "left")
            facts = both.groupBy("label").agg(F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("old") * F.col("old")).alias("oo"), F.sum(F.col("v") * F.col("old")).alias("vo")).collect()
            size = {r["label"]: math.sqrt(r["vv"] or 0.0) or 1.0 for r in facts}
            left = {r["label"] for r in facts if r["vv"] and 2 - 2 * r["vo"] / math.sqrt(r["vv"] * r["oo"]) > tolerance**2}
            cuts.drop(path)
            vector, path = new.withColumn("v", F.col("v") / _by_label(size, F.col("label"))), fresh
            if not left:
                break
        sides = {r["label"]: r for r in _along(matrix, vector).collect()}
        again = left | {z for z, r in sides.items() if (r["xab"] or 0.0) <= 0}
        if shift or not again:
            break
        norms = matrix.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("s")).collect()
        shift = {r["label"]: math.sqrt(r["s"]) for r in norms if r["label"] in again and r["s"]}
        if not shift:
            break
    return vector, sides, left


def _by_label(values: dict[str, float], label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), label) if values else F.lit(None).cast("double")


def _along(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """label, xab (the quotient along the vector), abab (the size of its outer product over the entries that are there)."""
    a = vector.select("label", F.col("judge").alias("i"), F.col("v").alias("a"))
    b = vector.select("label", F.col("judge").alias("j"), F.col("v").alias("b"))
    ab = F.col("a") * F.col("b")
    return matrix.join(a, ["label", "i"]).join(b, ["label", "j"]).groupBy("label").agg(F.sum(F.col("x") * ab).alias("xab"), F.sum(ab * ab).alias("abab"))


def reliability(spark, cuts: Cuts, votes: DataFrame, shares: DataFrame) -> DataFrame:
    """judge, label, n_votes, share, d: the rate of the label where it is true less that where it isn't, within +-0.95."""
    matrix = agreement_matrices(spark, cuts, votes, shares)
    vector, sides, left = leading_vectors(cuts, matrix, shares)
    if left:
        warnings.warn(f"power iteration did not settle for {sorted(left)}", stacklevel=2)
    n = F.col("n_votes").cast("double")
    pool = {r["label"]: (r["p"] or 0.0, r["side"] or 0.0) for r in shares.join(vector, ["label", "judge"], "left").groupBy("label").agg((F.sum(F.col("share") * n) / F.sum(n)).alias("p"), F.sum(F.coalesce("v", F.lit(0.0)) * n).alias("side")).collect()}
    size = {}
    for r in sides.values():
        p, side = pool[r["label"]]
        # Along the vector the matrix is (t - f)(t - f) p (1 - p); most votes count as skilled.
        size[r["label"]] = math.sqrt(max(0.0, (r["xab"] or 0.0) / (r["abab"] or 1.0)) / max(p * (1 - p), 1e-9)) * (1 if side >= 0 else -1)
    d = F.coalesce(F.col("v") * _by_label(size, F.col("label")), F.lit(0.0))
    return cuts.cut(shares.join(vector, ["label", "judge"], "left").select("judge", "label", "n_votes", "share", F.greatest(F.lit(-0.95), F.least(F.lit(0.95), d)).alias("d")))


def decide(spark, raw: DataFrame, items: DataFrame | None = None, labels: tuple[str, ...] = LABELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, choice, certainty, n_votes; the valid votes; judge, skill, n_votes).

    ``items`` (item) limits the votes to known items. skill is the mean of t - f over the labels. The share of each label
    among the items is taken from the annotators' shares, weighted by their skills.
    """
    cuts, k = Cuts(spark, "consensus"), range(len(labels))
    votes = clean_votes(raw, labels)
    if items is not None:
        votes = votes.join(items.select("item").where("item is not null").distinct(), "item", "left_semi")
    votes = cuts.cut(votes.select("judge", "item", "label"))
    rates = reliability(spark, cuts, votes, cuts.cut(label_shares(votes, labels)))
    skill = rates.groupBy("judge").agg(F.avg("d").alias("skill"), F.max("n_votes").alias("n_votes"))
    weight = F.greatest(F.lit(0.0), F.col("skill")) * F.col("n_votes")
    seen = {r["label"]: r["p"] for r in rates.join(skill.select("judge", "skill"), "judge").groupBy("label").agg(((F.sum(weight * F.col("share")) + 1 / len(labels)) / (F.sum(weight) + 1)).alias("p")).collect()}
    prior = {z: min(max(seen.get(z, 1 / len(labels)), 1e-6), 1 - 1e-6) for z in labels}
    f = F.greatest(F.lit(0.005), F.least(F.lit(0.99), F.col("share") - _by_label(prior, F.col("label")) * F.col("d")))
    t = F.greatest(F.lit(0.01), F.least(F.lit(0.995), f + F.col("d")))
    odds = rates.select("judge", "label", F.log(t / f).alias("yes"), F.log((1 - t) / (1 - f)).alias("no"))
    of = lambda z, c: F.max(F.when(F.col("label") == labels[z], F.col(c)))
    odds = odds.groupBy("judge").agg(*[of(z, c).alias(f"{c}{z}") for z in k for c in ("yes", "no")])
    score = [F.sum(F.when(F.col("label") == labels[z], F.col(f"yes{z}") + FAITH).otherwise(F.col(f"no{z}"))) + math.log(prior[labels[z]] / (1 - prior[labels[z]])) for z in k]
    sums = votes.join(odds, "judge").groupBy("item").agg(*[s.alias(f"s{z}") for z, s in enumerate(score)], F.count("*").alias("n_votes"))
    top = F.greatest(*[F.col(f"s{z}") for z in k])
    best = F.array_max(F.array(*[F.struct(F.col(f"s{z}").alias("s"), F.lit(-z).alias("z"), F.lit(labels[z]).alias("label")) for z in k]))
    return sums.select("item", best["label"].alias("choice"), (1 / sum((F.exp(F.col(f"s{z}") - top) for z in k), F.lit(0.0))).alias("certainty"), "n_votes"), votes, skill


def consensus(spark, raw: DataFrame, items: DataFrame | None = None, labels: tuple[str, ...] = LABELS) -> tuple[DataFrame, DataFrame]:
    """(per item: item, label, certainty, agreement, n_votes; per judge: judge, skill, accuracy, n_votes).

    As ``decide``; agreement is the share of an item's votes for the consensus label, accuracy the mean certainty of the
    judge's votes that are the consensus label.
    """
    decided, votes, skill = decide(spark, raw, items, labels)
    decided = Cuts(spark, "decided").cut(decided)
    right = (F.col("label") == F.col("choice")).cast("int")
    joined = votes.join(decided.select("item", "choice", "certainty"), "item")
    shared = joined.groupBy("item").agg(F.avg(right).alias("agreement"))
    judges = joined.groupBy("judge").agg(F.avg(right * F.col("certainty")).alias("accuracy")).join(skill, "judge")
    per_item = decided.join(shared, "item").select("item", F.col("choice").alias("label"), "certainty", "agreement", "n_votes")
    return per_item, judges.select("judge", "skill", "accuracy", "n_votes")
