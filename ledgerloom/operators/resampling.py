"""Permutation nulls over fixed incidences, in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import stable_rank
from ledgerloom.plans.materialise import Cuts
from ledgerloom.plans.ordering import numbered

#: Counts (of a group, by item and set size) that a draw holds at once, as a table or as sorted elements.
CELLS = 200_000

#: The share of all elements that is counted in tables, as those of the most frequent items.
FREQUENT = 0.98


def stratified_permutation(spark, members: DataFrame, incidence: DataFrame, draws: int = 100, seed: int = 11) -> DataFrame:
    """draw, value: macro mean over groups of the mean of ``x``, after permuting x within strata.

    ``members`` has member, stratum, x; ``incidence`` grp and member. Both sides of a stratum are ranked, one by id and one
    by a hash of (seed, draw, id), and joined by rank; so a draw needs no randomness, and draws spread over the cluster, a
    stratum over as many tasks as its rows need. A member without stratum raises an error.
    """
    if members.where("stratum is null").limit(1).count():
        raise ValueError("a member lies in no stratum")
    cuts = Cuts(spark, "strata")
    base = cuts.cut(numbered(cuts, members.select("member", "stratum", "x"), ["stratum"], ["member"], "place"))
    shuffled = base.drop("place").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    shuffled = shuffled.withColumn("_by", stable_rank(F.lit(seed), F.col("draw"), F.col("member")))
    values = numbered(cuts, shuffled, ["draw", "stratum"], ["_by", "member"], "place").select("draw", "stratum", "x", "place")
    permuted = base.select("member", "stratum", "place").join(values, ["stratum", "place"]).select("draw", "member", "x")
    groups = incidence.where("grp is not null and member is not null").distinct().join(permuted, "member").groupBy("draw", "grp").agg(F.avg("x").alias("m"), F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("draw").agg(F.avg("m").alias("value"))


def _macro_coherence(group: np.ndarray, member: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> Callable[[np.ndarray], float]:
    """A function of an assignment (whose set each member has) that gives the mean set-F1 of the groups, macro mean.

    ``group`` is ascending, 0 to the number of groups; the sets' ``sizes`` and ``items`` (numbers) stand one set behind the
    other. As in aggregates.coherence, the sum over pairs comes from the counts of members by (group, item, set size). Of a
    group with many elements the frequent items are counted in a table, whose products by set size give all pairs; all
    else is counted in sorted runs. Tables are taken in blocks, so they don't grow with the number of groups.
    """
    lengths = np.unique(sizes[sizes > 0])
    k = max(1, len(lengths))
    kind = np.where(sizes > 0, np.searchsorted(lengths, sizes), k).astype(np.uint8 if k < 256 else np.int64)
    f1 = 2.0 / (lengths[:, None] + lengths) if len(lengths) else np.zeros((1, 1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.bincount(items, np.bincount(member, minlength=len(sizes))[owner], minlength=1)
    items = np.argsort(np.argsort(-seen, kind="stable"))[items]  # by frequency
    most = len(seen)
    wide = min(most, int(np.searchsorted(np.cumsum(np.sort(seen)[::-1]), FREQUENT * seen.sum())) + 1)
    if most * k <= 4096:
        wide = most
    width, span = wide * k + 1, most * k  # of a table, with a cell for what isn't counted there; of a group's numbers in runs
    first = np.flatnonzero(np.diff(group, prepend=-1))
    n = np.diff(np.append(first, len(group)))
    dense = n * (sizes.mean() if len(sizes) else 0) > width / 8
    order = np.argsort(~dense, kind="stable")
    n, tables, member = n[order], int(dense.sum()), np.concatenate([*[member[first[g] : first[g] + n_] for g, n_ in zip(order, n[order])], member[:0]])
    first = np.append(0, np.cumsum(n))
    number = np.int32 if len(n) * span < 2**31 else np.int64
    cells = np.int32 if max(CELLS, width) + width < 2**31 else np.int64
    base = np.repeat(np.arange(len(n), dtype=number) * number(span), n)
    begin = np.cumsum(sizes) - sizes
    row, counted, run = np.zeros(len(sizes), np.int32), [], []  # sets of one size are columns of one matrix
    for c, size in enumerate(lengths):
        which = np.flatnonzero(kind == c)
        row[which] = np.arange(len(which))
        x = items[begin[which] + np.arange(size)[:, None]]
        counted.append(np.where(x < wide, x + c * wide, width - 1).astype(cells))
        run.append((x * k + c).astype(number))
    rare = items >= wide
    rare_code, rare_n = (items * k + kind[owner])[rare].astype(number), np.bincount(owner[rare], minlength=len(sizes))
    rare_at = np.cumsum(rare_n) - rare_n
    blocks, at = [], 0
    while at < len(n):  # neighbours of one sort, within the bound
        end, room = at, CELLS
        while end < len(n) and (end < tables) == (at < tables) and (end == at or room >= 0):
            room -= width if at < tables else n[end] * max(1, sizes.mean())
            end += 1
        blocks.append((at, end, np.repeat(np.arange(end - at, dtype=cells) * cells(width), n[at:end]) if at < tables else base[first[at] : first[end]]))
        at = end

    def runs(key: np.ndarray) -> np.ndarray:
        key.sort()
        edge = np.flatnonzero(np.diff(key, prepend=number(-1)))
        many, key = np.diff(np.append(edge, len(key))).astype(float), key[edge]
        cell = key // number(k)
        kinds = key - cell * number(k)
        add = many * many * f1[kinds, kinds]
        x = np.arange(len(key))
        for step in range(1, k):  # the other set sizes that have the same item
            x = x[: np.searchsorted(x, len(key) - step)]
            x = x[cell[x] == cell[x + step]]
            if not len(x):
                break
            add[x] += 2 * many[x] * many[x + step] * f1[kinds[x], kinds[x + step]]
        return np.bincount(cell // number(most), add, minlength=len(n))

    def value(has: np.ndarray) -> float:
        if not len(n):
            return float("nan")
        own = has[member]
        of, place = kind[own], row[own]
        total = -np.add.reduceat((of < k).astype(np.int64), first[:-1]).astype(float)  # pairs of a member with itself
        for lo, hi, start in blocks:
            part = slice(first[lo], first[hi])
            kinds, places = of[part], place[part]
            by = np.argsort(kinds, kind="stable")
            ends = np.searchsorted(kinds[by], np.arange(k + 1))
            codes = counted if lo < tables else run
            key, at = np.empty(int(np.dot(np.diff(ends)[: len(lengths)], lengths)), start.dtype), 0
            for c, size in enumerate(lengths):
                x = by[ends[c] : ends[c + 1]]
                part = key[at : at + size * len(x)].reshape(size, len(x))
                np.take(codes[c], places[x], axis=1, out=part, mode="clip")
                part += start[x]
                at += part.size
            if lo < tables:
                have = np.bincount(key, minlength=(hi - lo) * width).reshape(hi - lo, width)[:, :-1].astype(float).reshape(hi - lo, k, wide)
                total[lo:hi] += ((have @ have.swapaxes(1, 2)) * f1).sum((1, 2))
            elif len(key):
                total += runs(key)
        if len(rare_code):
            mine = own[: first[tables]]
            x = np.flatnonzero(rare_n[mine])
            many, mine = rare_n[mine[x]], mine[x]
            if len(x):
                code = rare_code[np.repeat(rare_at[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                total += runs(code + np.repeat(base[x], many))
        return float((total / (n * (n - 1))).mean())

    return value


def coherence_null(spark, profiles: DataFrame, incidence: DataFrame, fields: list[str], draws: int = 10_000, chunk: int | None = None, seed: int = 11) -> DataFrame:
    """draw, field, value: macro mean over groups of the mean set-F1, after permuting whole profiles within strata; draw 0 is the observed one.

    ``profiles`` has a row for each member: member, stratum, and for each of ``fields`` an array of strings without repeats;
    ``incidence`` grp and member. In a draw a member takes all sets of another member of its stratum, the same for every
    field; incidences stay. Members without profile are left out, and groups of one don't count. The draws of a chunk are
    one task, which is sent the profiles and incidences and holds them as whole numbers, so without ``chunk`` there are but two
    chunks for each core; draws differ by (seed, draw), whatever the chunk.
    A member without stratum raises an error.
    """
    if profiles.where("stratum is null").limit(1).count():
        raise ValueError("a member lies in no stratum")
    chunk = chunk or -(-(draws + 1) // (2 * spark.sparkContext.defaultParallelism))
    chunks = -(-(draws + 1) // chunk)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("member"))
    base = profiles.withColumn("place", place)
    spread = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    inc = incidence.where("grp is not null and member is not null").select("grp", "member").distinct().join(base.select("member", "stratum", "place"), "member")
    inc = inc.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("stratum", "place"))).alias("m")).where(F.size("m") > 1)
    inc = inc.select(F.col("grp").cast("string").alias("grp"), F.col("m.stratum").alias("s"), F.col("m.place").alias("p"))
    sets = base.select("stratum", "place", *[F.transform(f, lambda x: F.xxhash64(x)).alias(f) for f in fields])
    parts = sets.unionByName(inc, allowMissingColumns=True).select("*", spread)  # incidences have a group, profiles none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [x for x in batches if len(x)]
        if not both:
            return
        both = pa.Table.from_batches(both)
        column, at = lambda t, c: t[c].combine_chunks(), both["chunk"][0].as_py() * chunk
        linked = pc.is_valid(both["grp"])
        left, right = both.filter(pc.invert(linked)), both.filter(linked).sort_by("grp")
        strata, code = np.unique(column(left, "stratum").to_numpy(zero_copy_only=False), return_inverse=True)
        left = left.take(np.lexsort((column(left, "place").to_numpy(), code)))
        count = np.bincount(code, minlength=len(strata))
        begin = np.cumsum(count) - count
        group = np.repeat(np.arange(len(right)), pc.list_value_length(column(right, "s")).to_numpy().astype(np.int64))
        stands = np.searchsorted(strata, column(right, "s").flatten().to_numpy(zero_copy_only=False))
        member = begin[stands] + column(right, "p").flatten().to_numpy().astype(np.int64) - 1
        ways = []
        for f in fields:
            numbers = np.unique(column(left, f).flatten().to_numpy(), return_inverse=True)[1]
            ways.append((f, _macro_coherence(group, member, pc.list_value_length(column(left, f)).to_numpy().astype(np.int64), numbers)))
        del both, left, right
        out = []
        for draw in range(at, min(draws + 1, at + chunk)):
            has = np.arange(len(code))
            if draw:
                rng = np.random.default_rng([seed, draw])
                for a, c in zip(begin, count):
                    has[a : a + c] = a + rng.permutation(c)
            out += [(draw, f, value(has)) for f, value in ways]
        drawn, names, found = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int32()), pa.array(names, pa.string()), pa.array(found, pa.float64(), from_pandas=True)], ["draw", "field", "value"])

    return parts.repartitionById(chunks, "chunk").mapInArrow(run, "draw int, field string, value double")  # each chunk a partition of its own


def matched_controls(spark, positives: DataFrame, pool: DataFrame, seed: int = 7, reuse: bool = False) -> DataFrame:
    """trial, control, same_domain (and with ``reuse`` reused): one control for each positive, each used once within a stratum.

    ``positives`` has trial, stratum, domain; ``pool`` control, stratum, domain. The sequential rule (best unused by hash,
    same domain first) becomes two rank joins: the k-th positive of a (stratum, domain) takes the k-th control by hash;
    those left over take, in the same way, the controls that are left in the stratum. What is then without control has
    none, or with ``reuse`` takes the controls of its stratum a second time, round and round. Ranks come from a range
    partition, so a stratum may hold any part of the rows.
    """
    cuts = Cuts(spark, "controls")
    hashed = lambda df, c: df.withColumn("_by", stable_rank(F.lit(seed), F.col(c)))
    p = numbered(cuts, hashed(positives.select("trial", "stratum", "domain"), "trial"), ["stratum", "domain"], ["_by", "trial"], "k").drop("_by")
    c = cuts.cut(numbered(cuts, hashed(pool.select("control", F.col("stratum").alias("_s"), F.col("domain").alias("_d")), "control"), ["_s", "_d"], ["_by", "control"], "_k"))
    first = cuts.cut(p.join(c.drop("_by"), (F.col("stratum") == F.col("_s")) & F.col("domain").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left").select("trial", "stratum", "control"))
    rest = numbered(cuts, hashed(first.where("control is null").select("trial", "stratum"), "trial"), ["stratum"], ["_by", "trial"], "k")
    free = c.join(first.where("control is not null").select("control"), "control", "left_anti").select("control", "_s", "_by")
    free = numbered(cuts, free, ["_s"], ["_by", "control"], "_k").drop("_by")
    second = cuts.cut(rest.drop("_by").join(free, (F.col("stratum") == F.col("_s")) & (F.col("k") == F.col("_k")), "left").select("trial", "stratum", "control"))
    row = lambda df, same, again: df.select("trial", "control", same.alias("same_domain"), again.alias("reused"))
    no = F.lit(False)
    out = row(first.where("control is not null"), F.lit(True), no)
    if not reuse:
        return out.unionByName(row(second, F.when(F.col("control").isNotNull(), False), no)).drop("reused")
    left = numbered(cuts, hashed(second.where("control is null").select("trial", "stratum"), "trial"), ["stratum"], ["_by", "trial"], "k").drop("_by")
    every = cuts.cut(numbered(cuts, c.select("control", "_s", "_by"), ["_s"], ["_by", "control"], "_k").drop("_by"))
    sizes = every.groupBy(F.col("_s").alias("stratum")).agg(F.count("*").alias("_n"))
    left = left.join(sizes, "stratum", "left").withColumn("k", (F.col("k") - 1) % F.col("_n") + 1)
    third = left.join(every, (F.col("stratum") == F.col("_s")) & (F.col("k") == F.col("_k")), "left")
    return out.unionByName(row(second.where("control is not null"), no, no)).unionByName(row(third, F.when(F.col("control").isNotNull(), False), F.col("control").isNotNull()))


def trials(spark, incidence: DataFrame, most: int = 6, span: int = 5, seed: int = 20260721, rounds: int = 4) -> DataFrame:
    """trial, hub, option_a, option_b, true_position, same_domain, reused: blinded pairs of a paper of a hub and a control.

    ``incidence`` has hub, paper_id, year. Of each hub at most ``most`` papers are taken, by hash. The control is of the same
    ``span`` of years (null years are one span) and not in the hub; a control that turns out to be in the hub is drawn anew,
    ``rounds`` times, after which the trial has none (null). Which side holds the paper is the parity of a hash; in a
    packet the last three columns are left out.
    """
    cuts = Cuts(spark, "trials")
    i = cuts.cut(incidence.where("hub is not null and paper_id is not null").groupBy("hub", "paper_id").agg(F.min("year").alias("year")))
    stratum = F.coalesce(F.floor(F.col("year") / span).cast("string"), F.lit("none"))
    picked = numbered(cuts, i.withColumn("_by", stable_rank(F.lit(seed), F.lit("positive"), F.col("hub"), F.col("paper_id"))), ["hub"], ["_by", "paper_id"], "place").where(F.col("place") <= most)
    picked = cuts.cut(picked.select(F.concat_ws("#", "hub", F.col("place").cast("string")).alias("trial"), "hub", "paper_id", stratum.alias("stratum"), F.split("hub", "/")[0].alias("domain")))
    pool = cuts.cut(i.groupBy(F.col("paper_id").alias("control")).agg(F.min(stratum).alias("stratum"), F.min(F.split("hub", "/")[0]).alias("domain")))
    has = i.select(F.col("hub").alias("_h"), F.col("paper_id").alias("_c"))
    open_, done = picked, None
    for k in range(rounds):
        got = matched_controls(spark, open_, pool, seed + k, reuse=True).join(picked.select("trial", "hub"), "trial")
        got = cuts.cut(got.join(has, (F.col("hub") == F.col("_h")) & (F.col("control") == F.col("_c")), "left").select("trial", "control", "same_domain", "reused", F.col("_c").isNotNull().alias("inside")))
        kept = got.where("not inside").drop("inside")
        done = kept if done is None else done.unionByName(kept)
        open_ = open_.join(got.where("inside").select("trial"), "trial", "left_semi")
        if got.where("inside").isEmpty():
            break
    out = picked.join(done, "trial", "left")
    a_first = F.conv(F.right(stable_rank(F.lit(seed), F.lit("side"), F.col("hub"), F.col("paper_id")), F.lit(1)), 16, 10).cast("int") % 2 == 0
    side = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    return out.select("trial", "hub", side("paper_id", "control").alias("option_a"), side("control", "paper_id").alias("option_b"), F.when(a_first, "A").otherwise("B").alias("true_position"), "same_domain", "reused")
