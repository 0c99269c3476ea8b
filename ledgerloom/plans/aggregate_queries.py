"""Registered aggregation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import stable_rank
from ledgerloom.operators import aggregates as a
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import load

B = "bigint"


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS n_discounted, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_returnflag")
def agg_conditional(spark, d):
    """Count, conditional count, distinct count (A1, A2)."""
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.count_distinct("l_partkey").alias("n_parts"))


@query("SELECT work_id, list_sort(list(DISTINCT trim(hub_id))) AS hubs FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND work_id IS NOT NULL GROUP BY work_id HAVING count(DISTINCT trim(hub_id)) >= 5")
def agg_group_sets(spark, d):
    """Sorted set for each group, kept from a least size on (A3)."""
    rows = load(spark, d, "hub_paper_incidence", "hub_id", "work_id").where("hub_id is not null and work_id is not null")
    return rows.groupBy("work_id").agg(F.sort_array(F.collect_set(F.trim("hub_id"))).alias("hubs")).where(F.size("hubs") >= 5)


COHERENCE = """WITH s AS (SELECT work_id AS member, list_distinct(flatten(list(coalesce({field}, [])))) AS items FROM physh_gold_matched WHERE work_id IS NOT NULL GROUP BY work_id),
 i AS (SELECT DISTINCT trim(hub_id) AS grp, work_id AS member FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND work_id IS NOT NULL),
 m AS (SELECT grp, member, items FROM i JOIN s USING (member)),
 p AS (SELECT x.grp, CASE WHEN len(x.items) + len(y.items) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(x.items, y.items)) / (len(x.items) + len(y.items)) END AS f1 FROM m x JOIN m y ON x.grp = y.grp AND x.member < y.member),
 c AS (SELECT grp, count(*) AS n_members FROM m GROUP BY grp), q AS (SELECT grp, count(*) AS n_pairs, avg(f1) AS coherence FROM p GROUP BY grp)
 SELECT grp, n_members, coalesce(n_pairs, 0) AS n_pairs, round(coherence, 9) AS coherence FROM c LEFT JOIN q USING (grp)"""


def _coherence(spark, d, field):
    clean = F.filter(field, lambda x: x.isNotNull())
    sets = load(spark, d, "physh_gold_matched", "work_id", field).select(F.col("work_id").alias("member"), clean.alias("items"))
    inc = load(spark, d, "hub_paper_incidence", "hub_id", "work_id").select(F.trim("hub_id").alias("grp"), F.col("work_id").alias("member"))
    return a.coherence(inc, sets).withColumn("coherence", F.round("coherence", 9))


@query(COHERENCE.format(field="list_filter(disciplines, lambda x: x IS NOT NULL)"))
def agg_hub_coherence_disciplines(spark, d):
    """Mean set-F1 of disciplines over the pairs of papers of each hub."""
    return _coherence(spark, d, "disciplines")


@query(COHERENCE.format(field="list_filter(concepts, lambda x: x IS NOT NULL)"))
def agg_hub_coherence_concepts(spark, d):
    """Mean set-F1 of concepts over the pairs of papers of each hub."""
    return _coherence(spark, d, "concepts")


@query("SELECT macro.lang, round(avg(m), 6) AS macro_mean, count(*) AS n_groups FROM (SELECT lang, source, avg(n_chars) AS m FROM documents WHERE n_chars IS NOT NULL GROUP BY lang, source HAVING count(*) > 1) macro GROUP BY macro.lang")
def agg_macro_mean(spark, d):
    """Mean of group means, groups of one dropped (A4)."""
    g = load(spark, d, "documents", "lang", "source", "n_chars").where("n_chars is not null").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"), F.count("*").alias("n")).where("n > 1")
    return g.groupBy("lang").agg(F.round(F.avg("m"), 6).alias("macro_mean"), F.count("*").alias("n_groups"))


@query("WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem) SELECT l_returnflag, l_linestatus, round((avg(l_extendedprice) - any_value(m)) / any_value(sd), 6) AS z FROM lineitem, s GROUP BY l_returnflag, l_linestatus")
def agg_population_z(spark, d):
    """Standardised group means with the population deviation (A5)."""
    li = load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    sums = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").alias("s"), F.sum(F.pow("l_extendedprice", F.lit(2))).alias("q"), F.count("*").alias("n"))
    every = Window.partitionBy()  # a row for each pair of flags
    n, m = F.sum("n").over(every), F.sum("s").over(every) / F.sum("n").over(every)
    sd = F.sqrt(F.sum("q").over(every) / n - m * m)
    return sums.select("l_returnflag", "l_linestatus", F.round(F.try_divide(F.col("s") / F.col("n") - m, sd), 6).alias("z"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.025), 6) AS p025 FROM events GROUP BY event_type")
def agg_quantiles(spark, d):
    """Linear-interpolated quantiles."""
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return load(spark, d, "events", "event_type", "value").groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.025).alias("p025"))


@query("WITH dom AS (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS event_type) SELECT dom.event_type, count(e.event_id) AS n FROM dom LEFT JOIN events e ON dom.event_type = e.event_type GROUP BY dom.event_type")
def agg_zero_filled(spark, d):
    """Counts over a fixed domain, zero where a category is absent."""
    dom = spark.createDataFrame([("click",), ("view",), ("purchase",), ("refund",)], "event_type string")
    n = load(spark, d, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return dom.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).cast(B).alias("n"))


VOTES_SQL = """v AS (SELECT lower(trim(judge_id, ' \t\n')) AS judge, m.trial_id AS trial, lower(trim(m.choice, ' \t\n')) AS choice, submitted_at AS t
  FROM (SELECT judge_id, submitted_at, unnest(response.membership) AS m FROM judge_output WHERE judge_id IS NOT NULL) u WHERE m.choice IS NOT NULL),
 l AS (SELECT judge, trial, max_by(choice, (t, choice)) AS choice FROM v WHERE choice IN ('a', 'b', 'tie') GROUP BY judge, trial)"""


def _membership_votes(spark, d):
    tidy = lambda c: F.lower(F.btrim(c, F.lit(" \t\n")))
    v = load(spark, d, "judge_output", "judge_id", "response", "submitted_at").where("judge_id is not null").select(tidy(F.col("judge_id")).alias("judge"), F.explode("response.membership").alias("m"), F.col("submitted_at").alias("t"))
    v = v.select("judge", F.col("m.trial_id").alias("trial"), tidy(F.col("m.choice")).alias("choice"), "t").where(F.col("choice").isin("a", "b", "tie"))
    return v.groupBy("judge", "trial").agg(F.max_by("choice", F.struct("t", "choice")).alias("choice"))


@query(
    f"""WITH {VOTES_SQL} SELECT judge, count(*) AS n, round(avg(CASE WHEN choice = lower(true_position) THEN 1.0 WHEN choice = 'tie' THEN 0.5 ELSE 0.0 END), 6) AS score,
 round(avg(CASE WHEN choice = lower(true_position) THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN choice = lower(true_position) OR choice = 'tie' THEN 1.0 ELSE 0.0 END), 6) AS tie_aware,
 round(abs(avg(CASE WHEN choice = 'a' THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN choice = 'b' THEN 1.0 ELSE 0.0 END)), 6) AS position_bias,
 abs(avg(CASE WHEN choice = 'a' THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN choice = 'b' THEN 1.0 ELSE 0.0 END)) <= 0.15 AS unbiased
 FROM l JOIN trial_key k ON l.trial = k.trial_id WHERE true_position IS NOT NULL GROUP BY judge"""
)
def agg_judge_scores(spark, d):
    """Judges against the open keys: score, exact and tie-aware agreement, position bias and its gate."""
    k = load(spark, d, "trial_key", F.col("trial_id").alias("trial"), "true_position").where("true_position is not null")
    v = _membership_votes(spark, d).join(k, "trial")
    hit, tie = F.col("choice") == F.lower("true_position"), F.col("choice") == "tie"
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    bias = F.abs(rate(F.col("choice") == "a") - rate(F.col("choice") == "b"))
    return v.groupBy("judge").agg(F.count("*").alias("n"), F.round(F.avg(F.when(hit, 1.0).when(tie, 0.5).otherwise(0.0)), 6).alias("score"), F.round(rate(hit), 6).alias("exact"), F.round(rate(hit | tie), 6).alias("tie_aware"), F.round(bias, 6).alias("position_bias"), (bias <= 0.15).alias("unbiased"))


@query(
    f"""WITH {VOTES_SQL}, p AS (SELECT choice AS x, lower(true_position) AS y FROM l JOIN trial_key ON trial = trial_id WHERE true_position IS NOT NULL),
 s AS (SELECT count(*) AS n, avg((x = y)::INT::DOUBLE) AS agreement, avg((x = 'a')::INT::DOUBLE) * avg((y = 'a')::INT::DOUBLE) + avg((x = 'b')::INT::DOUBLE) * avg((y = 'b')::INT::DOUBLE) + avg((x = 'tie')::INT::DOUBLE) * avg((y = 'tie')::INT::DOUBLE) AS expected FROM p)
 SELECT n, round(agreement, 6) AS agreement, round(expected, 6) AS expected, round((agreement - expected) / (1 - expected), 6) AS kappa FROM s"""
)
def agg_kappa(spark, d):
    """Cohen's kappa of the votes and the open keys, over three fixed categories."""
    k = load(spark, d, "trial_key", F.col("trial_id").alias("trial"), F.lower("true_position").alias("y")).where("y is not null")
    out = a.kappa(_membership_votes(spark, d).select("trial", F.col("choice").alias("x")).join(k, "trial"), ["a", "b", "tie"])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")])


@query(
    """WITH m AS (SELECT o_orderpriority || o_orderstatus AS k, avg(o_totalprice) AS v FROM orders GROUP BY ALL), c AS (SELECT list(v - a ORDER BY v) AS v FROM (SELECT v, (SELECT avg(o_totalprice) FROM orders) AS a FROM m) z),
 o AS (SELECT list_sum(v) AS obs, len(v) AS n, v FROM c), f AS (SELECT list_sum(list_transform(range(n), lambda i: CASE WHEN (id >> i::INT) & 1 = 1 THEN v[i + 1] ELSE -v[i + 1] END)) >= obs - 1e-9 AS hit, obs, n FROM o, range(32768) r(id))
 SELECT max(n)::BIGINT AS n, round(max(obs) / max(n), 6) AS mean, round(avg(hit::INT::DOUBLE), 6) AS p FROM f"""
)
def agg_sign_flip(spark, d):
    """Exact sign-flip test over all sign masks, of the fifteen order groups' deviations."""
    o = load(spark, d, "orders", "o_orderpriority", "o_orderstatus", "o_totalprice")
    m = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    m = m.join(F.broadcast(o.agg(F.avg("o_totalprice").alias("a")))).select((F.col("v") - F.col("a")).alias("value"))  # one row
    return a.sign_flip(spark, m).select("n", F.round("mean", 6).alias("mean"), F.round("p", 6).alias("p"))


TRAJ = "SELECT step, reuse_n, create_n, reuse_n + create_n AS made, reuse_fraction_r AS r, old_node_membership_churn_c AS c, eligible_canonical_nodes AS e, multi_source_nodes AS m, is_sensitivity_entry AS s FROM trajectory"


@query(
    f"""WITH t AS ({TRAJ}), n AS (SELECT count(*) AS n FROM t) SELECT CASE WHEN step * 3 <= n THEN 'early' WHEN step * 3 <= 2 * n THEN 'middle' ELSE 'late' END AS period, sum(reuse_n)::BIGINT AS reuse, sum(made)::BIGINT AS made,
 round(sum(reuse_n) / sum(made)::DOUBLE, 9) AS pooled, round(avg(r), 9) AS mean_r, round(avg(c), 9) AS mean_c, round(regr_slope(r, step), 9) AS slope FROM t, n GROUP BY 1"""
)
def agg_trajectory_periods(spark, d):
    """Pooled reuse, mean churn and slope by period of the trajectory."""
    t = load(spark, d, "trajectory")
    n = t.agg(F.count("*").alias("n"))
    t = t.join(F.broadcast(n))  # one row
    period = F.when(F.col("step") * 3 <= F.col("n"), "early").when(F.col("step") * 3 <= 2 * F.col("n"), "middle").otherwise("late")
    made = F.col("reuse_n") + F.col("create_n")
    return t.groupBy(period.alias("period")).agg(
        F.sum("reuse_n").alias("reuse"), F.sum(made).alias("made"), F.round(F.try_divide(F.sum("reuse_n"), F.sum(made)), 9).alias("pooled"),
        F.round(F.avg("reuse_fraction_r"), 9).alias("mean_r"), F.round(F.avg("old_node_membership_churn_c"), 9).alias("mean_c"), F.round(F.regr_slope("reuse_fraction_r", F.col("step").cast("double")), 9).alias("slope"),
    )


@query("WITH s AS (SELECT l_suppkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round((sum(q) OVER () - q) / (sum(n) OVER () - n), 6) AS mean_without FROM s")
def agg_leave_one_out(spark, d):
    """The overall mean without each supplier."""
    s = load(spark, d, "lineitem", "l_suppkey", "l_quantity").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    t = s.agg(F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    return s.join(F.broadcast(t)).select("l_suppkey", F.round(F.try_divide(F.col("tq") - F.col("q"), F.col("tn") - F.col("n")), 6).alias("mean_without"))  # one row


@query("WITH n AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY l_partkey) SELECT count(*) AS nodes, count(*) FILTER (k >= 2) AS multi, round(count(*) FILTER (k >= 2) / count(*)::DOUBLE, 9) AS share FROM n")
def agg_consolidation(spark, d):
    """Share of nodes with two sources or more."""
    n = load(spark, d, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("k"))
    return n.agg(F.count("*").alias("nodes"), F.count_if(F.col("k") >= 2).alias("multi"), F.round(F.try_divide(F.count_if(F.col("k") >= 2), F.count("*")), 9).alias("share"))


@query(
    """WITH m AS (SELECT user_id, date_part('day', ts)::INT AS day, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY ALL)
 SELECT b.day AS day, count(*) AS n_old, count(*) FILTER (a.kinds <> b.kinds) AS n_changed, round(count(*) FILTER (a.kinds <> b.kinds) / count(*)::DOUBLE, 9) AS churn FROM m a JOIN m b ON a.user_id = b.user_id AND b.day = a.day + 1 GROUP BY b.day"""
)
def agg_churn(spark, d):
    """Share of members whose set changed from one step to the next."""
    m = load(spark, d, "events", "user_id", "ts", "event_type").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    old = m.select("user_id", (F.col("day") + 1).alias("day"), F.col("kinds").alias("old"))
    changed = F.count_if(F.col("old") != F.col("kinds"))
    return m.join(old, ["user_id", "day"]).groupBy("day").agg(F.count("*").alias("n_old"), changed.alias("n_changed"), F.round(F.try_divide(changed, F.count("*")), 9).alias("churn"))


@query("SELECT p_name AS alias, count(DISTINCT p_brand) AS n_nodes FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def agg_alias_collisions(spark, d):
    """Aliases that stand for more than one node."""
    return load(spark, d, "part", "p_name", "p_brand").groupBy(F.col("p_name").alias("alias")).agg(F.count_distinct("p_brand").alias("n_nodes")).where("n_nodes > 1")


@query(
    """WITH w AS (SELECT trim(hub_id) AS hub, work_id, min(recorded_at) AS t FROM hub_paper_incidence WHERE hub_id IS NOT NULL AND work_id IS NOT NULL GROUP BY ALL), b AS (SELECT hub, min(t) AS born FROM w GROUP BY hub)
 SELECT hub, count(*) FILTER (t <= born + INTERVAL 30 DAY) AS at_birth, count(*) AS final FROM w JOIN b USING (hub) GROUP BY hub"""
)
def agg_birth_final(spark, d):
    """Supporting works of a hub in its first month and at the end."""
    w = load(spark, d, "hub_paper_incidence", "hub_id", "work_id", "recorded_at").where("hub_id is not null and work_id is not null").groupBy(F.trim("hub_id").alias("hub"), "work_id").agg(F.min("recorded_at").alias("t"))
    b = w.groupBy("hub").agg(F.min("t").alias("born"))
    return w.join(b, "hub").groupBy("hub").agg(F.count_if(F.col("t") <= F.col("born") + F.expr("INTERVAL 30 DAYS")).alias("at_birth"), F.count("*").alias("final"))


@query(
    """WITH s AS (SELECT user_id, avg((event_type = 'purchase')::INT::DOUBLE) AS a, avg((event_type = 'view')::INT::DOUBLE) AS b, avg((event_type = 'click')::INT::DOUBLE) AS c, avg((event_type <> 'error')::INT::DOUBLE) AS e FROM events GROUP BY user_id),
 x AS (SELECT user_id, 0.35 * a + 0.45 * b + 0.10 * c + 0.10 * e AS score, a, e FROM s) SELECT round(avg(score), 6) AS mean, round(max(score), 6) AS best, bool_and(e >= 0.5) AS all_steady, count(*) FILTER (score >= 0.3) AS n_passed FROM x"""
)
def agg_weighted_exam(spark, d):
    """Weighted score of each user, rolled up with gates."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    t = F.col("event_type")
    s = load(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg((0.35 * rate(t == "purchase") + 0.45 * rate(t == "view") + 0.10 * rate(t == "click") + 0.10 * rate(t != "error")).alias("score"), rate(t != "error").alias("e"))
    return s.agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("best"), F.bool_and(F.col("e") >= 0.5).alias("all_steady"), F.count_if(F.col("score") >= 0.3).alias("n_passed"))


@query(
    """WITH p AS (SELECT o_orderpriority AS c, o_orderstatus AS kind, avg(o_totalprice) AS v FROM orders GROUP BY ALL), w AS (SELECT c, max(v) FILTER (kind = 'F') AS base, max(v) FILTER (kind = 'O') AS now_, count(*) FILTER (kind = 'F') AS nf, count(*) FILTER (kind = 'O') AS no FROM p GROUP BY c)
 SELECT c AS case_id, round(now_ / base, 6) AS ratio, now_ / base <= 0.7 AS within_budget FROM w WHERE nf = 1 AND no = 1"""
)
def agg_baseline_ratio(spark, d):
    """Ratio to baseline for each case that has exactly one of both."""
    p = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("case_id"), "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    pick = lambda k: F.max(F.when(F.col("o_orderstatus") == k, F.col("v")))
    n = lambda k: F.count_if(F.col("o_orderstatus") == k)
    w = p.groupBy("case_id").agg(pick("F").alias("base"), pick("O").alias("now"), n("F").alias("nf"), n("O").alias("no")).where("nf = 1 and no = 1")
    ratio = F.try_divide("now", "base")
    return w.select("case_id", F.round(ratio, 6).alias("ratio"), (ratio <= 0.7).alias("within_budget"))


@query(
    """WITH k AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, count(DISTINCT value) AS kinds, min(value) AS v, count(*) AS n FROM events GROUP BY ALL)
 SELECT user_id, count(*) AS n_entries, count(*) FILTER (kinds > 1) AS n_conflicts, round(sum(v), 6) AS cost FROM k GROUP BY user_id"""
)
def agg_ledger_cost(spark, d):
    """Ledger rows deduplicated by key, conflicts flagged, costs summed."""
    k = load(spark, d, "events").groupBy("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count_distinct("value").alias("kinds"), F.min("value").alias("v"))
    return k.groupBy("user_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("kinds") > 1).alias("n_conflicts"), F.round(F.sum("v"), 6).alias("cost"))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS n_children, count(c_custkey) AS n_items FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def agg_child_rollup(spark, d):
    """Children and their items, names and counts only."""
    r, n = load(spark, d, "region"), load(spark, d, "nation")
    c = load(spark, d, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    j = r.join(n, r.r_regionkey == n.n_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left")
    return j.groupBy("r_name").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_items"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS q, grouping(l_returnflag)::BIGINT * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def agg_grouping_sets(spark, d):
    """Grouping sets in one pass (A29, extension)."""
    li = load(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    a_, b_ = F.col("l_returnflag"), F.col("l_linestatus")
    return li.groupingSets([[a_, b_], [a_], []], a_, b_).agg(F.sum("l_quantity").alias("q"), (F.grouping("l_returnflag").cast(B) * 2 + F.grouping("l_linestatus")).alias("level"))


@query("SELECT label, sum(len(embedding))::BIGINT AS n_parameters, count(*) AS n FROM embeddings GROUP BY label")
def agg_parameter_count(spark, d):
    """Sum of array sizes."""
    return load(spark, d, "embeddings", "label", "embedding").groupBy("label").agg(F.sum(F.size("embedding")).alias("n_parameters"), F.count("*").alias("n"))


NULL_SQL = """SELECT b, avg(v) AS value FROM (SELECT b, v, row_number() OVER (PARTITION BY b ORDER BY sha256(b || '|' || hub)) AS r
 FROM (SELECT trim(hub_id) AS hub, avg(supporting_member_node_count) AS v FROM hub_paper_incidence WHERE hub_id IS NOT NULL GROUP BY 1) h, range(200) t(b)) q WHERE r <= 20 GROUP BY b"""


@query(
    f"""WITH n AS ({NULL_SQL}), o AS (SELECT avg(supporting_member_node_count) AS obs FROM hub_paper_incidence) SELECT round(any_value(obs), 6)::DOUBLE AS observed, round(avg(value), 6) AS null_mean, round(any_value(obs) - avg(value), 6) AS difference, round(quantile_cont(value, 0.025), 6) AS q025,
 round(quantile_cont(value, 0.975), 6) AS q975, round((any_value(obs) - avg(value)) / stddev_pop(value), 6) AS z, round((1.0 + count(*) FILTER (value >= obs)) / (count(*) + 1), 6) AS p FROM n, o"""
)
def agg_null_summary(spark, d):
    """Mean, quantiles, z and one-sided p against hash-ordered draws of twenty hubs (X2; stat_permutation has the whole null)."""
    inc = load(spark, d, "hub_paper_incidence", "hub_id", "supporting_member_node_count")
    hubs = inc.where("hub_id is not null").groupBy(F.trim("hub_id").alias("hub")).agg(F.avg("supporting_member_node_count").alias("v"))
    draws = hubs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(199))))
    place = F.row_number().over(Window.partitionBy("b").orderBy(stable_rank(F.col("b"), F.col("hub"))))  # one row for each hub
    nulls = draws.withColumn("place", place).where("place <= 20").groupBy("b").agg(F.avg("v").alias("value"))
    seen = inc.agg(F.avg("supporting_member_node_count").alias("obs"))
    out = a.null_summary(nulls.join(F.broadcast(seen)), F.max("obs"))  # one row
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
