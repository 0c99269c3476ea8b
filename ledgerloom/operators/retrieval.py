"""Retrieval pipelines: channels of ranked candidates, fusion, slots, typed results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as fn
from ledgerloom.operators.documents import whole_word


@dataclass(frozen=True)
class Request:
    """A recall request; unknown fields don't exist, ranges are checked when it is made."""

    query: str
    subjects: tuple[str, ...] = ()
    intent: str = "fact"
    domain: str = ""
    topk: int = 8
    include_deprecated: bool | str = False
    weights: dict[str, float] = field(default_factory=lambda: {"lexical": 1.0, "title": 1.0})

    def __post_init__(self):
        if not self.query.strip():
            raise ValueError("query is empty")
        if not 1 <= self.topk <= 20:
            raise ValueError("topk is 1 to 20")
        if len(self.subjects) > 3:
            raise ValueError("three subjects at most")
        if self.intent not in ("fact", "relation", "explanation", "exploration", "lineage"):
            raise ValueError(f"unknown intent {self.intent!r}")
        object.__setattr__(self, "include_deprecated", strict_bool(self.include_deprecated))


def strict_bool(value: bool | str) -> bool:
    """Only truth values and the words true and false."""
    if isinstance(value, bool):
        return value
    if value in ("true", "false"):
        return value == "true"
    raise ValueError(f"{value!r} is no truth value")


def admitted(pages: DataFrame, request: Request) -> DataFrame:
    """Pages in scope whose lifecycle admits them; stands below every ranking and limit."""
    out = pages if request.include_deprecated else pages.where(F.coalesce(F.col("status") != "deprecated", F.lit(True)))
    return out.where(F.col("domain") == request.domain) if request.domain else out


def hybrid(pages: DataFrame, request: Request, candidates: int = 5, more: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, channels) for ``pages`` (id, title, text, source, domain, status).

    All words of the query count. Two channels (words of the text, words of the title) rank at most candidates * topk pages
    each; ``more`` has further ones as tables of (id, place), of which as many places count, within the same scope. Order:
    distinct-term coverage, phrase, then weighted reciprocal-rank fusion of the best rank in each channel (weight 1 where
    the request gives none), then id. At most two results of a source. results: id, source, kind, read_action and
    read_input (how to read it), coverage, phrase, score, rank, evidence_read (always false: a candidate is no evidence).
    channels: channel, n_candidates, window_full; a channel without candidates is listed with 0. The intent is only checked.
    """
    terms = list(dict.fromkeys(w for w in request.query.lower().split() if w))
    for s in request.subjects:
        terms += [w for w in s.lower().split() if w not in terms]
    scope = admitted(pages, request)
    share = lambda c: sum((F.coalesce(whole_word(F.col(c), t), F.lit(False)).cast("int") for t in terms), F.lit(0)) / float(len(terms))
    scored = scope.select(
        "id", "source", share("text").alias("coverage"), share("title").alias("title_coverage"),
        F.coalesce(F.contains(F.lower("text"), F.lit(request.query.lower())), F.lit(False)).cast("int").alias("phrase"),
    )
    most = candidates * request.topk

    def channel(name: str, by: str) -> DataFrame:
        top = scored.where(F.col(by) > 0).orderBy(F.desc(by), F.desc("phrase"), "id").limit(most)
        place = F.row_number().over(Window.orderBy(F.desc(by), F.desc("phrase"), "id"))  # at most ``most`` rows
        return top.select("id", "source", "coverage", "title_coverage", "phrase", F.lit(name).alias("channel"), place.alias("place"))

    lanes = channel("lexical", "coverage").unionByName(channel("title", "title_coverage"))
    for name, places in (more or {}).items():
        lanes = lanes.unionByName(scored.join(places.where(F.col("place") <= most).select("id", "place"), "id").select("id", "source", "coverage", "title_coverage", "phrase", F.lit(name).alias("channel"), "place"))
    weight = F.create_map(*[F.lit(x) for kv in ({n: 1.0 for n in more or ()} | request.weights).items() for x in kv])
    best = lanes.groupBy("id", "source", "channel").agg(F.min("place").alias("place"), F.max("coverage").alias("coverage"), F.max("phrase").alias("phrase"))
    fused = best.groupBy("id", "source").agg(F.max("coverage").alias("coverage"), F.max("phrase").alias("phrase"), F.sum(F.coalesce(F.try_element_at(weight, F.col("channel")), F.lit(0.0)) * fn.rrf(F.col("place"))).alias("score"))
    order = [F.desc("coverage"), F.desc("phrase"), F.desc("score"), F.col("id")]
    slot = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    kept = fused.withColumn("slot", slot).where("slot <= 2").orderBy(*order).limit(request.topk)
    results = kept.select("id", "source", F.lit("source_material").alias("kind"), F.lit("read_section").alias("read_action"), F.col("id").cast("string").alias("read_input"), "coverage", "phrase", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"), F.lit(False).alias("evidence_read"))
    names = lanes.sparkSession.createDataFrame([(n,) for n in ("lexical", "title", *(more or ()))], "channel string")
    counts = names.join(lanes.groupBy("channel").agg(F.count("*").alias("n")), "channel", "left")
    return results, counts.select("channel", F.coalesce("n", F.lit(0)).alias("n_candidates"), (F.coalesce("n", F.lit(0)) >= most).alias("window_full"))


def _far_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """name, best: pairs of ``a`` (name) and ``b`` (best) for ``ratio_pairs``, among them all within the ratio.

    A ratio of at least r needs lengths within a factor r, and among the pieces that a name of n characters is cut into
    (more pieces than edits allowed) one that the other has unchanged. Names meet by piece.
    """
    cut = lambda n: F.floor((1 - F.lit(least)) * n / F.lit(least)).cast("int") + 1  # noqa: E731  (edits that the longer partner allows, plus one)
    a, b = a.withColumn("n", F.length("name")), b.withColumn("m", F.length("best"))
    pieces = a.withColumn("k", F.least(cut(F.col("n")), F.col("n"))).select("name", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    start = F.floor(F.col("i") * F.col("n") / F.col("k")).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("n") / F.col("k")).cast("int")
    pieces = pieces.select("name", "n", F.col("name").substr(start + 1, end - start).alias("piece"), (end - start).alias("size"), start.alias("at"))
    sizes = pieces.groupBy("size").agg(F.max("at").alias("far"))
    grams = b.join(F.broadcast(sizes)).where("m >= size")  # a row for each piece length
    grams = grams.select("best", "m", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("p"), "size").select("best", "m", F.col("best").substr(F.col("p"), F.col("size")).alias("piece")).distinct()
    return pieces.join(grams, "piece").where((F.least("n", "m") >= F.greatest("n", "m") * least)).select("name", "best").distinct()


def _close_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """name, best: pairs of ``a`` (name) and ``b`` (best) for ``ratio_pairs``, where the ratio allows few edits.

    Two lengths n and m allow d edits. Of d + 1 pieces of the name some i-th (from 0) stands unchanged in the other, with
    i edits before it and d - i behind it at most: the first up to whose end there are fewer edits than pieces. So a piece
    meets few places of names of fitting length. Each edit changes at most two of the parities of characters, which are
    compared before the names are.
    """
    edits = lambda n: F.floor((1 - least) * n + 1e-9).cast("int")
    n, m, d, i = F.col("n"), F.col("m"), F.col("d"), F.col("i")
    at = lambda k: F.floor(k * n / (d + 1)).cast("int")
    size, apart = at(i + 1) - at(i), m - n
    key = lambda c, place: F.xxhash64(n, d, i, F.substring(c, place + 1, size))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(x), F.lit(64)))
    odd = lambda c: F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(bit(x)))
    a = a.withColumns({"n": F.length("name"), "a_odd": odd("name")})
    a = a.select("*", F.explode(F.sequence(edits(n), edits(F.floor(n / least + 1e-9)))).alias("d"))
    a = a.select("*", F.explode(F.sequence(F.lit(0), d)).alias("i")).select("name", "a_odd", "d", key("name", at(i)).alias("key"))
    b = b.withColumns({"m": F.length("best"), "b_odd": odd("best")})
    b = b.select("*", F.explode(F.sequence(F.ceil(m * least - 1e-9).cast("int"), F.floor(m / least + 1e-9).cast("int"))).alias("n"))
    b = b.withColumn("d", edits(F.greatest(n, m))).select("*", F.explode(F.sequence(F.lit(0), d)).alias("i"))
    first = F.greatest(F.lit(0), at(i) + F.greatest(-i, apart - d + i))
    last = F.least(m - size, at(i) + F.least(i, apart + d - i))
    b = b.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("place")).select("best", "b_odd", key("best", F.col("place")).alias("key"))
    met = a.join(b, "key").where(F.bit_count(F.col("a_odd").bitwiseXOR(F.col("b_odd"))) <= 2 * d)
    return met.where(F.call_function("levenshtein", F.col("name"), F.col("best"), d) >= 0).select("name", "best").distinct()


def ratio_pairs(names: DataFrame, authority: DataFrame, least: float = 0.6) -> DataFrame:
    """name, best, ratio: all pairs of a name and an authority name within an edit ratio.

    Names meet by pieces that stand unchanged in both, not all by all.
    """
    a = names.select(F.col("name")).where("name is not null and name <> ''").distinct()
    b = authority.select(F.col("name").alias("best")).where("best is not null and best <> ''").distinct()
    pairs = _close_pairs(a, b, least) if least >= 0.9 else _far_pairs(a, b, least)
    return pairs.withColumn("ratio", fn.title_ratio(F.col("name"), F.col("best"))).where(F.col("ratio") >= least)


def ratio_top(names: DataFrame, authority: DataFrame, least: float = 0.6) -> DataFrame:
    """name, best, ratio: the most similar authority name within an edit ratio, exactly as an exhaustive search finds it.

    Equal ratios go to the smaller name; names without partner have a null best.
    """
    top = ratio_pairs(names, authority, least).groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "best")).alias("t"))
    every = names.select("name").where("name is not null and name <> ''").distinct()
    return every.join(top, "name", "left").select("name", "t.best", (-F.col("t.r")).alias("ratio"))


def recall(entries: DataFrame) -> DataFrame:
    """subject, at, value, n_superseded of ``entries`` (subject, at, value): the current entry of each subject.

    An entry supersedes the one before it unless it says the same; of one instant the greatest value is the later.
    """
    w = Window.partitionBy("subject").orderBy("at", "value")
    before, first = F.lag("value").over(w), F.row_number().over(w)
    kept = entries.withColumns({"_before": before, "_r": first}).where((F.col("_r") == 1) | ~F.col("value").eqNullSafe(F.col("_before")))
    last = F.max(F.struct("at", "value"))
    return kept.groupBy("subject").agg(last.alias("l"), (F.count("*") - 1).alias("n_superseded")).select("subject", "l.at", "l.value", "n_superseded")


def remember(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with the new ones appended; what repeats the current entry of its subject is left out, nothing is changed or removed."""
    now = recall(entries).select(F.col("subject").alias("_s"), F.col("value").alias("_v"))
    fresh = new.join(now, (F.col("subject") == F.col("_s")) & F.col("value").eqNullSafe(F.col("_v")), "left_anti")
    return entries.select("subject", "at", "value").unionByName(fresh.select("subject", "at", "value"))


def navigation(pages: DataFrame, aliases: DataFrame, edges: DataFrame, request: Request, most: int = 50) -> DataFrame:
    """id, place, how: pages by the literal tiers of title and alias (exact, prefix, inside), by the graph where these find none.

    ``aliases`` has alias and id, ``edges`` a and b (page ids). The fallback takes pages linked to those whose title has a
    word of the query, by the number of links. Scope and lifecycle count before any limit.
    """
    low = request.query.lower()
    scope = admitted(pages, request)

    def tier(text):
        text = F.lower(text)
        return F.when(text == low, 0).when(F.startswith(text, F.lit(low)), 1).when(F.contains(text, F.lit(low)), 2)

    names = scope.select("id", F.col("title").alias("text")).unionByName(scope.join(aliases, "id").select("id", F.col("alias").alias("text")))
    found = names.withColumn("tier", tier(F.col("text"))).where("tier is not null").groupBy("id").agg(F.min("tier").alias("tier"))
    found = found.orderBy("tier", "id").limit(most)
    words = [w for w in dict.fromkeys(low.split()) if w]
    any_word = sum((F.coalesce(whole_word(F.col("title"), w), F.lit(False)).cast("int") for w in words), F.lit(0)) > 0
    both = edges.select(F.col("a").alias("from"), F.col("b").alias("id")).unionByName(edges.select(F.col("b").alias("from"), F.col("a").alias("id")))
    near = both.join(scope.where(any_word).select(F.col("id").alias("from")), "from").groupBy("id").agg(F.count("*").alias("links")).join(scope.select("id"), "id", "left_semi")
    near = near.orderBy(F.desc("links"), "id").limit(most)
    none = found.agg((F.count("*") == 0).alias("none"))
    near = near.join(F.broadcast(none)).where("none")  # one row
    ranks = found.select("id", F.row_number().over(Window.orderBy("tier", "id")).alias("place"), F.lit("name").alias("how"))  # at most ``most`` rows
    return ranks.unionByName(near.select("id", F.row_number().over(Window.orderBy(F.desc("links"), "id")).alias("place"), F.lit("graph").alias("how")))
