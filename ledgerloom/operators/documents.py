"""Documents: lines, outlines, segments, windows, excerpts, locators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content: one row for each line; null texts have none."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def outline(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, level, title, next_line: Markdown headings outside code fences; next_line ends the section (null: the end).

    A section ends at the next heading of the same or a higher level.
    """
    rows = lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.col("content").rlike(r"^(```|~~~)").cast("int")).over(order)
    heads = rows.withColumn("fence", fence).where((F.col("fence") % 2 == 0) & F.col("content").rlike(r"^#{1,6} "))
    level = F.length(F.regexp_extract("content", r"^(#{1,6}) ", 1))
    heads = heads.select(key, "line", level.alias("level"), F.trim(F.regexp_replace("content", r"^#{1,6} ", "")).alias("title"))
    # From the end of the text on, the last heading of a level or higher that was met is the next one.
    back = Window.partitionBy(key).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.array(*[F.last(F.when(F.col("level") <= k, F.col("line")), ignorenulls=True).over(back) for k in range(1, 7)])
    return heads.withColumn("_next", nearest).select(key, "line", "level", "title", F.element_at("_next", F.col("level")).alias("next_line"))


def segments(docs: DataFrame, key: str, text: str, most_lines: int = 32, most_chars: int = 6000) -> DataFrame:
    """key, segment, first_line, last_line, n_chars: greedy runs of whole lines within both limits.

    A line longer than ``most_chars`` stands in a segment of its own (n_chars tells).
    """
    sizes = F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1)
    zero = F.struct(F.array().cast("array<struct<first:int,last:int,n:int>>").alias("done"), F.lit(0).alias("line"), F.lit(0).alias("n"), F.lit(0).alias("chars"))

    def step(s, x):
        new = (s["n"] >= most_lines) | ((s["n"] > 0) & (s["chars"] + x > most_chars))
        closed = F.array(F.struct((s["line"] - s["n"] + 1).cast("int").alias("first"), s["line"].cast("int").alias("last"), s["chars"].cast("int").alias("n")))
        return F.struct(
            F.when(new, F.concat(s["done"], closed)).otherwise(s["done"]).alias("done"),
            (s["line"] + 1).alias("line"),
            F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.when(new, x).otherwise(s["chars"] + x).alias("chars"),
        )

    end = lambda s: F.concat(s["done"], F.array(F.struct((s["line"] - s["n"] + 1).cast("int").alias("first"), s["line"].cast("int").alias("last"), s["chars"].cast("int").alias("n"))))
    folded = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.aggregate(sizes, zero, step, end)).alias("segment", "s"))
    return folded.select(key, "segment", F.col("s.first").alias("first_line"), F.col("s.last").alias("last_line"), F.col("s.n").alias("n_chars"))


def byte_windows(docs: DataFrame, key: str, text: str, most: int = 2400) -> DataFrame:
    """key, part, content: pieces of at most ``most`` UTF-8 bytes that together are the text; a newline is the preferred end."""

    def cut(value: str) -> list[str]:
        data, out, at = value.encode("utf-8", "surrogatepass"), [], 0
        while len(data) - at > most:
            end = at + most
            while data[end] & 0xC0 == 0x80:  # not within a character
                end -= 1
            line = data.rfind(b"\n", at, end) + 1
            end = line if line - at > (end - at) // 2 else end
            if end == at:
                raise ValueError("a window is smaller than a character")
            out.append(data[at:end].decode("utf-8", "surrogatepass"))
            at = end
        return [*out, data[at:].decode("utf-8", "surrogatepass")] if at < len(data) else out

    @F.pandas_udf("array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: cut(v) if v else [])

    return docs.select(key, F.posexplode(parts(F.col(text))).alias("part", "content"))


def excerpt(docs: DataFrame, key: str, text: str, wanted: list[str], most: int = 700) -> DataFrame:
    """key, first, end, n_terms, truncated, excerpt: the window of at most ``most`` characters with the most distinct terms.

    Positions count characters from 0, half open; the earliest of equal windows counts; without a hit it is the beginning.
    """
    low = [w.lower() for w in wanted]

    def best(value: str) -> tuple:
        base = value.lower()
        if len(base) != len(value):
            base = value
        hits = sorted((i, k) for k, w in enumerate(low) for i in _finds(base, w))
        ends = sorted((i + len(low[k]), i, k) for i, k in hits)
        top, at, gone, come, inside = 0, 0, 0, 0, [0] * len(low)
        for start in sorted({i for i, _ in hits}):  # hits enter by their ends and leave by their beginnings
            while come < len(ends) and ends[come][0] <= start + most:
                inside[ends[come][2]] += ends[come][1] >= start
                come += 1
            while hits[gone][0] < start:
                i, k = hits[gone]
                inside[k] -= i >= last and i + len(low[k]) <= last + most  # it had been counted
                gone += 1
            n = sum(1 for v in inside if v)
            if n > top:
                top, at = n, start
            last = start
        end = min(len(value), at + most)
        return at, end, top, at > 0 or end < len(value), value[at:end]

    @F.pandas_udf("first int, end int, n_terms int, truncated boolean, excerpt string")
    def window(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([best(v or "") for v in batch], columns=["first", "end", "n_terms", "truncated", "excerpt"])

    return docs.where(F.col(text).isNotNull()).select(key, window(F.col(text)).alias("w")).select(key, "w.*")


def _finds(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def locators(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, source, first_line, last_line of every line locator in the text."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(raw/[a-z0-9-]+\.md#L[0-9]+-L[0-9]+)"), F.lit(1)))
    rows = docs.select(key, found.alias("l"))
    return rows.select(key, F.regexp_extract("l", r"^(.*)#", 1).alias("source"), F.regexp_extract("l", r"#L([0-9]+)", 1).cast("int").alias("first_line"), F.regexp_extract("l", r"-L([0-9]+)$", 1).cast("int").alias("last_line"))


def whole_word(text: Column, word: str) -> Column:
    """Whether an English word stands in the text as a word; Han text is looked for literally."""
    if any("一" <= c <= "鿿" for c in word):
        return F.contains(text, F.lit(word))
    return F.lower(text).rlike(r"(^|[^\p{L}\p{N}])" + word.lower() + r"([^\p{L}\p{N}]|$)")


def abstract_span(docs: DataFrame, key: str, text: str, title: Column) -> DataFrame:
    """key, text, start_line, stop_line, overlap: lines between which an abstract can stand (both outside).

    It begins below the first-level heading that has most of the title's words (0.6 of them at least, the first of equals)
    and ends above the introduction, or after 80 lines. Texts without such a heading have no row.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    rows = docs.select(key, F.col(text).alias("text"), lines.alias("lines"), tokens(title).alias("want"))
    head = lambda x: F.when(x.rlike(r"(?d)^#\s+.+$"), F.size(F.array_intersect(F.col("want"), tokens(F.regexp_extract(x, r"(?d)^#\s+(.+)$", 1)))) / F.greatest(F.size("want"), F.lit(1)).cast("double"))
    heads = F.array_compact(F.transform("lines", lambda x, i: F.when(head(x) >= 0.6, F.struct(F.round(head(x), 9).alias("overlap"), (-i - 1).alias("at")))))
    rows = rows.withColumn("best", F.array_max(heads)).where("best is not null").withColumn("start_line", -F.col("best.at"))
    stop = F.array_min(F.array_compact(F.transform("lines", lambda x, i: F.when((i + 1 > F.col("start_line")) & (i + 1 < F.col("start_line") + 80) & x.rlike(r"(?i)^##\s+(?:\d+[.\s]+)?(?:introduction|引言)(?:$|[^\p{L}\p{N}_])"), i + 1))))
    return rows.select(key, "text", F.col("start_line").cast("int").alias("start_line"), F.coalesce(stop, F.least(F.col("start_line") + 80, F.size("lines") + 1)).cast("int").alias("stop_line"), F.col("best.overlap").alias("overlap"))


def abbreviations(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """short, full_name: what texts define as Full Name (FN).

    As many words before the bracket as the short form has letters; hyphens part words, initials must agree regardless of
    case. A short form with names that differ in more than hyphens and case is left out; of equal names the smallest counts.
    """
    found = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"([^()\n]{3,200}\([A-Z]{2,8}\))"), F.lit(1))).alias("m"))
    short = F.regexp_extract("m", r"\(([A-Z]{2,8})\)$", 1)
    before = F.trim(F.regexp_replace("m", r"\([A-Z]{2,8}\)$", ""))
    # Marks of the parted words, so that the name can be cut from the text as it was written.
    words = F.regexp_extract_all(before, F.lit(r"([^\s-]+[\s-]*)"), F.lit(1))
    found = found.select(short.alias("short"), F.slice(words, -F.least(F.length(short), F.size(words)), F.greatest(F.length(short), F.lit(1))).alias("words"))
    initials = F.upper(F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), ""))
    found = found.where(initials == F.col("short")).select("short", F.trim(F.array_join("words", "")).alias("full_name"))
    per = found.groupBy("short").agg(F.min("full_name").alias("full_name"), F.count_distinct(F.lower(F.replace("full_name", F.lit("-"), F.lit(" ")))).alias("n"))
    return per.where("n = 1").select("short", "full_name")


def slug(title: Column) -> Column:
    """A heading as the name of its section: lower case, everything but letters and digits as one hyphen."""
    return F.lower(F.regexp_replace(F.trim(title), r"[^\p{L}\p{N}]+", "-"))


def read_section(docs: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """key, state (found, missing), body, citations, sections: the first section of a name, without its heading.

    citations are the line locators in it; where the section is missing, sections lists those there are.
    """
    heads = outline(docs, key, text).withColumn("slug", slug(F.col("title")))
    mine = heads.where(F.col("slug") == wanted).groupBy(key).agg(F.min(F.struct("line", "next_line")).alias("s"))
    names = heads.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "slug"))), lambda x: x["slug"]), ",").alias("names"))
    rows = docs.select(key, F.col(text).alias("text")).join(mine, key, "left").join(names, key, "left")
    lines = F.split("text", "\n", -1)
    end = F.coalesce(F.col("s.next_line"), F.size(lines) + 1)
    body = F.when(F.col("s").isNotNull(), F.array_join(F.slice(lines, F.col("s.line") + 1, F.greatest(F.lit(0), end - F.col("s.line") - 1)), "\n"))
    rows = rows.select(key, F.when(F.col("s").isNull(), "missing").otherwise("found").alias("state"), body.alias("body"), F.when(F.col("s").isNull(), F.coalesce("names", F.lit(""))).alias("sections"))
    return rows.withColumn("citations", F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(raw/[a-z0-9-]+\.md#L[0-9]+-L[0-9]+)"), F.lit(1))))


def read_raw(asked: DataFrame, sources: DataFrame, most: int = 12_000, offered: int = 8) -> DataFrame:
    """``asked`` (source, first_line, last_line and more) with state, body and ranges, from ``sources`` (source, text).

    state is read, no source, no lines, or too long (more than ``most`` characters); lines beyond the end are not there. In
    the last case ranges has ``offered`` ranges of whole lines within the limit, and as last one what is left (rest true);
    a line longer than the limit is a range of its own.
    """
    rows = asked.join(sources.select(F.col("source").alias("_s"), F.col("text").alias("_t")), F.col("source") == F.col("_s"), "left")
    lines = F.split("_t", "\n", -1)
    last = F.least(F.col("last_line"), F.size(lines))
    rows = rows.withColumns({"_in": (F.col("first_line") >= 1) & (F.col("last_line") >= F.col("first_line")) & (F.col("first_line") <= F.size(lines)), "_last": last})
    part = F.when(F.col("_in"), F.slice(lines, F.col("first_line"), F.greatest(F.lit(0), F.col("_last") - F.col("first_line") + 1)))
    rows = rows.withColumn("_part", part).withColumn("_body", F.array_join("_part", "\n"))
    state = F.when(F.col("_s").isNull(), "no source").when(~F.col("_in"), "no lines").when(F.length("_body") > most, "too long").otherwise("read")
    kind = "struct<first:int,last:int,rest:boolean>"

    @F.pandas_udf(f"array<{kind}>")
    def cut(parts: pd.Series, firsts: pd.Series) -> pd.Series:
        def one(part, first):
            if part is None:
                return None
            out, begin, size = [], 0, 0
            for i, n in enumerate(map(len, part)):
                if i > begin and size + n + 1 > most:
                    out.append((begin, i - 1))
                    begin, size = i, 0
                size += n + (1 if i > begin else 0)
            out.append((begin, len(part) - 1))
            shown = [{"first": int(first + a), "last": int(first + z), "rest": False} for a, z in out[:offered]]
            return shown + ([{"first": int(first + out[offered][0]), "last": int(first + len(part) - 1), "rest": True}] if len(out) > offered else [])

        return pd.Series([one(p, f) for p, f in zip(parts, firsts)])

    rows = rows.withColumn("state", state)
    ranges = cut(F.when(F.col("state") == "too long", F.col("_part")), F.col("first_line"))
    return rows.withColumns({"body": F.when(F.col("state") == "read", F.col("_body")), "ranges": ranges}).drop("_s", "_t", "_in", "_last", "_part", "_body")


def outline_window(heads: DataFrame, key: str, query: str = "", start_line: int = 1, limit: int = 40) -> DataFrame:
    """key, line, level, title, more: the first ``limit`` headings from a line on that contain a text; more tells whether others follow."""
    if not 1 <= limit <= 200 or start_line < 1:
        raise ValueError("limit is 1 to 200, lines begin at 1")
    rows = heads.where((F.col("line") >= start_line) & F.contains(F.lower("title"), F.lit(query.lower())))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line"))
    rows = rows.withColumns({"_place": place, "_n": F.count("*").over(Window.partitionBy(key))})
    return rows.where(F.col("_place") <= limit).select(key, "line", "level", "title", (F.col("_n") > limit).alias("more"))
