from pyspark.sql import functions as F

from ledgerloom.llm import duplicates as du

FIELDS = {"title": False, "doi": True}
ROWS = [
    (1, "A Study, of: Things", "10.1/ab.c"), (2, "a study of things", "https://doi.org/10.1/AB.C"), (3, "A­Study​ of Things!", " doi: 10.1 / ab.c."),
    (4, "A Study of Things", "<HTTP://DX.DOI.ORG/10.1/ab.c>"), (5, "A Study of Things", None), (6, "A Study of Things", "  "), (7, "a study of things", ""),
    (8, None, None), (9, " ", " "), (10, "--", "doi:"), (11, "État 2", "x"), (12, "ÉTAT 2", "x"), (13, "Etat 2", "x"), (14, "etat 3", "x"),
    (19, "\u1100\u1161\u11a8 x", "k"), (20, "각 X", "k"), (21, "\uf900", "k"), (22, "豈", "k"), (23, "\u212bb", "k"), (24, "åB", "k"), (25, "a\u030ab", "Ký"), (26, "åb", "ky\u0301"),
    (15, "dup", "y"), (16, "dup", "y"), (17, "x" * 300000, "z"), (18, "X " * 300000, "z"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, d, "c") for i, t, d in rows], "id int, title string, doi string, keeper string")


def test_pairs(spark):
    got = {(r.keeper, r.id) for r in du.copies(table(spark), "id", FIELDS).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (5, 6), (5, 7), (8, 9), (11, 12), (15, 16), (17, 18), (19, 20), (21, 22), (23, 24), (25, 26)}


def test_counts_are_whole(spark):
    groups = du.collapse(table(spark), "id", FIELDS)
    assert groups.agg(F.sum("n_copies")).first()[0] == len(ROWS)
    assert groups.count() == len(ROWS) - 13


def test_fields_of_any_name(spark):
    df = table(spark).selectExpr("id as n", "title as least", "doi as raw", "keeper as form")
    got = {(r.keeper, r.id) for r in du.copies(df, "n", {"least": False, "raw": True}).collect()}
    assert got == {(r.keeper, r.id) for r in du.copies(table(spark), "id", FIELDS).collect()}


def test_repeated_raw_rows(spark):
    """A raw form of many rows beside other forms of its group, some of them smaller, some larger."""
    rows = [(i, "Same" if i % 2 else "same.", "d") for i in range(5, 40)] + [(2, "SAME", "d"), (90, "s a m e", "d"), (1, "other", "d"), (50, "other", "d")]
    got = {(r.keeper, r.id) for r in du.copies(table(spark, rows), "id", FIELDS).collect()}
    assert got == {(2, i) for i in [*range(5, 40), 90]} | {(1, 50)}


def test_empty(spark):
    assert du.copies(table(spark, []), "id", FIELDS).count() == 0


def test_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 3 == 0, "Same, one").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("doi"))
    assert du.copies(rows, "id", FIELDS).count() == 999


def test_payloads(spark):
    rows = [(1, '{"TITLE": "a", "Doi": null, "n": 3}'), (2, '{"title": "a"'), (3, None), (4, ""), (5, "[1]"), (6, ' {"doi": "x", "title": "\\u00e9"} '), (7, '{"title": "a"} trailing'), (8, "{}"), (9, '{"title": "a"} x}'), (10, '{"title": "a"}, {"title": "b"}'), (11, '{"title": "a"}], [{"title": "b"}'), (12, '{"title": "a"}} {"title": "b"}'), (13, '"title": "a"}')]
    df = spark.createDataFrame(rows, "id int, payload string")
    got = {r.id: (r.title, r.doi) for r in du.from_json_payload(df, "payload", ["title", "doi"]).collect()}
    assert got == {1: ("a", None), 6: ("é", "x"), 8: (None, None)}
