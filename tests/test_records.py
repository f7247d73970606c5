"""Record shaping, experience, views."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import experience, records, views


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_salary(spark):
    df = table(spark, [(10.0, 20.0), (0.0, 20.0), (10.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(records.salary_range(F.col("a"), F.col("b"))).collect()] == ["10 - 20", "up to 20", "from 10", ""]
    assert [r[0] for r in df.select(records.salary(F.col("a"), F.col("b"), F.lit("GBP"), F.lit("YEAR"))).collect()] == ["GBP 10 - 20 year", "GBP 0 - 20 year", "GBP from 10 year", ""]


def test_canonical_records(spark):
    raw = table(spark, [(" A &amp; B ", None, "https://x.org/?utm_term=1", ""), (None, "T", None, "Oslo")], "t string, u string, l string, p string")
    rows = records.canonical(raw, {"title": [F.col("t"), F.col("u")], "url": [F.col("l")], "location": [F.col("p")]}, "api").collect()
    assert [tuple(r) for r in rows] == [("api", "A & B", "https://x.org/", ""), ("api", "T", "", "Oslo")]
    one = table(spark, [("Oslo", None, "NO")], "a string, b string, c string")
    assert one.select(records.place(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "Oslo, NO"
    assert one.select(records.labelled({"City": F.col("a"), "State": F.col("b")})).first()[0] == "City: Oslo"
    assert one.select(records.requirements_tail(F.lit("We do. Requirements: SQL"))).first()[0] == "Requirements: SQL"


def test_lists_and_casts(spark):
    df = table(spark, [(["a", "B", " "], ["b", "c"])], "x array<string>, y array<string>")
    assert df.select(records.distinct_union(F.col("x"), F.col("y"))).first()[0] == ["a", "B", "c"]
    assert df.select(records.list_text(F.array(F.lit("a."), F.lit(" b"), F.lit("a")))).first()[0] == "a. b"
    odd = table(spark, [("12",), (" -3 ",), ("x",), (None,), ("true",)], "c string")
    assert [r[0] for r in odd.select(records.as_int(F.col("c"))).collect()] == [12, -3, 0, 0, 0]
    assert [r[0] for r in odd.select(records.as_bool(F.col("c"))).collect()] == [False, False, False, False, True]


def test_experience(spark):
    df = table(spark, [("5 years of SQL\n8 years preferred\nMasters degree",), ("none",)], "c string")
    rows = df.select(experience.most_years(F.col("c")), experience.required_years(F.col("c")), experience.level(experience.required_years(F.col("c"))), experience.degree(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(8.0, 5.0, "senior", 2), (None, None, None, 0)]
    need = table(spark, [(3, 2), (3, None), (None, 1), (2, 2)], "a int, b int")
    assert [r[0] for r in need.select(experience.unmet(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_views(spark):
    df = table(spark, [(1, "UK", 50, False), (2, "uk", None, False), (3, "FR", 90, True)], "id int, region string, score int, old boolean")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(views.filtered(df, {"region": "UK"}, {"score": 0})) == [1, 2]
    assert ids(views.filtered(df, least={"score": 40}, hidden=["old"])) == [1]
    assert ids(views.filtered(df, search="f", columns=["region"])) == [3]
    rows = table(spark, [(1, 0, "Acme", "low", "url"), (1, 1, "ACME", "high", "header"), (1, 2, "acme", "low", "url"), (1, 3, "Other", "medium", "body")], "doc int, pos int, name string, confidence string, evidence string")
    merged = {r.key: (r.name, r.confidence, r.evidence, r.sources) for r in views.merged_candidates(rows, text.company_key(F.col("name")), ["high", "medium", "low"], ["doc"]).collect()}
    assert merged == {"acme": ("ACME", "high", ["url", "header"], 3), "other": ("Other", "medium", ["body"], 1)}
    assert table(spark, [(["a", "b"], "b")], "r array<string>, v string").select(views.pushed(F.col("r"), F.col("v"))).first()[0] == ["b", "a"]
    options = table(spark, [("all", 9), ("x", 3), ("y", 5), ("z", 5)], "value string, n int")
    assert [(r.value, r.place) for r in views.option_order(options, ["all"], 2).orderBy("place").collect()] == [("all", 1), ("y", 2), ("z", 3)]


@pytest.mark.parametrize("rank,want", [("high", 3), ("low", 1), ("none", 0)])
def test_ranks(spark, rank, want):
    assert spark.range(1).select(views.ranked(F.lit(rank), ["high", "medium", "low"])).first()[0] == want
