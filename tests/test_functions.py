"""Functions whose dialect or state SQL does not cover."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys, text, urls
from millrace.operators import extract, quality, scoring
from millrace.sources import readers, writers


def one(spark, column, *values, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column.alias("x")).collect()]


@pytest.fixture(autouse=True)
def column(spark):
    global C
    C = F.col("c")


def test_normalisers_differ_on_purpose(spark):
    value = "C++ / Node.js_Dev-Ops & R"
    assert one(spark, text.search_text(C), value) == ["c++ node.js dev-ops r"]
    assert one(spark, text.company_key(C), value) == ["c++ node.js dev-ops & r"]
    assert one(spark, text.keyword_text(C), value) == [" c++ node js dev ops r "]
    assert one(spark, text.match_text(C), value, None)[0] == " c++ / node.js_dev ops & r "


def test_cleaners(spark):
    assert one(spark, text.clean_html(C), "<p>a &amp; b</p>&nbsp;<i>c</i>", None) == ["a & b c", ""]
    assert one(spark, text.redacted(C), "- mail me@x.org or +44 20 7946 0958, see https://x.org/a") == ["mail [redacted] or [redacted], see [redacted]"]
    assert one(spark, text.source_line(C), "- **Built** `x` with [tool](http://t)") == ["Built x with tool"]
    assert one(spark, text.markdown(C), "﻿a \r\n\r\n\r\n\r\nb") == ["a\n\nb"]
    assert one(spark, text.pdf_page(C), "exam-\nple\nPage 2 of 3\nend") == ["example\nend"]
    assert one(spark, text.unrepeated_lines(C, F.lit(["share"])), "a\nA\nShare\n\nb\nb\na") == ["a\nb\na"]
    assert one(spark, text.joined_lines(C), "one\ntwo.\nthree\n- four") == ["one two.\nthree\n- four"]
    assert one(spark, text.slug(C), "A b--C!", "!!", None) == ["a_b_c", "unknown", "unknown"]
    assert one(spark, text.aliased(C, {"uk": "United Kingdom"}), " UK. ", "Oslo") == ["United Kingdom", "Oslo"]
    assert one(spark, text.company_case(C, ("IBM",)), "ibm research", "McKay") == ["IBM Research", "McKay"]
    assert one(spark, text.masked_secrets(C), "url?api_key=abc&x=1") == ["url?api_key=***&x=1"]
    assert one(spark, text.shortened(C, 8), "abcdefghij", "abc") == ["abcde...", "abc"]
    assert one(spark, text.filename_words(C), "in/My_Data-role_20240102.pdf") == ["My Data role"]
    assert one(spark, text.without_leading_timestamp(C), "1/2/2024, 10:30 AM Analyst") == ["Analyst"]


def test_urls(spark):
    assert one(spark, urls.canonical(C), "HTTPS://A.org//b/?utm_term=1&q=2&GCLID=3&ref=x#f", "no url", None) == ["https://a.org/b?q=2&ref=x", "no url", ""]
    assert one(spark, urls.sanitized(C), "https://www.adzuna.com/land/ad/12?ref=1#f", "https://a.org/land/ad/12?app_key=k&ref=1#f") == ["https://www.adzuna.com/details/12", "https://a.org/land/ad/12?ref=1#f"]
    assert one(spark, urls.is_valid(C), "", "ftp://a", "http://", "https://a") == [True, False, False, True]
    assert one(spark, urls.company_label(C), "https://jobs.acme.com/x", "") == ["acme", ""]


def test_keys(spark):
    assert one(spark, keys.pair_hash(C, F.lit("b")), "a") != one(spark, keys.pair_hash(F.lit("b"), C), "a")
    split = one(spark, keys.stable_split(C), *map(str, range(400)))
    assert set(split) == {"train", "validation", "test"} and 240 < split.count("train") < 320


def test_extraction(spark):
    assert one(spark, extract.keywords(C, {"r": (), "machine learning": ("ml",)}), "R and ML", "rust html") == [["r", "machine learning"], []]
    assert one(spark, extract.stated_years(C), "2.5 years or three years", "none") == [[2.5, 3.0], []]
    assert one(spark, extract.flags(C, {"visa": ("sponsor",), "pay": ("unpaid",)}), "No sponsorship") == [["visa"]]
    assert one(spark, extract.classified(C, [("remote", ("remote",)), ("hybrid", ("hybrid",))], "site"), "Hybrid or remote", "office") == ["remote", "site"]
    assert one(spark, extract.snippets(C, ["sql", "python"]), "Knows SQL well\nPython and SQL") == [["Knows SQL well", "Python and SQL"]]


def test_quality_warnings(spark):
    df = spark.createDataFrame([("Acme", "", "Oslo", 10)], "a string, b string, c string, n int")
    found = df.select(quality.warnings(F.col("a"), F.col("b"), F.col("c"), F.lit(True), F.col("n"))).first()[0]
    assert found == ["title missing", "description short"]


def test_calibration_rounds_half_even(spark):
    df = spark.createDataFrame([(100, 1), (40, 1), (90, 8)], "s int, n int")
    assert [r[0] for r in df.select(scoring.calibrated(F.col("s"), F.col("n"))).collect()] == [62, 40, 90]


def test_eligibility_order(spark):
    status, reasons = scoring.eligibility(("a", F.col("c") > 1, "manual_review"), ("b", F.col("c") > 2, "failed"))
    rows = spark.createDataFrame([(1,), (2,), (3,), (None,)], "c int").select(status, reasons).collect()
    assert [(r[0], r[1]) for r in rows] == [("passed", []), ("manual_review", ["a"]), ("failed", ["a", "b"]), ("passed", [])]


def test_header_modes(spark):
    value = "# T\nUrl: not provided\nUrl: http://a\nUrl:\n\n## Job Description\nUrl: no\nbody"
    got = {m: one(spark, readers.header(C, "Url", m), value)[0] for m in ("first", "strict", "last", "blank")}
    assert got == {"first": "http://a", "strict": "not provided", "last": "", "blank": ""}
    assert one(spark, readers.body(C), value, "plain") == ["Url: no\nbody", "plain"]
    assert one(spark, writers.with_fields(C, {"Url": F.lit("$1\\x"), "New": F.lit("y")}), "# T\nUrl: a") == ["# T\nNew: y\nUrl: $1\\x"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text_of = spark.range(1).select(writers.markdown(F.lit("A role"), {"Company": F.lit(" Acme "), "Location": F.lit("")}, F.lit("Do it"))).first()[0]
    (tmp_path / "in" / "a.md").write_text(text_of)
    (tmp_path / "in" / "b.txt").write_text("no")
    row = readers.markdown_records(readers.text_files(spark, str(tmp_path / "in")), ["Company", "Location"]).collect()
    assert [(r.company, r.location, r.body) for r in row] == [("Acme", "", "Do it")]
    rows = spark.createDataFrame([(1, "t", "label", None, "x", None, None)], readers.EVENT)
    writers.write_json_lines(rows, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), readers.EVENT).collect() == rows.collect()
    assert readers.capped(50) == 20
    with pytest.raises(ValueError):
        readers.capped(0)
