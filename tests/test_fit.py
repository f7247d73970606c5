"""Golden cases of the fit, quality, evidence and review rules, worked out by hand."""

import datetime

from pyspark.sql import functions as F

from millrace.operators import evidence, fit, headers, postings, review

STRONG = "Data Science Intern\nRequired: Python, pandas, SQL and machine learning.\n- model evaluation\n- classification\n- communication\n- documentation\n- teamwork\nEntry level role for a new grad.\nYou will build reports with the team and present the results of every week."
GRADUATE = "Recent graduate. Python, pandas, SQL, machine learning, model evaluation, classification, communication, documentation, teamwork."


def scored(spark, job, candidate):
    return fit.scored(spark.createDataFrame([(job, candidate)], "j string, c string"), "j", "c").first().fit


def test_strong_match_is_an_apply(spark):
    found = scored(spark, STRONG, GRADUATE)
    assert (found.eligibility, found.confidence, found.recommendation) == ("passed", "high", "Apply") and found.score >= 85
    parts = {p.category: p for p in found.breakdown}
    assert parts["Core technical skills"].earned == 40.0 and parts["Domain fit"].earned is None
    # intern, entry-level and new grad are covered in full by a recent graduate
    assert parts["Experience level fit"].missing == [] and parts["Experience level fit"].earned == 15.0


def test_requirements_gate_the_score(spark):
    years = scored(spark, STRONG + "\n3+ years of experience required", GRADUATE)
    assert years.eligibility == "failed" and years.codes == ["minimum_experience"] and years.recommendation == "Skip / Not Eligible"
    wished = scored(spark, STRONG + "\n3+ years of experience preferred", GRADUATE)
    assert wished.eligibility == "passed" and wished.codes == []
    degree = scored(spark, STRONG + "\nMaster's degree required or equivalent experience", GRADUATE + " Bachelor of Arts")
    assert degree.codes == ["graduate_degree_equivalent"] and degree.eligibility == "manual_review"
    senior = scored(spark, "Senior Data Scientist\n" + STRONG, GRADUATE)
    assert "seniority_requirement" in senior.codes and senior.eligibility == "failed"
    helping = scored(spark, STRONG + "\nSupport senior engineers and report to the manager", GRADUATE)
    assert helping.codes == []
    papers = scored(spark, STRONG + "\nYou must have the right to work in the UK", GRADUATE)
    assert papers.codes == ["work_authorization"] and papers.flags[-1] == "uk_held"


def test_preferred_skills_count_half(spark):
    found = scored(spark, "Required: Python\nSQL is a plus\nA lab with twenty words or more so that nobody calls this text a short one for any reason at all", "Python")
    core = found.breakdown[0]
    assert core.matched == ["Python"] and core.missing == ["SQL"] and core.earned == 26.7  # 40 * 1 / 1.5
    assert found.coverage_score == 67 and found.confidence == "low" and found.score == 58  # 50 + 17 * 2 / 4, half to even
    assert found.recommendation == "Manual Review"


def test_title_focus_only_lowers(spark):
    found = scored(spark, "# Physics Tutor\n" + STRONG, GRADUATE)
    assert found.focus.focus == "Physics" and found.focus.score == 0 and found.observed_score == round(found.coverage_score * 0.75)


def test_empty_texts(spark):
    found = scored(spark, None, None)
    assert (found.score, found.coverage_score, found.confidence, found.quality.label) == (0, 0, "low", "empty_or_unreadable")


def test_posting_quality(spark):
    body = "## Requirements\n" + "- Experience with SQL is required.\n" * 4 + "## Responsibilities\n" + "- You will build and maintain systems.\n" * 3 + "word " * 130
    rows = [("full", f"# T\nSource: JSearch\n## Job Description\n{body}"), ("snippet", f"# T\nJD Fetch Status: snippet_only\n## Job Description\n{body}"), ("cut", f"{body} ..."), ("short", "one two three")]
    found = {r.id: r.quality for r in postings.quality(spark.createDataFrame(rows, "id string, j string"), "j").collect()}
    assert found["full"].label == "scoring_ready" and found["full"].sections == ["responsibilities", "requirements"] and not found["full"].incomplete
    assert found["snippet"].label == "likely_snippet" and found["snippet"].incomplete
    assert found["cut"].label == "partial_jd" and found["cut"].truncated and found["short"].label == "empty_or_unreadable"


def test_evidence_pairs(spark):
    def pair(requirement, statement):
        rows = spark.createDataFrame([(requirement, statement)], "r string, e string").select(evidence.described(F.col("r")).alias("r"), evidence.described(F.col("e")).alias("e"))
        return rows.select(evidence.pair_score(F.col("r"), F.col("e")).alias("s")).first().s

    direct = pair("Proficiency in Python and SQL databases", "Built Python and SQL databases for 20 teams")
    assert direct.accepted and direct.match_type == "Direct support" and direct.concepts == ["database", "python"]
    semantic = pair("Create dashboards for leaders", "Developed business intelligence reporting in 2020")
    assert semantic.accepted and semantic.match_type == "Semantic support" and semantic.terms == []
    none = pair("Operate forklifts safely", "Wrote poems about rivers")
    assert not none.accepted and none.similarity <= 0.24
    years = pair("Python for five years", "Built Python tools for 2 years")
    assert not years.accepted and years.similarity >= 0.42


def test_header_rules(spark):
    def one(f, value):
        return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]

    assert one(headers.company_name, "Makimoto - About the team and our work") == "Makimoto" and one(headers.company_name, "ACME LABS") == "Acme Labs"
    assert one(headers.company_name, "Easy Apply") == one(headers.company_name, "2024/05/06 10:30") == one(headers.company_name, "Senior Analyst") == one(headers.company_name, "London") == ""
    assert one(headers.job_title, "Title: Data Analyst (Remote)") == "Data Analyst" and one(headers.section_key, "## What you’ll do:") == "responsibilities"
    assert one(headers.is_title, "Machine Learning Intern") and not one(headers.is_title, "You will build engineer tools, daily") and one(headers.is_noise, "oooo")
    assert one(headers.is_location, "San Francisco, CA") and not one(headers.is_location, "Beijing Labs")


def test_review_ages(spark):
    now = F.lit(datetime.datetime(2024, 5, 10, 12))
    rows = spark.createDataFrame([("2024-05-01", ""), ("", "2024-05-09 18:30"), ("2024-06-01", ""), ("soon", "2024-05-01"), ("", "")], "a string, c string")
    assert [r[0] for r in rows.select(review.age_days(F.col("a"), F.col("c"), now)).collect()] == [9, 0, 0, None, None]


def test_exact_rounding(spark):
    from millrace.functions import numbers

    values = [i / 80000 for i in range(0, 80000, 7)] + [0.02125, 2.675, 0.15, 0.25, 0.35, 26.666666666666668]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.fourth(F.col("v")).alias("four"), numbers.tenth(F.col("v")).alias("one")).collect()
    assert all((r.four, r.one) == (round(r.v, 4), round(r.v, 1)) for r in rows)


def test_a_line_is_worked_out_once():
    from millrace.operators.fit_scorer import Scorer

    scorer, seen = Scorer(fit.FitRules()), []
    make = scorer.lines.make
    scorer.lines.make = lambda line: seen.append(line) or make(line)
    found = [scorer.score(f"# Analyst {i % 3}\n{STRONG}", GRADUATE) for i in range(90)]
    assert len(seen) == len(set(seen)) == 3 + len(STRONG.split("\n")) and len(scorer.candidates) == 1
    assert all(x == found[i % 3] for i, x in enumerate(found))


def test_fit_reads_lines_as_whole_texts_do(spark):
    odd = ["visa\nsponsorship", "must\nbe\ncurrently authorised to work\nin the UK", "Source:\nAdzuna\nrequirements : \n- Build. Design!\r\nlead", "##\nJob Description\n\n Benefits\n...", "\xa0Benefits\n## Job Description  \n\x1c\xa0about us\xa0\n-\n*", "#\nData Analyst\nrole: x", "• -\n*", "green\ncard\n" + STRONG]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, j string").withColumn("c", F.lit("Analyst"))
    found = {r.id: r for r in postings.quality(fit.scored(rows, "j", "c"), "j").collect()}
    assert all(r.fit.quality == r.quality for r in found.values())
    assert [found[i].fit.codes for i in (0, 1, 7)] == [["work_authorization"], [], []]
    assert [found[i].fit.flags for i in (0, 1, 7)] == [["status"], ["uk", "uk_held"], ["status"]]
    assert found[5].fit.focus.title == "Data Analyst" and found[2].quality.snippet


def test_pairs_join_before_texts_are_made(spark, tmp_path):
    from millrace.plans.inputs import pairs

    spark.createDataFrame([(1, 7, "1-URGENT"), (2, 7, "2-HIGH")], "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "A")], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = pairs(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == 2 and plan.index("Job Description") < plan.index("Join") and "Job Description" not in plan[plan.index("Join") :]
