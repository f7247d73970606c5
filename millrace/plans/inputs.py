"""Texts put together from whole tables: an order gives a posting, a customer a candidate. The expressions read alike in Spark and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import table


def _pick(key: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE CAST({key} % {len(values)} AS INT) {cases} END)"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


#: Of orders.
TITLE = _pick("o_orderkey", ["Senior Data Scientist", "Data Analyst", "Junior Machine Learning Engineer", "Physics Tutor", "Product Manager", "Business Analyst", "Data Engineer", "Audio Engineer", "Barista", "Staff Robotics Developer", "Graduate Analyst"])
SOURCE = _pick("o_custkey", ["Adzuna", "JSearch", "Jooble", "Company Website", "Manual", "Adzuna", "", "LinkedIn"])
STATUS = _pick("o_orderkey", ["complete", "snippet_only", "", "Full", "partial", "not provided", ""])
JOB = _lines(
    f"'# ' || {TITLE}",
    "'Company: Customer ' || CAST(o_custkey AS VARCHAR(20))",
    f"'Source: ' || {SOURCE}",
    f"'JD Fetch Status: ' || {STATUS}",
    "'Role: ' || o_orderpriority",
    _pick("o_custkey", ["## Job Description", "Job Description", "## job description", "## Job Description"]),
    "''",
    _pick("o_orderkey", ["## Responsibilities", "What you''ll do:", "Duties", "the role"]),
    "'- ' || " + _pick("o_custkey", ["Develop Python and SQL pipelines.", "Maintain dashboards; build charts and analytics.", "You will lead route planning for UAV missions!", "Collaborate with the team on robotics. Support sensor data.", "Serve coffee."]),
    "'* ' || " + _pick("o_orderkey", ["Design models with scikit-learn and pandas", "Communication, documentation and presentation", "analyse thermal data with C#", "Manage stakeholder management tasks", "Implement feature engineering, PCA and CNN models", "Teaching R and Excel"]),
    _pick("o_custkey", ["## Requirements", "Qualifications:", "About you", "requirements", "### What you''ll need", "Wishes"]),
    "'- ' || " + _pick("o_orderkey", ["Required: Python, SQL and machine learning experience.", "3+ years of data analysis required", "Preferred: 5+ years of analytics", "Must have a Master''s degree or equivalent experience", "PhD required. Knowledge of econometrics.", "Bachelor''s degree preferred", "at least 5 years in a senior role", "Entry level role for a new grad or intern", "Minimum 2.5 years experience with statistics"]),
    "'- ' || " + _pick("o_custkey", ["SQL is a plus", "Nice to have: NumPy, MATLAB, causal inference", "Ability to communicate; teamwork skills.", "Junior developers welcome", "Bonus: reinforcement learning and game AI", "ML model evaluation required", "did you know? Excel preferred"]),
    _pick("o_orderkey", ["Must have the right to work in the UK. No visa sponsorship.", "London office...", "We are an equal opportunity employer. Background check applies.", "Visa sponsorship available", "Location: remote", "Must be currently authorised to work in the UK (London)", "Citizenship is not needed", "", "See our privacy policy. Terms and conditions apply. Diversity and inclusion matter here."]),
    _pick("o_custkey", ["Benefits", "## What we offer", "about us", "Compensation:", ""]),
    "repeat(" + _pick("o_orderkey", ["We build useful tools for many people every day. ", "You will design and support systems. ", "Protected veteran and disability status statement. "]) + ", CAST(o_orderkey % 13 AS INT))",
)

#: Of customer.
CANDIDATE = _lines(
    "c_name",
    _pick("c_custkey", ["Senior analyst", "mid-level engineer", "Junior data person", "Recent graduate", "Undergraduate, current student", "Analyst", "Internship at a lab"]),
    "'- ' || " + _pick("c_custkey", ["Built Python, pandas and scikit-learn models", "Analyzed data with SQL and Excel", "Worked on UAV route planning", "Physics and mechanics tutor", "Wrote documentation"]),
    "'- ' || " + _pick("c_custkey", ["4 years of professional experience", "2.5 yrs experience with ETL", "10+ years of work experience", "no numbers"]),
    "'- ' || " + _pick("c_custkey", ["Bachelor of Science", "Master''s in statistics", "Ph.D. in physics", "self taught", "B.S. in audio", "MS", "communication and teamwork", "thermal data, econometrics", "data analysis and data visualization"]),
    _pick("c_custkey", ["Permanent resident", "Requires visa sponsorship", "Authorized to work", "", "citizen", "Not authorized to work"]),
)


def dealt_orders(spark, sf_dir: str) -> DataFrame:
    """Orders dealt out by key while they are narrow: a small file is one partition, and work on the texts made of them is work by the row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


def pairs(spark, sf_dir: str) -> DataFrame:
    """(o_orderkey, job, candidate): every order's posting beside its customer's candidate text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    both = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    # dealt out while rows are narrow, behind the join, which would move the texts of large tables; a customer's orders stay together, but a
    # large customer's are cut by order: what is worked out for equal texts and lines is kept for a while
    dealt = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey", "o_orderkey").sortWithinPartitions("o_custkey")
    return dealt.select("o_orderkey", F.expr(JOB).alias("job"), F.expr(CANDIDATE).alias("candidate"))


PAIRS = f"pairs AS (SELECT o_orderkey, {JOB} AS job, {CANDIDATE} AS candidate FROM orders JOIN customer ON c_custkey = o_custkey)"
