"""Queries over the review list. Every order is a scored record; the SQL is written anew."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import review
from millrace.plans.inputs import _pick
from millrace.plans.spec import query
from millrace.session import table

_K, _C = "o_orderkey", "o_custkey"
_COLUMNS = {
    "available": f"({_K} % 11 <> 0)",
    "eligibility": _pick(_K, ["passed", "manual_review", "passed", "failed", "passed"]),
    "confidence": _pick(_C, ["low", "medium", "high", "high"]),
    "recommendation": _pick(_K, ["Apply", "Maybe Apply", "Apply / Maybe Apply", "Manual Review", "Skip or Low Priority", "Skip / Not Eligible", "Apply"]),
    "score": f"(CASE WHEN {_K} % 13 = 0 THEN NULL ELSE CAST({_C} % 101 AS INT) END)",
    "tracker_status": _pick(_C, ["Not tracked", "Demo only", "ready", "Applied", "archived", "Rejected", "interview"]),
    "package_status": _pick(_K, ["No cover letter", "Cover letter ready", "Demo cover letter"]),
    "company_needs_review": f"({_C} % 9 = 0)",
    "newest": "CAST(o_orderdate AS VARCHAR(10))",
    "company": f"('Customer ' || CAST({_C} % 97 AS VARCHAR(9)))",
    "role": "o_orderpriority",
    "quality_ready": f"(CASE WHEN {_K} % 3 = 0 THEN {_C} % 2 = 0 END)",
    "incomplete": f"(CASE WHEN {_K} % 3 = 1 THEN {_C} % 2 = 1 END)",
    "fetched": _pick(_C, ["", "missing", "complete"]),
    "n_words": f"CAST({_C} % 160 AS INT)",
    "active": f"CAST({_C} % 12 AS INT)",
    "first_code": f"(CASE WHEN {_K} % 4 <> 0 THEN {_pick(_C, ['minimum_experience', 'work_authorization'])} END)",
    "status": _pick(_K, ["saved", "Ready", "applied", "Interview", "rejected", "archived", "", "APPLIED"]),
    "applied": f"(CASE WHEN {_K} % 2 = 0 THEN CAST(o_orderdate AS VARCHAR(10)) WHEN {_K} % 6 = 1 THEN 'soon' ELSE '' END)",
    "created": f"(CASE WHEN {_K} % 5 = 0 THEN 'yesterday' ELSE CAST(o_orderdate AS VARCHAR(10)) || ' 12:30' END)",
}
_ROWS = "j AS MATERIALIZED (SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM orders)"
_IGN = "(lower(trim(tracker_status)) IN ('archived', 'ignored', 'not interested', 'rejected', 'skip'))"
_CURRENT = "(available AND eligibility = 'passed' AND confidence IN ('medium', 'high') AND recommendation IN ('Apply', 'Apply / Maybe Apply', 'Maybe Apply'))"
_PACK, _UNTRACKED = "package_status IN ('Cover letter ready', 'Demo cover letter')", "tracker_status IN ('Not tracked', 'Demo only')"
_VIEWS = {
    "Recommended": f"{_CURRENT} AND coalesce(score, 0) >= 50 AND NOT {_IGN}",
    "Needs attention": f"NOT {_IGN} AND (NOT available OR eligibility = 'manual_review' OR confidence = 'low' OR recommendation = 'Manual Review' OR (tracker_status <> 'Demo only' AND (NOT {_PACK} OR {_UNTRACKED})))",
    "Ready": f"({_PACK} OR lower(tracker_status) = 'ready') AND NOT {_IGN}",
    "Not tracked": f"NOT {_IGN} AND {_UNTRACKED}",
    "Ignored": _IGN,
    "All": "true",
}
_FULL = "coalesce(NOT quality_ready, incomplete, lower(fetched) IN ('', 'missing', 'snippet_only') AND n_words < 80)"


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _COLUMNS.items()])


@query("review_views", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS records, min(o_orderkey) AS first, sum(score)::BIGINT AS total FROM j WHERE {t}" for v, t in _VIEWS.items()))
def review_views(spark, sf_dir):
    views = F.explode(F.array_compact(F.array(*[F.when(review.in_view(v), F.lit(v)) for v in _VIEWS]))).alias("view")
    rows = _jobs(spark, sf_dir).select("o_orderkey", "score", views)
    return rows.groupBy("view").agg(F.count("*").alias("records"), F.min("o_orderkey").alias("first"), F.sum("score").alias("total"))


_RANK = "(CASE recommendation WHEN 'Apply' THEN 5 WHEN 'Apply / Maybe Apply' THEN 4 WHEN 'Maybe Apply' THEN 3 WHEN 'Manual Review' THEN 2 WHEN 'Skip or Low Priority' THEN 1 ELSE 0 END)"
_ORDERS = {
    "Role Fit high to low": f"coalesce(score, 0) DESC, newest DESC, {_RANK} DESC",
    "Newest first": f"newest DESC, coalesce(score, 0) DESC, {_RANK} DESC",
    "Recommendation": f"{_RANK} DESC, coalesce(score, 0) DESC, newest DESC",
    "Company A-Z": "lower(company), coalesce(score, 0) DESC, newest",
    "Cover letter status": f"({_PACK}) DESC, coalesce(score, 0) DESC, newest DESC",
    "Tracker status": f"(NOT ({_UNTRACKED})) DESC, coalesce(score, 0) DESC, newest DESC",
}


@query("review_sorted", f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{m}' AS mode, company, o_orderkey, row_number() OVER (PARTITION BY company ORDER BY {o}, o_orderkey) AS place FROM j WHERE {_VIEWS['Recommended']}" for m, o in _ORDERS.items()))
def review_sorted(spark, sf_dir):
    """Each mode's order of the recommended records, numbered by company, so that no task holds them all."""
    rows = _jobs(spark, sf_dir).where(review.in_view("Recommended"))
    parts = [rows.select(F.lit(m).alias("mode"), "company", "o_orderkey", F.row_number().over(Window.partitionBy("company").orderBy(*review.order(m, "o_orderkey"))).cast("long").alias("place")) for m in review.MODES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("review_list", f"WITH {_ROWS} SELECT o_orderkey, company, role, score, recommendation FROM j WHERE {_VIEWS['Recommended']} AND coalesce(score, -1) >= 60 AND contains(lower(company || ' ' || role), 'high')")
def review_list(spark, sf_dir):
    return review.listed(_jobs(spark, sf_dir), "Recommended", "Newest first", "o_orderkey", 60, " HIGH ").select("o_orderkey", "company", "role", "score", "recommendation")


_SHOWN = "CASE WHEN NOT available THEN 'Not available' WHEN confidence = 'low' AND score IS NOT NULL THEN 'Provisional ' || score || '/100' WHEN confidence = 'low' THEN 'Not available' ELSE coalesce(score, 0) || '/100' END"
_LINE = f"CASE WHEN NOT available OR (confidence = 'low' AND score IS NULL) THEN 'Manual Review · Low confidence' WHEN confidence = 'low' THEN ({_SHOWN}) || ' · Manual Review · Low confidence' ELSE ({_SHOWN}) || ' · ' || recommendation || ' · ' || CASE confidence WHEN 'high' THEN 'High' ELSE 'Medium' END || ' confidence' END"


@query("review_labels", f"""WITH {_ROWS} SELECT o_orderkey, {_CURRENT} AS current, {_IGN} AS ignored, {_FULL} AS needs_text, {_SHOWN} AS role_fit,
  ({_LINE}) || CASE WHEN eligibility <> 'passed' AND first_code IS NOT NULL THEN ' · ' || CASE first_code WHEN 'minimum_experience' THEN 'Minimum Experience' ELSE 'Work Authorization' END ELSE '' END AS status_line,
  active || ' requirements · ' || coalesce(score || '% coverage', 'Coverage unavailable') || CASE WHEN {_FULL} THEN ' · API snippet' ELSE ' · Full JD' END AS evidence,
  CASE WHEN NOT available THEN 'add description' WHEN eligibility = 'failed' THEN 'review constraint' WHEN confidence = 'low' AND {_FULL} THEN 'get full description' WHEN confidence = 'low' THEN 'review requirements' WHEN company_needs_review THEN 'confirm company'
    WHEN package_status = 'No cover letter' THEN 'generate letter' WHEN tracker_status = 'Not tracked' THEN 'track' WHEN lower(tracker_status) = 'ready' THEN 'apply' ELSE 'record outcome' END AS next_action FROM j""")  # fmt: skip
def review_labels(spark, sf_dir):
    col = F.col
    full = review.needs_full_text(col("quality_ready"), col("incomplete"), col("fetched"), col("n_words"))
    return _jobs(spark, sf_dir).select(
        "o_orderkey", review.is_current_recommendation().alias("current"), review.is_ignored(col("tracker_status")).alias("ignored"), full.alias("needs_text"), review.role_fit().alias("role_fit"),
        review.status_line(col("first_code")).alias("status_line"), review.evidence_label(col("active"), col("score"), full).alias("evidence"), review.next_action(full).alias("next_action"),
    )


@query("tracker_actions", f"""WITH {_ROWS}, t AS (SELECT *, CASE WHEN applied <> '' THEN applied ELSE created END AS ref FROM j),
a AS (SELECT *, greatest(0, floor(date_diff('second', coalesce(try_strptime(left(ref, 19), '%Y-%m-%d %H:%M:%S'), try_strptime(left(ref, 16), '%Y-%m-%d %H:%M'), try_strptime(left(ref, 10), '%Y-%m-%d')), TIMESTAMP '1996-03-01 06:00:00') / 86400.0)::INT) AS age FROM t),
b AS (SELECT *, CASE WHEN try_strptime(left(ref, 10), '%Y-%m-%d') IS NULL THEN NULL ELSE age END AS age_days, lower(CASE WHEN status = '' THEN 'saved' ELSE status END) AS s FROM a)
SELECT o_orderkey, age_days, CASE WHEN s = 'saved' THEN 'review fit' WHEN s = 'ready' THEN 'apply' WHEN s = 'applied' AND coalesce(age_days >= 7, false) THEN 'follow up' WHEN s = 'applied' THEN 'wait' WHEN s = 'interview' THEN 'prepare' WHEN s = 'rejected' THEN 'learn and archive' ELSE 'archived' END AS action,
  CASE WHEN s = 'applied' AND coalesce(age_days >= 7, false) THEN age_days WHEN s = 'applied' THEN greatest(1, 7 - coalesce(age_days, 0)) END AS days, (lower(status) = 'applied' AND coalesce(age_days >= 7, false)) AS follow_up_due FROM b""")  # fmt: skip
def tracker_actions(spark, sf_dir):
    age = review.age_days(F.col("applied"), F.col("created"), F.lit("1996-03-01 06:00:00").cast("timestamp"))
    rows = _jobs(spark, sf_dir).withColumn("age_days", age)
    code, days = review.tracker_action(F.col("status"), F.col("age_days"))
    due = (F.lower("status") == "applied") & F.coalesce(F.col("age_days") >= 7, F.lit(False))
    return rows.select("o_orderkey", "age_days", code.alias("action"), days.alias("days"), due.alias("follow_up_due"))
