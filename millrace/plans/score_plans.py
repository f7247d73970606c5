"""Queries over weighted scores. Parts play the jobs: name words are the demanded keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import scoring
from millrace.plans.spec import query
from millrace.session import table


def _demands(spark, sf_dir):
    """An order is a posting, its lines the demands: ship mode-like categories from the line number and return flag."""
    lines = table(spark, sf_dir, "lineitem")
    category = F.when(F.col("l_linenumber") % 3 == 0, "methods").when(F.col("l_linenumber") % 3 == 1, "skills").otherwise("domain")
    points = F.when(category == "skills", 40).when(category == "methods", 35).otherwise(25)
    demand = F.when(F.col("l_returnflag") == "N", "preferred").otherwise("required")
    strength = scoring.match_strength(F.col("l_quantity") > 30, F.col("l_quantity") > 15)
    return lines.select("l_orderkey", category.alias("category"), points.alias("points"), demand.alias("demand"), strength.alias("strength"))


_BREAK = """d AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'methods' WHEN 1 THEN 'skills' ELSE 'domain' END AS category,
  CASE l_linenumber % 3 WHEN 1 THEN 40 WHEN 0 THEN 35 ELSE 25 END AS points, CASE WHEN l_returnflag = 'N' THEN 50 ELSE 100 END AS w,
  CASE WHEN l_quantity > 30 THEN 100 WHEN l_quantity > 15 THEN 60 ELSE 0 END AS st FROM lineitem),
b AS (SELECT l_orderkey, category, points AS possible, round_even(points * (sum(w * st / 100)::BIGINT)::DOUBLE / sum(w)::BIGINT, 1) AS earned, count(*) AS demands FROM d GROUP BY l_orderkey, category, points)"""


@query("score_breakdown", f"WITH {_BREAK} SELECT l_orderkey, category, possible, earned, demands FROM b")
def score_breakdown(spark, sf_dir):
    return scoring.breakdown(_demands(spark, sf_dir), "l_orderkey")


_FINAL = f"""{_BREAK}, c AS (SELECT l_orderkey, round_even(least(greatest(10.0::DOUBLE * sum(round_even(earned * 10, 0)::BIGINT)::BIGINT / sum(possible)::BIGINT, 0.0), 100.0), 0)::INT AS coverage, sum(demands)::BIGINT AS evidence, count(*) AS active FROM b GROUP BY l_orderkey),
f AS (SELECT c.*, o_totalprice, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 100 ELSE 0 END AS alignment FROM c JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT *, CASE WHEN alignment IS NULL THEN coverage ELSE least(coverage, round_even(0.75::DOUBLE * coverage + 0.25::DOUBLE * alignment, 0)::INT) END AS focus FROM f),
h AS (SELECT *, CASE WHEN focus > 50 THEN round_even(50 + (focus - 50) * least((evidence + (alignment IS NOT NULL)::INT) / 4.0::DOUBLE, 1.0), 0)::INT ELSE focus END AS score,
  CASE WHEN evidence < 4 THEN 'low' WHEN evidence >= 8 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'failed' WHEN o_orderpriority = '1-URGENT' THEN 'manual_review' ELSE 'passed' END AS eligibility FROM g),
r AS (SELECT *, CASE WHEN eligibility = 'failed' THEN 'Skip / Not Eligible' WHEN eligibility = 'manual_review' OR confidence = 'low' THEN 'Manual Review'
  WHEN score >= 80 THEN 'Apply' WHEN score >= 65 THEN 'Apply / Maybe Apply' WHEN score >= 50 THEN 'Maybe Apply' ELSE 'Skip or Low Priority' END AS recommendation FROM h)"""


def _final(spark, sf_dir):
    parts = scoring.coverage(scoring.breakdown(_demands(spark, sf_dir), "l_orderkey"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate")
    alignment = F.when(F.col("l_orderkey") % 4 == 0, F.lit(None)).when(F.col("l_orderkey") % 4 == 1, 100).otherwise(0)
    status, _ = scoring.eligibility(("price", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000), "failed"), ("urgent", F.col("o_orderpriority") == "1-URGENT", "manual_review"))
    out = parts.join(orders, "l_orderkey").withColumn("focus", scoring.focused(F.col("coverage"), alignment))
    out = out.withColumns({"score": scoring.calibrated(F.col("focus"), F.col("evidence"), alignment.isNotNull().cast("int")), "confidence": scoring.confidence(F.lit(100), F.col("evidence")), "eligibility": status})
    return out.withColumn("recommendation", scoring.recommendation(F.col("score"), F.col("eligibility"), F.col("confidence")))


@query("score_final", f"WITH {_FINAL} SELECT l_orderkey, coverage, focus, score, confidence, eligibility, recommendation FROM r")
def score_final(spark, sf_dir):
    return _final(spark, sf_dir).select("l_orderkey", "coverage", "focus", "score", "confidence", "eligibility", "recommendation")


@query("recommendation_counts", f"WITH {_FINAL} SELECT recommendation, confidence, count(*) AS rows, min(score) AS least, max(score) AS most FROM r GROUP BY ALL")
def recommendation_counts(spark, sf_dir):
    return _final(spark, sf_dir).groupBy("recommendation", "confidence").agg(F.count("*").alias("rows"), F.min("score").alias("least"), F.max("score").alias("most"))


_RANK = "CASE recommendation WHEN 'Apply' THEN 5 WHEN 'Apply / Maybe Apply' THEN 4 WHEN 'Maybe Apply' THEN 3 WHEN 'Manual Review' THEN 2 WHEN 'Skip or Low Priority' THEN 1 ELSE 0 END"


@query("ranked_view", f"WITH {_FINAL} SELECT l_orderkey, recommendation, score, confidence FROM r ORDER BY {_RANK} DESC, score DESC, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, l_orderkey LIMIT 100")
def ranked_view(spark, sf_dir):
    ranks = {"Apply": 5, "Apply / Maybe Apply": 4, "Maybe Apply": 3, "Manual Review": 2, "Skip or Low Priority": 1}
    rank, level = F.lit(0), F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    for name, value in ranks.items():
        rank = F.when(F.col("recommendation") == name, value).otherwise(rank)
    return _final(spark, sf_dir).orderBy(rank.desc(), F.desc("score"), level.desc(), "l_orderkey").limit(100).select("l_orderkey", "recommendation", "score", "confidence")


@query("strong_matches", f"WITH {_FINAL} SELECT o_custkey, count(*) AS strong FROM (SELECT r.*, o.o_custkey FROM r JOIN orders o ON o.o_orderkey = r.l_orderkey) WHERE eligibility = 'passed' AND confidence IN ('medium', 'high') AND recommendation = 'Apply' AND score >= 80 GROUP BY ALL")
def strong_matches(spark, sf_dir):
    strong = (F.col("eligibility") == "passed") & F.col("confidence").isin("medium", "high") & (F.col("recommendation") == "Apply") & (F.col("score") >= 80)
    return _final(spark, sf_dir).where(strong).groupBy("o_custkey").agg(F.count("*").alias("strong"))


@query("collapse_guard", "WITH v AS (SELECT event_id, event_type, user_id % 50 AS batch, CASE WHEN user_id % 50 < 10 THEN 0.001::DOUBLE ELSE value END AS score FROM events), s AS (SELECT batch, count(score) AS n, max(score) AS most, min(score) AS least FROM v GROUP BY batch) SELECT batch, count(*) AS rows, bool_or(n >= 5 AND most < 0.02 AND most - least < 0.01) AS collapsed FROM v JOIN s USING (batch) GROUP BY batch")
def collapse_guard(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("batch"), F.when(F.col("user_id") % 50 < 10, 0.001).otherwise(F.col("value")).alias("score"))
    return scoring.hidden_if_collapsed(events, "batch", "score").groupBy("batch").agg(F.count("*").alias("rows"), F.bool_or("collapsed").alias("collapsed"))
