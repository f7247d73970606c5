"""Queries over reviewed tasks made of orders and their lines, and over expected results. The SQL states labels and limits anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import datasets
from millrace.plans.spec import query
from millrace.session import table

_LABEL = "CASE WHEN o_orderkey % 5 < 2 THEN 'Direct' WHEN o_orderkey % 5 = 2 THEN 'Partial' ELSE 'No Support' END"
_REQUIREMENT = "CASE WHEN o_custkey % 4 = 0 THEN ' Must  have ' ELSE 'Wants ' END || o_orderpriority || ' Delivery by ' || o_orderstatus"


def _pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), F.expr(_LABEL).alias("support_label"), F.expr("CAST(o_custkey % 4 + 1 AS INT)").alias("selected_candidate_id"), F.expr(_REQUIREMENT).alias("requirement"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("candidate_id"), F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("evidence"))
    return datasets.training_pairs(tasks, lines)


_PAIRS = f"""t AS (SELECT o_orderkey AS task_id, {_LABEL} AS support_label, (o_custkey % 4 + 1)::INT AS selected, array_to_string(list_slice(string_split_regex(trim(regexp_replace(lower({_REQUIREMENT}), '\\s+', ' ', 'g')), ' '), 1, 3), ' ') AS template_group FROM orders),
j AS (SELECT t.*, l_linenumber AS candidate_id, l_returnflag || ' ' || l_linestatus AS evidence, CASE WHEN support_label = 'No Support' THEN 0 ELSE 1 END AS binary_label FROM t JOIN lineitem ON l_orderkey = task_id WHERE support_label = 'No Support' OR l_linenumber = selected),
p AS (SELECT substr(sha256(task_id || ':' || candidate_id || ':' || binary_label), 1, 16) AS pair_id, task_id, candidate_id, evidence, binary_label, support_label, CASE binary_label WHEN 1 THEN 'selected_best_evidence' ELSE 'no_support_task_candidate' END AS label_scope, template_group FROM j)"""


@query("training_pairs", f"WITH {_PAIRS} SELECT * FROM p")
def training_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("dataset_label_counts", f"WITH {_PAIRS} SELECT support_label, binary_label, label_scope, count(*) AS pairs, count(DISTINCT task_id) AS tasks, count(DISTINCT template_group) AS template_groups FROM p GROUP BY ALL")
def dataset_label_counts(spark, sf_dir):
    return datasets.label_counts(_pairs(spark, sf_dir))


_STATUS = "CASE {0} % {1} WHEN 0 THEN 'failed' WHEN 1 THEN 'review' ELSE 'passed' END"
_LEVEL = "CASE {0} % {1} WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"
_ADVICE = "CASE WHEN {0} % {1} >= 3 THEN 'Apply' WHEN {0} % {1} = 1 THEN 'Maybe' ELSE 'Skip' END"
_CASES = {
    "family": "o_orderpriority",
    "score": "CAST(o_orderkey % 101 AS INT)",
    "eligibility": _STATUS.format("o_custkey", 7),
    "confidence": _LEVEL.format("o_custkey", 3),
    "recommendation": _ADVICE.format("o_orderkey", 5),
}
_EXPECTED = {
    "low": "CAST(o_custkey % 60 AS INT)",
    "high": "CAST(o_custkey % 60 + 40 AS INT)",
    "eligibility": _STATUS.format("o_custkey", 5),
    "confidence": _LEVEL.format("o_orderkey", 3),
    "recommendation": _ADVICE.format("o_orderkey", 6),
}


@query("score_agreement", f"""
WITH c AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _CASES.items())}, {', '.join(f'{v} AS x_{k}' for k, v in _EXPECTED.items())} FROM orders),
a AS (SELECT family, grouping(family)::INT AS overall, count(*) AS total, count(*) FILTER (score BETWEEN x_low AND x_high) AS score_agreed, count(*) FILTER (eligibility = x_eligibility) AS eligibility_agreed,
count(*) FILTER (confidence = x_confidence) AS confidence_agreed, count(*) FILTER (recommendation = x_recommendation) AS recommendation_agreed, count(*) FILTER (x_eligibility = 'failed' AND eligibility <> 'failed') AS hard_constraint_false_negatives,
count(*) FILTER (score >= 80 AND recommendation = 'Apply' AND (x_eligibility <> 'passed' OR x_recommendation <> 'Apply')) AS unsafe_high_scores FROM c GROUP BY ROLLUP (family))
SELECT *, {', '.join(f"round_even({k}_agreed * 100 / total::DOUBLE, 6) AS {k}_rate" for k in ("score", "eligibility", "confidence", "recommendation"))} FROM a""")
def score_agreement(spark, sf_dir):
    fields = [F.expr(v).alias(k) for k, v in _CASES.items()]
    return datasets.agreement(table(spark, sf_dir, "orders").select(*fields, F.struct(*[F.expr(v).alias(k) for k, v in _EXPECTED.items()]).alias("expected")))
