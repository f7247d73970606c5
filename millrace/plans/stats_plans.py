"""Queries over agreement, association and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics
from millrace.plans.spec import query
from millrace.session import table


@query("cramers_v", """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT a, sum(n) AS na FROM c GROUP BY a), r AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
s AS (SELECT sum(n * n / (na * nb)::DOUBLE) AS s FROM c JOIN l USING (a) JOIN r USING (b)), z AS (SELECT (SELECT count(*) FROM l) AS r, (SELECT count(*) FROM r) AS k, (SELECT sum(n) FROM c)::DOUBLE AS n),
p AS (SELECT n, greatest(0, s - 1 - (k - 1) * (r - 1) / (n - 1)) AS phi, r - (r - 1) * (r - 1) / (n - 1) AS rc, k - (k - 1) * (k - 1) / (n - 1) AS kc FROM s, z)
SELECT n::BIGINT AS n, round_even(CASE WHEN n < 2 OR least(rc, kc) <= 1 THEN 0 ELSE sqrt(phi / (least(rc, kc) - 1)) END, 6) AS v FROM p""")
def cramers_v(spark, sf_dir):
    return metrics.cramers_v(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("fleiss_kappa", """
WITH c AS (SELECT l_orderkey AS s, l_returnflag AS r, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT s, sum(n) AS m, sum(n * (n - 1)) AS a FROM c GROUP BY s HAVING sum(n) >= 2),
p AS (SELECT r, sum(n) AS c FROM c JOIN m USING (s) GROUP BY r), e AS (SELECT sum(c * c)::DOUBLE / (sum(c) * sum(c)) AS pe FROM p), o AS (SELECT count(*) AS subjects, avg(a::DOUBLE / (m * (m - 1))) AS po FROM m)
SELECT subjects, CASE WHEN pe < 1 THEN round_even((po - pe) / (1 - pe), 6) END AS kappa FROM o, e""")
def fleiss_kappa(spark, sf_dir):
    return metrics.fleiss_kappa(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("consensus_routing", """
WITH c AS (SELECT l_orderkey, l_returnflag AS r, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, sum(n)::BIGINT AS raters, max(n) AS top FROM c GROUP BY l_orderkey),
d AS (SELECT m.*, (SELECT min(r) FROM c WHERE c.l_orderkey = m.l_orderkey AND c.n = m.top) AS decision, round_even(top / raters::DOUBLE, 4) AS share FROM m)
SELECT l_orderkey, raters, decision, share, CASE WHEN raters < 3 THEN 'needs_reviewers' WHEN share >= 0.75 THEN 'accepted' ELSE 'human_review' END AS status FROM d""")
def consensus_routing(spark, sf_dir):
    return metrics.consensus(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


_SCORED = "e AS (SELECT d.lang, l.quality AS label, (d.n_chars % 97) / 97.0::DOUBLE AS score, CASE WHEN d.n_chars % 97 >= 40 THEN 1 ELSE 0 END AS predicted FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)"


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality IS NOT NULL")
    rest = F.col("n_chars") % 97
    return docs.select("lang", F.col("quality").alias("label"), (rest / 97.0).alias("score"), F.when(rest >= 40, 1).otherwise(0).alias("predicted"))


def _over(x: str, y: str) -> str:
    return f"round_even(coalesce(({x})::DOUBLE / nullif({y}, 0), 0), 6)"


@query("binary_metrics", f"""WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 1 AND predicted = 0) AS fn FROM e GROUP BY lang)
SELECT *, {_over('tp + tn', 'tp + fp + tn + fn')} AS accuracy, round_even((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, {_over('tp', 'tp + fp')} AS precision, {_over('tp', 'tp + fn')} AS recall, {_over('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""")
def binary_metrics(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "label", "predicted", ["lang"])


_AT = f"""{_SCORED}, c AS (SELECT lang, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM e GROUP BY ALL),
a AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS n FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("ranking_by_group", f"WITH {_AT} SELECT lang, any_value(p)::BIGINT AS positives, any_value(n)::BIGINT AS negatives, round_even(sum((tp - pos / 2.0::DOUBLE) * neg) / any_value(p) / any_value(n), 6) AS auc, round_even(sum(pos * tp / (tp + fp)::DOUBLE) / any_value(p), 6) AS average_precision FROM a WHERE p > 0 AND n > 0 GROUP BY lang")
def ranking_by_group(spark, sf_dir):
    return metrics.ranking(_scored(spark, sf_dir), "label", "score", ["lang"])


@query("f1_threshold", f"WITH {_AT}, f AS (SELECT lang, score, round_even(2 * tp / (tp + fp + p)::DOUBLE, 9) AS f1 FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score) AS k FROM f) SELECT lang, score AS threshold, round_even(f1, 6) AS f1 FROM r WHERE k = 1")
def f1_threshold(spark, sf_dir):
    return metrics.f1_threshold(_scored(spark, sf_dir), "label", "score", ["lang"])


@query("retrieval_metrics", """
WITH r AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AS gold, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT o_custkey, min(rank) AS rank FROM r WHERE gold GROUP BY o_custkey)
SELECT count(*) AS queries, round_even(avg((rank <= 1)::INT::DOUBLE), 6) AS recall_1, round_even(avg((rank <= 3)::INT::DOUBLE), 6) AS recall_3, round_even(avg(1.0::DOUBLE / rank), 6) AS mrr FROM f""")
def retrieval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("gold", F.col("o_orderpriority") == "1-URGENT")
    return metrics.retrieval(rows, "o_custkey", "gold", "o_totalprice", "o_orderkey")


@query("position_bias_audit", """
WITH c AS (SELECT event_type, user_id % 4 AS v, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT event_type, sum(n)::BIGINT AS rows, max(n) AS top FROM c GROUP BY event_type)
SELECT event_type, rows, (SELECT min(v) FROM c WHERE c.event_type = m.event_type AND c.n = m.top) AS value, round_even(top / rows::DOUBLE, 4) AS share, round_even(top / rows::DOUBLE, 4) > 0.35 AS warning FROM m""")
def position_bias_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("position", F.col("user_id") % 4)
    return metrics.largest_share(rows, ["event_type"], "position", 0.35)
