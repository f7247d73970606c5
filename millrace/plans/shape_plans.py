"""Queries over record shaping, merged candidates and facet options."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import experience, records, views
from millrace.plans.spec import query
from millrace.session import table


@query("salary_text", """
SELECT p_partkey, CASE WHEN p_retailprice IS NOT NULL AND p_retailprice <> 0 AND hi IS NOT NULL AND hi <> 0 THEN round_even(p_retailprice, 0)::BIGINT || ' - ' || round_even(hi, 0)::BIGINT
  WHEN p_retailprice IS NOT NULL AND p_retailprice <> 0 THEN 'from ' || round_even(p_retailprice, 0)::BIGINT WHEN hi IS NOT NULL AND hi <> 0 THEN 'up to ' || round_even(hi, 0)::BIGINT ELSE '' END AS salary
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 700)::DOUBLE END AS p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 900)::DOUBLE END AS hi FROM part)""")
def salary_text(spark, sf_dir):
    k = F.col("p_partkey")
    low, high = F.when(k % 5 != 0, (k % 700).cast("double")), F.when(k % 3 != 0, (k % 900).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", records.salary_range(low, high).alias("salary"))


@query("required_years", """
WITH l AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '') || E'\\n' || (doc_id % 12) || ' years of work' || CASE WHEN doc_id % 2 = 0 THEN ' preferred' ELSE '' END), chr(10))) AS line FROM documents),
y AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(line, '([0-9]+(?:\\.[0-9]+)?)\\+? years?', 1), lambda x: x::DOUBLE)) AS y FROM l WHERE NOT contains(line, 'preferred') AND NOT contains(line, 'plus') AND NOT contains(line, 'nice to have')),
m AS (SELECT d.doc_id, max(y) AS years FROM documents d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, years, CASE WHEN years >= 5 THEN 'senior' WHEN years >= 3 THEN 'mid' WHEN years >= 0 THEN 'entry' END AS level FROM m""")
def required_years(spark, sf_dir):
    k = F.col("doc_id")
    line = F.concat(F.lit("\n"), (k % 12).cast("string"), F.lit(" years of work"), F.when(k % 2 == 0, " preferred").otherwise(""))
    years = experience.required_years(F.concat(F.coalesce("text", F.lit("")), line))
    return table(spark, sf_dir, "documents").select("doc_id", years.alias("years")).withColumn("level", experience.level(F.col("years")))


@query("merged_candidates", """
WITH c AS (SELECT c_nationkey, c_custkey AS pos, 'Segment ' || c_mktsegment AS name, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, 'src' || c_custkey % 2 AS evidence FROM customer),
k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9&.+#\\-]+', ' ', 'g')) AS key, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS s FROM c),
e AS (SELECT c_nationkey, key, evidence, min(pos) AS first_pos FROM k GROUP BY ALL), x AS (SELECT c_nationkey, key, string_agg(evidence, ',' ORDER BY first_pos) AS evidence FROM e GROUP BY ALL),
b AS (SELECT c_nationkey, key, name, confidence, count(*) OVER (PARTITION BY c_nationkey, key) AS sources, row_number() OVER (PARTITION BY c_nationkey, key ORDER BY s DESC, pos) AS n FROM k)
SELECT b.c_nationkey, b.key, name, confidence, evidence, sources FROM b JOIN x USING (c_nationkey, key) WHERE n = 1""")
def merged_candidates(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", k.alias("pos"), F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("name"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"), F.concat(F.lit("src"), (k % 2).cast("string")).alias("evidence"))
    merged = views.merged_candidates(rows, text.company_key(F.col("name")), ["high", "medium", "low"], ["c_nationkey"])
    return merged.withColumn("evidence", F.array_join("evidence", ","))


@query("filtered_view", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'o' AND coalesce(o_totalprice >= 1000, false) AND NOT coalesce(o_orderkey % 9 = 0, false) AND contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus)), 'high')")
def filtered_view(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("hide", F.col("o_orderkey") % 9 == 0)
    return views.filtered(orders, {"o_orderstatus": "o", "o_orderpriority": None}, {"o_totalprice": 1000}, ["hide"], "HIGH", ["o_orderpriority", "o_orderstatus"]).select("o_orderkey")


@query("facet_options", "WITH c AS (SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name), f AS (SELECT value, n, list_position(['FRANCE', 'CHINA'], value) AS f FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(f, 0) = 0 ORDER BY n DESC, value) AS b FROM f) SELECT value, n, (CASE WHEN coalesce(f, 0) > 0 THEN f ELSE 2 + b END)::INT AS place FROM r WHERE coalesce(f, 0) > 0 OR b <= 5")
def facet_options(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("value")).agg(F.count("*").alias("n"))
    return views.option_order(counts, ["FRANCE", "CHINA"])
