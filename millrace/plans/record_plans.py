"""Queries over tracker tables, event logs, facets, contracts and pair similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import similarity, tracker
from millrace.plans.spec import query
from millrace.session import table

_TRACKER = """t AS (SELECT o_orderkey AS id, c_name AS company, CASE o_orderstatus WHEN 'O' THEN 'applied' WHEN 'F' THEN 'saved' ELSE 'interview' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 101)::INT END AS match_score, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'https://example.org/' || (o_orderkey % 1000) END AS job_url, NULL::VARCHAR AS applied_date FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _tracker(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "applied").when(F.col("o_orderstatus") == "F", "saved").otherwise("interview")
    return orders.select(
        k.alias("id"), F.col("c_name").alias("company"), status.alias("status"), F.when(k % 5 != 0, (k % 101).cast("int")).alias("match_score"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("https://example.org/"), (k % 1000).cast("string"))).alias("job_url"), F.lit(None).cast("string").alias("applied_date"),
    )


@query("tracker_filter_sort", f"WITH {_TRACKER} SELECT id, company, status, match_score, created_at FROM t WHERE status IN ('applied', 'interview') AND coalesce(match_score, 0) >= 40 AND lower(company) LIKE '%customer%1%' ORDER BY coalesce(match_score, -1) DESC, id DESC")
def tracker_filter_sort(spark, sf_dir):
    return tracker.rows(_tracker(spark, sf_dir), ("applied", "interview"), 40, "customer%1", "score").select("id", "company", "status", "match_score", "created_at")


@query("tracker_upsert", f"WITH {_TRACKER}, k AS (SELECT * FROM t WHERE id % 2 = 0), b AS (SELECT * FROM t WHERE id % 2 = 1), f AS (SELECT *, CASE WHEN job_url = '' THEN 1 ELSE row_number() OVER (PARTITION BY job_url ORDER BY id) END AS n FROM b WHERE job_url NOT IN (SELECT job_url FROM k WHERE job_url <> '')), g AS (SELECT *, row_number() OVER (ORDER BY id) + (SELECT max(id) FROM k) AS new_id FROM f WHERE n = 1) SELECT id, company, job_url FROM k UNION ALL SELECT new_id, company, job_url FROM g")
def tracker_upsert(spark, sf_dir):
    rows = _tracker(spark, sf_dir)
    batch = rows.where("id % 2 = 1").withColumn("batch_order", F.col("id"))
    return tracker.inserted(rows.where("id % 2 = 0"), batch).select("id", "company", "job_url")


@query("tracker_update", f"WITH {_TRACKER} SELECT id, CASE WHEN id % 10 = 3 THEN 'applied' ELSE status END AS status, CASE WHEN id % 10 = 3 THEN '2024-05-01 00:00:00' END AS applied_date FROM t")
def tracker_update(spark, sf_dir):
    return tracker.with_status(_tracker(spark, sf_dir), F.col("id") % 10 == 3, "applied", F.lit("2024-05-01 00:00:00")).select("id", "status", "applied_date")


@query("tracker_delete", f"WITH {_TRACKER} SELECT status, count(*) AS rows, min(id) AS first_id FROM t WHERE id % 10 <> 3 GROUP BY status")
def tracker_delete(spark, sf_dir):
    return tracker.without(_tracker(spark, sf_dir), F.col("id") % 10 == 3).groupBy("status").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


@query("lookup_two_tier", f"WITH {_TRACKER}, r AS (SELECT id, 'https://example.org/' || (id % 1500) AS job_url, CASE WHEN id % 3 = 0 THEN company ELSE '' END AS company FROM t), l AS (SELECT * FROM t), u AS (SELECT job_url, min(id) AS m FROM r WHERE job_url <> '' GROUP BY job_url), c AS (SELECT company, min(id) AS m FROM r WHERE company <> '' GROUP BY company) SELECT l.id, coalesce(u.m, c.m) AS match FROM l LEFT JOIN u USING (job_url) LEFT JOIN c ON c.company = l.company")
def lookup_two_tier(spark, sf_dir):
    rows = _tracker(spark, sf_dir)
    other = rows.select("id", F.concat(F.lit("https://example.org/"), (F.col("id") % 1500).cast("string")).alias("job_url"), F.when(F.col("id") % 3 == 0, F.col("company")).otherwise("").alias("company"))
    return tracker.two_tier(rows, other, "job_url", "company", "id").select("id", "match")


@query("status_summary", "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 150000) AS large_partial FROM orders")
def status_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("finished"), F.count_if((s == "P") & (F.col("o_totalprice") > 150000)).alias("large_partial"))


@query("region_facets", "SELECT CASE WHEN grouping(r_name) = 0 THEN 'r_name' WHEN grouping(n_name) = 0 THEN 'n_name' ELSE 'all' END AS level, coalesce(r_name, n_name) AS value, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), ())")
def region_facets(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tracker.facets(table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")), "r_name", "n_name")


@query("topn_per_group", "SELECT o_custkey, o_orderkey, place::INT AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2")
def topn_per_group(spark, sf_dir):
    return tracker.top_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "place")


@query("event_latest_state", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def event_latest_state(spark, sf_dir):
    return tracker.latest_states(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type", "error")


@query("seen_upsert", "SELECT user_id, event_type, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*)::BIGINT AS times FROM events GROUP BY ALL")
def seen_upsert(spark, sf_dir):
    events, keys = table(spark, sf_dir, "events"), ["user_id", "event_type"]
    old = events.where("event_id % 2 = 0").groupBy(*keys).agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"), F.count("*").alias("times"))
    return tracker.upsert_seen(old, events.where("event_id % 2 = 1").select(*keys, F.col("event_id").alias("seen")), keys, "seen")


@query("repeat_agreement", "WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT count(*) AS repeats, count(*) FILTER (a.event_type = b.event_type) AS agreed FROM f a JOIN f b ON a.user_id = b.user_id AND a.n = 1 AND b.n = 2")
def repeat_agreement(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("event_id", "event_type")).alias("a"))
    rest = table(spark, sf_dir, "events").join(first, "user_id").where(F.col("event_id") > F.col("a.event_id"))
    second = rest.groupBy("user_id").agg(F.min(F.struct("event_id", "event_type")).alias("b"), F.first("a").alias("a"))
    return second.agg(F.count("*").alias("repeats"), F.count_if(F.col("a.event_type") == F.col("b.event_type")).alias("agreed"))


@query("data_contracts", "SELECT unnest(['text', 'lang', 'id', 'length']) AS rule, unnest([count(*) FILTER (NOT coalesce(length(trim(text)) > 0, false)), count(*) FILTER (NOT coalesce(lang IN ('en', 'de', 'fr'), false)), count(*) FILTER (NOT coalesce(doc_id >= 0, false)), count(*) FILTER (NOT coalesce(n_chars = length(text), false))]) AS violations FROM documents")
def data_contracts(spark, sf_dir):
    rules = {"text": F.length(F.trim("text")) > 0, "lang": F.col("lang").isin("en", "de", "fr"), "id": F.col("doc_id") >= 0, "length": F.col("n_chars") == F.length("text")}
    return tracker.violations(table(spark, sf_dir, "documents"), rules)


_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_+#.-]*[\\p{{L}}\\p{{N}}_]')"
_TURNS = f"""p AS (SELECT a.conv_id, a.turn, {_TOK.format(c='a.text')} AS l, {_TOK.format(c='b.text')} AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
d AS (SELECT *, list_distinct(l) AS dl, list_distinct(r) AS dr, list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS bl, list_distinct(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS br FROM p)"""


def _jac(a: str, b: str) -> str:
    return f"round_even(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END, 6)"


@query("pair_features", f"""WITH {_TURNS} SELECT conv_id, turn, {_jac('dl', 'dr')} AS jaccard, round_even(CASE WHEN len(dr) = 0 THEN 0 ELSE len(list_intersect(dl, dr))::DOUBLE / len(dr) END, 6) AS right_share, round_even(CASE WHEN len(dl) = 0 THEN 0 ELSE len(list_intersect(dl, dr))::DOUBLE / len(dl) END, 6) AS left_share,
  {_jac('bl', 'br')} AS bigram_jaccard, round_even(CASE WHEN greatest(len(l), len(r)) = 0 THEN 0 ELSE least(len(l), len(r))::DOUBLE / greatest(len(l), len(r)) END, 6) AS length_ratio, round_even(ln(1 + len(l)::DOUBLE), 6) AS log_left, round_even(ln(1 + len(r)::DOUBLE), 6) AS log_right FROM d""")
def pair_features(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("left_text"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("left_text").alias("right_text"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", similarity.pair_features(F.col("left_text"), F.col("right_text")).alias("f")).select("conv_id", "turn", "f.*")


@query("tfidf_cosine", f"""WITH t AS (SELECT item_id, unnest({_TOK.format(c='text')}) AS term FROM benchmark), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark),
i AS (SELECT term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM f, n GROUP BY term, n), w AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM f JOIN i USING (term)), v AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w),
c AS (SELECT a.item_id, b.item_id AS other_id, round_even(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, other_id) AS r FROM c) SELECT item_id, other_id, cosine FROM k WHERE r = 1""")
def tfidf_cosine(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    terms = similarity.term_rows(items, "item_id", "text")
    vectors = similarity.weighted(terms, similarity.inverse_frequencies(terms, items.count()), "item_id")
    pairs = similarity.cosines(vectors, vectors.withColumnRenamed("item_id", "other_id"), "item_id", "other_id").where("item_id <> other_id")
    return similarity.best_cosine(pairs, "item_id", "other_id")
