"""Queries over texts and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import keys, text, urls
from millrace.operators import extract, postings
from millrace.plans.fit_plans import QUALITY
from millrace.plans.spec import query
from millrace.session import table

#: A catalog that fits the test prose: frequent function words stand in for skills.
CATALOG = {"the": ("der", "die"), "of": ("de",), "license": ("licensed",), "that": (), "und": (), "is": ("ist", "est")}
PREFERRED = ("for", "with", "avec", "mit")
HEADINGS = {"legal": ("license", "licensed under cc by-nc 4.0."), "list": ("to.", "the.", "and.")}


def _norm(keep: str) -> str:
    return f"trim(regexp_replace(lower(coalesce(text, '')), '[^{keep}]+', ' ', 'g'))"


_COLLAPSE = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' ')"


@query("norm_variants", f"""
SELECT doc_id, sha256({_norm(text.KEEP['search'])}) AS search_sha, sha256({_norm(text.KEEP['identity'])}) AS identity_sha,
  sha256(' ' || {_norm(text.KEEP['fit'])} || ' ') AS fit_sha, sha256(' ' || {_norm(text.KEEP['path'])} || ' ') AS path_sha,
  sha256(' ' || {_norm(text.KEEP['keyword'])} || ' ') AS keyword_sha, sha256({_norm(text.KEEP['company'])}) AS company_sha
FROM documents""")  # fmt: skip
def norm_variants(spark, sf_dir):
    c = F.col("text")
    made = {"search_sha": text.search_text(c), "identity_sha": text.identity_text(c), "fit_sha": text.fit_text(c), "path_sha": text.path_text(c), "keyword_sha": text.keyword_text(c), "company_sha": text.company_key(c)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.sha2(v, 256).alias(k) for k, v in made.items()])


@query("norm_fingerprints", f"""
SELECT doc_id, sha256(coalesce(text, '')) AS exact_sha, sha256(lower({_COLLAPSE.format(c='text')})) AS normalized_sha,
  sha256(coalesce(text, '') || chr(0) || coalesce(source, '')) AS pair_sha FROM documents""")
def norm_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.sha(F.col("text")).alias("exact_sha"), keys.normalized_sha(F.col("text")).alias("normalized_sha"), keys.pair_hash(F.col("text"), F.col("source")).alias("pair_sha"))


@query("slug_and_title", """
SELECT o_orderkey, coalesce(nullif(lower(trim(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]+', '_', 'g'), '_')), ''), 'unknown') AS slug,
  replace(trim(regexp_replace(lower(replace(o_orderpriority, '_', ' ')), '\\s+', ' ', 'g')), ' ', '_') AS source_key,
  CASE WHEN length(o_clerk) > 12 THEN rtrim(substr(o_clerk, 1, 9)) || '...' ELSE o_clerk END AS short
FROM (SELECT *, 'Clerk#' || lpad(o_custkey::VARCHAR, 9, '0') AS o_clerk FROM orders)""")
def slug_and_title(spark, sf_dir):
    clerk = F.concat(F.lit("Clerk#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.slug(F.col("o_orderpriority")).alias("slug"), text.source_key(F.col("o_orderpriority")).alias("source_key"), text.shortened(clerk, 12).alias("short"))


_ENT = "coalesce(html, '')"
for _e, _c in text.ENTITIES.items():
    _ENT = "replace({}, '{}', '{}')".format(_ENT, _e, _c.replace("'", "''"))


@query("pages_clean_text", f"""
SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha FROM (
  SELECT page_id, trim(regexp_replace(replace(regexp_replace({_ENT}, '<[^>]+>', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g')) AS t FROM pages)""")
def pages_clean_text(spark, sf_dir):
    t = text.clean_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("text_sha"))


def _kept(q: str, names: str) -> str:
    """SQL of a query string without the named parameters, as a form would write it."""
    dec = "url_decode(replace({}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    key, value = dec.format("split_part(p, '=', 1)"), dec.format("CASE WHEN contains(p, '=') THEN regexp_replace(p, '^[^=]*=', '') ELSE '' END")
    return f"array_to_string(list_transform(list_filter(string_split({q}, '&'), lambda p: p <> '' AND lower({key}) NOT IN ({names})), lambda p: {enc(key)} || '=' || {enc(value)}), '&')"


_SAVED = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'app_id', 'app_key', 'aztt'"
_HISTORY = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'app_id', 'app_key', 'aztt'"
#: Four addresses of each page: its own, with credentials and tracking, of an ad host, and without a scheme.
_ADDRESSES = """SELECT page_id, 0 AS kind, url FROM pages UNION ALL
SELECT page_id, 1 AS kind, url || '//a/?App_Key=s3cret&ref=x%20y&utm_source=n&empty&q=a+b~c*&gclid=' || page_id || '#top' AS url FROM pages UNION ALL
SELECT page_id, 2 AS kind, 'HTTPS://www.Adzuna.co.uk/land/ad/' || page_id || '?se=1&utm_medium=x#f' AS url FROM pages UNION ALL
SELECT page_id, 3 AS kind, ' Example.com//Jobs/' || page_id || '/?msclkid=1&id=' || page_id AS url FROM pages"""


@query("url_canonical", f"""
WITH u AS ({_ADDRESSES}),
p AS (SELECT *, trim(coalesce(url, '')) AS c, ltrim(coalesce(url, '')) AS l FROM u),
g AS (SELECT *, regexp_extract(c, '^((?:[A-Za-z][A-Za-z0-9+.-]*:)?)((?://[^/?#]*)?)([^?#]*)', 1) AS s, regexp_extract(c, '^((?:[A-Za-z][A-Za-z0-9+.-]*:)?)((?://[^/?#]*)?)([^?#]*)', 2) AS h,
  regexp_extract(c, '^((?:[A-Za-z][A-Za-z0-9+.-]*:)?)((?://[^/?#]*)?)([^?#]*)', 3) AS pa, regexp_extract(l, '^((?:[A-Za-z][A-Za-z0-9+.-]*:)?)((?://[^/?#]*)?)([^?#]*)', 3) AS lpa,
  regexp_extract(c, '\\?([^#]*)', 1) AS q, regexp_extract(l, '\\?([^#]*)', 1) AS lq, regexp_extract(l, '#(.*)$', 1) AS f, lower(regexp_extract(c, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM p),
k AS (SELECT *, {_kept('q', _HISTORY)} AS hq, {_kept('lq', _SAVED)} AS sq FROM g)
SELECT page_id, kind,
  lower(s) || CASE WHEN h = '//' THEN '' ELSE lower(h) END || regexp_replace(regexp_replace(pa, '/+$', ''), '/{{2,}}', '/', 'g') || CASE WHEN hq = '' THEN '' ELSE '?' || hq END AS canonical_url,
  CASE WHEN contains(lower(h), 'adzuna.') AND regexp_matches(pa, '^/land/ad/[0-9]+') THEN lower(s) || h || '/details/' || regexp_extract(pa, '^/land/ad/([0-9]+)', 1)
    ELSE lower(s) || CASE WHEN h = '//' THEN '' ELSE h END || lpa || CASE WHEN sq = '' THEN '' ELSE '?' || sq END || CASE WHEN f = '' THEN '' ELSE '#' || f END END AS sanitized_url,
  (c = '' OR (lower(s) IN ('http:', 'https:') AND host <> '')) AS valid,
  coalesce(list_filter(string_split(host, '.'), lambda x: x NOT IN ({", ".join(repr(x) for x in urls.GENERIC_HOSTS)}))[1], '') AS company
FROM k""")
def url_canonical(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    made = (
        F.col("url"),
        F.concat("url", F.lit("//a/?App_Key=s3cret&ref=x%20y&utm_source=n&empty&q=a+b~c*&gclid="), "page_id", F.lit("#top")),
        F.concat(F.lit("HTTPS://www.Adzuna.co.uk/land/ad/"), "page_id", F.lit("?se=1&utm_medium=x#f")),
        F.concat(F.lit(" Example.com//Jobs/"), "page_id", F.lit("/?msclkid=1&id="), "page_id"),
    )
    u = F.col("url")
    rows = pages.select("page_id", F.posexplode(F.array(*made)).alias("kind", "url"))
    return rows.select("page_id", "kind", urls.canonical(u).alias("canonical_url"), urls.sanitized(u).alias("sanitized_url"), urls.is_valid(u).alias("valid"), urls.company_label(u).alias("company"))


_TOK = f"regexp_extract_all(lower(coalesce(text, '')), '{text.TOKEN}')"


@query("token_stats", f"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct,
  len(list_distinct(list_filter(list_transform(t, lambda x: trim(x, '.-')), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'der'))))::BIGINT AS n_terms
FROM (SELECT doc_id, {_TOK} AS t FROM documents)""")
def token_stats(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(c)).cast("long").alias("n_tokens"), F.size(F.array_distinct(text.tokens(c))).cast("long").alias("n_distinct"), F.size(text.distinct_terms(c, ("the", "and", "der"), 3)).cast("long").alias("n_terms"))


_DOCS = "pairs AS (SELECT doc_id, lang, coalesce(text, '') AS job FROM documents)"


def _judged(spark, sf_dir):
    q = F.col("quality")
    docs = postings.quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text")
    return docs.select("doc_id", "lang", *[q[n].alias(n) for n in ("n_words", "requirements", "responsibilities", "truncated", "label", "score")], F.round(q["boilerplate"], 9).alias("boilerplate"))


@query("quality_features", f"WITH {_DOCS}, {QUALITY} SELECT doc_id, n_words, requirements, responsibilities, truncated, label, quality_score AS score, round(boilerplate, 9) AS boilerplate FROM z")
def quality_features(spark, sf_dir):
    return _judged(spark, sf_dir).drop("lang")


@query("quality_by_lang", f"WITH {_DOCS}, {QUALITY} SELECT lang, label, count(*) AS docs, sum(n_words)::BIGINT AS words, min(quality_score) AS least_score, max(quality_score) AS most_score FROM z GROUP BY lang, label")
def quality_by_lang(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("lang", "label").agg(F.count("*").alias("docs"), F.sum("n_words").alias("words"), F.min("score").alias("least_score"), F.max("score").alias("most_score"))


def _alias(a: str, c: str = "k") -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9]){a}([^a-z0-9]|$)')" if len(a) <= 2 else f"contains({c}, ' {a} ')"


def _any(aliases, c="k") -> str:
    return " OR ".join(_alias(a, c) for a in aliases)


_KEYWORD = "' ' || trim(regexp_replace(lower({c}), '[^a-z0-9+#]+', ' ', 'g')) || ' '"
_MATCH = "' ' || trim(regexp_replace(replace(lower({c}), '-', ' '), '\\s+', ' ', 'g')) || ' '"


@query("keyword_hits", "WITH d AS (SELECT doc_id, " + _KEYWORD.format(c="coalesce(text, '')") + " AS k FROM documents)\n" + " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) AS docs, min(doc_id) AS first_doc FROM d WHERE {_any([k, *a])}" for k, a in CATALOG.items()))
def keyword_hits(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.keywords(F.col("text"), CATALOG)).alias("keyword"))
    return found.groupBy("keyword").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


_LINES = """l AS (SELECT doc_id, pos, trim(regexp_replace(raw, '^[\\s\\-•]+', '')) AS line FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
  WHERE trim(regexp_replace(raw, '^[\\s\\-•]+', '')) <> '')"""


@query("keyword_demands", "WITH " + _LINES + ", d AS (SELECT doc_id, " + _KEYWORD.format(c="line") + " AS k, " + _MATCH.format(c="line") + " AS m FROM l), h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS keyword, ({_any(PREFERRED, 'm')}) AS wish FROM d WHERE {_any([k, *a])}" for k, a in CATALOG.items()) + """)
SELECT keyword, demand, count(*) AS docs FROM (SELECT doc_id, keyword, CASE WHEN bool_or(wish) THEN 'preferred' ELSE 'required' END AS demand FROM h GROUP BY ALL) GROUP BY ALL""")
def keyword_demands(spark, sf_dir):
    rows = extract.lines(table(spark, sf_dir, "documents"))
    return extract.demands(rows, CATALOG, PREFERRED).groupBy("keyword", "demand").agg(F.count("*").alias("docs"))


@query("keyword_rows", "WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9+#]+', ' ', 'g')), ' '))) AS a FROM documents), c(keyword, a) AS (VALUES ('the', 'the'), ('the', 'der'), ('of', 'of'), ('of', 'de')) SELECT DISTINCT doc_id, keyword FROM t JOIN c USING (a)")
def keyword_rows(spark, sf_dir):
    aliases = spark.createDataFrame([("the", "the"), ("the", "der"), ("of", "of"), ("of", "de")], "keyword string, alias string")
    return extract.keyword_rows(table(spark, sf_dir, "documents"), aliases)


@query("section_lines", "WITH " + _LINES + ", o AS (SELECT *, CASE " + " ".join(f"WHEN n IN ({', '.join(repr(x) for x in names)}) THEN '{s}'" for s, names in reversed(HEADINGS.items())) + " END AS opened FROM (SELECT *, lower(rtrim(regexp_replace(line, '^#+\\s*', ''), ': ')) AS n FROM l)), c AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM o) SELECT doc_id, section, count(*) AS lines, min(pos)::INT AS first_pos FROM c WHERE opened IS NULL AND section IS NOT NULL GROUP BY ALL")
def section_lines(spark, sf_dir):
    rows = extract.sections(extract.lines(table(spark, sf_dir, "documents")), HEADINGS)
    return rows.where("section IS NOT NULL").groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.min("pos").alias("first_pos"))


@query("contact_findings", "WITH " + _LINES + ", f AS (" + " UNION ALL ".join("SELECT doc_id, pos, '{}' AS kind, unnest(regexp_extract_all(line, '{}')) AS found FROM l".format(k, p.replace("'", "''")) for k, p in (("email", text.EMAIL), ("url", text.URL), ("phone", text.PHONE))) + ") SELECT doc_id, pos::INT AS pos, kind, found FROM f WHERE kind <> 'phone' OR (length(regexp_replace(found, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND regexp_matches(found, '[ +()./-]'))")
def contact_findings(spark, sf_dir):
    return extract.contacts(extract.lines(table(spark, sf_dir, "documents")))


SIGNALS = {"english": {" the ": 3, " of ": 2, " and ": 2}, "german": {" der ": 3, " und ": 2, "sch": 2}, "french": {" le ": 2, " les ": 2, "eau": 3}, "spanish": {"ción": 4, " los ": 2}}


def _sum(weights) -> str:
    return " + ".join(f"(CASE WHEN contains(t, '{p}') THEN {w} ELSE 0 END)" for p, w in weights.items())


@query("signal_argmax", "WITH s AS (SELECT doc_id, " + ", ".join(f"{_sum(w)} AS {n}" for n, w in SIGNALS.items()) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)), b AS (SELECT *, greatest(" + ", ".join(SIGNALS) + ") AS best FROM s) SELECT doc_id, CASE WHEN best >= 4 THEN CASE " + " ".join(f"WHEN {n} = best THEN '{n}'" for n in SIGNALS) + " END END AS profile FROM b")
def signal_argmax(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extract.profile(F.col("text"), SIGNALS).alias("profile"))


RULES = {"licensed": ("license", "licen"), "secret": ("token =", "api_key", "password"), "contact": ("@",)}


@query("red_flags", "SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in ps) + f" THEN '{k}' END" for k, ps in RULES.items()) + "], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def red_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extract.flags(F.col("text"), RULES), ",").alias("flags"))


@query("text_search", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'the') AND contains(lower(concat_ws(' ', text, source)), 'src1')")
def text_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(extract.matches_query("the SRC1", F.col("text"), F.col("source"))).select("doc_id", "lang", "source")
