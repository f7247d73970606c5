"""Queries that score postings and candidates. The SQL states limits and weights anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vocabulary as v
from millrace.operators import fit, postings
from millrace.plans.inputs import PAIRS, pairs
from millrace.plans.spec import query


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _norm(c: str) -> str:
    return f"(' ' || regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9+#-]+', ' ', 'g') || ' ')"


def _alias(a: str, c: str) -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9]){a}([^a-z0-9]|$)')" if len(a) <= 2 and a.isalnum() else f"contains({c}, {_q(' ' + a + ' ')})"


def _any(aliases, c: str) -> str:
    return "(" + " OR ".join(_alias(a, c) for a in aliases) + ")"


def _named(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(a, c)} THEN {_q(k)} END" for k, a in v.KEYWORDS.items()) + "], lambda x: x IS NOT NULL)"


def _tenth(x: str) -> str:
    return f"((floor({x} * 10) + CASE WHEN ({x} * 16 - (2 * floor({x} * 10) + 1)) + {x} * 4 > 0 OR (({x} * 16 - (2 * floor({x} * 10) + 1)) + {x} * 4 = 0 AND floor({x} * 10) % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE)"


def _first(cases) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases)


_STRIP = "regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
_BODY = "CASE WHEN regexp_matches(job, '(?im)^##\\s+Job Description\\s*$') THEN regexp_replace(job, '(?is)^.*?\\n##\\s+Job Description[^\\S\\n]*\\n', '') ELSE job END"


def _field(label: str) -> str:
    return f"lower(trim(regexp_extract(job, '(?im)^{label}:\\s*(\\S.*?)\\s*$', 1)))"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {_q(pattern)})"


_WORDS = "len(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]([\\p{{L}}\\p{{N}}_+#.-]*[\\p{{L}}\\p{{N}}_])?'))"
_SPLIT = "len(regexp_extract_all({c}, '\\S+'))"
QUALITY = f"""
b AS (SELECT *, {_STRIP.format(c=_BODY)} AS body, {_field('Source')} AS source, {_field('Description Source')} AS described, {_field('JD Fetch Status')} AS fetched FROM pairs),
u AS (SELECT *, {_WORDS.format(c='body')}::BIGINT AS n_words,
  list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' -*•' || chr(9))), lambda x: x <> ''), lambda x: string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)))), lambda x: trim(x)), lambda x: x <> '') AS units FROM b),
f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_has('body', '(?im)^[ \\t]*(?:#+[ \\t]*)?(?:' + p + ')[ \\t]*:?[ \\t]*$')} THEN '{n}' END" for n, p in v.SECTIONS.items())}], lambda x: x IS NOT NULL) AS sections,
  len(list_filter(units, lambda x: {_has('x', v.REQUIREMENT_SIGNALS)}))::BIGINT AS requirements, len(list_filter(units, lambda x: {_has('x', v.RESPONSIBILITY_SIGNALS)}))::BIGINT AS responsibilities,
  coalesce(list_sum(list_transform(list_filter(units, lambda x: {_has('x', v.BOILERPLATE_SIGNALS)}), lambda x: {_SPLIT.format(c='x')})), 0)::DOUBLE / greatest(coalesce(list_sum(list_transform(units, lambda x: {_SPLIT.format(c='x')})), 0), 1) AS boilerplate,
  (contains(body, '...') OR contains(body, '…')) AS truncated, (source <> '' OR described <> '' OR fetched <> '') AS saved,
  (contains(described, 'full_jd') OR fetched IN ('complete', 'full', 'full_jd') OR source IN ('jsearch', 'company website', 'company_site')) AS is_full,
  (contains(described, 'snippet') OR contains(described, 'summary') OR fetched IN ('snippet', 'snippet_only', 'missing', 'partial') OR (source IN ('adzuna', 'jooble') AND n_words < 180)) AS snippet FROM u),
r AS (SELECT *, (n_words >= 120 AND requirements >= 3 AND responsibilities >= 2 AND NOT truncated AND NOT snippet AND boilerplate < 0.45::DOUBLE) AS ready,
  least(35.0::DOUBLE, n_words / 250.0::DOUBLE * 35.0::DOUBLE) + least(30.0::DOUBLE, requirements * 6.0::DOUBLE) + least(20.0::DOUBLE, len(sections) * 5.0::DOUBLE)
  + CASE WHEN n_words > 0 THEN 15.0::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - boilerplate) ELSE 0.0 END + CASE WHEN is_full AND n_words > 0 THEN 8.0::DOUBLE WHEN snippet THEN -18.0::DOUBLE ELSE 0.0 END - CASE WHEN truncated THEN 15.0::DOUBLE ELSE 0.0 END AS points FROM f),
q AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, points)), 0)::INT AS quality_score,
  CASE WHEN n_words < 10 THEN 'empty_or_unreadable' WHEN snippet OR (n_words < 80 AND truncated) THEN 'likely_snippet' WHEN boilerplate >= 0.45::DOUBLE THEN 'boilerplate_heavy'
    WHEN requirements < 2 THEN 'requirements_missing' WHEN ready THEN 'scoring_ready' ELSE 'partial_jd' END AS label FROM r),
z AS (SELECT *, CASE WHEN saved THEN label IN ('empty_or_unreadable', 'likely_snippet', 'boilerplate_heavy', 'requirements_missing') ELSE n_words < 20 END AS incomplete FROM q)"""


@query("jd_quality", f"""WITH {PAIRS}, {QUALITY}
SELECT o_orderkey, label, quality_score, n_words, array_to_string(sections, ',') AS sections, requirements, responsibilities, round(boilerplate, 9) AS boilerplate, truncated, saved, is_full, snippet, ready, incomplete,
  (n_words >= 20 AND requirements >= 1 AND boilerplate < 0.65::DOUBLE) AS provisional,
  CASE WHEN is_full OR snippet OR label IN ('empty_or_unreadable', 'scoring_ready') THEN 'high' ELSE 'medium' END AS sure,
  array_to_string(list_filter([CASE WHEN snippet THEN 'snippet source' END, CASE WHEN truncated THEN 'truncated' END, CASE WHEN n_words < 120 THEN 'short' END, CASE WHEN requirements < 3 THEN 'few requirements' END,
    CASE WHEN boilerplate >= 0.45::DOUBLE THEN 'boilerplate' END, CASE WHEN ready THEN 'ready' END], lambda x: x IS NOT NULL)[1:4], ',') AS reasons FROM z""")  # fmt: skip
def jd_quality(spark, sf_dir):
    found = postings.quality(pairs(spark, sf_dir), "job")
    q = lambda name: F.col("quality")[name]
    return found.select(
        "o_orderkey", q("label").alias("label"), q("score").alias("quality_score"), q("n_words").alias("n_words"), F.array_join(q("sections"), ",").alias("sections"), q("requirements").alias("requirements"),
        q("responsibilities").alias("responsibilities"), F.round(q("boilerplate"), 9).alias("boilerplate"), q("truncated").alias("truncated"), q("saved").alias("saved"), q("full").alias("is_full"), q("snippet").alias("snippet"),
        q("ready").alias("ready"), q("incomplete").alias("incomplete"), q("provisional").alias("provisional"), q("sure").alias("sure"), F.array_join(q("reasons"), ",").alias("reasons"),
    )


def _profile(prefix: str = "") -> str:
    level = _first([(_has("cn", p), _q(k)) for k, p in v.CAREER_LEVELS.items()] + [(_has("cn", r"\b(?:intern|internship)\b"), "'student'")]) + " END"
    degree = _first([(_has("cn", p), _q(k)) for k, p in v.DEGREES.items()]) + " ELSE 'unknown' END"
    return f"""
n AS (SELECT *, {_norm('candidate')} AS cn, {_norm('job')} AS jn FROM z),
p0 AS (SELECT *, {level} AS stated, {degree} AS degree,
  list_max(list_transform(regexp_extract_all(lower(candidate), '\\b(\\d+(?:\\.\\d+)?)\\+?\\s*(?:years|yrs)\\s+(?:of\\s+)?(?:professional\\s+|work\\s+)?experience\\b', 1), lambda x: x::DOUBLE)) AS years FROM n),
p AS (SELECT *, coalesce(stated, CASE WHEN years >= 5 THEN 'senior' WHEN years >= 3 THEN 'mid' WHEN years IS NOT NULL THEN 'junior' ELSE 'unknown' END) AS level,
  (stated IS NOT NULL)::INT + (years IS NOT NULL)::INT + (degree <> 'unknown')::INT AS n_evidence, {_named('cn')} AS has FROM p0)"""


_LINE = f"""
ls AS (SELECT o_orderkey, pos, raw, {_norm('raw')} AS ln FROM (SELECT o_orderkey, unnest(range(len(rs))) AS pos, unnest(rs) AS raw FROM
  (SELECT o_orderkey, list_filter(list_transform(string_split(job, chr(10)), lambda x: trim(x, ' -' || chr(9))), lambda x: x <> '') AS rs FROM pairs))),
lf AS (SELECT *, {_any(v.PREFERRED, 'ln')} AS wish, {_named('ln')} AS kws,
  CASE WHEN regexp_matches(ln, '\\b(?:5\\+?|five|at least 5)\\s*(?:years|yrs)\\b') THEN 'senior-level' WHEN regexp_matches(ln, '\\b(?:3\\+?|three|at least 3)\\s*(?:years|yrs)\\b') THEN 'mid-level' END AS lev,
  CASE WHEN regexp_matches(trim(raw), '(?i)^(?:role|title)?\\s*:?[ ]*(?:(?:senior|staff|principal)\\b|(?:engineering|product|data|machine learning) manager\\b)') THEN 'senior-level' END AS tit,
  CASE WHEN regexp_extract(ln, '\\b(\\d+(?:\\.\\d+)?)\\+?\\s*(?:years|yrs)\\b', 1) <> '' AND (contains(raw, '+') OR regexp_matches(ln, '\\b(?:required|requires?|must|minimum|at least)\\b')) THEN regexp_extract(ln, '\\b(\\d+(?:\\.\\d+)?)\\+?\\s*(?:years|yrs)\\b', 1)::DOUBLE END AS yrs,
  CASE WHEN regexp_matches(ln, '\\b(?:required|requires?|must|minimum)\\b') THEN CASE WHEN {_has('ln', v.DEGREES['phd'])} THEN 'phd' WHEN {_has('ln', v.DEGREES['master'])} THEN 'master' END END AS deg,
  contains(ln, 'equivalent') AND contains(ln, 'experience') AS equ,
  CASE WHEN regexp_matches(trim(raw, '#*: -'), '(?i)^(?:role|title)\\s*:\\s*') THEN trim(regexp_replace(trim(raw, '#*: -'), '^[^:]*:', '')) ELSE trim(raw, '#*: -') END AS tl FROM ls),
lh AS (SELECT *, regexp_matches(tl, '(?i)^(?:senior|staff|principal)\\s+[A-Za-z]') OR regexp_matches(tl, '(?i)^(?:engineering|product|data|machine learning) manager\\b') OR regexp_matches(tl, '(?i)\\b5\\+?\\s*years\\s+in\\s+a\\s+senior\\s+role\\b') AS sen FROM lf),
lk AS (SELECT o_orderkey, wish, unnest(list_concat(kws, list_filter([lev, tit], lambda x: x IS NOT NULL))) AS k FROM lh),
ld AS (SELECT o_orderkey, list(DISTINCT k) FILTER (NOT wish) AS req, list(DISTINCT k) FILTER (wish) AS pref FROM lk GROUP BY o_orderkey),
le AS (SELECT o_orderkey, max(yrs) FILTER (NOT wish) AS job_years, arg_min(deg, pos) FILTER (NOT wish AND deg IS NOT NULL) AS job_degree, coalesce(arg_min(equ, pos) FILTER (NOT wish AND deg IS NOT NULL), false) AS equivalent, bool_or(sen) AS senior FROM lh GROUP BY o_orderkey)"""


def _category(i: int, name: str, points: int, keywords) -> list[str]:
    """Columns w (possible), e (earned weight), n (active) and lists of one category."""
    weights, earned, matched, partial, missing = [], [], [], [], []
    for k in keywords:
        r, w = f"list_contains(req, {_q(k)})", f"list_contains(pref, {_q(k)})"
        weight = f"CASE WHEN {r} THEN 1.0::DOUBLE WHEN {w} THEN 0.5::DOUBLE ELSE 0.0 END" if name == "Experience level fit" else f"CASE WHEN {w} THEN 0.5::DOUBLE WHEN {r} THEN 1.0::DOUBLE ELSE 0.0 END"
        if name == "Experience level fit":
            cases = [(f"level = '{own}'", f"{covers[k]}::DOUBLE") for own, covers in v.LEVEL_COVERAGE.items() if k in covers]
            strength = _first(cases) + " ELSE 0.0 END"
        else:
            strength = f"CASE WHEN list_contains(has, {_q(k)}) THEN 1.0::DOUBLE" + (f" WHEN list_has_any(has, [{', '.join(map(_q, v.ADJACENT[k]))}]) THEN 0.6::DOUBLE" if k in v.ADJACENT else "") + " ELSE 0.0 END"
        on = f"({r} OR {w})"
        weights.append(f"({weight})")
        earned.append(f"({weight}) * ({strength})")
        matched.append(f"CASE WHEN {on} AND ({strength}) = 1 THEN {_q(k)} END")
        partial.append(f"CASE WHEN {on} AND ({strength}) > 0 AND ({strength}) < 1 THEN {_q(k)} END")
        missing.append(f"CASE WHEN {on} AND ({strength}) = 0 THEN {_q(k)} END")
    lists = [f"list_filter([{', '.join(x)}], lambda x: x IS NOT NULL) AS {n}{i}" for n, x in (("m", matched), ("a", partial), ("g", missing))]
    return [f"0.0::DOUBLE + {' + '.join(weights)} AS w{i}", f"0.0::DOUBLE + {' + '.join(earned)} AS e{i}", *lists]


_CATS = list(enumerate((name, points, keywords) for name, (points, keywords) in v.CATEGORIES.items()))
_FOCUS_CASE = _first([(_has("title", "(?i)" + "|".join(patterns)), _q(name)) for name, (patterns, _) in v.ROLE_FOCUS.items()]) + " END"
_MATCHED_CASE = _first([(f"focus = {_q(name)}", "list_filter([" + ", ".join(f"CASE WHEN {_alias(a, 'cn')} THEN {_q(a)} END" for a in aliases) + "], lambda x: x IS NOT NULL)[1:5]") for name, (_, aliases) in v.ROLE_FOCUS.items()]) + " ELSE [] END"
_SCORED = f"""WITH {PAIRS}, {QUALITY}, {_profile()}, {_LINE},
d AS MATERIALIZED (SELECT p.*, coalesce(ld.req, []) AS req, coalesce(ld.pref, []) AS pref, job_years, job_degree, equivalent, senior FROM p LEFT JOIN ld USING (o_orderkey) LEFT JOIN le USING (o_orderkey)),
c AS MATERIALIZED (SELECT *, {', '.join(x for i, (n, pts, ks) in _CATS for x in _category(i, n, pts, ks))},
  CASE WHEN regexp_extract(job, '(?m)^#\\s+(.+?)\\s*$', 1) <> '' THEN regexp_extract(job, '(?m)^#\\s+(.+?)\\s*$', 1) ELSE regexp_extract(job, '(?im)^Role:\\s*(.+?)\\s*$', 1) END AS title FROM d),
t AS MATERIALIZED (SELECT *, {', '.join(f"CASE WHEN w{i} > 0 THEN {_tenth(f'(e{i} / w{i} * {pts})')} END AS p{i}" for i, (n, pts, ks) in _CATS)}, {_FOCUS_CASE} AS focus, {' + '.join(f'len(m{i}) + len(a{i}) + len(g{i})' for i, _ in _CATS)} AS active FROM c),
s AS (SELECT *, {_MATCHED_CASE} AS matched_focus, coalesce(round_even(({' + '.join(f'coalesce(p{i}, 0.0::DOUBLE)' for i, _ in _CATS)}) / nullif({' + '.join(f'CASE WHEN p{i} IS NULL THEN 0.0::DOUBLE ELSE {pts} END' for i, (n, pts, ks) in _CATS)}, 0) * 100, 0)::INT, 0) AS coverage_score FROM t),
o AS (SELECT *, CASE WHEN focus IS NULL THEN coverage_score ELSE least(coverage_score, round_even(coverage_score * 0.75::DOUBLE + CASE WHEN len(matched_focus) > 0 THEN 100 ELSE 0 END * 0.25::DOUBLE, 0)::INT) END AS observed_score,
  least(1.0::DOUBLE, CASE WHEN incomplete THEN least(active + (focus IS NOT NULL)::INT, 3) ELSE active + (focus IS NOT NULL)::INT END / 4.0::DOUBLE) AS share,
  {_any(v.AUTHORIZATION, 'jn')} AS asks, {_any(v.AUTHORIZATION_HELD, 'jn')} AS held, {_any(v.CANDIDATE_NEEDS, 'cn')} AS needs, {_any(v.CANDIDATE_HOLDS, 'cn')} AS holds,
  CASE degree WHEN 'phd' THEN 3 WHEN 'master' THEN 2 WHEN 'bachelor' THEN 1 ELSE 0 END < CASE job_degree WHEN 'phd' THEN 3 WHEN 'master' THEN 2 END AS short_degree FROM s),
x AS (SELECT *, CASE WHEN observed_score > 50 AND share < 1 THEN least(observed_score, round_even(50 + (observed_score - 50) * share, 0)::INT) ELSE observed_score END AS score,
  CASE WHEN job_years IS NULL THEN NULL WHEN years IS NOT NULL THEN CASE WHEN years < job_years THEN 2 END WHEN level IN ('student', 'new_grad') AND job_years >= 3 THEN 2 ELSE 1 END AS r1,
  CASE WHEN job_degree IS NULL THEN NULL WHEN equivalent AND short_degree THEN 1 WHEN degree = 'unknown' THEN 1 WHEN short_degree THEN 2 END AS r2,
  CASE WHEN senior THEN CASE WHEN level IN ('student', 'new_grad', 'junior') THEN 2 WHEN level = 'unknown' THEN 1 END END AS r3,
  CASE WHEN asks AND NOT holds THEN CASE WHEN held AND needs THEN 2 ELSE 1 END END AS r4,
  list_filter([CASE WHEN saved AND incomplete OR n_words < 20 THEN 'posting too short' END, CASE WHEN active < 4 THEN 'few demands' END, CASE WHEN len(has) + n_evidence = 0 THEN 'no evidence' END], lambda y: y IS NOT NULL) AS doubts FROM o),
y AS (SELECT *, CASE greatest(coalesce(r1, 0), coalesce(r2, 0), coalesce(r3, 0), coalesce(r4, 0)) WHEN 2 THEN 'failed' WHEN 1 THEN 'manual_review' ELSE 'passed' END AS eligibility,
  CASE WHEN len(doubts) > 0 THEN 'low' WHEN active >= 8 THEN 'high' ELSE 'medium' END AS confidence FROM x),
w AS MATERIALIZED (SELECT *, CASE WHEN eligibility = 'failed' THEN 'Skip / Not Eligible' WHEN eligibility = 'manual_review' OR confidence = 'low' THEN 'Manual Review'
  WHEN score >= 80 THEN 'Apply' WHEN score >= 65 THEN 'Apply / Maybe Apply' WHEN score >= 50 THEN 'Maybe Apply' ELSE 'Skip or Low Priority' END AS recommendation FROM y)"""


@query("score_job_texts", _SCORED + f"""
SELECT o_orderkey, score, coverage_score, observed_score, title, focus, array_to_string(matched_focus, ',') AS focus_evidence, eligibility,
  array_to_string(list_filter([CASE WHEN r1 IS NOT NULL THEN 'minimum_experience' END, CASE WHEN r2 IS NOT NULL THEN CASE WHEN equivalent AND short_degree THEN 'graduate_degree_equivalent' ELSE 'graduate_degree' END END,
    CASE WHEN r3 IS NOT NULL THEN 'seniority_requirement' END, CASE WHEN r4 IS NOT NULL THEN 'work_authorization' END], lambda y: y IS NOT NULL), ',') AS codes,
  confidence, array_to_string(doubts, ',') AS doubts, active::INT AS active, (len(has) + n_evidence)::INT AS evidence, recommendation,
  array_to_string(list_filter([CASE WHEN {_has('jn', v.STATUS_PATTERN)} AND NOT {_has('cn', v.STATUS_PATTERN)} THEN 'status' END, CASE WHEN {_any(v.UK_PLACES, 'jn')} THEN 'uk' END,
    CASE WHEN {_any(v.UK_PLACES, 'jn')} AND {_any(v.UK_REVIEW, 'jn')} THEN 'uk_review' END, CASE WHEN {_any(v.UK_PLACES, 'jn')} AND {_has('jn', v.UK_HELD_PATTERN)} THEN 'uk_held' END], lambda y: y IS NOT NULL), ',') AS flags FROM w""")  # fmt: skip
def score_job_texts(spark, sf_dir):
    names = ("score", "coverage_score", "observed_score", "focus", "eligibility", "codes", "confidence", "doubts", "active", "evidence", "recommendation", "flags")
    found = fit.scored(pairs(spark, sf_dir), "job", "candidate", members=names)
    f = lambda *names: [F.col("fit")[n].alias(n) for n in names]
    joined = lambda n: F.array_join(F.col("fit")[n], ",").alias(n)
    focus = F.col("fit")["focus"]
    return found.select("o_orderkey", *f("score", "coverage_score", "observed_score"), focus["title"].alias("title"), focus["focus"].alias("focus"), F.array_join(focus["matched"], ",").alias("focus_evidence"), *f("eligibility"), joined("codes"), *f("confidence"), joined("doubts"), *f("active", "evidence", "recommendation"), joined("flags"))


@query("fit_breakdown", _SCORED + "\n" + "\nUNION ALL ".join(f"SELECT o_orderkey, {_q(n)} AS category, {pts} AS possible, p{i} AS earned, array_to_string(m{i}, ',') AS matched, array_to_string(a{i}, ',') AS partial, array_to_string(g{i}, ',') AS missing FROM w" for i, (n, pts, ks) in _CATS))
def fit_breakdown(spark, sf_dir):
    parts = fit.scored(pairs(spark, sf_dir), "job", "candidate", members=("breakdown",)).select("o_orderkey", F.explode_outer("fit.breakdown").alias("p"))  # not explode: its inferred filter would compute the parts again
    return parts.select("o_orderkey", "p.category", "p.possible", "p.earned", *[F.array_join(F.col("p")[n], ",").alias(n) for n in ("matched", "partial", "missing")])


@query("candidate_profiles", f"WITH {PAIRS}, z AS (SELECT * FROM pairs), {_profile()} SELECT o_orderkey, level, years, degree, n_evidence FROM p")
def candidate_profiles(spark, sf_dir):
    return pairs(spark, sf_dir).select("o_orderkey", fit.candidate_profile(F.col("candidate")).alias("p")).select("o_orderkey", "p.level", "p.years", "p.degree", "p.n_evidence")


@query("fit_explained", _SCORED + """
SELECT recommendation, confidence, eligibility, focus, count(*) AS pairs, min(score) AS least, max(score) AS most, sum(score)::BIGINT AS total, sum((coverage_score <> observed_score)::INT)::BIGINT AS focused, sum((observed_score <> score)::INT)::BIGINT AS calibrated FROM w GROUP BY ALL""")
def fit_explained(spark, sf_dir):
    f = lambda n: F.col("fit")[n]
    rows = fit.scored(pairs(spark, sf_dir), "job", "candidate", members=("score", "coverage_score", "observed_score", "focus", "eligibility", "confidence", "recommendation"))
    changed = lambda a, b: F.sum((f(a) != f(b)).cast("int"))
    return rows.groupBy(f("recommendation").alias("recommendation"), f("confidence").alias("confidence"), f("eligibility").alias("eligibility"), F.col("fit")["focus"]["focus"].alias("focus")).agg(
        F.count("*").alias("pairs"), F.min(f("score")).alias("least"), F.max(f("score")).alias("most"), F.sum(f("score")).alias("total"), changed("coverage_score", "observed_score").alias("focused"), changed("observed_score", "score").alias("calibrated")
    )
