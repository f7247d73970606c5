"""The review list: inbox views, filters, sort modes, next actions and labels of scored records. Expressions over a record's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranks of recommendations, and states.
RECOMMENDATION_RANK = {"Apply": 5, "Apply / Maybe Apply": 4, "Maybe Apply": 3, "Manual Review": 2, "Skip or Low Priority": 1, "Skip / Not Eligible": 0}
IGNORED = ("archived", "ignored", "not interested", "rejected", "skip")
RECOMMENDED = ("Apply", "Apply / Maybe Apply", "Maybe Apply")
PACKED = ("Cover letter ready", "Demo cover letter")
UNTRACKED = ("Not tracked", "Demo only")


def c(name: str) -> Column:
    return F.col(name)


def is_ignored(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*IGNORED)


def is_current_recommendation() -> Column:
    """Analysed, eligible, sure enough and recommended. Columns: available, eligibility, confidence, recommendation."""
    return c("available") & (c("eligibility") == "passed") & c("confidence").isin("medium", "high") & c("recommendation").isin(*RECOMMENDED)


def in_view(view: str) -> Column:
    """Whether a record belongs to an inbox view. Further columns: score, tracker_status, package_status."""
    has_package, tracked, ignored = c("package_status").isin(*PACKED), ~c("tracker_status").isin(*UNTRACKED), is_ignored(c("tracker_status"))
    if view == "Recommended":
        return is_current_recommendation() & (F.coalesce("score", F.lit(0)) >= 50) & ~ignored
    if view == "Needs attention":
        unclear = ~c("available") | (c("eligibility") == "manual_review") | (c("confidence") == "low") | (c("recommendation") == "Manual Review")
        return ~ignored & (unclear | ((c("tracker_status") != "Demo only") & (~has_package | ~tracked)))
    if view == "Ready":
        return (has_package | (F.lower("tracker_status") == "ready")) & ~ignored
    if view == "Not tracked":
        return ~ignored & ~tracked
    if view == "Ignored":
        return ignored
    if view == "All":
        return F.lit(True)
    raise ValueError(f"unknown view {view!r}")


def rank() -> Column:
    out = F.lit(0)
    for name, value in RECOMMENDATION_RANK.items():
        out = F.when(c("recommendation") == name, value).otherwise(out)
    return out


#: Sort modes of the list.
MODES = ("Role Fit high to low", "Newest first", "Recommendation", "Company A-Z", "Cover letter status", "Tracker status")


def order(mode: str, tie: str) -> list[Column]:
    """Sort columns of a mode; `tie` makes the order total. Columns: score, newest, recommendation, company, package_status, tracker_status."""
    score = F.coalesce("score", F.lit(0))
    if mode == "Newest first":
        keys = [c("newest").desc(), score.desc(), rank().desc()]
    elif mode == "Recommendation":
        keys = [rank().desc(), score.desc(), c("newest").desc()]
    elif mode == "Company A-Z":
        keys = [F.lower("company").asc(), score.desc(), c("newest").asc()]
    elif mode == "Cover letter status":
        keys = [c("package_status").isin(*PACKED).desc(), score.desc(), c("newest").desc()]
    elif mode == "Tracker status":
        keys = [(~c("tracker_status").isin(*UNTRACKED)).desc(), score.desc(), c("newest").desc()]
    elif mode == MODES[0]:
        keys = [score.desc(), c("newest").desc(), rank().desc()]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return [*keys, c(tie).asc()]


def needs_full_text(ready: Column, incomplete: Column, fetched: Column, n_words: Column) -> Column:
    """By the quality verdict, else by the confidence's, else by how the text was fetched and its length."""
    scarce = F.lower(F.coalesce(fetched, F.lit(""))).isin("", "missing", "snippet_only") & (F.coalesce(n_words, F.lit(0)) < 80)
    return F.coalesce(~ready, incomplete, scarce)


def next_action(needs_text: Column) -> Column:
    """One code a record: what to do first. Further column: company_needs_review."""
    return (
        F.when(~c("available"), "add description")
        .when(c("eligibility") == "failed", "review constraint")
        .when((c("confidence") == "low") & needs_text, "get full description")
        .when(c("confidence") == "low", "review requirements")
        .when(c("company_needs_review"), "confirm company")
        .when(c("package_status").isin("No cover letter", "Not generated", "-"), "generate letter")
        .when(c("tracker_status") == "Not tracked", "track")
        .when(F.lower("tracker_status") == "ready", "apply")
        .otherwise("record outcome")
    )


def parsed_time(value: Column) -> Column:
    """A tracker's time in one of its formats, null for others."""
    s = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.coalesce(F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.substring(s, 1, 16), F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")))


def age_days(applied: Column, created: Column, now: Column) -> Column:
    """Whole days since application, or since the record was made; never below 0; null without a readable time."""
    since = parsed_time(F.when(F.coalesce(applied, F.lit("")) != "", applied).otherwise(created))
    return F.when(since.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(since)) / 86400).cast("int")))


def tracker_action(status: Column, age: Column) -> tuple[Column, Column]:
    """(code, days): what a tracked record needs, and after how many days for the two that tell."""
    s = F.lower(F.when(F.coalesce(status, F.lit("")) == "", "saved").otherwise(status))
    due = F.coalesce(age >= 7, F.lit(False))
    code = F.when(s == "saved", "review fit").when(s == "ready", "apply").when((s == "applied") & due, "follow up").when(s == "applied", "wait").when(s == "interview", "prepare").when(s == "rejected", "learn and archive").otherwise("archived")
    days = F.when((s == "applied") & due, age).when(s == "applied", F.greatest(F.lit(1), 7 - F.coalesce(age, F.lit(0))))
    return code, days


def role_fit() -> Column:
    """The score as shown; not for results of low confidence."""
    shown = F.coalesce("score", F.lit(0)).cast("string")
    return F.when(~c("available"), "Not available").when((c("confidence") == "low") & c("score").isNotNull(), F.concat(F.lit("Provisional "), shown, F.lit("/100"))).when(c("confidence") == "low", "Not available").otherwise(F.concat(shown, F.lit("/100")))


def status_line(first_code: Column) -> Column:
    level = F.concat(F.initcap(c("confidence")), F.lit(" confidence"))
    base = F.when(~c("available"), "Manual Review · Low confidence").when(c("confidence") == "low", F.when(c("score").isNull(), "Manual Review · Low confidence").otherwise(F.concat(role_fit(), F.lit(" · Manual Review · Low confidence")))).otherwise(F.concat_ws(" · ", role_fit(), c("recommendation"), level))
    reason = F.initcap(F.replace(first_code, F.lit("_"), F.lit(" ")))
    return F.when((c("eligibility") != "passed") & first_code.isNotNull(), F.concat(base, F.lit(" · "), reason)).otherwise(base)


def evidence_label(active: Column, coverage: Column, needs_text: Column) -> Column:
    shown = F.when(coverage.isNull(), "Coverage unavailable").otherwise(F.concat(coverage.cast("string"), F.lit("% coverage")))
    return F.concat_ws(" · ", F.concat(active.cast("string"), F.lit(" requirements")), shown, F.when(needs_text, "API snippet").otherwise("Full JD"))


def listed(records: DataFrame, view: str, mode: str, tie: str, least_score: int = 0, search: str = "") -> DataFrame:
    """A view's records in a mode's order. Columns `company` and `role` are searched."""
    out = records.where(in_view(view)).where((F.coalesce("score", F.lit(-1)) >= least_score) | F.lit(least_score <= 0))
    if search.strip():
        out = out.where(F.lower(F.concat_ws(" ", "company", "role")).contains(search.strip().lower()))
    return out.orderBy(*order(mode, tie))
