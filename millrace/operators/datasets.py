"""Datasets made of reviewed tasks, and how far results agree with expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels whose selected candidate is a positive example, and the scopes of the pairs.
POSITIVE_LABELS = ("Direct", "Partial")
SELECTED = "selected_best_evidence"
UNSUPPORTED = "no_support_task_candidate"
#: Score and recommendation from which a wrong result is an unsafe one.
UNSAFE_SCORE = 80
APPLY = "Apply"


def template_group(requirement: Column) -> Column:
    """The first three words in small letters: wording that repeats shares a group."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(requirement, F.lit(""))), r"\s+", " ")), " ")
    return F.array_join(F.slice(words, 1, 3), " ")


def training_pairs(tasks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Labelled pairs of tasks (task_id, support_label, selected_candidate_id, requirement) and candidates (task_id, candidate_id, evidence).

    A supported task gives its selected candidate as a positive, one without support all its candidates as negatives; other
    candidates of supported tasks stay unlabelled. A task without a label is unresolved and gives none.
    Both sides meet by task_id once; no window or collected list grows with a task."""
    positive = F.col("support_label").isin(*POSITIVE_LABELS)
    rows = tasks.where("support_label is not null").withColumn("template_group", template_group(F.col("requirement"))).join(candidates, "task_id")
    rows = rows.where(~positive | (F.col("candidate_id") == F.col("selected_candidate_id")))
    label = F.when(positive, 1).otherwise(0)
    identity = F.concat_ws(":", F.col("task_id").cast("string"), F.col("candidate_id").cast("string"), label.cast("string"))
    scope = F.when(positive, SELECTED).otherwise(UNSUPPORTED)
    return rows.select(F.substring(F.sha2(identity, 256), 1, 16).alias("pair_id"), "task_id", "candidate_id", "evidence", label.alias("binary_label"), "support_label", scope.alias("label_scope"), "template_group")


def label_counts(pairs: DataFrame) -> DataFrame:
    """Pairs, tasks and template groups per label and scope."""
    return pairs.groupBy("support_label", "binary_label", "label_scope").agg(F.count("*").alias("pairs"), F.countDistinct("task_id").alias("tasks"), F.countDistinct("template_group").alias("template_groups"))


def agreement(cases: DataFrame) -> DataFrame:
    """Agreement per family, and over all in the row without one, of cases (family, score, eligibility, confidence, recommendation and
    expected: low, high, and the same three fields). Rates are percentages; a null never agrees."""
    checks = {"score": F.col("score").between(F.col("expected.low"), F.col("expected.high"))}
    checks |= {c: F.col(c) == F.col(f"expected.{c}") for c in ("eligibility", "confidence", "recommendation")}
    missed = (F.col("expected.eligibility") == "failed") & ~F.col("eligibility").eqNullSafe(F.lit("failed"))
    cleared = F.col("expected.eligibility").eqNullSafe(F.lit("passed")) & F.col("expected.recommendation").eqNullSafe(F.lit(APPLY))
    unsafe = (F.col("score") >= UNSAFE_SCORE) & (F.col("recommendation") == APPLY) & ~cleared
    counted = cases.rollup("family").agg(
        F.grouping("family").cast("int").alias("overall"),
        F.count("*").alias("total"),
        *[F.count_if(v).alias(f"{k}_agreed") for k, v in checks.items()],
        F.count_if(missed).alias("hard_constraint_false_negatives"),
        F.count_if(unsafe).alias("unsafe_high_scores"),
    )
    return counted.select("*", *[F.bround(F.col(f"{k}_agreed") * 100 / F.col("total"), 6).alias(f"{k}_rate") for k in checks])
