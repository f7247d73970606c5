"""Agreement, association, classification and retrieval metrics as grouped plans. Ties in scores are handled by grouping equal scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, v): the bias-corrected association of two categories; 0 where one of them is constant."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    sizes = left.agg(F.count("*").alias("r"), F.sum("na").alias("total")).join(right.agg(F.count("*").alias("k")))  # single rows
    # chi2 / n = sum of n_ij^2 / (n_i n_j), less one
    parts = cells.join(left, a).join(right, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"))
    n = F.col("total").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("s") - 1 - (F.col("k") - 1) * (F.col("r") - 1) / (n - 1))
    rc, kc = F.col("r") - (F.col("r") - 1) * (F.col("r") - 1) / (n - 1), F.col("k") - (F.col("k") - 1) * (F.col("k") - 1) / (n - 1)
    v = F.when((n < 2) | (F.least(rc, kc) <= 1), 0.0).otherwise(F.sqrt(phi / (F.least(rc, kc) - 1)))
    return sizes.join(parts).select(F.col("total").alias("n"), F.bround(v, 6).alias("v"))


def fleiss_kappa(rows: DataFrame, subject: str, rating: str, least: int = 2) -> DataFrame:
    """One row (subjects, kappa) over subjects with `least` ratings or more; kappa is null where chance agreement is total."""
    cells = rows.groupBy(subject, rating).agg(F.count("*").alias("n"))
    subjects = cells.groupBy(subject).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).where(F.col("m") >= least)
    kept = cells.join(subjects.select(subject), subject)
    shares = kept.groupBy(rating).agg(F.sum("n").alias("c"))
    chance = shares.agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("total")).select((F.col("sq") / (F.col("total") * F.col("total"))).alias("pe"))
    observed = subjects.agg(F.count("*").alias("subjects"), F.avg(F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("po"))
    return observed.join(chance).select("subjects", F.when(F.col("pe") >= 1, F.lit(None)).otherwise(F.bround((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6)).alias("kappa"))


def consensus(rows: DataFrame, subject: str, rating: str, least_raters: int = 3, least_share: float = 0.75) -> DataFrame:
    """(subject, raters, decision, share, status): the modal rating, the least among equals, and where it goes."""
    cells = rows.groupBy(subject, rating).agg(F.count("*").alias("n"))
    modal = cells.groupBy(subject).agg(F.sum("n").alias("raters"), F.min(F.struct((-F.col("n")).alias("minus"), F.col(rating).alias("decision"))).alias("m"))
    share = F.bround(-F.col("m.minus") / F.col("raters"), 4)
    status = F.when(F.col("raters") < least_raters, "needs_reviewers").when(share >= least_share, "accepted").otherwise("human_review")
    return modal.select(subject, "raters", F.col("m.decision").alias("decision"), share.alias("share"), status.alias("status"))


def confusion(rows: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, balanced accuracy, precision, recall and F1; 0 for an empty denominator."""
    count = lambda x, y: F.count_if((F.col(label) == x) & (F.col(predicted) == y))
    out = rows.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"))
    over = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    made = {
        "accuracy": over(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": (over(tp, tp + fn) + over(tn, tn + fp)) / 2,
        "precision": over(tp, tp + fp),
        "recall": over(tp, tp + fn),
        "f1": over(2 * tp, 2 * tp + fp + fn),
    }
    return out.select(*by, "tp", "fp", "tn", "fn", *[F.bround(v, 6).alias(k) for k, v in made.items()])


def _thresholds(rows: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives at it, and at it or above."""
    cells = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return cells.withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "p": F.sum("pos").over(whole), "n": F.sum("neg").over(whole)})


def ranking(rows: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """(by.., positives, negatives, auc, average_precision) of groups with both labels. Windows run over distinct scores of a group."""
    at = _thresholds(rows, label, score, by)
    auc = F.sum((F.col("tp") - F.col("pos") / 2.0) * F.col("neg")) / F.first("p") / F.first("n")
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("p")
    both = at.where("p > 0 AND n > 0").groupBy(*by)
    return both.agg(F.first("p").alias("positives"), F.first("n").alias("negatives"), F.bround(auc, 6).alias("auc"), F.bround(precision, 6).alias("average_precision"))


def f1_threshold(rows: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """(by.., threshold, f1): the score with the best F1, the lowest among equals."""
    f1 = F.bround(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p")), 9)
    best = _thresholds(rows, label, score, by).groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col(score)).alias("minus"))).alias("b"))
    return best.select(*by, (-F.col("b.minus")).alias("threshold"), F.bround("b.f1", 6).alias("f1"))


def retrieval(rows: DataFrame, query: str, gold: str, score: str, key: str) -> DataFrame:
    """One row (queries, recall_1, recall_3, mrr): the rank of each query's best gold row by score, then key."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)))
    first = ranked.groupBy(query).agg(F.min(F.when(F.col(gold), F.col("rank"))).alias("rank")).where("rank IS NOT NULL")
    mean = lambda c: F.bround(F.avg(c), 6)
    return first.agg(F.count("*").alias("queries"), mean((F.col("rank") <= 1).cast("double")).alias("recall_1"), mean((F.col("rank") <= 3).cast("double")).alias("recall_3"), mean(1.0 / F.col("rank")).alias("mrr"))


def largest_share(rows: DataFrame, group: Sequence[str], value: str, warn: float) -> DataFrame:
    """(group.., rows, value, share, warning): each group's most frequent value, the least among equals."""
    cells = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    top = cells.groupBy(*group).agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("minus"), F.col(value).alias("value"))).alias("m"))
    share = F.bround(-F.col("m.minus") / F.col("rows"), 4)
    return top.select(*group, "rows", F.col("m.value").alias("value"), share.alias("share"), (share > warn).alias("warning"))
