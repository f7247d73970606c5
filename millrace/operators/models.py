"""Trained pair relevance: logistic regression over pair features and cosines, with leave-one-group-out evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import metrics, similarity

FEATURES = ("jaccard", "right_share", "left_share", "bigram_jaccard", "length_ratio", "log_left", "log_right")


def featured(pairs: DataFrame, left: str = "left_text", right: str = "right_text", extra: Sequence[str] = ()) -> DataFrame:
    """pairs with a vector column features: the pair features and any extra numeric columns (cosines), nulls as 0."""
    from pyspark.ml.functions import array_to_vector

    made = pairs.withColumn("_f", similarity.pair_features(F.col(left), F.col(right)))
    values = [F.col(f"_f.{n}") for n in FEATURES] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extra]
    return made.withColumn("features", array_to_vector(F.array(*values))).drop("_f")


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with a weight that gives both labels the same total."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))  # two rows
    total = sizes.agg(F.sum("_n").alias("_total"))
    weights = sizes.join(F.broadcast(total)).select(label, (F.col("_total") / (2.0 * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)


def train(pairs: DataFrame, label: str = "label", regularisation: float = 0.01):
    """A balanced logistic regression on features."""
    from pyspark.ml.classification import LogisticRegression

    rows = balanced(pairs.withColumn(label, F.col(label).cast("double")), label)
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=regularisation, maxIter=50).fit(rows)


def scored(model, pairs: DataFrame) -> DataFrame:
    """pairs with score, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(pairs)
    return out.withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def leave_one_group_out(pairs: DataFrame, group: str, seed: int = 7, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(scores of every pair by a model that never saw its group, metrics at each fold's threshold).

    Groups are the caller's folds: one model each is trained, so they must be few. The threshold of a fold is the best F1 on
    another group with both labels, chosen by hash."""
    groups = sorted(r[0] for r in pairs.select(group).distinct().collect())
    mixed = {r[0] for r in pairs.groupBy(group).agg(F.count_distinct(label).alias("k")).where("k > 1").collect()}
    parts = []
    for held in groups:
        order = pairs.where((F.col(group) != held) & F.col(group).isin(*mixed)).select(group).distinct().orderBy(keys.sha(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))).first() if mixed - {held} else None
        tuning = order[0] if order else None
        fitting = pairs.where((F.col(group) != held) & ((F.col(group) != tuning) if tuning is not None and len(groups) > 2 else F.lit(True)))
        model = train(fitting, label)
        threshold = 0.5
        if tuning is not None:
            best = metrics.f1_threshold(scored(model, pairs.where(F.col(group) == tuning)), label, "score", [group]).first()
            threshold = best["threshold"] if best else threshold
        out = scored(model, pairs.where(F.col(group) == held))
        parts.append(out.withColumn("predicted", (F.col("score") >= threshold).cast("int")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every, metrics.confusion(every, label, "predicted")
