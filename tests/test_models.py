"""The pair model tells matching pairs from others in a group it never saw."""

import random

from millrace.operators import metrics, models


def test_leave_one_group_out(spark):
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for i in range(90):
        left = [word() for _ in range(12)]
        label = i % 2
        right = left[:8] + [word() for _ in range(4)] if label else [word() for _ in range(12)]
        rows.append((i, f"g{i % 3}", " ".join(left), " ".join(right), label))
    pairs = models.featured(spark.createDataFrame(rows, "id int, grp string, left_text string, right_text string, label int"))
    scores, report = models.leave_one_group_out(pairs, "grp")
    assert report.first()["accuracy"] >= 0.95
    assert min(r["auc"] for r in metrics.ranking(scores, "label", "score", ["grp"]).collect()) > 0.95
