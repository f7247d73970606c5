"""Training pairs and agreement on small tables with nulls, ties and repeated rows."""

import hashlib

from millrace.operators import datasets


def test_training_pairs_leave_ambiguous_candidates_unlabelled(spark):
    tasks = spark.createDataFrame(
        [("a", "Direct", "c2", " Must  Have Python skills"), ("b", "No Support", None, "must have python"), ("c", "Partial", None, ""), ("d", None, "c1", None), ("e", "No Support", "c1", None)],
        "task_id string, support_label string, selected_candidate_id string, requirement string",
    )
    candidates = spark.createDataFrame([(t, c, f"{t}{c}") for t in "abcdf" for c in ("c1", "c2")] + [(None, "c1", "x")], "task_id string, candidate_id string, evidence string")
    got = {(r.task_id, r.candidate_id): r for r in datasets.training_pairs(tasks, candidates).collect()}
    assert {k: (r.binary_label, r.label_scope) for k, r in got.items()} == {
        ("a", "c2"): (1, "selected_best_evidence"),
        ("b", "c1"): (0, "no_support_task_candidate"),
        ("b", "c2"): (0, "no_support_task_candidate"),
    }
    assert {r.template_group for r in got.values()} == {"must have python"}
    assert got["a", "c2"].pair_id == hashlib.sha256(b"a:c2:1").hexdigest()[:16]
    assert datasets.training_pairs(tasks.limit(0), candidates).count() == 0


def test_agreement_counts_by_family_and_over_all(spark):
    schema = "family string, score int, eligibility string, confidence string, recommendation string, expected struct<low: int, high: int, eligibility: string, confidence: string, recommendation: string>"
    good = (80, 100, "passed", "high", "Apply")
    rows = [("x", 90, "passed", "high", "Apply", good), ("x", 90, "passed", "high", "Apply", good), ("y", 85, "passed", "low", "Apply", (0, 50, "failed", "low", "Skip")), (None, None, None, None, None, (0, 50, "failed", "low", "Skip"))]
    found = datasets.agreement(spark.createDataFrame(rows, schema)).collect()
    by = {(r.family, r.overall): r for r in found}
    assert len(found) == 4 and (by["x", 0].total, by["x", 0].score_rate, by["x", 0].recommendation_agreed) == (2, 100.0, 2)
    assert (by["y", 0].hard_constraint_false_negatives, by["y", 0].unsafe_high_scores, by["y", 0].confidence_agreed) == (1, 1, 1)
    assert (by[None, 0].score_agreed, by[None, 0].hard_constraint_false_negatives) == (0, 1)
    assert (by[None, 1].total, by[None, 1].score_agreed, by[None, 1].confidence_rate) == (4, 2, 75.0)
