"""Every query with SQL gives DuckDB's rows; the others give rows."""

import collections
import difflib
import re

import pytest
from compare import compare

from millrace import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    assert compare(spark, SF, registry.queries()[name], SQL[name]) == ""


def test_fuzzy_link_against_brute_force(spark):
    from millrace.plans import identity_plans as plans

    forms = {"inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "co"}
    tokens = lambda text, drop: sorted(set(re.sub("[^a-z0-9+#]+", " ", (text or "").lower()).split()) - (forms if drop else set()))

    def alike(a, b, drop=False):
        x, y = tokens(a, drop), tokens(b, drop)
        if not x or not y:
            return 0.0
        shared = len(set(x) & set(y))
        return max(shared / len(set(x) | set(y)), 0.9 * difflib.SequenceMatcher(None, " ".join(x), " ".join(y)).ratio(), 0.95 * shared / min(len(x), len(y)))

    targets = {r.t: r for r in plans.link_targets(spark, SF).collect()}
    best = {t: [] for t in targets}
    for r in plans.link_candidates(spark, SF).collect():
        own = targets[r.t]
        company, role = alike(own.company, r.company, True), alike(own.role, r.role)
        total = 1.0 if own.url == r.url else 0.55 * company + 0.4 * role + 0.05 * (alike(own.location, r.location) if own.location else 0.5)
        if total >= 0.76 and company >= 0.78 and role >= 0.55:
            best[r.t].append((total, r.c))
    want = {}
    for t, found in best.items():
        found.sort(reverse=True)
        status = "none" if not found else "ambiguous" if len(found) > 1 and found[0][0] - found[1][0] < 0.03 else "linked"
        want[t] = (status, found[0][1] if status == "linked" else None)
    got = {r.t: (r.status, r.c) for r in plans.fuzzy_link(spark, SF).collect()}
    assert got == want and {s for s, _ in want.values()} >= {"linked", "ambiguous"}
    assert abs(alike("Datadog", "Datadogs", True) - 0.84) < 0.01


def test_grouped_split_keeps_groups_and_fractions(spark):
    from millrace.operators import splits

    rows = [("big", i) for i in range(400)] + [("half", i) for i in range(150)] + [(f"g{i // 2}", i) for i in range(450)]
    found = splits.grouped(spark.createDataFrame(rows, "`group` string, id int"), "group", {"train": 0.6, "validation": 0.2, "test": 0.2}).collect()
    homes, sizes = collections.defaultdict(set), collections.Counter()
    for r in found:
        homes[r["group"]].add(r.subset)
        sizes[r.subset] += 1
    assert len(found) == 1000 and all(len(h) == 1 for h in homes.values())
    assert homes["big"] == {"train"} and abs(sizes["train"] - 600) < 60 and abs(sizes["test"] - 200) < 60
    assert registry.queries()["grouped_split"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
