"""Links between postings and candidate postings: similarity of names, weighted scores, and an unambiguous best match."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Legal forms that company names are compared without, weights of the parts, and limits.
LEGAL_FORMS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "co")
WEIGHTS = {"company": 0.55, "role": 0.4, "location": 0.05}
LEAST_TOTAL, LEAST_COMPANY, LEAST_ROLE, MARGIN = 0.76, 0.78, 0.55, 0.03


def name_tokens(c: Column, company: bool = False) -> Column:
    """Sorted distinct words of a name; of a company's without legal forms."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9+#]+", " "), " "), lambda w: w != ""))
    return F.array_sort(F.filter(words, lambda w: ~w.isin(*LEGAL_FORMS)) if company else words)


@pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Of two name_tokens(): the largest of Jaccard, 0.9 times the ratio of matching characters and 0.95 times containment; 0 for an empty one.

    The characters are compared in Arrow batches: built-in functions have no such ratio."""
    shared, least = F.size(F.array_intersect(left, right)), F.least(F.size(left), F.size(right))
    ratio = sequence_ratio(F.array_join(left, " "), F.array_join(right, " "))
    return F.when(least == 0, 0.0).otherwise(F.greatest(shared / F.size(F.array_union(left, right)), ratio * 0.9, 0.95 * shared / least))


def scored_pairs(pairs: DataFrame, left: str = "l_", right: str = "r_") -> DataFrame:
    """pairs with company, role, location and url scores and their total: 1 for equal canonical URLs, else weighted.

    Columns <left>company, <left>role, <left>location, <left>url and the same of <right>. An unknown left location counts a half."""
    names = [("company", True), ("role", False), ("location", False)]
    out = pairs.withColumns({f"_{side}{n}": name_tokens(F.col(side + n), company) for n, company in names for side in (left, right)})
    out = out.withColumns({f"{n}_score": similarity(F.col(f"_{left}{n}"), F.col(f"_{right}{n}")) for n, _ in names})
    out = out.withColumn("location_score", F.when(F.coalesce(F.col(left + "location"), F.lit("")) == "", 0.5).otherwise(F.col("location_score")))
    same = (F.coalesce(F.col(left + "url"), F.lit("")) != "") & F.col(left + "url").eqNullSafe(F.col(right + "url"))
    total = sum((F.col(f"{n}_score") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumns({"url_score": same.cast("double"), "total": F.when(same, 1.0).otherwise(total)}).drop(*[f"_{side}{n}" for n, _ in names for side in (left, right)])


def best_links(scored: DataFrame, key: str, other: str, targets: DataFrame) -> DataFrame:
    """(key, status, other, total) of every target: `linked` to its best candidate, `ambiguous` if a different one is nearly as good, else `none`.

    The two best are found by aggregation, so a target of very many candidates is no group in one task."""
    safe = scored.where((F.col("total") >= LEAST_TOTAL) & (F.col("company_score") >= LEAST_COMPANY) & (F.col("role_score") >= LEAST_ROLE))
    distinct = safe.groupBy(key, other).agg(F.max("total").alias("total"))
    best = distinct.groupBy(key).agg(F.max(F.struct("total", F.col(other).alias("id"))).alias("b"), F.count("*").alias("n"))
    second = distinct.join(best.where("n > 1").select(key, F.col("b.id").alias("_first")), key).where(F.col(other) != F.col("_first")).groupBy(key).agg(F.max("total").alias("second"))
    found = targets.select(key).join(best, key, "left").join(second, key, "left")
    close = F.coalesce(F.round(F.col("b.total") - F.col("second"), 12) < MARGIN, F.lit(False))
    status = F.when(F.col("b").isNull(), "none").when(close, "ambiguous").otherwise("linked")
    return found.select(key, status.alias("status"), F.when(status == "linked", F.col("b.id")).alias(other), F.round("b.total", 6).alias("total"))
