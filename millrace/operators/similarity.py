"""Text pair features and TF-IDF cosine, as plans over term rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda x, y: F.concat_ws(" ", x, y)))


def pair_features(left: Column, right: Column) -> Column:
    """Struct of token Jaccard, shares of either side, bigram Jaccard, length ratio and log lengths."""

    def of(both: Column) -> Column:
        l, r = both["l"], both["r"]
        dl, dr = F.array_distinct(l), F.array_distinct(r)
        shared = F.size(F.array_intersect(dl, dr))
        share = lambda x: F.when(F.size(x) == 0, 0.0).otherwise(shared / F.size(x))
        longer = F.greatest(F.size(l), F.size(r))
        values = {"jaccard": jaccard(dl, dr), "right_share": share(dr), "left_share": share(dl), "bigram_jaccard": jaccard(F.array_distinct(_bigrams(l)), F.array_distinct(_bigrams(r))), "length_ratio": F.when(longer == 0, 0.0).otherwise(F.least(F.size(l), F.size(r)) / longer), "log_left": F.log1p(F.size(l).cast("double")), "log_right": F.log1p(F.size(r).cast("double"))}
        return F.struct(*[F.bround(v, 6).alias(k) for k, v in values.items()])

    return F.transform(F.array(F.struct(text.tokens(left).alias("l"), text.tokens(right).alias("r"))), of)[0]


def term_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, tf) of tokens."""
    return df.select(key, F.explode(text.tokens(F.col(column))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(terms: DataFrame, documents: int, least_df: int = 1) -> DataFrame:
    """(term, idf): smoothed, ln((1 + n) / (1 + df)) + 1."""
    df = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    return df.select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weighted(terms: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w, norm): (1 + ln tf) * idf with the vector's length beside it."""
    rows = terms.join(idf, "term").select(key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, key)


def cosines(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, cosine) of vectors that share a term."""
    a = left.select(left_key, "term", (F.col("w") / F.col("norm")).alias("wa"))
    b = right.select(right_key, "term", (F.col("w") / F.col("norm")).alias("wb"))
    return a.join(b, "term").groupBy(left_key, right_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def best_cosine(pairs: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Each left row's best right row, the least key among equals; cosines rounded before they are compared."""
    best = pairs.groupBy(left_key).agg(F.max(F.struct(F.bround("cosine", 6).alias("cosine"), (-F.col(right_key)).alias("minus"))).alias("b"))
    return best.select(left_key, (-F.col("b.minus")).alias(right_key), F.col("b.cosine").alias("cosine"))


def top_candidates(pairs: DataFrame, left_key: str, right_key: str, score: str, n: int = 3) -> DataFrame:
    """The n best right rows of each left row and its worst one, marked."""
    best, worst = Window.partitionBy(left_key).orderBy(F.desc(score), right_key), Window.partitionBy(left_key).orderBy(score, F.desc(right_key))
    ranked = pairs.withColumns({"place": F.row_number().over(best), "back": F.row_number().over(worst)})
    return ranked.where((F.col("place") <= n) | (F.col("back") == 1)).withColumn("hard_negative", F.col("place") > n).drop("back")
