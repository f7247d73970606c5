"""The corpus pipeline: language ID, quality rules, near-duplicate removal and packing over documents.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of docs, whatever further ones there are and whatever their names: helper columns have names of their own.

* Nulls: a null or empty text is of no known language and goes at the first stage (the quality rules alone would drop it
  too, the join keeps it, packing writes its end id). Null doc_id, lang and source are values like others.
* Repeated rows and ties: rows alike in doc_id, lang, source and text share every verdict. Of a group of linked documents
  the join keeps the one of least doc_id (null last), of several texts under that doc_id the one of least hash, of rows that
  repeat a doc_id and a text any one.
* Empty tables give empty tables. Very long texts are read whole, as each operator says."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, language_id, packing, quality_rules
from millrace.llm.common import documents, remove, stored

#: A document whose likeliest language holds less than this share is rejected.
LANGUAGE_SHARE = 0.35
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def _fresh(*names: str) -> list[str]:
    """Column names that no table has."""
    end = uuid.uuid4().hex
    return [f"{name}_{end}" for name in names]


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without one, or of no clear one, go."""
    lang, share = _fresh("lang", "share")
    found = language_id.predicted(docs, language_id.fit(docs), lang, share)
    return found.where((F.col(lang) != language_id.UNKNOWN) & (F.col(share) >= LANGUAGE_SHARE)).select(*_columns(docs))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    own, mark, *keys = _fresh("own", "mark", "doc_id", "lang", "source")
    judged = quality_rules.judged(docs.select("doc_id", "lang", "source", "text", _text_hash().alias(mark)))
    kept = judged.where("kept").select(*[F.col(c).alias(k) for c, k in zip(("doc_id", "lang", "source"), keys, strict=True)], mark).distinct()
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(("doc_id", "lang", "source"), keys, strict=True)]
    return docs.withColumn(own, _text_hash()).join(kept, [*same, F.col(own) == F.col(mark)], "left_semi").select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    own, mark, key = _fresh("own", "mark", "doc_id")
    found = jaccard_join.joined(docs.select("doc_id", "text"), SHINGLE_WORDS, SIMILARITY_PERCENT)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
    alone = found.where("component is null").select("doc_id", "text_hash")
    kept = first.select("first.doc_id", "first.text_hash").unionByName(alone).toDF(key, mark).distinct()
    near = docs.withColumn(own, _text_hash()).join(kept, [F.col("doc_id").eqNullSafe(F.col(key)), F.col(own) == F.col(mark)], "left_semi")
    return near.dropDuplicates(["doc_id", own]).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("quality_rules", filter_quality),
    ("jaccard_join", drop_near_duplicates),
    ("packing", pack),
]

#: Language mixtures and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
