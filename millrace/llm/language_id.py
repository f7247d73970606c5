"""Language identification by multilingual mixture inference.

Byte n-grams (orders 3 and 4, ASCII case folded, other ASCII than letters as one space) are counted per language. A
document is a mixture of languages: expectation-maximisation estimates the proportions from the n-grams'
likelihoods. The language set grows from the likeliest single language by the language with the steepest likelihood
gain, as long as the gain exceeds a penalty of PENALTY * log(n-grams) for its parameter.

Counts come from a bounded sample of labelled rows: about SAMPLE documents of each language, chosen by hash of doc_id.

Memory is bounded: a text of any length is read piece by piece into counts per n-gram bucket, and the mixture is estimated
over those counts, which gives the likelihood of the single n-grams.

Nulls: a text that is null or has no letter is `und` with score 0; rows of null lang teach nothing; a null doc_id is
kept, outside the learning rows. Without any learning row every document is `und`. Ties go to the language first in
order, repeated rows are judged alike. An empty table gives an empty result; columns besides doc_id, text and lang are not
read. Extra columns stay as they are; one named like a column that is added here is an error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import crc_mod, documents
from millrace.llm.words import PIECE, chunks

ORDERS = (3, 4)
LOG_BUCKETS = 16
#: Expected learning documents of each language.
SAMPLE = 1500
SMOOTHING = 0.2
PENALTY = 6.0
STEPS = 12
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_MULTIPLIER = np.uint32(2654435761)


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of one text's bytes."""
    codes = _FOLD[data]
    blank = codes == 32
    keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(codes) else blank
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
    found = []
    for k in ORDERS:
        if len(codes) < k:
            continue
        value = np.zeros(len(codes) - k + 1, np.uint32)
        for j in range(k):
            value |= codes[j : len(codes) - k + 1 + j] << np.uint32(8 * j)
        value = (value ^ (value >> np.uint32(15)) ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * _MULTIPLIER
        found.append(value >> np.uint32(32 - LOG_BUCKETS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def histogram(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text's n-grams and how often each occurs; a long text's pieces one after another."""
    if len(data) <= PIECE >> 6:
        return np.unique(grams(data), return_counts=True)
    total = np.zeros(1 << LOG_BUCKETS, np.int64)
    for i in range(0, len(data), PIECE):
        total += np.bincount(grams(data[i : i + PIECE]), minlength=1 << LOG_BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's bytes."""
    for chunk in chunks(column):
        for a, b in zip(chunk.starts[:-1], chunk.starts[1:], strict=True):
            yield chunk.data[a:b]


def has_letter(data: np.ndarray) -> bool:
    low = data | 32
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in bytes(data).decode("utf-8", "replace"))


class Mixture:
    """Languages with their n-gram probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        totals = np.maximum(counts.sum(axis=0), 1)
        smooth = counts * (totals.mean() / totals) + SMOOTHING if languages else counts + SMOOTHING  # equal weight for unseen n-grams
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=0)).astype(np.float32))
        self.log_p = np.log(self.p)

    def infer(self, data: np.ndarray) -> tuple[dict[int, float], float]:
        """Proportions of the selected languages, and how sure the likeliest single one is among all."""
        buckets, counts = histogram(data)
        n = int(counts.sum())
        heard = counts.astype(np.float32)
        single = counts.astype(np.float64) @ self.log_p[buckets]
        best = int(np.argmax(single))
        spread = np.exp(np.clip((single - single[best]) / len(ORDERS), -50, 0))
        chosen, shares, fit = [best], np.ones(1, np.float32), single[best]
        p = self.p[buckets]
        mixed = p[:, best]
        while len(chosen) < len(self.languages):
            gains = (heard @ (p / mixed[:, None])) / n  # slope of the likelihood towards each language
            gains[chosen] = 0
            new = int(np.argmax(gains))
            if gains[new] <= 1.0:
                break
            trial = [*chosen, new]
            weights = np.append(shares * 0.9, 0.1).astype(np.float32)
            part = p[:, trial]
            for _ in range(STEPS):
                joint = part * weights
                joint /= joint.sum(axis=1, keepdims=True)
                weights = (heard @ joint) / n
            total = part @ weights
            now = float(np.log(total).astype(np.float64) @ counts)
            if (now - fit) / len(ORDERS) <= PENALTY * np.log(n):
                break
            chosen, shares, fit, mixed = trial, weights, now, total
        return {i: float(s) for i, s in zip(chosen, shares, strict=True)}, float(1.0 / spread.sum())

    def predict(self, data: np.ndarray) -> tuple[str, float]:
        if not self.languages or not has_letter(data):
            return UNKNOWN, 0.0
        shares, sure = self.infer(data)
        top = max(sorted(shares), key=shares.__getitem__)
        return self.languages[top], min(1.0, shares[top] * (sure if len(shares) == 1 else 1.0))


def learning_rows(docs: DataFrame, held_out_mod: int, held_out: int, sample: int) -> DataFrame:
    """About `sample` rows of each language outside the held-out ones, the same ones at every run."""
    # one row per language is broadcast: the model holds far more for each of them
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", held_out_mod) != held_out))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("lang_rows"))
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    return rows.join(F.broadcast(sizes), "lang").where(chance * F.col("lang_rows") < sample)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
            found = totals.setdefault(lang, np.zeros(1 << LOG_BUCKETS, np.int64))
            for i in range(0, max(1, len(data)), PIECE):
                found += np.bincount(grams(data[i : i + PIECE]), minlength=1 << LOG_BUCKETS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])


def fit(docs: DataFrame, held_out_mod: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Mixture:
    """Learns from docs (doc_id, text, lang) outside the held-out rows. 2 ** LOG_BUCKETS numbers a language reach the driver."""
    rows = learning_rows(docs.select("doc_id", "text", "lang"), held_out_mod, held_out, sample).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table: pd.DataFrame = counts.toPandas()
    languages = sorted(table["lang"].unique().tolist())
    matrix = np.zeros((1 << LOG_BUCKETS, len(languages)))
    matrix[table["gram"].to_numpy(int), table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = table["n"].to_numpy(float)
    return Mixture(languages, matrix)


def predicted(docs: DataFrame, model: Mixture, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the predicted language and its score, as new columns after the given ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    taken = {c.lower() for c in docs.columns} & {name.lower(), score.lower()}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = shared.value
        for batch in batches:
            found = [mixture.predict(data) for data in texts(batch.column("text"))]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, name, score])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs)
    found = predicted(docs.select("doc_id", "text"), model, "lang_pred", "score")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
