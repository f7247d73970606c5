"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its first four and five bytes (ASCII case folded, ASCII
punctuation apart). Filters of widths 1, 2 and 3 run over the whole text, max pooling keeps each filter's strongest
answer, and a linear layer gives the logit. Embeddings start from the classes' log-odds and are trained, like
the filters, by stochastic gradients through the pooled positions. Thresholds are calibrated by the language that the
text itself shows, and are shifted to 0.5.

The classifier learns from a bounded sample: about TOXIC_ROWS toxic and CLEAN_ROWS other labelled documents, less one in
APART. Thresholds come from histograms of the logits of all other labelled rows outside the held-out ones, where each
class weighs as much as it does among all of them.

Nulls: a null text is an empty one, scored by the bias alone; a null doc_id is kept and never learnt from; null labels
teach nothing. Without both classes among the learning rows every score is 0. Repeated rows are scored one by one. An
empty table gives an empty result; columns besides doc_id, text (and lang, for calibration languages) are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id
from millrace.llm.common import crc_mod, documents, written
from millrace.llm.words import LOWER, PIECE, SPACE, hash_piece, mix, pieces

TOXIC_ROWS = 1200
CLEAN_ROWS = 2400
LOG_BUCKETS = 17
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)
EPOCHS = 6
#: One of so many labelled documents, by hash, never trains and only calibrates.
APART = 4
#: Histogram bins of a logit unit, and where logits are clipped.
BINS = 50
FAR = 30

_BREAK = SPACE.copy()
_BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(data: np.ndarray) -> np.ndarray:
    """Buckets of each word of one text and of its prefixes (words x 3)."""
    rows = []
    for piece in pieces(data, _BREAK):
        hashes, begins, lengths = hash_piece(piece, np.zeros(1, np.int64), LOWER, _BREAK)
        if not len(hashes):
            continue
        folded = np.append(LOWER[piece], np.zeros(max(PREFIXES), np.uint8)).astype(np.uint64)
        columns = [hashes]
        for k in PREFIXES:
            value = np.full(len(begins), k, np.uint64)
            for j in range(k):
                value = (value << np.uint64(8)) | folded[begins + j]
            columns.append(np.where(lengths >= k, mix(value), hashes))
        rows.append((np.stack(columns, axis=1) >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32))
    return np.concatenate(rows) if rows else np.zeros((0, 1 + len(PREFIXES)), np.int32)


@dataclass
class Classifier:
    table: np.ndarray  # buckets x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    shifts: np.ndarray  # bias of every filter
    weights: np.ndarray
    bias: float
    languages: language_id.Mixture
    thresholds: dict[str, float] = field(default_factory=dict)  # logits; "" for other languages

    def pooled(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's strongest answer and where it is, -1 where none is positive."""
        n = len(buckets)
        if not n:
            return np.zeros(len(self.shifts), np.float32), np.full(len(self.shifts), -1)
        words = self.table[buckets].sum(axis=1)
        best, where = [], []
        for w in self.filters:
            answer = words @ w[0]
            for j in range(1, len(w)):
                answer[:-j or None][: max(0, n - j)] += words[j:] @ w[j]
            at = answer.argmax(axis=0)
            best.append(answer[at, np.arange(answer.shape[1])])
            where.append(at)
        top = np.concatenate(best) + self.shifts
        return np.maximum(top, 0), np.where(top > 0, np.concatenate(where), -1)

    def logit(self, data: np.ndarray) -> float:
        """Over whole texts; very long ones are pooled piece by piece."""
        buckets = features(data)
        top = np.zeros(len(self.shifts), np.float32)
        step = PIECE // 16
        for i in range(0, len(buckets), step):
            top = np.maximum(top, self.pooled(buckets[i : i + step + max(WIDTHS) - 1])[0])
        return float(top @ self.weights + self.bias)


def likeliest(languages: language_id.Mixture, data: np.ndarray) -> str:
    """The single language that fits best; "" without languages or text."""
    if not languages.languages or not len(data):
        return ""
    buckets, counts = language_id.histogram(data)
    total = counts.astype(np.float64) @ languages.log_p[buckets]
    return languages.languages[int(np.argmax(total))]


def _start(rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Embeddings whose first coordinate is the bucket's smoothed log-odds between the classes."""
    seen = np.zeros((2, 1 << LOG_BUCKETS))
    for buckets, label in zip(rows, labels, strict=True):
        seen[label, np.unique(buckets)] += 1
    totals = np.bincount(labels, minlength=2).astype(float)
    odds = np.log((seen[1] + 1) / (totals[1] + 2)) - np.log((seen[0] + 1) / (totals[0] + 2))
    odds -= np.log((totals[0] + 2) / (totals[1] + 2))  # zero for a bucket never seen
    heard = seen.sum(axis=0)
    table = rng.normal(0, 0.05, (1 << LOG_BUCKETS, DIM)).astype(np.float32)
    table[:, 0] = np.clip(odds * heard / (heard + 6), -2, 2)
    return table, float(np.log((totals[1] + 1) / (totals[0] + 1)))


def train(rows: list[np.ndarray], labels: np.ndarray, languages: language_id.Mixture, seed: int = 5) -> Classifier:
    """A classifier from features and 0/1 labels, by Adagrad over EPOCHS passes."""
    rng = np.random.default_rng(seed)
    table, bias = _start(rows, labels, rng)
    filters = [rng.normal(0, 0.15, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for w in filters:
        w[:, 0, : FILTERS // 2] += 0.5 / len(w)  # half of the filters look at the log-odds first
    many = len(WIDTHS) * FILTERS
    model = Classifier(table, filters, np.full(many, -0.5, np.float32), rng.normal(0.1, 0.05, many).astype(np.float32), bias, languages)
    past = {"table": np.full(len(table), 1e-2, np.float32), "filters": [np.full_like(w, 1e-2) for w in filters], "shifts": np.full(many, 1e-2), "weights": np.full(many, 1e-2), "bias": 1e-2}
    rate, balance = 0.05, len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, label = rows[i], labels[i]
            top, where = model.pooled(buckets)
            z = float(np.clip(top @ model.weights + model.bias, -30, 30))
            slope = float((1 / (1 + np.exp(-z)) - label) * balance[label])
            if abs(slope) < 1e-3:
                continue
            to_top = slope * model.weights * (where >= 0)
            g = slope * top
            past["weights"] += g * g
            model.weights -= (rate * g / np.sqrt(past["weights"])).astype(np.float32)
            past["bias"] += slope * slope
            model.bias -= rate * slope / np.sqrt(past["bias"])
            past["shifts"] += to_top**2
            model.shifts -= (rate * to_top / np.sqrt(past["shifts"])).astype(np.float32)
            words = model.table[buckets].sum(axis=1) if len(buckets) else None
            for b, w in enumerate(filters):
                part = slice(b * FILTERS, (b + 1) * FILTERS)
                live = np.flatnonzero(to_top[part])
                if not len(live):
                    continue
                for j in range(len(w)):
                    at = where[part][live] + j
                    inside = at < len(buckets)
                    use, at = live[inside], at[inside]
                    if not len(use):
                        continue
                    push = to_top[part][use].astype(np.float32)
                    to_filter = words[at].T * push
                    to_words = w[j][:, use].T * push[:, None]
                    past["filters"][b][j][:, use] += to_filter**2
                    w[j][:, use] -= rate * to_filter / np.sqrt(past["filters"][b][j][:, use])
                    for column in buckets[at].T:
                        np.add.at(past["table"], column, (to_words**2).sum(axis=1) / DIM)
                        np.add.at(model.table, column, -rate * to_words / np.sqrt(past["table"][column])[:, None])
    return model


def _best_cut(bins: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit from which calling a row toxic gives the highest F1; between the bins on either side of it. toxic, clean: weights by bin."""
    seen = np.flatnonzero(toxic + clean)
    order = seen[np.argsort(-bins[seen], kind="stable")]
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.cumsum(toxic[order] + clean[order]) + toxic.sum())
    k = int(np.argmax(f1))
    low = bins[order[k + 1]] if k + 1 < len(order) else bins[order[k]] - BINS
    return float((bins[order[k]] + low) / 2 / BINS)


def calibrate(model: Classifier, counts: dict[str, np.ndarray], trained: tuple[int, int] = (0, 0)) -> None:
    """A threshold per language with enough toxic rows, drawn towards the common one by their number.

    counts: per language, rows by label and bin of the logit (2 x bins). trained: clean and toxic rows that are missing
    there because they trained; the others of their class weigh for them."""
    every = sum(counts.values(), np.zeros((2, 2 * FAR * BINS + 1)))
    rows = every.sum(axis=1)
    if not rows.all():
        return
    weights, bins = 1 + np.array(trained) / rows, np.arange(-FAR * BINS, FAR * BINS + 1)
    cut = lambda c: _best_cut(bins, c[1] * weights[1], c[0] * weights[0])
    common = cut(every)
    model.thresholds[""] = common
    for lang, mine in sorted(counts.items()):
        toxic = mine[1].sum()
        if lang and toxic >= 5 and mine[0].any():
            share = toxic / (toxic + 20)
            model.thresholds[lang] = float(share * cut(mine) + (1 - share) * common)


def _learning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(data).tobytes() for data in language_id.texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])


def trained(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[Classifier, DataFrame, tuple[int, int]]:
    """A classifier without thresholds, the labels (doc_id, toxic) that are left to calibrate it, and how many clean and toxic rows it learnt from.

    Only labels of docs whose crc32(doc_id) mod 5 is not 0 are used."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    wanted = F.when(F.col("toxic") == 1, toxic_rows / max(1, sizes.get(1, 0))).otherwise(clean_rows / max(1, sizes.get(0, 0)))
    trains = (chance < wanted) & (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(APART)) != 0)
    sample = known.where(trains)  # fewer than toxic_rows + clean_rows rows: bounded, so it may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    table = rows.mapInArrow(_learning, "doc_id bigint, toxic int, found binary").toPandas().sort_values(["doc_id", "toxic", "found"])
    languages = language_id.fit(docs, 5, 0, 400)
    found = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in table["found"]]
    marks = table["toxic"].to_numpy(int)
    if len(set(marks.tolist())) < 2:
        many = len(WIDTHS) * FILTERS
        model = Classifier(np.zeros((1 << LOG_BUCKETS, DIM), np.float32), [np.zeros((k, DIM, FILTERS), np.float32) for k in WIDTHS], np.zeros(many, np.float32), np.zeros(many, np.float32), -100.0, languages)
        return model, known.limit(0), (0, 0)
    toxic = int(marks.sum())
    return train(found, marks, languages), known.where(~trains), (len(marks) - toxic, toxic)


def measured(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, logit, shown) of every row of docs (doc_id, text): shown is the language of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** LOG_BUCKETS x DIM numbers and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            found = [(classifier.logit(data), likeliest(classifier.languages, data)) for data in language_id.texts(batch.column("text"))]
            columns = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "logit", "shown"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, logit double, shown string")


def histograms(logits: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Per language, rows by label and bin. Counts are summed by the executors; 2 x bins numbers a language at most reach the driver."""
    at = F.floor(F.greatest(F.least("logit", F.lit(float(FAR))), F.lit(float(-FAR))) * BINS).cast("int")
    counts = logits.join(labels, "doc_id").groupBy("shown", "toxic", at.alias("at")).agg(F.count("*").alias("n")).collect()
    out: dict[str, np.ndarray] = {}
    for row in counts:
        out.setdefault(row["shown"], np.zeros((2, 2 * FAR * BINS + 1)))[row["toxic"], row["at"] + FAR * BINS] = row["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Classifier:
    """Learns from labelled docs whose crc32(doc_id) mod 5 is not 0."""
    model, rest, learnt = trained(docs, labels, toxic_rows, clean_rows)
    calibrate(model, histograms(measured(docs, model), rest), learnt)
    return model


def _shifted(logits: DataFrame, model: Classifier) -> DataFrame:
    common = F.lit(float(model.thresholds.get("", 0.0)))
    cuts = [x for lang, cut in sorted(model.thresholds.items()) for x in (F.lit(lang), F.lit(float(cut)))]
    cut = F.coalesce(F.create_map(*cuts)[F.col("shown")], common) if cuts else common
    return logits.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(F.col("logit") - cut, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    return _shifted(measured(docs, model), model)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, rest, learnt = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    logits = written(measured(docs, model), "toxicity")  # read twice
    calibrate(model, histograms(logits, rest), learnt)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return _shifted(logits, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
