"""Quality rules with adaptive thresholds. Native: DataFrame functions only.

Each document gets counts over its whole text. Mergeable KLL quantile sketches of the derived ratios
are kept per language and source, merged per language and for the corpus, and give upper fences
(a quantile plus a multiple of the distance between two, both the group's own); the fences are joined
to the documents, which are kept if they pass the base rule and every fence.

A fence leans on the wider group's by weight, at every size alike: a language's is (rows * own + PRIOR_ROWS * corpus's)
/ (rows + PRIOR_ROWS), and a source's is drawn to its language's in the same way. So a source of a few rows has nearly its
language's fences, one of thousands nearly its own. There are no floors. Ceilings are for groups that are junk by a quarter
or more, whose quantiles tell nothing: each is a parameter of its rule, and binds the group's own fence before the weighting.

Ratios that are zero for most documents are sketched as (n + 1) / (whole + 1): the quantiles then tell how
small a ratio the group's documents can show at all, and a fence is never zero. Documents are judged by n / whole.
Sketches of more than SKETCH rows are approximate (ranks within about 0.5 percent) and draw at random:
verdicts right at a fence may differ between runs.

Nulls: a null text has no words and fails the base rule; null lang or source form their own groups; a null doc_id is kept.
Ties and repeated rows are judged alike, row by row. An empty table gives an empty result. A group without a row that
passes the base rule has no fences; its rows fail anyway. Very long texts are counted whole, with arrays of their words.
Extra columns stay as they are; one whose name is a column's that is added here (counts, ratios, fences, verdicts) is an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, documents, written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5


@dataclass(frozen=True)
class Fence:
    """Of the ratio count / whole, values beyond high + spread * (high - low) are rejected; low and high are the group's quantiles of (count + extra) / (whole + extra). ceiling: for groups that are junk by a quarter or more, the fence never lies above it."""

    name: str
    count: str
    whole: str
    extra: int
    low: float
    high: float
    spread: float
    ceiling: float

    def ratio(self, extra: int = 0) -> Column:
        return (F.col(self.count) + extra) / F.greatest(F.col(self.whole) + extra, F.lit(1))


FENCES = (
    Fence("symbol_ratio", "n_symbols", "word_chars", 1, 0.25, 0.75, 6.0, 0.30),
    Fence("upper_ratio", "n_upper", "word_chars", 1, 0.25, 0.75, 6.0, 0.60),
    Fence("dup_line_ratio", "n_dup_lines", "n_lines", 1, 0.25, 0.50, 3.0, 0.80),
    Fence("word_length", "word_chars", "n_words", 0, 0.25, 0.75, 6.0, 40.0),
)
#: Where documents are all alike, high - low counts as this share of high at least.
LEAST_SPREAD = 0.025
#: Size parameter of the sketches.
SKETCH = 800
#: Rows that the fence of the wider group counts for in a group's own.
PRIOR_ROWS = 50
RATIOS = tuple(f.name for f in FENCES)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: it is bound as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words lying in windows that occur twice or more, from the hashes of all windows in order."""

    def of_pairs(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda i, j: pairs[i]["h"] == pairs[j]["h"]
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < n - 1) & same(F.least(i + 1, n - 1), i)))
        starts = F.sort_array(F.transform(twice, lambda i: pairs[i]["i"]))
        # each start covers WINDOW words, less what the next start covers again
        return _let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("sum"), x.alias("last")), lambda acc: acc["sum"]))

    indexed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(indexed, of_pairs))


def _repeated(hashes: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(WINDOW)]))
    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(_let(windows, _covered))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with the counts n_words, word_chars, n_symbols, n_upper, n_dup_lines, n_repeat_words (long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, SPACES), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words"))
    counts = _let(words, hashed)
    dup = _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    measured = {
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)),
        "n_upper": F.regexp_count(whole, F.lit("[A-Z]")),
        "n_dup_lines": dup,
        "n_lines": F.size(lines),
    }
    out = docs.withColumn("_counts", counts).withColumns({k: v.cast("long") for k, v in measured.items()})
    return out.withColumns({k: F.col("_counts")[k].cast("long") for k in ("n_words", "word_chars", "n_repeat_words")}).drop("_counts", text)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fences(measures: DataFrame) -> DataFrame:
    """One row per (lang_key, source_key): its fences. Sketches are merged from sources to languages to the corpus."""
    sketch = [F.kll_sketch_agg_double(f.ratio(f.extra), SKETCH).alias(f.name) for f in FENCES]
    by_source = measures.where(~F.col("base_failed")).groupBy("lang_key", "source_key").agg(F.count("*").alias("rows"), *sketch)
    merge = [F.kll_merge_agg_double(c, SKETCH) for c in RATIOS]
    by_lang = by_source.groupBy("lang_key").agg(F.sum("rows").alias("lang_rows"), *[m.alias(f"lang_{c}") for m, c in zip(merge, RATIOS, strict=True)])
    by_all = by_lang.groupBy().agg(*[F.kll_merge_agg_double(f"lang_{c}", SKETCH).alias(f"all_{c}") for c in RATIOS])
    near = by_source.join(by_lang, "lang_key").join(F.broadcast(by_all))  # by_all is a single row

    def own(f: Fence, of: str) -> Column:
        low, high = (F.kll_sketch_get_quantile_double(F.col(of + f.name), F.lit(q)) for q in (f.low, f.high))
        return F.least(high + f.spread * F.greatest(high - low, high * LEAST_SPREAD), F.lit(f.ceiling))

    def leaning(rows: str, mine: Column, wider: Column) -> Column:
        return (F.col(rows) * mine + PRIOR_ROWS * wider) / (F.col(rows) + PRIOR_ROWS)

    fence = {f.name: leaning("rows", own(f, ""), leaning("lang_rows", own(f, "lang_"), own(f, "all_"))) for f in FENCES}
    return near.select("lang_key", "source_key", *[c.alias(f"{name}_fence") for name, c in fence.items()])


def _added(extra: tuple[str, ...] = ()) -> set[str]:
    counts = {"n_words", "word_chars", "n_symbols", "n_upper", "n_dup_lines", "n_repeat_words", "n_lines"}
    return counts | {f.name for f in FENCES} | {f"{f.name}_fence" for f in FENCES} | {"base_failed", "kept", *extra}


def judged(docs: DataFrame) -> DataFrame:
    """docs without text, with counts, ratios, fences, base_failed and kept. Needs text, lang and source; written once to the shared folder between the two passes."""
    taken = {c.lower() for c in docs.columns} & _added(("_counts", "lang_key", "source_key"))
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null apart from every value
    measures = measured(docs).withColumns({"lang_key": key("lang"), "source_key": key("source"), "base_failed": base_failed()}).withColumns({f.name: f.ratio() for f in FENCES})
    measures = written(measures, "quality")
    passed = [F.col(f.name) <= F.col(f"{f.name}_fence") for f in FENCES]
    verdict = ~F.col("base_failed") & F.coalesce(passed[0] & passed[1] & passed[2] & passed[3], F.lit(True))
    return measures.join(fences(measures), ["lang_key", "source_key"], "left").withColumn("kept", verdict).drop("lang_key", "source_key")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs).select(*columns, *[f"{f.name}_fence" for f in FENCES])
