"""Keywords, lines, sections, years, contacts and profiles out of texts. Vocabularies are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text

Catalog = Mapping[str, Sequence[str]]


def contains_phrase(padded: Column, phrase: str) -> Column:
    return padded.contains(f" {phrase} ")


def contains_alias(padded: Column, alias: str) -> Column:
    """Phrase containment; aliases of one or two letters or digits stand between other characters."""
    if len(alias) <= 2 and alias.isalnum():
        return padded.rlike(f"(^|[^a-z0-9]){alias}([^a-z0-9]|$)")
    return contains_phrase(padded, alias)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: as a lambda's variable it is not repeated in every use."""
    return F.transform(F.array(value), body)[0]


def named(padded: Column, catalog: Catalog) -> Column:
    """Keywords of which an alias occurs in a padded text, in catalog order."""
    return bound(padded, lambda p: F.array_compact(F.array(*[F.when(any_alias(p, aliases), F.lit(k)) for k, aliases in catalog.items()])))


def any_alias(padded: Column, aliases: Sequence[str]) -> Column:
    found = F.lit(False)
    for alias in aliases:
        found = found | contains_alias(padded, alias)
    return found


def keywords(c: Column, catalog: Catalog) -> Column:
    """Keywords with an alias in the text, in catalog order. A catalog is a few hundred entries: it is planned in line."""
    return named(text.keyword_text(c), {k: [k, *aliases] for k, aliases in catalog.items()})


def keyword_rows(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, keyword) for catalogs of any size: tokens joined to one-word aliases (keyword, alias)."""
    terms = docs.select(key, F.explode(F.array_distinct(F.split(F.trim(text.keyword_text(F.col(column))), " "))).alias("alias"))
    return terms.join(aliases, "alias").select(key, "keyword").distinct()


def lines(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, line): trimmed non-empty lines with their place."""
    exploded = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\n")).alias("pos", "raw"))
    return exploded.select(key, "pos", F.trim(F.regexp_replace("raw", r"^[\s\-•]+", "")).alias("line")).where("line <> ''")


def sections(rows: DataFrame, headings: Mapping[str, Sequence[str]], key: str = "doc_id") -> DataFrame:
    """lines() with the section that the last heading line above opened. headings: section -> lower-case names."""
    name = F.lower(F.rtrim(F.regexp_replace("line", r"^#+\s*", ""), F.lit(": ")))
    opened = F.lit(None).cast("string")
    for section, names in headings.items():
        opened = F.when(name.isin(*names), F.lit(section)).otherwise(opened)
    marked = rows.withColumn("opened", opened)
    current = F.last("opened", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("section", current).where(F.col("opened").isNull()).drop("opened")


def section_text(rows: DataFrame, section: str, key: str = "doc_id", limit: int = 12) -> DataFrame:
    """(key, text) of a section's first lines."""
    first = rows.where(F.col("section") == section).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("n") <= limit)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return first.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def demands(rows: DataFrame, catalog: Catalog, preferred: Sequence[str], key: str = "doc_id") -> DataFrame:
    """(key, keyword, demand): preferred if a preferring line names it, else required."""
    wish = any_alias(text.match_text(F.col("line")), preferred)
    found = rows.select(key, wish.alias("wish"), F.explode(keywords(F.col("line"), catalog)).alias("keyword"))
    return found.groupBy(key, "keyword").agg(F.when(F.max(F.col("wish").cast("int")) == 1, "preferred").otherwise("required").alias("demand"))


#: Numbers written as words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def stated_years(c: Column) -> Column:
    """Numbers that stand before the word year or years, as digits or words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    digits = F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]+(?:\.[0-9]+)?)\+? years?"), F.lit(1)), lambda x: x.cast("double"))
    table = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, float(v))])
    words = F.transform(F.regexp_extract_all(low, F.lit(f"({'|'.join(NUMBER_WORDS)}) years?"), F.lit(1)), lambda x: F.element_at(table, x))
    return F.concat(digits, words)


def contacts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, kind, found): contact data by line; a phone number has 10 to 15 digits and a separator."""
    # most lines have none: a plain containment test goes before each pattern
    some_digits = F.length(F.translate("line", "0123456789", "")) <= F.length("line") - 7
    kinds = (("email", text.EMAIL, F.contains("line", F.lit("@"))), ("url", text.URL, F.contains("line", F.lit("://"))), ("phone", text.PHONE, some_digits))

    def hits(kind: str, pattern: str, may: Column) -> Column:
        found = F.transform(F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
        return F.when(may, found).otherwise(F.array().cast("array<struct<kind:string,found:string>>"))

    found = F.flatten(F.array(*[hits(*kind) for kind in kinds]))
    out = rows.select(key, "pos", F.explode(found).alias("f")).select(key, "pos", "f.kind", "f.found")
    digits = F.length(F.regexp_replace("found", "[^0-9]", ""))
    return out.where((F.col("kind") != "phone") | (digits.between(10, 15) & F.col("found").rlike(r"[ +()./-]")))


def profile(c: Column, signals: Mapping[str, Mapping[str, int]], least: int = 4) -> Column:
    """The profile with the largest sum of signals contained as substrings, the first among equals; null below `least`."""
    low, sums = F.lower(F.coalesce(c, F.lit(""))), []
    for weights in signals.values():
        total = F.lit(0)
        for part, weight in weights.items():
            total = total + F.when(low.contains(part), weight).otherwise(0)
        sums.append(total)
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]
    out = F.lit(None).cast("string")
    for name, total in reversed(list(zip(signals, sums, strict=True))):
        out = F.when(total == best, F.lit(name)).otherwise(out)
    return F.when(best >= least, out)


def flags(c: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Labels whose phrases occur as substrings, in order."""
    low = F.lower(F.coalesce(c, F.lit("")))

    def hit(parts: Sequence[str]) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | low.contains(part)
        return found

    return F.array_compact(F.array(*[F.when(hit(parts), F.lit(label)) for label, parts in rules.items()]))


def snippets(c: Column, words: Sequence[str], limit: int = 3, width: int = 180) -> Column:
    """For each word the first line that has it, cut to width; distinct, at most limit."""
    rows = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    having = lambda w: F.filter(rows, lambda x: F.lower(x).contains(w))
    first = [F.get(having(w), F.lit(0)) for w in words]
    return F.slice(F.array_distinct(F.array_compact(F.array(*[F.substring(x, 1, width) for x in first]))), 1, limit)


def matches_query(query: str, *columns: Column) -> Column:
    """All words of the query are substrings of the columns together."""
    whole = F.lower(F.concat_ws(" ", *columns))
    found = F.lit(True)
    for word in query.lower().split():
        found = found & whole.contains(word)
    return found


def classified(c: Column, rules: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The label of the first rule of which a part occurs."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(other)
    for label, parts in reversed(rules):
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out
