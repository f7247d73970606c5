"""Text normalisers as Column -> Column functions. They differ on purpose: each keeps its own set of characters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _kept(c: Column, keep: str) -> Column:
    """Lower case, every run of characters outside `keep` to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{keep}]+", " "))


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


#: Characters that each plain normaliser keeps.
KEEP = {
    "search": r"a-z0-9+#.\-",
    "identity": r"\p{L}\p{N}_+#.\-",
    "fit": r"a-z0-9+#\-",
    "path": r"a-z0-9+#./\-",
    "keyword": r"a-z0-9+#",
    "company": r"a-z0-9&.+#\-",
}


def search_text(c: Column) -> Column:
    return _kept(c, KEEP["search"])


def key_text(c: Column) -> Column:
    return F.lower(collapse(c))


def identity_text(c: Column) -> Column:
    return _kept(c, KEEP["identity"])


def source_key(c: Column) -> Column:
    return F.regexp_replace(collapse(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))), " ", "_")


def fit_text(c: Column) -> Column:
    return padded(_kept(c, KEEP["fit"]))


def match_text(c: Column) -> Column:
    """Hyphens to spaces, punctuation kept, padded."""
    return padded(collapse(F.replace(F.lower(c), F.lit("-"), F.lit(" "))))


def path_text(c: Column) -> Column:
    return padded(_kept(c, KEEP["path"]))


def keyword_text(c: Column) -> Column:
    return padded(_kept(c, KEEP["keyword"]))


def plain_text(c: Column) -> Column:
    return _kept(c, KEEP["keyword"])


def company_key(c: Column) -> Column:
    return _kept(c, KEEP["company"])


def hash_text(c: Column) -> Column:
    """Lower case with white space collapsed, the input of normalised hashes. Compatibility forms are left as they are."""
    return F.lower(collapse(c))


#: Entities that are unescaped, in this order: the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def clean_html(c: Column) -> Column:
    """Entities unescaped, tags to spaces, white space collapsed."""
    out = F.coalesce(c, F.lit(""))
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), " ", " "))


def one_line(c: Column, strip: str = " \"'`.,;:-|") -> Column:
    return F.btrim(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\n\r_]", " ")), F.lit(strip))


#: Contact patterns, valid in Java and RE2.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>\"']+"
PHONE = r"\+?[0-9][0-9 ()./-]{8,18}[0-9]"


def redacted(c: Column, mark: str = "[redacted]") -> Column:
    """E-mail addresses, URLs and phone numbers masked, leading bullets dropped."""
    out = F.coalesce(c, F.lit(""))
    for pattern in (EMAIL, URL, PHONE):
        out = F.regexp_replace(out, pattern, mark)
    return collapse(F.regexp_replace(out, r"^[\s•*-]+", ""))


def source_line(c: Column) -> Column:
    """A Markdown line without bullet, number, emphasis, code marks and link targets."""
    out = F.regexp_replace(F.trim(c), r"^(?:[-*+•]|[0-9]+[.)])\s+", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return collapse(F.regexp_replace(out, r"[*`]+", ""))


def markdown(c: Column) -> Column:
    """Line ends unified, byte order mark dropped, line ends trimmed, blank lines squeezed."""
    out = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("﻿"), F.lit("")), r"\r\n?", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def pdf_page(c: Column) -> Column:
    """Words broken over lines joined, page-number lines dropped, blank lines squeezed."""
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z])-\n([a-z])", "$1$2")
    lines = F.filter(F.split(joined, "\n"), lambda x: ~F.trim(x).rlike(r"^(?i)(page )?[0-9]+( of [0-9]+)?$") | (F.trim(x) == ""))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


def unrepeated_lines(c: Column, noise: Column | None = None) -> Column:
    """Non-blank lines, noise out, without direct repeats of the line before (case-insensitively)."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), collapse), lambda x: x != "")
    if noise is not None:
        lines = F.filter(lines, lambda x: ~F.array_contains(noise, F.lower(x)))
    kept = F.filter(lines, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(lines, i - 1))))
    return F.array_join(kept, "\n")


def joined_lines(c: Column) -> Column:
    """Wrapped lines joined until a sentence's end; bullets and headings start lines of their own."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    step = lambda acc, x: F.when((acc == "") | acc.rlike(r"[.!?:]$") | x.rlike(r"^([-*•#]|[0-9]+[.)])"), F.concat(acc, F.when(acc == "", F.lit("")).otherwise(F.lit("\n")), x)).otherwise(F.concat(acc, F.lit(" "), x))
    return F.aggregate(lines, F.lit(""), step)


def slug(c: Column, empty: str = "unknown") -> Column:
    base = F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(base, F.lit("")), F.lit(empty))


def aliased(c: Column, aliases: Mapping[str, str]) -> Column:
    """A cleaned value replaced by its alias, found by lower case; others stay."""
    cleaned = F.btrim(collapse(c), F.lit(" .,;:-"))
    if not aliases:
        return cleaned
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(cleaned)), cleaned)


def title_case(c: Column, acronyms: tuple[str, ...] = ()) -> Column:
    """Words of one case to title case, acronyms to capitals; mixed case stays."""
    known = F.lit([a.lower() for a in acronyms]) if acronyms else F.array().cast("array<string>")
    fix = lambda w: F.when(F.array_contains(known, F.lower(w)), F.upper(w)).when((w == F.lower(w)) | (w == F.upper(w)), F.initcap(w)).otherwise(w)
    return F.array_join(F.transform(F.split(collapse(c), " "), fix), " ")


def company_case(c: Column, acronyms: tuple[str, ...] = ()) -> Column:
    """title_case, only for names all in one case."""
    name = collapse(c)
    return F.when((name == F.lower(name)) | (name == F.upper(name)), title_case(name, acronyms)).otherwise(name)


def masked_secrets(c: Column) -> Column:
    """Values of key-like parameters in error messages masked."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)(api[_-]?key|app[_-]?id|app[_-]?key|token|secret|password)([=: \"']+)[^\s&\"']+", "$1$2***")


def shortened(c: Column, limit: int = 120) -> Column:
    text = collapse(c)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def without_leading_timestamp(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4},?( [0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?[AaPp][Mm])?)?\s*", ""))


def filename_words(c: Column) -> Column:
    """A file name as words: extension, dates and long numbers dropped."""
    base = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[A-Za-z0-9]{1,5}$", "")
    words = F.regexp_replace(F.regexp_replace(base, r"[_-]+", " "), r"\b[0-9]{4,}\b", " ")
    return collapse(words)


def without_doubled_punctuation(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for pair, one in ((",,", ","), ("..", "."), (";;", ";"), (" ,", ","), (" .", ".")):
        out = F.replace(out, F.lit(pair), F.lit(one))
    return out


#: Tokens: letters, digits and inner + # . - ; two characters at least.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_+#.-]*[\p{L}\p{N}_]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]([\p{L}\p{N}_+#.-]*[\p{L}\p{N}_])?"))


def distinct_terms(c: Column, stop: tuple[str, ...] = (), least: int = 2) -> Column:
    """Distinct tokens of at least `least` characters, ends stripped of . and -, stop words out."""
    found = F.transform(tokens(c), lambda t: F.btrim(t, F.lit(".-")))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least))


def sentences(c: Column) -> Column:
    """Trimmed non-empty units, split at lines and behind . ! ?"""
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def accents_stripped(c: Column) -> Column:
    """Common Latin letters without their accents, after lower case."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
