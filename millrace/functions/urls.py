"""URL functions as Column -> Column. Parts are cut by regular expression, so odd URLs never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import vocabulary

#: First host labels that name no company.
GENERIC_HOSTS = ("www", "careers", "jobs", "apply", "boards", "job-boards")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def _decoded(c: Column) -> Column:
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plain)


def _encoded(c: Column) -> Column:
    """As in a form: letters, digits and _.-~ stay, a space is a plus."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def kept_query(url: Column, dropped: tuple[str, ...]) -> Column:
    """The query string without the named parameters, decoded and encoded anew; a parameter without a value gets an empty one."""
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v"))
    pairs = F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), pair)
    kept = F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*dropped))
    return F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")


def _with(mark: str, part: Column) -> Column:
    return F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(mark), part))


_START = r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?)((?://[^/?#]*)?)([^?#]*)"


def sanitized(url: Column, dropped: tuple[str, ...] = vocabulary.SAVED_URL_PARAMETERS, ad_host: str = "adzuna.") -> Column:
    """Tracking parameters and credentials dropped, the fragment kept. On ad_host, /land/ad/<number> becomes /details/<number> and nothing follows."""
    clean = F.ltrim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(clean, _START, i)
    front = F.concat(F.lower(part(1)), F.when(part(2) == "//", "").otherwise(part(2)))
    ad = F.regexp_extract(part(3), r"^/land/ad/([0-9]+)", 1)
    whole = F.concat(front, part(3), _with("?", kept_query(clean, dropped)), _with("#", fragment(clean)))
    return F.when(F.lower(part(2)).contains(ad_host) & (ad != ""), F.concat(front, F.lit("/details/"), ad)).otherwise(whole)


def canonical(url: Column, dropped: tuple[str, ...] = vocabulary.HISTORY_URL_PARAMETERS) -> Column:
    """Scheme and host in lower case, the path without doubled or trailing slashes, no tracking parameters, no fragment."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(clean, _START, i)
    where = F.regexp_replace(F.regexp_replace(part(3), "/+$", ""), "/{2,}", "/")
    return F.concat(F.lower(part(1)), F.when(part(2) == "//", "").otherwise(F.lower(part(2))), where, _with("?", kept_query(clean, dropped)))


def is_valid(url: Column) -> Column:
    clean = F.trim(F.coalesce(url, F.lit("")))
    return (clean == "") | (scheme(clean).isin("http", "https") & (host(clean) != ""))


def company_label(url: Column) -> Column:
    """The first host label that is not generic; '' without one."""
    labels = F.filter(F.split(host(F.coalesce(url, F.lit(""))), r"\."), lambda x: ~x.isin(*GENERIC_HOSTS))
    return F.coalesce(F.get(labels, F.lit(0)), F.lit(""))


def region_scope(place: Column, rules: tuple[tuple[str, str], ...], other: str = "other") -> Column:
    """The bucket of the first rule (substring, bucket) that a place contains."""
    out, low = F.lit(other), F.lower(F.coalesce(place, F.lit("")))
    for part, bucket in reversed(rules):
        out = F.when(low.contains(part), F.lit(bucket)).otherwise(out)
    return out
