"""Named gaps of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text


def warnings(company: Column, title: Column, place: Column, url_ok: Column, n_words: Column) -> Column:
    """Named gaps of a record, in a fixed order."""
    return F.array_compact(F.array(
        F.when(text.collapse(company) == "", "company missing"),
        F.when(text.collapse(title) == "", "title missing"),
        F.when(text.collapse(place) == "", "location missing"),
        F.when(~url_ok, "url invalid"),
        F.when(n_words < 60, "description short"),
    ))
