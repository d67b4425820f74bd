"""Adjustments of a hit's similarity: title words, tabular text, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passages.functions.text import fields, let, trim_ws

# Fixed values of the ranking.
TITLE_STEP = 0.06
TITLE_MAX = 0.24
TABLE_MAX = 0.18
CITED_BONUS = 0.08
TITLE_STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "what", "need", "has",
    "have", "are", "was", "were", "how", "does", "can", "you", "your",
]
TITLE_TRIM = r"""[.,?!;:"'()\[\]]+"""


def title_terms(query: Column) -> Column:
    trimmed = F.transform(
        fields(F.lower(query)),
        lambda w: F.regexp_replace(w, rf"^{TITLE_TRIM}|{TITLE_TRIM}\z", ""),
    )
    return F.filter(trimmed, lambda w: (F.octet_length(w) >= 3) & ~w.isin(TITLE_STOPWORDS))


def title_boost(title: Column, query: Column) -> Column:
    return let(F.lower(title), lambda lowered: boost_for_terms(lowered, title_terms(query)))


def boost_for_terms(lowered: Column, terms: Column) -> Column:
    """Boost of a lower-case title for the terms of a query, repeated ones included."""
    found = F.size(F.filter(terms, lambda w: F.contains(lowered, w)))
    return F.least(F.lit(TITLE_MAX), found * F.lit(TITLE_STEP))


def is_tabular(line: Column) -> Column:
    """A trimmed line that reads like a table row: mostly figures."""
    digits = F.regexp_count(line, F.lit(r"\p{Nd}"))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    pieces = fields(line)
    figures = F.size(F.filter(pieces, lambda p: p.rlike(r"^\p{Nd}+\z")))
    dense = (digits / F.nullif(digits + letters, F.lit(0)) > 0.4) & (F.octet_length(line) < 100)
    row = (figures >= 3) & (F.size(pieces) <= 10)
    return F.coalesce((digits + letters > 0) & (row | dense), F.lit(False))


def text_lines(text: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(text, "\n"), trim_ws), lambda x: x != "")


def table_penalty(text: Column) -> Column:
    # A tabular line has a digit and most prose has none, so the costly test runs on few lines.
    def share(lines: Column) -> Column:
        tabular = F.filter(F.filter(lines, lambda x: x.rlike(r"\p{Nd}")), is_tabular)
        return F.size(tabular) / F.nullif(F.size(lines), F.lit(0))

    penalty = F.coalesce(let(text_lines(text), share) * F.lit(TABLE_MAX), F.lit(0.0))
    return F.when(text.rlike(r"\p{Nd}"), penalty).otherwise(F.lit(0.0))


def adjusted(similarity: Column, boost: Column, penalty: Column, cited: Column) -> Column:
    bonus = F.when(cited, F.lit(CITED_BONUS)).otherwise(F.lit(0.0))
    return similarity + boost - penalty + bonus
