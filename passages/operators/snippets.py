"""Snippets of sections around each term of their book, words of a text looked up once and not term by term."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions.text import ELLIPSIS, flat_snippet, flat_text, trim_ws
from passages.session import broadcast_if_small
from passages.sources.tables import stage

WIDTH = 240
LEAD = 40
# Distinct words whose terms a task keeps, and letters of the longest of them.
KEPT_WORDS = 300_000
KEPT_LETTERS = 64
# Letters that terms are told apart by at first.
BEGINNING = 3

_WORD = re.compile(r"\w+")


def book_term_snippets(sections: DataFrame, terms: DataFrame) -> DataFrame:
    """(section_id, term, snippet): every section beside every one of ``terms`` (pdf_id, term) of its book.

    A snippet is a window around the term's first place in the text, or the head of the text. Most
    terms are not in a text: the head is made once per section, and windows are made in one pass
    over the text, for the terms that it holds. Terms beyond the bounds of a broadcast are sought
    one by one where a shuffle brings them together with the texts.
    """
    nth = F.row_number().over(Window.partitionBy("pdf_id").orderBy("term")).alias("_nth")
    terms = stage(terms.select("pdf_id", "term", F.lower(trim_ws(F.col("term"))).alias("_asked"), nth), "book-terms")
    flat = stage(sections.select("section_id", "pdf_id", flat_text(F.col("plain_text")).alias("_flat")), "flat-texts")
    sent = broadcast_if_small(terms)
    if sent is terms:
        snippet = flat_snippet(F.col("_flat"), F.col("_lowered"), F.col("_asked"), WIDTH, LEAD)
        return flat.withColumn("_lowered", F.lower("_flat")).join(terms, "pdf_id").select("section_id", "term", snippet.alias("snippet"))
    met = _windows(flat, terms).join(sent.drop("_asked"), "pdf_id")
    met = met.withColumn("_at", F.array_position("_nths", F.col("_nth")))
    snippet = F.when(F.col("_at") > 0, F.get("_found", (F.col("_at") - 1).cast("int"))).otherwise(F.col("_head"))
    return met.select("section_id", "term", snippet.alias("snippet"))


def _windows(flat: DataFrame, terms: DataFrame) -> DataFrame:
    """(section_id, pdf_id, _head, _nths, _found): what is shown of a section for the terms it lacks and for those it holds."""
    long = F.length("_flat") > WIDTH
    head = F.when(long, F.concat(F.left("_flat", F.lit(WIDTH)), F.lit(ELLIPSIS))).otherwise(F.col("_flat"))
    given = flat.select(
        "section_id", "pdf_id", head.alias("_head"), F.when(long, F.col("_flat")).alias("_flat"), F.when(long, F.lower("_flat")).alias("_lowered")
    )
    kept = [given.schema[c] for c in ("section_id", "pdf_id", "_head")]
    made = {"_nths": T.ArrayType(T.IntegerType()), "_found": T.ArrayType(T.StringType())}
    rows = terms.toArrow()
    books = _books(*(rows[c].to_pylist() for c in ("pdf_id", "_asked", "_nth")))
    asked = sorted({t for own in books.values() for t in own})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(asked)
        for batch in batches:
            nths, found = [], []
            for book, text, lowered in zip(*(batch.column(c) for c in ("pdf_id", "_flat", "_lowered")), strict=True):
                own, text = books.get(book.as_py()), text.as_py()
                places = finder.places(lowered.as_py(), own) if own and text is not None else {}
                numbered = [(n, at) for t, at in places.items() for n in own[t]]
                nths.append([n for n, _ in numbered])
                found.append([window(text, at) for _, at in numbered])
            columns = [batch.column(f.name) for f in kept]
            new = [pa.array(nths, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *new], [*(f.name for f in kept), *made])

    return given.mapInArrow(run, T.StructType([*kept, *(T.StructField(*m) for m in made.items())]))


def _books(books: list, asked: list, nths: list) -> dict:
    """The numbers of each asked text, by book; null terms are never found."""
    made: dict = {}
    for book, text, nth in zip(books, asked, nths, strict=True):
        if text is not None:
            made.setdefault(book, {}).setdefault(text, []).append(nth)
    return made


def window(text: str, at: int) -> str:
    """What is shown of a flat text, whose only white space are blanks, around a place."""
    start = max(at - LEAD, 0)
    return text[start : start + WIDTH].strip(" ") + ELLIPSIS


class Finder:
    """Finds which of many terms stand anywhere in a text, and where first.

    A term of word characters alone lies within a word of the text, so the distinct words are looked
    up, by the beginnings that terms have. The terms of a word are kept for the next texts. Terms of
    one or two letters, of which there are few, are sought as they are.
    """

    def __init__(self, terms: Iterable[str]):
        terms = set(terms)
        self.begun: dict[str, list[str]] = {}
        for t in terms:
            if len(t) >= BEGINNING and _WORD.fullmatch(t):
                self.begun.setdefault(t[:BEGINNING], []).append(t)
        self.other = terms.difference(*self.begun.values())
        self.known: dict[str, tuple[str, ...]] = {}

    def places(self, text: str, of: Iterable[str]) -> dict[str, int]:
        """Those terms ``of`` the known ones that ``text`` holds, with their first places."""
        held = set(self.other)
        for word in set(_WORD.findall(text)):
            own = self.known.get(word)
            if own is None:
                own = self._within(word)
            if own:
                held.update(own)
        return {t: at for t in held.intersection(of) if (at := text.find(t)) >= 0}

    def _within(self, word: str) -> tuple[str, ...]:
        starts = range(len(word) - BEGINNING + 1)
        own = tuple(t for i in starts for t in self.begun.get(word[i : i + BEGINNING], ()) if word.startswith(t, i))
        if len(word) <= KEPT_LETTERS:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = own
        return own
