"""Text columns: white space, tokenisers, excerpts and query rewriting.

Every function takes and returns a Column and stays inside the JVM.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, written for a regular-expression class. Java and RE2 read it alike, while
# their own \s differ.
WS = (
    r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_RUN = f"[{WS}]+"
WS_ENDS = rf"^[{WS}]+|[{WS}]+\z"
# Runs of white space other than one blank, of which texts are full.
WS_ODD = f"[{WS.replace(' ', '', 1)}][{WS}]*| [{WS}]+"

# The same characters one by one.
WS_CHARS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Stands in for the sharp s while a text is put in capitals: it has no one-letter capital, and
# engines disagree on what to put instead.
_SHARP_S_HOLD = "\ue0df"

# Punctuation of typeset documents and its plain form.
PUNCTUATION = {
    "\u201c": '"',
    "\u201d": '"',
    "\u2018": "'",
    "\u2019": "'",
    "\u201a": "'",
    "\u201e": '"',
    "\u2032": "'",
    "\u2033": '"',
    "\u2026": "...",
    "\u2013": "-",
    "\u2014": "-",
    "\u2212": "-",
    "\u00a0": " ",
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
}

# Fixed value: one token of dice notation, not touching another word character.
DICE = (
    r"(?i)(?<![0-9A-Za-z_])(\d*d\d+(?:[+-]\d+)?|\d+d(?:[+-]\d+)?)(?![0-9A-Za-z_])"
)

ELLIPSIS = "\u2026"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, WS_ODD, " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c), F.lit("")) == ""


def fields(c: Column) -> Column:
    """White-space separated pieces."""
    return F.filter(F.split(c, WS_RUN), lambda x: x != "")


def normalize_punctuation(c: Column) -> Column:
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for char, plain in PUNCTUATION.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(char), F.lit(plain))
    return out


def upper_simple(c: Column) -> Column:
    """Capitals letter by letter, so that no letter becomes two."""
    held = F.upper(F.translate(c, "ß", _SHARP_S_HOLD))
    return F.translate(held, _SHARP_S_HOLD, "ß")


@cache
def accent_table() -> tuple[str, str]:
    """Letters that are a plain Latin letter plus one mark, and that letter."""
    marked, plain = [], []
    for point in range(0xC0, min(sys.maxunicode, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            marked.append(chr(point))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold(c: Column) -> Column:
    """Lower case without accents, as full-text terms are stored."""
    marked, plain = accent_table()
    folded = F.translate(F.lower(F.regexp_replace(c, r"\p{Mn}+", "")), marked, plain)
    # A text of one byte a letter has no accents.
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(folded)


def index_terms(c: Column) -> Column:
    """Full-text terms in order: runs of letters and numbers of the folded text."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def spaced_terms(c: Column) -> Column:
    """The same terms in one text, set apart by blanks; it may begin or end with one."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")


def count_words(c: Column) -> Column:
    """Words for frequency tables: capitals, letters and digits only, two bytes or longer."""
    pieces = F.split(upper_simple(c), r"[^\p{L}\p{Nd}]+")
    return F.filter(pieces, lambda x: F.octet_length(x) >= 2)


def embed_words(c: Column) -> Column:
    """Words for the hashed vector: punctuation inside a word is dropped, not split on."""
    kept = F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{Nd}}{WS}]+", "")
    return F.filter(F.split(kept, WS_RUN), lambda x: F.octet_length(x) > 1)


def spaced_words(c: Column) -> Column:
    """The same words, and those of one byte, in one text, set apart by blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{Nd}}{WS}]+", ""), WS_ODD, " ")


def flat_text(c: Column) -> Column:
    """Text on one line with plain punctuation, as snippets are cut from."""
    return collapse_ws(normalize_punctuation(c))


def snippet(text: Column, query: Column, width: int = 240, lead: int = 40) -> Column:
    """A window around the whole query where the text holds it, else the head of the text."""
    return let(
        flat_text(text),
        lambda flat: flat_snippet(flat, F.lower(flat), F.lower(trim_ws(query)), width, lead),
    )


def flat_snippet(
    flat: Column, lowered: Column, query: Column, width: int = 240, lead: int = 40
) -> Column:
    """The same for a flat text given with its lower-case form and a trimmed lower-case query."""

    def around(at: Column) -> Column:
        start = F.greatest(at - 1 - lead, F.lit(0))
        window = F.concat(trim_ws(F.substring(flat, start + 1, F.lit(width))), F.lit(ELLIPSIS))
        head = F.concat(F.left(flat, F.lit(width)), F.lit(ELLIPSIS))
        return F.when(at > 0, window).otherwise(head)

    return F.when(F.length(flat) <= width, flat).otherwise(let(F.instr(lowered, query), around))


def truncate_words(c: Column, n: int) -> Column:
    """The first n words and three dots; a shorter text only loses its outer white space."""
    words = fields(c)
    cut = F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))
    return F.when(F.size(words) > n, cut).otherwise(trim_ws(c))


def citation_excerpt(c: Column, n: int = 400) -> Column:
    words = fields(c)
    joined = F.array_join(F.slice(words, 1, n), " ")
    return F.when(F.size(words) > n, F.concat(joined, F.lit("..."))).otherwise(joined)


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(ELLIPSIS))).otherwise(c)


def flat_preview(c: Column, n: int) -> Column:
    return preview(collapse_ws(c), n)


def lower_all(words: Column) -> Column:
    return F.transform(words, F.lower)


def distinct_ignoring_case(words: Column) -> Column:
    """First spelling of every word, in order."""

    def keep_firsts(w: Column) -> Column:
        return let(
            lower_all(w),
            lambda low: F.filter(w, lambda x, i: F.array_position(low, F.lower(x)) == i + 1),
        )

    return let(words, keep_firsts)


def unseen(words: Column, seen: Column) -> Column:
    """Words that do not occur in ``seen``, whatever the capitals."""
    return let(
        lower_all(seen),
        lambda low: F.filter(words, lambda x: ~F.array_contains(low, F.lower(x))),
    )


def dice_tokens(c: Column) -> Column:
    return distinct_ignoring_case(F.regexp_extract_all(c, F.lit(DICE), F.lit(1)))


def keep_dice(original: Column, merged: Column) -> Column:
    """Append the dice tokens of the original query that the merged one lost."""
    dice = dice_tokens(original)
    whole = let(fields(merged), lambda w: F.array_join(F.concat(w, unseen(dice, w)), " "))
    return F.when(F.size(dice) == 0, merged).otherwise(whole)


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']+|["']+\z""", "")


def clean_keywords(reply: Column) -> Column:
    """Keywords out of a rewriter's reply: first line, no quotes, no commas."""
    first = F.regexp_extract(trim_ws(reply), r"^[^\n\r]*", 0)
    return F.array_join(fields(F.replace(_unquote(first), F.lit(","), F.lit(" "))), " ")


def merge_words(original: Column, rewritten: Column) -> Column:
    words = F.transform(F.concat(fields(original), fields(rewritten)), _unquote)
    return F.array_join(distinct_ignoring_case(F.filter(words, lambda x: x != "")), " ")
