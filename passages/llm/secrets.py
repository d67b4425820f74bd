"""Secret scan: known patterns, plus windows of high Shannon entropy in candidate strings.

Known patterns give the base spans. Further spans come from candidate strings, which are runs of one
character class: a window slides over each, its character counts and the sum of c * log2(c) are
brought up to date for the entering and the leaving character, and windows whose entropy reaches the
class's threshold are merged into spans. An allow-list then drops spans that are something else
(plain words and paths, numbers, UUIDs). All of it is DataFrame expressions; positions count code
points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import let


class Pattern(NamedTuple):
    """A kind of secret: a match counts if its given group is long enough."""

    kind: str
    regex: str
    group: int
    shortest: int


class EntropyClass(NamedTuple):
    """A character class: candidates are its runs of at least ``window`` characters."""

    kind: str
    alphabet: str
    regex: str
    window: int
    threshold: float


# Given patterns. Fixed values. The last two are written with their least lengths; as they match
# whole runs, these are the matches that are long enough.
PATTERNS = (
    Pattern(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 8,
    ),
    Pattern("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Pattern("hex", r"[0-9a-f]{32,}", 0, 32),
)

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("entropy_hex", "0123456789abcdefABCDEF", r"[0-9A-Fa-f]{24,}", 24, 3.3),
    EntropyClass("entropy_base64", _LETTERS + "0123456789+/_=-", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
)

# What the method's spans may look like without being secrets: no digit, no letter, or a UUID.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)

SPAN = "array<struct<start:int,end:int,kind:string>>"
_PIECE = 256


def running_starts(lengths: Column) -> Column:
    """Sum of all earlier numbers for each number of an array, in bounded pieces so that it stays near linear."""

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)

    def inside(numbers: Column) -> Column:
        return F.transform(numbers, lambda _, i: total(F.slice(numbers, 1, i)))

    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / _PIECE).cast("int") - 1, F.lit(0))),
        lambda p: F.slice(lengths, p * _PIECE + 1, _PIECE),
    )
    return let(
        pieces,
        lambda ps: let(
            F.transform(ps, total),
            lambda sums: F.flatten(
                F.transform(
                    ps,
                    lambda piece, p: let(
                        total(F.slice(sums, 1, p)),
                        lambda base: F.transform(inside(piece), lambda x: x + base),
                    ),
                )
            ),
        ),
    )


def _matches(text: Column, regex: str, body: Callable[[Column, Column], Column]) -> Column:
    """body(matches, starts) for the leftmost non-overlapping matches of a regex that is never empty."""
    lengths = lambda strings: F.transform(strings, F.length)
    return let(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
        lambda found: let(
            running_starts(
                F.zip_with(
                    lengths(F.split(text, regex, -1)), lengths(found), lambda a, b: a + F.coalesce(b, F.lit(0))
                )
            ),
            lambda before: let(
                lengths(F.split(text, regex, -1)),
                lambda gaps: body(found, F.zip_with(before, gaps, lambda a, b: a + b)),
            ),
        ),
    )


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def pattern_spans(text: Column, pattern: Pattern) -> Column:
    """Spans of a pattern's matches whose group is long enough."""

    def pick(found: Column, starts: Column) -> Column:
        kept = F.transform(
            found,
            lambda m, i: F.when(
                F.length(F.regexp_extract(m, pattern.regex, pattern.group)) >= pattern.shortest,
                _span(F.get(starts, i), F.get(starts, i) + F.length(m), pattern.kind),
            ),
        )
        return F.filter(kept, lambda x: x.isNotNull())

    spans = _matches(text, pattern.regex, pick)
    return F.when(text.rlike(pattern.regex), spans).otherwise(F.array().cast(SPAN))


def hot_windows(candidate: Column, cls: EntropyClass) -> Column:
    """(start, end) spans that windows of high entropy cover in one candidate string.

    Positions are those in the candidate. The state holds one count per character of the class and
    the sum of c * log2(c); each step changes two counts.
    """
    w = cls.window
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(cls.alphabet), c))
    weigh = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    start = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )

    def scan(code: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(code, i), F.coalesce(F.get(code, i - w), F.lit(0))
            counted = let(
                F.get(state["counts"], enters),
                lambda c: let(
                    F.get(state["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0),
                    lambda d: state["sum"] - weigh(c) + weigh(c + 1)
                    + F.when(i >= w, weigh(d - 1) - weigh(d)).otherwise(F.lit(0.0)),
                ),
            )
            counts = F.transform(
                state["counts"],
                lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when((k == leaves) & (i >= w), 1).otherwise(0),
            )

            def note(total: Column) -> Column:
                entropy = F.log2(F.lit(float(w))) - total / w
                first, last = i - w + 1, F.get(state["spans"], F.size(state["spans"]) - 1)
                window = lambda a: F.array(F.struct(a.cast("int").alias("start"), (i + 1).cast("int").alias("end")))
                grown = F.when(
                    last.isNotNull() & (last["end"] >= first),
                    F.concat(F.slice(state["spans"], 1, F.size(state["spans"]) - 1), window(last["start"])),
                ).otherwise(F.concat(state["spans"], window(first)))
                hot = (i >= w - 1) & (entropy >= cls.threshold)
                return F.struct(
                    counts.alias("counts"), total.alias("sum"),
                    F.when(hot, grown).otherwise(state["spans"]).alias("spans"),
                )

            return let(counted, note)

        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), start, step, lambda s: s["spans"])

    return let(codes, scan)


def entropy_spans(text: Column, cls: EntropyClass, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of high entropy in the candidates of a class, without those on the allow-list."""

    def allow(part: Column) -> Column:
        fits = F.lit(False)
        for regex in allowed:
            fits = fits | part.rlike(regex)
        return fits

    def pick(found: Column, starts: Column) -> Column:
        per_candidate = F.transform(
            found,
            lambda m, i: F.transform(
                F.filter(
                    hot_windows(m, cls), lambda s: ~allow(F.substring(m, s["start"] + 1, s["end"] - s["start"]))
                ),
                lambda s: _span(F.get(starts, i) + s["start"], F.get(starts, i) + s["end"], cls.kind),
            ),
        )
        return F.flatten(per_candidate)

    spans = _matches(text, cls.regex, pick)
    return F.when(text.rlike(cls.regex), spans).otherwise(F.array().cast(SPAN))


def _by_start(spans: Column, kinds: Sequence[str]) -> Column:
    rank = lambda s: F.array_position(F.lit(list(kinds)), s["kind"])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )


def find_secrets(
    docs: DataFrame, text: str = "text", patterns: Sequence[Pattern] = PATTERNS,
    classes: Sequence[EntropyClass] = CLASSES, allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``entropy_spans`` added: arrays of (start, end, kind).

    Both are ordered by start, then by kind as listed. A null text counts as empty and has none. The
    allow-list concerns the entropy spans only.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.flatten(F.array(*[pattern_spans(whole, p) for p in patterns]))
    added = F.flatten(F.array(*[entropy_spans(whole, c, allowed) for c in classes]))
    return docs.withColumns(
        {
            "base_spans": _by_start(base, [p.kind for p in patterns]),
            "entropy_spans": _by_start(added, [c.kind for c in classes]),
        }
    )


def all_spans(base: Column, added: Column) -> Column:
    """Both kinds of spans together, by start and then by kind as listed."""
    return _by_start(F.concat(base, added), [k.kind for k in (*PATTERNS, *CLASSES)])


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def merged_spans(spans: Column) -> Column:
    """Overlapping or touching spans made one: (start, end) in order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(
            last.isNotNull() & (s["start"] <= last["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), joined),
        ).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int>>"), add)


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span replaced by a mark."""

    def rebuild(cut: Column) -> Column:
        pieces = F.transform(
            cut,
            lambda s, i: let(
                F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(0),
                lambda start: F.concat(F.substring(text, start + 1, s["start"] - start), F.lit(mark)),
            ),
        )
        end = F.get(cut, F.size(cut) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(merged_spans(spans), rebuild)).otherwise(text)
