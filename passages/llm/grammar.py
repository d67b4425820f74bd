"""Cheapest repairs of conversations as min-plus matrices over a Re-Pair grammar of message symbols.

A message is one symbol: its role's initial and its fault. The matrix of a symbol says for every pair of
states what it costs to get from one to the other over that message, and by which edits. States are how
far the repaired roles have got in ``(s?(ua)+)?``: nothing, after a system message, after a user message,
after an answer. Matrices are multiplied with minimum for sum and sum for product; edits are joined as
ropes. Among equal costs the edits least in ASCII win, which can be decided part by part: an entry's edits
end with a message's own edit and hold one of these per message, so none is the beginning of another.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

# Symbols of messages: initial of the role ("x" for any other), then the fault. Fixed order.
INITIALS = "suax"
FAULTS = ["", "truncated", "blank", "duplicate"]
SYMBOLS = [(i, f) for i in INITIALS for f in FAULTS]
FIRST = ord("A")  # a message's letter is its place in SYMBOLS counted from here
TERMINALS = len(SYMBOLS)

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ANSWER = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWER, (ANSWER, "u"): USER}
LEGAL = {"su", "ua", "au"}
LEAF = 256  # edits up to this many are one string, longer ones a tree


class Rope:
    """Edits as a tree of strings that share their parts."""

    __slots__ = ("text", "left", "right", "length")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.length = len(text) if text is not None else left.length + right.length

    def __add__(self, other: Rope) -> Rope:
        if not self.length or not other.length:
            return self if self.length else other
        if self.length + other.length <= LEAF:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def parts(self) -> Iterator[str]:
        left = [self]
        while left:
            rope = left.pop()
            if rope.text is not None:
                yield rope.text
            else:
                left += [rope.right, rope.left]

    def __str__(self) -> str:
        return "".join(self.parts())

    def __lt__(self, other: Rope) -> bool:
        if self is other:
            return False
        ours, theirs = self.parts(), other.parts()
        a = b = ""
        while True:
            a, b = a or next(ours, ""), b or next(theirs, "")
            size = min(len(a), len(b))
            if not size:
                return len(a) < len(b)
            if a[:size] != b[:size]:
                return a[:size] < b[:size]
            a, b = a[size:], b[size:]


@dataclass(frozen=True)
class Part:
    """What a run of messages does: its ends' initials, its counts, and its matrix of (cost, edits)."""

    first: str
    last: str
    illegal: int
    truncated: int
    blank: int
    duplicate: int
    cells: tuple  # (cost, rope) or None, by 4 * state before + state after

    def __add__(self, other: Part) -> Part:
        return Part(
            self.first, other.last, self.illegal + other.illegal + (self.last + other.first not in LEGAL),
            self.truncated + other.truncated, self.blank + other.blank, self.duplicate + other.duplicate,
            _times(self.cells, other.cells),
        )


def _better(one, two):
    if one is None or two is None:
        return two if one is None else one
    return two if (two[0], two[1]) < (one[0], one[1]) else one


def _times(left: tuple, right: tuple) -> tuple:
    cells = []
    for a in STATES:
        for c in STATES:
            best = None
            for b in STATES:
                x, y = left[4 * a + b], right[4 * b + c]
                if x is None or y is None:
                    continue
                cost = x[0] + y[0]
                if best is None or cost <= best[0]:
                    edits = x[1] + y[1]
                    if best is None or cost < best[0] or edits < best[1]:
                        best = (cost, edits)
            cells.append(best)
    return tuple(cells)


def inserted(state: int) -> list[int]:
    """States reached by inserting no, one or two messages; more never pay, as they lead back."""
    one = {START: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
    out = [state]
    while one[out[-1]] not in out:
        out.append(one[out[-1]])
    return out


def terminal(initial: str, fault: str) -> Part:
    cells: list = [None] * 16
    for a in STATES:
        for n, b in enumerate(inserted(a)):
            before = INSERT * n
            edits = [(DELETE, "D", b)]
            if fault in ("", "truncated"):
                more = UNFINISHED if fault else 0
                if (b, initial) in NEXT:
                    edits.append((KEEP + more, "K", NEXT[b, initial]))
                edits += [(REROLE + more, "R", NEXT[b, role]) for role in "ua" if (b, role) in NEXT]
            for cost, letter, c in edits:
                cells[4 * a + c] = _better(cells[4 * a + c], (before + cost, Rope("I" * n + letter)))
    counts = [int(fault == f) for f in FAULTS[1:]]
    return Part(initial, initial, 0, *counts, tuple(cells))


def ending(state: int) -> tuple[int, str] | None:
    """Cost and edits of getting from ``state`` to a whole conversation."""
    n = {START: 0, ANSWER: 0, USER: 1, SYSTEM: 2}[state]
    return INSERT * n, "I" * n


def evaluate(rules: Sequence[tuple[int, int]]) -> list[Part]:
    """Parts of all symbols: the messages' first, then each rule's from those of its two symbols."""
    parts = [terminal(*s) for s in SYMBOLS]
    for left, right in rules:
        parts.append(parts[left] + parts[right])
    return parts


def disjoint(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs, in their order, that can be replaced at once: no symbol starts one and ends another."""
    starts, ends, chosen = set(), set(), []
    for a, b in pairs:
        if a in ends or b in starts or (a == b and a in starts):
            continue
        if a == b and b in ends:
            continue
        chosen.append((a, b))
        starts.add(a)
        ends.add(b)
    return chosen


def replaced(codes: Sequence[int], named: dict[tuple[int, int], int]) -> list[int]:
    """Symbols with every chosen pair replaced, from the left."""
    out, i = [], 0
    while i < len(codes):
        new = named.get((codes[i], codes[i + 1])) if i + 1 < len(codes) else None
        out.append(codes[i] if new is None else new)
        i += 1 if new is None else 2
    return out


def pair_counts(codes: Sequence[int]) -> Counter:
    """How often each pair of neighbours occurs; of overlapping equal pairs, as in aaa, every second."""
    found: Counter = Counter()
    skip = False
    for i in range(len(codes) - 1):
        a, b = codes[i], codes[i + 1]
        if a == b and skip:
            skip = False
            continue
        found[a, b] += 1
        skip = a == b and i + 2 < len(codes) and codes[i + 2] == a
    return found


def folded(codes: Sequence[int], parts: Sequence[Part]) -> Part:
    """Part of a run of symbols, by halves so that ropes stay shallow."""
    runs = [parts[c] for c in codes]
    while len(runs) > 1:
        runs = [runs[i] + runs[i + 1] if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]
