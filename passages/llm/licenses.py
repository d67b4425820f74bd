"""License scans: ordered signature rules behind a keyword gate, overlapping detections resolved by priority.

A text is reduced to its lower-case words with one space between. A rule is a regex over that form, a
label, a priority and the words without which it cannot match; a text is searched by a rule only if it
holds all of them. A detection goes when another of higher priority (or of the same priority and more
words, or the same words and an earlier rule) covers its words. What one text needs depends on that
text alone, so nothing is shuffled and no text meets another.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that always count, and their labels, as the contract gives them. Fixed values.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Priorities, best first, and how sure a detection of each makes the scan. A base phrase has the last one's.
IDENTIFIER, GRANT, VERSIONED, NAMED, HINT = range(5)
SURE = [0.99, 0.97, 0.9, 0.7, 0.5]

# Hand-written signatures, in order: priority, label, words needed, regex over lower-case words.
# A blank in a regex is the blank between words; `{v}` stands for each version of the family.
GNU = [
    (IDENTIFIER, "{f}-{v}-only", "spdx {a}", "spdx license identifier {a} {w}(?: 0)? only"),
    (IDENTIFIER, "{f}-{v}-or-later", "spdx {a}", "spdx license identifier {a} {w}(?: 0)? or later"),
    (IDENTIFIER, "{f}-{v}", "spdx {a}", "spdx license identifier {a} {w}(?: 0)?"),
    (GRANT, "{f}-{v}-or-later", "license later version", "(?:gnu )?{n}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{w}(?: 0)?(?: of the license)? or (?:at your option )?any later version"),
    (GRANT, "{f}-{v}-only", "license only", "(?:gnu )?{n}(?: as published by the free software foundation)? (?:version |v ?)?{w}(?: 0)? only"),
    (GRANT, "{f}-{v}-or-later", "{a} later", "{a} (?:version |v ?)?{w}(?: 0)? or later"),
    (GRANT, "{f}-{v}-only", "{a} only", "{a} (?:version |v ?)?{w}(?: 0)? only"),
    (VERSIONED, "{f}-{v}", "license", "(?:gnu )?{n}(?: as published by the free software foundation)? (?:version |v ?)?{w}(?: 0)?"),
    (VERSIONED, "{f}-{v}", "{a}", "{a} (?:version |v ?)?{w}(?: 0)?"),
    (VERSIONED, "{f}-{v}", "{a}v{m}", "{a}v{w}(?: 0)?"),
    (VERSIONED, "{f}-{v}", "gnu org", "gnu org (?:copyleft|licenses|licenses old licenses) {a} {w}(?: 0)?"),
]
# Family, abbreviation, name, versions.
GNU_FAMILIES = [
    ("gpl", "gpl", "general public license", "1 2 3"),
    ("lgpl", "lgpl", "(?:lesser|library) general public license", "2 2.1 3"),
    ("agpl", "agpl", "affero general public license", "1 3"),
    ("gfdl", "gfdl", "free documentation license", "1.1 1.2 1.3"),
]
COMMONS = [
    (IDENTIFIER, "cc-{f}-{v}", "spdx cc", "spdx license identifier cc {s} {w}"),
    (GRANT, "cc-{f}-{v}", "licensed cc", "licensed under(?: a| the)? cc {s} {w}"),
    (VERSIONED, "cc-{f}-{v}", "cc", "cc {s} {w}"),
    (VERSIONED, "cc-{f}-{v}", "commons attribution", "creative commons attribution{n} {w}(?: international| unported| generic)?(?: public)?(?: license)?"),
    (VERSIONED, "cc-{f}-{v}", "creativecommons", "creativecommons org licenses {s} {w}"),
]
COMMONS_PLAIN = [
    (NAMED, "cc-{f}", "cc", "cc {s}"),
    (NAMED, "cc-{f}", "commons attribution", "creative commons attribution{n}"),
]
# Suffix of the label and the name between "attribution" and the version.
COMMONS_FAMILIES = [
    ("by", ""), ("by-sa", " share ?alike"), ("by-nc", " non ?commercial"), ("by-nd", " no ?deriv(?:atives|s)?(?: works)?"),
    ("by-nc-sa", " non ?commercial share ?alike"), ("by-nc-nd", " non ?commercial no ?deriv(?:atives|s)?(?: works)?"),
]
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
# Licenses known by a name and a version.
VERSIONED_RULES = [
    (IDENTIFIER, "{f}-{v}", "spdx {a}", "spdx license identifier {a} {w}"),
    (GRANT, "{f}-{v}", "under {k}", "(?:licensed|released|distributed|available|published|provided) under(?: the terms of)?(?: the)? {n}(?: version | v ?| ){w}"),
    (VERSIONED, "{f}-{v}", "{k}", "{n}(?: version | v ?| ){w}"),
    (VERSIONED, "{f}-{v}", "{a}", "{a}(?: version | v ?| ){w}"),
    (VERSIONED, "{f}-{v}", "licenses {a}", "licenses {a} {w}"),
]
NAMED_RULES = [(NAMED, "{f}", "{k}", "{n}")]
# Label, abbreviation, a word of the name, name, versions.
VERSIONED_FAMILIES = [
    ("apache", "apache", "apache", "apache (?:software )?license", "1.0 1.1 2.0"),
    ("mpl", "mpl", "mozilla", "mozilla public license", "1.0 1.1 2.0"),
    ("epl", "epl", "eclipse", "eclipse public license", "1.0 2.0"),
    ("cpl", "cpl", "common", "common public license", "1.0"),
    ("cddl", "cddl", "distribution", "common development and distribution license", "1.0 1.1"),
    ("artistic", "artistic", "artistic", "(?:perl )?artistic license", "1.0 2.0"),
    ("eupl", "eupl", "european", "european union public licen[cs]e", "1.0 1.1 1.2"),
    ("ofl", "ofl", "font", "(?:sil )?open font license", "1.0 1.1"),
    ("osl", "osl", "open", "open software license", "1.0 2.0 2.1 3.0"),
    ("afl", "afl", "academic", "academic free license", "1.1 1.2 2.0 2.1 3.0"),
    ("lppl", "lppl", "latex", "latex project public license", "1.0 1.1 1.2 1.3"),
    ("bsl", "bsl", "boost", "boost software license", "1.0"),
    ("zpl", "zpl", "zope", "zope public license", "1.1 2.0 2.1"),
    ("php", "php", "php", "php license", "3.0 3.01"),
    ("psf", "psf", "python", "python (?:software foundation )?license", "2"),
    ("qpl", "qpl", "q", "q public license", "1.0"),
    ("apsl", "apsl", "apple", "apple public source license", "1.0 1.1 1.2 2.0"),
    ("cecill", "cecill", "cecill", "cecill(?: free software license agreement)?", "1.0 1.1 2.0 2.1"),
    ("odbl", "odbl", "database", "open database license", "1.0"),
    ("sspl", "sspl", "side", "server side public license", "1"),
    ("busl", "busl", "business", "business source license", "1.1"),
    ("elastic", "elastic", "elastic", "elastic license", "2.0"),
    ("ms-pl", "ms", "microsoft", "microsoft public license", "1.0"),
    ("upl", "upl", "universal", "universal permissive license", "1.0"),
    ("mulan-psl", "mulan", "mulan", "mulan permissive software license", "1 2"),
]
PLAIN = [
    (IDENTIFIER, "mit", "spdx mit", "spdx license identifier mit(?: license)?"),
    (IDENTIFIER, "isc", "spdx isc", "spdx license identifier isc"),
    (IDENTIFIER, "zlib", "spdx zlib", "spdx license identifier zlib"),
    (IDENTIFIER, "unlicense", "spdx unlicense", "spdx license identifier unlicense"),
    (IDENTIFIER, "bsd-2-clause", "spdx bsd", "spdx license identifier bsd 2 clause"),
    (IDENTIFIER, "bsd-3-clause", "spdx bsd", "spdx license identifier bsd 3 clause"),
    (IDENTIFIER, "bsd-4-clause", "spdx bsd", "spdx license identifier bsd 4 clause"),
    (IDENTIFIER, "0bsd", "spdx 0bsd", "spdx license identifier 0bsd"),
    (IDENTIFIER, "cc0-1.0", "spdx cc0", "spdx license identifier cc0 1 0"),
    (IDENTIFIER, "wtfpl", "spdx wtfpl", "spdx license identifier wtfpl"),
    (GRANT, "mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (GRANT, "mit", "mit under", "(?:licensed|released|distributed|available|published|provided) under(?: the terms of)?(?: the)? mit(?: license)?"),
    (GRANT, "isc", "permission hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (GRANT, "bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    (GRANT, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledg?ement"),
    (GRANT, "bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    (GRANT, "zlib", "warranty held", "provided as is without any express or implied warranty in no event will the authors be held liable"),
    (GRANT, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (GRANT, "wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    (GRANT, "beerware", "beer", "you can buy me a beer in return"),
    (GRANT, "apache-2.0", "apache except compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    (GRANT, "gpl", "redistribute gnu", "redistribute it and or modify it under the terms of the gnu general public license"),
    (GRANT, "lgpl", "redistribute gnu modify", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (GRANT, "agpl", "redistribute affero", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    (GRANT, "cc0-1.0", "waived", "has waived all copyright and related(?: or| and) neighboring rights"),
    (GRANT, "openssl", "openssl", "this product includes software developed by the openssl project"),
    (VERSIONED, "bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: license)?|bsd (?:2|two) clause(?: license)?|simplified bsd license"),
    (VERSIONED, "bsd-2-clause", "freebsd", "freebsd license"),
    (VERSIONED, "bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: license)?|bsd (?:3|three) clause(?: license)?|(?:new|modified|revised) bsd license"),
    (VERSIONED, "bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: license)?|bsd (?:4|four) clause(?: license)?|original bsd license"),
    (VERSIONED, "0bsd", "bsd", "(?:0|zero) clause bsd(?: license)?|bsd (?:0|zero) clause(?: license)?"),
    (VERSIONED, "cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    (VERSIONED, "cc0-1.0", "creativecommons zero", "creativecommons org publicdomain zero 1 0"),
    (VERSIONED, "pdm-1.0", "creativecommons mark", "creativecommons org publicdomain mark 1 0"),
    (VERSIONED, "ncsa", "illinois", "university of illinois(?: ncsa)? open source license"),
    (NAMED, "gpl", "gpl", "(?:gnu )?gpl"),
    (NAMED, "lgpl", "lgpl", "(?:gnu )?lgpl"),
    (NAMED, "agpl", "agpl", "(?:gnu )?agpl"),
    (NAMED, "gpl", "general public", "(?:gnu )?general public license"),
    (NAMED, "lgpl", "general public", "(?:gnu )?(?:lesser|library) general public license"),
    (NAMED, "agpl", "affero", "(?:gnu )?affero general public license"),
    (NAMED, "gfdl", "documentation", "(?:gnu )?free documentation license"),
    (NAMED, "mit", "mit", "(?:the )?mit licen[cs]e|mit x11"),
    (NAMED, "mit", "x11", "x11 license"),
    (NAMED, "mit", "expat", "expat license"),
    (NAMED, "bsd", "bsd", "bsd licen[cs]e|bsd style license|bsd licensed"),
    (NAMED, "isc", "isc", "isc license"),
    (NAMED, "zlib", "zlib", "zlib(?: libpng)? license"),
    (NAMED, "unlicense", "unlicense", "(?:the )?unlicense"),
    (NAMED, "wtfpl", "wtfpl", "wtfpl"),
    (NAMED, "ruby", "ruby", "ruby license|same terms as ruby"),
    (NAMED, "perl", "perl", "same terms as perl(?: itself)?"),
    (NAMED, "w3c", "w3c", "w3c software(?: and document)?(?: notice and)? license"),
    (NAMED, "unicode", "unicode", "unicode (?:license|terms of use)"),
    (NAMED, "icu", "icu", "icu license"),
    (NAMED, "curl", "curl", "curl license"),
    (NAMED, "openssl", "openssl", "openssl license"),
    (NAMED, "json", "evil", "the software shall be used for good not evil"),
    (NAMED, "ogl", "ogl", "ogl 1 0a?"),
    (NAMED, "ogl", "game", "open game license"),
    (NAMED, "ogl-uk", "government", "open government licen[cs]e(?: v(?:ersion)? ?\\d 0)?"),
    (NAMED, "etalab", "ouverte", "licence ouverte(?: etalab)?"),
    (NAMED, "etalab", "etalab", "etalab(?: 2 0)?"),
    (NAMED, "commons-clause", "clause", "commons clause(?: license condition)?"),
    (NAMED, "public-domain", "domain", "(?:released|dedicated|placed|is|are)(?: in| into| to)?(?: the)? public domain"),
    (NAMED, "creative-commons", "commons", "creative commons(?: public)?(?: licen[cs]e)?"),
    (NAMED, "proprietary", "proprietary", "proprietary and confidential|confidential and proprietary|proprietary license"),
    (NAMED, "proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|software|document|work))?"),
    (NAMED, "no-reproduction", "reproduced", "no part of this (?:publication|book|work|document) may be reproduced"),
    (NAMED, "reserved", "reserved", "all rights reserved"),
    (NAMED, "reserved", "droits", "tous droits réservés"),
    (NAMED, "reserved", "vorbehalten", "alle rechte vorbehalten"),
    (NAMED, "some-rights-reserved", "reserved", "some rights reserved"),
    (HINT, "copyright-notice", "copyright", "copyright (?:c |© )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?"),
    (HINT, "open-source", "source", "open source (?:software |initiative )?licen[cs]e"),
    (HINT, "license-reference", "license", "see (?:the )?(?:file )?license(?: file| txt| md)?(?: for (?:details|more information|licensing information))?"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    needed: tuple[str, ...]
    regex: str


def _spread(templates: list[tuple], versions: str, **names: str) -> Iterator[Rule]:
    for version in versions.split() or [""]:
        words = version.replace(".", " ")
        known = {**names, "v": version, "w": words, "m": words.split(" ")[0]}
        for priority, label, needed, regex in templates:
            # Regexes have no braces of their own, so format only fills in the names.
            yield Rule(label.format(**known), priority, tuple(needed.format(**known).split()), regex.format(**known))


@cache
def signature_rules() -> tuple[Rule, ...]:
    """All rules in their order: the hand-written ones, each family's once for every version."""
    rules: list[Rule] = []
    for family, short, name, versions in GNU_FAMILIES:
        rules += _spread(GNU, versions, f=family, a=short, n=name)
    for family, name in COMMONS_FAMILIES:
        names = {"f": family, "s": family.replace("-", " "), "n": name}
        rules += _spread(COMMONS, COMMONS_VERSIONS, **names)
        rules += _spread(COMMONS_PLAIN, "", **names)
    for family, short, word, name, versions in VERSIONED_FAMILIES:
        names = {"f": family, "a": short, "k": word, "n": name}
        rules += _spread(VERSIONED_RULES, versions, **names)
        rules += _spread(NAMED_RULES, "", **names)
    rules += [Rule(label, priority, tuple(needed.split()), regex) for priority, label, needed, regex in PLAIN]
    return tuple(rules)


_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def plain_words(text: str) -> bytes:
    """Lower-case words (letters, digits and all beyond ASCII), one blank before and after each."""
    words = b" " + text.encode().translate(_LETTERS) + b" "
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return words


def surviving(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Detections (first word, word after the last, priority, rule) that no better one covers.

    Better: a higher priority, else more words, else an earlier rule. As covering carries over, it
    does not matter whether the better one survives itself, so one sweep per priority is enough.
    """
    order = sorted(set(found), key=lambda d: (d[2], d[0], -d[1], d[3]))
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []  # better priorities: first words, and the furthest end up to there
    ends: list[int] = []
    at = 0
    while at < len(order):
        stop = at
        while stop < len(order) and order[stop][2] == order[at][2]:
            stop += 1
        level, at = order[at:stop], stop
        furthest = -1
        for d in level:  # by first word, longest first: whoever covers d comes before it
            before = bisect_right(starts, d[0]) - 1
            if d[1] > furthest and (before < 0 or ends[before] < d[1]):
                kept.append(d)
            furthest = max(furthest, d[1])
        merged = sorted([*zip(starts, ends, strict=True), *((d[0], d[1]) for d in level)])
        starts, ends = [s for s, _ in merged], []
        for _, end in merged:
            ends.append(max(end, ends[-1]) if ends else end)
    return sorted(kept)


class Scanner:
    """The rules made ready for a task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.regexes = [re.compile(rb"(?<= )(?:" + r.regex.encode() + rb")(?= )") for r in rules]
        self.needed = [tuple(f" {w} ".encode() for w in r.needed) for r in rules]
        self.words = sorted({w for ws in self.needed for w in ws})
        self.base = [(re.compile(b"(?= " + p.encode() + b" )"), p.count(" ") + 1, label) for p, label in BASE]

    def scan(self, text: str) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words, base places (first word, label) and surviving detections."""
        words = plain_words(text)
        there = {w for w in self.words if w in words}
        hits = [(m.start(), size, label) for regex, size, label in self.base for m in regex.finditer(words)]
        found = [
            (m.start() - 1, m.group().count(b" ") + 1, number)
            for number, needed in enumerate(self.needed) if there.issuperset(needed)
            for m in self.regexes[number].finditer(words)
        ]
        # Word numbers: blanks before, counted in one walk along the text.
        numbers, at, seen = {}, 0, 0
        for place in sorted({h[0] for h in hits} | {f[0] for f in found}):
            seen += words.count(b" ", at, place)
            numbers[place], at = seen, place
        base = sorted((numbers[p], numbers[p] + size, label) for p, size, label in hits)
        best = surviving([(numbers[p], numbers[p] + n, self.rules[i].priority, i) for p, n, i in found])
        return words.count(b" ") - 1, base, best


DETECTION = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("priority", pa.int32()), ("regex", pa.string())]
)
SPOT = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def scan_licenses(documents: DataFrame, key: str = "doc_id", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(key, n_words, base, detections, score) of every row of ``documents`` (key, text).

    ``base`` lists every place of a base phrase, ``detections`` what the rules found and no better
    detection covers: label, first word, word after the last, priority, regex. The score is one less
    the product of all doubts, each distinct label counted once at its surest: 0 without any, below 1.
    A null text counts as empty: no words, nothing found, score 0. Repeated rows each have their row;
    the key may be of any type and null; other columns are ignored.
    """
    scanner_rules = signature_rules() if rules is None else tuple(rules)
    kind = documents.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, n_words bigint, base array<struct<label:string,first_word:bigint,end_word:bigint>>, detections "
        "array<struct<label:string,first_word:bigint,end_word:bigint,priority:int,regex:string>>, score double"
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(scanner_rules)
        for batch in batches:
            counts, bases, detections, scores = [], [], [], []
            for text in batch.column("text"):
                n, base, best = scanner.scan(text.as_py() or "")
                sure = {label: SURE[HINT] for _, _, label in base}
                for _, _, priority, i in best:
                    label = scanner.rules[i].label
                    sure[label] = max(sure.get(label, 0.0), SURE[priority])
                doubt = 1.0
                for label in sorted(sure):
                    doubt *= 1.0 - sure[label]
                counts.append(n)
                scores.append(1.0 - doubt)
                bases.append([{"label": label, "first_word": a, "end_word": b} for a, b, label in base])
                detections.append([
                    {"label": scanner.rules[i].label, "first_word": a, "end_word": b, "priority": p, "regex": scanner.rules[i].regex}
                    for a, b, p, i in best
                ])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array(counts, pa.int64()), pa.array(bases, pa.list_(SPOT)),
                    pa.array(detections, pa.list_(DETECTION)), pa.array(scores, pa.float64()),
                ],
                ["key", "n_words", "base", "detections", "score"],
            )

    found = documents.select(F.col(key).alias("key"), F.col("text")).mapInArrow(scan, schema)
    return found.withColumnRenamed("key", key)
