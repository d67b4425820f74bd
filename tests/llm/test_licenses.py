"""License scan against a plain version, on given and on made-up texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from passages.llm import licenses
from passages.llm.queries import QUERIES
from passages.sources.tables import read_table

SF = "/root/testdata/sf0.001"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PARTS = [
    "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "or any later version", "CC BY-NC 4.0",
    "All rights reserved.", "SPDX-License-Identifier: MIT", "cc by cc by", "the", "and", "license", "Released under the MIT License",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "2-clause BSD license", "été", "CC-BY-SA 3.0", "Mozilla Public License 2.0", "public license",
]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    spots = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        spots += [(i, i + len(parts), label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return words, sorted(spots)


def plain_scan(text, rules):
    """Every rule on every text without the keyword gate, and every detection against every other."""
    words, base = plain_base(text)
    line = " " + " ".join(words) + " "
    found = set()
    for i, rule in enumerate(rules):
        for m in re.finditer("(?<= )(?:" + rule.regex + ")(?= )", line, re.ASCII):
            first = line[: m.start()].count(" ") - 1
            found.add((first, first + len(m.group().split(" ")), rule.priority, i))
    better = lambda e, d: (e[2], e[0] - e[1], e[3]) < (d[2], d[0] - d[1], d[3])
    kept = [d for d in found if not any(e[0] <= d[0] and d[1] <= e[1] and better(e, d) for e in found)]
    return len(words), base, sorted(kept)


def check(spark, texts):
    rules = licenses.signature_rules()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns(
        {c: F.lit("x") for c in ("key", "base", "labels", "score")}
    )
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, base, best = plain_scan(text, rules)
        assert got[i].n_words == n
        assert [tuple(b)[1:] + (b.label,) for b in got[i].base] == base
        assert [(d.first_word, d.end_word, d.label, d.priority) for d in got[i].detections] == [(a, b, rules[r].label, p) for a, b, p, r in best]
        assert 0 <= got[i].score < 1 and (got[i].score > 0) == bool(base or best)


def test_hundreds_of_rules_and_gates():
    rules = licenses.signature_rules()
    assert len(rules) > 300
    assert all(rule.needed for rule in rules)


def test_made_up_texts(spark):
    rng = random.Random(4)
    check(spark, [rng.choice([" ", "\n", ", "]).join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(120)])


def test_given_texts(spark):
    check(spark, [r.text for r in read_table(spark, SF, "documents").collect()])


def test_odd_texts(spark):
    check(spark, [None, "", " \n", "\x00", "ALL RIGHTS RESERVED", "all-rights_reserved", "ccby", "all rights reservedé", "© cc by", "cc by " * 3000])


def samples(regex):
    """Texts that the alternatives of a regex match: optional parts gone, of inner choices each one."""
    inner = re.search(r"\(\?:([^()]*)\)(\?)?", regex)
    if inner:
        for choice in [""] if inner[2] else inner[1].split("|"):
            yield from samples(regex[: inner.start()] + choice + regex[inner.end() :])
        return
    for choice in regex.split("|"):
        plain = re.sub(r"\[(.)[^]]*\]", r"\1", choice).replace("\\d", "9")
        yield re.sub(r".\?", "", plain).strip()


def test_every_rule_is_reached_through_its_gate():
    """A text that a rule matches holds the words that the gate asks for."""
    scanner = licenses.Scanner(licenses.signature_rules())
    for i, rule in enumerate(scanner.rules):
        for sample in samples(rule.regex):
            line = f" {sample} ".encode()
            assert scanner.regexes[i].search(line), (rule, line)
            assert all(w in line for w in scanner.needed[i]), (rule, line)


@pytest.mark.parametrize("name", ["op13_licenses"])
def test_query_columns(name, spark):
    got = QUERIES[name](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    texts = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    for r in got.collect():
        words, base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b[2] for b in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert licenses.scan_licenses(docs).collect() == []
