"""Model replies: finding and mending the JSON in them, and reading loosely typed fields.

Whole, valid JSON never leaves the JVM. Only replies that do not parse as they stand go through a
small Arrow function that cuts out the first balanced value and mends what string-aware rules can.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions.text import let, trim_ws

_STRING = r'"(?:\\.|[^"\\])*"'
_TOKEN = re.compile(rf"{_STRING}|[{{}}\[\]]", re.S)
_COMMENT = re.compile(rf"({_STRING})|//[^\n\r]*|/\*.*?(?:\*/|\Z)", re.S)
_LITERAL = re.compile(_STRING, re.S)
# Fixed value: a key followed by a doubled colon, a slip some models make.
_KEY_SLIP = re.compile(r'"([a-z_]+):_:')
_TRAILING_COMMA = re.compile(r",\s*([}\]])")
_CONTROL = {"\n": r"\n", "\r": r"\r", "\t": r"\t"}


def strip_fence(reply: Column) -> Column:
    """Reply without an enclosing code fence."""
    bare = trim_ws(reply)
    opened = F.regexp_replace(bare, r"^```(json)?", "")
    closed = F.regexp_replace(opened, r"(?s)```(?!.*```).*\z", "")
    return F.when(F.startswith(bare, F.lit("```")), trim_ws(closed)).otherwise(bare)


def first_value(text: str) -> str:
    """First balanced object, else the first balanced array, else the text itself."""
    for opener, closer in ("{}", "[]"):
        start = text.find(opener)
        if start < 0:
            continue
        depth = 0
        for token in _TOKEN.finditer(text, start):
            if token.group() == opener:
                depth += 1
            elif token.group() == closer:
                depth -= 1
                if depth == 0:
                    return text[start : token.end()].strip()
    return text


def mend(text: str) -> str:
    """Key slips, comments, raw control characters in strings and trailing commas put right."""
    text = _KEY_SLIP.sub(r'"\1":', text)
    text = _COMMENT.sub(lambda m: m.group(1) or "", text)
    text = _LITERAL.sub(lambda m: "".join(_CONTROL.get(c, c) for c in m.group()), text)
    return _TRAILING_COMMA.sub(r"\1", text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_and_mended(texts: pd.Series) -> pd.Series:
    cut = [None if t is None else first_value(t) for t in texts]
    return pd.Series([None if c is None else [c, mend(c)] for c in cut], index=texts.index)


def json_candidates(stripped: Column) -> Column:
    """Texts to try in order: the reply itself where it is a JSON object, else cut out and mended."""
    whole = F.startswith(stripped, F.lit("{")) & F.try_parse_json(stripped).isNotNull()
    return F.when(whole, F.array(stripped)).otherwise(_cut_and_mended(F.when(~whole, stripped)))


def first_fitting(candidates: Column, kind: Column) -> Column:
    """First candidate that is JSON of the shape the pass asks for; a bare feature list is wrapped.

    features: a list of texts. glossary: objects of a feature_id and a list of terms. cheatsheet: a
    feature_id and citations with a title. Each may be missing or null, none may have another type.
    """
    wrapped = F.transform(
        F.filter(candidates, lambda c: (kind == "features") & F.startswith(c, F.lit("["))),
        lambda c: F.concat(F.lit('{"features":'), c, F.lit("}")),
    )

    def fits(c: Column) -> Column:
        value = F.try_parse_json(c)

        def shape(path: str) -> Column:
            return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))

        def rows(path: str, fields: dict[str, str]) -> Column:
            """A list of objects whose named fields have the wanted types, or none at all."""
            given = shape(path)
            typed = given.rlike(r"^ARRAY<OBJECT<")
            for field, wanted in fields.items():
                typed = typed & ~given.rlike(rf"[<\s]{field}: (?!(?:{wanted}|VOID)[,>])")
            return given.isin("VOID", "ARRAY<VOID>") | typed

        words = "ARRAY<(?:STRING|VOID)>"
        shapes = (
            F.when(kind == "features", shape("$.features").isin("VOID", "ARRAY<VOID>", "ARRAY<STRING>"))
            .when(kind == "glossary", rows("$.glossary", {"feature_id": "STRING", "terms": words}))
            .when(
                kind == "cheatsheet",
                shape("$.feature_id").isin("VOID", "STRING") & rows("$.citations", {"section_title": "STRING"}),
            )
            .otherwise(True)
        )
        return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")) & shapes, F.lit(False))

    return F.get(F.filter(F.concat(candidates, wrapped), fits), F.lit(0))


def loose_page(value: Column) -> Column:
    """Page number given as whole number, fraction or text; anything else is 0."""
    kind = F.schema_of_variant(value)

    def read(text: Column) -> Column:
        number = text.try_cast("double")
        digits = F.when(text.rlike(r"^\+?\d+\z"), text.try_cast("int"))
        numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.when(numeric & (number > 0), F.floor(number).try_cast("int")).when(
            kind == "STRING", digits
        )

    return F.coalesce(let(trim_ws(F.try_variant_get(value, "$", "string")), read), F.lit(0))


def loose_ids(value: Column) -> Column:
    """Section ids given as one text or a list of texts."""
    kind = F.schema_of_variant(value)
    one = F.array(F.try_variant_get(value, "$", "string"))
    many = F.try_variant_get(value, "$", "array<string>")
    given = F.when(kind == "STRING", one).when(kind == "ARRAY<STRING>", many)
    trimmed = F.filter(F.transform(given, trim_ws), lambda x: x != "")
    return F.coalesce(trimmed, F.array().cast("array<string>"))


def loose_definition(value: Column) -> Column:
    """Definition given as text, or inside an object under one of three names."""
    kind = F.schema_of_variant(value)
    inner = [
        F.nullif(trim_ws(F.try_variant_get(value, f"$.{name}", "string")), F.lit(""))
        for name in ("definition", "text", "summary")
    ]
    text = F.when(kind == "STRING", trim_ws(F.try_variant_get(value, "$", "string")))
    return F.coalesce(text, F.when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(*inner)), F.lit(""))
