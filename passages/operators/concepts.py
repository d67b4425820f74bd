"""Concept catalogue: matching phrases and book terms in texts, and expanding queries with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import distinct_ignoring_case, fields, let, trim_ws, unseen
from passages.operators.ordering import first_by
from passages.session import BROADCAST_ROWS, broadcast_if_small
from passages.sources.tables import stage

WORD = r"[\p{L}\p{N}]+"
EDGE = r"[^\p{L}\p{N}]"

# Up to this many phrases, each text is intersected with them; the cost of that is per text.
INTERSECT_ROWS = 2_000

# Fixed values of the definition query: trimmed marks, least bytes of a word, closing words.
DESCRIPTION_TRIM = r"""[.,;:"'()\[\]]+"""
QUESTION_TRIM = r"""[.,;:?"'()\[\]]+"""
DEFINITION_BYTES = 4
DEFINITION_TAIL = ["rules", "definition"]


def _words(c: Column) -> Column:
    return F.array_distinct(F.split(F.lower(c), rf"{EDGE}+"))


def _meet(texts: DataFrame, wanted: DataFrame, on: str, scope: list[str]) -> DataFrame:
    """Pairs of texts (key…, _text, _offers) and wanted rows that share an offer.

    A small catalogue is intersected with each text's offers first, so a text is repeated only for
    what may be found in it. One of up to the broadcast bounds is sent to the texts: an offer is
    looked up where its text is, and nothing but the pairs found goes on. Only a larger one is
    shuffled, with the bare keys of the texts, which are joined to the texts afterwards.
    """
    keys = [c for c in texts.columns if c not in ("_text", "_offers")]
    if wanted.limit(INTERSECT_ROWS + 1).count() <= INTERSECT_ROWS:
        known = wanted.agg(F.collect_set(on)).scalar()
        offered = texts.select(*keys, "_text", F.explode(F.array_intersect("_offers", known)).alias(on))
        return offered.join(F.broadcast(wanted), [on, *scope])
    sent = broadcast_if_small(wanted, BROADCAST_ROWS)
    if sent is not wanted:
        return texts.select(*keys, "_text", F.explode("_offers").alias(on)).join(sent, [on, *scope])
    bare = texts.select(*keys, F.explode("_offers").alias(on))
    pairs = bare.join(wanted, [on, *scope])
    return pairs.join(texts.drop("_offers", *scope), [k for k in keys if k not in scope])


def phrase_matches(texts: DataFrame, key: str, text: str, synonyms: DataFrame) -> DataFrame:
    """(key, feature_id, synonym) wherever a synonym stands in a text between non-word characters.

    A text can only hold a phrase whose first word it holds, so texts and phrases meet in a join on
    that word; the pattern is then tried on the few pairs left. Phrases without any word join on
    the empty word, which every text offers.
    """
    phrase = F.lower(trim_ws(F.col("synonym")))
    quoted = F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(F.lit(rf"(^|{EDGE})\Q"), quoted, F.lit(rf"\E($|{EDGE})"))
    wanted = synonyms.where(phrase != "").select(
        "feature_id",
        "synonym",
        F.regexp_extract(phrase, WORD, 0).alias("_word"),
        pattern.alias("_pattern"),
        phrase.rlike(rf"^{WORD}\z").alias("_single"),
    )
    offered = texts.select(
        key,
        F.lower(text).alias("_text"),
        F.array_distinct(F.concat(_words(F.col(text)), F.array(F.lit("")))).alias("_offers"),
    )
    # A phrase of one word needs no pattern: the text offers that very word.
    return (
        _meet(offered, wanted, "_word", [])
        .where(F.expr("_single or _text rlike _pattern"))
        .select(key, "feature_id", "synonym")
    )


def synonym_features(texts: DataFrame, key: str, text: str, synonyms: DataFrame) -> DataFrame:
    return phrase_matches(texts, key, text, synonyms).select(key, "feature_id").distinct()


def scan_text(sections: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Catalogue phrases of two bytes or more found in section texts, one row per phrase."""
    usable = synonyms.where(F.octet_length("synonym") >= 2).withColumn("_key", F.lower("synonym"))
    once = first_by(usable, ["feature_id", "_key"], F.col("synonym")).drop("_key")
    return phrase_matches(sections, "section_id", "plain_text", once)


def term_matches(
    texts: DataFrame, key: str, text: str, terms: DataFrame, scope: str | None = None
) -> DataFrame:
    """(key, feature_id, term) wherever a text contains a book term, also inside a word.

    Text and term meet on the first three characters of the term (all of a shorter one), which any
    text containing it must contain too. With ``scope``, a column of both sides, a text only meets
    terms of its own scope.
    """
    scoped = [scope] if scope else []
    lowered = F.lower(F.col("term"))
    wanted = (
        terms.where(F.col("term") != "")
        .select(*scoped, "feature_id", "term", F.left(lowered, F.lit(3)).alias("_gram"))
        .distinct()
    )

    def grams(n: int) -> Column:
        def cut(c: Column) -> Column:
            at = F.sequence(F.lit(1), F.length(c) - (n - 1))
            pieces = F.transform(at, lambda i: F.substring(c, i, F.lit(n)))
            return F.when(F.length(c) >= n, pieces).otherwise(F.array().cast("array<string>"))

        return let(F.lower(F.col(text)), cut)

    offered = texts.select(
        key,
        *scoped,
        F.lower(text).alias("_text"),
        F.array_distinct(F.concat(grams(1), grams(2), grams(3))).alias("_offers"),
    )
    return (
        _meet(offered, wanted, "_gram", scoped)
        .where(F.contains("_text", F.lower("term")))
        .select(key, "feature_id", "term")
    )


def matched_features(
    texts: DataFrame,
    key: str,
    text: str,
    synonyms: DataFrame,
    glossary: DataFrame,
    scope: str | None = None,
) -> DataFrame:
    """(key, feature_id): features a text names by a catalogue synonym or by a book's own term."""
    by_term = term_matches(texts, key, text, glossary, scope).select(key, "feature_id")
    by_synonym = phrase_matches(texts, key, text, synonyms).select(key, "feature_id")
    return by_synonym.unionByName(by_term).distinct()


def expand_queries(
    queries: DataFrame,
    matched: DataFrame,
    glossary: DataFrame,
    text: str = "query_text",
    scope: str | None = None,
) -> DataFrame:
    """queries with ``fts_text``: the words of the text plus unseen book terms of matched features.

    ``glossary`` is (pdf_order, feature_id, term); terms are added in that order, each once
    whatever its capitals. A query that matches nothing keeps its text untouched.
    """
    scoped = [scope] if scope else []
    rank = F.struct("pdf_order", "feature_id", "term")
    terms = glossary.select(
        *scoped, "pdf_order", "feature_id", trim_ws(F.col("term")).alias("term")
    ).where(F.col("term") != "")
    asked = matched.join(queries.select("query_id", *scoped), "query_id") if scope else matched
    offered = asked.join(terms, ["feature_id", *scoped]).select(
        "query_id", F.lower("term").alias("_key"), "pdf_order", "feature_id", "term"
    )
    added = (
        first_by(offered, ["query_id", "_key"], rank)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(rank)).alias("_terms"))
    )
    matched_ids = matched.select("query_id").distinct().withColumn("_matched", F.lit(True))
    extra = F.coalesce(F.transform("_terms", lambda t: t["term"]), F.array().cast("array<string>"))
    widened = let(fields(F.col(text)), lambda w: F.array_join(F.concat(w, unseen(extra, w)), " "))
    return (
        queries.join(matched_ids, "query_id", "left")
        .join(added, "query_id", "left")
        .withColumn(
            "fts_text",
            F.when(F.col("_matched"), widened).otherwise(F.col(text)),
        )
        .drop("_matched", "_terms")
    )


def definition_queries(requests: DataFrame, features: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pdf_id, feature_id, query_text): keyword query that looks up a feature's definition.

    ``requests`` is (pdf_id, feature_id), ``features`` the catalogue by feature_id. Words come from
    name, synonyms, description, questions and the book's own terms, each once whatever its
    capitals, followed by two fixed words.
    """

    def keywords(c: Column, marks: str) -> Column:
        bare = F.transform(fields(c), lambda w: F.regexp_replace(w, rf"^{marks}|{marks}\z", ""))
        return F.filter(bare, lambda w: F.octet_length(w) >= DEFINITION_BYTES)

    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array("name"),
        F.coalesce("synonyms", none),
        keywords(F.coalesce("description", F.lit("")), DESCRIPTION_TRIM),
        F.coalesce(F.flatten(F.transform("questions", lambda q: keywords(q, QUESTION_TRIM))), none),
    )
    catalogue = features.select("feature_id", parts.alias("_parts"))
    terms = glossary.groupBy("pdf_id", "feature_id").agg(
        F.array_sort(F.collect_set("term")).alias("_terms")
    )
    joined = requests.join(catalogue, "feature_id", "left").join(
        terms, ["pdf_id", "feature_id"], "left"
    )
    words = F.transform(
        F.concat(
            F.coalesce("_parts", none),
            F.coalesce("_terms", none),
            F.array(*[F.lit(w) for w in DEFINITION_TAIL]),
        ),
        trim_ws,
    )
    kept = F.filter(words, lambda w: w != "")
    once = distinct_ignoring_case(kept)
    return joined.select("pdf_id", "feature_id", F.array_join(once, " ").alias("query_text"))


def cited_sections(matched: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, section_id) cited by entries of the features a query matches.

    Queries that match the same features are one until the end, and a section meets them through the
    first feature they share, so pairs of query and section are neither moved nor made twice.
    """
    usable = citations.where(F.col("section_id").isNotNull())
    cited = usable.groupBy("section_id").agg(F.collect_set("feature_id").alias("_of"))
    asked = matched.groupBy("query_id").agg(F.array_sort(F.collect_set("feature_id")).alias("_asked"))
    asked = stage(asked, "asked")
    kinds = asked.select("_asked").distinct().select("_asked", F.explode("_asked").alias("feature_id"))
    met = cited.select("section_id", "_of", F.explode("_of").alias("feature_id")).join(broadcast_if_small(kinds), "feature_id")
    met = met.where(F.col("feature_id") == F.array_min(F.array_intersect("_of", "_asked")))
    return met.join(broadcast_if_small(asked), "_asked").select("query_id", "section_id")


def feature_names(ids: DataFrame, features: DataFrame) -> DataFrame:
    """ids with ``feature_name``: the catalogue name, or the id where it has none."""
    names = features.select("feature_id", trim_ws(F.col("name")).alias("_name"))
    return ids.join(names, "feature_id", "left").withColumn(
        "feature_name", F.coalesce(F.nullif("_name", F.lit("")), F.col("feature_id"))
    ).drop("_name")
