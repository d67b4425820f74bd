"""Word counts and concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import concepts, vocabulary
from passages.queries import bindings as b
from passages.queries.bindings import (
    ATTACHED_SQL, CITED_SQL, GAME_QUESTIONS_SQL, QUESTIONS_SQL, SECTIONS_SQL, SYNONYMS_SQL,
    count_words_sql, marked_sql, trim_sql, with_sql,
)
from passages.queries.registry import query
from passages.queries.search import GLOSSARY_SCOPED_SQL, game_glossary, match_sql
from passages.sources.saved import read_word_tables, write_word_tables
from passages.sources.tables import new_folder, read_table, stage, synonym_rows, usable_features

STOP_SQL = ", ".join(f"'{w}'" for w in vocabulary.STOPWORDS)

COUNTS_SQL = f"""counts AS (
SELECT pdf_id, word, count(*) AS n FROM (
SELECT pdf_id, unnest(list_concat({count_words_sql('title')}, {count_words_sql(trim_sql('plain_text'))})) AS word
FROM sections WHERE {trim_sql('plain_text')} <> '') GROUP BY ALL),
synonym_words AS (SELECT DISTINCT feature_id, unnest({count_words_sql('synonym')}) AS word FROM synonyms)"""

FREQUENT_SQL = f"""kept AS (
SELECT * FROM counts WHERE word NOT IN ({STOP_SQL}) OR word IN (SELECT word FROM synonym_words)),
listed AS (
SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY n DESC, word) AS spot FROM kept),
frequent AS (
SELECT pdf_id, word, n, spot > 1000 AS forced FROM listed
WHERE spot <= 1000 OR word IN (SELECT word FROM synonym_words))"""


def counts(spark, folder):
    """Word counts, written once: every use below reads them more than once."""
    samples = vocabulary.section_samples(b.sections(spark, folder))
    return stage(vocabulary.word_counts(samples), "word_counts")


@query("word_frequency", with_sql(SECTIONS_SQL, SYNONYMS_SQL, COUNTS_SQL, FREQUENT_SQL) + "SELECT * FROM frequent")
def word_frequency(spark, folder):
    return vocabulary.frequent_words(counts(spark, folder), synonym_rows(b.catalogue(spark)))


@query("word_tables_tsv", with_sql(SECTIONS_SQL, SYNONYMS_SQL, COUNTS_SQL, FREQUENT_SQL) + "SELECT pdf_id, word, n AS count FROM frequent")
def word_tables_tsv(spark, folder):
    """Every book's word table written as tab-separated text and read back."""
    path = new_folder(spark, "word-tables")
    write_word_tables(vocabulary.frequent_words(counts(spark, folder), synonym_rows(b.catalogue(spark))), path)
    return read_word_tables(spark, path)


@query("unique_tokens", with_sql(SECTIONS_SQL, SYNONYMS_SQL, COUNTS_SQL)
       + "SELECT pdf_id, count(*) AS unique_tokens FROM counts GROUP BY ALL")
def unique_tokens(spark, folder):
    return vocabulary.unique_words(counts(spark, folder))


CANDIDATES_SQL = f"""feature_candidates AS (
SELECT DISTINCT pdf_id, feature_id FROM counts JOIN synonym_words USING (word)
UNION
SELECT DISTINCT g.pdf_id, g.feature_id FROM (
SELECT pdf_id, feature_id, unnest({count_words_sql('term')}) AS word FROM glossary) g
JOIN counts c ON c.pdf_id = g.pdf_id AND c.word = g.word)"""


@query("feature_candidates", with_sql(SECTIONS_SQL, SYNONYMS_SQL, COUNTS_SQL, CITED_SQL, CANDIDATES_SQL)
       + "SELECT * FROM feature_candidates")
def feature_candidates(spark, folder):
    own = b.glossary(b.cited_sections(spark, folder))
    return vocabulary.feature_candidates(counts(spark, folder), synonym_rows(b.catalogue(spark)), own)


@query("scan_text", with_sql(SECTIONS_SQL, SYNONYMS_SQL, f"marked AS (SELECT section_id, {marked_sql('plain_text')} AS m FROM sections)")
       + f"SELECT section_id, feature_id, synonym FROM marked JOIN synonyms ON contains(m, {marked_sql('synonym')})")
def scan_text(spark, folder):
    return concepts.scan_text(b.sections(spark, folder), synonym_rows(b.catalogue(spark)))


@query("match_query_features", with_sql(QUESTIONS_SQL, SYNONYMS_SQL)
       + f"""SELECT DISTINCT query_id, feature_id FROM questions
JOIN synonyms ON contains({marked_sql('query_text')}, {marked_sql('synonym')})""")  # fmt: skip
def match_query_features(spark, folder):
    return concepts.synonym_features(
        b.questions(spark, folder), "query_id", "query_text", synonym_rows(b.catalogue(spark))
    )


MATCHED_SQL = with_sql(
    SECTIONS_SQL, ATTACHED_SQL, GAME_QUESTIONS_SQL, CITED_SQL, SYNONYMS_SQL, GLOSSARY_SCOPED_SQL,
    match_sql("game_questions", "query_text", "matched", "scoped_glossary", "AND g.game_id = q.game_id"),
)


def matched(spark, folder, rows):
    return concepts.matched_features(
        b.game_questions(spark, folder), "query_id", "query_text", synonym_rows(b.catalogue(spark)),
        game_glossary(spark, folder, rows), "game_id",
    )


@query("matched_features", MATCHED_SQL + "SELECT query_id, feature_id FROM matched")
def matched_features(spark, folder):
    return matched(spark, folder, b.cited_sections(spark, folder))


@query("cited_sections", MATCHED_SQL + """SELECT DISTINCT m.query_id, c.section_id
FROM matched m JOIN game_questions q USING (query_id) JOIN attached a USING (game_id)
JOIN citations c ON c.pdf_id = a.pdf_id AND c.feature_id = m.feature_id""")
def cited_sections(spark, folder):
    rows = b.cited_sections(spark, folder)
    by_game = b.attached(spark, folder).join(b.citations(rows), "pdf_id")
    asked = matched(spark, folder, rows).join(
        b.game_questions(spark, folder).select("query_id", "game_id"), "query_id"
    )
    return concepts.cited_sections(
        asked.withColumn("feature_id", F.concat_ws("/", "game_id", "feature_id")),
        by_game.withColumn("feature_id", F.concat_ws("/", "game_id", "feature_id")),
    )


# Brands as features, with names given more than once: the last part of a brand wins.
@query("catalog_synonyms", """SELECT feature_id, name, unnest([kind, name]) AS synonym FROM (
SELECT p_brand AS feature_id, arg_max(p_name, p_partkey) AS name, arg_max(p_type, p_partkey) AS kind
FROM part WHERE p_size > 1 GROUP BY ALL)""")
def catalog_synonyms(spark, folder):
    parts = read_table(spark, folder, "part")
    rows = parts.select(
        F.when(F.col("p_size") > 1, F.col("p_brand")).otherwise(F.lit("")).alias("id"),
        F.col("p_name").alias("name"),
        F.lit("").alias("description"),
        F.array().cast("array<string>").alias("questions"),
        F.array("p_type", "p_name").alias("synonyms"),
        F.col("p_partkey").alias("pos"),
    )
    last = usable_features(rows)
    return last.select("feature_id", "name", F.explode("synonyms").alias("synonym"))


