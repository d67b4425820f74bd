"""The given tables seen as a library: documents are sections, their sources books.

Each relation is defined twice, as a DataFrame and as a common table expression for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.functions.text import WS, accent_table
from passages.operators.fulltext import TextIndex, build_text_index
from passages.operators.ordering import dense_position, int_chunk
from passages.session import broadcast_if_small
from passages.sources.tables import CATALOGUE_SCHEMA, changed_at, read_table, spread, stage, usable_features

# A small catalogue over words of the documents: function words of their languages, one phrase of
# several words each, one feature no text names, one without a name of its own and one named as its id.
CATALOGUE = [
    (0, "en", "English prose", "Sentences built on common English words.",
     ["Which words open a sentence?", "How often does the article occur?"], ["the", "of the", "and"]),
    (1, "fr", "French prose", "Sentences built on common French words.",
     ["Which words open a sentence?"], ["les", "dans", "de la"]),
    (2, "de", "de", "Really what? Sentences built on common German words.",
     ["Which words are written with a capital letter?"], ["und", "der", "in der"]),
    (3, "es", "", "Sentences built on common Spanish words.", [], ["los", "que", "de los"]),
    (4, "rare", "Rare words", "", [], ["zyzzyva", "is-not"]),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, f"pos int, {CATALOGUE_SCHEMA}")


def features(spark: SparkSession) -> DataFrame:
    return broadcast_if_small(usable_features(catalogue(spark)))


def sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("section_id"),
        F.col("source").alias("pdf_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        (F.col("doc_id") + 1).alias("start_page"),
        (F.col("doc_id") + 1).alias("end_page"),
        F.col("doc_id").alias("sort_order"),
        F.col("text").alias("plain_text"),
    )
    return spread(rows, "section_id")


_indexes: dict[tuple[str, str, int], TextIndex] = {}


def text_index(spark: SparkSession, folder: str) -> TextIndex:
    """Index of the sections, built by the first search of a session and read by the later ones.

    A table that was written anew is indexed anew.
    """
    key = (spark.sparkContext.applicationId, folder, changed_at(spark, f"{folder}/documents.parquet"))
    if key not in _indexes:
        _indexes[key] = build_text_index(sections(spark, folder))
    return _indexes[key]


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(pdf_id, page_no, section_id, text): documents as the numbered pages of their book."""
    numbered = dense_position(
        read_table(spark, folder, "documents").select("source", "doc_id"),
        ["source"],
        {"_piece": int_chunk("doc_id")},
        ["doc_id"],
        "spot",
    )
    texts = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return numbered.join(texts, "doc_id").select(
        F.col("source").alias("pdf_id"),
        (F.col("spot") + 1).alias("page_no"),
        F.col("doc_id").alias("section_id"),
        "text",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def attached(spark: SparkSession, folder: str) -> DataFrame:
    """Two games: books with a one-digit and with a two-digit number, in number order."""
    books = read_table(spark, folder, "documents").select(F.col("source").alias("pdf_id")).distinct()
    return books.select(
        F.format_string("game%d", F.length("pdf_id")).alias("game_id"),
        "pdf_id",
        F.concat(F.lit("Book "), "pdf_id").alias("pdf_title"),
        F.regexp_extract("pdf_id", "[0-9]+", 0).cast("int").alias("sort_order"),
    )


def game_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every question asked in every game."""
    ids = attached(spark, folder).agg(F.collect_set("game_id")).scalar()
    games = F.explode(ids).alias("game_id")
    return questions(spark, folder).select(
        F.col("query_id").alias("item_id"), games, "query_text"
    ).select(F.format_string("%s/%d", "game_id", "item_id").alias("query_id"), "game_id", "query_text")


def cited_sections(spark: SparkSession, folder: str) -> DataFrame:
    """(pdf_id, feature_id, has_entry, defines, pos, section_id, section_title, start_page, end_page).

    Every good document is a citation of its book and language, in id order. A book and language has
    an entry where one of them is toxic; those documents stand for the ones that define a term. The
    rows are written once: glossary, cheatsheet and citations are all read off them.
    """
    docs = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("section_id"), F.col("source").alias("pdf_id"), F.col("lang").alias("feature_id"),
        F.substring_index("text", "\n", 1).alias("section_title"),
    )
    good = read_table(spark, folder, "labels").where("quality = 1").select(
        F.col("doc_id").alias("section_id"), (F.col("toxic") == 1).alias("defines")
    )
    picked = stage(docs.join(good, "section_id"), "good")
    group = ["pdf_id", "feature_id"]
    entries = picked.groupBy(*group).agg(F.max(F.col("defines").cast("int")).alias("has_entry"))
    placed = dense_position(picked, group, {"_piece": int_chunk("section_id")}, ["section_id"], "pos")
    rows = placed.join(entries, group).select(
        *group, "has_entry", "defines", F.col("pos").cast("int").alias("pos"), "section_id", "section_title",
        (F.col("section_id") + 1).alias("start_page"), F.lit(0).cast("bigint").alias("end_page"),
    )
    return stage(rows, "cited")


def glossary(cited_rows: DataFrame) -> DataFrame:
    """(pdf_id, feature_id, term): opening words of the sections that define a term."""
    word = F.regexp_extract("section_title", r"\p{L}+", 0)
    return cited_rows.where("defines").select("pdf_id", "feature_id", word.alias("term")).where("term <> ''").distinct()


def cheatsheet(cited_rows: DataFrame) -> DataFrame:
    """(pdf_id, feature_id, definition) where the language has an entry."""
    return cited_rows.where("has_entry = 1 and pos = 0").select(
        "pdf_id", "feature_id", F.col("section_title").alias("definition")
    )


def citations(cited_rows: DataFrame) -> DataFrame:
    return cited_rows.where("has_entry = 1").drop("has_entry", "defines")


def detected(cited_rows: DataFrame) -> DataFrame:
    return cited_rows.select("pdf_id", "feature_id").distinct()


# ---- the same for the oracles ----------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]::VARCHAR[]"


_rows = ",\n".join(
    f"({pos}, {quote(i)}, {quote(n)}, {quote(d)}, {_list(q)}, {_list(s)})"
    for pos, i, n, d, q, s in CATALOGUE
)
CATALOGUE_SQL = f"""catalogue(pos, feature_id, name, description, questions, synonyms) AS (VALUES
{_rows})"""
SYNONYMS_SQL = f"""{CATALOGUE_SQL},
synonyms AS (SELECT feature_id, unnest(synonyms) AS synonym FROM catalogue)"""

SECTIONS_SQL = """sections AS (
SELECT doc_id AS section_id, source AS pdf_id, split_part(text, chr(10), 1) AS title,
       doc_id + 1 AS start_page, doc_id + 1 AS end_page, doc_id AS sort_order, text AS plain_text
FROM documents)"""

PAGES_SQL = """page_texts AS (
SELECT source AS pdf_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no,
       doc_id AS section_id, text FROM documents)"""

QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"

ATTACHED_SQL = """attached AS (
SELECT DISTINCT 'game' || length(source) AS game_id, source AS pdf_id, 'Book ' || source AS pdf_title,
       CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS sort_order
FROM documents)"""

GAME_QUESTIONS_SQL = """game_questions AS (
SELECT g.game_id || '/' || item_id AS query_id, g.game_id, text AS query_text
FROM benchmark, (SELECT DISTINCT 'game' || length(source) AS game_id FROM documents) g)"""

CITED_SQL = """cited_rows AS (
SELECT s.pdf_id, d.lang AS feature_id, max(toxic) OVER g AS has_entry, toxic = 1 AS defines,
       CAST(row_number() OVER (PARTITION BY s.pdf_id, d.lang ORDER BY doc_id) - 1 AS INTEGER) AS pos,
       doc_id AS section_id, s.title AS section_title, s.start_page, CAST(0 AS BIGINT) AS end_page
FROM documents d JOIN labels USING (doc_id) JOIN sections s ON s.section_id = doc_id WHERE quality = 1
WINDOW g AS (PARTITION BY s.pdf_id, d.lang)),
glossary AS (
SELECT DISTINCT pdf_id, feature_id, regexp_extract(section_title, '\\p{L}+') AS term
FROM cited_rows WHERE defines AND regexp_extract(section_title, '\\p{L}+') <> ''),
cheatsheet AS (
SELECT pdf_id, feature_id, section_title AS definition FROM cited_rows
WHERE has_entry = 1 AND pos = 0),
citations AS (
SELECT pdf_id, feature_id, pos, section_id, section_title, start_page, end_page
FROM cited_rows WHERE has_entry = 1),
detected AS (SELECT DISTINCT pdf_id, feature_id FROM cited_rows)"""


def trim_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def collapse_sql(expr: str) -> str:
    return trim_sql(f"regexp_replace({expr}, '[{WS}]+', ' ', 'g')")


def fields_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{WS}]+'), lambda x: x <> '')"


def fold_sql(expr: str) -> str:
    marked, plain = accent_table()
    return f"translate(lower({expr}), '{marked}', '{plain}')"


def terms_sql(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array({fold_sql(expr)}, '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda x: x <> '')"
    )


def count_words_sql(expr: str) -> str:
    up = f"translate(upper(translate({expr}, 'ß', chr(57567))), chr(57567), 'ß')"
    return (
        f"list_filter(regexp_split_to_array({up}, '[^\\p{{L}}\\p{{Nd}}]+'), "
        "lambda x: strlen(x) >= 2)"
    )


def embed_words_sql(expr: str) -> str:
    kept = f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{Nd}}{WS}]+', '', 'g')"
    return f"list_filter(regexp_split_to_array({kept}, '[{WS}]+'), lambda x: strlen(x) > 1)"


def fnv_sql(expr: str) -> str:
    """32-bit FNV-1a over the bytes of a text."""
    byte = f"CAST('0x' || substr(hex({expr}), 2 * i - 1, 2) AS UBIGINT)"
    bytes_ = f"list_transform(range(1, strlen({expr}) + 1), lambda i: {byte})"
    return (
        f"list_reduce({bytes_}, lambda h, b: (xor(h, b) * 16777619) & 4294967295, "
        "2166136261::UBIGINT)"
    )


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def marked_sql(expr: str) -> str:
    """Lower-case text with a mark at every word edge, so that whole phrases are plain substrings."""
    edges = f"regexp_replace(lower({expr}), '([^\\p{{L}}\\p{{N}}])', chr(1) || '\\1' || chr(1), 'g')"
    return f"chr(1) || {edges} || chr(1)"
