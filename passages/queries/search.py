"""Full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions.ranking import (
    TITLE_STOPWORDS, is_tabular, table_penalty, text_lines, title_boost,
)
from passages.functions.text import embed_words, fields
from passages.functions.vectors import cosine, fnv1a
from passages.operators import embedding
from passages.operators.concepts import definition_queries, expand_queries, matched_features
from passages.operators.fulltext import phrase_hits, query_phrases
from passages.operators.snippets import book_term_snippets
from passages.plans import search
from passages.queries import bindings as b
from passages.queries.bindings import (
    ATTACHED_SQL, CITED_SQL, GAME_QUESTIONS_SQL, QUESTIONS_SQL, SECTIONS_SQL, SYNONYMS_SQL,
    collapse_sql, embed_words_sql, fields_sql, fnv_sql, marked_sql, terms_sql, trim_sql, with_sql,
)
from passages.queries.registry import query
from passages.sources.tables import read_table, stage, synonym_rows

# ---- oracle fragments ---------------------------------------------------------------------------

TERMS_SQL = f"""terms AS (
SELECT section_id, pdf_id, {terms_sql('title')} AS title_terms, {terms_sql('plain_text')} AS body_terms
FROM sections),
sized AS (SELECT *, len(title_terms) + len(body_terms) AS n_terms FROM terms)"""


def phrases_sql(source: str, text: str) -> str:
    return f"""words AS (
SELECT query_id, unnest({fields_sql(text)}) AS word, generate_subscripts({fields_sql(text)}, 1) - 1 AS ordinal
FROM {source}),
phrase_lists AS (
SELECT query_id, ordinal, {terms_sql("replace(word, '\"', '')")} AS pieces FROM words),
phrases AS (
SELECT query_id, CAST(ordinal AS INTEGER) AS ordinal, array_to_string(pieces, ' ') AS phrase,
       CAST(len(pieces) AS INTEGER) AS n_words
FROM phrase_lists WHERE len(pieces) > 0)"""


# Counts runs of one to three terms that begin with a phrase; longer phrases do not occur in the
# given questions.
HITS_SQL = """runs AS (
SELECT section_id, n, array_to_string(list_slice(terms, i, i + n - 1), ' ') AS run
FROM (SELECT section_id, terms, n, unnest(range(1, len(terms) - n + 2)) AS i
      FROM (SELECT section_id, title_terms AS terms FROM sized
            UNION ALL SELECT section_id, body_terms FROM sized),
           (SELECT DISTINCT n_words AS n FROM phrases))),
run_counts AS (SELECT section_id, n, run, count(*) AS f FROM runs GROUP BY ALL),
vocabulary AS (SELECT DISTINCT n, run FROM run_counts),
wanted AS (SELECT DISTINCT phrase, n_words FROM phrases),
prefixed AS (
SELECT v.n, v.run, w.phrase FROM vocabulary v JOIN wanted w ON v.n = w.n_words AND starts_with(v.run, w.phrase)),
hits AS (
SELECT section_id, phrase, CAST(sum(f) AS INTEGER) AS f
FROM run_counts JOIN prefixed USING (n, run) GROUP BY ALL)"""

RANK_SQL = """corpus AS (SELECT count(*) AS n_rows, avg(n_terms) AS mean FROM sized),
spread AS (SELECT phrase, count(*) AS n_with FROM hits GROUP BY ALL),
weights AS (
SELECT query_id, phrase, count(*) AS times,
       greatest(ln((any_value(n_rows) - any_value(n_with) + 0.5) / (any_value(n_with) + 0.5)), 0) AS idf
FROM phrases JOIN spread USING (phrase), corpus GROUP BY query_id, phrase),
scored AS (
SELECT query_id, section_id, pdf_id,
       round(-sum(times * (CASE WHEN idf > 0 THEN idf ELSE 1e-6 END)
                  * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * n_terms / mean))), 9) AS fts_rank
FROM weights JOIN hits USING (phrase) JOIN sized USING (section_id), corpus
{scope}
GROUP BY query_id, section_id, pdf_id),
candidates AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fts_rank, section_id) AS fts_pos
               FROM scored) WHERE fts_pos <= 100)"""

MATCH_SQL = """by_synonym AS (
SELECT query_id, s.feature_id FROM {texts} q JOIN synonyms s ON contains({marked}, {phrase})),
by_term AS (
SELECT query_id, g.feature_id FROM {texts} q JOIN {glossary} g
ON contains(lower(q.{text}), lower(g.term)) {scope}),
{name} AS (SELECT * FROM by_synonym UNION SELECT * FROM by_term)"""


def match_sql(texts: str, text: str, name: str = "matched", glossary: str = "glossary", scope: str = "") -> str:
    body = MATCH_SQL.format(
        texts=texts, text=text, glossary=glossary, scope=scope, name=name,
        marked=marked_sql(f"q.{text}"), phrase=marked_sql("s.synonym"),
    )
    return body.replace("by_synonym", f"{name}_s").replace("by_term", f"{name}_t")


def weights_sql(texts: str, key: str, text: str, name: str) -> str:
    """(key, bucket, weight) of a relation of texts."""
    return f"""{name}_words AS (SELECT {key}, unnest({embed_words_sql(text)}) AS word FROM {texts}),
{name}_vocab AS (SELECT word, CAST({fnv_sql('word')} % 256 AS INTEGER) AS bucket
                 FROM (SELECT DISTINCT word FROM {name}_words)),
{name}_counts AS (SELECT {key}, bucket, count(*) AS n FROM {name}_words JOIN {name}_vocab USING (word) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {name}_counts)"""


STOP_SQL = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)


def boost_sql(title: str, text: str) -> str:
    trimmed = (
        f"list_transform({fields_sql(f'lower({text})')}, "
        """lambda w: regexp_replace(w, '^[.,?!;:"''()\\[\\]]+|[.,?!;:"''()\\[\\]]+\\z', '', 'g'))"""
    )
    kept = (
        f"list_filter({trimmed}, lambda w: strlen(w) >= 3 AND w NOT IN ({STOP_SQL}) "
        f"AND contains(lower({title}), w))"
    )
    return f"least(0.24, 0.06 * len({kept}))"


def tabular_sql(line: str) -> str:
    digits = f"len(regexp_extract_all({line}, '\\p{{Nd}}'))"
    letters = f"len(regexp_extract_all({line}, '\\p{{L}}'))"
    pieces = fields_sql(line)
    figures = f"len(list_filter({pieces}, lambda p: regexp_matches(p, '^\\p{{Nd}}+\\z')))"
    return (
        f"({digits} + {letters} > 0 AND (({figures} >= 3 AND len({pieces}) <= 10) OR "
        f"({digits} / nullif({digits} + {letters}, 0)::DOUBLE > 0.4 AND strlen({line}) < 100)))"
    )


LINES_SQL = f"""lines AS (
SELECT section_id, line_no, {trim_sql('line')} AS line
FROM (SELECT section_id, unnest(string_split(plain_text, chr(10))) AS line,
             generate_subscripts(string_split(plain_text, chr(10)), 1) - 1 AS line_no FROM sections)
WHERE {trim_sql('line')} <> ''),
judged_lines AS (SELECT *, {tabular_sql('line')} AS tabular FROM lines),
penalties AS (
SELECT section_id, 0.18 * avg(CASE WHEN tabular THEN 1.0 ELSE 0.0 END) AS penalty
FROM judged_lines GROUP BY ALL)"""


def snippet_sql(text: str, asked: str) -> str:
    flat = collapse_sql(text)
    at = f"instr(lower({flat}), lower({trim_sql(asked)}))"
    return f"""CASE WHEN length({flat}) <= 240 THEN {flat}
WHEN {at} > 0 THEN {trim_sql(f"substring({flat}, CAST(greatest({at} - 41, 0) + 1 AS BIGINT), 240)")} || '…'
ELSE left({flat}, 240) || '…' END"""


# ---- queries ------------------------------------------------------------------------------------


@query("fts_terms", with_sql(QUESTIONS_SQL, phrases_sql("questions", "query_text"))
       + "SELECT query_id, ordinal, phrase, n_words FROM phrases")
def fts_terms(spark, folder):
    return query_phrases(b.questions(spark, folder))


@query("fts_prefix_match", with_sql(SECTIONS_SQL, QUESTIONS_SQL, TERMS_SQL, phrases_sql("questions", "query_text"), HITS_SQL)
       + "SELECT section_id, phrase, f FROM hits")
def fts_prefix_match(spark, folder):
    return phrase_hits(b.text_index(spark, folder), query_phrases(b.questions(spark, folder))).select("section_id", "phrase", "f")


@query("bm25_rank", with_sql(SECTIONS_SQL, QUESTIONS_SQL, TERMS_SQL, phrases_sql("questions", "query_text"), HITS_SQL, RANK_SQL.format(scope=""))
       + "SELECT query_id, section_id, pdf_id, round(fts_rank, 6) AS fts_rank, CAST(fts_pos AS INTEGER) AS fts_pos FROM candidates")
def bm25_rank(spark, folder):
    ranked = search.candidates_only(
        b.sections(spark, folder), b.questions(spark, folder), index=b.text_index(spark, folder)
    )
    return ranked.withColumn("fts_rank", F.round("fts_rank", 6))


@query("fnv_hash", with_sql(SECTIONS_SQL, f"words AS (SELECT DISTINCT unnest({embed_words_sql('plain_text')}) AS word FROM sections)")
       + f"SELECT word, CAST({fnv_sql('word')} AS BIGINT) AS hash FROM words")
def fnv_hash(spark, folder):
    words = F.explode(embed_words(F.col("plain_text"))).alias("word")
    distinct = b.sections(spark, folder).select(words).distinct()
    return distinct.select("word", fnv1a(F.col("word")).alias("hash"))


@query("hash_embed", with_sql(SECTIONS_SQL, weights_sql("sections", "section_id", r"title || chr(10) || plain_text", "w"))
       + "SELECT section_id, bucket, round(weight, 6) AS weight FROM w")
def hash_embed(spark, folder):
    texts = b.sections(spark, folder).select(
        "section_id", F.concat_ws("\n", "title", "plain_text").alias("text")
    )
    cells = embedding.bucket_weights(texts, "section_id", "text")
    return cells.withColumn("weight", F.round("weight", 6))


@query("rebuild_vectors", with_sql(SECTIONS_SQL, weights_sql("(SELECT * FROM sections WHERE plain_text <> '')", "section_id", r"title || chr(10) || chr(10) || plain_text", "w"))
       + """SELECT s.section_id, s.pdf_id, CAST(256 AS INTEGER) AS dims, count(w.bucket) AS filled,
       round(coalesce(sum(w.weight), 0), 6) AS total
FROM sections s LEFT JOIN w USING (section_id) WHERE plain_text <> '' GROUP BY s.section_id, s.pdf_id""")  # fmt: skip
def rebuild_vectors(spark, folder):
    indexed = b.sections(spark, folder).where("plain_text <> ''")
    texts = indexed.select(
        "section_id", "pdf_id", F.concat_ws("\n\n", "title", "plain_text").alias("text")
    )
    key = F.struct("section_id", "pdf_id").alias("key")
    vectors = embedding.dense_vectors(texts.select(key, "text"), "key", "text").select("key.*", "embedding")
    filled = F.filter("embedding", lambda x: x > 0)
    return vectors.select(
        "section_id",
        "pdf_id",
        F.size("embedding").alias("dims"),
        F.size(filled).cast("bigint").alias("filled"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
    )


@query("cosine", """SELECT a.vec_id, b.vec_id AS next_id,
round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
      / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
         * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")  # fmt: skip
def neighbour_cosine(spark, folder):
    a = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    following = a.select(
        (F.col("vec_id") - 1).alias("vec_id"),
        F.col("vec_id").alias("next_id"),
        F.col("embedding").alias("next_embedding"),
    )
    return a.join(following, "vec_id").select(
        "vec_id",
        "next_id",
        F.round(cosine(F.col("embedding"), F.col("next_embedding")), 6).alias("similarity"),
    )


@query("vector_delete", """SELECT label, count(*) AS left_over FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY label""")
def vector_delete(spark, folder):
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "label")
    toxic = read_table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    left = embedding.without_sections(vectors, toxic, "vec_id")
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("left_over"))


@query("knn", with_sql(
    SECTIONS_SQL, QUESTIONS_SQL,
    weights_sql("sections", "section_id", r"title || chr(10) || chr(10) || plain_text", "d"),
    weights_sql("questions", "query_id", "query_text", "q"),
    """sims AS (SELECT query_id, section_id, round(sum(q.weight * d.weight), 9) AS similarity
FROM q JOIN d USING (bucket) GROUP BY ALL)""")
    + """SELECT query_id, section_id, round(similarity, 6) AS similarity, CAST(spot AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, section_id) AS spot FROM sims)
WHERE spot <= 10""")  # fmt: skip
def knn(spark, folder):
    """Neighbours among the vectors that the index holds."""
    cells = b.text_index(spark, folder).cells
    vectors = cells.select("section_id", embedding.dense_cells(F.col("cells")).alias("embedding"))
    asked = embedding.dense_vectors(b.questions(spark, folder), "query_id", "query_text")
    found = embedding.nearest(vectors.withColumnRenamed("section_id", "key"), asked, 10)
    return found.select(
        "query_id", F.col("key").alias("section_id"), F.round("similarity", 6).alias("similarity"), "rank"
    )


TURNS_SQL = """turns AS (
SELECT a.conv_id, a.turn, split_part(a.text, chr(10), 1) AS title, b.text AS asked
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"""


@query("title_boost", with_sql(TURNS_SQL)
       + f"SELECT conv_id, turn, round(CAST({boost_sql('title', 'asked')} AS DOUBLE), 6) AS boost FROM turns")
def title_boosts(spark, folder):
    """First line of each turn as a title, the turn before it as the question."""
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    boost = title_boost(F.substring_index("text", "\n", 1), F.col("asked"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(boost, 6).alias("boost"))


ORDER_TEXT_SQL = """sections AS (
SELECT o_orderkey AS section_id,
       o_orderpriority || ' ' || o_orderkey || chr(10) || ' status ' || o_orderstatus || chr(10) || chr(10)
       || o_custkey || ' ' || year(o_orderdate) || ' ' || month(o_orderdate) || ' rows' AS plain_text
FROM orders)"""


def order_texts(spark, folder):
    """Short texts of the orders, some of whose lines read like table rows."""
    number = [F.col("o_custkey"), F.year("o_orderdate"), F.month("o_orderdate")]
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("section_id"),
        F.concat_ws(
            "\n",
            F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")),
            F.concat(F.lit(" status "), "o_orderstatus"),
            F.lit(""),
            F.concat_ws(" ", *[n.cast("string") for n in number], F.lit("rows")),
        ).alias("plain_text"),
    )


@query("tabular_lines", with_sql(ORDER_TEXT_SQL, LINES_SQL)
       + "SELECT section_id, line FROM judged_lines WHERE tabular")
def tabular_lines(spark, folder):
    lines = order_texts(spark, folder).select("section_id", F.explode(text_lines(F.col("plain_text"))).alias("line"))
    return lines.where(is_tabular(F.col("line")))


@query("table_penalty", with_sql(ORDER_TEXT_SQL, LINES_SQL)
       + """SELECT section_id, round(coalesce(penalty, 0.0), 6) AS penalty
FROM sections LEFT JOIN penalties USING (section_id)""")  # fmt: skip
def table_penalties(spark, folder):
    return order_texts(spark, folder).select(
        "section_id", F.round(table_penalty(F.col("plain_text")), 6).alias("penalty")
    )


@query("snippet", with_sql(SECTIONS_SQL, CITED_SQL)
       + f"SELECT s.section_id, c.term, {snippet_sql('s.plain_text', 'c.term')} AS snippet "
       "FROM sections s JOIN (SELECT DISTINCT pdf_id, term FROM glossary) c ON c.pdf_id = s.pdf_id")  # fmt: skip
def snippets(spark, folder):
    """Every section beside every term of its book."""
    terms = b.glossary(b.cited_sections(spark, folder)).select("pdf_id", "term").distinct()
    return book_term_snippets(b.sections(spark, folder), terms)


GLOSSARY_SCOPED_SQL = """scoped_glossary AS (
SELECT game_id, sort_order AS pdf_order, feature_id, term FROM attached JOIN glossary USING (pdf_id))"""


def expand_sql(source: str, glossary: str, scope: str, matched: str = "widened") -> str:
    """source with fts_text; ``scope`` joins a glossary row g to a question q."""
    return f"""offers AS (
SELECT q.query_id, lower(g.term) AS k, min({{'pdf_order': g.pdf_order, 'feature_id': g.feature_id, 'term': g.term}}) AS best
FROM {source} q JOIN {matched} m ON m.query_id = q.query_id
JOIN {glossary} g ON g.feature_id = m.feature_id AND {scope}
GROUP BY q.query_id, lower(g.term)),
extra AS (
SELECT q.query_id, string_agg((best).term, ' ' ORDER BY best) AS added
FROM offers o JOIN {source} q USING (query_id)
WHERE NOT list_contains(list_transform({fields_sql('q.query_text')}, lambda x: lower(x)), o.k)
GROUP BY ALL),
expanded AS (
SELECT q.*, CASE WHEN q.query_id IN (SELECT query_id FROM {matched})
            THEN array_to_string({fields_sql('q.query_text')}, ' ') || coalesce(' ' || added, '')
            ELSE query_text END AS fts_text
FROM {source} q LEFT JOIN extra USING (query_id))"""


def rerank_sql(rank_scope: str, asked: str) -> str:
    """Everything from expanded questions (query_id, game_id, …) to ranked hits."""
    return ",\n".join([
        TERMS_SQL,
        phrases_sql("expanded", "fts_text"),
        HITS_SQL,
        RANK_SQL.format(scope=rank_scope),
        match_sql("expanded", "query_text", "told", *asked.split("|")),
        """cited_pairs AS (
SELECT DISTINCT t.query_id, c.section_id FROM told t JOIN expanded e USING (query_id)
JOIN attached a USING (game_id) JOIN citations c ON c.pdf_id = a.pdf_id AND c.feature_id = t.feature_id)""",
        LINES_SQL,
        weights_sql("(SELECT * FROM sections WHERE section_id IN (SELECT section_id FROM candidates))",
                    "section_id", "title || chr(10) || plain_text", "d"),
        weights_sql("expanded", "query_id", "query_text", "qw"),
        """sims AS (
SELECT query_id, section_id, sum(qw.weight * d.weight) AS score
FROM candidates JOIN qw USING (query_id) JOIN d USING (section_id, bucket) GROUP BY ALL)""",
        f"""judged AS (
SELECT c.query_id, c.section_id, c.pdf_id, a.pdf_title, s.title AS section_title, s.start_page, s.end_page,
       a.sort_order AS pdf_sort_order, coalesce(m.score, 0) AS score, c.fts_rank, c.fts_pos,
       {snippet_sql('s.plain_text', 'e.query_text')} AS snippet,
       round(coalesce(m.score, 0) + {boost_sql('s.title', 'e.query_text')} - coalesce(p.penalty, 0)
             + CASE WHEN cp.section_id IS NOT NULL THEN 0.08 ELSE 0 END, 9) AS adjusted_score,
       e.fts_text <> e.query_text AS query_rewritten,
       count(*) OVER (PARTITION BY c.query_id) AS fts_candidates
FROM candidates c JOIN sections s USING (section_id) JOIN expanded e USING (query_id)
JOIN attached a ON a.game_id = e.game_id AND a.pdf_id = c.pdf_id
LEFT JOIN sims m ON m.query_id = c.query_id AND m.section_id = c.section_id
LEFT JOIN penalties p ON p.section_id = c.section_id
LEFT JOIN cited_pairs cp ON cp.query_id = c.query_id AND cp.section_id = c.section_id),
ranked AS (
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted_score DESC, pdf_sort_order DESC, fts_pos) AS INTEGER) AS rank
FROM judged)""",
    ])


HITS_OUT = """SELECT query_id, rank, section_id, pdf_id, pdf_title, section_title, start_page, end_page,
pdf_sort_order, round(score, 6) AS score, round(fts_rank, 6) AS fts_rank, snippet,
round(adjusted_score, 6) AS adjusted_score, fts_candidates, query_rewritten
FROM ranked WHERE rank <= 10"""

SCOPED_QUESTIONS_SQL = f"""asked AS (
SELECT query_id, game_id, {trim_sql('query_text')} AS query_text FROM game_questions)"""

HYBRID_SQL = with_sql(
    SECTIONS_SQL, ATTACHED_SQL, GAME_QUESTIONS_SQL, CITED_SQL, SYNONYMS_SQL, GLOSSARY_SCOPED_SQL,
    SCOPED_QUESTIONS_SQL,
    "doubled AS (SELECT query_id, game_id, query_text || ' ' || query_text AS both_text FROM asked)",
    match_sql("doubled", "both_text", "widened", "scoped_glossary", "AND g.game_id = q.game_id"),
    expand_sql("asked", "scoped_glossary", "g.game_id = q.game_id"),
    rerank_sql("WHERE (query_id, pdf_id) IN (SELECT (e.query_id, a.pdf_id) FROM expanded e JOIN attached a USING (game_id))",
               "scoped_glossary|AND g.game_id = q.game_id"),
)


def hybrid_hits(spark, folder, limit=search.RESULTS, **hooks):
    rows = b.cited_sections(spark, folder)
    return search.hybrid_search(
        b.sections(spark, folder),
        b.game_questions(spark, folder),
        stage(b.attached(spark, folder), "attached"),
        synonym_rows(b.catalogue(spark)),
        b.glossary(rows),
        b.citations(rows),
        limit=limit,
        index=b.text_index(spark, folder),
        **hooks,
    )


def rounded_hits(hits):
    return hits.withColumns(
        {c: F.round(c, 6) for c in ("score", "fts_rank", "adjusted_score")}
    )


@query("hybrid_search", HYBRID_SQL + HITS_OUT)
def hybrid_search(spark, folder):
    return rounded_hits(hybrid_hits(spark, folder))


# A stand-in for a model's vectors: length, and how often two letters occur. Blank texts have none.
VECTOR_SQL = "[CAST(length({t}) AS DOUBLE), length({t}) - length(replace({t}, 'e', '')), length({t}) - length(replace({t}, 'n', ''))]"
SIMS_SQL = """sims AS (
SELECT query_id, section_id, sum(qw.weight * d.weight) AS score
FROM candidates JOIN qw USING (query_id) JOIN d USING (section_id, bucket) GROUP BY ALL)"""
EMBEDDED_SQL = f"""sims AS (
SELECT c.query_id, c.section_id, list_cosine_similarity({VECTOR_SQL.format(t="e.query_text")}, {VECTOR_SQL.format(t="(s.title || chr(10) || s.plain_text)")}) AS score
FROM candidates c JOIN expanded e USING (query_id) JOIN sections s USING (section_id))"""


@query("hybrid_embedded", HYBRID_SQL.replace(SIMS_SQL, EMBEDDED_SQL) + HITS_OUT)
def hybrid_embedded(spark, folder):
    """Search with a caller's vectors in place of the hashed ones."""

    def embed(texts):
        def count(letter):
            return (F.length("text") - F.length(F.replace("text", F.lit(letter), F.lit("")))).cast("double")

        return texts.select("key", F.array(F.length("text").cast("double"), count("e"), count("n")).alias("vector"))

    return rounded_hits(hybrid_hits(spark, folder, embed=embed))


# A stand-in for a rewriter: the first words of the next question, a blank reply to every fourth, none to the last.
def _unquoted_list(expr: str) -> str:
    return (
        f"list_filter(list_transform({fields_sql(expr)}, "
        """lambda w: regexp_replace(w, '^["'']+|["'']+\\z', '', 'g')), lambda w: w <> '')"""
    )


_both_words = f"list_concat({_unquoted_list('query_text')}, {_unquoted_list('keywords')})"
REWRITTEN_SQL = f"""replies AS (
SELECT g.query_id, CASE WHEN n.item_id % 4 <> 0 THEN array_to_string(list_slice({fields_sql('n.text')}, 1, 3), ' ') ELSE '' END AS keywords
FROM game_questions g JOIN benchmark n ON n.item_id = CAST(split_part(g.query_id, '/', 2) AS BIGINT) + 1),
asked AS (
SELECT query_id, game_id, query_text, CASE WHEN coalesce(keywords, '') = '' THEN query_text ELSE
array_to_string(list_filter(words, lambda w, i: list_position(list_transform(words, lambda x: lower(x)), lower(w)) = i), ' ') END AS rewritten
FROM (SELECT g.query_id, game_id, {trim_sql('query_text')} AS query_text, keywords, {_both_words} AS words
      FROM game_questions g LEFT JOIN replies r USING (query_id)))"""
HYBRID_REWRITTEN_SQL = (
    HYBRID_SQL.replace(SCOPED_QUESTIONS_SQL, REWRITTEN_SQL)
    .replace("query_text || ' ' || query_text AS both_text", "query_text || ' ' || rewritten AS both_text")
    .replace(
        expand_sql("asked", "scoped_glossary", "g.game_id = q.game_id"),
        expand_sql("asked", "scoped_glossary", "g.game_id = q.game_id").replace("query_text", "rewritten"),
    )
    .replace("e.fts_text <> e.query_text AS query_rewritten", "(e.rewritten <> e.query_text OR e.fts_text <> e.rewritten) AS query_rewritten")
)


@query("hybrid_rewritten", HYBRID_REWRITTEN_SQL + HITS_OUT)
def hybrid_rewritten(spark, folder):
    """Search with a rewriter's replies merged into the questions."""
    following = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("next_id"), F.array_join(F.slice(fields(F.col("text")), 1, 3), ", ").alias("words")
    )
    asked = b.game_questions(spark, folder).select("query_id")
    numbered = asked.withColumn("next_id", F.split("query_id", "/")[1].cast("bigint") + 1)
    reply = F.concat(F.lit('"'), F.col("words"), F.lit('"\nand more'))
    raw = F.when(F.col("next_id") % 4 != 0, reply).otherwise(F.lit(' ""'))
    rewrites = numbered.join(following, "next_id").select("query_id", raw.alias("raw"))
    return rounded_hits(hybrid_hits(spark, folder, rewrites=rewrites))


@query("expand_query", with_sql(
    SECTIONS_SQL, ATTACHED_SQL, GAME_QUESTIONS_SQL, CITED_SQL, SYNONYMS_SQL, GLOSSARY_SCOPED_SQL,
    match_sql("game_questions", "query_text", "widened", "scoped_glossary", "AND g.game_id = q.game_id"),
    expand_sql("game_questions", "scoped_glossary", "g.game_id = q.game_id"))
    + "SELECT query_id, fts_text FROM expanded")
def expand_query(spark, folder):
    asked = b.game_questions(spark, folder)
    terms = game_glossary(spark, folder, b.cited_sections(spark, folder))
    matched = matched_features(
        asked, "query_id", "query_text", synonym_rows(b.catalogue(spark)), terms, "game_id"
    )
    return expand_queries(asked, matched, terms, scope="game_id").select("query_id", "fts_text")


def game_glossary(spark, folder, cited_rows):
    return b.attached(spark, folder).join(b.glossary(cited_rows), "pdf_id").select(
        "game_id", F.col("sort_order").alias("pdf_order"), "feature_id", "term"
    )


def _keywords_sql(expr: str, question: str = "") -> str:
    marks = f"[.,;:{question}\"''()\\[\\]]+"
    bare = f"regexp_replace(w, '^{marks}|{marks}\\z', '', 'g')"
    return f"list_filter(list_transform({fields_sql(expr)}, lambda w: {bare}), lambda w: strlen(w) >= 4)"


# Parts in order: name, synonyms, description words, question words, own terms, two fixed words.
FEATURE_QUERY_SQL = f"""feature_parts AS (
SELECT c.feature_id, list_concat([c.name], c.synonyms, {_keywords_sql('c.description')},
       coalesce(flatten(list_transform(c.questions, lambda x: {_keywords_sql('x', '?')})), [])) AS parts
FROM catalogue c),
own_terms AS (SELECT pdf_id, feature_id, list_sort(list(DISTINCT term)) AS terms FROM glossary GROUP BY ALL),
feature_words AS (
SELECT d.pdf_id, d.feature_id,
       list_filter(list_transform(list_concat(coalesce(p.parts, []), coalesce(o.terms, []), ['rules', 'definition']),
                                  lambda w: {trim_sql('w')}), lambda w: w <> '') AS words
FROM requests d LEFT JOIN feature_parts p USING (feature_id) LEFT JOIN own_terms o USING (pdf_id, feature_id)),
feature_queries AS (
SELECT pdf_id, feature_id, array_to_string(list_filter(words, lambda w, i:
       list_position(list_transform(words, lambda x: lower(x)), lower(w)) = i), ' ') AS query_text
FROM feature_words)"""

# Every book is asked for every feature it holds and for those it lacks.
REQUESTS_SQL = """requests AS (
SELECT DISTINCT a.pdf_id, c.feature_id FROM attached a, catalogue c)"""


def feature_requests(spark, folder):
    """(pdf_id, feature_id) for every book and catalogue feature."""
    ids = F.array(*[F.lit(row[1]) for row in b.CATALOGUE])
    return b.attached(spark, folder).select("pdf_id", F.explode(ids).alias("feature_id"))


def feature_questions(spark, folder, cited_rows):
    return definition_queries(
        feature_requests(spark, folder), b.features(spark), b.glossary(cited_rows)
    )


@query("feature_query", with_sql(SECTIONS_SQL, ATTACHED_SQL, CITED_SQL, SYNONYMS_SQL, REQUESTS_SQL, FEATURE_QUERY_SQL)
       + "SELECT pdf_id, feature_id, query_text FROM feature_queries")
def feature_query(spark, folder):
    return feature_questions(spark, folder, b.cited_sections(spark, folder))


PDF_SEARCH_SQL = with_sql(
    SECTIONS_SQL,
    CITED_SQL, SYNONYMS_SQL,
    """attached AS (
SELECT DISTINCT source AS game_id, source AS pdf_id, 'Book ' || source AS pdf_title, 0 AS sort_order FROM documents)""",
    REQUESTS_SQL, FEATURE_QUERY_SQL,
    "scoped_glossary AS (SELECT pdf_id AS game_id, 0 AS pdf_order, feature_id, term FROM glossary)",
    """asked AS (
SELECT pdf_id || '/' || feature_id AS query_id, pdf_id AS game_id, query_text FROM feature_queries)""",
    "doubled AS (SELECT query_id, game_id, query_text || ' ' || query_text AS both_text FROM asked)",
    match_sql("doubled", "both_text", "widened", "scoped_glossary", "AND g.game_id = q.game_id"),
    expand_sql("asked", "scoped_glossary", "g.game_id = q.game_id"),
    rerank_sql("WHERE (query_id, pdf_id) IN (SELECT (query_id, game_id) FROM expanded)",
               "scoped_glossary|AND g.game_id = q.game_id"),
)


def pdf_hits(spark, folder):
    """Every book searched for the definition of every feature."""
    rows = b.cited_sections(spark, folder)
    asked = feature_questions(spark, folder, rows).select(
        F.concat_ws("/", "pdf_id", "feature_id").alias("query_id"), "pdf_id", "query_text"
    )
    books = stage(b.attached(spark, folder).select("pdf_id", "pdf_title"), "books")
    return search.search_books(
        b.sections(spark, folder), asked, books, synonym_rows(b.catalogue(spark)), b.glossary(rows), b.citations(rows),
        index=b.text_index(spark, folder),
    )


@query("pdf_search", PDF_SEARCH_SQL + HITS_OUT)
def pdf_search(spark, folder):
    return rounded_hits(pdf_hits(spark, folder))
