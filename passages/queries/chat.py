"""Hit lists, text blocks, lookups, prompts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import hits, replies, reports
from passages.operators.meta import pending_features
from passages.plans import chat, learnings
from passages.plans.search import TOOL_RESULTS
from passages.queries import bindings as b
from passages.queries.bindings import fields_sql, trim_sql
from passages.queries.concepts import (
    CANDIDATES_SQL, COUNTS_SQL, FREQUENT_SQL, MATCHED_SQL, matched,
)
from passages.queries.metas import PARTS_SQL
from passages.queries.registry import query
from passages.queries.search import HYBRID_SQL, PDF_SEARCH_SQL, feature_requests, hybrid_hits, pdf_hits
from passages.sources.tables import new_folder, read_table, stage, synonym_rows

# ---- oracle fragments ---------------------------------------------------------------------------

USABLE_SQL = """usable AS (SELECT pdf_id, feature_id, definition FROM cheatsheet WHERE definition <> '')"""
SHOWN_SQL = """shown AS (
SELECT query_id, feature_id FROM matched
UNION
SELECT q.query_id, u.feature_id FROM game_questions q, (SELECT DISTINCT feature_id FROM usable) u
WHERE q.query_id NOT IN (SELECT query_id FROM matched))"""


def excerpt_sql(expr: str, n: int = 400) -> str:
    words = fields_sql(expr)
    return f"array_to_string(list_slice({words}, 1, {n}), ' ') || CASE WHEN len({words}) > {n} THEN '...' ELSE '' END"


CITATION_HITS_SQL = f"""offered AS (
SELECT s.query_id, c.section_id, a.sort_order AS pdf_order, s.feature_id, c.pos, c.pdf_id,
       coalesce(nullif(c.section_title, ''), t.title) AS section_title,
       coalesce(nullif(c.start_page, 0), t.start_page) AS start_page, coalesce(nullif(c.end_page, 0), t.end_page) AS end_page,
       {excerpt_sql('t.plain_text')} AS snippet,
       row_number() OVER (PARTITION BY s.query_id, c.section_id ORDER BY a.sort_order, s.feature_id, c.pos) AS nth
FROM shown s JOIN game_questions q USING (query_id) JOIN attached a USING (game_id)
JOIN usable u ON u.pdf_id = a.pdf_id AND u.feature_id = s.feature_id
JOIN citations c ON c.pdf_id = u.pdf_id AND c.feature_id = u.feature_id
JOIN sections t ON t.section_id = c.section_id AND t.pdf_id = c.pdf_id WHERE {trim_sql('t.plain_text')} <> ''),
citation_hits AS (SELECT * FROM offered WHERE nth = 1)"""

ENTRY_SQL = """named AS (
SELECT u.pdf_id, u.feature_id, u.definition, coalesce(nullif(trim(c.name), ''), u.feature_id) AS feature_name
FROM usable u LEFT JOIN catalogue c USING (feature_id)),
cited_lines AS (
SELECT pdf_id, feature_id, string_agg('  [' || (pos + 1) || '] ' || section_title || ' [section_id=' || section_id || '] (page ' || start_page || ')' || chr(10), '' ORDER BY pos) AS tail
FROM citations GROUP BY ALL),
entries AS (
SELECT a.game_id, a.sort_order, n.feature_id,
'- ' || a.pdf_title || ' / ' || n.feature_name || ' (' || n.feature_id || '): ' || n.definition || chr(10) || coalesce(c.tail, '') AS entry
FROM attached a JOIN named n USING (pdf_id) LEFT JOIN cited_lines c USING (pdf_id, feature_id))"""

LINES_SQL = """own AS (SELECT pdf_id, feature_id, string_agg(term, ', ' ORDER BY term) AS terms FROM glossary GROUP BY ALL),
glossary_lines AS (
SELECT a.game_id, o.feature_id, a.sort_order, a.pdf_title,
'- ' || a.pdf_title || ' / ' || CASE WHEN trim(c.name) <> '' THEN c.name || ' (' || o.feature_id || ')' ELSE o.feature_id END
|| ': ' || o.terms AS line, o.terms
FROM attached a JOIN own o USING (pdf_id) LEFT JOIN catalogue c USING (feature_id))"""


def parts(spark, folder):
    return b.cited_sections(spark, folder)


# ---- hit lists ----------------------------------------------------------------------------------


@query("citation_hits", MATCHED_SQL.rstrip() + ",\n" + ",\n".join([USABLE_SQL, SHOWN_SQL, CITATION_HITS_SQL])
       + """ SELECT query_id, section_id, pdf_id, feature_id, start_page, end_page, section_title, snippet, CAST(1 AS DOUBLE) AS score
FROM citation_hits""")  # fmt: skip
def citation_hits(spark, folder):
    rows = parts(spark, folder)
    found = hits.citation_hits(
        b.game_questions(spark, folder), matched(spark, folder, rows), b.cheatsheet(rows), b.citations(rows),
        b.sections(spark, folder), b.attached(spark, folder),
    )
    return found.select(
        "query_id", "section_id", "pdf_id", "feature_id", "start_page", "end_page", "section_title", "snippet", "score"
    )


@query("chat_context", HYBRID_SQL.rstrip() + ",\n" + ",\n".join(
    [USABLE_SQL, "matched AS (SELECT * FROM told)", SHOWN_SQL, CITATION_HITS_SQL, """both_lists AS (
SELECT query_id, section_id, 0 AS prio, row_number() OVER (PARTITION BY query_id ORDER BY pdf_order, feature_id, pos) AS pos,
       section_title, snippet, CAST(1 AS DOUBLE) AS score FROM citation_hits
UNION ALL SELECT query_id, section_id, 1, rank, section_title, snippet, score FROM ranked WHERE rank <= 10),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, section_id ORDER BY prio, pos) AS nth FROM both_lists),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prio, pos) AS spot FROM once WHERE nth = 1)"""])
    + """ SELECT query_id, CAST(spot AS INTEGER) AS spot, prio = 0 AS cited, section_id, section_title, md5(replace(snippet, '…', '...')) AS snippet,
round(score, 6) AS score FROM placed WHERE spot <= 10""")  # fmt: skip
def chat_context(spark, folder):
    rows = parts(spark, folder)
    found = hybrid_hits(spark, folder)
    merged = chat.context_hits(
        b.game_questions(spark, folder), matched(spark, folder, rows), b.cheatsheet(rows), b.citations(rows),
        b.sections(spark, folder), found, b.attached(spark, folder),
    )
    return merged.select(
        "query_id", "spot", "cited", "section_id", "section_title", F.md5("snippet").alias("snippet"),
        F.round("score", 6).alias("score"),
    )


@query("chat_blocks", HYBRID_SQL.rstrip() + ",\n" + ",\n".join(
    [USABLE_SQL, "matched AS (SELECT * FROM told)", SHOWN_SQL, CITATION_HITS_SQL, ENTRY_SQL.replace("FROM citations GROUP", "FROM citations WHERE pos < 10 GROUP"),
     LINES_SQL, f"""game_terms AS (
SELECT game_id, {b.quote(reports.CHAT_GLOSSARY)} || string_agg('- ' || pdf_title || ': ' || feature_id || ' → ' || terms || chr(10), '' ORDER BY sort_order, feature_id) AS block
FROM glossary_lines GROUP BY game_id),
sheets AS (
SELECT s.query_id, CASE WHEN s.query_id IN (SELECT query_id FROM matched) THEN {b.quote(reports.MATCHING_SHEET)} ELSE {b.quote(reports.WHOLE_SHEET)} END
|| string_agg(e.entry, '' ORDER BY e.sort_order, e.feature_id) AS block
FROM shown s JOIN game_questions q USING (query_id) JOIN entries e ON e.game_id = q.game_id AND e.feature_id = s.feature_id GROUP BY s.query_id),
found_sections AS (
SELECT query_id, section_id FROM citation_hits UNION SELECT query_id, section_id FROM ranked WHERE rank <= 10),
found_counts AS (SELECT query_id, least(count(*), 10) AS n FROM found_sections GROUP BY ALL)"""])
    + """ SELECT q.query_id, md5(coalesce(g.block, '')) AS glossary, md5(coalesce(s.block, '')) AS cheatsheet, coalesce(f.n, 0) AS n_sources
FROM game_questions q LEFT JOIN game_terms g USING (game_id) LEFT JOIN sheets s USING (query_id) LEFT JOIN found_counts f USING (query_id)""")  # fmt: skip
def chat_blocks(spark, folder):
    """All that an answer is given: hits with both blocks, one row a question."""
    rows, asked = parts(spark, folder), b.game_questions(spark, folder)
    found = stage(matched(spark, folder, rows), "matched")
    merged = chat.context_hits(
        asked, found, b.cheatsheet(rows), b.citations(rows), b.sections(spark, folder), hybrid_hits(spark, folder), b.attached(spark, folder)
    )
    blocks = chat.context_blocks(
        asked, found, b.glossary(rows), b.cheatsheet(rows), b.citations(rows), b.features(spark), b.attached(spark, folder)
    )
    whole = chat.chat_context(merged, blocks)
    return whole.select(
        "query_id", F.md5("glossary").alias("glossary"), F.md5("cheatsheet").alias("cheatsheet"), F.size("sources").cast("bigint").alias("n_sources")
    )


@query("fallback_answer", HYBRID_SQL + f""" SELECT q.query_id, md5(CASE WHEN count(r.rank) = 0 THEN {b.quote(reports.NOTHING_FOUND)} ELSE {b.quote(reports.FALLBACK_HEAD)}
|| string_agg(r.rank || '. **' || r.pdf_title || ' — ' || r.section_title || '** (pages ' || r.start_page || '-' || r.end_page || ')' || chr(10) || '   ' || r.snippet || chr(10) || chr(10), '' ORDER BY r.rank)
|| {b.quote(reports.FALLBACK_TAIL)} || any_value(q.query_text) END) AS answer
FROM game_questions q LEFT JOIN (SELECT * FROM ranked WHERE rank <= {TOOL_RESULTS}) r USING (query_id) GROUP BY q.query_id""")
def fallback_answer(spark, folder):
    answers = reports.fallback_answers(b.game_questions(spark, folder), hybrid_hits(spark, folder, TOOL_RESULTS))
    return answers.select("query_id", F.md5("answer").alias("answer"))


# Two lists of hits per customer: dear orders first, then all by number; lines as section ids.
@query("merge_hits", """WITH lists AS (
SELECT o_custkey AS query_id, o_orderpriority AS section_id, CASE WHEN o_totalprice > 400000 THEN 0 ELSE 1 END AS prio, o_orderkey AS pos FROM orders
UNION ALL SELECT o_custkey, ' ', 0, o_orderkey FROM orders),
once AS (SELECT query_id, section_id, min((prio, pos)) AS best FROM lists WHERE trim(section_id) <> '' GROUP BY ALL)
SELECT query_id, section_id, CAST(best[1] AS INTEGER) AS prio, best[2] AS pos, CAST(spot AS INTEGER) AS spot FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best) AS spot FROM once) WHERE spot <= 3""".replace(
    "min((prio, pos)) AS best", "min({'a': prio, 'b': pos}) AS best").replace("best[1]", "best.a").replace("best[2]", "best.b"))
def merge_hits(spark, folder):
    orders = read_table(spark, folder, "orders")
    prio = F.when(F.col("o_totalprice") > 400000, F.lit(0)).otherwise(F.lit(1))
    listed = orders.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("section_id"), prio.alias("prio"),
        F.col("o_orderkey").alias("pos"),
    )
    blank = listed.withColumns({"section_id": F.lit(" "), "prio": F.lit(0)})
    return hits.merge_hits(listed.unionByName(blank), ["query_id"], 3)


@query("session_hits", """SELECT user_id AS conv_id, event_type AS section_id, min(event_id) AS prio, CAST(0 AS INTEGER) AS pos FROM events GROUP BY ALL""")
def session_hits(spark, folder):
    """Searches of one session in call order; a section counts where it was found first."""
    found = read_table(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_type").alias("section_id"),
        F.col("event_id").alias("prio"), F.lit(0).alias("pos"),
    )
    return hits.merge_hits(found, ["conv_id"])


# ---- blocks and lookups ---------------------------------------------------------------------------


@query("glossary_block", PARTS_SQL.rstrip() + ",\n" + LINES_SQL + f""" SELECT game_id, {b.quote(reports.CHAT_GLOSSARY)}
|| string_agg('- ' || pdf_title || ': ' || feature_id || ' → ' || terms || chr(10), '' ORDER BY sort_order, feature_id) AS block
FROM glossary_lines GROUP BY game_id""")
def glossary_block(spark, folder):
    return reports.glossary_blocks(b.attached(spark, folder), b.glossary(b.cited_sections(spark, folder)))


SHEET_SQL = MATCHED_SQL.rstrip() + ",\n" + ",\n".join([USABLE_SQL, SHOWN_SQL, ENTRY_SQL])


def entries(spark, folder, rows):
    return reports.cheatsheet_entries(
        b.attached(spark, folder), b.cheatsheet(rows), b.citations(rows), b.features(spark)
    )


def shown(spark, folder, rows, found):
    asked = b.game_questions(spark, folder)
    offered = b.cheatsheet(rows).where("definition <> ''").select("feature_id").distinct()
    return hits.feature_filter(asked, found, offered).join(asked.select("query_id", "game_id"), "query_id")


@query("cheatsheet_for_query", SHEET_SQL + """ SELECT s.query_id, e.sort_order, e.feature_id, md5(e.entry) AS entry
FROM shown s JOIN game_questions q USING (query_id) JOIN entries e ON e.game_id = q.game_id AND e.feature_id = s.feature_id""")
def cheatsheet_for_query(spark, folder):
    rows = parts(spark, folder)
    listed = shown(spark, folder, rows, matched(spark, folder, rows))
    found = listed.join(entries(spark, folder, rows), ["game_id", "feature_id"])
    return found.select("query_id", "sort_order", "feature_id", F.md5("entry").alias("entry"))


@query("cheatsheet_block", SHEET_SQL + f""" SELECT s.query_id,
md5(CASE WHEN s.query_id IN (SELECT query_id FROM matched) THEN {b.quote(reports.MATCHING_SHEET)} ELSE {b.quote(reports.WHOLE_SHEET)} END
|| string_agg(e.entry, '' ORDER BY e.sort_order, e.feature_id)) AS block
FROM shown s JOIN game_questions q USING (query_id) JOIN entries e ON e.game_id = q.game_id AND e.feature_id = s.feature_id
GROUP BY s.query_id""")
def cheatsheet_block(spark, folder):
    rows = parts(spark, folder)
    found = stage(matched(spark, folder, rows), "matched")
    lines = reports.cheatsheet_lines(b.attached(spark, folder), b.cheatsheet(rows), b.citations(rows), b.features(spark))
    return reports.cheatsheet_digests(shown(spark, folder, rows, found), found, lines).withColumnRenamed("digest", "block")


GAME_REQUESTS_SQL = "game_requests AS (SELECT DISTINCT a.game_id, c.feature_id FROM attached a, catalogue c)"


def game_requests(spark, folder):
    return (
        feature_requests(spark, folder)
        .join(b.attached(spark, folder).select("pdf_id", "game_id"), "pdf_id")
        .select("game_id", "feature_id")
        .distinct()
    )


@query("lookup_cheatsheet", PARTS_SQL.rstrip() + ",\n" + ",\n".join([USABLE_SQL, ENTRY_SQL, GAME_REQUESTS_SQL]) + f""" SELECT r.game_id, r.feature_id,
coalesce({trim_sql("string_agg(e.entry, '' ORDER BY e.sort_order)")},
         'No cheatsheet entry for feature_id=' || r.feature_id || ' in this game''s indexed PDFs.') AS answer
FROM game_requests r LEFT JOIN entries e ON e.game_id = r.game_id AND e.feature_id = r.feature_id GROUP BY r.game_id, r.feature_id""")
def lookup_cheatsheet(spark, folder):
    rows = parts(spark, folder)
    return reports.lookup_cheatsheet(game_requests(spark, folder), entries(spark, folder, rows))


def named_lines(spark, folder, rows):
    return reports.glossary_lines(b.attached(spark, folder), b.glossary(rows), b.features(spark))


@query("lookup_glossary", MATCHED_SQL.rstrip() + ",\n" + ",\n".join([LINES_SQL, GAME_REQUESTS_SQL]) + f""" SELECT
'feature ' || r.game_id || ' ' || r.feature_id AS request,
coalesce({b.quote(reports.LOOKUP_GLOSSARY)} || string_agg(l.line, chr(10) ORDER BY l.line), {b.quote(reports.NO_GLOSSARY)}) AS answer
FROM game_requests r LEFT JOIN glossary_lines l ON l.game_id = r.game_id AND l.feature_id = r.feature_id GROUP BY r.game_id, r.feature_id
UNION ALL
SELECT 'term ' || q.query_id, CASE WHEN q.query_id NOT IN (SELECT query_id FROM matched) THEN 'No glossary mapping found for term "' || any_value(q.query_text) || '".'
ELSE coalesce({b.quote(reports.LOOKUP_GLOSSARY)} || string_agg(l.line, chr(10) ORDER BY l.line), {b.quote(reports.NO_GLOSSARY)}) END
FROM game_questions q LEFT JOIN matched m ON m.query_id = q.query_id
LEFT JOIN glossary_lines l ON l.game_id = q.game_id AND l.feature_id = m.feature_id GROUP BY q.query_id""")
def lookup_glossary(spark, folder):
    """By feature for every game, and by term with every question as the term."""
    rows = parts(spark, folder)
    lines = named_lines(spark, folder, rows)
    by_feature = reports.lookup_glossary_feature(game_requests(spark, folder), lines)
    asked = b.game_questions(spark, folder).withColumnRenamed("query_text", "term")
    found = stage(matched(spark, folder, rows), "matched")
    by_term = reports.lookup_glossary_term(asked, found, lines)
    return by_feature.select(F.concat_ws(" ", F.lit("feature"), "game_id", "feature_id").alias("request"), "answer").unionByName(
        by_term.select(F.concat_ws(" ", F.lit("term"), "query_id").alias("request"), "answer")
    )


@query("rewrite_glossary_block", MATCHED_SQL.rstrip() + ",\n" + LINES_SQL + f""", own_lines AS (
SELECT q.query_id, string_agg(l.line, chr(10) ORDER BY l.line) AS own FROM game_questions q JOIN matched m USING (query_id)
JOIN glossary_lines l ON l.game_id = q.game_id AND l.feature_id = m.feature_id GROUP BY q.query_id),
all_lines AS (SELECT game_id, string_agg(line, chr(10) ORDER BY line) AS whole FROM glossary_lines GROUP BY game_id)
SELECT q.query_id, coalesce({b.quote(reports.REWRITE_GLOSSARY)} || coalesce(o.own, w.whole), '') AS block
FROM game_questions q LEFT JOIN own_lines o USING (query_id) LEFT JOIN all_lines w USING (game_id)""")
def rewrite_glossary_block(spark, folder):
    rows = parts(spark, folder)
    return reports.rewrite_blocks(
        b.game_questions(spark, folder), matched(spark, folder, rows), named_lines(spark, folder, rows)
    )


@query("excerpt_block", HYBRID_SQL + f""" SELECT q.query_id, md5(coalesce({trim_sql('''string_agg(chr(10) || '[' || r.rank || '] ' || r.pdf_title || ' — '
|| r.section_title || ' (pages ' || r.start_page || '-' || r.end_page || ')' || chr(10) || r.snippet || chr(10), '' ORDER BY r.rank)''')},
{b.quote(reports.NO_EXCERPTS)})) AS block
FROM game_questions q LEFT JOIN (SELECT * FROM ranked WHERE rank <= {TOOL_RESULTS}) r USING (query_id) GROUP BY q.query_id""")
def excerpt_block(spark, folder):
    found = hybrid_hits(spark, folder, TOOL_RESULTS)
    blocks = reports.excerpt_blocks(b.game_questions(spark, folder).select("query_id"), found)
    return blocks.select("query_id", F.md5("block").alias("block"))


# ---- prompts, plans and replies ---------------------------------------------------------------------


@query("cheatsheet_context", PDF_SEARCH_SQL.rstrip() + f""" SELECT pdf_id, split_part(query_id, '/', 2) AS feature_id,
count(*) AS n_hits, md5(string_agg(rank || '|' || section_id || '|' || section_title || '|' || start_page || '-' || end_page || '|'
|| CASE WHEN len(w) > 800 THEN array_to_string(list_slice(w, 1, 800), ' ') || '...' ELSE t END, chr(10) ORDER BY rank)) AS excerpts
FROM (SELECT r.*, {fields_sql('s.plain_text')} AS w, {trim_sql('s.plain_text')} AS t FROM ranked r JOIN sections s USING (section_id) WHERE rank <= 5)
GROUP BY pdf_id, query_id""")
def cheatsheet_context(spark, folder):
    """The excerpts told for every book and feature, with their number."""
    line = lambda x: F.format_string(
        "%d|%s|%s|%d-%d|%s", x["rank"], x["section_id"].cast("string"), x["section_title"], x["start_page"], x["end_page"], x["text"]
    )
    facts = cheatsheet_facts(spark, folder)
    return facts.select(
        "pdf_id", "feature_id", F.size("excerpts").cast("bigint").alias("n_hits"),
        F.md5(F.array_join(F.transform("excerpts", line), "\n")).alias("excerpts"),
    )


def cheatsheet_facts(spark, folder):
    rows = parts(spark, folder)
    named = F.split("query_id", "/")
    found = pdf_hits(spark, folder).withColumn("feature_id", named[1])
    return learnings.cheatsheet_facts(
        found, b.sections(spark, folder), b.detected(rows), b.glossary(rows), b.features(spark)
    )


FACTS_SQL = PARTS_SQL.rstrip() + ",\n" + ",\n".join([COUNTS_SQL, FREQUENT_SQL, CANDIDATES_SQL]) + """, tables AS (
SELECT pdf_id, 'word' || chr(9) || 'count' || chr(10) || string_agg(word || chr(9) || n || chr(10), '' ORDER BY forced, n DESC, word) AS t FROM frequent GROUP BY ALL),
hinted AS (SELECT pdf_id, count(*) AS n_hints, list_sort(list(feature_id)) AS hints FROM (SELECT DISTINCT pdf_id, feature_id FROM feature_candidates) GROUP BY ALL),
sizes AS (SELECT pdf_id, count(*) AS n_unique FROM counts GROUP BY ALL),
own_features AS (SELECT pdf_id, count(DISTINCT feature_id) AS n_own FROM glossary GROUP BY ALL)"""


def term_facts(spark, folder, rows):
    return learnings.term_facts(
        b.sections(spark, folder), b.features(spark), synonym_rows(b.catalogue(spark)), b.glossary(rows)
    )


@query("learnings_prompts", FACTS_SQL + """ SELECT pdf_id, n_unique, md5(t) AS words, coalesce(n_hints, 0) AS n_hints, coalesce(n_own, 0) AS n_own,
(SELECT count(*) FROM catalogue WHERE feature_id <> '') AS n_catalogue
FROM tables JOIN sizes USING (pdf_id) LEFT JOIN hinted USING (pdf_id) LEFT JOIN own_features USING (pdf_id)""")
def learnings_prompts(spark, folder):
    """What both passes are told about every book."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return term_facts(spark, folder, parts(spark, folder)).select(
        "pdf_id", F.col("unique_tokens").cast("bigint").alias("n_unique"), F.md5("table").alias("words"),
        size("hints").alias("n_hints"), size("own").alias("n_own"), size("catalogue").alias("n_catalogue"),
    )


def stand_in(prompt: str) -> str:
    """Deterministic answers in place of a model, from prompts of the form book|features: some fail, some misspell."""
    import json

    book, _, hints = prompt.partition("|")
    number = int(book.removeprefix("src"))
    if number % 5 == 3:
        raise TimeoutError("no answer")
    if number % 5 == 4:
        return "I cannot answer about " + book
    ids = [i for i in hints.split(",") if i]
    text = json.dumps({"glossary": [{"feature_id": i, "terms": [f" {book} {i} ", ""]} for i in [*ids, "unknown"]], "features": [*ids, "unknown"]})
    return f"```json\n{text}\n```" if number % 5 == 1 else text


@query("learnings_chain", FACTS_SQL + """, told AS (
SELECT pdf_id, hints, CAST(substr(pdf_id, 4) AS INTEGER) % 5 < 3 AS fits FROM tables LEFT JOIN hinted USING (pdf_id)),
said AS (SELECT pdf_id, unnest(hints) AS feature_id FROM told WHERE fits)
SELECT pdf_id, 'term' AS kind, feature_id, pdf_id || ' ' || feature_id AS value FROM said
UNION ALL SELECT pdf_id, 'term', feature_id, term FROM glossary WHERE pdf_id NOT IN (SELECT pdf_id FROM told WHERE fits)
UNION ALL SELECT pdf_id, 'feature', feature_id, '' FROM said
UNION ALL SELECT pdf_id, 'feature', feature_id, '' FROM detected WHERE pdf_id NOT IN (SELECT pdf_id FROM told WHERE fits)""")
def learnings_chain(spark, folder):
    """Both passes over every book with the stand-in; failed books keep the given terms and features."""
    rows = parts(spark, folder)
    facts = stage(term_facts(spark, folder, rows), "facts")
    wording = F.concat_ws("|", "pdf_id", F.array_join(F.coalesce("hints", F.array().cast("array<string>")), ","))
    terms = learnings.learn_terms(facts, b.glossary(rows), b.features(spark), wording, stand_in)
    found = learnings.learn_features(facts, b.detected(rows), b.features(spark), wording, stand_in)
    return terms.select("pdf_id", F.lit("term").alias("kind"), "feature_id", F.col("term").alias("value")).unionByName(
        found.select("pdf_id", F.lit("feature").alias("kind"), "feature_id", F.lit("").alias("value"))
    )


def stand_in_sheet(prompt: str) -> str:
    """Deterministic cheatsheet replies to prompts in JSON: some fail, some say nothing, some cite by title only."""
    import json

    told = json.loads(prompt)
    number = int(told["pdf_id"].removeprefix("src")) % 5
    if number == 3:
        raise TimeoutError("no answer")
    if number == 4:
        return "I cannot answer about " + told["pdf_id"]
    cited = [{"section_title": told["title"], "start_page": "7"}, {"section_id": [told["id"]], "start_page": 3}]
    entry = {"feature_id": told["feature_id"], "definition": f" {told['pdf_id']} {told['feature_id']} ", "citations": cited}
    if number == 0:
        entry |= {"definition": {"text": ""}, "citations": cited[:1]}
    if number == 2:
        entry |= {"feature_id": None, "citations": []}
    text = json.dumps(entry)
    return f"```json\n{text}\n```" if number == 2 else text


@query("learnings_cheatsheet", PDF_SEARCH_SQL.rstrip() + """,
jobs AS (SELECT pdf_id, feature_id FROM detected EXCEPT SELECT pdf_id, feature_id FROM cheatsheet),
told_jobs AS (
SELECT pdf_id, split_part(query_id, '/', 2) AS feature_id, max(CASE WHEN rank = 1 THEN section_title END) AS title,
       coalesce(CAST(max(CASE WHEN rank = 2 THEN section_id END) AS VARCHAR), '') AS id
FROM ranked WHERE rank <= 5 GROUP BY ALL),
judged_jobs AS (
SELECT j.*, t.title, t.id, CASE WHEN t.pdf_id IS NULL THEN -1 ELSE CAST(substr(j.pdf_id, 4) AS INTEGER) % 5 END AS n,
       coalesce(trim(c.description), '') AS description
FROM jobs j LEFT JOIN told_jobs t USING (pdf_id, feature_id) JOIN catalogue c USING (feature_id)),
fresh AS (
SELECT *, CASE WHEN n IN (1, 2) THEN pdf_id || ' ' || feature_id ELSE description END AS definition,
       CASE WHEN n IN (1, 2) THEN 'model' ELSE 'catalogue' END AS origin
FROM judged_jobs WHERE n IN (1, 2) OR (n IN (-1, 0) AND description <> '')),
titled AS (
SELECT pdf_id, lower(trim(title)) AS k, arg_max(section_id, sort_order) AS section_id FROM sections GROUP BY ALL),
said AS (
SELECT f.pdf_id, f.feature_id, 0 AS pos, CAST(t.section_id AS VARCHAR) AS section_id, trim(f.title) AS section_title, 7 AS start_page
FROM fresh f JOIN titled t ON t.pdf_id = f.pdf_id AND t.k = lower(trim(f.title)) WHERE n IN (0, 1)
UNION ALL SELECT pdf_id, feature_id, 1, coalesce(nullif(id, ''), NULL), '', 3 FROM fresh WHERE n = 1)
SELECT 'entry' AS kind, pdf_id, feature_id, -1 AS pos, origin || ':' || definition AS value FROM fresh
UNION ALL SELECT 'entry', pdf_id, feature_id, -1, 'stored:' || definition FROM cheatsheet
UNION ALL SELECT 'citation', pdf_id, feature_id, pos, coalesce(section_id, '') || '|' || md5(section_title) || '|' || start_page FROM said
UNION ALL SELECT 'citation', pdf_id, feature_id, pos, section_id || '|' || md5(section_title) || '|' || start_page FROM citations
UNION ALL SELECT 'left', pdf_id, feature_id, -1, '' FROM judged_jobs WHERE (pdf_id, feature_id) NOT IN (SELECT (pdf_id, feature_id) FROM fresh)""")
def learnings_cheatsheet(spark, folder):
    """The third pass over every feature that lacks an entry, with the stand-in."""
    rows = parts(spark, folder)
    first, second = F.get("excerpts", F.lit(0)), F.get("excerpts", F.lit(1))
    wording = F.to_json(F.struct(
        "pdf_id", "feature_id", first["section_title"].alias("title"),
        F.coalesce(second["section_id"].cast("string"), F.lit("")).alias("id"),
    ))
    made = learnings.learn_cheatsheet(
        pending_features(b.detected(rows), b.cheatsheet(rows)), cheatsheet_facts(spark, folder), b.cheatsheet(rows), b.citations(rows),
        b.features(spark), b.sections(spark, folder), wording, stand_in_sheet, new_folder(spark, "manifest"),
    )
    cell = F.concat_ws("|", F.coalesce("section_id", F.lit("")), F.md5("section_title"), F.col("start_page").cast("string"))
    both = ["pdf_id", "feature_id"]
    entry = F.concat_ws(":", "origin", "definition")
    return (
        made.entries.select(F.lit("entry").alias("kind"), *both, F.lit(-1).alias("pos"), entry.alias("value"))
        .unionByName(made.citations.select(F.lit("citation").alias("kind"), *both, "pos", cell.alias("value")))
        .unionByName(made.left.select(F.lit("left").alias("kind"), *both, F.lit(-1).alias("pos"), F.lit("").alias("value")))
    )


PLAN_REQUESTS_SQL = """plan_requests AS (
SELECT pdf_id, m.mode, CAST(NULL AS VARCHAR) AS feature_id FROM (SELECT DISTINCT pdf_id FROM attached), (VALUES ('glossary'), ('features'), ('cheatsheet'), ('missing')) m(mode)
UNION ALL SELECT pdf_id, 'feature', feature_id FROM requests),
ready AS (SELECT * FROM plan_requests WHERE pdf_id <> 'src3'),
found AS (SELECT DISTINCT pdf_id, feature_id FROM detected),
done AS (SELECT DISTINCT pdf_id, feature_id FROM cheatsheet)"""


@query("rebuild_plan", PARTS_SQL.rstrip() + ",\n" + PLAN_REQUESTS_SQL + """ SELECT pdf_id, mode, mode AS step, feature_id FROM ready WHERE mode IN ('glossary', 'features')
UNION ALL SELECT r.pdf_id, mode, 'cheatsheet', f.feature_id FROM ready r JOIN found f USING (pdf_id) WHERE mode = 'cheatsheet'
UNION ALL SELECT r.pdf_id, mode, 'cheatsheet', f.feature_id FROM ready r JOIN found f USING (pdf_id)
WHERE mode = 'missing' AND (f.pdf_id, f.feature_id) NOT IN (SELECT (pdf_id, feature_id) FROM done)
UNION ALL SELECT pdf_id, mode, 'complete', NULL FROM ready WHERE mode = 'missing' AND pdf_id IN (SELECT pdf_id FROM found)
AND pdf_id NOT IN (SELECT pdf_id FROM found WHERE (pdf_id, feature_id) NOT IN (SELECT (pdf_id, feature_id) FROM done))
UNION ALL SELECT pdf_id, mode, CASE WHEN (pdf_id, feature_id) IN (SELECT (pdf_id, feature_id) FROM found UNION SELECT (pdf_id, feature_id) FROM done)
THEN 'cheatsheet' ELSE 'refused' END, feature_id FROM ready WHERE mode = 'feature'
UNION ALL SELECT pdf_id, mode, 'refused', NULL FROM ready WHERE mode IN ('cheatsheet', 'missing') AND pdf_id NOT IN (SELECT pdf_id FROM found)
UNION ALL SELECT pdf_id, mode, 'refused', feature_id FROM plan_requests WHERE pdf_id = 'src3'""")
def rebuild_plan(spark, folder):
    """Every mode asked of every book; one book is not indexed yet."""
    rows = parts(spark, folder)
    names = b.attached(spark, folder).select("pdf_id")
    modes = F.explode(F.array(*[F.lit(m) for m in ("glossary", "features", "cheatsheet", "missing")]))
    general = names.select("pdf_id", modes.alias("mode"), F.lit(None).cast("string").alias("feature_id"))
    single = feature_requests(spark, folder).select("pdf_id", F.lit("feature").alias("mode"), "feature_id")
    state = names.select("pdf_id", (F.col("pdf_id") != "src3").alias("indexed"), F.lit(True).alias("has_text"))
    return learnings.rebuild_plan(general.unionByName(single), state, b.detected(rows), b.cheatsheet(rows))


# Replies in the ways models misspell them, one per part and size.
REPLY_KINDS = 8
TYPED_KINDS = 5


def messy_replies(spark, folder):
    kind, name, size = F.col("p_size") % REPLY_KINDS, F.col("p_name"), F.col("p_size").cast("string")
    clean = F.concat(F.lit('{"features":["'), name, F.lit('","s'), size, F.lit('"]}'))
    body = F.concat(F.lit('"'), name, F.lit('", "s'), size, F.lit('"'))
    forms = [
        clean,
        F.concat(F.lit("```json\n"), clean, F.lit("\n```")),
        F.concat(F.lit("Sure, here it is: "), clean, F.lit(" Anything else? {}")),
        F.concat(F.lit('{"features:_: ['), body, F.lit(",], // done\n}")),
        F.concat(F.lit("["), body, F.lit("]")),
        F.concat(F.lit('{"features": [/* two */ '), body, F.lit(',\n]}')),
        F.concat(F.lit('{"features": ["'), name, F.lit('", "s'), size, F.lit('"], "note": "a\nb\t// c"}')),
        F.concat(F.lit("I cannot answer about "), name),
    ]
    raw = forms[-1]
    for i, form in enumerate(forms[:-1]):
        raw = F.when(kind == i, form).otherwise(raw)
    return read_table(spark, folder, "part").select("p_partkey", F.lit("features").alias("pass"), raw.alias("raw"))


def typed_replies(spark, folder):
    """Replies of the other two passes; some are JSON of a type the pass does not take."""
    kind, name, size = F.col("p_size") % TYPED_KINDS, F.col("p_name"), F.col("p_size").cast("string")
    entry = F.concat(F.lit('{"feature_id":"'), name, F.lit('","terms":["s'), size, F.lit('"]}'))
    cited = F.concat(F.lit('[{"section_title":"'), name, F.lit('","start_page":"'), size, F.lit('"}]'))
    forms = {
        "glossary": [
            F.concat(F.lit('{"glossary":['), entry, F.lit(",{\"feature_id\":null}]}")),
            F.concat(F.lit('```json\n{"glossary": ['), entry, F.lit(",]}\n```")),
            F.concat(F.lit('{"glossary":"'), name, F.lit('"}')),
            F.concat(F.lit('{"glossary":[{"feature_id":['), size, F.lit("]}]}")),
            F.concat(F.lit('{"glossary":[{"feature_id":"a","terms":['), size, F.lit("]}]}")),
        ],
        "cheatsheet": [
            F.concat(F.lit('{"feature_id":"'), name, F.lit('","definition":{"text":"s'), size, F.lit('"},"citations":'), cited, F.lit("}")),
            F.concat(F.lit('Here: {"feature_id":"'), name, F.lit('","definition":"s'), size, F.lit('"}')),
            F.concat(F.lit('{"feature_id":['), size, F.lit("]}")),
            F.concat(F.lit('{"feature_id":"a","citations":"'), name, F.lit('"}')),
            F.concat(F.lit('{"feature_id":"a","citations":[{"section_title":'), size, F.lit("}]}")),
        ],
    }
    parts, both = read_table(spark, folder, "part"), None
    for pass_name, given in forms.items():
        raw = given[-1]
        for i, form in enumerate(given[:-1]):
            raw = F.when(kind == i, form).otherwise(raw)
        rows = parts.select("p_partkey", F.lit(pass_name).alias("pass"), raw.alias("raw"))
        both = rows if both is None else both.unionByName(rows)
    return both


@query("parse_typed_responses", f"""WITH k AS (SELECT p_partkey, p_name, 's' || p_size AS term, p_size % {TYPED_KINDS} AS kind FROM part)
SELECT p_partkey, pass, CASE WHEN kind < 2 THEN p_name || ' ' || term END AS entry, CASE WHEN kind >= 2 THEN 'no fitting JSON' END AS reason
FROM k, (VALUES ('glossary'), ('cheatsheet')) p(pass)""")
def parse_typed_responses(spark, folder):
    read = replies.parse_replies(typed_replies(spark, folder))

    def at(*paths):
        return F.coalesce(*[F.get_json_object("parsed", p) for p in paths])

    name = at("$.glossary[0].feature_id", "$.feature_id")
    text = at("$.glossary[0].terms[0]", "$.definition.text", "$.definition")
    entry = F.when(F.col("reason").isNull(), F.concat(name, F.lit(" "), text))
    return read.select("p_partkey", "pass", entry.alias("entry"), "reason")


@query("parse_responses", f"""SELECT p_partkey, CASE WHEN p_size % {REPLY_KINDS} < {REPLY_KINDS - 1} THEN p_name || ',s' || p_size END AS features,
CASE WHEN p_size % {REPLY_KINDS} = {REPLY_KINDS - 1} THEN 'no fitting JSON' END AS reason FROM part""")
def parse_responses(spark, folder):
    read = replies.parse_replies(messy_replies(spark, folder))
    ids = F.from_json(F.get_json_object("parsed", "$.features"), "array<string>")
    return read.select("p_partkey", F.array_join(ids, ",").alias("features"), "reason")


LOOSE_KINDS = 5


def loose_entries(spark, folder):
    kind, name, size = F.col("p_size") % LOOSE_KINDS, F.col("p_name"), F.col("p_size").cast("string")

    def entry(definition, *cells):
        return F.concat(
            F.lit('{"feature_id":"'), F.col("p_brand"), F.lit('","definition":'), definition, F.lit(',"citations":['), *cells, F.lit("]}")
        )

    text = F.concat(F.lit('" '), name, F.lit(' "'))
    forms = [
        entry(text, F.lit('{"section_id":"a","section_title":"T","start_page":'), size, F.lit(',"end_page":1}')),
        entry(F.concat(F.lit('{"definition":"","text":'), text, F.lit("}")),
              F.lit('{"section_id":["b"," c ",""],"section_title":" U ","start_page":"'), size, F.lit('","end_page":"x"}')),
        entry(F.lit("null"), F.lit('{"section_title":"V","start_page":'), size, F.lit(".7},{\"section_title\":\" \",\"start_page\":-2}")),
        entry(F.lit("12"), F.lit('{"section_id":7,"start_page":'), size, F.lit(',"end_page":'), size, F.lit("00}")),
        entry(text),
    ]
    raw = forms[-1]
    for i, form in enumerate(forms[:-1]):
        raw = F.when(kind == i, form).otherwise(raw)
    return read_table(spark, folder, "part").select("p_partkey", raw.alias("raw"))


@query("flex_citations", f"""WITH k AS (SELECT p_partkey, p_brand AS feature_id, p_name, p_size, p_size % {LOOSE_KINDS} AS kind FROM part)
SELECT p_partkey, feature_id, p_name AS definition, CAST(0 AS INTEGER) AS pos, 'a' AS section_id, 'T' AS section_title, p_size AS start_page,
       greatest(p_size, 1) AS end_page FROM k WHERE kind = 0
UNION ALL SELECT p_partkey, feature_id, p_name, 0, x.i, 'U', p_size, 0 FROM k, (VALUES ('b'), ('c')) x(i) WHERE kind = 1
UNION ALL SELECT p_partkey, feature_id, '', 0, NULL, 'V', p_size, 0 FROM k WHERE kind = 2
UNION ALL SELECT p_partkey, feature_id, '', 0, NULL, '', p_size, p_size * 100 FROM k WHERE kind = 3
UNION ALL SELECT p_partkey, feature_id, p_name, NULL, NULL, '', 0, 0 FROM k WHERE kind = 4""")
def flex_citations(spark, folder):
    return replies.reply_citations(loose_entries(spark, folder), "p_partkey", "raw")


