"""Per-book metadata: stored JSON, its parts and the jobs that keep it complete."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import hits, meta
from passages.queries import bindings as b
from passages.queries.bindings import ATTACHED_SQL, CITED_SQL, SECTIONS_SQL, SYNONYMS_SQL, with_sql
from passages.queries.registry import query
from passages.queries.search import REQUESTS_SQL, feature_requests
from passages.sources.saved import SavedTable
from passages.sources.tables import new_folder, read_table, spread, stage

# One stored JSON text per part: half in the present form, half in the earlier one, a few broken.
NEW_JSON_SQL = """'{"features":["' || p_type || '"," ' || p_brand || ' ","","' || p_type || '"],"glossary":[{"feature_id":" ' || p_type
|| ' ","terms":["' || p_name || '","' || upper(p_name) || '"," "]},{"feature_id":"' || p_brand || '","terms":[" "]}],"cheatsheet":[{"feature_id":"'
|| p_type || '","definition":" ' || p_name || ' ","citations":[{"section_id":" s' || p_partkey || '","section_title":"' || p_name
|| '","start_page":' || p_size || '},{"section_title":" ","start_page":0},{"section_title":"","start_page":3,"end_page":4}]}]}'"""
OLD_JSON_SQL = """'{"features":[{"feature_id":"' || p_type || '","terms":[]},{"feature_id":" "}],"glossary":[{"feature_id":"' || p_type
|| '","pdf_term":"' || p_name || '"},{"feature_id":"' || p_brand || '","pdf_term":" ' || p_name || ' "},{"feature_id":"' || p_type
|| '","pdf_term":"a ' || p_size || '"},{"feature_id":"x","pdf_term":" "}],"cheatsheet":[{"feature_id":"' || p_brand
|| '","feature_name":" ' || p_name || '","section":"' || p_type || '","start_page":' || p_size || '},{"feature_id":"' || p_type
|| '","feature_name":"","section":""}],"llm_glossary_skipped":true}'"""
BROKEN_SIZE = 13


def _parts(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def stored_metas(spark, folder):
    kind, brand, name = F.col("p_type"), F.col("p_brand"), F.col("p_name")
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    new = _parts(
        '{"features":["', kind, '"," ', brand, ' ","","', kind, '"],"glossary":[{"feature_id":" ', kind,
        ' ","terms":["', name, '","', F.upper(name), '"," "]},{"feature_id":"', brand,
        '","terms":[" "]}],"cheatsheet":[{"feature_id":"', kind, '","definition":" ', name,
        ' ","citations":[{"section_id":" s', key, '","section_title":"', name, '","start_page":', size,
        '},{"section_title":" ","start_page":0},{"section_title":"","start_page":3,"end_page":4}]}]}',
    )
    old = _parts(
        '{"features":[{"feature_id":"', kind, '","terms":[]},{"feature_id":" "}],"glossary":[{"feature_id":"', kind,
        '","pdf_term":"', name, '"},{"feature_id":"', brand, '","pdf_term":" ', name, ' "},{"feature_id":"', kind,
        '","pdf_term":"a ', size, '"},{"feature_id":"x","pdf_term":" "}],"cheatsheet":[{"feature_id":"', brand,
        '","feature_name":" ', name, '","section":"', kind, '","start_page":', size, '},{"feature_id":"', kind,
        '","feature_name":"","section":""}],"llm_glossary_skipped":true}',
    )
    raw = (
        F.when(F.col("p_size") == BROKEN_SIZE, F.concat(F.lit("not json "), name))
        .when(F.col("p_size") > 25, old)
        .otherwise(new)
    )
    parts = spread(read_table(spark, folder, "part"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("pdf_id"), raw.alias("raw"))


def parsed_metas(spark, folder):
    return stored_metas(spark, folder).select("pdf_id", meta.parse_meta(F.col("raw")).alias("meta"))


STORED_SQL = f"""stored AS (
SELECT p_partkey AS pdf_id, p_type, p_brand, p_name, p_size,
CASE WHEN p_size = {BROKEN_SIZE} THEN 'not json ' || p_name WHEN p_size > 25 THEN {OLD_JSON_SQL} ELSE {NEW_JSON_SQL} END AS raw FROM part),
good AS (SELECT pdf_id, p_size > 25 AS old, CAST(raw AS JSON) AS j FROM stored WHERE p_size <> {BROKEN_SIZE})"""

# Parts of the metadata as rows, read off the JSON.
META_ROWS_SQL = """feature_rows AS (
SELECT DISTINCT pdf_id, trim(CASE WHEN old THEN f ->> '$.feature_id' ELSE f ->> '$' END) AS feature_id
FROM (SELECT pdf_id, old, unnest(CAST(j -> '$.features' AS JSON[])) AS f FROM good)
WHERE trim(CASE WHEN old THEN f ->> '$.feature_id' ELSE f ->> '$' END) <> ''),
raw_terms AS (
SELECT pdf_id, trim(g ->> '$.feature_id') AS feature_id, trim(t ->> '$') AS term, i FROM (
SELECT pdf_id, g, unnest(CAST(g -> '$.terms' AS JSON[])) AS t, generate_subscripts(CAST(g -> '$.terms' AS JSON[]), 1) AS i
FROM (SELECT pdf_id, unnest(CAST(j -> '$.glossary' AS JSON[])) AS g FROM good WHERE NOT old))
UNION ALL
SELECT DISTINCT pdf_id, trim(g ->> '$.feature_id'), trim(g ->> '$.pdf_term'), 0
FROM (SELECT pdf_id, unnest(CAST(j -> '$.glossary' AS JSON[])) AS g FROM good WHERE old)),
glossary_rows AS (
SELECT pdf_id, feature_id, arg_min(term, i) AS term FROM raw_terms WHERE feature_id <> '' AND term <> ''
GROUP BY pdf_id, feature_id, lower(term)),
raw_sheet AS (
SELECT pdf_id, old, c, unnest(CASE WHEN old THEN CASE WHEN c ->> '$.section' <> '' THEN ['{}'::JSON] ELSE [NULL::JSON] END
       ELSE CAST(c -> '$.citations' AS JSON[]) END) AS z
FROM (SELECT pdf_id, old, unnest(CAST(j -> '$.cheatsheet' AS JSON[])) AS c FROM good)),
sheet_rows AS (
SELECT DISTINCT pdf_id, trim(c ->> '$.feature_id') AS feature_id,
       trim(coalesce(CASE WHEN old THEN c ->> '$.feature_name' ELSE c ->> '$.definition' END, '')) AS definition FROM raw_sheet),
citation_rows AS (
SELECT pdf_id, trim(c ->> '$.feature_id') AS feature_id, trim(coalesce(z ->> '$.section_id', '')) AS section_id,
       trim(CASE WHEN old THEN c ->> '$.section' ELSE coalesce(z ->> '$.section_title', '') END) AS section_title,
       CAST(coalesce(CASE WHEN old THEN c -> '$.start_page' ELSE z -> '$.start_page' END, '0') AS INTEGER) AS start_page,
       CAST(coalesce(z -> '$.end_page', '0') AS INTEGER) AS end_page
FROM raw_sheet WHERE z IS NOT NULL),
kept_citations AS (SELECT * FROM citation_rows WHERE section_title <> '' OR start_page > 0)"""

FLAT_SQL = """SELECT pdf_id, 'feature' AS part, feature_id, '' AS value, CAST(0 AS INTEGER) AS page FROM feature_rows
UNION ALL SELECT pdf_id, 'term', feature_id, term, 0 FROM glossary_rows
UNION ALL SELECT pdf_id, 'entry', feature_id, definition, 0 FROM sheet_rows
UNION ALL SELECT pdf_id, 'citation', feature_id, section_id || '|' || section_title || '|' || end_page, start_page FROM kept_citations"""


def flat_meta(metas):
    cited = F.concat_ws("|", "cited.section_id", "cited.section_title", F.col("cited.end_page").cast("string"))
    value = F.when(F.col("part") == "citation", cited).otherwise(F.col("text"))
    page = F.coalesce("cited.start_page", F.lit(0))
    return meta.part_rows(metas).select("pdf_id", "part", "feature_id", value.alias("value"), page.alias("page"))


@query("normalize_meta", with_sql(STORED_SQL, META_ROWS_SQL) + FLAT_SQL)
def normalize_meta(spark, folder):
    return flat_meta(parsed_metas(spark, folder))


@query("legacy_meta", with_sql(STORED_SQL, META_ROWS_SQL) + """SELECT pdf_id, feature_id, string_agg(term, ',' ORDER BY term) AS terms
FROM glossary_rows WHERE pdf_id IN (SELECT pdf_id FROM good WHERE old) GROUP BY ALL""")
def legacy_meta(spark, folder):
    old = parsed_metas(spark, folder).where("meta.llm_learnings_skipped")
    entries = old.select("pdf_id", F.inline("meta.glossary"))
    return entries.select("pdf_id", "feature_id", F.array_join("terms", ",").alias("terms"))


@query("meta_explode", with_sql(STORED_SQL, META_ROWS_SQL) + """SELECT s.pdf_id,
(SELECT count(*) FROM feature_rows f WHERE f.pdf_id = s.pdf_id) AS n_features,
(SELECT count(*) FROM glossary_rows g WHERE g.pdf_id = s.pdf_id) AS n_terms,
(SELECT count(*) FROM kept_citations c WHERE c.pdf_id = s.pdf_id) AS n_citations,
s.p_size > 25 AS skipped FROM stored s""")
def meta_explode(spark, folder):
    sizes = F.aggregate(
        F.transform("meta.glossary", lambda g: F.size(g["terms"])), F.lit(0), lambda acc, n: acc + n
    )
    cited = F.aggregate(
        F.transform("meta.cheatsheet", lambda e: F.size(e["citations"])), F.lit(0), lambda acc, n: acc + n
    )
    return parsed_metas(spark, folder).select(
        "pdf_id",
        F.size("meta.features").cast("bigint").alias("n_features"),
        sizes.cast("bigint").alias("n_terms"),
        cited.cast("bigint").alias("n_citations"),
        F.col("meta.llm_learnings_skipped").alias("skipped"),
    )


@query("meta_roundtrip", with_sql(STORED_SQL, META_ROWS_SQL) + FLAT_SQL)
def meta_roundtrip(spark, folder):
    """Written as JSON and read again: nothing changes."""
    written = parsed_metas(spark, folder).select("pdf_id", meta.meta_json(F.col("meta")).alias("raw"))
    return flat_meta(written.select("pdf_id", meta.parse_meta(F.col("raw")).alias("meta")))


@query("meta_saved", with_sql(STORED_SQL, META_ROWS_SQL) + FLAT_SQL)
def meta_saved(spark, folder):
    """Written as JSON over an empty one for each book, half of the books at a time, and read again."""
    written = parsed_metas(spark, folder).select("pdf_id", meta.meta_json(F.col("meta")).alias("raw"))
    written = stage(written, "metas")
    saved = SavedTable(new_folder(spark, "saved-metas"), "pdf_id")
    saved.create(written.withColumn("raw", F.lit("{}")))
    half = F.pmod(F.xxhash64("pdf_id"), F.lit(2))
    for i in range(2):
        saved.save(written.where(half == i))
    kept = saved.read(spark, f"pdf_id {written.schema['pdf_id'].dataType.simpleString()}, raw string")
    return flat_meta(kept.select("pdf_id", meta.parse_meta(F.col("raw")).alias("meta")))


# ---- flat parts over the cited sections of the books ----------------------------------------------

PARTS_SQL = with_sql(SECTIONS_SQL, ATTACHED_SQL, CITED_SQL, SYNONYMS_SQL, REQUESTS_SQL)


@query("pending_features", PARTS_SQL + """SELECT pdf_id, feature_id FROM detected
WHERE (pdf_id, feature_id) NOT IN (SELECT (pdf_id, feature_id) FROM cheatsheet)""")
def pending_features(spark, folder):
    rows = b.cited_sections(spark, folder)
    return meta.pending_features(b.detected(rows), b.cheatsheet(rows))


@query("cheatsheet_incomplete", PARTS_SQL + """SELECT a.pdf_id, coalesce(p.pending, false) AS incomplete FROM attached a
LEFT JOIN (SELECT DISTINCT pdf_id, true AS pending FROM detected
WHERE (pdf_id, feature_id) NOT IN (SELECT (pdf_id, feature_id) FROM cheatsheet)) p USING (pdf_id)""")
def cheatsheet_incomplete(spark, folder):
    rows = b.cited_sections(spark, folder)
    return meta.incomplete_books(b.detected(rows), b.cheatsheet(rows), b.attached(spark, folder))


@query("rebuild_allowed", PARTS_SQL + """SELECT r.pdf_id, r.feature_id,
(r.pdf_id, r.feature_id) IN (SELECT (pdf_id, feature_id) FROM detected UNION SELECT (pdf_id, feature_id) FROM cheatsheet) AS allowed
FROM requests r""")
def rebuild_allowed(spark, folder):
    rows = b.cited_sections(spark, folder)
    allowed = meta.rebuildable_features(b.detected(rows), b.cheatsheet(rows)).withColumn("allowed", F.lit(True))
    return (
        feature_requests(spark, folder)
        .join(allowed, ["pdf_id", "feature_id"], "left")
        .withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    )


@query("cheatsheet_fallback", PARTS_SQL + """SELECT r.pdf_id, r.feature_id,
coalesce(nullif(trim(s.definition), ''), c.description) AS definition, nullif(trim(s.definition), '') IS NULL AS from_catalogue
FROM requests r LEFT JOIN cheatsheet s USING (pdf_id, feature_id) LEFT JOIN catalogue c ON c.feature_id = r.feature_id
WHERE coalesce(nullif(trim(s.definition), ''), c.description) <> ''""")
def cheatsheet_fallback(spark, folder):
    rows = b.cited_sections(spark, folder)
    return meta.fallback_entries(feature_requests(spark, folder), b.cheatsheet(rows), b.features(spark))


@query("feature_index", PARTS_SQL + """SELECT DISTINCT a.game_id, d.feature_id,
'- ' || d.feature_id || ' (' || coalesce(nullif(c.name, ''), d.feature_id) || ')'
|| CASE WHEN c.description <> '' THEN ': ' || c.description ELSE '' END AS line
FROM detected d JOIN attached a USING (pdf_id) JOIN catalogue c ON c.feature_id = d.feature_id""")
def feature_index(spark, folder):
    rows = b.cited_sections(spark, folder)
    return meta.features_of_games(b.detected(rows), b.attached(spark, folder), b.features(spark))


@query("cheatsheet_upsert", """SELECT o_custkey AS pdf_id, o_orderpriority AS feature_id, max(o_orderkey) AS seq,
arg_max(o_orderstatus, o_orderkey) AS definition FROM orders GROUP BY ALL""")
def cheatsheet_upsert(spark, folder):
    rows = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("pdf_id"), F.col("o_orderpriority").alias("feature_id"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("definition"),
    )
    return meta.upsert_entries(rows.where("definition = 'F'"), rows.where("definition <> 'F'"))


@query("merge_glossary", """SELECT pdf_id, feature_id, string_agg(term, ',' ORDER BY term) AS terms FROM (
SELECT DISTINCT l_suppkey AS pdf_id, l_returnflag AS feature_id, trim(term) AS term FROM (
SELECT l_suppkey, l_returnflag, CASE WHEN l_linestatus = 'O' THEN ' ' || l_linenumber ELSE '' || l_linenumber END AS term FROM lineitem
UNION ALL SELECT l_suppkey, l_returnflag, 'tax ' || l_tax FROM lineitem)) GROUP BY ALL""")
def merge_glossary(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    number = F.col("l_linenumber").cast("string")
    keys = [F.col("l_suppkey").alias("pdf_id"), F.col("l_returnflag").alias("feature_id")]
    spaced = F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" "), number)).otherwise(number)
    stored = lines.select(*keys, spaced.alias("term"))
    updated = lines.select(*keys, F.concat(F.lit("tax "), F.col("l_tax").cast("string")).alias("term"))
    merged = meta.merge_glossaries(stored, updated)
    return merged.groupBy("pdf_id", "feature_id").agg(
        F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms")
    )


# Replies name languages as features, padded, and some that the catalogue lacks.
@query("validate_features", with_sql(SYNONYMS_SQL) + """SELECT DISTINCT source AS pdf_id, lang AS feature_id FROM documents
WHERE lang IN (SELECT feature_id FROM catalogue)""")
def validate_features(spark, folder):
    docs = read_table(spark, folder, "documents").select(F.col("source").alias("pdf_id"), "lang")
    padded = docs.select("pdf_id", F.concat(F.lit(" "), "lang", F.lit(" ")).alias("feature_id"))
    unknown = docs.select("pdf_id", F.upper("lang").alias("feature_id"))
    return meta.known_features(padded.unionByName(unknown), b.features(spark))


@query("validate_glossary", with_sql(SYNONYMS_SQL) + """SELECT source AS pdf_id, lang AS feature_id, doc_id AS pos,
regexp_extract(text, '\\p{L}+') AS term FROM documents WHERE lang IN (SELECT feature_id FROM catalogue) AND regexp_extract(text, '\\p{L}+') <> ''""")
def validate_glossary(spark, folder):
    docs = read_table(spark, folder, "documents")
    word = F.concat(F.regexp_extract("text", r"\p{L}+", 0), F.lit("  "))
    named = docs.select(
        F.col("source").alias("pdf_id"), F.concat(F.col("lang"), F.lit(" ")).alias("feature_id"),
        F.col("doc_id").alias("pos"), word.alias("term"),
    )
    blank = named.withColumn("term", F.lit("  "))
    return meta.known_glossary(named.unionByName(blank), b.features(spark))


# Citations without ids for the last part of each name; titles repeat within a brand.
@query("attach_section_ids", """WITH known AS (
SELECT p_brand AS pdf_id, lower(p_name) AS k, arg_max(p_partkey, p_partkey) AS found FROM part GROUP BY ALL)
SELECT p.p_partkey AS pos, p.p_brand AS pdf_id, CASE WHEN p.p_size > 40 THEN p.p_partkey ELSE k.found END AS section_id
FROM part p LEFT JOIN known k ON k.pdf_id = p.p_brand AND k.k = lower(CASE WHEN p.p_size = 1 THEN 'none' ELSE p.p_name END)""")
def attach_section_ids(spark, folder):
    parts = read_table(spark, folder, "part")
    known = parts.select(
        F.col("p_brand").alias("pdf_id"), F.col("p_name").alias("title"),
        F.col("p_partkey").alias("section_id"), F.col("p_partkey").alias("sort_order"),
    )
    title = F.when(F.col("p_size") == 1, F.lit("none")).otherwise(F.concat(F.lit(" "), F.upper("p_name")))
    cited = parts.select(
        F.col("p_partkey").alias("pos"), F.col("p_brand").alias("pdf_id"), title.alias("section_title"),
        F.when(F.col("p_size") > 40, F.col("p_partkey")).alias("section_id"),
    )
    return hits.attach_section_ids(cited, known).select("pos", "pdf_id", "section_id")
