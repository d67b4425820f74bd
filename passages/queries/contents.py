"""Contents pages, bookmarks, section assembly and section scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import status
from passages.functions.text import fields, is_blank
from passages.operators import assembly, contents, vocabulary
from passages.plans import imports
from passages.queries import bindings as b
from passages.queries.bindings import (
    PAGES_SQL, SECTIONS_SQL, collapse_sql, embed_words_sql, fields_sql, fnv_sql, terms_sql, trim_sql, with_sql,
)
from passages.queries.registry import ORACLES, query
from passages.queries.texts import normalize_sql
from passages.sources.saved import SavedTable
from passages.sources.tables import new_folder, read_table, spread, stage

PAGE_COUNT = 50

# Contents lines made of parts: dot leaders, tabs with a backspace slip, or a leading page number.
LINES_SQL = """lines AS (
SELECT p_brand AS pdf_id, p_partkey AS pos,
CASE p_type WHEN 'SMALL' THEN p_size || ' ' || p_name || '''s 7'
            WHEN 'ECONOMY' THEN p_name || 'x' || chr(8) || chr(9) || chr(9) || p_size
            WHEN 'LARGE' THEN '  ' || p_size || '  '
            ELSE p_name || ' ..... ' || p_size END AS line
FROM part)"""


def contents_lines(spark, folder):
    size = F.col("p_size").cast("string")
    line = (
        F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit(" "), "p_name", F.lit("'s 7")))
        .when(F.col("p_type") == "ECONOMY", F.concat("p_name", F.lit("x\b\t\t"), size))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("  "), size, F.lit("  ")))
        .otherwise(F.concat("p_name", F.lit(" ..... "), size))
    )
    parts = spread(read_table(spark, folder, "part"), "p_partkey")
    return parts.select(F.col("p_brand").alias("pdf_id"), F.col("p_partkey").alias("pos"), line.alias("line"))


def contents_books(spark, folder):
    brands = read_table(spark, folder, "part").select(F.col("p_brand").alias("pdf_id")).distinct()
    return brands.withColumn("page_count", F.lit(PAGE_COUNT))


# A backspace takes the character before it along; the lines above hold one at most.
_CLEAN = collapse_sql(
    "regexp_replace(regexp_replace(line, '.' || chr(8), '', 'g'), '[^\\p{L}\\p{Nd}\\t-\\r ]+', '', 'g')"
)
PARSE_SQL = f"""cleaned AS (SELECT pdf_id, pos, {_CLEAN} AS c FROM lines),
split_lines AS (
SELECT pdf_id, pos, {trim_sql("regexp_extract(c, '^([0-9]{1,4}) +(.+)$', 2)")} AS t1,
       TRY_CAST(regexp_extract(c, '^([0-9]{{1,4}}) +(.+)$', 1) AS INTEGER) AS p1,
       {trim_sql("regexp_extract(c, '^(.+?)([0-9]{1,4})$', 1)")} AS t2,
       TRY_CAST(regexp_extract(c, '^(.+?)([0-9]{{1,4}})$', 2) AS INTEGER) AS p2
FROM cleaned),
usable AS (
SELECT pdf_id, pos, CASE WHEN p1 >= 1 AND t1 <> '' AND NOT regexp_full_match(t1, '[0-9 ]+') THEN t1
            WHEN p2 >= 1 AND t2 <> '' AND NOT regexp_full_match(t2, '[0-9 ]+') THEN t2 END AS title,
       CASE WHEN p1 >= 1 AND t1 <> '' AND NOT regexp_full_match(t1, '[0-9 ]+') THEN p1
            WHEN p2 >= 1 AND t2 <> '' AND NOT regexp_full_match(t2, '[0-9 ]+') THEN p2 END AS start_page
FROM split_lines),
entries AS (
SELECT * FROM usable WHERE title IS NOT NULL AND strlen(title) >= 2
AND lower(title) NOT IN ('contents', 'table of contents', 'tableofcontents', 'index'))"""

DEDUPE_SQL = """unique_entries AS (
SELECT pdf_id, pos, title, start_page FROM (
SELECT *, row_number() OVER (PARTITION BY pdf_id, start_page, lower(title) ORDER BY pos) AS nth FROM entries)
WHERE nth = 1)"""

RANGES_SQL = """ranges AS (
SELECT pdf_id, row_number() OVER w - 1 AS sort_order, title, start_page,
       CAST(least(page_count, greatest(start_page, coalesce(lead(start_page) OVER w - 1, page_count))) AS INTEGER) AS end_page
FROM unique_entries JOIN books USING (pdf_id) WINDOW w AS (PARTITION BY pdf_id ORDER BY start_page, pos))"""

BOOKS_SQL = f"books AS (SELECT DISTINCT p_brand AS pdf_id, {PAGE_COUNT} AS page_count FROM part)"


@query("toc_parse", with_sql(LINES_SQL, PARSE_SQL) + "SELECT pdf_id, pos, title, start_page FROM entries")
def toc_parse(spark, folder):
    return contents.parse_lines(contents_lines(spark, folder))


@query("toc_dedupe", with_sql(LINES_SQL, PARSE_SQL, DEDUPE_SQL) + "SELECT * FROM unique_entries")
def toc_dedupe(spark, folder):
    return contents.drop_repeats(contents.parse_lines(contents_lines(spark, folder)))


@query("toc_end_pages", with_sql(LINES_SQL, PARSE_SQL, DEDUPE_SQL, BOOKS_SQL, RANGES_SQL)
       + "SELECT * FROM ranges")
def toc_end_pages(spark, folder):
    entries = contents.drop_repeats(contents.parse_lines(contents_lines(spark, folder)))
    return contents.page_ranges(entries, contents_books(spark, folder))


@query("toc_import", with_sql(LINES_SQL, PARSE_SQL, DEDUPE_SQL, BOOKS_SQL, RANGES_SQL)
       + "SELECT * FROM ranges WHERE end_page <= 50")
def toc_import(spark, folder):
    return imports.import_contents(contents_lines(spark, folder), contents_books(spark, folder))


# Lists offered for saving: orders as sections of the customer's book, some with faults.
OFFERED_SQL = """offered AS (
SELECT o_custkey AS pdf_id, o_orderkey AS pos,
CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 3000 THEN ' ' ELSE ' ' || o_orderpriority || ' ' END AS title,
CAST(CASE WHEN o_totalprice < 5000 THEN 0 ELSE 1 + floor(o_totalprice / 10000) END AS INTEGER) AS start_page,
CAST(CASE WHEN o_totalprice > 480000 AND o_orderstatus = 'P' THEN 2 ELSE 3 + floor(o_totalprice / 10000) END AS INTEGER) AS end_page
FROM orders),
order_books AS (SELECT c_custkey AS pdf_id, CAST(c_nationkey * 4 AS INTEGER) AS page_count FROM customer)"""

FAULT_SQL = """CASE WHEN trim(title) = '' THEN 'title is required'
WHEN start_page < 1 THEN 'start page must be at least 1'
WHEN end_page < start_page THEN 'end page must be >= start page'
WHEN page_count > 0 AND (start_page > page_count OR end_page > page_count)
THEN 'page range exceeds document page count (' || page_count || ')' END"""

JUDGED_SQL = f"""judged AS (
SELECT *, max(CASE WHEN fault IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY pdf_id) = 1 AS rejected
FROM (SELECT o.*, page_count, {FAULT_SQL} AS fault FROM offered o JOIN order_books USING (pdf_id)))"""


def offered_lists(spark, folder):
    price, tens = F.col("o_totalprice"), F.floor(F.col("o_totalprice") / 10000)
    untitled = (F.col("o_orderpriority") == "1-URGENT") & (price < 3000)
    backwards = (price > 480000) & (F.col("o_orderstatus") == "P")
    return read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("pdf_id"),
        F.col("o_orderkey").alias("pos"),
        F.when(untitled, F.lit(" ")).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("title"),
        F.when(price < 5000, F.lit(0)).otherwise(1 + tens).cast("int").alias("start_page"),
        F.when(backwards, F.lit(2)).otherwise(3 + tens).cast("int").alias("end_page"),
    )


def order_books(spark, folder):
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pdf_id"), (F.col("c_nationkey") * 4).cast("int").alias("page_count")
    )


@query("validate_sections", with_sql(OFFERED_SQL, JUDGED_SQL) + "SELECT pdf_id, pos, fault, rejected FROM judged")
def validate_sections(spark, folder):
    judged = contents.check_sections(offered_lists(spark, folder), order_books(spark, folder))
    return judged.select("pdf_id", "pos", "fault", "rejected")


@query("toc_replace", with_sql(OFFERED_SQL, JUDGED_SQL, """fresh AS (
SELECT pdf_id, row_number() OVER (PARTITION BY pdf_id ORDER BY pos) - 1 AS sort_order, trim(title) AS title, start_page, end_page
FROM judged WHERE NOT rejected),
stored AS (SELECT c_custkey AS pdf_id, CAST(0 AS BIGINT) AS sort_order, c_name AS title, CAST(1 AS INTEGER) AS start_page,
           CAST(1 AS INTEGER) AS end_page FROM customer)""")
    + "SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE pdf_id NOT IN (SELECT pdf_id FROM fresh)")
def toc_replace(spark, folder):
    one = F.lit(1).cast("int")
    stored = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pdf_id"), F.lit(0).cast("bigint").alias("sort_order"),
        F.col("c_name").alias("title"), one.alias("start_page"), one.alias("end_page"),
    )
    return contents.replace_sections(stored, offered_lists(spark, folder), order_books(spark, folder))


@query("toc_saved", ORACLES["toc_replace"])
def toc_saved(spark, folder):
    """The same save into a table kept by books: only the folders of the books that change are written."""
    one = F.lit(1).cast("int")
    stored = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pdf_id"), F.lit(0).cast("bigint").alias("sort_order"),
        F.col("c_name").alias("title"), one.alias("start_page"), one.alias("end_page"),
    )
    saved = SavedTable(new_folder(spark, "saved-sections"), "pdf_id")
    saved.create(stored)
    saved.save(contents.accepted_sections(offered_lists(spark, folder), order_books(spark, folder)))
    return saved.read(spark, "pdf_id bigint, sort_order bigint, title string, start_page int, end_page int")


@query("validate_library", """SELECT 'game' AS kind, c_custkey AS id,
CASE WHEN trim(name) = '' THEN 'name is required'
     WHEN strlen(trim(name)) > 120 THEN 'name must be at most 120 characters' END AS fault
FROM (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN '  ' WHEN c_nationkey = 1 THEN repeat(c_name || 'é ', 8)
      ELSE c_name END AS name FROM customer)
UNION ALL
SELECT 'pdf', p_partkey, CASE WHEN p_type = 'SMALL' THEN 'title is required'
     WHEN p_type = 'ECONOMY' THEN 'file path is required' END FROM part""")
def validate_library(spark, folder):
    name = (
        F.when(F.col("c_nationkey") == 0, F.lit("  "))
        .when(F.col("c_nationkey") == 1, F.repeat(F.concat("c_name", F.lit("é ")), F.lit(8)))
        .otherwise(F.col("c_name"))
    )
    games = read_table(spark, folder, "customer").select(
        F.lit("game").alias("kind"), F.col("c_custkey").alias("id"), status.name_fault(name).alias("fault")
    )
    title = F.when(F.col("p_type") == "SMALL", F.lit("\t")).otherwise(F.col("p_name"))
    path = F.when(F.col("p_type") == "ECONOMY", F.lit(" ")).otherwise(F.col("p_brand"))
    books = read_table(spark, folder, "part").select(
        F.lit("pdf").alias("kind"), F.col("p_partkey").alias("id"), status.document_fault(title, path).alias("fault")
    )
    return games.unionByName(books)


# A bookmark tree per region: nations, below them customers, below them orders.
NODES_SQL = """nodes AS (
SELECT n_regionkey AS pdf_id, 'n' || n_nationkey AS node_id, NULL AS parent_id, CAST(n_nationkey AS BIGINT) AS pos,
       ' ' || n_name AS title, CAST(n_nationkey AS BIGINT) AS page FROM nation
UNION ALL
SELECT n_regionkey, 'c' || c_custkey, 'n' || c_nationkey, c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE c_name END, c_custkey + 1
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT n_regionkey, 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, o_orderpriority, o_orderkey + 1
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def bookmark_nodes(spark, folder):
    nation = read_table(spark, folder, "nation")
    region = nation.select(F.col("n_regionkey").alias("pdf_id"), "n_nationkey")
    customer = read_table(spark, folder, "customer")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")

    def key(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    top = nation.select(
        F.col("n_regionkey").alias("pdf_id"), key("n", "n_nationkey").alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"), F.col("n_nationkey").cast("bigint").alias("pos"),
        F.concat(F.lit(" "), "n_name").alias("title"), F.col("n_nationkey").cast("bigint").alias("page"),
    )
    title = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(" ")).otherwise(F.col("c_name"))
    owners = customer.join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    middle = owners.select(
        "pdf_id", key("c", "c_custkey").alias("node_id"), key("n", "c_nationkey").alias("parent_id"),
        F.col("c_custkey").alias("pos"), title.alias("title"), (F.col("c_custkey") + 1).alias("page"),
    )
    leaves = orders.join(owners.select("c_custkey", "pdf_id"), F.col("o_custkey") == F.col("c_custkey")).select(
        "pdf_id", key("o", "o_orderkey").alias("node_id"), key("c", "o_custkey").alias("parent_id"),
        F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") + 1).alias("page"),
    )
    return top.unionByName(middle).unionByName(leaves)


@query("bookmarks_flatten", "WITH RECURSIVE " + NODES_SQL + """,
tree AS (
SELECT pdf_id, node_id, 1 AS depth, [CAST(pos AS BIGINT)] AS path, title, page FROM nodes WHERE parent_id IS NULL
UNION ALL
SELECT n.pdf_id, n.node_id, t.depth + 1, list_append(t.path, CAST(n.pos AS BIGINT)), n.title, n.page
FROM tree t JOIN nodes n ON n.pdf_id = t.pdf_id AND n.parent_id = t.node_id)
SELECT pdf_id, array_to_string(path, '/') AS pos, CAST(depth AS INTEGER) AS depth, trim(title) AS title, page AS start_page
FROM tree WHERE trim(title) <> '' AND page >= 1""")
def bookmarks_flatten(spark, folder):
    flat = contents.flatten_bookmarks(bookmark_nodes(spark, folder))
    return flat.withColumn("pos", F.array_join(F.col("pos").cast("array<string>"), "/"))


@query("bookmarks_import", "WITH RECURSIVE " + NODES_SQL + """,
tree AS (
SELECT pdf_id, node_id, 1 AS depth, [CAST(pos AS BIGINT)] AS path, title, page FROM nodes WHERE parent_id IS NULL
UNION ALL
SELECT n.pdf_id, n.node_id, t.depth + 1, list_append(t.path, CAST(n.pos AS BIGINT)), n.title, n.page
FROM tree t JOIN nodes n ON n.pdf_id = t.pdf_id AND n.parent_id = t.node_id WHERE t.depth < 2),
books AS (
SELECT n_regionkey AS pdf_id, CASE n_regionkey WHEN 1 THEN 0 WHEN 2 THEN max(c_custkey) + 5 ELSE count(*) + 10 END AS page_count
FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey),
entries AS (SELECT pdf_id, path AS pos, trim(title) AS title, page AS start_page FROM tree WHERE trim(title) <> '' AND page >= 1),
unique_entries AS (
SELECT pdf_id, pos, title, start_page FROM (
SELECT *, row_number() OVER (PARTITION BY pdf_id, start_page, lower(title) ORDER BY pos) AS nth FROM entries) WHERE nth = 1),
ranges AS (
SELECT pdf_id, row_number() OVER w - 1 AS sort_order, title, start_page,
       CAST(least(CASE WHEN page_count > 0 THEN page_count ELSE 1000000000 END,
                  greatest(start_page, coalesce(lead(start_page) OVER w - 1, page_count))) AS INTEGER) AS end_page,
       page_count
FROM unique_entries JOIN books USING (pdf_id) WINDOW w AS (PARTITION BY pdf_id ORDER BY start_page, pos))
SELECT pdf_id, sort_order, title, start_page, end_page FROM ranges
WHERE pdf_id NOT IN (SELECT pdf_id FROM ranges WHERE end_page < start_page
                     OR (page_count > 0 AND (start_page > page_count OR end_page > page_count)))""")
def bookmarks_import(spark, folder):
    """Two levels of the trees as sections; one book's length is unknown, most are too short."""
    nation = read_table(spark, folder, "nation").select(F.col("n_regionkey").alias("pdf_id"), "n_nationkey")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    pages = (
        F.when(F.col("pdf_id") == 1, F.lit(0))
        .when(F.col("pdf_id") == 2, F.max("c_custkey") + 5)
        .otherwise(F.count(F.lit(1)) + 10)
    )
    books = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("pdf_id")
        .agg(pages.alias("page_count"))
    )
    return imports.import_bookmarks(bookmark_nodes(spark, folder), books, 2)


# ---- assembly -----------------------------------------------------------------------------------

SPANS_SQL = """spans AS (
SELECT section_id, pdf_id, page_no AS start_page, page_no + CASE WHEN page_no % 7 = 0 THEN -1 ELSE 2 END AS end_page FROM page_texts)"""
RANGE_TEXT_SQL = f"""range_text AS (
SELECT s.section_id, {normalize_sql(trim_sql("string_agg(p.text, chr(10) ORDER BY p.page_no)"))} AS text
FROM SPANS s JOIN page_texts p ON p.pdf_id = s.pdf_id AND p.page_no BETWEEN s.start_page AND s.end_page
GROUP BY s.section_id)"""


@query("section_text", with_sql(PAGES_SQL, SPANS_SQL, RANGE_TEXT_SQL.replace("SPANS", "spans"))
       + """SELECT section_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest
FROM spans LEFT JOIN range_text USING (section_id)""")  # fmt: skip
def section_text(spark, folder):
    """Every page starts a section of three pages; some ranges are the wrong way round and have no text."""
    pages = b.page_texts(spark, folder)
    step = F.when(F.col("page_no") % 7 == 0, -1).otherwise(2)
    spans = pages.select(
        "section_id", "pdf_id", F.col("page_no").alias("start_page"), (F.col("page_no") + step).alias("end_page")
    )
    texts = assembly.page_range_text(spans, pages)
    return texts.select(
        "section_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")
    )


# Short lines of a page serve as its headings; a page without any is one section named after it.
HEADING_WORDS = 8
HEADINGS_SQL = f"""page_lines AS (
SELECT section_id AS page_id, pdf_id, page_no, line, line_no FROM (
SELECT section_id, pdf_id, page_no, unnest(string_split(t, chr(10))) AS line,
       generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no
FROM (SELECT section_id, pdf_id, page_no, {normalize_sql(trim_sql('text'))} AS t FROM page_texts))),
heading_lines AS (
SELECT * FROM page_lines WHERE {trim_sql('line')} <> '' AND len({fields_sql('line')}) <= {HEADING_WORDS}),
heads AS (
SELECT page_id || '/' || line_no AS section_id, pdf_id, page_no AS start_page, page_no AS end_page,
       line_no AS sort_order, ' ' || replace(lower(line), ' ', '  ') AS title FROM heading_lines
UNION ALL
SELECT page_id || '/', pdf_id, any_value(page_no), any_value(page_no) + 1, 0, 'Page ' || page_id
FROM page_lines GROUP BY page_id, pdf_id
HAVING page_id NOT IN (SELECT page_id FROM heading_lines))"""

SHARED_SQL = """shared AS (
SELECT pdf_id, start_page AS page_no, count(*) AS n FROM heads WHERE start_page = end_page
GROUP BY ALL HAVING count(*) > 1)"""

SPLIT_SQL = f"""titled AS (
SELECT h.*, lower({collapse_sql('title')}) AS k FROM heads h JOIN shared s
ON s.pdf_id = h.pdf_id AND s.page_no = h.start_page WHERE h.start_page = h.end_page),
owners AS (SELECT pdf_id, start_page AS page_no, k, arg_max(title, sort_order) AS owner FROM titled GROUP BY ALL),
anchors AS (
SELECT l.pdf_id, l.page_no, o.owner, min(l.line_no) AS line_no FROM page_lines l JOIN owners o
ON o.pdf_id = l.pdf_id AND o.page_no = l.page_no AND o.k = lower({collapse_sql('l.line')}) GROUP BY ALL),
bounds AS (
SELECT *, lead(line_no) OVER (PARTITION BY pdf_id, page_no ORDER BY line_no) AS next_line FROM anchors),
parts AS (
SELECT b.pdf_id, b.page_no, b.owner, {trim_sql("string_agg(l.line, chr(10) ORDER BY l.line_no)")} AS text
FROM bounds b JOIN page_lines l ON l.pdf_id = b.pdf_id AND l.page_no = b.page_no
AND l.line_no >= b.line_no AND (b.next_line IS NULL OR l.line_no < b.next_line) GROUP BY ALL),
cut AS (
SELECT t.section_id, p.text FROM titled t JOIN parts p
ON p.pdf_id = t.pdf_id AND p.page_no = t.start_page AND p.owner = t.title)"""


def heading_sections(pages):
    lines = pages.select(
        F.col("section_id").alias("page_id"),
        "pdf_id",
        "page_no",
        F.posexplode(F.split(assembly.clean_page(F.col("text")), "\n")).alias("line_no", "line"),
    )
    short = (F.size(fields(F.col("line"))) <= HEADING_WORDS) & ~is_blank(F.col("line"))
    heads = lines.where(short).select(
        F.concat_ws("/", "page_id", "line_no").alias("section_id"),
        "pdf_id",
        F.col("page_no").alias("start_page"),
        F.col("page_no").alias("end_page"),
        F.col("line_no").cast("bigint").alias("sort_order"),
        F.concat(F.lit(" "), F.replace(F.lower("line"), F.lit(" "), F.lit("  "))).alias("title"),
    )
    plain = pages.select(F.col("section_id").alias("page_id"), "pdf_id", "page_no").join(
        lines.where(short).select("page_id").distinct(), "page_id", "left_anti"
    )
    whole = plain.select(
        F.concat_ws("/", "page_id", F.lit("")).alias("section_id"),
        "pdf_id",
        F.col("page_no").alias("start_page"),
        (F.col("page_no") + 1).alias("end_page"),
        F.lit(0).cast("bigint").alias("sort_order"),
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
    )
    return heads.unionByName(whole)


@query("same_page_groups", with_sql(PAGES_SQL, HEADINGS_SQL, SHARED_SQL) + "SELECT pdf_id, page_no, n FROM shared")
def same_page_groups(spark, folder):
    return assembly.shared_pages(heading_sections(b.page_texts(spark, folder)))


@query("heading_split", with_sql(PAGES_SQL, HEADINGS_SQL, SHARED_SQL, SPLIT_SQL)
       + "SELECT section_id, length(text) AS n_chars, md5(text) AS digest FROM cut")
def heading_split(spark, folder):
    pages = stage(b.page_texts(spark, folder), "pages", "section_id")
    cut = assembly.split_by_headings(stage(heading_sections(pages), "headings", "section_id"), pages)
    return cut.select("section_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("index_build", with_sql(
    PAGES_SQL, HEADINGS_SQL, SHARED_SQL, SPLIT_SQL, RANGE_TEXT_SQL.replace("SPANS", "heads"),
    f"""filled AS (
SELECT h.section_id, h.title, coalesce(nullif(c.text, ''), r.text, '') AS plain_text
FROM heads h LEFT JOIN cut c USING (section_id) LEFT JOIN range_text r USING (section_id)),
vec_words AS (
SELECT section_id, unnest({embed_words_sql("title || chr(10) || chr(10) || plain_text")}) AS word FROM filled),
vec_vocab AS (SELECT word, {fnv_sql('word')} % 256 AS bucket FROM (SELECT DISTINCT word FROM vec_words)),
vec AS (SELECT section_id, count(DISTINCT bucket) AS n_buckets FROM vec_words JOIN vec_vocab USING (word) GROUP BY ALL)""")
    + f"""SELECT section_id, md5(plain_text) AS digest,
CAST(len({terms_sql('title')}) + len({terms_sql('plain_text')}) AS INTEGER) AS n_terms,
coalesce(n_buckets, 0) AS n_buckets FROM filled LEFT JOIN vec USING (section_id)""")  # fmt: skip
def index_build(spark, folder):
    pages = stage(b.page_texts(spark, folder), "pages", "section_id")
    built = imports.build_index(stage(heading_sections(pages), "headings", "section_id"), pages)
    cells = built["vectors"].groupBy("section_id").agg(F.count(F.lit(1)).alias("n_buckets"))
    return (
        built["sections"]
        .select("section_id", F.md5("plain_text").alias("digest"))
        .join(built["index"].cells.select("section_id", "n_terms"), "section_id")
        .join(cells, "section_id", "left")
        .withColumn("n_buckets", F.coalesce("n_buckets", F.lit(0)).cast("bigint"))
    )


# ---- scans --------------------------------------------------------------------------------------


@query("section_scan", with_sql(SECTIONS_SQL)
       + "SELECT pdf_id, sort_order, section_id, start_page, end_page, plain_text <> '' AS indexed FROM sections")
def section_scan(spark, folder):
    rows = b.sections(spark, folder).withColumn("indexed", F.col("plain_text") != "")
    return rows.select("pdf_id", "sort_order", "section_id", "start_page", "end_page", "indexed").orderBy(
        "pdf_id", "sort_order"
    )


@query("indexed_sections", with_sql(SECTIONS_SQL)
       + "SELECT pdf_id, sort_order, section_id, title FROM sections WHERE plain_text <> ''")
def indexed_sections(spark, folder):
    rows = b.sections(spark, folder).where("plain_text <> ''")
    return rows.select("pdf_id", "sort_order", "section_id", "title").orderBy("pdf_id", "sort_order")


@query("section_samples", with_sql(SECTIONS_SQL) + f"""SELECT section_id, title, start_page, end_page,
CASE WHEN len({fields_sql('plain_text')}) > 1000 THEN array_to_string(list_slice({fields_sql('plain_text')}, 1, 1000), ' ') || '...'
     ELSE {trim_sql('plain_text')} END AS excerpt, length({trim_sql('plain_text')}) AS n_chars
FROM sections WHERE {trim_sql('plain_text')} <> ''""")
def section_samples(spark, folder):
    samples = vocabulary.section_samples(b.sections(spark, folder))
    return samples.select(
        "section_id", "title", "start_page", "end_page", "excerpt", F.length("plain_text").cast("bigint").alias("n_chars")
    )
