"""Library bookkeeping: books, games, attachments and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import library, ordering
from passages.queries.bindings import with_sql
from passages.queries.registry import ORACLES, query
from passages.sources.saved import SavedTable
from passages.sources.tables import new_folder, read_table

# Suppliers are books, nations games; a supplier is attached to its nation.


def books(spark, folder):
    return read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("pdf_id"), F.col("s_name").alias("title")
    )


def attached(spark, folder):
    """Suppliers in good standing are attached; the position follows the book number."""
    rows = read_table(spark, folder, "supplier").where("s_acctbal >= 2000").select(
        F.col("s_nationkey").alias("game_id"), F.col("s_suppkey").alias("pdf_id")
    )
    return ordering.dense_position(
        rows, ["game_id"], {"_piece": ordering.int_chunk("pdf_id")}, ["pdf_id"], "sort_order"
    )


def games(spark, folder):
    return read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("game_id"),
        F.col("n_name").alias("name"),
        (F.col("n_regionkey") == 0).alias("archived"),
        F.lit(False).alias("running"),
        (F.col("n_nationkey") * 7 % 25).alias("updated_at"),
    )


ATTACHED = """attached AS (
SELECT s_nationkey AS game_id, s_suppkey AS pdf_id,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS sort_order
FROM supplier WHERE s_acctbal >= 2000)"""


@query("library_list", "SELECT s_suppkey AS pdf_id, s_name AS title FROM supplier")
def library_list(spark, folder):
    return books(spark, folder).orderBy("title")


@query("games_filtered", """SELECT n_nationkey AS game_id, n_name AS name, 'active' AS filter FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT n_nationkey, n_name, 'archived' FROM nation WHERE n_regionkey = 0
UNION ALL SELECT n_nationkey, n_name, 'all' FROM nation""")
def games_filtered(spark, folder):
    kept = [
        library.games_list(games(spark, folder), which).select("game_id", "name", F.lit(which).alias("filter"))
        for which in (library.ACTIVE, library.ARCHIVED, library.ALL)
    ]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("game_pdf_list", with_sql(ATTACHED) + """SELECT a.game_id, a.pdf_id, a.sort_order, s.s_name AS title, coalesce(c.n, 0) AS section_count,
CASE WHEN a.pdf_id IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN 'ok' ELSE 'missing' END AS path_status
FROM attached a JOIN supplier s ON s.s_suppkey = a.pdf_id
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) c ON c.l_suppkey = a.pdf_id""")
def game_pdf_list(spark, folder):
    lines = read_table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("pdf_id"))
    counted = library.count_by(lines, "pdf_id", "section_count")
    path = lambda key: F.format_string("/books/%d.pdf", key)
    files = read_table(spark, folder, "part").where("p_size > 10").select(path("p_partkey").alias("path"))
    filed = library.path_status(books(spark, folder).withColumn("file_path", path("pdf_id")), files)
    rows = library.game_books(attached(spark, folder), filed, counted)
    columns = ["game_id", "pdf_id", "sort_order", "title", "section_count", "path_status"]
    return rows.select(*columns).orderBy("game_id", "sort_order")


@query("library_summary", with_sql(ATTACHED) + """SELECT s_suppkey AS pdf_id, s_name AS title, coalesce(c.n, 0) AS section_count,
coalesce(g.n, 0) AS game_count FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) c ON c.l_suppkey = s_suppkey
LEFT JOIN (SELECT pdf_id, count(*) AS n FROM attached GROUP BY ALL) g ON g.pdf_id = s_suppkey""")
def library_summary(spark, folder):
    lines = read_table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("pdf_id"))
    counted = library.with_counts(
        books(spark, folder), library.count_by(lines, "pdf_id", "section_count"), "pdf_id", "section_count"
    )
    refs = library.count_by(attached(spark, folder), "pdf_id", "game_count")
    return library.with_counts(counted, refs, "pdf_id", "game_count")


@query("game_summary", with_sql(ATTACHED) + """SELECT n_nationkey AS game_id, n_name AS name, coalesce(g.n, 0) AS pdf_count
FROM nation LEFT JOIN (SELECT game_id, count(*) AS n FROM attached GROUP BY ALL) g ON g.game_id = n_nationkey""")
def game_summary(spark, folder):
    counted = library.count_by(attached(spark, folder), "game_id", "pdf_count")
    rows = games(spark, folder).select("game_id", "name")
    return library.with_counts(rows, counted, "game_id", "pdf_count")


@query("unattached_pdfs", with_sql(ATTACHED) + """SELECT s_suppkey AS pdf_id, s_name AS title FROM supplier
WHERE s_suppkey NOT IN (SELECT pdf_id FROM attached)""")
def unattached_pdfs(spark, folder):
    return library.unattached(books(spark, folder), attached(spark, folder))


@query("deletable_pdfs", with_sql("refs AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL)") + """SELECT k AS pdf_id,
CASE WHEN refs.n > 0 THEN 'pdf is attached to ' || refs.n || ' game(s); detach it first'
     WHEN c_custkey IS NULL THEN 'pdf not found' ELSE 'deleted' END AS verdict
FROM (SELECT DISTINCT c_custkey + 100 AS k FROM customer) LEFT JOIN refs USING (k) LEFT JOIN customer ON c_custkey = k""")
def deletable_pdfs(spark, folder):
    """Customers as books, their orders as references; some requests name books that do not exist."""
    customers = read_table(spark, folder, "customer")
    requests = customers.select((F.col("c_custkey") + 100).alias("pdf_id"))
    known = customers.select(F.col("c_custkey").alias("pdf_id"))
    refs = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("pdf_id"))
    return library.deletable(requests, known, refs)


@query("attach_list", """WITH lists AS (
SELECT o_orderkey AS game_id, [o_custkey, o_custkey + 1, CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_custkey + 2 END] AS ids FROM orders)
SELECT game_id, pdf_id, CAST(sort_order AS INTEGER) AS sort_order FROM (
SELECT game_id, unnest(ids) AS pdf_id, generate_subscripts(ids, 1) - 1 AS sort_order, ids FROM lists)
WHERE len(list_distinct(ids)) = 3 AND (SELECT max(c_custkey) FROM customer) >= list_max(ids)""")
def attach_list(spark, folder):
    """Each order names three customers as its list, some twice and some unknown."""
    orders = read_table(spark, folder, "orders")
    first = F.col("o_custkey")
    last = F.when(F.col("o_orderstatus") == "P", first).otherwise(first + 2)
    lists = orders.select(F.col("o_orderkey").alias("game_id"), F.array(first, first + 1, last).alias("pdf_ids"))
    known = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("pdf_id"))
    return library.attach_lists(lists, known, orders.select(F.col("o_orderkey").alias("game_id")))


@query("attach_saved", f"""WITH accepted AS ({ORACLES["attach_list"]})
SELECT * FROM accepted UNION ALL SELECT o_orderkey, o_custkey, CAST(0 AS INTEGER) FROM orders WHERE o_orderkey NOT IN (SELECT game_id FROM accepted)""")
def attach_saved(spark, folder):
    """The same lists saved over a list of one book per game; refused lists leave their game as it was."""
    stored = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("pdf_id"), F.lit(0).cast("int").alias("sort_order")
    )
    saved = SavedTable(new_folder(spark, "saved-lists"), "game_id")
    saved.create(stored)
    saved.save(attach_list(spark, folder).select("game_id", "pdf_id", F.col("sort_order").cast("int").alias("sort_order")))
    return saved.read(spark, "game_id bigint, pdf_id bigint, sort_order int")


UPSERT_SQL = """changes AS (
SELECT c_custkey AS pdf_id, c_name AS title, '/books/' || c_custkey AS file_path, CAST(NULL AS INTEGER) AS page_count,
       CAST('' AS VARCHAR) AS index_status, CAST(-1 AS BIGINT) AS seq FROM customer
UNION ALL
SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN ' ' || o_orderpriority || ' ' ELSE ' ' END, '',
       CASE WHEN o_totalprice > 200000 THEN CAST(year(o_orderdate) AS INTEGER) END,
       CASE WHEN o_orderstatus = 'P' THEN 'indexed' ELSE '' END, o_orderkey FROM orders WHERE o_custkey >= 0),
given AS (SELECT pdf_id, seq, nullif(trim(title), '') AS title, nullif(trim(file_path), '') AS file_path, page_count,
                 nullif(trim(index_status), '') AS index_status FROM changes)"""


@query("library_upsert", with_sql(UPSERT_SQL) + """SELECT pdf_id, arg_max(title, seq) AS title, arg_max(file_path, seq) AS file_path,
arg_max(page_count, seq) AS page_count, coalesce(arg_max(index_status, seq), 'none') AS index_status
FROM given GROUP BY pdf_id HAVING arg_max(title, seq) IS NOT NULL AND arg_max(file_path, seq) IS NOT NULL""")
def library_upsert(spark, folder):
    """Customers as stored books, orders as later partial changes."""
    stored = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pdf_id"), F.col("c_name").alias("title"),
        F.concat(F.lit("/books/"), F.col("c_custkey").cast("string")).alias("file_path"),
        F.lit(None).cast("int").alias("page_count"), F.lit("").alias("index_status"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    title = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    changed = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("pdf_id"), F.coalesce(title, F.lit(" ")).alias("title"), F.lit("").alias("file_path"),
        F.when(F.col("o_totalprice") > 200000, F.year("o_orderdate")).alias("page_count"),
        F.when(F.col("o_orderstatus") == "P", F.lit("indexed")).otherwise(F.lit("")).alias("index_status"),
        F.col("o_orderkey").alias("seq"),
    )
    return library.upsert_books(stored, changed)


@query("apply_status_commands", """WITH commands AS (
SELECT user_id AS pdf_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 'thumbnail' ELSE 'status' END AS kind,
       event_type AS value, CASE WHEN event_type = 'purchase' THEN event_id END AS set_at FROM events)
SELECT c_custkey AS pdf_id, coalesce(s.value, 'none') AS index_status, s.row.set_at AS indexed_at, t.value AS thumbnail_path
FROM customer
LEFT JOIN (SELECT pdf_id, arg_max(value, seq) AS value, arg_max({'set_at': set_at}, seq) AS row FROM commands WHERE kind = 'status' GROUP BY ALL) s ON s.pdf_id = c_custkey
LEFT JOIN (SELECT pdf_id, arg_max(value, seq) AS value FROM commands WHERE kind = 'thumbnail' GROUP BY ALL) t ON t.pdf_id = c_custkey""")
def apply_status_commands(spark, folder):
    """Events as commands on customers: views set thumbnails, all others the status."""
    known = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("pdf_id"), F.lit("none").alias("index_status"),
        F.lit(None).cast("bigint").alias("indexed_at"), F.lit(None).cast("string").alias("thumbnail_path"),
    )
    kind = F.when(F.col("event_type") == "view", F.lit("thumbnail")).otherwise(F.lit("status"))
    commands = read_table(spark, folder, "events").select(
        F.col("user_id").alias("pdf_id"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.col("event_type").alias("value"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("at"),
    )
    return library.apply_commands(known, commands)


COMMANDS_SQL = """commands AS (
SELECT user_id AS game_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'stop'
       WHEN 'error' THEN 'archive' WHEN 'purchase' THEN 'restore' ELSE 'look' END AS kind FROM events),
marks AS (
SELECT game_id, max(seq) FILTER (kind = 'start') AS started, max(seq) FILTER (kind IN ('stop', 'archive')) AS halted,
       max(seq) FILTER (kind = 'archive') AS archived_at, max(seq) FILTER (kind IN ('restore', 'start')) AS restored_at
FROM commands GROUP BY ALL)"""

STATES_SQL = """SELECT game_id,
coalesce(started = (SELECT max(started) FROM marks), false) AND NOT coalesce(halted > started, false) AS running,
archived_at IS NOT NULL AND NOT coalesce(restored_at > archived_at, false) AS archived FROM marks"""


def game_commands(events):
    kind = (
        F.when(F.col("event_type") == "signup", F.lit("start"))
        .when(F.col("event_type") == "click", F.lit("stop"))
        .when(F.col("event_type") == "error", F.lit("archive"))
        .when(F.col("event_type") == "purchase", F.lit("restore"))
        .otherwise(F.lit("look"))
    )
    return events.select(F.col("user_id").alias("game_id"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query("running_game", with_sql(COMMANDS_SQL) + STATES_SQL)
def running_game(spark, folder):
    return library.game_states(library.game_marks(game_commands(read_table(spark, folder, "events"))))


@query("section_upsert", """WITH texts AS (
SELECT c_custkey AS section_id, CAST(-1 AS BIGINT) AS seq, '' AS plain_text FROM customer
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority || ' ' || o_orderstatus FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT section_id, max(seq) AS seq, arg_max(plain_text, seq) AS plain_text FROM texts GROUP BY ALL""")
def section_upsert(spark, folder):
    """Customers as empty sections, orders as arriving texts."""
    stored = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("section_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("plain_text")
    )
    arrived = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("section_id"),
        F.col("o_orderkey").alias("seq"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("plain_text"),
    )
    return library.latest_texts(stored, arrived)


FILES_SQL = """wanted AS (SELECT o_orderkey AS pdf_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE '/books/' || o_custkey || '.pdf' END AS file_path FROM orders),
files AS (SELECT DISTINCT '/books/' || c_custkey || '.pdf' AS path FROM customer WHERE c_acctbal > 0)"""


@query("path_status", with_sql(FILES_SQL) + """SELECT pdf_id, file_path, CASE WHEN trim(file_path) <> '' AND file_path IN (SELECT path FROM files)
THEN 'ok' ELSE 'missing' END AS path_status FROM wanted""")
def path_status(spark, folder):
    """Orders name the file of a book, customers with money are the files that exist."""
    orders, customers = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    path = lambda key: F.format_string("/books/%d.pdf", key)
    named = F.when(F.col("o_orderkey") % 11 == 0, F.lit(" ")).otherwise(path("o_custkey"))
    wanted = orders.select(F.col("o_orderkey").alias("pdf_id"), named.alias("file_path"))
    files = customers.where("c_acctbal > 0").select(path("c_custkey").alias("path"))
    return library.path_status(wanted, files).select("pdf_id", "file_path", "path_status")


@query("game_upsert", """WITH rows AS (
SELECT CAST(n_nationkey AS BIGINT) AS game_id, n_name AS name, '' AS notes, CAST(-1 AS BIGINT) AS seq FROM nation
UNION ALL SELECT c_custkey % 40, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE ' ' || c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_custkey FROM customer)
SELECT game_id, arg_max(nullif(trim(name), ''), seq) AS name, arg_max(notes, seq) AS notes FROM rows GROUP BY game_id HAVING max(nullif(trim(name), '')) IS NOT NULL""")
def game_upsert(spark, folder):
    """Nations as stored games, customers as changes to them and to new ones; blank names change nothing."""
    stored = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("game_id"), F.col("n_name").alias("name"), F.lit("").alias("notes"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    changed = read_table(spark, folder, "customer").select(
        (F.col("c_custkey") % 40).cast("bigint").alias("game_id"), name.alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("notes"), F.col("c_custkey").cast("bigint").alias("seq"),
    )
    return library.upsert_games(stored, changed)
