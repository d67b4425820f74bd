"""Streaming jobs run over what the given tables hold, checked against the same state in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions.status import is_active, progress_percent
from passages.operators.fulltext import best_sections, query_phrases
from passages.operators.library import game_states
from passages.queries import bindings as b
from passages.queries.bindings import SECTIONS_SQL, count_words_sql, terms_sql, with_sql
from passages.queries.books import COMMANDS_SQL, STATES_SQL, game_commands
from passages.queries.registry import ORACLES, query
from passages.queries.search import weights_sql
from passages.queries.texts import PERCENT_SQL, PROGRESS_SQL, progress
from passages.streaming import jobs
from passages.streaming.running import running_log


@query("stream_index", with_sql(SECTIONS_SQL, weights_sql("sections", "section_id", "title || chr(10) || chr(10) || plain_text", "w"))
       + f"""SELECT s.section_id, s.pdf_id, CAST(len({count_words_sql('s.plain_text')}) AS INTEGER) AS n_words,
CAST(len({terms_sql('s.title')}) + len({terms_sql('s.plain_text')}) AS INTEGER) AS n_terms, coalesce(c.n, 0) AS n_cells
FROM sections s LEFT JOIN (SELECT section_id, count(*) AS n FROM w GROUP BY ALL) c USING (section_id)""")  # fmt: skip
def stream_index(spark, folder):
    texts = jobs.read_changes(spark, folder, "documents").select(
        F.col("doc_id").alias("section_id"), F.col("source").alias("pdf_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("plain_text"),
        F.col("doc_id").alias("seq"),
    )
    log = jobs.index_sections(texts, jobs.new_log(spark, "index"))
    cells = F.coalesce(F.size("vector"), F.lit(0))
    return jobs.current_index(log).select(
        "section_id", "pdf_id", "n_words", "n_terms", F.greatest(cells, F.lit(0)).cast("bigint").alias("n_cells")
    )


@query("stream_search", ORACLES["bm25_rank"])
def stream_search(spark, folder):
    """Full-text ranking over the index that the stream of documents has built."""
    texts = jobs.read_changes(spark, folder, "documents").select(
        F.col("doc_id").alias("section_id"), F.col("source").alias("pdf_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("plain_text"),
        F.col("doc_id").alias("seq"),
    )
    path = jobs.new_log(spark, "index")
    index = jobs.open_index(jobs.index_sections(texts, path), path)
    ranked = best_sections(index, query_phrases(b.questions(spark, folder)))
    return ranked.withColumn("fts_rank", F.round("fts_rank", 6))


@query("stream_progress", with_sql(PROGRESS_SQL, """latest AS (
SELECT *, CAST(CASE WHEN total <= 0 THEN 1 ELSE total END AS DOUBLE) AS whole FROM (
SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY ts DESC, event_id DESC) AS nth FROM progress) WHERE nth = 1)""")
    + f"""SELECT pdf_id, event_id, phase, round(CAST({PERCENT_SQL} AS DOUBLE), 6) AS percent, phase <> 'error' AS active FROM latest""")
def stream_progress(spark, folder):
    rows = progress(jobs.read_changes(spark, folder, "events"))
    log = jobs.progress_log(rows, jobs.new_log(spark, "progress"))
    phase = F.col("phase")
    return jobs.current(log, ["pdf_id"]).select(
        "pdf_id", "event_id", "phase",
        F.round(progress_percent(phase, F.col("current"), F.col("total")), 6).alias("percent"),
        is_active(phase).alias("active"),
    )


@query("stream_running", with_sql(COMMANDS_SQL) + STATES_SQL)
def stream_running(spark, folder):
    commands = game_commands(jobs.read_changes(spark, folder, "events"))
    log = jobs.game_log(commands, jobs.new_log(spark, "games"))
    return game_states(jobs.current(log, ["game_id"]))


@query("stream_library", with_sql(COMMANDS_SQL, """last_starts AS (
SELECT *, 'lib' || game_id % 4 AS library_id, row_number() OVER (PARTITION BY game_id % 4 ORDER BY started DESC NULLS LAST) AS nth FROM marks)""")
    + """SELECT library_id, started AS seq, CASE WHEN started IS NOT NULL AND NOT coalesce(halted > started, false) THEN game_id END AS game_id
FROM last_starts WHERE nth = 1""")  # fmt: skip
def stream_library(spark, folder):
    """The game that runs in each of four libraries, kept as state of the stream."""
    commands = game_commands(jobs.read_changes(spark, folder, "events"))
    named = commands.withColumn("library_id", F.concat(F.lit("lib"), F.col("game_id") % 4))
    return jobs.current(running_log(named, jobs.new_log(spark, "libraries")), ["library_id"])


@query("stream_session", """SELECT user_id AS conv_id, event_type AS section_id, min(event_id) AS prio FROM events GROUP BY ALL""")
def stream_session(spark, folder):
    found = jobs.read_changes(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_type").alias("section_id"), F.col("event_id").alias("prio"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    log = jobs.session_log(jobs.new_finds(found), jobs.new_log(spark, "session"))
    return jobs.current(log, ["conv_id", "section_id"], -F.col("prio"))


@query("stream_messages", "SELECT conv_id, arg_max(text, turn) AS message FROM conversations WHERE role = 'user' GROUP BY ALL")
def stream_messages(spark, folder):
    turns = jobs.read_changes(spark, folder, "conversations")
    log = jobs.message_log(turns, jobs.new_log(spark, "messages"))
    return jobs.current(log, ["conv_id"], F.col("turn")).select("conv_id", "message")
