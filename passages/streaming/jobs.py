"""Streaming jobs: section index, progress, running game and chat sessions.

Every job writes a log of changes, one folder per micro-batch. A replayed batch overwrites its own
folder, so the log holds each change once whatever fails; the present state is the latest row per
key of the log. Nothing is rewritten in place, and old folders can be folded into one at leisure
with ``compact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions.text import count_words, is_blank
from passages.operators.fulltext import TextIndex, listed_terms, posting_rows, section_entries, whole_sections
from passages.operators.library import game_marks
from passages.operators.ordering import latest_by
from passages.session import broadcast_if_small
from passages.sources.saved import exists
from passages.sources.tables import drop_at_end, is_folder, new_folder, stage


def read_changes(spark, folder: str, table: str) -> DataFrame:
    """Stream of one of the given parquet tables, kept as one file or as a folder of files."""
    path = f"{folder}/{table}.parquet"
    changes = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    if is_folder(spark, path):
        return changes.parquet(path)
    return changes.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def run_to_log(changes: DataFrame, log: str, mode: str = "append", prepare=None, also=None) -> DataFrame:
    """Run a stream over what is there now and return its change log, with ``batch_id``.

    ``prepare`` makes a batch's rows; ``also`` is given the rows as written, and the batch's number.
    """
    spark = changes.sparkSession
    shape = None

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal shape
        rows = prepare(batch) if prepare else batch
        shape = rows.schema
        rows.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        if also:
            also(spark.read.schema(shape).parquet(f"{log}/batch_id={batch_id}"), batch_id)

    stream = (
        changes.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{log}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    if shape is None:  # nothing came in, or only what an earlier run had read
        shape = prepare(_empty(changes)).schema if prepare else changes.schema
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{log}/batch_id=-1")
    logged = T.StructType([*shape.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(logged).parquet(log)


def _empty(changes: DataFrame) -> DataFrame:
    return changes.sparkSession.createDataFrame([], changes.schema)


def new_log(spark, name: str) -> str:
    """Folder for a log that is removed, with its checkpoint and segments, when the driver ends."""
    path = new_folder(spark, name)
    for part in ("checkpoint", "postings", "vocabulary"):
        drop_at_end(spark, f"{path}-{part}")
    return path


def current(log: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Latest row per key of a change log."""
    return latest_by(log, keys, F.col("batch_id") if order is None else order).drop("batch_id")


def compact(log: DataFrame, keys: list[str], path: str) -> None:
    """Write the present state as the one batch of a new log."""
    current(log, keys).write.mode("overwrite").parquet(f"{path}/batch_id=0")


def index_sections(texts: DataFrame, log: str) -> DataFrame:
    """Index arriving section texts (section_id, pdf_id, title, plain_text, seq); the last by seq wins.

    Each batch is a segment of the index: the last text per section with its terms, word count and
    vector cells in the log itself, and beside it the batch's postings, sorted by term, and its vocabulary.
    What holds now, whatever batch it came in, is read with ``current_index`` and searched with
    ``open_index``. A replayed batch overwrites its own segment.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        last = _last_texts(batch)
        words = last.withColumn("n_words", F.size(count_words(F.col("plain_text"))))
        held = section_entries(words, "seq", "title", "plain_text", "n_words")
        return held.withColumn("vector", F.col("cells")).drop("cells")

    def segment(rows: DataFrame, batch_id: int) -> None:
        _write_segment(rows, log, batch_id)

    return run_to_log(texts, log, prepare=prepare, also=segment)


def _last_texts(batch: DataFrame) -> DataFrame:
    """The last text of each section by seq. Only texts of sections that come several times, or without a seq, are moved."""
    seqs = batch.groupBy(F.col("section_id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.count("seq").alias("m"))
    repeated = stage(seqs.where("n > 1 or m < n").select("_id"), "repeated")
    if not repeated.head(1):
        return batch
    sent, same = broadcast_if_small(repeated), F.col("section_id").eqNullSafe(F.col("_id"))
    again = latest_by(batch.join(sent, same, "left_semi"), ["section_id"], F.col("seq"))
    return batch.join(sent, same, "left_anti").unionByName(again)


def _write_segment(rows: DataFrame, log: str, batch_id: int) -> None:
    postings = posting_rows(rows).repartitionByRange("term", "section_id").sortWithinPartitions("term", "section_id")
    postings.write.mode("overwrite").parquet(f"{log}-postings/batch_id={batch_id}")
    terms = rows.select(F.explode(listed_terms()).alias("term")).distinct()
    terms.write.mode("overwrite").parquet(f"{log}-vocabulary/batch_id={batch_id}")


def current_index(log: DataFrame) -> DataFrame:
    """Latest state of each section: the highest seq, the later batch among equals."""
    newest = _newest(log)
    return log.join(newest, ["section_id", "batch_id"]).drop("batch_id", "terms", "ends", "places")


def _newest(log: DataFrame) -> DataFrame:
    """(section_id, batch_id) of the segment that holds each section's present state; texts don't move."""
    return log.groupBy("section_id").agg(F.max_by("batch_id", F.struct("seq", "batch_id")).alias("batch_id"))


def open_index(log: DataFrame, path: str) -> TextIndex:
    """The segments of the log in folder ``path`` as one index to search.

    Rows of sections that a newer segment holds are hidden by their (section, segment); there are as
    many as texts were replaced, until ``compact_index`` folds the segments. Sizes and counts are
    those of the present texts. The vocabulary may hold words of hidden rows, which find nothing.
    """
    spark = log.sparkSession
    newest = stage(_newest(log), "newest")
    hidden = stage(log.select("section_id", "batch_id").join(newest, ["section_id", "batch_id"], "left_anti"), "hidden")
    sent = broadcast_if_small(hidden)
    postings = _read_parts(spark, f"{path}-postings", posting_rows(log).schema)
    postings = postings.join(sent, ["section_id", "batch_id"], "left_anti").drop("batch_id")
    vocabulary = _read_parts(spark, f"{path}-vocabulary", T.StructType([T.StructField("term", T.StringType())]))
    # What is hidden is little, so texts, entries and vectors stay where they were written.
    live = log.where("section_id is not null").join(sent, ["section_id", "batch_id"], "left_anti")
    size = live.agg(F.count(F.lit(1)).alias("n"), F.avg("n_terms").alias("mean")).first()
    cells = live.select("section_id", "n_terms", F.col("vector").alias("cells"), "penalty")
    return TextIndex(
        postings,
        stage(vocabulary.select("term").distinct(), "vocabulary"),
        stage(cells, "cells") if sent is hidden else cells,
        size["n"],
        size["mean"] or 0.0,
        entries=whole_sections(live),
    )


def _read_parts(spark, path: str, schema: T.StructType) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def compact_index(log: DataFrame, path: str) -> None:
    """Write the present state as the one segment of a new log in folder ``path``."""
    live = stage(log.join(_newest(log), ["section_id", "batch_id"]).drop("batch_id"), "live")
    live.write.mode("overwrite").parquet(f"{path}/batch_id=0")
    _write_segment(live, path, 0)


def read_log(spark, path: str, like: DataFrame) -> DataFrame:
    """A log from its folder, with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(path)


def progress_log(progress: DataFrame, log: str) -> DataFrame:
    """Latest progress (pdf_id, phase, current, total) per book, by time and event."""
    state = F.struct("event_id", "phase", "current", "total")
    latest = progress.groupBy("pdf_id").agg(F.max_by(state, F.struct("ts", "event_id")).alias("s"))
    return run_to_log(latest.select("pdf_id", "s.*"), log, "update")


def game_log(commands: DataFrame, log: str) -> DataFrame:
    """Last command of each kind per game; which game runs follows from them on reading.

    Kept per game rather than in one global state, so commands of many games spread over the tasks.
    """
    return run_to_log(game_marks(commands), log, "update")


def new_finds(found: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stream of finds (conv_id, section_id, prio, at) without those that were delivered before.

    A find is remembered until the watermark, ``delay`` behind the newest ``at``, has passed it, so
    the state holds no more than ``delay`` brings. What comes later than that is left out.
    """
    seen = ["conv_id", "section_id", "prio"]
    return found.withWatermark("at", delay).dropDuplicatesWithinWatermark(seen)


def session_log(found: DataFrame, log: str) -> DataFrame:
    """First find of each section per conversation (conv_id, section_id, prio), batch by batch.

    No state is kept between batches: each logs the first finds among its own, and the least ``prio``
    of the log is the first of all. Read it with ``current(log, keys, -prio)``.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        return batch.groupBy("conv_id", "section_id").agg(F.min("prio").alias("prio"))

    return run_to_log(found, log, prepare=prepare)


def message_log(turns: DataFrame, log: str) -> DataFrame:
    """Last user message per conversation (conv_id, turn, message), batch by batch; blank ones don't count.

    As with ``session_log`` no state is kept; read it with ``current(log, ["conv_id"], turn)``.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        last = batch.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m"))
        return last.select("conv_id", "m.turn", F.col("m.text").alias("message"))

    said = turns.where((F.col("role") == "user") & ~is_blank(F.col("text")))
    return run_to_log(said.select("conv_id", "turn", "text"), log, prepare=prepare)
