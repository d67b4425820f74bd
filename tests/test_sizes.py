"""Rows that a task meets where tables of a few ids are joined."""

from pyspark.sql import functions as F

from passages.operators import library
from passages.sources import tables


def largest(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_attachment_lists_meet_few_rows_a_task(spark, rows, monkeypatch):
    monkeypatch.setattr(tables, "MET", 500)
    games = spark.range(4_000).select(F.col("id").alias("game_id"))
    lists = games.select("game_id", F.array(F.col("game_id"), F.col("game_id") + 1, F.col("game_id") + 2 * F.signum("game_id").cast("bigint")).alias("pdf_ids"))
    more = spark.createDataFrame([(5, [1]), (6, [9, None]), (7, [6]), (8, [8]), (None, [1]), (9_999, [1])], "game_id bigint, pdf_ids array<bigint>")
    books = spark.range(3_000).select(F.col("id").alias("pdf_id"))
    kept = library.attach_lists(lists.unionByName(more), books, games)
    # 0 repeats a book, 6 names a blank, 8 has a second list that repeats a book, the last name unknown books.
    good = [g for g in range(2_998) if g not in (0, 6, 8)]
    want = [(g, g + i, i) for g in good for i in range(3)] + [(5, 1, 0), (7, 6, 0)]
    assert rows(kept, "game_id", "pdf_id", "sort_order") == sorted(want, key=repr)
    assert largest(kept) < 1_500
