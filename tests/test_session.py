"""Shared folder, size-checked broadcasts and plans that must not shuffle."""

import pytest
from pyspark.sql import functions as F

from passages import session
from passages.operators.embedding import bucket_weights, vector_cells
from passages.sources import tables


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_cluster_without_shared_folder_is_refused():
    class Context:
        master = "yarn"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_staged_tables_go_at_the_end(spark, monkeypatch):
    dropped = []
    monkeypatch.setattr(tables, "drop_at_end", lambda spark, path: dropped.append(path))
    kept = tables.stage(spark.range(5), "five")
    assert kept.count() == 5 and len(dropped) == 1 and dropped[0].startswith(session.shared_dir(spark))


@pytest.mark.parametrize("rows, size, hinted", [(10, 10, True), (11, 10, False), (10, 10_000, False)])
def test_broadcast_bounds(spark, rows, size, hinted):
    df = spark.range(rows).select(F.repeat(F.lit("x"), F.lit(size)).alias("text"), F.lit(None).cast("string").alias("n"))
    assert ("broadcast" in plan(session.broadcast_if_small(df, 10, 10_000))) == hinted


def test_vectors_are_made_without_a_shuffle(spark):
    texts = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "id int, text string")
    assert "Exchange" not in plan(bucket_weights(texts, "id", "text"))
    made = {r.id: r.cells for r in texts.select("id", vector_cells(F.col("text")).alias("cells")).collect()}
    assert not made[2] and not made[3]


def test_search_reads_postings_only(spark):
    from passages.operators import fulltext

    rows = [("s1", "b", "Title one", "the wild attack"), ("s2", "b", "Other", "a wild-attack theme")]
    sections = spark.createDataFrame(rows, "section_id string, pdf_id string, title string, plain_text string")
    index = fulltext.build_text_index(sections)
    asked = spark.createDataFrame([(0, "the wild-att")], "query_id int, query_text string")
    hits = fulltext.phrase_hits(index, fulltext.query_phrases(asked))
    assert "plain_text" not in plan(hits) and "body_terms" not in plan(hits)
    assert {(r.section_id, r.phrase, r.f) for r in hits.collect()} == {
        ("s1", "the", 1), ("s2", "the", 1), ("s1", "wild att", 1), ("s2", "wild att", 1)
    }
