"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from passages.llm import (
    decontaminate, embeddings, language, pieces, secrets, simhash, substrings, toxicity, urls, warc,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "a long text of words that go on, and on. " * 5_000
TEXTS = [(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (None, "lone"), (4, LONG), (5, " \n ")]
EXTRA = ["key", "id", "row", "doc", "label", "lang", "score", "words", "text_hash", "fingerprint", "candidates", "bucket"]


def documents(spark, rows=TEXTS):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs.withColumns({name: F.lit("x") for name in EXTRA})


def benchmark(spark, rows=((1, "one two three four five"), (2, None), (None, "lone"), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def language_model():
    points = language._letters("one two three")
    return language.LanguageFilter.build({"en": language.grams(points, 2)}, rows=1 << 10, sizes=(2,))


JOBS = {
    "simhash": lambda spark, docs: simhash.simhash_components(docs),
    "pieces": lambda spark, docs: pieces.encode_documents(docs, MODEL),
    "decontaminate": lambda spark, docs: decontaminate.contamination(docs, benchmark(spark)),
    "secrets": lambda spark, docs: secrets.find_secrets(docs),
    "toxicity": lambda spark, docs: toxicity.toxicity(docs, toxicity.fit({"idiot": 3.0}, {"word": 3.0})),
    "language": lambda spark, docs: language.identify(docs, language_model()),
    "substrings": lambda spark, docs: substrings.cut_repeats(docs),
}


@pytest.mark.parametrize("name", JOBS)
def test_odd_documents(name, spark):
    got = JOBS[name](spark, documents(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _ in TEXTS)
    twins = [r for r in got if r.doc_id == 1]
    assert twins[0] == twins[1]


@pytest.mark.parametrize("name", JOBS)
def test_no_documents(name, spark):
    assert JOBS[name](spark, documents(spark, [])).collect() == []


def test_no_benchmark(spark):
    got = decontaminate.contamination(documents(spark), benchmark(spark, [])).collect()
    assert len(got) == len(TEXTS) and not any(r.contaminated for r in got)


def test_training_without_labels(spark):
    docs = documents(spark)
    nothing = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, toxicity.train(docs, nothing)).collect())
    model = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
        (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1),
        (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("bucket", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(vectors).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert got[None] == (0, None, True)
    assert embeddings.near_vectors(vectors.where("vec_id < 0")).collect() == []


def test_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/x?b=2&a=1&utm_source=q#f"), (4, "https://example.net"),
            (5, "https://www.example.com/en/"), (None, "http://x.org/p/"), (6, "http://x.org:80/p?ref=1"), (6, "http://x.org:80/p?ref=1")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]
    listed = spark.createDataFrame([("x.org/p/",), (None,), ("x.org/p/",)], "canonical string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed, rules).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"),
        (3, "a.example.com", "/en/x", "example.com/en/", "block"), (4, "example.net", "", None, "allow"),
        (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (None, "x.org", "/p/", None, "block"),
        (6, "x.org:80", "/p", None, "block"),
    }
    assert urls.judge_urls(pages, listed, rules).count() == len(rows)
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0), []).collect()} == {"allow"}
    assert urls.judge_urls(pages.where("page_id < 0"), listed, rules).collect() == []


def test_bloom_filter_only_passes(spark):
    listed = spark.range(2_000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    asked = spark.range(20_000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"))
    hits = urls.possible_hits(asked, listed, 2_000 // urls.KEYS_PER_BLOCK + 1).where("maybe")
    assert hits.join(listed, "canonical", "left_semi").count() == 2_000
    assert hits.count() < 2_000 + 18_000 * 0.05


def test_odd_pages(spark, tmp_path):
    html = "<p>WARC/1.1\r\n\r\nContent-Length: 3</p> é"
    rows = [(1, "http://a/", html), (5, "http://a/\r\nX: y", html), (3, None, html), (7, None, None), (8, "http://b/", ""),
            (None, "http://c/", html), (9, "http://d/", "only"), (9, "http://d/", "only")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("value", F.lit("x"))
    warc.write_archives(pages, str(tmp_path / "w"), captures=2)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.where("type = 'response'").select("payload").distinct().count() == 3
    got = sorted(
        (str(r.page), r.type, r.payload_bytes, r.payload_digest, r.to)
        for r in warc.assemble_captures(records).selectExpr(
            "metadata.fields['page-id'] AS page", "answer.type", "payload_bytes", "payload_digest", "refers_to['page-id'] AS to"
        ).collect()
    )
    import base64
    import hashlib

    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    n = len(html.encode())
    assert got == sorted([
        ("1", "revisit", n, digest(html), "5"), ("5", "response", n, digest(html), None), ("3", "revisit", n, digest(html), "5"),
        ("None", "revisit", n, digest(html), "5"), ("7", "revisit", 0, digest(""), "8"), ("8", "response", 0, digest(""), None),
        ("9", "response", 4, digest("only"), None), ("9", "response", 4, digest("only"), None),
    ], key=lambda r: r)
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.assemble_captures(warc.read_archives(spark, str(tmp_path / "none"))).collect() == []
