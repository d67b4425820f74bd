"""What a model is told about a book, the passes that ask it, and what a rebuild has to redo."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.functions.text import trim_ws, truncate_words
from passages.operators.hits import attach_section_ids
from passages.operators.ordering import first_by
from passages.operators.replies import generate, parse_replies, reply_citations
from passages.operators.vocabulary import (
    TOP_WORDS, feature_candidates, frequent_words, section_samples, unique_words, word_counts,
)
from passages.plans.search import TOOL_RESULTS
from passages.session import broadcast_if_small
from passages.sources.saved import exists
from passages.sources.tables import stage

EXCERPT_WORDS = 800


def word_tables(counts: DataFrame, synonyms: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """(pdf_id, table): each book's frequency table as tab-separated text, commonest words first."""
    words = frequent_words(counts, synonyms, n)
    rows = F.collect_list(F.struct("forced", (-F.col("n")).alias("_down"), "word", "n"))
    lines = F.transform(
        F.array_sort(rows), lambda r: F.concat(r["word"], F.lit("\t"), r["n"].cast("string"), F.lit("\n"))
    )
    return words.groupBy("pdf_id").agg(
        F.concat(F.lit("word\tcount\n"), F.array_join(lines, "")).alias("table")
    )


def book_terms(glossary: DataFrame) -> DataFrame:
    """(pdf_id, own): the book's terms as a list of (feature_id, terms), bounded by the catalogue."""
    entries = glossary.groupBy("pdf_id", "feature_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return entries.groupBy("pdf_id").agg(
        F.array_sort(F.collect_list(F.struct("feature_id", "terms"))).alias("own")
    )


def term_facts(
    sections: DataFrame, features: DataFrame, synonyms: DataFrame, glossary: DataFrame
) -> DataFrame:
    """What a model is told about each book to find its terms and features, as columns.

    (pdf_id, unique_tokens, table, catalogue, own, hints): number of distinct words, word table,
    the catalogue's entries, the book's terms so far, and features whose words occur. How they are
    put into words is up to the caller: see ``ask``. Word counts are made once and written.
    """
    counts = stage(word_counts(section_samples(sections)), "word_counts")
    base = word_tables(counts, synonyms).join(unique_words(counts), "pdf_id")
    # The catalogue is a small configuration table.
    entries = features.select(F.struct("feature_id", "name", "description", "synonyms").alias("entry"))
    catalogue = entries.agg(F.array_sort(F.collect_list("entry"))).scalar()
    hints = feature_candidates(counts, synonyms, glossary).groupBy("pdf_id").agg(
        F.array_sort(F.collect_set("feature_id")).alias("hints")
    )
    return (
        base.withColumn("catalogue", catalogue)
        .join(book_terms(glossary), "pdf_id", "left")
        .join(hints, "pdf_id", "left")
        .select("pdf_id", "unique_tokens", "table", "catalogue", "own", "hints")
    )


def cheatsheet_facts(
    hits: DataFrame, sections: DataFrame, detected: DataFrame, glossary: DataFrame, features: DataFrame
) -> DataFrame:
    """What a model is told to write a feature's entry, as columns.

    (pdf_id, feature_id, name, description, synonyms, questions, others, terms, excerpts): the
    catalogue entry, the book's other features, its own terms, and the best hits of the feature's
    search with the beginning of their texts. ``hits`` is (pdf_id, feature_id, rank, section_id,
    section_title, start_page, end_page, snippet).
    """
    best = hits.where(F.col("rank") <= TOOL_RESULTS)
    bodies = sections.select("section_id", truncate_words(F.col("plain_text"), EXCERPT_WORDS).alias("_body"))
    # Hits are few; sections are matched to them where they are read.
    text = F.coalesce(F.nullif("_body", F.lit("")), F.col("snippet")).alias("text")
    excerpt = F.struct("rank", "section_id", "section_title", "start_page", "end_page", text)
    found = (
        best.join(bodies, "section_id", "left")
        .groupBy("pdf_id", "feature_id")
        .agg(F.array_sort(F.collect_list(excerpt)).alias("excerpts"))
    )
    described = features.select("feature_id", "name", trim_ws(F.col("description")).alias("description"))
    other = F.struct("feature_id", "name", "description")
    per_book = detected.join(described, "feature_id").groupBy("pdf_id").agg(
        F.array_sort(F.collect_set(other)).alias("others")
    )
    own = glossary.groupBy("pdf_id", "feature_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    target = features.select("feature_id", "name", "description", "synonyms", "questions")
    return (
        found.join(target, "feature_id")
        .join(per_book, "pdf_id", "left")
        .join(own, ["pdf_id", "feature_id"], "left")
        .withColumn("others", F.filter("others", lambda o: o["feature_id"] != F.col("feature_id")))
        .select("pdf_id", "feature_id", "name", "description", "synonyms", "questions", "others", "terms", "excerpts")
    )


def ask(facts: DataFrame, wording: Column, keys: list[str], reply: Callable[[str], str], kind: str) -> DataFrame:
    """(keys…, parsed, reason): one pass over a table of facts.

    ``wording`` makes the prompt of the facts' columns, ``reply`` is the caller's model. The read
    replies are written, so a later pass, or a lost executor, never asks again.
    """
    prompts = facts.select(*keys, wording.alias("prompt"))
    raw = generate(prompts, keys, reply).withColumn("pass", F.lit(kind))
    return stage(parse_replies(raw).select(*keys, "parsed", "reason"), f"replies-{kind}")


def learn_terms(
    facts: DataFrame, stored: DataFrame, features: DataFrame, wording: Column, reply: Callable[[str], str]
) -> DataFrame:
    """(pdf_id, feature_id, term) after a glossary pass over every book.

    A book whose reply fits gets the terms of the reply that name catalogue features; a book whose
    call failed, or whose reply does not fit, keeps what it had.
    """
    read = ask(facts, wording, ["pdf_id"], reply, "glossary")
    entries = F.from_json(F.get_json_object("parsed", "$.glossary"), "array<struct<feature_id:string,terms:array<string>>>")
    said = read.where("reason is null").select("pdf_id", F.inline(entries))
    terms = said.select("pdf_id", trim_ws(F.col("feature_id")).alias("feature_id"), F.explode("terms").alias("term"))
    fresh = terms.withColumn("term", trim_ws(F.col("term"))).where("term <> ''")
    known = fresh.join(features.select("feature_id"), "feature_id", "left_semi").distinct()
    kept = stored.join(read.where("reason is null").select("pdf_id"), "pdf_id", "left_anti")
    return stage(kept.select("pdf_id", "feature_id", "term").unionByName(known.select("pdf_id", "feature_id", "term")), "glossary")


def learn_features(
    facts: DataFrame, stored: DataFrame, features: DataFrame, wording: Column, reply: Callable[[str], str]
) -> DataFrame:
    """(pdf_id, feature_id) after a features pass; as with terms, a failed book keeps what it had."""
    read = ask(facts, wording, ["pdf_id"], reply, "features")
    ids = F.from_json(F.get_json_object("parsed", "$.features"), "array<string>")
    said = read.where("reason is null").select("pdf_id", F.explode(ids).alias("feature_id"))
    named = said.withColumn("feature_id", trim_ws(F.col("feature_id")))
    known = named.join(features.select("feature_id"), "feature_id", "left_semi").distinct()
    kept = stored.join(read.where("reason is null").select("pdf_id"), "pdf_id", "left_anti")
    return stage(kept.select("pdf_id", "feature_id").unionByName(known.select("pdf_id", "feature_id")), "features")


def ask_open(
    facts: DataFrame, wording: Column, keys: list[str], reply: Callable[[str], str], kind: str,
    manifest: str, batch: int = 1_000,
) -> DataFrame:
    """(keys…, parsed): fitting answers to one pass, of which the folder ``manifest`` keeps account.

    Jobs are asked in batches by a hash of their keys, and each batch is written to the manifest before
    the next one starts. What it holds an answer for is never asked again, so a run that broke off is
    finished by the next one; calls that failed, and replies that don't fit, are asked again then.
    """
    spark = facts.sparkSession
    kinds = ", ".join(f"`{k}` {facts.schema[k].dataType.simpleString()}" for k in keys)
    path, schema = f"{manifest}/{kind}", f"{kinds}, parsed string, reason string, batch string"

    def answered() -> DataFrame:
        if not exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path).where("reason is null")

    left = facts.select(*keys, wording.alias("prompt")).join(answered().select(*keys), keys, "left_anti")
    left = stage(left, f"open-{kind}")
    batches = -(-left.count() // batch)
    for i in range(batches):
        part = left.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == i)
        raw = generate(part, keys, reply).withColumn("pass", F.lit(kind))
        read = parse_replies(raw).withColumn("reason", F.coalesce("error", "reason"))
        read.select(*keys, "parsed", "reason").write.parquet(f"{path}/batch={uuid.uuid4().hex}")
    return answered().select(*keys, "parsed").dropDuplicates(keys)


class Cheatsheet(NamedTuple):
    """entries: pdf_id, feature_id, definition, origin (stored, model, catalogue)
    citations: pdf_id, feature_id, pos, section_id, section_title, start_page, end_page
    left: pdf_id, feature_id of jobs without an entry: the model failed, or nobody could say anything
    """

    entries: DataFrame
    citations: DataFrame
    left: DataFrame


def learn_cheatsheet(
    jobs: DataFrame,
    facts: DataFrame,
    stored: DataFrame,
    stored_citations: DataFrame,
    features: DataFrame,
    sections: DataFrame,
    wording: Column,
    reply: Callable[[str], str],
    manifest: str,
    batch: int = 1_000,
) -> Cheatsheet:
    """Cheatsheets after a pass over ``jobs`` (pdf_id, feature_id), which a later run can take up: see ``ask_open``.

    ``facts`` are those of ``cheatsheet_facts``. A job without hits, or whose reply has no definition,
    gets the catalogue's description; a reply may name another feature of the catalogue, else its own is
    meant. Citations without a section id get that of the book's section of their title. New entries
    replace stored ones of their book and feature, with their citations; jobs that failed keep what there was.
    """
    both = ["pdf_id", "feature_id"]
    jobs = stage(jobs.select(*both).distinct().join(features.select("feature_id"), "feature_id", "left_semi").select(*both), "jobs")
    told = stage(facts.join(jobs, both, "left_semi"), "job-facts")
    read = stage(ask_open(told, wording, both, reply, "cheatsheet", manifest, batch), "answers")
    key = F.struct(*both).alias("job")
    cells = reply_citations(read.select(key, "parsed"), "job", "parsed").withColumnRenamed("feature_id", "_said")
    said = F.coalesce(F.nullif(trim_ws(F.col("_said")), F.lit("")), F.col("job.feature_id"))
    cells = stage(cells.withColumn("said", said), "answer-cells")
    known = broadcast_if_small(features.select(F.col("feature_id").alias("said"), trim_ws(F.col("description")).alias("_told")))
    heads = cells.groupBy("job").agg(F.min("said").alias("said"), trim_ws(F.coalesce(F.min("definition"), F.lit(""))).alias("_own"))
    heads = heads.join(known.select("said"), "said", "left_semi")
    own = broadcast_if_small(features.select("feature_id", trim_ws(F.col("description")).alias("_told")))
    silent = jobs.join(told.select(*both), both, "left_anti").select(key, F.col("feature_id").alias("said"), F.lit("").alias("_own"))
    # Without a definition an entry is the catalogue's, under the feature that was asked.
    written = heads.unionByName(silent.select("said", "job", "_own")).select(
        "job", "_own", F.when(F.col("_own") != "", F.col("said")).otherwise(F.col("job.feature_id")).alias("feature_id")
    ).join(own, "feature_id", "left")
    text = F.when(F.col("_own") != "", F.col("_own")).otherwise(F.coalesce("_told", F.lit("")))
    origin = F.when(F.col("_own") != "", F.lit("model")).otherwise(F.lit("catalogue"))
    made = written.select("job", F.col("job.pdf_id").alias("pdf_id"), "feature_id", text.alias("definition"), origin.alias("origin"))
    # Of two jobs that name one feature, its own job's entry stays.
    rank = F.struct(F.col("job.feature_id") != F.col("feature_id"), "job")
    fresh = stage(first_by(made.where("definition <> ''"), both, rank), "fresh-entries")

    cited = cells.where("pos is not null").join(fresh.select("job", *both), "job").withColumn("_pos", F.struct("pos", "section_id"))
    cited = cited.select(
        *both, "_pos", F.col("section_id").cast("string").alias("section_id"), "section_title", "start_page", "end_page"
    )
    cited = attach_section_ids(cited, sections.withColumn("section_id", F.col("section_id").cast("string")))
    numbered = cited.withColumn("pos", F.row_number().over(Window.partitionBy(*both).orderBy("_pos")) - 1).drop("_pos")
    columns = ["pos", "section_id", "section_title", "start_page", "end_page"]
    kept = stored.join(fresh.select(*both), both, "left_anti").select(*both, "definition", F.lit("stored").alias("origin"))
    kept_cited = stored_citations.join(fresh.select(*both), both, "left_anti")
    casts = {"pos": F.col("pos").cast("int"), "section_id": F.col("section_id").cast("string"),
             "start_page": F.col("start_page").cast("bigint"), "end_page": F.col("end_page").cast("bigint")}
    citations = kept_cited.withColumns(casts).select(*both, *columns).unionByName(numbered.withColumns(casts).select(*both, *columns))
    entries = kept.unionByName(fresh.select(*both, "definition", "origin"))
    left = jobs.join(fresh.select(*both).union(fresh.select("job.pdf_id", "job.feature_id")), both, "left_anti")
    return Cheatsheet(stage(entries, "cheatsheet"), stage(citations, "citations"), left)


def rebuild_plan(
    requests: DataFrame, books: DataFrame, detected: DataFrame, cheatsheet: DataFrame
) -> DataFrame:
    """(pdf_id, mode, step, feature_id) that each rebuild request runs, or step "refused".

    ``requests`` is (pdf_id, mode, feature_id), with a feature only for mode "feature"; ``books``
    is (pdf_id, indexed, has_text). Steps are glossary, features and cheatsheet; a cheatsheet that
    is already complete gives step "complete".
    """
    both = ["pdf_id", "feature_id"]
    told = requests.join(books, "pdf_id", "left").withColumn(
        "_ready", F.coalesce(F.col("indexed") & F.col("has_text"), F.lit(False))
    )
    ready, refused = told.where("_ready"), told.where("not _ready")
    found = detected.select(*both).distinct()
    known = found.select("pdf_id").distinct()
    done = cheatsheet.select(*both).distinct()

    passes = ready.where(F.col("mode").isin("glossary", "features")).select(
        "pdf_id", "mode", F.col("mode").alias("step"), F.lit(None).cast("string").alias("feature_id")
    )
    sheet = ready.where(F.col("mode").isin("cheatsheet", "missing")).select("pdf_id", "mode")
    every = sheet.where("mode = 'cheatsheet'").join(found, "pdf_id")
    missing = sheet.where("mode = 'missing'").join(found.join(done, both, "left_anti"), "pdf_id")
    runs = every.unionByName(missing).select("pdf_id", "mode", F.lit("cheatsheet").alias("step"), "feature_id")
    complete = (
        sheet.where("mode = 'missing'")
        .join(known, "pdf_id", "left_semi")
        .join(missing.select("pdf_id").distinct(), "pdf_id", "left_anti")
        .select("pdf_id", "mode", F.lit("complete").alias("step"), F.lit(None).cast("string").alias("feature_id"))
    )
    one = ready.where("mode = 'feature'").select("pdf_id", "mode", "feature_id")
    allowed = found.unionByName(done).distinct()
    single = one.join(allowed, both, "left_semi").select("pdf_id", "mode", F.lit("cheatsheet").alias("step"), "feature_id")
    denied = (
        one.join(allowed, both, "left_anti")
        .unionByName(
            sheet.join(known, "pdf_id", "left_anti").withColumn("feature_id", F.lit(None).cast("string"))
        )
        .unionByName(refused.select("pdf_id", "mode", "feature_id"))
        .select("pdf_id", "mode", F.lit("refused").alias("step"), "feature_id")
    )
    return passes.unionByName(runs).unionByName(complete).unionByName(single).unionByName(denied)
