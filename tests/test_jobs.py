"""Contents, assembly, metadata, library, replies and streaming on small fixtures."""

import datetime
import json
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passages.functions import replies as text_replies
from passages.operators import assembly, concepts, contents, fulltext, hits, library, meta, ordering, replies, reports, vocabulary
from passages.plans import imports, learnings
from passages.queries import QUERIES
from passages.queries import contents as queries_contents
from passages.queries import metas as queries_metas
from passages.sources.saved import SavedTable, read_word_tables, write_word_tables
from passages.sources.tables import spread, stage
from passages.streaming import jobs
from passages.streaming.running import running_log


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ENTRIES = "pdf_id string, pos long, title string, start_page int"
BOOKS = "pdf_id string, page_count int"
SMALL = "/root/testdata/sf0.001"
SPANS = "section_id int, pdf_id string, title string, start_page int, end_page int, sort_order int"


def test_end_pages(spark, rows):
    entries = frame(spark, [("a", 0, "Intro", 5), ("a", 1, "Combat", 12), ("a", 2, "Index", 90)], ENTRIES)
    ends = contents.page_ranges(entries, frame(spark, [("a", 100)], BOOKS))
    assert rows(ends, "sort_order", "end_page") == [(0, 11), (1, 89), (2, 100)]


def test_siblings_on_one_page(spark, rows):
    given = [("a", i, f"T{i}", 95) for i in range(4)] + [("a", 4, "Next", 96), ("a", 5, "t0 ", 95)]
    entries = contents.drop_repeats(frame(spark, given, ENTRIES))
    ends = contents.page_ranges(entries, frame(spark, [("a", 0)], BOOKS))
    assert rows(ends, "title", "end_page") == [("Next", 96)] + [(f"T{i}", 95) for i in range(4)]


def test_one_fault_refuses_a_list(spark, rows):
    given = [("a", 0, "x", 1, 2), ("a", 1, " ", 0, 0), ("b", 0, "y", 3, 2), ("c", 0, "z", 1, 99), ("d", 0, "w", 1, 1)]
    lists = frame(spark, given, "pdf_id string, pos long, title string, start_page int, end_page int")
    books = frame(spark, [("a", 9), ("b", 9), ("c", 9), ("d", 9)], BOOKS)
    judged = contents.check_sections(lists, books)
    assert rows(judged, "pdf_id", "rejected") == [("a", True), ("a", True), ("b", True), ("c", True), ("d", False)]
    stored = lists.withColumnRenamed("pos", "sort_order")
    kept = contents.replace_sections(stored.where("pdf_id = 'b'"), lists, books)
    assert rows(kept, "pdf_id", "title") == [("b", "y"), ("d", "w")]


@pytest.mark.parametrize("depth, n", [(1, 2), (2, 3), (0, 4)])
def test_bookmark_depth(spark, depth, n):
    nodes = [("a", 1, None, 0, "Chapter 1", 1), ("a", 2, 1, 0, "Section A", 2), ("a", 3, 2, 0, "Subsection A1", 3),
             ("a", 4, None, 1, "Chapter 2", 9), ("a", 5, None, 2, " ", 10)]
    tree = frame(spark, nodes, "pdf_id string, node_id int, parent_id int, pos int, title string, page int")
    flat = contents.flatten_bookmarks(tree, depth).orderBy("pos").collect()
    assert len(flat) == n and flat[-1]["title"] == "Chapter 2"
    assert imports.import_bookmarks(tree, frame(spark, [("a", 12)], BOOKS), depth).count() == n
    assert contents.bookmark_depth(-3) == 0 and contents.bookmark_depth(None, False) == 1


def test_shared_page_is_cut_at_headings(spark, rows):
    spans = [(1, "a", "Alpha  One", 1, 1, 0), (2, "a", "Beta", 1, 1, 1), (3, "a", "Gone", 1, 1, 2), (4, "a", "Long", 2, 3, 3)]
    pages = frame(spark, [("a", 1, "top\nalpha one\nx\n BETA \ny\nBeta\nz"), ("a", 2, "p"), ("a", 3, "q…")], "pdf_id string, page_no int, text string")
    texts = dict(rows(assembly.section_texts(frame(spark, spans, SPANS), pages)))
    assert texts[1] == "alpha one\nx"
    assert texts[2] == "BETA \ny\nBeta\nz"
    assert texts[3].startswith("top") and texts[4] == "p\nq..."


def test_word_table(spark):
    samples = frame(spark, [("a", "The TRAIT", "trait tests: tests, tests the the the trait benny x")], "pdf_id string, title string, plain_text string")
    synonyms = frame(spark, [("benny", "benny"), ("the", "no the")], "feature_id string, synonym string")
    counts = vocabulary.word_counts(samples)
    got = {(r["word"], r["n"], r["forced"]) for r in vocabulary.frequent_words(counts, synonyms, 1).collect()}
    assert got == {("THE", 4, False), ("BENNY", 1, True)}


LEGACY = json.dumps({
    "features": [{"feature_id": " benny "}, {"feature_id": ""}],
    "glossary": [{"feature_id": "b", "pdf_term": "Z"}, {"feature_id": "b", "pdf_term": "A "}, {"feature_id": "", "pdf_term": "x"}],
    "cheatsheet": [{"feature_id": "c", "feature_name": " C ", "section": "S", "start_page": 3}],
    "llm_glossary_skipped": True,
})
CURRENT = json.dumps({
    "features": ["b", " a", "b", ""],
    "glossary": [{"feature_id": " g ", "terms": ["Two", "one", " two ", ""]}, {"feature_id": "h", "terms": []}],
    "cheatsheet": [{"feature_id": "f", "definition": " d ", "citations": [{"section_title": "", "start_page": 0}, {"section_title": " T ", "start_page": 4}]}],
})


def test_meta_forms(spark):
    raw = frame(spark, [(1, LEGACY), (2, CURRENT), (3, "oops"), (4, "")], "pdf_id int, raw string")
    got = {r["pdf_id"]: r["m"] for r in raw.select("pdf_id", meta.parse_meta(F.col("raw")).alias("m")).collect()}
    old, new = got[1], got[2]
    assert old.features == ["benny"] and old.llm_learnings_skipped
    assert [(g.feature_id, g.terms) for g in old.glossary] == [("b", ["A", "Z"])]
    assert old.cheatsheet[0].definition == "C" and old.cheatsheet[0].citations[0].start_page == 3
    assert new.features == ["a", "b"] and not new.llm_learnings_skipped
    assert [(g.feature_id, g.terms) for g in new.glossary] == [("g", ["Two", "one"])]
    assert [c.section_title for c in new.cheatsheet[0].citations] == ["T"]
    assert got[3].features == [] and got[4].cheatsheet == []


def test_meta_rows_come_from_one_pass(spark, rows):
    raw = frame(spark, [(1, LEGACY), (2, CURRENT), (3, "oops")], "pdf_id int, raw string")
    got = meta.part_rows(raw.select("pdf_id", meta.parse_meta(F.col("raw")).alias("meta")))
    assert rows(got.select("pdf_id", "part", "feature_id", "text", "cited.section_title", "cited.start_page")) == [
        (1, "citation", "c", "", "S", 3), (1, "entry", "c", "C", None, None), (1, "feature", "benny", "", None, None),
        (1, "term", "b", "A", None, None), (1, "term", "b", "Z", None, None), (2, "citation", "f", "", "T", 4),
        (2, "entry", "f", "d", None, None), (2, "feature", "a", "", None, None), (2, "feature", "b", "", None, None),
        (2, "term", "g", "Two", None, None), (2, "term", "g", "one", None, None),
    ]
    for name in ("normalize_meta", "meta_roundtrip"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1, plan


def pieces(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_in_one_piece_are_spread(spark):
    """Many pieces of which one holds all rows, as a file with one row group gives them."""
    held = spark.range(0, 64000, 1, 16).where("id < 4000")
    assert held.rdd.getNumPartitions() >= 8 and pieces(held) == [4000]
    assert len(pieces(spread(held, "id"))) >= 8
    even = spark.range(0, 4000, 1, 8)
    assert spread(even, "id") is even
    assert spread(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("made", [queries_contents.contents_lines, queries_metas.stored_metas])
def test_heavy_lines_of_a_small_table_are_spread(spark, made):
    assert len(pieces(made(spark, SMALL))) >= 8


REPLIES = [
    ('{"features": ["a", "b"]}', ["a", "b"]),
    ('```json\n{"features": ["a"]}\n```', ["a"]),
    ('Here: {"features": ["}"]} and {"x": 1}', ["}"]),
    ('["a", "b",]', ["a", "b"]),
    ('{"features:_: ["a"]} // end', ["a"]),
    ('{"features": ["a // b", /* no */ "line\nbreak"]}', ["a // b", "line\nbreak"]),
    ("nothing to see", None),
    ("", None),
]


def test_replies(spark):
    table = frame(spark, [(i, "features", r) for i, (r, _) in enumerate(REPLIES)], "id int, pass string, raw string")
    read = replies.parse_replies(table)
    ids = F.from_json(F.get_json_object("parsed", "$.features"), "array<string>")
    got = {r["id"]: (r["x"], r["reason"]) for r in read.select("id", ids.alias("x"), "reason").collect()}
    assert [got[i][0] for i in range(len(REPLIES))] == [w for _, w in REPLIES]
    assert got[6][1] == "no fitting JSON" and got[7][1] == "empty" and got[0][1] is None
    assert text_replies.mend('{"a": "x"} // "y"') == '{"a": "x"} '


def test_reply_hook(spark):
    def answer(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    prompts = frame(spark, [(1, "hi"), (2, "bad")], "id int, prompt string")
    got = {r["id"]: (r["raw"], r["error"]) for r in replies.generate(prompts, ["id"], answer).collect()}
    assert got == {1: ("HI", None), 2: (None, "no")}


def test_library(spark, rows):
    games = frame(spark, [("g", False, 2), ("h", True, 1)], "game_id string, archived boolean, updated_at int")
    assert [r["game_id"] for r in library.games_list(games).collect()] == ["g"]
    lists = frame(spark, [("g", ["b", "a"]), ("h", ["a", "a"]), ("x", ["a"])], "game_id string, pdf_ids array<string>")
    books = frame(spark, [("a",), ("b",)], "pdf_id string")
    kept = library.attach_lists(lists, books, games)
    assert rows(kept, "game_id", "pdf_id", "sort_order") == [("g", "a", 1), ("g", "b", 0)]
    assert rows(library.deletable(frame(spark, [("a",), ("z",)], "pdf_id string"), books, kept)) == [
        ("a", "pdf is attached to 1 game(s); detach it first"), ("z", "pdf not found"),
    ]


def test_one_game_runs(spark, rows):
    log = [("a", 1, "start"), ("b", 2, "archive"), ("b", 3, "start"), ("c", 4, "archive"), ("b", 5, "stop"), ("d", 6, "start")]
    commands = frame(spark, log, "game_id string, seq int, kind string")
    states = library.game_states(library.game_marks(commands.where("seq < 6")))
    assert rows(states) == [("a", False, False), ("b", False, False), ("c", False, True)]
    assert ("d", True, False) in rows(library.game_states(library.game_marks(commands)))


def test_streams_over_several_batches(spark, tmp_path, rows):
    schema = "section_id int, pdf_id string, title string, plain_text string, seq int"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def arrive(*given):
        frame(spark, list(given), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        return jobs.index_sections(stream, log)

    arrive((1, "a", "T", "old words", 1), (2, "a", "U", "kept", 1))
    state = jobs.current(arrive((1, "a", "T", "new", 3), (1, "a", "T", "newer text here", 4)), ["section_id"])
    assert rows(state, "section_id", "plain_text", "n_words") == [(1, "newer text here", 3), (2, "kept", 1)]
    jobs.compact(spark.read.parquet(log), ["section_id"], str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 2


def test_latest_and_first(spark, rows):
    df = frame(spark, [("a", 1, "x"), ("a", 2, None), ("b", 1, "z")], "k string, seq int, v string")
    assert rows(ordering.latest_by(df, ["k"], F.col("seq"))) == [("a", 2, None), ("b", 1, "z")]
    assert rows(ordering.first_by(df, ["k"], F.col("seq"))) == [("a", 1, "x"), ("b", 1, "z")]


TEXTS = "section_id int, pdf_id string, title string, plain_text string, seq int"


def arrivals(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def arrive(*given):
        frame(spark, list(given), TEXTS).coalesce(1).write.mode("append").parquet(source)
        return jobs.index_sections(spark.readStream.schema(TEXTS).parquet(source), log)

    return arrive, log


def scores(index, asked):
    found = fulltext.score_sections(index, fulltext.query_phrases(asked)).collect()
    return sorted((r.query_id, r.section_id, r.pdf_id, r.fts_rank) for r in found)


def test_live_index_is_the_index_of_what_holds_now(spark, tmp_path):
    """Three batches, one of them out of seq order, against an index built at once from the latest texts."""
    arrive, path = arrivals(spark, tmp_path)
    arrive((1, "a", "Wild Magic", "old words of fire", 5), (2, "a", "Rules", "fire and water", 1), (3, "b", "Gone", "water water", 1))
    arrive((1, "a", "Late", "a late arrival of fire", 2), (3, "b", "Gone", "stone and wood", 2))
    log = arrive((4, "b", "New", "wild fire in the wood", 1), (2, "a", "Rules", "fire", 3), (2, "a", "Rules", "no fire", 2))
    holds = [(1, "a", "Wild Magic", "old words of fire", 5), (2, "a", "Rules", "fire", 3), (3, "b", "Gone", "stone and wood", 2), (4, "b", "New", "wild fire in the wood", 1)]
    asked = frame(spark, [(0, "fire"), (1, "water"), (2, "wild fi"), (3, "wood stone late"), (4, "wild-fire")], "query_id int, query_text string")
    want = scores(fulltext.build_text_index(frame(spark, holds, TEXTS)), asked)
    assert want and scores(jobs.open_index(log, path), asked) == want
    state = {r.section_id: (r.plain_text, r.seq) for r in jobs.current_index(log).collect()}
    assert state == {s: (text, seq) for s, _, _, text, seq in holds}
    folded = str(tmp_path / "folded")
    jobs.compact_index(log, folded)
    assert scores(jobs.open_index(jobs.read_log(spark, folded, log), folded), asked) == want
    # A batch that is written again leaves the same index.
    segment = spark.read.parquet(f"{path}/batch_id=1")
    jobs._write_segment(segment, path, 1)
    assert scores(jobs.open_index(log, path), asked) == want


def test_texts_that_come_once_stay_where_they_are(spark, tmp_path, rows):
    once = frame(spark, [(1, "a", "One", "fire", 1), (2, "a", "Two", "water", 1)], TEXTS)
    assert "Exchange" not in jobs._last_texts(once)._jdf.queryExecution().toString()
    odd = frame(spark, [(1, "a", "One", "fire", 1), (2, "a", "Two", "water", 1), (2, "a", "Two", "ice", 3), (3, "a", "T", "x", None), (None, "a", "N", "y", 1), (None, "a", "N", "z", 2)], TEXTS)
    assert rows(jobs._last_texts(odd)) == rows(ordering.latest_by(odd, ["section_id"], F.col("seq")))
    arrive, path = arrivals(spark, tmp_path)
    index = jobs.open_index(arrive((1, "a", "One", "fire", 1), (2, "a", "Two", "water", 1)), path)
    for held in (index.cells, index.entries):
        plan = held._jdf.queryExecution().sparkPlan().toString()
        assert held.count() == 2 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_empty_live_index(spark, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [], TEXTS).write.parquet(source)
    path = str(tmp_path / "log")
    log = jobs.index_sections(spark.readStream.schema(TEXTS).parquet(source), path)
    asked = frame(spark, [(0, "fire")], "query_id int, query_text string")
    assert scores(jobs.open_index(log, path), asked) == []


def test_chat_state_ends(spark, tmp_path):
    """Finds delivered twice count once, late ones are left out, and old ones are forgotten."""
    schema = "conv_id int, section_id string, prio int, at timestamp"
    source = str(tmp_path / "in")
    at = lambda minute: datetime.datetime(2026, 1, 1, 10, minute)

    def arrive(*given):
        frame(spark, list(given), schema).coalesce(1).write.mode("append").parquet(source)
        finds = jobs.new_finds(spark.readStream.schema(schema).parquet(source), "5 minutes")
        stream = finds.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        run = stream.outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        return run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    first = arrive(*[(1, f"s{i}", i, at(0)) for i in range(20)], (1, "s0", 0, at(0)))
    again = arrive((1, "s1", 1, at(0)), (2, "new", 1, at(1)), (1, "far", 9, at(40)))
    last = arrive((1, "s2", 2, at(0)), (3, "x", 1, at(41)))
    assert first == 20 and again < 5 and last < 5
    got = [(r.conv_id, r.section_id) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted([*[(1, f"s{i}") for i in range(20)], (2, "new"), (1, "far"), (3, "x")])


def test_last_message_over_batches(spark, tmp_path, rows):
    schema = "conv_id int, turn int, role string, text string"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def arrive(*given):
        frame(spark, list(given), schema).coalesce(1).write.mode("append").parquet(source)
        return jobs.message_log(spark.readStream.schema(schema).parquet(source), log)

    arrive((1, 3, "user", "third"), (1, 4, "assistant", "no"), (2, 1, "user", "one"))
    found = arrive((1, 1, "user", "first"), (2, 2, "user", " \n"), (3, 1, "system", "x"))
    assert rows(jobs.current(found, ["conv_id"], F.col("turn")), "conv_id", "message") == [(1, "third"), (2, "one")]


def test_saves_touch_their_own_groups_only(spark, tmp_path, rows):
    saved = SavedTable(str(tmp_path / "saved"), "book", 8)
    schema = "book string, n bigint, word string"
    saved.create(frame(spark, [(f"b{i}", n, "old") for i in range(40) for n in range(3)], schema))
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "saved").rglob("*.parquet")}
    before = files()
    fresh = frame(spark, [("b1", 0, "new"), ("b1", 1, "new"), ("b99", 0, "new")], schema)
    for _ in range(2):  # a save that is run again changes nothing
        saved.save(fresh, frame(spark, [("b2",)], "book string"))
        got = rows(saved.read(spark, schema))
        want = [(f"b{i}", n, "old") for i in range(40) for n in range(3) if i not in (1, 2)]
        assert got == sorted([*want, ("b1", 0, "new"), ("b1", 1, "new"), ("b99", 0, "new")], key=repr)
    untouched = {f for f in before if f in files()}
    folders = {f.parent.name for f in before}
    assert len(folders) == 8 and len({f.parent.name for f in untouched}) >= 5
    assert all(files()[f] == before[f] for f in untouched)
    saved.save(frame(spark, [], schema), saved.read(spark, schema).select("book"))
    assert rows(saved.read(spark, schema)) == []
    saved.save(fresh)
    assert len(rows(saved.read(spark, schema))) == 3


def test_word_tables_as_text(spark, tmp_path):
    words = frame(spark, [("a/b", "TRAIT", 3, False), ("a/b", "BENNY", 9, True), ("a/b", "ÄRA", 7, False), ("c", "x2", 1, False)],
                  "pdf_id string, word string, n bigint, forced boolean")
    write_word_tables(words, str(tmp_path / "tsv"))
    texts = {f.parent.name: f.read_text() for f in (tmp_path / "tsv").rglob("*.csv")}
    assert len(texts) == 2 and "word\tcount\nÄRA\t7\nTRAIT\t3\nBENNY\t9\n" in texts.values()
    got = {tuple(r) for r in read_word_tables(spark, str(tmp_path / "tsv")).collect()}
    assert got == {("a/b", "TRAIT", 3), ("a/b", "BENNY", 9), ("a/b", "ÄRA", 7), ("c", "x2", 1)}


def cheatsheet_inputs(spark):
    features = frame(spark, [(f, f.upper(), f" About {f} ", ["q"], ["s"]) for f in ("f", "g", "h")] + [("mute", "M", " ", [], [])],
                     "feature_id string, name string, description string, questions array<string>, synonyms array<string>")
    excerpt = "array<struct<rank:int,section_id:string,section_title:string,start_page:int,end_page:int,text:string>>"
    facts = frame(spark, [(p, f, [(1, "s1", "Combat", 1, 2, "text")]) for p in ("a", "b") for f in ("f", "g", "mute")],
                  f"pdf_id string, feature_id string, excerpts {excerpt}")
    jobs_ = frame(spark, [(p, f) for p in ("a", "b") for f in ("f", "g", "h", "mute", "unknown")], "pdf_id string, feature_id string")
    stored = frame(spark, [("a", "f", "old"), ("a", "x", "kept")], "pdf_id string, feature_id string, definition string")
    cited = frame(spark, [("a", "f", 0, "s9", "Old", 1, 1), ("a", "x", 0, "s8", "X", 2, 2)],
                  "pdf_id string, feature_id string, pos int, section_id string, section_title string, start_page int, end_page int")
    sections = frame(spark, [("s1", "a", " combat", 0), ("s2", "a", "Combat", 3), ("s3", "b", "Magic", 0)],
                     "section_id string, pdf_id string, title string, sort_order int")
    return jobs_, facts, stored, cited, features, sections


def test_cheatsheet_pass_is_taken_up(spark, tmp_path):
    """A run that breaks off half-way is finished by the next one, which asks only what is open."""
    asked = tmp_path / "asked"
    asked.mkdir()
    broken = tmp_path / "broken"
    broken.touch()

    def reply(prompt):
        if broken.exists() and len(list(asked.iterdir())) >= 3:
            raise SystemExit("the worker is lost")
        (asked / f"{prompt}-{uuid.uuid4().hex}").touch()
        book, feature = prompt.split("|")
        if prompt == "b|g":
            raise TimeoutError("no answer")
        title = "Combat" if book == "a" else "None such"
        return json.dumps({"feature_id": None, "definition": "" if feature == "mute" else f" {prompt} ", "citations": [{"section_title": title}]})

    def run():
        return learnings.learn_cheatsheet(
            *cheatsheet_inputs(spark), F.concat_ws("|", "pdf_id", "feature_id"), reply, str(tmp_path / "manifest"), batch=1
        )

    counts = lambda: Counter(f.name.rsplit("-", 1)[0] for f in asked.iterdir())
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a lost worker
        run()
    written = spark.read.parquet(str(tmp_path / "manifest" / "cheatsheet")).where("reason is null").collect()
    answered = {f"{r.pdf_id}|{r.feature_id}" for r in written}
    assert 0 < len(answered) < 6
    broken.unlink()
    made = run()
    assert all(n == 1 for p, n in counts().items() if p in answered)
    assert {p for p in counts()} == {f"{b}|{f}" for b in "ab" for f in ("f", "g", "mute")}
    entries = {(r.pdf_id, r.feature_id): (r.definition, r.origin) for r in made.entries.collect()}
    assert entries == {
        ("a", "f"): ("a|f", "model"), ("a", "g"): ("a|g", "model"), ("a", "h"): ("About h", "catalogue"), ("a", "x"): ("kept", "stored"),
        ("b", "f"): ("b|f", "model"), ("b", "h"): ("About h", "catalogue"),
    }
    cited = sorted((r.pdf_id, r.feature_id, r.pos, r.section_id, r.section_title) for r in made.citations.collect())
    assert cited == [("a", "f", 0, "s2", "Combat"), ("a", "g", 0, "s2", "Combat"), ("a", "x", 0, "s8", "X"), ("b", "f", 0, None, "None such")]
    left = sorted((r.pdf_id, r.feature_id) for r in made.left.collect())
    assert left == [("a", "mute"), ("b", "g"), ("b", "mute")]
    before = counts()
    run()
    assert {p for p, n in counts().items() if n > before[p]} == {"b|g"}


def test_citations_are_cut_before_questions_meet_them(spark):
    """With a limit the first sections of all are given, and no feature hands on more than the limit."""
    rng = random.Random(5)
    features = [f"f{i}" for i in range(4)]
    cited = [(f"b{b}", f, p, rng.randint(0, 60), "", 0, 0) for b in range(3) for f in features for p in range(30)]
    citations = frame(spark, cited, "pdf_id string, feature_id string, pos int, section_id int, section_title string, start_page int, end_page int")
    sections = frame(spark, [(i, f"b{i % 3}", "t", 1, 1, " " if i % 7 == 0 else f"text {i}") for i in range(61)],
                     "section_id int, pdf_id string, title string, start_page int, end_page int, plain_text string")
    sheet = frame(spark, [(f"b{b}", f, "d" if (b, f) != (1, "f2") else "") for b in range(3) for f in features], "pdf_id string, feature_id string, definition string")
    attached = frame(spark, [("g", "b2", 0), ("g", "b0", 1), ("h", "b1", 0)], "game_id string, pdf_id string, sort_order int")
    asked = frame(spark, [(i, "gh"[i % 2]) for i in range(12)], "query_id int, game_id string")
    matched = frame(spark, [(i, features[i % 4]) for i in range(9)] + [(3, "f0")], "query_id int, feature_id string")
    given = (asked, matched, sheet, citations, sections, attached)
    want = {}
    whole = hits.citation_hits(*given).collect()
    for r in sorted(whole, key=lambda r: (r.pdf_order, r.feature_id, r.pos, r.section_id)):
        want.setdefault(r.query_id, []).append((r.section_id, r.feature_id, r.snippet))
    for limit in (1, 5):
        got = {}
        for r in sorted(hits.citation_hits(*given, limit).collect(), key=lambda r: (r.pdf_order, r.feature_id, r.pos, r.section_id)):
            got.setdefault(r.query_id, []).append((r.section_id, r.feature_id, r.snippet))
        assert got == {q: rows[:limit] for q, rows in want.items()}
        assert sum(map(len, got.values())) <= 12 * limit < len(whole)


def cited_library(spark):
    """Two games of three books, four features with entries of 30 citations each, and twelve questions."""
    rng = random.Random(6)
    names = [f"f{i}" for i in range(4)]
    cells = "pdf_id string, feature_id string, pos int, section_id int, section_title string, start_page int, end_page int"
    cited = [(f"b{b}", f, p, rng.randint(0, 60), f"T{p}é", p, p % 3) for b in range(3) for f in names for p in range(30)]
    entries = [(f"b{b}", f, f"about {f}\n" if (b, f) != (1, "f2") else "") for b in range(3) for f in names]
    attached = [("g", "b2", "Two", 0), ("g", "b0", "", 0), ("h", "b1", "One", 1)]
    return {
        "asked": frame(spark, [(i, "gh"[i % 2]) for i in range(12)], "query_id int, game_id string"),
        "matched": frame(spark, [(i, names[i % 4]) for i in range(9)] + [(3, "f0")], "query_id int, feature_id string"),
        "sheet": frame(spark, entries, "pdf_id string, feature_id string, definition string"),
        "citations": frame(spark, cited, cells),
        "features": frame(spark, [("f0", "Name"), ("f1", " ")], "feature_id string, name string"),
        "attached": frame(spark, attached, "game_id string, pdf_id string, pdf_title string, sort_order int"),
    }


def test_cheatsheet_digests_are_those_of_the_blocks(spark):
    given = cited_library(spark)
    parts = [given[k] for k in ("attached", "sheet", "citations", "features")]
    shown = hits.feature_filter(given["asked"], given["matched"], given["sheet"].select("feature_id").distinct())
    shown = shown.join(given["asked"], "query_id")
    blocks = reports.cheatsheet_blocks(shown, given["matched"], reports.cheatsheet_entries(*parts))
    want = {r.query_id: r.digest for r in blocks.select("query_id", F.md5("block").alias("digest")).collect()}
    digests = reports.cheatsheet_digests(shown, given["matched"], reports.cheatsheet_lines(*parts))
    assert {r.query_id: r.digest for r in digests.collect()} == want
    # Query 9 is shown all of game h; query 5 only f1 of it, query 2 is of the other game; book b1 has no f2.
    assert len(want) == 12 and len(set(want.values())) > 4


def test_pairs_of_question_and_citation_are_not_moved(spark, rows, monkeypatch):
    given, written = cited_library(spark), []
    monkeypatch.setattr(hits, "stage", lambda df, name: written.append(df.columns) or stage(df, name))
    sections = frame(spark, [(i, f"b{i % 3}", "t", 1, 1, f"text {i}") for i in range(61)],
                     "section_id int, pdf_id string, title string, start_page int, end_page int, plain_text string")
    found = hits.citation_hits(*[given[k] for k in ("asked", "matched", "sheet", "citations")], sections, given["attached"])
    assert written and not any({"query_id", "section_id"} <= set(columns) for columns in written)
    pairs = concepts.cited_sections(given["matched"], given["citations"])
    for df in (found, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*query_id", plan), plan
        assert len(set(rows(df, "query_id", "section_id"))) == df.count()
    both = given["matched"].join(given["citations"], "feature_id").select("query_id", "section_id").distinct()
    assert rows(pairs) == rows(both)


def test_running_game_is_kept_over_restarts(spark, tmp_path):
    """Commands in any order, in several runs that each go on from the checkpoint."""
    schema = "library_id string, game_id bigint, seq bigint, kind string"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")

    def arrive(*given):
        frame(spark, list(given), schema).coalesce(1).write.mode("append").parquet(source)
        found = running_log(spark.readStream.schema(schema).parquet(source), log)
        return {r.library_id: (r.seq, r.game_id) for r in jobs.current(found, ["library_id"]).collect()}

    assert arrive(("a", 1, 1, "start"), ("a", 2, 3, "start"), ("b", 1, 2, "stop"), ("a", 1, 4, "stop")) == {"a": (3, 2), "b": (None, None)}
    assert arrive(("a", 3, 2, "start"), ("b", 1, 1, "start"), ("a", 2, 5, "look")) == {"a": (3, 2), "b": (1, None)}
    assert arrive(("a", 2, 6, "archive"), ("c", 7, 1, "start"), ("b", 1, 9, "start")) == {"a": (3, None), "b": (9, 1), "c": (1, 7)}
    assert arrive(("a", 3, 8, "stop"), ("a", 3, 7, "start")) == {"a": (7, None), "b": (9, 1), "c": (1, 7)}


def test_stream_of_a_table_in_several_files(spark, rows, tmp_path):
    for table, n in (("turns", 7), ("turn", 2)):
        spark.range(n).repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    log = jobs.run_to_log(jobs.read_changes(spark, str(tmp_path), "turns"), jobs.new_log(spark, "turns"))
    assert rows(log, "id") == [(i,) for i in range(7)]
