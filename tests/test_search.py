"""Ranking, search, concepts and neighbours on small fixtures."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages import session
from passages.operators import concepts, embedding, fulltext, hits, scoring, tokens
from passages.operators.ordering import dense_position, int_chunk, next_in_group
from passages.plans import search
from passages.queries import bindings
from passages.sources.tables import read_table, stage, usable_features

SECTIONS = [
    ("s1", "core", "Combat Rules", 1, 2, "A wild attack in combat adds two. Combat is deadly."),
    ("s2", "core", "Magic Rules", 3, 4, "Spells and 2D6-2 damage of dark magic."),
    ("s3", "core", "Attributes", 5, 5, "Attributes are traits of a character."),
    ("s4", "other", "Attributes", 1, 1, "Other attributes and combatants."),
    ("s5", "core", "Dark Magic", 6, 6, "Those who raise the dead."),
]
SCHEMA = "section_id string, pdf_id string, title string, start_page int, end_page int, plain_text string"


@pytest.fixture
def sections(spark):
    return spark.createDataFrame(SECTIONS, SCHEMA)


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query_text string")


def sqlite_ranks(query, rows=SECTIONS):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, content, id UNINDEXED)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(r[2], r[5], r[0]) for r in rows])
    match = " OR ".join('"' + w.replace('"', "") + '"*' for w in query.split())
    return dict(con.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (match,)))


@pytest.mark.parametrize(
    "query", ["wild attack combat", "2D6-2", "attr", "combat combat dark", "the a of", 'say "magic"', "zzz"]
)
@pytest.mark.parametrize("bound", [session.BROADCAST_ROWS, 0])
def test_bm25_like_sqlite(spark, sections, query, bound, monkeypatch):
    """Same scores as an FTS5 table, with broadcast phrases and with the shuffled join."""
    monkeypatch.setattr(fulltext, "BROADCAST_ROWS", bound)
    phrases = fulltext.query_phrases(ask(spark, query))
    got = {
        r["section_id"]: r["fts_rank"]
        for r in fulltext.score_sections(fulltext.build_text_index(sections), phrases).collect()
    }
    wanted = sqlite_ranks(query)
    assert got.keys() == wanted.keys()
    for key, rank in wanted.items():
        assert got[key] == pytest.approx(rank, abs=1e-8)


def test_bm25_like_sqlite_on_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select(
        F.col("doc_id").cast("string"), "source", F.substring_index("text", "\n", 1), F.lit(1), F.lit(1), "text"
    )
    local = [tuple(r) for r in rows.collect()]
    query = "that on bles 2 ére"
    phrases = fulltext.query_phrases(ask(spark, query))
    terms = fulltext.build_text_index(spark.createDataFrame(local, SCHEMA))
    got = {r["section_id"]: r["fts_rank"] for r in fulltext.score_sections(terms, phrases).collect()}
    wanted = sqlite_ranks(query, local)
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-8) for k, v in wanted.items())


def corpus(spark, rng, n_sections, n_words=60):
    """Sections of words whose frequency falls with their number, so that some are everywhere and some nowhere else."""
    words = [f"w{i:03d}" for i in range(n_words)]
    shares = 1 / np.arange(1, n_words + 1)
    rows = []
    for i in range(n_sections):
        text = rng.choice(words, size=rng.integers(1, 60), p=shares / shares.sum())
        rows.append((f"s{i:04d}", f"b{i % 5}", str(text[0]), 1, 1, " ".join(text)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("limit, first_hits", [(3, 10), (10, 10_000), (10, 1), (500, 10)])
def test_best_sections_are_those_of_all_scores(spark, limit, first_hits, monkeypatch):
    """Pruned search equals the full scores, cut at the limit, for all scopes."""
    rng = np.random.default_rng(limit)
    index = fulltext.build_text_index(corpus(spark, rng, 300))
    asked = [" ".join(rng.choice([f"w{i:03d}" for i in range(60)] + ["w", "w0", "w01", "none"], size=rng.integers(1, 12))) for _ in range(25)]
    asked += ["w000", "w059", "w000 w059 w000", "w-059"]
    phrases = stage(fulltext.query_phrases(ask(spark, *asked)), "phrases")
    one = ask(spark, *asked).select("query_id", F.concat(F.lit("g"), F.pmod("query_id", F.lit(2))).alias("scope_id"))
    books = spark.createDataFrame([("g0", "b0"), ("g0", "b1"), ("g1", "b1"), ("g1", "b4")], "scope_id string, pdf_id string")
    monkeypatch.setattr(fulltext.contenders, "__defaults__", (limit, first_hits))
    monkeypatch.setattr(fulltext, "SCORE_ALL", 0)
    for scopes in ((None, None), (one, books), (one.select("query_id", F.concat(F.lit("b"), F.pmod("query_id", F.lit(5))).alias("scope_id")), None)):
        full = fulltext.score_sections(index, phrases, *scopes).collect()
        want = {}
        for r in sorted(full, key=lambda r: (r.fts_rank, r.section_id)):
            want.setdefault(r.query_id, []).append((r.section_id, r.fts_rank))
        got = {}
        for r in sorted(fulltext.best_sections(index, phrases, *scopes, limit).collect(), key=lambda r: r.fts_pos):
            got.setdefault(r.query_id, []).append((r.section_id, r.fts_rank))
        assert got == {q: rows[:limit] for q, rows in want.items()}


def test_shared_phrases_are_summed_once(spark):
    """Queries widened alike share bundles, some lack a phrase or ask it twice; scores are those of single phrases."""
    rng = np.random.default_rng(3)
    index = fulltext.build_text_index(corpus(spark, rng, 300))
    shared = [f"w{i:03d}" for i in range(10, 40)]
    asked = [" ".join([f"w{i % 7:03d}", *(w for w in shared if w != f"w{i + 9:03d}"), *(["w021"] if i % 5 == 0 else [])]) for i in range(20)]
    phrases = stage(fulltext.query_phrases(ask(spark, *asked)), "phrases")
    one = ask(spark, *asked).select("query_id", F.lit("g0").alias("scope_id"))
    books = spark.createDataFrame([("g0", "b0"), ("g0", "b1")], "scope_id string, pdf_id string")
    hits = stage(fulltext.phrase_hits(index, phrases), "hits")
    for scopes in ((None, None), (one, books)):
        _, placed, weights = fulltext._weights(index, hits, phrases, *scopes)
        bundles = fulltext.bundle_phrases(stage(weights, "weights"), index.n_sections)
        assert bundles.askers.count() < weights.count() / 3
        want = {(r.query_id, r.section_id): round(r.score, 9) for r in fulltext._summed(placed, weights).collect()}
        parts = fulltext._weights(index, hits, phrases, *scopes)[0]
        got = fulltext._summed_by_bundle(parts, bundles, scopes[1]).collect()
        assert {(r.query_id, r.section_id): round(r.score, 9) for r in got} == want


def test_few_sections_are_scored_whole(spark):
    """Sections that only hold words found everywhere are not scored when rare words decide."""
    rng = np.random.default_rng(9)
    index = fulltext.build_text_index(corpus(spark, rng, 1_000))
    asked = [f"w000 w001 w002 w{i:03d}" for i in range(40, 60)]
    phrases = stage(fulltext.query_phrases(ask(spark, *asked)), "phrases")
    hits = stage(fulltext.phrase_hits(index, phrases), "hits")
    scored = fulltext.contenders(*fulltext._weights(index, hits, phrases, None, None), 5, 500).count()
    met = fulltext.score_sections(index, phrases).count()
    assert met > 15_000 and scored < met / 10


def test_search_reads_the_ranges_of_its_terms(spark, sections):
    rng = np.random.default_rng(4)
    index = fulltext.build_text_index(corpus(spark, rng, 400), 8)
    assert len(index.ranges) > 2
    few = spark.createDataFrame([("w059",)], "term string")
    read = fulltext.asked_postings(index, few)
    plan = read._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [" in scan and "part" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(term,w059)" in scan
    every = fulltext.asked_postings(index, index.vocabulary)
    assert read.select("part").distinct().count() < every.select("part").distinct().count() == len(index.ranges)
    assert read.count() == index.postings.where("term = 'w059'").count()
    assert fulltext.asked_postings(index, few.limit(0)).count() == 0
    hot = index.postings.groupBy("term").agg(F.countDistinct("part").alias("n")).where("n > 1").count()
    assert hot, "a frequent term lies in several ranges"


def hybrid(spark, sections, texts, rewrites=None, limit=10, glossary=(), citations=()):
    asked = ask(spark, *texts).withColumn("game_id", F.lit("g"))
    attached = spark.createDataFrame([("g", "core", "Core", 0)], "game_id string, pdf_id string, pdf_title string, sort_order int")
    synonyms = spark.createDataFrame([("magic", "spell")], "feature_id string, synonym string")
    terms = spark.createDataFrame(list(glossary), "pdf_id string, feature_id string, term string")
    cited = spark.createDataFrame(list(citations), "pdf_id string, feature_id string, section_id string")
    if rewrites:
        rewrites = spark.createDataFrame(rewrites, "query_id int, raw string")
    found = search.hybrid_search(sections, asked, attached, synonyms, terms, cited, rewrites, limit)
    return found.orderBy("query_id", "rank").collect()


def test_hybrid_order_scope_and_limit(spark, sections):
    found = hybrid(spark, sections, ["wild attack combat", "attributes", " "])
    first = [r for r in found if r["query_id"] == 0]
    assert first[0]["section_id"] == "s1" and first[0]["rank"] == 1
    assert {r["section_id"] for r in found if r["query_id"] == 1} == {"s3"}
    assert not [r for r in found if r["query_id"] == 2]
    assert len(hybrid(spark, sections, ["magic rules dark attributes"], limit=2)) == 2


def test_rewrites_and_expansion(spark, sections):
    assert hybrid(spark, sections, ["necromancer"]) == []
    rewritten = hybrid(spark, sections, ["necromancer"], rewrites=[(0, '"Dark Magic"')])
    assert {"s5", "s2"} <= {r["section_id"] for r in rewritten} and rewritten[0]["query_rewritten"]
    own = [("core", "magic", "dark")]
    expanded = hybrid(spark, sections, ["a spell, please"], glossary=own)
    assert "s5" in {r["section_id"] for r in expanded}


def test_citation_bonus(spark, sections):
    own, cited = [("core", "magic", "magic")], [("core", "magic", "s5")]
    plain = {r["section_id"]: r["adjusted_score"] for r in hybrid(spark, sections, ["magic"], glossary=own)}
    lifted = {
        r["section_id"]: r["adjusted_score"]
        for r in hybrid(spark, sections, ["magic"], glossary=own, citations=cited)
    }
    assert lifted["s5"] - plain["s5"] == pytest.approx(0.08, abs=1e-6)
    assert lifted["s2"] == plain["s2"]


@pytest.mark.parametrize("bound, sent", [(concepts.INTERSECT_ROWS, 1000), (-1, 1000), (-1, 0)])
def test_concepts(spark, rows, bound, sent, monkeypatch):
    monkeypatch.setattr(concepts, "INTERSECT_ROWS", bound)
    monkeypatch.setattr(concepts, "BROADCAST_ROWS", sent)
    texts = ask(spark, "A skill check!", "skill checks", "skill-check", "[x] save now", "my Tests")
    synonyms = spark.createDataFrame(
        [("skill_check", "skill check"), ("save", "[x] save"), ("odd", "!")], "feature_id string, synonym string"
    )
    terms = spark.createDataFrame([("trait", "est"), ("none", "")], "feature_id string, term string")
    found = concepts.matched_features(texts, "query_id", "query_text", synonyms, terms)
    assert rows(found) == [(0, "skill_check"), (3, "save"), (4, "trait")]


def test_ten_thousand_phrases_without_a_shuffle(spark):
    """Texts meet a large catalogue where they are; what goes on is what was found."""
    phrases = spark.range(10_000).select(
        F.concat(F.lit("f"), F.pmod("id", F.lit(50))).alias("feature_id"), F.concat(F.lit("word"), "id", F.lit(" next"), "id").alias("synonym")
    )
    texts = spark.range(300).select("id", F.concat(F.lit("so word"), "id", F.lit(" next"), "id", F.lit(" and word"), F.col("id") + 1).alias("text"))
    found = concepts.phrase_matches(texts, "id", "text", phrases)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()
    assert sorted(r.id for r in found.collect()) == list(range(300))


def test_last_catalogue_row_wins(spark, rows):
    given = [(0, "a", "x", "", [], ["1"]), (1, "a", "y", "", [], ["2"]), (2, "", "z", "", [], [])]
    features = spark.createDataFrame(given, f"pos int, {bindings.CATALOGUE_SCHEMA}")
    assert rows(usable_features(features), "feature_id", "name") == [("a", "y")]


@pytest.mark.parametrize("block", [2, 1024])
def test_nearest_is_exact(spark, block):
    rng = np.random.default_rng(1)
    vectors, asked = rng.normal(size=(60, 8)), rng.normal(size=(5, 8))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "key int, embedding array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["key"] for r in embedding.nearest(left.repartition(4), right, 3, block).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q, v in enumerate(asked):
        order = np.argsort(-(unit @ (v / np.linalg.norm(v))))
        assert [got[q, r + 1] for r in range(3)] == order[:3].tolist()
    with pytest.raises(ValueError):
        embedding.nearest(left, right, 0)


def test_nearest_with_ties_blanks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SENT", 1)
    held = [(i, [float(i % 3), 1.0]) for i in range(20)] + [(30, [0.0, 0.0]), (31, [1.0]), (32, []), (33, None)]
    asked = [(0, [1.0, 1.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.5]), (3, [2.0])]
    left = spark.createDataFrame(held, "key int, embedding array<double>")
    right = spark.createDataFrame(asked, "query_id int, embedding array<double>")

    def similar(x, y):
        x = x if x and len(x) == len(y) else [0.0] * len(y)
        length = np.linalg.norm(x) * np.linalg.norm(y)
        return round(float(np.dot(x, y) / length), 9) if length else 0.0

    got = embedding.nearest(left, right, 9, 4).collect()
    for q, y in asked:
        want = sorted((-similar(x, y), key) for key, x in held)[:9]
        assert [(-r.similarity, r.key) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_far_blocks_are_skipped():
    rng = np.random.default_rng(3)
    centres = embedding._unit(rng.normal(size=(20, 16)))
    asked = embedding._unit(centres[:5] + 0.02 * rng.normal(size=(5, 16)))
    best = embedding.BestNeighbours(list(range(5)), asked, 3)
    for c in centres:
        points = embedding._unit(c + 0.02 * rng.normal(size=(50, 16)))
        middle = embedding._unit(points.sum(axis=0, keepdims=True))[0]
        best.add(list(range(50)), points, middle, float(np.arccos(np.clip(points @ middle, -1, 1)).max()))
    assert best.skipped > 3 * best.multiplied


def test_merge_keeps_primary_first(spark):
    listed = [(1, 0, 0, "a"), (1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, ""), (1, 1, 3, "c")]
    df = spark.createDataFrame(listed, "query_id int, prio int, pos int, section_id string")
    merged = hits.merge_hits(df, ["query_id"], 2).orderBy("spot").collect()
    assert [(r["section_id"], r["prio"]) for r in merged] == [("a", 0), ("b", 1)]
    assert hits.merge_hits(df, ["query_id"]).count() == 3


def test_dense_position_over_many_pieces(spark):
    df = spark.range(0, 1000).select((F.col("id") * 3).alias("n"), F.lit("hot").alias("g"))
    placed = dense_position(df, ["g"], {"_p": int_chunk("n", 64)}, ["n"], "at")
    assert placed.where("at <> n / 3").count() == 0 and placed.count() == 1000


def test_next_over_many_pieces(spark):
    df = spark.range(0, 500).select((F.col("id") * 37).alias("n"), F.lit("hot").alias("g"))
    found = next_in_group(df, ["g"], "n", "after", 64).orderBy("n").collect()
    assert [r["after"] for r in found] == [n * 37 for n in range(1, 500)] + [None]


def test_snippets_read_flat_texts(spark):
    """The join of sections and terms carries texts that are flat already; none is made flat per pair."""
    from conftest import SMALL

    from passages.queries import QUERIES

    assert "plain_text" not in QUERIES["snippet"](spark, SMALL)._jdf.queryExecution().toString()


def scopes_of(spark, asked):
    one = ask(spark, *asked).select("query_id", F.concat(F.lit("g"), F.pmod("query_id", F.lit(2))).alias("scope_id"))
    books = spark.createDataFrame([("g0", "b0"), ("g0", "b1"), ("g1", "b1"), ("g1", "b4")], "scope_id string, pdf_id string")
    by_book = one.select("query_id", F.concat(F.lit("b"), F.pmod("query_id", F.lit(5))).alias("scope_id"))
    return (None, None), (one, books), (by_book, None)


@pytest.mark.parametrize("limit, cells", [(3, 1 << 20), (40, 64)])
def test_matrix_scores_are_those_of_all_rows(spark, limit, cells, monkeypatch):
    """Sections are scored where they lie, in blocks of any size, and summed and pruned rows never come up."""
    rng = np.random.default_rng(limit)
    index = fulltext.build_text_index(corpus(spark, rng, 200).unionByName(corpus(spark, np.random.default_rng(limit), 50).withColumn("section_id", F.concat(F.lit("copy"), "section_id"))))
    asked = [" ".join(rng.choice([f"w{i:03d}" for i in range(60)] + ["w", "w0", "none"], size=rng.integers(1, 12))) for _ in range(20)]
    asked += ["w000", "w059 w059", "none", "w-059"]
    phrases = stage(fulltext.query_phrases(ask(spark, *asked)), "phrases")
    monkeypatch.setattr(scoring, "MATRIX", cells)
    monkeypatch.setattr(fulltext, "bundle_phrases", None)
    for scopes in scopes_of(spark, asked):
        want: dict = {}
        for r in sorted(fulltext.score_sections(index, phrases, *scopes).collect(), key=lambda r: (r.fts_rank, r.section_id)):
            want.setdefault(r.query_id, []).append((r.section_id, r.pdf_id, r.fts_rank))
        got: dict = {}
        for r in sorted(fulltext.best_sections(index, phrases, *scopes, limit).collect(), key=lambda r: r.fts_pos):
            got.setdefault(r.query_id, []).append((r.section_id, r.pdf_id, r.fts_rank))
        assert got == {q: own[:limit] for q, own in want.items()}


def test_phrases_are_counted_in_whole_sections(spark):
    """Terms that begin with a phrase are counted where their section lies, as the postings say it."""
    rng = np.random.default_rng(5)
    index = fulltext.build_text_index(corpus(spark, rng, 80))
    phrases = stage(fulltext.query_phrases(ask(spark, "w w00 w01 none w059", "w-000 w000-w001")), "phrases")
    one = phrases.where("n_words = 1").select("phrase").distinct().toArrow()["phrase"].combine_chunks()
    terms = F.transform("entries", lambda e: F.struct(e["term"].alias("term"), F.size(e["places"]).alias("n")))
    rows = tokens.from_tokens(index.entries.select("section_id", terms.alias("t")), {"hits": ("t", tokens.HITS, tokens.prefix_counts(one))}, 500)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    want = {(r.section_id, r.phrase, r.f) for r in fulltext.phrase_hits(index, phrases).collect()}
    listed = rows.select("section_id", F.inline("hits")).collect()
    assert {tuple(r) for r in listed} == {w for w in want if " " not in w[1]}
    both = fulltext.section_hits(index, phrases).select("section_id", F.inline("hits")).collect()
    assert len(both) == len(want) and {tuple(r) for r in both} == want


def test_snippets_seek_only_terms_that_a_text_may_hold(spark, rows, monkeypatch):
    from passages.operators import snippets
    from passages.operators.snippets import Finder, book_term_snippets

    text = "Öl und Wasser. " * 20 + "Zum  Schluß\tein Ölfaß; İstanbul a.b … Ende"
    sections = spark.createDataFrame(
        [(1, "x", text), (2, "x", "kurz und gut"), (3, "y", text), (4, None, text), (5, "x", None), (6, "z", text), (None, "x", text)],
        "section_id long, pdf_id string, plain_text string",
    )
    words = ["wasser", "Schluß", "faß", "İstanbul", "a.b", "e", "ß ein", "nirgends", " ende", "", None]
    terms = spark.createDataFrame([(p, w) for p in ("x", "y", None) for w in words] + [("x", "wasser")], "pdf_id string, term string")
    made = rows(book_term_snippets(sections, terms))
    assert len(made) == 4 * 12 + 11 and {r[0] for r in made} == {1, 2, 3, 5, None}
    monkeypatch.setattr(snippets, "broadcast_if_small", lambda df: df)
    assert made == rows(book_term_snippets(sections, terms))

    sought = []

    class Text(str):
        def find(self, term, *at):
            sought.append(term)
            return super().find(term, *at)

    many = [f"wort{i}" for i in range(1000)]
    finder = Finder([*many, "a"])
    assert finder.places(Text("ein wort7 und wort12"), many) == {"wort7": 4, "wort1": 14, "wort12": 14}
    assert len(sought) < 10


def test_wide_phrases_are_counted_without_a_shuffle(spark, rows):
    """Phrases that ask for half of an index are counted where sections lie, whether its postings are in ranges or not."""
    index = fulltext.build_text_index(corpus(spark, np.random.default_rng(6), 80))
    phrases = stage(fulltext.query_phrases(ask(spark, "w w00 w01 none w059", "w000-w001")), "phrases")
    want = rows(fulltext.posting_hits(index, phrases))
    assert len({r[3] for r in want}) > 3 and want == rows(fulltext.phrase_hits(index, phrases))
    one = phrases.where("n_words = 1")
    for some in (index, index._replace(ranges=())):
        found = fulltext.phrase_hits(some, one)
        assert "Exchange" not in found._jdf.queryExecution().toString()
        assert rows(found) == [w for w in want if " " not in w[3]]
    twice = spark.createDataFrame([(1, "a", "w1", "w2 w3"), (1, "a", "w1", "w2 w3"), (None, "a", "w1", "x"), (None, "a", "w1", "y"), (2, "a", "w1", "z")], "section_id int, pdf_id string, title string, plain_text string")
    index, asked = fulltext.build_text_index(twice), fulltext.query_phrases(ask(spark, "w w1 x z"))
    found = rows(fulltext.phrase_hits(index, asked))
    assert found == rows(fulltext.posting_hits(index, asked)) and (1, "a", 3, "w", 6) in found


def test_entries_of_odd_texts(spark, rows):
    """Terms, places and sizes of texts that are null, blank, accented or full of marks."""
    given = [(1, "a", "Élan vital", "\u00c9lan,  Stra\u00dfe\n\nx x e\u0301"), (2, "a", "", "..."), (3, "b", None, "x"), (4, "b", "x", None), (5, "b", "x", "y-x")]
    made = fulltext.section_entries(spark.createDataFrame(given, "section_id int, pdf_id string, title string, plain_text string"))
    listed = rows(made.select("section_id", "n_terms", fulltext.entry_list().alias("e")))
    found = {s: (n, {t: list(p) for t, p in e}) for s, n, e in listed}
    assert found == {
        1: (7, {"e": [7], "elan": [0, 3], "straße": [4], "vital": [1], "x": [5, 6]}),
        2: (0, {}), 3: (None, {}), 4: (None, {}), 5: (3, {"x": [0, 3], "y": [2]}),
    }
    assert {(r.section_id, r.term): (r.f, r.places) for r in fulltext.posting_rows(made).collect()} == {
        (s, t): (len(p), p) for s, (_, own) in found.items() for t, p in own.items()
    }
