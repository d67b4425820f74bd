"""Operators and pipeline against brute-force versions, the library itself, or held-out labels."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from compare import connect
from pyspark.sql import functions as F

import corpus_pipeline
from passages.llm import embeddings, pieces, secrets, simhash, substrings, toxicity
from passages.llm.queries import ORACLES, QUERIES, held_out
from passages.sources.tables import read_table

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read_table(spark, SF, "documents").collect()}


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def five_words(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def smallest_reachable(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(texts):
    for text in [*list(texts.values())[:60], "", "one", "A b C d", "É x\x0bY"]:
        assert simhash.fingerprint(text.encode(), 4) % (1 << 64) == plain_fingerprint(text)


def test_simhash_components(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4]
    roots = smallest_reachable(ids, links)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}


@pytest.mark.parametrize("count, entry_rows", [(2, 4096), (3, 2), (4, 3)])
def test_near_components_of_crowded_fingerprints(spark, count, entry_rows):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(40)} | {0}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.near_components(spark.createDataFrame(signed, "fingerprint bigint"), 4, count, entry_rows).collect()
    values = [s for (s,) in signed]
    links = [(a, b) for k, a in enumerate(values) for b in values[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert {r.fingerprint: r.root for r in found} == smallest_reachable(values, links)


@pytest.mark.parametrize("block", [8, 256])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    points = np.concatenate([c + rng.normal(size=(25, 16)) * s for c in centres for s in (0.01, 0.12, 0.3)])
    points[40] = points[41] = points[42]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(points)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(vectors, block=block).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(len(points))[:, None] % 2 == np.arange(len(points))[None, :] % 2)
    np.fill_diagonal(near, False)
    counted = np.array([got[i].n_links for i in range(len(points))])
    assert (counted <= near.sum(axis=1)).all()
    assert counted.sum() >= 0.99 * near.sum()
    roots = smallest_reachable(range(len(points)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == roots[i] for i in roots]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pieces_like_the_library(spark, texts):
    odd = ["", " ", "  ", " a  b ", "a▁b", "▁", "x\n\n y\t", "é😀  ａ", "a ", "\x00", "<s> </s> <unk> <0x41>", "trail   ", "　x  y"]
    given = dict(enumerate([*odd, *list(texts.values())[:80]]))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string").repartition(5)
    got = pieces.encode_documents(docs, MODEL, block=20_000).collect()
    assert len(got) == len(given)
    for r in got:
        ids = sp.encode(given[r.doc_id])
        assert list(r.ids) == ids and r.decoded == sp.decode(ids)


def test_base_spans_like_re(spark, texts):
    odd = ["token: secret: abcdefghijk", "PassWord ='abcdefgh' passwd=short api_key:\"a.b/c+d=e-\"", "AKIAABAKIA" + "B" * 20,
           "é😀 secret=12345678\nnext " + "0f" * 20 + "G", "AKIA" + "A" * 11, "f" * 31]
    given = dict(enumerate([*odd, *texts.values()]))
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    base = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
    }
    for r in secrets.find_secrets(docs).collect():
        want = sorted(
            (m.start(), rank, m.end(), kind)
            for rank, (kind, (regex, group, least)) in enumerate(base.items())
            for m in regex.finditer(given[r.doc_id])
            if len(m.group(group)) >= least
        )
        assert [(s.start, s.end, s.kind) for s in r.base_spans] == [(a, b, k) for a, _, b, k in want]


def test_entropy_and_redaction(spark):
    rows = [(1, "key Zx9Kq2LmP0vT7rWbY3sDfGh8JnQ5 end"), (2, "A" * 40), (3, "antidisestablishmentarianismandmore"),
            (4, "123e4567-e89b-12d3-a456-426614174000"), (5, "token=abcdefgh12 and tail")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = F.concat("base_spans", "entropy_spans")
    got = {r.doc_id: r for r in secrets.find_secrets(docs).select("*", secrets.redact(F.col("text"), spans).alias("clean")).collect()}
    assert got[1].clean == "key [REDACTED] end" and got[5].clean == "[REDACTED] and tail"
    assert all(not got[i].entropy_spans for i in (2, 3, 4))


def test_repeats_like_brute_force(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op9_substrings"](spark, SF).collect()}
    seen = set()
    for i in sorted(texts):
        parts = substrings.sentences(texts[i])
        assert "".join(parts) == texts[i]
        words = [p.lower().split() for p in parts]
        full, removed = [k for k, w in enumerate(words) if w], set()
        for a in range(len(full)):
            ends = [b for b in range(a + 2, len(full)) if sum(len(words[k]) for k in full[a : b + 1]) >= 20]
            if not ends:
                continue
            run = " ".join(" ".join(words[k]) for k in full[a : ends[0] + 1])
            if run in seen:
                removed.update(range(full[a], full[ends[0]] + 1))
            seen.add(run)
        kept = "".join(p for k, p in enumerate(parts) if k not in removed)
        assert (got[i].n_removed, got[i].kept_sha256) == (len(removed), hashlib.sha256(kept.encode()).hexdigest())


def test_held_out(spark):
    ids = [*range(200), None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", held_out().alias("out")).collect()
    assert all(r.out == (r.doc_id is None or crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_models_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in read_table(spark, folder, "documents").select("doc_id", "lang").collect()}
    found = [r for r in QUERIES["op7_language"](spark, folder).collect() if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found]) > 0.98
    toxic = {r.doc_id: r.toxic for r in read_table(spark, folder, "labels").collect()}
    found = [r for r in QUERIES["op6_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in found]) > 0.85


def test_insults_with_gaps():
    from passages.llm.toxicity import fit

    words = ["garden", "window", "people", "evening", "morning", "idiom", "order", "modern", "mother"]
    model = fit({"idiot": 50.0, "moron": 40.0}, {w: 30.0 for w in words})
    near = model.decide([f"\x02{w}\x03" for w in ("idiot", "idixot", "mo1ron")])
    far = model.decide([f"\x02{w}\x03" for w in words])
    assert near.min() > 0 > far.max()


def test_pipeline_stage_by_stage(spark, texts, tmp_path):
    """Each stage's rows follow from its operator's decisions on its own input."""
    docs, source = read_table(spark, SF, "documents"), None
    for name, work in corpus_pipeline.STAGES:
        out = work(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, rows = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert rows.keys() <= before.keys() and len(rows) == after.count()
        if name == "simhash":
            sets = {i: five_words(r.text) for i, r in before.items()}
            links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert rows.keys() == set(smallest_reachable(sorted(sets), links).values())
        elif name == "secrets":
            assert rows.keys() == before.keys()
            found = secrets.find_secrets(docs).where("size(base_spans) + size(entropy_spans) > 0").collect()
            assert {i for i in rows if rows[i] != before[i]} == {r.doc_id for r in found}
            for r in found:
                assert "[REDACTED]" in rows[r.doc_id].text and rows[r.doc_id].n_chars == len(rows[r.doc_id].text)
        elif name == "pieces":
            sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            assert rows.keys() == before.keys() and all(list(rows[i].ids) == sp.encode(before[i].text) for i in rows)
        elif name == "toxicity":
            model = toxicity.train(docs, read_table(spark, SF, "labels").where(~held_out()))
            assert all(rows[i] == before[i] for i in rows)
            assert rows.keys() == {i for i, r in before.items() if plain_score(model, r.text) < 0.5}
        else:
            duck = connect(SF)
            duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{source}/*.parquet'")
            clean = duck.execute(f"SELECT doc_id FROM ({ORACLES['op4_decontamination']}) WHERE NOT contaminated").fetchall()
            assert rows.keys() == {i for (i,) in clean} and all(rows[i] == before[i] for i in rows)
        docs, source = after, tmp_path / name


def plain_score(model, text):
    """Score of the worst window: its worst chunk and the mean of the next two, read off the sorted decisions."""
    chunks = toxicity.chunks_of(text or "")
    values = model.decide([toxicity.marked(toxicity.clean(c)) for c in chunks]).tolist() or [model.bias]
    pairs = []
    for start in range(0, max(1, len(values) - toxicity.STEP), toxicity.STEP) if len(values) > toxicity.WINDOW else [0]:
        top = sorted(values[start : start + toxicity.WINDOW], reverse=True)[:3]
        pairs.append((top[0], sum(top[1:]) / len(top[1:]) if top[1:] else top[0]))
    best = max(pairs, key=sum)
    return float(model.score(np.array([best]))[0])


def plain_kernel(one, two):
    """Subsequence kernel by listing all of them."""
    def held(word):
        found = {}
        codes = [toxicity._CODE.get(c, toxicity._OTHER) for c in word]
        for at in itertools.combinations(range(len(word)), toxicity.ORDER):
            part = tuple(codes[i] for i in at)
            found[part] = found.get(part, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return found

    def times(x, y):
        return sum(v * y.get(k, 0.0) for k, v in x.items())

    x, y = held(one), held(two)
    return times(x, y) / np.sqrt(times(x, x) * times(y, y)) if x and y else 0.0


def test_one_weight_per_subsequence_is_the_kernel_machine():
    harmless = ["garden", "window", "people", "evening", "morning", "idiom", "order", "modern", "mother"]
    model = toxicity.fit({"idiot": 50.0, "moron": 40.0, "unbelievablyidioticperson": 9.0}, {w: 30.0 for w in harmless})
    for word in ["idiot", "idixot", "mother", "mo", "möron", "é%", "abracadabra"]:
        chunk = toxicity.marked(word)
        want = sum(f * plain_kernel(chunk, m) for f, m in zip(model.factors, model.landmarks, strict=True)) + model.bias
        assert abs(model.decide([chunk])[0] - want) < 1e-9
    pieces_of = toxicity._pieces(toxicity.marked("a" * 20 + "idiot" + "b" * 20))
    assert len(pieces_of) > 2 and model.decide([toxicity.marked("a" * 20 + "idiot" + "b" * 20)])[0] == max(model.decide(pieces_of))


def test_harmless_text_does_not_hide_an_insult():
    harmless = ["garden", "window", "people", "evening", "morning", "idiom", "order", "modern", "mother"]
    model = toxicity.fit({"idiot": 50.0, "moron": 40.0}, {w: 30.0 for w in harmless})
    model.slopes, model.shift = (1.0, 1.0), 0.0
    insult, rng = "you idiot moron idiot", random.Random(6)
    scores = []
    for n in (0, 50, 500, 5_000):
        lines = [" ".join(rng.choices(harmless, k=8)) + "." for _ in range(n)]
        scores += [model.worst([" ".join([insult, *lines])])[0].sum(), model.worst([" ".join([*lines, insult])])[0].sum()]
    assert min(scores) >= scores[0] - 1e-9


def test_endings_of_long_words_are_learnt():
    harmless = {w: 30.0 for w in ["gardenersgardening", "windowlesswindowcases", "extraordinarygarden", "morning"]}
    model = toxicity.fit({"extraordinaryidiot": 20.0, "windowlesswindowmoron": 20.0}, harmless)
    assert model.decide([toxicity.marked("extraordinaryidiot")])[0] > 0 > model.decide([toxicity.marked("extraordinarygarden")])[0]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")}
    )
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", rows[0][1]), ("3", None), ("None", "x y z")], key=str)


def test_any_repeat_of_fifty_words_holds_a_run():
    """Passages in the midst of sentences of different hosts: sentences of 17 words, one long one, words seldom or always cut."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = ["".join(rng.choices(letters, k=6)) for _ in range(5000)]
    rare = [w for w in many if crc32(w.encode()) % 8]
    for trial in range(300):
        words = rng.choices((many, rare, many[:3], many[:1])[trial % 4], k=51)
        if trial % 3 == 0:
            words = [w + "." if i % 17 == 16 else w for i, w in enumerate(words)]
        hosts = [" ".join([*rng.choices(many, k=rng.randint(0, 30)), *words, *rng.choices(many, k=rng.randint(0, 30))]) for _ in range(2)]
        assert all("".join(substrings.sentences(h)) == h for h in hosts)
        first, second = ({tuple(h) for h in substrings.runs(host)[2].tolist()} for host in hosts)
        assert first & second


def test_cut_repeat_within_sentences(spark):
    rng = random.Random(8)
    passage, *other = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n)) for n in (51, 40, 40, 40, 40)]
    rows = [(1, f"{other[0]} {passage} {other[1]}"), (2, f"{other[2]} {passage} {other[3]}")]
    got = {r.doc_id: r for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].kept == rows[0][1]
    kept = got[2].kept.split()
    assert got[2].n_removed > 0 and kept[:40] == other[2].split() and kept[-40:] == other[3].split() and len(kept) <= 80 + 51 - 20


def test_pipeline_keeps_columns_of_any_name(spark):
    rows = [(1, "one two three four five six", "x"), (2, "one two three four five six", "x"), (3, "seven eight nine ten", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(
        {c: F.lit("x") for c in ("count", "row", "name", "hash", "score", "source", "n_chars")}
    )
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and [r.row for r in kept.collect()] == ["x", "x"]
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 3
        assert stage(spark, docs.where("doc_id < 0"), SF).collect() == []


def test_near_copies_at_the_limit_are_found(spark):
    """Recall of links of the stage against exact five-word similarity, for pairs of 0.8 to 0.9."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(4000)]
    rows, near = [], []
    for i in range(0, 800, 2):
        text = rng.choices(words, k=200)
        copy = list(text)
        for at in rng.sample(range(200), rng.randint(2, 5)):
            copy[at] = rng.choice(words)
        rows += [(i, " ".join(text)), (i + 1, " ".join(copy))]
        x, y = (five_words(t) for _, t in rows[-2:])
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            near.append(i)
        elif len(x & y) < 0.8 * len(x | y):
            rows.pop()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert all(i in kept for i in range(0, 800, 2))
    assert len(near) > 100 and np.mean([i + 1 not in kept for i in near]) >= 0.99


def test_texts_of_equal_fingerprint_are_checked(spark):
    """Much repeated lines give equal fingerprints to texts that differ; a text behind such a twin keeps its own copies."""
    rng = random.Random(12)
    line = "all rights reserved by the owner of this page " * 300
    x, y = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(2))
    copy = " ".join(w if i != 40 else "other" for i, w in enumerate(y.split()))
    rows = [(1, line + x), (2, line + y), (3, line + copy)]
    assert len({plain_fingerprint(t) for _, t in rows[:2]}) == 1
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()
    assert {r.doc_id for r in kept} == {1, 2}


def test_sketches_leave_no_link_out(spark):
    """Every pair of a similarity of 0.8 passes the sketches; most others, which only share some lines, do not."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for n in range(80):
        words = base[: int(rng.integers(2, 121))] if n % 4 == 0 else list(base)
        for at in rng.integers(0, len(words), int(rng.integers(0, 12))):
            words[at] = f"x{n}-{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    sketches = [simhash.outline(t.encode())[2] for t in texts]
    assert [s[0] for s in sketches] == [len(s) for s in sets]
    held = spark.createDataFrame([(i, s) for i, s in enumerate(sketches)], "id int, sketch struct<n: bigint, low: bigint, high: bigint>")
    pairs = held.alias("x").join(held.alias("y"), F.col("x.id") < F.col("y.id"))
    told = pairs.select("x.id", "y.id", simhash.may_reach(F.col("x.sketch"), F.col("y.sketch"), 0.8)).collect()
    links = {(i, j) for i, j, _ in told if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    passed = {(i, j) for i, j, may in told if may}
    assert links and links <= passed
    assert len(passed - links) < 0.1 * (len(told) - len(links))
