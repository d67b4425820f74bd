"""Language bits against plain sets of n-grams, and recall of near vectors at the given width."""

import numpy as np

from passages.llm import embeddings, language
from passages.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_popcounts_like_plain_sets(spark):
    rows = read_table(spark, SF, "documents").where("lang is not null").select("lang", "text").collect()
    held = {}
    for r in rows[:120]:
        points = language._letters(r.text or "")
        for size in language.SIZES:
            held.setdefault(r.lang, set()).update(language.grams(points, size).tolist())
    model = language.LanguageFilter.build({k: np.array(sorted(v), np.uint64) for k, v in held.items()}, rows=1 << 24)
    assert model.false_positives.max() < 1e-3
    named = grams = 0
    for r in rows[100:160]:
        points = language._letters(r.text or "")
        codes = [c for size in language.SIZES for c in language.grams(points, size).tolist()]
        counts, total = model.popcounts(r.text or "")
        plain = np.array([sum(c in held[name] for c in codes) for name in model.languages])
        assert total == len(codes) and (counts >= plain).all()
        named, grams = named + int((counts - plain).sum()), grams + total
    assert named <= 0.001 * grams * len(model.languages)


def test_recall_at_the_given_width(spark):
    """Pairs of 64 components at cosines of 0.93 to 0.95, which the given table does not hold."""
    rng = np.random.default_rng(10)
    ones = rng.normal(size=(400, 64))
    ones /= np.linalg.norm(ones, axis=1, keepdims=True)
    off = rng.normal(size=ones.shape)
    off -= (off * ones).sum(axis=1, keepdims=True) * ones
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosines = rng.uniform(0.9301, 0.95, size=(400, 1))
    others = cosines * ones + np.sqrt(1 - cosines**2) * off
    rows = [(2 * i + k, v.tolist(), i % 2) for i, pair in enumerate(zip(ones, others, strict=True)) for k, v in enumerate(pair)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_vectors(vectors).collect()}
    caught = [got[2 * i + 1].component_id == 2 * i and got[2 * i].n_links >= 1 for i in range(400)]
    assert np.mean(caught) >= 0.99
