"""Hard negatives against all pairs, and the bounds against exact scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.llm import negatives


def plain(rows, positives=5, keep=10):
    q = {}
    for i, (_, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        q[i] = [int(np.floor(256 * np.float64(x))) for x in vector]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out, seen = set(), []
    for i in q:
        key, _, label = rows[i]
        if key is None or key % 100 or (key, label, q[i]) in seen:
            continue
        seen.append((key, label, q[i]))
        scores = [(sum(a * b for a, b in zip(q[i], q[j], strict=True)), rows[j][0], rows[j][2]) for j in q if len(q[j]) == len(q[i])]
        near = sorted(((s, k) for s, k, other in scores if other == label and k != key), key=order)[:positives]
        for p, pk in near:
            fits = sorted(((s, k) for s, k, other in scores if other != label and 30 * p <= 100 * s <= 90 * p), key=order)[:keep]
            out |= {(key, pk, rank, k, p, s) for rank, (s, k) in enumerate(fits, 1)}
    return out


def found(spark, rows, kind="float"):
    vectors = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    vectors = vectors.withColumns({c: F.lit("x") for c in ("id", "number", "width", "norm", "low", "batch")}).repartition(5)
    return [tuple(r) for r in negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0).collect()]


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_clustered_vectors(spark, spread, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "BATCH_BYTES", 4_000)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    rows = [(i * 4, (centres[i % 8] + spread * rng.normal(size=12)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(400)]
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows) and got


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    points = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centres] + [np.zeros((3, 16))]))
    norms = np.linalg.norm(points, axis=1)
    directions = negatives.reference_directions(points)
    angles = negatives.angles_to(points, norms, directions)
    assert len(directions) == negatives.REFERENCES
    for at in range(0, len(points), 40):
        some = slice(at, at + 40)
        low, high = negatives.score_bounds(angles, norms, angles[some].min(axis=0), angles[some].max(axis=0), norms[some].min(), norms[some].max())
        scores = points @ points[some].T
        assert (low[:, None] <= scores).all() and (scores <= high[:, None]).all()
    anchors = {"angles": angles[:20], "norms": norms[:20], "points": points[:20].astype("<i4"), "labels": np.zeros(20, np.int64),
               "ids": np.arange(20), "numbers": np.arange(20), "low": np.full((20, 1), -negatives.FAR), "high": np.full((20, 1), negatives.FAR)}
    best = negatives.BestScores(anchors, 5, True)
    for at in range(0, len(points), 40):
        some = slice(at, at + 40)
        best.add({"low": angles[some].min(axis=0), "high": angles[some].max(axis=0), "norms": norms[some], "points": points[some].astype("<i4"),
                  "labels": np.zeros(len(points[some]), np.int64), "ids": np.arange(len(points))[some], "nameless": np.zeros(len(points[some]), bool)})
    assert best.skipped > 5 * best.scored


def test_ties_repeats_nulls_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    near = [[1.0, 0.5, 0.25], [1.0, 0.5, 0.0], [0.5, 0.5, 0.0]]
    rows = [(i, near[i % 3], i % 2) for i in range(0, 120, 10)]
    rows += [(0, near[0], 0), (None, near[0], 0), (None, near[1], 1), (None, near[2], 1), (7, None, 1), (8, [nan, 1.0, 1.0], 0), (9, [inf, 1.0, 1.0], 0),
             (11, [None, 1.0, 1.0], 1), (12, near[0], None), (13, [], 0), (200, [], 0), (300, [1.0], 0), (14, [2.0], 0), (15, [1.5], 1), (400, [0.0, 0.0, 0.0], 0)]
    got = found(spark, rows)
    assert set(got) == plain(rows)


def test_large_components(spark):
    rows = [(i, [float((i % 7 + 1) * 70_000), 3.0 * i, -1.0], i % 3) for i in range(0, 300, 4)]
    assert set(found(spark, rows, "double")) == plain(rows)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(100, [1.0], 1), (2, [0.5], 2)]) == []
