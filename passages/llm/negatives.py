"""Hard negatives by angular triangle filtering: reference angles bound scores, integers decide.

Every vector is quantized to whole numbers and stored with its norm and its angles to a few reference
directions. Vectors near one reference, in one band of angles, form bounded blocks that know the range of
their angles and norms. For an anchor at angle a to a reference and a block at angles from l to h, the
angle between them lies in ``[max(0, l - a, a - h), min(a + h, 2 pi - a - l)]``; the tightest such interval
over all references gives a cosine interval, and the norms turn it into score bounds. Only where these
overlap a window of scores that is still wanted are the whole-number products computed. Windows narrow
as results come in: below an anchor's k-th best score so far nothing is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.sources.tables import stage

SCALE = 256
REFERENCES = 16
SAMPLE = 2_048  # vectors from which the reference directions are chosen
BANDS = 16  # bands of angle to the nearest reference
BUCKETS = 16  # parts by label
BLOCK = 2_048  # vectors, or anchors, in a block
BATCH_BYTES = 16 << 20  # anchors broadcast at once
FAR = 1 << 62  # scores and norms stay below
EXACT = float(1 << 53)  # whole numbers that a double holds


def reference_directions(points: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other among ``points``, each the one furthest from those before."""
    norms = np.linalg.norm(points, axis=1)
    units = points[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.zeros((0, points.shape[1]))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles_to(points: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of points to directions. A zero vector is at every angle's score zero, so any will do."""
    cosines = points @ directions.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def score_bounds(
    angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, small: float, large: float
) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of anchors (angles, norms) with vectors of angles low..high and norms small..large.

    The margin covers the rounding of angles, cosines and norms, so no true score lies outside.
    """
    nearest = np.maximum(np.maximum(low - angles, angles - high), 0.0).max(axis=1, initial=0.0)
    over = np.where(angles + high <= np.pi, angles + high, np.where(angles + low >= np.pi, 2 * np.pi - angles - low, np.pi))
    furthest = over.min(axis=1, initial=np.pi)
    top, bottom = np.cos(nearest), np.cos(furthest)
    margin = 1e-6 * norms * large + 1.0
    return (
        bottom * norms * np.where(bottom < 0, large, small) - margin,
        top * norms * np.where(top > 0, large, small) + margin,
    )


def whole_scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact products of rows of whole numbers. Doubles hold them as long as no norms' product exceeds 2^53."""
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class BestScores:
    """Best ``keep`` vectors of each window of a block of anchors, as vectors come by in blocks."""

    def __init__(self, anchors: dict, keep: int, same: bool):
        self.anchors, self.keep, self.same = anchors, keep, same
        n, windows = anchors["low"].shape
        self.wanted = anchors["low"].copy()  # least score that still matters, by anchor and window
        self.found = [[[] for _ in range(windows)] for _ in range(n)]
        self.scored = self.skipped = 0

    def add(self, block: dict) -> None:
        own = self.anchors
        low, high = score_bounds(own["angles"], own["norms"], block["low"], block["high"], block["norms"].min(), block["norms"].max())
        near = ((high[:, None] >= self.wanted) & (low[:, None] <= own["high"])).any(axis=1)
        rows = np.nonzero(near)[0]
        self.scored += len(rows) * len(block["ids"])
        self.skipped += (len(near) - len(rows)) * len(block["ids"])
        if not len(rows):
            return
        scores = whole_scores(own["points"][rows], block["points"], own["norms"][rows].max() * block["norms"].max())
        alike = own["labels"][rows][:, None] == block["labels"][None, :]
        fits = alike & ((own["ids"][rows][:, None] != block["ids"][None, :]) | block["nameless"][None, :]) if self.same else ~alike
        for w in range(self.wanted.shape[1]):
            hits = fits & (scores >= self.wanted[rows, w][:, None]) & (scores <= own["high"][rows, w][:, None])
            for i in np.nonzero(hits.any(axis=1))[0].tolist():
                at = np.nonzero(hits[i])[0]
                new = zip((-scores[i, at]).tolist(), block["nameless"][at].tolist(), block["ids"][at].tolist(), strict=True)
                best = sorted([*self.found[rows[i]][w], *new])[: self.keep]
                self.found[rows[i]][w] = best
                if len(best) == self.keep:
                    self.wanted[rows[i], w] = max(self.wanted[rows[i], w], -best[-1][0])

    def rows(self) -> Iterator[tuple]:
        for anchor, windows in zip(self.anchors["numbers"].tolist(), self.found, strict=True):
            for w, best in enumerate(windows):
                for score, nameless, key in best:
                    yield anchor, w, None if nameless else key, -score


def _sound(vectors: DataFrame, key: str, anchor: Column) -> DataFrame:
    values = F.col("embedding")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("number"), F.col(key).cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        values.cast("array<double>").alias("embedding"), F.size(values).alias("width"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )


def _points(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def measured(vectors: DataFrame, references: dict[int, np.ndarray], scale: int) -> DataFrame:
    """Quantized vectors with norm, angles, nearest reference and band: one row per vector."""
    schema = (
        "number bigint, id bigint, label bigint, anchor boolean, width int, points binary, norm double, "
        "angles array<double>, cell int, band int, bucket int"
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width in np.unique(batch.column("width").to_numpy()).tolist():
                rows = batch.filter(pa.array(batch.column("width").to_numpy() == width))
                for at in range(0, len(rows), 1024):
                    yield _measured(rows.slice(at, 1024), width)

    def _measured(rows: pa.RecordBatch, width: int) -> pa.RecordBatch:
        points = np.floor(_points(rows.column("embedding"), width) * scale)
        norms = np.sqrt((points * points).sum(axis=1))
        directions = references.get(width, np.zeros((0, width)))
        angles = angles_to(points, norms, directions)
        cells = angles.argmin(axis=1) if len(directions) else np.zeros(len(rows), np.int64)
        nearest = angles.min(axis=1) if len(directions) else np.zeros(len(rows))
        fits = norms < 2.0**31
        points[~fits] = 0
        whole = points.astype("<i4")
        out = pa.RecordBatch.from_arrays(
            [
                *[rows.column(c) for c in ("number", "id", "label", "anchor", "width")],
                pa.array([p.tobytes() for p in whole], pa.binary()), pa.array(norms), pa.array(list(angles), pa.list_(pa.float64())),
                pa.array(cells.astype(np.int32)), pa.array((nearest * BANDS / np.pi).astype(np.int32)),
                pa.array((rows.column("label").to_numpy() % BUCKETS).astype(np.int32)),
            ],
            [c.split()[0] for c in schema.split(", ")],
        )
        return out.filter(pa.array(fits))

    return vectors.mapInArrow(measure, schema)


def _packed(rows: DataFrame, group: list[str], size: int, windows: bool) -> DataFrame:
    """Rows of each group in blocks of about ``size``, each block one row of packed columns with its ranges."""
    pieces = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).alias("pieces"))
    dealt = rows.join(pieces, group).withColumn("piece", F.pmod(F.xxhash64("number"), "pieces"))
    schema = (
        "width int, bucket int, block bigint, count int, numbers binary, ids binary, nameless binary, labels binary, points binary, norms binary, "
        "angles binary, low binary, high binary"
    )

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(list(batches)).sort_by("number")
        column = lambda c: unit[c].combine_chunks()
        ids = column("id")
        angles = np.stack(unit["angles"].to_numpy()) if len(unit) else np.zeros((0, 0))
        values = {
            "width": unit["width"][0].as_py(), "bucket": unit["bucket"][0].as_py(), "block": unit["number"][0].as_py(), "count": len(unit),
            "numbers": column("number").to_numpy().tobytes(), "ids": ids.fill_null(0).to_numpy().tobytes(),
            "nameless": ids.is_null().to_numpy(zero_copy_only=False).tobytes(), "labels": column("label").to_numpy().tobytes(),
            "points": b"".join(unit["points"].to_pylist()), "norms": column("norm").to_numpy().tobytes(), "angles": angles.tobytes(),
        }
        if windows:  # anchors: least and largest score of each window
            low, high = (np.array(unit[c].to_pylist(), np.int64) for c in ("low", "high"))
        else:
            low, high = angles.min(axis=0), angles.max(axis=0)
            values["angles"] = b""
        yield pa.RecordBatch.from_pylist([{**values, "low": low.tobytes(), "high": high.tobytes()}], _arrow(schema))

    return dealt.groupBy(*group, "piece").applyInArrow(pack, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _unpacked(row: dict, anchors: bool) -> dict:
    n, width = row["count"], row["width"]
    kinds = {"numbers": np.int64, "ids": np.int64, "nameless": np.bool_, "labels": np.int64, "norms": np.float64}
    out = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}
    out["points"] = np.frombuffer(row["points"], "<i4").reshape(n, width)
    if anchors:
        out["angles"] = np.frombuffer(row["angles"], np.float64).reshape(n, -1)
        out["low"], out["high"] = (np.frombuffer(row[c], np.int64).reshape(n, -1) for c in ("low", "high"))
    else:
        out["low"], out["high"] = (np.frombuffer(row[c], np.float64) for c in ("low", "high"))
    return out


def best_scores(blocks: DataFrame, anchors: DataFrame, on: list[str], keep: int, same: bool) -> DataFrame:
    """(number, place, id, score): each task's best ``keep`` vectors of every window of every anchor.

    Anchors are broadcast, some megabytes at a time; the vectors stay where they are.
    """
    total = anchors.agg(F.coalesce(F.sum(F.length("points") + F.length("angles") + 48 * F.col("count")), F.lit(0))).first()[0]
    batches = -(-total // BATCH_BYTES) or 1
    sides = [F.struct(*blocks.columns).alias("vectors"), F.struct(*blocks.columns).alias("anchors")]
    asked = anchors.select(*on, sides[1], F.pmod(F.xxhash64("block"), F.lit(batches)).alias("batch"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, BestScores] = {}
        last, block = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.column("vectors")[i]
                if row["block"].as_py() != last:
                    last, block = row["block"].as_py(), _unpacked(row.as_py(), False)
                chunk = batch.column("anchors")[i]
                name = chunk["block"].as_py()
                if name not in best:
                    best[name] = BestScores(_unpacked(chunk.as_py(), True), keep, same)
                best[name].add(block)
        out: list[tuple] = []
        for scores in best.values():
            for row in scores.rows():
                out.append(row)
                if len(out) == 10_000:
                    yield _found(out)
                    out = []
        if out:
            yield _found(out)

    parts = []
    for b in range(batches):
        side = F.broadcast(asked.where(F.col("batch") == b).drop("batch"))
        met = blocks.select(*on, sides[0]).join(side, on).select("vectors", "anchors")
        parts.append(stage(met.mapInArrow(scan, "number bigint, place int, id bigint, score bigint"), "scores"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["number", "place", "id", "score"])


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", positives: int = 5, negatives: int = 10,
    least: int = 30, most: int = 90, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (key, embedding, label).

    Components become floor(scale * x); a score is the whole-number inner product with the anchor, higher
    first, ties by the smaller key, null keys last. An anchor's positives are its best ``positives`` rows
    of the same label and another key. For each, the best ``negatives`` rows of other labels follow whose
    score is from ``least`` to ``most`` percent of the positive's. Only vectors of one length are compared.
    Keys and labels are integers. Rows with a null label or vector, a null or non-finite component, or a
    norm of 2^31 or more after scaling take no part. Repeated rows count each as candidates, but a repeated
    anchor row is answered once. Anchors without a positive or a fitting negative have no rows, as has an empty
    table; other columns are ignored.
    """
    sound = _sound(vectors, key, anchor)
    references = {}
    sample = sound.orderBy(F.xxhash64("id", "label"), "number").limit(SAMPLE).select("embedding").collect()
    for width in {len(r.embedding) for r in sample} - {0}:
        some = np.floor(np.array([r.embedding for r in sample if len(r.embedding) == width], np.float64) * scale)
        references[width] = reference_directions(some[np.linalg.norm(some, axis=1) < 2.0**31])
    rows = stage(measured(sound, references, scale), "measured")
    blocks = stage(_packed(rows, ["width", "bucket", "cell", "band"], BLOCK, False), "vector-blocks")
    once = rows.where("anchor").groupBy("id", "label", "width", "points").agg(F.min("number").alias("number")).select("number")
    asked = stage(rows.join(once, "number", "left_semi"), "anchors")
    ends = [F.array(F.lit(-FAR)).alias("low"), F.array(F.lit(FAR)).alias("high")]
    chunks = stage(_packed(asked.select("*", *ends), ["width", "bucket"], BLOCK, True), "anchor-blocks")
    alike = _ranked(best_scores(blocks, chunks, ["width", "bucket"], positives, True), positives)
    alike = stage(alike.select("number", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(score * least / 100).cast("bigint"), F.floor(score * most / 100).cast("bigint")
    # Windows in the order of the positives; anchors with fewer have windows that nothing fits.
    listed = F.array_sort(F.collect_list(F.struct("place", low.alias("low"), high.alias("high"))))
    windows = alike.groupBy("number").agg(listed.alias("w"))
    filled = [
        F.array(*[F.coalesce(F.get("w", F.lit(i))[c], F.lit(none)) for i in range(positives)]).alias(c)
        for c, none in (("low", FAR), ("high", -FAR))
    ]
    chunks = stage(_packed(asked.join(windows.select("number", *filled), "number"), ["width"], BLOCK, True), "anchor-blocks")
    unlike = _ranked(best_scores(blocks, chunks, ["width"], negatives, False), negatives)
    names = asked.select("number", F.col("id").alias("anchor_id"))
    return unlike.join(alike, ["number", "place"]).join(names, "number").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
