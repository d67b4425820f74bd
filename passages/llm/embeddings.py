"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Equal vectors of one label are first made one class with a count, so copies are never paired. Each
class vector gets one bucket number per table: the signs of its products with random hyperplanes.
Vectors that share a bucket are compared by exact cosine. Small buckets are packed together into
units of bounded size; large ones are cut into blocks, and every pair of a bucket's blocks is a unit,
so a hot bucket is spread over many tasks. A unit is one matrix product and returns at most one row per vector of its blocks (how many vectors
it is linked to there, and the local component it falls into), never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.components import component_of
from passages.sources.tables import stage

TABLES = 32
BITS = 14
SEED = 7
BLOCK = 256


def hyperplanes(width: int, tables: int, bits: int) -> np.ndarray:
    """Normals of all tables' hyperplanes, the same on every executor: (width, tables * bits)."""
    return np.random.default_rng([SEED, width]).standard_normal((width, tables * bits))


def signatures(vectors: DataFrame, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """(id, label, embedding, copies) with the bucket number of each table added as ``buckets``."""
    schema = vectors.schema.simpleString()[7:-1] + ",buckets:array<int>"
    at = vectors.columns.index("embedding")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int32)
        for batch in batches:
            rows = batch.column(at)
            widths = np.diff(rows.offsets.to_numpy())
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(widths)])[:-1]
            out = np.zeros((len(rows), tables), np.int32)
            for width in np.unique(widths).tolist():
                if width not in planes:
                    planes[width] = hyperplanes(width, tables, bits)
                own = np.nonzero(widths == width)[0]
                for some in np.array_split(own, len(own) // 4096 + 1):
                    points = flat[starts[some][:, None] + np.arange(width)]
                    above = (points @ planes[width] > 0).reshape(len(some), tables, bits)
                    out[some] = above @ weights
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "buckets"])

    return vectors.mapInArrow(sign, schema.replace(":", " "))


def _local_roots(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the symmetric links ``near``, for every index."""
    roots = np.arange(len(near))
    while True:
        low = np.where(near, roots[None, :], len(near)).min(axis=1)
        low = np.minimum(low, roots)
        low = low[low]
        if (low == roots).all():
            return roots
        roots = low


def _compare(unit: pa.Table, table: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Links within a unit: position, number of linked vectors, and position of the local root."""
    points = np.stack([np.asarray(v, np.float64) for v in unit["embedding"].to_numpy()])
    buckets = np.stack(unit["buckets"].to_numpy())
    block = unit["own_block"].to_numpy()
    copies = unit["copies"].to_numpy()
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = points @ points.T >= threshold
    near &= buckets[:, table][:, None] == buckets[:, table][None, :]
    np.fill_diagonal(near, False)
    first = block.min()
    if block.max() > first:  # two blocks: only pairs across them, the others have units of their own
        near &= (block[:, None] == first) != (block[None, :] == first)
    # Pairs that share an earlier table's bucket were counted there.
    a, b = np.nonzero(near)
    for at in range(0, len(a), 1 << 18):
        some = slice(at, at + (1 << 18))
        again = (buckets[a[some], :table] == buckets[b[some], :table]).any(axis=1)
        near[a[some][again], b[some][again]] = False
    links = near @ copies
    return np.nonzero(links)[0], links, _local_roots(near)


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", threshold: float = 0.93,
    tables: int = TABLES, bits: int = BITS, block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors`` (key, embedding, label).

    n_links counts the other vectors found with cosine >= threshold; component_id is the smallest
    key reachable by links, the own key without any; kept says whether it is the own. Only vectors of
    one label and length are compared. Vectors that are null, empty or zero or hold a null or
    non-finite component, and those without a label or key, link with nothing. Repeated rows count as
    vectors of their own. A pair at cosine 0.93 shares a bucket in one of 32 tables of 14 bits with
    probability 0.997; closer pairs are missed less often. ``bits`` should grow by one for every
    doubling of the vectors of a label beyond some hundred thousand, with tables to match.
    """
    values = F.col("embedding")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists(values, lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = vectors.select(
        F.col(key).alias("id"), "label", "embedding"
    )
    rows = rows.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.sha2(_text(values), 256)))
    classes = (
        rows.where(F.col("class").isNotNull())
        .groupBy("label", "class")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    )
    classes = stage(signatures(classes, tables, bits), "vectors")

    entries = classes.select(
        "label", "id", F.posexplode("buckets").alias("table", "bucket"), F.size("embedding").alias("width")
    )
    place = ["label", "width", "table", "bucket"]
    sizes = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = stage(sizes, "vector-buckets")
    totals = sizes.groupBy(*place[:-1]).agg(F.ceil(F.sum("rows") / block).alias("packs"))
    small = F.col("rows") <= block
    pack = F.when(small, F.pmod(F.xxhash64("bucket"), "packs")).otherwise(-1 - F.col("bucket"))
    blocks = F.when(small, 1).otherwise(F.ceil(F.col("rows") / block)).cast("int")
    sizes = sizes.join(totals, place[:-1]).select(*place, pack.alias("pack"), blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    # Each block meets itself and every other block of its bucket once.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = (
        entries.join(sizes, place)
        .withColumn("own_block", own)
        .withColumn("other", other)
        .select(
            *place[:-1], "pack", "id", "own_block",
            F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high"),
        )
    )
    units = units.join(classes.select("label", "id", "embedding", "copies", "buckets"), ["label", "id"])

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(list(batches)).sort_by("id")
        found, links, roots = _compare(unit, key[2].as_py(), threshold)
        ids = unit["id"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[found]), pa.array(links[found]), pa.array(ids[roots[found]])], ["id", "links", "root"]
        )

    found = stage(
        units.groupBy(*place[:-1], "pack", "low", "high").applyInArrow(
            compare, "id bigint, links bigint, root bigint"
        ),
        "vector-links",
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = component_of(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    heads = (
        classes.select("label", "class", "id", "copies")
        .join(counts, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "label", "class",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    named = rows.select("id", "label", "class").join(heads, ["label", "class"], "left")
    component = F.coalesce("component_id", "id")
    return named.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _text(values):
    """The numbers' exact text, with both zeros alike and the length given by the parts."""
    return F.array_join(F.transform(values, lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))), " ")
