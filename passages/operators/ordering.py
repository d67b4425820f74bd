"""Positions, first and last rows per group that hold up when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def int_chunk(order: str, width: int = CHUNK) -> Column:
    """Chunk number of an integer order column, for dense_position."""
    return F.floor(F.col(order) / width)


def dense_position(
    df: DataFrame,
    group: Sequence[str],
    chunk: dict[str, Column],
    order: Sequence[str],
    name: str,
) -> DataFrame:
    """0-based position of each row in its group without sorting a whole group in one task.

    ``chunk`` cuts each group into bounded pieces that follow the order (they are columns that
    never decrease along it). Pieces are counted first; a row's position is the number of rows in
    earlier pieces plus its place in its own. Only the counts are ordered per whole group.
    """
    keys = [*group, *chunk]
    pieces = df.withColumns(chunk)
    earlier = (
        Window.partitionBy(*group).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        pieces.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        pieces.join(starts, keys)
        .withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_start", *chunk)
    )


def next_in_group(
    df: DataFrame, group: Sequence[str], column: str, name: str, width: int = CHUNK
) -> DataFrame:
    """df, whose ``column`` is a distinct whole number per group, with the next larger one.

    Numbers are compared within bounded pieces; the last of a piece takes the first of the next
    piece that has any. Only one row per piece is ordered per whole group.
    """
    keys = [*group, "_piece"]
    pieces = df.withColumn("_piece", int_chunk(column, width))
    later = F.lead("_first").over(Window.partitionBy(*group).orderBy("_piece"))
    firsts = (
        pieces.groupBy(*keys).agg(F.min(column).alias("_first")).select(*keys, later.alias("_after"))
    )
    inside = F.lead(column).over(Window.partitionBy(*keys).orderBy(column))
    return (
        pieces.join(firsts, keys)
        .withColumn(name, F.coalesce(inside, F.col("_after")))
        .drop("_after", "_piece")
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """First row of each key. An aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last row of each key: what an upsert in that order leaves behind."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """Best n rows of each key, numbered from 1. Each task keeps its own best n before the shuffle."""
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, spot).where(F.col(name) <= n)
