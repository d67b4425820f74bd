"""Bounded samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.sources.tables import stage

_STEPS = 1 << 30


def about(rows: DataFrame, group: str, size: int, *mix: str) -> DataFrame:
    """About ``size`` rows of each group, or all of a smaller one; the same rows on every run.

    A row is taken when the hash of the columns ``mix`` falls into the share of its group that is
    wanted, so nothing is sorted and no group meets in one task. Groups should be few.
    """
    shares = stage(
        rows.groupBy(group).agg((F.lit(float(size)) / F.count(F.lit(1))).alias("_share")), "sample-shares"
    )
    place = F.pmod(F.xxhash64(F.lit("sample"), *mix), F.lit(_STEPS)) / _STEPS
    return rows.join(F.broadcast(shares), group).where(place < F.col("_share")).drop("_share")
