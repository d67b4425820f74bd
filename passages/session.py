"""Session settings, size-checked broadcasts and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it has been measured and has no more rows and bytes than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def build_session(app_name: str = "passages", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables, as named by the cluster.

    Where ``spark.checkpoint.dir`` is unset, a run on this machine alone gets a local folder, which
    the session remembers. Executors elsewhere could not see that folder, so a cluster is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="passages-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast after measuring; past the bounds the join is left to a shuffle and AQE.

    Measuring stops one row past the bound, so a huge side costs no more than a small one. Bytes are
    those of the texts and lists, and eight for any other value.
    """
    sizes = [_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields]
    first = df.select(sum(sizes, F.lit(0)).alias("n")).limit(max_rows + 1)
    rows, held = first.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and held <= max_bytes else df


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
    return F.lit(8)
