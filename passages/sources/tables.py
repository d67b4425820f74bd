"""Parquet tables, staged results and the catalogue of concepts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.functions.text import trim_ws
from passages.session import shared_dir

# Rows that a task meets on average where tables of a few ids are joined.
MET = 1_000_000

CATALOGUE_SCHEMA = (
    "id string, name string, description string, questions array<string>, synonyms array<string>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str, key: str | None = None, parts: str | None = None) -> DataFrame:
    """Write a step's result to the shared folder and go on from the written table.

    It cuts the lineage, survives lost executors, and gives the next step real sizes to plan with.
    The table is removed when the driver ends. With ``key``, a result written in few pieces is spread over the cores again.
    With ``parts``, each value of that column has a folder of its own, so that others need not be read.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, partitionBy=parts)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    return spread(written, key) if key else written


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared place that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    return path


def changed_at(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written, as its file system counts."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files rather than one file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system that holds ``path`` remove it when the driver's session with it ends."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Concept catalogue kept as one JSON document per feature."""
    return spark.read.schema(CATALOGUE_SCHEMA).json(path)


def write_catalogue(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").json(path)


def usable_features(features: DataFrame, order: str = "pos") -> DataFrame:
    """One row per feature id: the last one given wins, rows without an id are left out."""
    last = F.max_by(F.struct("name", "description", "questions", "synonyms"), F.col(order))
    return (
        features.where(F.coalesce(F.col("id"), F.lit("")) != "")
        .groupBy(F.col("id").alias("feature_id"))
        .agg(last.alias("f"))
        .select("feature_id", "f.*")
    )


def synonym_rows(features: DataFrame) -> DataFrame:
    """(feature_id, synonym) of every feature, blanks left out."""
    return features.select(
        F.col("id").alias("feature_id"), F.explode("synonyms").alias("synonym")
    ).where(trim_ws(F.col("synonym")) != "")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share the rows of a table in few pieces out over all cores.

    A row group is read by one task, however heavy the work on its rows, and pieces of a file without
    the start of a row group are empty; so rows are counted by task, which reads no column. A table
    whose largest piece is no more than twice a core's share is left as it is: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("piece")).count()
    pieces, largest, rows = sizes.agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    if not rows or largest * cores <= 2 * rows:
        return df
    return df.repartition(max(cores, pieces), key)


def pieces_of(spark: SparkSession, *rows: int) -> int:
    """Pieces to deal the sides of a join out into, so that a task meets about ``MET`` rows of the largest.

    Adaptive execution puts pieces together by compressed bytes. Ids take few of these, so that its
    pieces grow to many millions of rows, and a task's memory with them.
    """
    return max(spark.sparkContext.defaultParallelism, -(-max(rows) // MET))
