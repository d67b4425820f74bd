"""Saved tables that are changed group by group in place, and word tables as tab-separated text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.sources.tables import pieces_of, stage

BUCKETS = 64
_PART = "_bucket"


@dataclass(frozen=True)
class SavedTable:
    """A table in folder ``path``, cut by a hash of ``key`` (a book, a game) into ``buckets`` folders.

    A save rewrites the folders of the groups that it touches and no others, however many groups the
    table holds. ``buckets`` must stay what it was when the table was made. Keys are not null.
    """

    path: str
    key: str
    buckets: int = BUCKETS

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_PART, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, dealt: DataFrame, **options: str) -> None:
        # Buckets are brought together, and split again where one is large.
        spread = dealt.hint("rebalance", _PART)
        spread.write.mode("overwrite").options(**options).partitionBy(_PART).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write the whole table; what was there before goes."""
        self._write(self._dealt(rows), partitionOverwriteMode="static")

    def _stored(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, {_PART} int").parquet(self.path)

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The present rows. ``schema`` names their columns, without any reading of files to find out."""
        return self._stored(spark, schema).drop(_PART)

    def save(self, rows: DataFrame, groups: DataFrame | None = None) -> None:
        """Replace the rows of every group in ``rows``, and of every one in ``groups`` (key) that has none.

        A save that is run again, after a failure or by mistake, leaves the same table.
        """
        spark = rows.sparkSession
        keys = rows.select(self.key) if groups is None else rows.select(self.key).union(groups.select(self.key))
        keys = stage(keys.distinct(), "saved-keys")
        touched = sorted(r[0] for r in self._dealt(keys).select(_PART).distinct().collect())
        if not touched:
            return
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        stored = self._stored(spark, schema).where(F.col(_PART).isin(touched))
        pieces = pieces_of(spark, stored.count(), keys.count())
        old = stored.repartition(pieces, self.key).join(keys.repartition(pieces, self.key), self.key, "left_anti")
        merged = stage(old.select(*rows.columns).unionByName(rows), "saved-rows")
        filled = {r[0] for r in self._dealt(merged).select(_PART).distinct().collect()}
        self._write(self._dealt(merged), partitionOverwriteMode="dynamic")
        # A folder that lost its last row is not rewritten by the writer, so it is removed.
        for bucket in touched:
            if bucket not in filled:
                _remove(spark, f"{self.path}/{_PART}={bucket}")


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


WORD_SCHEMA = "word string, count bigint, pdf_id string"


def write_word_tables(words: DataFrame, path: str) -> None:
    """Each book's frequency table (pdf_id, word, n, forced) as tab-separated text in a folder of its own.

    Lines are in reading order: commonest words first, forced ones after them. A book's table is short,
    so each is one file.
    """
    placed = words.repartition("pdf_id").sortWithinPartitions("pdf_id", "forced", F.desc("n"), "word")
    lines = placed.select("pdf_id", "word", F.col("n").alias("count"))
    lines.write.partitionBy("pdf_id").options(sep="\t", header="true", quote="").csv(path)


def read_word_tables(spark: SparkSession, path: str) -> DataFrame:
    """(pdf_id, word, count) of the tables written so."""
    rows = spark.read.schema(WORD_SCHEMA).options(sep="\t", header="true", quote="").csv(path)
    return rows.select("pdf_id", "word", "count")
