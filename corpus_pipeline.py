"""Corpus preparation as a chain of stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.decontaminate import contamination
from passages.llm.pieces import encode_documents
from passages.llm.queries import held_out, piece_model
from passages.llm.secrets import find_secrets, redact
from passages.llm.simhash import simhash_components
from passages.llm.toxicity import train, without_toxic
from passages.sources.tables import read_table, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labelled documents of ``docs``."""
    model = train(docs, read_table(spark, sf_dir, "labels").where(~held_out()))
    return without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links, the one with the smallest id stays; of equal rows, one.

    Links are wider than the default, to find copies with several changes: a similarity of at least 0.8
    on five-word shingles, sought among texts that share a MinHash band or differ in up to 7 bits.
    """
    name = F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("name")
    named = docs.select(F.struct("*").alias("row"), "text", name)
    groups = simhash_components(named, "name", radius=7, count=4, least=0.8).groupBy("name", "component_id").count()
    heads = groups.where("name = component_id").select("name", "count")
    kept = named.select("row", "name").join(heads, "name")
    # Only rows that are repeated as a whole are compared with each other.
    once = kept.where("count = 1").select("row")
    again = kept.where("count > 1").select("row", F.struct("row.doc_id", "row.text").alias("name")).dropDuplicates(["name"])
    return once.unionByName(again.select("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    whole = docs.select(F.struct("*").alias("row"), "text")
    found = contamination(whole, read_table(spark, sf_dir, "benchmark"), "row")
    return found.where("NOT contaminated").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the new text. Other documents stay as they are."""
    found = find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    spans = F.concat("base_spans", "entropy_spans")
    changed = F.size(spans) > 0
    text = F.when(changed, redact(F.col("text"), spans)).otherwise(F.col("text"))
    cleaned = found.select("row", changed.alias("changed"), text.alias("new_text"))
    new = {
        "text": F.col("new_text"),
        "n_chars": F.when(F.col("changed"), F.length("new_text").cast("bigint")).otherwise(F.col("row.n_chars")),
    }
    return cleaned.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and a digest of what they decode to."""
    named = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    found = encode_documents(named, piece_model(), "row")
    return found.select(
        "row.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode),
]

# SQL can't express the kernel machine, SimHash and the tokenizer: tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and reread as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
