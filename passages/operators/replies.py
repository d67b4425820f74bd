"""Tables of model replies into typed rows and rejects, and the hook that produces them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.functions.replies import (
    first_fitting, json_candidates, loose_definition, loose_ids, loose_page, strip_fence,
)
from passages.functions.text import trim_ws


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies (…, pass, raw) with ``parsed`` JSON text, or null and a ``reason``.

    ``pass`` is glossary, features or cheatsheet.
    """
    stripped = replies.withColumn("_text", strip_fence(F.coalesce("raw", F.lit(""))))
    tried = stripped.withColumn("_tries", json_candidates(F.col("_text")))
    read = tried.withColumn("parsed", first_fitting(F.col("_tries"), F.col("pass")))
    reason = F.when(F.col("parsed").isNull(), F.when(F.col("_text") == "", "empty").otherwise("no fitting JSON"))
    return read.withColumn("reason", reason).drop("_text", "_tries")


def reply_citations(replies: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, feature_id, definition, pos, section_id, section_title, start_page, end_page).

    Loosely typed pages, ids and definitions are settled; a citation with several ids gives a row
    for each, one without id, title and page gives none. Entries without citations keep a row.
    """
    whole = F.try_parse_json(raw)
    cells = F.try_variant_get(F.col("_v"), "$.citations", "array<variant>")
    entry = replies.select(key, whole.alias("_v")).select(
        key,
        F.try_variant_get("_v", "$.feature_id", "string").alias("feature_id"),
        loose_definition(F.try_variant_get("_v", "$.definition", "variant")).alias("definition"),
        F.posexplode_outer(cells).alias("pos", "_c"),
    )

    def part(name: str):
        return F.try_variant_get("_c", f"$.{name}", "variant")

    read = entry.select(
        key,
        "feature_id",
        "definition",
        "pos",
        trim_ws(F.coalesce(F.try_variant_get("_c", "$.section_title", "string"), F.lit(""))).alias("section_title"),
        loose_page(part("start_page")).alias("start_page"),
        loose_page(part("end_page")).alias("_end"),
        loose_ids(part("section_id")).alias("_ids"),
    )
    late = (F.col("_end") > 0) & (F.col("_end") < F.col("start_page"))
    settled = read.withColumn("end_page", F.when(late, F.col("start_page")).otherwise(F.col("_end")))
    kept = settled.where(
        F.col("pos").isNull() | (F.size("_ids") > 0) | (F.col("section_title") != "") | (F.col("start_page") > 0)
    )
    return kept.select(
        key, "feature_id", "definition", "pos", F.explode_outer("_ids").alias("section_id"),
        "section_title", "start_page", "end_page",
    )


def generate(prompts: DataFrame, keys: list[str], reply: Callable[[str], str]) -> DataFrame:
    """(keys…, raw, error): replies to ``prompt`` by a caller's function, called in the tasks."""
    types = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", raw string, error string"

    def answer(text: str) -> tuple[str | None, str | None]:
        try:
            return reply(text), None
        except Exception as e:  # noqa: BLE001 - a failing call must not end the job
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [answer(p) for p in batch["prompt"]]
            out = batch[keys].copy()
            out["raw"] = [a for a, _ in answers]
            out["error"] = [e for _, e in answers]
            yield out

    return prompts.select(*keys, "prompt").mapInPandas(run, schema)
