"""Per-book metadata: reading, upgrading, cleaning and writing the JSON form, and its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import distinct_ignoring_case, let, trim_ws
from passages.operators.ordering import latest_by

CITATION = "struct<section_id:string,section_title:string,start_page:int,end_page:int>"
GLOSSARY = "array<struct<feature_id:string,terms:array<string>>>"
CHEATSHEET = f"array<struct<feature_id:string,definition:string,citations:array<{CITATION}>>>"
META = (
    f"struct<glossary:{GLOSSARY},features:array<string>,cheatsheet:{CHEATSHEET},"
    "llm_learnings_skipped:boolean>"
)

# Earlier stored forms of the three lists.
OLD_FEATURES = "array<struct<feature_id:string>>"
OLD_GLOSSARY = "array<struct<feature_id:string,pdf_term:string>>"
OLD_CHEATSHEET = (
    "array<struct<feature_id:string,feature_name:string,section:string,start_page:int>>"
)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def parse_meta(raw: Column) -> Column:
    """Metadata struct of a stored JSON text in its present or an earlier form, cleaned.

    Each list is read from its own JSON fragment, so one list may be old and another new. A text
    that is no JSON gives the empty metadata.
    """

    def part(name: str) -> Column:
        return F.get_json_object(raw, f"$.{name}")

    def flag(name: str) -> Column:
        return F.coalesce(part(name) == "true", F.lit(False))

    listed = part("features")
    are_rows = F.coalesce(F.get_json_object(listed, "$[0].feature_id").isNotNull(), F.lit(False))
    old_ids = F.filter(
        F.transform(F.from_json(listed, OLD_FEATURES), lambda f: trim_ws(f["feature_id"])),
        lambda x: x != "",
    )
    features = F.when(are_rows, old_ids).otherwise(F.from_json(listed, "array<string>"))

    new_glossary = F.from_json(part("glossary"), GLOSSARY)
    has_terms = F.size(F.get(new_glossary, F.lit(0))["terms"]) > 0
    glossary = F.when(has_terms, new_glossary).otherwise(
        regroup_terms(F.from_json(part("glossary"), OLD_GLOSSARY))
    )

    new_sheet = F.from_json(part("cheatsheet"), CHEATSHEET)
    has_text = F.coalesce(F.get(new_sheet, F.lit(0))["definition"], F.lit("")) != ""
    old_sheet = F.filter(
        F.transform(F.from_json(part("cheatsheet"), OLD_CHEATSHEET), _upgrade_entry),
        lambda e: e["feature_id"] != "",
    )
    sheet = F.when(has_text, new_sheet).otherwise(old_sheet)

    return clean_meta(
        F.coalesce(glossary, _empty(GLOSSARY)),
        F.coalesce(features, _empty("array<string>")),
        F.coalesce(sheet, _empty(CHEATSHEET)),
        flag("llm_learnings_skipped") | flag("llm_glossary_skipped"),
    )


def regroup_terms(rows: Column) -> Column:
    """[(feature, term)] as [(feature, sorted distinct terms)], ordered by feature."""
    pairs = F.filter(
        F.transform(
            rows,
            lambda r: F.struct(
                trim_ws(r["feature_id"]).alias("feature_id"), trim_ws(r["pdf_term"]).alias("term")
            ),
        ),
        lambda p: (p["feature_id"] != "") & (p["term"] != ""),
    )

    def grouped(given: Column) -> Column:
        def entry(i: Column) -> Column:
            mine = F.filter(given, lambda p: p["feature_id"] == i)
            terms = F.array_sort(F.array_distinct(F.transform(mine, lambda p: p["term"])))
            return F.struct(i.alias("feature_id"), terms.alias("terms"))

        ids = F.array_distinct(F.transform(given, lambda p: p["feature_id"]))
        return F.transform(F.array_sort(ids), entry)

    return let(pairs, grouped)


def _upgrade_entry(e: Column) -> Column:
    section = F.coalesce(e["section"], F.lit(""))
    cited = F.array(
        F.struct(
            F.lit("").alias("section_id"),
            trim_ws(section).alias("section_title"),
            F.coalesce(e["start_page"], F.lit(0)).alias("start_page"),
            F.lit(0).alias("end_page"),
        )
    )
    return F.struct(
        trim_ws(F.coalesce(e["feature_id"], F.lit(""))).alias("feature_id"),
        trim_ws(F.coalesce(e["feature_name"], F.lit(""))).alias("definition"),
        F.when(section != "", cited).otherwise(_empty(f"array<{CITATION}>")).alias("citations"),
    )


def clean_meta(glossary: Column, features: Column, cheatsheet: Column, skipped: Column) -> Column:
    """Trimmed, de-duplicated and ordered metadata struct."""

    def bare(c: Column) -> Column:
        return trim_ws(F.coalesce(c, F.lit("")))

    def glossary_entry(g: Column) -> Column:
        kept = F.filter(F.transform(g["terms"], bare), lambda t: t != "")
        terms = F.coalesce(F.array_sort(distinct_ignoring_case(kept)), _empty("array<string>"))
        return F.struct(bare(g["feature_id"]).alias("feature_id"), terms.alias("terms"))

    def citation(c: Column) -> Column:
        return F.struct(
            bare(c["section_id"]).alias("section_id"),
            bare(c["section_title"]).alias("section_title"),
            F.coalesce(c["start_page"], F.lit(0)).alias("start_page"),
            F.coalesce(c["end_page"], F.lit(0)).alias("end_page"),
        )

    def sheet_entry(e: Column) -> Column:
        cited = F.filter(
            F.transform(e["citations"], citation),
            lambda c: (c["section_title"] != "") | (c["start_page"] > 0),
        )
        return F.struct(
            bare(e["feature_id"]).alias("feature_id"),
            bare(e["definition"]).alias("definition"),
            F.coalesce(cited, _empty(f"array<{CITATION}>")).alias("citations"),
        )

    def by_feature(rows: Column) -> Column:
        return F.array_sort(
            rows,
            lambda a, b: F.when(a["feature_id"] < b["feature_id"], F.lit(-1))
            .when(a["feature_id"] > b["feature_id"], F.lit(1))
            .otherwise(F.lit(0)),
        )

    entries = F.filter(
        F.transform(glossary, glossary_entry),
        lambda g: (g["feature_id"] != "") & (F.size(g["terms"]) > 0),
    )
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(features, bare), lambda x: x != "")))
    sheet = F.filter(F.transform(cheatsheet, sheet_entry), lambda e: e["feature_id"] != "")
    return F.struct(
        by_feature(entries).alias("glossary"),
        ids.alias("features"),
        by_feature(sheet).alias("cheatsheet"),
        F.coalesce(skipped, F.lit(False)).alias("llm_learnings_skipped"),
    )


def meta_json(meta: Column) -> Column:
    return F.to_json(meta)


def part_rows(metas: DataFrame, meta: str = "meta") -> DataFrame:
    """(pdf_id, part, feature_id, text, cited) of every feature, term, entry and citation.

    ``text`` is the term or the entry's definition, ``cited`` the citation. One pass: a meta is made once,
    whatever it is computed from, and all its rows come from it.
    """
    parts = F.col(meta)

    def row(part: str, feature: Column, text: Column = F.lit(""), cited: Column | None = None) -> Column:
        cited = F.lit(None).cast(CITATION) if cited is None else cited
        return F.struct(F.lit(part).alias("part"), feature.alias("feature_id"), text.alias("text"), cited.alias("cited"))

    terms = F.transform(parts["glossary"], lambda g: F.transform(g["terms"], lambda t: row("term", g["feature_id"], t)))
    entries = F.transform(
        parts["cheatsheet"],
        lambda e: F.concat(
            F.array(row("entry", e["feature_id"], e["definition"])),
            F.transform(e["citations"], lambda c: row("citation", e["feature_id"], cited=c)),
        ),
    )
    features = F.transform(parts["features"], lambda f: row("feature", f))
    return metas.select("pdf_id", F.inline(F.concat(features, F.flatten(terms), F.flatten(entries))))


def merge_glossaries(existing: DataFrame, updated: DataFrame) -> DataFrame:
    """(pdf_id, feature_id, term) of both, trimmed and distinct."""
    both = existing.unionByName(updated).select(
        "pdf_id",
        trim_ws(F.col("feature_id")).alias("feature_id"),
        trim_ws(F.col("term")).alias("term"),
    )
    return both.where((F.col("feature_id") != "") & (F.col("term") != "")).distinct()


def known_features(found: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct (pdf_id, feature_id) whose trimmed id the catalogue holds."""
    bare = found.select("pdf_id", trim_ws(F.col("feature_id")).alias("feature_id"))
    return bare.join(features.select("feature_id"), "feature_id", "left_semi").distinct()


def known_glossary(found: DataFrame, features: DataFrame) -> DataFrame:
    """(pdf_id, feature_id, pos, term): trimmed terms of features the catalogue holds, in order."""
    bare = found.select(
        "pdf_id",
        trim_ws(F.col("feature_id")).alias("feature_id"),
        "pos",
        trim_ws(F.col("term")).alias("term"),
    )
    return bare.where(F.col("term") != "").join(
        features.select("feature_id"), "feature_id", "left_semi"
    )


def pending_features(detected: DataFrame, cheatsheet: DataFrame) -> DataFrame:
    """Detected features that still lack a cheatsheet entry."""
    return detected.join(
        cheatsheet.select("pdf_id", "feature_id"), ["pdf_id", "feature_id"], "left_anti"
    )


def incomplete_books(detected: DataFrame, cheatsheet: DataFrame, books: DataFrame) -> DataFrame:
    """(pdf_id, incomplete): any detected feature without an entry; false without features."""
    pending = pending_features(detected, cheatsheet).select("pdf_id").distinct()
    return books.select("pdf_id").join(
        pending.withColumn("incomplete", F.lit(True)), "pdf_id", "left"
    ).withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))


def rebuildable_features(detected: DataFrame, cheatsheet: DataFrame) -> DataFrame:
    """Features one may rebuild: detected or already on the cheatsheet."""
    columns = ["pdf_id", "feature_id"]
    return detected.select(*columns).unionByName(cheatsheet.select(*columns)).distinct()


def upsert_entries(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Cheatsheet after changes: the last write of each (pdf_id, feature_id) by ``seq`` stays."""
    return latest_by(stored.unionByName(changed), ["pdf_id", "feature_id"], F.col("seq"))


def fallback_entries(requests: DataFrame, built: DataFrame, features: DataFrame) -> DataFrame:
    """(pdf_id, feature_id, definition, from_catalogue): built text, else the catalogue's, else none."""
    catalogue = features.select("feature_id", trim_ws(F.col("description")).alias("_description"))
    text = trim_ws(F.coalesce("definition", F.lit("")))
    return (
        requests.join(built, ["pdf_id", "feature_id"], "left")
        .join(catalogue, "feature_id", "left")
        .select(
            "pdf_id",
            "feature_id",
            F.when(text != "", text).otherwise(F.col("_description")).alias("definition"),
            (text == "").alias("from_catalogue"),
        )
        .where(F.coalesce("definition", F.lit("")) != "")
    )


def features_of_games(detected: DataFrame, attached: DataFrame, features: DataFrame) -> DataFrame:
    """(game_id, feature_id, line): features found in a game's books, with their catalogue line."""
    found = (
        attached.select("game_id", "pdf_id")
        .join(detected.where(F.col("feature_id") != ""), "pdf_id")
        .select("game_id", "feature_id")
        .distinct()
    )
    name = F.coalesce(F.nullif(trim_ws(F.col("name")), F.lit("")), F.col("feature_id"))
    described = trim_ws(F.coalesce("description", F.lit("")))
    line = F.when(F.col("name").isNull(), F.concat(F.lit("- "), F.col("feature_id"))).otherwise(
        F.concat(
            F.format_string("- %s (%s)", F.col("feature_id"), name),
            F.when(described != "", F.concat(F.lit(": "), described)).otherwise(F.lit("")),
        )
    )
    return found.join(features, "feature_id", "left").select(
        "game_id", "feature_id", line.alias("line")
    )
