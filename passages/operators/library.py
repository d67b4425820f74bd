"""Books, games and the ordered lists that attach books to games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.status import document_fault, name_fault
from passages.functions.text import trim_ws
from passages.operators.ordering import latest_by
from passages.session import broadcast_if_small
from passages.sources.tables import pieces_of, stage

ALL, ACTIVE, ARCHIVED = "all", "active", "archived"


def games_list(games: DataFrame, which: str = ACTIVE) -> DataFrame:
    """Games newest first: active ones, archived ones or all."""
    if which == ARCHIVED:
        games = games.where("archived")
    elif which != ALL:
        games = games.where("not archived")
    return games.orderBy(F.desc("updated_at"), "game_id")


def count_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def with_counts(base: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    return base.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def path_status(books: DataFrame, files: DataFrame) -> DataFrame:
    """books with ``path_status``: ok where the file listing holds the path, else missing."""
    present = files.select(F.col("path").alias("file_path")).distinct().withColumn("_ok", F.lit(True))
    blank = trim_ws(F.coalesce("file_path", F.lit(""))) == ""
    found = F.coalesce("_ok", F.lit(False)) & ~blank
    status = F.when(found, F.lit("ok")).otherwise(F.lit("missing"))
    return books.join(present, "file_path", "left").withColumn("path_status", status).drop("_ok")


def game_books(attached: DataFrame, books: DataFrame, section_counts: DataFrame) -> DataFrame:
    """Books of each game in list order, with their number of sections."""
    return with_counts(attached.join(books, "pdf_id"), section_counts, "pdf_id", "section_count")


def unattached(books: DataFrame, attached: DataFrame) -> DataFrame:
    return books.join(attached.select("pdf_id"), "pdf_id", "left_anti")


def deletable(requests: DataFrame, books: DataFrame, attached: DataFrame) -> DataFrame:
    """requests (pdf_id) with ``verdict``: deleted, not found, or how many games hold the book."""
    refs = count_by(attached, "pdf_id", "refs")
    known = books.select("pdf_id").withColumn("_known", F.lit(True))
    joined = requests.join(refs, "pdf_id", "left").join(known, "pdf_id", "left")
    verdict = (
        F.when(
            F.col("refs") > 0,
            F.format_string("pdf is attached to %d game(s); detach it first", F.col("refs")),
        )
        .when(F.col("_known").isNull(), F.lit("pdf not found"))
        .otherwise(F.lit("deleted"))
    )
    return joined.select("pdf_id", verdict.alias("verdict"))


def attach_lists(lists: DataFrame, books: DataFrame, games: DataFrame) -> DataFrame:
    """Accepted lists as (game_id, pdf_id, sort_order).

    ``lists`` is (game_id, pdf_ids). A list is refused as a whole if the game is unknown, an id is
    blank or repeated, or a book is unknown.
    """
    entries = lists.agg(F.coalesce(F.sum(F.greatest(F.size("pdf_ids"), F.lit(1))), F.lit(0))).first()[0]
    pieces = pieces_of(lists.sparkSession, entries, games.count(), books.count())
    known = lists.repartition(pieces, "game_id").join(games.select("game_id").repartition(pieces, "game_id"), "game_id", "left_semi")
    rows = known.select("game_id", F.posexplode("pdf_ids").alias("sort_order", "pdf_id"))
    blank = F.coalesce(F.col("pdf_id").cast("string"), F.lit("")) == ""
    # Each book is looked up once, in however many lists it stands.
    named = rows.select("pdf_id").repartition(pieces, "pdf_id").distinct()
    strange = stage(named.join(books.select("pdf_id").repartition(pieces, "pdf_id"), "pdf_id", "left_anti"), "strange")
    marked = rows.join(broadcast_if_small(strange.withColumn("_strange", F.lit(True))), "pdf_id", "left")
    faults = marked.groupBy("game_id", "pdf_id").agg(F.count(F.lit(1)).alias("n"), F.max(blank | F.col("_strange").isNotNull()).alias("bad"))
    refused = faults.where("n > 1 or bad").select("game_id").repartition(pieces, "game_id").distinct()
    return rows.join(refused, "game_id", "left_anti").select("game_id", "pdf_id", "sort_order")


def upsert_books(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Books after changes (pdf_id, title, file_path, page_count, index_status, seq).

    Blank fields of a change keep the stored value; a blank status becomes "none"; changes that
    leave a book without title or path are refused. Later ``seq`` wins.
    """
    return _patched(
        stored, changed, "pdf_id",
        {"title": _text, "file_path": _text, "page_count": None, "index_status": _status},
        lambda: document_fault(F.col("title"), F.col("file_path")),
    )


def upsert_games(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Games after changes (game_id, name, notes, seq); faulty names are refused."""
    return _patched(
        stored, changed, "game_id", {"name": _text, "notes": None}, lambda: name_fault(F.col("name"))
    )


def _text(c: Column) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def _status(c: Column) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def _patched(stored, changed, key, columns, fault) -> DataFrame:
    """Last given value of every column by ``seq``, so partial changes add up."""
    rows = stored.unionByName(changed)
    cleaned = rows.select(
        key, "seq", *[(f(F.col(c)) if f else F.col(c)).alias(c) for c, f in columns.items()]
    )
    given = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns
    ]
    merged = cleaned.groupBy(key).agg(*given)
    if "index_status" in columns:
        merged = merged.withColumn("index_status", F.coalesce("index_status", F.lit("none")))
    return merged.where(fault().isNull())


def apply_commands(books: DataFrame, commands: DataFrame) -> DataFrame:
    """Books after status commands (pdf_id, seq, kind, value, at).

    A status command sets status and indexed_at together, so a command without a time clears it; a
    thumbnail command sets the thumbnail path only.
    """
    status = F.when(F.col("kind") == "status", F.struct("seq", "value", "at"))
    thumb = F.when(F.col("kind") == "thumbnail", F.struct("seq", "value"))
    last = commands.groupBy("pdf_id").agg(F.max(status).alias("_status"), F.max(thumb).alias("_thumb"))
    told = F.col("_status").isNotNull()
    return books.join(last, "pdf_id", "left").select(
        *[
            c
            for c in books.columns
            if c not in ("index_status", "indexed_at", "thumbnail_path")
        ],
        F.when(told, F.col("_status.value")).otherwise(F.col("index_status")).alias("index_status"),
        F.when(told, F.col("_status.at")).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(F.col("_thumb").isNotNull(), F.col("_thumb.value"))
        .otherwise(F.col("thumbnail_path"))
        .alias("thumbnail_path"),
    )


def game_marks(commands: DataFrame) -> DataFrame:
    """(game_id, started, halted, archived_at, restored_at): last seq of each kind of command.

    ``commands`` is (game_id, seq, kind) with kinds start, stop, archive and restore. These maxima
    are all that is needed to tell which games run, and they merge, so the log is never ordered.
    """

    def last(*kinds: str) -> Column:
        return F.max(F.when(F.col("kind").isin(*kinds), F.col("seq")))

    return commands.groupBy("game_id").agg(
        last("start").alias("started"),
        last("stop", "archive").alias("halted"),
        last("archive").alias("archived_at"),
        last("restore", "start").alias("restored_at"),
    )


def game_states(marks: DataFrame) -> DataFrame:
    """(game_id, running, archived): at most one game runs, the last one started."""
    latest = marks.agg(F.max("started").alias("m")).scalar()
    halted = F.coalesce(F.col("halted") > F.col("started"), F.lit(False))
    running = F.coalesce(F.col("started") == latest, F.lit(False)) & ~halted
    archived = F.col("archived_at").isNotNull() & ~F.coalesce(
        F.col("restored_at") > F.col("archived_at"), F.lit(False)
    )
    return marks.select("game_id", running.alias("running"), archived.alias("archived"))


def latest_texts(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Section texts after arrivals: the last text of each known section by ``seq``."""
    known = arrived.join(stored.select("section_id"), "section_id", "left_semi")
    return latest_by(stored.unionByName(known), ["section_id"], F.col("seq"))


def title_from_path(path: Column) -> Column:
    """File name without folders and extension."""
    name = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return trim_ws(F.regexp_replace(name, r"\.[^.]*\z", ""))


def is_pdf_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)\z", 1)) == ".pdf"
