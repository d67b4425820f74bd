"""Contents pages and bookmarks into page-ranged sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.contents import contents_entry
from passages.functions.status import section_fault
from passages.functions.text import trim_ws
from passages.operators.ordering import dense_position, first_by, int_chunk, next_in_group
from passages.sources.tables import stage

ALL_LEVELS = 0


def parse_lines(lines: DataFrame) -> DataFrame:
    """(pdf_id, pos, title, start_page) of the contents lines that name a section."""
    entry = contents_entry(trim_ws(F.col("line")))
    return (
        lines.select("pdf_id", "pos", entry.alias("e"))
        .where(F.col("e").isNotNull())
        .select("pdf_id", "pos", F.col("e.title").alias("title"), F.col("e.page").alias("start_page"))
    )


def drop_repeats(entries: DataFrame) -> DataFrame:
    """First entry per book, page and title, whatever the capitals."""
    keyed = entries.withColumn("_key", F.lower(trim_ws(F.col("title"))))
    return first_by(keyed, ["pdf_id", "start_page", "_key"], F.col("pos")).select(*entries.columns)


def page_ranges(entries: DataFrame, books: DataFrame, piece: Column | None = None) -> DataFrame:
    """Sections with ``end_page`` and 0-based ``sort_order``; books gives (pdf_id, page_count).

    ``piece`` cuts the entries of one page into bounded runs that follow ``pos``; it may be left
    out where pos is a number.

    A section ends before the next one starts, the last at the end of the book. The next start is
    looked up among a book's distinct start pages, however many entries share a page.
    """
    starts = entries.groupBy("pdf_id", "start_page").agg(F.max("pos").alias("_last_pos"))
    nexts = next_in_group(starts, ["pdf_id"], "start_page", "_next")
    placed = dense_position(
        entries,
        ["pdf_id"],
        {"_page": F.col("start_page"), "_piece": int_chunk("pos") if piece is None else piece},
        ["pos"],
        "sort_order",
    )
    counted = F.coalesce("page_count", F.lit(0))
    last = F.when(counted > 0, counted).otherwise(F.col("start_page"))
    # An entry followed by another on its own page ends where it starts.
    tail = F.coalesce(F.col("_next") - 1, last)
    natural = F.when(F.col("pos") < F.col("_last_pos"), F.col("start_page")).otherwise(tail)
    floored = F.greatest(natural, F.col("start_page"))
    end = F.when(counted > 0, F.least(floored, counted)).otherwise(floored)
    return (
        placed.join(nexts, ["pdf_id", "start_page"])
        .join(books.select("pdf_id", "page_count"), "pdf_id", "left")
        .select("pdf_id", "sort_order", "title", "start_page", end.cast("int").alias("end_page"))
    )


def check_sections(sections: DataFrame, books: DataFrame) -> DataFrame:
    """sections with ``fault`` (first rule broken, or null) and ``rejected`` for the whole book."""
    counted = sections.join(books.select("pdf_id", "page_count"), "pdf_id", "left")
    judged = counted.withColumn(
        "fault",
        section_fault(
            F.col("title"), F.col("start_page"), F.col("end_page"), F.coalesce("page_count", F.lit(0))
        ),
    )
    bad = judged.where(F.col("fault").isNotNull()).select("pdf_id").distinct()
    return (
        judged.join(bad.withColumn("rejected", F.lit(True)), "pdf_id", "left")
        .withColumn("rejected", F.coalesce("rejected", F.lit(False)))
        .drop("page_count")
    )


def accepted_sections(offered: DataFrame, books: DataFrame) -> DataFrame:
    """(pdf_id, sort_order, title, start_page, end_page) of the lists without a fault.

    ``offered`` has ``pos`` for ``sort_order``. Lists for unknown books are rejected.
    """
    known = offered.join(books.select("pdf_id"), "pdf_id", "left_semi")
    accepted = check_sections(known, books).where(~F.col("rejected"))
    numbered = dense_position(accepted, ["pdf_id"], {"_piece": int_chunk("pos")}, ["pos"], "sort_order")
    return numbered.select(
        "pdf_id", "sort_order", trim_ws(F.col("title")).alias("title"), "start_page", "end_page"
    )


def replace_sections(stored: DataFrame, offered: DataFrame, books: DataFrame) -> DataFrame:
    """All sections after a save: an accepted list replaces the book's rows, a rejected one does not.

    ``stored`` is as ``accepted_sections`` gives it. Where the table is kept as a ``SavedTable``,
    saving the accepted rows does the same without reading other books.
    """
    fresh = accepted_sections(offered, books)
    kept = stored.join(fresh.select("pdf_id").distinct(), "pdf_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def bookmark_depth(max_depth: int | None = None, include_children: bool | None = None) -> int:
    """Levels to import: a positive depth as given, one level without children, else all."""
    if max_depth is not None:
        return max(max_depth, ALL_LEVELS)
    return 1 if include_children is False else ALL_LEVELS


def flatten_bookmarks(nodes: DataFrame, max_depth: int = ALL_LEVELS) -> DataFrame:
    """(pdf_id, pos, depth, title, start_page) of a bookmark tree.

    ``pos`` is the list of positions from the root down, which sorts as the tree reads.

    ``nodes`` is (pdf_id, node_id, parent_id, pos, title, page). The tree is walked one level per
    join, each level written before the next one starts, so neither depth nor size of a tree is
    bounded by a query plan.
    """
    step = F.col("pos").cast("bigint")
    columns = ["pdf_id", "node_id", "depth", "path", "title", "page"]
    level = nodes.where("parent_id is null").select(
        "pdf_id", "node_id", F.lit(1).alias("depth"), F.array(step).alias("path"), "title", "page"
    )
    below = nodes.where("parent_id is not null").withColumn("_step", step)
    walked, depth = level, 1
    while max_depth <= 0 or depth < max_depth:
        above = level.select("pdf_id", F.col("node_id").alias("parent_id"), F.col("path").alias("_path"))
        level = stage(
            below.join(above, ["pdf_id", "parent_id"])
            .withColumn("path", F.concat("_path", F.array("_step")))
            .withColumn("depth", F.lit(depth + 1))
            .select(*columns),
            "bookmarks",
        )
        if level.isEmpty():
            break
        walked, depth = walked.unionByName(level), depth + 1
    title = trim_ws(F.col("title"))
    return walked.select(
        "pdf_id", F.col("path").alias("pos"), "depth", title.alias("title"), F.col("page").alias("start_page")
    ).where((F.col("title") != "") & (F.col("start_page") >= 1))


def path_piece(levels: int = 2) -> Column:
    """Beginning of a bookmark path, the piece that page_ranges needs for bookmarks."""
    return F.slice("pos", 1, levels)
