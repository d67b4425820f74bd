"""Progress, time and validation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passages.functions.text import trim_ws

# Percent of the bar at which each phase starts, and how much of it the phase fills.
PHASE_START = {
    "thumbnail": 2.0,
    "sections": 8.0,
    "glossary_llm": 60.0,
    "features_llm": 70.0,
    "cheatsheet_llm": 78.0,
    "finalize": 96.0,
    "done": 100.0,
    "error": 0.0,
}
PHASE_SPAN = {"sections": 52.0, "glossary_llm": 10.0, "features_llm": 8.0, "cheatsheet_llm": 17.0}
THUMBNAIL_READY = 8.0
QUIET_PHASES = ["idle", "done", "error"]
NAME_BYTES = 120

# What a phase is called while it runs, and the faults of what is saved.
THUMBNAIL_TEXT = "Rendering thumbnail"
SECTION_TEXT = "Indexing section: "
GLOSSARY_TEXT = "Extracting glossary (LLM %d/%d)"
FEATURES_TEXT = "Detecting features (LLM %d/%d)"
SHEET_ENTRY_TEXT = "Building cheatsheet: %s (%d/%d)"
SHEET_DONE_TEXT = "Cheatsheet complete (%d/%d)"
SHEET_TEXT = "Building cheatsheet entries (%d/%d)"
FINAL_TEXT = "Finishing up"
DONE_TEXT = "Complete"
NO_TITLE = "title is required"
NO_PATH = "file path is required"
NO_NAME = "name is required"
LONG_NAME = "name must be at most %d characters"
LOW_START = "start page must be at least 1"
LOW_END = "end page must be >= start page"
BEYOND = "page range exceeds document page count (%d)"


def progress_percent(phase: Column, current: Column, total: Column) -> Column:
    whole = F.when(total <= 0, F.lit(1)).otherwise(total)
    clamped = F.least(F.greatest(current, F.lit(0)), whole)
    out = F.lit(0.0)
    for name, start in PHASE_START.items():
        value = F.lit(start)
        if name in PHASE_SPAN:
            done = clamped if name == "cheatsheet_llm" else current
            value = value + done / whole * F.lit(PHASE_SPAN[name])
        elif name == "thumbnail":
            value = F.when(current > 0, F.lit(THUMBNAIL_READY)).otherwise(value)
        out = F.when(phase == name, value).otherwise(out)
    return out


def is_active(phase: Column) -> Column:
    return ~phase.isin(QUIET_PHASES)


def progress_message(phase: Column, current: Column, total: Column, label: Column) -> Column:
    whole = F.when(total <= 0, F.lit(1)).otherwise(total)
    clamped = F.least(F.greatest(current, F.lit(0)), whole)
    sheet = (
        F.when(label != "", F.format_string(SHEET_ENTRY_TEXT, label, clamped, whole))
        .when(clamped >= whole, F.format_string(SHEET_DONE_TEXT, whole, whole))
        .otherwise(F.format_string(SHEET_TEXT, clamped, whole))
    )
    return (
        F.when(phase == "thumbnail", F.lit(THUMBNAIL_TEXT))
        .when(phase == "sections", F.concat(F.lit(SECTION_TEXT), label))
        .when(phase == "glossary_llm", F.format_string(GLOSSARY_TEXT, current, whole))
        .when(phase == "features_llm", F.format_string(FEATURES_TEXT, current, whole))
        .when(phase == "cheatsheet_llm", sheet)
        .when(phase == "finalize", F.lit(FINAL_TEXT))
        .when(phase == "done", F.lit(DONE_TEXT))
        .otherwise(label)
    )


def parse_time(c: Column) -> Column:
    """UTC timestamp of a stored time text; blank or unknown forms give null.

    Accepted: date and time joined by T with an offset or Z, or by a space without one; the seconds
    may carry a fraction. Fractions beyond microseconds are cut off.
    """
    text = trim_ws(c)
    zoned = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"
    local = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?\z"
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(zoned), cut.try_cast("timestamp")).when(
        text.rlike(local), F.concat(cut, F.lit("Z")).try_cast("timestamp")
    )


def format_time(ts: Column) -> Column:
    """RFC 3339 in UTC, without trailing zeros in the fraction."""
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(utc, r"\.?0+\z", ""), F.lit("Z"))


def section_fault(title: Column, start: Column, end: Column, page_count: Column) -> Column:
    """First rule a contents section breaks, or null."""
    return (
        F.when(trim_ws(title) == "", F.lit(NO_TITLE))
        .when(start < 1, F.lit(LOW_START))
        .when(end < start, F.lit(LOW_END))
        .when(
            (page_count > 0) & ((start > page_count) | (end > page_count)),
            F.format_string(BEYOND, page_count),
        )
    )


def name_fault(name: Column) -> Column:
    bare = trim_ws(name)
    return F.when(bare == "", F.lit(NO_NAME)).when(
        F.octet_length(bare) > NAME_BYTES, F.lit(LONG_NAME % NAME_BYTES)
    )


def document_fault(title: Column, path: Column) -> Column:
    return F.when(trim_ws(title) == "", F.lit(NO_TITLE)).when(
        trim_ws(path) == "", F.lit(NO_PATH)
    )
