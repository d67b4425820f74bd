"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import status, text
from passages.operators import library
from passages.queries import bindings as b
from passages.queries.bindings import (
    collapse_sql, fields_sql, trim_sql, with_sql,
)
from passages.queries.registry import query
from passages.sources.tables import read_table

# Plain text with the marks of typeset documents put in, so that there is something to undo.
TYPESET = [("'", "’"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), (". ", "… "), (", ", " – ")]
TYPESET_SQL = "text"
for _plain, _mark in TYPESET:
    TYPESET_SQL = f"replace({TYPESET_SQL}, {b.quote(_plain)}, {b.quote(_mark)})"


def typeset(c):
    for plain, mark in TYPESET:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def normalize_sql(expr: str) -> str:
    for mark, plain in text.PUNCTUATION.items():
        expr = f"replace({expr}, {b.quote(mark)}, {b.quote(plain)})"
    return expr


@query("normalize_text", f"SELECT doc_id, {normalize_sql(TYPESET_SQL)} AS plain FROM documents")
def normalize_text(spark, folder):
    marked = typeset(F.col("text"))
    return read_table(spark, folder, "documents").select(
        "doc_id", text.normalize_punctuation(marked).alias("plain")
    )


@query("truncate_words", f"""SELECT doc_id,
CASE WHEN len({fields_sql('text')}) > 40 THEN array_to_string(list_slice({fields_sql('text')}, 1, 40), ' ') || '...'
     ELSE {trim_sql('text')} END AS short,
array_to_string(list_slice({fields_sql('text')}, 1, 400), ' ')
  || CASE WHEN len({fields_sql('text')}) > 400 THEN '...' ELSE '' END AS excerpt
FROM documents""")
def truncate_words(spark, folder):
    return read_table(spark, folder, "documents").select(
        "doc_id",
        text.truncate_words(F.col("text"), 40).alias("short"),
        text.citation_excerpt(F.col("text")).alias("excerpt"),
    )


def _preview_sql(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) > {n} THEN left({expr}, {n}) || '…' ELSE {expr} END"


@query("preview", f"""SELECT conv_id, turn, {_preview_sql('text', 120)} AS preview,
{_preview_sql(collapse_sql('text'), 200)} AS flat FROM conversations""")
def preview(spark, folder):
    return read_table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        text.preview(F.col("text"), 120).alias("preview"),
        text.flat_preview(F.col("text"), 200).alias("flat"),
    )


DICE_TEXT_SQL = """'roll ' || p_size || 'D6-2 and d' || p_size || ', then ' || p_size || 'd6-2x, D'
|| p_size || ' or ' || (p_size + 1) || 'D for ' || p_name"""
DICE_RE = r"(?i)\b(\d*[dD]\d+(?:[+-]\d+)?|\d+[dD](?:[+-]\d+)?)\b"


def _distinct_sql(words: str) -> str:
    return (
        f"list_filter({words}, lambda x, i: "
        f"list_position(list_transform({words}, lambda y: lower(y)), lower(x)) = i)"
    )


DICE_SQL = _distinct_sql(f"regexp_extract_all(roll, '{DICE_RE}', 1)")


def dice_texts(spark, folder):
    size = F.col("p_size").cast("string")
    return read_table(spark, folder, "part").select(
        "p_partkey",
        F.concat(
            F.lit("roll "), size, F.lit("D6-2 and d"), size, F.lit(", then "), size, F.lit("d6-2x, D"),
            size, F.lit(" or "), (F.col("p_size") + 1).cast("string"), F.lit("D for "), F.col("p_name"),
        ).alias("roll"),
    )


@query("dice_tokens", f"""SELECT p_partkey, array_to_string({DICE_SQL}, ',') AS dice
FROM (SELECT p_partkey, {DICE_TEXT_SQL} AS roll FROM part)""")
def dice_tokens(spark, folder):
    tokens = text.dice_tokens(F.col("roll"))
    return dice_texts(spark, folder).select("p_partkey", F.array_join(tokens, ",").alias("dice"))


@query("preserve_dice", f"""SELECT p_partkey, array_to_string(list_concat(words,
list_filter(dice, lambda x: NOT list_contains(list_transform(words, lambda w: lower(w)), lower(x)))), ' ') AS merged
FROM (SELECT p_partkey, {DICE_SQL} AS dice, {fields_sql('roll2')} AS words
      FROM (SELECT p_partkey, {DICE_TEXT_SQL} AS roll, 'Roll the d' || p_size || ' ' || p_name AS roll2 FROM part))""")
def preserve_dice(spark, folder):
    rolls = dice_texts(spark, folder)
    merged = F.concat(F.lit("Roll the d"), F.regexp_extract("roll", r"d(\d+),", 1), F.lit(" "),
                      F.regexp_extract("roll", r"for (.*)$", 1))
    return rolls.select("p_partkey", text.keep_dice(F.col("roll"), merged).alias("merged"))


# A rewriter's reply made of a conversation turn: quoted, with commas and later lines.
REPLY_SQL = "' \"' || text || '\" ' || chr(10) || 'second line'"


def _clean_sql(reply: str) -> str:
    first = f"regexp_extract({trim_sql(reply)}, '^[^\\n\\r]*')"
    bare = f"""regexp_replace({first}, '^["'']+|["'']+\\z', '', 'g')"""
    words = fields_sql(f"replace({bare}, ',', ' ')")
    return f"array_to_string({words}, ' ')"


def replies():
    return F.concat(F.lit(' "'), F.col("text"), F.lit('" \nsecond line'))


@query("rewrite_clean", f"SELECT conv_id, turn, {_clean_sql(REPLY_SQL)} AS keywords FROM conversations")
def rewrite_clean(spark, folder):
    return read_table(spark, folder, "conversations").select(
        "conv_id", "turn", text.clean_keywords(replies()).alias("keywords")
    )


def _unquoted_sql(expr: str) -> str:
    return (
        f"list_filter(list_transform({fields_sql(expr)}, "
        """lambda w: regexp_replace(w, '^["'']+|["'']+\\z', '', 'g')), lambda w: w <> '')"""
    )


@query("merge_queries", f"""WITH pairs AS (
SELECT a.conv_id, a.turn, {_unquoted_sql('b.text')} AS x, {_unquoted_sql('a.text')} AS y
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1),
words AS (SELECT conv_id, turn, list_concat(x, y) AS w FROM pairs),
firsts AS (
SELECT conv_id, turn, lower(word) AS k, min(pos) AS pos, arg_min(word, pos) AS word
FROM (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words) GROUP BY ALL)
SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS merged FROM firsts GROUP BY ALL""")
def merge_queries(spark, folder):
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return turns.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.merge_words(F.col("asked"), F.col("text")).alias("merged")
    )


@query("parse_times", r"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second,
CAST(microsecond(ts) % 1000000 AS BIGINT) AS micros,
regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+\z', '') || 'Z' AS stored, CAST(3 AS INTEGER) AS forms FROM events""")
def parse_times(spark, folder):
    """Every event time written in three stored forms, read back and written once more."""
    events = read_table(spark, folder, "events").select("event_id", "ts")
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    east = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    forms = F.array(
        F.concat(F.lit(" "), local, F.lit("789")),
        F.concat(F.replace(local, F.lit(" "), F.lit("T")), F.lit("Z")),
        F.concat(east, F.lit("+02:00")),
        F.lit("  "),
        F.lit("yesterday"),
    )
    parsed = F.transform(forms, status.parse_time)
    read = F.filter(parsed, lambda t: t == F.col("ts"))
    return events.select(
        "event_id",
        F.date_format(parsed[0], "yyyy-MM-dd HH:mm:ss").alias("second"),
        (F.unix_micros(parsed[0]) % 1000000).alias("micros"),
        status.format_time(parsed[2]).alias("stored"),
        F.size(read).alias("forms"),
    )


# Progress rows out of the event log: the kind of event stands for a phase.
PHASES = {
    "signup": "thumbnail", "view": "sections", "click": "cheatsheet_llm",
    "purchase": "features_llm", "error": "error",
}
PROGRESS_SQL = """progress AS (
SELECT event_id, ts, user_id AS pdf_id,
CASE event_type WHEN 'signup' THEN 'thumbnail' WHEN 'view' THEN 'sections' WHEN 'click' THEN 'cheatsheet_llm'
     WHEN 'purchase' THEN 'features_llm' ELSE 'error' END AS phase,
CAST(floor(value) AS INTEGER) AS current, CAST(json_extract(props, '$.k') AS INTEGER) AS total
FROM events)"""


def progress(events):
    phase = F.lit(PHASES["error"])
    for kind, name in PHASES.items():
        phase = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(phase)
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("pdf_id"),
        phase.alias("phase"),
        F.floor("value").cast("int").alias("current"),
        F.get_json_object("props", "$.k").cast("int").alias("total"),
    )


PERCENT_SQL = """CASE phase WHEN 'thumbnail' THEN CASE WHEN current > 0 THEN 8.0 ELSE 2.0 END
WHEN 'sections' THEN 8 + current / whole * 52 WHEN 'features_llm' THEN 70 + current / whole * 8
WHEN 'cheatsheet_llm' THEN 78 + least(greatest(current, 0), whole) / whole * 17 ELSE 0.0 END"""

MESSAGE_SQL = """CASE phase WHEN 'thumbnail' THEN 'Rendering thumbnail' WHEN 'sections' THEN 'Indexing section: '
WHEN 'features_llm' THEN 'Detecting features (LLM ' || current || '/' || CAST(whole AS INTEGER) || ')'
WHEN 'cheatsheet_llm' THEN CASE WHEN least(greatest(current, 0), whole) >= whole
     THEN 'Cheatsheet complete (' || CAST(whole AS INTEGER) || '/' || CAST(whole AS INTEGER) || ')'
     ELSE 'Building cheatsheet entries (' || greatest(current, 0) || '/' || CAST(whole AS INTEGER) || ')' END
ELSE '' END"""


@query("progress_percent", with_sql(
    PROGRESS_SQL, "sane AS (SELECT *, CAST(CASE WHEN total <= 0 THEN 1 ELSE total END AS DOUBLE) AS whole FROM progress)")
    + f"""SELECT event_id, phase, round(CAST({PERCENT_SQL} AS DOUBLE), 6) AS percent,
phase <> 'error' AS active, {MESSAGE_SQL} AS message FROM sane""")  # fmt: skip
def progress_percent(spark, folder):
    rows = progress(read_table(spark, folder, "events"))
    phase, current, total = F.col("phase"), F.col("current"), F.col("total")
    return rows.select(
        "event_id",
        "phase",
        F.round(status.progress_percent(phase, current, total), 6).alias("percent"),
        status.is_active(phase).alias("active"),
        status.progress_message(phase, current, total, F.lit("")).alias("message"),
    )


@query("last_user_message", """SELECT conv_id, arg_max(CASE WHEN trim(text) <> '' THEN text ELSE '' END, turn) AS message
FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def last_user_message(spark, folder):
    turns = read_table(spark, folder, "conversations").where("role = 'user'")
    parts = turns.withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), F.lit("").alias("text"))))
    return parts.groupBy("conv_id").agg(
        F.max_by(message_text(F.col("text"), F.col("parts")), F.col("turn")).alias("message")
    )


def message_text(content, parts):
    """Content of a chat message, or its text parts put together where the content is blank."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.when(~text.is_blank(content), content).otherwise(F.array_join(texts, ""))


PATH_SQL = "'/library/' || p_brand || '/' || p_name || '.' || p_partkey || CASE WHEN p_size > 25 THEN '.PDF' ELSE '.txt' END"


@query("title_from_path", f"""SELECT path, regexp_replace(regexp_extract(path, '([^/]*)\\z', 1), '\\.[^.]*\\z', '') AS title,
lower(right(path, 4)) = '.pdf' AS is_pdf FROM (SELECT {PATH_SQL} AS path FROM part)""")
def title_from_path(spark, folder):
    ending = F.when(F.col("p_size") > 25, F.lit(".PDF")).otherwise(F.lit(".txt"))
    path = F.concat(
        F.lit("/library/"), "p_brand", F.lit("/"), "p_name", F.lit("."), F.col("p_partkey").cast("string"), ending
    )
    paths = read_table(spark, folder, "part").select(path.alias("path"))
    return paths.select(
        "path",
        library.title_from_path(F.col("path")).alias("title"),
        library.is_pdf_name(F.col("path")).alias("is_pdf"),
    )


