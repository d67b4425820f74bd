"""Registered queries of the subpackage: each operator over its whole table, digests derived from its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.queries.registry import Query
from passages.sources.tables import read_table, stage

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(job: Query) -> Query:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


@query("op1_simhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash components of all documents."""
    from passages.llm.simhash import simhash_components

    found = simhash_components(read_table(spark, folder, "documents"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


@query("op10_embeddings")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate vectors of each label."""
    from passages.llm.embeddings import near_vectors

    return near_vectors(read_table(spark, folder, "embeddings"))


# Given rules of the query: verdict, host, path. Fixed values.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

URL_SQL = r"""
WITH cut AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, strpos(url, '://') > 0 AS whole,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM cut
), kept AS (
  SELECT *, list_filter(list_sort(string_split(query, '&')),
                        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')) AS asked
  FROM parts
), named AS (
  SELECT page_id, host, path,
         CASE WHEN whole THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
           || regexp_replace(path, '/+$', '') || '/'
           || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM kept
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    count(*) OVER (PARTITION BY canonical) AS seen
  FROM named
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IS NOT NULL AND seen > 1 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op8_urls", URL_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url against the rules; listed are the canonical URLs that several pages share."""
    from passages.llm.urls import canonical_url, judge_urls

    pages = read_table(spark, folder, "pages")
    shared = pages.groupBy(canonical_url(F.col("url")).alias("canonical")).count().where("count > 1")
    return judge_urls(pages, shared, URL_RULES)


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(list_slice(w, i, i + 12), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), found AS (
  SELECT rid, i, size, item_id FROM grams JOIN windows USING (size, phrase)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


@query("op4_decontamination", CONTAMINATION_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Contamination of every document by the benchmark items."""
    from passages.llm.decontaminate import contamination

    found = contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def _secrets_sql() -> str:
    from passages.llm.secrets import ALLOWED, CLASSES, PATTERNS

    def quoted(regex: str) -> str:
        return "'" + regex.replace("'", "''") + "'"

    def matches(kind: str, regex: str) -> str:
        q = quoted(regex)
        return f"""{kind}_m AS (
  SELECT rid, i, m, sum(gap) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT rid, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(list_transform(gaps[1:len(ms)], lambda x: length(x))) AS gap
        FROM (SELECT rid, regexp_extract_all(t, {q}, 0) AS ms, string_split_regex(t, {q}) AS gaps FROM d WHERE regexp_matches(t, {q})))
  WINDOW w AS (PARTITION BY rid ORDER BY i)
)"""

    parts, spans = [], []
    for rank, p in enumerate(PATTERNS):
        parts.append(matches(p.kind, p.regex))
        spans.append(
            f"SELECT rid, {rank} AS rank, '{p.kind}' AS kind, start, start + length(m) AS stop FROM {p.kind}_m "
            f"WHERE length(regexp_extract(m, {quoted(p.regex)}, {p.group})) >= {p.shortest}"
        )
    for rank, c in enumerate(CLASSES, len(PATTERNS)):
        parts.append(matches(c.kind, c.regex))
        parts.append(f"""{c.kind}_w AS (
  SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY rid, i ORDER BY pos) + {c.window}, -1) AS fresh
  FROM (SELECT rid, i, m, start, unnest(range(0, length(m) - {c.window} + 1)) AS pos FROM {c.kind}_m)
  WHERE list_aggregate(string_split(substr(m, pos + 1, {c.window}), ''), 'entropy') >= {c.threshold}
), {c.kind}_r AS (
  SELECT rid, i, m, start, min(pos) AS low, max(pos) + {c.window} AS high
  FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY rid, i ORDER BY pos) AS run FROM {c.kind}_w)
  GROUP BY rid, i, m, start, run
)""")
        allowed = " AND ".join(f"NOT regexp_matches(substr(m, low + 1, high - low), {quoted(a)})" for a in ALLOWED)
        spans.append(
            f"SELECT rid, {rank} AS rank, '{c.kind}' AS kind, start + low AS start, start + high AS stop FROM {c.kind}_r WHERE {allowed}"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
spans AS ({" UNION ALL ".join(spans)}),
told AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, rank) FILTER (rank < {len(PATTERNS)}) AS base,
         string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""


@query("op5_secrets", _secrets_sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document's text."""
    from passages.llm.secrets import PATTERNS, all_spans, find_secrets, spans_text

    found = find_secrets(read_table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        own = F.filter("base_spans", lambda s: s["kind"] == kind)
        return F.size(own).cast("bigint").alias(f"n_{kind}")

    counts = [count(p.kind) for p in PATTERNS]
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        spans_text(all_spans(F.col("base_spans"), F.col("entropy_spans"))).alias("spans"),
    )


def piece_model() -> str:
    """Path of the public SentencePiece model, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_pieces")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """SentencePiece ids of every document, and the text they decode to, as digests."""
    from passages.llm.pieces import encode_documents

    found = encode_documents(read_table(spark, folder, "documents"), piece_model())
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, strlen(html) AS payload_bytes, upper(sha1(html)) AS hex, max(page_id) OVER (PARTITION BY html) AS response_id FROM p
), b AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM h
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([32768, 1024, 32, 1],
         lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // d) % 32 + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM response_id AND response_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to
FROM b
"""


@query("op3_warc", WARC_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives, read back and assembled."""
    from passages.llm.warc import assemble_captures, new_archive_folder, read_archives, write_archives

    path = new_archive_folder(spark)
    write_archives(read_table(spark, folder, "pages"), path)
    records = stage(read_archives(spark, path, payloads=False), "warc-records")
    captures = assemble_captures(records)
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("answer.type").alias("record_type"), F.col("refers_to")["page-id"].cast("bigint").alias("refers_to"),
    )


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the documents, which no model learns from. Rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    from passages.llm.language import identify, train

    docs = read_table(spark, folder, "documents")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    from passages.llm.toxicity import toxicity, train

    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    found = toxicity(docs, train(docs, labels.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op9_substrings")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that repeat, as counts and a digest."""
    from passages.llm.substrings import cut_repeats

    found = cut_repeats(read_table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_sentences", "n_removed", F.length("kept").cast("bigint").alias("n_chars_kept"),
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op13_licenses")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """License detections of every document."""
    from passages.llm.licenses import scan_licenses

    found = scan_licenses(read_table(spark, folder, "documents"))
    base = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["first_word"])
    both = F.concat(base, F.transform("detections", lambda d: d["label"]))

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(both).alias("labels"), "score",
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults that the query plants by a hash of conversation and turn."""
    said = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    text = F.coalesce("text", F.lit(" "))
    dice = F.crc32(said) % 20
    changed = F.when(dice == 1, "").when(dice == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(dice == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(dice == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(dice != 0).select(
        "conv_id", "turn", role.alias("role"), changed.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


@query("op11_conversations")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    from passages.llm.conversations import plan_repairs, repaired_digests

    rows = read_table(spark, folder, "conversations")
    repairs = plan_repairs(damaged(rows))
    # The audit is one text a conversation, as asked; the operator keeps it by blocks.
    edits = repairs.blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "edits"))).alias("parts"))
    audits = edits.select("id", F.array_join(F.transform("parts", lambda p: p["edits"]), "").alias("audit"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        rows.select(F.struct(F.col("conv_id").alias("key")).alias("id")).distinct()
        .join(repairs.totals, "id", "left").join(audits, "id", "left").join(repaired_digests(repairs), "id", "left")
        .select(
            F.col("id")["key"].alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS alike, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM v.vec_id AND len(a.q) = len(v.q)
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id NULLS LAST) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id NULLS LAST) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for every hundredth vector and its positives, among all vectors."""
    from passages.llm.negatives import mine_negatives

    vectors, label = read_table(spark, folder, "embeddings"), F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_negatives(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)
