"""Benchmark decontamination: a prefix-filtered set join of shingles, then exact containment.

Each benchmark item is cut into windows of consecutive words, and a document is searched for exact
occurrences of windows. A window is seen as the set of its word shingles. All of them must be in the
document, so the necessary prefix of a window's shingles, ordered by how rare they are in all
documents, is its rarest one: only documents with that shingle can hold the window. A prefix match
fixes where the window would start (positional bound) and whether it fits into the document (length
bound); what is left is verified word by word, once per distinct text. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import let
from passages.session import broadcast_if_small
from passages.sources.tables import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words are runs of ASCII letters and digits and of all characters beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 4


def split_words(text: Column) -> Column:
    """Words of a text as written; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), "")


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return split_words(F.translate(text, UPPER, LOWER))


def _rough_words(text: Column) -> Column:
    """Words for the candidate search only, fully lower-cased: words equal after words_of are equal here."""
    return F.transform(split_words(text), F.lower)


def _shingles(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from every position on; empty for fewer words."""
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - size),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def benchmark_windows(benchmark: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, words, phrase): distinct windows of each item. An item of fewer words is one window."""
    words = benchmark.select(F.col(key).alias("item"), words_of(F.col(text)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    windows = words.where(F.size("all") > 0).select("item", "all", F.explode(starts).alias("at"))
    return (
        windows.select("item", F.slice("all", F.col("at"), window).alias("words"))
        .withColumn("phrase", F.array_join("words", " "))
        .dropDuplicates(["item", "phrase"])
    )


def shingle_hits(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(text_hash, at, n, shingle, size): where the given shingles occur in the distinct texts of ``docs``.

    n is the number of words of the text. Hits of copies of a text are one row.
    """
    wanted = broadcast_if_small(shingles)
    words = docs.select(F.xxhash64("text").alias("text_hash"), _rough_words(F.col("text")).alias("words"))
    each = [
        words.select(
            "text_hash", F.size("words").alias("n"), F.lit(size).alias("size"),
            F.posexplode(_shingles(F.col("words"), size)).alias("at", "shingle"),
        )
        for size in sizes
    ]
    return (
        reduce(DataFrame.unionAll, each)
        .join(wanted, ["shingle", "size"], "left_semi")
        .select("text_hash", "at", "n", "shingle", "size")
        .distinct()
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(key, n_words, n_hit, items, contaminated) of every row of ``docs``.

    n_hit counts the words inside any occurrence of a window; items are the ids, as sorted strings,
    of the benchmark items with occurring windows; a document is contaminated when at least one
    twentieth of its words are hit. Null texts have no words. Items without words have no windows;
    an item without an id counts for hits but is not listed. Repeated items add nothing, repeated
    documents each get their row.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    items = stage(benchmark_windows(benchmark, item_key, item_text, window), "benchmark-windows")
    windows = items.groupBy("phrase").agg(F.first("words").alias("words"))
    rough = windows.select("phrase", F.transform("words", F.lower).alias("words"))
    size = F.least(F.size("words"), F.lit(shingle))
    sizes = [r[0] for r in rough.select(size).distinct().collect()] or [shingle]  # at most ``shingle`` rows
    parts = [
        rough.where(size == n).select(
            "phrase", F.size("words").alias("length"), F.lit(n).alias("size"),
            F.posexplode(_shingles(F.col("words"), n)).alias("offset", "shingle"),
        )
        for n in sizes
    ]
    parts = stage(reduce(DataFrame.unionAll, parts), "benchmark-shingles")

    hits = stage(shingle_hits(rows, parts.select("shingle", "size").distinct(), sizes), "shingle-hits")
    counts = stage(hits.groupBy("shingle", "size").agg(F.count(F.lit(1)).alias("found")), "shingle-counts")
    # A window with a shingle that no document has cannot occur.
    rarity = F.struct(F.coalesce("found", F.lit(0)).alias("found"), "shingle", "offset")
    prefix = (
        parts.join(counts, ["shingle", "size"], "left")
        .groupBy("phrase", "length", "size")
        .agg(F.min(rarity).alias("rarest"))
        .where("rarest.found > 0")
        .select("phrase", "length", "size", "rarest.shingle", "rarest.offset")
    )
    start = F.col("at") - F.col("offset")
    candidates = (
        hits.join(broadcast_if_small(prefix), ["shingle", "size"])
        .where((start >= 0) & (start + F.col("length") <= F.col("n")))
        .groupBy("text_hash")
        .agg(F.collect_set(F.struct(start.alias("start"), "length", "phrase")).alias("candidates"))
    )
    candidates = stage(candidates, "window-candidates")

    # Each distinct text is verified once. The digest keeps texts of equal hash apart.
    known = broadcast_if_small(candidates.select("text_hash"))
    texts = (
        rows.where(F.col("text").isNotNull())
        .select(F.xxhash64("text").alias("text_hash"), "text")
        .join(known, "text_hash", "left_semi")
        .groupBy("text_hash", F.sha2("text", 256).alias("digest"))
        .agg(F.first("text").alias("text"))
    )
    verified = let(
        words_of(F.col("text")),
        lambda w: F.filter(
            "candidates", lambda c: F.array_join(F.slice(w, c.start + 1, c.length), " ") == c.phrase
        ),
    )
    found = stage(
        texts.join(candidates, "text_hash").select("text_hash", "digest", verified.alias("windows")).where("size(windows) > 0"),
        "windows-found",
    )
    named = (
        found.select("text_hash", "digest", F.explode("windows.phrase").alias("phrase"))
        .join(broadcast_if_small(items.select("phrase", F.col("item").cast("string").alias("item"))), "phrase")
        .groupBy("text_hash", "digest")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    covered = found.select("text_hash", "digest", _covered(F.col("windows")).alias("n_hit"))
    results = broadcast_if_small(covered.join(named, ["text_hash", "digest"]))
    measured = rows.select(
        "id", F.size(split_words(F.col("text"))).cast("bigint").alias("n_words"),
        F.xxhash64("text").alias("text_hash"), F.sha2("text", 256).alias("digest"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return measured.join(results, ["text_hash", "digest"], "left").select(
        F.col("id").alias(key), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _covered(windows: Column) -> Column:
    """Number of positions in the union of (start, length) intervals."""
    ordered = F.array_sort(F.transform(windows, lambda x: F.struct(x.start.alias("start"), (x.start + x.length).alias("end"))))
    empty = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def add(state: Column, x: Column) -> Column:
        fresh = F.greatest(x.end - F.greatest(x.start, state.end), F.lit(0))
        return F.struct((state.total + fresh).alias("total"), F.greatest(state.end, x.end).alias("end"))

    return F.aggregate(ordered, empty, add, lambda state: state.total)
