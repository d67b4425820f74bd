"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The listed URLs set bits in blocks of 256 bits; a URL's hash picks one block and eight bits in it, so
the filter is an ordinary table of (block, four words) that one join by block can probe. URLs whose
bits are not all set are certainly not listed and go no further. Only the possible hits are joined
with the list itself, which removes the false positives. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.session import broadcast_if_small
from passages.sources.tables import stage

# (verdict, host, path prefix)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that say where a visit came from, not which page it is. Fixed values.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
WORDS = 4
KEYS_PER_BLOCK = 16


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, ``www.``, default port, fragment, tracking and closing slash.

    Query parts are sorted. Null for a null url or one without ``://``.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.array_sort(F.split(query, "&")), lambda part: (part != "") & ~part.rlike(TRACKING))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.lit("/"), asked))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(verdict, rule) of the longest rule that fits; null if none does."""
    fits = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        fits = F.when(here, found) if fits is None else fits.when(here, found)
    return fits if fits is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """Two bits in each word of the block, from a second hash."""
    other = F.xxhash64(F.lit("bits"), url)

    def bit(n: int) -> Column:
        place = F.shiftrightunsigned(other, 6 * n).bitwiseAND(63).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct, non-null strings in ``listed.canonical``."""
    url = F.col("canonical")
    bits = listed.select(_block(url, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(url))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(urls: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """``urls`` with ``maybe``: false only where ``canonical`` is certainly not listed."""
    url = F.col("canonical")
    table = broadcast_if_small(bloom_filter(listed, blocks))
    inside = F.lit(True)
    for i, bits in enumerate(_bits(url)):
        inside = inside & (F.col(f"w{i}").bitwiseAND(bits) == bits)
    return (
        urls.withColumn("block", _block(url, blocks))
        .join(table, "block", "left")
        .withColumn("maybe", F.coalesce(inside, F.lit(False)) & url.isNotNull())
        .drop("block", *[f"w{i}" for i in range(WORDS)])
    )


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``.

    The longest fitting rule decides. Without one the verdict is ``block`` for a URL whose canonical
    form is in ``listed.canonical`` and ``allow`` for any other. A null url, or one without ``://``,
    has an empty host and path, no rule and is never listed. Nulls and repeats in ``listed`` add
    nothing; repeated pages each get their row; an empty list blocks nothing.
    """
    address = F.col("url")
    urls = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).select(
        "id", host_of(address).alias("host"), path_of(address).alias("path"), canonical_url(address).alias("canonical")
    )
    urls = urls.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    names = stage(listed.select("canonical").where("canonical is not null").distinct(), "listed-urls")
    blocks = names.count() // KEYS_PER_BLOCK + 1
    tested = possible_hits(urls, names, blocks)
    # A rule decides whatever the list says.
    asked = F.col("maybe") & F.col("match").isNull()
    clear = tested.where(~asked).withColumn("listed", F.lit(False))
    hits = names.withColumn("listed", F.lit(True))
    open_ = tested.where(asked).join(hits, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return clear.unionByName(open_).select(
        F.col("id").alias(key), "host", "path", F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", by_list).alias("verdict"),
    )
