"""SimHash near-duplicates: multi-index hashing over fingerprint segments.

A document's fingerprint sums up the hashes of its word shingles. Two fingerprints are linked when
they differ in at most ``radius`` bits, and links join documents into components.

Searching works as in multi-index hashing. The 64 bits are cut into segments; two fingerprints
within the radius must be close in at least one of them, by the pigeonhole principle. Every
fingerprint is put into one table per segment, looks itself up there with every segment value in a
small Hamming ball around its own, and each match is verified on all 64 bits.

Groups of near copies would match in all pairs. They are therefore joined in two steps: in each
table entry all fingerprints are first compared with the entry's smallest one only, which makes the
bulk of every dense group one component at linear cost; the full lookup then verifies only pairs
that are not yet connected. No link between different components is lost, so the components are
those of all links.

Links that are checked on the texts are sought more widely, as 64 bits do not tell a similarity of
0.8 from much lower ones. Their nodes are distinct texts, and texts also meet in one more table per
band of MinHash values, whatever their fingerprints. Each has a sketch, the number of its shingles and
the parity of those in each of 128 parts. Two texts differ in at least as many shingles as parities,
so most pairs that only met by chance are known not to be links where they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions.text import let
from passages.llm.components import component_of
from passages.session import broadcast_if_small
from passages.sources.tables import stage

# Keeps some of the rows (a, b, …) of a table of pairs.
Check = Callable[[DataFrame], DataFrame]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[\x20\x09-\x0D]+"
SEED = 42
# Shingles hashed at a time, so that a text of any length needs bounded memory.
PIECE = 1 << 16
# Texts with a similarity of 0.8 share one of the bands, each of so many MinHash values, with
# probability 1 - (1 - 0.8 ** 6) ** 20 = 0.998.
BANDS, VALUES = 20, 6
_XORS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * VALUES), np.uint64)
_FACTORS |= np.uint64(1)
# Entries with more texts than this are compared with several of them before all unconnected pairs are.
CROWD = 32
HEADS = 3


def fingerprint(text: bytes, size: int) -> int:
    """SimHash of the ASCII-lower-cased, white-space-separated words of a text, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), PIECE):
        cuts = map(slice, starts[at : at + PIECE], ends[at : at + PIECE])
        digests = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED))
        hashes = np.fromiter(digests, np.uint64, min(PIECE, len(starts) - at))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(
                axis=0, dtype=np.int64
            )
        ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    packed = np.packbits(2 * ones > len(starts))
    return int(packed.view(">i8")[0])


def outline(text: bytes, size: int = 5) -> tuple[int, list[int], tuple[int, int, int]]:
    """Hash of a text's words, a negative number for each band of MinHash values of its distinct shingles, and their sketch.

    Words are those of ``fingerprint``, shingles those of ``alike``.
    """
    words = text.lower().split()
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends + 1])[: max(1, len(words) - size + 1)].tolist()
    ends = ends[size - 1 :].tolist() if words else [0]
    least = np.full(BANDS * VALUES, (1 << 64) - 1, np.uint64)
    seen = []
    for at in range(0, len(starts), PIECE >> 5):
        cuts = map(slice, starts[at : at + (PIECE >> 5)], ends[at : at + (PIECE >> 5)])
        digests = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED))
        hashes = np.fromiter(digests, np.uint64)
        seen.append(hashes)
        least = np.minimum(least, ((hashes[:, None] ^ _XORS) * _FACTORS).min(axis=0))
    bands = [
        (xxhash.xxh64_intdigest(band.tobytes(), n) >> 1) - (1 << 63) for n, band in enumerate(least.reshape(BANDS, VALUES))
    ]
    return _signed(xxhash.xxh64_intdigest(joined, SEED + 1)), bands, _sketch(np.unique(np.concatenate(seen)))


def _sketch(hashes: np.ndarray) -> tuple[int, int, int]:
    """Number of the given distinct hashes, and whether each of 128 parts holds an odd number of them."""
    odd = np.bincount((hashes >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(odd.astype(np.uint8)).view(">i8").tolist()
    return len(hashes), low, high


def may_reach(x: Column, y: Column, least: float) -> Column:
    """False only where texts with these sketches have less than the share ``least`` of their shingles in common.

    With n and m shingles, of which d are in one text only, that share is (n + m - d) / (n + m + d).
    """
    odd = F.bit_count(x["low"].bitwiseXOR(y["low"])) + F.bit_count(x["high"].bitwiseXOR(y["high"]))
    differ = F.greatest(odd, F.abs(x["n"] - y["n"]))
    return differ * (1 + least) <= (x["n"] + y["n"]) * (1 - least) + 1e-6


def outlines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fingerprint, bands, sketch) of every row, where fingerprint is a struct with the hash of the text's words."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            found = [outline(t) for t in texts]
            prints = pa.array([fingerprint(t, size) for t in texts], pa.int64())
            nodes = pa.StructArray.from_arrays([prints, pa.array([h for h, _, _ in found], pa.int64())], ["fingerprint", "hash"])
            bands = pa.array([b for _, b, _ in found], pa.list_(pa.int64()))
            sketches = [pa.array([s[i] for _, _, s in found], pa.int64()) for i in range(3)]
            sketches = pa.StructArray.from_arrays(sketches, ["n", "low", "high"])
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, bands, sketches], ["key", "fingerprint", "bands", "sketch"])

    node = T.StructType([T.StructField("fingerprint", T.LongType()), T.StructField("hash", T.LongType())])
    sketch = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "low", "high")])
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("fingerprint", node),
        T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", sketch),
    ])
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(fold, schema).withColumnRenamed("key", key)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(key, fingerprint) of every row. A null text counts as empty; without words the fingerprint is 0."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"", size) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["key", "fingerprint"]
            )

    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())]
    )
    pairs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pairs.mapInArrow(fold, schema).withColumnRenamed("key", key)


def segments(count: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball radius) of each segment.

    With radius = count * s + rest, two words within the radius differ in at most s bits in one of
    the first rest + 1 segments or in at most s - 1 bits in one of the others.
    """
    s, rest = divmod(radius, count)
    cut, shift = [], 64
    for i in range(count):
        width = (64 - sum(w for _, w, _ in cut)) // (count - i)
        width += (64 - sum(w for _, w, _ in cut)) % (count - i) > 0
        shift -= width
        cut.append((shift, width, s if i <= rest else s - 1))
    return [c for c in cut if c[2] >= 0]


def ball(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` bits set."""
    found = {0}
    for _ in range(radius):
        found |= {x | 1 << i for x in found for i in range(width)}
    return sorted(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _entry(fp: Column, n: int, shift: int, width: int) -> Column:
    """Table number and segment value in one number."""
    return F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1) + F.lit(n << 40)


def alike(docs: DataFrame, found: DataFrame, key: str, text: str, least: float, size: int = 5) -> Check:
    """Keeps pairs of ``outlines``' nodes whose texts have at least the share ``least`` of their shingles in common.

    All texts of a node have the same words; that of its smallest key is read, and only for nodes of the pairs.
    """

    def keep(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "simhash-pairs")
        ends = pairs.select(F.col("a").alias("fingerprint")).union(pairs.select("b")).distinct()
        heads = found.join(ends, "fingerprint").groupBy("fingerprint").agg(F.min(key).alias(key))
        words = F.split(F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WHITE, " ")), " ")
        texts = docs.select(key, F.col(text)).join(broadcast_if_small(heads), key).groupBy("fingerprint").agg(F.first(text).alias(text))
        sets = stage(texts.select("fingerprint", F.array_distinct(_shingles(words, size)).alias("set")), "simhash-sets")
        met = pairs.join(sets.select(F.col("fingerprint").alias("a"), F.col("set").alias("_x")), "a").join(
            sets.select(F.col("fingerprint").alias("b"), F.col("set").alias("_y")), "b"
        )
        common = F.size(F.array_intersect("_x", "_y"))
        return met.where(common >= least * (F.size("_x") + F.size("_y") - common)).drop("_x", "_y")

    return keep


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, or of all words where there are fewer."""
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= size,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
            ),
        ).otherwise(F.array(F.xxhash64(w))),
    )


def near_components(
    prints: DataFrame, radius: int = 4, count: int = 3, entry_rows: int = 4096, check: Check | None = None, least: float = 0.0
) -> DataFrame:
    """(fingerprint, root) for every fingerprint; links join those within ``radius`` bits.

    With ``check``, ``prints`` are those of ``outlines``: (fingerprint, bands, sketch). A link is then also
    sought between texts that share a band, and every link has to be among the pairs (a, b, …) that it keeps;
    it keeps none whose sketches show a similarity below ``least``.

    ``prints`` has distinct, non-null fingerprints. root is the smallest fingerprint reachable by
    links. With N fingerprints the tables have about N / 2^(64/count) rows an entry, so ``count``
    should fall as N grows: 3 up to some ten million fingerprints, 2 beyond. Entries with more than
    ``entry_rows`` fingerprints are cut into blocks that meet their lookups in different tasks.
    """
    cut = segments(count, radius)
    fp = F.col("fingerprint")

    def bits(node: Column) -> Column:
        return node["fingerprint"] if check else node

    def near(x: Column, y: Column) -> Column:
        close = F.bit_count(bits(x).bitwiseXOR(bits(y))) <= radius
        return (F.col("entry") < 0) | close if check else close

    entries = F.array(*[_entry(bits(fp), n, s, w) for n, (s, w, _) in enumerate(cut)])
    entries = F.explode(F.concat(entries, "bands") if check else entries).alias("entry")
    table = stage(prints.select(fp, entries), "simhash-tables")
    first = table.groupBy("entry").agg(F.min("fingerprint").alias("a"), F.count(F.lit(1)).alias("n"))
    first = stage(first.where("n > 1"), "simhash-entries")
    stars = table.join(first, "entry").where((fp != F.col("a")) & near(fp, F.col("a"))).select("a", fp.alias("b"))
    stars = stage(check(stars.distinct()), "simhash-stars") if check else stars
    joined = stage(component_of(stars), "simhash-joined")
    if check:
        # Texts that failed against an entry's first one are held against a few others.
        crowds = stage(table.join(first.where(F.col("n") > CROWD).select("entry"), "entry"), "simhash-crowds")
        grouped = crowds.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
            "entry", "fingerprint", F.coalesce("component", "fingerprint").alias("group")
        )
        picked = [F.min_by(F.struct("fingerprint", "group"), F.xxhash64("fingerprint", F.lit(n))).alias(f"_{n}") for n in range(1, HEADS)]
        heads = grouped.groupBy("entry").agg(*picked)
        heads = heads.select("entry", F.explode(F.array(*[f"_{n}" for n in range(1, HEADS)])).alias("head"))
        a = F.col("head.fingerprint")
        more = grouped.join(heads, "entry").where((F.col("group") != F.col("head.group")) & near(fp, a))
        more = check(more.select(F.least(fp, a).alias("a"), F.greatest(fp, a).alias("b")).distinct())
        joined = stage(component_of(stars.union(stage(more, "simhash-stars"))), "simhash-joined")
    known = prints.join(
        joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", F.coalesce("component", "fingerprint").alias("group"), *(["bands", "sketch"] if check else []))
    known = stage(known, "simhash-known")

    also = ["sketch"] if check else []
    lookups = known.select("fingerprint", "group", *also, F.explode("bands").alias("entry")) if check else None
    for n, (shift, width, r) in enumerate(cut):
        moves = F.explode(F.array(*[F.lit(_signed(m << shift)) for m in ball(width, r)]))
        moved = known.select("fingerprint", "group", *also, moves.alias("move"))
        own = moved.select(
            "fingerprint", "group", *also, _entry(bits(fp).bitwiseXOR(F.col("move")), n, shift, width).alias("entry")
        )
        lookups = own if lookups is None else lookups.unionAll(own)
    beside = [F.col(c).alias(f"other_{c}") for c in ("group", *also)]
    rows = known.select(fp.alias("other"), *beside, entries)

    hot = broadcast_if_small(
        first.where(F.col("n") > entry_rows).select("entry", F.ceil(F.col("n") / entry_rows).alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(hot, "entry", "left").select(
        "entry", "other", "other_group", *[f"other_{c}" for c in also], F.pmod(F.xxhash64("other"), blocks).cast("int").alias("block")
    )
    lookups = lookups.join(hot, "entry", "left").select(
        "entry", "fingerprint", "group", *also, F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block")
    )
    matches = (
        lookups.join(rows, ["entry", "block"])
        .where(fp < F.col("other"))
        .where(F.col("group") != F.col("other_group"))
        .where(near(fp, F.col("other")))
        .where(may_reach(F.col("sketch"), F.col("other_sketch"), least) if check else F.lit(True))
        .select(fp.alias("a"), F.col("other").alias("b"), "group", "other_group")
    )
    matches = check(matches.distinct()) if check else matches
    matches = matches.select(F.col("group").alias("a"), F.col("other_group").alias("b"))
    merged = component_of(matches).withColumnRenamed("node", "group")
    return known.join(merged, "group", "left").select(
        "fingerprint", F.coalesce("component", "group").alias("root")
    )


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4, count: int = 3,
    least: float | None = None,
) -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``.

    fingerprint is a signed 64-bit number; component_id is the smallest key reachable by links. A
    null text has the empty text's fingerprint 0, which is linked like any other. Repeated rows each
    get their row. Null keys take part in linking but are never the smallest. With ``least``, links
    are between texts of that similarity, whose words alone can make them equal: see ``alike``.
    """
    find = fingerprints if least is None else outlines
    found = stage(find(docs, key, text, size), "simhash-prints")
    aggs = [F.min(key).alias("first"), *([] if least is None else [F.first(c).alias(c) for c in ("bands", "sketch")])]
    firsts = stage(found.groupBy("fingerprint").agg(*aggs), "simhash-distinct")
    check = None if least is None else alike(docs, found, key, text, least)
    roots = stage(
        near_components(firsts.drop("first"), radius, count, check=check, least=least or 0.0).join(firsts, "fingerprint"), "simhash-roots"
    )
    heads = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(heads, "root").select("fingerprint", "component_id")
    bits = F.col("fingerprint") if least is None else F.col("fingerprint.fingerprint").alias("fingerprint")
    return found.join(named, "fingerprint").select(key, bits, "component_id")
