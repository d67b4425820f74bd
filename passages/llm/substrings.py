"""Substring duplicates: every run of consecutive sentences is hashed, and repeats are cut out.

A text is cut into sentences, and these into pieces of a few words at places that depend on the
words around them only. From each piece on, the shortest run of several pieces with enough words is
hashed; where the same run occurs again anywhere in the table, all but its first occurrence are
repeats, and every piece that a repeat covers is removed. Runs start at every piece, so a repeated
passage is covered from its first whole piece on wherever it stands, also within longer sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENTENCES = 3
WORDS = 20
# Sentences are also cut after the word of the smallest hash in every window of so many words. A cut
# depends on the WINDOW - 1 words to either side only, and no piece has more than WINDOW words. So of
# a stretch that is repeated anywhere, the words from WINDOW - 1 on to as far from its end are cut
# alike; the first cut among them is at most WINDOW words on, and the run behind it has at most
# WORDS + WINDOW - 1 words: 49 words in a row surely hold a whole run.
WINDOW = 8
# Runs emitted at a time.
ROWS = 1 << 17

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+\Z")
_WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[str]:
    """Sentences, long ones in pieces, with the marks and white space behind them; joined they are the text."""
    parts = _SENTENCE.findall(text)
    words = [p.lower().split() for p in parts]
    sizes = np.fromiter(map(len, words), np.int64, len(parts))
    if not len(parts) or sizes.max() < WINDOW:
        return parts
    hashes = np.fromiter((crc32(w.encode()) for own in words for w in own), np.uint32, sizes.sum())
    owner = np.repeat(np.arange(len(parts)), sizes)
    # Windows do not reach over the end of a sentence.
    within = np.nonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])[0]
    least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[within].argmin(axis=1)
    cuts = np.unique(within + least)
    ends: dict[int, list[int]] = {}
    first = np.concatenate([[0], np.cumsum(sizes)])
    for i, end in zip(owner[cuts].tolist(), (cuts + 1 - first[owner[cuts]]).tolist(), strict=True):
        ends.setdefault(i, []).append(end)
    out = []
    for i, part in enumerate(parts):
        if i not in ends:
            out.append(part)
            continue
        own = _WORD.findall(part)
        own[0] = part[: len(part) - len(part.lstrip())] + own[0]
        at = 0
        for end in ends[i]:
            out.append("".join(own[at:end]))
            at = end
        if at < len(own):
            out.append("".join(own[at:]))
    return out


def runs(text: str, count: int = SENTENCES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of the run from each sentence on; hash has two 64-bit numbers.

    Case and the kind of white space don't matter. Sentences without words belong to no count.
    """
    parts = [s.lower().split() for s in sentences(text)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    full = np.nonzero(sizes)[0]
    total = np.concatenate([[0], np.cumsum(sizes[full])])
    # Last sentence of the shortest run with enough words and sentences.
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), np.arange(len(full)) + count)
    starts = np.nonzero(ends <= len(full))[0]
    ends = ends[starts]
    norm = [" ".join(parts[i]).encode() for i in full.tolist()]
    joined = b" ".join(norm)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, norm), np.int64, len(norm)) + 1)])
    cuts = zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)
    digests = b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in cuts])
    hashes = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
    return full[starts], full[ends - 1] - full[starts] + 1, hashes


def sentence_runs(docs: DataFrame, count: int, words: int) -> DataFrame:
    """(key, hash, at, length, high, low): every run of every document (key, hash, text)."""
    rows = docs.where(F.col("text").isNotNull()).select("key", "hash", "text")
    kind = rows.schema["key"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, held = [], [], 0
            for i, text in enumerate(batch.column(2)):
                own = runs(text.as_py(), count, words)
                if len(own[0]):
                    at.append(np.full(len(own[0]), i))
                    found.append(own)
                    held += len(own[0])
                if held >= ROWS:
                    yield _runs(batch, at, found)
                    at, found, held = [], [], 0
            if held:
                yield _runs(batch, at, found)

    return rows.mapInArrow(find, f"key {kind}, hash bigint, at int, length int, high bigint, low bigint")


def _runs(docs: pa.RecordBatch, at: list, found: list) -> pa.RecordBatch:
    starts, lengths, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = pa.array(np.concatenate(at))
    columns = [
        docs.column(0).take(rows), docs.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()),
        pa.array(hashes[:, 0]), pa.array(hashes[:, 1]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["key", "hash", "at", "length", "high", "low"])


def cut_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = SENTENCES, words: int = WORDS
) -> DataFrame:
    """(key, n_sentences, n_removed, kept) of every row: kept is the text without repeated passages.

    A run has at least ``count`` sentences and ``words`` words. Of a run's occurrences the one with
    the smallest key, and then the earliest in the text, is the first; null keys come before others.
    Rows with equal key and text are one document and get equal results. A null text has no
    sentences and stays null.
    """
    # Smallest first by the key; the hash tells different texts with one key apart.
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    found = sentence_runs(rows, count, words)
    # All occurrences of a run meet in one exchange, which serves both to find the first and to drop it.
    place = F.struct("key", "hash", "at")
    first = F.min(place).over(Window.partitionBy("high", "low"))
    doc = F.struct("key", "hash").alias("doc")
    repeats = (
        found.withColumn("first", first)
        .where(place != F.col("first"))
        .groupBy(doc)
        .agg(F.collect_set(F.struct("at", "length")).alias("repeats"))
    )
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, covers in zip(batch.column(1), batch.column(2), strict=True):
                whole = text.as_py()
                parts = sentences(whole or "")
                keep = np.ones(len(parts), bool)
                for c in covers.as_py() or ():
                    keep[c["at"] : c["at"] + c["length"]] = False
                sizes.append(len(parts))
                removed.append(int((~keep).sum()))
                kept.append(whole if keep.all() else "".join([p for p, k in zip(parts, keep, strict=True) if k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["key", "n_sentences", "n_removed", "kept"],
            )

    joined = rows.select("key", "text", doc).join(repeats, "doc", "left").select("key", "text", "repeats")
    out = joined.mapInArrow(cut, f"key {kind}, n_sentences bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("key", key)
