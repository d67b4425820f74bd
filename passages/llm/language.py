"""Language identification by language-bitmask n-gram filters.

The model is one bit-sliced Bloom filter for all languages: a table of rows, each a bitmask with one
bit per language. An n-gram's hashes pick a few rows, and the AND of their masks names all languages
that contain the n-gram in one look. A text is decided by popcounts: for each language the share of
the text's n-grams that name it, less the share that false positives would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passages.llm.samples import about

SIZES = (2, 3, 4)
HASHES = 3
ROWS = 1 << 20
# Bounds of the model: rows per language to learn from, n-grams kept per language and size.
TRAINING_ROWS = 3_000
GRAMS = 6_000
# A language holds an n-gram if it uses it at least this often compared with the language that uses it most.
LEAST_SHARE = 0.4
# Letters of a text hashed at a time.
PIECE = 1 << 18
UNKNOWN = "und"
_SPACE = 32


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters made one space, and one at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 128
    letter = np.where(low, (points >= 97) & (points <= 122), False)
    if not low.all():
        high, where = np.unique(points[~low], return_inverse=True)
        letter[~low] = np.array([chr(p).isalpha() for p in high.tolist()], bool)[where]
    kept = np.where(letter, points, _SPACE)
    kept = np.concatenate([[_SPACE], kept, [_SPACE]]).astype(np.uint64)
    return kept[np.concatenate([[True], (kept[1:] != _SPACE) | (kept[:-1] != _SPACE)])]


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit numbers of the n-grams; those with a space inside, between two words, are left out."""
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = np.full(n, size, np.uint64)
    whole = np.ones(n, bool)
    for i in range(size):
        part = points[i : i + n]
        code = (code ^ part) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        if 0 < i < size - 1:
            whole &= part != _SPACE
    return code[whole]


@dataclass
class LanguageFilter:
    """languages in bit order; table: (rows, words) of 64-bit masks."""

    languages: list[str]
    table: np.ndarray
    hashes: int = HASHES
    sizes: tuple[int, ...] = SIZES

    @classmethod
    def build(cls, held: dict[str, np.ndarray], rows: int = ROWS, hashes: int = HASHES, sizes: tuple[int, ...] = SIZES):
        names = sorted(held)
        table = np.zeros((rows, max(1, -(-len(names) // 64))), np.uint64)
        model = cls(names, table, hashes, sizes)
        for bit, name in enumerate(names):
            for place in model._places(held[name]):
                np.bitwise_or.at(table[:, bit // 64], place, np.uint64(1 << bit % 64))
        return model

    def _places(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        high = codes >> np.uint64(32) | np.uint64(1)
        for i in range(self.hashes):
            yield (codes + np.uint64(i) * high & np.uint64(0xFFFFFFFFFFFF)) % np.uint64(len(self.table))

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Languages containing each n-gram: (n, words) masks."""
        found = None
        for place in self._places(codes):
            own = self.table[place]
            found = own if found is None else found & own
        return found

    @cached_property
    def false_positives(self) -> np.ndarray:
        """Probability per language that an n-gram it lacks is named all the same."""
        bits = range(len(self.languages))
        fill = [float((self.table[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).mean()) for b in bits]
        return np.array(fill) ** self.hashes

    def popcounts(self, text: str) -> tuple[np.ndarray, int]:
        """How many of the text's n-grams name each language, and how many there are."""
        points = _letters(text)
        counts, total = np.zeros(len(self.languages), np.int64), 0
        for at in range(0, len(points), PIECE):
            for size in self.sizes:
                codes = grams(points[at : at + PIECE + size - 1], size)
                total += len(codes)
                masks = self.masks(codes)
                if self.table.shape[1] == 1 and len(self.languages) <= 12:
                    # Few languages: count each mask once, then read its bits.
                    seen = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << len(self.languages))
                    bits = np.arange(len(seen))[:, None] >> np.arange(len(self.languages)) & 1
                    counts += seen @ bits
                else:
                    counts += [
                        int((masks[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)).sum()) for b in range(len(self.languages))
                    ]
        return counts, total

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of its support among all languages'); unknown for null or without a letter."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        points = _letters(text)
        if not (points != _SPACE).any():
            return UNKNOWN, 0.0
        counts, total = self.popcounts(text)
        share = counts / max(total, 1)
        support = np.clip((share - self.false_positives) / np.maximum(1 - self.false_positives, 1e-9), 0, 1)
        best = int(support.argmax())
        whole = support.sum()
        return self.languages[best], float(support[best] / whole) if whole > 0 else 1 / len(self.languages)


def _counted(sizes: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = _letters(text or "")
                for size in sizes:
                    found.setdefault((lang, size), []).append(grams(points, size))
            for (lang, size), lists in found.items():
                codes, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(codes), "size": pa.array([size] * len(codes), pa.int32()), "code": codes.view(np.int64), "n": n}
                )

    return count


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", training_rows: int = TRAINING_ROWS,
    kept: int = GRAMS, sizes: tuple[int, ...] = SIZES, least_share: float = LEAST_SHARE,
) -> LanguageFilter:
    """Filter of the ``kept`` most frequent n-grams of each size and language, without those that
    another language uses much more often.

    Learns from about ``training_rows`` rows a language, or all of fewer; rows
    without a language or text are left out. No labelled rows give a filter without languages.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    picked = about(rows, "lang", training_rows, "key", "text").select("lang", "text")
    counts = picked.mapInArrow(_counted(sizes), "lang string, size int, code bigint, n bigint")
    totals = counts.groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang", "size"))
    most = F.max("rate").over(Window.partitionBy("size", "code"))
    totals = totals.withColumn("rate", rate).withColumn("most", most).where(F.col("rate") >= least_share * F.col("most"))
    best = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "code"))
    held: dict[str, list[int]] = {}
    for row in totals.withColumn("place", best).where(F.col("place") <= kept).select("lang", "code").toLocalIterator():
        held.setdefault(row.lang, []).append(row.code)
    return LanguageFilter.build({k: np.array(v, np.int64).view(np.uint64) for k, v in held.items()}, sizes=sizes)


def identify(docs: DataFrame, model: LanguageFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row. A null text, or one without a letter, is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            names, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(judge, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
