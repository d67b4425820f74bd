"""Tokens of texts turned into index entries and vector cells, a slice of an Arrow batch at a time.

Spark cuts the texts into tokens; what is done per distinct token (hashing, grouping) happens here on
whole columns, so that a word that many texts of a slice hold is hashed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from passages.functions.vectors import DIMS, FNV_BASIS, FNV_PRIME

# Tokens of a slice, and bytes that count as one; a longer text is a slice of its own.
SLICE = 500_000
TOKEN_BYTES = 7
# A token that only takes a place.
GAP = "\n"

CELLS = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.DoubleType())]))
HELD = T.StructType(
    [T.StructField("n_terms", T.IntegerType()), T.StructField("terms", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ends", "places")]
)
HITS = T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("f", T.IntegerType())]))


def from_tokens(df: DataFrame, made: dict[str, tuple[str, T.DataType, Callable]], size: int = SLICE) -> DataFrame:
    """df with a column for each of ``made`` in place of the list of tokens, or text of them, that it is made from."""
    given = [source for source, _, _ in made.values()]
    kept = [f for f in df.schema.fields if f.name not in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, given, size):
                columns = [rows.column(f.name) for f in kept]
                new = [make(rows.column(source)) for source, _, make in made.values()]
                yield pa.RecordBatch.from_arrays([*columns, *new], [*(f.name for f in kept), *made])

    new = [T.StructField(name, kind) for name, (_, kind, _) in made.items()]
    return df.mapInArrow(run, T.StructType([*kept, *new]))


def _slices(batch: pa.RecordBatch, given: list[str], size: int) -> Iterator[pa.RecordBatch]:
    tokens = sum(_size(batch.column(c)) for c in given)
    number = (np.cumsum(tokens) - tokens) // size
    starts = np.nonzero(np.diff(number, prepend=-1))[0].tolist()
    for start, end in zip(starts, [*starts[1:], len(tokens)], strict=True):
        yield batch.slice(start, end - start)


def _size(column: pa.Array) -> np.ndarray:
    if pa.types.is_struct(column.type):
        return _size(column.field(0))
    if pa.types.is_list(column.type):
        return np.diff(column.offsets.to_numpy()).astype(np.int64)
    return pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64) // TOKEN_BYTES


def cut(texts: pa.StringArray, least: int = 1) -> pa.ListArray:
    """Tokens of ``least`` bytes or more of texts in which blanks set them apart; a null has none."""
    lists = pc.split_pattern(texts.fill_null(""), " ")
    values = lists.flatten()
    kept = pc.greater_equal(pc.binary_length(values), least)
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    offsets = pa.array(before[lists.offsets.to_numpy()].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values.filter(kept))


def held_terms(texts: pa.StringArray) -> pa.StructArray:
    """What an index holds of texts of terms: their number, and their entries as the terms in one text and all
    places in one list, with the end of each term's own.
    """
    tokens = cut(texts)
    gaps = pc.equal(tokens.values, GAP)
    before = np.concatenate([[0], np.cumsum(~gaps.to_numpy(zero_copy_only=False))])
    n = pa.array(np.diff(before[tokens.offsets.to_numpy()]).astype(np.int32))
    entries = term_entries(pa.ListArray.from_arrays(tokens.offsets, pc.if_else(gaps, None, tokens.values)))
    terms = pc.binary_join(pa.ListArray.from_arrays(entries.offsets, entries.values.field("term")), " ")
    places, first = entries.values.field("places"), entries.offsets.to_numpy()
    last = places.offsets.to_numpy()
    ends = last[1:] - np.repeat(last[first[:-1]], np.diff(first))
    columns = [terms, pa.ListArray.from_arrays(entries.offsets, pa.array(ends)), pa.ListArray.from_arrays(pa.array(last[first]), places.values)]
    n = pc.if_else(texts.is_valid(), n, None)
    return pa.StructArray.from_arrays([n, *columns], ["n_terms", "terms", "ends", "places"])


def _values(tokens: pa.ListArray) -> pa.Array:
    offsets = tokens.offsets
    return tokens.values.slice(offsets[0].as_py(), offsets[-1].as_py() - offsets[0].as_py())


def _cells(tokens: pa.ListArray, field: str | None = None) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Row and place of every token, and the tokens themselves, or a field of theirs."""
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    values = _values(tokens)
    return rows, places, (values.field(field) if field else values).dictionary_encode()


def _per_row(rows: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of structs, by the row that each belongs to, in order."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def term_entries(tokens: pa.ListArray) -> pa.ListArray:
    """(term, places) of each list, one entry per distinct term, in order of terms; nulls only take a place."""
    rows, places, coded = _cells(tokens)
    known = coded.dictionary
    rank = np.empty(len(known), dtype=np.int64)
    order = pc.sort_indices(known).to_numpy()
    rank[order] = np.arange(len(known))
    held = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    rows, places = rows[held], places[held]
    keys = rows * len(known) + rank[coded.indices.drop_null().to_numpy()]
    by_term = np.argsort(keys, kind="stable")
    keys, places = keys[by_term], places[by_term].astype(np.int32)
    starts = np.nonzero(np.diff(keys, prepend=-1))[0]
    ends = np.append(starts, len(keys)).astype(np.int32)
    each = {
        "term": known.take(pa.array(order[keys[starts] % max(len(known), 1)])),
        "places": pa.ListArray.from_arrays(pa.array(ends), pa.array(places)),
    }
    return _per_row(keys[starts] // max(len(known), 1), len(tokens), each)


def prefix_counts(phrases: pa.Array) -> Callable[[pa.ListArray], pa.ListArray]:
    """Makes lists of (term, n) into lists of (phrase, f): the n of all terms that begin with the phrase.

    Each distinct term of a slice is looked up once, by its beginnings of the lengths that phrases have.
    """
    sizes = pc.utf8_length(phrases).to_numpy(zero_copy_only=False)
    lengths = np.unique(sizes).tolist()

    def count(terms: pa.ListArray) -> pa.ListArray:
        rows, _, coded = _cells(terms, "term")
        known = coded.dictionary
        term, phrase = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in lengths:
            own = np.nonzero(sizes == n)[0]
            found = pc.index_in(pc.utf8_slice_codeunits(known, 0, n), value_set=phrases.take(pa.array(own)))
            held = np.nonzero(found.is_valid().to_numpy(zero_copy_only=False))[0]
            term.append(held)
            phrase.append(own[found.drop_null().to_numpy()])
        term, phrase = np.concatenate(term), np.concatenate(phrase)
        by_term = np.argsort(term, kind="stable")
        many = np.bincount(term, minlength=len(known))
        starts = np.cumsum(many) - many
        codes = coded.indices.to_numpy()
        met = many[codes]
        place = np.repeat(starts[codes] - (np.cumsum(met) - met), met) + np.arange(met.sum())
        keys, at = np.unique(np.repeat(rows, met) * len(phrases) + phrase[by_term][place], return_inverse=True)
        f = np.bincount(at, weights=np.repeat(_values(terms).field("n").to_numpy(), met), minlength=len(keys))
        fields = {"phrase": phrases.take(pa.array(keys % len(phrases))), "f": pa.array(f.astype(np.int32))}
        return _per_row(keys // len(phrases), len(terms), fields)

    return count


def counted_terms(held: pa.StructArray) -> pa.ListArray:
    """Lists of (term, n) of the ``terms`` and ``ends`` that ``held_terms`` made."""
    terms, ends = cut(held.field("terms")), held.field("ends").flatten().to_numpy()
    n = np.diff(ends, prepend=0)
    first = terms.offsets.to_numpy()
    first = first[:-1][np.diff(first) > 0]
    n[first] = ends[first]
    counted = pa.StructArray.from_arrays([terms.values, pa.array(n.astype(np.int32))], ["term", "n"])
    return pa.ListArray.from_arrays(terms.offsets, counted)


def hashed_cells(words: pa.ListArray) -> pa.ListArray:
    """(bucket, weight) of each list of words, in order of buckets, scaled to unit length."""
    rows, _, coded = _cells(words)
    buckets = word_buckets(coded.dictionary)[coded.indices.to_numpy()]
    keys, counts = np.unique(rows * DIMS + buckets, return_counts=True)
    rows = keys // DIMS
    squares = np.bincount(rows, weights=counts.astype(np.float64) ** 2, minlength=len(words))
    weights = counts / np.sqrt(squares[rows])
    return _per_row(rows, len(words), {"bucket": pa.array((keys % DIMS).astype(np.int32)), "weight": pa.array(weights)})


def word_buckets(words: pa.StringArray) -> np.ndarray:
    """32-bit FNV-1a of the UTF-8 bytes of each word, by the number of buckets."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    lengths = np.diff(offsets)
    longest_first = np.argsort(-lengths, kind="stable")
    starts, falling = offsets[:-1][longest_first], -lengths[longest_first]
    hashes = np.full(len(words), FNV_BASIS, dtype=np.uint64)
    for i in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(falling, -i))  # words of more than i bytes
        mixed = (hashes[:n] ^ data[starts[:n] + i]) * np.uint64(FNV_PRIME)
        hashes[:n] = mixed & np.uint64(0xFFFFFFFF)
    out = np.empty(len(words), dtype=np.int64)
    out[longest_first] = (hashes % np.uint64(DIMS)).astype(np.int64)
    return out
