"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of a model goes on past a word into the next white-space marker, a text's pieces are
those of its chunks: words with the markers before them. Documents are taken in blocks of bounded
size. Each block offers its distinct chunks, all blocks' chunks are dealt out by hash, and every
distinct chunk is segmented once; ids and decoded text then go back to the blocks that asked, where
they are put in the order of the text. What travels, compressed, is each block's texts, its distinct
chunks and their ids, each once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

MARK = "▁"
# Characters of text in a block, unless one document has more.
BLOCK = 3 << 22
# A chunk's ids as 32-bit numbers, and what they decode to if that is not the chunk itself.
Piece = tuple[bytes, str | None]
_CHUNK = re.compile(" *[^ ]+| +$")


@cache
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless texts can be cut before each word's markers, with the markers as the only change."""
    sp = processor(model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if MARK in p.lstrip(MARK)]
    probe = " a  b Ａ "
    if crossing or sp.decode(sp.encode(probe)) != probe:
        raise ValueError("pieces of this model cross word boundaries, or it rewrites its input")


def chunks_of(text: str) -> list[str]:
    """Chunks in order, each without its first marker; further markers are spaces. None for an empty text."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


def segment(model: str, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk. The library adds the first marker itself, but not to an empty text."""
    sp = processor(model)
    found = sp.encode(chunks, num_threads=1)
    for i, chunk in enumerate(chunks):
        if not chunk:
            found[i] = [sp.piece_to_id(MARK)]
    return found


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[str]]]:
    """(number, keys, texts) of consecutive rows with about ``size`` characters."""
    number, keys, texts, held = 0, [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= size:
                yield number, keys, texts
                number, keys, texts, held = number + 1, [], [], 0
    if keys:
        yield number, keys, texts


def encode_documents(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """(key, ids, decoded) of every row: the library's encode() of the whole text and decode() of the ids.

    No begin or end ids, no sampling. A null text counts as empty and has no ids. Repeated rows and
    null keys each get their row.
    """
    check_model(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = to_arrow_type(docs.schema[key].dataType)
    # As many buckets as keep one bucket's chunks to a small part of a block's.
    buckets = max(64, 4 * rows.rdd.getNumPartitions())

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, _, texts in _blocks(batches, block):
            lists = _by_bucket(set(chain.from_iterable(map(chunks_of, texts))), buckets)
            packed = [_pack(chunks=pa.array(chunks, pa.string())) for chunks in lists.values()]
            yield _rows(part=[part] * len(lists), number=[number] * len(lists), bucket=list(lists), packed=packed)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, Piece] = {}
        at = None
        for row in chain.from_iterable(batch.to_pylist() for batch in batches):
            if row["bucket"] != at:
                at, table = row["bucket"], {}
            chunks = _unpack(row["packed"])["chunks"].to_pylist()
            _add(table, model, chunks)
            row["packed"] = _answer(chunks, table)
            yield _rows(**{name: [value] for name, value in row.items()})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, keys, texts in _blocks(batches, block):
            held = _pack(key=pa.array([k.as_py() for k in keys], key_type), text=pa.array(texts, pa.large_string()))
            yield _rows(part=[part], number=[number], bucket=[-1], packed=[held])

    def assemble(own: pa.Table, answers: pa.Table) -> pa.Table:
        keys, ids, decoded = [], [], []
        for packed in own["packed"].to_pylist():
            held = _unpack(packed)
            keys.append(held["key"].combine_chunks())
            texts = held["text"]
            # Texts are cut twice, as the chunks of a whole block would need much more memory than its texts.
            lists = _by_bucket(set(chain.from_iterable(chunks_of(t.as_py()) for t in texts)), buckets)
            table: dict[str, Piece] = {}
            for bucket, answer in zip(answers["bucket"].to_pylist(), answers["packed"], strict=True):
                _take(table, lists.get(bucket, []), answer.as_py())
            # Blocks are cut by the order of the rows. Should that have changed when the rows were read
            # again, some answers are for other chunks, and what is missing is segmented here.
            _add(table, model, chain.from_iterable(lists.values()))
            for text in texts:
                chunks = chunks_of(text.as_py())
                found = [table[c] for c in chunks]
                ids.append(b"".join([f[0] for f in found]))
                decoded.append(" ".join([c if f[1] is None else f[1] for c, f in zip(chunks, found, strict=True)]))
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        whole = pa.concat_arrays(keys) if keys else pa.array([], key_type)
        return pa.table({"key": whole, "ids": listed, "decoded": pa.array(decoded, pa.string())})

    schema = "part int, number int, bucket int, packed binary"
    asked = rows.mapInArrow(offer, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(look_up, schema)
    out = rows.mapInArrow(pack, schema).groupBy("part", "number").cogroup(answers.groupBy("part", "number"))
    returned = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return out.applyInArrow(assemble, returned).withColumnRenamed("key", key)


def _pack(**columns: pa.Array) -> bytes:
    """Columns as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"packed": pa.binary()}
    arrays = [pa.array(values, kinds.get(name, pa.int32())) for name, values in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _by_bucket(chunks: set[str], buckets: int) -> dict[int, list[str]]:
    """Chunks of each bucket in order."""
    lists: dict[int, list[str]] = {}
    for chunk in sorted(chunks):
        lists.setdefault(crc32(chunk.encode()) % buckets, []).append(chunk)
    return lists


def _answer(chunks: list[str], table: dict[str, Piece]) -> bytes:
    """Ids of a list of chunks, what they decode to where that differs, and a check of the list."""
    found = [table[c] for c in chunks]
    ids = np.frombuffer(b"".join(f[0] for f in found), np.int32)
    ends = np.cumsum([0, *(len(f[0]) // 4 for f in found)])
    small = ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids
    return _pack(
        ids=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(small)),
        changed=pa.array([f[1] for f in found], pa.string()),
        check=pa.array([_check(chunks)] * len(chunks), pa.int64()),
    )


def _take(table: dict[str, Piece], chunks: list[str], answer: bytes) -> None:
    """Add an answer to the table if it is for exactly these chunks."""
    held = _unpack(answer)
    if held.num_rows != len(chunks) or not chunks or held["check"][0].as_py() != _check(chunks):
        return
    lists = held["ids"].combine_chunks()
    ends = (lists.offsets.to_numpy() * 4).tolist()
    flat = lists.flatten().to_numpy().astype(np.int32).tobytes()
    ids = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    table.update(zip(chunks, zip(ids, held["changed"].to_pylist(), strict=True), strict=True))


def _check(chunks: list[str]) -> int:
    return crc32("\0".join(chunks).encode())


def _add(table: dict[str, Piece], model: str, chunks: Iterable[str]) -> None:
    """Segment the chunks that the table lacks: their ids, and what they decode to where that differs."""
    new = list({c: None for c in chunks if c not in table})
    if new:
        ids = segment(model, new)
        for chunk, own, text in zip(new, ids, processor(model).decode(ids), strict=True):
            table[chunk] = np.array(own, np.int32).tobytes(), None if text == chunk else text
