"""Hashed bag-of-words vectors and similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passages.functions.text import let

# Width of the hashed vector and the 32-bit FNV-1a parameters.
DIMS = 256
FNV_BASIS = 2166136261
FNV_PRIME = 16777619


def _mix(h: Column, byte: Column) -> Column:
    return (h.bitwiseXOR(byte) * F.lit(FNV_PRIME)).bitwiseAND(_big(0xFFFFFFFF))


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _mix_point(h: Column, point: Column) -> Column:
    """Mix in the UTF-8 bytes of one code point."""

    def lead(mark: int, shift: int) -> Column:
        return F.shiftright(point, shift).bitwiseOR(_big(mark))

    def tail(shift: int) -> Column:
        return F.shiftright(point, shift).bitwiseAND(_big(0x3F)).bitwiseOR(_big(0x80))

    def mixed(*bytes_: Column) -> Column:
        out = h
        for byte in bytes_:
            out = _mix(out, byte)
        return out

    return (
        F.when(point < 0x80, _mix(h, point))
        .when(point < 0x800, mixed(lead(0xC0, 6), tail(0)))
        .when(point < 0x10000, mixed(lead(0xE0, 12), tail(6), tail(0)))
        .otherwise(mixed(lead(0xF0, 18), tail(12), tail(6), tail(0)))
    )


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a bigint. Plain ASCII takes a shorter way."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    plain = F.aggregate(
        chars, _big(FNV_BASIS), lambda h, ch: _mix(h, F.ascii(ch).cast("bigint"))
    )
    full = F.aggregate(
        chars,
        _big(FNV_BASIS),
        lambda h, ch: let(F.ascii(ch).cast("bigint"), lambda point: _mix_point(h, point)),
    )
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(full)


def bucket(word: Column) -> Column:
    return (fnv1a(word) % DIMS).cast("int")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where lengths differ, a vector is empty or all zero."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    ratio = let(norm(a) * norm(b), lambda scale: F.when(scale > 0, dot(a, b) / scale))
    return F.when(usable, F.coalesce(ratio, F.lit(0.0))).otherwise(F.lit(0.0))
