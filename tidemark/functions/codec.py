"""Codecs of internal keys, varints and checksums, as column expressions and as plain Python."""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: added to a rotated checksum so that checksums of checksums differ (fixed value)
MASK_DELTA = 0xA282EAD8


def internal_key_hex(key: Column, seq: Column, op: Column) -> Column:
    """Hex of key bytes, then (seq << 8 | op) as 8 big-endian bytes."""
    return F.concat(F.hex(key.cast("binary")), F.lpad(F.hex(seq * 256 + op), 16, "0"))


def internal_key_parts(encoded: Column) -> Column:
    """struct(key_hex, seq, op) of an encoded internal key in hex."""
    n = F.length(encoded)
    tail = F.substring(encoded, n - 15, F.lit(16))
    return F.struct(F.substring(encoded, F.lit(1), n - 16).alias("key_hex"), F.conv(F.substring(tail, 1, 14), 16, 10).cast("bigint").alias("seq"), F.conv(F.substring(tail, 15, 2), 16, 10).cast("int").alias("op"))


def varint_length(n: Column) -> Column:
    """Bytes that a varint takes, one per 7 bits; n is a bigint or a whole decimal."""
    out = F.when(n.isNull(), F.lit(None)).when(n < 1 << 7, 1)
    for k in range(2, 19):
        out = out.when(n < F.lit(1 << 7 * k if k < 9 else Decimal(1 << 7 * k)), k)
    return out.otherwise(19)


def masked_crc(crc: Column) -> Column:
    """The checksum turned right by 15 bits, plus the delta, modulo 2**32."""
    turned = F.shiftright(crc, 15) + F.pmod(crc, F.lit(1 << 15)) * F.lit(1 << 17)
    return F.pmod(turned + F.lit(MASK_DELTA), F.lit(1 << 32))


def unmasked_crc(masked: Column) -> Column:
    turned = F.pmod(masked - F.lit(MASK_DELTA), F.lit(1 << 32))
    return F.shiftright(turned, 17) + F.pmod(turned, F.lit(1 << 17)) * F.lit(1 << 15)


def format_bytes(n: Column) -> Column:
    """Bytes (a bigint or a whole decimal) in the largest unit that leaves at least one, to two decimals, halves to the even one."""
    size, unit = F.when(n >= 1 << 30, F.lit(1 << 30)), F.when(n >= 1 << 30, " GB")
    for shift, name in ((20, " MB"), (10, " KB")):
        size, unit = size.when(n >= 1 << shift, F.lit(1 << shift)), unit.when(n >= 1 << shift, name)
    size, unit = size.otherwise(1).cast("bigint"), unit.otherwise(" B")
    # only what is below the unit is multiplied, so that no n overflows; both divisions by a power of two are exact
    below = F.pmod(n, size).cast("bigint")
    cents = F.floor((n - below) / size) * 100 + F.rint(below * 100 / size).cast("int")
    text = F.when(size > 1, (cents * F.lit(Decimal("0.01"))).cast("string")).otherwise(n.cast("string"))
    return F.concat(text, unit)


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def get_varint(raw: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next position); ValueError when the bytes end or run over 10."""
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(raw):
            raise ValueError("varint ends early")
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
    raise ValueError("varint too long")


def put_bytes(raw: bytes) -> bytes:
    """Length-prefixed bytes."""
    return put_varint(len(raw)) + raw


def get_bytes(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = get_varint(raw, at)
    if at + n > len(raw):
        raise ValueError("bytes end early")
    return raw[at : at + n], at + n


fixed32, fixed64 = struct.Struct("<I"), struct.Struct("<Q")


def encode_internal_key(key: bytes, seq: int, op: int) -> bytes:
    return key + struct.pack(">Q", seq << 8 | op)


def decode_internal_key(raw: bytes) -> tuple[bytes, int, int]:
    if len(raw) < 8:
        raise ValueError("internal key too short")
    tail = struct.unpack(">Q", raw[-8:])[0]
    if tail & 0xFF not in (1, 2):
        raise ValueError(f"no such operation: {tail & 0xFF}")
    return raw[:-8], tail >> 8, tail & 0xFF


def encode_batch(entries: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """Entry count (32 bit), then per entry the operation, the key and, for a put, the value."""
    out = [fixed32.pack(len(entries))]
    for op, key, value in entries:
        out.append(bytes([op]) + put_bytes(key) + (put_bytes(value or b"") if op == 1 else b""))
    return b"".join(out)


def decode_batch(raw: bytes) -> list[tuple[int, bytes, bytes | None]]:
    if len(raw) < 4:
        raise ValueError("batch ends early")
    (count,), at, out = fixed32.unpack(raw[:4]), 4, []
    for _ in range(count):
        if at >= len(raw) or raw[at] not in (1, 2):
            raise ValueError("batch ends early or holds an unknown operation")
        op = raw[at]
        key, at = get_bytes(raw, at + 1)
        value = None
        if op == 1:
            value, at = get_bytes(raw, at)
        out.append((op, key, value))
    return out


def mask_crc(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def unmask_crc(masked: int) -> int:
    turned = (masked - MASK_DELTA) & 0xFFFFFFFF
    return (turned >> 17 | turned << 15) & 0xFFFFFFFF


def crc32(*parts: bytes) -> int:
    crc = 0
    for p in parts:
        crc = zlib.crc32(p, crc)
    return crc
