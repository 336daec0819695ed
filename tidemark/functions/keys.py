"""Byte-key helpers: bounds of a prefix, short separators."""

from __future__ import annotations


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with ``prefix``; None if there is none (all bytes 0xFF, or no byte)."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def text_prefix_end(prefix: str) -> str | None:
    """As ``prefix_end`` for text keys, in code point order (the order of their UTF-8 bytes)."""
    body = prefix.rstrip("\U0010ffff")
    if not body:
        return None
    last = ord(body[-1]) + 1
    return body[:-1] + chr(0xE000 if 0xD800 <= last < 0xE000 else last)


def separator(start: bytes, limit: bytes) -> bytes:
    """A short key k with start <= k < limit, as an index would keep."""
    n = next((i for i, (a, b) in enumerate(zip(start, limit)) if a != b), None)
    if n is not None and start[n] < 0xFF and start[n] + 1 < limit[n]:
        return start[:n] + bytes([start[n] + 1])
    return start


def successor(key: bytes) -> bytes:
    """A short key >= ``key``: its first byte that can grow, grown."""
    for i, b in enumerate(key):
        if b != 0xFF:
            return key[:i] + bytes([b + 1])
    return key
