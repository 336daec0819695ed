"""Names of a store's files: NNNNNN.log (commit), NNNNNN.parquet (table), NNNNNN.tmp, MANIFEST-NNNNNN, CURRENT, LOCK."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"log": "commit", "parquet": "table", "tmp": "temporary"}
_NUMBERED = re.compile(r"^(\d+)\.(log|parquet|tmp)$")
_MANIFEST = re.compile(r"^MANIFEST-(\d+)$")


def parse(name: str) -> tuple[str, int] | None:
    """(kind, number) of a file name, None for a stranger."""
    if m := _NUMBERED.match(name):
        return KINDS[m[2]], int(m[1])
    if m := _MANIFEST.match(name):
        return "manifest", int(m[1])
    return (name.lower(), 0) if name in ("CURRENT", "LOCK") else None


def listing(path: str) -> dict[str, list[int]]:
    """The numbers of a folder's files by kind, in order; strangers are left out."""
    out: dict[str, list[int]] = {}
    for kind, number in filter(None, map(parse, os.listdir(path))):
        out.setdefault(kind, []).append(number)
    return {kind: sorted(numbers) for kind, numbers in out.items()}


def highest(path: str) -> int:
    """The greatest number of a folder's files, 0 without any; manifests count apart."""
    return max((n for kind, numbers in listing(path).items() if kind != "manifest" for n in numbers), default=0)


def number_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^([0-9]+)[.]", 1).cast("bigint")


def kind_of(name: Column) -> Column:
    ending = F.regexp_extract(name, r"[.]([a-z]+)$", 1)
    out = F.lit(None).cast("string")
    for end, kind in KINDS.items():
        out = F.when(ending == end, kind).otherwise(out)
    return out
