"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words.  Every document of a source expects the
same number of copies, target / source size; the running sum of the expected
copies, shifted by one random offset per source, emits a copy whenever it
crosses an integer.  So a document is taken floor or ceil of its expectation
times, and a source's total differs from its target by about one document.

The running sum follows the documents by size class (sixteenths of an octave),
then by a hash, so every size is taken in proportion.  It needs no sort of a
whole source: documents fall into cells (source, class, hash bucket), cells are
counted first, and a document's place is the count of the cells before its own
plus its place within.  A cell is a 4096th of a class, however large the source.

Nulls: a null source is a source of its own, last; null or empty texts have
size 0 and are taken by the same rule (they add no words); a source of size 0
has target 0 and nothing is taken; repeated rows are separate documents; ids
may repeat or be null; extra columns pass through, and an added column that
clashes gets a ``_`` in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, maybe_broadcast, stash, text_or_empty

_CELL = ("_key", "_class", "_bucket")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one per source.

    Sources in code point order, null last, take the weights in turn and share
    the total size by weight; no target exceeds ``cap`` times its source, and
    what is cut off goes to the others by weight.  That fixed point is one
    level: target = least(cap * size, level * weight), and the level is the
    largest of those at which the first i sources by cap per weight are full.
    A global window over one short row per source does it.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("_cap", F.col("source_size") * cap)
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_total", F.sum("source_size").over(whole))
    w = w.withColumn("_full", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("_open", F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("_level", F.max((F.col("_total") - F.col("_full")) / F.col("_open")).over(whole))
    return w.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_total", "_full", "_open", "_level")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with size, source_size, target, copies and taken (= size * copies) per document.

    Reruns agree.  One narrow aggregation counts the cells, one shuffle by cell
    places the documents.
    """
    keep = list(docs.columns) if keep is None else keep
    names = fresh(docs, "size", "source_size", "target", "copies", "taken")
    text = text_or_empty(F.col(f"`{text_col}`"))
    sized = (
        docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(f"`{source_col}`").cast("string").alias("_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"), F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), text).cast("binary")).alias("_hash"))
        .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")))
        .withColumn("_class", F.expr("length(bin(_size)) * 16 + shiftright(_size * 16, length(bin(_size)))"))
        .withColumn("_bucket", F.substring("_hash", 1, 3))
    )
    cells = stash(sized.groupBy("_source", *_CELL).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")), "cells")
    sources = cells.groupBy(F.col("_source").alias("source"), "_key").agg(F.sum("_words").alias("source_size"))
    sources = targets(sources, weights, cap).select(
        F.col("_key"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(seed), "_key").cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("_offset"),
    )
    classes = cells.groupBy("_key", "_class").agg(F.sum("_n").alias("_in_class"))
    up_to = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("_key", "_class", F.coalesce(F.sum("_in_class").over(up_to(["_key"], "_class")), F.lit(0)).alias("_below"))
    rows = cells.agg(F.count_distinct("_key").alias("keys"), F.count_distinct("_key", "_class").alias("classes")).first()
    places = (
        cells.withColumn("_left", F.coalesce(F.sum("_n").over(up_to(["_key", "_class"], "_bucket")), F.lit(0)))
        .join(maybe_broadcast(classes, rows["classes"], 60), ["_key", "_class"])
        .join(maybe_broadcast(sources, rows["keys"], 80), "_key")
        .select(*_CELL, (F.col("_below") + F.col("_left")).alias("_before"), "source_size", "target", "_rate", "_offset")
    )
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*_CELL).orderBy("_hash"))
    crossed = lambda at: F.floor(F.col("_offset") + F.col("_rate") * at)
    out = sized.drop("_source").join(places, list(_CELL)).withColumn("_place", place)
    # no rate exceeds ``cap``, but at very large places the sums are rounded
    out = out.withColumn("_copies", F.least(crossed(F.col("_place")) - crossed(F.col("_place") - 1), F.lit(cap).cast("long")))
    added = (F.col("_size"), F.col("source_size"), F.col("target"), F.col("_copies"), F.col("_size") * F.col("_copies"))
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(n) for c, n in zip(added, names)])


def emit(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """The mix itself: each document as often as it was taken."""
    number = fresh(mixed, "_copy")[0]
    own = [F.col(f"`{c}`") for c in columns]
    return mixed.filter(F.col(copies) > 0).select(*own, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(number)).select(*own)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h
  FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 16 + ((size * 16) >> length(bin(size))) AS class, substr(h, 1, 3) AS bucket FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM sources
), filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target,
         CAST('0x' || substr(md5('mix' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM filled
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, h) AS place FROM classed
)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(p.size * CASE WHEN t.source_size = 0 THEN 0 ELSE
         floor(t.shift + t.target / t.source_size * p.place) - floor(t.shift + t.target / t.source_size * (p.place - 1)) END AS BIGINT) AS taken
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""
