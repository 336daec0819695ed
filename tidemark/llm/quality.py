"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected, in every stratum.

Each rule compares one share of the text (symbols, capitals, repeated lines,
repeated words) with a cutoff.  Per stratum (language) and rule the cutoffs of
a fixed grid are tested from the most lenient on, each by the exact binomial
(Clopper-Pearson) upper bound of the rate at which labelled good documents fall
to it; testing stops at the first that is not certified, so a stratum and rule
cost one test of the error budget (fixed-sequence testing), and Bonferroni
splits the budget among strata and rules.  The allowed false rejection is split
among the rules, so it bounds what they reject together.  Of the certified
cutoffs the one that gains most is taken, bad documents rejected less ``cost``
times the good ones, the more lenient on a tie.  Documents that the base rule
rejects anyhow take no part.  A stratum with too few labels certifies nothing and rejects nothing.

Nulls and empty texts have zero for every count and are rejected by the base
rule; a null stratum is a stratum of its own; labels without a document, or
null labels, count for nothing; repeated label rows count as often as they
stand there; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.common import discard, fresh, maybe_broadcast, ship, stash

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
UPPER = np.isin(np.arange(256), np.arange(65, 91))

#: from the most lenient cutoff to the strictest
GRID = tuple(round(0.95 - 0.05 * i, 2) for i in range(16)) + (0.17, 0.14, 0.12, 0.1, 0.08, 0.06)

#: rule -> (count, whole) of the share it looks at
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_upper", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Risk:
    """At most ``rate`` of a stratum's good documents are rejected by all rules together, with probability 1 - ``miss`` for all strata at once.

    ``cost``: how many bad documents the loss of a good one outweighs when certified cutoffs are compared.
    """

    rate: float = 0.05
    miss: float = 0.05
    cost: float = 10.0


def count_text(col: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of every text of an Arrow string column."""
    b = textvec.Batch(col)
    data, offsets = b.data, b.offsets
    rows = len(offsets) - 1

    def of_bytes(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(b.inside & ~CONTINUATION[data], out=worded[1:])
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.repeat(np.arange(rows), of_bytes(data == 10) + 1)
    full = worded[ends] > worded[starts]
    line_row = line_row[full]
    key = textvec.mix(textvec.span_hash(data, starts[full], ends[full]) + textvec.mix(line_row.astype(np.uint64)))
    _, index = np.unique(key, return_index=True)
    n_lines = np.bincount(line_row, minlength=rows)

    h, whole = textvec.windows(b.hash, b.first, 5)
    at = np.flatnonzero(whole)
    _, inverse, times = np.unique(textvec.mix(h[at] + textvec.mix(b.row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    hit = at[times[inverse] > 1]
    cover = np.zeros(len(b.hash) + 6, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    return {
        "n_words": b.n.astype(np.int64),
        "word_chars": worded[offsets[1:]] - worded[offsets[:-1]],
        "n_symbols": of_bytes(SYMBOLS[data]),
        "n_dup_lines": n_lines - np.bincount(line_row[index], minlength=rows),
        "n_repeat_words": textvec.per_row_sum(np.cumsum(cover)[: len(b.hash)] > 0, b.first),
        "n_lines": n_lines,
        "n_upper": of_bytes(UPPER[data]),
    }


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (or only ``keep`` of it) with its COUNTS added, and the names the counts got (``_`` before a clashing one)."""
    ship(docs.sparkSession)
    keep = list(docs.columns) if keep is None else keep
    names = dict(zip(COUNTS, fresh(docs, *COUNTS)))
    text = fresh(docs, "_text")[0]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names.values()]])

    def count(batches):
        for batch in batches:
            whole = batch.column(batch.num_columns - 1)
            for i, j in textvec.slices(whole):
                part = batch.slice(i, j - i)
                got = count_text(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(got[c], pa.int64()) for c in COUNTS]], names=schema.names)

    return given.mapInArrow(count, schema), names


def base_failed(names: dict[str, str]) -> Column:
    """Fewer than 10 words, or more than a fifth of the words in repeated windows."""
    n, rep = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (n < 10) | (100 * rep > 20 * n)


def _share(rule: str, names: dict[str, str]) -> Column:
    part, whole = RULES[rule]
    return F.coalesce(F.col(names[part]) / F.col(names[whole]), F.lit(0.0))


def binomial_upper(k: int, n: int, miss: float) -> float:
    """The Clopper-Pearson upper bound: the largest rate at which k or fewer of n still has probability ``miss``."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if tail(mid or 1e-300) > miss:
            lo = mid
        else:
            hi = mid
    return hi


def pick_cutoff(good: np.ndarray, bad: np.ndarray, rate: float, miss: float, cost: float) -> float | None:
    """The cutoff for one stratum and rule.

    ``good[i]`` and ``bad[i]`` count labelled documents whose share stays below
    exactly the first i cutoffs of GRID, so GRID[j] rejects those with i <= j.
    """
    n_good, best, chosen = int(good.sum()), 0.0, None
    fallen_good, fallen_bad = np.cumsum(good), np.cumsum(bad)
    for j, cutoff in enumerate(GRID):
        if not n_good or binomial_upper(int(fallen_good[j]), n_good, miss) > rate:
            break
        gain = fallen_bad[j] - cost * fallen_good[j]
        if gain > best:
            best, chosen = gain, cutoff
    return chosen


def cutoffs(counted: DataFrame, names: dict[str, str], labels: DataFrame, risk: Risk = Risk(), *, id_col: str = "doc_id", stratum_col: str = "lang", quality_col: str = "quality") -> DataFrame:
    """One row per stratum: ``stratum`` and a cutoff (or null) per rule, from all labelled documents.

    The labelled documents shrink to counts per stratum, rule, grid step and
    label before anything is gathered; one group of at most
    2 * rules * (grid + 1) rows per stratum is then searched.
    """
    marked = labels.filter(F.col(quality_col).isin(0, 1)).select(F.col(id_col).alias("_id"), (F.col(quality_col) == 1).alias("_good"))
    # step i: the share stays below exactly the first i cutoffs of GRID
    step = lambda rule: F.size(F.filter(F.array(*map(F.lit, GRID)), lambda c: _share(rule, names) < c))
    steps = (
        counted.filter(F.col(id_col).isNotNull() & ~base_failed(names))
        .select(F.col(id_col).alias("_id"), F.col(stratum_col).cast("string").alias("stratum"), *[step(r).alias(f"_{r}") for r in RULES])
        .join(marked, "_id")
        .groupBy("stratum", "_good", *[f"_{r}" for r in RULES])
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("stratum", "_good", "_n", F.posexplode(F.array(*[F.col(f"_{r}") for r in RULES])).alias("_rule", "_step"))
        .groupBy("stratum", "_good", "_rule", "_step")
        .agg(F.sum("_n").alias("_n"))
    )
    steps = stash(steps, "steps")
    n_strata = steps.select("stratum").distinct().count()
    rules = list(RULES)
    schema = T.StructType([T.StructField("stratum", T.StringType()), *[T.StructField(r, T.DoubleType()) for r in rules]])

    def search(key, pdf):
        import pandas as pd

        miss = risk.miss / (n_strata * len(rules))
        row = {"stratum": key[0]}
        for k, r in enumerate(rules):
            tall = {}
            for flag in (True, False):
                own = pdf[(pdf["_rule"] == k) & (pdf["_good"] == flag)]
                tall[flag] = np.bincount(own["_step"], weights=own["_n"], minlength=len(GRID) + 1).astype(np.int64)
            row[r] = pick_cutoff(tall[True], tall[False], risk.rate / len(rules), miss, risk.cost)
        return pd.DataFrame([row], columns=schema.names).astype({r: "float64" for r in rules})

    return steps.groupBy("stratum").applyInPandas(search, schema)


def with_verdict(counted: DataFrame, names: dict[str, str], cut: DataFrame, *, stratum_col: str = "lang") -> DataFrame:
    """``counted`` with base_failed and kept.

    ``cut`` has a row per stratum; its rows are counted, and broadcast only
    when they are few.
    """
    failed, kept, stratum, *limits = fresh(counted, "base_failed", "kept", "_stratum", *[f"_cut_{r}" for r in RULES])
    cut = cut.select(F.col("stratum").alias(stratum), *[F.col(r).alias(c) for r, c in zip(RULES, limits)])
    joined = counted.join(maybe_broadcast(cut, cut.count(), 100), F.col(f"`{stratum_col}`").cast("string").eqNullSafe(F.col(stratum)), "left")
    bad = F.lit(False)
    for r, limit in zip(RULES, limits):
        bad = bad | F.coalesce(_share(r, names) >= F.col(limit), F.lit(False))
    return joined.withColumn(failed, base_failed(names)).withColumn(kept, ~F.col(failed) & ~bad).drop(stratum, *limits)


def filtered(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), *, id_col: str = "doc_id", stratum_col: str = "lang", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """The documents that the rules keep, with their own columns; cutoffs come from those of them that have labels."""
    counted, names = with_counts(docs, text_col, keep=list(dict.fromkeys([id_col, stratum_col])))
    counted = stash(counted, "quality")  # a few numbers a row: the labels meet these, never the texts
    cut = stash(cutoffs(counted, names, labels, risk, id_col=id_col, stratum_col=stratum_col, quality_col=quality_col), "cutoffs")
    discard(counted)
    counted, names = with_counts(docs, text_col)
    judged = with_verdict(counted, names, cut, stratum_col=stratum_col)
    return judged.filter(F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
