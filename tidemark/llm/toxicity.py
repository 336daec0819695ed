"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (3 to 5 bytes of the text with A-Z
lower-cased and white space made single) that it holds, hashed to 22 bits.
From labelled texts come, per n-gram, the smoothed log ratio of its share among
the toxic and the other texts; the n-grams whose ratio is surest are kept, each
present feature takes its ratio as value, and a logistic regression with an L2
penalty is trained on top, in numpy.

Training learns from at most ``Spec.sample`` labelled texts, those of the least
hash of their id.  Their n-grams are counted where the texts lie; only the
numbers of the kept features that each text holds come to the driver, at most
``sample * features`` of them.  Scoring reads every whole text.

Null and empty texts hold no n-gram and get the model's base rate; labels
without document or with a null flag are not learnt from; rows of equal id,
text and label are learnt from once; without both classes among the labels
every score is the smoothed base rate; repeated rows are scored alike; extra
columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.common import discard, fresh, ship, stash

BITS = 22
GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Spec:
    """``sample``: labelled texts learnt from at most; ``features``: n-grams kept; ``least``: texts an n-gram must stand in."""

    sample: int = 8000
    features: int = 4000
    least: int = 4
    penalty: float = 1.0
    steps: int = 400


def _grams(col: pa.Array):
    """(rows, hashed n-grams) of a string column, repeats included, for one size of n-grams after the other."""
    data, offsets = textvec.column_bytes(col)
    blank = textvec.WORD_SPACE[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    keep = ~blank  # of a run of white space only the first counts
    keep[1:] |= blank[1:] & ~(blank[:-1] & (row[1:] == row[:-1]))
    low = np.where(blank, np.uint8(32), textvec.LOWER[data])[keep].astype(np.uint64)
    row = row[keep]
    h = low.copy()
    for k in range(1, max(GRAMS)):
        if len(low) <= k:
            return
        h = h[:-1] * np.uint64(257) + low[k:]
        if k + 1 in GRAMS:
            gram = (((h + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
            same = row[: len(h)] == row[k:]
            yield row[: len(h)][same], gram[same]


def presence(col: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (row, n-gram) pairs; ``wanted[gram]`` is the feature number + 1, or 0 for n-grams left out."""
    keys = []
    for row, gram in _grams(col):
        if wanted is not None:
            gram = wanted[gram]
            hit = np.flatnonzero(gram)
            row, gram = row[hit], gram[hit].astype(np.int64) - 1
        keys.append(row.astype(np.int64) << BITS | gram)
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1), len(col)


@dataclass
class Model:
    """``grams``: the kept n-grams; ``weight``: what the presence of each adds; ``bias``: the log odds of a text with none."""

    grams: np.ndarray
    weight: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        wanted = np.zeros(1 << BITS, np.uint16 if len(self.grams) < 1 << 16 else np.int32)  # small, to stay in the processor's cache
        wanted[self.grams] = np.arange(1, len(self.grams) + 1)
        return wanted

    def score(self, col: pa.Array, wanted: np.ndarray) -> np.ndarray:
        r, f, n = presence(col, wanted)
        return 1 / (1 + np.exp(-np.clip(np.bincount(r, weights=self.weight[f], minlength=n) + self.bias, -30, 30)))


def gram_counts(parts, toxic_parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, toxic texts with each, other texts with each) over parts of texts and their labels."""
    held = {True: np.zeros(1 << BITS, np.int32), False: np.zeros(1 << BITS, np.int32)}
    for texts, toxic in zip(parts, toxic_parts):
        for i, j in textvec.slices(texts, 256 << 10):  # small ones: a slice's n-grams take a hundred times its bytes
            r, f, _ = presence(texts.slice(i, j - i))
            for flag in held:
                np.add.at(held[flag], f[toxic[i:j][r] == flag], 1)
    grams = np.flatnonzero(held[True] + held[False])
    return grams, held[True][grams], held[False][grams]


def log_ratio(with_it, without, n_pos: int, n_neg: int, log=np.log):
    """The smoothed log ratio of an n-gram's shares among toxic and other texts."""
    return log((with_it + 0.5) / (n_pos + 1)) - log((without + 0.5) / (n_neg + 1))


def prior(n_pos: int, n_neg: int) -> float:
    return float(np.log((n_pos + 0.5) / (n_neg + 0.5)))


def regress(first: np.ndarray, f: np.ndarray, toxic: np.ndarray, grams: np.ndarray, ratio: np.ndarray, spec: Spec) -> Model:
    """Logistic regression on the features ``f[first[i]:first[i + 1]]`` of each text i, scaled by their ratios."""
    n, k = len(toxic), len(grams)
    r = np.repeat(np.arange(n), np.diff(first))
    y, bias = toxic.astype(float), prior(int(toxic.sum()), int((~toxic).sum()))
    w, m, v = np.zeros(k), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, spec.steps + 1):  # Adam on the whole sample
        z = np.bincount(r, weights=(w * ratio)[f], minlength=n) + bias
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append((np.bincount(f, weights=d[r], minlength=k) * ratio + spec.penalty * w) / n, d.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(grams, w * ratio, bias)


def labelled(docs: DataFrame, labels: DataFrame, spec: Spec, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """_flag, _text of at most ``spec.sample`` different labelled texts."""
    flags = labels.filter(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_flag")).distinct()
    flags = flags.orderBy(F.xxhash64("_id"), "_id", "_flag").limit(spec.sample)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    # the keys are chosen without their texts: at most ``sample`` short rows
    keys = rows.select("_id", "_hash").join(F.broadcast(flags), "_id").distinct().orderBy(F.xxhash64("_id"), "_id", "_flag", "_hash").limit(spec.sample)
    return rows.join(F.broadcast(keys), ["_id", "_hash"]).groupBy("_id", "_hash", "_flag").agg(F.min("_text").alias("_text")).select("_flag", "_text")


def train(docs: DataFrame, labels: DataFrame, spec: Spec = Spec(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled texts; see the head of the module for what comes to the driver."""
    ship(docs.sparkSession)
    rows = stash(labelled(docs, labels, spec, id_col=id_col, text_col=text_col, label_col=label_col), "labelled")
    n = {r["_flag"]: r["count"] for r in rows.groupBy("_flag").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        discard(rows)
        return Model(np.zeros(0, np.int64), np.zeros(0), prior(n_pos, n_neg))

    def counted(batches):
        parts = [(b.column(1), b.column(0).to_numpy() == 1) for b in batches]
        grams, pos, neg = gram_counts(*zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        for i in range(0, len(grams), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int32()) for x in (grams, pos, neg)], names=["gram", "pos", "neg"])

    grams = rows.mapInArrow(counted, "gram int, pos int, neg int").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") + F.col("neg") >= spec.least)
    sure = F.abs(log_ratio(F.col("pos"), F.col("neg"), n_pos, n_neg, F.log)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = grams.withColumn("sure", sure).filter("sure > 3").orderBy(F.desc("sure"), "gram").limit(spec.features).toArrow()
    best = best.take(np.argsort(best.column("gram").to_numpy()))
    grams = best.column("gram").to_numpy().astype(np.int64)
    ratio = log_ratio(best.column("pos").to_numpy(), best.column("neg").to_numpy(), n_pos, n_neg)
    model = Model(grams, ratio, 0.0)

    def held(batches):
        wanted = model.lookup()
        for b in batches:
            for i, j in textvec.slices(b.column(1), 256 << 10):
                r, f, count = presence(b.column(1).slice(i, j - i), wanted)
                at = np.searchsorted(r, np.arange(count + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))], names=["_flag", "f"])

    got = rows.mapInArrow(held, "_flag int, f array<int>").orderBy(F.xxhash64("f"), "f", "_flag").toArrow()
    lists = got.column("f").combine_chunks()
    first = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    discard(rows)
    return regress(first, lists.flatten().to_numpy().astype(np.int64), got.column("_flag").to_numpy() == 1, grams, ratio, spec)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with ``score``, the probability that a text is toxic."""
    ship(docs.sparkSession)
    keep = list(docs.columns) if keep is None else keep
    name, text = fresh(docs, "score", "_text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(name, T.DoubleType())])

    def run(batches):
        wanted = model.lookup()
        for b in batches:
            for i, j in textvec.slices(b.column(b.num_columns - 1)):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(part.column(part.num_columns - 1), wanted))], names=schema.names)

    return given.mapInArrow(run, schema)
