"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

A token is a word (A-Z lower-cased) or the end of a text.  Its probability is
P(class | the two classes before) * P(word | class, the class before).  The
commonest words are classes of their own; the others fall into classes by their
last two letters.  Within a class the ``vectors`` commonest words have vectors of
their own and all others of the class one in common, which they share by count.

Everything is learnt from all training texts: one pass counts words, a second
counts class trigrams and, per class before, the words that have vectors.  The
counts combine on the map side.  Both tables are bounded by the model's size, so
they can come to the driver, where two log-bilinear models (vectors of contexts
and targets, a matrix per context position, biases) are trained in numpy by
noise-contrastive estimation: batches of ``batch`` tokens are drawn from a table,
each with ``noise`` targets drawn from the unigram distribution (within the class
for words; all from a fixed seed), and the model learns to tell data from noise.
Batched matrix products then give the scores of all targets after all contexts,
and their normalised log-probabilities.

The others of a class: a word has probability (c + 1) / (N + V + 1) among them,
an unknown one 1 / (...), so all tokens together sum to one.

Word counts do not fit the driver.  The commonest words' counts, ``broadcast``
of them at most, go to all tasks; the others are joined by the word's hash.

Null and empty texts are one end token; rows with a null id train; repeated rows
are scored each; with no training text every class is equally likely; extra
columns pass through as asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.common import fresh, ship, stash, text_or_empty


@dataclass(frozen=True)
class Spec:
    """``classes`` in all, ``words`` of them single words; ``vectors``: further words with a vector; ``size`` of the vectors; ``noise`` per token; training ``steps`` of ``batch`` tokens."""

    classes: int = 128
    words: int = 80
    vectors: int = 4096
    size: int = 16
    noise: int = 10
    steps: int = 800
    batch: int = 2048
    broadcast: int = 1 << 18


_TAIL = np.isin(np.arange(256), np.frombuffer(b".,;:!?|%*#&$\"')(", np.uint8))


def endings(b: textvec.Batch) -> np.ndarray:
    """The last two bytes of every word before closing punctuation, as one number."""
    last = b.end - 1
    for _ in range(4):
        last = np.where((last > b.start) & _TAIL[b.data[last]], last - 1, last)
    before = np.maximum(last - 1, b.start)
    return b.data[before].astype(np.int64) << 8 | b.data[last]


@dataclass
class Model:
    """What scoring needs; class 0 is the end of a text, ``start`` a context only."""

    spec: Spec
    tokens: int = 0
    distinct: int = 0
    word_hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted; of the single-word classes
    word_class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ending_class: np.ndarray = field(default_factory=lambda: np.ones(1 << 16, np.int64))
    vector_hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted; of the words with vectors
    vector_target: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # their columns of ``within``
    other_target: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # per class: the column of all its other words
    room: np.ndarray = field(default_factory=lambda: np.zeros(0))  # per class: log10 of what an other word's count + 1 is divided by
    common_hash: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted; words whose counts are at hand
    common_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end_count: int = 0
    log_p: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # (context, class), log10
    within: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # (class before, target), log10 given the target's class

    @property
    def start(self) -> int:
        return self.spec.classes

    def single(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.word_hash, hashes)

    def targets(self, b: textvec.Batch, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(column of ``within`` of every word, whether it has a vector of its own), given the words' classes."""
        at, known = _find(self.vector_hash, b.hash)
        out = self.other_target[classes]
        out[known] = self.vector_target[at[known]]
        return out, known

    def class_sequence(self, b: textvec.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class of every token, ends included; its context; whether a word is a class of its own)."""
        at, own = self.single(b.hash)
        classes = self.ending_class[endings(b)] if len(b.hash) else np.zeros(0, np.int64)
        classes[own] = self.word_class[at[own]]
        rows = len(b.n)
        seq = np.zeros(len(classes) + rows, np.int64)
        seq[np.arange(len(classes)) + b.row] = classes
        begin = b.first[:-1] + np.arange(rows)
        one = np.empty_like(seq)
        one[1:] = seq[:-1]
        one[begin] = self.start
        two = np.empty_like(seq)
        two[2:] = seq[:-2]
        two[begin] = self.start
        two[(begin + 1)[b.n > 0]] = self.start
        return seq, two * (self.start + 1) + one, own


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys).clip(max=len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def train_nce(table: np.ndarray, spec: Spec, seed: int = 1) -> np.ndarray:
    """log10 P(class | context) for every context, from trigram counts of shape (classes + 1, classes + 1, classes)."""
    k, c1 = spec.classes, spec.classes + 1
    counts = table.reshape(c1 * c1, k).astype(np.float32)
    seen = np.flatnonzero(counts.sum(axis=1))
    if not len(seen):
        return np.full((c1 * c1, k), -np.log10(k), np.float32)
    n = counts[seen]
    per_context = n.sum(axis=1, keepdims=True)
    noise = ((n.sum(axis=0) + 1) / (n.sum() + k)).astype(np.float64)
    rng = np.random.default_rng(seed)
    p = {
        "context": rng.normal(0, 0.1, (c1, spec.size)),
        "target": rng.normal(0, 0.1, (k, spec.size)),
        "far": np.eye(spec.size),
        "near": np.eye(spec.size),
        "bias": np.log(noise),
    }
    p = {name: v.astype(np.float32) for name, v in p.items()}
    shift = np.log(spec.noise * noise).astype(np.float32)
    # tokens are drawn so that a context's pull grows with the root of its count: rare contexts learn too, common ones don't drown them
    cell = np.flatnonzero(n)
    draw = np.cumsum((n / np.sqrt(per_context)).reshape(-1)[cell].astype(np.float64))
    draw_noise = np.cumsum(noise) / noise.sum()
    far_of, near_of = seen // c1, seen % c1
    m = {name: np.zeros_like(v) for name, v in p.items()}
    s = {name: np.zeros_like(v) for name, v in p.items()}
    add = lambda rows, values: np.stack([np.bincount(rows, weights=values[:, j], minlength=c1) for j in range(spec.size)], axis=1).astype(np.float32)
    token = np.arange(spec.batch)
    for step in range(1, spec.steps + 1):
        at = cell[np.searchsorted(draw, rng.random(spec.batch) * draw[-1], side="right").clip(max=len(cell) - 1)]
        far, near, data = far_of[at // k], near_of[at // k], at % k
        false = np.searchsorted(draw_noise, rng.random((spec.batch, spec.noise)), side="right").clip(max=k - 1)
        a, b = p["context"][far], p["context"][near]
        q = a @ p["far"] + b @ p["near"]
        real = 1 / (1 + np.exp(-np.clip(q @ p["target"].T + p["bias"] - shift, -30, 30)))  # P(from the data) of every class
        taken = np.bincount((token[:, None] * k + false).reshape(-1), minlength=spec.batch * k).reshape(spec.batch, k)
        g = (-taken * real).astype(np.float32)
        g[token, data] += 1 - real[token, data]
        g /= spec.batch
        dq = g @ p["target"]
        grad = {"target": g.T @ q, "bias": g.sum(axis=0), "far": a.T @ dq, "near": b.T @ dq, "context": add(far, dq @ p["far"].T) + add(near, dq @ p["near"].T)}
        for name, d in grad.items():  # Adam, upwards
            m[name] = 0.9 * m[name] + 0.1 * d
            s[name] = 0.99 * s[name] + 0.01 * d * d
            p[name] += 0.02 * (1 - step / (spec.steps + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-10)
    half = [p["context"] @ p["far"], p["context"] @ p["near"]]
    out = np.empty((c1 * c1, k), np.float32)
    for i in range(c1):  # one product per far class: all near classes at once
        z = (half[0][i] + half[1]) @ p["target"].T + p["bias"]
        z -= z.max(axis=1, keepdims=True)
        out[i * c1 : (i + 1) * c1] = (z - np.log(np.exp(z).sum(axis=1, keepdims=True))) / np.log(10)
    return out


def train_within(table: np.ndarray, first: np.ndarray, spec: Spec, seed: int = 2) -> np.ndarray:
    """log10 P(target | its class, the class before), from counts of shape (classes + 1, targets).

    The targets of class i are the columns first[i] to first[i + 1].
    """
    c1, m = table.shape
    counts = table.astype(np.float64)
    total = counts.sum(axis=0) + 1
    size = np.diff(first)
    own = np.repeat(np.arange(len(size)), size)  # the class of every target
    share = total / np.add.reduceat(total, first[:-1])[own]
    rng = np.random.default_rng(seed)
    p = {"context": rng.normal(0, 0.01, (c1, spec.size)), "target": rng.normal(0, 0.1, (m, spec.size)), "bias": np.log(share)}
    p = {name: v.astype(np.float32) for name, v in p.items()}
    cell = np.flatnonzero(counts * (size[own] > 1))
    if len(cell):
        draw = np.cumsum((counts / np.sqrt(counts.sum(axis=1, keepdims=True) + 1)).reshape(-1)[cell])
        until = np.concatenate([[0.0], np.cumsum(total)])
        shift = np.log(spec.noise * share).astype(np.float32)
        a = {name: np.zeros_like(v) for name, v in p.items()}
        b = {name: np.zeros_like(v) for name, v in p.items()}
        sums = lambda rows, values, n: np.stack([np.bincount(rows, weights=values[:, j], minlength=n) for j in range(spec.size)], axis=1).astype(np.float32)
        for step in range(1, spec.steps + 1):
            at = cell[np.searchsorted(draw, rng.random(spec.batch) * draw[-1], side="right").clip(max=len(cell) - 1)]
            near, data = at // m, at % m
            lo, hi = until[first[own[data]]], until[first[own[data] + 1]]
            false = np.searchsorted(until, lo[:, None] + rng.random((spec.batch, spec.noise)) * (hi - lo)[:, None], side="right") - 1
            false = np.clip(false, first[own[data]][:, None], first[own[data] + 1][:, None] - 1)
            both = np.concatenate([data[:, None], false], axis=1)
            q, t = p["context"][near], p["target"][both]
            g = -1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", q, t) + p["bias"][both] - shift[both], -30, 30)))
            g[:, 0] += 1  # the first of each row is from the data
            g /= spec.batch
            flat = both.reshape(-1)
            grad = {"context": sums(near, np.einsum("bk,bkd->bd", g, t), c1), "target": sums(flat, (g[:, :, None] * q[:, None, :]).reshape(-1, spec.size), m), "bias": np.bincount(flat, weights=g.reshape(-1), minlength=m).astype(np.float32)}
            for name, d in grad.items():  # Adam, upwards
                a[name] = 0.9 * a[name] + 0.1 * d
                b[name] = 0.99 * b[name] + 0.01 * d * d
                p[name] += 0.02 * (1 - step / (spec.steps + 1)) * (a[name] / (1 - 0.9**step)) / (np.sqrt(b[name] / (1 - 0.99**step)) + 1e-8)
    z = p["context"] @ p["target"].T + p["bias"]
    return ((z - np.logaddexp.reduceat(z, first[:-1], axis=1)[:, own]) / np.log(10)).astype(np.float32)


def fit(training: DataFrame, spec: Spec = Spec(), *, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the counts of the words it does not hold itself (columns hash, c)."""
    ship(training.sparkSession)
    texts = training.select(text_or_empty(F.col(f"`{text_col}`")).alias("_text"))

    def count(batches):
        for batch in batches:
            for i, j in textvec.slices(batch.column(0)):
                b = textvec.Batch(batch.column(0).slice(i, j - i), lower=True)
                found, first, times = np.unique(b.hash, return_index=True, return_counts=True)
                ends = endings(b)[first] if len(first) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found.astype(np.int64), 0)), pa.array(np.append(ends, -1)), pa.array(np.append(times, j - i).astype(np.int64))], names=["hash", "ending", "c"])

    counted = texts.mapInArrow(count, "hash long, ending long, c long").groupBy("hash", "ending").agg(F.sum("c").alias("c"))
    counted = stash(counted, "words")  # ending -1: the end of texts
    model = Model(spec)
    total = counted.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("ending") < 0, F.col("c")))).first()
    model.tokens, model.distinct, model.end_count = total[0] or 0, total[1], total[2] or 0
    words = counted.filter("ending >= 0")

    # the lowest count of which the words at hand have at most ``broadcast``
    steps = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("c") > 1).orderBy(F.desc("c")).limit(spec.broadcast).collect()
    least, held = 1 << 62, 0
    for r in steps:
        if held + r["n"] > spec.broadcast:
            break
        least, held = r["c"], held + r["n"]
    common = words.filter(F.col("c") >= least).toArrow()
    hashes, counts, ends = common.column("hash").to_numpy().astype(np.int64).view(np.uint64), common.column("c").to_numpy(), common.column("ending").to_numpy()
    order = np.argsort(hashes)
    model.common_hash, model.common_count = hashes[order], counts[order]
    ranked = np.lexsort((hashes, -counts))
    top, further = ranked[: spec.words], ranked[spec.words : spec.words + spec.vectors]
    by_ending = {r["ending"]: (r["c"], r["v"]) for r in words.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}  # at most 2**16
    for i in np.concatenate([top, further]):
        c, v = by_ending[int(ends[i])]
        by_ending[int(ends[i])] = (c - int(counts[i]), v - 1)
    sorted_top = top[np.argsort(hashes[top])]
    model.word_hash = hashes[sorted_top]
    model.word_class = np.arange(1, len(top) + 1)
    free = spec.classes - 2 - len(top)
    common_ends = sorted(by_ending, key=lambda e: (-by_ending[e][0], e))[:free]
    model.ending_class[:] = spec.classes - 1
    model.ending_class[np.array(common_ends, np.int64)] = np.arange(len(top) + 1, len(top) + 1 + len(common_ends))
    room = np.ones(spec.classes)
    for e, (c, v) in by_ending.items():
        room[model.ending_class[e]] += c + v
    model.room = np.log10(room)
    # columns: class by class its words with vectors, then its others
    further = further[np.lexsort((hashes[further], model.ending_class[ends[further]]))]
    in_class = np.bincount(model.ending_class[ends[further]], minlength=spec.classes) + 1
    first = np.concatenate([[0], np.cumsum(in_class)])
    model.other_target = first[1:] - 1
    column = np.arange(len(further)) + model.ending_class[ends[further]]
    by_hash = np.argsort(hashes[further])
    model.vector_hash, model.vector_target = hashes[further][by_hash], column[by_hash]

    c1, targets = spec.classes + 1, int(first[-1])
    trigram_cells = c1 * c1 * spec.classes
    cells = trigram_cells + c1 * targets

    def cells_of(batches):
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for i, j in textvec.slices(batch.column(0)):
                b = textvec.Batch(batch.column(0).slice(i, j - i), lower=True)
                seq, context, own = model.class_sequence(b)
                word = np.arange(len(b.hash)) + b.row
                target, _ = model.targets(b, seq[word])
                pairs = trigram_cells + (context[word] % c1) * targets + target
                cell, times = np.unique(np.concatenate([context * spec.classes + seq, pairs[~own]]), return_counts=True)
                table[cell] += times
        cell = np.flatnonzero(table)
        for i in range(0, len(cell), 1 << 16):
            part = cell[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(table[part])], names=["cell", "n"])

    table = np.zeros(cells, np.int64)
    got = texts.mapInArrow(cells_of, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    model.log_p = train_nce(table[:trigram_cells], spec)
    model.within = train_within(table[trigram_cells:].reshape(c1, targets), first, spec)
    return model, words.filter(F.col("c") < least).select("hash", "c")


def score(docs: DataFrame, model: Model, rest: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with n_tokens, n_known, train_tokens, base_score and score.

    One pass scores all tokens but the counts of uncommon words; those words,
    one row per document and word, are joined by hash and summed per document.
    """
    ship(docs.sparkSession)
    keep = list(docs.columns) if keep is None else keep
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    given = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("_row"), text_or_empty(F.col(f"`{text_col}`")).alias("_text"))
    k = len(keep)
    extra = [("_n", T.LongType()), ("_known", T.LongType()), ("_log_c", T.DoubleType()), ("_part", T.DoubleType()), ("_words", T.ArrayType(T.LongType())), ("_times", T.ArrayType(T.LongType()))]
    schema = T.StructType([*given.schema.fields[: k + 1], *[T.StructField(n, t) for n, t in extra]])

    def run(batches):
        for batch in batches:
            for i, j in textvec.slices(batch.column(k + 1)):
                part = batch.slice(i, j - i)
                b = textvec.Batch(part.column(k + 1), lower=True)
                rows = part.num_rows
                seq, context, own = model.class_sequence(b)
                ends = np.append(b.first[:-1] + np.arange(rows), len(seq))
                total = np.concatenate([[0.0], np.cumsum(model.log_p[context, seq].astype(np.float64))])
                classed = total[ends[1:]] - total[ends[:-1]]
                word = np.arange(len(b.hash)) + b.row
                target, known = model.targets(b, seq[word])
                in_class = np.where(own, 0.0, model.within[context[word] % (model.start + 1), target])
                others = ~own & ~known  # these share their class's vector by count
                spread = np.where(others, model.room[seq[word]], 0.0)
                at, common = _find(model.common_hash, b.hash)
                log_c = np.where(common, np.log10(model.common_count[at] + 1.0) if len(model.common_count) else 0.0, 0.0)
                by_row = lambda v: np.bincount(b.row, weights=v, minlength=rows)
                end_c = np.log10(model.end_count + 1.0)
                scored = classed + by_row(in_class - spread + np.where(others, log_c, 0.0))
                left = np.flatnonzero(~common)
                left = left[np.lexsort((b.hash[left], b.row[left]))]
                r, h = b.row[left], b.hash[left]
                new = np.ones(len(left), bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(left)))
                at = pa.array(np.searchsorted(r[first], np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int64))) for v in (h[first].view(np.int64), times)]
                known = by_row(common).astype(np.int64) + (model.end_count > 0)
                yield pa.RecordBatch.from_arrays([*part.columns[: k + 1], pa.array((b.n + 1).astype(np.int64)), pa.array(known), pa.array(by_row(log_c) + end_c), pa.array(scored), *lists], names=schema.names)

    scored = stash(given.mapInArrow(run, schema), "scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("_w")).select("_row", F.col("_w._words").alias("hash"), F.col("_w._times").alias("_t"))
    found = rare.join(rest, "hash").groupBy("_row").agg(F.sum(F.col("_t") * F.log10(F.col("c") + 1.0)).alias("_more"), F.sum("_t").alias("_more_known"))
    out = scored.drop("_words", "_times").join(found, "_row", "left")
    more = F.coalesce("_more", F.lit(0.0))
    base = F.col("_log_c") + more - F.col("_n") * F.lit(float(np.log10(model.tokens + model.distinct + 1)))
    added = (F.col("_n"), F.col("_known") + F.coalesce("_more_known", F.lit(0)), F.lit(model.tokens).cast("long"), base, F.col("_part") + more)
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(n) for c, n in zip(added, names)])
