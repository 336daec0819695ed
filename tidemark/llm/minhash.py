"""Near-duplicates by HyperMinHash.

A document's set are its distinct 5-word shingles (A-Z lower-cased); of fewer
words the whole sequence is the one shingle; without words the set is empty and
linked with nothing.

1. One pass turns each text into a HyperMinHash sketch: shingles fall into 252
   buckets, a bucket keeps of its least hash the number of leading zeros and 10
   bits of mantissa, 16 bits in all.  Equal sets get one 128-bit class key, so
   exact copies collapse before anything is compared.
2. Empty registers borrow from filled ones in an order of their own, so small
   sets have 252 filled ones too; 42 bands of 6 registers file each set in 42
   buckets.  Two sets of similarity J miss each other with probability
   (1 - J**6)**42: 2e-9 at 0.85, 3e-6 at 0.8.
3. Each set is paired with one member of each of its buckets, never with all:
   with the one whose buckets hold most, likely the text that others are copies
   of.  Register agreement, less the chance agreement of two sets of these
   sizes, rules out pairs more than 4.5 standard errors below the threshold
   (a link is lost with probability 3e-6); the others are confirmed on the full
   sets.
4. A bucket that still holds several groups is searched: its members outside the
   largest one are compared with all members of other groups, block by block,
   each pair in its first common bucket only, on registers and then on full
   sets.  So every two members of a bucket are either connected or were
   compared.  A block yields a spanning forest of its links, never its pairs.
5. The components of the confirmed links are the groups.

Rows grow with the members of buckets, whatever the size of a group of near
copies.  The comparisons of 4 grow with a bucket's members times those that its
largest group leaves outside; they are spread over blocks.

Null texts are empty; a null id belongs to its group but is never its smallest
id; repeated rows are exact copies; extra columns pass through, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.common import discard, fresh, hot_keys, maybe_broadcast, ship, spread_join, stash, text_or_empty
from tidemark.llm.components import components

SHINGLE, REGISTERS, MANTISSA, BANDS = 5, 252, 10, 42
#: of a block: members of one bucket, and their shingles
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000


#: mean size of a text's part from which parts are sorted one by one
_LONG = 40


def _sort_parts(values: np.ndarray, first: np.ndarray) -> None:
    """Sorts ``values[first[i]:first[i + 1]]`` for every i, in place."""
    if len(values) < _LONG * (len(first) - 1):
        values[:] = values[np.lexsort((values, np.repeat(np.arange(len(first) - 1), np.diff(first))))]
    else:
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            values[i:j].sort()


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within a text, and n + 1 offsets."""
    b = textvec.Batch(col, lower=True)
    h, whole = textvec.windows(b.hash, b.first, SHINGLE)
    first = np.concatenate([[0], np.cumsum(np.where(b.n < SHINGLE, b.n > 0, b.n - SHINGLE + 1))])
    value = np.empty(first[-1], np.uint64)
    short = np.flatnonzero((b.n > 0) & (b.n < SHINGLE))
    long = np.ones(len(value), bool)
    long[first[short]] = False
    value[long] = h[whole]
    if len(short):
        at = [b.hash[b.first[i] : b.first[i + 1]] for i in short]
        total = np.array([np.bitwise_xor.reduce(textvec.mix(x * np.uint64(2 * len(x) + 1) + np.arange(len(x), dtype=np.uint64))) for x in at], np.uint64)
        value[first[short]] = textvec.mix(total + np.uint64(1))
    _sort_parts(value, first)
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[first[:-1][first[:-1] < len(value)]] = True
    return value[new], np.concatenate([[0], np.cumsum(new)])[first]


#: rows whose registers are numbered together, and the bits that their numbers take
_ROWS, _SLOT_BITS = 1 << 16, 24


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash sketches, a row of REGISTERS each; 0 is an empty register."""
    n = len(first) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    for lo in range(0, n, _ROWS):
        hi = min(lo + _ROWS, n)
        v = values[first[lo] : first[hi]]
        slot = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(first[lo : hi + 1])) * np.uint64(REGISTERS) + ((v >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32))
        rest = textvec.mix(v ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1 << _SLOT_BITS)  # of which the high 40 bits count
        both = slot << np.uint64(64 - _SLOT_BITS) | rest >> np.uint64(_SLOT_BITS)
        both.sort()  # by register, then least hash first
        slot = both >> np.uint64(64 - _SLOT_BITS)
        least = np.ones(len(slot), bool)
        least[1:] = slot[1:] != slot[:-1]
        slot, rest = slot[least].astype(np.int64), both[least] << np.uint64(_SLOT_BITS)
        zeros = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1].clip(1, 53) - 11
        mantissa = (rest << (zeros + 1).clip(0, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[lo:hi].reshape(-1)[slot] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16) + 1
    return out


#: for each register, the order in which it looks for a filled one
_LENDERS = np.argsort(textvec.mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS), axis=1)


def filled(sketch: np.ndarray) -> np.ndarray:
    """Sketches whose empty registers hold the value of the first filled one in their order; all need one filled register."""
    out = sketch.copy()
    row, slot = np.nonzero(sketch == 0)
    for attempt in range(REGISTERS):
        if not len(row):
            break
        lent = sketch[row, _LENDERS[slot, attempt]]
        out[row, slot] = lent
        left = lent == 0
        row, slot = row[left], slot[left]
    return out


def bucket_keys(sketch: np.ndarray) -> np.ndarray:
    """The BANDS buckets of every set."""
    spread = textvec.mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    each = textvec.mix(filled(sketch).astype(np.uint64) * spread + spread)
    return textvec.mix(each.reshape(len(sketch), BANDS, -1).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that two disjoint sets of n and m shingles agree in a register.

    The least hashes of a bucket are exponential with rates n and m over
    REGISTERS; both must fall into one of the cells 2**-(z + 1 + MANTISSA) wide
    that z leading zeros have.
    """
    a, b = np.asarray(n) / REGISTERS, np.asarray(m) / REGISTERS
    z = 2.0 ** -np.arange(40)
    both = (a + b)[..., None]
    cells = (z / 2 ** (MANTISSA + 1) * (np.exp(-both * z / 2) - np.exp(-both * z))).sum(axis=-1)
    either = -np.expm1(-(a + b))  # registers that are empty in both don't count
    return a * b / (a + b) * cells / either


def estimate(one: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of sketch rows, corrected for chance agreement, and the registers it rests on."""
    used = ((one > 0) | (others > 0)).sum(axis=-1)
    equal = ((one == others) & (one > 0)).sum(axis=-1)
    p = chance(n, m)
    return (equal / used - p) / (1 - p), used


def likely(one: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sketch rows may be linked."""
    j, used = estimate(one, others, n, m)
    fits = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    return fits & (j >= threshold - 4.5 * np.sqrt(threshold * (1 - threshold) / used) - 0.01)


def linked(one: np.ndarray, other: np.ndarray, threshold_pct: int) -> bool:
    """Whether two sorted sets are linked."""
    if len(one) > len(other):
        one, other = other, one
    shared = int((other[np.searchsorted(other, one).clip(max=len(other) - 1)] == one).sum())
    return 100 * shared >= threshold_pct * (len(one) + len(other) - shared)


def class_keys(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits that equal sets share; None for an empty set."""
    n = np.diff(first)
    sums = []
    for salt in (11, 1337):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(textvec.mix(values + np.uint64(salt)), out=total[1:])
        sums.append(textvec.mix((total[first[1:]] - total[first[:-1]]) + n.astype(np.uint64)))
    both = np.stack(sums, axis=1)
    return [both[i].tobytes() if n[i] else None for i in range(len(n))]


def sketched(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """_id, _hash (of the text), n_shingles, cls and sketch per document: everything but the text."""
    ship(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text_or_empty(F.col(f"`{text_col}`"))).alias("_hash"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = T.StructType([*given.schema.fields[:2], T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        for b in batches:
            for i, j in textvec.slices(b.column(2)):
                part = b.slice(i, j - i)
                values, first = shingle_sets(part.column(2))
                sketch = pa.array([r.tobytes() for r in registers(values, first)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(class_keys(values, first), pa.binary()), sketch], names=schema.names)

    return given.mapInArrow(run, schema)


def _sketch_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), REGISTERS)


def _filed(classes: DataFrame, threshold: float) -> DataFrame:
    """key, cls: the buckets of every set that may be linked with another than its equal."""
    least = math.ceil(threshold / (1 - threshold) - 1e-9)

    def run(batches):
        for b in batches:
            keys = bucket_keys(_sketch_rows(b.column("sketch"))) if b.num_rows else np.zeros((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), b.column("cls").take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["key", "cls"])

    return classes.filter(F.col("n") >= least).select("cls", "sketch").mapInArrow(run, "key long, cls binary")


def _likely_pairs(pairs: DataFrame, sets: DataFrame, hot: DataFrame | None, threshold: float) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out; ``hot`` are the much used b."""

    def run(batches):
        for t in batches:
            for i in range(0, t.num_rows, 2048):
                p = t.slice(i, 2048)
                n, m = p.column("n").to_numpy(), p.column("m").to_numpy()
                keep = pa.array(np.flatnonzero(likely(_sketch_rows(p.column("s")), _sketch_rows(p.column("t")), n, m, threshold)))
                yield pa.RecordBatch.from_arrays([p.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    left = pairs.join(sets.select(F.col("cls").alias("a"), "n", F.col("sketch").alias("s")), "a")
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    return spread_join(left, right, "b", hot).select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, hot: DataFrame | None, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) that are linked, as their full sets tell."""

    def run(batches):
        last, theirs = None, None
        for t in batches:
            for i, j in textvec.slices(t.column("s")):
                p = t.slice(i, j - i)
                a, b = p.column("a"), p.column("b").to_pylist()
                values, first = shingle_sets(p.column("s"))
                told = np.zeros(p.num_rows, bool)
                for k, name in enumerate(b):
                    if name != last:  # the pairs of one b mostly come together
                        theirs, last = shingle_sets(p.column("t").slice(k, 1))[0], name
                    told[k] = linked(values[first[k] : first[k + 1]], theirs, threshold_pct)
                keep = pa.array(np.flatnonzero(told))
                yield pa.RecordBatch.from_arrays([a.take(keep), p.column("b").take(keep)], names=["a", "b"])

    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("_text").alias("s")), "a")
    right = texts.select(F.col("cls").alias("b"), F.col("_text").alias("t"))
    return spread_join(left, right, "b", hot).select("a", "b", "s", "t").mapInArrow(run, "a binary, b binary")


def compared(key: np.ndarray, cls: list[bytes], root: list[bytes], out: np.ndarray, probe: np.ndarray, texts: pa.Array, threshold_pct: int) -> list[tuple[bytes, bytes]]:
    """Spanning forests of the links between groups, of blocks that follow one another.

    ``key`` tells the bucket of each row, blocks are runs of equal ``key`` rows
    in it.  ``probe`` rows meet the others; of two rows that are ``out`` both,
    the lesser class is the probe.
    """
    sets: list[np.ndarray] = []
    sketches, n = [], []
    for i, j in textvec.slices(texts):
        values, first = shingle_sets(texts.slice(i, j - i))
        sets += [values[a:b] for a, b in zip(first[:-1], first[1:])]
        sketches.append(registers(values, first))
        n.append(np.diff(first))
    sketch, n = np.concatenate(sketches), np.concatenate(n)
    buckets = bucket_keys(sketch)
    forest = []
    new = np.any(key[1:] != key[:-1], axis=1)
    cuts = np.flatnonzero(new) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
        parent = {r: r for r in root[lo:hi]}

        def top(r: bytes) -> bytes:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        band = int(np.flatnonzero(buckets[lo] == key[lo, 0])[0])
        others = lo + np.flatnonzero(~probe[lo:hi])
        for i in (lo + np.flatnonzero(probe[lo:hi])).tolist():
            mine = top(root[i])
            to = others[[top(root[k]) != mine and not (out[k] and cls[k] < cls[i]) for k in others.tolist()]]
            for at in range(0, len(to), 512):
                part = to[at : at + 512]
                part = part[likely(sketch[i], sketch[part], n[i], n[part], threshold_pct / 100)]
                part = part[~(buckets[part, :band] == buckets[i, :band]).any(axis=1)]
                for k in part.tolist():
                    a, b = top(root[i]), top(root[k])
                    if a != b and linked(sets[i], sets[k], threshold_pct):
                        parent[a] = b
                        forest.append((cls[i], cls[k]))
    return forest


def _searched(held: DataFrame, groups: DataFrame, sets: DataFrame, texts, threshold_pct: int) -> DataFrame:
    """a, b: links that connect different groups within a bucket.

    Of a bucket with several groups, the members outside the largest one
    (probes) meet all members, in blocks bounded by BLOCK and BLOCK_SHINGLES.
    ``texts`` gives cls, _text of the classes of a table.
    """
    ship(held.sparkSession)
    placed = held.filter("cls != rep").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = stash(placed.join(sets.select("cls", F.col("n").alias("size")), "cls").select("key", "cls", "root", "size"), "placed")
    per_group = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = per_group.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("main")).filter("groups > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("key", "n", F.col("main.root").alias("main"), blocks(F.col("n"), F.col("size")).alias("rows"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("cols"))
    mixed = stash(mixed, "mixed")
    members = spread_join(placed.select("key", "cls", "root"), mixed.drop("n"), "key", hot_keys(mixed.select("key", "n"), "key"))
    members = stash(members.withColumn("out", F.col("root") != F.col("main")).drop("main"), "members")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    rows = members.select("key", "cls", "root", "out", F.lit(False).alias("probe"), dealt("rows").alias("row"), upto("cols").alias("col"))
    cols = members.filter("out").select("key", "cls", "root", "out", F.lit(True).alias("probe"), upto("rows").alias("row"), dealt("cols").alias("col"))
    met = rows.unionByName(cols).join(texts(members), "cls")
    met = met.repartition("key", "row", "col").sortWithinPartitions("key", "row", "col").select("key", "row", "col", "cls", "root", "out", "probe", "_text")

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def done(t: pa.Table):
            if t.num_rows:
                key = np.stack([t.column(c).to_numpy() for c in ("key", "row", "col")], axis=1)
                flags = [t.column(c).to_numpy() for c in ("out", "probe")]
                found = compared(key, t.column("cls").to_pylist(), t.column("root").to_pylist(), *flags, t.column("_text").combine_chunks(), threshold_pct)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            waiting.append(batch)
            ends = [batch.column(c).to_numpy() for c in range(3)]
            last = np.flatnonzero(np.any([k != k[-1] for k in ends], axis=0))
            if not len(last) and len(waiting) > 1 and all(waiting[0].column(c)[0] == batch.column(c)[0] for c in range(3)):
                continue  # one block goes on
            t = pa.Table.from_batches(waiting)
            whole = t.num_rows - batch.num_rows + (int(last[-1]) + 1 if len(last) else 0)  # the last block may go on in the next batch
            yield from done(t.slice(0, whole))
            waiting = t.slice(whole).combine_chunks().to_batches()
        if waiting:
            yield from done(pa.Table.from_batches(waiting))

    out = stash(met.mapInArrow(run, "a binary, b binary"), "found")
    discard(placed, mixed, members)
    return out


def near_duplicates(docs: DataFrame, *, threshold_pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, groups): _id, _hash, n_shingles, cls per document; cls, copies, root (of its group), component_id and first per class of equal sets.

    ``first`` is the document (none, _id, _hash) of a group that comes first by id, a null id last.
    """
    t = threshold_pct / 100
    spent: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        spent.append(stash(df, label))
        return spent[-1]

    sk = keep(sketched(docs, id_col=id_col, text_col=text_col), "sketches")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")).alias("first")
    classes = keep(sk.filter("cls is not null").groupBy("cls").agg(first, F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")), "classes")

    filed = _filed(classes, t)
    full = keep(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    size = full.count()
    small = maybe_broadcast(full, size, 32)
    hot = hot_keys(full, "key")
    filed = keep(filed.join(small, "key") if small is not full else spread_join(filed, full, "key", hot), "filed")
    ranks = keep(filed.groupBy("cls").agg(F.sum("n").alias("rank")), "ranks")
    n_ranks = ranks.count()
    reps = filed.join(maybe_broadcast(ranks, n_ranks, 40), "cls").groupBy("key").agg(F.max(F.struct("rank", "cls")).alias("rep"))
    held = keep(spread_join(filed.select("key", "cls"), reps.select("key", F.col("rep.cls").alias("rep")), "key", hot), "held")
    at = F.col("first._id").alias("_at_id"), F.col("first._hash").alias("_at_hash")
    sets = keep(classes.select("cls", "n", "sketch", *at).join(maybe_broadcast(ranks, n_ranks, 40), "cls", "left_semi"), "sets")
    texts = lambda of: _texts_of(docs, sets, of.select("cls").distinct(), id_col, text_col)

    pairs = keep(held.filter("cls != rep").select(F.col("cls").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    much = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b")
    pairs = keep(_likely_pairs(pairs, sets, much, t), "likely")
    own = keep(texts(pairs.select(F.explode(F.array("a", "b")).alias("cls"))), "texts")
    links = keep(_confirmed(pairs, own, much, threshold_pct), "told")
    groups = components(links, "links")
    spent.append(groups)
    found = _searched(held, groups, sets, texts, threshold_pct)
    spent.append(found)
    if not found.isEmpty():
        groups = components(links.union(found), "links")
        spent.append(groups)

    joined = classes.select("cls", "copies", "first").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    joined = keep(joined, "joined")
    least = joined.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    least = keep(least.select("root", "first", F.col("first._id").alias("component_id"), "n"), "least")
    out = stash(spread_join(joined.drop("first"), least.drop("n"), "root", hot_keys(least.select("root", "n"), "root")).select("cls", "copies", "root", "component_id", "first"), "members")
    rows = stash(sk.drop("sketch"), "rows")
    discard(*spent)
    return rows, out


def _texts_of(docs: DataFrame, sets: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, _text: one text for each of the named classes."""
    n = named.count()
    at = sets.select("cls", "_at_id", "_at_hash").join(maybe_broadcast(named, n, 24), "cls", "left_semi")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text_or_empty(F.col(f"`{text_col}`"))).alias("_hash"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    texts = texts.join(maybe_broadcast(at, n, 80), F.col("_id").eqNullSafe(F.col("_at_id")) & (F.col("_hash") == F.col("_at_hash"))).select("cls", "_text")
    return texts.groupBy("cls").agg(F.min("_text").alias("_text"))  # repeated rows are one


def deduplicated(docs: DataFrame, *, threshold_pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id (a null one only if the group has no other), and all without words.

    Of repeated rows one stays. Documents keep their columns.
    """
    rows, groups = near_duplicates(docs, threshold_pct=threshold_pct, id_col=id_col, text_col=text_col)
    own, at, at_hash = fresh(docs, "_hash", "_stay_id", "_stay_hash")
    stay = groups.filter("cls = root").select("first._id", "first._hash").union(rows.filter("cls is null").select("_id", "_hash").distinct())
    stay = stash(stay.select(F.col("_id").alias(at), F.col("_hash").alias(at_hash)), "stay")
    here = docs.withColumn(own, F.xxhash64(text_or_empty(F.col(f"`{text_col}`"))))
    out = here.join(maybe_broadcast(stay, stay.count(), 40), F.col(f"`{id_col}`").eqNullSafe(F.col(at)) & (F.col(own) == F.col(at_hash)), "left_semi")
    if not rows.groupBy("_id", "_hash").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, own])
    discard(rows, groups)
    return out.drop(own)


def verdicts(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """_id, _hash, n_shingles, component_id and kept per document."""
    some = spread_join(rows.filter("cls is not null"), groups.select("cls", "component_id"), "cls", hot_keys(groups.select("cls", F.col("copies").alias("n")), "cls"))
    none = rows.filter("cls is null").withColumn("component_id", F.col("_id"))
    out = some.select(*none.columns).union(none)
    return out.select("_id", "_hash", "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM docs, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
