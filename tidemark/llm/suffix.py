"""Repeated passages by sparse suffix arrays.

A passage is a run of at least ``LENGTH`` words (A-Z lower-cased) that stands in
two or more places, of one text or of several.

Only suffixes at content-selected positions are kept: in every window of 35
consecutive 16-word grams the leftmost of least hash (a minimiser), one word in
18.  Each stretch of 50 words has one minimiser, at the same place in all its
copies, so copies always meet at a kept suffix.

1. Kept suffixes whose head (their first 16 words) stands nowhere else can't be
   in a repeated passage.  Heads are counted, which combines on the map side;
   the others of the suffixes stay.
2. These are sorted by head, then by the words that follow, then by those that
   stand before.  Each is compared with its neighbours: the words they share to
   the right and to the left of the head give the stretches of 50 words that
   both have.
3. A suffix among three or more of one head may share a stretch with one that is
   not its neighbour, if the neighbour shares more to the right and less to the
   left.  Stretches that its right side allows and no neighbour confirmed are
   looked up among all stretches of that head.
4. A head with more suffixes than ``SPREAD`` is dealt over several parts, each
   sorted and compared like that.  What stays open is looked up among the
   distinct stretches of all parts, one row for each and part, however often it
   stands there.
5. Repeated stretches of a text are joined into spans.

Null and short texts have no passage and no row; repeated rows are copies of one
another, and each gets its row; null ids are kept; extra columns pass through as
asked for, whatever their names; an empty table gives no rows.  Words are
compared by 32-bit hashes, heads by 64-bit ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textvec
from tidemark.llm.common import BROADCAST_BYTES, SPREAD, discard, fresh, maybe_broadcast, ship, stash, text_or_empty

LENGTH, HEAD = 50, 16
#: words of a stretch beyond the head
REST = LENGTH - HEAD
#: rows of one head that a task holds at once
RUN = 4 * SPREAD
_PLACE = np.uint64(24)  # low bits that hold a place when minima are searched
_COLUMNS = np.arange(REST)


def sampled(col: pa.Array) -> tuple[textvec.Batch, np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts of all stretches, the minimiser of each, head hashes by word) of a string column."""
    b = textvec.Batch(col, lower=True)
    head, _ = textvec.windows(b.hash, b.first, HEAD)
    wide = REST + 1
    _, whole = textvec.windows(b.hash, b.first, LENGTH)
    starts = np.flatnonzero(whole)
    if not len(starts):
        return b, starts, starts, head
    place = np.arange(len(head), dtype=np.uint64) & ((np.uint64(1) << _PLACE) - np.uint64(1))
    m, span = (textvec.mix(head) >> _PLACE << _PLACE) | place, 1
    while 2 * span <= wide:  # minima of windows of 1, 2, 4, ... grams
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
    low = (m[starts] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    size = 1 << int(_PLACE)
    return b, starts, starts + (low - starts) % size, head


def _ranges(first: np.ndarray, count: np.ndarray, step: int = 1) -> np.ndarray:
    """first[i], first[i] + step, ... of count[i] numbers, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first, count) + step * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count))


def _binaries(words: np.ndarray, count: np.ndarray) -> pa.Array:
    """Binary values of count[i] 32-bit words each."""
    at = np.concatenate([[0], np.cumsum(count)]) * 4
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(words.astype(">u4").tobytes())])


def kept_suffixes(col: pa.Array) -> tuple[textvec.Batch, np.ndarray, pa.Table]:
    """(words, row of each kept suffix, the suffixes: head, at, n_words, and the words after and before the head).

    ``after`` and ``before`` (nearest first) go as far as the stretches that
    have the suffix as minimiser: those that begin a words before it have its a
    nearest words before, the head, and the nearest REST - a words after.
    """
    b, starts, at, head = sampled(col)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    run = np.flatnonzero(new)
    last = np.append(run[1:], len(starts))[: len(run)] - 1
    place = at[run] if len(run) else run
    most, least = place - starts[run], place - starts[last]  # of a
    small = (b.hash >> np.uint64(32)).astype(np.uint32)
    row = b.row[place]
    after = _binaries(small[_ranges(place + HEAD, REST - least)], REST - least)
    before = _binaries(small[_ranges(place - 1, most, -1)], most)
    cols = [pa.array(head[place].astype(np.int64)), pa.array((place - b.first[row]).astype(np.int32)), pa.array(b.n[row].astype(np.int32)), after, before]
    return b, row, pa.table(cols, names=["head", "at", "n_words", "after", "before"])


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of binary values side by side, their number)."""
    buffers = col.buffers()
    at = np.frombuffer(buffers[1], np.int32)[col.offset : col.offset + len(col) + 1] // 4
    n = np.diff(at)
    out = np.zeros((len(col), REST), np.uint32)
    out[_COLUMNS < n[:, None]] = np.frombuffer(buffers[2], ">u4")[at[0] : at[-1]] if at[-1] > at[0] else 0
    return out, n


def _bits(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Numbers with the bits lo..hi set, 0 where lo > hi."""
    one = np.int64(1)
    return np.where(hi >= lo, ((one << (hi - lo + 1).clip(0, 62)) - one) << lo.clip(0, 62), 0)


def _common(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leading words that each row shares with the next."""
    differ = np.ones((len(words) - 1, REST + 1), bool)
    differ[:, :REST] = words[1:] != words[:-1]
    return np.minimum(differ.argmax(axis=1), np.minimum(n[1:], n[:-1]))


def compared(head: np.ndarray, after: pa.Array, before: pa.Array, hot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes compared with their neighbours: (found, open, stretch hashes, their first by row).

    Bit a of ``found`` says that the stretch from a words before the suffix on
    stands elsewhere among these; of ``open``, that it may stand with others
    (only if ``hot``; else all suffixes of a head are here).  Hashes are worked
    out where needed, for a from the largest down.
    """
    m = len(head)
    right, n_right = _matrix(after)
    left, n_left = _matrix(before)
    least, most = REST - n_right, n_left
    same = head[1:] == head[:-1]
    r, l_ = np.where(same, _common(right, n_right), -1), np.where(same, _common(left, n_left), -1)
    both = np.where(same, _bits(REST - r, l_), 0)
    found = np.append(both, 0) | np.append(0, both)
    own = _bits(least, most)
    reach = np.maximum(np.append(r, -1), np.append(-1, r))
    new = np.append(True, ~same) if m else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run] if m else run
    left_open = own & ~found if hot else np.where(size > 2, own & ~found & _bits(REST - reach, most), 0)
    wanted = np.zeros(m, bool)
    if hot:
        wanted[:] = True
    elif left_open.any():
        wanted = np.bincount(run, weights=left_open != 0)[run] > 0
    rows = np.flatnonzero(wanted)
    width = n_left[rows] + 1 + n_right[rows]
    seq_first = np.concatenate([[0], np.cumsum(width)])
    seq = np.zeros(seq_first[-1], np.uint64)
    seq[_ranges(seq_first[:-1] + n_left[rows] - 1, n_left[rows], -1)] = left[rows][_COLUMNS < n_left[rows][:, None]]
    seq[seq_first[:-1] + n_left[rows]] = head[rows].astype(np.int64).view(np.uint64)
    seq[_ranges(seq_first[:-1] + n_left[rows] + 1, n_right[rows])] = right[rows][_COLUMNS < n_right[rows][:, None]]
    stretch, _ = textvec.windows(textvec.mix(seq), seq_first, REST + 1)
    count = np.zeros(m, np.int64)
    count[rows] = most[rows] - least[rows] + 1
    first = np.concatenate([[0], np.cumsum(count)])
    hashes = stretch[_ranges(seq_first[:-1], count[rows])]
    if len(hashes):
        owner = np.repeat(np.arange(m), count)
        a = _ranges(most, count, -1)
        key = textvec.mix(hashes + textvec.mix(run[owner].astype(np.uint64)))
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        np.bitwise_or.at(found, owner[again], np.int64(1) << a[again])
    return found, (own & ~found if hot else np.zeros(m, np.int64)), hashes, first


_FOUND = "_ref long, n_words int, at int, mask long, hashes array<long>"


def _neighbours(rows: DataFrame) -> DataFrame:
    """What ``compared`` finds, from partitions sorted by part, head, after, before.

    Rows with ``hashes`` and a ``_ref`` are open stretches (by the bits of mask,
    from the highest); those without are the distinct stretches of a hot part.
    """

    def told(t: pa.Table, hot: bool):
        found, left_open, hashes, first = compared(t.column("head").to_numpy(), t.column("after").combine_chunks(), t.column("before").combine_chunks(), hot)
        keep = pa.array(np.flatnonzero(found))
        some = t.select(["_ref", "n_words", "at"]).take(keep)
        yield pa.RecordBatch.from_arrays([*[some.column(c).combine_chunks() for c in some.column_names], pa.array(found[found != 0]), pa.nulls(len(keep), pa.list_(pa.int64()))], names=names)
        if hot:
            distinct = np.unique(hashes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([distinct], pa.list_(pa.int64()))], names=names)
            keep = np.flatnonzero(left_open)
            if len(keep):
                lists = []
                for i in keep.tolist():
                    own = hashes[first[i] : first[i + 1]].astype(np.int64)
                    top = int(t.column("before")[i].as_buffer().size // 4)
                    lists.append([int(own[top - a]) for a in range(top, top - len(own), -1) if left_open[i] >> a & 1])
                some = t.select(["_ref", "n_words", "at"]).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*[some.column(c).combine_chunks() for c in some.column_names], pa.array(left_open[keep]), pa.array(lists, pa.list_(pa.int64()))], names=names)

    names = ["_ref", "n_words", "at", "mask", "hashes"]

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        rows_waiting = 0

        def flush(t: pa.Table):
            """Cold rows together, hot ones part by part."""
            hot = t.column("hot").to_numpy()
            part = t.column("part").to_numpy()
            head = t.column("head").to_numpy()
            cuts = np.flatnonzero((hot[1:] != hot[:-1]) | (hot[1:] & ((part[1:] != part[:-1]) | (head[1:] != head[:-1])))) + 1 if t.num_rows else []
            for i, j in zip([0, *cuts], [*cuts, t.num_rows]):
                if j > i:
                    yield from told(t.slice(i, j - i), bool(hot[i]))

        for batch in batches:
            waiting.append(batch)
            rows_waiting += batch.num_rows
            if rows_waiting < RUN:
                continue
            t = pa.Table.from_batches(waiting)
            head, part = t.column("head").to_numpy(), t.column("part").to_numpy()
            other = np.flatnonzero((head != head[-1]) | (part != part[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last head may go on
            yield from flush(t.slice(0, whole))
            waiting = t.slice(whole).combine_chunks().to_batches()
            rows_waiting = t.num_rows - whole
        if waiting:
            yield from flush(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, _FOUND)


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document with a repeated passage: ``keep`` (the id unless given), n_words, n_repeated, n_spans and spans.

    ``spans`` is start:end of every maximal run covered by repeated passages,
    in words from 0, end exclusive, comma-joined; n_repeated counts its words.
    """
    ship(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    text = text_or_empty(F.col(f"`{text_col}`"))
    ref = F.xxhash64(F.col(f"`{id_col}`"), text)
    texts = docs.select(ref.alias("_ref"), text.alias("_text"))

    def heads(batches):
        for batch in batches:
            for i, j in textvec.slices(batch.column(0)):
                b, _, at, head = sampled(batch.column(0).slice(i, j - i))
                found, times = np.unique(head[np.unique(at)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times)], names=["head", "n"])

    counted = texts.select("_text").mapInArrow(heads, "head long, n long").groupBy("head").agg(F.sum("n").alias("n"))
    company = stash(counted.filter("n > 1"), "heads")
    n_company, n_hot = company.count(), company.filter(F.col("n") > SPREAD).count()

    def suffixes(batches):
        for batch in batches:
            for i, j in textvec.slices(batch.column(1)):
                _, row, t = kept_suffixes(batch.column(1).slice(i, j - i))
                refs = batch.column(0).slice(i, j - i).take(pa.array(row))
                for b in t.append_column("_ref", refs).to_batches(max_chunksize=1 << 14):
                    yield b

    rows = texts.mapInArrow(suffixes, "head long, at int, n_words int, after binary, before binary, _ref long")
    if n_company * 24 <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(company), "head")
    else:  # too many to go to all tasks: single suffixes take part in the sort as well
        hot = company.filter(F.col("n") > SPREAD)
        rows = rows.join(maybe_broadcast(hot, n_hot, 24), "head", "left")
    hot = F.coalesce(F.col("n") > SPREAD, F.lit(False))
    part = F.when(hot, F.pmod(F.xxhash64("_ref", "at"), F.ceil(F.col("n") / SPREAD))).otherwise(0).cast("int")
    rows = rows.withColumn("hot", hot).withColumn("part", part).drop("n")
    sorted_rows = rows.repartition("head", "part").sortWithinPartitions("head", "part", "after", "before")
    told = stash(_neighbours(sorted_rows), "neighbours")
    marked = told.filter("hashes is null").select("_ref", "n_words", "at", "mask")
    if n_hot:
        parts = told.filter("_ref is null").select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        bit = F.expr("filter(sequence(0, 62), b -> getbit(mask, b) = 1)")
        still = told.filter("_ref is not null and hashes is not null").select("_ref", "n_words", "at", F.explode(F.arrays_zip(F.reverse(bit).alias("a"), F.col("hashes").alias("h"))).alias("s"))
        still = still.select("_ref", "n_words", "at", "s.a", "s.h").join(stash(parts, "parts"), "h", "left_semi")
        marked = marked.union(still.select("_ref", "n_words", "at", F.expr("shiftleft(1L, a)").alias("mask")))
    starts = marked.groupBy("_ref").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(F.struct("at", "mask")).alias("found"))
    out = T.StructType([T.StructField("_found", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_repeated", "n_spans")], T.StructField("spans", T.StringType())])

    def joined(batches):
        for batch in batches:
            cols = [[], [], []]
            for found in batch.column(2):
                s = found.values
                at, mask = s.field("at").to_numpy(), s.field("mask").to_numpy()
                a = np.arange(REST + 1)
                s = np.unique((at[:, None] - a)[(mask[:, None] >> a & 1) > 0])
                cut = np.flatnonzero(np.diff(s) > LENGTH) + 1
                lo, hi = s[np.append(0, cut)], s[np.append(cut - 1, len(s) - 1)] + LENGTH
                cols[0].append(int((hi - lo).sum()))
                cols[1].append(len(lo))
                cols[2].append(",".join(f"{a}:{b}" for a, b in zip(lo.tolist(), hi.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=out.names)

    spans = stash(starts.mapInArrow(joined, out), "spans")
    discard(told, company)
    own, other = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "_ref", "_found")
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "n_words", "n_repeated", "n_spans", "spans")
    found = spans.select(F.col("_found").alias(other), *[F.col(c).alias(n) for c, n in zip(("n_words", "n_repeated", "n_spans", "spans"), names)])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], ref.alias(own))
    return rows.join(maybe_broadcast(found, spans.count(), 120), F.col(own) == F.col(other)).drop(own, other)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), stretches AS (
  SELECT r, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS s FROM docs, LATERAL (SELECT unnest(generate_series(0, len(w) - 50)) AS i)
), hits AS (SELECT r, i FROM stretches WHERE s IN (SELECT s FROM stretches GROUP BY s HAVING count(*) > 1)),
marked AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS b FROM hits),
runs AS (SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT *, sum(b) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) GROUP BY r, g)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(sum(hi - lo) AS BIGINT) AS n_repeated, count(*) AS n_spans, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS spans
FROM runs JOIN docs USING (r) GROUP BY r, doc_id, w
"""
