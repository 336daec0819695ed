"""Token-id files: Parquet with a list column of ids, in ascending id order.

Layout of a file set:

``doc_id``    the document's id, ascending over the files by name
``row``       64-bit position: file number in the high bits, row in the file below
``offset``    token ids before the document within its file
``n_tokens``  ids of the document, the end id included
``ids``       the ids, 32 bit, dictionary-encoded with bit-packed indexes

Row groups and pages are kept small and carry column and page indexes, so a
reader that wants a few columns, or a range of ids, touches only those pages.

Nulls and empty texts encode to the end id alone; rows with equal ids stay
side by side in the order of their texts' hashes; a null id sorts first; an
empty table gives an empty file set.  Extra input columns are ignored unless
named in ``keep``.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import maybe_broadcast, scratch_path, ship

#: 1 << 33 rows fit a file, as in monotonically_increasing_id
_FILE_BITS = 33

_LETTERS = "a-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: texts of these characters are normalised and split by the plain rule below; of others, each odd chunk goes through the library whole
_PLAIN = re.compile("[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*+\\Z")
_PIECE = re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{_LETTERS}0-9\t-\r\x20]+")


def _byte_letters() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """piece -> its ids as bytes, found on first use."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        got = self[piece] = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        return got


class WordEncoder:
    """Encodes texts with a white-space-free vocabulary, remembering the ids of pieces seen before.

    The vocabulary merges only within the pieces that its splitting rule finds,
    and no piece holds white space, so the ids of a text are those of its
    pieces one after the other.  ``room`` bounds the pieces remembered; beyond
    it the memory starts afresh, which changes no result.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.room = room
        self.pieces = _Pieces(self.whole.model)
        self.odd: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> bytes:
        if len(self.pieces) > self.room:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _PLAIN.match(text) and "<|" not in text:
            return self._plain(text)
        got = self.odd.get(chunk)
        if got is None:
            if len(self.odd) > self.room // 8:
                self.odd.clear()
            got = self.odd[chunk] = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """32-bit ids of a text, in the machine's byte order."""
        if _PLAIN.match(text) and "<|" not in text:
            return self._plain(text)
        return b"".join(map(self._chunk, text.encode().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    keep: tuple[str, ...] = (),
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    dictionary: bool = True,
) -> None:
    """Encodes every whole text and writes the file set.

    One range shuffle brings the documents into order; ties of the id are split
    by the text's hash, so a much repeated id does not fill one partition unless
    its texts are equal as well.  ``dictionary=False`` delta-encodes the ids.
    ``keep`` names more input columns to store beside the ids.
    """
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c not in (id_col, text_col))
    ordered = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
        .repartitionByRange(F.col("_id"), F.xxhash64("_text"))
        .sortWithinPartitions(F.col("_id"), F.xxhash64("_text"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    fields += [T.StructField("row", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(c, docs.schema[c].dataType) for c in keep]
    end = array("I", [end_id]).tobytes()

    def encode(batches):
        enc, offset = encoder(tokenizer), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [enc.encode(t or "") + end for t in part.column("_text").to_pylist()]
                n = np.array([len(b) // 4 for b in ids], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                flat = pa.array(np.frombuffer(b"".join(ids), np.uint32).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)
                cols = [part.column("_id"), part.column("_row"), pa.array(at[:-1] + offset), pa.array(n), lists, *[part.column(f"_keep_{k}") for k in range(len(keep))]]
                offset += int(at[-1])
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    (
        ordered.mapInArrow(encode, T.StructType(fields))
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#ids.list.element", str(dictionary).lower())
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, ids: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a file set: only ``columns``, and only documents with lo <= doc_id <= hi if ``ids`` is given."""
    df = spark.read.parquet(path)
    if ids is not None:
        df = df.filter(F.col("doc_id").between(*ids))
    return df.select(*columns) if columns else df


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row, start (ids of all documents before it) and n_tokens, from the metadata columns alone.

    The totals of the files, one row a file, are prefix-summed; the offsets
    within a file were written with it.
    """
    meta = read_tokens(spark, path, ["doc_id", "row", "offset", "n_tokens"])
    return _with_start(meta, meta).select("doc_id", "row", "start", "n_tokens")


def _with_start(df: DataFrame, meta: DataFrame) -> DataFrame:
    file = F.shiftright("row", _FILE_BITS)
    totals = meta.groupBy(file.alias("_file")).agg(F.sum("n_tokens").alias("_all"))
    before = totals.select("_file", (F.sum("_all").over(Window.orderBy("_file")) - F.col("_all")).alias("_before"))
    files = len(meta.inputFiles())
    return df.withColumn("_file", file).join(maybe_broadcast(before, files, 16), "_file").withColumn("start", F.col("_before") + F.col("offset")).drop("_file", "_before")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files read back."""
    ship(spark)
    rows = read_tokens(spark, path, ["doc_id", "row", "offset", "ids"])
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("row", "offset", "n_tokens", "ids_crc32")]])

    def digest(batches):
        for b in batches:
            lists = b.column("ids")
            at = np.asarray(lists.offsets)
            raw = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(raw[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=schema.names)

    meta = read_tokens(spark, path, ["row", "n_tokens"])
    return _with_start(rows.mapInArrow(digest, schema), meta).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` as a file set in the shared folder and digests it from there."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return token_digest(spark, path)
