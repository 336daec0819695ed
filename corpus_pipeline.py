"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Every stage takes all that its predecessor kept and returns the columns of
``documents``; the last returns the digest of the token files it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, minhash, mixing, quality, tokens
from tidemark.llm.common import discard, stash, table

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a certified cutoff rejects."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similarity 0.8 or more on five-word shingles."""
    return minhash.deduplicated(docs, threshold_pct=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no span of a benchmark item: one item is enough to go."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), least_items=1)
    return judged.filter(~F.col(f"`{judged.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs)
    return mixing.emit(mixed, docs.columns, mixed.columns[-2])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the token files."""
    import public_tokenizers  # only this stage needs the vocabulary files

    return tokens.token_round_trip(docs, public_tokenizers.path(TOKENIZER), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token output", token_output),
]

#: quality cutoffs and token ids can't be had in SQL; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = []
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*kept)
        kept = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(*kept)
    return out
