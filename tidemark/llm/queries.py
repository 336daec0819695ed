"""The thin queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lm, minhash, mixing, pages, quality, secrets, suffix, tokens, toxicity
from tidemark.llm.common import stash, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = [(i, r.kind) for i, r in enumerate(secrets.RULES) if r.base]
    return found.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in base], F.sha2(secrets.spans_text(F.col("found"), True).cast("binary"), 256).alias("base_sha256"), secrets.spans_text(F.col("found")).alias("spans"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, names = quality.with_counts(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])
    counted = stash(counted, "quality")
    cut = stash(quality.cutoffs(counted, names, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.with_verdict(counted, names, cut).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, rest = lm.fit(docs.filter(~held_out))
    scored = lm.score(docs, model, rest, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, groups = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold_pct=85)
    return minhash.verdicts(rows, groups).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_mixing, op2_secret_scan, op3_token_output, op4_quality_rules, op5_lm_scoring, op6_suffix_dedup, op7_minhash_dedup, op8_toxicity, op9_html_extraction, op10_decontamination)}

SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op2_secret_scan": secrets.SQL, "op6_suffix_dedup": suffix.SQL, "op7_minhash_dedup": minhash.SQL, "op10_decontamination": decontam.SQL}
