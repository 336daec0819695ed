"""Repeated passages against a plain Python version, with hot passages and tiny parts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix


def brute(texts):
    words = [(t or "").lower().split() for t in texts]
    times = Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    out = {}
    for d, w in enumerate(words):
        covered = sorted({p for i in range(len(w) - 49) if times[tuple(w[i : i + 50])] > 1 for p in range(i, i + 50)})
        if covered:
            spans, lo = [], covered[0]
            starts = sorted(i for i in range(len(w) - 49) if times[tuple(w[i : i + 50])] > 1)
            lo, hi = starts[0], starts[0] + 50
            for i in starts[1:]:
                if i > hi:
                    spans.append((lo, hi))
                    lo = i
                hi = i + 50
            spans.append((lo, hi))
            out[d] = (len(w), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans))
    return out


def corpus(seed):
    """Texts over few passages, cut, joined and edited, so that most stretches have partners that are not neighbours."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(rng.randrange(60, 140))] for _ in range(6)]
    texts = []
    for _ in range(220):
        out = [word() for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(passages))
            lo = rng.randrange(0, len(p) - 50)
            p = p[lo : rng.randrange(lo + 40, len(p))] if rng.random() < 0.8 else p
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = word()
            out += p + [word() for _ in range(rng.randrange(0, 20))]
        texts.append(" ".join(out))
    loop = [word() for _ in range(7)]
    return [*texts, " ".join(loop * 30), " ".join(loop * 9), None, "", " ".join(word() for _ in range(50)), texts[3], texts[3]]


@pytest.mark.parametrize("spread", [4096, 12, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, spread, seed):
    monkeypatch.setattr(suffix, "SPREAD", spread)
    monkeypatch.setattr(suffix, "RUN", 40 if spread < 100 else suffix.RUN)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"], r["n_spans"], r["spans"]) for r in suffix.repeated(docs).collect()}
    assert got == brute(texts)


def test_single_suffixes_may_take_part(spark, monkeypatch):
    """Without the broadcast of shared heads the result is the same."""
    monkeypatch.setattr(suffix, "BROADCAST_BYTES", 0)
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_repeated"], r["n_spans"], r["spans"]) for r in suffix.repeated(docs).collect()} == brute(texts)


def test_clashing_names(spark):
    text = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "a"), (2, text, "b")], "doc_id long, text string, _ref string").withColumn("spans", F.lit("mine")).withColumn("_found", F.lit(7))
    out = suffix.repeated(docs, keep=["doc_id", "_ref", "spans", "_found"])
    assert out.columns == ["doc_id", "_ref", "spans", "_found", "n_words", "n_repeated", "n_spans", "_spans"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "mine", 7, 60, 60, 1, "0:60"), (2, "b", "mine", 7, 60, 60, 1, "0:60")]
