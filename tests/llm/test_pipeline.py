"""The pipeline against a plain Python version of its stages."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def good(d):
    w = split(d["text"])
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w) >= 10 and 100 * len(hit) <= 20 * len(w)


def one_of_each(docs):
    sets = {}
    for d in docs:
        w = split(low(d["text"]))
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return [d for d in docs if root[d["doc_id"]] == d["doc_id"]]


def clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    where = {}
    for i in items:
        w = words(i["text"])
        for j in range(len(w) - 7):
            where.setdefault(tuple(w[j : j + 8]), set()).add(i["item_id"])
    out = []
    for d in docs:
        w = words(d["text"])
        if not any(tuple(w[j : j + 8]) in where for j in range(len(w) - 7)):
            out.append(d)
    return out


def mixed(docs):
    sizes, out = Counter(), []
    for d in docs:
        d["size"] = len(split(d["text"]))
        sizes[d["source"]] += d["size"]
    names = sorted(sizes)
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in names:
        rate = (3 * sizes[s] if s in full else level * weight[s]) / sizes[s]
        shift = int(hashlib.md5(f"mixs{s}".encode()).hexdigest()[:8], 16) / 2**32
        own = [d for d in docs if d["source"] == s]
        own.sort(key=lambda d: (d["size"].bit_length() * 16 + (d["size"] * 16 >> d["size"].bit_length()), hashlib.md5(f"{d['doc_id']}|{d['text']}".encode()).hexdigest()))
        for i, d in enumerate(own):
            out += [d] * (math.floor(shift + rate * (i + 1)) - math.floor(shift + rate * i))
    return out


def test_run_equals_plain_python(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    # so few labels certify no cutoff: only the base rule rejects
    assert quality.binomial_upper(0, 87, quality.Risk().miss) > quality.Risk().rate / len(quality.RULES)
    kept = mixed(clean(one_of_each([d for d in docs if good(d)]), items))
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d in sorted(kept, key=lambda d: d["doc_id"]):
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids + [1]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_one_planted_passage_is_enough(spark, tmp_path):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    item = max((i["text"] for i in items), key=lambda t: len(t.split()))
    passage = " ".join(item.split()[:12])
    rows = [(1, f"before {passage} after", "en", "a", 1), (2, "nothing of the kind stands in this text", "en", "a", 1), (3, passage.upper(), None, None, None), (4, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.decontamination(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 4]


def test_stages_on_odd_rows(spark):
    """Nulls, repeats, ties and columns with the names that the operators use inside."""
    text = " ".join(f"word{i}" for i in range(40))
    long = " ".join(f"w{i % 4999}" for i in range(60000))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (None, text + " x", "en", None, 1), (None, None, None, None, None), (4, "", "fr", "a", 0), (5, long, "de", "b", 9), (6, long + " end", "de", "b", 9), (6, text[::-1], "es", "b", 9)]
    names = ["_hash", "_id", "_copy", "kept", "copies", "_stratum", "_cut_symbols", "_stay_id", "_text", "n_words", "_keep_0", "_part", "size", "_key"]
    docs = spark.createDataFrame([(*r, *["mine"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    wanted = {
        "quality rules": [1, 1, 6, None],  # the long texts repeat themselves
        "near dedup": [1, 2, 4, 5, 6, None],
        "decontamination": [1, 1, 2, 4, 5, 6, 6, None, None],
    }
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and all(r[n] == "mine" for r in got for n in names), name
        if name in wanted:
            assert order(r["doc_id"] for r in got) == wanted[name], name
    tokens = corpus_pipeline.token_output(spark, docs, SF).collect()
    assert len(tokens) == len(rows) and sum(r["n_tokens"] == 1 for r in tokens) == 3


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "mixing", "token output"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
