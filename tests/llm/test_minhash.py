"""Near-duplicates: registers, buckets and links against brute force."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import minhash


def _pair(rng, n, j):
    """Two random sets of about n values with a similarity of j or just more, sorted, and their sketches."""
    union = np.unique(rng.integers(0, 2**64, n, np.uint64))
    shared = int(np.ceil(j * len(union)))
    own = np.arange(shared, len(union))
    cut = rng.integers(0, len(own) + 1)
    sets = [np.sort(np.concatenate([union[:shared], union[own[:cut]]])), np.sort(np.concatenate([union[:shared], union[own[cut:]]]))]
    return sets, minhash.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))


@pytest.mark.parametrize("j", [0.8, 0.85])
@pytest.mark.parametrize("n", [5, 7, 12, 30, 100, 400, 3000])
def test_linked_sets_share_a_bucket_and_pass_the_estimate(n, j):
    rng = np.random.default_rng(n)
    trials = 300
    for _ in range(trials):
        sets, sketch = _pair(rng, n, j)
        size = np.array(list(map(len, sets)))
        keys = minhash.bucket_keys(sketch)
        assert (keys[0] == keys[1]).any()
        assert minhash.likely(sketch[0], sketch[1:], size[0], size[1:], j)[0]


def test_chance_agreement_follows_both_sizes():
    rng = np.random.default_rng(5)
    for n, m in [(60, 60), (3000, 3000), (3000, 300)]:
        equal = used = 0
        for _ in range(1500):
            sets = [np.sort(rng.integers(0, 2**64, k, np.uint64)) for k in (n, m)]
            a, b = minhash.registers(np.concatenate(sets), np.array([0, n, n + m]))
            equal += int(((a == b) & (a > 0)).sum())
            used += int(((a > 0) | (b > 0)).sum())
        expected = used * float(minhash.chance(np.array([n]), np.array([m]))[0])
        assert abs(equal - expected) < 4 * expected**0.5 + 1, (n, m)


def test_the_estimate_is_close():
    rng = np.random.default_rng(6)
    off = []
    for _ in range(200):
        sets, sketch = _pair(rng, 2000, 0.7)
        off.append(minhash.estimate(sketch[0], sketch[1:], len(sets[0]), np.array([len(sets[1])]))[0][0] - 0.7)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def _family(rng, words, copies, edits):
    base = [f"w{rng.randrange(9000)}" for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"e{rng.randrange(9000)}"
        yield " ".join(text)


@pytest.mark.parametrize("pct", [80, 85])
def test_groups_against_brute_force(spark, monkeypatch, pct):
    """Large families of near copies, around the threshold, with tiny blocks and parts."""
    from tidemark.llm import common

    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(common, "SPREAD", 5)
    rng = random.Random(pct)
    texts = [t for words, copies, edits in [(60, 60, 7), (12, 40, 2), (150, 40, 9), (5, 3, 2), (3, 4, 1)] for t in _family(rng, words, copies, edits)]
    texts += [texts[0]] * 30 + [" ".join(f"u{i}w{k}" for k in range(40)) for i in range(30)] + ["", None, None]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, groups = minhash.near_duplicates(docs, threshold_pct=pct)
    got = {r["_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.verdicts(rows, groups).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    kept = minhash.deduplicated(docs, threshold_pct=pct)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_clashing_names_and_repeats(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, text, "x", 1, "p"), (1, text, "x", 1, "p"), (2, text + " b", "y", 2, "q"), (None, text, "z", 3, "r"), (None, None, None, None, None), (5, "lone words here", "t", 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc_hash string, _stay_id int, _hash string")
    got = sorted(tuple(r) for r in minhash.deduplicated(docs).filter("doc_id is not null").collect())
    assert got == [rows[0], rows[5]]
    left = minhash.deduplicated(docs).filter("doc_id is null").collect()
    assert [tuple(r) for r in left] == [rows[4]]
