import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = tokens.WordEncoder(PATH, room=50)
TRICKY = ["it's we've  I'LL\n1234 éÀß ÿ", "ΑΣ Σ ﬁ ｆ　x", "<|endoftext|> a<|startoftext|>b <|x|>", "á ́b \x1c\x85\xa0z", "İstanbul K ſ µ × ÷", "日本語 text🙂🙂", "don't'd''s 's", "\x00\x7f|||***", ""]


def ids(text):
    return np.frombuffer(ENCODER.encode(text), np.uint32).tolist()


@pytest.mark.parametrize("text", TRICKY)
def test_tricky(text):
    assert ids(text) == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZé'sÄ19 \n\t.<|>&"), st.characters(blacklist_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert ids(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = [(3, "b a", "x"), (None, "z", "y"), (1, None, "x"), (2, "", None), (2, "it's", "x"), (5, "w " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [tuple(r) for r in tokens.token_round_trip(docs, PATH).orderBy("start").collect()]
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        one = WHOLE.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((w[0] or 0, *w[1:]) for w in want)
    for r in got:
        assert r[1] == start
        start += r[2]
    assert [r[0] for r in got] == [None, 1, 2, 2, 3, 5]


def test_empty_and_selective(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_round_trip(docs, PATH).count() == 0
    docs = spark.range(50).selectExpr("id as doc_id", "concat('w', id) as text", "id * 2 as start")
    tokens.write_tokens(docs, str(tmp_path / "t"), PATH, keep=("start",), dictionary=False)
    assert [r[0] for r in tokens.read_tokens(spark, str(tmp_path / "t"), ["doc_id"], ids=(10, 12)).orderBy("doc_id").collect()] == [10, 11, 12]
    assert tokens.read_tokens(spark, str(tmp_path / "t"), ["start"], ids=(10, 10)).first()[0] == 20
    index = tokens.token_index(spark, str(tmp_path / "t")).orderBy("row").collect()
    assert [r["start"] for r in index] == np.cumsum([0] + [r["n_tokens"] for r in index])[:-1].tolist()
