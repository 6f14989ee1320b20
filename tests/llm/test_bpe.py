import hashlib
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleaner.llm import bpe as B

TEXT = B.default_vocabulary()
V = B.Vocabulary(TEXT)
LIB = Tokenizer.from_str(TEXT)
PIECES = V.pieces


def check(text):
    want = LIB.encode(text, add_special_tokens=False).ids
    raw = b"".join(V.encode_words(V.split(text)))
    assert np.frombuffer(raw, "<u4").tolist() == want
    assert B.decode_bytes(np.array(want, np.int64), PIECES).decode() == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=600, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    check(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "'s", "'ll", " ", "  ", "\n", "1", "²", "é", "ß", "!", " ", "\u0085", "\x1c", "<|endoftext|>", "中", " ", "🙂", "'", "꟎", "—"]), max_size=14))
def test_tricky_parts(parts):
    check("".join(parts))


def test_every_agreed_code_point():
    rule, _ = B.split_patterns()
    for lo, hi in B.AGREED:
        for c in map(chr, range(lo, hi + 1)):
            for text in (f"a{c}a", f"1{c}1", f"!{c}!", f"a {c} {c}b", f"{c}"):
                assert rule.findall(text) == [text[a:b] for _, (a, b) in LIB.pre_tokenizer.pre_tokenize_str(text)], (hex(ord(c)), unicodedata.category(c))


@pytest.mark.parametrize("table_words", [0, 3, 1000])
def test_rows(spark, table_words):
    docs = [(i, f"the word é {i % 7} and more\nwords <|endoftext|> x") for i in range(50)] + [(90, None), (91, ""), (0, "again"), (None, "a" * 200_000)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, ids string").repartition(4)
    rows = B.encode_texts(df, keep=["doc_id", "text"], table_words=table_words).collect()
    assert len(rows) == 54
    for r in rows:
        want = LIB.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert B.encode_texts(df.limit(0), keep=["doc_id"]).count() == 0


def test_decode_join(spark):
    df = spark.createDataFrame([(1, LIB.encode("häuser 12!").ids), (2, []), (3, None)], "n long, ids array<int>")
    assert [r.text for r in B.decode_ids(df).orderBy("n").collect()] == ["häuser 12!", "", None]


def test_query_keeps_its_contract(spark):
    rows = B.op3_bpe(spark, "/root/testdata/sf0.001")
    assert rows.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIB.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
