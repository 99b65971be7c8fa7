import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm.bpe import DEFAULT_TOKENIZER, BacktrackingEncoder, count_tokens, decode_corpus, encode_corpus


@pytest.fixture(scope="module")
def ours():
    with open(DEFAULT_TOKENIZER, "rb") as f:
        return BacktrackingEncoder(f.read())


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_equal_to_the_library(ours, theirs):
    @settings(max_examples=600, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst thgo'.,-0123 \n\t<|>ąłżß漢😀", max_size=120)))
    def check(text):
        text = text.encode("utf-8", "replace").decode()
        ids = ours.encode(text)
        assert ids == theirs.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == text.encode()

    check()


def test_long_and_repetitive_texts(ours, theirs):
    for text in ("a" * 30_000, "ab" * 20_000, "the" * 9_000, " " * 20_000, "=-" * 9_000, "<|endoftext|>" * 50):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_corpus(spark, theirs):
    texts = [(1, "Group rig-05 holds 4 pages."), (2, ""), (3, None), (4, "łąka " * 3000), (4, "same id"), (None, "no id"), (7, "  \n"), (8, "<|endoftext|>")]
    df = spark.createDataFrame([(*t, "x", "y", 1) for t in texts], "doc_id bigint, text string, TEXT string, ids string, n_tokens int")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()), key=repr)
    want = sorted(((i, theirs.encode(t, add_special_tokens=False).ids if t else []) for i, t in texts), key=repr)
    assert got == want
    back = sorted(((r["doc_id"], r["text"]) for r in decode_corpus(encode_corpus(df)).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in texts), key=repr)
    assert encode_corpus(df.limit(0)).count() == 0
    n = count_tokens(df.select("doc_id", F.lit("s").alias("source"), df.columns[1] if False else F.lit("abc").alias("text")), ["doc_id", "source"])
    assert {r["n_tokens"] for r in n.collect()} == {len(theirs.encode("abc", add_special_tokens=False).ids)}


def test_bytes_that_are_no_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    ids = encode_corpus(df).first()["ids"]
    assert len(ids) > 0
