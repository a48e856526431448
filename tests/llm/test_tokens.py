import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochwise.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.MergeTable(PATH))


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "",
    " ",
    "Hello world, it's 12345 o'clock!!   \n\n  next\tline ",
    "a" * 10_001,
    "ab" * 3_000 + "ba" * 2_999,
    "naïve Füße 😀😀😀 ​\xa0 日本語テキスト ٣٤٥",
    "<|endoftext|>a<|endoftext|><|endoftext|> b <|endoftext",
    " ".join(f"word{i}xyz" for i in range(5_000)),
    "\x00\x01\x85  x",
]


def test_matches_library(library, counter):
    assert list(counter.counts(TEXTS)) == expected(library, TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abest '<|endoftx>\n1é😀 ") , max_size=80))
def test_matches_library_on_small_alphabet(library, counter, text):
    assert list(counter.counts([text])) == expected(library, [text])


def test_matches_library_on_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in tokens.token_counts(docs, PATH).collect()}
    rows = docs.collect()
    want = expected(library, [r.text for r in rows])
    assert [got[r.doc_id].n_tokens for r in rows] == want
    assert [got[r.doc_id].n_bytes for r in rows] == [len(r.text.encode()) for r in rows]
    assert [got[r.doc_id].over_limit for r in rows] == [n > 512 for n in want]


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_tokens string, over_limit int"
    assert tokens.token_counts(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(None, "a b", "x", 1), (1, None, None, 2), (1, None, None, 2)]
    got = tokens.token_counts(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [
        (0, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False)
    ]


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        tokens.MergeTable(public_tokenizers.path("word_bpe_49k.json"))
