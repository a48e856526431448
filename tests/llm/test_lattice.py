import hashlib

import public_tokenizers
import pytest
import sentencepiece

from epochwise.llm import lattice
from epochwise.llm.queries import op6_sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


TEXTS = [
    None, "", " ", "  a  b\n\nc\t1234 <s> </s> é 😀", "Hello, world! It's a test.", "thinor, of the  .a.b.c | x|y", "\n", "\n\nab\n",
    "ﬁ ½ Ⅷ 日本語テキスト 벨ゼ梦 ​\xa0\x00\x01", "a" * 40, "▁x ▁▁ y", "foo();\r\n\tbar", "Füße naïve ŁÓDŹ", "1.000.000,50 end ...", "a. b.c ,d",
]


def test_merges_match_library_and_decode_back(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    encoded = lattice.encode(df, PATH)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert [got[i] for i in range(len(TEXTS))] == [library.encode(t or "") for t in TEXTS]
    back = {r.doc_id: r.text for r in lattice.decode(encoded, PATH).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [(t or "").replace("▁", " ") for t in TEXTS]


def test_documents_match_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in lattice.encode(docs, PATH).collect()}
    assert {i: got[i].ids for i in texts} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r.n_tokens == len(r.ids) for r in got.values())


def test_viterbi_is_the_best_path(spark, library):
    pieces = lattice.Pieces(PATH)
    scores = {p: (s, i) for p, i, s in pieces.rows}
    units = ["▁the", "▁thanable", "abcabc", "▁▁x", "é😀z", "q"]

    def best(unit):
        if not unit:
            return 0.0
        options = [scores[unit[:k]][0] + best(unit[k:]) for k in range(1, len(unit) + 1) if unit[:k] in scores]
        return max([*options, lattice._UNKNOWN_SCORE + best(unit[1:])])

    table = spark.createDataFrame([(u,) for u in units], "unit string")
    of_id = {i: s for _, i, s in pieces.rows}
    for row in lattice.unit_ids(table, pieces, "viterbi").collect():
        unknown = sum(c not in scores for c in row.unit)
        assert sum(of_id.get(i, 0) for i in row.ids) + unknown * lattice._UNKNOWN_SCORE == best(row.unit)
        assert library.decode(row.ids).strip() == row.unit.replace("▁", " ").strip()


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, ids string, unit int"
    assert lattice.encode(spark.createDataFrame([], schema), PATH).count() == 0
    rows = [(None, "a b", "x", 1), (1, "a b", "x", 1), (1, "a b", "x", 1), (1, None, None, 1)]
    got = lattice.encode(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (1, 2), (1, 2)]


def test_decode_goes_row_by_row_and_knows_every_id(spark, library):
    control = [i for i in range(library.vocab_size()) if library.is_control(i)]
    byte = next(i for i in range(library.vocab_size()) if library.is_byte(i))
    first, second = library.encode("one two"), library.encode("other text, longer")
    rows = [first, second, first, [], [*control, *first], [library.unk_id(), *first], [*first, library.unk_id(), *control]]
    rows += [second[1:], [byte + 32, *second]]
    df = spark.createDataFrame([(7, r) for r in rows] + [(None, first), (7, None)], "doc_id long, ids array<int>")
    got = sorted(((r.doc_id, r.text) for r in lattice.decode(df, PATH).collect()), key=repr)
    assert got == sorted([(7, library.decode(r)) for r in rows] + [(None, "one two"), (7, "")], key=repr)
    for odd in (library.vocab_size(), -1, None):
        with pytest.raises(Exception, match="no such piece"):
            lattice.decode(spark.createDataFrame([(1, [odd, *first])], "doc_id long, ids array<int>"), PATH).collect()


def test_query_decodes_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: hashlib.sha256((r.text or "").replace("▁", " ").encode()).hexdigest() for r in docs.collect()}
    got = op6_sentence_pieces(spark, "/root/testdata/sf0.001")
    assert {r.doc_id: r.decoded_sha256 for r in got.collect()} == want


def test_very_long_units_match_library(spark, library):
    mixed = "".join("etaoinshr,.é1日"[k * k * 7 % 14] for k in range(20_000))
    texts = ["a" * 20_000, mixed, "thethe" * 30, "ab " * 40 + mixed[:49]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in lattice.encode(df, PATH).collect()}
    assert [got[i] for i in range(len(texts))] == [library.encode(t) for t in texts]


def test_encoding_shuffles_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert "Exchange" not in lattice.encode_and_decode(docs, PATH)._jdf.queryExecution().executedPlan().toString()
