import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return packing.Encoder(packing.Traits(file.read()))


def encoded(encoder, texts):
    return [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode(texts)]


def test_encoder_matches_library(encoder):
    texts = [
        "", " ", "Hello, World's  12345 \n\nLine\ttab\xa0nbsp\x85nel\x1cfs ls",
        "<|endoftext|> a<|startoftext|>b <|endoftext", "é ́x ΑΣ ΑΣ. İstanbul ǅ ﬁ 한국어 😀😀",
        "x" * 5000, "it's we'll 'S don't", "a <| b",
    ]
    assert encoder.by_words and encoded(encoder, texts) == library_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbé́ \n\t\xa0'sΣ1<|endoftx>."), max_size=60))
def test_encoder_matches_library_on_any_text(encoder, text):
    assert encoded(encoder, [text]) == library_ids([text])


def bins_of(plan, counts):
    """Expand a plan: items of each bin as (offset, length)."""
    bins, seen = defaultdict(list), Counter()
    for length, a, b, first, per_bin, used in plan:
        for rank in range(a, b):
            assert seen[length, rank] == 0
            seen[length, rank] += 1
            bins[first + (rank - a) // per_bin].append((used + (rank - a) % per_bin * length, length))
    assert Counter(k for k, _ in seen.elements()) == counts
    return bins


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), st.sampled_from([30, 37, 64]))
def test_plan_is_best_fit_decreasing(counts, capacity):
    bins = bins_of(packing.plan_bins(counts, capacity), Counter(counts))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == best_fit(counts, capacity)
    assert sorted(bins) == list(range(len(bins)))


def test_plan_size_does_not_follow_the_counts():
    lengths = np.random.default_rng(0).integers(1, 4097, 3000)
    small = Counter(lengths.tolist())
    large = {k: v * 100_000 for k, v in small.items()}
    assert len(packing.plan_bins(large, 4096)) < 40_000
    assert len(packing.plan_bins({7: 10**12}, 4096)) <= 2


def check(rows, texts, capacity):
    ids = {i: [*x, 1] for i, x in zip(texts, library_ids([t or "" for t in texts.values()]), strict=True)}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for i, want in ids.items():
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(want), capacity))
        assert [r.piece for r in own] == list(range(len(own)))
    for items in by_bin.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_bin), sum(map(len, ids.values()))


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    n, total = check(packing.pack_documents(docs, PATH, 512).collect(), texts, 512)
    assert n <= 1.02 * total / 512 + 1


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, length string, piece int"
    empty = packing.pack_documents(spark.createDataFrame([], schema), PATH)
    assert empty.count() == 0
    rows = [(1, None, "x", 1), (2, "", None, 2), (None, "a b", "x", 1), (3, "a b", "x", 1), (3, "a b", "x", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert {r.sequence_id for r in got} == {0}
    assert sorted(r.offset for r in got) == [0, 3, 6, 9, 10]


def test_words_that_normalising_or_lowering_changes(encoder):
    """Words split into letters and tail, alone and among others, over many small calls."""
    odd = ["K", "क़", "Ωa", "İ", "été", "豈", "가", "ΑΣ", "Σ", "ǅ", "ﬁ", "힣", "ß", "é" * 45, "a" * 41, "a" * 90]
    tails = ["", ".", ",", "..", "!?", "|", "̸", "'s", "'", "<", "<|endoftext|>", "1"]
    words = [w + t for w in odd for t in tails] + [t + w for w in odd for t in tails]
    texts = [*words, " ".join(words), "\n".join(reversed(words)), "  ".join(words) + " "]
    assert encoded(encoder, texts) == library_ids(texts)
    for at in range(0, len(texts), 7):
        assert encoded(encoder, texts[at : at + 7]) == library_ids(texts[at : at + 7])


def test_remembered_parts_start_afresh(encoder, monkeypatch):
    monkeypatch.setattr(packing, "_PARTS", 5)
    texts = ["one two, three. 4 five", "five, six seven. one", "eight! nine ten two"] * 3
    for text in texts:
        assert encoded(encoder, [text]) == library_ids([text])


def test_slices_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(packing, "_SLICE_BYTES", 10)
    texts = packing.pa.array(["", "abc", "x" * 50, "", "éé", "abcdef", "ab"])
    parts = list(packing._slices(texts))
    assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == len(texts)
    assert all(b - a == 1 or packing.pc.sum(packing.pc.binary_length(texts.slice(a, b - a))).as_py() <= 10 for a, b in parts)


def test_workers_get_small_batches(spark):
    """Rows of a written table of pieces: here each is as long as its batch has rows."""
    def sizes(batches):
        for batch in batches:
            told = [[0], [0], [0], [batch.num_rows], [0]]
            yield packing.pa.RecordBatch.from_arrays(
                [packing.pa.array(v, type=t) for v, t in zip(told, map(packing.pa.type_for_alias, kinds), strict=True)], names=names
            )

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], ["int64", "int32", "int64", "int64", "int64"]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    rows = packing.packed(spark.range(0, 5000, 1, 1).mapInArrow(sizes, packing.PIECE_SCHEMA), 5000).collect()
    assert sum(r.length for r in rows) == 5000 and max(r.length for r in rows) <= 1000
    assert spark.conf.get(setting) == before


def test_new_words_reach_the_library_in_parts(encoder, monkeypatch):
    words = [f"{a}{b}{c}x{d}" for a in "bcdf" for b in "aeiou" for c in "ghjk" for d in ["", "!!", "é?", "7"]]
    want, sizes, library = library_ids([" ".join(words)]), [], encoder._library
    monkeypatch.setattr(encoder, "parts", packing.Ragged())
    monkeypatch.setattr(packing, "_NEW_PARTS", 7)
    monkeypatch.setattr(encoder, "_library", lambda texts: sizes.append(sum(len(t) for t in texts)) or library(texts))
    assert encoded(encoder, [" ".join(words)]) == want
    assert max(sizes) < 7 * (5 + len("<|startoftext|>")) < sum(map(len, words))
