import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochwise.llm import resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def features(text):
    words = words_of(text)
    return [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_hand(rows, target, share=(5, 100), min_words=20):
    found = [(i, len(words_of(t)), [f % 10_000 for f in features(t)]) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for text in target:
        t.update(f % 10_000 for f in features(text))
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
        for b in range(10_000)
    ]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(drawn[: share[0] * len(drawn) // share[1]]):
        row[5] = place + 1
    return sorted(map(tuple, out), key=repr)


def found(docs, target, **options):
    return sorted((tuple(r) for r in resampling.resampled(docs, target, **options).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abCZ09 .\n-é中", max_size=40), min_size=1, max_size=6))
def test_crcs_of_all_word_runs(texts):
    """Every run's CRC from two prefixes is the CRC of its bytes, also across texts."""
    data = b"".join(t.encode() + b" " for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
    stream, spaces, before = resampling.word_stream(np.frombuffer(data, dtype=np.uint8), offsets)
    words = [w for t in texts for w in words_of(t)]
    assert bytes(stream) == b"".join(w + b" " for w in words)
    assert np.diff(before).tolist() == [len(words_of(t)) for t in texts]
    for n, crcs in enumerate(resampling.ngram_crcs(stream, spaces, 3), start=1):
        assert crcs.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def test_long_shifts():
    """Words and streams far longer than a stripe."""
    words = [b"a" * 5, b"xy" * 70_000, b"q", "é".encode() * 999, b"z9" * 300]
    stream = np.frombuffer(b"".join(w + b" " for w in words), dtype=np.uint8)
    spaces = np.cumsum([len(w) + 1 for w in words]) - 1
    for n, crcs in enumerate(resampling.ngram_crcs(stream, spaces, 3), start=1):
        assert crcs.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def test_matches_brute_force(spark):
    rows = [(i, f"Common words, number {i % 50} " + "filler-%d " % i * (i % 40)) for i in range(600)]
    rows += [(1000 + i, "hot text " * 15) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " ..\n"), (2003, "w" * 300_000 + " x y"), (2004, "Ünïcode Ärger " * 5000)]
    target = ["number 7 filler target words", None, "", "more target words"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert found(docs, bench) == by_hand(rows, target)
    assert found(docs, bench, share=(1, 3), min_words=1) == by_hand(rows, target, (1, 3), 1)


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    schema = "doc_id long, text string, weight string, row int, `a.b` int, place int"
    empty = spark.createDataFrame([], schema)
    assert resampling.resampled(empty, empty).count() == 0
    text = "one two three four five six seven " * 4
    rows = [(1, text, "x", 1, 1, 1), (1, text, "x", 1, 1, 1), (None, text, None, None, None, None), (2, None, None, 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = found(docs, empty, share=(1, 1))
    assert got == by_hand([r[:2] for r in rows], [], (1, 1))
    assert sorted(r[-1] for r in got if r[-1]) == [1, 2, 3]


def test_ties_go_to_the_smaller_id(spark):
    """Without words nothing but the noise tells rows apart; the same id ties with itself."""
    docs = spark.createDataFrame([(i, None) for i in (5, 3, 5, 9)], "doc_id long, text string")
    got = found(docs, docs, share=(1, 1), min_words=0)
    assert got == by_hand([(i, None) for i in (5, 3, 5, 9)], [], (1, 1), 0)


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_sample_documents(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    bench = spark.read.parquet(f"/root/testdata/{scale}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, bench) == by_hand(rows, [r.text for r in bench.collect()])
