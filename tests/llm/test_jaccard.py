import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from epochwise.llm import jaccard
from epochwise.llm.components import components

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def by_hand(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def found(df, n, threshold):
    return sorted(tuple(r) for r in jaccard.near_duplicates(df, n, threshold).collect())


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("n", "threshold"), [(3, (90, 100)), (5, (80, 100)), (2, (50, 100)), (1, (100, 100))])
def test_matches_brute_force(spark, n, threshold):
    rng = random.Random(n)
    common = [f"c{i}" for i in range(15)]
    rows = []
    for base in range(12):
        words = [f"w{base}_{i}" if rng.random() < 0.7 else rng.choice(common) for i in range(rng.randint(20, 120))]
        rows += [edited(rng, words, rng.randint(0, 5)) for _ in range(rng.randint(1, 12))]
    hot = [f"hot{i}" for i in range(90)]
    rows += [edited(rng, hot, rng.randint(0, 6)) for _ in range(60)] + [" ".join(hot)] * 40
    rows += [" ".join(rng.choices(common, k=rng.randint(1, 6))) for _ in range(60)]
    rows += ["", None, " \n", "A b", "a B", "a", "A", "x y z " * 2000]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, n, threshold) == by_hand(rows, n, *threshold)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé \n\tAB"), max_size=40), min_size=1, max_size=6), st.integers(1, 4))
def test_sets_match_brute_force(texts, n):
    got = jaccard.Shingler(n).sets([t.encode() for t in texts])
    want = [shingles(t, n) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for a, x in zip(got, want, strict=True):
        for b, y in zip(got, want, strict=True):
            assert len(set(a.tolist()) & set(b.tolist())) == len(x & y)


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (2, 3), (1, 1)])
def test_prefix_length(num, den):
    for size in range(1, 300):
        need = min(k for k in range(size + 1) if den * k >= num * size)
        assert jaccard.prefix_length(size, num, den) == size - need + 1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(200)] + [(501, 500), (502, 500), (7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = defaultdict(int) | {i: 0 for i in range(41)} | {i: 100 for i in range(100, 301)} | dict.fromkeys((500, 501, 502), 500)
    assert {r.node: r.label for r in got} == dict(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text, "s"), (2, text + " more", "s"), (9, "other words here", "s"), (None, text, "s"), (10, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `c.x` string")
    left = jaccard.without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [2, 9, 10]


def test_rows_are_decided_one_by_one(spark):
    """Different texts under one id, rows without an id, repeated rows, and columns named like helpers."""
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    schema = "doc_id long, text string, _hash string, _suspect int, _bitmap_no int, _bitmap string, whole int, c int, keep int"
    rows = [(1, text), (2, text), (2, other), (None, other), (None, "alone in the world"), (3, None), (3, None), (4, ""), (None, None)]
    rows += [(7, other + " end"), (8, "once more " * 5), (8, "once more " * 5), (None, "no id " * 9), (None, "no id " * 9)]
    df = spark.createDataFrame([(*r, "h", 1, 2, "b", 3, 4, 5) for r in rows], schema)
    left = jaccard.without_near_duplicates(df)
    assert left.columns == df.columns and {tuple(r)[2:] for r in left.collect()} == {("h", 1, 2, "b", 3, 4, 5)}
    want = [(1, text), (2, other), (None, "alone in the world"), (3, None), (3, None), (4, ""), (None, None), (8, "once more " * 5), (None, "no id " * 9)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)


def test_one_token_of_a_large_component_and_a_foreign_class(spark):
    """Only pairs across labels are made: as many as the component has classes, not their square."""
    rows = [(5, i, 20, 0, 0) for i in range(50_000)] + [(5, 99_999_999, 20, 0, 1)]
    known = spark.createDataFrame(rows, "token long, c long, n long, i int, label long")
    pairs = jaccard._other_pairs(known, 80, 100)
    assert pairs.count() == 50_000 and pairs.where("b <> 99999999").count() == 0


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, c string, token int"
    empty = spark.createDataFrame([], schema)
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.without_near_duplicates(empty).count() == 0
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (None, "A B c", "x", 1), (None, None, None, None), (4, "z", "", 1)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_duplicates(
        spark.createDataFrame(rows, schema), 3
    ).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 1, 1), (4, 1, 4)]


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100), (2, 3), (1, 1)])
def test_pairs_that_may_link_share_a_key_with_both_roles(num, den):
    """Whatever the sizes and places of the first common token, unless size and place rule the pair out."""
    bands, held = jaccard.Bands(num, den), {}
    for size in range(1, 90):
        for place in range(jaccard.prefix_length(size, num, den)):
            prefix = np.arange(1000, 1000 + jaccard.prefix_length(size, num, den), dtype=np.uint64)
            prefix[place] = 7
            keys, places = bands.placed(prefix, size)
            assert len(set(keys.tolist())) == len(keys)
            held[size, place] = {k: p % 4 for k, p in zip(keys.tolist(), places.tolist(), strict=True) if p // 4 == place}
    for (n_a, i), mine in held.items():
        for (n_b, j), other in held.items():
            if min(n_a - i, n_b - j) * (num + den) >= num * (n_a + n_b):
                assert any(mine[k] | other[k] == 3 for k in mine.keys() & other.keys())


def test_parities_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    every = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    rows = []
    for size, gone, new in [(1, 0, 0), (60, 3, 5), (64, 0, 1), (65, 1, 0), (900, 20, 180), (1000, 500, 30), (900, 450, 450)]:
        a, b = every[:size], every[gone : size + new]
        wanted = 10 * len(np.setxor1d(a, b)) <= len(a) + len(b)  # num = 9, den = 11
        odd = jaccard.parities(a), jaccard.parities(b)
        few = [jaccard.folded(o, len(x), 9, 11).tolist() for o, x in zip(odd, (a, b), strict=True)]
        rows.append((len(a), len(b), odd[0].tolist(), odd[1].tolist(), *few, wanted))
    df = spark.createDataFrame(
        rows, "n_a long, n_b long, odd_a array<long>, odd_b array<long>, few_a array<long>, few_b array<long>, wanted boolean"
    )
    for name in ("odd", "few"):
        got = df.select("wanted", jaccard._close(9, 11, name).alias("close"), jaccard._close(0, 1, name).alias("any")).collect()
        assert sum(r.wanted for r in got) == 4 and all(r.close for r in got if r.wanted) and all(r["any"] for r in got)
        assert [r.close for r in got[-2:]] == [False, False]


def test_what_two_texts_share_by_chance_is_looked_at_once(spark, monkeypatch):
    """Pairs that are far from similar take part in one round and are never compared as whole sets."""
    own = lambda i: [f"w{i}_{k}" for k in range(100)]
    rows = [(i, " ".join(own(i)[:60] + own(10_000 + i // 2)[:40])) for i in range(60)]
    counts = defaultdict(list)

    def counted(df, name, stage=jaccard.stage):
        out = stage(df, name)
        counts[name].append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(df).collect()} == set(range(60))
    assert counts["centred-rows"][0] and counts["pairs"] == [0, 0, 0]
    assert counts["open-rows"] == [0, 0] and counts["sets"] == [0, 0, 0]


def test_classes_of_cells_take_little_memory():
    cells = np.random.Generator(np.random.PCG64(2)).poisson(50, 1 << jaccard._CELL_BITS).astype(np.int64)
    cells[:40] += np.int64(1) << np.arange(40)
    above = np.maximum(0, (cells - cells.mean() - 4 * np.sqrt(cells.mean())) / 4).astype(np.int64)
    want = [int(x).bit_length() for x in above]
    tracemalloc.start()
    got = jaccard._classes(cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == want and peak < cells.nbytes / 2
