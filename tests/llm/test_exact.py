import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from epochwise.llm import exact


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**47), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    values = np.array(sorted(values), dtype=np.int64)
    assert exact.golomb_decode(len(values), *exact.golomb_encode(values)).tolist() == values.tolist()


def test_golomb_saves_room():
    values = np.unique(np.random.default_rng(1).integers(0, 2**40, 50_000))
    _, unary, rest = exact.golomb_encode(values)
    assert len(unary) + len(rest) < 0.7 * 40 / 8 * len(values)


def by_hand(rows):
    groups = defaultdict(list)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    for (i, t), b in zip(rows, bare, strict=True):
        groups[b].append((-len(t or ""), i))
    return sorted(
        (i, min(groups[b])[1], len(groups[b]), min(groups[b])[1] == i, hashlib.sha256(b.encode()).hexdigest())
        for (i, _), b in zip(rows, bare, strict=True)
    )


def found(df):
    return sorted(tuple(r) for r in exact.exact_duplicates(df).collect())


def test_matches_brute_force(spark):
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(400)]
    rows += [(1000 + i, "hot  text") for i in range(700)] + [(3000, "hot text\n\n\n"), (2999, "hottext    ")]
    rows += [(5000 + i, f"only {i}") for i in range(200)] + [(-5, None), (7000, ""), (7001, " \n"), (7002, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df) == by_hand(rows)
    kept = {i for i, keep, *_ in by_hand(rows) if i == keep}
    assert sorted(r.doc_id for r in exact.without_exact_duplicates(df).collect()) == sorted(kept)


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, kept string, bare int, `a.b` int"
    empty = spark.createDataFrame([], schema)
    assert exact.exact_duplicates(empty).count() == 0 and exact.without_exact_duplicates(empty).count() == 0
    rows = [(1, "a b", "x", 1, 1), (1, "a b", "x", 1, 1), (None, "a b", None, None, None), (None, "z", None, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect())
    assert got == [(0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    left = exact.without_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "z"), (1, "a b")]


def test_only_suspects_shuffle_their_text(spark):
    """Without copies no text moves: the only exchange of texts comes after the bitmaps."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan
