import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from epochwise.operators import boosted, evaluation, row_blocks, splits

SCHEMA = "SubjectID string, EpochID string, label int, x array<double>"


def data(n, d, seed, subjects=4, gap=0.6):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d))
    x[:, 0] += gap * (2 * y - 1)
    x[:, 1] = np.round(x[:, 1])  # few values, many ties
    return x, y, np.arange(n) % subjects


def rows_of(spark, x, y, s):
    rows = [(f"s{g}", f"ep-{i}", int(l), list(map(float, v))) for i, (v, l, g) in enumerate(zip(x, y, s, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("features", array_to_vector("x")).drop("x")


def plain_fit(b, y, bins, rounds, depth, rate):
    """One model, row by row and node by node: a function from binned rows to log odds."""
    start = np.log(y.mean() / (1 - y.mean()))
    f, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        r, h = y - p, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                return r[rows].sum() / h[rows].sum() if h[rows].sum() > 1e-150 else 0.0
            best = (1e-12 * max(len(rows), 1), None)
            for j in range(b.shape[1]):
                for at in range(bins - 1):
                    low = b[rows, j] <= at
                    n1, n2 = low.sum(), (~low).sum()
                    if n1 and n2:
                        gain = n1 * n2 / len(rows) * (r[rows][low].mean() - r[rows][~low].mean()) ** 2
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (j, at))
            if best[1] is None:
                return grow(rows, level + 1)
            j, at = best[1]
            low = b[rows, j] <= at
            return j, at, grow(rows[low], level + 1), grow(rows[~low], level + 1)

        def leaf(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        f = f + rate * np.array([leaf(tree, row) for row in b])
    return lambda rows: start + rate * np.array([sum(leaf(t, row) for t in trees) for row in rows])


def test_equal_to_separate_fits(spark, monkeypatch):
    """All left-out parts together against one plain fit each, over several blocks and written scores."""
    monkeypatch.setattr(boosted, "_WRITTEN_EVERY", 3)
    x, y, s = data(150, 3, 1)
    df = splits.stratified_folds(rows_of(spark, x, y, s), 2)
    edges = boosted.bin_edges(df, 8)
    fold = {r.EpochID: r.fold for r in df.collect()}
    fold = np.array([fold[f"ep-{i}"] for i in range(150)])
    coded, _, _ = boosted.with_part_codes(df)
    blocks = row_blocks.write_blocks(coded, part=F.col("code"), block_rows=20)
    exclude = [(0, -1), (2, -1), (-1, 1), (3, 0), (-1, -1)]
    trees = boosted.fit(blocks, edges, exclude, rounds=7, depth=3, rate=0.3)
    b = boosted.binned(x, edges)
    for i, (part, out) in enumerate(exclude):
        kept = (s != part) & (fold != out)
        want = plain_fit(b[kept], y[kept].astype(float), 8, 7, 3, 0.3)(b)
        np.testing.assert_allclose(boosted.scores(trees, i, b, 0.3, 3), want, atol=1e-9)


def test_sums_of_many_tasks(spark, monkeypatch):
    """The same where Spark adds the sums, in one step or two."""
    x, y, s = data(60, 2, 2)
    df = rows_of(spark, x, y, s)
    want = sorted(tuple(r) for r in boosted.leave_one_subject_out(df, 3, bins=4).collect())
    monkeypatch.setattr(row_blocks, "_DRIVER_NUMBERS", 0)
    assert sorted(tuple(r) for r in boosted.leave_one_subject_out(df, 3, bins=4).collect()) == want
    monkeypatch.setattr(row_blocks, "_TOGETHER", 2)
    assert sorted(tuple(r) for r in boosted.leave_one_subject_out(df, 3, bins=4).collect()) == want


def test_histograms_stay_off_the_driver(spark, monkeypatch):
    """Of a pass with many histograms the driver gets splits only, the same for any number of blocks."""
    x, y, s = data(400, 16, 6)
    df = rows_of(spark, x, y, s)
    blocks, edges = row_blocks.write_blocks(df, block_rows=20), boosted.bin_edges(df, 32)
    exclude = [(-1, -1)] * 40
    sent = []
    whole = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: sent.append(whole(self)) or sent[-1])
    trees = boosted.fit(blocks, edges, exclude, rounds=1, depth=2)
    assert sum(t.nbytes for t in sent) < 100_000
    monkeypatch.setattr(row_blocks, "_DRIVER_NUMBERS", 10**9)
    again = boosted.fit(blocks, edges, exclude, rounds=1, depth=2)
    assert (trees.leaf == again.leaf).all() and (trees.feature == again.feature).all()
    assert sum(t.nbytes for t in sent) > 1_000_000


def test_groups_of_models_do_not_matter(spark, monkeypatch):
    x, y, s = data(80, 2, 3, subjects=5)
    df = rows_of(spark, x, y, s)
    want = sorted(tuple(r) for r in boosted.leave_one_subject_out(df, 4, bins=4).collect())
    assert len(want) == 80
    monkeypatch.setattr(boosted, "_MOST_NUMBERS", 1)
    assert sorted(tuple(r) for r in boosted.leave_one_subject_out(df, 4, bins=4).collect()) == want


def test_what_is_separable(spark):
    x, y, s = data(90, 3, 4)
    x[:, 2] = 20 * y - 10  # a column of few values is binned without loss
    df = splits.stratified_folds(rows_of(spark, x, y, s), 3)
    found = boosted.cross_validate(df, 3, 5)
    assert found.count() == 90 and evaluation.accuracy(found).first()[0] == 1.0
    nested = {r.SubjectID: (r.cv_mean, r.cv_std) for r in boosted.nested_scores(df, 3, 5).collect()}
    assert nested == {f"s{i}": (1.0, 0.0) for i in range(4)}


def test_one_class_and_one_subject(spark):
    x, _, s = data(30, 2, 5)
    found = boosted.leave_one_subject_out(rows_of(spark, x, np.ones(30, dtype=int), s), 2)
    assert {r.prediction for r in found.collect()} == {1}
    with pytest.raises(ValueError):
        boosted.leave_one_subject_out(rows_of(spark, x, np.arange(30) % 2, np.zeros(30, dtype=int)), 2)
