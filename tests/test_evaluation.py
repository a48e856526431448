import pathlib
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from epochwise.operators import cells, evaluation, models, neighbours, splits
from epochwise.storage import stage


def vectors(n=90, d=5, seed=0, gap=0.0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, size=n)
    x = rng.normal(size=(n, d)) + gap * label[:, None]
    return pd.DataFrame(
        {
            "SubjectID": ["s%d" % (2 * (i % 5) + label[i]) for i in range(n)],
            "EpochID": ["ep-%d" % i for i in range(n)],
            "label": label,
            "values": list(x),
        }
    )


def frame(spark, pdf):
    out = pdf.assign(values=[list(map(float, v)) for v in pdf["values"]], label=pdf["label"].astype(int))
    return spark.createDataFrame(
        out, "SubjectID string, EpochID string, label int, values array<double>"
    )


def as_neighbours(df, group):
    return df.select(
        F.col("EpochID").alias("key"), "label", "values",
        (F.lit(None) if group is None else F.col(group)).cast("string").alias("grp"),
    )


def brute(pdf, metric, k, same_allowed):
    x = np.stack(pdf["values"])
    gap = x[:, None, :] - x[None, :, :]
    d = np.abs(gap).sum(-1) if metric == "manhattan" else np.sqrt((gap**2).sum(-1))
    keys, out = pdf["EpochID"].tolist(), {}
    for i in range(len(pdf)):
        options = sorted(
            (d[i, j], keys[j]) for j in range(len(pdf)) if same_allowed(i, j)
        )[:k]
        out[keys[i]] = [key for _, key in options]
    return out


@pytest.mark.parametrize("sizes", [(32_768, 256, 8_000_000, 512), (20, 7, 90, 6), (20, 7, 90, 1)])
def test_neighbours_do_not_depend_on_blocks(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK_ROWS", "LEAST_ROWS", "TILE_NUMBERS", "CELL_ROWS"), sizes):
        monkeypatch.setattr(cells, name, value)
    pdf = vectors()
    pdf.at[3, "values"] = pdf.at[5, "values"]  # equal vectors tie by key
    rows = as_neighbours(frame(spark, pdf), "SubjectID")
    found = neighbours.nearest(rows, rows, 4).toPandas()
    subject = pdf["SubjectID"].tolist()
    for metric in neighbours.METRICS:
        want = brute(pdf, metric, 4, lambda i, j: subject[i] != subject[j])
        part = found[found["metric"] == metric].sort_values(["key", "place"])
        assert part.groupby("key")["ref_key"].apply(list).to_dict() == want


def test_fewer_references_than_neighbours(spark):
    rows = as_neighbours(frame(spark, vectors(3)), None)
    found = neighbours.nearest(rows, rows.limit(2), 11, ["euclidean"])
    assert found.count() == 6
    with pytest.raises(ValueError):
        neighbours.nearest(rows, rows, 1, ["cosine"])


@pytest.mark.parametrize("shift", [0.0, 1e7])
@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_few_pairs_of_clustered_vectors_are_compared(spark, monkeypatch, metric, shift):
    """Equal to brute force while most pairs are ruled out; far from the origin rounding costs pruning only."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 400)
    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    rng = np.random.default_rng(11)
    x = rng.normal(0, 10, (50, 8))[np.arange(3000) % 50] + rng.normal(0, 0.5, (3000, 8)) + shift
    pdf = pd.DataFrame({"key": [f"k{i:04d}" for i in range(3000)], "label": 0, "values": x.tolist(), "grp": None})
    rows = spark.createDataFrame(pdf, "key string, label int, values array<double>, grp string")
    work = spark.sparkContext.accumulator(0)
    found = neighbours.nearest(rows, rows, 3, [metric], work).toPandas()
    gap = x[:, None, :] - x[None, :, :]
    d = np.abs(gap).sum(-1) if metric == "manhattan" else np.sqrt((gap**2).sum(-1))
    want = np.lexsort((np.broadcast_to(np.arange(3000), d.shape), d), axis=1)[:, :3]
    got = found.sort_values(["key", "place"])["ref_key"].str[1:].astype(int).to_numpy().reshape(-1, 3)
    assert (got == want).all()
    if not shift:
        assert 0 < work.value < 0.1 * 3000 * 3000


@pytest.mark.parametrize("width, scale", [(3, 1.0), (64, 1e-3), (150, 1e9)])
def test_distances_in_steps_have_a_bound(width, scale):
    """Sums of 16 bits are never further off than what they say."""
    rng = np.random.default_rng(width)
    a, b = (rng.normal(5, scale, (n, width)) for n in (40, 70))
    b[0, 0] += 20 * scale
    steps = cells.Steps(a, b)
    rows = np.arange(3, 33)
    rough, near = steps.rough(rows, 10, 70)
    gap = np.abs(rough - np.abs(a[rows, None] - b[None, 10:]).sum(axis=2))
    assert steps.usable and rough.shape == (30, 60) and (gap <= near[:, None]).all()
    assert not cells.Steps(np.ones((2, 3)), np.ones((2, 3))).usable
    assert not cells.Steps(np.full((2, 3), -1.7e308), np.full((2, 3), 1.7e308)).usable


@pytest.mark.parametrize("width, scale, far", [(3, 1.0, 0.0), (64, 1e-3, 0.0), (64, 1e6, 1e9), (150, 1e9, 0.0)])
def test_screens_lose_no_pair(width, scale, far):
    """Every pair within its query's distance is marked, and few others where vectors are spread evenly."""
    rng = np.random.default_rng(width)
    a, b = (rng.normal(far, scale, (n, width)) for n in (60, 500))
    b[0, 0] += 20 * scale
    gap = np.abs(a[:, None] - b[None])
    rows = np.arange(5, 55)
    for kind, d in ((cells.Coarse, gap.sum(axis=2)), (cells.Singles, np.sqrt((gap**2).sum(axis=2)))):
        screen, tau = kind(a, b), np.sort(d, axis=1)[:, 4]
        marks = screen.marks(rows, 20, 480, tau[rows])
        assert screen.usable and marks.shape == (50, 460) and marks[d[rows, 20:480] <= tau[rows, None]].all()
        assert far or marks.mean() < 0.2
    for wrong in (np.full((2, 3), np.nan), np.full((2, 3), np.inf), np.zeros((2, 3))):
        assert not cells.Coarse(wrong, wrong).usable and not cells.Singles(wrong, wrong).usable


def test_a_tile_holds_few_numbers(monkeypatch):
    """A block of queries and references is compared in a few MB, whatever the metric."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (4096, 16))
    q = pd.DataFrame({"key": [f"k{i}" for i in range(4096)], "grp": None, "values": list(x), "tau": np.inf})
    for metric in neighbours.METRICS:
        d, slack = cells.distances(metric, x[:1], x[:1])
        one = cells.Cells(metric, x[:1], d, np.zeros(1, int), np.array([4096]), np.zeros(1), np.full(1, 1e3), np.array([4096]), 1e-9)
        tracemalloc.start()
        found = cells._best_of_bundle(q, q.assign(cell=0, label=0), one, 3, None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 3 * 4096 and peak < 50e6


def test_copies_of_one_vector_and_a_hot_group(spark, monkeypatch):
    """Most rows are one vector: its cell is cut into blocks; one group holds half of the rows."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 30)
    monkeypatch.setattr(cells, "CELL_ROWS", 10)
    x = np.random.default_rng(12).normal(0, 1, (200, 3))
    x[:120] = x[0]
    pdf = pd.DataFrame({"EpochID": [f"k{i:03d}" for i in range(200)], "label": 1, "values": x.tolist()})
    pdf["grp"] = ["hot" if i % 2 else None if i % 3 else "cold" for i in range(200)]
    rows = spark.createDataFrame(
        pdf.rename(columns={"EpochID": "key"}), "key string, label int, values array<double>, grp string"
    )
    found = neighbours.nearest(rows, rows, 5).toPandas()
    grp = pdf["grp"].tolist()
    for metric in neighbours.METRICS:
        want = brute(pdf, metric, 5, lambda i, j: grp[i] is None or grp[i] != grp[j])
        part = found[found["metric"] == metric].sort_values(["key", "place"])
        assert part.groupby("key")["ref_key"].apply(list).to_dict() == want


def test_disk_of_a_search_grows_with_the_rows(spark, monkeypatch):
    """Neither side of a search is copied for the blocks of the other, in shuffles or in written tables."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 64)
    monkeypatch.setattr(cells, "LEAST_ROWS", 64)
    monkeypatch.setattr(cells, "CELL_ROWS", 16)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))

    def files():
        found = blocks.getAllFiles()
        shuffled = [pathlib.Path(found.apply(i).getPath()) for i in range(found.length())]
        return {p: p.stat().st_size for p in [*shuffled, *folder.rglob("*.parquet")] if p.is_file()}

    def written(n):
        before, rows = files(), as_neighbours(frame(spark, vectors(n, 32, seed=n)), None)
        assert neighbours.nearest(rows, rows, 3, ["euclidean"]).count() == 3 * n
        return sum(size for p, size in files().items() if p not in before)

    few, many = written(128), written(768)
    assert many < 12 * few  # six times the rows; copies of them for each block of the other side would be 36 times as many


def test_roles_share_a_comparison(spark, monkeypatch):
    """The lists of a role are those of a search of its own; a key that repeats has the best of all its rows."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 40)
    monkeypatch.setattr(cells, "CELL_ROWS", 10)
    pdf = vectors(150, 4, seed=6)
    pdf.at[7, "values"] = pdf.at[8, "values"]
    pdf.loc[11, ["SubjectID", "EpochID"]] = pdf.loc[10, ["SubjectID", "EpochID"]]
    rows = frame(spark, pdf)
    train = stage(rows.where("SubjectID <> 's1'").withColumn("fold", F.pmod(F.xxhash64("values"), F.lit(3)).cast("int")), "train")
    test = rows.where("SubjectID = 's1'")
    found = stage(neighbours.by_role(train, test, 4), "found")
    refs = as_neighbours(train, "fold")
    want, roles = {}, {("test", r.EpochID, -1, r.label) for r in test.collect()}
    for r in train.collect():
        roles |= {("cv", r.EpochID, r.fold, r.label), ("train", r.EpochID, -1, r.label)}
    for part, queries in {"cv": refs, "train": as_neighbours(train, None), "test": as_neighbours(test, None)}.items():
        near = neighbours.nearest(queries, refs, 4).toPandas().sort_values("place")
        for (key, metric), some in near.groupby(["key", "metric"]):
            for _, _, fold, label in (r for r in roles if r[:2] == (part, key)):
                want[part, key, metric, fold, label] = some["dist"].tolist(), some["ref_label"].tolist()
    got = {(r.part, r.key.split(":")[1], r.metric, r.fold, r.label): (r.dist, r.ref_label) for r in found.collect()}
    assert found.count() == len(got) and got == want
    long = found.select(F.concat_ws("|", "part", "key", "fold", "label").alias("key"), "metric", F.posexplode(F.arrays_zip("dist", "ref_label")).alias("at", "ref"))
    votes = neighbours.vote(long.select("key", "metric", "ref.*", (F.col("at") + 1).alias("place")), [1, 3])
    whole = neighbours.vote_lists(found, ["part", "key", "fold", "label", "metric"], [1, 3])
    whole = whole.select(F.concat_ws("|", "part", "key", "fold", "label").alias("key"), "metric", "k", "weights", "prediction")
    assert votes.count() == 4 * len(got) and votes.exceptAll(whole).count() == 0


def test_no_references(spark):
    rows = as_neighbours(frame(spark, vectors(3)), None)
    assert neighbours.nearest(rows, rows.limit(0), 2).count() == 0
    assert neighbours.nearest(rows.limit(0), rows, 2).count() == 0


def votes_of(spark, rows, weights, k):
    df = spark.createDataFrame(
        [("q", "euclidean", d, f"r{i}", label, i + 1) for i, (d, label) in enumerate(rows)],
        "key string, metric string, dist double, ref_key string, ref_label int, place int",
    )
    return neighbours.vote(df, [k], [weights]).first()["prediction"]


@pytest.mark.parametrize(
    "rows, weights, k, want",
    [
        ([(1.0, 1), (2.0, 0)], "uniform", 2, 0),  # tie: smaller label
        ([(1.0, 1), (2.0, 0)], "distance", 2, 1),
        ([(0.0, 1), (0.1, 0), (0.1, 0)], "distance", 3, 1),  # distance 0 decides
        ([(0.0, 1), (0.0, 0), (0.1, 1)], "distance", 3, 0),  # equal zeros: smaller label
        ([(1.0, 1), (1.1, 0), (1.2, 0)], "uniform", 1, 1),
        ([(1.0, 1), (1.1, 0), (1.2, 0)], "uniform", 3, 0),
    ],
)
def test_votes(spark, rows, weights, k, want):
    assert votes_of(spark, rows, weights, k) == want


def test_identification_recall(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cells, "CELL_ROWS", 8)
    pdf = vectors(120, 3, seed=2)
    df = splits.random_split(frame(spark, pdf), 0.3)
    marked = df.toPandas()
    ranked = neighbours.ranked_subjects(df, 6)
    order = {r["SubjectID"]: r["place"] for r in ranked.collect()}
    ready = df.withColumnRenamed("EpochID", "key")
    found = neighbours.identification_recall(
        ready.where("not is_test"), ready.where("is_test"), ranked, 6
    )
    got = {r["Num_Subjects"]: r["Recall"] for r in found.collect()}
    want = {}
    for n in range(2, 7):
        used = marked[marked["SubjectID"].map(lambda s: order.get(s, 99) <= n)]
        train, test = used[~used["is_test"]], used[used["is_test"]]
        x, q = np.stack(train["values"]), np.stack(test["values"])
        nearest = np.linalg.norm(q[:, None] - x[None], axis=2).argmin(axis=1)
        hit = train["SubjectID"].to_numpy()[nearest] == test["SubjectID"].to_numpy()
        want[n] = pd.Series(hit).groupby(test["SubjectID"].to_numpy()).mean().mean()
    assert got.keys() == want.keys()
    for n in want:
        np.testing.assert_allclose(got[n], want[n])


def test_hold_out_is_disjoint(spark):
    df = frame(spark, vectors())
    train, test = splits.hold_out(df, 2)
    a = {r[0] for r in train.select("SubjectID").distinct().collect()}
    b = {r[0] for r in test.select("SubjectID").distinct().collect()}
    assert not a & b and b == {"s0", "s1", "s2", "s3"}
    assert train.count() + test.count() == 90


def test_random_split_sizes(spark):
    df = frame(spark, vectors())
    marked = splits.random_split(df, 0.3).toPandas()
    for _, part in marked.groupby("SubjectID"):
        assert part["is_test"].sum() == int(np.ceil(len(part) * 0.3))
    again = splits.random_split(df.repartition(5), 0.3).toPandas()
    assert set(marked[marked["is_test"]]["EpochID"]) == set(again[again["is_test"]]["EpochID"])


@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("k", [5, 15])
def test_folds_are_stratified(spark, k, shuffle):
    folded = splits.stratified_folds(frame(spark, vectors()), k, shuffle).toPandas()
    sizes = folded.groupby(["label", "fold"]).size().unstack()
    assert list(sizes.columns) == list(range(k))
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_more_folds_than_rows(spark):
    folded = splits.stratified_folds(frame(spark, vectors(4)), 9).toPandas()
    assert (folded.groupby(["label", "fold"]).size() == 1).all()


def predictions(spark, rows):
    return spark.createDataFrame(rows, "SubjectID string, EpochID string, label int, prediction int")


RAGGED = (
    [("a", f"ep-{i}", 1, int(i < 4)) for i in range(4)]  # all right
    + [("b", f"ep-{i}", 1, int(i < 2)) for i in range(4)]  # exactly one half
    + [("c", f"ep-{i}", 0, int(i < 1)) for i in range(3)]  # two of three
)


def test_reports_against_counts(spark):
    df = predictions(spark, RAGGED)
    rows = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    # predicted 1: 4 + 2 + 1, of which 6 are right; predicted 0: 2 + 2, of which 2 are right
    np.testing.assert_allclose(rows["1"][1:], [6 / 7, 6 / 8, 2 * 6 / 15, 8])
    np.testing.assert_allclose(rows["0"][1:], [2 / 4, 2 / 3, 2 * 2 / 7, 3])
    np.testing.assert_allclose(rows["macro avg"]["precision"], (6 / 7 + 0.5) / 2)
    np.testing.assert_allclose(rows["weighted avg"]["recall"], 8 / 11)
    assert evaluation.macro_recall(df).first()[0] == pytest.approx((0.75 + 2 / 3) / 2)


def test_class_never_predicted_scores_zero(spark):
    df = predictions(spark, [("a", "ep-0", 0, 1), ("a", "ep-1", 1, 1)])
    row = evaluation.classification_report(df).where("class = '0'").first()
    assert tuple(row)[1:] == (0.0, 0.0, 0.0, 1)


def test_summary_histogram_and_group_reports(spark):
    df = predictions(spark, RAGGED)
    summary = evaluation.subject_summary(df)
    got = [(r["SubjectID"], r["test_accuracy"], r["correct"], r["total_epochs"], r["incorrect"])
           for r in summary.collect()]
    assert got == [("a", 1.0, 4, 4, 0), ("c", 0.6667, 2, 3, 1), ("b", 0.5, 2, 4, 2)]
    bins = {(r["Group"], r["bin"]): r["subjects"]
            for r in evaluation.accuracy_histogram(summary).collect()}
    assert len(bins) == 20 and bins["Alzheimer's", 9] == 1 and bins["Alzheimer's", 5] == 1
    assert bins["Control", 6] == 1 and sum(bins.values()) == 3
    per_epoch = {r["Group"]: r for r in evaluation.epoch_group_report(summary).collect()}
    row = per_epoch["Alzheimer's"]
    np.testing.assert_allclose(row[1:], [6 / 7, 6 / 8, 2 * 6 / 15, 8])
    per_subject = {r["Group"]: r for r in evaluation.subject_group_report(summary).collect()}
    np.testing.assert_allclose(per_subject["Control"][1:], [1 / 2, 1.0, 2 / 3, 1])
    majority = {r["label"]: tuple(r)[1:] for r in evaluation.majority_counts(df).collect()}
    assert majority == {1: (1, 1, 0.5), 0: (1, 0, 1.0)}


def test_correctness_matrix_is_ragged(spark):
    rows = {r["SubjectID"]: tuple(r)[1:]
            for r in evaluation.correctness_matrix(predictions(spark, RAGGED), range(4)).collect()}
    assert rows["b"] == (True, True, False, False) and rows["c"] == (False, True, True, None)


def test_grid_report_order_and_best_fold(spark):
    rows = [(c, f, 1, int(ok)) for c, f, ok in
            [("x", 0, 1), ("x", 1, 0), ("y", 0, 1), ("y", 1, 1)] for _ in range(2)]
    df = spark.createDataFrame(rows, "config string, fold int, label int, prediction int")
    found = evaluation.grid_report(df, ["config"]).collect()
    assert [tuple(r) for r in found] == [("y", 1.0, 0.0, 1.0, 0), ("x", 0.5, 0.5, 1.0, 0)]


@pytest.fixture(scope="module")
def easy(spark):
    rows = frame(spark, vectors(80, 4, seed=1, gap=4.0))
    return rows.select("SubjectID", "EpochID", "label", array_to_vector("values").alias("features"))


@pytest.mark.parametrize(
    "predictor, prepare",
    [
        (models.with_estimator(lambda t: models.decision_tree()), None),
        (models.with_estimator(lambda t: models.linear_svm(t.count(), max_iter=10)), models.standardise),
    ],
)
def test_models_separate_what_is_separable(easy, predictor, prepare):
    folded = splits.stratified_folds(easy, 3)
    found = models.cross_validate(folded, 3, predictor, prepare=prepare)
    assert found.count() == 80 and found.select("EpochID").distinct().count() == 80
    assert evaluation.accuracy(found).first()[0] > 0.85


def test_model_report(easy):
    train, test = splits.hold_out(easy, 1)
    tree = models.with_estimator(lambda t: models.decision_tree())
    shallow = models.with_estimator(lambda t: models.linear_svm(t.count(), max_iter=5))
    found = models.model_report(
        splits.stratified_folds(train, 3), test, 3, {"tree": tree, "svm": shallow}, models.standardise
    ).collect()
    assert {r["model"] for r in found} == {"tree", "svm"}
    assert found[0]["cv_mean"] >= found[1]["cv_mean"]
    for r in found:
        assert r["best_fold_accuracy"] >= r["cv_mean"] > 0.85 and r["best_fold"] in (0, 1, 2)
        assert r["train_accuracy"] > 0.85 and r["test_accuracy"] > 0.85


def test_memory_of_a_block_does_not_grow_with_cells(monkeypatch):
    def block(count, n, rng):
        x = rng.normal(size=(n, 4))
        pivots = x[:count]
        between, slack = cells.distances("euclidean", pivots, pivots)
        d = cells.distances("euclidean", x, pivots)[0]
        home, away = d.argmin(axis=1), d.min(axis=1)
        far = np.array([away[home == c].max() for c in range(count)])
        rows = np.bincount(home, minlength=count)
        index = cells.Cells(
            "euclidean", pivots, between + slack[:, None], np.zeros(count, int), rows, np.zeros(count), far, rows, 1e-9
        )
        q = pd.DataFrame({"key": [f"k{i:05}" for i in range(n)], "grp": None, "values": list(x), "label": 0})
        return q.assign(tau=np.inf), q.assign(cell=home), index

    q, r, index = block(1024, 8192, np.random.default_rng(5))
    whole = cells._best_of_bundle(q, r, index, 3, None)
    monkeypatch.setattr(cells, "LOWER_NUMBERS", 1 << 20, raising=False)
    tracemalloc.start()
    cut = cells._best_of_bundle(q, r, index, 3, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cut.equals(whole)
    assert peak < 40e6  # 8192 queries by 1024 cells alone are 67 MB
    near = [cells.nearer(q.head(900).assign(tau=0.5), r, index)]
    monkeypatch.setattr(cells, "LOWER_NUMBERS", 1)
    near.append(cells.nearer(q.head(900).assign(tau=0.5), r, index))
    pairs = [{(a, b) for i, j, _ in x for a, b in zip(i.tolist(), j.tolist(), strict=True)} for x in near]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 900
