import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from epochwise.operators import components, effects, normalize, reshape
from epochwise.plans import catalog, flows

COLS = ["a.b", "c", "k"]


def matrix(seed=0, n=40):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "SubjectID": ["s%d" % (0 if i % 3 else i % 5) for i in range(n)],
            "EpochID": ["ep-%d" % i for i in range(n)],
            "label": [i % 2 for i in range(n)],
            "a.b": rng.normal(size=n),
            "c": rng.normal(size=n) * 5 + 2,
            "k": 7.0,
        }
    )


def back(df):
    pdf = df.toPandas()
    return pdf.sort_values("EpochID").reset_index(drop=True)


def by_epoch(pdf):
    return pdf.sort_values("EpochID").reset_index(drop=True)


def test_global_range_comes_from_training(spark):
    train, test = matrix(0), matrix(1)
    a, b = normalize.minmax_global(spark.createDataFrame(train), spark.createDataFrame(test), COLS)
    for scaled, pdf in ((back(a), by_epoch(train)), (back(b), by_epoch(test))):
        for c in ("a.b", "c"):
            lo, hi = train[c].min(), train[c].max()
            np.testing.assert_allclose(scaled[c], (pdf[c] - lo) / (hi - lo) * 2 - 1)
        assert (scaled["k"] == -1.0).all()


def test_global_standardisation(spark):
    train, test = matrix(0), matrix(1)
    test.loc[3, "c"] = None
    a, b = normalize.zscore_global(
        spark.createDataFrame(train), spark.createDataFrame(test), COLS, reshape.KEYS
    )
    assert reshape.feature_columns(a) == sorted(COLS)
    scaled = back(a)
    np.testing.assert_allclose(scaled["c"].mean(), 0, atol=1e-12)
    np.testing.assert_allclose(scaled["c"].std(ddof=1), 1)
    assert (scaled["k"] == 0).all()


def test_missing_value_becomes_zero(spark):
    df = spark.createDataFrame(
        [("s", "e1", 0, 1.0), ("s", "e2", 0, 3.0), ("s", "e3", 1, None)],
        "SubjectID string, EpochID string, label int, v double",
    )
    _, out = normalize.zscore_global(df, df, ["v"], reshape.KEYS)
    assert back(out)["v"].tolist()[2] == 0.0


def test_scaling_by_subject(spark):
    pdf = matrix()
    df = spark.createDataFrame(pdf)
    z, mm = back(normalize.zscore_by_subject(df, COLS)), back(normalize.minmax_by_subject(df, COLS))
    ordered = by_epoch(pdf)
    for c in ("a.b", "c"):
        g = ordered.groupby("SubjectID")[c]
        want = (ordered[c] - g.transform("mean")) / g.transform("std").replace(0, 1).fillna(1)
        np.testing.assert_allclose(z[c], want, atol=1e-12)
        width = (g.transform("max") - g.transform("min")).replace(0, 1)
        np.testing.assert_allclose(mm[c], (ordered[c] - g.transform("min")) / width)
    assert (z["k"] == 0).all() and (mm["k"] == 0).all()


def test_vector_range_by_subject(spark):
    df = spark.createDataFrame(
        [("a", "1", [1.0, 5.0]), ("a", "2", [3.0, 5.0]), ("b", "3", [9.0, 1.0])],
        "SubjectID string, EpochID string, v array<double>",
    ).select("SubjectID", "EpochID", array_to_vector("v").alias("features"))
    out = normalize.minmax_vector_by_subject(df).select("EpochID", vector_to_array("features").alias("v"))
    assert {r["EpochID"]: r["v"] for r in out.collect()} == {
        "1": [0.0, 0.0], "2": [1.0, 0.0], "3": [0.0, 0.0]
    }


def test_power_by_electrode_and_band(spark):
    schema = "Electrode string, WaveBand string, Power double"
    train = spark.createDataFrame([("x", "A", 1.0), ("x", "A", 3.0), ("y", "A", 5.0)], schema)
    test = spark.createDataFrame([("x", "A", 2.0), ("z", "A", 2.0)], schema)
    a, b = normalize.zscore_power(train, test)
    got = sorted((r["Electrode"], round(r["Power"], 6)) for r in a.collect())
    assert got == [("x", -0.707107), ("x", 0.707107), ("y", 0.0)]
    assert [(r["Electrode"], r["Power"]) for r in b.collect()] == [("x", 0.0)]


def test_effect_size(spark):
    rng = np.random.default_rng(4)
    x0, x1 = rng.normal(size=30), rng.normal(size=20) + 1
    rows = [("f", 0, float(v)) for v in x0] + [("f", 1, float(v)) for v in x1]
    rows += [("flat", i % 2, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "pivot string, label int, value double")
    found = {r["Feature"]: r for r in effects.effect_size(df).collect()}
    v0, v1 = x0.var(ddof=1), x1.var(ddof=1)
    gap = x1.mean() - x0.mean()
    pooled = np.sqrt((29 * v0 + 19 * v1) / 48)
    np.testing.assert_allclose(found["f"]["Cohen_d"], gap / pooled)
    e0, e1 = v0 / 30, v1 / 20
    np.testing.assert_allclose(found["f"]["t"], gap / np.sqrt(e0 + e1))
    np.testing.assert_allclose(found["f"]["dof"], (e0 + e1) ** 2 / (e0**2 / 29 + e1**2 / 19))
    assert found["flat"]["Cohen_d"] is None


def test_selection_is_strict(spark):
    df = spark.createDataFrame(
        [("a", 0.5), ("b", 0.51), ("c", None), ("d", 2.0)], "Feature string, Abs_Cohen_d double"
    )
    assert effects.strong_names(df) == ["b", "d"]


def separable(n=60, seed=0):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    return pd.DataFrame(
        {
            "SubjectID": ["s%d" % (i % 6) for i in range(n)],
            "EpochID": ["ep-%d" % i for i in range(n)],
            "label": label,
            "good": label * 4 + rng.normal(size=n),
            "noise": rng.normal(size=n),
            "copy": label * 4 + rng.normal(size=n) * 0.1,
        }
    )


def test_selected_features_are_scaled(spark):
    out, kept = flows.select_by_effect(spark.createDataFrame(separable()), ["good", "noise", "copy"], 1.0)
    assert kept == ["copy", "good"] and out.columns == ["SubjectID", "EpochID", "label", *kept]
    row = out.agg(F.min("good"), F.max("good")).first()
    assert tuple(row) == (-1.0, 1.0)
    with pytest.raises(ValueError):
        flows.select_by_effect(spark.createDataFrame(separable()), ["noise"], 5.0)


def test_no_strong_feature_gives_no_rows(spark, tmp_path):
    """Both labels have the same vectors: no component has an effect, which is a result and not an error."""
    rows = [(i, [float((i // 2) % 7 + j) for j in range(64)], i % 2) for i in range(56)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalog.QUERIES["minmax_selected"](spark, str(tmp_path))
    assert found.dtypes == [(c, "string") for c in ("SubjectID", "EpochID")] + [
        ("label", "int"), ("pivot", "string"), ("value", "double")
    ]
    assert found.count() == 0


def test_components_match_numpy(spark):
    pdf = separable()
    cols = ["good", "noise", "copy"]
    df = spark.createDataFrame(pdf)
    fitted = components.fit_pca(df, cols, 0.95)
    share, vectors = np.linalg.eigh(np.cov(pdf[cols].T.to_numpy()))
    share, vectors = share[::-1] / share.sum(), vectors[:, ::-1]
    np.testing.assert_allclose(fitted.variance, share)
    assert fitted.k == int(np.argmax(np.cumsum(share) >= 0.95)) + 1
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(3)])
    scores = components.project(df, fitted).toPandas().set_index("EpochID").loc[pdf["EpochID"]]
    got = np.stack([v.toArray() for v in scores["features"]])
    np.testing.assert_allclose(got, pdf[cols].to_numpy() @ vectors[:, : fitted.k], atol=1e-9)
    top = components.top_loadings(df, fitted, 2).collect()
    assert len(top) == 2 * fitted.k
    first = [r["feature"] for r in sorted(top, key=lambda r: r["place"]) if r["pc"] == 1]
    assert first[0] == cols[int(np.abs(vectors[:, 0]).argmax())]


def test_component_count():
    assert components.components_for([0.5, 0.3, 0.2], 0.8) == 2
    assert components.components_for([0.5, 0.3], 0.95) == 2


def test_reduction_keeps_scores_in_range(spark):
    pdf = separable()
    df = spark.createDataFrame(pdf)
    train, test = df.where("SubjectID <> 's0'"), df.where("SubjectID = 's0'")
    a, b, fitted = flows.reduce_with_pca(train, test, ["good", "noise", "copy"])
    values = a.unionByName(b).select(F.explode(vector_to_array("features")).alias("v"))
    low, high = values.agg(F.min("v"), F.max("v")).first()
    assert low == 0.0 and high == 1.0 and len(fitted.signs) == 3
