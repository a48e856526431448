"""Exact nearest neighbours between two tables of vectors.

References lie in the cells of an index (``cells.py``), so a query meets only those rows
that the triangle inequality does not rule out. No table of pairs ever exists and no
group depends on how often a subject or label occurs. Results do not depend on the index.

Input columns: ``key`` (unique string), ``label`` (int), ``values``
(array<double>) and ``grp`` (string): a query never meets references of its own
``grp``; NULL excludes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from epochwise.operators import cells
from epochwise.storage import stage

# The grid of the nearest-neighbour classifier.
K_VALUES = (1, 2, 3, 5, 7, 9, 11)
METRICS = ("euclidean", "manhattan")
WEIGHTS = ("uniform", "distance")

_OWN = "key string, dist double"
_NEARER = "key string, place int"


def nearest(
    queries: DataFrame, refs: DataFrame, k: int, metrics: Sequence[str] = METRICS, work: Accumulator | None = None
) -> DataFrame:
    """The k nearest references: key, metric, place (1..k), dist, ref_key, ref_label.

    ``work`` adds up the pairs that were compared.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    # Written once: both sides are counted and read several times.
    stored = stage(queries, "queries")
    index = cells.build_index(stored if refs is queries else stage(refs, "references"), metrics)
    if index is None:
        schema = "key string, metric string, dist double, ref_key string, ref_label int, place int"
        return queries.sparkSession.createDataFrame([], schema)
    asked = stored.select("key", F.col("label").cast("int").alias("label"), "grp", "values", F.lit(False).alias("both"))
    # Written as lists, so that no reader searches anew.
    lists = cells.search(asked, index, k, work).where("first").select("key", "metric", "dist", "ref_key", "ref_label")
    one = F.posexplode(F.arrays_zip("dist", "ref_key", "ref_label")).alias("place", "ref")
    return stage(lists, "neighbours").select("key", "metric", one).select("key", "metric", "ref.*", (F.col("place") + 1).alias("place"))


def by_role(train: DataFrame, test: DataFrame, k: int, metrics: Sequence[str] = METRICS) -> DataFrame:
    """The k nearest training rows in three roles at once, found in one search.

    Training rows meet all other folds (part cv) and all training rows, themselves
    included (train), in one comparison; test rows meet all training rows (test). ``train``
    (with fold), a written table, and ``test`` have EpochID, label and values. Returns a row
    for each key of a part, metric, fold (-1 but for cv) and label, with lists dist and
    ref_label, nearest first. Each action searches anew.
    """
    refs = train.select(F.col("EpochID").alias("key"), F.col("label").cast("int").alias("label"), F.col("fold").cast("string").alias("grp"), "values")
    index = cells.build_index(refs, metrics)
    if index is None:
        schema = "key string, metric string, part string, fold int, label int, dist array<double>, ref_label array<int>"
        return train.sparkSession.createDataFrame([], schema)

    def role(df: DataFrame, part: str, grp: Column, both: bool) -> DataFrame:
        key = F.concat(F.lit(f"{part}:"), F.col("key"))
        return df.select(key.alias("key"), F.col("label").cast("int").alias("label"), grp.cast("string").alias("grp"), "values", F.lit(both).alias("both"))

    queries = role(refs, "train", F.col("grp"), True).unionByName(role(test.withColumnRenamed("EpochID", "key"), "test", F.lit(None), False))
    part = F.substring_index("key", ":", 1)
    part = F.when((part == "train") & ~F.col("everyone"), F.lit("cv")).otherwise(part)
    fold = F.when(part == "cv", F.col("grp").cast("int")).otherwise(-1)
    return (
        cells.search(queries, index, k)
        .where("key IS NOT NULL")
        .select("key", "metric", part.alias("part"), fold.alias("fold"), "label", "dist", "ref_label")
    )


def vote(
    found: DataFrame,
    k_values: Sequence[int] = K_VALUES,
    weights: Sequence[str] = WEIGHTS,
) -> DataFrame:
    """Predictions of all (metric, k, weights) at once: key, metric, k, weights, prediction.

    ``distance`` weighs by 1/dist; if a neighbour lies at distance 0, only such
    neighbours count. Ties go to the smaller label.
    """
    one = F.struct("place", "dist", "ref_label")
    lists = found.groupBy("key", "metric").agg(F.array_sort(F.collect_list(one)).alias("_found"))
    lists = lists.select("key", "metric", F.col("_found.dist").alias("dist"), F.col("_found.ref_label").alias("ref_label"))
    return vote_lists(lists, ["key", "metric"], k_values, weights)


def vote_lists(
    lists: DataFrame,
    keep: Sequence[str],
    k_values: Sequence[int] = K_VALUES,
    weights: Sequence[str] = WEIGHTS,
) -> DataFrame:
    """The same for rows that hold their neighbours as lists dist and ref_label, nearest first; no row moves.

    Columns ``keep`` go with the predictions.
    """
    kept = lists.select(*keep).schema
    asked = [(int(k), w) for k in k_values for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _ballots(batch["dist"], batch["ref_label"], asked)
            offsets = pa.array(np.arange(len(batch) + 1) * len(asked), pa.int32())
            names = [f.name for f in kept]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.ListArray.from_arrays(offsets, found)], [*names, "_found"])

    voted = lists.select(*keep, "dist", "ref_label").mapInArrow(run, StructType([*kept, StructField("_found", ArrayType(IntegerType()))]))
    ballots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights")) for k, w in asked])
    picks = F.arrays_zip(ballots.alias("_asked"), F.col("_found").alias("prediction"))
    return voted.select(*keep, F.explode(picks).alias("_pick")).select(*keep, "_pick._asked.k", "_pick._asked.weights", "_pick.prediction")


def _ballots(dist: pa.ListArray, label: pa.ListArray, asked: Sequence[tuple[int, str]]) -> pa.Array:
    """The label that each (k, weights) asked for picks of each row, one row after the other."""
    sizes = np.diff(dist.offsets.to_numpy())
    width = int(sizes.max(initial=1))
    filled = np.arange(width) < sizes[:, None]
    d, of = np.full(filled.shape, np.nan), np.full(filled.shape, np.nan)
    d[filled], of[filled] = dist.flatten().to_numpy(zero_copy_only=False), label.flatten().to_numpy(zero_copy_only=False)
    # A missing label is one of its own, and loses ties.
    of[filled & np.isnan(of)] = np.inf
    same = of[:, :, None] == of[:, None, :]
    with np.errstate(divide="ignore"):
        inverse = np.where(d == 0, 0.0, 1 / d)
    out = np.empty((len(d), len(asked)))
    for at, (k, weights) in enumerate(asked):
        used = same[:, :, :k] & filled[:, None, :k]
        if weights == "uniform":
            score = used.sum(axis=2).astype(float)
        else:
            # With neighbours at distance 0 their number decides alone.
            zero = (used & (d == 0)[:, None, :k]).sum(axis=2).astype(float)
            score = np.where(used, inverse[:, None, :k], 0.0).sum(axis=2)
            score = np.where((zero > 0).any(axis=1, keepdims=True), zero, score)
        score[:, k:] = -np.inf
        score[~filled] = -np.inf
        best = score == score.max(axis=1, keepdims=True)
        out[:, at] = np.where(best & filled, of, np.inf).min(axis=1)
    none = np.isinf(out)
    return pa.array(np.where(none, 0, out).astype(np.int32).ravel(), mask=none.ravel())


def _own_distance(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(key, dist): each query's nearest reference of its own subject, in blocks of bounded size."""
    sizes = refs.groupBy("label").agg(F.count(F.lit(1)).alias("_r")).join(
        queries.groupBy("label").agg(F.count(F.lit(1)).alias("_q")), "label"
    )
    sizes = stage(
        sizes.selectExpr(
            "label",
            f"cast(ceil(_r / {cells.BLOCK_ROWS}) as int) AS _rs",
            f"cast(ceil(_q / {cells.BLOCK_ROWS}) as int) AS _qs",
        ),
        "subject-blocks",
    )

    def dealt(df: DataFrame, own: str, n: str, others: str, m: str) -> DataFrame:
        return (
            df.join(sizes, "label")
            .withColumn(own, F.pmod(F.xxhash64("key"), F.col(n)))
            .withColumn(others, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
            .select("key", "label", "values", F.col("_rb").cast("long"), F.col("_qb").cast("long"))
        )

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame(columns=["key", "dist"])
        a, b = cells.matrix(q["values"]), cells.matrix(r["values"])
        best = np.empty(len(a))
        for tile in cells.tiles(len(a), len(b)):
            rough, slack = cells.ROUGH["euclidean"](a[tile], b)
            i, j = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
            best[tile] = pd.Series(cells.exact("euclidean", a[tile][i], b[j])).groupby(i).min().to_numpy()
        return pd.DataFrame({"key": q["key"], "dist": best})

    by = ["label", "_rb", "_qb"]
    found = (
        dealt(queries, "_qb", "_qs", "_rb", "_rs")
        .groupBy(*by)
        .cogroup(dealt(refs, "_rb", "_rs", "_qb", "_qs").groupBy(*by))
        .applyInPandas(compare, _OWN)
    )
    return found.groupBy("key").agg(F.min("dist").alias("tau"))


def identification_recall(
    train: DataFrame, test: DataFrame, ranked: DataFrame, max_subjects: int
) -> DataFrame:
    """Macro recall of 1-NN subject identification among the first 2..N subjects.

    ``ranked`` gives each SubjectID its ``place`` 1..N; train and test hold
    key, SubjectID and values. The distance to a query's own subject is found first. Only
    references within it matter: as subjects are added one by one, a query is right from
    its own place until the first subject that comes nearer. At equal distance the
    subject of the smaller place counts as nearer.
    """
    places = F.broadcast(ranked.select("SubjectID", "place"))  # at most N rows

    def ready(df: DataFrame) -> DataFrame:
        return df.join(places, "SubjectID").select(
            "key", F.col("place").alias("label"), F.lit(None).cast("string").alias("grp"), "values"
        )

    queries, refs = stage(ready(test), "queries"), stage(ready(train), "references")
    index = cells.build_index(refs, ["euclidean"])
    own = queries.join(_own_distance(queries, refs), "key")

    def compare(q: pd.DataFrame, r: pd.DataFrame, of: cells.Cells) -> pa.Table:
        places, own_place = r["label"].to_numpy(), q["label"].to_numpy()
        tau, first = q["tau"].to_numpy(), np.full(len(q), np.iinfo(np.int32).max)
        for i, j, dist in cells.nearer(q, r, of):
            before = (places[j] < own_place[i]) | ((places[j] > own_place[i]) & (dist < tau[i]))
            np.minimum.at(first, i[before], places[j][before])
        met = first < np.iinfo(np.int32).max
        return pa.table({"key": pa.array(q["key"].to_numpy()[met], pa.string()), "place": pa.array(first[met], pa.int32())})

    records = own.select("key", "label")
    if index is not None:
        beaten = cells.within(stage(own, "own-distances"), index, compare, _NEARER)
        first = beaten.groupBy("key").agg(F.min("place").alias("_first"))
        records = records.join(first, "key", "left").select(
            "key", "label", (F.coalesce("_first", F.lit(max_subjects + 1)) - 1).alias("until")
        ).where("until >= label")
    else:
        records = records.withColumn("until", F.col("label"))
    # From here on at most N * N rows.
    right_until = (
        queries.select("key", "label")
        .join(records, ["key", "label"])
        .groupBy("label", "until")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    totals = queries.groupBy("label").agg(F.count(F.lit(1)).alias("support"))
    hits = (
        right_until.withColumn(
            "n", F.explode(F.sequence(F.greatest("label", F.lit(2)), F.greatest("until", F.lit(2))))
        )
        .where(F.col("n") <= F.col("until"))
        .groupBy("label", "n")
        .agg(F.sum("hits").alias("hits"))
        .join(totals, "label")
        .groupBy("n")
        .agg(F.sum(F.col("hits") / F.col("support")).alias("_sum"))
    )
    sizes = ranked.agg(F.max("place").alias("_n")).select(
        F.explode(F.sequence(F.lit(2), F.col("_n"))).alias("n")
    )
    return sizes.join(hits, "n", "left").select(
        F.col("n").alias("Num_Subjects"),
        (F.coalesce(F.col("_sum"), F.lit(0.0)) / F.col("n")).alias("Recall"),
    )


def ranked_subjects(df: DataFrame, max_subjects: int | None = None, seed: int = 42) -> DataFrame:
    """All subjects, or the first N, in a reproducible random order with their place from 1."""
    mixed = F.md5(F.concat_ws("|", "SubjectID", F.lit(str(seed))))
    chosen = df.select("SubjectID").distinct()
    if max_subjects is not None:
        chosen = chosen.orderBy(mixed, "SubjectID").limit(max_subjects)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(mixed, "SubjectID")))
