import random

from pyspark.sql import functions as F

from epochwise.functions.columns import unfold
from epochwise.operators.numbering import number_by_chunk, number_by_hash, number_by_range


def expected_numbers(rows):
    out, seen = {}, {}
    for key, order in sorted(rows):
        out[(key, order)] = seen.get(key, 0)
        seen[key] = out[(key, order)] + 1
    return out


def test_one_group_holding_most_rows(spark):
    random.seed(1)
    rows = [("hot" if i % 5 else f"k{i % 3}", random.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, at double").repartition(7)
    numbered, totals = number_by_range(df, ["key"], ["at"], "n")
    got = {(r["key"], r["at"]): r["n"] for r in numbered.collect()}
    assert got == expected_numbers(rows)
    sizes = {r["key"]: r["rows"] for r in totals.collect()}
    assert sizes["hot"] == sum(k == "hot" for k, _ in rows)


def test_chunks_and_totals(spark):
    rows = [("a", i) for i in range(0, 500, 3)] + [("b", 7)]
    df = spark.createDataFrame(rows, "key string, at long")
    numbered = number_by_chunk(df, ["key"], F.floor(F.col("at") / 10), ["at"], "n", "of")
    got = {(r["key"], r["at"]): r["n"] for r in numbered.collect()}
    assert got == expected_numbers(rows)
    assert {r["of"] for r in numbered.where("key = 'a'").collect()} == {len(rows) - 1}


def test_hash_order(spark):
    df = spark.range(300).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("id"))
    numbered = number_by_hash(df, ["key"], F.md5("id"), ["id"], "n")
    got = [r["id"] for r in numbered.orderBy("n").collect()]
    by_hash = [r["id"] for r in df.orderBy(F.md5("id")).collect()]
    assert got == by_hash


def test_unfold_crosses_chunks(spark):
    df = spark.createDataFrame([(1, 4090, 12_300), (2, 5, 4)], "id int, lo long, hi long")
    got = sorted(r["v"] for r in unfold(df, F.col("lo"), F.col("hi"), "v").collect())
    assert got == list(range(4090, 12_301))
