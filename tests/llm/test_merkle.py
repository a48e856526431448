import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from epochwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return digest(*map(field, row))


def levels(nodes):
    every = [nodes]
    while len(every[-1]) > 1:
        every.append([digest(*every[-1][i : i + 3]) for i in range(0, len(every[-1]), 3)])
    return every


def path(every, i):
    for nodes in every[:-1]:
        begin = i // 3 * 3
        yield "".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + 3])
        i //= 3


def by_hand(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        groups.setdefault(row[1], []).append(row)
    trees = {s: levels([leaf(r) for r in rs]) for s, rs in groups.items()}
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, row in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, place)]
            node = own = trees[s][0][i]
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                node = leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in steps:
                node = digest(left, node, right)
            proof = digest(*(left + right for left, right in steps))
            out.append((row[0], own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def found(df):
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return sorted((tuple(r) for r in merkle.dataset_manifest(df, changed).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 81, 82, 243, 700])
def test_one_source_of_any_size(spark, n):
    rows = [(i * 7 % 1009, "only", "en", i, f"line\n{i}") for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_many_sources_of_many_sizes(spark):
    """A hot source, a null one, sources of one row, and names that sort by their bytes."""
    rows = [(i, "hot", "de", None, f"a\nb{i}" if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, None, None, i, "no\nsource") for i in range(30)]
    rows += [(2000 + i, f"s{i}", "en", 1, "" if i % 2 else "x\n") for i in range(100)]
    rows += [(3000, "", "", 0, ""), (3001, "é", "fr", 2, "é\n"), (3002, "z", "en", 2, "z"), (3003, "😀", "en", 1, "t" * 200_000 + "\n")]
    rows += [(-4, "￿", "en", -1, "-"), (-5, "=", "en", -1, "1:-")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(6)) == by_hand(rows)


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "a", "en", 1, "x\ny")] * 5 + [(None, "a", None, None, None), (2, "b", None, 3, "t")]
    extra = SCHEMA + ", digest string, grp int, rank int, `a.b` int, page int, path int"
    df = spark.createDataFrame([(*r, "?", 1, 2, 3, 4, 5) for r in rows], extra)
    assert found(df) == by_hand(rows)


def test_nothing_changed_is_verified(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"t\n{i}") for i in range(50)]
    assert all(r.verified for r in merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA)).collect())


def test_equal_subtrees_share_a_page(spark):
    """The store is addressed by content: two groups of equal leaves have one page."""
    leaves = [(g, digest(str(i)), i) for g in ("x", "y") for i in range(30)]
    tree, _ = merkle.build_trees(spark.createDataFrame(leaves, "grp string, digest string, row long"), ["row"])
    assert tree.store.count() == 1 and tree.tops.count() == 2


def test_few_requests(spark):
    """A descent for some leaves reads the same proofs, from pages on their ways only."""
    digests = [digest(str(i)) for i in range(500)]
    leaves = spark.createDataFrame([("g", d, i) for i, d in enumerate(digests)], "grp string, digest string, row long")
    tree, _ = merkle.build_trees(leaves, ["row"])
    starts = spark.createDataFrame([("g",)], "grp string").selectExpr(
        "grp", "cast(array() as array<struct<l: string, r: string>>) AS path", "'' AS top"
    )
    asked = spark.createDataFrame([("g", 3, 3), ("g", 499, 499)], "grp string, rank long, carried long")
    got = {r.carried: (r.digest, [tuple(p) for p in r.path]) for r in merkle.descend(tree, starts, asked).collect()}
    every = levels(digests)
    assert got == {i: (digests[i], list(path(every, i))) for i in (3, 499)}
