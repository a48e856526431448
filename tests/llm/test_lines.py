import random
from collections import defaultdict

from epochwise.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def by_hand(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(SPACE)].add(site or "")
    out = []
    for i, text, _ in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if not x.strip(SPACE) or len(sites[x.strip(SPACE)]) < min_sites]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    pool = [f"shared line number {k} with enough characters in it" for k in range(30)]
    rows = []
    for i in range(600):
        own = [f"only in document {i}, line {k}, and long enough" for k in range(rng.randint(0, 4))]
        picked = [(" " * rng.randint(0, 2)) + p + "\t" * rng.randint(0, 1) for k, p in enumerate(pool) if rng.random() < 1 / (k + 2)]
        mixed = [*own, *picked, "short", ""]
        rng.shuffle(mixed)
        rows.append((i, "\n".join(mixed), f"s{min(rng.randrange(12), rng.randrange(12))}"))
    hot = "the very same boilerplate line on a great many pages"
    rows += [(1000 + i, hot, f"site {i}") for i in range(500)]
    rows += [(None, hot, None), (2, None, "s1"), (3, "", None), (4, (hot + "\n") * 3000, "s2"), (4, (hot + "\n") * 3000, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for least in (2, 5, 9):
        got = sorted((tuple(r) for r in lines.without_boilerplate(df, least).collect()), key=repr)
        assert got == by_hand(rows, least)


def test_short_lines_go_and_blank_lines_stay(spark):
    text = "All rights reserved.\n\n \t\nown {}\n a "
    df = spark.createDataFrame([(i, text.format(i), f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    got = sorted(tuple(r) for r in lines.without_boilerplate(df, 5).collect())
    assert got == [(i, 5, 2, f"\n \t\nown {i}") for i in range(6)]


def test_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, source string, line string, bad int"
    assert lines.without_boilerplate(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a\nb", "s", "x", 1), (1, "a\nb", "s", "x", 1)]
    got = lines.without_boilerplate(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, "a\nb")] * 2


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = lines.without_boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
