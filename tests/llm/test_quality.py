import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from epochwise.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum((text or "").count(c) for c in quality.SYMBOLS),
        len(lines) - len(set(lines)),
        len(covered),
    )


def verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in quality.quality_verdicts(df).orderBy("doc_id").collect()]


def counts(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)


def test_counts_match_brute_force(spark):
    prose = "one two three four five six seven eight nine ten eleven twelve of the"
    texts = [
        None,
        "",
        " \n\t\x0b\x0c\r ",
        "a",
        prose,
        prose + "\n" + prose,
        "x " * 40,
        "a b c d e a b c d e f",
        "line\n\nline\nline \n# * $\n#",
        "Füße\xa0und\x85andere 😀 fff\n" * 3,
        "w%d " * 3000,
        " ".join(f"w{i % 700}" for i in range(30_000)),
    ]
    assert [counts(r) for r in verdicts(spark, texts)] == [by_hand(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab# \n\t", max_size=60), min_size=1, max_size=30))
def test_counts_match_brute_force_on_any_text(spark, texts):
    assert [counts(r) for r in verdicts(spark, texts)] == [by_hand(t) for t in texts]


def test_verdicts(spark):
    prose = " ".join(f"word{i} of" for i in range(50)) + " the"
    symbols = " ".join(f"word{i}###" for i in range(50))
    stopless = " ".join(f"word{i}" for i in range(100))
    got = verdicts(spark, [prose, symbols, stopless, "too short", prose + " " + prose])
    assert [r.kept for r in got] == [True, False, False, False, False]
    assert [r.base_failed for r in got] == [False, False, False, True, True]
    assert got[1].failed_rules == ["symbols_per_word"]
    assert got[2].failed_rules == ["stop_word_share"]


def test_empty_table_repeats_nulls_and_clashing_columns(spark):
    schema = "doc_id long, text string, n_words string, w int, l int, `a.b` int"
    assert quality.quality_verdicts(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "x", 1, 2, 3), (7, "a b", "x", 1, 2, 3), (7, "a b", None, 1, 2, 3)]
    got = quality.quality_verdicts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 2, False), (7, 2, False), (7, 2, False)]


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.quality_verdicts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_accepted_keeps_whole_rows(spark):
    prose = " ".join(f"word{i} of" for i in range(20))
    df = spark.createDataFrame([(1, prose, "s"), (2, "bad", "s")], "doc_id long, text string, `kept.x` string")
    got = quality.accepted(df)
    assert got.columns == df.columns
    assert [r.doc_id for r in got.collect()] == [1]
