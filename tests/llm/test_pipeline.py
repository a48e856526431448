"""The whole pipeline against brute force, stage by stage, on the smallest tables."""

import re
from collections import Counter

import public_tokenizers
from test_jaccard import by_hand as near_by_hand
from test_pii import by_hand as pii_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from epochwise.llm import quality

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def accepted(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if len(words) < 10 or 100 * repeat > 20 * len(words):
        return False
    value = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in quality.SYMBOLS),
        "n_stop_words": sum(len(w) < 6 and w.lower() in quality.STOP_WORDS for w in words),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_lines": len(lines),
        "n_repeat_words": repeat,
        "n_shouts": sum(w.endswith("!!") for w in words),
    }
    for rule in quality.RULES:
        ratio = value[rule.numerator] / value[rule.denominator]
        if len(words) >= rule.at_least and (ratio > rule.bound if rule.direction == "above" else ratio < rule.bound):
            return False
    return True


def redacted(text):
    out, at = "", 0
    for kind, start, end in pii_by_hand(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "ngram_jaccard", "personal_data", "best_fit_packing"
    ]


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect() if accepted(r.text)}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    texts = {min(g)[1]: texts[min(g)[1]] for g in groups.values()}
    texts = {i: texts[i] for i, _, c in near_by_hand(list(texts.items()), 5, 80, 100) if i == c}
    texts = {i: redacted(t) for i, t in texts.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: 1 + len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}

    rows = corpus_pipeline.run(spark, DIR).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert dict(got) == want
    bins = Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096 and len(bins) <= sum(want.values()) / 4096 * 1.05 + 1
    # All but the last stage keep the columns of documents.
    held = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        held = step(spark, held, DIR)
        assert held.columns == docs.columns


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
