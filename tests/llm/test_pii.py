import hashlib
import re

from epochwise.llm import pii

# The base patterns as stated, for the brute-force version.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def by_hand(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def check(row, text):
    want = by_hand(text)
    written = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
    assert row.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), (text[:200], written, row.spans)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]
    base = [s for s in row.spans.split(",") if s and not s.startswith("context")]
    assert ",".join(base) == written


TEXTS = [
    None, "", "plain", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é😀 a@b.c_d@e.f.g x@y z@@w.de @a.b a.@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.2.3 1.2.3 99999999999999999999.1.1.1", "+1 (555) 123-4567, +49.30.1234567890 +1 2",
    "4111111111111111 4111  1111 1111 1111", "12345678901234567890123", "49927398716 4992739871600 79927398713000000",
    "+1 555 123 4567 4111 1111 1111 1111+1 555 123 45678", "a" * 60_000 + "@" + "b" * 1000 + ".c", "1 " * 30_000,
    "1." * 20_000, "9" * 50_000, "a.b@c.d " * 300, "+1 ((((((((((( 5551234567)", "x@a.b@c.d.e@f.g",
]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in pii.personal_data(df).collect():
        check(row, TEXTS[row.doc_id])


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.personal_data(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        check(row, texts[row.doc_id])


def test_contexts_find_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004"]
    texts = [f"bla bla kontonr {c} danke" for c in cards]
    texts += ["kontonr DE44-5001-0517 rest", 'und kontonr "77-AX-90210", ok', "nummer 77-AX-90210 allein", "kein 123456789 hier"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[4] == "context:8:22" and texts[4][8:22] == "DE44-5001-0517"
    assert got[5] == "context:13:24" and got[6] == "context:7:18"  # a known value counts wherever it stands
    assert got[7] == ""
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[0] == "bla bla kontonr [CARD] danke" and clean[5] == 'und kontonr "[CONTEXT]", ok' and clean[7] == texts[7]


def test_discovered_identifiers_support_patterns_of_their_own(spark):
    # Each word stands before the identifiers of two groups; only the first group has seeds.
    def card(i):
        digits = f"411111111111{i:03d}"
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    groups = [[card(i) for i in range(40)]] + [[f"ID-{k}-{i:04d}x" for i in range(n)] for k, n in enumerate((20, 10, 5))]
    words = ["kontonr", "akte", "vorgang"]
    texts = [f"{w} {v}" for k, w in enumerate(words) for v in groups[k] + groups[k + 1]]
    texts += [f"menge {i}-55-777-{i}" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    for i, text in enumerate(texts):
        assert got[i].startswith("context") == (" ID-" in text), text


def test_redacted_keeps_rows_and_columns(spark):
    rows = [(1, "x a@b.de y +1 555 123 4567 z", "k"), (None, None, "k"), (2, "é 1.2.3.4", None), (2, "é 1.2.3.4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ents string")
    left = pii.redacted(df)
    assert left.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "", r.ents or "") for r in left.collect())
    assert got == [(0, "", "k"), (1, "x [EMAIL] y [PHONE] z", "k"), (2, "é [IP]", ""), (2, "é [IP]", "")]


def test_nulls_repeats_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, spans string, ents int"
    assert pii.personal_data(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (1, None, None, 1)]
    got = pii.personal_data(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in got) == [(0, 1), (1, 0), (1, 1), (1, 1)]


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.personal_data(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
