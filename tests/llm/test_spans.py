import random
import re

from pyspark.sql import functions as F

from centrum.llm import personal_data, secret_scan

SECRETS = {
    "assign": (re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(1)) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 32),
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return 12 <= len(digits) <= 19 and total % 10 == 0


PERSONAL = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: luhn(m.group())),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(c.isdigit() for c in m.group()) <= 15),
}


def brute(text, rules):
    found = []
    for place, (kind, (pattern, fits)) in enumerate(rules.items()):
        found += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text or "") if fits(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def texts():
    r = random.Random(5)
    parts = [
        "token=", "Token: '", 'api_key" = "', "secret", "password =", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, "0123456789abcdef" * 2, "é😀", " ", "\n", "a@b.co", "x_y%+z@", "b.com_x@c.de",
        "10.0.0.255", "1.2.3.256", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44.20.7946.0958", "+", "7", "=", "abcdefgh1", "token:token=longvalue123", "0" * 40, "-", "1.2.3.0004", "._%", "@", ".", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789 ",
    ]
    rows = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(700)]
    return [*rows, None, "", "tokenſ=abcdefghij", "ToKeN=abcdefghij", "a" * 60_000, "1" * 60_000, "1 " * 30_000, "x@" * 20_000, "pre token=abcdefgh " * 3000, "a.b" * 20_000 + "@", "+1" * 20_000]


SCHEMA = "doc_id long, text string, source string, lang string, row int, kind string"


def check(spark, scan, rules):
    rows = [(i, t, f"s{i % 3}", "en", 1, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in scan(df).collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(texts()):
        assert [s for s in got[i] if s.split(":")[0] in rules] == brute(text, rules), (text or "")[:300]
    return got


def test_secret_spans_equal_plain_search(spark):
    check(spark, secret_scan.scan, SECRETS)


def test_personal_spans_equal_plain_search(spark):
    got = check(spark, personal_data.scan, PERSONAL)
    assert any("iban" in s for spans in got.values() for s in spans)
    assert any("ssn" in s for spans in got.values() for s in spans)


def test_owners_separate_examples_from_live_values(spark):
    rows = [(i, "password=hunter2hunter2", f"owner{i}", "a") for i in range(3)] + [(10, "password=onlymine99x", "owner1", "a"), (11, "password=onlymine99x", "owner1", "a"), (12, "token=changeme123", "owner1", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: [(s.live, s.owners, s.repositories) for s in r.spans] for r in secret_scan.scan(df, repo_col="lang").collect()}
    assert got == {0: [(False, 3, 3)], 1: [(False, 3, 3)], 2: [(False, 3, 3)], 10: [(True, 1, 1)], 11: [(True, 1, 1)], 12: [(False, 1, 1)]}


def test_provider_forms_are_added_only_if_live(spark):
    value = "ghp_" + "a1B2" * 9
    rows = [(1, f"see {value}", "a", "x")] + [(2 + i, "sk_live_" + "Zz9" * 6, f"o{i}", "x") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.scan(df).collect()}
    assert got == {1: ["provider"], 2: [], 3: [], 4: [], 5: []}


def test_null_and_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, source string, lang string"
    df = spark.createDataFrame([(None, None, None, None), (1, "token=abcdefgh", None, None), (1, "token=abcdefgh", None, None)], schema)
    assert sorted((r.doc_id or 0, len(r.spans)) for r in secret_scan.scan(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert sorted((r.doc_id or 0, len(r.spans)) for r in personal_data.scan(df).collect()) == [(0, 0), (1, 0), (1, 0)]
    for scan in (secret_scan.scan, personal_data.scan):
        assert scan(spark.createDataFrame([], schema)).collect() == []


def test_redaction_joins_overlapping_spans(spark):
    text = "é token=deadbeefdeadbeefdeadbeefdeadbeef end"
    df = spark.createDataFrame([(1, text, "a", "b")], "doc_id long, text string, source string, lang string")
    out = secret_scan.scan(df).join(df, "doc_id").select(secret_scan.redacted(F.col("text"), F.col("spans")).alias("t")).first().t
    assert out == "é <secret> end"
