import importlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.test_rules import texts
from veilsift.operators.redact import apply_replacements, outbound_filter, redact
from veilsift.rules import LATE_REDACTION_RULES, SAFE_REFERENCES
from workloads.views import PLANTED

SK = "sk" + "-Qr5tW8xZ2mB7nC4vL9kJ1hG6fD3sA0pY"
URL = "mysql:" + "//svc:t0psecret@orders.brightshop.org:3306/orders"
MAIL = "noor" + "@brightshop.org"
EXAMPLE = "\n".join([
    f"api_key: '{SK}'", f"- orders = {URL}", f"- contact = {MAIL}", "- token = os.environ['ORDERS_TOKEN']",
])
EXPECTED = "\n".join([
    "api_key: [REDACTED:sk-key]", "- orders = mysql[REDACTED:credentials-in-url]:3306/orders",
    "- contact = [REDACTED:pii-email]", "- token = os.environ['ORDERS_TOKEN']",
])


def run(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    return [r for r in redact(df, "t").orderBy("id").collect()]


def test_documented_example(spark):
    row = run(spark, [EXAMPLE])[0]
    assert row.redacted == EXPECTED and row.has_high


def test_empty_and_null(spark):
    empty, null = run(spark, ["", None])
    assert empty.redacted == "" and empty.findings == [] and not empty.has_high
    assert null.redacted is None


def test_replacement_is_global(spark):
    mail = "ann.lee" + "@acme.net"
    row = run(spark, [f"m = {mail}\nx = process.env.MAIL // {mail}"])[0]
    assert row.redacted.count("[REDACTED:pii-email]") == 2 and len(row.findings) == 1


def test_edge_lines(spark):
    rows = run(spark, [PLANTED[i] for i in (43, 44, 45, 48, 49)])
    assert [r.redacted for r in rows[:3]] == [PLANTED[i] for i in (43, 44, 45)]
    assert rows[3].redacted.endswith("m = [REDACTED:pii-email]")
    assert rows[4].redacted == "passwd = [REDACTED:sk-key]"
    assert [f.rule_id for f in rows[4].findings] == ["sk-key", "cred-generic-secret"]


def test_against_model(spark):
    rng = random.Random(17)
    pool = texts(1500, seed=29)
    values = ["\n".join(rng.choices(pool, k=rng.randint(1, 8))) for _ in range(700)]
    found = 0
    for value, row in zip(values, run(spark, values)):
        text, findings = model.redact(value)
        found += len(findings)
        assert [(f.rule_id, f.matched_text) for f in row.findings] == findings, value
        assert row.redacted == text, value
    assert found > 400


def test_many_copies_of_one_value(spark):
    value = "\n".join(["p = 415-" + "867-5309"] * 3000)
    row = run(spark, [value])[0]
    assert len(row.findings) == 3000 and "867" not in row.redacted


def test_redacting_twice_adds_nothing(spark):
    # the token of the contract-number rule reads like a contract number itself
    values = [p for i, p in enumerate(PLANTED) if i != 37]
    once = [r.redacted for r in run(spark, values)]
    assert [r.redacted for r in run(spark, once)] == once


@pytest.mark.parametrize("mode,expected", [
    ("redact", {0: "redacted", 1: "redacted", 2: "clean"}),
    ("block", {0: "blocked", 1: "redacted", 2: "clean"}),
    ("warn", {0: "warned", 1: "warned", 2: "clean"}),
    ("off", {0: "off", 1: "off", 2: "off"}),
    ("Unknown", {0: "redacted", 1: "redacted", 2: "clean"}),
])
def test_modes(spark, mode, expected):
    values = [EXAMPLE, "m = ann.lee" + "@acme.net", "nothing"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    rows = outbound_filter(df, "t", mode).orderBy("id").collect()
    assert {r.id: r.outbound_status for r in rows} == expected
    for r in rows:
        if r.outbound_status == "blocked":
            assert r.outbound_text is None
        elif r.outbound_status == "redacted":
            assert "[REDACTED:" in r.outbound_text
        else:
            assert r.outbound_text == values[r.id]
    if mode == "redact":
        assert rows[0].outbound_rules == (
            "sk-key, credentials-in-url, pii-email, cred-generic-secret")


def test_hostile_texts_are_linear_and_do_not_recurse(spark):
    mail = "b" + "@c.de"
    values = [
        "12" + " Aaaa" * 20000 + " x",
        "12" + " Aaaa" * 20000 + " Ave",
        "a" * 60000 + " " + mail,
        "ab." * 20000 + "@ x" + mail,
        "1" * 100000,
        'password="' + "😀a" * 30000,
        " " * 100000 + ":=",
    ]
    rows = run(spark, values)
    assert rows[0].findings == []
    assert rows[1].redacted == "[REDACTED:pii-address]"
    assert [f.matched_text for f in rows[2].findings] == [mail]
    assert [f.matched_text for f in rows[3].findings] == ["x" + mail]


def test_street_addresses(spark):
    values = ["12 Main St Oak Ave Foo", "12 St Ave", "9 Oak Stone", "7 Ave", "12 Elm St-James x",
              "123456 Elm Rd", "x12 Elm Rd", "12 Elm Rd 14 Oak Ct", "5 Maple  Grove\tLn, 6 A B Dr"]
    for value, row in zip(values, run(spark, values)):
        text, findings = model.redact(value)
        assert (row.redacted, [(f.rule_id, f.matched_text) for f in row.findings]) == (
            text, findings), value


def in_turn(text, findings, protect):
    """The plain meaning: value by value over the whole text (or over its open lines)."""
    done = set()
    for rule_id, value in sorted(findings, key=lambda f: (f[0] in LATE_REDACTION_RULES, -len(f[1]))):
        if value in done:
            continue
        done.add(value)
        lines = text.split("\n") if protect else [text]
        text = "\n".join(
            line if protect and any(s in line for s in SAFE_REFERENCES) else line.replace(value, f"[REDACTED:{rule_id}]")
            for line in lines
        )
    return text


def replaced(spark, cases, protect):
    df = spark.createDataFrame(
        [(i, t, [{"rule_id": r, "matched_text": m} for r, m in f]) for i, (t, f) in enumerate(cases)],
        "id int, t string, f array<struct<rule_id string, matched_text string>>",
    )
    out = df.select("id", apply_replacements(F.col("t"), F.col("f"), protect).alias("r"))
    return [r.r for r in out.orderBy("id").collect()]


@pytest.mark.parametrize("protect", [False, True])
def test_many_values_equal_value_by_value(spark, monkeypatch, protect):
    """Values that overlap, lie in tokens, hold brackets or cut characters; safe lines in between."""
    module = importlib.import_module("veilsift.operators.redact")
    monkeypatch.setattr(module, "FEW_VALUES", 0)
    monkeypatch.setattr(module, "_PIECE", 9)
    rng = random.Random(3)
    parts = ["a", "b", "ab", " ", ",", "sk", "-key", "[", "]", ":", "RED", "ED:s", "é", "\U0001f600", "=", "x9" * 7, "]a", "t[R"]
    rules = ["sk-key", "pii-email", "cred-generic-secret"]
    cases = []
    for _ in range(400):
        line = lambda: "".join(rng.choices(parts, k=rng.randrange(12)))
        lines = [line() + (SAFE_REFERENCES[0] + "x" + line() if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, 90))]
        values = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        cases.append(("\n".join(lines), [(rng.choice(rules), v) for v in values]))
    for got, case in zip(replaced(spark, cases, protect), cases):
        assert got == in_turn(*case, protect), case


def test_many_values_in_a_long_text(spark):
    phones = [f"415-867-{i:04d}" for i in range(10_000)]
    keys = [f"AKIA{i * 7919:016d}" for i in range(10_000)]
    one_line = '{"p":"' + '","p":"'.join(phones) + '"}' + "," * 800_000
    lines = "\n".join(f"key {i} = '{k}' and again {keys[i - 1]} " + "z" * 50 for i, k in enumerate(keys))
    cases = [(one_line, [("pii-phone-us", p) for p in phones]), (lines, [("aws-key", k) for k in keys])]
    began = time.time()
    got = replaced(spark, cases, False)
    assert time.time() - began < 60
    assert got[0] == '{"p":"' + '","p":"'.join(["[REDACTED:pii-phone-us]"] * 10_000) + '"}' + "," * 800_000
    assert "AKIA" not in got[1] and got[1].count("[REDACTED:aws-key]") == 20_000


def test_safe_lines_stay_if_protected(spark):
    text = f"m = {MAIL}\nn = process.env.MAIL // {MAIL}\no = {MAIL}"
    df = spark.createDataFrame([(text,)], "t string")
    both = [redact(df, "t", protect_safe_lines=p).first().redacted.split("\n") for p in (False, True)]
    assert [MAIL in x for x in both[0]] == [False] * 3 and [MAIL in x for x in both[1]] == [False, True, False]
    sent = outbound_filter(df, "t", protect_safe_lines=True).first()
    assert sent.outbound_text == "\n".join(both[1]) and sent.outbound_status == "redacted"
