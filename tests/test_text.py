import pytest
from loomwork.functions import json as J
from loomwork.functions import numbers, secrets, text
from loomwork.operators import evidence
from pyspark.sql import functions as F


def one(spark, column, *values, names="abcdef"):
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n, _ in zip(names, values, strict=False)))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("given", "want"), [
    ("48,200", "48200"), ("7.310", "7310"), ("6,25", "6.25"), ("9.70", "9.7"), ("2.718.281", "2718281"), ("5,820.40", "5820.4"),
    ("5.820,40", "5820.4"), ("0.750", "0.75"),
    ("0042", "42"), ("000", "0"), ("21.43.65", "21.43.65"), ("8675.309", "8675.309"), ("0,875", "0.875"), ("600", "600"),
])
def test_canonical_numbers(spark, given, want):
    assert one(spark, numbers.canon_number(F.col("a")), given) == want


def test_numbers_in_text(spark):
    said = "1. In 2,031 there were 3.50 units (U-0001), P000123 and x12; S01.b02 fell by 7%."
    assert one(spark, numbers.extract_numbers(F.col("a")), said) == ["2031", "3.5", "7"]
    assert one(spark, numbers.extract_numbers(F.col("a"), True), "Two of twenty-one") == ["2", "20", "1"]


def test_unverified_numbers(spark):
    reports = spark.createDataFrame([(1, "3 of 40 in 2027, 2 more")], "k int, text string")
    sources = spark.createDataFrame([(1, "three or forty"), (1, "in 2026")], "k int, text string")
    assert {r.number for r in numbers.unverified_numbers(reports, sources, "k").collect()} == {"2027", "2"}
    assert {r.number for r in numbers.unverified_numbers(reports, sources, "k", 100).collect()} == {"2027"}


@pytest.mark.parametrize(("given", "want"), [
    ("  “Hello”  world… ", '"hello" world...'), ("co-\n op", "coop"), ("a—b c", "a-b c"), ("soft­hyphen Straße", "softhyphen strasse"),
])
def test_norm_for_match(spark, given, want):
    assert one(spark, text.norm_for_match(F.col("a")), given) == want


def test_composition_and_diacritics(spark):
    assert one(spark, text.nfc(F.col("a")), "é") == "é"
    assert one(spark, text.strip_diacritics(F.col("a")), "Đặng đo é") == "Dang do e"
    assert one(spark, text.strip_diacritics(F.col("a")), None) is None
    assert one(spark, text.slugify(F.col("a")), "  My Key -- #1 ") == "my-key-1"


def test_unverified_numbers_take_one_exchange_and_a_null_key_is_a_key(spark):
    reports = spark.createDataFrame([(None, "3 of 40"), (1, "1.234.5 of 1,000, 0 and 007"), (2, None)], "k int, text string")
    sources = spark.createDataFrame([(None, "three"), (1, "1.000 and 7"), (2, "5")], "k int, text string")
    found = numbers.unverified_numbers(reports, sources, "k")
    assert {tuple(r) for r in found.collect()} == {(None, "40"), (1, "0")}
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


@pytest.mark.parametrize(("quote", "para", "fuzzy", "want"), [
    ("The plan begins", "the PLAN  begins in 2027", False, "exact"), ("plan: begins", "The plan begins", False, "loose"),
    ("nothing", "The plan begins", False, "missing"),
    ("", "x", False, "missing"), ("x", None, False, "unknown_pid"),
    ("the project begin5 officially in may", "The project begins officially in May", True, "missing"),
    ("the projekt begins officially in the month of may", "The project begins officially in the month of May", True, "fuzzy"),
    ("the project begins officially in 2031", "The project begins officially in 2027", True, "missing"), ("shrt", "short", True, "missing"),
])
def test_quotes(spark, quote, para, fuzzy, want):
    e = spark.createDataFrame([("P1", quote)], "pid string, quote string")
    p = spark.createDataFrame([("P1" if para is not None else "P2", para or "")], "pid string, text string")
    assert evidence.verified(e, p, ["pid"], fuzzy).first().status == want


@pytest.mark.parametrize(("quote", "para", "want"), [
    ("pfzuä erж die und enbest bersch eintzü", "en pfzuä erß die und enbest bersch eintzü und zui", "fuzzy"),
    ("pfzuä eжж die und enbest bersch eintzü", "en pfzuä erß die und enbest bersch eintzü und zui", "missing"),
    ("pfzuä ERSS die und enbest berжch eintzü", "en pfzuä erß die und enbest bersch eintzü und zui", "fuzzy"),
])
def test_a_misread_letter_counts_once_if_folding_makes_two_of_it(spark, quote, para, want):
    e = spark.createDataFrame([("P1", quote)], "pid string, quote string")
    p = spark.createDataFrame([("P1", para)], "pid string, text string")
    assert evidence.verified(e, p, ["pid"], True).first().status == want


@pytest.mark.parametrize(("given", "want"), [
    ('Sure: {"a": [1, "}"]} tail', '{"a":[1,"}"]}'), ("<think>{x}</think>[1, 2]", "[1,2]"), ('```json\n{"k": "é"}\n```', '{"k":"é"}'),
    ('{"a": 1', None), ("none", None), (None, None),
])
def test_first_json(given, want):
    assert J.first_json(given) == want


def test_canonical_json(spark):
    assert one(spark, J.canonical_json(F.col("a")), '{"b": 1, "a": {"d": 2, "c": [1]}}') == '{"a":{"c":[1],"d":2},"b":1}'
    a, b = (one(spark, J.content_sha256(F.col("a")), x) for x in ('{"b":1,"a":2}', '{ "a": 2, "b": 1 }'))
    assert a == b and len(a) == 64


def test_split_keys(spark):
    given = "main|abc123, \"quoted-key\"; NAME = secretvalue99 Bearer token_x a=b"
    got = [(r["label"], r["key"]) for r in one(spark, secrets.split_keys(F.col("a")), given)]
    assert got == [("main", "abc123"), (None, "quoted-key"), ("NAME", "secretvalue99"), (None, "token_x"), (None, "a=b")]


@pytest.mark.parametrize(("given", "want"), [
    ("short", "too_short"), ("has a blank inside it", "invalid"), ("xxxxxxxxxxxxxxxxxxxx", "placeholder"), ("your-api-key-goes-here", "placeholder"),
    ("ababababababababab", "placeholder"),
    ("aaaaaaaaaaaaaaaabcdef", "placeholder"), ("sk-1234567890abcdefXYZ", "ok"), ("0123456789abcdefXYZ-nonmatching", "invalid"),
])
def test_secrets(spark, given, want):
    assert one(spark, secrets.classify_secret(F.col("a"), r"sk-[\w]+|x+|.*(?:key|abab|aaaa).*"), given) == want


def test_near_stretches_miss_none():
    import random

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *accumulated(x, b, row)]
        return row[-1]

    def accumulated(x, b, row):
        left = 0
        for j, y in enumerate(b):
            left = row[j] + 1 if x == y else max(left, row[j + 1])
            yield left

    dice = random.Random(7)
    for case in range(400):
        b = "".join(dice.choice("abcdefgh "[: 3 + case % 7]) for _ in range(dice.randrange(30, 90)))
        at, n = dice.randrange(len(b) // 3), dice.randrange(8, 60)
        a = list(b[at : at + n])
        for _ in range(dice.randrange(4)):
            i = dice.randrange(len(a))
            a[i : i + dice.randrange(2)] = dice.choice(["", "z", "a"])
        a = "".join(a) + "zz" * (case % 3 == 0)
        short, long = sorted((a, b), key=len)
        k = len(short)
        stretches = {long[max(0, i) : i + k] for i in range(1 - k, len(long))}
        want = max(200 * common(short, s) / (k + len(s)) for s in stretches)
        for least in (90.0, 95.0):
            assert evidence.best_ratio(a, b, least) == pytest.approx(want if want >= least else 0)
