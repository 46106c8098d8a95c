"""Scalar functions against the standard library."""

import random
import unicodedata
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money, text
from ledgerlens.operators import concepts

MONEY_CASES = {
    "874.25": "874.25", "$9,316.07": "9316.07", "PHP 44,018.9": "44018.9", "62,007.3": "62007.3",
    "(3,481.66)": "-3481.66", "no amount": None, "-$5": None, "$(5)": None, "($5)": "-5", "5.": None, ".5": "0.5",
    "1e5": None, "+5": "5", "007": "7", "-0.00": "-0.00", "(0.00)": "0.00", "(-5)": "5", "()": None, "(": None,
    "€ 1": "1", "₱1,2,3": "123", "£-5": "-5", "1 000": None, "٣٤": "34", " 5 ": "5", "( 5 )": "-5",
    "PHP": None, "--5": None, "(PHP 3)": "-3", "\x1f3\x1c": "3", "": None, "   ": None, "$$5": None, "5\n": "5",
}


def test_money(spark):
    rows = spark.createDataFrame([(v,) for v in MONEY_CASES], "v STRING").select("v", money.parse("v").alias("p")).collect()
    assert {r.v: r.p.text for r in rows} == MONEY_CASES
    for row in rows:
        assert row.p.value == (None if row.p.text is None else Decimal(row.p.text))
        assert row.p.valid == (row.p.text is not None)


def test_number_takes_no_symbol(spark):
    df = spark.createDataFrame([("$5",), ("(5)",), ("1,000",), (None,)], "v STRING")
    assert [r[0] for r in df.select(money.parse_number("v")).collect()] == [None, Decimal(-5), Decimal(1000), None]


def test_number_too_large_is_valid_without_value(spark):
    row = spark.createDataFrame([("9" * 40,)], "v STRING").select(money.parse("v").alias("p")).first().p
    assert row.valid and row.value is None and row.text == "9" * 40


def test_number_too_fine_is_never_rounded(spark):
    cases = {"5.00000000001": None, "5.00000000000": Decimal(5), "0.0000000001": Decimal("0.0000000001"), "-1.12345678905": None}
    rows = spark.createDataFrame([(v,) for v in cases], "v STRING").select("v", money.parse("v").alias("p")).collect()
    assert {r.v: r.p.value for r in rows} == cases and all(r.p.valid for r in rows)
    whole = spark.createDataFrame([("9" * 40,), ("5.00",), ("5.00000000001",)], "v STRING").select(money.is_whole(F.col("v"))).collect()
    assert [r[0] for r in whole] == [True, True, False]


def test_scale(spark):
    df = spark.createDataFrame([("12.50",), ("12",), ("-0.125",)], "v STRING")
    assert [r[0] for r in df.select(money.scale_of(F.col("v"))).collect()] == [2, 0, 3]


# text: (moment, label), None for no date, or "ambiguous"; worked out by hand
DATES = {
    "2031-04-09": ("2031-04-09 00:00:00", "%Y-%m-%d"),
    "20310409": ("2031-04-09 00:00:00", "%Y-%m-%d"),
    " 2031-04-09\t": ("2031-04-09 00:00:00", "%Y-%m-%d"),
    "2028-02-29": ("2028-02-29 00:00:00", "%Y-%m-%d"),
    "2031-02-29": None,
    "2031-04-31": None,
    "2031-13-01": None,
    "0000-05-05": None,
    "2031": None,
    "2031-04": None,
    "2031-099": None,
    "2031-W15": ("2031-04-07 00:00:00", "%Y-%m-%d"),
    "2031-W15-3": ("2031-04-09 00:00:00", "%Y-%m-%d"),
    "2031W153": ("2031-04-09 00:00:00", "%Y-%m-%d"),
    "2031-W00-1": None,
    "2031-W53-1": None,
    "2032-W53-6": ("2033-01-01 00:00:00", "%Y-%m-%d"),
    "2031-W15-8": None,
    "2031-04-09T": None,
    "2031-04-09T17": ("2031-04-09 17:00:00", "ISO-8601"),
    "2031-04-09T17:45": ("2031-04-09 17:45:00", "ISO-8601"),
    "2031-04-09T174530": ("2031-04-09 17:45:30", "ISO-8601"),
    "2031-04-09 17:45:30.25": ("2031-04-09 17:45:30.250000", "%Y-%m-%d"),
    "2031-04-09T17:45:30Z": ("2031-04-09 17:45:30", "ISO-8601"),
    "2031-04-09T17:45:30+08:00": ("2031-04-09 17:45:30", "ISO-8601"),
    "2031-04-09T17:45:30.123456789-0330": ("2031-04-09 17:45:30.123456", "ISO-8601"),
    "2031-04-09T24:30": None,
    "2031-04-09T17:61": None,
    "2031-04-09Z": ("2031-04-09 00:00:00", "%Y-%m-%d"),
    "2031-4-9 7:05:09": ("2031-04-09 07:05:09", "%Y-%m-%d %H:%M:%S"),
    "2031-4-9": None,
    "19/04/2031": ("2031-04-19 00:00:00", "%d/%m/%Y"),
    "04/19/2031": ("2031-04-19 00:00:00", "%m/%d/%Y"),
    "4/19/2031": ("2031-04-19 00:00:00", "%m/%d/%Y"),
    "04/09/2031": "ambiguous",
    "9/4/2031": "ambiguous",
    "0/0/2031": "ambiguous",
    "32/04/2031": None,
    "19/19/2031": None,
    "00/19/2031": None,
    "19/04/31": None,
    "04/19/2031 23:59:58": ("2031-04-19 23:59:58", "%m/%d/%Y %H:%M:%S"),
    "4/9/2031 3:4:5": ("2031-04-09 03:04:05", "%m/%d/%Y %H:%M:%S"),
    "17:45": None,
    "some day": None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(v,) for v in DATES], "v STRING").select("v", dates.parse("v").alias("p")).collect()
    got = {r.v: "ambiguous" if r.p.ambiguous else r.p.value and (str(r.p.value), r.p.format) for r in rows}
    assert {v: (got[v], DATES[v]) for v in DATES if got[v] != DATES[v]} == {}


def test_iso_moments_come_back(spark):
    rng = random.Random(7)
    moments = [datetime(rng.randint(1, 9999), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.choice([0, rng.randrange(10**6)])) for _ in range(500)]
    forms = [lambda m: m.isoformat(), lambda m: m.isoformat(" "), lambda m: m.isoformat() + "Z", lambda m: m.isoformat() + "-11:15"]
    texts = {rng.choice(forms)(m): m for m in moments}
    rows = spark.createDataFrame([(v,) for v in texts], "v STRING").select("v", dates.parse("v").alias("p")).collect()
    assert all(r.p.value == texts[r.v] and r.p.format == ("ISO-8601" if "T" in r.v else "%Y-%m-%d") for r in rows)


def test_format_bits(spark):
    labels = [("%d/%m/%Y",), ("ISO-8601",), ("%Y-%m-%d",), (None,)]
    bits = spark.createDataFrame(labels, "f STRING").agg(F.bit_or(dates.format_bit(F.col("f"))).alias("b"))
    assert bits.select(dates.formats_of(F.col("b"))).first()[0] == ["%Y-%m-%d", "%d/%m/%Y", "ISO-8601"]


def test_concepts(spark):
    names = ["note", "Date", "posted-date", "  AMOUNT ", "amount", "Running__Balance", "id", "Date"]
    found = concepts.literal_concepts(spark, names)
    assert found == [None, "transaction_date", None, "amount", None, "balance", "identifier", "transaction_date"]


@pytest.mark.parametrize(
    "name, safe",
    [
        ("Checking Account (Main).csv", "Checking_Account_Main_.csv"),
        ("Résumé été.csv", "Resume_ete.csv"),
        ("__x__.csv__", "x_.csv"),
        ("€€", ""),
        ("a" * 200 + ".csv", "a" * 176 + ".csv"),
        ("ﬁle①.csv", "file1.csv"),
    ],
)
def test_sanitize(spark, name, safe):
    row = spark.createDataFrame([(name,)], "n STRING").select(text.sanitize_filename(F.col("n")), text.file_extension(text.sanitize_filename(F.col("n")))).first()
    assert row[0] == safe
    assert row[1] == (".csv" if safe.endswith(".csv") else "")


def test_strip_is_what_python_strips():
    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(text.WHITESPACE) == spaces
    assert all(unicodedata.category(d) == "Nd" for d in text._DIGITS)


def test_common_texts_are_parsed_as_by_the_general_way(spark):
    """The patterns that tell plain numbers, plain dates and neither agree with the parsers behind them, which white space leads to."""
    texts = ["1.50", "-0.00", "007", "5-", "T12", "1:2", "", "9" * 30, "0." + "1" * 11, "2024-02-30", "2024-02-29", "2024-02-29T10:20:30", "2024-02-29 24:00:00", "0000-01-01", "20240229", "1/2/2024", "13/2/2024", "2024", "x2024-01-01"]
    df = spark.createDataFrame([(t, f"\u2003{t} ") for t in texts], "v STRING, w STRING")
    df = df.select("v", money.parse("v").alias("a"), money.parse("w").alias("b"), dates.parse("v").alias("c"), dates.parse("w").alias("d"))
    assert [r.v for r in df.filter("NOT (a <=> b) OR NOT (c <=> d)").collect()] == []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE(v" in plan


def test_marked_amounts_and_slash_dates_are_told_by_patterns(spark):
    """Symbols, parentheses, slash dates and nothing take no interpreted way either, and mean what they mean there."""
    texts = ["$1.50", "€ 0.5", "php0", "PHP 12.00", "₱007", "$ 1,000.5", "$-1", "$(1)", "(1.50)", "(0.00)", "(-1)", "($1)", "(01)", "()", "(1", "$", "$" + "9" * 30, "(0." + "1" * 10 + ")", "(0." + "1" * 11 + ")",
             "13/2/2024", "02/13/2024", "2/13/2024", "12/12/2024", "0/13/2024", "13/0/2024", "13/13/2024", "31/02/2024", "29/02/2024", "13/02/0000", "1/2/0000", "13/2/2024 ", "1/13/2024 1:2:3", "/", "", None]
    df = spark.createDataFrame([(t, None if t is None else f" {t} ") for t in texts], "v STRING, w STRING")
    df = df.select("v", *[f(c).alias(f"{n}_{c}") for n, f in (("a", money.parse), ("b", lambda c: money.parse(c, "false")), ("c", dates.parse)) for c in "vw"])
    assert [r.v for r in df.filter("NOT (a_v <=> a_w) OR NOT (b_v <=> b_w) OR NOT (c_v <=> c_w)").collect()] == []
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index(v" in plan and "isnull(v" in plan
