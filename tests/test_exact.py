"""Numbers of any length against Python's whole numbers and fractions."""

import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import limbs
from ledgerlens.operators import columns as C, exact, ledger as L


def numbers(count, seed):
    chance = random.Random(seed)
    out = ["0", "-0", "0.0", "1", "1.00", "-1", "0.1", "0.2", "0.30000000000000004", "9" * 60, "-" + "9" * 60, "0." + "0" * 50 + "1", "-0." + "0" * 50 + "1"]
    for _ in range(count):
        whole = str(chance.randrange(10 ** chance.choice([1, 9, 10, 18, 25])))
        fraction = "".join(chance.choice("0019") for _ in range(chance.choice([0, 2, 9, 10, 30])))
        out.append(chance.choice(["", "-"]) + whole + ("." + fraction if fraction else ""))
    return out


def sixth(x):
    """x with six places, halves away from zero; None beyond 24 digits."""
    size = (2 * abs(x) * 10**6 + 1) // 2
    return None if size >= 10**24 else Decimal(-size if x < 0 else size).scaleb(-6)


def deviation(xs):
    n = len(xs)
    square = Fraction(n * sum(x * x for x in xs) - sum(xs) ** 2) * 4 * 10**12 / n**2
    size = (math.isqrt(square.numerator // square.denominator) + 1) // 2
    return None if size >= 10**24 else Decimal(size).scaleb(-6)


def test_keys_sort_as_numbers(spark):
    texts = numbers(400, 1)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", limbs.order_key(F.col("t")).alias("k")).collect()
    rows.sort(key=lambda r: Fraction(r.t))
    for a, b in zip(rows, rows[1:]):
        assert (a.k < b.k) if Fraction(a.t) < Fraction(b.t) else (a.k == b.k), (a, b)


@pytest.mark.parametrize("seed", [2, 3])
def test_figures(spark, seed):
    chance, rows = random.Random(seed), []
    for column in range(12):
        # the first columns hold all numbers, the others those of a size whose figures can be kept
        texts = [t for t in numbers(60, seed * 100 + column) if column < 2 or len(t.partition(".")[0]) <= 12]
        texts = texts if column % 2 else texts + ["5." + "0" * 20 + "1"]
        rows += [("f", column, t) for t in texts for _ in range(chance.choice([1, 1, 3]))]
    rows += [("g", 0, "7" * 40)] * 5 + [("h", 0, "0.00000000000000000001"), ("h", 0, "-0.00000000000000000001")] + [("i", 0, "0.1"), ("i", 0, "2")]
    cells = [(f, n + 2, c, f"c{c}", None, t) for n, (f, c, t) in enumerate(rows)]
    chance.shuffle(cells)
    df = spark.createDataFrame(cells, "file_id string, row_no bigint, position int, name string, concept string, value string").repartition(5)
    found = {(r.file_id, r.column_position): r for r in C.column_profiles(C.value_counts(df)).collect()}
    for key in {(f, c) for f, c, _ in rows}:
        texts = [t for f, c, t in rows if (f, c) == key]
        xs, r = [Fraction(t) for t in texts], found[key]
        middle = sorted(xs)[(len(xs) - 1) // 2] + sorted(xs)[len(xs) // 2]
        assert (Fraction(r.minimum_value), Fraction(r.maximum_value)) == (min(xs), max(xs))
        assert (r.mean_value, r.median_value, r.standard_deviation) == (sixth(sum(xs) / len(xs)), sixth(middle / 2), deviation(xs)), key


def test_totals(spark):
    texts = {"a": ["0.30000000000000004", "0.1", "-5", "x", ""], "b": ["9" * 30, "-" + "9" * 30, "1.5"], "c": ["9" * 40], "d": ["1", "2.25"], "e": ["", "no"]}
    rows = [(f, n + 2, None, t, None, None, t) for f, ts in texts.items() for n, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "file_id string, row_no bigint, balance_name string, amount string, balance string, debit string, credit string")
    found = {r.file_id: (r.monetary_total, r.debit_total, r.credit_total) for r in L.control_totals(df).collect()}
    want = {"a": Decimal("-4.6"), "b": Decimal("1.5"), "c": None, "d": Decimal("3.25"), "e": None}
    assert found == {f: (t, None, t) for f, t in want.items()}


def plain_balances(rows):
    """(summary, [(row_no, expected text, matches, negative)]) of one ledger of texts (amount, balance)."""
    moved, balances = [Fraction(a) for a, _ in rows], [Fraction(b) for _, b in rows]
    expected, scale, out = balances[0] - moved[0], 0, []
    for n, ((a, b), m, told) in enumerate(zip(rows, moved, balances)):
        expected += m
        scale = max(scale, len(a.partition(".")[2]), len(b.partition(".")[2]) if n == 0 else 0)
        size = abs(expected) * 10**scale
        assert size.denominator == 1
        digits = str(int(size)).rjust(scale + 1, "0")
        text = ("-" if expected < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)
        out.append((n + 2, text, abs(expected - told) <= Fraction(1, 100), told < 0))
    return (sixth(balances[0] - moved[0]), sixth(balances[-1]), sixth(expected), all(r[2] for r in out)), out


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_balances(spark, block):
    chance, ledgers = random.Random(9), {}
    for name in ("fine", "wide", "plain", "mixed"):
        rows, balance = [], Fraction(0)
        for n in range(40):
            whole = chance.randrange(-(10 ** (30 if name == "wide" else 6)), 10 ** (30 if name == "wide" else 6))
            places = 25 if name == "fine" or (name == "mixed" and n == 20) else 2
            amount = f"{whole}." + "".join(chance.choice("0123456789") for _ in range(places))
            balance += Fraction(amount)
            told = balance + (5 if n in (13, 27) else 0) + (Fraction(1, 10**25) if name == "fine" else 0)
            digits = str(abs(int(told * 10**25))).rjust(26, "0")
            rows.append((amount, ("-" if told < 0 else "") + f"{digits[:-25]}.{digits[-25:]}"))
        ledgers[name] = [(a, b.rstrip("0").rstrip(".") if name != "fine" else b) for a, b in rows]
    data = [(f, n + 2, "balance", a, b, None, None) for f, rows in ledgers.items() for n, (a, b) in enumerate(rows)]
    # by sides, and one that cannot be verified
    data += [("sides", 2, "balance", None, "0.30000000000000004", "", "0.30000000000000004"), ("sides", 3, "balance", None, "-0.7", "1.00000000000000004", "")]
    data += [("broken", 2, "balance", "9" * 30, "9" * 30, None, None), ("broken", 3, "balance", "x", "1", None, None), ("broken", 4, "balance", "1", "2.00000000000000000004", None, None)]
    df = spark.createDataFrame(data, "file_id string, row_no bigint, balance_name string, amount string, balance string, debit string, credit string").repartition(3)
    running = {}
    for r in L.running_balance(df, block_rows=block).collect():
        running.setdefault(r.file_id, []).append((r.row_no, r.expected_text, r.matches, r.negative))
    summary = {r.file_id: r for r in L.balance_summary(df, block_rows=block).collect()}
    for name, rows in ledgers.items():
        told, want = plain_balances(rows)
        s = summary[name]
        assert sorted(running[name]) == want, name
        assert (s.opening_balance, s.closing_balance, s.calculated_closing_balance, s.running_balance_valid) == told
    assert sorted(running["sides"]) == [(2, "0.30000000000000004", True, False), (3, "-0.70000000000000000", True, True)]
    assert summary["sides"].running_balance_valid and summary["sides"].opening_balance == 0
    s = summary["broken"]
    assert "broken" not in running and not s.verifiable and s.opening_balance is None and s.closing_balance == 2 and s.running_balance_valid is None


def test_long_numbers_are_added_up_where_they_are_read(spark):
    """The sums and squares of a batch make a few rows, not some for every number; a column of zeros stays."""
    texts = numbers(800, 7)
    rows = spark.createDataFrame([("f", 0, t, 1 + n % 3) for n, t in enumerate(texts)] + [("z", 1, "-0.00", 2)], "file_id string, position int, text string, cnt bigint").coalesce(1)
    found = exact.sums_of_numbers(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("MapInPandas") and "Generate" not in plan

    def value(parts):
        return sum(Fraction(int(p.v)) * Fraction(10) ** (9 * p.i) for p in parts)

    got = {r.file_id: (value(r.sums), value(r.squares)) for r in found.collect()}
    weighed = [(Fraction(t), 1 + n % 3) for n, t in enumerate(texts)]
    assert got == {"f": (sum(x * w for x, w in weighed), sum(x * x * w for x, w in weighed)), "z": (0, 0)}
