"""Numbers of any length, exactly.

``order_key`` writes a normalized number so that texts compare as the numbers do. Sums are taken by limbs: a number is a sum of
parts below 10 ** 9, each times a power of 10 ** 9; parts of one power are added up by Spark, and only one row per group carries them over.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

LIMBS = "array<struct<i: int, v: bigint>>"
SUMS = "array<struct<i: int, v: decimal(38,0)>>"
RESULT = DecimalType(24, 6)
_DIGITS, _COMPLEMENT = "0123456789", "9876543210"


def order_key(text: Column) -> Column:
    """Text that sorts as normalized number text does, the same for 1 and 1.00: sign, count of whole digits, digits.

    Digits of negative numbers are turned around, with a last character above all digits.
    """
    size = F.regexp_replace(text, "^-", "")
    whole = F.regexp_replace(F.substring_index(size, ".", 1), "^0+", "")
    fraction = F.when(size.contains("."), F.regexp_replace(F.substring_index(size, ".", -1), "0+$", "")).otherwise("")
    digits = F.concat(F.lpad(F.char_length(whole).cast("string"), 10, "0"), whole, fraction)
    negative = text.startswith("-") & (F.concat(whole, fraction) != "")
    return F.when(negative, F.concat(F.lit("0"), F.translate(digits, _DIGITS, _COMPLEMENT), F.lit("~"))).otherwise(F.concat(F.lit("1"), digits))


def python_parts() -> dict[str, Callable]:
    # Made inside a function so that it reaches the workers by value, without this package installed there.
    def scaled(text: str) -> tuple[int, int]:
        """A number as a whole number of 10 ** (-9 * n), and n."""
        import sys

        sys.set_int_max_str_digits(0)
        whole, _, fraction = text.partition(".")
        n = -(-len(fraction) // 9)
        return int(whole + fraction.ljust(9 * n, "0")), n

    def cut(value: int, n: int) -> list[dict]:
        import sys

        sys.set_int_max_str_digits(0)
        sign, digits = (-1 if value < 0 else 1), str(abs(value))
        digits = digits.rjust(-(-len(digits) // 9) * 9, "0")
        count = len(digits) // 9
        parts = [(count - 1 - k - n, sign * int(digits[9 * k : 9 * k + 9])) for k in range(count)]
        return [{"i": i, "v": v} for i, v in parts if v]

    def together(parts: object, least: int) -> int:
        """The sum of limbs as a whole number of 10 ** (9 * least)."""
        found: dict[int, int] = {p["i"] - least: int(p["v"]) for p in parts}
        values, base = [found.get(k, 0) for k in range(max(found, default=0) + 1)], 10**9
        while len(values) > 1:  # neighbours first, so that long numbers meet once only
            values += [0] * (len(values) % 2)
            values = [low + high * base for low, high in zip(values[::2], values[1::2])]
            base *= base
        return values[0]

    def least_of(parts: object) -> int:
        return min((p["i"] for p in parts), default=0)

    def from_key(key: str) -> tuple[int, int]:
        negative = key[0] == "0"
        digits = key[1:].rstrip("~")
        digits = digits.translate(str.maketrans("9876543210", "0123456789")) if negative else digits
        count, digits = int(digits[:10]), digits[10:]
        value, n = scaled(f"{digits[:count] or '0'}.{digits[count:]}")
        return (-value if negative else value), n

    def rounded(above: int, below: int) -> object:
        """above / below with six places, halves away from zero; None where 24 digits do not do."""
        from decimal import Context, Decimal

        quotient, rest = divmod(abs(above) * 10**6, below)
        quotient += 2 * rest >= below
        if quotient >= 10**24:
            return None
        return Decimal(-quotient if above < 0 else quotient).scaleb(-6, Context(prec=40))

    return locals()


def limbs_of(text: Column) -> Column:
    """Limbs of normalized number text; zero limbs are left out."""
    made = python_parts()
    scaled, cut = made["scaled"], made["cut"]

    def limbs(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            value, n = scaled(text) if text is not None else (0, 0)
            out.append(cut(value, n))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(limbs, LIMBS)(text)


def total(sums: Column) -> Column:
    """The number that added limbs make, with six places; null if it is too large."""
    made = python_parts()
    together, least_of, rounded = made["together"], made["least_of"], made["rounded"]

    def of(rows: pd.Series) -> pd.Series:
        out = []
        for parts in rows:
            least = min(least_of(parts), 0) if parts is not None else 0
            out.append(None if parts is None else rounded(together(parts, least), 10 ** (-9 * least)))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, RESULT)(sums)


def mean(count: Column, sums: Column) -> Column:
    made = python_parts()
    together, least_of, rounded = made["together"], made["least_of"], made["rounded"]

    def of(counts: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for n, parts in zip(counts, rows):
            least = min(least_of(parts), 0)
            out.append(rounded(together(parts, least), int(n) * 10 ** (-9 * least)))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, RESULT)(count, sums)


def deviation(count: Column, sums: Column, squares: Column) -> Column:
    """The population standard deviation."""
    made = python_parts()
    together, least_of, rounded = made["together"], made["least_of"], made["rounded"]

    def of(counts: pd.Series, rows: pd.Series, square_rows: pd.Series) -> pd.Series:
        import math

        out = []
        for n, parts, squared in zip(counts, rows, square_rows):
            n = int(n)
            least = min(0, least_of(parts), least_of(squared) // 2)
            # n * n * variance, in units of 10 ** (18 * least)
            spread = n * together(squared, 2 * least) - together(parts, least) ** 2
            # twice the deviation in millionths, cut off, so that a half is seen exactly
            twice = math.isqrt(4 * 10**12 * spread // (n * 10 ** (-9 * least)) ** 2)
            out.append(rounded((twice + 1) // 2, 10**6))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, RESULT)(count, sums, squares)


def middle(low: Column, high: Column) -> Column:
    """The mean of two numbers given by their keys."""
    made = python_parts()
    from_key, rounded = made["from_key"], made["rounded"]

    def of(lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(lows, highs):
            (x, m), (y, n) = from_key(a), from_key(b)
            most = max(m, n)
            out.append(rounded(x * 10 ** (9 * (most - m)) + y * 10 ** (9 * (most - n)), 2 * 10 ** (9 * most)))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, RESULT)(low, high)


def followed(sums: Column, reported: Column, scale: Column, tolerance: str) -> Column:
    """A struct of the number that added limbs make: text with ``scale`` places, that with six (value), and whether ``reported``, normalized
    number text, is as near as the tolerance."""
    made = python_parts()
    scaled, together, least_of, rounded = made["scaled"], made["together"], made["least_of"], made["rounded"]

    def of(rows: pd.Series, texts: pd.Series, scales: pd.Series) -> pd.DataFrame:
        out = []
        bound, places = scaled(tolerance)
        for parts, text, scale in zip(rows, texts, scales):
            least = min(least_of(parts), 0)
            value, unit = together(parts, least), 10 ** (-9 * least)
            size = abs(value) * 10 ** int(scale) // unit
            digits = str(size).rjust(int(scale) + 1, "0")
            written = digits if not scale else f"{digits[: -int(scale)]}.{digits[-int(scale) :]}"
            told, n = scaled(text)
            most = max(-least, n, places)
            apart = abs(value * 10 ** (9 * (most + least)) - told * 10 ** (9 * (most - n)))
            out.append(("-" + written if value < 0 else written, rounded(value, unit), apart <= bound * 10 ** (9 * (most - places))))
        return pd.DataFrame(out, columns=["text", "value", "matches"])

    return F.pandas_udf(of, "text string, value decimal(24,6), matches boolean")(sums, reported, scale)
