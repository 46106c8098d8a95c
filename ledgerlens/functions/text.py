"""Text helpers as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Every character that counts as white space at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def sql_text(value: str) -> str:
    """SQL string literal of any characters."""
    return "'" + "".join(c if c.isalnum() and c.isascii() else f"\\U{ord(c):08x}" for c in value) + "'"


_WHITESPACE_SQL = sql_text(WHITESPACE)
_DIGITS_SQL, _ASCII_DIGITS_SQL = sql_text("".join(_DIGITS)), sql_text(_ASCII_DIGITS)


def let_sql(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` under a name: worked out once, however often the body uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip_sql(value: str) -> str:
    return f"trim(BOTH {_WHITESPACE_SQL} FROM {value})"


def ascii_digits_sql(value: str) -> str:
    """Decimal digits of any script become 0-9; plain ASCII text skips the translation."""
    translated = f"translate(_raw, {_DIGITS_SQL}, {_ASCII_DIGITS_SQL})"
    return let_sql("_raw", value, f"if(octet_length(_raw) = char_length(_raw), _raw, {translated})")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def decimal_text(c: Column, scale: Column) -> Column:
    """Plain text of a DECIMAL with the given number of decimal places (at most its own scale)."""
    plain = c.cast("decimal(38,10)").cast("string")
    return F.left(plain, F.char_length(plain) - F.lit(10) + scale - F.when(scale == 0, 1).otherwise(0))


def _ascii_name() -> Callable[[Column], Column]:
    # Defined inside a function so that it reaches the workers by value, without this package installed there.
    def ascii_name(names: pd.Series) -> pd.Series:
        return names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return F.pandas_udf(ascii_name, StringType())


def sanitize_filename(c: Column) -> Column:
    """Safe file name; the empty string when nothing usable is left."""
    ascii_only = _ascii_name()(strip(c))
    safe = F.regexp_replace(ascii_only, r"[^A-Za-z0-9._-]+", "_")
    safe = F.trim(F.regexp_replace(safe, r"_+", "_"), F.lit("._"))
    suffix = F.regexp_extract(safe, r"(?s)^.+?(\.[^.]+)$", 1)
    stem = F.left(safe, F.char_length(safe) - F.char_length(suffix))
    room = F.lit(180) - F.char_length(suffix)
    keep = F.when(room >= 0, room).otherwise(F.greatest(F.char_length(stem) + room, F.lit(0)))
    return F.when(F.char_length(safe) > 180, F.concat(F.left(stem, keep), suffix)).otherwise(safe)


def file_extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?s)^.+?(\.[^.]+)$", 1))


def stored_filename(checksum: Column, sanitized: Column) -> Column:
    return F.concat_ws("_", checksum, sanitized)


def relative_path(stored: Column) -> Column:
    return F.concat(F.lit("raw/registered/"), stored)


def issue_fingerprint(file_id: Column, version: str, code: Column, column: Column, row: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "|",
            file_id,
            F.lit(version),
            code,
            F.coalesce(column, F.lit("")),
            F.coalesce(row.cast("string"), F.lit("")),
        ),
        256,
    )
