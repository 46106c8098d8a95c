"""Amounts in text. A value that is no number is NULL, never zero.

``parse`` yields STRUCT<valid, value, text>: ``text`` is the normalized number as written (scale kept),
``value`` is DECIMAL(28,10) and is NULL also for a valid number that it cannot hold exactly: such a number is never
rounded. The expressions are SQL text over a column name: one expression tree, built in one call.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlens.functions.text import ascii_digits_sql, let_sql, strip_sql

VALUE_TYPE = "decimal(28,10)"

# What may precede an amount, and the form of a number.
_SYMBOL = r"r'^(?:[$€£₱]|(?i:PHP))'"
_NUMBER = r"r'\A[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\z'"
_LEADING = r"r'^[+-]?0*(?=[0-9.])'"
# Further decimal places than VALUE_TYPE has.
_FINER = r"r'\.[0-9]{10,}[1-9]'"
# Numbers that stand as they are normalized, and what no number has: letters but those of PHP, marks of dates, a sign behind a digit.
_NORMAL = r"r'\A-?(?:0|[1-9][0-9]*+)(?:\.[0-9]{1,10})?\z'"
_NEVER = r"r'[A-GI-OQ-Za-gi-oq-z/:_]|[0-9]-'"
# The same numbers behind a symbol, and in parentheses.
_MARKED = r"r'\A(?:[$€£₱]|(?i:PHP)) ?(?:0|[1-9][0-9]*+)(?:\.[0-9]{1,10})?\z'"
_ENCLOSED = r"r'\A\((?:0|[1-9][0-9]*+)(?:\.[0-9]{1,10})?\)\z'"


def parse_sql(column: str, money: str = "true") -> str:
    """``money``: SQL condition under which a currency symbol may precede the number."""
    in_parentheses = "(startswith(_whole, '(') AND endswith(_whole, ')'))"
    inner = f"if({in_parentheses}, {strip_sql('substring(_whole, 2, char_length(_whole) - 2)')}, _whole)"
    symbol_free = strip_sql(f"regexp_replace(_inner, {_SYMBOL}, '')")
    bare = f"if({money}, {symbol_free}, _inner)"
    digits = ascii_digits_sql(f"replace({let_sql('_inner', inner, bare)}, ',', '')")
    # Negating a zero loses its sign, a written minus sign stays.
    minus = "startswith(_digits, '-')"
    negative = f"if({in_parentheses}, NOT {minus} AND _size rlike '[1-9]', {minus})"
    text = f"concat(if({negative}, '-', ''), if(startswith(_size, '.'), '0', ''), _size)"
    text = let_sql("_size", f"regexp_replace(_digits, {_LEADING}, '')", text)
    value = f"if(_text rlike {_FINER}, CAST(NULL AS {VALUE_TYPE}), try_cast(_text AS {VALUE_TYPE}))"
    number = f"named_struct('valid', true, 'value', {value}, 'text', _text)"
    nothing = f"named_struct('valid', false, 'value', CAST(NULL AS {VALUE_TYPE}), 'text', CAST(NULL AS STRING))"
    parsed = f"if(_digits rlike {_NUMBER}, {let_sql('_text', text, number)}, {nothing})"
    parsed = let_sql("_whole", strip_sql(column), let_sql("_digits", digits, parsed))
    # Lambdas are interpreted, so the common texts are told by one pattern each.
    def known(text: str) -> str:
        return f"named_struct('valid', true, 'value', try_cast({text} AS {VALUE_TYPE}), 'text', {text})"

    marked = known(f"trim(LEADING '$€£₱PHphp ' FROM {column})")
    enclosed = known(f"concat(if({column} rlike '[1-9]', '-', ''), substring({column}, 2, char_length({column}) - 2))")
    return f"""CASE WHEN {column} IS NULL OR {column} = '' THEN {nothing}
        WHEN {column} rlike {_NORMAL} THEN {known(column)}
        WHEN {column} rlike {_ENCLOSED} THEN {enclosed}
        WHEN {money} AND {column} rlike {_MARKED} THEN {marked}
        WHEN {column} rlike {_NEVER} THEN {nothing} ELSE {parsed} END"""


def parse(column: str, money: str = "true") -> Column:
    return F.expr(parse_sql(column, money))


def parse_money(column: str) -> Column:
    return parse(column)["value"]


def parse_number(column: str) -> Column:
    return parse(column, "false")["value"]


def is_whole(text: Column) -> Column:
    """Whether normalized number text, of any length, has no fraction."""
    return ~text.rlike(r"\.[0-9]*[1-9]")


def scale_of(text: Column) -> Column:
    """Decimal places of normalized number text."""
    return F.char_length(F.substring_index(F.concat(text, F.lit(".")), ".", 2)) - F.char_length(
        F.substring_index(text, ".", 1)
    ) - 1


def has_currency_mark(value: Column) -> Column:
    # The marks that make a numeric column's format "currency".
    upper = F.upper(value)
    return upper.contains("$") | upper.contains("PHP") | upper.contains("₱")
