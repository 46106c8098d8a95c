"""Dates in text.

``parse`` yields STRUCT<value TIMESTAMP_NTZ, format STRING, ambiguous BOOLEAN>. Accepted: ISO-8601 calendar
and week dates (extended or basic) with an optional time and offset, ``d/d/yyyy``, and two formats with
unpadded parts. The wall-clock value is kept and an offset is dropped. A slash date that could be read both
ways is ambiguous and has no value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerlens.functions.text import ascii_digits_sql, let_sql, strip_sql

# Labels of the accepted formats, in text order.
FORMATS = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y", "%m/%d/%Y %H:%M:%S", "ISO-8601")

_HOUR, _SIXTY = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_PART = rf"(?:{_HOUR}(?::{_SIXTY}(?::{_SIXTY})?)?|{_HOUR}(?:{_SIXTY}(?:{_SIXTY})?)?)"
_OFFSET = rf"[+-](?:{_HOUR}(?::\d\d(?::\d\d)?)?|{_HOUR}(?:\d\d(?:\d\d)?)?)(?:[.,]\d+)?"
# The common ISO parser takes a fraction after any part, one with its point missing, and overlooks what
# stands between a full fraction, or one character between a part, and an offset.
_TIME = (
    rf"(?:{_PART}(?:[.,]\d+)?(?:{_OFFSET})?|{_HOUR}{_SIXTY}{_SIXTY}\d{{2,}}(?:{_OFFSET})?|{_PART}(?:[.,]\d{{6}}[^+-]*|[^+-]){_OFFSET})"
)
_TAIL = rf"(?:[\s\S]{_TIME})?\z"
_YEAR = r"\A(?!0000)\d{4}"
_ISO_CALENDAR = rf"{_YEAR}(?:-\d\d-\d\d|\d{{4}}){_TAIL}"
_ISO_WEEK = rf"{_YEAR}(?:-W\d\d(?:-\d(?!\d))?|W\d\d(?:\d(?!\d))?){_TAIL}"
_SLASH = r"\A(\d{1,2})/(\d{1,2})/(\d{4})\z"
_CLOCK = r"(2[0-3]|[01]?\d):([0-5]?\d):([0-5]?\d)\z"
_DASH_CLOCK = rf"{_YEAR}-(?:1[0-2]|0?[1-9])-(?:3[01]|[12]\d|0?[1-9]| [1-9])\s+{_CLOCK}"
# The common texts, and what every text of an accepted format has, whatever white space is before it.
_PLAIN = r"\A(?!0000)\d{4}-\d\d-\d\d(?:[ T](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)?\z"
_LIKELY = r"/|\A[^!-~]*+\d{4}(?:[W-]|\d{4})"
_SLASH_CLOCK = rf"\A(?:1[0-2]|0?[1-9])/(?:3[01]|[12]\d|0?[1-9]| [1-9])/(?!0000)\d{{4}}\s+{_CLOCK}"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _two(part: str) -> str:
    return f"lpad(trim({part}), 2, '0')"


def _clock_sql(tail: str) -> str:
    """Clock text of an ISO tail (separator, time, offset); midnight when there is no tail."""
    digits = "replace(regexp_extract(_tail, r'^[\\s\\S]([0-9:]*)', 1), ':', '')"
    packed = f"rpad(regexp_extract({digits}, r'^((?:[0-9][0-9])*)', 1), 6, '0')"
    # An offset may carry a fraction too; the time's own one follows its seconds directly.
    fraction = "rpad(regexp_extract(_tail, r'^[\\s\\S](?:[0-9]{6}(?=[0-9]{2})|[0-9:]+[.,])([0-9]+)', 1), 6, '0')"
    clock = f"concat(substr(_p, 1, 2), ':', substr(_p, 3, 2), ':', substr(_p, 5, 2), '.', {fraction})"
    return let_sql("_tail", tail, let_sql("_p", packed, clock))


def _calendar_sql(text: str) -> str:
    extended = f"concat(left({text}, 10), ' ', {_clock_sql(f'substr({text}, 11)')})"
    day = f"concat_ws('-', substr({text}, 1, 4), substr({text}, 5, 2), substr({text}, 7, 2))"
    return f"if(substr({text}, 5, 1) = '-', {extended}, concat({day}, ' ', {_clock_sql(f'substr({text}, 9)')}))"


def _week_sql(text: str) -> str:
    head = _raw(r"^(\d{4}-W\d\d(?:-\d(?!\d))?|\d{4}W\d\d(?:\d(?!\d))?)")
    year, week = "CAST(substr(_w, 1, 4) AS INT)", "CAST(substr(_w, 6, 2) AS INT)"
    weekday = "if(char_length(_w) = 8, CAST(substr(_w, 8, 1) AS INT), 1)"
    # Weeks are counted from the Monday of the week that holds 4 January; the last one holds 28 December.
    anchor = f"make_date({year}, 1, 4)"
    last = f"weekofyear(make_date({year}, 12, 28))"
    day = f"date_add(date_sub({anchor}, weekday({anchor})), ({week} - 1) * 7 + {weekday} - 1)"
    valid = f"({week} BETWEEN 1 AND {last} AND {weekday} BETWEEN 1 AND 7)"
    day = let_sql("_w", "replace(_head, '-', '')", f"if({valid}, CAST({day} AS STRING), NULL)")
    clock = _clock_sql(f"substr({text}, char_length(_head) + 1)")
    return let_sql("_head", f"regexp_extract({text}, {head}, 1)", f"concat({day}, ' ', {clock})")


def _slash_sql(text: str) -> str:
    first, second, year = (f"regexp_extract({text}, {_raw(_SLASH)}, {i})" for i in (1, 2, 3))
    month_day = f"if(CAST({first} AS INT) <= 12, concat_ws('-', {_two(first)}, {_two(second)}), concat_ws('-', {_two(second)}, {_two(first)}))"
    return f"if({year} = '0000', NULL, concat({year}, '-', {month_day}, ' 00:00:00'))"


def _parts_sql(text: str, order: tuple[int, int, int]) -> str:
    pattern = _raw(r"\A(\d+)[-/]([ \d]+)[-/]([ \d]+?)\s+(\d+):(\d+):(\d+)\z")
    part = [f"regexp_extract({text}, {pattern}, {i})" for i in range(1, 7)]
    year, month, day = (part[i] for i in order)
    clock = ", ".join(_two(p) for p in part[3:])
    return f"concat({year}, '-', {_two(month)}, '-', {_two(day)}, ' ', concat_ws(':', {clock}))"


def parse_sql(column: str) -> str:
    iso = "replace(_t, 'Z', '+00:00')"
    mapped = ascii_digits_sql("_t")
    first, second = (f"try_cast(regexp_extract({mapped}, {_raw(_SLASH)}, {i}) AS INT)" for i in (1, 2))
    day_first = f"CAST(regexp_extract(_t, {_raw(_SLASH)}, 1) AS INT) > 12"
    dated, slashed = r"_t rlike r'\A\d{4}'", "contains(_t, '/')"
    iso_label = "if(contains(_t, 'T'), 'ISO-8601', '%Y-%m-%d')"

    def form(moment: str, label: str) -> str:
        return f"named_struct('moment', {moment}, 'format', {label})"

    # The forms exclude each other: the first one a text has decides, also when its parts are no date.
    forms = f"""CASE
        WHEN {dated} AND {iso} rlike {_raw(_ISO_CALENDAR)} THEN {form(_calendar_sql(iso), iso_label)}
        WHEN {dated} AND {iso} rlike {_raw(_ISO_WEEK)} THEN {form(_week_sql(iso), iso_label)}
        WHEN {slashed} AND {first} <= 12 AND {second} <= 12 THEN {form("CAST(NULL AS STRING)", "''")}
        WHEN {slashed} AND _t rlike {_raw(_SLASH)} THEN {form(_slash_sql("_t"), f"if({day_first}, '%d/%m/%Y', '%m/%d/%Y')")}
        WHEN {dated} AND _t rlike {_raw(_DASH_CLOCK)} THEN {form(_parts_sql("_t", (0, 1, 2)), "'%Y-%m-%d %H:%M:%S'")}
        WHEN {slashed} AND _t rlike {_raw(_SLASH_CLOCK)} THEN {form(_parts_sql("_t", (2, 0, 1)), "'%m/%d/%Y %H:%M:%S'")}
    END"""
    result = """named_struct('value', _day, 'format', if(_day IS NULL, NULL, _form.format),
        'ambiguous', coalesce(_form.format = '', false))"""
    typed = let_sql("_day", "try_cast(_form.moment AS TIMESTAMP_NTZ)", result)
    parsed = let_sql("_form", let_sql("_t", strip_sql(column), forms), typed)
    # Lambdas are interpreted, so the common texts are told by one pattern each.
    day = f"try_cast({column} AS TIMESTAMP_NTZ)"
    label = f"if({day} IS NULL, NULL, if(contains({column}, 'T'), 'ISO-8601', '%Y-%m-%d'))"
    plain = f"named_struct('value', {day}, 'format', {label}, 'ambiguous', false)"
    nothing = "named_struct('value', CAST(NULL AS TIMESTAMP_NTZ), 'format', CAST(NULL AS STRING), 'ambiguous', false)"
    # slash dates in ASCII digits
    first, second = f"substring_index({column}, '/', 1)", f"substring_index(substring_index({column}, '/', 2), '/', -1)"
    year, late = f"right({column}, 4)", f"CAST({first} AS INT) > 12"
    parts = f"if({late}, concat_ws('-', {year}, {second}, {first}), concat_ws('-', {year}, {first}, {second}))"
    day = f"if({year} = '0000', CAST(NULL AS TIMESTAMP_NTZ), try_cast({parts} AS TIMESTAMP_NTZ))"
    slash = f"named_struct('value', {day}, 'format', if({day} IS NULL, NULL, if({late}, '%d/%m/%Y', '%m/%d/%Y')), 'ambiguous', false)"
    unsure = nothing.replace("'ambiguous', false", "'ambiguous', true")
    return f"""CASE WHEN {column} IS NULL THEN {nothing}
        WHEN {column} rlike {_raw(_PLAIN)} THEN {plain}
        WHEN NOT {column} rlike {_raw(_LIKELY)} THEN {nothing}
        WHEN {column} rlike {_raw(_SLASH)} THEN if(NOT {late} AND CAST({second} AS INT) <= 12, {unsure}, {slash})
        ELSE {parsed} END"""


def parse(column: str) -> Column:
    return F.expr(parse_sql(column))


def is_midnight(ts: Column) -> Column:
    return ts == ts.cast("date").cast("timestamp_ntz")


def format_bit(label: Column) -> Column:
    """One bit per format, so that the set of formats is a fixed-width aggregate (bit_or)."""
    bit = F.lit(0)
    for i, name in enumerate(FORMATS):
        bit = F.when(label == name, F.lit(1 << i)).otherwise(bit)
    return bit


def formats_of(bits: Column) -> Column:
    """Sorted labels of a bit set."""
    return F.filter(
        F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(FORMATS)]),
        lambda label: label.isNotNull(),
    )
