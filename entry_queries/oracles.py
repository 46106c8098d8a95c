"""DuckDB SQL that restates every registered query on the given tables.

Built from common table expressions; ``_with`` chains the ones a query needs.
"""

from __future__ import annotations

from entry_queries.inputs import DELIMITERS, FILE_COLUMNS, FILE_ROWS, LEDGER_COLUMNS, SIDES_COLUMNS
from entry_queries.more_inputs import HEADER_NAMES, ORDER_COLUMNS

CONCEPT = {
    "transaction_id": "identifier",
    "posted_date": "transaction_date",
    "amount": "amount",
    "balance": "balance",
    "debit": "debit",
    "credit": "credit",
    "total": "amount",
}
MONEY = "('amount', 'debit', 'credit', 'balance')"
NAME_CONCEPTS = {
    "Transaction-Date": "transaction_date", "posted_date": "transaction_date", "Date": "transaction_date",
    "AMOUNT": "amount", "net  amount": "amount", "amount": "amount", "Running_Balance": "balance",
    "Account Balance": "balance", "reference number": "identifier", "id": "identifier",
    "withdrawals": "debit", "Deposit": "credit",
}


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


LEDGER = """
base AS (
  SELECT user_id, event_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
moved AS (SELECT *, CASE WHEN event_type IN ('purchase', 'error') THEN -cents ELSE cents END AS mv FROM base),
summed AS (
  SELECT *, CAST(sum(mv) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bc FROM moved),
txt AS (
  SELECT *, concat(CAST(abs(mv) // 100 AS VARCHAR), '.', lpad(CAST(abs(mv) % 100 AS VARCHAR), 2, '0')) AS a,
    concat(CASE WHEN bc < 0 THEN '-' ELSE '' END, CAST(abs(bc) // 100 AS VARCHAR), '.',
           lpad(CAST(abs(bc) % 100 AS VARCHAR), 2, '0')) AS b FROM summed),
ledger AS (
SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(rn + 1 AS BIGINT) AS row_no,
  CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 53 = 0 THEN 'T0'
       ELSE concat('T', CAST(event_id AS VARCHAR)) END AS transaction_id,
  CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 89 = 0 THEN '01/02/2024'
       WHEN event_id % 5 = 0 AND day(ts) > 12 THEN strftime(ts, '%d/%m/%Y')
       ELSE strftime(ts, '%Y-%m-%d') END AS posted_date,
  CASE WHEN user_id % 3 = 0 AND event_id % 103 = 0 THEN 'n/a'
       WHEN mv < 0 THEN CASE WHEN event_id % 2 = 0 THEN concat('(', a, ')') ELSE concat('-', a) END
       WHEN event_id % 7 = 0 THEN concat('$', a) WHEN event_id % 11 = 0 THEN concat('PHP ', a) ELSE a END AS amount,
  CASE WHEN event_id % 199 = 0 THEN concat(b, '9') WHEN event_id % 211 = 0 THEN '0.00' ELSE b END AS balance,
  event_type AS description,
  CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END AS note,
  CASE WHEN event_id % 13 = 0 THEN 'many' ELSE CAST(event_id % 50 AS VARCHAR) END AS units,
  CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS settled,
  CASE WHEN event_id % 17 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       WHEN event_id % 19 = 0 THEN strftime(ts, '%-m/%-d/%Y %-H:%-M:%-S')
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS booked_at,
  '' AS memo
FROM txt)"""

SIDES = """
sides AS (
SELECT file_id, row_no, transaction_id, posted_date,
  CASE WHEN outgoing THEN bare ELSE '' END AS debit, CASE WHEN outgoing THEN '' ELSE amount END AS credit,
  balance, description
FROM (SELECT *, (amount LIKE '(%' OR amount LIKE '-%') AS outgoing,
        regexp_replace(amount, '^PHP |[$()-]', '', 'g') AS bare FROM ledger))"""


def cells_cte(source: str, columns: list[str], name: str = "cells") -> str:
    parts = [
        f"SELECT file_id, row_no, {i} AS position, {q(c)} AS name, CAST({q(CONCEPT.get(c))} AS VARCHAR) AS concept, "
        f"CAST({c} AS VARCHAR) AS value FROM {source}"
        for i, c in enumerate(columns)
    ]
    return f"\n{name} AS (" + "\nUNION ALL ".join(parts) + ")"


VALUE_COUNTS = """
vc AS (SELECT file_id, position, name, concept, value, count(*) AS cnt, min(row_no) AS first_row FROM cells GROUP BY ALL)"""


def money_parts(value: str, symbol: str) -> str:
    """SELECT list pieces for number parsing of column ``value``; ``symbol`` = condition for currency symbols."""
    ws = "' ' || chr(160) || chr(9) || chr(10) || chr(13)"
    t = f"trim({value}, {ws})"
    paren = f"({t} LIKE '(%' AND {t} LIKE '%)')"
    inner = f"CASE WHEN {paren} THEN trim(substr({t}, 2, length({t}) - 2), {ws}) ELSE {t} END"
    bare = f"CASE WHEN {symbol} THEN trim(regexp_replace({inner}, '^([$€£₱]|PHP)', '', 'i'), {ws}) ELSE {inner} END"
    return f"{paren} AS paren, replace({bare}, ',', '') AS digits"


NUMBER_FORM = "'[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)'"


def numbers_cte(source: str, name: str, symbol: str, value: str = "value") -> str:
    """Adds valid, num (DECIMAL(28,10)) and ntext to ``source``."""
    return f"""
{name}_0 AS (SELECT *, {money_parts(value, symbol)} FROM {source}),
{name}_1 AS (SELECT * EXCLUDE (paren, digits), regexp_full_match(digits, {NUMBER_FORM}) AS valid, paren AS neg, digits,
  CASE WHEN digits LIKE '-%' THEN -1 ELSE 1 END AS sgn,
  regexp_replace(ltrim(regexp_replace(digits, '^[+-]', ''), '0'), '^([.]|$)', '0\\1') AS size FROM {name}_0),
{name} AS (SELECT * EXCLUDE (neg, digits, sgn, size),
  CASE WHEN valid THEN CAST(size AS DECIMAL(28,10)) * (CASE WHEN neg THEN -sgn ELSE sgn END) END AS num,
  CASE WHEN valid THEN concat(CASE WHEN neg THEN CASE WHEN sgn = 1 AND regexp_matches(size, '[1-9]') THEN '-' ELSE '' END
    WHEN sgn = -1 THEN '-' ELSE '' END, size) END AS ntext FROM {name}_1)"""


_CLOCK = "([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?|[0-5][0-9]([0-5][0-9]([.][0-9]+)?)?)?([+-][0-9]{2}:?[0-9]{2})?"


def dates_cte(source: str, name: str, value: str = "value") -> str:
    """Adds dts (TIMESTAMP), dfmt and amb to ``source``."""
    return f"""
{name}_0 AS (SELECT *, trim({value}) AS dv, replace(trim({value}), 'Z', '+00:00') AS di FROM {source}),
{name}_1 AS (SELECT *,
  CASE WHEN regexp_full_match(di, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T]{_CLOCK})?') THEN 'ext'
       WHEN regexp_full_match(di, '[0-9]{{8}}([ T]{_CLOCK})?') THEN 'bas'
       WHEN regexp_full_match(di, '[0-9]{{4}}-W[0-9]{{2}}(-[1-7])?') THEN 'wk'
       WHEN regexp_full_match(di, '[0-9]{{4}}W[0-9]{{2}}([1-7])?') THEN 'wkb'
       WHEN regexp_full_match(dv, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') THEN 'sl'
       WHEN regexp_full_match(dv, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} [0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}') THEN 'slc'
       WHEN regexp_full_match(dv, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} [0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}}') THEN 'dac'
  END AS form FROM {name}_0),
{name}_2 AS (SELECT *,
  CASE form WHEN 'ext' THEN substr(di, 1, 10) WHEN 'bas' THEN concat(substr(di, 1, 4), '-', substr(di, 5, 2), '-', substr(di, 7, 2)) END AS dday,
  CASE form WHEN 'ext' THEN substr(di, 12) WHEN 'bas' THEN substr(di, 10) END AS dclk,
  try_cast(split_part(dv, '/', 1) AS INT) AS s1, try_cast(split_part(dv, '/', 2) AS INT) AS s2 FROM {name}_1),
{name}_3 AS (SELECT *, rpad(replace(regexp_extract(dclk, '^[0-9:]*'), ':', ''), 6, '0') AS dhms,
  rpad(regexp_extract(regexp_replace(dclk, '[+-].*$', ''), '[.]([0-9]+)', 1), 6, '0') AS dfrac FROM {name}_2),
{name} AS (SELECT * EXCLUDE (dv, di, form, dday, dclk, s1, s2, dhms, dfrac, ts0), ts0 AS dts,
  CASE WHEN ts0 IS NULL THEN NULL WHEN form IN ('ext', 'bas', 'wk', 'wkb') THEN CASE WHEN contains(dv, 'T') THEN 'ISO-8601' ELSE '%Y-%m-%d' END
       WHEN form = 'sl' THEN CASE WHEN s1 > 12 THEN '%d/%m/%Y' ELSE '%m/%d/%Y' END
       WHEN form = 'slc' THEN '%m/%d/%Y %H:%M:%S' ELSE '%Y-%m-%d %H:%M:%S' END AS dfmt,
  coalesce(form = 'sl' AND s1 <= 12 AND s2 <= 12, false) AS amb
 FROM (SELECT *, CASE
    WHEN form IN ('ext', 'bas') THEN try_cast(concat(dday, ' ', substr(dhms, 1, 2), ':', substr(dhms, 3, 2), ':', substr(dhms, 5, 2), '.', dfrac) AS TIMESTAMP)
    WHEN form IN ('wk', 'wkb') AND CAST(regexp_extract(di, 'W([0-9]{{2}})', 1) AS INT) BETWEEN 1 AND 52
      THEN try_strptime(concat(substr(di, 1, 4), '-W', regexp_extract(di, 'W([0-9]{{2}})', 1), '-', coalesce(nullif(regexp_extract(di, 'W[0-9]{{2}}-?([1-7])', 1), ''), '1')), '%G-W%V-%u')
    WHEN form = 'sl' AND s1 <= 12 AND s2 <= 12 THEN NULL
    WHEN form = 'sl' AND s1 > 12 THEN try_strptime(dv, '%d/%m/%Y')
    WHEN form = 'sl' THEN try_strptime(dv, '%m/%d/%Y')
    WHEN form = 'slc' THEN try_strptime(dv, '%m/%d/%Y %H:%M:%S')
    WHEN form = 'dac' THEN try_strptime(dv, '%Y-%m-%d %H:%M:%S') END AS ts0 FROM {name}_3))"""


IS_MONEY = f"coalesce(concept IN {MONEY}, false)"
PARSED = numbers_cte("vc", "vn", IS_MONEY) + "," + dates_cte("vn", "parsed")

FACTS = """
facts AS (SELECT file_id, position, name, concept,
  sum(cnt) AS n_rows, sum(CASE WHEN value = '' THEN cnt ELSE 0 END) AS n_null,
  count(*) FILTER (value <> '') AS n_distinct,
  coalesce(sum(cnt) FILTER (valid), 0) AS n_num, coalesce(sum(cnt) FILTER (valid AND num = floor(num)), 0) AS n_int,
  coalesce(sum(cnt) FILTER (dts IS NOT NULL), 0) AS n_date, coalesce(sum(cnt) FILTER (amb), 0) AS n_amb,
  coalesce(sum(cnt) FILTER (dts = date_trunc('day', dts)), 0) AS n_mid,
  coalesce(sum(cnt) FILTER (lower(value) IN ('true', 'false', 'yes', 'no', '0', '1')), 0) AS n_bool,
  bool_or(contains(upper(value), 'PHP') OR contains(value, '$') OR contains(value, '₱')) AS marked,
  arg_min(ntext, (num, first_row)) FILTER (valid) AS lo, arg_max(ntext, (num, -first_row)) FILTER (valid) AS hi,
  CAST(sum(num * cnt) FILTER (valid) AS DECIMAL(38,10)) AS total,
  min(value) FILTER (value <> '') AS lo_text, max(value) FILTER (value <> '') AS hi_text,
  min(length(value)) FILTER (value <> '') AS lo_len, max(length(value)) FILTER (value <> '') AS hi_len,
  sum(length(value) * cnt) FILTER (value <> '') AS sum_len,
  min(dts) AS lo_ts, max(dts) AS hi_ts,
  list_sort(list(DISTINCT dfmt) FILTER (dfmt IS NOT NULL)) AS fmts
 FROM parsed GROUP BY ALL),
typed AS (SELECT *, n_rows - n_null AS n_full,
  CASE WHEN concept = 'transaction_date' AND n_date > 0 THEN 'date' WHEN concept = 'identifier' THEN 'identifier'
       WHEN n_rows > n_null AND n_num = n_rows - n_null THEN
         CASE WHEN concept IN ('amount', 'debit', 'credit', 'balance') THEN 'currency' WHEN n_int = n_num THEN 'integer' ELSE 'decimal' END
       WHEN n_rows > n_null AND n_date + n_amb = n_rows - n_null THEN CASE WHEN n_mid = n_date THEN 'date' ELSE 'datetime' END
       WHEN n_rows > n_null AND n_bool = n_rows - n_null THEN 'boolean' ELSE 'text' END AS kind FROM facts),
spread AS (SELECT file_id, position,
  CAST(CAST(sqrt(sum(cnt * power(CAST(num AS DOUBLE) - CAST(mu AS DOUBLE), 2)) / sum(cnt)) AS DECIMAL(24,6)) AS VARCHAR) AS sd
 FROM parsed JOIN (SELECT file_id, position, CAST(total AS DOUBLE) / CAST(n_num AS DOUBLE) AS mu FROM facts WHERE n_num > 0) USING (file_id, position)
 WHERE valid GROUP BY ALL),
expanded AS (SELECT file_id, position, num, sum(cnt) OVER w AS upto, cnt, sum(cnt) OVER (PARTITION BY file_id, position) AS n
 FROM (SELECT file_id, position, num, sum(cnt) AS cnt FROM parsed WHERE valid AND value <> '' GROUP BY ALL)
 WINDOW w AS (PARTITION BY file_id, position ORDER BY num ROWS UNBOUNDED PRECEDING)),
med AS (SELECT file_id, position, CAST(CAST((max(num) FILTER (upto - cnt < (n + 1) // 2 AND upto >= (n + 1) // 2)
   + max(num) FILTER (upto - cnt < n // 2 + 1 AND upto >= n // 2 + 1)) AS DOUBLE) / 2 AS DECIMAL(24,6)) AS median
 FROM expanded GROUP BY ALL),
smp AS (SELECT file_id, position, string_agg(value, '¦' ORDER BY first_row) AS samples
 FROM (SELECT *, row_number() OVER (PARTITION BY file_id, position ORDER BY first_row, value) AS rk FROM vc WHERE value <> '')
 WHERE rk <= 5 GROUP BY ALL)"""

NUMERIC = "kind IN ('integer', 'decimal', 'currency') AND n_num > 0"
DATED = "kind IN ('date', 'datetime') AND n_date > 0"
TEXTUAL = "kind IN ('text', 'identifier') AND lo_text IS NOT NULL"
MINIMUM = f"CASE WHEN {NUMERIC} THEN lo WHEN {DATED} THEN strftime(lo_ts, '%Y-%m-%d') WHEN {TEXTUAL} THEN lo_text END AS minimum_value"
MAXIMUM = f"CASE WHEN {NUMERIC} THEN hi WHEN {DATED} THEN strftime(hi_ts, '%Y-%m-%d') WHEN {TEXTUAL} THEN hi_text END AS maximum_value"
MEAN = f"CASE WHEN {NUMERIC} THEN CAST(CAST(CAST(total AS DOUBLE) / CAST(n_num AS DOUBLE) AS DECIMAL(24,6)) AS VARCHAR) END AS mean_value"
STDDEV = f"CASE WHEN {NUMERIC} THEN sd END AS standard_deviation"
FORMATS = (
    f"CASE WHEN {NUMERIC} THEN CASE WHEN marked THEN 'currency' ELSE 'numeric' END "
    f"WHEN {DATED} THEN array_to_string(fmts, '¦') ELSE '' END AS detected_formats"
)
LENGTHS = (
    f"CASE WHEN {TEXTUAL} THEN CAST(lo_len AS VARCHAR) END AS minimum_length, "
    f"CASE WHEN {TEXTUAL} THEN CAST(hi_len AS VARCHAR) END AS maximum_length, "
    f"CASE WHEN {TEXTUAL} THEN CAST(CAST(CAST(sum_len AS DOUBLE) / CAST(n_full AS DOUBLE) AS DECIMAL(12,4)) AS VARCHAR) END AS average_length"
)
DAYS = (
    f"CASE WHEN {DATED} THEN strftime(lo_ts, '%Y-%m-%d') END AS earliest_date, "
    f"CASE WHEN {DATED} THEN strftime(hi_ts, '%Y-%m-%d') END AS latest_date"
)
NULLS = (
    "CAST(n_rows AS BIGINT) AS row_count, CAST(n_null AS BIGINT) AS null_count, CAST(n_full AS BIGINT) AS non_null_count"
)
NULL_SHARE = "CAST(CAST(CAST(n_null AS DOUBLE) / CAST(n_rows AS DOUBLE) * 100 AS DECIMAL(7,4)) AS VARCHAR) AS null_percentage"
DISTINCT = "n_distinct AS unique_count, CAST(greatest(n_full - n_distinct, 0) AS BIGINT) AS duplicate_value_count"

# --- ledgers: m = movement, r = reported balance ---


def walk_cte(source: str, movement: str) -> str:
    """rows with movement, running expectation and scales of table ``source``; ``movement`` computes it."""
    return f"""
{numbers_cte(source, "lb", "true", "balance").strip()},
{movement},
walk0 AS (SELECT *, CASE WHEN contains(btext, '.') THEN length(split_part(btext, '.', 2)) ELSE 0 END AS bsc FROM mv),
per AS (SELECT file_id, count(*) AS n, count(m) AS nm, count(r) AS nr, arg_min(r, row_no) - arg_min(m, row_no) AS opening,
   arg_max(r, row_no) FILTER (r IS NOT NULL) AS closing, arg_min(bsc, row_no) AS osc FROM walk0 GROUP BY file_id),
walk AS (SELECT w.*, opening, nm = n AND nr = n AS verifiable,
   opening + sum(m) OVER (PARTITION BY file_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS expected,
   greatest(osc, max(msc) OVER (PARTITION BY file_id ORDER BY row_no ROWS UNBOUNDED PRECEDING)) AS sc
 FROM walk0 w JOIN per USING (file_id)),
checked AS (SELECT *, abs(expected - r) <= 0.01 AS matches,
   substr(CAST(CAST(expected AS DECIMAL(38,10)) AS VARCHAR), 1, CAST(length(CAST(CAST(expected AS DECIMAL(38,10)) AS VARCHAR)) - 10 + sc - CASE WHEN sc = 0 THEN 1 ELSE 0 END AS INT)) AS etext
 FROM walk WHERE verifiable),
summary AS (SELECT file_id, nm = n AND nr = n AS verifiable, opening, closing, calc, bad FROM per
   LEFT JOIN (SELECT file_id, arg_max(expected, row_no) AS calc, count(*) FILTER (NOT matches) AS bad FROM checked GROUP BY file_id) USING (file_id)
   WHERE nr > 0)"""


def scale(text: str) -> str:
    return f"CASE WHEN contains({text}, '.') THEN length(split_part({text}, '.', 2)) ELSE 0 END"


AMOUNT_MOVES = (
    numbers_cte("(SELECT * RENAME (num AS r, ntext AS btext, valid AS bvalid) FROM lb)", "la", "true", "amount").strip()
    + f",\nmv AS (SELECT *, num AS m, coalesce({scale('ntext')}, 0) AS msc FROM la)"
)
SIDE_MOVES = (
    numbers_cte("(SELECT * RENAME (num AS r, ntext AS btext, valid AS bvalid) FROM lb)", "ld", "true", "debit").strip()
    + ","
    + numbers_cte("(SELECT * RENAME (num AS dnum, ntext AS dtext, valid AS dvalid) FROM ld)", "lc", "true", "credit")
    + f""",
mv AS (SELECT *, CASE WHEN credit = '' THEN 0 ELSE num END - CASE WHEN debit = '' THEN 0 ELSE dnum END AS m,
  greatest(coalesce({scale('ntext')}, 0), coalesce({scale('dtext')}, 0)) AS msc FROM lc)"""
)
LEDGER_WALK = walk_cte("ledger", AMOUNT_MOVES)
SIDES_WALK = walk_cte("sides", SIDE_MOVES)


def money24(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(24,6)) AS VARCHAR)"


SUMMARY_SELECT = f"""SELECT file_id, verifiable, CASE WHEN verifiable THEN {money24('opening')} END AS opening_balance,
  {money24('closing')} AS closing_balance, CASE WHEN verifiable THEN {money24('calc')} END AS calculated_closing_balance,
  CASE WHEN verifiable THEN CASE WHEN bad = 0 THEN 'true' ELSE 'false' END END AS running_balance_valid FROM summary"""
RUNNING_SELECT = "SELECT file_id, row_no, btext AS reported, etext AS expected, matches FROM checked"

# --- findings ---


def finding(source: str, code: str, severity: str, message: str, *, column="NULL", row="NULL", observed="NULL", expected="NULL", where="true") -> str:
    text = message if message.startswith("concat(") else q(message)
    return (
        f"SELECT CAST(file_id AS VARCHAR) AS file_id, CAST({column} AS VARCHAR) AS column_name, CAST({row} AS VARCHAR) AS row_number, "
        f"{q(code)} AS issue_code, {q(severity)} AS severity, {text} AS message, "
        f"CAST({observed} AS VARCHAR) AS observed_value, CAST({expected} AS VARCHAR) AS expected_value FROM {source} WHERE {where}"
    )


def union(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


CELL = dict(column="name", row="row_no")
R_NULLS = finding("cells", "unexpected_null_value", "warning", "A financial candidate column contains a null value.",
                  **CELL, where=f"value = '' AND (concept IN {MONEY} OR concept = 'transaction_date')")
CELL_NUMBERS = numbers_cte("cells", "cn", IS_MONEY)
CELL_DATES = dates_cte("(SELECT * FROM cells WHERE concept = 'transaction_date' AND value <> '')", "cd")
R_MONEY = finding("cn", "invalid_monetary_value", "error", "Value cannot be parsed as money.", **CELL, observed="value",
                  where=f"value <> '' AND concept IN {MONEY} AND NOT valid")
R_DATE = union(
    finding("cd", "invalid_date_value", "warning", "Date is ambiguous and was not accepted.", **CELL, observed="value", where="amb"),
    finding("cd", "invalid_date_value", "error", "Value cannot be parsed as a supported date.", **CELL, observed="value",
            where="dts IS NULL AND NOT amb"),
)
R_MISSING_ID = finding("cells", "missing_transaction_identifier", "error", "Transaction identifier is missing.", **CELL,
                       where="value = '' AND concept = 'identifier'")
R_REPEATED_ID = finding(
    "(SELECT *, count(*) OVER (PARTITION BY file_id, position, value) AS c FROM cells WHERE concept = 'identifier' AND value <> '')",
    "duplicate_transaction_identifier", "error", "Transaction identifier is duplicated.", **CELL, observed="value", where="c > 1",
)
R_NUMERIC = finding(
    "(SELECT cn.*, n_num, n_full FROM cn JOIN typed USING (file_id, position) WHERE cn.concept IS NULL)",
    "invalid_numeric_value", "error", "Value is inconsistent with the numeric values in this column.", **CELL, observed="value",
    where="value <> '' AND NOT valid AND n_num > 0 AND n_num < n_full AND CAST(n_num AS DOUBLE) / CAST(n_full AS DOUBLE) >= 0.8",
)
R_COLUMN = union(
    finding("typed", "inconsistent_date_formats", "warning", "Column contains multiple date formats.", column="name",
            observed="array_to_string(fmts, ', ')", where="len(fmts) > 1"),
    finding("typed", "all_null_column", "warning", "Column contains only null values.", column="name", where="n_full = 0"),
    finding("typed", "constant_value_column", "info", "Column contains one constant value.", column="name", observed="lo_text",
            where="n_distinct = 1 AND n_full > 1"),
    finding("typed", "high_null_percentage", "warning", "Column null percentage exceeds the configured threshold.", column="name",
            observed="printf('%.2f%%', CAST(n_null AS DOUBLE) / CAST(n_rows AS DOUBLE) * 100)", expected="'<50.00%'",
            where="CAST(n_null AS DOUBLE) / CAST(n_rows AS DOUBLE) * 100 >= 50 AND n_full > 0"),
)
R_BALANCE = union(
    finding("checked", "invalid_running_balance", "error", "Reported running balance does not match calculated balance.",
            column="'balance'", row="row_no", observed="btext", expected="etext", where="NOT matches"),
    finding("checked", "unexpected_negative_balance", "warning", "Running balance is negative.", column="'balance'", row="row_no",
            observed="btext", where="r < 0"),
    finding("summary", "running_balance_not_verifiable", "warning",
            "Running balance cannot be reliably validated from available columns.", where="NOT verifiable"),
)
DUPLICATE_ROWS = f"""
dup AS (SELECT file_id, CAST(sum(c - 1) AS BIGINT) AS d FROM
  (SELECT file_id, {", ".join(LEDGER_COLUMNS)}, count(*) AS c FROM ledger GROUP BY ALL) GROUP BY file_id)"""
R_DUPLICATE = finding("dup", "duplicate_rows", "warning", "concat('Found ', d, ' duplicate data row(s).')", observed="d", where="d > 0")

CELLS = cells_cte("ledger", LEDGER_COLUMNS)
STATS = [LEDGER, CELLS, VALUE_COUNTS, PARSED, FACTS]
ISSUES_CTE = "issues AS (" + union(R_NULLS, R_MONEY, R_DATE, R_MISSING_ID, R_REPEATED_ID, R_NUMERIC, R_COLUMN, R_BALANCE, R_DUPLICATE) + ")"
ISSUES = [*STATS, CELL_NUMBERS, CELL_DATES, LEDGER_WALK, DUPLICATE_ROWS, ISSUES_CTE]
FINGERPRINT = "sha256(concat(file_id, '|1.0.0|', issue_code, '|', coalesce(column_name, ''), '|', coalesce(row_number, '')))"
PROFILE_ID = "sha256(concat(file_id, '|1.0.0'))"


def _with(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


# --- files ---

FILE_KEY = f"concat(file_id, '-', (row_no - 2) // {FILE_ROWS})"
_DELIMITER = "CASE CAST(file_id AS BIGINT) % 4 " + " ".join(
    f"WHEN {i} THEN " + ("chr(9)" if d == "\t" else q(d)) for i, d in enumerate(DELIMITERS)
) + " END"
CLEAN_FILES = f"""
lines AS (SELECT {FILE_KEY} AS file_key, {_DELIMITER} AS delimiter, row_no, [{", ".join(FILE_COLUMNS)}] AS fields,
   {", ".join(FILE_COLUMNS)} FROM ledger),
files AS (SELECT file_key, delimiter, concat(concat_ws(delimiter, {", ".join(q(c) for c in FILE_COLUMNS)}), chr(10),
   string_agg(concat_ws(delimiter, {", ".join(FILE_COLUMNS)}), '\n' ORDER BY row_no), chr(10)) AS text FROM lines GROUP BY file_key, delimiter),
known AS (SELECT *, sha256(text) AS file_id FROM files)"""
FLAWED = f"""
shaped AS (SELECT {FILE_KEY} AS file_key, row_no, CASE WHEN row_no % 11 = 0 THEN [{", ".join(FILE_COLUMNS)}, 'extra', 'extra']
   WHEN row_no % 13 = 0 THEN [{", ".join(FILE_COLUMNS[:3])}] ELSE [{", ".join(FILE_COLUMNS)}] END AS fields FROM ledger),
lines AS (
  SELECT file_key, row_no, 0 AS sub, ['', '  '] AS fields FROM shaped WHERE row_no % 7 = 0
  UNION ALL SELECT file_key, row_no, 1, CASE WHEN row_no % 5 = 0 THEN list_transform(fields, lambda f: concat(' ', f, ' ')) ELSE fields END FROM shaped
  UNION ALL SELECT file_key, row_no, 2, fields FROM shaped WHERE row_no % 17 = 0
  UNION ALL SELECT file_key, row_no, 3, CAST([] AS VARCHAR[]) FROM shaped WHERE row_no % 19 = 0),
numbered AS (SELECT file_key, fields, 1 + row_number() OVER (PARTITION BY file_key ORDER BY row_no, sub) AS record_no,
    sub IN (1, 2) AS kept FROM lines),
recs AS (SELECT file_key AS file_id, record_no, fields, kept,
    CASE WHEN kept THEN 1 + sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY file_key ORDER BY record_no) END AS row_no FROM numbered
  UNION ALL SELECT DISTINCT file_key, 1, [{", ".join(q(c) for c in FILE_COLUMNS)}], NULL, NULL FROM shaped),
trimmed AS (SELECT * EXCLUDE (fields), list_transform(fields, lambda f: trim(f)) AS fields, len(fields) AS n FROM recs),
fitted AS (SELECT * EXCLUDE (fields), list_concat(fields[1:5], list_transform(range(greatest(5 - n, 0)), lambda i: '')) AS fields
  FROM trimmed WHERE row_no IS NOT NULL)"""
LIMITED = """SELECT r.file_id, record_no, CAST(CAST(row_no AS BIGINT) AS VARCHAR) AS row_no FROM recs r
  LEFT JOIN (SELECT file_id, record_no AS stop FROM recs WHERE row_no = 21) USING (file_id)
  WHERE stop IS NULL OR record_no <= stop"""
FLAWED_DUPLICATES = "dups AS (SELECT file_id, CAST(sum(c - 1) AS BIGINT) AS duplicate_row_count FROM (SELECT file_id, fields, count(*) AS c FROM fitted GROUP BY ALL) GROUP BY file_id)"

ENCODED = """
enc AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN concat(' ', chr(10), chr(9), ' ') ELSE text END AS body,
  doc_id % 5 = 0 AS bom, doc_id % 5 <> 0 AND doc_id % 7 = 0 AS broken FROM documents),
classed AS (SELECT *, CASE WHEN broken THEN 'unsupported_encoding' WHEN trim(body, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty_file' ELSE 'readable' END AS file_class FROM enc)"""

_PICKS = ", ".join(f"names[(CAST(c_custkey * {i + 1} + (c_custkey // 7) * {i} AS BIGINT) % {len(HEADER_NAMES)}) + 1]" for i in range(5))
HEADERS = f"""
named AS (SELECT CAST(c_custkey AS VARCHAR) AS file_id, CASE WHEN c_custkey % 50 = 0 THEN ['', ''] ELSE
   list_transform([{_PICKS}], lambda x: trim(x)) END AS names
  FROM customer, (SELECT [{", ".join(q(n) for n in HEADER_NAMES)}] AS names)),
aliases AS (SELECT * FROM (VALUES {", ".join(f"({q(n)}, {q(c)})" for n, c in NAME_CONCEPTS.items())}) AS v(alias, concept)),
hcols AS (SELECT file_id, i AS position, names[i + 1] AS name, names FROM (SELECT file_id, names, unnest(range(len(names))) AS i FROM named)),
hc0 AS (SELECT h.*, a.concept AS c0 FROM hcols h LEFT JOIN aliases a ON h.name = a.alias),
hc AS (SELECT file_id, position, name, names, CASE WHEN first_value(name) OVER (PARTITION BY file_id, c0 ORDER BY position) = name THEN c0 END AS concept FROM hc0)"""
R_HEADERS = union(
    finding("(SELECT * FROM named WHERE len(list_filter(names, lambda x: x <> '')) = 0)", "missing_header", "critical", "The CSV does not contain a usable header."),
    finding("(SELECT file_id, min(position) AS position FROM hcols WHERE name = '' AND len(list_filter(names, lambda x: x <> '')) > 0 GROUP BY file_id)",
            "blank_column_name", "error", "A column name is blank.", row="1", observed="position + 1"),
    finding("(SELECT file_id, name, count(*) AS c FROM hcols WHERE name <> '' GROUP BY ALL)", "duplicate_column_name", "error",
            "A column name occurs more than once.", column="name", where="c > 1"),
)

# --- landed files ---

LANDING = """
systems AS (SELECT DISTINCT source AS code, source <> 'src3' AS is_active FROM documents WHERE source <> 'src7'),
landed AS (SELECT doc_id, lang, source, text, concat('landing/', doc_id) AS path,
  CASE doc_id % 23 WHEN 0 THEN 'folder/file.csv' WHEN 1 THEN 'ledger.txt' WHEN 2 THEN '..\\escape.csv' WHEN 3 THEN '..'
    WHEN 4 THEN '  ' WHEN 5 THEN '€€.€' WHEN 6 THEN concat('Café ', left(text, 220), '.csv')
    WHEN 7 THEN concat(repeat('long name ', 24), '.csv') ELSE concat('Doc ', doc_id, ' (', lang, ').CSV') END AS original_filename,
  CASE doc_id % 29 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL WHEN 2 THEN 'Text/CSV; charset=utf-8' WHEN 3 THEN '' ELSE 'text/csv' END AS mime,
  doc_id % 97 AS seconds, strlen(text) AS size, sha256(text) AS checksum FROM documents),
safe0 AS (SELECT *, trim(original_filename, ' ' || chr(9) || chr(10) || chr(13)) AS bare FROM landed),
safe1 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(bare), '[^\\x00-\\x7F]', '', 'g'),
   '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._') AS s FROM safe0),
safe2 AS (SELECT *, regexp_extract(s, '^.+?([.][^.]+)$', 1) AS suffix FROM safe1),
safe AS (SELECT *, CASE WHEN length(s) > 180 THEN concat(left(left(s, length(s) - length(suffix)), 180 - length(suffix)), suffix) ELSE s END AS sanitized FROM safe2),
checked_files AS (SELECT l.*, lower(suffix) AS ext,
  lower(split_part(CASE WHEN mime IS NULL OR mime = '' THEN 'application/octet-stream' ELSE mime END, ';', 1)) AS kind,
  CASE WHEN y.code IS NULL THEN 1
    WHEN bare = '' OR length(bare) > 255 OR contains(bare, '/') OR contains(bare, chr(92)) OR bare IN ('.', '..') THEN 2
    WHEN s = '' THEN 3 WHEN lower(suffix) <> '.csv' THEN 4
    WHEN lower(split_part(CASE WHEN mime IS NULL OR mime = '' THEN 'application/octet-stream' ELSE mime END, ';', 1)) NOT IN
      ('text/csv', 'application/csv', 'application/vnd.ms-excel', 'text/plain', 'application/octet-stream') THEN 5
    WHEN size > 16000 THEN 6 ELSE 0 END AS failed
  FROM safe l LEFT JOIN systems y ON y.code = l.source AND y.is_active),
outcome AS (SELECT *, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS wave,
  CASE failed WHEN 1 THEN 'missing_source_system' WHEN 2 THEN 'invalid_filename' WHEN 3 THEN 'invalid_filename'
    WHEN 4 THEN 'unsupported_extension' WHEN 5 THEN 'invalid_mime_type' WHEN 6 THEN 'file_too_large' END AS error_code,
  CASE failed WHEN 1 THEN 'The selected source system does not exist or is inactive.'
    WHEN 2 THEN 'The uploaded filename is invalid or contains a path.' WHEN 3 THEN 'The uploaded filename does not contain a usable name.'
    WHEN 4 THEN 'Only .csv files are allowed.' WHEN 5 THEN concat('MIME type ''', kind, ''' is not allowed.')
    WHEN 6 THEN 'The file exceeds the 16000-byte limit.' END AS error_message FROM checked_files),
res AS (SELECT *, concat(checksum, '_', sanitized) AS stored, CASE WHEN failed > 0 THEN 'failed'
   WHEN row_number() OVER (PARTITION BY checksum, failed > 0 ORDER BY wave, seconds, path) = 1 THEN 'registered' ELSE 'duplicate' END AS status,
   sha256(concat('source_file_upload|wave-', wave, '|', path)) AS run_id FROM outcome)"""
# The same without a size limit.
ANY_SIZE = LANDING.replace("size > 16000", "false")

_ORDERS = """
orders_text AS (SELECT CAST(o_custkey AS VARCHAR) AS file_id, 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no,
  concat('O-', o_orderkey) AS order_id, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority, o_orderkey FROM orders)"""

_PLAIN = "concat(abs(c) // 100, '.', lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0'))"
_NOTATIONS = ["{}", "${}", "PHP {}", "php{}", "({})", "($ {})", "$({})", "-${}", "€{}", "£ {}", "₱{}", "+{}", "00{}",
              "1,{}", " {} ", " {} ", "{}e5", "-{}", "- {}", "(-{})", "{}.", "PHP", "", "n/a"]
_MONEY_FORMS = ["replace(" + q(n) + f", '{{}}', {_PLAIN})" for n in _NOTATIONS] + [
    "concat('.', lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0'))", "CAST(abs(c) // 100 AS VARCHAR)", "concat(abs(c) // 100, '.')",
    "'0.00'", "'(0.00)'", "'-0'",
]
MONEY_TEXTS = f"""
texts AS (SELECT event_id, CASE event_id % {len(_MONEY_FORMS)} {" ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_MONEY_FORMS))} END AS v
  FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS c FROM events))"""
_ISO = ["'%Y-%m-%d'", "'%Y%m%d'", "'%Y-%m-%dT%H:%M:%S'", "'%Y-%m-%d %H:%M'", "'%Y-%m-%dT%H:%M:%S.%fZ'", "'%Y%m%dT%H%M%S+05:30'",
        "'%G-W%V-%u'", "'%GW%V%u'", "'%G-W%V'", "'%d/%m/%Y'", "'%-m/%-d/%Y'", "'%-m/%-d/%Y %-H:%-M:%-S'", "'%Y-%-m-%-d %-H:%-M:%-S'",
        "'%Y-%m-31'", "'%Y-W60-1'", "'%Y'", "'%Y-%m'", "'%H:%M:%S'", "'%Y-%m-%dT25:00'"]
_DATE_FORMS = [f"strftime(ts, {f})" for f in _ISO] + ["'bad'", "''", "'13/13/2024'", "'00/20/2024'", "strftime(ts, ' %Y-%m-%d ')"]
DATE_TEXTS = f"""
texts AS (SELECT event_id, CASE event_id % {len(_DATE_FORMS)} {" ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_DATE_FORMS))} END AS v FROM events)"""
NUMBER_SELECT = "SELECT event_id, valid, CAST(num AS VARCHAR) AS amount, ntext AS normalized FROM n"

STATUS = "CASE WHEN bool_or(severity = 'critical') THEN 'blocked' WHEN count(issue_code) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status"
ROLLUP = """
roll AS (SELECT file_id, CAST(sum(n_null) AS BIGINT) AS total_null_count, CAST(sum(n_full) AS BIGINT) AS total_non_null_count,
  count(*) FILTER (kind IN ('integer', 'decimal', 'currency')) AS total_numeric_columns,
  count(*) FILTER (kind IN ('date', 'datetime')) AS total_date_columns,
  count(*) FILTER (kind IN ('text', 'identifier')) AS total_text_columns, count(*) FILTER (kind = 'boolean') AS total_boolean_columns,
  strftime(min(lo_ts) FILTER (kind IN ('date', 'datetime')), '%Y-%m-%d') AS date_range_start,
  strftime(max(hi_ts) FILTER (kind IN ('date', 'datetime')), '%Y-%m-%d') AS date_range_end FROM typed GROUP BY file_id)"""
LEDGER_TOTALS = f"""
totals AS (SELECT file_id, {money24("sum(num)")} AS monetary_total FROM la GROUP BY file_id)"""

FULL_PROFILE = f"""SELECT file_id, position AS column_position, name AS column_name, kind AS inferred_data_type, {NULLS}, {DISTINCT},
  {MINIMUM}, {MAXIMUM}, {NULL_SHARE}, {MEAN}, CASE WHEN {NUMERIC} THEN CAST(median AS VARCHAR) END AS median_value, {STDDEV}, {LENGTHS}, {DAYS},
  coalesce(samples, '') AS sample_values, {FORMATS}
 FROM typed LEFT JOIN spread USING (file_id, position) LEFT JOIN med USING (file_id, position) LEFT JOIN smp USING (file_id, position)"""

_ORDER_CELLS = cells_cte("(SELECT * REPLACE ('all' AS file_id, o_orderkey + 2 AS row_no) FROM orders_text)", ORDER_COLUMNS)

FILE_LEVEL = [*ISSUES, ROLLUP, LEDGER_TOTALS]
CORPUS_ROWS = f"""
part_rows AS (SELECT {FILE_KEY} AS file_key, 2 + (row_no - 2) % {FILE_ROWS} AS row_no, {", ".join(FILE_COLUMNS)} FROM ledger),
part_ledger AS (SELECT p.* EXCLUDE (file_key), k.file_id, k.file_key FROM part_rows p JOIN known k USING (file_key))"""
CORPUS = [LEDGER, CLEAN_FILES, CORPUS_ROWS, cells_cte("part_ledger", FILE_COLUMNS), VALUE_COUNTS, PARSED, FACTS, CELL_NUMBERS, CELL_DATES,
          walk_cte("part_ledger", AMOUNT_MOVES),
          f"dup AS (SELECT file_id, CAST(sum(c - 1) AS BIGINT) AS d FROM (SELECT file_id, {', '.join(FILE_COLUMNS)}, count(*) AS c FROM part_ledger GROUP BY ALL) GROUP BY file_id)",
          ISSUES_CTE, ROLLUP, LEDGER_TOTALS]
PRESENT = "file_key NOT LIKE '%3-0'"
STEP_NAMES = ["load_registered_file", "detect_encoding_and_delimiter", "inspect_schema", "calculate_file_statistics",
              "calculate_column_statistics", "run_data_quality_rules", "validate_running_balance", "persist_profile", "finalize_profile"]

# Numbers with twenty decimal places, as whole numbers of the last place.
LONG_NUMBERS = """SELECT o_orderpriority AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END
  * (CAST(o_totalprice AS DECIMAL(18,2)) * 100)::HUGEINT * 1000000000000000000 + CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS x FROM orders"""


def _places(x: str, places: int) -> str:
    """Text of a whole number of the last place."""
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || abs({x}) // {10 ** places}::HUGEINT || '.' || lpad((abs({x}) % {10 ** places}::HUGEINT)::VARCHAR, {places}, '0'))"


def _sixth(above: str, below: str) -> str:
    """Text of a quotient with six places, halves away from zero; ``below`` is that of millionths."""
    return _places(f"(CASE WHEN {above} < 0 THEN -1 ELSE 1 END * ((2 * abs({above}) + {below}) // (2 * {below})))", 6)


ORACLES: dict[str, str] = {
    "x1_parse_money": _with([MONEY_TEXTS, numbers_cte("texts", "n", "true", "v")], NUMBER_SELECT),
    "x2_parse_number": _with([MONEY_TEXTS, numbers_cte("texts", "n", "false", "v")], NUMBER_SELECT),
    "x3_parse_date": _with(
        [DATE_TEXTS, dates_cte("texts", "d", "v")],
        "SELECT event_id, strftime(dts, '%Y-%m-%d %H:%M:%S.%f') AS moment, dfmt AS format, amb AS ambiguous FROM d",
    ),
    "x8_concepts": _with([HEADERS], "SELECT file_id, position, name, concept FROM hc"),
    "x10_sanitize": _with([LANDING], "SELECT doc_id, sanitized FROM safe"),
    "x11_checksum_names": """SELECT doc_id, sha256(text) AS checksum, concat(sha256(text), '_landing_', doc_id) AS stored_filename,
        concat('raw/registered/', sha256(text), '_landing_', doc_id) AS relative_path FROM documents""",
    "x17_profile_metadata": _with([HEADERS], """SELECT file_id, concat('{"column_names":[', list_aggregate(list_transform(any_value(names), lambda n: concat('"', n, '"')), 'string_agg', ','),
        '],"identified_columns":{', coalesce(string_agg(DISTINCT concat('"', concept, '":"', name, '"'), ',' ORDER BY concat('"', concept, '":"', name, '"')) FILTER (concept IS NOT NULL), ''),
        '},"running_balance_tolerance":0.01}') AS metadata FROM hc GROUP BY file_id"""),
    "s1_corpus_missing": _with([LEDGER, CLEAN_FILES], f"SELECT file_id AS source_file_id, file_key FROM known WHERE NOT ({PRESENT})"),
    "s2_encoding": _with([ENCODED], """SELECT doc_id, CASE WHEN broken THEN NULL WHEN bom THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding,
        CASE WHEN NOT broken THEN CAST(length(body) AS VARCHAR) END AS characters FROM enc"""),
    "s3_delimiter": _with([LEDGER, CLEAN_FILES], "SELECT file_key, delimiter FROM known"),
    "s4_records": _with([LEDGER, CLEAN_FILES], f"""SELECT file_id, 1 AS record_no, {q("¦".join(FILE_COLUMNS))} AS fields FROM known
        UNION ALL SELECT file_id, 1 + row_number() OVER (PARTITION BY file_key ORDER BY row_no), array_to_string(fields, '¦') FROM lines JOIN known USING (file_key)"""),
    "s5_headers": _with([LEDGER, FLAWED], "SELECT file_id, v.position, v.name, v.concept FROM (SELECT DISTINCT file_id FROM recs), (VALUES "
        + ", ".join(f"({i}, {q(c)}, {q(CONCEPT.get(c))})" for i, c in enumerate(FILE_COLUMNS)) + ") AS v(position, name, concept)"),
    "s6_file_class": _with([ENCODED], "SELECT doc_id, file_class FROM classed"),
    "s8_table_cells": _with([_ORDERS, cells_cte("orders_text", ORDER_COLUMNS)], "SELECT file_id, row_no, position, name, value FROM cells"),
    "p1_trim": _with([LEDGER, FLAWED], "SELECT file_id, record_no, array_to_string(fields, '¦') AS fields FROM trimmed"),
    "p2_fit_width": _with([LEDGER, FLAWED], "SELECT file_id, record_no, n AS n_fields, array_to_string(fields, '¦') AS fields FROM fitted"),
    "p4_empty_rows": _with([LEDGER, FLAWED], "SELECT file_id, record_no FROM recs WHERE kept OR record_no = 1"),
    "p5_row_limit": _with([LEDGER, FLAWED], LIMITED),
    "p5_parser_limit": _with([LEDGER, FLAWED], LIMITED),
    "p6_row_numbers": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no FROM events",
    "p8_ledger_view": _with([LEDGER], "SELECT file_id, row_no, 'balance' AS balance_name, amount, balance, CAST(NULL AS VARCHAR) AS debit FROM ledger"),
    "a21_value_counts": _with([LEDGER, CELLS, VALUE_COUNTS], "SELECT file_id, position, value, cnt, first_row FROM vc"),
    "a3_nulls": _with(STATS, f"SELECT file_id, position AS column_position, {NULLS}, {NULL_SHARE} FROM typed"),
    "a4_distinct": _with(STATS, f"SELECT file_id, position AS column_position, {DISTINCT} FROM typed"),
    "a5_numeric_stats": _with(STATS, f"""SELECT file_id, position AS column_position, {MINIMUM}, {MAXIMUM}, {MEAN}, {STDDEV}
        FROM typed LEFT JOIN spread USING (file_id, position) WHERE kind IN ('integer', 'decimal', 'currency')"""),
    "a5_orders_stats": _with([_ORDERS, _ORDER_CELLS, VALUE_COUNTS, PARSED, FACTS], f"""SELECT name AS column_name, kind AS inferred_data_type, n_distinct AS unique_count,
        {MINIMUM}, {MAXIMUM}, {MEAN}, {STDDEV}, {LENGTHS.split("maximum_length, ")[1]}, {DAYS.split(", CASE")[0]} FROM typed LEFT JOIN spread USING (file_id, position)"""),
    "a5_long_numbers": f"""WITH v AS ({LONG_NUMBERS}),
        f AS (SELECT file_id, count(*) AS n, min(x) AS low, max(x) AS high, sum(x)::HUGEINT AS total, list(x ORDER BY x) AS xs FROM v GROUP BY 1),
        m AS (SELECT *, xs[(n + 1) // 2] + xs[n // 2 + 1] AS middle FROM f)
        SELECT file_id, 'value' AS column_name, 'decimal' AS inferred_data_type, n AS unique_count, {_places("low", 20)} AS minimum_value,
          {_places("high", 20)} AS maximum_value, {_sixth("total", "n * 100000000000000")} AS mean_value, {_sixth("middle", "200000000000000::HUGEINT")} AS median_value FROM m
        UNION ALL SELECT file_id, 'large', 'integer', n, low || repeat('0', 14), high || repeat('0', 14), NULL, NULL FROM m""",
    "a16_long_totals": f"""SELECT file_id, {_sixth("sum(x)::HUGEINT", "100000000000000::HUGEINT")} AS monetary_total, NULL::VARCHAR AS debit_total,
        NULL::VARCHAR AS credit_total FROM ({LONG_NUMBERS}) GROUP BY 1""",
    "a7_median": _with(STATS, "SELECT file_id, position, CAST(median AS VARCHAR) AS median_value FROM med"),
    "a7_lineitem_median": """SELECT l_returnflag AS file_id, CAST(CAST(median(CAST(l_extendedprice AS DOUBLE)) AS DECIMAL(24,6)) AS VARCHAR) AS median_value
        FROM lineitem GROUP BY 1""",
    "a9_date_stats": _with(STATS, f"SELECT file_id, position AS column_position, {MINIMUM}, {MAXIMUM}, {DAYS}, {FORMATS} FROM typed WHERE kind IN ('date', 'datetime')"),
    "a11_text_stats": _with(STATS, f"SELECT file_id, position AS column_position, {MINIMUM}, {MAXIMUM}, {LENGTHS} FROM typed WHERE kind IN ('text', 'identifier')"),
    "a13_inferred_types": _with(STATS, "SELECT file_id, position AS column_position, kind AS inferred_data_type FROM typed"),
    "a14_formats": _with(STATS, f"SELECT file_id, position AS column_position, {FORMATS} FROM typed"),
    "w1_samples": _with(STATS, "SELECT file_id, position, samples AS sample_values FROM smp"),
    "a1_file_counts": _with([LEDGER, FLAWED], """SELECT file_id, count(*) FILTER (kept) AS row_count, 5 AS column_count,
        count(*) FILTER (NOT kept) AS empty_row_count FROM recs GROUP BY file_id"""),
    "a2_duplicate_rows": _with([LEDGER, FLAWED, FLAWED_DUPLICATES], "SELECT * FROM dups"),
    "a2_lineitem_duplicates": """SELECT CAST(l_suppkey AS VARCHAR) AS file_id, CAST(sum(c - 1) AS BIGINT) AS duplicate_row_count
        FROM (SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1""",
    "a15_file_rollup": _with([*STATS, ROLLUP], "SELECT * FROM roll"),
    "a16_control_totals": _with([LEDGER, LEDGER_WALK, LEDGER_TOTALS], "SELECT *, CAST(NULL AS VARCHAR) AS debit_total, CAST(NULL AS VARCHAR) AS credit_total FROM totals"),
    "a16_side_totals": _with([LEDGER, SIDES, SIDES_WALK], f"""SELECT file_id, CAST(NULL AS VARCHAR) AS monetary_total, {money24("sum(dnum)")} AS debit_total,
        {money24("sum(num)")} AS credit_total FROM lc GROUP BY file_id"""),
    "w3_closing_balance": _with([LEDGER, LEDGER_WALK], f"SELECT file_id, {money24('closing')} AS closing_balance FROM summary"),
    "w4_running_balance": _with([LEDGER, LEDGER_WALK], RUNNING_SELECT),
    "w4_side_balance": _with([LEDGER, SIDES, SIDES_WALK], RUNNING_SELECT),
    "w5_balance_summary": _with([LEDGER, LEDGER_WALK], SUMMARY_SELECT),
    "r_headers": _with([HEADERS], R_HEADERS),
    "r_file_rules": _with([ENCODED, HEADERS, LEDGER, FLAWED, FLAWED_DUPLICATES], union(
        finding("(SELECT doc_id AS file_id, file_class FROM classed)", "unsupported_encoding", "critical", "CSV encoding is not supported.", where="file_class = 'unsupported_encoding'"),
        finding("(SELECT doc_id AS file_id, file_class FROM classed)", "empty_file", "critical", "The registered CSV is empty.", where="file_class = 'empty_file'"),
        finding("""(SELECT concat('header ', file_id) AS file_id, count(*) FILTER (concept IN ('amount', 'debit', 'credit')) AS c,
            count(*) FILTER (name <> '') AS named FROM hc GROUP BY file_id)""", "required_financial_field_not_found", "warning",
            "No amount, debit, or credit candidate column was found.", where="c = 0 AND named > 0"),
        finding("(SELECT file_id, count(*) AS c FROM fitted GROUP BY file_id)", "profiling_row_limit", "warning",
            "Profiling stopped at the configured row safety limit.", where="c >= 60"),
        finding("dups", "duplicate_rows", "warning", "concat('Found ', duplicate_row_count, ' duplicate data row(s).')",
            observed="duplicate_row_count", where="duplicate_row_count > 0"),
    )),
    "r_shape": _with([LEDGER, FLAWED], union(
        finding("recs", "completely_empty_row", "info", "The row is completely empty.", row="record_no", where="NOT kept"),
        finding("recs", "row_too_many_fields", "error", "The row has more fields than the header.", row="record_no", observed="len(fields)", expected="5", where="kept AND len(fields) > 5"),
        finding("recs", "row_too_few_fields", "error", "The row has fewer fields than the header.", row="record_no", observed="len(fields)", expected="5", where="kept AND len(fields) < 5"),
    )),
    "r_nulls": _with([LEDGER, SIDES, cells_cte("sides", SIDES_COLUMNS)], R_NULLS),
    "r_invalid_money": _with([LEDGER, CELLS, CELL_NUMBERS], R_MONEY),
    "r_invalid_date": _with([LEDGER, CELLS, CELL_DATES], R_DATE),
    "r_identifiers": _with([LEDGER, CELLS], R_MISSING_ID),
    "r_duplicate_identifier": _with([LEDGER, CELLS], R_REPEATED_ID),
    "r_invalid_numeric": _with([*STATS, CELL_NUMBERS], R_NUMERIC),
    "r_column_rules": _with(STATS, R_COLUMN),
    "r_balance": _with([LEDGER, LEDGER_WALK], R_BALANCE),
    "u1_all_issues": _with(ISSUES, "SELECT * FROM issues"),
    "u4_fingerprints": _with(ISSUES, f"SELECT DISTINCT file_id, {FINGERPRINT} AS issue_fingerprint FROM issues"),
    "a17_issue_totals": _with(ISSUES, "SELECT file_id, severity, count(*) AS n FROM issues GROUP BY ALL"),
    "a18_status": _with(ISSUES, f"SELECT l.file_id, {STATUS} FROM (SELECT DISTINCT file_id FROM ledger) l LEFT JOIN issues i ON i.file_id = l.file_id GROUP BY l.file_id"),
    "column_profile": _with(STATS, FULL_PROFILE),
    "table_profile": _with(FILE_LEVEL, f"""SELECT l.file_id, s.status, l.n AS row_count, {len(LEDGER_COLUMNS)} AS column_count, 0 AS empty_row_count,
        d AS duplicate_row_count, r.* EXCLUDE (file_id), s.rule_issue_count, monetary_total, CAST(NULL AS VARCHAR) AS debit_total, CAST(NULL AS VARCHAR) AS credit_total,
        b.* EXCLUDE (file_id, verifiable)
      FROM (SELECT file_id, count(*) AS n FROM ledger GROUP BY file_id) l JOIN dup USING (file_id) JOIN roll r USING (file_id) JOIN totals USING (file_id)
      LEFT JOIN ({SUMMARY_SELECT}) b USING (file_id)
      JOIN (SELECT x.file_id, {STATUS}, count(issue_code) FILTER (issue_code NOT IN ('running_balance_not_verifiable', 'invalid_running_balance', 'unexpected_negative_balance')) AS rule_issue_count
            FROM (SELECT DISTINCT file_id FROM ledger) x LEFT JOIN issues i ON i.file_id = x.file_id GROUP BY x.file_id) s USING (file_id)"""),
    "f_register_checks": _with([LANDING], "SELECT path, error_code, error_message, kind AS normalized_mime_type, ext AS file_extension FROM outcome"),
    "j4_duplicate_files": """SELECT concat('landing/', doc_id) AS path, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id % 97, concat('landing/', doc_id)) = 1
        THEN 'registered' ELSE 'duplicate' END AS outcome FROM documents""",
    "b1_register_batch": _with([LANDING], """SELECT path, status, CASE WHEN status = 'duplicate' THEN 'duplicate' ELSE error_code END AS code,
        CASE WHEN status = 'duplicate' THEN 'This exact file has already been registered.' ELSE error_message END AS message,
        CASE WHEN status <> 'failed' THEN checksum END AS source_file_id FROM res"""),
    "b2_register_audit": _with([LANDING], r"""SELECT run_id, 'source_file_upload' AS run_type, status, CASE WHEN status <> 'failed' THEN checksum END AS source_file_id, error_message,
        'receive_and_register' AS step_name, concat('{"original_filename":', to_json(original_filename), ',"source_system_code":"', source, '"',
          CASE WHEN status = 'registered' THEN concat(',"stored_filename":"', stored, '"') ELSE '' END,
          CASE WHEN status <> 'failed' THEN concat(',"sha256_checksum":"', checksum, '"') ELSE '' END,
          CASE WHEN status = 'registered' THEN concat(',"file_size_bytes":', size) ELSE '' END, '}') AS metadata_json FROM res"""),
    "k1_registry": _with([ANY_SIZE], """SELECT checksum AS source_file_id, source AS source_system_code, original_filename, stored AS stored_filename,
        concat('raw/registered/', stored) AS relative_path, ext AS file_extension, kind AS mime_type, size AS file_size_bytes, 'registered' AS status FROM res WHERE status = 'registered'"""),
    "j1_files_with_system": _with([ANY_SIZE], "SELECT checksum AS source_file_id, original_filename, source AS source_system_code, concat('System ', source) AS source_system_name FROM res WHERE status = 'registered'"),
    "j2_runs_with_steps": _with([ANY_SIZE], "SELECT run_id, status, 1 AS n_steps, 'receive_and_register' AS step_name, status AS step_status FROM res"),
    "t4_system_page": _with([ANY_SIZE], "SELECT code, concat('System ', code) AS name, is_active FROM systems ORDER BY 2, 1 LIMIT 5 OFFSET 5"),
    "t5_file_page": _with([ANY_SIZE], "SELECT checksum AS source_file_id, original_filename FROM res WHERE status = 'registered' ORDER BY checksum DESC LIMIT 20 OFFSET 20"),
    "t6_run_page": _with([ANY_SIZE], "SELECT run_id, status FROM res ORDER BY run_id DESC LIMIT 20 OFFSET 40"),
    "f6_issue_filter": _with(ISSUES, f"""SELECT {FINGERPRINT} AS issue_fingerprint, file_id AS source_file_id, CAST(row_number AS BIGINT) AS row_number, observed_value FROM issues
        WHERE severity = 'error' AND issue_code = 'invalid_date_value' AND column_name = 'posted_date'"""),
    "t1_issue_page": _with(ISSUES, f"""SELECT * FROM (SELECT {FINGERPRINT} AS issue_fingerprint, file_id AS source_file_id, issue_code, CAST(NULL AS VARCHAR) AS total
        FROM issues WHERE severity = 'warning' ORDER BY 1 DESC LIMIT 50 OFFSET 100)
        UNION ALL SELECT NULL, NULL, NULL, CAST(count(*) AS VARCHAR) FROM issues WHERE severity = 'warning'"""),
    "t2_profile_page": _with([LEDGER], """SELECT file_id AS source_file_id, count(*) AS row_count, day FROM ledger, (VALUES ('2024-06-01'), ('2024-06-02')) AS v(day)
        WHERE file_id = '8' GROUP BY ALL"""),
    "t3_column_page": _with(STATS, "SELECT position AS column_position, name AS column_name, kind AS inferred_data_type FROM typed WHERE file_id = '8' ORDER BY position LIMIT 4 OFFSET 4"),
    "t7_latest_profile": _with([LEDGER], """SELECT file_id AS source_file_id, count(*) AS row_count, CASE WHEN CAST(file_id AS INT) % 2 = 0 THEN '2.0.0' ELSE '1.0.0' END AS profile_version,
        CASE WHEN CAST(file_id AS INT) % 2 = 0 THEN '2024-06-02' ELSE '2024-06-01' END AS day FROM ledger GROUP BY file_id"""),
    "j9_profile_with_file": _with([LEDGER], """SELECT file_id AS source_file_id, count(*) AS row_count, concat('ledger ', file_id, '.csv') AS original_filename, count(*) * 100 AS registered_size_bytes
        FROM ledger GROUP BY file_id"""),
    "f7_by_key": _with(ISSUES, f"""SELECT l.file_id AS source_file_id, l.n AS row_count, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "error", "warning", "info"))},
        {STATUS}, 9 AS n_steps, 'load_registered_file,detect_encoding_and_delimiter,inspect_schema,calculate_file_statistics,calculate_column_statistics,run_data_quality_rules,validate_running_balance,persist_profile,finalize_profile' AS steps
        FROM (SELECT file_id, count(*) AS n FROM ledger WHERE file_id = '8' GROUP BY 1) l LEFT JOIN issues i ON i.file_id = l.file_id GROUP BY l.file_id, l.n"""),
    "a17_profile_totals": _with(ISSUES, f"""SELECT l.file_id AS source_file_id, {STATUS}, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "error", "warning", "info"))}
        FROM (SELECT DISTINCT file_id FROM ledger) l LEFT JOIN issues i ON i.file_id = l.file_id GROUP BY l.file_id"""),
    "k3_latest_profiles": _with(ISSUES, f"""SELECT l.file_id AS source_file_id, '2024-06-02' AS day, '2024-06-01' AS created, '2024-06-02' AS updated, l.n AS row_count, {len(LEDGER_COLUMNS)} AS n_columns, coalesce(i.c, 0) AS n_issues, 2 AS n_runs
        FROM (SELECT file_id, count(*) AS n FROM ledger GROUP BY 1) l LEFT JOIN (SELECT file_id, count(*) AS c FROM issues GROUP BY 1) i USING (file_id)"""),
    "b3_profile_corpus": _with(CORPUS, f"""SELECT k.file_id AS source_file_id, s.status, 'utf-8' AS encoding, k.delimiter, l.n AS row_count, {len(FILE_COLUMNS)} AS column_count,
        0 AS empty_row_count, d AS duplicate_row_count, strlen(k.text) AS file_size_bytes, total_null_count, total_non_null_count, total_numeric_columns, total_date_columns,
        total_text_columns, monetary_total, b.* EXCLUDE (file_id, verifiable)
      FROM known k JOIN (SELECT file_id, count(*) AS n FROM part_ledger GROUP BY 1) l USING (file_id) JOIN dup USING (file_id) JOIN roll USING (file_id) JOIN totals USING (file_id)
      LEFT JOIN ({SUMMARY_SELECT}) b USING (file_id)
      JOIN (SELECT x.file_id, {STATUS} FROM known x LEFT JOIN issues i ON i.file_id = x.file_id GROUP BY x.file_id) s USING (file_id) WHERE {PRESENT}"""),
    "b4_profile_audit": _with(CORPUS, f"""SELECT k.file_id AS source_file_id, CASE WHEN {PRESENT} THEN s.status ELSE 'failed' END AS run_status, v.step_order, v.step_name,
        CASE WHEN {PRESENT} THEN 'completed' WHEN v.step_order = 1 THEN 'failed' ELSE 'pending' END AS status,
        CASE WHEN NOT ({PRESENT}) AND v.step_order = 1 THEN 'Registered source file is missing' END AS error_message
      FROM known k JOIN (SELECT x.file_id, {STATUS} FROM known x LEFT JOIN issues i ON i.file_id = x.file_id GROUP BY x.file_id) s USING (file_id),
        (VALUES {", ".join(f"({i}, {q(n)})" for i, n in enumerate(STEP_NAMES, 1))}) AS v(step_order, step_name)"""),
    "j3_unprofiled": _with([LEDGER, CLEAN_FILES], f"""SELECT file_id AS source_file_id, file_key, '1.0.0' AS version FROM known WHERE NOT ({PRESENT})
        UNION ALL SELECT file_id, file_key, '2.0.0' FROM known"""),
    "st1_incremental_intake": _with([LEDGER, CLEAN_FILES], """SELECT file_id AS source_file_id, 'registered' AS status, 1 AS n FROM known
        UNION ALL SELECT file_id, 'duplicate', 1 FROM known WHERE file_key < '3' AND file_key >= '2'
        UNION ALL SELECT sha256(''), unnest(['registered', 'duplicate']), 1"""),
}
