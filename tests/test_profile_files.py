"""Whole files through the corpus path; expected results as worked out by hand."""

import hashlib
from decimal import Decimal

import pytest

from ledgerlens.config import ProfilingConfig
from ledgerlens.plans.profile import profile_files

BOM = b"\xef\xbb\xbf"
FILES = {
    "tidy": b"reference,posted date,amount,balance\nr-1,2031-05-04,250.00,250.00\nr-2,2031-05-19,-40.00,210.00\n",
    "same_row_twice": b"id,total\nq7,81\nq7,81\n",
    "sparse": b"id,amount,memo\ns1,7,\ns2,,\ns3,,kept\n",
    "two_date_forms": b"id,date,total\nd1,2029-08-21,3\nd2,25/09/2029,4\n",
    "marked_amounts": b'id,total\nm1,"$2,400.75"\nm2,"(400.75)"\nm3,"PHP 10.00"\n',
    "word_for_amount": b"id,amount\nw1,6\nw2,pending\n",
    "identifier_twice": b"id,amount\nz9,12\nz9,36\n",
    "balance_off": b"id,amount,balance\nb1,60,60\nb2,-15,50\n",
    "one_line_end": b"\r\n",
    "names_only": b"reference,date,total,memo\n",
    "comma_in_quotes": b'reference,memo,total\nc1,"Tea, two cups",8.40\n',
    "marked_utf8": BOM + b"reference,total\nu1,15\n",
    "no_amounts": b"id,memo\nn1,lunch\n",
    "blank_column": b"id,unused\nk1,\nk2,\n",
    "one_state": b"id,state,total\ne1,open,4\ne2,open,9\n",
    "one_row": b"posting date,memo,net amount\n2033-11-30,Rent of the hall,940.25\n",
    "many_faults": b"reference,date,amount,balance,memo\nf1,2027-02-03,80.00,80.00,same\nf2,2027-02-17,(30.00),50.00,same\nf2,soon,?12,60.00,same\n",
    "zero_bytes": b"",
    "ragged": b"id,amount\n1,2,3\n2\n",
    "no_money_all_null": b"description,empty\nx,\ny,\n",
    "bom_semicolon": BOM + b"id;amount\n1;2\n3;4\n",
    "two_equal_headers": b"id,amount,amount\n1,5,x\n2,6,x\n",
    "two_blank_headers": b"id,,\n1,2,3\n",
    "leading_newline": b"\nid,amount\n1,2\n",
    "all_blank_header": b" , ,\n1,2,3\n",
    "two_bases": b"id,amount\n1,5\n , \n2,bad\n",
    "datetimes": b"id,when,amount\n1,2026-01-01 10:00:00,1\n2,2026-01-02T00:00:00+05:00,2\n",
    "booleans": b"id,flag,amount\n1,true,1\n2,No,2\n3,0,3\n",
    "sides": b"id,debit,credit,balance\n1,,100,100\n2,30.5,,69.500\n3,1,1,68.5\n",
    "bad_side": b"id,debit,credit,balance\n1,,100,100\n2,x,,70\n",
    "mostly_numeric": b"id,n,amount\n" + b"".join(b"%d,%s,1\n" % (i, b"many" if i == 7 else b"%d" % i) for i in range(10)),
    "negative": b"id,amount,balance\n1,-5,-5\n2,-5,-10\n",
    "empty_identifier": b"id,amount\n,5\n2,6\n",
    "bad_bytes": b"id,amount\n1,\xff\n",
    "newline_in_quotes": b'id,note,amount\n1,"two\nlines",5\n2,y,\n',
    "odd_spaces": "id,amount\n 1 ,  5\n".encode(),
    "wide_amount": b"id,amount\n" + b"".join(b"%d,1.00\n" % i for i in range(9)) + b"9,1234567890123456789.00\n",
    "wide_balance": b"id,amount,balance\n1,5,5\n2,1234567890123456789,1234567890123456794\n",
    "fine_fractions": b"id,share,amount\n1,5.00000000001,1\n2,6.00000000001,2\n",
    "huge_field": b"id,amount\n1," + b"9" * 200_000 + b"\n",
}
NAMES = {hashlib.sha256(content).hexdigest(): name for name, content in FILES.items()}


@pytest.fixture(scope="module")
def result(spark):
    files = spark.createDataFrame(
        [(hashlib.sha256(c).hexdigest(), len(c), bytearray(c)) for c in FILES.values()],
        "file_id STRING, length BIGINT, content BINARY",
    )
    profile = profile_files(files)
    by_name = lambda df: [(NAMES[r["file_id"]], r) for r in df.collect()]
    files = dict(by_name(profile.files))
    columns, issues = {}, {}
    for name, row in by_name(profile.columns):
        columns.setdefault(name, {})[row["column_position"]] = row
    for name, row in by_name(profile.issues):
        issues.setdefault(name, []).append(row)
    return files, columns, issues


EXPECTED = {
    # name: (types, issues as (code, column, row), status)
    "tidy": ("identifier date currency currency", [], "completed"),
    "same_row_twice": (
        "identifier currency",
        [("duplicate_rows", None, None), ("constant_value_column", "id", None), ("constant_value_column", "total", None),
         ("duplicate_transaction_identifier", "id", 2), ("duplicate_transaction_identifier", "id", 3)],
        "completed_with_warnings",
    ),
    "sparse": (
        "identifier currency text",
        [("unexpected_null_value", "amount", 3), ("unexpected_null_value", "amount", 4),
         ("high_null_percentage", "amount", None), ("high_null_percentage", "memo", None)],
        "completed_with_warnings",
    ),
    "two_date_forms": ("identifier date currency", [("inconsistent_date_formats", "date", None)], "completed_with_warnings"),
    "marked_amounts": ("identifier currency", [], "completed"),
    "word_for_amount": ("identifier text", [("invalid_monetary_value", "amount", 3)], "completed_with_warnings"),
    "identifier_twice": (
        "identifier currency",
        [("constant_value_column", "id", None), ("duplicate_transaction_identifier", "id", 2), ("duplicate_transaction_identifier", "id", 3)],
        "completed_with_warnings",
    ),
    "balance_off": ("identifier currency currency", [("invalid_running_balance", "balance", 3)], "completed_with_warnings"),
    "one_line_end": ("", [("empty_file", None, None)], "blocked"),
    "names_only": ("identifier text text text", [("all_null_column", c, None) for c in ("reference", "date", "total", "memo")], "completed_with_warnings"),
    "comma_in_quotes": ("identifier text currency", [], "completed"),
    "marked_utf8": ("identifier currency", [], "completed"),
    "no_amounts": ("identifier text", [("required_financial_field_not_found", None, None)], "completed_with_warnings"),
    "blank_column": (
        "identifier text",
        [("required_financial_field_not_found", None, None), ("all_null_column", "unused", None)],
        "completed_with_warnings",
    ),
    "one_state": ("identifier text currency", [("constant_value_column", "state", None)], "completed_with_warnings"),
    "one_row": ("date text currency", [], "completed"),
    "many_faults": (
        "identifier date text currency text",
        [("invalid_date_value", "date", 4), ("invalid_monetary_value", "amount", 4), ("duplicate_transaction_identifier", "reference", 3),
         ("duplicate_transaction_identifier", "reference", 4), ("running_balance_not_verifiable", None, None),
         ("constant_value_column", "memo", None)],
        "completed_with_warnings",
    ),
    "zero_bytes": ("", [("empty_file", None, None)], "blocked"),
    "ragged": (
        "identifier currency",
        [("row_too_many_fields", None, 2), ("row_too_few_fields", None, 3), ("unexpected_null_value", "amount", 3),
         ("high_null_percentage", "amount", None)],
        "completed_with_warnings",
    ),
    "no_money_all_null": (
        "text text",
        [("required_financial_field_not_found", None, None), ("all_null_column", "empty", None)],
        "completed_with_warnings",
    ),
    "bom_semicolon": ("identifier currency", [], "completed"),
    "two_equal_headers": (
        "identifier currency text",
        [("duplicate_column_name", "amount", None), ("invalid_monetary_value", "amount", 2),
         ("invalid_monetary_value", "amount", 3), ("constant_value_column", "amount", None)],
        "completed_with_warnings",
    ),
    "two_blank_headers": (
        "identifier integer integer",
        [("blank_column_name", None, 1), ("required_financial_field_not_found", None, None)],
        "completed_with_warnings",
    ),
    "leading_newline": ("", [("missing_header", None, None)], "blocked"),
    "all_blank_header": ("text text text", [("missing_header", None, None), ("all_null_column", "", None)], "blocked"),
    "two_bases": (
        "identifier text",
        [("completely_empty_row", None, 3), ("invalid_monetary_value", "amount", 3)],
        "completed_with_warnings",
    ),
    "datetimes": ("identifier datetime currency", [("inconsistent_date_formats", "when", None)], "completed_with_warnings"),
    "booleans": ("identifier boolean currency", [], "completed"),
    "sides": (
        "identifier currency currency currency",
        [("unexpected_null_value", "debit", 2), ("unexpected_null_value", "credit", 3), ("invalid_running_balance", "balance", 4)],
        "completed_with_warnings",
    ),
    "bad_side": (
        "identifier text currency currency",
        [("unexpected_null_value", "debit", 2), ("unexpected_null_value", "credit", 3), ("invalid_monetary_value", "debit", 3),
         ("high_null_percentage", "debit", None), ("high_null_percentage", "credit", None), ("running_balance_not_verifiable", None, None)],
        "completed_with_warnings",
    ),
    "mostly_numeric": (
        "identifier text currency",
        [("invalid_numeric_value", "n", 9), ("constant_value_column", "amount", None)],
        "completed_with_warnings",
    ),
    "negative": (
        "identifier currency currency",
        [("unexpected_negative_balance", "balance", 2), ("unexpected_negative_balance", "balance", 3), ("constant_value_column", "amount", None)],
        "completed_with_warnings",
    ),
    "empty_identifier": (
        "identifier currency",
        [("missing_transaction_identifier", "id", 2), ("high_null_percentage", "id", None)],
        "completed_with_warnings",
    ),
    "bad_bytes": ("", [("unsupported_encoding", None, None)], "blocked"),
    "newline_in_quotes": (
        "identifier text currency",
        [("unexpected_null_value", "amount", 3), ("high_null_percentage", "amount", None)],
        "completed_with_warnings",
    ),
    "odd_spaces": ("identifier currency", [], "completed"),
}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_types_issues_status(result, name):
    files, columns, issues = result
    types, expected, status = EXPECTED[name]
    found = columns.get(name, {})
    assert [found[i]["inferred_data_type"] for i in sorted(found)] == types.split()
    key = lambda i: (i[0], i[1] or "", i[2] or 0)
    assert sorted(((r["issue_code"], r["column_name"], r["row_number"]) for r in issues.get(name, [])), key=key) == sorted(expected, key=key)
    assert files[name]["status"] == status


def values(row, **expected):
    got = {k: row[k] for k in expected}
    assert got == {k: Decimal(v) if isinstance(v, str) and v.replace(".", "").replace("-", "").isdigit() else v for k, v in expected.items()}


def test_totals_and_balances(result):
    files, columns, issues = result
    values(files["tidy"], monetary_total="210", opening_balance="0", closing_balance="210", calculated_closing_balance="210", running_balance_valid=True)
    values(files["same_row_twice"], monetary_total="162", duplicate_row_count=1, row_count=2)
    values(files["marked_amounts"], monetary_total="2010")
    values(files["balance_off"], opening_balance="0", closing_balance="50", calculated_closing_balance="45", running_balance_valid=False, monetary_total="45")
    values(files["names_only"], row_count=0, column_count=4, monetary_total=None, running_balance_valid=None)
    values(files["one_line_end"], delimiter=None, row_count=0, column_count=0)
    values(files["marked_utf8"], encoding="utf-8-sig", delimiter=",")
    values(files["bom_semicolon"], encoding="utf-8-sig", delimiter=";")
    values(files["bad_bytes"], encoding=None, delimiter=None)
    values(files["many_faults"], closing_balance="60", monetary_total="50", opening_balance=None, running_balance_valid=None, row_count=3, column_count=5)
    values(files["sides"], debit_total="31.5", credit_total="101", opening_balance="0", closing_balance="68.5", calculated_closing_balance="69.5", running_balance_valid=False)
    values(files["two_bases"], row_count=2, empty_row_count=1)
    assert str(files["two_date_forms"]["date_range_start"]) == "2029-08-21"
    assert str(files["two_date_forms"]["date_range_end"]) == "2029-09-25"
    assert files["huge_field"]["error"] is None and files["huge_field"]["row_count"] == 1


def test_long_numbers_are_exact(result):
    """Figures are there wherever 24 digits hold them; balances are followed whether they do or not."""
    files, columns, _ = result
    values(columns["wide_amount"][1], inferred_data_type="currency", non_null_count=10, unique_count=2, median_value="1")
    values(columns["wide_amount"][1], mean_value="123456789012345679.8", standard_deviation="370370367037037036.4")
    assert (columns["wide_amount"][1]["minimum_value"], columns["wide_amount"][1]["maximum_value"]) == ("1.00", "1234567890123456789.00")
    values(files["wide_amount"], monetary_total=None, row_count=10)
    values(files["wide_balance"], monetary_total=None, closing_balance=None, opening_balance="0", calculated_closing_balance=None, running_balance_valid=True, status="completed")
    values(columns["fine_fractions"][1], inferred_data_type="decimal", mean_value="5.5", median_value="5.5", standard_deviation="0.5")
    assert (columns["fine_fractions"][1]["minimum_value"], columns["fine_fractions"][1]["maximum_value"]) == ("5.00000000001", "6.00000000001")
    values(files["fine_fractions"], monetary_total="3")
    assert columns["huge_field"][1]["maximum_value"] == "9" * 200_000 and columns["huge_field"][1]["standard_deviation"] == 0


def test_column_figures(result):
    _, columns, issues = result
    values(columns["tidy"][2], standard_deviation="145")
    values(columns["tidy"][3], standard_deviation="20")
    amount = columns["marked_amounts"][1]
    assert (amount["minimum_value"], amount["maximum_value"], amount["detected_formats"]) == ("-400.75", "2400.75", ["currency"])
    values(amount, median_value="10", mean_value="670", standard_deviation="1235.259909")
    values(columns["word_for_amount"][1], minimum_length=1, maximum_length=7, average_length="4")
    values(columns["identifier_twice"][1], standard_deviation="12")
    assert (columns["many_faults"][2]["minimum_value"], columns["many_faults"][2]["maximum_value"]) == ("(30.00)", "?12")
    assert columns["sparse"][2]["sample_values"] == ["kept"]
    by = {(r["issue_code"], r["column_name"]): r for n in ("sparse", "balance_off", "two_date_forms", "sides") for r in issues[n]}
    assert by["high_null_percentage", "amount"]["observed_value"] == "66.67%"
    assert by["high_null_percentage", "amount"]["expected_value"] == "<50.00%"
    assert by["inconsistent_date_formats", "date"]["observed_value"] == "%Y-%m-%d, %d/%m/%Y"
    # The expected balance is written with the largest scale met so far.
    assert (by["invalid_running_balance", "balance"]["observed_value"], by["invalid_running_balance", "balance"]["expected_value"]) == ("68.5", "69.5")


def test_row_limit(spark):
    content = b"id,amount\n" + b"".join(b"%d,%d\n" % (i, i) for i in range(6)) + b"\n\nbad,bad,bad\n"
    files = spark.createDataFrame([("f", len(content), bytearray(content))], "file_id STRING, length BIGINT, content BINARY")
    for limit, rows, codes in ((6, 6, {"profiling_row_limit"}), (3, 3, {"profiling_row_limit"}), (8, 7, None)):
        profile = profile_files(files, ProfilingConfig(max_rows=limit))
        assert profile.files.first()["row_count"] == rows
        found = {r["issue_code"] for r in profile.issues.collect()}
        assert found == (codes or {"completely_empty_row", "row_too_many_fields", "invalid_monetary_value"})


def test_many_chunks(spark):
    """More records than one parser chunk, with a blank record in each."""
    lines = [b"%d,%d" % (i, i % 9) if i % 1000 else b"" for i in range(1, 12_001)]
    content = b"id,amount\n" + b"\n".join(lines) + b"\n"
    files = spark.createDataFrame([("f", len(content), bytearray(content))], "file_id STRING, length BIGINT, content BINARY")
    row = profile_files(files).files.first()
    values(row, row_count=11_988, empty_row_count=12, monetary_total=str(sum(i % 9 for i in range(1, 12_001) if i % 1000)))
