"""The split reader against the standard library's, whole and by ranges of a few bytes."""

import csv
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import corpus as K, delimited as D

SCHEMA = "file_id STRING, length BIGINT, content BINARY"


def plain(text, delimiter):
    """[(record_no, row_no, fields)]"""
    csv.field_size_limit(2**31 - 1)
    out, kept = [], 1
    for number, fields in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
        filled = number > 1 and any(f.strip() for f in fields)
        kept += filled
        out.append((number, kept if filled else None, fields))
    return out


def found(parsed):
    files = {r.file_id: r for r in parsed.files.collect()}
    records = {name: [] for name in files}
    for r in parsed.records.collect():
        records[r.file_id].append((r.record_no, r.row_no, r.fields))
    return files, {name: sorted(rows, key=lambda r: r[0]) for name, rows in records.items()}


def from_table(spark, texts):
    rows = [(name, len(t), bytearray(t)) for name, t in texts.items()]
    return found(K.parse_files(K.with_encoding(spark.createDataFrame(rows, SCHEMA))))


def from_folder(spark, folder, texts, encodings=("utf-8-sig", "utf-8"), **options):
    for name, content in texts.items():
        (folder / f"{name}.csv").write_bytes(content)
    listed = [(f"file:{folder}/{name}.csv", name, len(t)) for name, t in texts.items()]
    listed = spark.createDataFrame(listed, "path string, file_id string, length bigint")
    return found(K.parse_folder(spark, f"file:{folder}", listed, encodings, **options))


@pytest.fixture
def tiny_ranges(spark, monkeypatch):
    """Files are read by ranges of forty bytes; the ranges are pinned, so that the rest is read as ever."""
    read = K.read_lines

    def by_ranges(session, paths):
        session.conf.set("spark.sql.files.maxPartitionBytes", "40")
        session.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            return K.materialize(read(session, paths), "lines")
        finally:
            session.conf.unset("spark.sql.files.maxPartitionBytes")
            session.conf.unset("spark.sql.files.openCostInBytes")

    monkeypatch.setattr(K, "read_lines", by_ranges)


def odd_texts(count, seed):
    chance = random.Random(seed)
    texts = {}
    for i in range(count):
        delimiter = chance.choice(D.DELIMITERS)
        alphabet = ["a", "é", " ", '"', '"', '""', delimiter, delimiter, f'{delimiter}"', f'"{delimiter}', "\n", "\r\n", "\r", " ", "\x85", "'", ",", ";", "$1", "\\"]
        texts[f"t{i}"] = "".join(chance.choice(alphabet) for _ in range(chance.randint(1, 120))).encode()
    return texts


def same(texts, result):
    files, records = result
    for name, content in texts.items():
        if files[name].file_class == "readable":
            assert records[name] == plain(content.decode("utf-8-sig"), files[name].delimiter), (name, content, files[name])
        else:
            assert not records[name]


TOLD = {
    "quoted": b'id,note\n1,"two\nlines, and a ""word"""\n2,"a"b"c\n3,x"y"\n',
    "open": b'id,note\n1,"never closed, \n\n2,3\r\n',
    "open_without_end": b'id,note\n1,"never closed\r',
    "open_after_quote": b'a,"b""',
    "one": b"x", "blank": b"\n", "returns": b"a,b\rc,d\r\re,f", "mixed": b"a;b\r\n\r\n;\n \r\"\";\"\"\n\"\n\";\n1;2\n",
    "marked": b"\xef\xbb\xbf\"a\";b\n1;2", "marked_only": b"\xef\xbb\xbf", "none": b"", "white": b" \n\t\r\n", "broken": b"a,b\n\xff\n",
    "many": b"id,n\n" + b"".join(b"%d,%d\n" % (i, i) if i % 900 else b",\n" for i in range(10_000)),
    "quotes": b'"' * 9_001 + b"\n1,2\n", "long": b"a,b\n1,\"" + b'x""' * 100_000 + b'"\n', "wide": b"|".join([b'"q"'] * 2_000) + b"\n",
    "a b+c[1]{2}*": "é,è\n1,2\n".encode(),
}


def test_told_texts(spark, tmp_path):
    same(TOLD, from_table(spark, TOLD))
    files, records = from_folder(spark, tmp_path, TOLD)
    same(TOLD, (files, records))
    assert files["marked"].encoding == "utf-8-sig" and files["marked"].delimiter == ";" and records["marked"][0][2] == ["a", "b"]
    assert {n for n, f in files.items() if f.file_class == "empty_file"} == {"blank", "none", "white", "marked_only"}
    assert files["broken"].file_class == "unsupported_encoding" and files["broken"].delimiter is None


def test_odd_texts(spark):
    texts = odd_texts(400, 1)
    same(texts, from_table(spark, texts))


def test_ranges(spark, tmp_path, tiny_ranges):
    """Records and quotes run across ranges of forty bytes."""
    texts = odd_texts(20, 2) | {k: v for k, v in TOLD.items() if len(v) < 200}
    texts["across"] = b"id,note\n" + b"".join(b'%d,"line\n\nand, ""%d""\r\n"\n\n' % (i, i) for i in range(25))
    same(texts, from_folder(spark, tmp_path, texts))


def test_one_file_many_tasks(spark, tmp_path):
    body = b"".join(b'%d,"first line of %d\nsecond, ""quoted"" line",%d\n' % (i, i, i) for i in range(60_000))
    (tmp_path / "f.csv").write_bytes(b"id,note,amount\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        lines = K.read_lines(spark, f"file:{tmp_path}/f.csv")
        assert lines.rdd.getNumPartitions() >= 8
        files, records = from_folder(spark, tmp_path, {"f": b"id,note,amount\n" + body})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(records["f"]) == 60_001 and records["f"][60_000] == (60_001, 60_001, ["59999", 'first line of 59999\nsecond, "quoted" line', "59999"])


def test_latin(spark, tmp_path):
    texts = {"latin": "é;ü\r\n1;Ã©\r\n".encode("latin-1"), "utf": "é;ü\n".encode()}
    files, records = from_folder(spark, tmp_path, texts, ("utf-8", "latin-1"))
    assert [r[2] for r in records["latin"]] == [["é", "ü"], ["1", "Ã©"]] and files["latin"].encoding == "latin-1"
    assert [r[2] for r in records["utf"]] == [["é", "ü"]] and files["utf"].encoding == "utf-8"
    files, records = from_folder(spark, tmp_path, texts, ("latin-1",))
    assert [r[2] for r in records["utf"]] == [["Ã©", "Ã¼"]]
    with pytest.raises(ValueError, match="unsupported"):
        from_folder(spark, tmp_path, texts, ("utf-16",))


@pytest.mark.parametrize(
    "text, delimiter",
    [
        ("a;b\n1,5;2,5\n", ";"), ("a,b;c\n", ","), ("a\nb\n", ","), ("", ","), ("a|b\n" + "x\n" * 3, ","), ("a\tb\n1\t2\nx\n", "\t"),
        ('"a;b;c",d\n"e;f;g",h\n', ","), ("a,b;c;d\n1,2;3;4\n", ";"), ("word, word\n" * 900 + "a;b\n" * 1500, ";"), ('x;"1\n2;3";y\n' * 5, ";"),
    ],
)
def test_delimiters(spark, text, delimiter):
    files = spark.createDataFrame([("f", len(text), bytearray(text.encode() or b"\n x"))], SCHEMA)
    assert K.detect_delimiters(K.with_encoding(files)).first().delimiter == delimiter


def test_row_limit(spark, tmp_path):
    text = b"a,b\n\n1,2\n,\n3,4\n\n5,6\n\n"
    _, records = from_folder(spark, tmp_path, {"f": text}, max_rows=2)
    assert records["f"] == plain(text.decode(), ",")[:5]


def test_only_listed_files_are_opened(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"other{i}.csv").write_bytes(b"a,b\n1,2\n")
    from_folder(spark, tmp_path, {"f": b"a,b\n"})
    listed = spark.createDataFrame([(f"file:{tmp_path}/f.csv", hashlib.sha256(b"a,b\n").hexdigest(), 4)], "path string, file_id string, length bigint")
    assert K.read_lines(spark, [listed.first().path]).select(F.input_file_name()).distinct().count() == 1
    assert K.parse_folder(spark, f"file:{tmp_path}", listed).records.count() == 1


def test_texts_are_made_once(spark):
    """Pieces and facts of files come from the same texts; to make these again for each would double the work."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    files = spark.createDataFrame([(str(i), 8, bytearray(b"a,b\n1,%d\n" % (i % 10))) for i in range(40)], SCHEMA)
    files = K.with_encoding(files).mapInPandas(counted, "file_id string, length bigint, content binary, encoding string, text string")
    parsed = K.parse_files(files)
    assert parsed.files.count() == 40 and parsed.records.count() == 80
    assert made.value == 40
