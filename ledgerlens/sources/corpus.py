"""Corpora of delimited files: one row per file, then one row per record (``sources.delimited``)."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.config import ProfilingConfig
from ledgerlens.durable import materialize
from ledgerlens.functions.text import strip
from ledgerlens.sources.delimited import ENDINGS, Parsed, delimiter_of, parse_pieces, place_ranges, read_pieces, told_delimiters

# Fixed value: the checksum of no bytes at all. The file source lists no empty file.
EMPTY_FILE = hashlib.sha256(b"").hexdigest()
BOM = b"\xef\xbb\xbf"
# Longest list of files whose paths are given to the reader one by one.
LISTED_FILES = 10_000

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

#: Spark's setting of the most tasks that list paths given one by one: 10,000, a task each, unless it is set.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 200
#: Tasks for each core that read files; Spark alone makes one for 32 short files.
TASKS_A_CORE = 4
#: Bytes beyond which a further task reads files by ranges.
TASK_BYTES = 128 << 20


def list_in_few_tasks(spark: SparkSession) -> None:
    """From now on at most ``LISTING_TASKS`` tasks of the session list paths that are given one by one; to start a task takes longer than to list a path."""
    spark.conf.set(LISTING, min(LISTING_TASKS, int(spark.conf.get(LISTING, "10000"))))


def in_few_tasks(files: DataFrame, size: int = 0) -> DataFrame:
    """Files, or lines of files of ``size`` bytes in all, read by a few tasks for each core, not by a task for 32 short files.

    Parts are put together as they are, in order, so a task meets more files but holds no more of them at once.
    """
    return files.coalesce(max(TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism, int(size // TASK_BYTES)))


def listed_paths(spark: SparkSession, directory: str) -> DataFrame:
    """path of every file below ``directory``, empty ones too: Spark lists them, but reads none."""
    files = spark.read.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(directory)
    # the listing has URLs, the column of the source plain paths
    paths = [(re.sub(r"^([a-z]+):/+(?=[^/])", r"\1:/", unquote(f)) if f.startswith("file:") else unquote(f),) for f in files.inputFiles()]
    return spark.createDataFrame(paths, "path STRING")


def read_corpus(spark: SparkSession, directory: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``directory``: path, modificationTime, length, content.

    The size limit reaches the scan, so an oversized file is never opened.
    """
    files = (
        spark.read.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(directory)
    )
    return files if max_bytes is None else files.filter(F.col("length") <= max_bytes)


def with_file_id(files: DataFrame) -> DataFrame:
    return files.withColumn("file_id", F.sha2("content", 256))


def missing_files(registered: DataFrame, files: DataFrame) -> DataFrame:
    """Registered files (``source_file_id``) whose bytes are not among ``files``."""
    present = files.select(F.sha2("content", 256).alias("source_file_id"))
    return registered.join(present, "source_file_id", "left_anti")


def with_encoding(files: DataFrame, encodings: tuple[str, ...] = ProfilingConfig.encodings) -> DataFrame:
    """Adds ``encoding`` (label, NULL if none fits) and ``text`` (decoded with the first encoding that fits)."""
    raw = F.col("content")
    bom = F.startswith(raw, F.lit(BOM))
    valid = F.is_valid_utf8(raw.cast("string"))
    after_bom = F.substring(raw, F.lit(4), F.octet_length(raw))
    label = text = F.lit(None).cast("string")
    for name in reversed(encodings):
        if name == "utf-8-sig":
            fits, plain, decoded = valid, "utf-8", F.when(bom, after_bom).otherwise(raw).cast("string")
        elif name == "utf-8":
            fits, plain, decoded = valid, "utf-8", raw.cast("string")
        elif name == "ascii":
            fits = valid & (F.octet_length(raw) == F.char_length(raw.cast("string")))
            plain, decoded = "ascii", raw.cast("string")
        elif name in ("latin-1", "iso-8859-1"):
            fits, plain, decoded = F.lit(True), name, F.decode(raw, "ISO-8859-1")
        else:
            raise ValueError(f"unsupported encoding: {name}")
        label = F.when(fits, F.when(bom, "utf-8-sig").otherwise(plain)).otherwise(label)
        text = F.when(fits, decoded).otherwise(text)
    return files.withColumns({"encoding": F.when(raw.isNotNull(), label), "text": F.when(raw.isNotNull(), text)})


def classify_files(decoded: DataFrame) -> DataFrame:
    """Adds ``file_class``: unsupported_encoding, empty_file or readable."""
    return decoded.withColumn(
        "file_class",
        F.when(F.col("text").isNull(), "unsupported_encoding")
        .when(strip(F.col("text")) == "", "empty_file")
        .otherwise("readable"),
    )


def _pieces_of(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces and files of texts that are in the table already (file_id, length, encoding, text); one row is one range."""
    files = classify_files(decoded).withColumn("text", F.when(F.col("file_class") == "readable", F.col("text")))
    # both branches read the texts, and to make them may be the larger part of the work
    files = materialize(files.select("file_id", "length", "encoding", "file_class", "text"), "texts")
    lines = F.split("text", "\n", -1)
    # what follows the last line end is a line only if there is something
    whole = F.slice(lines, F.lit(1), F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0))
    rows = files.where(F.col("text").isNotNull()).select("file_id", F.lit(0).cast("bigint").alias("block"), F.explode(whole).alias("line"), F.lit(True).alias("valid"))
    files = files.select(
        "file_id", F.col("file_id").alias("name"), "length", "encoding", "file_class",
        F.lit(False).alias("latin"), F.lit("").alias("prefix"), F.coalesce(F.col("text").endswith("\n"), F.lit(False)).alias("ended"),
    )
    return materialize(read_pieces(rows), "pieces"), files


def detect_delimiters(decoded: DataFrame) -> DataFrame:
    """file_id, delimiter of every readable file, judged by all of its records; comma when undecided."""
    pieces, files = _pieces_of(decoded)
    told = told_delimiters(pieces, files, place_ranges(pieces)).where("kind IS NOT NULL")
    return told.select("file_id", delimiter_of(F.col("kind")).alias("delimiter"))


def parse_files(decoded: DataFrame, max_rows: int | None = None) -> Parsed:
    """Files and records of texts that are in the table (file_id, length, encoding, text); every file_id must be there once."""
    return parse_pieces(*_pieces_of(decoded), max_rows)


def _plain_path(url: Column) -> Column:
    """A path as the binary file source has it, of one as in the file metadata."""
    return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of files of any size, read by ranges: file_id (the path), block (begin of the range), line, valid.

    Lines end at LF only, which is left out. A line that is not UTF-8 is decoded as Latin-1.
    """
    files = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true").load(paths)
    valid = F.is_valid_utf8("value")
    line = F.when(valid, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return files.select(_plain_path(F.col("_metadata.file_path")).alias("file_id"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"), valid.alias("valid"))


def _file_facts(pieces: DataFrame, listed: DataFrame, encodings: tuple[str, ...]) -> DataFrame:
    """Encoding and class of files that were read by ranges, see ``parse_pieces``. ``listed``: path, file_id, length.

    The reader leaves out a byte-order mark and the line end of the last line; the bytes that are missing tell of both.
    """
    size = F.when(F.col("valid"), F.octet_length("piece")).otherwise(F.length("piece"))
    end = F.get(F.array(*[F.lit(len(e)) for e in ENDINGS]), F.col("ending"))
    facts = pieces.groupBy("file_id").agg(
        F.bool_and("valid").alias("valid"),
        F.bool_and(F.octet_length("piece") == F.length("piece")).alias("ascii"),
        F.bool_and(strip(F.col("piece")) == "").alias("blank"),
        F.sum((size + end).cast("bigint")).alias("bytes"),
    )
    files = listed.select(F.col("path").alias("file_id"), F.col("file_id").alias("name"), "length").join(facts, "file_id", "left")
    missing = F.col("length") - F.coalesce("bytes", F.lit(0))
    bom, valid, ascii_only = missing >= 2, F.coalesce("valid", F.lit(True)), F.coalesce("ascii", F.lit(True))
    label, prefix, latin = F.lit(None).cast("string"), F.lit(""), F.lit(False)
    for name in reversed(encodings):
        fits = {"ascii": ascii_only & ~bom, "utf-8": valid, "utf-8-sig": valid}.get(name, F.lit(True))
        mark = {"utf-8-sig": "", "utf-8": "\ufeff", "ascii": ""}.get(name, BOM.decode("latin-1"))
        plain = "utf-8" if name == "utf-8-sig" else name
        label = F.when(fits, F.when(bom, "utf-8-sig").otherwise(plain)).otherwise(label)
        prefix = F.when(fits, F.when(bom, mark).otherwise("")).otherwise(prefix)
        latin = F.when(fits, name in ("latin-1", "iso-8859-1")).otherwise(latin)
    files = files.withColumns({"encoding": label, "prefix": prefix, "latin": latin, "ended": missing.isin(0, 3) & F.col("bytes").isNotNull()})
    nothing = F.coalesce("blank", F.lit(True)) & (F.col("prefix") == "")
    kind = F.when(F.col("encoding").isNull(), "unsupported_encoding").when(nothing, "empty_file").otherwise("readable")
    return files.select("file_id", "name", "length", "encoding", kind.alias("file_class"), "latin", "prefix", "ended")


def parse_folder(
    spark: SparkSession, directory: str, listed: DataFrame, encodings: tuple[str, ...] = ProfilingConfig.encodings, max_rows: int | None = None
) -> Parsed:
    """Files and records of the files ``listed`` (path, file_id, length) below ``directory``, each read by as many tasks as it has ranges.

    A short list of paths is all that is opened; for a longer one the folder is read. A mark that the encoding does not take away is
    kept before the first field, but does not hinder its quotes. A file whose lines end with CR alone is one range.
    """
    for name in encodings:
        if name not in ("utf-8-sig", "utf-8", "ascii", "latin-1", "iso-8859-1"):
            raise ValueError(f"unsupported encoding: {name}")
    listed = materialize(listed.select("path", "file_id", "length"), "listed")
    named = listed.where("path IS NOT NULL AND length > 0")
    few = [r.path for r in named.select("path").limit(LISTED_FILES + 1).collect()]
    if len(few) <= LISTED_FILES:
        # the reader takes paths for patterns
        list_in_few_tasks(spark)
        lines = read_lines(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in few]) if few else None
    else:
        lines = read_lines(spark, directory)
    if lines is None:
        lines = spark.createDataFrame([], "file_id STRING, block BIGINT, line STRING, valid BOOLEAN")
    size = named.agg(F.sum("length")).first()[0] or 0
    pieces = materialize(read_pieces(in_few_tasks(lines, size)), "pieces")
    # and with it the listing of the files, which the driver holds
    del lines
    return parse_pieces(pieces, _file_facts(pieces, listed, encodings), max_rows)


def parsed_files(parsed: Parsed) -> DataFrame:
    """One row per file: file_id, length, encoding, file_class, delimiter, error (nothing that can be read fails to be parsed)."""
    return parsed.files


def raw_records(parsed: Parsed) -> DataFrame:
    """file_id, record_no, row_no, fields as written, with the header's names and concepts on every record."""
    return parsed.records


def extract_headers(records: DataFrame) -> DataFrame:
    """One row per file: file_id, names, concepts, usable."""
    return records.filter(F.col("record_no") == 1).select(
        "file_id", "names", "concepts", F.exists("names", lambda name: name != "").alias("usable")
    )
