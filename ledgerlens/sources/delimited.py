"""Delimited text of any size: files are read by ranges, and a record may begin in one and end in another.

Lines are cut at line ends only. What a line does to the quote state (outside or inside a quoted field, at its begin and at its
end) is a map of two values, so maps compose: every range is read under both states at once, the ranges of a file are then put in
order (one row a range), and each line knows its state, and the number of its record, without a line before it being read again.
The delimiter is not known by then either, so each candidate has maps of its own.

A quoted field begins with a quote at the begin of a field, and ends at a quote that is not doubled; what follows up to the delimiter
belongs to it as written. Quotes elsewhere are ordinary characters. Records end at CR, LF or both, outside quotes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.config import RECORD_ROWS
from ledgerlens.durable import materialize
from ledgerlens.functions.text import strip
from ledgerlens.operators.concepts import concepts_of
from ledgerlens.operators.shaping import is_blank, limit_rows

#: In order of preference.
DELIMITERS = (",", ";", "\t", "|")
#: A delimiter must stand equally often in this share of a file's records.
CONSISTENT = 0.5
#: Consecutive records that share one row of facts (names, blank records before them).
RUN = 4096
#: The line ends that ``ending`` counts from 0.
ENDINGS = ("\n", "\r\n", "\r")

_KINDS = len(DELIMITERS)
_STREAMS = 2 * _KINDS
# the map of a line without quotes: outside stays outside, inside stays inside
_UNCHANGED = (1 << _STREAMS) - (1 << _KINDS)


class Parsed(NamedTuple):
    """files: file_id, length, encoding, file_class, delimiter, error. records: file_id, record_no, row_no, names, concepts, fields."""

    files: DataFrame
    records: DataFrame


# --- patterns; possessive throughout, so that time is linear and nothing recurses ---------------------------------------------------

_BODY = '[^"]*+(?:""[^"]*+)*+'


def _escaped(delimiter: str) -> str:
    return {"|": r"\|", "\t": r"\t"}.get(delimiter, delimiter)


def _closed(delimiter: str) -> str:
    d = _escaped(delimiter)
    return f'(?:"{_BODY}"[^{d}]*+|[^"{d}][^{d}]*+)?+'


def _ends_inside(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field, begun outside or inside one."""
    d, rest = _escaped(delimiter), f'(?:{_closed(delimiter)}{_escaped(delimiter)})*+"{_BODY}'
    return line.rlike(rf"^{rest}\z"), line.rlike(rf'^{_BODY}(?:"[^{d}]*+{d}{rest})?+\z')


def _separators(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Delimiters outside quoted fields of a line begun outside or inside one."""
    d = _escaped(delimiter)

    def counted(text: Column) -> Column:
        bare = F.regexp_replace(text, f'(^|{d})"{_BODY}"?+', "$1")
        return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))

    return counted(line), counted(F.regexp_replace(line, f'^{_BODY}"?+', ""))


def fields_of(record: Column, delimiter: str) -> Column:
    """The fields of a record without its line end; none if it is empty. Every quote that opens a field must be closed."""
    d = _escaped(delimiter)
    quoted = F.regexp_extract_all(F.concat(record, F.lit(delimiter)), F.lit(f"({_closed(delimiter)}){d}"), F.lit(1))

    def plain(field: Column) -> Column:
        body = F.replace(F.regexp_extract(field, f'^"({_BODY})"', 1), F.lit('""'), F.lit('"'))
        return F.when(field.startswith('"'), F.concat(body, F.regexp_replace(field, f'^"{_BODY}"', ""))).otherwise(field)

    none = F.array().cast("array<string>")
    return F.when(record == "", none).when(record.contains('"'), F.transform(quoted, plain)).otherwise(F.split(record, d, -1))


def _by_delimiter(kind: Column, made: Callable[[str], Column]) -> Column:
    found = F.lit(None)
    for k, delimiter in enumerate(DELIMITERS):
        found = F.when(kind == k, made(delimiter)).otherwise(found)
    return found


# --- lines and their states ---------------------------------------------------------------------------------------------------------


def _states() -> Callable[..., Column]:
    # Made inside a function so that it reaches the workers by value, without this package installed there.
    kinds, streams = _KINDS, _STREAMS

    def states(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import numpy as np

        last, number, state, inside = None, 0, [0] * streams, [0] * streams
        for keys, maps in batches:
            key, code, n = keys.to_numpy(), maps.to_numpy(), len(keys)
            if not n:
                yield pd.DataFrame({c: np.zeros(0, np.int32) for c in ("seq", "before", "after", *[f"c{j}" for j in range(streams)])})
                continue
            first = np.ones(n, bool)
            first[1:] = key[1:] != key[:-1]
            goes_on = last is not None and key[0] == last
            first[0] = not goes_on
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(first, at, -1))
            seq = at - np.maximum(begin, 0) + np.where(begin < 0, number, 0)
            out = {"seq": seq, "before": np.zeros(n, np.int32), "after": np.zeros(n, np.int32)}
            for j in range(streams):
                k, start = j % kinds, j // kinds
                f0, f1 = (code >> k) & 1, (code >> (k + kinds)) & 1
                known = np.where(first, np.where(start, f1, f0), f0)
                fixed = first | (f0 == f1)
                if goes_on:
                    known[0], fixed[0] = (f1 if state[j] else f0)[0], True
                turns = np.cumsum(~fixed & (f0 == 1))
                since = np.maximum.accumulate(np.where(fixed, at, 0))
                after = known[since] ^ ((turns - turns[since]) & 1)
                before = np.empty_like(after)
                before[1:] = after[:-1]
                before[0] = state[j]
                before[first] = start
                met = np.cumsum(before)
                # lines inside so far, from the begin of the range
                count = met - np.where(begin < 0, -inside[j], (met - before)[np.maximum(begin, 0)])
                out["before"] |= (before << j).astype(np.int32)
                out["after"] |= (after << j).astype(np.int32)
                out[f"c{j}"] = count
                state[j], inside[j] = int(after[-1]), int(count[-1])
            last, number = key[-1], int(seq[-1]) + 1
            yield pd.DataFrame(out)

    schema = "seq bigint, before int, after int, " + ", ".join(f"c{j} bigint" for j in range(streams))
    return F.pandas_udf(states, schema)


def read_pieces(lines: DataFrame) -> DataFrame:
    """One row per line or part of a line that a CR ends, with its states. ``lines``: file_id, block, line, valid, in order within every block.

    seq counts within the block; ending is 0 for LF, 1 for CR and LF, 2 for CR. before and after hold a bit for every candidate begun outside,
    then begun inside; c0, ... count the pieces so far that begin inside.
    """
    line = F.col("line")
    body = F.when(line.endswith("\r"), F.left(line, F.length(line) - 1)).otherwise(line)
    split = F.when(body.contains("\r"), F.split(body, "\r", -1)).otherwise(F.array(body))
    rows = lines.select("*", line.endswith("\r").alias("_crlf"), F.posexplode(split).alias("_sub", "piece"), F.size(split).alias("_subs"))
    ending = F.when(F.col("_sub") + 1 < F.col("_subs"), 2).when(F.col("_crlf"), 1).otherwise(0)
    piece, quoted = F.col("piece"), F.col("piece").contains('"')
    maps = F.lit(0)
    outside, inside = [], []
    for k, delimiter in enumerate(DELIMITERS):
        for inner, ends in enumerate(_ends_inside(piece, delimiter)):
            maps = maps + F.when(ends, 1 << (k + inner * _KINDS)).otherwise(0)
        begun_outside, begun_inside = _separators(piece, delimiter)
        plain = F.length(piece) - F.length(F.replace(piece, F.lit(delimiter), F.lit("")))
        outside.append(F.when(quoted, begun_outside).otherwise(plain))
        inside.append(F.when(quoted, begun_inside).otherwise(0))
    rows = rows.withColumns(
        {
            "ending": ending,
            "outside": F.array(*outside),
            "inside": F.array(*inside),
            "_maps": F.when(quoted, maps).otherwise(_UNCHANGED),
            "_key": F.xxhash64("file_id", "block"),
        }
    )
    rows = rows.withColumn("_state", _states()("_key", "_maps"))
    return rows.select("*", "_state.*").drop("line", "_crlf", "_sub", "_subs", "_maps", "_key", "_state")


def place_ranges(pieces: DataFrame) -> DataFrame:
    """Per range (file_id, block): for every candidate, whether it begins inside quotes and how many records begin before it.

    Only files of more than one range are put in order, one row a range.
    """
    ends = F.max(F.shiftleft("seq", 16) + F.col("after")).alias("last")
    counts = [F.max(f"c{j}").alias(f"c{j}") for j in range(_STREAMS)]
    ranges = materialize(pieces.groupBy("file_id", "block").agg(ends, *counts), "ranges")
    several = ranges.groupBy("file_id").count().where("count > 1").select("file_id")
    kinds, streams = _KINDS, _STREAMS

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        inside, begun, found = [0] * kinds, [0] * kinds, []
        for row in rows.to_dict("records"):
            found.append((row["file_id"], row["block"], list(inside), list(begun)))
            for k in range(kinds):
                j = k + kinds * inside[k]
                begun[k] += (int(row["last"]) >> 16) + 1 - int(row[f"c{j}"])
                inside[k] = (int(row["last"]) >> j) & 1
        return pd.DataFrame(found, columns=["file_id", "block", "inside_at", "records_before"])

    assert streams <= 16
    schema = "file_id string, block bigint, inside_at array<int>, records_before array<bigint>"
    folded = ranges.join(several, "file_id", "left_semi").groupBy("file_id").applyInPandas(fold, schema)
    nothing = F.array_repeat(F.lit(0), _KINDS)
    single = ranges.join(several, "file_id", "left_anti")
    single = single.select("file_id", "block", nothing.alias("inside_at"), nothing.cast("array<bigint>").alias("records_before"))
    return materialize(folded.unionByName(single), "placed")


def _placed(pieces: DataFrame, kind: Column) -> DataFrame:
    """Adds begins_inside, ends_inside, record_no under the candidate number ``kind``."""
    stream = kind + F.lit(_KINDS) * F.get("inside_at", kind)
    bit = lambda c: F.col(c).bitwiseAND(F.expr("shiftleft(1, _stream)")) != 0
    counts = F.array(*[f"c{j}" for j in range(_STREAMS)])
    number = F.get("records_before", kind) + F.col("seq") + 1 - F.get(counts, F.col("_stream"))
    rows = pieces.withColumn("_stream", stream)
    return rows.withColumns({"begins_inside": bit("before"), "ends_inside": bit("after"), "record_no": number}).drop("_stream")


# --- the delimiter ------------------------------------------------------------------------------------------------------------------


def choose_delimiters(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """file_id, kind (number of the delimiter), judged by all records that are not blank.

    For every candidate the number of delimiters that most records have, if at least one, is looked for; the candidate that has it in the
    largest share of records is taken, of equals the one with more delimiters a record, then the first. A share below ``CONSISTENT``
    decides nothing, which means the comma.
    """
    narrow = pieces.select("file_id", "block", "seq", "before", "after", "outside", "inside", *[f"c{j}" for j in range(_STREAMS)], (strip(F.col("piece")) == "").alias("blank"))
    rows = narrow.join(ranges, ["file_id", "block"]).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in range(_KINDS)])))
    rows = _placed(rows, F.col("kind"))
    count = F.get(F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("outside")), F.col("kind"))
    rows = rows.select("file_id", "kind", "record_no", "blank", count.alias("n"), (F.col("begins_inside") | F.col("ends_inside")).alias("part"))
    # a quoted line end is no blank record
    whole = rows.where(~F.col("part") & ~F.col("blank")).groupBy("file_id", "kind", "n").agg(F.count("*").alias("records"))
    parts = rows.where("part").groupBy("file_id", "kind", "record_no").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("file_id", "kind", "n").agg(F.count("*").alias("records"))
    counts = whole.unionByName(parts.withColumn("n", F.col("n").cast("int"))).groupBy("file_id", "kind", "n").agg(F.sum("records").alias("records"))
    positive = F.when(F.col("n") > 0, F.struct("records", "n"))
    best = counts.groupBy("file_id", "kind").agg(F.sum("records").alias("all"), F.max(positive).alias("most"))
    best = best.where(F.col("most.records") >= CONSISTENT * F.col("all"))
    order = F.struct((F.col("most.records") / F.col("all")).alias("share"), F.col("most.n"), (-F.col("kind")).alias("kind"))
    return best.groupBy("file_id").agg((-F.max(order)["kind"]).alias("kind"))


# --- records ------------------------------------------------------------------------------------------------------------------------


def _records(pieces: DataFrame) -> DataFrame:
    """file_id, block, kind, record_no, text of every record; its pieces are put together, a quote that nothing closes is closed.

    Needs begins_inside, ends_inside, record_no, kind, ended (whether the file ends with a line end).
    """
    part = F.col("begins_inside") | F.col("ends_inside")
    keep = ["file_id", "block", "kind", "record_no"]
    whole = pieces.where(~part).select(*keep, F.col("piece").alias("text"))
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), F.col("ending"))
    one = F.struct("block", "seq", "piece", ending.alias("ending"), "ends_inside")
    parts = pieces.where(part).groupBy("file_id", "kind", "record_no").agg(F.sort_array(F.collect_list(one)).alias("p"), F.first("ended").alias("ended"))
    last = F.element_at("p", -1)
    before = F.array_join(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: F.concat(x["piece"], x["ending"])), "")
    # only the last piece of a file ends inside
    end = F.when(F.col("ended"), last["ending"]).otherwise(F.replace(last["ending"], F.lit("\n"), F.lit("")))
    text = F.concat(before, last["piece"], F.when(last["ends_inside"], F.concat(end, F.lit('"'))).otherwise(""))
    return whole.unionByName(parts.select("file_id", F.get("p", F.lit(0))["block"].alias("block"), "kind", "record_no", text.alias("text")))


def _with_fields(records: DataFrame) -> DataFrame:
    return records.withColumn("fields", _by_delimiter(F.col("kind"), lambda d: fields_of(F.col("text"), d)))


def _headers(pieces: DataFrame) -> DataFrame:
    """file_id, header: the fields of the first record. Only files whose first record has several lines are looked through for the rest."""
    first = materialize(pieces.where((F.col("seq") == 0) & (F.col("record_no") == 1) & ~F.col("begins_inside")), "first-lines")
    more = first.where("ends_inside").select("file_id")
    rows = first.where(~F.col("ends_inside"))
    if not more.isEmpty():
        rows = rows.unionByName(pieces.where("record_no = 1").join(more, "file_id", "left_semi"))
    return _with_fields(_records(rows)).select("file_id", F.col("fields").alias("header"))


def _run_of(record_no: Column) -> Column:
    return F.floor((record_no - 1) / RUN).cast("bigint")


def _blank_records(pieces: DataFrame) -> DataFrame:
    """file_id, record_no of the records without a character beside white space; the header is none of them.

    Only what holds nothing but white space, quotes and candidates for a delimiter is parsed.
    """
    part = F.col("begins_inside") | F.col("ends_inside")
    bare = strip(F.translate("piece", '"' + "".join(DELIMITERS), "")) == ""
    several = pieces.where(part).groupBy("file_id", "record_no").agg(F.bool_and(bare).alias("bare")).where("bare").drop("bare")
    parts = pieces.where(part).join(several, ["file_id", "record_no"], "left_semi").select(*pieces.columns)
    likely = pieces.where(~part & bare).unionByName(parts).where("record_no > 1 OR begins_inside")
    return _with_fields(_records(likely)).where(is_blank() & (F.col("record_no") > 1)).select("file_id", "record_no")


def _run_facts(pieces: DataFrame, headers: DataFrame) -> DataFrame:
    """Per run of records in a range (file_id, block, run): names, concepts, blank records of the file before the run (blank_before) and in it (blank)."""
    runs = pieces.where(~F.col("begins_inside")).select("file_id", "block", _run_of(F.col("record_no")).alias("run")).distinct()
    names = headers.select("file_id", F.transform("header", strip).alias("names")).withColumn("concepts", concepts_of("names"))
    # one row a range and run, so a large file spreads over many
    runs = materialize(runs.join(names, "file_id"), "runs")
    blank = materialize(_blank_records(pieces), "blank")
    none = F.array().cast("array<bigint>")
    if blank.isEmpty():
        return runs.withColumns({"blank_before": F.lit(0).cast("bigint"), "blank": none})
    by_run = blank.groupBy("file_id", _run_of(F.col("record_no")).alias("run")).agg(F.sort_array(F.collect_list("record_no")).alias("blank"))
    every = runs.select("file_id", "run").distinct().join(by_run, ["file_id", "run"], "left").withColumn("blank", F.coalesce("blank", none))
    earlier = Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("blank_before", F.coalesce(F.sum(F.size("blank").cast("bigint")).over(earlier), F.lit(0).cast("bigint")))
    return runs.join(every, ["file_id", "run"])


def told_delimiters(pieces: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """``files`` with kind, the number of the delimiter; null where a file is not readable."""
    kinds = choose_delimiters(pieces, ranges)
    kind = F.when(F.col("file_class") == "readable", F.coalesce("kind", F.lit(0)))
    return files.join(kinds, "file_id", "left").withColumn("kind", kind)


def delimiter_of(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DELIMITERS]), kind)


def parse_pieces(pieces: DataFrame, files: DataFrame, max_rows: int | None = None) -> Parsed:
    """Records of the readable ones of ``files``: file_id, name, length, encoding, file_class, latin, prefix, ended.

    Pieces of a ``latin`` file are decoded as Latin-1; its first one begins with ``prefix`` besides. In the result, ``name`` is the file_id.
    record_no counts every record, the header being 1; row_no is 2 for the first record after it that is not blank, and null for the header and
    for blank records. Nothing is returned beyond the ``max_rows``-th such record.
    """
    ranges = place_ranges(pieces)
    files = materialize(told_delimiters(pieces, files, ranges), "delimiters")
    told = ranges.join(files.where("kind IS NOT NULL").select("file_id", "kind", "ended", "latin", "prefix"), "file_id")
    rows = pieces.join(materialize(told, "told"), ["file_id", "block"])
    # lines that are no UTF-8 have been decoded when they were read
    text = F.when(F.col("latin") & F.col("valid"), F.decode(F.col("piece").cast("binary"), "ISO-8859-1")).otherwise(F.col("piece"))
    first = (F.col("block") == 0) & (F.col("seq") == 0)
    rows = _placed(rows.withColumn("piece", F.when(first, F.concat("prefix", text)).otherwise(text)), F.col("kind"))
    rows = rows.select("file_id", "block", "seq", "piece", "ending", "kind", "ended", "begins_inside", "ends_inside", "record_no")
    facts = materialize(_run_facts(rows, _headers(rows)).join(files.select("file_id", "name"), "file_id"), "facts")
    records = _with_fields(_records(rows)).withColumn("run", _run_of(F.col("record_no"))).join(facts, ["file_id", "block", "run"])
    here = F.size(F.filter("blank", lambda n: n <= F.col("record_no")))
    kept = (F.col("record_no") > 1) & ~F.array_contains("blank", F.col("record_no"))
    row_no = F.when(kept, F.col("record_no") - F.col("blank_before") - here)
    records = records.select(F.col("name").alias("file_id"), "record_no", row_no.alias("row_no"), "names", "concepts", "fields")
    records = records if max_rows is None else limit_rows(records, max_rows)
    error = F.lit(None).cast("string").alias("error")
    known = files.select(F.col("name").alias("file_id"), "length", "encoding", "file_class", delimiter_of(F.col("kind")).alias("delimiter"), error)
    return Parsed(known, materialize(records, "records", RECORD_ROWS))
