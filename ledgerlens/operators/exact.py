"""Figures of columns and ledgers that hold numbers longer than a DECIMAL: the same figures, from limbs.

Only such columns and files come here. Numbers are parsed into limbs by distinct value, limbs are added up by Spark's aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.durable import materialize
from ledgerlens.functions import limbs
from ledgerlens.operators.ordered import in_middle, running_sum


def added_limbs(rows: DataFrame, keys: list[str], parts: Column, weight: Column, name: str) -> DataFrame:
    """Per group the sums of all limbs, as one array: keys, ``name``. A group of zeros has no limb."""
    each = rows.select(*keys, weight.cast("decimal(20,0)").alias("_w"), F.explode_outer(parts).alias("_p"))
    each = each.select(*keys, F.col("_p.i").alias("i"), (F.col("_p.v").cast("decimal(10,0)") * F.col("_w")).cast("decimal(30,0)").alias("v"))
    sums = each.groupBy(*keys, "i").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    return sums.groupBy(*keys).agg(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v"))).alias(name))


def _batch_sums() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    # Made inside a function so that it reaches the workers by value, without this package installed there.
    made = limbs.python_parts()
    scaled, cut = made["scaled"], made["cut"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for rows in batches:
            # sum and sum of squares by column and unit
            found: dict[tuple, list[int]] = {}
            for file_id, position, text, weight in zip(rows["file_id"], rows["position"], rows["text"], rows["cnt"].tolist()):
                value, n = scaled(text)
                both = found.setdefault((file_id, position, n), [0, 0])
                weighed = value * weight
                both[0] += weighed
                both[1] += weighed * value
            out = []
            for (file_id, position, n), both in found.items():
                for squared, value in enumerate(both):
                    parts = cut(value, n * (squared + 1)) or [{"i": None, "v": 0}]
                    out += [(file_id, position, squared, p["i"], Decimal(p["v"])) for p in parts]
            made = pd.DataFrame(out, columns=["file_id", "position", "squared", "i", "v"])
            yield made.astype({"i": "Int32"})

    return sums


def sums_of_numbers(rows: DataFrame) -> DataFrame:
    """Per column the limbs of the sum and of the sum of squares: file_id, position, sums, squares. ``rows``: file_id, position, text, cnt.

    The numbers of a batch are added up where they are read, so little is shuffled. A column of zeros has no limb.
    """
    kind = rows.schema["position"].dataType.simpleString()
    schema = f"file_id string, position {kind}, squared int, i int, v decimal(38,0)"
    each = rows.select("file_id", "position", "text", "cnt").mapInPandas(_batch_sums(), schema)
    added = each.groupBy("file_id", "position", "squared", "i").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    limb = F.struct("i", "v")
    return added.groupBy("file_id", "position").agg(
        *[F.collect_list(F.when(F.col("i").isNotNull() & (F.col("squared") == k), limb)).alias(name) for k, name in enumerate(("sums", "squares"))]
    )


def long_number_statistics(parsed: DataFrame, columns: DataFrame) -> DataFrame:
    """file_id, column_position and the five figures of ``columns`` (file_id, position); ``parsed`` as from ``parsed_values``.

    Minimum and maximum are the texts as normalized, of equal numbers that of the first row. Mean, median and population standard deviation are
    rounded once, to six places, and null only where 24 digits cannot hold them.
    """
    column = ["file_id", "position"]
    rows = parsed.filter((F.col("value") != "") & F.col("number.valid")).select(*column, "cnt", "first_row", F.col("number.text").alias("text"))
    rows = rows.join(columns, column, "left_semi").withColumn("key", limbs.order_key(F.col("text")))
    facts = rows.groupBy(*column).agg(
        F.sum("cnt").alias("n"),
        F.min(F.struct("key", "first_row", "text")).alias("low"),
        F.max(F.struct("key", (-F.col("first_row")).alias("r"), "text")).alias("high"),
    )
    middles = in_middle(rows.groupBy(*column, F.col("key").alias("number")).agg(F.sum("cnt").alias("cnt")), column)
    facts = facts.join(sums_of_numbers(rows), column)
    return facts.join(middles, column).select(
        "file_id",
        F.col("position").cast("int").alias("column_position"),
        F.col("low.text").alias("minimum_value"),
        F.col("high.text").alias("maximum_value"),
        limbs.mean(F.col("n"), F.col("sums")).alias("mean_value"),
        limbs.middle(F.col("a"), F.col("b")).alias("median_value"),
        limbs.deviation(F.col("n"), F.col("sums"), F.col("squares")).alias("standard_deviation"),
    )


def long_totals(parsed: DataFrame, files: DataFrame, sums: dict[str, str]) -> DataFrame:
    """file_id and a total for every name of ``sums`` of the ``files`` (file_id): null where no value is a number, or the total too large.

    ``parsed``: file_id and, by the values of ``sums``, parsed numbers.
    """
    rows = parsed.join(files, "file_id", "left_semi")
    each = rows.select("file_id", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"{c}.text").alias("text")) for name, c in sums.items()])).alias("e"))
    each = each.select("file_id", "e.name", "e.text").where("text IS NOT NULL")
    added = added_limbs(each, ["file_id", "name"], limbs.limbs_of(F.col("text")), F.lit(1), "sums").withColumn("total", limbs.total(F.col("sums")))
    found = added.groupBy("file_id").agg(*[F.max(F.when(F.col("name") == name, F.col("total"))).alias(name) for name in sums])
    return files.join(found, "file_id", "left")


def _limb_rows(rows: DataFrame, texts: dict[str, int], keys: list[str]) -> DataFrame:
    """keys, i, v: the limbs of the numbers in columns of text, each times 1 or -1."""

    def signed_limbs(text: Column, sign: int) -> Column:
        return F.transform(limbs.limbs_of(text), lambda p: F.struct(p["i"].alias("i"), (p["v"] * sign).alias("v")))

    signed = [signed_limbs(F.col(c), sign) for c, sign in texts.items()]
    # a row of zeros, or without a number, counts with a limb of zero
    nothing = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("v"))).cast(limbs.LIMBS)
    parts = F.concat(nothing, *[part.cast(limbs.LIMBS) for part in signed])
    return rows.select(*keys, F.explode(parts).alias("p")).groupBy(*keys, "p.i").agg(F.sum("p.v").alias("v"))


def long_balances(rows: DataFrame, tolerance: str) -> DataFrame:
    """What the rows of ledgers with long numbers must say: file_id, row_no, verifiable, opening, expected, expected_text, matches.

    ``rows``: file_id, row_no, reported_text, scale, complete (balance and movement are numbers), and the movement as text to add (plus) and to take
    away (minus). The balance expected in a row is that of the first one and the movements of all others so far. Every limb is summed up
    on its own, in blocks of rows; the limbs of a row are put together at the end.
    """
    key = ["file_id", "row_no"]
    verifiable = rows.groupBy("file_id").agg(F.bool_and("complete").alias("verifiable"))
    good = rows.join(verifiable.where("verifiable").select("file_id"), "file_id", "left_semi")
    first = F.col("row_no") == 2
    given = good.select(*key, F.when(first, F.col("reported_text")).otherwise(F.col("plus")).alias("plus"), F.when(~first, F.col("minus")).alias("minus"))
    parts = materialize(_limb_rows(given, {"plus": 1, "minus": -1}, key), "limbs")
    kinds = parts.select("file_id", "i").distinct().groupBy("file_id").agg(F.collect_list("i").alias("kinds"))
    # one row per row and limb of its file, so that every limb runs through
    dense = good.select(*key).join(kinds, "file_id").select(*key, F.explode("kinds").alias("i")).join(parts, [*key, "i"], "left")
    run = running_sum(dense.withColumn("v", F.coalesce("v", F.lit(0).cast("bigint"))), ["file_id", "i"], "row_no", F.col("v"), "s")
    sums = run.groupBy(*key).agg(F.collect_list(F.struct("i", F.col("s").cast("decimal(38,0)").alias("v"))).alias("sums"))
    told = sums.join(good.select(*key, "reported_text", "scale"), key)
    told = told.select(*key, limbs.followed(F.col("sums"), F.col("reported_text"), F.col("scale"), tolerance).alias("f"))
    opening = _limb_rows(good.where(first), {"reported_text": 1, "plus": -1, "minus": 1}, ["file_id"])
    opening = opening.groupBy("file_id").agg(F.collect_list(F.struct("i", F.col("v").cast("decimal(38,0)").alias("v"))).alias("sums"))
    opening = opening.select("file_id", limbs.total(F.col("sums")).alias("opening"))
    found = rows.select(*key).join(verifiable, "file_id").join(opening, "file_id", "left").join(told, key, "left")
    return found.select(*key, "verifiable", "opening", F.col("f.value").alias("expected"), F.col("f.text").alias("expected_text"), F.col("f.matches").alias("matches"))
