"""Hard negatives: for every anchor and each of its nearest rows of the same label, rows of other labels somewhat less near.

Scores are integer inner products of quantised vectors. All rows are written as Parquet blocks along a Hilbert curve through their
most spread components, with the least and greatest value of every component of a block (its zone). Interval arithmetic over a zone
bounds the scores that an anchor can meet in the block; only blocks whose bounds meet what the anchor still looks for are read.

Anchors travel in groups of neighbours on the curve. Zones go to pages, each group meets each page of zones, and names the blocks it must
read; the blocks' rows are then joined with the groups that named them, and scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.durable import materialize

#: Rows of a block; its vectors are one value of a Parquet row.
BLOCK_ROWS = 1024
#: Blocks that are joined by one key, and zones that a group of anchors meets at a time.
PAGE_BLOCKS, ZONE_PAGE = 16, 256
GROUP_ANCHORS = 512
#: Components that the curve runs through, and bits of each.
CURVE, BITS = 10, 6
ANCHORS, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score lies between so many percent of the positive's.
LOW, HIGH = 30, 90
#: Groups of anchors whose best scores a worker remembers.
REMEMBERED = 256

BLOCK = "block bigint, page bigint, ids binary, nameless binary, labels binary, data binary, lo binary, hi binary"
GROUP = "grp bigint, ids binary, labels binary, home binary, floor binary, data binary"
FOUND = "grp bigint, anchor int, anchor_id bigint, slot int, score bigint, id bigint, nameless boolean, row bigint"


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part: components as floor(256 * x), every seventh label moved on."""
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of points with coordinates below ``2 ** bits`` on the Hilbert curve (Skilling's transform, all points at once)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ turn) >> b) & 1)
    return place


def _key_of(spans: list[tuple[int, int, int]]) -> Column:
    """The place on the curve; ``spans``: component, least and greatest value of each dimension of the curve."""
    bits = BITS

    @F.pandas_udf("bigint")
    def place(vectors: pd.Series) -> pd.Series:
        points = np.array([[v[k] for k, _, _ in spans] for v in vectors], np.float64).reshape(len(vectors), len(spans))
        low, high = (np.array([s[j] for s in spans], np.float64) for j in (1, 2))
        cells = np.floor((points - low) / np.maximum(high - low + 1, 1) * (1 << bits))
        return pd.Series(hilbert(cells.astype(np.int64), bits))

    return place("vector")


class Numbers:
    """How vectors are kept: components of a vector, bytes of one, and how scores are made without rounding."""

    def __init__(self, size: int, largest: int):
        most = max(size, 1) * largest * largest
        if most >= 1 << 63:
            raise ValueError("scores of these vectors may not fit 64 bits")
        self.size = max(size, 1)
        self.kept = np.int32 if largest < 1 << 31 else np.int64
        # sums of products below 2 ** 53 are exact in a double
        self.work = np.float64 if most < 1 << 53 else np.int64

    def vectors(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kept).reshape(-1, self.size).astype(self.work)

    def bounds(self, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of every anchor with anything between ``lo`` and ``hi`` (zones by rows)."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        lo, hi = lo.astype(self.work).T, hi.astype(self.work).T
        return up @ lo + down @ hi, up @ hi + down @ lo


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


BLOCK_ARROW = pa.schema([("block", pa.int64()), ("page", pa.int64()), *[(n, pa.binary()) for n in ("ids", "nameless", "labels", "data", "lo", "hi")]])
GROUP_ARROW = pa.schema([("grp", pa.int64()), *[(n, pa.binary()) for n in ("ids", "labels", "home", "floor", "data")]])


def blocks_of(rows: DataFrame, numbers: Numbers, spans: list[tuple[int, int, int]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Packs rows (vec_id, label, vector) into blocks along the curve, see ``BLOCK``. Rows of a block are in order of id."""
    size = numbers.size

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, count = TaskContext.get().partitionId(), [], 0

        def block(number: int, table: pa.Table) -> pa.RecordBatch:
            ids = table["vec_id"].combine_chunks()
            nameless = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(2**63 - 1), np.int64)
            # null ids come last
            order = np.lexsort((nameless, ids))
            vectors = np.asarray(table["vector"].combine_chunks().flatten(), np.int64).reshape(-1, size)[order]
            labels = np.asarray(table["label"], np.int64)[order]
            name = (part << 24) + number
            values = (ids[order], nameless[order], labels, vectors.astype(numbers.kept), vectors.min(0), vectors.max(0))
            return _table([(name, (part << 24) + number // PAGE_BLOCKS, *[v.tobytes() for v in values])], BLOCK_ARROW)

        number = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= block_rows:
                table = pa.Table.from_batches(held)
                yield block(number, table.slice(0, block_rows))
                held, count, number = table.slice(block_rows).to_batches(), count - block_rows, number + 1
        if count:
            yield block(number, pa.Table.from_batches(held))

    full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get("vector", i), F.lit(0).cast("bigint")))
    rows = rows.withColumn("vector", full).withColumn("place", _key_of(spans))
    # the id parts rows that share a place
    rows = rows.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id").select("vec_id", "label", "vector")
    return rows.mapInArrow(pack, BLOCK)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _best(scores: np.ndarray, allowed: np.ndarray, ceiling: np.ndarray, floor: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``scores`` the first ``count`` allowed columns with floor <= score <= ceiling, greatest first, ties by column.

    Returns row, column, and per row the score of the last one where all ``count`` are there, else the floor.
    """
    fits = allowed & (scores <= ceiling[:, None]) & (scores >= floor[:, None])
    row, column = np.nonzero(fits)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < count
    row, column = row[keep], column[keep]
    met = np.bincount(row, minlength=len(scores))
    last = np.array(floor)
    full = np.flatnonzero(met == count)
    ends = np.cumsum(met)[full] - 1
    last[full] = scores[row[ends], column[ends]]
    return row, column, last


def anchor_groups(blocks: DataFrame, numbers: Numbers, size: int = GROUP_ANCHORS) -> DataFrame:
    """Packs anchors into groups of neighbours, see ``GROUP``. ``home`` names their rows; no positive scores below ``floor``.

    The floor is the score of the last of so many positives, where the anchor's own block has them.
    """
    lowest = np.iinfo(np.int64).min

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, count
            while count >= size or (last and count):
                together = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield _table([((part << 24) + number, *[x[:size].tobytes() for x in together])], GROUP_ARROW)
                held, count, number = [tuple(x[size:] for x in together)], max(count - size, 0), number + 1

        for r in _rows_of(batches):
            ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
            at = np.flatnonzero((ids % ANCHORS == 0) & ~np.frombuffer(r["nameless"], bool))
            if not len(at):
                continue
            vectors = numbers.vectors(r["data"])
            scores = (vectors[at] @ vectors.T).astype(np.int64)
            allowed = labels[at][:, None] == labels[None, :]
            allowed[np.arange(len(at)), at] = False
            none = np.full(len(at), lowest)
            floor = _best(scores, allowed, np.full(len(at), np.iinfo(np.int64).max), none, POSITIVES)[2]
            held.append((ids[at], labels[at], (r["block"] << 12) + at, floor, np.frombuffer(r["data"], numbers.kept).reshape(-1, numbers.size)[at]))
            count += len(at)
            yield from groups(False)
        yield from groups(True)

    return blocks.mapInArrow(pack, GROUP)


def _windows(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, slot, ceiling, floor of what a group looks for: positives above its floor, or negatives in windows."""
    if r.get("windows") is None:
        floor = np.frombuffer(r["floor"], np.int64)
        return np.arange(len(floor)), np.zeros(len(floor), np.int64), np.full(len(floor), np.iinfo(np.int64).max), floor
    found = np.array([(w["anchor"], w["slot"], w["score"]) for w in r["windows"]], np.int64).reshape(-1, 3)
    anchor, slot, score = found[found[:, 2] >= 0].T
    # in whole numbers without overflow: scores may fill 63 bits
    part, rest = score // 100, score % 100
    return anchor, slot, part * HIGH + rest * HIGH // 100, part * LOW + -(-rest * LOW // 100)


def _other_labels(labels: np.ndarray, own: np.ndarray, same: bool) -> np.ndarray:
    return (own[:, None] == labels[None, :]) == same


def chosen(blocks: DataFrame, groups: DataFrame, numbers: Numbers, pages: int) -> DataFrame:
    """(page, grp, wanted): the blocks of every page that a group must read, by the bounds over their zones."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows_of(batches):
            zones = r["zones"]
            anchors, labels = numbers.vectors(r["data"]), np.frombuffer(r["labels"], np.int64)
            least, most = numbers.bounds(anchors, *[np.stack([np.frombuffer(z[k], np.int64) for z in zones]) for k in ("lo", "hi")])
            same = r.get("windows") is None
            held = np.stack([_other_labels(np.unique(np.frombuffer(z["labels"], np.int64)), labels, same).any(1) for z in zones], 1)
            anchor, _, ceiling, floor = _windows(r)
            need = (held[anchor] & (most[anchor] >= floor[:, None]) & (least[anchor] <= ceiling[:, None])).any(0)
            by_page: dict[int, list[int]] = {}
            for k in np.flatnonzero(need):
                by_page.setdefault(zones[k]["page"], []).append(zones[k]["block"])
            if by_page:
                yield pa.record_batch({"page": pa.array(by_page.keys(), pa.int64()), "grp": pa.array([r["grp"]] * len(by_page), pa.int64()), "wanted": pa.array(by_page.values(), pa.list_(pa.int64()))})

    place = F.pmod(F.xxhash64("page"), F.lit(pages)).alias("at")
    zones = blocks.groupBy(place).agg(F.collect_list(F.struct("block", "page", "lo", "hi", "labels")).alias("zones"))
    every = groups.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pages - 1).cast("bigint"))))
    return zones.join(every, "at").drop("at").mapInArrow(choose, "page bigint, grp bigint, wanted array<bigint>")


def scored(blocks: DataFrame, groups: DataFrame, named: DataFrame, numbers: Numbers) -> DataFrame:
    """What the groups look for in the blocks that they named, see ``FOUND``: the best of every block, no worse than what the task has met."""
    fields = pa.schema([("grp", pa.int64()), ("anchor", pa.int32()), ("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("nameless", pa.bool_()), ("row", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        for r in _rows_of(batches):
            same = r.get("windows") is None
            anchor, slot, ceiling, floor = _windows(r)
            floor = floors.pop(r["grp"], floor)
            anchors, own = numbers.vectors(r["data"]), np.frombuffer(r["labels"], np.int64)
            zone = [np.frombuffer(r[k], np.int64)[None, :] for k in ("lo", "hi")]
            least, most = (b[:, 0] for b in numbers.bounds(anchors, *zone))
            look = np.flatnonzero((most[anchor] >= floor) & (least[anchor] <= ceiling))
            labels = np.frombuffer(r["their_labels"], np.int64)
            who, inverse = np.unique(anchor[look], return_inverse=True)
            products = (anchors[who] @ numbers.vectors(r["their_data"]).T).astype(np.int64)
            allowed = _other_labels(labels, own[who], same)
            rows = (r["block"] << 12) + np.arange(len(labels))
            if same:
                allowed &= np.frombuffer(r["home"], np.int64)[who][:, None] != rows[None, :]
            at, column, last = _best(products[inverse], allowed[inverse], ceiling[look], floor[look], POSITIVES if same else NEGATIVES)
            better = np.array(floor)
            better[look] = last
            floors[r["grp"]] = better
            while len(floors) > REMEMBERED:
                del floors[next(iter(floors))]
            if len(at):
                found = look[at]
                ids, nameless = np.frombuffer(r["their_ids"], np.int64)[column], np.frombuffer(r["nameless"], bool)[column]
                own_ids = np.frombuffer(r["ids"], np.int64)[anchor[found]]
                values = (np.full(len(at), r["grp"]), anchor[found], own_ids, slot[found], products[inverse[at], column], ids, nameless, rows[column])
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], schema=fields)

    theirs = blocks.select("page", "block", "lo", "hi", "nameless", *[F.col(c).alias(f"their_{c}") for c in ("ids", "labels", "data")])
    asked = named.join(groups, "grp")
    tiles = theirs.join(asked, "page").where(F.array_contains("wanted", F.col("block"))).drop("wanted", "page")
    return tiles.mapInArrow(score, FOUND)


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first rows of every key by score, then id (null last), then place; numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "nameless", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(embeddings: DataFrame, block_rows: int = BLOCK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """Up to ten hard negatives for every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with null labels, null vectors, or a null, infinite or undefined component take no part. Every row is one of its own: where an id
    repeats, each of its rows is an anchor, positive or negative. A row without an id is no anchor, and comes last among ties. A shorter
    vector counts as filled up with zeros. Positives with negative scores have no negatives. Other columns are left alone.
    """
    rows = materialize(quantised(embeddings), "vectors")
    cells = rows.select(F.posexplode("vector").alias("k", "x"))
    spread = cells.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.variance("x").alias("spread")).collect()
    largest = max((max(abs(s.low), abs(s.high)) for s in spread), default=0)
    numbers = Numbers(max((s.k + 1 for s in spread), default=0), largest)
    widest = sorted(spread, key=lambda s: (-(s.spread or 0), s.k))[:CURVE]
    blocks = materialize(blocks_of(rows, numbers, [(s.k, s.low, s.high) for s in widest] or [(0, 0, 0)], block_rows), "blocks")
    groups = materialize(anchor_groups(blocks, numbers, group_anchors), "anchors")
    pages = 1 + blocks.count() // ZONE_PAGE

    sought = groups.withColumn("windows", F.lit(None).cast("array<struct<anchor: int, slot: int, score: bigint>>"))
    near = scored(blocks, sought, chosen(blocks, sought, numbers, pages), numbers)
    positives = _first(near, ["grp", "anchor"], POSITIVES).select("grp", "anchor", F.col("rank").alias("slot"), "score", "id", "nameless")
    positives = materialize(positives, "positives")

    asked = positives.groupBy("grp").agg(F.collect_list(F.struct("anchor", "slot", "score")).alias("windows"))
    sought = materialize(groups.join(asked, "grp"), "windows")
    less = scored(blocks, sought, chosen(blocks, sought, numbers, pages), numbers)
    negatives = _first(less, ["grp", "anchor", "slot"], NEGATIVES).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    named = positives.select("grp", "anchor", "slot", F.col("id").alias("positive_id"), F.col("nameless").alias("_nameless"), F.col("score").alias("positive_score"))
    found = negatives.join(named, ["grp", "anchor", "slot"])
    return found.select(
        "anchor_id",
        F.when(~F.col("_nameless"), F.col("positive_id")).alias("positive_id"),
        "rank",
        F.when(~F.col("nameless"), F.col("negative_id")).alias("negative_id"),
        "positive_score",
        "negative_score",
    )
