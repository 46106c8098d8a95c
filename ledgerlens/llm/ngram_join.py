"""Jaccard self-join on word shingles by the pigeonhole principle over a partitioned universe.

The universe of shingles is cut by hash into segments. Two sets that differ in at most H shingles must agree on
one of H + 1 disjoint segments, or differ by one shingle on one segment that counts twice. The number of segments
goes with the size of the sets: sizes fall into bands, a set is indexed in the band of its size, and a larger set
probes the band of its own size and every lower one that may hold partners. Which segments a set probes, which it skips and where it probes the
one-deletion neighbourhood is chosen per set by cost: small subsets are common, so they are expensive.

Only keys that occur twice survive the first aggregation. Copies collapse before pairs are formed, and buckets are
contracted around their most central member, so a group of copies costs its rows, not its pairs. Pairs are listed only
between parts that are still apart, and only of sets that can be partners: in large buckets, shingles that no other candidate holds
bound from above what a set shares with any of them, and the bits in which two sketches differ, one bit for the parity
of each of many buckets of shingles, bound from below in how many shingles two sets differ. Every candidate that sketches leave is
verified on both whole texts, and only then are texts shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.durable import materialize
from ledgerlens.llm.components import components
from ledgerlens.llm.words import buffer_of, distinct, mix, seeds, shingles_of, slices, words_of, tidied

SHINGLE_WORDS = 4
PERCENT = 85
#: Ids of candidates that are broadcast, 16 bytes each; more are joined by shuffling.
BROADCAST_IDS = 1_000_000

BAND_RATIO = 1.5
#: One segment in so many carries one-deletion neighbourhoods, one at least.
DELETION_SHARE = 64
INDEX, INDEX_DELETED, PROBE, PROBE_NEAR, PROBE_DELETED = 1, 2, 4, 8, 16
PROBES = PROBE | PROBE_NEAR | PROBE_DELETED
#: Expected partners on a key of a subset of k shingles: COMMON * RARER ** k.
COMMON, RARER = 1e5, 0.25

#: 64-bit words of a sketch.
SKETCH_WORDS = 16
#: Words of the sketch that goes with every row of a bucket.
FOLDED_WORDS = 4
#: In buckets of more rows, shingles that nobody else holds leave out sets before pairs are compared; in others that costs more than it saves.
CROWD = 1024

_CONTENT = seeds(1, 21)[0]


def largest_difference(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which sets of these sizes can differ when 100 * intersection >= percent * union."""
    return (100 - percent) * (np.asarray(a, np.int64) + b) // (100 + percent)


class Bands:
    """Sizes up to ``top[b]`` belong to band b, which has ``segments[b]``, the first ``deletions[b]`` with neighbourhoods."""

    def __init__(self, percent: int, largest: int):
        tops = [5]
        while tops[-1] < largest:
            tops.append(int(tops[-1] * BAND_RATIO))
        self.percent = percent
        self.top = np.array(tops, np.int64)
        self.segments = largest_difference(self.top, self.top * 100 // percent, percent) + 1
        self.deletions = np.maximum(1, self.segments // DELETION_SHARE)
        self.seed = seeds(len(tops), 31)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.top, size)

    def needed(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Units a set of this size must probe in this band: one more than the largest difference."""
        return largest_difference(size, np.minimum(size, self.top[band]), self.percent) + 1


def _expected(k: np.ndarray) -> np.ndarray:
    return 1 + COMMON * RARER ** np.minimum(k, 30)


def _keys(bands: Bands, band: np.ndarray, size: np.ndarray, member: np.ndarray, token: np.ndarray, index: bool):
    """Keys of sets: set number, key, role. ``member`` numbers the set of each token; the sets lie in ``band``."""
    m, d = bands.segments[band], bands.deletions[band]
    base = np.cumsum(m) - m
    total = int(m.sum())
    owner = np.repeat(np.arange(len(m)), m)
    segment = np.arange(total) - base[owner]
    spread = mix(token ^ bands.seed[band][member])
    place = base[member] + ((spread >> np.uint64(32)) * m[member].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    content = mix(token * _CONTENT)
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, place, content)
    k = np.bincount(place, minlength=total)
    salt = mix(segment.astype(np.uint64) + bands.seed[band][owner])

    near = np.flatnonzero(segment < d[owner])
    near = near[k[near] > 0]
    cost = np.concatenate([_expected(k), _expected(k[near]) + (k[near] + 1) + k[near] * _expected(k[near] - 1)])
    unit_owner = np.concatenate([owner, owner[near]])
    order = np.lexsort((cost, unit_owner))
    counts = np.bincount(unit_owner, minlength=len(m))
    rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[unit_owner[order]]
    chosen = np.zeros(len(order), bool)
    chosen[order[rank < bands.needed(size, band)[unit_owner[order]]]] = True
    probed = chosen[:total]
    doubled = np.zeros(total, bool)
    doubled[near] = chosen[total:]

    role = INDEX * int(index) + PROBE * probed + PROBE_NEAR * doubled
    full = np.flatnonzero(role)
    gone = np.flatnonzero(segment[place] < d[owner[place]]) if index else np.flatnonzero(doubled[place])
    gone_role = INDEX_DELETED * int(index) + PROBE_DELETED * doubled[place[gone]]
    return (
        np.concatenate([owner[full], owner[place[gone]]]),
        np.concatenate([mix(sums[full] + salt[full]), mix(sums[place[gone]] - content[gone] + salt[place[gone]])]),
        np.concatenate([role[full], gone_role]),
    )


def _set_slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of the batch's rows with the (text, shingle) pairs of their sets."""
    data, offsets = buffer_of(batch.column(1))
    for low, high in slices(offsets):
        text, shingle, _ = shingles_of(words_of(data, offsets[low : high + 1]), size)
        yield low, high, *distinct(text, shingle)


@tidied
def _sizes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "one", "two"]
    for batch in batches:
        for low, high, text, shingle in _set_slices(batch, size):
            n = np.bincount(text, minlength=high - low)
            one, two = np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)
            np.add.at(one, text, mix(shingle))
            np.add.at(two, text, mix(shingle * _CONTENT))
            columns = [batch.column(0).slice(low, high - low), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


@tidied
def _rows(batches: Iterator[pa.RecordBatch], size: int, percent: int, narrow: bool) -> Iterator[pa.RecordBatch]:
    """Keys of all sets. ``narrow``: key and weight only; a weight is 1, and 2 ** 32 more for a key that is probed."""
    for batch in batches:
        ids = batch.column(0)
        for low, _, text, shingle in _set_slices(batch, size):
            n = np.bincount(text)
            bands = Bands(percent, int(n.max(initial=1)))
            own = bands.of(n)
            found = []
            # own band, then lower bands while sets of their top size can be similar enough
            for below in range(len(bands.top)):
                band = np.maximum(own - below, 0)
                wanted = (n > 0) & (own >= below) & (100 * bands.top[band] >= percent * n)
                # equal sets are found by their digest
                wanted &= (bands.needed(n, band) if below else largest_difference(n, n * 100 // percent, percent) + 1) > 1
                if not wanted.any():
                    break
                sets = np.flatnonzero(wanted)
                number = np.cumsum(wanted) - 1
                inside = wanted[text]
                owner, key, role = _keys(bands, band[sets], n[sets], number[text[inside]], shingle[inside], below == 0)
                found.append((sets[owner], key, role))
            if not found:
                continue
            text, key, role = (np.concatenate(x) for x in zip(*found, strict=True))
            key = pa.array(key.view(np.int64))
            if narrow:
                weight = pa.array(1 + (((role & PROBES) > 0).astype(np.int64) << 32))
                yield pa.RecordBatch.from_arrays([key, weight], names=["key", "weight"])
            else:
                info = pa.array(n[text].astype(np.int64) * 32 + role)
                yield pa.RecordBatch.from_arrays([key, ids.take(pa.array(text + low)), info], names=["key", "id", "info"])


@tidied
def _shingles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, _, text, shingle in _set_slices(batch, size):
            columns = [batch.column(0).take(pa.array(text + low)), pa.array(shingle.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingle"])


@tidied
def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Size and sketch of every set: bit b is the parity of the number of its shingles in bucket b."""
    names = ["id", "n", *[f"bits_{w}" for w in range(SKETCH_WORDS)]]
    for batch in batches:
        for low, high, text, shingle in _set_slices(batch, size):
            words = np.zeros((high - low, SKETCH_WORDS), np.uint64)
            bucket = (shingle >> np.uint64(32)) % np.uint64(64 * SKETCH_WORDS)
            np.bitwise_xor.at(words, (text, (bucket >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bucket & np.uint64(63)))
            columns = [batch.column(0).slice(low, high - low), pa.array(np.bincount(text, minlength=high - low))]
            columns += [pa.array(np.ascontiguousarray(words[:, w]).view(np.int64)) for w in range(SKETCH_WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


@tidied
def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, text_a, text_b) whose whole sets are similar enough."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = buffer_of(column)
        for i in range(len(offsets) - 1):
            yield np.unique(shingles_of(words_of(data, offsets[i : i + 2]), size)[1])

    for batch in batches:
        keep = []
        for one, two in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(common > 0 and 100 * common >= percent * (len(one) + len(two) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``df`` joined ("left_semi" or "left_anti") with ``ids`` of one column; a list of checked size is broadcast."""
    ids = materialize(ids.distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)


def similar_sets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row (id, n_shingles, component_id) per row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A document's set holds its distinct
    shingles of ``size`` words; a shorter text is one shingle; null and empty texts have an empty set and no links.
    Documents link when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reachable.
    Other columns are left out. Rows that repeat an id are one document, linked through any of its texts. A row
    with a null id has its size, no links and a null component.
    """
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    sizes = materialize(texts.mapInArrow(partial(_sizes, size=size), "id bigint, n bigint, one bigint, two bigint"), "sets")
    known = sizes.where("id IS NOT NULL AND n > 0")
    classes = known.groupBy("n", "one", "two").agg(F.min("id").alias("rep"))
    members = materialize(known.join(classes, ["n", "one", "two"]).select("id", "rep").distinct(), "members")

    named = texts.where("id IS NOT NULL")
    keys = named.mapInArrow(partial(_rows, size=size, percent=percent, narrow=True), "key bigint, weight bigint")
    shared = keys.groupBy("key").agg(F.sum("weight").alias("w")).where("w % 4294967296 > 1 AND w >= 4294967296")
    # written, so that the shuffle of all keys is gone before that of all rows begins; joined in one way at any size
    shared = materialize(shared.select("key"), "shared")
    rows = named.mapInArrow(partial(_rows, size=size, percent=percent, narrow=False), "key bigint, id bigint, info bigint")
    rows = rows.join(shared.hint("merge"), "key").join(members, "id")
    rows = materialize(rows.select("key", F.col("rep").alias("id"), "info").distinct(), "keys")

    verified = partial(_verify, size=size, percent=percent)
    texts_of = materialize(by_ids(named, rows.select("id"), "left_semi"), "texts")

    bits = [f"bits_{w}" for w in range(SKETCH_WORDS)]
    kinds = ", ".join(f"{b} bigint" for b in bits)
    sketches = materialize(texts_of.mapInArrow(partial(_sketches, size=size), f"id bigint, n bigint, {kinds}").distinct(), "sketches")

    def few_differ(one: list[Column], two: list[Column], both: Column) -> Column:
        """Whether sets of ``both`` shingles together can be similar enough, by bits of their sketches."""
        differ = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(one, two, strict=True)), F.lit(0))
        return differ * (100 + percent) <= both * (100 - percent)

    def links(pairs: DataFrame) -> DataFrame:
        # sketches are a tenth of the texts or less, and few pairs are left by them
        left, right = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(b).alias(f"{b}_{x}") for b in bits]) for x in "ab")
        alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        alike &= few_differ([F.col(f"{b}_a") for b in bits], [F.col(f"{b}_b") for b in bits], F.col("n_a") + F.col("n_b"))
        pairs = materialize(pairs.join(left, "a").join(right, "b").where(alike).select("a", "b").distinct(), "alike")
        wanted = by_ids(texts_of, pairs.select(F.explode(F.array("a", "b")).alias("id")), "left_semi")
        left, right = (wanted.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return materialize(both.mapInArrow(verified, "a bigint, b bigint"), "links")

    # first, every bucket around its most central member: the one whose buckets are the largest together
    members_of = rows.groupBy("key").agg(F.count("*").alias("n"))
    central = rows.join(members_of, "key").groupBy("id").agg(F.sum("n").alias("n"))
    hubs = rows.join(central, "id").groupBy("key").agg(F.max(F.struct("n", "id"))["id"].alias("hub"), F.count("*").alias("n"))
    tried = rows.join(hubs.where("n > 1"), "key").where("id <> hub")
    tried = materialize(tried.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "pairs")
    found = links(tried)

    # then, in buckets that are still in parts, all that is not in the largest part against the other parts
    parts = components(found).withColumnRenamed("node", "id")
    rows = rows.join(parts, "id", "left").select("key", "id", "info", F.coalesce("component", "id").alias("part"))
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = counts.groupBy("key").agg(F.max_by("part", "n").alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    split = split.where("parts > 1").select("key", "main", (F.col("n") > CROWD).alias("crowded"))
    rows = materialize(rows.join(split, "key"), "parts")
    n = F.expr("info DIV 32")
    # partners in a crowded bucket are both among these
    shingles = by_ids(texts_of, rows.where("crowded").select("id"), "left_semi").mapInArrow(partial(_shingles, size=size), "id bigint, shingle bigint")
    private = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    private = private.groupBy("id").agg(F.count("*").alias("private"))
    # of an id with several texts it is not known whose they are
    several_texts = texts_of.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    private = by_ids(private, several_texts, "left_anti")
    rows = rows.join(private, "id", "left").withColumn("most", n - F.when(F.col("crowded"), F.coalesce("private", F.lit(0))).otherwise(0))
    rows = rows.where(F.col("most") * 100 >= n * percent).select("key", "id", "info", "part", "main", n.alias("n"), "most")
    rows = materialize(rows, "open")
    # a sketch folded upon itself is one of fewer bits; the whole ones are compared pair by pair
    folded = [reduce(Column.bitwiseXOR, [F.col(b) for b in bits[k::FOLDED_WORDS]]).alias(f"fold_{k}") for k in range(FOLDED_WORDS)]
    folds = [f"fold_{k}" for k in range(FOLDED_WORDS)]
    rows = materialize(rows.join(sketches.select("id", "n", *folded).distinct(), ["id", "n"]), "sketched")
    one = rows.where("part <> main")
    two = rows.select("key", *[F.col(c).alias(f"other_{c}") for c in ("id", "info", "part", "n", "most", *folds)])
    both, common = F.col("n") + F.col("other_n"), F.least("most", "other_most")
    roles = [(PROBE, INDEX), (PROBE_NEAR, INDEX_DELETED), (PROBE_DELETED, INDEX)]
    meets = F.lit(False)
    for probe, index in roles:
        for x, y in ((probe, index), (index, probe)):
            meets |= F.col("info").bitwiseAND(F.lit(x)).cast("boolean") & F.col("other_info").bitwiseAND(F.lit(y)).cast("boolean")
    pairs = one.join(two, "key").where(
        (F.col("part") != F.col("other_part"))
        & ((F.col("other_part") == F.col("main")) | (F.col("id") < F.col("other_id")))
        & (common * 100 >= (both - common) * percent)
        & meets
        & few_differ([F.col(f) for f in folds], [F.col(f"other_{f}") for f in folds], both)
    )
    pairs = pairs.select(F.least("id", "other_id").alias("a"), F.greatest("id", "other_id").alias("b")).distinct()
    found = found.unionByName(links(pairs.join(tried, ["a", "b"], "left_anti")))

    # an id with several texts joins their classes
    several = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    found = found.unionByName(members.join(several, "id").select("a", F.col("rep").alias("b")))
    named_by = components(found).withColumnRenamed("node", "rep")
    reached = members.join(named_by, "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id")).distinct()
    return sizes.join(reached, "id", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents (doc_id, text, ...) without those that link, directly or not, to one with a smaller id.

    Of rows that repeat an id the one whose other columns are the smallest text in JSON stays. Rows with a null id stay. Other columns may be
    of any name and type.
    """
    found = materialize(similar_sets(docs, size=size, percent=percent), "groups").where("doc_id IS NOT NULL")
    docs = by_ids(docs, found.where("doc_id <> component_id").select("doc_id"), "left_anti")
    several = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "several")
    rest = [c for c in docs.columns if c != "doc_id"]
    smallest = by_ids(docs, several, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("row"))
    return by_ids(docs, several, "left_anti").unionByName(smallest.select("doc_id", "row.*").select(docs.columns))
