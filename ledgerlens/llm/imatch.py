"""I-Match fingerprints of documents, with DataFrame functions only.

A document's terms are the distinct lower-cased runs of letters and digits. Those whose document frequency lies in a
band (neither so common that all documents share them, nor so rare that they are noise) make up the lexicon.
Every family of randomised subsets deals the lexicon out by 16 bits of a term's hash. A fingerprint is a hash of the
document's sorted lexicon terms, and for every family a hash of those in its first subset that holds any: such a
hash survives edits elsewhere in the text, so the share of equal hashes tells how alike two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.durable import materialize, pin

#: Document frequencies of the lexicon's terms, as a share of all documents.
LEAST_SHARE, MOST_SHARE = 0.01, 0.1
#: Families of subsets: four from each of so many hashes.
HASHES = 3
FAMILIES = 4 * HASHES
_BUCKETS = 8192


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[int]:
    """Hashes of the terms of ``texts`` (text) in the band, counted over all rows.

    No more than (mean distinct terms of a text) / ``least`` terms can be so frequent, however many texts there are: with 1,000 terms
    in a mean text and a least share of 0.01, that is 100,000 numbers of eight bytes. So all of them are taken.
    """
    rows = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = counts.where(F.col("n").between(least * rows, most * rows)).select("term")
    return sorted(r.term for r in band.collect())


def _within(found: Column, chosen: list[int]) -> Column:
    """The terms that the lexicon holds: it is a constant table of buckets."""
    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for term in chosen:
        buckets[term % _BUCKETS].append(str(term))
    # Spark folds this into a constant when it plans
    table = F.from_json(F.lit("[" + ",".join(f"[{','.join(b)}]" for b in buckets) + "]"), "array<array<bigint>>")
    at = lambda x: (F.pmod(x, F.lit(_BUCKETS)) + 1).cast("int")
    return F.filter(found, lambda x: F.array_contains(F.element_at(table, at(x)), x))


def _subset(hashed: Column, family: int) -> Column:
    """The number of the subset that a term belongs to."""
    return F.shiftrightunsigned(hashed, 16 * (family % 4)).bitwiseAND(F.lit(65535))


def _hashed(kept: Column, seed: int) -> Column:
    return F.transform(kept, lambda x: F.xxhash64(x, F.lit(seed)))


def _first(hashed: Column, family: int) -> Column:
    return F.array_min(F.transform(hashed, lambda x: _subset(x, family)))


def _held(hashed: Column, family: int, first: Column) -> Column:
    return F.filter(hashed, lambda x: _subset(x, family) == first)


def fingerprinted(df: DataFrame, text: str, name: str, chosen: list[int]) -> DataFrame:
    """Adds the column ``name``: an array of hashes, the first of all kept terms, then one for each family.

    A text without a term of the lexicon is taken with all its terms; without any term, all hashes are that of nothing.
    """
    df = df.withColumn("_terms", terms(F.col(text))).withColumn("_kept", _within(F.col("_terms"), chosen))
    kept = F.sort_array(F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_terms")))
    hashes = {f"_hash{i}": _hashed(F.col("_kept"), i) for i in range(1, HASHES)}
    df = df.withColumn("_kept", kept).withColumn("_hash0", F.col("_kept")).withColumns(hashes)
    first = [_first(F.col(f"_hash{f // 4}"), f) for f in range(FAMILIES)]
    df = df.withColumn("_first", F.array(*first))
    held = [_held(F.col(f"_hash{f // 4}"), f, F.get("_first", F.lit(f))) for f in range(FAMILIES)]
    parts = [F.xxhash64("_kept"), *[F.xxhash64(F.sort_array(h)) for h in held]]
    return df.withColumn(name, F.array(*parts)).drop("_terms", "_kept", "_first", *[f"_hash{i}" for i in range(HASHES)])


def likeness(one: Column, two: Column) -> Column:
    """The share of equal hashes of two fingerprints."""
    same = F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda e: e))
    return same / F.lit(float(FAMILIES + 1))


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id, and for the smallest the largest. Null ids are left out."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = pin(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()))
    # one row for each part, so the window over all of them sees few
    parts = ids.groupBy("part").agg(F.max("doc_id").alias("first"))
    order = Window.orderBy(F.desc("first"))
    all_parts = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(all_parts)).alias("follows"))
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    found = ids.withColumn("next_id", inside).join(F.broadcast(parts), "part")
    return found.select("doc_id", F.coalesce("next_id", "follows").alias("next_id"))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per row of documents.

    In the edited text the last third of the code points (rounded down) gives way to as many, or all, of the first ones of the next
    document by descending id. Null counts as empty. Where an id repeats, the next document's text and fingerprint are the smallest under that id;
    a row with a null id has no next document, and nothing takes the place of its last third.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = lexicon(texts, least, most)
    following = materialize(next_ids(texts), "next")
    third = F.floor(F.length("text") / 3).cast("int")
    # both joins take the texts dealt out by id as they are, so that Spark deals them out once
    named = texts.where("doc_id IS NOT NULL")
    need = named.groupBy("doc_id").agg(F.max(third).alias("k"))
    need = need.join(following, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "k")
    begin = need.join(named, "doc_id").select("for_id", F.col("text").substr(F.lit(1), F.col("k")).alias("begin"))
    begin = begin.groupBy(F.col("for_id").alias("doc_id")).agg(F.min("begin").alias("begin"))
    nameless = texts.where("doc_id IS NULL").withColumn("begin", F.lit(None).cast("string"))
    rows = named.join(begin, "doc_id", "left").unionByName(nameless).withColumn("k", third)
    kept = F.col("text").substr(F.lit(1), F.length("text") - F.col("k"))
    edited = F.concat(kept, F.coalesce(F.col("begin").substr(F.lit(1), F.col("k")), F.lit("")))
    rows = rows.select("doc_id", "text", edited.alias("edited"))
    rows = fingerprinted(fingerprinted(rows, "text", "own", chosen), "edited", "other", chosen)
    rows = rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        "own",
    )
    rows = materialize(rows, "fingerprints")
    one = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id"))
    theirs = one.agg(F.min(F.struct("fingerprint", "own"))["own"].alias("theirs"))
    next_own = following.join(theirs, "next_id").select("doc_id", "theirs")
    near_next = F.coalesce(likeness(F.col("own"), F.col("theirs")), F.lit(0.0)).alias("near_next")
    return rows.join(next_own, "doc_id", "left").select(*[c for c in rows.columns if c != "own"], near_next)
