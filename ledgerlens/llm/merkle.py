"""A manifest of a dataset as a tree of digests, and a proof for every row.

Every row is a leaf. The leaves of one language make a tree, the roots of all languages (subroots) one more. A digest is
the SHA-256 of the inputs one after the other; digests go in as lowercase hex text, and are kept as 32 bytes.

One level costs ``arity - 1`` equijoins of its nodes with themselves, on computed sibling numbers; the rows at slot zero
then emit the parents. Levels shrink by the arity. Proofs come down from the root: every level is joined with the paths of
its parents, so a path is sent once a node and never gathered from all levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.durable import materialize
from ledgerlens.operators.ordered import number_rows

#: Every so many-th document, by the CRC of its id, is tampered with.
TAMPERED = 7
PATH = "array<struct<left: binary, right: binary>>"


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest_of(*texts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*texts), 256))


def field(value: Column) -> Column:
    """``-`` for null, else the count of bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest and tampered (the digest after tampering) of every row.

    ``tree`` orders as the language does, null first. A null id or count is not tampered with.
    """
    count = F.col("n_chars").cast("decimal(38,0)")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    row = lambda n: digest_of(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    # not hit: null, so that most texts are hashed once
    found = docs.select("doc_id", tree.alias("tree"), row(count).alias("digest"), F.when(hit, row(count + 1)).alias("tampered"))
    return found.withColumn("tampered", F.coalesce("tampered", "digest"))


def numbered(rows: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """Adds ``idx``: 0, 1, ... in every group by ``keys``. Rows alike in all keys may be of any number: another key parts them."""
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    return number_rows(rows, groups, [*keys, "_tie"], "idx", 0).drop("_tie")


def _together(pairs: Column) -> Column:
    """The digests of an array of (slot, digest), by slot."""
    return F.aggregate(F.array_sort(pairs), F.lit(b""), lambda so_far, p: F.concat(so_far, p["digest"]))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds left and right (digests of the run's others before and after, together) and ``done``: the last node of its tree."""
    slot, joined = F.col("idx") % arity, nodes
    names = [f"_other{shift}" for shift in range(1, arity)]
    for shift, name in enumerate(names, 1):
        there = F.col("idx").bitwiseXOR(F.lit(1).cast("bigint")) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        other = nodes.select("tree", F.col("idx").alias("_at"), F.struct((F.col("idx") % arity).alias("slot"), "digest").alias(name))
        joined = joined.withColumn("_at", there).join(other, ["tree", "_at"], "left").drop("_at")
    others = F.filter(F.array(*names), lambda p: p.isNotNull())
    part = lambda wanted: _together(F.filter(others, wanted))
    joined = joined.withColumns({"left": part(lambda p: p["slot"] < slot), "right": part(lambda p: p["slot"] > slot)}).drop(*names)
    alone = (F.col("idx") == 0) & (F.octet_length("left") + F.octet_length("right") == 0)
    return joined.withColumn("done", alone)


def grow(nodes: DataFrame, arity: int = 2) -> list[DataFrame]:
    """The levels of all trees of ``nodes`` (tree, idx, digest, more): leaves first, one node a tree at last.

    Every level has tree, idx, digest, left, right, done; the first keeps the other columns. A tree that has come to one
    node hands it on unchanged until the tallest tree is done.
    """
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    last = nodes.agg(F.max("idx")).first()[0] or 0
    levels = []
    while True:
        levels.append(level := materialize(with_siblings(nodes, arity), f"level-{len(levels)}"))
        if last == 0:
            return levels
        parent = F.when(F.col("done"), F.col("digest")).otherwise(digest_of(hex_of(F.col("digest")), hex_of(F.col("right"))))
        first = level.where(F.col("idx") % arity == 0)
        nodes = first.select("tree", F.floor(F.col("idx") / arity).cast("bigint").alias("idx"), parent.alias("digest"))
        last //= arity


def paths(levels: list[DataFrame], tops: DataFrame, arity: int = 2) -> DataFrame:
    """The leaves with ``path``: their siblings level by level, then the path of ``tops`` (tree, path, more columns) for their tree."""
    above = levels[-1].join(tops, "tree")
    carried = [c for c in tops.columns if c != "tree"]
    for level in reversed(levels[:-1]):
        above = above.select("tree", F.col("idx").alias("_parent"), *carried)
        rows = level.withColumn("_parent", F.floor(F.col("idx") / arity).cast("bigint"))
        own = F.when(F.col("done"), F.lit(None)).otherwise(F.array(F.struct("left", "right")))
        rows = rows.withColumn("_own", F.coalesce(own, F.array().cast(PATH)))
        above = rows.join(above, ["tree", "_parent"]).withColumn("path", F.concat("_own", "path")).drop("_own", "_parent")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to, in hex."""
    step = lambda so_far, p: F.sha2(F.concat(hex_of(p["left"]), so_far, hex_of(p["right"])), 256)
    return F.aggregate(path, hex_of(start), step)


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, left to right, in hex."""
    both = F.transform(path, lambda p: F.concat(hex_of(p["left"]), hex_of(p["right"])))
    return F.sha2(F.array_join(both, ""), 256)


def manifest(docs: DataFrame, arity: int = 2) -> DataFrame:
    """Per row of documents: leaf, subroot, root, proof_sha256, and whether the leaf after tampering still leads to the root.

    Null languages make a tree of their own. Leaves of a tree are ordered by doc_id (null first), rows that repeat an id by their digest.
    Null and empty texts differ. Other columns are left alone. Without rows there is no root and no row.
    """
    rows = materialize(leaves(docs), "leaves")
    levels = grow(numbered(rows, ["tree"], ["doc_id", "digest"]), arity)
    subroots = levels[-1].select(F.lit("").alias("all"), "tree", F.col("digest").alias("subroot"))
    subroots = numbered(subroots, ["all"], ["tree"])
    upper = grow(subroots.select(F.col("all").alias("tree"), "idx", F.col("subroot").alias("digest"), F.col("tree").alias("name"), "subroot"), arity)
    root = upper[-1].select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = paths(upper, root, arity).select(F.col("name").alias("tree"), "path", "subroot", "root")
    found = paths(levels, materialize(tops, "subroots"), arity)
    found = found.select(
        "doc_id",
        hex_of(F.col("digest")).alias("leaf"),
        hex_of(F.col("subroot")).alias("subroot"),
        hex_of(F.col("root")).alias("root"),
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
