"""Hard negatives against brute force; the curve and the bounds by what they promise."""

import math
import random

import numpy as np
import pytest

from compare import connect, differences
from ledgerlens.llm import hard_negatives as H
from ledgerlens.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows):
    kept = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
            kept.append((vec_id, moved, [math.floor(256 * float(np.float32(x))) for x in vector]))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (anchor, label, vector) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scores = [(sum(x * y for x, y in zip(vector, v, strict=False)), i, n) for k, (i, n, v) in enumerate(kept) if k != a]
        for score, positive, _ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            fit = sorted((s for s in scores if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:10]
            out += [(anchor, positive, rank, s[1], score, s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(r[n] for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=repr)


def test_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    places = H.hilbert(cells, 3)
    assert sorted(places) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(places)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_bounds_hold():
    chance = np.random.default_rng(1)
    numbers = H.Numbers(6, 100)
    anchors, points = chance.integers(-100, 100, (20, 6)).astype(float), chance.integers(-100, 100, (30, 6)).astype(float)
    least, most = numbers.bounds(anchors, points.min(0)[None], points.max(0)[None])
    scores = anchors @ points.T
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= most[:, 0]).all()


def test_against_sql(spark):
    assert not differences(QUERIES["op12_hard_negatives"](spark, SF_DIR), connect(SF_DIR), ORACLES["op12_hard_negatives"])


def table(count, size, spread):
    chance = random.Random(count)
    centres = [[chance.gauss(0, 1) for _ in range(size)] for _ in range(8)]
    rows = []
    for i in range(count):
        centre = centres[0 if i % 3 == 0 else chance.randrange(8)]
        rows.append((i, [float(np.float32(c + chance.gauss(0, spread))) for c in centre], chance.randrange(4)))
    return rows


@pytest.mark.parametrize("spread", [0.0, 0.1])
def test_clusters(spark, spread):
    """Close clusters, so that many blocks are left out; without spread, a third of all vectors are alike."""
    rows = table(1500, 5, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert results(H.mine(df, block_rows=16, group_anchors=4)) == brute_force(rows)


def test_blocks_are_left_out(spark):
    # one label a cluster, on a few rows: what lies elsewhere is not looked at for positives
    rows = spark.createDataFrame([(i, v, int(10 * abs(v[0])) % 50) for i, v, _ in table(3000, 5, 0.01)], SCHEMA)
    vectors = H.quantised(rows)
    numbers = H.Numbers(5, 2000)
    blocks = H.materialize(H.blocks_of(vectors, numbers, [(k, -1500, 1500) for k in range(5)], 32), "blocks")
    groups = H.anchor_groups(blocks, numbers, 4).selectExpr("*", "cast(null as array<struct<anchor: int, slot: int, score: bigint>>) AS windows")
    groups = H.materialize(groups, "groups")
    read = sum(len(r.wanted) for r in H.chosen(blocks, groups, numbers, 2).collect())
    assert 0 < read < 0.5 * blocks.count() * groups.count()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [0.9, 0.5], 2), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (None, [1.0, 0.5], 1), (None, [0.5, 0.25], 2),
        (2, [0.4, 0.3], 2), (3, [0.4, 0.3], 2), (3, [0.4, 0.3], 3), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, 1.0], None),
        (10, [], 2), (11, [0.5], 2), (200, [-1.0, -1.0], 7), (12, [0.5, 0.5], 7), (300, [0.0, 0.0], 2), (700, [0.3, 0.3], 9), (-100, [0.2, 0.2, 5.0], 0),
        (13, [0.1, 0.1, 0.1], -3), (14, [0.6, 0.1, 0.1], -4),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS place", "1 AS vector", "2 AS block", "'p' AS page")
    assert results(H.mine(df, block_rows=4, group_anchors=2)) == brute_force(rows)


def test_large_components(spark):
    rows = [(i, [float((i % 7 - 3) * 2**40), 2.0**40], i % 3) for i in range(0, 400, 20)]
    with pytest.raises(Exception, match="64 bits"):
        H.mine(spark.createDataFrame(rows, SCHEMA))
    rows = [(i, [float((i % 7 - 3) * 2**20 + i), 2.0**20], i % 3) for i in range(0, 400, 20)]
    assert results(H.mine(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_no_rows(spark):
    assert results(H.mine(spark.createDataFrame([], SCHEMA))) == []
    assert results(H.mine(spark.createDataFrame([(1, [0.5], 1)], SCHEMA))) == []
