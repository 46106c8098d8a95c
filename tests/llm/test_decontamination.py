"""Seeds and alignment against plain dynamic programming over every item and document."""

import random
import re

import numpy as np

from ledgerlens.llm import decontamination as D

ITEMS = "item_id bigint, text string"


def plain_score(one, two):
    """Smith-Waterman, cell by cell."""
    rows = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, a in enumerate(one, 1):
        for j, b in enumerate(two, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (D.MATCH if a == b else D.MISMATCH), rows[i - 1][j] + D.GAP, rows[i][j - 1] + D.GAP)
    return max(max(r) for r in rows)


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edited(chance, passage, share, vocabulary):
    out = []
    for w in passage:
        what = chance.random()
        out += [] if what < share / 3 else [chance.choice(vocabulary)] if what < 2 * share / 3 else [w, chance.choice(vocabulary)] if what < share else [w]
    return out


def test_alignment_is_smith_waterman():
    chance = np.random.default_rng(3)
    one, two = chance.integers(2, 6, (50, 9)).astype(np.uint64), chance.integers(2, 6, (50, 14)).astype(np.uint64)
    score, i, j = D.align(one, two)
    for k in range(50):
        assert score[k] == plain_score(one[k].tolist(), two[k].tolist())
        assert plain_score(one[k][: i[k] + 1].tolist(), two[k][: j[k] + 1].tolist()) == score[k]


def test_copies_and_edited_copies(spark, documents):
    chance = random.Random(8)
    vocabulary = [f"v{i}" for i in range(150)] + ["Straße", "él", "l'eau"]
    items = [(i, " ".join(chance.choice(vocabulary) for _ in range(chance.randint(18, 60)))) for i in range(12)]
    items.append((12, " ".join(chance.choice(vocabulary) for _ in range(400))))
    texts = []
    for k in range(120):
        text = [chance.choice(vocabulary) for _ in range(chance.randint(0, 300))]
        for _ in range(chance.choice([0, 0, 1, 2])):
            at = chance.randint(0, len(text))
            copy = edited(chance, chance.choice(items[:12])[1].split(), chance.choice([0, 0, 0.1, 0.2]), vocabulary)
            text[at:at] = copy
        texts.append(", ".join(text).upper() if k % 3 == 0 else " ".join(text))
    texts.append("before " + items[12][1] + " after")
    df = documents(texts)
    got = {(r.doc_id, r.item_id): r for r in D.find_leaks(df, spark.createDataFrame(items, ITEMS)).collect()}
    for d, text in enumerate(texts):
        for item, passage in items[:12]:
            want = plain_score(words(passage), words(text)) / (D.MATCH * len(words(passage)))
            if want >= 0.7:  # edits of a tenth or a fifth leave a seed
                assert abs(got[d, item].score - want) < 1e-9
            elif want < D.THRESHOLD:
                assert (d, item) not in got
    assert got[len(texts) - 1, 12].score == 1
    for (d, item), r in got.items():
        if r.score == 1 and item < 12:
            assert words(texts[d][r.first_char : r.end_char]) == words(items[item][1])


def test_frequent_passages_and_blocks(spark, documents):
    """A passage in most documents keeps its seeds, and blocks of items change nothing."""
    items = [(i, " ".join(f"q{i}w{j}" for j in range(20))) for i in range(30)]
    texts = [f"start {items[0][1]} end"] * 200 + [f"x y {p}" for _, p in items] + ["x y z " * 50]
    table = spark.createDataFrame(items, ITEMS)
    one = D.find_leaks(documents(texts), table).collect()
    some = D.find_leaks(documents(texts), table, block_bytes=700).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, some))
    assert len(one) == 230 and {r.score for r in one} == {1.0}
    assert [r.doc_id for r in D.without_leaks(documents(texts), table).collect()] == [230]


def test_odd_rows(spark, documents):
    passage = "alpha beta gamma delta epsilon zeta"
    rows = [(1, None, None), (2, "", None), (3, passage, None), (3, passage, None), (None, "a b " + passage, None)]
    rows += [(4, "filler words " * 40_000 + passage + " filler" * 40_000, None), (5, "alpha beta gamma", None)]
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "alpha beta"), (None, passage)], ITEMS)
    items = items.selectExpr("*", "'x' AS doc_id", "1 AS score")
    got = sorted((str(r.doc_id), str(r.item_id), r.score) for r in D.find_leaks(documents(rows, extra=True), items).collect())
    assert got == sorted((d, i, 1.0) for d in ("3", "3", "4", "None") for i in ("1", "None"))
    kept = D.without_leaks(documents(rows, extra=True), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5] and kept.columns == documents(rows, extra=True).columns


def test_no_rows(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert D.find_leaks(documents([]), none).count() == 0
    assert D.find_leaks(documents(["a b c d e f"]), none).count() == 0
    assert D.find_leaks(documents([]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0
    assert D.without_leaks(documents(["a b c d e f"]), none).count() == 1


def test_copies_with_unchanged_runs_of_three_words(spark, documents):
    """Every fourth word is replaced; n-grams that no document holds take no seed's place."""
    items = [(i, " ".join(f"q{i}w{j}" for j in range(15 + i))) for i in range(30)]
    texts = []
    for i, passage in items:
        copy = [f"edit{i}x{j}" if j % 4 == i % 4 else w for j, w in enumerate(passage.split())]
        texts.append(" ".join([*(f"own{i}x{j}" for j in range(40)), *copy, *(f"end{i}x{j}" for j in range(40))]))
    got = {(r.doc_id, r.item_id): r.score for r in D.find_leaks(documents(texts), spark.createDataFrame(items, ITEMS)).collect()}
    want = {i: plain_score(words(passage), words(texts[i])) / (D.MATCH * len(words(passage))) for i, passage in items}
    assert min(want.values()) >= D.THRESHOLD
    assert got.keys() == {(i, i) for i in want} and all(abs(got[i, i] - s) < 1e-9 for i, s in want.items())


def test_recall_of_substituted_copies(spark, documents):
    """Each item is copied once; every copy from the threshold on that still shares three words in a row is found."""
    chance = random.Random(21)
    items = [(i, " ".join(f"q{i}w{j}" for j in range(15))) for i in range(400)]
    texts = []
    for i, passage in items:
        texts.append(" ".join(f"edit{i}x{j}" if chance.random() < 0.25 else w for j, w in enumerate(passage.split())))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(texts), spark.createDataFrame(items, ITEMS)).collect()}
    want = set()
    for i, passage in items:
        one, two = words(passage), words(texts[i])
        run = any(one[k : k + 3] == two[k : k + 3] for k in range(len(one) - 2))
        if run and plain_score(one, two) >= D.THRESHOLD * D.MATCH * len(one):
            want.add((i, i))
    assert len(want) > 300 and got == want
