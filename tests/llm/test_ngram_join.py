"""The pigeonhole join against all pairs."""

import random
import re

import pytest

from ledgerlens.llm import ngram_join
from ledgerlens.llm.ngram_join import similar_sets


def brute_force(texts, size=4, percent=85):
    """texts: {doc_id: text}."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets[i] = grams
    reach = {i: i for i in texts}

    def find(i):
        while reach[i] != i:
            i = reach[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                reach[two] = one
    return {i: (len(sets[i]), find(i)) for i in texts}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("percent,size", [(85, 4), (85, 1), (70, 2), (100, 3)])
def test_links_and_components(documents, percent, size):
    chance = random.Random(percent + size)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for length in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 22, 26, 33, 40, 50, 75, 120, 200, 400]:
        base = [chance.choice(words) for _ in range(length)]
        for _ in range(6):
            copy = list(base)
            for _ in range(chance.randint(0, max(1, length // 15))):
                at = chance.randrange(len(copy))
                copy[at : at + chance.randint(0, 1)] = [chance.choice(words).upper()] * chance.randint(0, 1)
                copy = copy or ["x"]
            texts.append(" ".join(copy))
    chance.shuffle(texts)
    assert result(similar_sets(documents(texts), size=size, percent=percent)) == brute_force(dict(enumerate(texts)), size, percent)


def test_boundary_of_the_threshold(documents):
    """185 * intersection against 85 * both sizes, one shingle on either side."""
    texts = []
    for n in (6, 7, 13, 20, 37, 74, 111):
        base = [f"a{n}x{i}" for i in range(n)]
        for change in range(1, n // 4 + 2):
            texts += [" ".join(base), " ".join([*base[:-change], *[f"b{n}x{change}x{i}" for i in range(change)]])]
            texts.append(" ".join(base[:-change]))
    assert result(similar_sets(documents(texts), size=1)) == brute_force(dict(enumerate(texts)), 1)


def test_a_chain_is_one_component_and_a_large_group_of_copies_too(documents):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*(f"v{k}" for k in range(4 * j)), *base[4 * j :]]) for j in range(12)]
    texts += [" ".join(base)] * 300 + [" ".join([*base, f"end{i}"]) for i in range(300)]
    got = result(similar_sets(documents(texts), size=1))
    assert got == brute_force(dict(enumerate(texts)), 1)
    assert {c for _, c in got.values()} == {0}


def test_odd_rows(documents):
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, None, None), (2, "", None), (3, " \t\n", None), (4, "One two", None), (4, "One two", None), (5, "one\ntwo", "en")]
    rows += [(6, long, None), (7, long + " end", None), (None, "one two", None), (8, "a b c d e", None), (8, "one two", None)]
    got = sorted(map(str, similar_sets(documents(rows, extra=True)).select("doc_id", "n_shingles", "component_id").collect()))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (None, 1, None), (8, 2, 4), (8, 1, 4)]
    row = "Row(doc_id={}, n_shingles={}, component_id={})".format
    assert [g for g in got if "doc_id=6" not in g and "doc_id=7" not in g] == sorted(row(*w) for w in want)
    assert {g.rpartition("=")[2] for g in got if "doc_id=6" in g or "doc_id=7" in g} == {"6)"}


def test_no_rows(documents):
    assert similar_sets(documents([])).count() == 0


def test_two_long_texts_under_one_id(documents):
    """Pairs that stand in the buckets of a hub unlike them; a second text, all its own, stands under each id."""
    chance = random.Random(3)
    base, rows, texts = [f"b{k}" for k in range(60)], [], {}
    for g in range(40):
        own = chance.sample(range(60), 5)
        for j, places in enumerate((own[1:3], own[3:])):
            text = list(base)
            text[own[0]] = f"g{g}"
            for k in places:
                text[k] = f"e{g}x{j}x{k}"
            texts[2 * g + j] = " ".join(text)
            rows.append((2 * g + j, texts[2 * g + j], None))
            rows.append((2 * g + j, " ".join(f"own{g}x{j}x{k}" for k in range(61)), None))
    got = {}
    for r in similar_sets(documents(rows), size=1).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {i: {c} for i, (_, c) in brute_force(texts, size=1).items()}


def _written(monkeypatch):
    """Rows of what similar_sets writes, by name."""
    kept, write = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: kept.setdefault(name, []).append(out := write(df, name)) or out)
    return kept


def _lines_in_common(chance, count=60):
    """Texts with a common line and a near copy of each of some; the line is too little to link them."""
    line = [f"line{k}" for k in range(8)]
    texts = []
    for i in range(count):
        own = [f"t{i}x{k}" for k in range(chance.randint(12, 40))]
        texts.append(" ".join([*line, *own]))
        if i % 5 == 0:
            texts.append(" ".join([*line, *own, f"end{i}"]))
    return texts


def test_texts_are_shuffled_only_for_pairs_that_sketches_leave(documents, monkeypatch):
    kept = _written(monkeypatch)
    texts = _lines_in_common(random.Random(11))
    got = result(similar_sets(documents(texts), size=1, percent=80))
    assert got == brute_force(dict(enumerate(texts)), 1, 80)
    linked = len(texts) - len({c for _, c in got.values()})
    alike = sum(df.count() for df in kept["alike"])
    assert linked <= alike <= 2 * linked < kept["pairs"][0].count()


@pytest.mark.parametrize("crowd", [0, 1, 1024])
def test_links_do_not_depend_on_what_counts_as_crowded(documents, monkeypatch, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    texts = _lines_in_common(random.Random(12), 30)
    assert result(similar_sets(documents(texts), size=1, percent=80)) == brute_force(dict(enumerate(texts)), 1, 80)
