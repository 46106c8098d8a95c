"""Trees and proofs against plain Python."""

import hashlib
import zlib

import pytest

from ledgerlens.llm import merkle
from ledgerlens.llm.queries import ORACLES, QUERIES

from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, arity):
    """The root, and for every node its siblings as (left, right) level by level."""
    where, levels = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = at - at % arity
            levels[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
            where[i] = at // arity
        nodes = [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], levels


def plain(rows, arity=2):
    """Result rows for (doc_id, text, lang, source, n_chars)."""
    by_lang = {}
    for doc_id, text, lang, source, n in rows:
        by_lang.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), leaf(doc_id, source, lang, n, text), doc_id, text, source, n))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: r[:2])
    lower = {lang: tree([r[1] for r in by_lang[lang]], arity) for lang in langs}
    root, upper = tree([lower[lang][0] for lang in langs], arity) if langs else (None, [])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for (_, own, doc_id, text, source, n), path in zip(by_lang[lang], lower[lang][1], strict=True):
            path = path + above
            changed = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            end = leaf(doc_id, source, lang, n + 1, text) if changed else own
            for left, right in path:
                end = h(left, end, right)
            out.append((doc_id, own, lower[lang][0], root, h(*[x for p in path for x in p]), end, end == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def results(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


ODD = [
    (3, "a", "en", "s", 1), (1, "", "en", "s", 0), (2, None, "en", None, None), (None, "x", "en", "s", 1), (7, "ü" * 5000, "en", "s", 5000),
    (7, "twice", "en", "s", 5), (7, "twice", "en", "s", 5), (8, "alone", "zz", "s", 5), (9, "q", None, "s", 2**63 - 1), (-4, "q", None, "s", 1),
    (18, "tampered", "", "s", 8), (0, "b", "de", "t", 1), (5, "\x00", "Z", "t", 1), (6, "ä", "é", "t", 1), (10, "c", "é", "t", 1), (11, "d", "é", "t", 1),
]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_odd_rows(spark, arity):
    more = [(i, f"t{i}", "en", None, i) for i in range(100, 100 + 4 * arity)]
    df = spark.createDataFrame(ODD + more, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS idx", "'y' AS digest", "0 AS path", "2 AS root", "'p' AS _parent")
    assert results(merkle.manifest(df.repartition(3), arity)) == plain(ODD + more, arity)


@pytest.mark.parametrize("rows", [[], [(14, "one", None, None, 3)], [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)]])
def test_few_rows(spark, rows):
    assert results(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = results(merkle.manifest(docs))
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_against_sql(spark):
    assert not differences(QUERIES["op13_merkle_manifest"](spark, SF_DIR), connect(SF_DIR), ORACLES["op13_merkle_manifest"])


def test_arity(spark):
    with pytest.raises(ValueError, match="arity"):
        merkle.grow(spark.createDataFrame([("", 0, b"")], "tree string, idx bigint, digest binary"), 1)
