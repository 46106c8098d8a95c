"""The pipeline against plain Python, stage by stage."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ledgerlens.llm import bpe
from llm_plain import leaks, links, secrets
from test_ngram_join import brute_force

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_redaction(text):
    out, done = [], 0
    for kind, start, end in secrets(text or ""):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def kept(spark, stage, rows, extra=()):
    docs = spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"{c} string" for c in extra)]))
    result = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF_DIR)
    return result, docs


@pytest.fixture(scope="module")
def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select(COLUMNS).collect()]


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "byte_bpe"]


def test_run_equals_plain_python(spark, table):
    rows = {r[0]: r for r in table}
    known = {r.doc_id for r in kept(spark, "language_id", table)[0].collect()}
    # the network judges languages; every text with letters that reads like one stays
    assert len(known) > 0.99 * len(rows) and not known - rows.keys()
    group = links({i: rows[i][1] for i in known})
    firsts = {i for i in known if group[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {i for i in firsts if not leaks(rows[i][1], items)}
    assert clean < firsts < known
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.TOKENIZER)), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got.keys() == clean
    for i, r in got.items():
        text = plain_redaction(rows[i][1])
        assert r.ids == encoding.encode_ordinary(text) and r.n_tokens == len(r.ids) and r.n_chars == len(text) and r.exact
        assert (r.lang, r.source) == rows[i][2:4]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    text = "the cat and the dog are there with password=b7db7aa4a5fcc78305"
    rows = [(1, text, "en", None, 5), (1, text, "en", None, 5), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "12 34", "de", "s", 5)]
    rows += [(None, "und die Katze " * 30_000, "de", None, None), (None, None, None, None, None), (5, text + " x", None, None, 7)]
    result, docs = kept(spark, stage, rows, extra=("id", "key", "score", "label", "words", "found"))
    if stage != "byte_bpe":
        assert result.columns == docs.columns
    found = result.collect()
    count = {"language_id": 4, "ngram_jaccard_join": 6, "benchmark_decontamination": 8, "secret_scan": 8, "byte_bpe": 8}[stage]
    assert len(found) == count
    if stage == "secret_scan":
        assert sum("[assign]" in (r.text or "") for r in found) == 3 and {r.n_chars for r in found if r.doc_id == 1} == {len(text) - 27 + 8}
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.where("false"), SF_DIR).count() == 0


def test_near_copies_of_five_words_and_80_percent(spark):
    """Scattered edits and edited blocks between the stage's threshold and that of the op8 query."""
    rows, texts = [], {}
    for g, changed in enumerate([1, 2, 3, 4, 5, 6, 8, 12, 14, 16, 18, 20, 22, 24]):
        base = [f"b{g}x{k}" for k in range(200)]
        block, spread = list(base), list(base)
        for k in range(changed):
            block[80 + k], spread[(k * 200) // changed + 3] = f"c{g}x{k}", f"d{g}x{k}"
        for k, text in enumerate((base, block, spread)):
            texts[10 * g + k] = " ".join(text)
            rows.append((10 * g + k, texts[10 * g + k], "en", "s", len(texts[10 * g + k])))
    result, _ = kept(spark, "ngram_jaccard_join", rows)
    firsts = {i for i, (_, component) in brute_force(texts, size=5, percent=80).items() if component == i}
    assert {r.doc_id for r in result.collect()} == firsts
    assert firsts != {i for i, (_, component) in brute_force(texts).items() if component == i}
