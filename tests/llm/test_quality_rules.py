"""Counts against plain Python, verdicts against numpy."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules as Q

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    met = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if met[g] > 1 for j in range(3)}
    n, repeated = len(words), len(again)
    chars, symbols, dup = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    marks = sum(not WORDS.fullmatch(c) is None and unicodedata.category(c)[0] not in "LN" for c in text)
    share = lambda a, b: math.sqrt(a / max(b, 1))
    vector = [math.log(max(chars, 1) / max(n, 1)), share(symbols, chars), share(upper, chars), share(marks, chars), share(dup, len(lines)), share(repeated, n)]
    return (n, chars, symbols, dup, repeated, n < 50 or 100 * repeated > 50 * n), vector


def quantile(values, share):
    return sorted(values)[max(math.ceil(share * len(values)), 1) - 1]


def estimate(x, larger=1.0):
    n, k = len(x), Q.PRIOR
    mean = x.sum(0) / (n + k)
    centred = x - x.mean(0) if n else x
    return mean, (larger * centred.T @ centred + k * np.eye(Q.P)) / (n + k) + Q.NOISE * np.eye(Q.P)


def far(x, mean, cov):
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def verdicts(rows):
    """{position: (counts, kept)} for (lang, source, text)."""
    found = [counts(text or "") for _, _, text in rows]
    passed = [i for i, (c, _) in enumerate(found) if not c[-1]]
    languages, cells = defaultdict(list), defaultdict(list)
    for i in passed:
        languages[rows[i][0]].append(i)
        cells[rows[i][:2]].append(i)
    z = np.zeros((len(rows), Q.P))
    for own in languages.values():
        x = np.array([found[i][1] for i in own])
        middle = np.array([quantile(c, 0.5) for c in x.T])
        scale = np.array([max(floor, 1.4826 * quantile(c, 0.5)) for c, floor in zip(np.abs(x - middle).T, Q.FLOORS.values(), strict=True)])
        z[own] = (x - middle) / scale
    kept, limit = {}, Q.chi_square_quantile(1 - Q.REJECTED, Q.P)
    for own in cells.values():
        x = z[own]
        unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
        starts = [(np.zeros(Q.P), np.eye(Q.P)), (np.zeros(Q.P), estimate(np.tanh(x))[1]), (np.zeros(Q.P), estimate(unit)[1])]
        for _ in range(Q.STEPS):
            starts = [estimate(x[d <= quantile(d, Q.SHARE)]) for d in (far(x, *s) for s in starts)]
        mean, cov = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
        inner = Q.chi_square_quantile(Q.SHARE, Q.P)
        d = far(x, mean, cov) * Q.chi_square(inner, Q.P + 2) / Q.SHARE
        outer = Q.chi_square_quantile(0.975, Q.P)
        d = far(x, *estimate(x[d <= outer], 0.975 / Q.chi_square(outer, Q.P + 2)))
        kept |= dict(zip(own, d <= limit, strict=True))
    return {i: (*c, bool(kept.get(i, False))) for i, (c, _) in enumerate(found)}


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def results(df):
    return {r.doc_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_chi_square():
    assert Q.chi_square_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)
    assert Q.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))
    assert Q.chi_square(0.0, 6) == 0


def test_counts_of_odd_texts(spark):
    texts = [
        None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b c d a b c", "ab c d a bc d ab c d",
        "Ä ß   zz\x0bq\x0c\rr", "l\n\nl\n l\nl\r\n", "# * $ %\n&|<>\n# * $ %", "\U0001f600 \U0001f600 \U0001f600 \U0001f600", "\x00 \x1f \x85 w",
        "word " * 60, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), "line one\n" * 3 + "A.B!",
        " ".join(f"w{i}" for i in range(50)) + " p q r" * 17, " ".join(f"w{i}" for i in range(52)) + " p q r" * 17, "y" * 300_000, "k " * 100_000,
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = results(Q.judge(df.selectExpr("*", "1 AS cell", "'x' AS words", "2 AS distance", "'y' AS base_failed")))
    for i, text in enumerate(texts):
        assert got[i][:-1] == counts(text or "")[0], text


def plain_text(chance, words, odd=0.0):
    made = ["".join(chance.choice("aeiourstln") for _ in range(chance.randint(2, 9))) for _ in range(words)]
    made = [w.capitalize() if chance.random() < 0.1 else w for w in made]
    made = [w + chance.choice("$#!*") if chance.random() < odd else w + "." * (chance.random() < 0.1) for w in made]
    return "".join(w + ("\n" if chance.random() < 0.1 else " ") for w in made)


@pytest.mark.parametrize("most", [0, 1000])
def test_verdicts(spark, most):
    chance = random.Random(4)
    rows = []
    for i in range(700):
        lang = chance.choice(["en", "en", None, "xx"]) if i else "alone"
        source = "hot" if chance.random() < 0.4 else chance.choice([None, "a", "b"])
        rows.append((lang, source, plain_text(chance, chance.randint(40, 300), 0.9 if i % 25 == 0 else 0.02)))
    rows += [rows[30]] * 3 + [("en", "hot", None), ("en", "hot", "")]
    df = spark.createDataFrame([(i, text, lang, source, None) for i, (lang, source, text) in enumerate(rows)], SCHEMA).repartition(4)
    got, want = results(Q.judge(df, most=most)), verdicts(rows)
    assert got == want
    long = [i for i, r in enumerate(rows[:700]) if i and not want[i][5]]
    assert not any(got[i][-1] for i in long if i % 25 == 0) and sum(got[i][-1] for i in long if i % 25) > 0.99 * sum(i % 25 != 0 for i in long)


def test_odd_tables(spark):
    assert results(Q.judge(spark.createDataFrame([], SCHEMA))) == {}
    text = " ".join(f"w{i}" for i in range(60))
    assert results(Q.judge(spark.createDataFrame([(None, text, "en", "s", 1)], SCHEMA)))[None][-1] is True


def test_whole_table_and_labels(spark):
    """Counts of every text; the labelled bad ones go, the good ones stay."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    judged = Q.judge(docs)
    got = results(judged)
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        assert got[r.doc_id][:-1] == counts(r.text or "")[0]
    kept = judged.where("NOT base_failed").select("doc_id", "kept").join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1, share


def test_no_python_in_the_plan(spark):
    vectors = Q.statistics(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    plan = vectors._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
