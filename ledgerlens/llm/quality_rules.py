"""Quality rules on counts of a text, and outliers among documents of one language and source.

Counts come from the whole text, by DataFrame functions only. Their transformed shares make a vector a document. For every
language and source a minimum covariance determinant estimate (mean and covariance of the ``SHARE`` of documents that lie
closest together) is found by concentration steps from three fixed starts; a document whose Mahalanobis distance is
too large is rejected. Every step is one pass over the narrow table of vectors: sums and quantile sketches that are merged on the way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.durable import materialize
from ledgerlens.llm.merkle import field

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WHITE_CHARACTERS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Beyond so many percent of repeated words a text fails.
MOST_REPEATED = 50

#: The vector of a document, and the least scale of each component: below it, differences count as chance.
FLOORS = {"word_length": 0.1, "symbols": 0.05, "upper": 0.05, "marks": 0.05, "dup_lines": 0.2, "repeats": 0.2}
NAMES = list(FLOORS)
P = len(NAMES)
#: Share of a cell's documents that the determinant is minimised over.
SHARE = 0.75
STEPS = 3
#: So many documents with the language's median and scales are added to every cell, so that small ones have an estimate too.
PRIOR = 20.0
#: Variance by chance, in scales of the language, that is added to every component whatever the number of documents.
NOISE = 0.5
#: Chance of rejecting a document of a normal cell.
REJECTED = 1e-4
#: Estimates are broadcast up to so many (about 400 bytes each), else joined by cell and one of SALTS parts.
BROADCAST_CELLS, SALTS = 20_000, 32
#: Of the quantile sketches.
ACCURACY = 2_000


def chi_square(x: float, freedom: int) -> float:
    """The chance of a chi-square variable up to x (series of the incomplete gamma function)."""
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(chance: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < chance else (low, mid)
    return low


def _trigrams(words: Column) -> Column:
    """(hash, second hash, number of the first word) of every three words in a row, by hash."""
    three = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
    made = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(*three(i)).alias("a"), F.xxhash64(F.lit(1), *three(i)).alias("b"), i.alias("at")))
    return F.when(F.size(words) >= 3, F.sort_array(made)).otherwise(F.array().cast("array<struct<a: bigint, b: bigint, at: int>>"))


def _met_again(sorted_grams: Column) -> Column:
    """Places of the trigrams that are like a neighbour."""
    def same(x: Column, other: Column) -> Column:
        return F.coalesce((x["a"] == other["a"]) & (x["b"] == other["b"]), F.lit(False))

    again = F.filter(sorted_grams, lambda x, i: same(x, F.get(sorted_grams, i - 1)) | same(x, F.get(sorted_grams, i + 1)))
    return F.sort_array(F.transform(again, lambda x: x["at"]))


def _covered(places: Column) -> Column:
    """Words in windows of three that begin at sorted ``places``."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda so_far, at: F.struct(at.alias("last"), (so_far["n"] + F.least(F.lit(3), at - so_far["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda x: x["n"])


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, counts of the whole text, base_failed, and the vector of every row of documents."""
    text, words = F.col("_text"), F.col("_words")
    rows = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = rows.withColumns({"_words": F.filter(F.split(text, WHITE), lambda w: w != ""), "_lines": lines})
    rows = rows.select(
        "doc_id", "lang", "source",
        F.size(words).cast("bigint").alias("n_words"),
        _without(text, WHITE_CHARACTERS).alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]")).alias("_marks"),
        _trigrams(words).alias("_grams"),
    )
    rows = rows.withColumn("n_repeat_words", _covered(_met_again(F.col("_grams")))).drop("_grams")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    vector = {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "upper": share("_upper", "word_chars"),
        "marks": share("_marks", "word_chars"),
        "dup_lines": share("n_dup_lines", "_n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }
    return rows.select(
        "doc_id", field(F.col("lang")).alias("language"), F.concat(field(F.col("lang")), field(F.col("source"))).alias("cell"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *[c.alias(n) for n, c in vector.items()],
    )


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], most: int = BROADCAST_CELLS) -> DataFrame:
    """Joins facts of a group to its rows. One group may hold most rows, so many facts are joined by group and part."""
    if facts.count() <= most:
        return rows.join(F.broadcast(facts), keys)
    rows = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    facts = facts.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.join(facts, [*keys, "_part"]).drop("_part")


def _median(value: Column) -> Column:
    return F.percentile_approx(value, 0.5, ACCURACY)


def standardised(rows: DataFrame, most: int = BROADCAST_CELLS) -> DataFrame:
    """Puts every component as its distance from the language's median, in robust scales of the language (not under ``FLOORS``).

    Median and scale are those of the documents that pass the base rules.
    """
    passed = rows.where(~F.col("base_failed"))
    middle = materialize(passed.groupBy("language").agg(*[_median(F.col(n)).alias(f"_m_{n}") for n in NAMES]), "medians")
    off = with_facts(passed, middle, ["language"], most)
    scale = off.groupBy("language").agg(*[F.greatest(F.lit(FLOORS[n]), 1.4826 * _median(F.abs(F.col(n) - F.col(f"_m_{n}")))).alias(f"_s_{n}") for n in NAMES])
    facts = materialize(middle.join(scale, "language"), "scales")
    found = with_facts(passed, facts, ["language"], most)
    return found.withColumns({n: (F.col(n) - F.col(f"_m_{n}")) / F.col(f"_s_{n}") for n in NAMES}).select(*rows.columns)


def moments(rows: DataFrame, keys: list[str], counted: Column | None = None, larger: float = 1.0) -> DataFrame:
    """Mean and covariance of the ``counted`` vectors of every group, as columns m0, ... and c00, c10, ..., with the prior's documents.

    The covariance is made ``larger`` by a factor. A group without a counted vector has the prior's.
    """
    once = F.lit(1.0) if counted is None else F.when(counted, 1.0).otherwise(0.0)
    x = [F.col(n) * once for n in NAMES]
    sums = {f"s{i}": F.sum(x[i]) for i in range(P)} | {f"q{i}{j}": F.sum(x[i] * F.col(NAMES[j])) for i in range(P) for j in range(i + 1)}
    found = rows.groupBy(*keys).agg(F.sum(once).alias("n"), *[c.alias(n) for n, c in sums.items()])
    n = F.col("n")

    def covariance(i: int, j: int) -> Column:
        about = F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.greatest(n, F.lit(1.0))
        same = float(i == j)
        return (larger * about + PRIOR * same) / (n + PRIOR) + NOISE * same

    mean = [(F.col(f"s{i}") / (n + PRIOR)).alias(f"m{i}") for i in range(P)]
    return found.select(*keys, *mean, *[covariance(i, j).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])


def whitened(estimates: DataFrame) -> DataFrame:
    """Adds the determinant and w00, w10, ...: the inverse of the covariance's Cholesky factor, column by column."""
    for j in range(P):
        before = lambda i, j=j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        estimates = estimates.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - before(j)))
        if j + 1 < P:
            estimates = estimates.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - before(i)) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):
        inner = lambda j, i=i: sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
        own = {f"w{i}{j}": -inner(j) / F.col(f"l{i}{i}") for j in range(i)}
        estimates = estimates.withColumns(own | {f"w{i}{i}": 1 / F.col(f"l{i}{i}")})
    determinant = 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return estimates.withColumn("log_determinant", determinant).drop(*[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def distances(rows: DataFrame, estimates: DataFrame, keys: list[str], most: int = BROADCAST_CELLS) -> DataFrame:
    """Adds the squared Mahalanobis distance of every vector from its group's estimate."""
    names = [c for c in estimates.columns if c in keys or c[0] in "mw" and c[1:].isdigit()]
    found = with_facts(rows, estimates.select(*names), keys, most)
    found = found.withColumns({f"_d{i}": F.col(NAMES[i]) - F.col(f"m{i}") for i in range(P)})
    found = found.withColumns({f"_y{i}": sum((F.col(f"w{i}{j}") * F.col(f"_d{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(P)})
    return found.select(*rows.columns, sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0)).alias("distance"))


def concentrated(rows: DataFrame, share: float = SHARE, steps: int = STEPS, most: int = BROADCAST_CELLS) -> DataFrame:
    """The estimate of least determinant of every cell, scaled as for normal data and weighed once more.

    The starts order the vectors by their length, and by the covariance of their squashed and of their directions.
    """
    keys = ["cell", "start"]
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in NAMES), F.lit(0.0)))
    squashed = rows.select("cell", F.lit(1).alias("start"), *[F.tanh(n).alias(n) for n in NAMES])
    directions = rows.withColumn("_length", F.greatest(length, F.lit(1e-9))).select("cell", F.lit(2).alias("start"), *[(F.col(n) / F.col("_length")).alias(n) for n in NAMES])
    even = rows.select("cell").distinct().select("cell", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"m{i}") for i in range(P)], *[F.lit(float(i == j)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
    first = moments(squashed.unionByName(directions), keys)
    first = first.withColumns({f"m{i}": F.lit(0.0) for i in range(P)})
    estimates = materialize(whitened(even.unionByName(first)), "start")
    started = rows.withColumn("start", F.explode(F.array(*[F.lit(s) for s in range(3)])))
    for step in range(steps):
        far = distances(started, estimates, keys, most)
        limits = materialize(far.groupBy(*keys).agg(F.percentile_approx("distance", share, ACCURACY).alias("limit")), "limits")
        near = F.col("distance") <= F.col("limit")
        estimates = materialize(whitened(moments(with_facts(far, limits, keys, most), keys, near)), f"step-{step}")
    best = estimates.groupBy("cell").agg(F.min_by("start", F.struct("log_determinant", "start")).alias("start"))
    best = materialize(estimates.join(best, keys).drop("start"), "best")
    # a covariance of the nearest share of normal data is too small by this factor
    limit = chi_square_quantile(share, P)
    far = distances(rows, best, ["cell"], most).withColumn("distance", F.col("distance") * (chi_square(limit, P + 2) / share))
    limit = chi_square_quantile(0.975, P)
    again = moments(far, ["cell"], F.col("distance") <= limit, 0.975 / chi_square(limit, P + 2))
    return materialize(whitened(again), "estimates")


def judge(docs: DataFrame, rejected: float = REJECTED, most: int = BROADCAST_CELLS) -> DataFrame:
    """Counts, base_failed and kept of every row of documents; the distance is null where base_failed.

    Null texts count as empty, and so fail. Null languages and sources make cells of their own. A cell with few documents is judged by its
    language's medians and scales. Repeated rows, null and repeated ids are judged each; other columns are left alone.
    """
    rows = materialize(statistics(docs), "statistics")
    vectors = materialize(standardised(rows, most), "vectors")
    far = distances(vectors, concentrated(vectors, most=most), ["cell"], most)
    found = far.unionByName(rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")))
    limit = chi_square_quantile(1 - rejected, P)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance") <= limit)).alias("kept"), "distance",
    )
