"""Personal data in texts: generators propose spans, boosted trees judge them by format and context.

The base generators follow fixed rules, and what passes their checks is always kept. Further generators propose
spans that may well be something else (national telephone numbers, account numbers, disguised addresses), and
may overlap. The trees learn from the base spans, with and without the sign that gives them away, from further
spans that a check confirms (accounts, IPv6, disguised addresses), and from the spans that failed and numbers that the words before
them speak against; what nothing tells about is left out. A span is selected where its calibrated probability reaches a threshold that held the
wanted precision on documents that were not trained on.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.durable import materialize
from ledgerlens.llm import boosting

BASE = ("email", "ip", "card", "phone")
#: Generators beyond the base, in the order in which their spans are listed behind the base kinds.
MORE = ("number", "account", "ip6", "address")
KINDS = BASE + MORE
PRECISION = 0.9
#: Characters before a span that are its context.
CONTEXT = 40
SPANS = "array<struct<kind string, start int, end int, score double>>"

#: What the base kinds look like. Possessive repetition keeps long runs linear; a run of digits begins only one match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_MORE = {
    "number": re.compile(r"(?<![A-Za-z0-9+.])\(?[0-9]++(?:[\x20()./-]{1,2}[0-9]++)*+(?![A-Za-z0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip6": re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])"),
    "address": re.compile(r"(?i:(?<![a-z0-9._-])[a-z0-9._-]{1,64}+\x20?[(\[]?\x20?at\x20?[)\]]?\x20[a-z0-9-]{1,64}+(?:\x20?[(\[]?\x20?dot\x20?[)\]]?\x20[a-z]{2,12}+)+)"),
}
#: Words before a span that speak for and against personal data.
_FOR = re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|mail|email|e-mail|contact|ssn|iban|account|card|address|born|dob|passport)\b")
_AGAINST = re.compile(r"(?i)\b(?:version|release|isbn|page|pages|chapter|figure|table|section|order|invoice|item|license|licence|year|copyright)\b")
_DIGIT = re.compile("[0-9]")
_ADDRESS = re.compile(r"[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*@(?:[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*\.)+[A-Za-z]{2,12}")
_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr nl ch eu ca au jp cn ru br".split())


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), True
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """All matches of the base rules: kind, code points, whether the match passes its check."""
    for start, end, good in _emails(text):
        yield "email", start, end, good
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 7:
            digits = _digits(m[0])
            yield "card", *m.span(), 12 <= len(digits) <= 19 and _luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= len(_digits(m[0])) <= 15


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """What the further generators propose."""
    if _DIGIT.search(text):
        for kind in ("number", "account"):
            for m in _MORE[kind].finditer(text):
                if 7 <= len(_digits(m[0])) <= 24:
                    yield kind, *m.span()
    if text.count(":") > 2:
        for m in _MORE["ip6"].finditer(text):
            yield "ip6", *m.span()
    if " dot" in text.lower() or "dot " in text.lower():
        for m in _MORE["address"].finditer(text):
            yield "address", *m.span()


def _valid_account(span: str) -> bool:
    """The check digits of an international account number, modulo 97."""
    plain = span.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _valid_ip6(span: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(span))
    except ValueError:
        return False


def _valid_address(span: str) -> bool:
    """Whether it becomes an address that can be, and cannot well be prose: by its brackets or its ending."""
    plain = re.sub(r"(?i)\x20?[(\[]?\x20?\bat\b\x20?[)\]]?\x20", "@", span, count=1)
    plain = re.sub(r"(?i)\x20?[(\[]?\x20?\bdot\b\x20?[)\]]?\x20", ".", plain)
    sure = any(c in span for c in "([") or plain.rpartition(".")[2].lower() in _ENDINGS
    return sure and bool(_ADDRESS.fullmatch(plain))


#: Further kinds that a check can confirm; what it does not confirm says nothing.
CONFIRMS = {"account": _valid_account, "ip6": _valid_ip6, "address": _valid_address}


def features(before: str, span: str, after: str) -> list[float]:
    """Format of a span and its context; nothing that the base checks decide by."""
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    digits = sum(groups)
    letters = sum(c.isalpha() for c in span)
    signs = [c for c in span if not c.isalnum()]
    return [
        len(span), digits, letters, digits / len(span), len(groups), max(groups), min(groups), groups[0], groups[-1],
        len(signs), len(set(signs)), signs.count("."), signs.count("-"), signs.count(" "), signs.count("("), signs.count(":"), signs.count("@"),
        sum(c.isupper() for c in span), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "=/#$€£%"),
        len(_FOR.findall(before)), len(_AGAINST.findall(before)),
    ]


def _features_at(text: str, start: int, end: int) -> list[float]:
    return features(text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + 1])


def examples(text: str) -> Iterator[tuple[bool, list[float]]]:
    """Labelled candidates of a text."""
    good = []
    for kind, start, end, passed in base_spans(text):
        if passed:
            good.append((start, end))
            before, span, after = text[max(0, start - CONTEXT) : start], text[start:end], text[end : end + 1]
            yield True, features(before, span, after)
            if span[0] == "+":  # as it would be written within its country
                yield True, features(before, re.sub(r"^\+[0-9]{1,3}\x20?", "", span) or span, after)
        elif kind != "card" or len(_digits(text[start:end])) >= 12:
            # a shorter number was no candidate for a card, and may be another thing
            yield False, _features_at(text, start, end)
    rest = [m for m in more_spans(text) if not any(a < m[2] and m[1] < b for a, b in good)]
    open_ = []
    for kind, start, end in rest:
        if kind in CONFIRMS:
            open_.append((start, end))
            if CONFIRMS[kind](text[start:end]):
                yield True, _features_at(text, start, end)
    for kind, start, end in rest:
        # a number within one of those may be a part of it, and any other may be someone's: only words against it tell
        before = text[max(0, start - CONTEXT) : start]
        if kind not in CONFIRMS and _AGAINST.search(before) and not _FOR.search(before) and not any(a < end and start < b for a, b in open_):
            yield False, _features_at(text, start, end)


@dataclass
class Judge:
    model: boosting.Model | None
    threshold: float

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, rank of the kind, end, score): the base spans, and others that are selected, the likelier of two that overlap."""
        found = [(start, KINDS.index(kind), end, 1.0) for kind, start, end, good in base_spans(text) if good]
        if self.model is not None:
            taken = [(s, e) for s, _, e, _ in found]
            asked = [m for m in more_spans(text) if not any(a < m[2] and m[1] < b for a, b in taken)]
            if asked:
                score = self.model.probability(np.array([_features_at(text, s, e) for _, s, e in asked]))
                for i in np.argsort(-score, kind="stable"):
                    kind, start, end = asked[i]
                    if score[i] >= self.threshold and not any(a < end and start < b for a, b in taken):
                        taken.append((start, end))
                        found.append((start, KINDS.index(kind), end, float(score[i])))
        return sorted(found)


def fit(docs: DataFrame, precision: float = PRECISION) -> Judge:
    """Learns from all candidates of the whole texts of ``docs`` (doc_id, text); those of every other document calibrate.

    Spark counts equal candidates. Trees split at ``boosting.BINS`` quantiles of a feature, so candidates that no split can part are counted
    together, too: what comes to the driver is one row for each of these, however many texts there are.
    Without both kinds of candidates there is nothing to learn, and only base spans are found.
    """

    @F.arrow_udf("array<struct<good boolean, x array<double>>>")
    def candidates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("good", pa.bool_()), ("x", pa.list_(pa.float64()))]))
        for texts in batches:
            yield pa.array([[{"good": g, "x": x} for g, x in examples(t or "")] for t in texts.to_pylist()], kind)

    found = docs.select("doc_id", F.explode(candidates(F.col("text").cast("string"))).alias("c"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")
    counted = materialize(found.groupBy(fold, "c.good", "c.x").agg(F.count(F.lit(1)).alias("n")), "candidates")
    values = counted.where("fold = 0").select("n", F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("n").alias("n")).toArrow()
    f, v, n = (values.column(c).to_numpy() for c in ("f", "v", "n"))
    if not len(f):
        return Judge(None, 2.0)
    limits = [boosting.cuts_of(v[f == k], n[f == k]) for k in range(int(f.max()) + 1)]

    @F.arrow_udf("array<double>")
    def between_cuts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # every value becomes the cut that ends its bin, so that it stays on the same side of all cuts
        for vectors in batches:
            x = np.array(vectors.to_pylist(), float).reshape(len(vectors), len(limits))
            ended = [np.append(cuts, np.inf)[np.searchsorted(cuts, x[:, k])] for k, cuts in enumerate(limits)]
            yield pa.array(np.column_stack(ended).tolist(), pa.list_(pa.float64()))

    drawn = counted.select("fold", "good", between_cuts("x").alias("x"), "n").groupBy("fold", "good", "x").agg(F.sum("n").alias("n")).toArrow()
    x = np.array(drawn.column("x").to_pylist(), float)
    y, fold, counts = (drawn.column(c).to_numpy().astype(float) for c in ("good", "fold", "n"))
    order = np.lexsort([*x.T, y, fold])  # sums of floats hang on the order
    x, y, fold, counts = x[order], y[order], fold[order], counts[order]
    one, two = fold == 0, fold == 1
    if any(len(np.unique(y[f])) < 2 for f in (one, two)):
        return Judge(None, 2.0)
    model = boosting.train(x[one], y[one], counts[one], limits)
    boosting.calibrate(model, x[two], y[two], counts[two])
    # precise on all that was held out, and likelier than not each
    return Judge(model, max(0.5, boosting.threshold(model.probability(x[two]), y[two], precision, counts[two])))


def find(text: Column | str, judge: Judge) -> Column:
    """Personal data of every whole text, by start and then in the order of KINDS; code points, end exclusive.

    Null and empty texts have none.
    """

    @F.arrow_udf(SPANS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for texts in batches:
            out = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in judge.spans(t or "")] for t in texts.to_pylist()]
            yield pa.array(out, kind)

    return of(text)


def redacted(text: Column | str, judge: Judge) -> Column:
    """The text with every stretch that found spans cover replaced by ``[kind]`` of the first; null stays null."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                parts, done = [], 0
                for start, kind, end, _ in judge.spans(t or ""):
                    if start >= done:
                        parts += [t[done:start], f"[{KINDS[kind]}]"]
                    done = max(done, end)
                out.append("".join([*parts, t[done:]]) if parts else t)
            yield pa.array(out, texts.type)

    return of(text)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of documents: its id, counts of the base kinds, their digest, and all spans as text.

    Null and empty texts have no spans. Repeated rows, null and repeated ids have a row each; other columns are left out.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", find("text", fit(rows)).alias("found"))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = [F.size(F.expr(f"filter(found, x -> x.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in BASE]
    digest = F.sha2(F.array_join(F.transform(F.filter("found", lambda x: x["kind"].isin(*BASE)), label), ","), 256)
    return found.select("doc_id", *count, digest.alias("base_sha256"), F.array_join(F.transform("found", label), ",").alias("spans"))
