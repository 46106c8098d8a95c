"""Secrets in texts: all rules in one pass of one automaton over the bytes.

Every rule says what a match is, which matches count, and what all those that count hold. The automaton of all
rules accepts where it has read the latter. The few stretches of text around such places, up to bytes that no
match holds, are then cut into matches, rule by rule. A private key goes on behind its first line, over the lines of its body.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.automaton import Automaton, compile_rules, matches, read
from ledgerlens.llm.words import buffer_of, free_name, slices, tidied


@dataclass(frozen=True)
class Rule:
    """``pattern`` cuts a text into matches, leftmost first; ``counts`` says which of them are secrets.

    ``seen`` matches within every match that counts; what it leaves open keeps the automaton of all rules small.
    """

    kind: str
    pattern: str
    seen: str
    counts: Callable[[str], bool]


#: What the keys, and the prefixes of well-known tokens, look like.
_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"


def _long_value(found: str) -> bool:
    """At least 12 characters behind the first : or = and what may follow it."""
    rest = found[min(i for i in (found.find(":"), found.find("=")) if i >= 0) + 1 :].lstrip(" ")
    return len(rest.removeprefix(rest[:1] if rest[:1] in ("'", '"') else "")) >= 12


BASE = (
    Rule("assign", f"{_KEY}{_VALUE}+", f"{_KEY}{_VALUE}{{4}}", _long_value),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{4}", lambda s: len(s) >= 18),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{10}", lambda s: len(s) >= 16),
)
RULES = BASE + (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----", lambda s: True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{4}", lambda s: len(s) >= 24),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-", lambda s: len(s) >= 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"\.eyJ", lambda s: True),
)
#: What ends a private key, and what its body is made of where no end follows: header fields, lines that hold base64 alone (line ends
#: may be written as escapes), and long pieces of base64 that stand in one line.
_KEY_BORDER = re.compile(rb"-----(?:BEGIN |END [A-Z ]*PRIVATE KEY-----)")
_EDGE = rb"""[\x20\t>#|"',]"""
_LINE_END = rb"(?:\r|\n|\\[nr])"
_KEY_BODY = re.compile(
    rb"(?:%(edge)s*+(?:%(end)s%(edge)s*+)++(?:(?:Proc-Type|DEK-Info):[^\r\n\\]++|[A-Za-z0-9+/=]++(?=%(edge)s*+(?:%(end)s|\Z)))"
    rb"|(?:%(edge)s|%(end)s)++[A-Za-z0-9+/=]{40,}+)++" % {b"edge": _EDGE, b"end": _LINE_END}
)
SPANS = "array<struct<kind string, start int, end int>>"


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    all: Automaton
    each: list[tuple]

    @classmethod
    def of(cls, rules: tuple[Rule, ...] = RULES) -> Scanner:
        every = compile_rules([r.seen for r in rules])
        single = [compile_rules([r.pattern], anywhere=False) for r in rules]
        held = np.logical_or.reduce([(a.moves != a.dead).any(axis=0)[a.classes] for a in single])
        if held[10] or (held & every.resets).any():
            raise ValueError("matches must not hold line ends, nor bytes that part stretches")
        return cls(rules, every, [(a.moves.tolist(), a.classes.tobytes(), a.accepts.tolist(), a.dead) for a in single])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """For every text with secrets: its number and (first byte, rule, end byte), sorted."""
        low = int(offsets[0])
        # a line end behind every text keeps them apart
        lines = np.insert(data[low : int(offsets[-1])], offsets[1:] - low, 10)
        ends = offsets[1:] - low + np.arange(len(offsets) - 1)
        seen = self.all.accepts[read(self.all, lines)]
        at = np.flatnonzero(seen)
        if not len(at):
            return
        borders = np.flatnonzero(self.all.resets[lines])
        stretch = np.searchsorted(borders, at)  # up to the border behind
        which, first = np.unique(stretch, return_index=True)
        bits = np.bitwise_or.reduceat(seen[at], first)
        begin = np.where(which > 0, borders[which - 1] + 1, 0)
        text = np.searchsorted(ends, at[first])
        raw = lines.tobytes()
        found: list[tuple[int, int, int]] = []
        for k in range(len(which)):
            part = raw[begin[k] : borders[which[k]]]
            base = int(ends[text[k] - 1] + 1 if text[k] else 0)
            shift = int(begin[k]) - base
            for number, rule in enumerate(self.rules):
                if bits[k] >> number & 1:
                    for start, end in matches(*self.each[number], part):
                        if rule.counts(part[start:end].decode("ascii")):
                            last = end + shift
                            if rule.kind == "private_key":
                                last = _key_end(raw, base + last, int(ends[text[k]])) - base
                            found.append((start + shift, number, last))
            if k + 1 == len(which) or text[k + 1] != text[k]:
                if found:
                    yield int(text[k]), sorted(found)
                found = []


def _key_end(raw: bytes, at: int, limit: int) -> int:
    """Where the private key ends whose first line ends at ``at``."""
    border = _KEY_BORDER.search(raw, at, limit)
    if border and border[0].endswith(b"KEY-----"):
        return border.end()
    body = _KEY_BODY.match(raw, at, border.start() if border else limit)
    return body.end() if body else at


def _code_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _each(scanner: Scanner, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, int]]]]:
    data, offsets = buffer_of(texts)
    for low, high in slices(offsets):
        for text, spans in scanner.spans(data, offsets[low : high + 1]):
            yield low + text, data[offsets[low + text] : offsets[low + text + 1]], spans


def find(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Secrets of every whole text: kind and code points, end exclusive, by start and then in the order of the rules.

    Matches of one rule are leftmost, longest and apart; matches of different rules may overlap. Null and empty
    texts have none.
    """
    scanner = Scanner.of(rules)
    kinds = [r.kind for r in rules]

    @F.arrow_udf(SPANS)
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for i, own, spans in _each(scanner, texts):
                place = _code_points(own)
                out[i] = [{"kind": kinds[r], "start": int(place[a]), "end": int(place[b])} for a, r, b in spans]
            yield pa.array(out, kind)

    return of(text)


def redacted(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with every stretch that secrets cover replaced by ``[kind]``, named by its first secret; null stays null."""
    scanner = Scanner.of(rules)
    kinds = [r.kind for r in rules]

    @F.arrow_udf("string")
    @tidied
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            changed = {}
            for i, own, spans in _each(scanner, texts):
                raw, parts, done = own.tobytes(), [], 0
                for start, rule, end in spans:
                    if start >= done:
                        parts += [raw[done:start], f"[{kinds[rule]}]".encode()]
                    done = max(done, end)
                changed[i] = b"".join([*parts, raw[done:]]).decode("utf-8")
            if changed:
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                # the changed ones are few; the others stay as they are
                new = pa.array([changed[i] for i in sorted(changed)], texts.type)
                texts = pc.replace_with_mask(texts, pa.array(mask), new)
            yield texts

    return of(text)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of documents: its id, counts of the base kinds, their digest, and all spans as text.

    Null and empty texts have no spans. Repeated rows, null and repeated ids have a row each; other columns are left out.
    """
    found = docs.select("doc_id", find(F.col("text").cast("string")).alias("found"))
    label = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = [r.kind for r in BASE]
    count = [F.size(F.expr(f"filter(found, x -> x.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in base]
    digest = F.sha2(F.array_join(F.transform(F.filter("found", lambda x: x["kind"].isin(*base)), label), ","), 256)
    return found.select("doc_id", *count, digest.alias("base_sha256"), F.array_join(F.transform("found", label), ",").alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets redacted; where the text changes, so does n_chars.

    Null texts stay null. Repeated rows, null and repeated ids are treated each; other columns of any name and type stay.
    """
    text, name = F.col("text").cast("string"), free_name(docs.columns, "_new")
    new = docs.withColumn(name, redacted(text))
    n_chars = F.when(F.col(name).eqNullSafe(text), F.col("n_chars")).otherwise(F.length(name).cast("bigint"))
    return new.withColumns({"n_chars": n_chars, "text": F.col(name)}).drop(name)
