"""Many regular expressions as one minimal deterministic automaton over bytes, and its pass over a buffer.

Expressions are parsed by the standard library; the ones used here are made of ASCII letters, classes, groups,
alternatives and repetition. The automaton is a table state x class of bytes. A buffer is read in lanes side by
side, each byte once: a lane first assumes that it begins where nothing has been read, and where the lane before it
ends in another state, its beginning is read again up to the place where both readings meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as C, _parser

import numpy as np

#: Bytes of a lane.
#: So few lanes are mended one after the other.
FEW_LANES = 16
#: Steps in vain that are not worth remembering.
SHORT_TRAIL = 16
LANE = 1024


class _Graph:
    """States with moves on sets of bytes and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, parsed: Iterable, at: int, fold: bool) -> int:
        """Appends a parsed expression at a state; returns the state behind it."""
        for what, value in parsed:
            if what is C.MAX_REPEAT:
                least, most, inner = value
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if most is C.MAXREPEAT:
                    loop, after = self.state(), self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    self.empty[loop].append(after)
                    at = after
                else:
                    after = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(after)
                        at = self.add(inner, at, fold)
                    self.empty[at].append(after)
                    at = after
            elif what is C.BRANCH:
                after = self.state()
                for inner in value[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(inner, begin, fold)].append(after)
                at = after
            elif what is C.SUBPATTERN:
                _, on, off, inner = value
                at = self.add(inner, at, bool((fold or on & re.IGNORECASE) and not off & re.IGNORECASE))
            else:
                after = self.state()
                self.moves[at].append((_bytes(what, value, fold), after))
                at = after
        return at

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


def _bytes(what: object, value: object, fold: bool) -> frozenset[int]:
    if what is C.LITERAL:
        found = {value}
    elif what is C.IN and value[0][0] is not C.NEGATE:
        found = set()
        for kind, x in value:
            if kind is C.LITERAL:
                found.add(x)
            elif kind is C.RANGE:
                found.update(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"not supported in a class: {kind}")
    else:
        raise ValueError(f"not supported: {what}")
    if max(found) > 127:
        raise ValueError("only ASCII is supported")
    return frozenset(found | {ord(c) for b in found if fold for c in (chr(b).lower(), chr(b).upper())})


@dataclass
class Automaton:
    """State 0 begins. ``accepts[s]`` has bit i if a match of expression i ends in s."""

    classes: np.ndarray  # of each byte
    moves: np.ndarray  # state x class
    accepts: np.ndarray
    dead: int  # the state that nothing leaves, or -1

    @property
    def resets(self) -> np.ndarray:
        """For each byte, whether it always leads to state 0: no match holds such a byte."""
        return (self.moves == 0).all(axis=0)[self.classes]


def compile_rules(patterns: list[str], anywhere: bool = True) -> Automaton:
    """The minimal automaton of the expressions; with ``anywhere``, matches begin at any byte."""
    graph = _Graph()
    begin = graph.state()
    ends = {}
    for number, pattern in enumerate(patterns):
        first = graph.state()
        graph.empty[begin].append(first)
        ends[graph.add(_parser.parse(pattern), first, False)] = number
    sets = sorted({s for moves in graph.moves for s, _ in moves}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    # sets of states are the bits of a number
    bits = lambda states: sum(1 << s for s in graph.closed(states))
    start = bits([begin])
    steps = [[bits({after for on, after in moves if byte in on}) for byte in sample] for moves in graph.moves]
    always = start if anywhere else 0
    numbers, todo, moves = {start: 0}, [start], []
    for states in todo:
        members = [i for i in range(states.bit_length()) if states >> i & 1 and graph.moves[i]]
        row = []
        for c in range(len(sample)):
            to = always
            for i in members:
                to |= steps[i][c]
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        moves.append(row)
    accepts = np.array([sum(1 << n for s, n in ends.items() if states >> s & 1) for states in numbers], np.int64)
    return _minimal(classes, np.array(moves), accepts)


def _minimal(classes: np.ndarray, moves: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Merges states that no text tells apart, by refining the parts of equal acceptance."""
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, first, finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.ravel()
        if len(first) == part.max() + 1:
            break
        part = finer
    order = np.argsort(first)  # state 0 stays first
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    first, part = first[order], number[finer]
    moves, accepts = part[moves[first]], accepts[first]
    sinks = np.flatnonzero((moves == np.arange(len(moves))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(classes.astype(np.uint8), moves.astype(np.int32), accepts, int(sinks[0]) if len(sinks) else -1)


def read(automaton: Automaton, data: np.ndarray) -> np.ndarray:
    """The state after every byte of ``data``."""
    n = len(data)
    lanes = -(-n // LANE)
    width = automaton.moves.shape[1]
    moves = (automaton.moves * width).ravel()  # states are held as the offsets of their rows
    kinds = np.zeros(lanes * LANE, np.int32)
    kinds[:n] = automaton.classes[data]
    kinds = np.ascontiguousarray(kinds.reshape(lanes, LANE).T)
    after = np.empty((LANE, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for i in range(LANE):
        state = moves.take(state + kinds[i], out=after[i])
    began = np.zeros(lanes, np.int32)
    while True:
        ended = np.concatenate([[0], after[-1, :-1]]).astype(np.int32) if lanes else began
        wrong = np.flatnonzero(ended != began)
        if len(wrong) <= FEW_LANES:
            _mend(moves, kinds, after, began, wrong)
            break
        began = ended
        state = ended[wrong]
        for i in range(LANE):
            state = moves[state + kinds[i, wrong]]
            apart = state != after[i, wrong]
            if not apart.all():
                wrong, state = wrong[apart], state[apart]
                if not len(wrong):
                    break
            after[i, wrong] = state
    return (after // width).T.ravel()[:n]


def _mend(moves: np.ndarray, kinds: np.ndarray, after: np.ndarray, began: np.ndarray, wrong: np.ndarray) -> None:
    """Reads on from the lanes before the ``wrong`` ones until the states meet, byte by byte and across lanes: no byte is read twice."""
    step, lanes = moves.tolist() if len(wrong) else [], after.shape[1]
    for lane in wrong.tolist():
        if after[-1, lane - 1] == began[lane]:
            continue  # an earlier one has come by
        state, met = int(after[-1, lane - 1]), False
        while not met and lane < lanes:
            # what this lane was read from, for the lanes behind to tell whether they are still wrong
            began[lane] = state
            own, old = kinds[:, lane].tolist(), after[:, lane].tolist()
            for i, kind in enumerate(own):
                state = step[state + kind]
                if state == old[i]:
                    met = True
                    break
                old[i] = state
            after[:, lane] = old
            lane += 1


def matches(moves: list[list[int]], classes: bytes, accepts: list[int], dead: int, text: bytes) -> list[tuple[int, int]]:
    """Leftmost longest matches that don't overlap, by an automaton of one expression that begins where it is put.

    Linear in the text: where a state has led to no acceptance is remembered, and not read from again.
    """
    found, at, n = [], 0, len(text)
    alive = [moves[0][c] != dead for c in range(len(moves[0]))]
    text = text.translate(classes)
    vain: dict[int, bytearray] = {}
    while at < n:
        if not alive[text[at]]:
            at += 1
            continue
        state, end, i = 0, at, at
        trail: list[int] = []  # states since the last acceptance
        while i < n:
            state = moves[state][text[i]]
            if state == dead:
                break
            i += 1
            if accepts[state]:
                end = i
                trail = []
            elif state in vain and vain[state][i - 1]:
                break
            else:
                trail.append(state)
        if len(trail) > SHORT_TRAIL:
            for k, passed in enumerate(trail, end):
                if passed not in vain:
                    vain[passed] = bytearray(n)
                vain[passed][k] = 1
        if end > at:
            found.append((at, end))
            at = end
        else:
            at += 1
    return found
