"""Weighted finite-state transducers that read one symbol at a time, and their composition.

A transducer is sequential: each state has at most one arc for a symbol, which writes any
number of symbols and carries a weight; what is still held back when the input ends is
written by the state's final output. Weights multiply along a path. `compose` feeds what
one transducer writes to the next and keeps the pairs of states that can be reached.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

Written = tuple[tuple[str, float], ...]  # symbols with their weights


@dataclass(frozen=True)
class Transducer:
    start: int
    arcs: tuple[dict[str, tuple[int, Written]], ...]  # by state and symbol: next state, what is written
    ends: tuple[Written, ...]  # by state: what is written at the end

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for s in symbols:
            state, written = self.arcs[state][s]
            out += written
        return [*out, *self.ends[state]]


def transducer(start: Hashable, alphabet: str, step: Callable[[Hashable, str], tuple[Hashable, Written]], end: Callable[[Hashable], Written]) -> Transducer:
    """From rules: step(state, symbol) and end(state). Only states that can be reached are kept, as numbers."""
    number, todo, arcs, ends = {start: 0}, [start], [], []
    for state in todo:
        row = {}
        for s in alphabet:
            after, written = step(state, s)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row[s] = (number[after], written)
        arcs.append(row)
        ends.append(end(state))
    return Transducer(0, tuple(arcs), tuple(ends))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what `first` reads and writes what `second` writes for it."""

    def fed(state: int, written: Written) -> tuple[int, Written]:
        out: list[tuple[str, float]] = []
        for symbol, weight in written:
            state, more = second.arcs[state][symbol]
            out += [(s, w * weight) for s, w in more]
        return state, tuple(out)

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], Written]:
        after, written = first.arcs[state[0]][symbol]
        at, out = fed(state[1], written)
        return (after, at), out

    def end(state: tuple[int, int]) -> Written:
        at, out = fed(state[1], first.ends[state[0]])
        return (*out, *second.ends[at])

    return transducer((first.start, second.start), "".join(first.arcs[first.start]), step, end)
