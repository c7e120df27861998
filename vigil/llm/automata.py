"""Deterministic automata over bytes, compiled from regular expressions.

``compile_rules`` turns rules into one automaton by subset construction and
minimises it by partition refinement; its transitions are one flat array.
Supported: literals, classes, groups, alternatives and greedy counts.
"""

from __future__ import annotations

from re import _constants as K
from re import _parser

import numpy as np


class Nfa:
    """Positions with sets of bytes; edges without bytes are in ``free``."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int, back: bool, fold: bool, short: bool = False) -> int:
        """Append what ``tree`` matches after ``start``; the state at its end.
        short: a count that ends the pattern is taken at its least."""
        tree = list(tree)[:: -1 if back else 1]
        for i, (op, arg) in enumerate(tree):
            last = short and i == len(tree) - 1
            if op is K.SUBPATTERN:
                start = self.add(arg[3], start, back, fold, last)
            elif op is K.BRANCH:
                ends = [self.add(x, self._after(start), back, fold) for x in arg[1]]
                start = self.state()
                for e in ends:
                    self.free[e].append(start)
            elif op is K.MAX_REPEAT:
                low, high, inner = arg
                high = low if last else high
                for _ in range(low):
                    start = self.add(inner, start, back, fold)
                if high is K.MAXREPEAT:
                    loop = self._after(start)
                    self.free[self.add(inner, loop, back, fold)].append(loop)
                    start = self._after(loop)
                else:
                    skip = [start]
                    for _ in range(high - low):
                        start = self.add(inner, self._after(start), back, fold)
                        skip.append(start)
                    end = self.state()
                    for s in skip:
                        self.free[s].append(end)
                    start = end
            else:
                end, here = self.state(), self._after(start)
                self.moves[here] = (self._bytes(op, arg, fold), end)
                start = end
        return start

    def _after(self, start: int) -> int:
        s = self.state()
        self.free[start].append(s)
        return s

    @staticmethod
    def _bytes(op, arg, fold: bool) -> frozenset:
        if op is K.LITERAL:
            found = {arg}
        elif op is K.NOT_LITERAL:
            found = set(range(256)) - {arg}
        elif op is K.ANY:
            found = set(range(256)) - {10}
        elif op is K.IN:
            found, negate = set(), False
            for o, a in arg:
                if o is K.NEGATE:
                    negate = True
                elif o is K.RANGE:
                    found |= set(range(a[0], a[1] + 1))
                else:
                    found.add(a)
            found = set(range(256)) - found if negate else found
        else:
            raise ValueError(f"not supported in a rule: {op}")
        if fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)


class Dfa:
    """next: flat array, next[state + byte] is the next state; states are
    multiples of 256, 0 is the start, states from ``accept`` on end a match, and
    rules[state // 256] names which."""

    def __init__(self, table: np.ndarray, labels: list[frozenset]):
        order = sorted(range(1, len(labels)), key=lambda s: bool(labels[s]))
        order = [0, *order]
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        self.rules = [labels[s] for s in order]
        self.accept = 256 * next((i for i, x in enumerate(self.rules) if x), len(order))
        self.next = (new[table[order]] * 256).ravel().tolist()
        self.dead = {256 * i for i in range(len(order)) if all(self.next[256 * i + b] == 256 * i for b in range(256)) and not self.rules[i]}


def determined(nfa: Nfa, start: int, ends: dict[int, int]) -> tuple[np.ndarray, list[frozenset]]:
    """Subset construction; bytes that no rule tells apart are handled together."""
    sets = {m[0] for m in nfa.moves if m}
    signature = {}
    for b in range(256):
        signature.setdefault(frozenset(i for i, s in enumerate(sets) if b in s), []).append(b)
    groups = list(signature.values())

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in ends)

    first = closure([start])
    number, todo, rows = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = np.zeros(256, np.int64)
        for group in groups:
            b = group[0]
            to = closure([m[1] for s in now if (m := nfa.moves[s]) and b in m[0]])
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[group] = number[to]
        rows.append(row)
    return np.array(rows), [frozenset(ends[s] for s in x if s in ends) for x in number]


def minimised(table: np.ndarray, labels: list[frozenset]) -> tuple[np.ndarray, list[frozenset]]:
    """Merge states that no input tells apart, by refining the partition by labels."""
    kinds = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    part = np.array([kinds[x] for x in labels])
    while True:
        _, first, new = np.unique(np.column_stack([part, part[table]]), axis=0, return_index=True, return_inverse=True)
        new = new.ravel()
        if len(first) == part.max() + 1:
            break
        part = new
    order = np.argsort(first)  # the start stays state 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[new[table[first[order]]]], [labels[i] for i in first[order]]


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool, back: bool = False) -> Dfa:
    """One automaton for all (pattern, either case) rules.  anywhere: a match can
    begin at each byte and ends as soon as it can; back: matches are read from their end."""
    nfa = Nfa()
    start = nfa.state()
    if anywhere:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.moves[loop] = (frozenset(range(256)), start)
    ends = {}
    for i, (pattern, fold) in enumerate(patterns):
        end = nfa.add(_parser.parse(pattern.encode()), nfa._after(start), back, fold, anywhere)
        ends[end] = i
    return Dfa(*minimised(*determined(nfa, start, ends)))


