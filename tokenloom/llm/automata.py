"""Byte regexes to one minimal deterministic automaton: Thompson construction, subsets, partition refinement.

Syntax: literals, ``.`` (any byte), ``[...]`` with ranges and ``^``, ``(...)``, ``(?i:...)``, ``|``,
``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``, and escapes ``\\xHH``, ``\\n``, ``\\t``, ``\\r`` or of any other character.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

_NAMED = {"n": 10, "t": 9, "r": 13}


class _Nfa:
    def __init__(self) -> None:
        self.epsilon: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.epsilon.append([])
        self.moves.append([])
        return len(self.epsilon) - 1


class _Parser:
    """Recursive descent to a tree of tuples."""

    def __init__(self, pattern: str):
        self.text, self.at, self.fold = pattern, 0, False

    def parse(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unbalanced ')' in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"pattern ends early: {self.text!r}")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        tree = self.atom()
        while self.peek() and self.peek() in "?*+{":
            mark = self.take()
            if mark == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                low, comma, high = body.partition(",")
                tree = ("rep", tree, int(low), (int(high) if high else None) if comma else int(low))
            else:
                tree = ("rep", tree, int(mark == "+"), 1 if mark == "?" else None)
        return tree

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return _NAMED.get(c, ord(c))

    def bytes_of(self, found: set[int]) -> tuple[str, frozenset[int]]:
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        return ("set", frozenset(found))

    def atom(self):
        c = self.take()
        if c == "(":
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            tree = self.alternatives()
            self.fold = before
            if self.take() != ")":
                raise ValueError(f"missing ')' in {self.text!r}")
            return tree
        if c == "[":
            flip = self.peek() == "^"
            if flip:
                self.take()
            found: set[int] = set()
            while self.peek() != "]":
                c = self.take()
                low = self.escaped() if c == "\\" else ord(c)
                if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    c = self.take()
                    found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
                else:
                    found.add(low)
            self.take()
            return self.bytes_of(set(range(256)) - found if flip else found)
        if c == ".":
            return ("set", frozenset(range(256)))
        return self.bytes_of({self.escaped() if c == "\\" else ord(c)})


def _build(nfa: _Nfa, tree, begin: int) -> int:
    """Adds the tree's states after ``begin``; the last one."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.moves[begin].append((tree[1], end))
        return end
    if kind == "seq":
        for part in tree[1]:
            begin = _build(nfa, part, begin)
        return begin
    if kind == "or":
        end = nfa.state()
        for option in tree[1]:
            first = nfa.state()
            nfa.epsilon[begin].append(first)
            nfa.epsilon[_build(nfa, option, first)].append(end)
        return end
    _, part, low, high = tree
    for _ in range(low):
        begin = _build(nfa, part, begin)
    if high is None:
        loop, end = nfa.state(), nfa.state()
        nfa.epsilon[begin].append(loop)
        nfa.epsilon[_build(nfa, part, loop)].append(loop)
        nfa.epsilon[loop].append(end)
        return end
    end = nfa.state()
    nfa.epsilon[begin].append(end)
    for _ in range(high - low):
        begin = _build(nfa, part, begin)
        nfa.epsilon[begin].append(end)
    return end


@dataclass(frozen=True)
class Dfa:
    """``table[state, class_of[byte]]`` is the next state; ``accepts[state]`` has bit r if pattern r matches there.

    State 0 is the start. ``resets``: bytes after which the state is 0 whatever it was.
    """

    class_of: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    resets: np.ndarray

    @cached_property
    def dead(self) -> int:
        """The state that no match leaves, or -1."""
        lost = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
        return lost[0] if lost else -1

    @cached_property
    def rows(self) -> list[list[int]]:
        return self.table.tolist()


def compile_patterns(patterns: list[str], *, anchored: bool) -> Dfa:
    """One minimal automaton for all patterns; unless ``anchored``, a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    owner: dict[int, int] = {}
    for k, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.epsilon[start].append(first)
        owner[_build(nfa, _Parser(pattern).parse(), first)] = 1 << k

    sets = {s for moves in nfa.moves for s, _ in moves}
    signature: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    class_of = np.array([signature.setdefault(tuple(b in s for s in ordered), len(signature)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(signature))]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.epsilon[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in owner or s == start)

    initial = closure({start})
    number, queue, rows = {initial: 0}, [initial], []
    for subset in queue:
        row = []
        for byte in sample:
            reached = {t for s in subset for chars, t in nfa.moves[s] if byte in chars}
            if not anchored:
                reached |= {start}
            target = closure(reached)
            if target not in number:
                number[target] = len(queue)
                queue.append(target)
            row.append(number[target])
        rows.append(row)
    table = np.array(rows, np.int32)
    accepts = np.array([sum({owner[s] for s in subset if s in owner}) for subset in queue], np.int64)

    group = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = np.unique(group, return_index=True)[1]
    renamed = np.argsort(np.argsort(order))  # by first member, so that the start is 0
    group = renamed[group]
    first = np.sort(order)
    table, accepts = group[table[first]].astype(np.int32), accepts[first]
    return Dfa(class_of, table, accepts, np.array([bool((table[:, class_of[b]] == 0).all()) for b in range(256)]))


def find_ends(dfa: Dfa, data: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose byte takes the automaton to an accepting state, and those states' accepts, in order.

    The bytes are scanned once. They are cut into lanes after bytes that reset the automaton, so each
    lane starts in state 0, and all lanes take their steps together.
    """
    flat, width = np.ascontiguousarray(dfa.table).reshape(-1), dfa.table.shape[1]
    classes = dfa.class_of[data].astype(np.int32)
    resets = np.flatnonzero(dfa.resets[data])
    wanted = np.arange(lane, len(data), lane)
    near = np.searchsorted(resets, wanted)
    cuts = resets[near[near < len(resets)]] + 1
    starts = np.unique(np.concatenate([[0], cuts[cuts < len(data)]]))
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    state = np.zeros(len(starts), np.int32)
    accepting = dfa.accepts != 0
    places, marks = [], []
    falling = -sizes
    longest = int(sizes[0]) if len(sizes) else 0
    step = 0
    while step < longest:
        active = int(np.searchsorted(falling, -step))
        if active <= 8:
            break
        at = starts[:active] + step
        now = flat[state[:active] * width + classes[at]]
        state[:active] = now
        hit = accepting[now]
        if hit.any():
            places.append(at[hit])
            marks.append(dfa.accepts[now[hit]])
        step += 1
    rows = dfa.table.tolist()
    for i in range(int(np.searchsorted(falling, -step)) if step < longest else 0):
        s = int(state[i])
        own: list[tuple[int, int]] = []
        for p in range(int(starts[i]) + step, int(starts[i] + sizes[i])):
            s = rows[s][classes[p]]
            if accepting[s]:
                own.append((p, int(dfa.accepts[s])))
        if own:
            places.append(np.array([x[0] for x in own]))
            marks.append(np.array([x[1] for x in own], np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, mark = np.concatenate(places), np.concatenate(marks)
    order = np.argsort(place, kind="stable")
    return place[order], mark[order]


def longest_match(dfa: Dfa, data: bytes, begin: int, end: int) -> int:
    """End of the longest match of an anchored automaton at ``begin``, or -1."""
    state, best = 0, begin if dfa.accepts[0] else -1
    rows, class_of, accepts, dead = dfa.rows, dfa.class_of, dfa.accepts, dfa.dead
    for p in range(begin, end):
        state = rows[state][class_of[data[p]]]
        if accepts[state]:
            best = p + 1
        elif state == dead:
            break
    return best
