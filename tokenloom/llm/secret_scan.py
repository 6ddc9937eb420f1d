"""Operator 5: secret scans with one combined deterministic automaton.

All rules are compiled into one minimal automaton over bytes; a text's bytes go through its transition
array once for all rules. Where the automaton accepts, the stretch between the neighbouring bytes that
reset it is resolved into spans, leftmost and not overlapping per rule, by the rules' anchored automata.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import blocks
from .automata import Dfa, compile_patterns, find_ends, longest_match


@dataclass(frozen=True)
class Rule:
    """A secret of kind ``kind``: ``prefix``, then ``value`` of at least ``min_value`` bytes; shorter matches are dropped. ``scan_value``: what the combined automaton looks for in place of ``value``.

    ``tail``: if this follows, the span takes it in; it may run over bytes that end all other matches."""

    kind: str
    prefix: str
    value: str
    min_value: int
    scan_value: str | None = None
    tail: str | None = None


BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]+", 12),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14),
    Rule("hex", r"", r"[0-9a-f]+", 16, r"[0-9a-f]{16,}"),
)
#: Kinds beyond the base.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.", r"[A-Za-z0-9_\-]+", 10),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-+", 5, None, r"[A-Za-z0-9+/=:,.\\\x09\x0A\x0D\x20]*-----END [A-Z ]*PRIVATE KEY-----"),
)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.combined = compile_patterns([r.prefix + (r.scan_value or r.value) for r in rules], anchored=False)
        self.parts = [(compile_patterns([r.prefix], anchored=True), compile_patterns([r.value], anchored=True)) for r in rules]
        self.tails = [compile_patterns([r.tail], anchored=True) if r.tail else None for r in rules]
        both = [compile_patterns([r.prefix + r.value], anchored=True) for r in rules]
        self.firsts = [self._first(d) for d in both]
        reset = np.flatnonzero(self.combined.resets)
        if not len(reset):
            raise ValueError("some byte must be outside all rules, to keep texts apart")
        self.gap = bytes([int(reset[0])]) if 10 not in reset else b"\n"

    @staticmethod
    def _first(dfa: Dfa) -> np.ndarray:
        """Bytes that a match can begin with."""
        live = {int(s) for s in np.flatnonzero(dfa.accepts)}
        while True:
            more = live | {s for s in range(len(dfa.table)) if live & set(dfa.table[s].tolist())}
            if more == live:
                break
            live = more
        return np.array([int(dfa.table[0, dfa.class_of[b]]) in live for b in range(256)])

    def _resolve(self, rule: int, data: bytes, begin: int, end: int) -> Iterator[tuple[int, int]]:
        prefix, value = self.parts[rule]
        free = begin
        for p in np.flatnonzero(self.firsts[rule][np.frombuffer(data, np.uint8, end - begin, begin)]) + begin:
            p = int(p)
            if p < free:
                continue
            middle = longest_match(prefix, data, p, end)
            stop = longest_match(value, data, middle, end) if middle >= 0 else -1
            if stop < 0:
                continue
            free = stop
            if stop - middle >= self.rules[rule].min_value:
                yield p, stop

    def _whole(self, rule: int, data: bytes, stop: int, end: int) -> int:
        """Where a span that stops here ends with its tail."""
        tail = self.tails[rule]
        return max(stop, longest_match(tail, data, stop, end)) if tail else stop

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans ``(start, rule, end)`` in bytes, by start and then rule."""
        data = self.gap.join(texts) + self.gap
        array = np.frombuffer(data, np.uint8)
        ends, marks = find_ends(self.combined, array)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(ends):
            return out
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        walls = np.concatenate([[-1], np.flatnonzero(self.combined.resets[array])])
        cell = np.searchsorted(walls, ends)
        for c in np.unique(cell):
            begin, end = int(walls[c - 1]) + 1, int(walls[c]) if c < len(walls) else len(data)
            own = int(np.bitwise_or.reduce(marks[cell == c])) if len(ends) < 64 else int(np.bitwise_or.reduce(marks[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]))
            text = int(np.searchsorted(first, begin, "right")) - 1
            base = int(first[text])
            for r in range(len(self.rules)):
                if own >> r & 1:
                    out[text] += [(a - base, r, self._whole(r, data, b, int(first[text + 1]) - 1) - base) for a, b in self._resolve(r, data, begin, end)]
        return [sorted(x) for x in out]


def _points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points."""
    if not spans:
        return []
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), r, int(before[b])) for a, r, b in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base_kinds: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """One row per document (``doc_id``, ``text``; other columns are ignored) with its secrets.

    ``n_assign``, ``n_access``, ``n_hex``: spans of the base kinds; ``base_sha256``: of those spans as
    ``kind:start:end`` by start and then kind, comma-joined; ``spans``: all kinds, joined likewise;
    ``found``: the same as an array. Starts and ends are code points, ends exclusive. Null and empty texts have no
    spans; repeated rows get a row each; a null ``doc_id`` stays null; an empty table gives no rows.
    """
    kinds = [r.kind for r in rules]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for begin, raws in blocks(texts, 2 << 20):
                for k, (raw, spans) in enumerate(zip(raws, scanner.spans(raws), strict=True)):
                    points = _points(raw, spans)
                    named = [(f"{kinds[r]}:{a}:{b}", kinds[r]) for a, r, b in points]
                    base = ",".join(x for x, kind in named if kind in base_kinds)
                    count = [sum(kind == b for _, kind in named) for b in ("assign", "access", "hex")]
                    rows.append((keys[begin + k], *count, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x, _ in named), [{"kind": kinds[r], "start": a, "end": b} for a, r, b in points]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
