"""Byte-level word tools on numpy: a batch of texts is one byte array, words are spans with 64-bit hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

WHITE = bytes([32, 9, 10, 11, 12, 13])


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lowered()


def word_table(kind: str) -> np.ndarray:
    """Byte table: A-Z lower-cased, bytes outside words to 0x20. ``white``: words end at white space; ``alnum``: at any ASCII byte but letters and digits."""
    table = LOWER.copy()
    if kind == "white":
        table[list(WHITE)] = 32
    elif kind == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        table[~keep] = 32
    else:
        raise ValueError(f"unknown word table {kind!r}")
    return table


_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1 << 12, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _BASE)])
    return _POWERS


_POWERS[1:] = _BASE
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``starts[i]:ends[i]``, in order, not empty and not overlapping."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    inside = data[place + np.repeat(starts, sizes)]
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(_BYTE[inside] * _powers(int(sizes.max()))[place], first) + sizes.astype(np.uint64))


class Words:
    """The words of a batch of byte strings: ``hashes`` in order, ``first[i]:first[i + 1]`` are those of string i."""

    def __init__(self, texts: Sequence[bytes], table: np.ndarray):
        self.data = table[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        edge = np.flatnonzero(np.diff((self.data != 32).astype(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, text_bounds(texts))
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bounds(texts: Sequence[bytes]) -> np.ndarray:
    """Where each text begins when they are joined by one byte, and the end."""
    return np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])


#: Rows of a batch that become Python objects at a time: texts and shingle sets can be long.
PIECE = 256


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows; what is no longer used is given back to the system at the end."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    give_back()


def give_back() -> None:
    """Gives back to the system what a worker no longer uses, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def blocks(texts: Iterable, size: int = 1 << 20) -> Iterable[tuple[int, list[bytes]]]:
    """``(first index, byte strings)`` of about ``size`` bytes; a longer text is a block of its own."""
    block: list[bytes] = []
    begin = held = 0
    for i, text in enumerate(texts):
        raw = utf8(text)
        if block and held + len(raw) > size:
            yield begin, block
            block, begin, held = [], i, 0
        block.append(raw)
        held += len(raw)
    if block:
        yield begin, block
