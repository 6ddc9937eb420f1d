"""Operator 1: cost-balanced packing of tokenised documents into sequences.

A document's cost in a sequence is ``linear * n + quadratic * n * n`` for a piece of n tokens (the
feed-forward and the attention share of a block-diagonal mask). Documents of a group are taken in
descending length; each goes to the sequence of lowest cost so far that still has room for it.
The group's sequences are planned to hold exactly its tokens: as many of ``max_tokens`` as fit and
powers of two for the rest, which need no padding. A document that fits in no open sequence is cut.

A group is a run of documents of one input partition, of bounded tokens, so the operator needs no
shuffle, holds one group in memory, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, WHITE, blocks, span_hashes, text_bounds
from ._text import pieces as slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of text that are tokenised at a time.
BLOCK_BYTES = 1 << 20
#: Rows whose texts are Python objects at a time.
SLICE = 1024
#: Pieces of text whose ids a worker remembers at once.
KNOWN_PIECES = 500_000
_SPACE, _LETTER, _DIGIT, _MARK, _STICKY = range(5)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    kinds[97:123] = _LETTER
    kinds[48:58] = _DIGIT
    kinds[list(WHITE)] = _SPACE
    kinds[128:] = kinds[ord("'")] = _STICKY
    return kinds


KINDS = _byte_kinds()
#: What the last token of a word ends with.
WORD_END = "</w>"
#: Pieces of one word that are tokenised together.
GROUP = 64


def _one_word(piece: str) -> bool:
    """Certainly a single word of the tokenizer: letters of the Latin blocks, or ASCII marks."""
    return piece.isalpha() and max(piece) < "\u0250" or piece.isascii() and not any(c.isalnum() or c == "'" for c in piece)


class PieceTokenizer:
    """Ids of whole texts, from a tokenizer that lower-cases and whose words are a contraction, a run of letters, a digit or a run of marks.

    A text is cut at white space and between an ASCII letter, digit and mark, but never beside an
    apostrophe or a byte above 127, whose words the tokenizer itself must find. The ids of a text are
    those of its pieces, one after another. Pieces are found and hashed by numpy, a block of texts at
    a time; the tokenizer sees only pieces that the worker has not met. Texts that may hold a special
    token are left to the tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._final = np.zeros(max(vocabulary.values()) + 1, bool)
        self._final[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._special = [t.content.lower().encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self._place: dict[int, int] = {}
        self._ids, self._first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, raw: bytes) -> np.ndarray:
        return np.array(self._tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _learn(self, keys: list[int], pieces: list[str], group: int) -> None:
        """Tokenises new pieces, ``group`` at a time; more than one at a time only if each is one word."""
        got = self._tokenizer.encode_batch_fast([" ".join(pieces[i : i + group]) for i in range(0, len(pieces), group)], add_special_tokens=False)
        each = [np.array(x.ids, np.uint32) for x in got]
        sizes = np.array([len(x) for x in each], np.int64)
        if group > 1:
            ends = [np.flatnonzero(self._final[x]) + 1 for x in each]
            if any(len(e) != len(pieces[i * group : (i + 1) * group]) for i, e in enumerate(ends)):
                return self._learn(keys, pieces, 1)
            sizes = np.concatenate([np.diff(e, prepend=0) for e in ends]) if ends else sizes
        base = len(self._first) - 1
        self._place.update(zip(keys, range(base, base + len(keys)), strict=True))
        self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, *each])
        return None

    def _places(self, hashes: np.ndarray, words: Callable[[int], str]) -> np.ndarray:
        """Where the table has these pieces; those not met before are tokenised."""
        if len(self._place) + len(hashes) > KNOWN_PIECES:
            self._forget()
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self._place]
        if new:
            pieces = [words(i) for i in new]
            plain = [_one_word(x) for x in pieces]
            for k in (True, False):
                self._learn([keys[i] for i, p in zip(new, plain, strict=True) if p == k], [x for x, p in zip(pieces, plain, strict=True) if p == k], GROUP if k else 1)
        return np.fromiter(map(self._place.__getitem__, keys), np.int64, len(keys))

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        kind = KINDS[data]
        before = np.concatenate([[_SPACE], kind[:-1]]).astype(np.uint8)
        cut = (kind != before) & (((kind != _STICKY) & (before != _STICKY)) | (before == _SPACE) | (kind == _SPACE))
        edge = np.flatnonzero(cut | (kind == _SPACE))
        starts = edge[kind[edge] != _SPACE]
        ends = np.append(edge, len(data))[np.searchsorted(edge, starts, "right")]
        hashes, sample, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        places = self._places(hashes, lambda i: raw[starts[sample[i]] : ends[sample[i]]].decode("utf-8", "replace"))[which.reshape(-1)]
        sizes = np.diff(self._first)[places]
        ids_before = np.concatenate([[0], np.cumsum(sizes)])
        flat = self._ids[np.arange(ids_before[-1]) + np.repeat(self._first[places] - ids_before[:-1], sizes)].astype("<u4")
        bounds = ids_before[np.searchsorted(starts, text_bounds(texts))]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, text in enumerate(texts):
            if any(s in text.lower() for s in self._special):
                out[i] = self._whole(text)
        return out


@cache
def _tokenizer(path: str) -> PieceTokenizer:
    """One for each worker process, which keeps what it has met from task to task."""
    return PieceTokenizer(path)


def plan(total: int, max_tokens: int) -> np.ndarray:
    """Capacities that hold ``total`` tokens without padding: full sequences, then falling powers of two."""
    rest = total % max_tokens
    return np.array([max_tokens] * (total // max_tokens) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def assign(lengths: np.ndarray, max_tokens: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with these lengths, all at least 1."""
    capacity = plan(int(lengths.sum()), max_tokens)
    room, cost, pieces, opened = capacity.copy(), np.zeros(len(capacity)), [], 0
    left: list[tuple[int, int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n, start = int(lengths[i]), 0
        while n - start >= max_tokens:
            pieces.append((int(i), start, max_tokens, opened, 0))
            room[opened] = 0
            opened += 1
            start += max_tokens
        if start < n:
            left.append((n - start, int(i), start))
    left.sort(key=lambda x: (-x[0], x[1]))
    for n, i, start in left:
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            take = min(n, int(room[s]))
            pieces.append((i, start, take, s, int(capacity[s] - room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            n, start = n - take, start + take
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, group_tokens: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document (``doc_id``, ``text``; other columns are ignored).

    Columns: ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32``
    (of its ids as little-endian unsigned 32-bit numbers), ``doc_tokens`` (with ``end_id``),
    ``sequence_id``, ``offset`` (place in the sequence) and, with ``with_ids``, ``ids`` (array of int).
    A null or empty text is the end id alone; repeated rows and ids are documents of their own; a
    null ``doc_id`` stays null; an empty table gives no rows. ``max_tokens`` is a power of two.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, ids, held, tokens
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            pieces = assign(lengths, max_tokens, linear, quadratic)
            raw = [held[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in pieces]
            columns = [
                pa.array([ids[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array([int(lengths[p[0]]) for p in pieces], pa.int64()),
                pa.array([sequence + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                names.append("ids")
            sequence += 1 + max(p[3] for p in pieces)
            ids, held, tokens = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches, SLICE):
            keys = batch.column("doc_id").to_pylist()
            for begin, texts in blocks(batch.column("text").to_pylist(), BLOCK_BYTES):
                for key, got in zip(keys[begin : begin + len(texts)], tokenizer.many(texts), strict=True):
                    ids.append(key)
                    held.append(got.tobytes() + end)
                    tokens += len(got) + 1
                    if tokens >= group_tokens:
                        yield flush()
        if held:
            yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
