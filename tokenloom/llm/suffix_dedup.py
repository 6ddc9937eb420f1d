"""Operator 3: removal of repeated substrings by column-wise construction of the suffix order of many strings.

A byte goes if it lies in a string of ``WIDTH`` bytes that also starts elsewhere in the collection; bytes in shorter ones, of ``MARK`` bytes, are
counted. Building the suffix order of whole documents one symbol a round would take as many rounds, each over all data, as the longest
document has bytes. So the construction is applied to short strings of one length that line up, after two steps that find them:

1. Winnowing picks anchors, the least hash of ``GRAM`` bytes in each run of ``MARK`` bytes. Equal strings of ``MARK``
   bytes have the same anchor at the same place, so a repeated string is found among the occurrences of one anchor.
   An anchor's context is the bytes that such strings can reach, ``BEFORE`` before it and ``WIDTH`` from it on.
2. Occurrences whose anchor is unique are settled, and equal contexts of an anchor are one, with a count. What is left is one
   context of each kind of the anchors that have several.
3. For these the collection is built by columns, from the last to the first: each round inserts one symbol of every
   context in front, which keeps the suffixes ordered by one stable sort by symbol (the column is the Burrows-Wheeler
   transform's next symbols), and updates the common prefixes of neighbours from the last round's. Where
   neighbours have ``WIDTH`` or ``MARK`` bytes in common, such a string that starts in this column is repeated. Columns are stored
   one after another, and each is read once.

A collection has ``LIMIT`` strings of a group at most, so it needs no files and some 150 MB of memory at most. An anchor of more kinds is divided: strings that start in a range
of columns have the bytes in common that all of them reach, which for the whole range is the anchor, and more for a part of it. So a group's
range is cut into parts, a part's strings are grouped by those bytes, and equal ones are one again, down to a range of a
single start, where the groups themselves tell what is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, written
from ._text import blocks, give_back, mix64
from ._text import pieces as slices

WIDTH, MARK, GRAM = 400, 287, 32
#: Positions at which the anchor of a string can stand in it; bytes of a context before the anchor.
REACH = MARK - GRAM + 1
BEFORE = REACH - 1
#: Starts that are in one range, level by level; each is a multiple of the next.
RANGES = (REACH, 64, 16, 4, 1)
#: Bytes that are winnowed at a time; positions in them take at most 24 bits of a sort key.
SECTION = 1 << 20
#: Strings of a group that are built in one collection; a group of more is divided. Strings that are gathered for a collection of several groups.
LIMIT, TOGETHER = 32_000, 10_000
#: Rows (about 30 bytes each) that are broadcast at most; beyond that a shuffled join gives the same rows.
MAX_BROADCAST_ROWS = 2_000_000
#: Rows of a batch that become Python objects at a time.
SLICE = 1024

_RANDOM = np.random.default_rng(400)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(0, 2**62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(2**64 - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """The first n powers of the base (k = 0) or its inverse (k = 1)."""
    if len(_powers[k]) < n:
        steps = np.full(n, _INVERSE if k else _BASE, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[k][:n]


class Hashes:
    """Hashes of any substrings of some bytes, equal for equal substrings."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        with np.errstate(over="ignore"):
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(0, len(data)), dtype=np.uint64)])

    def of(self, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self._sums[end] - self._sums[begin]) * _power(1, len(self._sums))[begin])


def anchors(hashes: Hashes, starts: np.ndarray) -> np.ndarray:
    """Positions of the anchors of the strings that start at ``starts``, in order."""
    n = hashes.size - GRAM + 1
    if n <= 0 or not len(starts):
        return np.zeros(0, np.int64)
    keys = (hashes.of(slice(0, n), slice(GRAM, n + GRAM)) & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // REACH) * REACH + REACH, _NONE)
    padded[:n] = keys
    rows = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.unique((np.minimum(behind[starts], ahead[starts + REACH - 1]) & np.uint64(0xFFFFFF)).astype(np.int64))


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes to winnow at a time: short texts together, a long one in overlapping sections.

    With them the positions at which strings start, and for each text in them its number, the place of its first byte (which can
    lie before the bytes) and its size.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= SECTION]
    sizes = np.array([len(texts[i]) for i in short], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    some = np.flatnonzero(sizes >= MARK)
    counts = sizes[some] - MARK + 1
    starts = np.arange(int(counts.sum())) + np.repeat(first[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(some) else np.zeros(0, np.int64)
    yield b"".join(texts[i] for i in short), starts, np.array(short, np.int64), first[:-1], sizes
    for i, text in enumerate(texts):
        for begin in range(0, len(text) if len(text) > SECTION else 0, SECTION):
            low = max(0, begin - BEFORE)
            starts = np.arange(begin, max(begin, min(begin + SECTION, len(text) - MARK + 1))) - low
            yield text[low : begin + SECTION + 2 * WIDTH], starts, np.array([i]), np.array([-low]), np.array([len(text)])


def anchored(docs: DataFrame) -> DataFrame:
    """``anchor`` and ``context`` (hashes), ``doc`` (the text's hash), ``n`` (its bytes) and ``pos`` of every anchor; ``docs``: ``doc``, ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            keys = batch.column("doc").to_numpy()
            for begin, texts in blocks(batch.column("text").to_pylist(), SECTION):
                last = {}
                for raw, starts, numbers, first, sizes in _pieces(texts):
                    hashes = Hashes(np.frombuffer(raw, np.uint8))
                    at = anchors(hashes, starts)
                    text = np.searchsorted(first, at, "right") - 1
                    pos, n = at - first[text], sizes[text]
                    if len(numbers) == 1:  # the next section of a text can begin with the last anchor of this one
                        new = pos > last.get(int(numbers[0]), -1)
                        at, text, pos, n = at[new], text[new], pos[new], n[new]
                        last[int(numbers[0])] = int(pos[-1]) if len(pos) else last.get(int(numbers[0]), -1)
                    left, right = np.minimum(pos, BEFORE), np.minimum(n - pos, WIDTH)
                    with np.errstate(over="ignore"):
                        context = mix64(hashes.of(at - left, at + right) + (left * 1000 + right).astype(np.uint64))
                    columns = [hashes.of(at, at + GRAM).view(np.int64), context.view(np.int64), keys[begin + numbers[text]] if len(at) else np.zeros(0, np.int64), n.astype(np.int32), pos.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "doc", "n", "pos"])

    return docs.mapInArrow(run, "anchor long, context long, doc long, n int, pos int")


def repeated_windows(columns: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of ``WIDTH``, and of ``MARK``, symbols that start in a column another string of the same group has at the same place.

    ``columns``: symbols by column and string, 256 where a string has none; ``groups``: sorted. The results have a row
    for each column at which a string of ``WIDTH`` can start. One column is inserted a round, the last first.
    """
    width, m = columns.shape
    out = [np.zeros((width - WIDTH + 1, m), bool) for _ in range(2)]
    order = np.arange(m)
    common = np.zeros(m, np.int32)  # of each suffix and the one before it
    base = groups.astype(np.int64) * 512
    for column in range(width - 1, -1, -1):
        symbols = np.asarray(columns[column])[order]
        keys = base[order] + symbols
        place = np.argsort(keys, kind="stable")
        sorted_keys = keys[place]
        joined = np.zeros(m, bool)
        joined[1:] = (sorted_keys[1:] == sorted_keys[:-1]) & (symbols[place[1:]] < 256)
        # Two suffixes with one symbol in front have in common what all between them had before.
        least = np.minimum.reduceat(np.append(common, 0), np.append(np.minimum(place + 1, m), m))[:-1]
        fresh = np.zeros(m, np.int32)
        fresh[1:] = np.where(joined[1:], np.minimum(least[:-1] + 1, WIDTH), 0)
        order, common = order[place], fresh
        if column <= width - WIDTH:
            for k, size in enumerate((WIDTH, MARK)):
                found = np.flatnonzero(common >= size)
                out[k][column, order[found]] = True
                out[k][column, order[found - 1]] = True
    return out[0], out[1]


def _runs(starts: np.ndarray, size: int) -> np.ndarray:
    """Begins and ends, in turn, of what strings of ``size`` at these places cover."""
    if not len(starts):
        return np.zeros(0, np.int32)
    gap = np.flatnonzero(np.diff(starts) > size)
    return np.column_stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + size]).reshape(-1).astype(np.int32)


def settled(pieces: DataFrame, size: int) -> DataFrame:
    """``group``, ``piece``, ``gone`` and ``seen`` (begins and ends of bytes in repeated strings of ``WIDTH`` and ``MARK``, from the anchor on) of pieces (``group``, ``piece``, ``a``, ``skip``, ``bytes``), but for the ``whole`` ones.

    A piece starts at ``a`` of its context, lacks ``skip`` bytes in front, and holds the strings of ``size`` starts.
    """
    names = ["group", "piece", "gone", "seen"]

    def built(rows: list[tuple[int, int, int, int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
        groups = np.unique([r[0] for r in rows], return_inverse=True)[1].reshape(-1)
        columns = np.empty((size - 1 + WIDTH, len(rows)), np.uint16)
        for begin in range(0, len(rows), 4096):
            part = np.full((min(4096, len(rows) - begin), len(columns)), 256, np.uint16)
            for k, (_, _, _, skip, raw, _) in enumerate(rows[begin : begin + 4096]):
                part[k, skip : skip + len(raw)] = np.frombuffer(raw, np.uint8)
            columns[:, begin : begin + len(part)] = part.T
        found = repeated_windows(columns, groups)
        out = []
        for k in np.flatnonzero(found[1].any(axis=0) & ~np.array([r[5] for r in rows])):
            first = rows[k][2] - BEFORE
            out.append((*rows[k][:2], *[_runs(np.flatnonzero(f[:, k]) + first, n) for f, n in zip(found, (WIDTH, MARK), strict=True)]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())], strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes, bool]] = []
        for batch in slices(batches, SLICE):
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "piece", "a", "skip", "bytes", "whole")), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    # Ordered by group's hash as signed, which is the order of np.unique too.
                    yield from built(held)
                    held = []
                held.append(row)
        if held:
            yield from built(held)
            held = []
            give_back()

    return pieces.repartition("group").sortWithinPartitions("group", "piece").mapInArrow(run, "group long, piece long, gone array<int>, seen array<int>")


def _over_texts(rows: DataFrame, docs: DataFrame, each: Callable[[bytes, dict], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``each`` makes of the text and every row of ``rows`` (``doc``, ``n``, ``pos``, more); equal texts of a task are one."""
    by_doc = written(rows.groupBy("doc", "n").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("doc", "n")])).alias("places")))
    if rows.count() <= MAX_BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in slices(batches, SLICE):
            for doc, n, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "text", "places")), strict=True):
                if (doc, n) in met:
                    continue
                met.add((doc, n))
                raw = text.encode("utf-8", "surrogatepass")
                out = [x for p in places for x in each(raw, p | {"doc": doc, "n": n})]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[part.split()[1]] for part in schema.split(", ")]
    found = docs.withColumn("n", F.octet_length("text")).join(by_doc, ["doc", "n"]).select("doc", "n", "text", "places")
    return found.mapInArrow(run, schema)


def _piece(raw: bytes, pos: int, a: int, size: int) -> tuple[int, bytes]:
    """The bytes that strings of ``size`` starts from ``a`` on reach, and how many are missing in front."""
    begin, end = pos - BEFORE + a, min(pos - BEFORE + a + size - 1 + WIDTH, pos + WIDTH)
    return max(0, -begin), raw[max(0, begin) : max(0, end)]


def bytes_of(pieces: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``group``, ``piece``, ``a``, ``skip``, ``bytes``, ``whole`` (it occurs again) of pieces (``group``, ``piece``, ``times``, ``a``, ``doc``, ``n``, ``pos``) of ``size`` starts."""

    def each(raw: bytes, p: dict) -> Iterator[tuple]:
        yield (p["group"], p["piece"], p["a"], *_piece(raw, p["pos"], p["a"], size), p["whole"])

    rows = pieces.select("group", "piece", "a", "doc", "n", "pos", (F.col("times") > 1).alias("whole"))
    return _over_texts(rows, docs, each, "group long, piece long, a int, skip int, bytes binary, whole boolean")


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def divided(rows: DataFrame, docs: DataFrame, size: int, part: int) -> DataFrame:
    """``rows`` (``anchor``, ``context``, ``times``, ``a``, ``doc``, ``n``, ``pos``) of ``size`` starts cut into ranges of ``part`` starts, with ``group`` and ``piece``."""

    def each(raw: bytes, p: dict) -> Iterator[tuple]:
        pos = p["pos"]
        for a in range(p["a"], p["a"] + size, part):
            first, last = max(pos - BEFORE + a, 0), min(pos - BEFORE + a + part - 1, len(raw) - MARK)
            if first <= last:
                inner = raw[pos - BEFORE + a + part - 1 : pos - BEFORE + a + MARK]
                skip, piece = _piece(raw, pos, a, part)
                yield (_hash(p["anchor"].to_bytes(8, "little", signed=True), bytes([a]), inner), _hash(skip.to_bytes(2, "little"), piece), p["anchor"], p["context"], p["times"], a, p["doc"], p["n"], pos)

    return _over_texts(rows.select("anchor", "context", "times", "a", "doc", "n", "pos"), docs, each, "group long, piece long, anchor long, context long, times long, a int, doc long, n int, pos int").dropDuplicates(["anchor", "context", "a"])


def repeats(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """``anchor``, ``context``, ``gone``, ``seen`` (begins and ends from the anchor on) of contexts (``anchor``, ``context``, ``times``, ``doc``, ``n``, ``pos``) in which a string is repeated."""
    members = kinds.select(F.col("anchor").alias("group"), F.col("context").alias("piece"), "anchor", "context", "times", F.lit(0).alias("a"), "doc", "n", "pos")
    out = []
    for level, size in enumerate(RANGES):
        # At first every context is a piece of its own.
        pieces = members
        if level:
            pieces = written(members.groupBy("group", "piece").agg(F.sum("times").alias("times"), F.min(F.struct("doc", "n", "pos", "a")).alias("at")).select("group", "piece", "times", "at.*"))
        several = written(pieces.groupBy(F.col("group").alias("open")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
        begin = F.greatest(F.col("a") - BEFORE, -F.col("pos"))
        end = F.least(F.col("a") - BEFORE + (size - 1 + WIDTH), F.lit(WIDTH), F.col("n") - F.col("pos"))
        nothing = F.array().cast("array<int>")
        all_of = lambda n: F.when(end - begin >= n, F.array(begin, end).cast("array<int>")).otherwise(nothing)  # noqa: B023, E731
        found = pieces.where("times > 1").select("group", "piece", all_of(WIDTH).alias("gone"), all_of(MARK).alias("seen"))
        compared = written(pieces.join(several, F.col("group") == F.col("open")).drop("open"))
        if size == 1:
            found = found.union(compared.select("group", "piece", nothing, F.array(begin, begin + MARK).cast("array<int>")))
        else:
            found = found.union(settled(bytes_of(compared.where(F.col("kinds") <= LIMIT), docs, size), size))
        if level:
            found = members.select("group", "piece", "anchor", "context").join(found, ["group", "piece"])
        else:
            found = found.withColumnsRenamed({"group": "anchor", "piece": "context"})
        out.append(written(found.select("anchor", "context", "gone", "seen")))
        many = compared.where(F.col("kinds") > LIMIT)
        if size == 1 or many.isEmpty():
            break
        if level:
            many = members.join(many.select("group", "piece"), ["group", "piece"], "left_semi")
        members = written(divided(many, docs, size, RANGES[level + 1]))
        discard(compared, several)
    if len(out) == 1:
        return out[0]
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("gone", "seen")]
    return written(reduce(DataFrame.union, out).groupBy("anchor", "context").agg(*lists))


def _covered(marks: pa.ListArray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs that the spans ``name`` of each row's marks cover: the number of the row, begin and end, in order."""
    rows = np.repeat(np.arange(len(marks)), marks.value_lengths().fill_null(0).to_numpy())
    flat = marks.flatten()
    spans = flat.field(name)
    sizes = spans.value_lengths().to_numpy() // 2
    ends = spans.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
    # A place is a number whose upper bits are the row's, so that all rows are treated at once.
    ends += np.repeat((rows << 40) + flat.field("pos").to_numpy(), sizes)[:, None]
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ends[:, 1])
    first = np.flatnonzero(np.concatenate([[True], ends[1:, 0] > reach[:-1]])) if len(ends) else np.zeros(0, np.int64)
    begin, end = ends[first, 0], reach[np.append(first[1:], len(ends)) - 1] if len(first) else reach
    return begin >> 40, begin & ((1 << 40) - 1), end & ((1 << 40) - 1)


def remove_repeats(docs: DataFrame, *, with_kept: bool = False) -> DataFrame:
    """One row per document (``doc_id``, ``text``; other columns are ignored): ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, ``n_repeated`` and, with ``with_kept``, the bytes ``kept``.

    Strings of 400 bytes are judged on the whole input; one that occurs twice goes at both places, in one document or two. ``n_repeated``: bytes in
    strings of 287 bytes that also start elsewhere, so passages of some 50 words count there that are too short to go.
    Null texts are empty, and texts under 400 bytes stay whole; rows with equal texts repeat each other, whatever their ids;
    a null id stays null; an empty table gives no rows. Contexts of an anchor are known by 64-bit hashes, texts by such a hash and their size.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("doc", F.xxhash64("text"))
    found = written(anchored(source.select("doc", "text")))
    # An anchor that occurs once has no part in what follows. Counts are written before the join, which could not split a common anchor's rows otherwise.
    met = written(found.groupBy(F.col("anchor").alias("met")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("met"))
    every = written(found.join(met, F.col("anchor") == F.col("met"), "left_semi"))
    discard(found)
    # Equal texts give equal rows here, and a pre-aggregated one for each task.
    kinds = written(every.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "n", "pos")).alias("at")).select("anchor", "context", "times", "at.*"))
    covered = repeats(kinds, source).withColumnsRenamed({"anchor": "anchor_c", "context": "context_c"})
    marks = every.join(covered, (F.col("anchor") == F.col("anchor_c")) & (F.col("context") == F.col("context_c"))).select("doc", "n", "pos", "gone", "seen").distinct()
    by_doc = written(marks.groupBy("doc", "n").agg(F.collect_list(F.struct("pos", "gone", "seen")).alias("marks")).withColumnsRenamed({"doc": "d", "n": "m"}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            owner, begin, end = _covered(batch.column("marks"), "gone")
            first = np.searchsorted(owner, np.arange(len(raws) + 1))
            lefts = []
            for raw, a, b in zip(raws, first[:-1], first[1:], strict=True):
                lefts.append(b"".join(raw[x:y] for x, y in zip([0, *end[a:b]], [*begin[a:b], len(raw)], strict=True)) if b > a else raw)
            at, x, y = _covered(batch.column("marks"), "seen")
            seen = np.bincount(at, y - x, len(raws)).astype(np.int64)
            sizes = [np.array([len(r) for r in t], np.int64) for t in (raws, lefts)]
            columns = [batch.column("doc_id"), pa.array(sizes[0]), pa.array(sizes[0] - sizes[1]), pa.array(np.diff(first)), pa.array([hashlib.sha256(t).hexdigest() for t in lefts], pa.string()), pa.array(seen)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lefts, pa.binary())] if with_kept else columns, [*names, "kept"] if with_kept else names)

    final = source.withColumn("n", F.octet_length("text")).join(by_doc, (F.col("doc") == F.col("d")) & (F.col("n") == F.col("m")), "left").select("doc_id", "text", "marks")
    return final.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long" + (", kept binary" if with_kept else ""))
