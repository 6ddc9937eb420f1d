"""Operator 8: line dedup by a segment-partition edit join, in DataFrame operations only.

Equal lines are one line, known by a hash. Lines of at least ``min_chars`` characters are also joined if
few edits (insertions, deletions, substitutions) turn one into the other: at most k, which grows with the shorter line's
length. k + 1 segments of a line are indexed. At most k edits leave a segment i with i edits at most before it and k - i behind
it, so the other line has its text at most i characters from its place as counted from the line's beginning, or k - i as counted from the end.
Segments of the first half are counted from the beginning, the others from the end, and a line probes all those places. Where segments lie
depends on the greatest power of two within the length, so that lengths need no probes of their own, but for lines so little longer
than a power of two that the other may be below it.

Most keys are of one line alone, and nothing is kept of them. Lines that meet under a key are compared by counts of frequent characters
before they become candidates: an edit changes two of these counts at most. A key of very many lines is divided by length, and what is left
into blocks. Candidates are verified on the whole lines by a banded edit distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed
from .components import components

#: Characters of a line (by the greatest power of two within its length) for each edit; shorter lines may have one.
CHARS_PER_EDIT = 64
#: Keys with more pairs than this are divided.
HOT_PAIRS = 4096
#: Characters of length that a divided key spans, at least; indexed lines of a block of it.
SPAN, BLOCK = 16, 4096
#: Characters that are counted, in two numbers of 15 counts of four bits.
COUNTED = ("etaoinsrhldcumf", "pgwb 0123456789")
#: Ids that are broadcast at most; beyond that a shuffled join gives the same rows.
MAX_BROADCAST_IDS = 1_000_000
#: A line of more copies has its keys made for the first only.
COPIES = 256
#: Characters that make no word.
BLANK = " \t\n\x0b\x0c\r"


def _has_word(line: Column) -> Column:
    return F.octet_length(F.ltrim(line, F.lit(BLANK))) > 0


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``place``, ``line``, and the hashes ``h`` and ``g`` of the lines with a word; null ids and texts have none."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(_has_word(F.col("line")))
    return lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.hash("line", F.lit(1)))


def _base(size: Column) -> Column:
    """The greatest power of two that is at most ``size``."""
    return F.pow(F.lit(2.0), F.length(F.bin(size)) - 1).cast("int")


def edits_of(size: Column, max_edits: int) -> Column:
    """The edits that lines may differ by, of which the shorter has ``size`` characters."""
    return F.least(F.greatest(F.floor(_base(size) / CHARS_PER_EDIT).cast("int"), F.lit(1)), F.lit(max_edits))


def _levels(max_edits: int) -> list[int]:
    """The values that ``edits_of`` can have."""
    return sorted({min(1 << i, max_edits) for i in range(max_edits.bit_length() + 1)})


def _key() -> tuple[Column, Column]:
    """Hash of the segment ``part``, ``moved`` characters from its place, and whether the line has one there."""
    base, edits, part, size = F.col("base"), F.col("edits"), F.col("part"), F.col("size")
    width = F.floor(base / (edits + 1)).cast("int")
    # Places behind the middle are counted from the end.
    first = F.when(2 * part <= edits, width * part).otherwise(size - width * (edits + 1 - part)) + F.col("moved")
    # Bytes are found at once where they are characters; a segment has the same hash either way.
    taken = F.when(F.col("ascii"), F.substring(F.col("line").cast("binary"), first + 1, width)).otherwise(F.substring("line", first + 1, width).cast("binary"))
    return F.xxhash64(base, part, taken), (first >= 0) & (first + width <= size)


def _chosen(lists: dict[int, list[tuple[int, ...]]], names: str) -> Column:
    """Of lists of number tuples, as structs of the fields ``names``, that of the row's ``edits``."""
    table = [F.when(F.col("edits") == edits, F.from_json(F.lit(str([dict(zip(names.split(), x, strict=True)) for x in rows]).replace("'", '"')), f"array<struct<{','.join(n + ':int' for n in names.split())}>>")) for edits, rows in lists.items()]
    return F.explode(F.coalesce(*table))


def _indexed_and_probed(edits: int) -> list[tuple[int, int]]:
    """Segments, and how far from their places they are looked for."""
    return [(part, moved) for part in range(edits + 1) for moved in range(-min(part, edits - part), min(part, edits - part) + 1)]


def _counts(line: Column, characters: str) -> Column:
    """How often a line has each of 15 characters, modulo 16, in four bits each."""
    size = F.octet_length(line)
    each = [F.shiftleft((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(15), 4 * i) for i, c in enumerate(characters)]
    return reduce(Column.bitwiseOR, each)


def _gains(left: Column, right: Column) -> tuple[Column, Column]:
    """How many of the counted characters one line has more than the other, each way, modulo 16 for each character."""
    tops, rest, low = 0x888888888888888, 0x777777777777777, 0x0F0F0F0F0F0F0F0F
    # Four bits are subtracted from four bits, all at once: the top ones are kept apart, so that nothing is borrowed.
    minus = (left.bitwiseOR(tops) - right.bitwiseAND(rest)).bitwiseXOR(F.bitwise_not(left.bitwiseXOR(right)).bitwiseAND(tops))
    top = minus.bitwiseAND(tops)
    below_zero = top.bitwiseOR(top - F.shiftright(top, 3))
    # The remainder by 255 of a number is that of the sum of its bytes.
    total = lambda x: (x.bitwiseAND(low) + F.shiftright(x, 4).bitwiseAND(low)) % 255
    return total(minus.bitwiseAND(F.bitwise_not(below_zero))), total(minus.bitwiseXOR(below_zero).bitwiseAND(below_zero)) + F.bit_count(top)


def _pairs(index: DataFrame, other: DataFrame, *keys: str, texts: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` of an indexed line and one that probes or is indexed too, under the keys, of different ``part``, and of lengths and counts that allow it.

    A pair is made under the first key that the line of lower hash is indexed by, or else the other one, and that both have: ``indexed_keys``
    and ``every`` are a line's keys, ``before`` the indexed ones before the row's. With ``texts``, rows have ``line``, and pairs of more edits are left out.
    """
    values = ["h", "size", "low", "high", "part", *keys, *([] if texts is None else ["line"])]
    index = index.select(*[F.col(c).alias(f"{c}_a") for c in values], "edits", "before", F.col("every").alias("every_a"))
    other = other.select(*[F.col(c).alias(f"{c}_b") for c in values], F.col("probe").alias("probe_b"), "indexed_keys", F.col("every").alias("every_b"))
    same = reduce(Column.__and__, [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys])
    gains = [_gains(F.col(f"{n}_a"), F.col(f"{n}_b")) for n in ("low", "high")]
    near = [F.abs(F.col("size_a") - F.col("size_b")) <= F.col("edits"), *[x + y <= F.col("edits") for x, y in zip(*gains, strict=True)]]
    once = [(F.col("h_a") < F.col("h_b")) | (F.col("probe_b") & ~F.arrays_overlap("indexed_keys", "every_a")), ~F.arrays_overlap("before", "every_b")]
    # Spark's own distance, which stops at a threshold, drops the rest of most pairs of hot keys inside the join.
    close = [F.levenshtein("line_a", "line_b", k) >= 0 for k in ([] if texts is None else [texts])]
    found = index.join(other, reduce(Column.__and__, [same, F.col("part_a") != F.col("part_b"), *near, *once, *close]))
    return found.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b"))


def _divided_pairs(keyed: DataFrame, max_edits: int) -> DataFrame:
    """``_pairs`` of hot keys, by spans of length and blocks: an indexed row is in one of each, and is looked for from all where it can be."""
    wide, size = max(SPAN, 2 * max_edits), F.col("size")
    spans = F.array_distinct(F.array(F.floor((size - max_edits) / wide), F.floor((size + max_edits) / wide)))
    blocks = F.ceil(F.col("indexed") / BLOCK)
    index = keyed.where(~F.col("probe")).select("*", F.floor(size / wide).alias("span"), F.pmod("h", blocks).alias("block"))
    other = keyed.select("*", F.explode(spans).alias("span")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    return _pairs(index, other, "key", "span", "block", texts=max_edits)


def _led_pairs(keyed: DataFrame) -> DataFrame:
    """``_pairs`` of each hot key's leader, the indexed line that most hot keys have, with its other lines."""
    often = keyed.groupBy(F.col("h").alias("line_h")).agg(F.count(F.lit(1)).alias("times"))
    indexed = keyed.where(~F.col("probe")).join(often, F.col("h") == F.col("line_h"))
    leaders = indexed.groupBy("key").agg(F.max(F.struct("times", "h", "size", "low", "high", "part", "edits", "before", "every")).alias("top")).select("key", "top.*")
    return _pairs(leaders, keyed.withColumn("probe", F.lit(True)), "key")


def _counted(keyed: DataFrame) -> DataFrame:
    """Keys under which different lines meet, their indexed rows and the number of their pairs."""
    indexed = F.sum(F.when(F.col("probe"), 0).otherwise(1))
    counts = keyed.groupBy("key").agg(indexed.alias("indexed"), F.count(F.lit(1)).alias("n"), F.min("h").alias("first"), F.max("h").alias("last"))
    return counts.where("indexed > 0 and first < last").select(F.col("key").alias("met"), "indexed", (F.col("indexed") * F.col("n")).alias("pairs"))


def _met(keyed: DataFrame) -> DataFrame:
    """The rows (``key``, ``mark``, ``h``) of keys under which different lines meet, one of them indexed, each once.

    Rows are dealt by key once: the tasks that find the keys that meet read them again for the rows, as most keys are of one line.
    """
    dealt = keyed.repartition("key")
    keys = dealt.groupBy(F.col("key").alias("met")).agg(F.min("h").alias("first"), F.max("h").alias("last"), F.min(F.col("mark").bitwiseAND(1)).alias("probes")).where("first < last and probes = 0")
    return checkpointed(dealt.join(keys.select("met").hint("shuffle_hash"), F.col("key") == F.col("met")).drop("met").distinct())


def _some(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Each line of ``ids`` (``id``) once, with its text."""
    ids = checkpointed(ids.distinct())
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return checkpointed(lines.select("h", "line").join(ids, F.col("h") == F.col("id"), "left_semi").dropDuplicates(["h"]))


def within_edits(left: Column, right: Column, edits: int) -> Column:
    """Whether at most ``edits`` edits (4 at most) turn one string into the other; null if one is null.

    A band of ``2 * edits + 1`` diagonals suffices: after j characters of ``right``, j - edits to j + edits of ``left`` are used. The state has a bit for each
    diagonal and number of edits, a level of bits for each number. A character of ``right`` comes as the mask of the diagonals on
    which ``left`` has it, for all levels, so that one step treats the whole band at once.
    """
    wide, levels = 2 * edits + 1, edits + 1
    if wide * levels > 63:
        raise ValueError("the band has more bits than a number: at most 4 edits")

    def all_levels(bits: int) -> int:
        return sum(bits << wide * k for k in range(levels))

    number = lambda bits: F.lit(bits).cast("long")
    every, but_first = (number(all_levels(b)) for b in ((1 << wide) - 1, (1 << wide) - 2))

    def only_left(n: int) -> Callable[[Column], Column]:
        stay = number(all_levels((1 << wide - n) - 1))
        return lambda state: state.bitwiseOR(F.shiftleft(state.bitwiseAND(stay), n * (wide + 1))).bitwiseAND(every)

    def after(characters: Column) -> Column:
        def mask(c: Column, place: Column) -> Column:
            return reduce(Column.__add__, [F.when(F.get(characters, place + (d - edits)) == c, number(all_levels(1 << d))).otherwise(number(0)) for d in range(wide)])

        def step(state: Column, found: Column) -> Column:
            moved = F.shiftleft(state.bitwiseOR(F.shiftright(state.bitwiseAND(but_first), 1)), wide)
            out = F.array(state.bitwiseAND(found).bitwiseOR(moved).bitwiseAND(every))
            # A lambda variable holds what up to twice as many characters of the left are passed from.
            for k in range(edits.bit_length()):
                out = F.transform(out, only_left(1 << k))
            return F.get(out, 0)

        masks = F.transform(F.array_remove(F.split(right, ""), ""), mask)
        begin = sum(1 << wide * k + edits + k for k in range(levels))
        return F.aggregate(masks, number(begin), step)

    # A lambda variable holds the split line, which would be split again for each character else.
    state = F.get(F.transform(F.array(F.split(left, "")), after), 0)
    longer = F.length(left) - F.length(right)
    reached = F.call_function("shiftleft", number(all_levels(1)), longer + edits)
    return (F.abs(longer) <= edits) & (state.bitwiseAND(reached) > 0)


def edit_links(lines: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    """Pairs ``a``, ``b`` of hashes of different lines (``h``, ``line``) of at least ``min_chars`` characters within the edits that their lengths allow.

    Of the lines under a hot key some pairs are left out, but none that these links don't connect.
    """
    long = lines.where(F.length("line") >= min_chars)
    size, line = F.length("line"), F.col("line")
    base = _base(size)
    lower = F.floor(base / 2).cast("int")
    levels = _levels(max_edits)
    own = F.struct(base.alias("base"), edits_of(size, max_edits).alias("edits"), F.lit(False).alias("below"))
    less = F.struct(lower.alias("base"), edits_of(lower, max_edits).alias("edits"), F.lit(True).alias("below"))
    sides = F.when((size - edits_of(lower, max_edits) < base) & (size > min_chars), F.array(own, less)).otherwise(F.array(own))
    sided = long.select("h", "line", size.alias("size"), (size == F.octet_length("line")).alias("ascii"), F.explode(sides).alias("s")).select("h", "line", "size", "ascii", "s.*")
    placed = sided.select("*", _chosen({e: _indexed_and_probed(e) for e in levels}, "part moved").alias("k")).select("*", "k.part", "k.moved")
    key, there = _key()
    # The bucket and the length are one number, as rows have a word for each column.
    mark = F.col("size").cast("long") * 4 + F.when(F.col("below"), 2).otherwise(0) + F.when(F.col("below") | (F.col("moved") != 0), 1).otherwise(0)
    keyed = _met(placed.where(there).select(key.alias("key"), mark.alias("mark"), "h"))
    bits = F.col("mark").bitwiseAND
    keyed = keyed.select("key", "h", F.shiftright("mark", 2).cast("int").alias("size"), (bits(1) == 1).alias("probe"), (bits(2) == 2).alias("below"))
    met = checkpointed(_counted(keyed))
    open_keys = checkpointed(keyed.join(met, F.col("key") == F.col("met")).drop("met"))
    texts = _some(long, open_keys.select(F.col("h").alias("id")))
    counts = checkpointed(texts.select(F.col("h").alias("id"), *[_counts(line, c).alias(n) for n, c in zip(("low", "high"), COUNTED, strict=True)]))
    own = _base(F.col("size"))
    own = F.when(F.col("below"), F.floor(own / 2).cast("int")).otherwise(own)
    open_keys = checkpointed(open_keys.join(counts, F.col("h") == F.col("id")).drop("id").withColumn("edits", edits_of(own, max_edits)))
    none = F.array().cast("array<long>")
    open_keys = open_keys.select("*", F.col("h").alias("part"), none.alias("before"), none.alias("every"), none.alias("indexed_keys"))
    cold, hot = open_keys.where(F.col("pairs") <= HOT_PAIRS), open_keys.where(F.col("pairs") > HOT_PAIRS)

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("h").alias(n), F.col("line").alias(f"line_{n}")) for n in "ab")
        allowed = edits_of(F.least(F.length("line_a"), F.length("line_b")), max_edits)
        # Spark's own distance, which stops at a threshold, drops most candidates sooner.
        near = F.coalesce(*[F.when(allowed == edits, (F.levenshtein("line_a", "line_b", edits) >= 0) & within_edits(F.col("line_a"), F.col("line_b"), edits)) for edits in levels])
        return checkpointed(checkpointed(pairs.distinct()).join(left, "a").join(right, "b").where(near).select("a", "b"))

    # Lines that a hot key's leader links are joined already; other lines of the key are compared between the parts that it has yet.
    led = verified(_led_pairs(hot))
    parts = components(led)
    split = hot.drop("part").join(parts, F.col("h") == F.col("node"), "left").withColumn("part", F.coalesce("component", "h")).drop("node", "component", "every", "indexed_keys")
    sets = hot.groupBy(F.col("h").alias("line_h")).agg(F.collect_set(F.when(~F.col("probe"), F.col("key"))).alias("indexed_keys"), F.collect_set("key").alias("every"))
    sets = sets.join(texts.select(F.col("h").alias("id"), "line"), F.col("line_h") == F.col("id")).drop("id")
    split = split.join(sets, F.col("h") == F.col("line_h")).withColumn("before", F.filter("indexed_keys", lambda x: x < F.col("key"))).drop("line_h")
    return led.union(verified(_pairs(cold.where(~F.col("probe")), cold, "key").union(_divided_pairs(checkpointed(split), max_edits)))).distinct()


def line_classes(docs: DataFrame, *, min_chars: int = 30, max_edits: int = 4) -> DataFrame:
    """Lines that occur again, exactly or within a few edits: ``h``, ``line_class`` (the smallest hash of the class), ``first`` and ``own`` (``doc_id`` and ``place`` of the
    class's and the line's first occurrence), ``joined`` (whether few edits link it). ``docs``: ``doc_id`` (long), ``text``.
    """
    lines = lines_of(docs)
    distinct = checkpointed(lines.groupBy("h").agg(F.min(F.struct("doc_id", "place")).alias("own"), F.count(F.lit(1)).alias("n"), F.min("g").alias("low"), F.max("g").alias("high")))
    # The keys of a very common line are very common too.
    often = distinct.where((F.col("n") > COPIES) & (F.col("low") == F.col("high"))).select(F.col("h").alias("id"), "own.*").toDF("id", "own_id", "own_place")
    often = F.broadcast(often) if often.count() <= MAX_BROADCAST_IDS else often
    first = lines.join(often, F.col("h") == F.col("id"), "left").where("own_id is null or own_id = doc_id and own_place = place").select(*lines.columns)
    links = checkpointed(edit_links(first, min_chars, max_edits))
    joined = components(links)
    # Different lines of one hash are told by the other, and all stay.
    several = distinct.join(joined, F.col("h") == F.col("node"), "left").where("(n > 1 or node is not null) and low = high")
    placed = checkpointed(several.select("h", "own", F.coalesce("component", "h").alias("line_class"), F.col("node").isNotNull().alias("joined")))
    classes = checkpointed(placed.groupBy(F.col("line_class").alias("c")).agg(F.min("own").alias("first")))
    return checkpointed(placed.join(classes, F.col("line_class") == F.col("c")).select("h", "line_class", "first", "own", "joined"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 30, max_edits: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id``, ``text``) with the lines removed that repeat an earlier line of the corpus, and counts.

    Lines are separated by ``\\n``; those without a word always stay. Of a class of lines that are equal or, from ``min_chars``
    characters on, linked by few edits, the first by ``doc_id`` and place stays. Columns added, in place of any of
    that name: ``n_lines`` (with a word), ``n_removed``, ``n_near`` (removed, and different from the line that
    stays), ``n_joined`` (the document's different lines that few edits link to others). Linked lines differ by one edit at most, or by one for each
    ``CHARS_PER_EDIT`` characters of the greatest power of two within the shorter one's length, but by no more than ``max_edits``. A null text stays null; a null id's
    lines are compared with nothing and stay; rows of one id are one document, so a repeated row keeps and loses the same lines; a text can become empty; an empty table gives no rows.
    """
    added = ("n_lines", "n_removed", "n_near", "n_joined")
    kept = docs.drop(*added)
    # Inner names are of this call alone, whatever columns ``docs`` has.
    ours = {c: f"_line_{uuid.uuid4().hex[:12]}_{c}" for c in ("id", "places", "joined", "near")}
    source = kept.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes = line_classes(source, min_chars=min_chars, max_edits=max_edits)
    # Dealt by document after the join, so that the join may be split where one line is very common, and both groupings are local.
    again = lines_of(source).select("doc_id", "place", "h").join(classes.withColumnRenamed("h", "known"), F.col("h") == F.col("known")).repartition("doc_id")
    gone = F.struct("doc_id", "place") != F.col("first")
    # Different lines of one document that are equal count once.
    per_line = again.groupBy("doc_id", "h").agg(F.collect_set(F.when(gone, F.col("place"))).alias("places"), F.first("joined").alias("joined"), F.first(F.col("own") != F.col("first")).alias("near"))
    removed = per_line.groupBy(F.col("doc_id").alias(ours["id"])).agg(
        F.flatten(F.collect_list("places")).alias(ours["places"]), F.count_if("joined").alias(ours["joined"]), F.sum(F.when(F.col("near"), F.size("places")).otherwise(0)).alias(ours["near"])
    )
    joined = kept.join(checkpointed(removed), F.col("doc_id").cast("long") == F.col(ours["id"]), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    places = F.coalesce(ours["places"], F.array().cast("array<int>"))
    text = F.when(F.size(places) > 0, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(places, i)), "\n")).otherwise(F.col("text").cast("string"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept.columns]
    n_lines = F.size(F.filter(lines, _has_word))
    counts = [n_lines, F.size(places), F.col(ours["near"]), F.col(ours["joined"])]
    return joined.select(*columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in zip(counts, added, strict=True)])
