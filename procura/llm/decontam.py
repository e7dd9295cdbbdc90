"""Benchmark decontamination by canonical templates and slot consistency."""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm.common import cut, pieces, table, text_key, utf8

WINDOW = 8  # words, or tokens of a template
MIN_LITERALS = 4  # of a template window or segment; below that, only its words identify it
MIN_SEGMENT = 4  # tokens of a consistent segment that counts towards coverage
RUN = 13  # words in a row that make a leak, or the whole item if it is shorter
COVERED = 0.6  # of an item's words in runs, which make one too
#: Words of 64 bits of the filter before the join, at most: 32 MB on a worker, whatever the benchmark.
MOST_BLOCKS = 1 << 22

# Number words and units that become typed slots.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs hz khz mhz ghz w kw v a j kj cal kcal pa bar c f k "
    "kb mb gb tb percent degrees dollars cents euros pounds inches feet yards miles meters metres kilometers kilometres "
    "grams kilograms liters litres seconds minutes hours days weeks months years mph kph"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3  # what a word may be by itself; NAME and UNIT depend on what is before
WORDS, PLAIN, BOLD = 0, 1, 2  # streams: words as they are; templates in which a sentence's first word is none, or may be a name
_NUM = re.compile(rb"[+-]?[$\xc2\xa3\xe2\x82\xac]*\d[\d.,:/]*%?$")
_GLUED = re.compile(rb"([+-]?\d[\d.,]*)([A-Za-z\xc2\xb5%]+)$")
_NUMBERS = {w.encode() for w in NUMBER_WORDS}
_UNITS = {w.encode() for w in UNITS} | {b"%"}
_EDGE = b".,;:!?\"'()[]{}"
_NUMERIC = set(b"+-$0123456789\xc2\xe2")  # how a number may begin
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)
#: Two-byte capitals of Latin-1.
_WIDE_CAPITALS = {chr(c).encode() for c in range(0xC0, 0xDF) if c != 0xD7}


class Lexicon:
    """Numbers words as they come and keeps, by number, what a template needs; forgets all when it has grown large."""

    def __init__(self, most: int = 400_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.flags = bytearray()  # what the word may be, whether a sentence ends there, whether punctuation follows
        self.hash = array("Q")

    def number(self, word: bytes) -> int:
        core = word.strip(_EDGE)
        low = core.lower()
        kind = _KINDS.get(low, LITERAL)
        if not kind and core:
            first = core[0]
            if 65 <= first <= 90 or (first == 0xC3 and core[:2] in _WIDE_CAPITALS):
                kind = NAME
            elif first in _NUMERIC and (_NUM.match(core) or _GLUED.match(core)):
                kind = NUMBER
        self.flags.append(kind | _AFTER[word[-1]])
        self.hash.append(xxhash.xxh64_intdigest(low or word))
        i = self.ids[word] = len(self.hash) - 1
        return i


_ENDS, _SHUT = 4, 8
_AFTER = bytes((_ENDS if x in b".!?:" else 0) | (_SHUT if x in _EDGE else 0) for x in range(256))
_KINDS = {**dict.fromkeys(_UNITS, UNIT), **dict.fromkeys(_NUMBERS, NUMBER)}


@dataclass
class Stream:
    """Tokens of a text: hash in a template, slot or not, a name that begins a sentence or not, and the words they span."""

    raw: np.ndarray
    template: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @cached_property
    def value(self) -> np.ndarray:
        """Hash of the words of each token."""
        return np.add.reduceat(self.raw, self.start) if len(self.start) < len(self.raw) else self.raw


def streams(text: bytes, lex: Lexicon) -> list[Stream]:
    """The three streams of a text, by ``WORDS``, ``PLAIN`` and ``BOLD``.

    Hashes of words leave case and outer punctuation out.  In a template a number is a slot, a unit is one after a
    number, and a capitalised word is a name; names or numbers in a row, with no punctuation between, are one slot.
    """
    words = text.split()
    if len(lex.ids) > lex.most:
        lex.clear()
    get, new = lex.ids.get, lex.number
    found = list(map(get, words))
    if None in found:
        found = [i if i is not None else j if (j := get(w)) is not None else new(w) for w, i in zip(words, found)]
    at = np.array(found, np.int64)
    n = len(at)
    if not n:
        none = np.empty(0, np.uint64)
        return [Stream(none, none, none == 1, none == 1, none.astype(int), none.astype(int))] * 3
    raw = np.frombuffer(lex.hash, np.uint64)[at]
    flags = np.frombuffer(lex.flags, np.uint8)[at]
    bold = flags & 3
    unit = np.flatnonzero(bold == UNIT)
    bold[unit[(unit == 0) | (bold[unit - 1] != NUMBER)]] = LITERAL
    begins = np.flatnonzero(np.concatenate(([True], (flags[:-1] & _ENDS) > 0)) & (bold == NAME))
    plain = bold.copy()
    plain[begins] = LITERAL
    open_ = flags[:-1] < _SHUT
    place, off = np.arange(n), np.zeros(n, bool)
    out = [Stream(raw, raw, off, off, place, place + 1)]
    for slot in (plain, bold):
        if slot is bold and not len(begins):
            out.append(out[PLAIN])
            break
        goes_on = (slot[1:] == slot[:-1]) & ((slot[1:] == NUMBER) | (slot[1:] == NAME)) & open_
        head = np.flatnonzero(np.concatenate(([True], ~goes_on)))
        s = slot[head]
        first = np.zeros(len(head), bool)
        if slot is bold:
            first[np.searchsorted(head, begins, "right") - 1] = True
        out.append(Stream(raw, np.where(s > 0, _SLOTS[s], raw[head]), s > 0, first, head, np.append(head[1:], n)))
    return out


def _rolled(x: np.ndarray, size: int, salt: int) -> np.ndarray:
    m = len(x) - size + 1
    if m < 1:
        return np.empty(0, np.uint64)
    # By doubling: a window of 2, 4, 8 from two of half its size.
    h, wide, power = x + np.uint64(salt), 1, int(_MULT)
    while wide < size:
        more = min(wide, size - wide)  # the second half may overlap the first
        h = h[: len(h) - more] * np.uint64(power) + h[more:]
        wide, power = wide + more, (power * power * int(_MULT)) & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sums(x: np.ndarray) -> np.ndarray:
    """Number of true values in each window."""
    c = np.concatenate(([0], np.cumsum(x)))
    return c[WINDOW:] - c[:-WINDOW]


def windows(found: list[Stream], sizes: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(stream, hashes, places)``: windows of words of all ``sizes``, and those of templates that have a slot and
    ``MIN_LITERALS`` literal tokens; of ``BOLD`` ones only those that differ from ``PLAIN`` ones."""
    out = []
    for size in sizes:
        h = _rolled(found[WORDS].template, size, size)
        out.append((WORDS, h, np.arange(len(h))))
    for stream in (PLAIN, BOLD):
        t = found[stream]
        if len(t.slot) < WINDOW:
            continue
        slots = _sums(t.slot)
        good = (slots > 0) & (slots <= WINDOW - MIN_LITERALS)
        if stream == BOLD:
            if not t.first.any():
                continue
            good &= _sums(t.first) > 0
        at = np.flatnonzero(good)
        if len(at):
            out.append((stream, _rolled(t.template, WINDOW, 99)[at], at))
    return out


def _runs(ok: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def verified(doc: list[Stream], item: list[Stream], hits: set[tuple[int, int, int, int]]) -> tuple | None:
    """``(kind, words hit, covered share, longest run, start, stop)`` of the item's leak, None if there is none.

    ``hits`` are matched windows: the text's stream and place, the item's stream and place.  Each grows along its
    diagonal as far as tokens agree.  Equal words count by themselves.  Template runs count as far as the values in
    their slots stand for each other one to one over all runs of the item: of pairs that contradict each other the one
    seen more often holds (then the earlier), and a run is cut at the tokens of the others.
    """
    n = len(item[WORDS].value)
    diagonals = sorted({(ds, bs, at - place) for ds, at, bs, place in hits})
    seen: dict[tuple[int, int, int], np.ndarray] = {}
    for ds, at, bs, place in hits:
        seen.setdefault((ds, bs, at - place), np.zeros(len(item[bs].value) + 1, bool))[place] = True
    equal, template, pairs = np.zeros(n, bool), [], Counter()
    best = (0, 0, 0)  # run, start, stop
    for ds, bs, shift in diagonals:
        d, b = doc[ds], item[bs]
        low, high = max(0, -shift), min(len(b.value), len(d.value) - shift)
        mine, theirs = slice(low + shift, high + shift), slice(low, high)
        same = d.value[mine] == b.value[theirs]
        ok = same if ds == bs == WORDS else same | ((d.template[mine] == b.template[theirs]) & d.slot[mine] & b.slot[theirs])
        for s, e in _runs(ok):
            if not seen[ds, bs, shift][low + s : low + e].any():
                continue
            if ds == bs == WORDS:
                if e - s >= min(WINDOW, n):
                    equal[low + s : low + e] = True
                    best = max(best, (e - s, -(low + s + shift), low + e + shift))
                continue
            template.append((d, b, low + s, low + e, shift))
            for i in np.flatnonzero(b.slot[low + s : low + e]) + low + s:
                pairs[int(b.value[i]), int(d.value[i + shift])] += 1
    if best[0] >= min(RUN, n) or (equal.sum() >= WINDOW and equal.mean() >= COVERED):
        return "verbatim", int(equal.sum()), float(equal.mean()), best[0], -best[1], best[2]
    here, there = {}, {}
    for (x, y), _ in pairs.most_common():  # ties in order of appearance
        if x not in here and y not in there:
            here[x], there[y] = y, x
    hit, best = equal.copy(), (0, 0, 0)
    for d, b, s, e, shift in template:
        slot = b.slot[s:e]
        fits = np.ones(e - s, bool)
        fits[slot] = [here.get(int(x)) == int(y) for x, y in zip(b.value[s:e][slot], d.value[s + shift : e + shift][slot])]
        for f, l in _runs(fits):
            if l - f < MIN_SEGMENT or l - f - int(slot[f:l].sum()) < MIN_LITERALS:
                continue
            first, last = s + f, s + l - 1
            hit[b.start[first] : b.stop[last]] = True
            best = max(best, (int(b.stop[last] - b.start[first]), -int(d.start[first + shift]), int(d.stop[last + shift])))
    if best[0] >= min(RUN, n) or (hit.sum() >= WINDOW and hit.mean() >= COVERED and best[0]):
        return "template", int(hit.sum()), float(hit.mean()), best[0], -best[1], best[2]
    return None


# --- the join ---------------------------------------------------------------------------------------------------------
def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types)], schema=schema)


_WINDOWS = pa.schema(
    [("item_id", pa.int64()), ("th", pa.binary()), ("size", pa.int32()), ("h", pa.int64()), ("bs", pa.int32()), ("place", pa.int32())]
)


def _item_windows(batches):
    lex = Lexicon()
    for b in pieces(batches):
        out = []
        for item_id, th, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            found = streams(text, lex)
            size = min(WINDOW, len(found[WORDS].value))
            for stream, h, at in windows(found, [size] if size else []):
                out += [(item_id, th, size, x, stream, p) for x, p in zip(h.view(np.int64).tolist(), at.tolist())]
        yield _table(out, _WINDOWS)


def _blocked(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a hash is in, and its four bits there."""
    u = h.view(np.uint64)
    mask = np.zeros(len(u), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((u >> np.uint64(6 * k)) & np.uint64(63))
    return (u >> np.uint64(64 - bits)).astype(np.int64), mask


def _blocks(bits: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                block, mask = _blocked(b.column(0).to_numpy(zero_copy_only=False), bits)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], ["block", "mask"])

    return run


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.binary()), ("h", pa.list_(pa.int64())), ("ds", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))]
)


def _finder(held):
    """Texts with windows that pass the filter, and those windows."""

    def run(batches):
        bits, words, sizes = held.value
        lex = Lexicon()
        for b in pieces(batches):
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hs, ds, ats = [], [], []
                for stream, h, at in windows(streams(text, lex), sizes):
                    # One bit of the four first, which few windows have.
                    word = words[(h >> np.uint64(64 - bits)).astype(np.int64)]
                    near = np.flatnonzero((word >> (h & np.uint64(63))) & np.uint64(1))
                    if len(near):
                        mask = _blocked(h[near], bits)[1]
                        near = near[(word[near] & mask) == mask]
                    if len(near):
                        hs += h[near].view(np.int64).tolist()
                        ds += [stream] * len(near)
                        ats += at[near].tolist()
                if hs:
                    out.append((doc_id, text, hs, ds, ats))
            yield _table(out, _FOUND)

    return run


_LEAKS = pa.schema(
    [("row", pa.int64()), ("same", pa.int64()), ("doc_id", pa.int64()), ("th", pa.binary()), ("item_id", pa.int64()), ("kind", pa.string())]
    + [(n, pa.int64()) for n in ("n_items", "n_tokens")]
    + [("covered", pa.float64())]
    + [(n, pa.int64()) for n in ("run", "start", "stop")]
)
SCHEMA = "row long, same long, doc_id long, th binary, item_id long, kind string, n_items long, n_tokens long, covered double, run long, start long, stop long"


def _verify(batches):
    lex, memo = Lexicon(), {}
    for b in pieces(batches, 32):
        out = []
        for row, doc_id, th, text, items in zip(*(b.column(i).to_pylist() for i in range(5))):
            doc = streams(text, lex)
            for it in items:
                if len(memo) > 2_000:
                    memo.clear()
                item = memo.get(it["text"])
                if item is None:
                    item = memo[it["text"]] = streams(it["text"], lex)
                hits = {(x["ds"], x["at"], x["bs"], x["place"]) for x in it["hits"]}
                if found := verified(doc, item, hits):
                    kind, words, *rest = found
                    out.append((row, it["same"], doc_id, th, it["item_id"], kind, it["n_items"], words, *rest))
        yield _table(out, _LEAKS)


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, th, text``: the distinct items that have a word; ``th`` stands for the text."""
    text = utf8(F.col("text"))
    found = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_key(F.col("text")).alias("th"), text.alias("text"))
    return found.distinct()


def members(benchmark: DataFrame) -> DataFrame:
    """``h, item_id, n_items``: which items have the windows that several have; expands ``n_items`` of ``leaks``."""
    w = items_of(benchmark).mapInArrow(_item_windows, "item_id long, th binary, size int, h long, bs int, place int")
    w = w.select("h", "item_id", "th").distinct()
    n = w.groupBy("h").agg(F.count(F.lit(1)).alias("n_items")).where("n_items > 1")
    return w.join(n, "h").select("h", "item_id", "n_items")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    # Equal items are one, under the smallest id.
    id_of = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id")).alias("i")
    items = items_of(benchmark).groupBy("th").agg(id_of, F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    items = cut(items.select("i.item_id", "th", "copies", "text"), "items")
    w = items.select("item_id", "th", "text").mapInArrow(_item_windows, "item_id long, th binary, size int, h long, bs int, place int")
    w = cut(w, "item-windows")
    counts = w.select("h", "th").distinct().join(items.select("th", "copies"), "th").groupBy("h").agg(F.sum("copies").alias("n_items"))
    counts = cut(counts, "window-counts")
    n = counts.count()
    sizes = [r[0] for r in w.select("size").distinct().collect()]  # eight at most
    bits = max(10, min(MOST_BLOCKS.bit_length() - 1, n.bit_length() + 1))
    words = np.zeros(1 << bits, np.uint64)
    if n:
        of = counts.select("h").mapInArrow(_blocks(bits), "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
        words[of.column(0).to_numpy()] = of.column(1).to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast((bits, words, sorted(sizes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    found = rows.mapInArrow(_finder(held), "doc_id long, text binary, h array<long>, ds array<int>, at array<int>")
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "found")  # numbered once, as written
    hits = found.select("row", F.inline(F.arrays_zip("h", "ds", "at"))).join(w.join(counts, "h"), "h")
    by_item = hits.groupBy("row", "item_id", "th").agg(
        F.array_sort(F.collect_list(F.struct("ds", "at", "bs", "place"))).alias("hits"), F.min("n_items").alias("n_items")
    )
    # Items that have the same windows of a text in the same order, wherever in the item they begin.
    low = F.array_min(F.transform("hits", lambda x: x["place"]))
    pattern = F.transform("hits", lambda x: F.struct(x["ds"], x["at"], x["bs"], x["place"] - low))
    by_item = cut(by_item.withColumn("same", F.xxhash64(pattern)), "item-hits")
    least = F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "th")).alias("i")
    first = cut(by_item.groupBy("row", "same").agg(least, F.count(F.lit(1)).alias("c")).select("row", "same", "i.th", "c"), "first-items")

    def judged(some: DataFrame) -> DataFrame:
        whole = some.join(items.select("th", F.col("text").alias("of")), "th")
        it = F.struct("item_id", F.col("of").alias("text"), "n_items", "same", "hits")
        by_row = whole.groupBy("row").agg(F.collect_list(it).alias("items"))
        return found.join(by_row, "row").select("row", "doc_id", text_key(F.col("text")).alias("th"), "text", "items").mapInArrow(_verify, SCHEMA)

    one = cut(judged(by_item.join(first.select("row", "same", "th"), ["row", "same", "th"], "left_semi")), "first-leaks")
    # A run of RUN equal words makes a leak of each item that has it, and one row says so.  What else the items of a
    # pattern are, their lengths and values decide: each of them is judged.
    settled = one.where((F.col("kind") == "verbatim") & (F.col("run") >= RUN)).select("row", "same")
    open_ = first.where("c > 1").join(settled, ["row", "same"], "left_anti").select("row", "same", F.col("th").alias("judged"))
    rest = by_item.join(open_, ["row", "same"]).where("th <> judged").drop("judged")
    return one.union(judged(rest)).drop("row", "same")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item it leaks.

    Words become templates: numbers, units after numbers and names are typed slots, several words in a row one slot.
    Windows of eight words and of eight template tokens are hash-joined with those of all items.  Items that have the same
    windows of a text in the same order, and a run of 13 equal words by them, are one row under the smallest id, so that a
    preamble of many items is one (``n_items`` of them have the rarest window of the match); ``members`` expands them.
    Every other item is judged by itself, also if all its windows are another's.
    Matches grow along their diagonals, token by token; see ``verified`` for slots.  An item leaks if a run has 13
    words or the whole item, or if runs cover 60 % of it.  Items of under eight words leak whole and word for word.

    A filter of a bounded size keeps windows of no item out of the join; what passes it by chance meets nothing there.
    Returns ``doc_id, item_id, kind`` (verbatim, or template: other values in its slots), ``n_items, n_tokens`` (words
    hit), ``covered, run, start, stop`` (of the longest run, in words).  Null, empty and clean texts have no row;
    repeated rows repeat; a null item_id is an item like any other, equal items count once; other columns are ignored;
    an empty table on either side gives an empty one.
    """
    return _leaks(docs, benchmark).drop("th")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaks: rows go by id and text, so that equal rows go together.

    Null and empty texts stay, repeated rows stay repeated.  What leaks is written first, so that the join knows its size.
    """
    found = _leaks(docs, table(spark, sf_dir, "benchmark"))
    gone = cut(found.select("doc_id", "th").distinct(), "leaks").alias("g")
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").alias("d")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (text_key(F.col("d.text")) == F.col("g.th"))
    return d.join(gone, on, "left_anti")
