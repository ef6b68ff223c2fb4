"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over the bytes triggers phrase ends that depend on nothing but the
bytes around them, so equal strings are parsed alike wherever they stand.  Every
place where a repeated string could start belongs to the first trigger after it.  The
places of one trigger make a phrase of the dictionary (the bytes up to the trigger)
with what the parse goes on with (the bytes from the trigger on, as far as the
phrase's strings reach).

1. Phrases whose core (bytes from the trigger on that all their strings share) occurs
   once in the corpus hold no repeat.  A hash decides this: it can only keep too many.
2. A phrase that occurs again together with its whole continuation (by 128 bits of
   BLAKE2) is repeated at all its places.
3. The other phrases' places are classed by their distance to the trigger.  All strings
   of a class share most of their bytes, and a class whose shared bytes occur once,
   again by a hash, holds no repeat.
4. For the classes left, the two suffix arrays are made.  The dictionary's suffixes that
   end at a trigger are ordered by their reversed bytes, and the parse's suffixes by
   theirs, each as far as a string reaches, by a distributed sort.  The longest common
   prefixes of neighbours, taken on the bytes, give for each depth the interval of the
   order that shares it.  Two strings are equal exactly if they stand in the same
   interval of the dictionary's order and in the same one of the parse's; a string
   whose neighbours share too little is in neither.

So a step shuffles a row for a phrase, and a row for a byte only near the ends of
repeats.  Sorted strings are distinct, so one that very many texts share is sorted
once, and different ones that share a long prefix are split by the sort's ranges.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import discard, in_arrow, text_key, text_slices, written

LENGTH = 400
#: Bytes of the rolling hash, and how far before a trigger a place may lie.
ROLL = 16
REACH = 160
#: Bytes of a core at most; such a string that occurs again is reported even if it is too short to go.
CORE = 160
#: A trigger is a hash with so many leading zero bits: phrases of 128 bytes, then finer ones where none is in reach.
TRIGGERS = (7, 5, 2)
#: Classes of a phrase's places by their distance to the trigger.
CLASSES = 4
#: Bytes taken at a time.
PIECE = 1 << 20
#: Bytes of short texts taken together: few enough for the processor's cache.
JOINED = 1 << 16


def reach_of(length: int) -> int:
    """How far before its trigger a place may lie: the trigger has to lie within the string with all the bytes it depends on."""
    if length < 4 * ROLL:
        raise ValueError(f"strings have at least {4 * ROLL} bytes")
    return min(REACH, (length - ROLL) // 2)


def core_of(length: int) -> int:
    return min(CORE, length - reach_of(length) + 1)


def class_of(length: int) -> int:
    """Distances of a class: its strings share all but that many bytes, less one."""
    return -(-reach_of(length) // CLASSES)


@functools.lru_cache(maxsize=2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a polynomial hash: byte values, powers of the base, and powers of its inverse."""
    rng = np.random.default_rng(101)
    values = rng.integers(1 << 62, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 62)) * 8 + 5 & (1 << 64) - 1
    one = np.ones(1, np.uint64)
    grow = lambda b: np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))])
    return values, grow(base), grow(pow(base, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Piece:
    """Prefix hashes of some bytes; any substring's hash then takes one step."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        values, powers, self.inverse = _tables(max(self.n, PIECE + 4096))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values[data] * powers[: self.n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def rolling(self) -> np.ndarray:
        return (self.sums[ROLL:] - self.sums[:-ROLL]) * self.inverse[: max(0, self.n - ROLL + 1)]


def _next(flags: np.ndarray, n: int) -> np.ndarray:
    """For each place up to n, the next flagged one (or far away)."""
    out = np.full(n + 1, 1 << 40, np.int64)
    at = np.flatnonzero(flags)
    out[at] = at
    return np.minimum.accumulate(out[::-1])[::-1]


def phrases(piece: Piece, places: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first place, last place) of each phrase of the places, which ascend."""
    h = piece.rolling()
    trigger = places.copy()
    open_ = np.ones(len(places), bool)
    for bits in TRIGGERS:
        at = _next((h >> np.uint64(64 - bits)) == 0, piece.n)[places]
        use = open_ & (at - places < reach)
        trigger[use] = at[use]
        open_ &= ~use
    if not len(places):
        return places, places, places
    new = np.flatnonzero((trigger[1:] != trigger[:-1]) | (places[1:] != places[:-1] + 1)) + 1
    first, last = np.append(0, new), np.append(new, len(places)) - 1
    return trigger[first], places[first], places[last]


def text_phrases(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(core, trigger, low, high) of the phrases of a whole text, part by part; a core is a hash of what all strings of a phrase share."""
    array, reach, n = np.frombuffer(data, np.uint8), reach_of(length), len(data)
    stop = n - length + 1
    for first in range(0, max(0, stop), PIECE):
        last = min(first + PIECE, stop)
        a, b = max(0, first - reach), min(n, last + length + reach + ROLL)
        piece = Piece(array[a:b])
        t, lo, hi = phrases(piece, np.arange(first - a, last - a), reach)
        yield _mixed(piece.hash(t, t + core_of(length))).view(np.int64), t + a, lo + a, hi + a


def joined_phrases(texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """The number of its text and (core, trigger, low, high) of each phrase of whole texts; short ones are taken together.

    A trigger and all that it depends on lie within the strings before it, so what
    follows a text's end changes nothing.
    """
    reach, held, first, size = reach_of(length), [], 0, 0

    def together() -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        sizes = np.array([len(x) for x in held])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        inside = np.zeros(size + 1, np.int8)
        np.add.at(inside, starts[sizes >= length], 1)
        np.add.at(inside, ends[sizes >= length] - length + 1, -1)
        piece = Piece(np.frombuffer(b"".join(held), np.uint8))
        t, lo, hi = phrases(piece, np.flatnonzero(np.cumsum(inside[:-1])), reach)
        of = np.searchsorted(ends, lo, side="right")
        at = starts[of]
        return of + first, (_mixed(piece.hash(t, t + core_of(length))).view(np.int64), t - at, lo - at, hi - at)

    i = -1
    for i, data in enumerate(texts):
        if held and size + len(data) > JOINED:
            yield together()
            held, size, first = [], 0, i
        if len(data) > JOINED:
            for found in text_phrases(data, length):
                yield np.full(len(found[0]), i), found
            first = i + 1
            continue
        held.append(data)
        size += len(data)
    if held:
        yield together()


def class_hashes(data: bytes, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> list[np.ma.MaskedArray]:
    """For each class, a hash of what its strings of each phrase (t, lo, hi) share; masked where a phrase has no place of the class."""
    array, step = np.frombuffer(data, np.uint8), class_of(length)
    size = length - step + 1
    start = t - np.arange(CLASSES)[:, None] * step
    use = (start >= lo) & (start - step < hi)
    h = np.zeros(start.shape, np.uint64)
    for k in range(0, len(data), PIECE):
        of = use if len(data) <= PIECE else use & (start >= k) & (start < k + PIECE)
        at = start[of] - k
        h[of] = Piece(array[k : k + PIECE + size]).hash(at, at + size)
    h = (_mixed(h) + np.arange(CLASSES, dtype=np.uint64)[:, None]).view(np.int64)
    return [np.ma.MaskedArray(a, ~b) for a, b in zip(h, use, strict=True)]


def packed_places(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A phrase's trigger with its distances to the first and last place, which are under 256, as one long."""
    return t << 16 | t - lo << 8 | t - hi


def unpacked_places(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = place >> 16
    return t, t - (place >> 8 & 255), t - (place & 255)


def _halves(key: Column) -> list[Column]:
    """A 16-byte key as two longs, which stay small in every row."""
    as_long = lambda a: F.conv(F.hex(F.substring(key, a, 8)), 16, -10).cast("long")
    return [as_long(1).alias("k1"), as_long(9).alias("k2")]


def _parsed(rows: DataFrame, length: int) -> DataFrame:
    """The phrases of (k1, k2, text): a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "core", "place"]
        packed = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            size = 0
            k1, k2 = (batch.column(i).to_numpy() for i in range(2))
            for of, (core, *found) in joined_phrases((value.as_buffer().to_pybytes() for value in batch.column(2)), length):
                parts.append([k1[of], k2[of], core, packed_places(*found)])
                size += len(of)
                if size > 200_000:
                    yield packed(parts)
                    parts, size = [], 0
            if parts:
                yield packed(parts)

    return rows.transform(in_arrow, run, "k1 long, k2 long, core long, place long")


def _short(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _emitted(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


HASHES = [f"h{j}" for j in range(CLASSES)]


def _whole(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, copied, t, lo, hi, w1, w2, h0 ...): w1 and w2 stand for each kept phrase of (k1, k2, copied, text, phrases) with all that its strings reach, h0 and so on for what its classes share."""
    names = ["k1", "k2", "copied", "t", "lo", "hi", "w1", "w2", *HASHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.blake2b
        for batch in batches:
            for k1, k2, copied, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                data = text.as_buffer().to_pybytes()
                t, lo, hi = unpacked_places(found.values.to_numpy())
                # the length of the phrase goes into the hash by way of its key
                named = b"".join([digest(data[a:b], digest_size=16, key=c).digest() for a, b, c in zip(lo.tolist(), (hi + length).tolist(), [(x + 1).to_bytes(4) for x in (t - lo).tolist()], strict=True)])
                two = np.frombuffer(named, "<i8").reshape(-1, 2)
                n = len(t)
                columns = [np.full(n, k1), np.full(n, k2), np.full(n, copied), t, lo, hi, two[:, 0].copy(), two[:, 1].copy(), *class_hashes(data, t, lo, hi, length)]
                for i in range(0, n, 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names)

    return rows.transform(in_arrow, run, "k1 long, k2 long, copied boolean, t long, lo long, hi long, w1 long, w2 long, " + ", ".join(f"{h} long" for h in HASHES))


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """What stands on both sides of the trigger of chosen phrases of (k1, k2, text, classes of phrases).

    left is the phrase from the trigger backwards, right the text from the trigger on as
    far as the phrase's strings reach; lh and rh name them.
    """
    names = ["k1", "k2", "t", "lo", "hi", "open", "lh", "rh", "left", "right"]
    types = [*[pa.int64()] * 5, pa.bool_(), *[pa.binary()] * 4]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k1, k2, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_buffer().to_pybytes()
                spans: dict[int, tuple[int, int, bool]] = {}
                for t, lo, hi, open_ in zip(*(found.values.field(i).to_pylist() for i in range(4)), strict=True):  # a row for each class
                    a, b, _ = spans.get(t, (lo, hi, open_))
                    spans[t] = min(a, lo), max(b, hi), open_
                for t, (lo, hi, open_) in spans.items():
                    left, right = data[lo:t][::-1], data[t : hi + length]
                    yield k1, k2, t, lo, hi, open_, _short(left), _short(right), left, right

    return rows.transform(in_arrow, lambda batches: _emitted(each(batches), names, types, 4000), "k1 long, k2 long, t long, lo long, hi long, open boolean, lh binary, rh binary, left binary, right binary")


# --- suffix orders --------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def cut(steps: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
    """(depth, interval) steps as far as a depth; each step's interval holds from the depth before it on."""
    out = []
    for d, i in steps:
        if d >= depth:
            return [*out, (depth, i)] if depth else out
        out.append((d, i))
    return out


def _ordered(strings: DataFrame, name: str) -> tuple[DataFrame, dict[int, tuple[list[int], list[int]]]]:
    """The order of (h, s, n) by s: (h, most, depths, intervals), and the intervals that go on from partition to partition.

    ``most`` is the longest prefix that a neighbour in the order shares; all of s if
    n > 1.  At depth r the string lies in the interval number i whose depth is the
    first not below r; an interval is named by its first string.  A partition does not
    know what stands before it: its first string's own intervals are returned apart,
    worked out on the driver from two strings for each partition.
    """
    spark = strings.sparkSession
    dealt = strings.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").sortWithinPartitions("s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["h", "most", "depths", "intervals", "part", "edge", "s"]
        types = [pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
        part = TaskContext.get().partitionId()
        number = part << 36
        steps: list[tuple[int, int]] = []
        held: list | None = None  # the last string; its next neighbour is not known yet
        out: list[list] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for batch in batches:
            for h, s, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shared = common(held[6], s) if held else 0
                steps = [*cut(steps, shared), (len(s), number)] if len(s) > shared else cut(steps, shared)
                row = [h, len(s) if n > 1 or held is None else shared, [d for d, _ in steps], [i for _, i in steps], part, 0 if held else 1, s]
                number += 1
                if held:
                    held[1] = max(held[1], shared)
                    out.append(held if held[5] else [*held[:6], None])
                    if len(out) >= 4000:
                        yield packed()
                        out.clear()
                held = row
        if held:
            held[1], held[5] = len(held[6]), held[5] | 2  # the neighbour is in the next partition
            out.append(held)
            yield packed()

    done = written(dealt.select("h", "s", "n").transform(in_arrow, run, "h binary, most long, depths array<int>, intervals array<long>, part int, edge int, s binary"), name)
    edges = {(r.part, bit): r for r in done.where("edge > 0").collect() for bit in (1, 2) if r.edge & bit}
    return done, carried(edges)


def carried(edges: dict) -> dict[int, tuple[list[int], list[int]]]:
    """The steps of the first string of each partition, by its number, from the (part, 1) first and (part, 2) last strings."""
    out: dict[int, tuple[list[int], list[int]]] = {}
    before: tuple[bytes, list[tuple[int, int]]] | None = None
    for part in sorted({p for p, _ in edges}):
        first, last = edges[part, 1], edges[part, 2]
        own = part << 36
        steps = [(len(first.s), own)]
        if before:
            shared = common(before[0], first.s)
            steps = cut(before[1], shared) + ([(len(first.s), own)] if len(first.s) > shared else [])
        out[own] = ([d for d, _ in steps], [i for _, i in steps])
        ending = list(zip(last.depths, last.intervals, strict=True))
        if ending and ending[0][1] == own:  # as far as this it lies in the first string's intervals
            ending = cut(steps, ending[0][0]) + ending[1:]
        before = (last.s, ending)
    return out


def interval(depths: list[int], intervals: list[int], carry: dict, depth: int) -> tuple[int, int]:
    """The interval of a string at a depth, and up to which depth it stays in it."""
    at = bisect.bisect_left(depths, depth)
    i, far = intervals[at], depths[at]
    if i in carry:
        own, named = carry[i]
        at = bisect.bisect_left(own, depth)
        i, far = named[at], min(far, own[at])
    return i, far


def shared_runs(depths: tuple[list[int], list[int]], others: tuple[list[int], list[int]], carries: tuple[dict, dict], length: int, first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, d, n): runs of distances d to d + n - 1 between first and last whose strings lie in interval a of one order and b of the other."""
    d = first
    while d <= last:
        a, far = interval(*depths, carries[0], d) if d else (-1, 0)
        b, _ = interval(*others, carries[1], length - d)
        # the other side's depth falls as d grows: its interval holds down to the depth before
        at = bisect.bisect_left(others[0], length - d)
        low = others[0][at - 1] if at else 0
        i = others[1][at]
        if i in carries[1]:
            own = carries[1][i][0]
            k = bisect.bisect_left(own, length - d)
            low = max(low, own[k - 1] if k else 0)
        stop = min(last, far, length - low - 1)
        yield a, b, d, stop - d + 1
        d = stop + 1


def _places(rows: DataFrame, length: int, left_carry: dict, right_carry: dict) -> DataFrame:
    """(a, b, d, k1, k2, p, open): the strings of each phrase that both orders' neighbours may share."""
    names = ["a", "b", "d", "k1", "k2", "p", "open"]

    def packed(runs: list[tuple]) -> pa.RecordBatch:
        a, b, d, n, k1, k2, t, open_ = (np.array(c) for c in zip(*runs, strict=True))
        of = np.repeat(np.arange(len(n)), n)
        each = d[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[of], b[of], each.astype(np.int32), k1[of], k2[of], t[of] - each, open_[of])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carries = (left_carry, right_carry)
        for batch in batches:
            runs: list[tuple] = []
            for k1, k2, t, lo, hi, open_, l_most, l_depths, l_in, r_most, r_depths, r_in in zip(*(batch.column(i).to_pylist() for i in range(12)), strict=True):
                first, last = max(t - hi, length - r_most), min(t - lo, l_most)
                if first <= last:
                    runs += [(*x, k1, k2, t, open_) for x in shared_runs((l_depths, l_in), (r_depths, r_in), carries, length, first, last)]
                    if len(runs) > 5000:
                        yield packed(runs)
                        runs = []
            if runs:
                yield packed(runs)

    return rows.transform(in_arrow, run, "a long, b long, d int, k1 long, k2 long, p long, open boolean")


def _repeats_of(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): first to last start of repeated strings, phrase by phrase, of (k1, k2, copied, text, phrases); none of copied texts, which go as a whole."""
    whole = written(_whole(texts, length), "whole-phrases")
    one = [F.first(c).alias(c) for c in ("k1", "k2", "t", "lo", "hi", *HASHES)]  # all of one row, without the sort that a struct would take
    kinds = whole.groupBy("w1", "w2").agg((F.count(F.lit(1)) + F.max(F.col("copied").cast("long"))).alias("n"), *one)
    kinds = written(kinds, "kinds")
    twice = kinds.where("n > 1").select("w1", "w2").hint("shuffle_hash")
    repeated = written(whole.where("not copied").select("k1", "k2", "lo", "hi", "w1", "w2").join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "lo", "hi"), "repeated")
    discard(whole)
    # one phrase of each kind goes on, with the classes that meet another kind's; one of the two is still open
    step = class_of(length)
    classes = kinds.select("k1", "k2", "t", "lo", "hi", (F.col("n") == 1).alias("open"), F.posexplode(F.array(*HASHES)).alias("j", "h")).where("h is not null")
    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("open").cast("long")).alias("open")).where("n > 1 and open > 0")
    shared = written(shared.select("h"), "shared-classes")
    near = F.col("t") - F.col("j") * step
    own = F.struct("t", F.greatest("lo", near - (step - 1)).alias("lo"), F.least("hi", near).alias("hi"), "open")
    met = classes.join(shared.hint("shuffle_hash"), "h", "left_semi").select("k1", "k2", own.alias("own"))
    met = written(met.groupBy("k1", "k2").agg(F.collect_list("own").alias("met")), "met-lists")
    discard(kinds, shared)
    met_texts = texts.select("k1", "k2", "text").join(met, ["k1", "k2"]).select("k1", "k2", "text", "met")
    before, met = met, written(_contexts(met_texts, length), "met-phrases")
    discard(before)
    strings = lambda h, s: met.groupBy(F.col(h).alias("h")).agg(F.first(s).alias("s"), F.count(F.lit(1)).alias("n"))
    left, left_carry = _ordered(strings("lh", "left"), "dictionary-order")
    right, right_carry = _ordered(strings("rh", "right"), "parse-order")
    side = lambda df, x: df.select(F.col("h").alias(x + "h"), F.col("most").alias(x + "_most"), F.col("depths").alias(x + "_depths"), F.col("intervals").alias(x + "_in"))
    both = met.drop("left", "right").join(side(left, "l"), "lh").join(side(right, "r"), "rh")
    some = F.greatest(F.col("t") - F.col("hi"), length - F.col("r_most")) <= F.least(F.col("t") - F.col("lo"), "l_most")
    rows = both.where(some).select("k1", "k2", "t", "lo", "hi", "open", "l_most", "l_depths", "l_in", "r_most", "r_depths", "r_in")
    places = written(_places(rows, length, left_carry, right_carry), "places")
    discard(met, left, right)
    again = written(places.groupBy("a", "b", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "d"), "intervals")
    single = places.where("open").join(again.hint("shuffle_hash"), ["a", "b", "d"], "left_semi").select("k1", "k2", F.col("p").alias("lo"), F.col("p").alias("hi"))
    single = written(single, "repeated")
    discard(places, again)
    return repeated.unionByName(single)


def removed_spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings of ``length`` that start in the given ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """What is left of each text once repeated strings are gone: one row for each row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else, in its own text or another one; strings are judged on the input, so all
    copies go.  Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage,
    spans (``start:end`` in bytes, comma-joined) and, with ``keep_text``, kept (binary,
    as a cut may fall inside a character).  n_passage counts the bytes of cores that
    occur again, by their hash: it also tells of passages too short to go.  A null text
    counts as empty.  Equal texts have equal results: they are worked out once and
    joined back to the rows.
    """
    texts = docs.select(*_halves(text_key(F.col("text"))), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_enough = texts.where(F.octet_length("text") >= length)
    parsed = written(_parsed(long_enough, length), "phrases")
    cores = written(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "cores")
    kept = parsed.join(cores.hint("shuffle_hash"), "core", "left_semi").groupBy("k1", "k2").agg(F.collect_set("place").alias("phrases"))
    kept = written(kept, "kept-phrases")
    discard(parsed, cores)
    one = long_enough.groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied"))
    found = written(one.join(kept, ["k1", "k2"]).select("k1", "k2", "copied", "text", "phrases"), "kept-texts")
    places = _repeats_of(found, length)
    discard(found)
    starts = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    lists = written(kept.withColumnRenamed("phrases", "cores").join(starts, ["k1", "k2"], "left"), "starts")
    discard(kept)
    every = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied")).join(lists, ["k1", "k2"], "left")
    core = core_of(length)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in text_slices(batches, 2):
            for k1, k2, text, copied, cores, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                data = text.as_buffer().to_pybytes()
                ranges: list[tuple[int, int]] = [(0, len(data) - length)] if copied and len(data) >= length else []
                if starts.is_valid and not ranges:
                    ranges = [*zip(*(starts.values.field(i).to_pylist() for i in range(2)), strict=True)]
                spans = removed_spans(ranges, length)
                parts, at = [], 0
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                left = b"".join([*parts, data[at:]])
                passage = sum(b - a for a, b in removed_spans([(t, t) for t in unpacked_places(cores.values.to_numpy())[0].tolist()], core)) if cores.is_valid else 0
                yield k1, k2, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), passage, ",".join(f"{a}:{b}" for a, b in spans), left if keep_text else None

    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage", "spans", "kept"]
    types = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.string(), pa.binary()]
    rows = every.select("k1", "k2", "text", "copied", "cores", "starts")
    made = written(rows.transform(in_arrow, lambda batches: _emitted(each(batches), names, types, 200), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long, spans string, kept binary"), "kept")
    discard(lists)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_halves(text_key(F.col("text"))))
    return keys.join(made, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage", "spans", *["kept"] * keep_text)
