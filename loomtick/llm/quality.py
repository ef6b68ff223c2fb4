"""Quality rules with suffix-array repetition.

The words of a text (runs without ASCII white space) are sorted by suffix with
prefix doubling; intervals of the longest common prefix give the maximal repeated
substrings.  Their spans are united; a text fails if they cover too much of it or
one of them is too long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import in_arrow, text_slices

WINDOW = 5
#: Repeated substrings from this many words on count as covered.
MIN_REPEAT = 10
#: Largest covered fraction of the words (below the fifth that windows of five words may repeat), and longest repeated substring in words and as a fraction of the text.
MAX_COVERED = 0.15
MAX_REPEAT = 60
MAX_REPEAT_FRACTION = 0.05
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Words whose suffixes are sorted together; a longer text is sorted alone.
GROUP_WORDS = 1 << 18


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, bool]:
    """Dense ranks of pairs, and whether they are all different."""
    key = first * (int(second.max(initial=0)) + 2) + second + 1
    order = np.argsort(key, kind="stable")
    step = np.empty(len(key), np.int64)
    if len(key):
        step[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=step[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return rank, bool(len(key) == 0 or step[-1] == len(key) - 1)


def suffix_order(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of texts laid end to end, and the ranks at lengths 1, 2, 4, ...

    Texts never match across their ends: the end of each counts as a word of its
    own, smaller than all others.  Suffixes are ordered within their text.
    """
    n = len(words)
    left = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)  # end of each text
    end = left[np.searchsorted(left, np.arange(n), side="right")] if n else left[:0]
    rank, done = _ranks(doc, words)
    levels, k = [rank], 1
    while not done:
        after = np.full(n, -1, np.int64)
        inside = np.flatnonzero(np.arange(n) + k < end)
        if not len(inside):
            break
        after[inside] = rank[inside + k]
        rank, done = _ranks(rank, after)
        levels.append(rank)
        k *= 2
    # suffixes that are still equal cannot be: one text's suffixes differ in length
    return np.argsort(rank, kind="stable"), levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        k = 1 << level
        ok = (a + k <= end[order[:-1]]) & (b + k <= end[order[1:]])
        ia, ib = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = ok & (levels[level][ia] == levels[level][ib])
        step = np.where(same, k, 0)
        got += step
        a += step
        b += step
    lcp[1:] = got
    return lcp


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring from it on that its text repeats."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    left = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)
    end = left[np.searchsorted(left, np.arange(n), side="right")]
    order, levels = suffix_order(words, doc)
    lcp = neighbour_lcp(order, levels, end)
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def _covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Words in a repeated substring of at least ``least`` words: the united spans, none of which leaves its text."""
    n = len(longest)
    reach = np.where(longest >= least, np.arange(n) + longest, 0)
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def _window_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words whose 5-word window may occur again in the text: no repeat is missed."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(n, bool)
    odd = np.random.default_rng(5).integers(1 << 62, size=WINDOW + 1).astype(np.uint64) | np.uint64(1)
    m = n - WINDOW + 1
    h = doc[:m].astype(np.uint64) * odd[WINDOW]
    for i in range(WINDOW):
        h = h + (words[i : i + m].astype(np.uint64) + np.uint64(1)) * odd[i]
    h ^= h >> np.uint64(31)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    flag = np.zeros(n, bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def measure(texts: list[str], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Measures of several texts at once; the suffixes are sorted in groups of bounded size."""
    number: dict[bytes, int] = {}
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    chars = np.array([len(t) - sum(map(t.count, " \t\n\r\x0b\x0c")) for t in texts], np.int64)
    symbols = np.array([len(_SYMBOLS.findall(t)) for t in texts], np.int64)
    lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if "\n" in t:
            own = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
            lines[i] = len(own) - len(set(own))
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines}
    out |= {k: np.zeros(len(texts), np.int64) for k in ("n_repeat_words", "covered_words", "longest_repeat")}
    start = 0
    while start < len(texts):
        stop, total = start + 1, int(n_words[start])
        while stop < len(texts) and total + n_words[stop] <= GROUP_WORDS:
            total += int(n_words[stop])
            stop += 1
        number.clear()
        flat = np.fromiter((number.setdefault(w, len(number)) for s in split[start:stop] for w in s), np.int64, total)
        doc = np.repeat(np.arange(start, stop), n_words[start:stop])
        own = np.unique(doc[_window_repeats(flat, doc)])  # only these can repeat five words
        if len(own):
            pick = np.isin(doc, own)
            flat, doc = flat[pick], doc[pick]
            longest = longest_repeats(flat, doc)
            for name, least in (("n_repeat_words", WINDOW), ("covered_words", min_repeat)):
                inside = _covered(longest, least)
                out[name][own] = np.bincount(doc[inside], minlength=stop)[own]
            np.maximum.at(out["longest_repeat"], doc, longest)
        start = stop
    out["longest_repeat"][out["longest_repeat"] < WINDOW] = 0  # of texts that only may repeat five words
    return out


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, max_repeat_fraction: float = MAX_REPEAT_FRACTION) -> DataFrame:
    """Measures and verdict of every whole text: one row for each row of ``docs``.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, covered_words, longest_repeat.  ``base_failed``: fewer than
    ten words, or more than a fifth of them in repeated 5-word windows.  Beyond
    that a text fails if repeated substrings of ``min_repeat`` words cover more
    than ``max_covered`` of it, or if its longest one has more than ``max_repeat``
    words and is more than ``max_repeat_fraction`` of it.  longest_repeat is 0 if
    nothing of five words repeats.  A null text has no words and fails.  Works row by row; nothing is shuffled.
    """
    return _measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long", min_repeat, max_covered, max_repeat, max_repeat_fraction)


def _verdict(m: dict[str, np.ndarray], max_covered: float, max_repeat: int, max_fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts that fail the plain rules, and those that repeat too much."""
    n, longest = m["n_words"], m["longest_repeat"]
    failed = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
    return failed, (m["covered_words"] > max_covered * n) | ((longest > max_repeat) & (longest > max_fraction * n))


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(rows: DataFrame, head: str, min_repeat: int, max_covered: float, max_repeat: int, max_fraction: float) -> DataFrame:
    name = head.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            m = measure([t or "" for t in batch.column(1).to_pylist()], min_repeat)
            failed, bad = _verdict(m, max_covered, max_repeat, max_fraction)
            cols = [batch.column(0), *(pa.array(m[k]) for k in _MEASURES), pa.array(failed), pa.array(~failed & ~bad), pa.array(m["covered_words"]), pa.array(m["longest_repeat"])]
            yield pa.RecordBatch.from_arrays(cols, [name, *_MEASURES, "base_failed", "kept", "covered_words", "longest_repeat"])

    return rows.transform(in_arrow, run, f"{head}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns.

    Every row is carried through in Arrow batches as it is, so repeated rows,
    nulls and clashing names of other columns change nothing.
    """
    limits = {"min_repeat": MIN_REPEAT, "max_covered": MAX_COVERED, "max_repeat": MAX_REPEAT, "max_repeat_fraction": MAX_REPEAT_FRACTION} | options
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            m = measure([t or "" for t in batch.column(at).to_pylist()], limits["min_repeat"])
            failed, bad = _verdict(m, limits["max_covered"], limits["max_repeat"], limits["max_repeat_fraction"])
            yield batch.filter(pa.array(~failed & ~bad))

    return docs.transform(in_arrow, run, docs.schema)


#: Words in repeated substrings of ten words are those in ten-word windows that occur again; runs of repeated five-word windows at one distance give the longest.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM d),
l AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t\x0B\f\r]') GROUP BY 1),
g AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (VALUES (5), (10)) v(k))),
r AS (SELECT rid, k, i, gram FROM (SELECT *, count(*) OVER (PARTITION BY rid, k, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, k, count(DISTINCT i + s) AS n FROM r, range(0, 10) o(s) WHERE s < k GROUP BY 1, 2),
p AS (SELECT a.rid, b.i - a.i AS gap, a.i - row_number() OVER (PARTITION BY a.rid, b.i - a.i ORDER BY a.i) AS run FROM r a JOIN r b ON a.rid = b.rid AND a.k = 5 AND b.k = 5 AND a.gram = b.gram AND a.i < b.i),
m AS (SELECT rid, max(n) + 4 AS longest FROM (SELECT rid, gap, run, count(*) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
 coalesce(c5.n, 0)::BIGINT AS n_repeat_words, coalesce(c10.n, 0)::BIGINT AS covered_words, coalesce(longest, 0)::BIGINT AS longest_repeat
 FROM t LEFT JOIN l USING (rid) LEFT JOIN c c5 ON c5.rid = t.rid AND c5.k = 5 LEFT JOIN c c10 ON c10.rid = t.rid AND c10.k = 10 LEFT JOIN m ON m.rid = t.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (covered_words > @C@ * n_words OR (longest_repeat > @R@ AND longest_repeat > @F@ * n_words)) AS kept, covered_words, longest_repeat FROM f
""".replace("@C@", str(MAX_COVERED)).replace("@R@", str(MAX_REPEAT)).replace("@F@", str(MAX_REPEAT_FRACTION))
