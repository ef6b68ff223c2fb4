"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

Items are partitioned by the size of their shingle set (powers of two).  Each keeps
a bottom-k MinHash sketch: its k shingles with the smallest hashes, k chosen for the
smallest set of its partition so that a text with the wanted containment misses all
of them with a probability of at most ``MISS``.  A long document is not sketched: beside
a short item its MinHash would say nothing.  All its shingles are looked up in the
sketches; a hit makes a candidate, and candidates are verified by exact containment.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import fresh, text_key, written

WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-9
#: Sketches, items and candidates of up to so many rows are broadcast (their size is counted first); more are shuffled.
BROADCAST_ROWS = 1 << 20
BROADCAST_SHINGLES = 1 << 21


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _each(w: Column, long: Callable[[Column], Column], short: Column, kind: str) -> Column:
    """Something of every place where five words begin; of the whole where there are fewer words, of nothing without any."""
    places = F.transform(F.sequence(F.lit(1), F.size(w) - (WORDS - 1)), long)
    return F.when(F.size(w) >= WORDS, places).when(F.size(w) > 0, F.array(short)).otherwise(F.array().cast(f"array<{kind}>"))


def shingles(w: Column) -> Column:
    """Distinct shingles of a word array, as text; fewer than five words are one."""
    return F.array_distinct(_each(w, lambda i: F.array_join(F.slice(w, i, WORDS), " "), F.array_join(w, " "), "string"))


def shingle_hashes(w: Column) -> Column:
    return _each(w, lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(WORDS))), F.xxhash64(*(F.get(w, F.lit(k)) for k in range(WORDS))), "long")


def sketch_size(smallest: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Hashes to keep so that a text with the containment misses them all with probability ``miss`` at most."""
    lost = smallest - math.ceil(containment * smallest)  # shingles that may be missing
    k, p = 0, 1.0
    while p > miss and k <= lost:
        p *= max(0, lost - k) / (smallest - k)
        k += 1
    return max(1, k)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, shingles) of the items; one without words has none and is left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w")).distinct()
    rows = rows.select("item_id", shingles(F.col("w")).alias("shingles")).where(F.size("shingles") > 0).distinct()
    return rows.withColumn("part", F.floor(F.log2(F.size("shingles"))).cast("int"))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(hash, item): the bottom-k sketch of every item, k by its size partition."""
    k = F.lit(1)
    for part in range(31):  # sizes of one partition: 2**part and more; larger sets need no larger k
        k = F.when(F.col("part") == part, F.lit(max(sketch_size(n, containment) for n in range(2**part, 2 ** (part + 1))) if part < 8 else 16)).otherwise(k)
    mins = F.slice(F.array_sort(F.transform("shingles", lambda s: F.xxhash64(*(F.get(F.split(s, " "), F.lit(i)) for i in range(WORDS))))), F.lit(1), k)
    return items.select(F.explode(mins).alias("hash"), "item")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, key, item_id, n_shared, n_item, containment) of items within whole texts.

    A row for each row of ``docs`` and each item (repeated benchmark rows count
    once) of which at least ``containment`` of the shingles occur in its text.  Null
    and short texts hold nothing.  Only the sketches, items and candidates are ever
    broadcast, each behind a count; where they are larger, they and the shingles'
    hashes or the texts are shuffled instead.
    """
    items = written(items_of(benchmark).withColumn("item", F.xxhash64("item_id", "shingles")), "items")
    few_items = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0] <= BROADCAST_SHINGLES
    index = _small(written(sketches(items, containment), "sketches"), broadcast_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = rows.select(text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w")).select("key", F.explode(shingle_hashes(F.col("w"))).alias("hash"))
    found = written(hashes.join(index, "hash").select("key", "item").distinct(), "candidates")
    whole = rows.withColumn("key", text_key(F.col("text"))).join(_small(found, broadcast_rows), "key")
    whole = whole.select("doc_id", "key", "item", words(F.col("text")).alias("w")).select("doc_id", "key", "item", shingles(F.col("w")).alias("own"))
    item_rows = items.select("item", "item_id", "shingles")
    both = whole.join(F.broadcast(item_rows) if few_items else item_rows, "item")
    out = both.select("doc_id", "key", "item_id", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_item"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= containment)


def decontaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their columns."""
    name = fresh(docs, "lt_key")
    bad = written(contained(docs, benchmark, containment, broadcast_rows).select(F.col("key").alias(name + "2")).distinct(), "contaminated")
    marked = docs.withColumn(name, text_key(F.col("text").cast("string")))
    return marked.join(_small(bad, broadcast_rows), F.col(name) == F.col(name + "2"), "left_anti").drop(name)


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SHINGLES_SQL = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END"
ORACLE_SQL = f"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS_SQL} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark),
s AS (SELECT item_id, {_SHINGLES_SQL} AS sh FROM iw WHERE len(w) > 0),
i AS (SELECT item_id, len(sh)::BIGINT AS n_item, unnest(sh) AS x FROM s),
d AS (SELECT doc_id, rid, unnest({_SHINGLES_SQL}) AS x FROM dw WHERE len(w) > 0)
SELECT d.doc_id, i.item_id, count(*)::BIGINT AS n_shared, i.n_item, count(*)::DOUBLE / i.n_item AS containment
FROM d JOIN i ON d.x = i.x GROUP BY d.doc_id, d.rid, i.item_id, i.n_item HAVING count(*)::DOUBLE / i.n_item >= {CONTAINMENT}
"""
