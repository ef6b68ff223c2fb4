"""Line deduplication by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import fresh, written

#: A line on more than this fraction of its host's pages, and on at least MIN_PAGES of them, is boilerplate.
RATIO = 0.1
MIN_PAGES = 2
#: Boilerplate lines up to this number (32 bytes each) are broadcast; more are joined by host and salt.
BROADCAST_LINES = 1 << 20
#: Pages of a host that one part of the salted join takes.
PAGES_A_PART = 20_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _mark(line: Column) -> Column:
    """128 bits that stand for a line, without the spaces around it."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, mark): lines on more than ``ratio`` of the pages of a host.

    Each page counts a line once.  Counts are summed up before the shuffle, which
    carries hashes and not lines, so neither a large host nor a common line gathers
    in one task.  A host has at most (lines of its mean page) / ratio of them,
    however many pages it has.
    """
    rows = pages.select(F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _mark))
    counts = rows.select("host", F.explode(marks).alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") >= min_pages).withColumnRenamed("host", "of")
    return counts.join(totals, F.col("of").eqNullSafe(F.col("host"))).where(F.col("n") / F.col("n_pages") > ratio).select("host", "mark", "n_pages")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with the boilerplate lines of their host cut from ``text``.

    Adds n_lines and n_dropped; all other columns and every row stay (a page that
    is nothing but boilerplate keeps an empty text).  Lines are compared without
    spaces around them; blank lines stay.  A null host is a host of its own, a null
    text becomes empty.  Repeated rows count as pages each.

    Up to ``broadcast_lines`` boilerplate lines are broadcast, and the pages are
    not shuffled at all.  Beyond that the pages meet them by (host, salt), with as
    many salts as the host has parts of ``PAGES_A_PART`` pages.
    """
    found = written(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    by_host = found.groupBy("host").agg(F.collect_set("mark").alias("marks"), F.max("n_pages").alias("n_pages"))
    own, marks, salt, lines = (fresh(pages, n) for n in ("lt_host", "lt_marks", "lt_salt", "lt_lines"))
    key = F.col(host).cast("string")
    if found.count() <= broadcast_lines:
        side = by_host.select(F.col("host").alias(own), F.col("marks").alias(marks))
        joined = pages.join(F.broadcast(side), key.eqNullSafe(F.col(own)), "left")
    else:
        parts = F.ceil(F.col("n_pages") / PAGES_A_PART).cast("int")
        n_parts = fresh(pages, "lt_parts")
        side = by_host.select(F.col("host").alias(own), F.col("marks").alias(marks), F.explode(F.sequence(F.lit(0), parts - 1)).alias(salt + "2"))
        sizes = written(by_host.select(F.col("host").alias(own + "2"), parts.alias(n_parts)), "host-parts")
        # one row a host with boilerplate; a page needs its host's number of parts to draw a salt
        salted = pages.join(sizes, key.eqNullSafe(F.col(own + "2")), "left")
        salted = salted.withColumn(salt, F.pmod(F.xxhash64(F.col(text).cast("string")), F.coalesce(F.col(n_parts), F.lit(1))).cast("int"))
        joined = salted.join(side, key.eqNullSafe(F.col(own)) & (F.col(salt) == F.col(salt + "2")), "left")
    split = joined.withColumn(lines, _lines(F.col(text).cast("string")))
    bad = lambda x: (F.trim(x) != "") & F.coalesce(F.array_contains(F.col(marks), _mark(x)), F.lit(False))
    kept = fresh(pages, "lt_kept")
    split = split.withColumn(kept, F.when(F.col(marks).isNull(), F.col(lines)).otherwise(F.filter(F.col(lines), lambda x: ~bad(x))))
    out = [F.array_join(F.col(kept), "\n").alias(text) if c == text else F.col(c) for c in pages.columns if c not in ("n_lines", "n_dropped")]
    n = F.size(F.col(lines)).cast("long")
    return split.select(*out, n.alias("n_lines"), (n - F.size(F.col(kept))).alias("n_dropped"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT rid, source, trim(x) AS line FROM (SELECT rid, source, unnest(lines) AS x FROM d) WHERE trim(x) <> ''),
h AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bad AS (SELECT l.source, l.line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source
        GROUP BY l.source, l.line, h.n HAVING count(*) >= {MIN_PAGES} AND count(*)::DOUBLE / h.n > {RATIO}),
b AS (SELECT source, list(line) AS bl FROM bad GROUP BY source),
k AS (SELECT d.doc_id, d.lines, list_filter(d.lines, lambda x: NOT list_contains(coalesce(b.bl, []), trim(x))) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""
