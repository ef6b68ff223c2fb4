"""Streams: rows of (stream_id, pos, pts, value, ...) in order, and their segments.

``stream_id`` names a stream, ``pos`` counts its rows from 0, ``pts`` is its clock in
microseconds.  A cut splits a stream into segments; state of a later operator never
crosses a cut, which is what partitioning by (stream_id, segment_id) does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_stream() -> WindowSpec:
    """The rows of each stream in order."""
    return W.partitionBy("stream_id").orderBy("pos")


def in_order(stream: DataFrame) -> WindowSpec:
    """The rows of each segment in order, where the stream has segments; else those of each stream."""
    return W.partitionBy(*segment_keys(stream)).orderBy("pos")


def segment_keys(stream: DataFrame) -> list[str]:
    return ["stream_id", "segment_id"] if "segment_id" in stream.columns else ["stream_id"]


def event_stream(events: DataFrame) -> DataFrame:
    """The ``events`` table as a stream for each user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    instant = F.expr("unix_micros(cast(convert_timezone('UTC', current_timezone(), ts) as timestamp))")
    return events.select(
        F.col("user_id").alias("stream_id"),
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
        instant.alias("pts"),
        "value",
        "event_type",
    )


def with_segments(stream: DataFrame, cut: Column, order: WindowSpec | None = None) -> DataFrame:
    """Add ``segment_id``: the number of cuts at or before a row. A null cut is none."""
    return stream.withColumn("segment_id", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over((order or by_stream()).rowsBetween(W.unboundedPreceding, 0)).cast("long"))


def jump(threshold: float, order: WindowSpec | None = None) -> Column:
    """Cut where the value moves by more than ``threshold`` from the row before (strictly)."""
    return F.abs(F.col("value") - F.lag("value").over((order or by_stream()))) > threshold


def array_mad(now: Column, before: Column) -> Column:
    """Mean absolute difference of two arrays."""
    d = F.zip_with(now, before, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(now)


def histogram(values: Column, bins: int = 32) -> Column:
    """Counts of bytes (0 to 255) in equal bins: bin ``v * bins // 256``."""
    each = F.transform(values, lambda v: F.floor(v * bins / 256).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(each, lambda b: b == k)).cast("double"))


def chi_square(before: Column, now: Column) -> Column:
    """Chi-square distance of histograms over the mass of the earlier one."""
    eps = 1e-6
    total = F.aggregate(F.zip_with(before, now, lambda a, b: (a - b) * (a - b) / (a + b + F.lit(eps))), F.lit(0.0), lambda s, x: s + x)
    return total / (F.aggregate(before, F.lit(0.0), lambda s, x: s + x) + F.lit(eps))


def gop_positions(stream: DataFrame, sync: Column) -> DataFrame:
    """Add is_sync, gop_ordinal, gop_length; rows before the first sync count from 0 up to it.

    All null in a stream without a sync row.
    """
    group = W.partitionBy("stream_id", "gop")
    df = stream.withColumn("is_sync", sync).withColumn("gop", F.sum(F.col("is_sync").cast("int")).over(by_stream().rowsBetween(W.unboundedPreceding, 0)))
    some = F.max(F.col("is_sync").cast("int")).over(W.partitionBy("stream_id")) == 1
    df = df.withColumn("gop_ordinal", F.when(some, (F.row_number().over(group.orderBy("pos")) - 1).cast("long")))
    return df.withColumn("gop_length", F.when(some, F.count(F.lit(1)).over(group))).drop("gop")


def snap_start(stream: DataFrame, sync: Column, at: Column) -> DataFrame:
    """(stream_id, snapped): the sync row nearest in time to ``at``; of two, the earlier one."""
    rows = stream.where(sync).withColumn("_order", F.struct(F.abs(F.col("pts") - at), F.col("pos")))
    return rows.groupBy("stream_id").agg(F.min_by("pos", "_order").alias("snapped"))


def trim(stream: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows from the one on screen at ``start`` (or the first) to the last one before ``end``."""
    first = F.coalesce(F.max(F.when(F.col("pts") <= start, F.col("pos"))).over(W.partitionBy("stream_id")), F.lit(0))
    return stream.withColumn("_first", first).where((F.col("pos") >= F.col("_first")) & (F.col("pts") < end)).drop("_first")


def violations(stream: DataFrame, tick: int) -> DataFrame:
    """(stream_id, pos, rule): rows that a sink with a grid of ``tick`` has to refuse."""
    before = F.lag("pts").over(by_stream())
    off = F.least(F.pmod("pts", F.lit(tick)), tick - F.pmod("pts", F.lit(tick))) > 1
    rules = F.array_compact(F.array(F.when(F.col("pts") <= before, F.lit("not_increasing")), F.when(off, F.lit("off_grid"))))
    return stream.withColumn("rule", rules).select("stream_id", "pos", F.explode("rule").alias("rule"))
