"""Choosing rows and naming them: strides, clips, context before a start, clocks, pairing by time stamp."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.functions.rational import half_even
from loomtick.operators.streams import by_stream
from loomtick.operators.timing import as_of

#: Ticks a second of stamps that no clock of its own governs, and the finest time base that a stamp may have.
PRODUCT_SCALE = 600
LARGEST_SCALE = 2**31 - 1


def strided(rows: DataFrame, step: int, start: int = 0, position: str = "pos") -> DataFrame:
    """Every ``step``-th row from ``start`` on."""
    p = F.col(position)
    return rows.where((p >= start) & (F.pmod(p - start, F.lit(step)) == 0))


def clip_positions(total: Column, length: int, clips: int, interval: int) -> Column:
    """``clips`` arrays of ``length`` positions, ``interval`` apart, spread over ``total`` rows; a short stream wraps around."""
    span = length * interval
    gap = (total - span + 1) / clips
    first = lambda i: F.when(total > span - 1, F.floor(i * gap + gap / 2)).otherwise(0).cast("long")
    places = lambda o: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.pmod(o + k * interval, total))
    return F.transform(F.sequence(F.lit(0), F.lit(clips - 1)), lambda i: places(first(i)))


def with_context(stream: DataFrame, sync: Column, start: Column) -> DataFrame:
    """Rows from the last sync row at or before position ``start`` on, on a clock that is 0 at ``start``.

    What is read only as context so has negative stamps; without such a sync row there is none.
    """
    whole = W.partitionBy("stream_id")
    first = F.max(F.when(sync & (F.col("pos") <= start), F.col("pos"))).over(whole)
    zero = F.max(F.when(F.col("pos") == start, F.col("pts"))).over(whole)
    rows = stream.withColumn("_first", F.coalesce(first, start)).withColumn("_zero", zero)
    return rows.where((F.col("pos") >= F.col("_first")) & F.col("_zero").isNotNull()).withColumn("pts", F.col("pts") - F.col("_zero")).drop("_first", "_zero")


def display_index(pts: Column, origin: Column, rate: tuple[int, int], ticks: int = 1_000_000) -> Column:
    """Number of the row on screen at ``pts`` at a rate of num / den a second, halves to even."""
    return half_even((pts - origin) * rate[0], F.lit(ticks * rate[1]))


def time_base(stamps: DataFrame, denominator: str, scale: int = PRODUCT_SCALE, largest: int = LARGEST_SCALE) -> DataFrame:
    """(stream_id, base): ticks a second that stamps of all denominators fall on, with ``scale`` among them if that fits.

    Null if even the stamps' own do not fit.  Only distinct denominators of a stream meet.
    """
    distinct = stamps.groupBy("stream_id").agg(F.collect_set(F.col(denominator).cast("long")).alias("dens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dens in batch.column(1).to_pylist():
                own = math.lcm(1, *dens)
                out.append(next((b for b in (math.lcm(own, scale), own) if b <= largest), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["stream_id", "base"])

    return distinct.select("stream_id", "dens").mapInArrow(run, "stream_id long, base long")


def thumbnail(pixels: Column, height: int, width: int, side: int = 32) -> Column:
    """Every n-th sample of every n-th line, so that about ``side`` of each are left."""
    dy, dx = max(1, height // side), max(1, width // side)
    return F.filter(pixels, lambda _, i: (F.floor(i / width) % dy == 0) & (i % width % dx == 0))


#: Primaries, transfer and matrix where nothing is known, and by name.
COLOURS = {"709": ("bt709", "bt709", "bt709"), "601": ("smpte170m", "bt709", "bt601"), "2020": ("bt2020", "bt709", "bt2020")}


def resolved_colour(rows: DataFrame, override: str = "auto", full_range: str = "auto") -> DataFrame:
    """Add ``primaries``, ``transfer``, ``matrix`` and ``full``: what overrides say, else the tag, else the guess, else 709.

    Rows have ``tag`` and ``guess`` columns of each, as ``tag_matrix``, and ``tag_full``.
    """
    out = rows
    for i, name in enumerate(("primaries", "transfer", "matrix")):
        known = F.coalesce(f"tag_{name}", f"guess_{name}", F.lit(COLOURS["709"][i]))
        out = out.withColumn(name, known if override == "auto" else F.lit(COLOURS[override][i]))
    return out.withColumn("full", F.coalesce("tag_full", F.lit(False)) if full_range == "auto" else F.lit(full_range == "full"))


def variants(clips: DataFrame, table: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Each clip with each variant of a fixed list; the list is part of the plan, so nothing is joined."""
    names = list(dict.fromkeys(k for row in table for k in row))
    each = F.array(*(F.struct(*(F.lit(row.get(k)).alias(k) for k in names)) for row in table))
    return clips.withColumn("_v", F.explode(each)).select(*clips.columns, "_v.*")


def taken(outputs: DataFrame, originals: DataFrame, columns: list[str]) -> DataFrame:
    """Outputs with what was kept of the original at the same stamp, under ``original_`` names.

    Each original is taken once, by the first output of its stamp; of originals with equal
    stamps the last one counts.  Outputs without one pass through with nulls.
    """
    kept = originals.groupBy("stream_id", "pts").agg(F.max_by(F.struct(*columns), "pos").alias("_o")).withColumn("_n", F.lit(1))
    order = W.partitionBy("stream_id", "pts").orderBy("pos")
    both = outputs.withColumn("_n", F.row_number().over(order)).join(kept, ["stream_id", "pts", "_n"], "left")
    return both.select(*outputs.columns, *(F.col(f"_o.{c}").alias(f"original_{c}") for c in columns))


def compared(outputs: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Each output with the source row it is compared with: that of ``source_index`` where it has one, else the latest at its time."""
    exact = source.select("stream_id", F.col("pos").alias("source_index"), F.struct(*columns).alias("_x"))
    rows = as_of(outputs.join(exact, ["stream_id", "source_index"], "left"), source, ["stream_id"], "pts", columns)
    return rows.select(*outputs.columns, *(F.when(F.col("source_index").isNotNull(), F.col(f"_x.{c}")).otherwise(F.col(f"{c}_as_of")).alias(f"source_{c}") for c in columns))


def pulse_zone(gain: Column, since_sync: Column, zone: int = 3) -> Column:
    """A gain above 1 only holds within ``zone`` rows of a sync row, where that distance is known."""
    return F.when((since_sync > zone) & (gain > 1), F.lit(1.0)).otherwise(gain)


def tail_duration(stream: DataFrame, cadence: tuple[int, int] | None = None, ticks: int = 1_000_000) -> DataFrame:
    """(stream_id, tail): how long the last row lasts.

    Its own ``duration``, else a step of the grid (num / den rows a second), else the upper
    median of the steps that grow, else the mean over all rows, else a 25th of a second.
    """
    steps = stream.withColumn("_d", F.lead("pts").over(by_stream()) - F.col("pts"))
    usual = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _d DESC) FILTER (WHERE _d > 0)").cast("long")
    own = F.max_by("duration", "pos") if "duration" in stream.columns else F.lit(None).cast("long")
    sums = steps.groupBy("stream_id").agg(own.alias("_own"), usual.alias("_usual"), (F.max("pts") - F.min("pts")).alias("_span"), F.count(F.lit(1)).alias("_n"))
    grid = F.lit(None).cast("long") if cadence is None else F.lit(round(ticks * cadence[1] / cadence[0])).cast("long")
    mean = F.when(F.col("_span") > 0, (F.col("_span") / F.col("_n")).cast("long"))
    return sums.select("stream_id", F.coalesce("_own", grid, "_usual", mean, F.lit(ticks // 25)).alias("tail"))
