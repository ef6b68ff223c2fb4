"""Sample windows, segments and gaps on an integer sample clock."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.functions.rational import half_even
from loomtick.operators.ordered import ordered

MICROS = 1_000_000


def sample_index(micros: Column, rate: Column | int) -> Column:
    """Sample nearest to a time in microseconds; halves go to the even one."""
    return half_even(micros * rate, F.lit(MICROS))


def sample_window(total: Column, rate: Column | int, start: Column, end: Column, longest: Column) -> tuple[Column, Column]:
    """Half-open bounds [first, stop) of a window given in microseconds.

    A null ``end`` stands for the end of the track, a null ``longest`` for no cap.  The
    cap counts from the first sample as rounded, so it is rounded by itself.  A null
    ``total`` bounds nothing; without ``end`` it stops the query.
    """
    # least() and greatest() pass over nulls
    at = lambda t: F.when(t.isNotNull(), F.greatest(F.lit(0), sample_index(t, rate)))
    first = F.least(at(start), total)
    open_end = F.when(total.isNull(), F.raise_error(F.lit("the track has no usable end"))).otherwise(total)
    stop = F.when(end.isNull(), open_end).otherwise(F.least(at(end), total))
    stop = F.least(stop, first + at(longest))
    return first.cast("long"), F.greatest(first, stop).cast("long")


def snapped_starts(segments: Iterator[tuple[int, int]], tick_samples: Fraction) -> Iterator[tuple[int, int]]:
    """(start, stop) of (reported start, length): starts within a tick of the end before are moved to it."""
    slack = max(1, -(-tick_samples.numerator // tick_samples.denominator))
    end = None
    for start, length in segments:
        if end is not None and start < end - slack:
            raise ValueError(f"a segment overlaps the one before by {end - start} samples at sample {end}")
        if end is not None and start <= end + slack:
            start = end
        end = start + length
        yield start, end


def snap_segments(segments: DataFrame, tick_samples: Fraction) -> DataFrame:
    """(stream_id, pos, start, stop) of segments (stream_id, pos, start, length), by ``snapped_starts``.

    The end that a segment is held against depends on all before it, hence a fold.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        names: list[tuple] = []

        def parts() -> Iterator[tuple[int, int]]:
            for stream_id, pos, start, length in rows:
                names[:] = [(stream_id, pos)]
                yield start, length

        for found in snapped_starts(parts(), tick_samples):
            yield (*names[0], *found)

    return ordered(segments.select("stream_id", "pos", "start", "length"), ["pos"], run, "stream_id long, pos long, start long, stop long")


def fill_gaps(segments: DataFrame, first: Column, stop: Column) -> DataFrame:
    """(stream_id, start, stop, pos): a window laid out in runs, null ``pos`` for silence.

    ``segments`` has (stream_id, pos, start, stop) without overlaps.  What no segment
    covers before the last one's end is silence; nothing is added after it.  A gap of
    any length is one row.
    """
    w = W.partitionBy("stream_id").orderBy("pos")
    df = segments.withColumn("_from", F.greatest(F.coalesce(F.lag("stop").over(w), first), first))
    run = lambda a, b, pos: F.struct(F.greatest(a, first).cast("long").alias("start"), F.least(b, stop).cast("long").alias("stop"), pos.alias("pos"))
    nobody = F.lit(None).cast("long")
    both = F.array(run(F.col("_from"), F.col("start"), nobody), run(F.col("start"), F.col("stop"), F.col("pos").cast("long")))
    return df.select("stream_id", F.explode(F.filter(both, lambda r: r["start"] < r["stop"])).alias("r")).select("stream_id", "r.*")


def place(track_start: Column, track_stop: Column, first: Column, stop: Column, longest: Column) -> Column:
    """How a track meets a window of a clip, as (skip, offset, length); null where they do not meet.

    ``skip`` samples of the track come before the window, ``offset`` of the window before
    the track; a cap on the window's length is shortened by the offset.
    """
    skip, offset = F.greatest(F.lit(0), first - track_start), F.greatest(F.lit(0), track_start - first)
    length = F.least(F.least(stop, track_stop) - F.greatest(first, track_start), F.when(longest.isNotNull(), F.greatest(F.lit(0), longest - offset)))
    found = F.struct(skip.cast("long").alias("skip"), offset.cast("long").alias("offset"), length.cast("long").alias("length"))
    return F.when(length > 0, found)
