"""Operators over neighbouring rows: filters, levels, flicker, trackers and measures of change.

Filters keep to a segment where the stream has them; measures go over whole streams.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from loomtick.functions.quantiles import lower_median, upper_median
from loomtick.operators.ordered import ordered
from loomtick.operators.streams import by_stream, in_order, segment_keys


def temporal_difference(stream: DataFrame, order: WindowSpec | None = None) -> DataFrame:
    """Add ``tsd``: distance of each row from the mean of its neighbours, in whole steps.

    Values count as integers, as 8-bit samples do; the mean is floored.  First and
    last rows have none and are left out.
    """
    v = F.floor("value").cast("long")
    a, c = F.lag(v).over((order or by_stream())), F.lead(v).over((order or by_stream()))
    return stream.withColumn("tsd", F.abs(v - F.floor((a + c) / 2))).where("tsd IS NOT NULL")


def fir_blend(stream: DataFrame, taps: int, sigma: float, strength: float, order: WindowSpec | None = None) -> DataFrame:
    """Add ``blended``: a mean with the last ``taps`` rows, near values weighing more."""
    past = F.collect_list("value").over((order or in_order(stream)).rowsBetween(-taps, -1))
    weight = lambda x: F.lit(strength) * F.exp(-F.pow((x - F.col("value")) / sigma, 2))
    total = F.aggregate("_past", F.lit(0.0), lambda s, x: s + weight(x))
    mass = F.aggregate("_past", F.lit(0.0), lambda s, x: s + weight(x) * x)
    return stream.withColumn("_past", past).withColumn("blended", (F.col("value") + mass) / (1 + total)).drop("_past")


def deflicker(stream: DataFrame, reach: int, band: float, fraction: float, max_fix: float, step: float, least: int = 6, order: WindowSpec | None = None) -> DataFrame:
    """Add ``fixed``: oscillating values replaced by the mean of the window's in-band values.

    The window is clipped at the ends, not shrunk on the other side.  A row changes
    if the window swings more than it drifts, enough of it lies within ``band`` of its
    lower median with some on each side, and the change stays under ``max_fix``.
    (The two-dimensional vetoes have no part in the scalar form.)
    """
    sides = {"_w": (-reach, reach), "_l": (-reach, -1), "_r": (1, reach)}
    df = stream
    for name, (a, b) in sides.items():
        df = df.withColumn(name, F.collect_list("value").over((order or in_order(stream)).rowsBetween(a, b)))
    n = F.size("_w")
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.abs(y - x))
    swing = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    drift = F.abs(F.element_at("_w", -1) - F.element_at("_w", 1))
    df = df.withColumn("_m", lower_median(F.col("_w")))
    near = lambda c: F.filter(c, lambda x: F.abs(x - F.col("_m")) < band)
    df = df.withColumn("_in", near("_w"))
    mean = F.aggregate("_in", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("_in"), F.lit(0))
    both = ((F.size("_l") == 0) | (F.size(near("_l")) > 0)) & ((F.size("_r") == 0) | (F.size(near("_r")) > 0))
    fire = (n >= 2) & (n >= least) & (drift <= 0.6 * swing + step) & (F.size("_in") >= fraction * n) & both & (F.abs(mean - F.col("value")) < max_fix)
    return df.withColumn("fixed", F.when(fire, mean).otherwise(F.col("value"))).drop(*sides, "_m", "_in")


def pulse_gain(stream: DataFrame, sigma: Column, history: int = 48, least: int = 8, floor: float = 0.002, low: float = 0.6, high: float = 1.8, order: WindowSpec | None = None) -> DataFrame:
    """Add ``gain``: a row's spread over the upper median of its last ones, clamped.

    The first row of a segment has no spread and is neutral, as is a row with fewer
    than ``least`` spreads so far or a median below ``floor``.
    """
    df = stream.withColumn("_s", sigma).withColumn("_h", F.collect_list("_s").over((order or in_order(stream)).rowsBetween(1 - history, 0)))
    ref = upper_median(F.col("_h"))
    gain = F.greatest(F.lit(low), F.least(F.lit(high), F.col("_s") / F.nullif(ref, F.lit(0.0))))
    neutral = F.col("_s").isNull() | (F.size("_h") < least) | (ref < floor)
    return df.withColumn("gain", F.when(neutral, F.lit(1.0)).otherwise(gain)).drop("_s", "_h")


def ema(stream: DataFrame, alpha: float) -> DataFrame:
    """(stream_id, pos, ema): alpha * value + (1 - alpha) * ema of the row before; the first row of a segment starts it, a null changes nothing."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = at = None
        for stream_id, pos, segment, value in rows:
            if segment != at:
                now, at = None, segment
            if value is not None:
                now = value if now is None else alpha * value + (1 - alpha) * now
            yield stream_id, pos, now

    segment = F.col("segment_id") if "segment_id" in stream.columns else F.lit(0).cast("long")
    return ordered(stream.select("stream_id", "pos", segment.alias("segment_id"), "value"), ["pos"], run, "stream_id long, pos long, ema double")


def spread(stream: DataFrame, value: str = "value") -> Column:
    """Change from the row before as the spread of one row; null in the first row of a segment."""
    return F.abs(F.col(value) - F.lag(value).over(in_order(stream))) / 1.4142135623730951


def level(stream: DataFrame, quantiles: str, reach: int, order: WindowSpec | None = None) -> DataFrame:
    """Add ``reference``: mean quantile function of the rows around, and ``shift`` from it.

    The window shrinks alike on both sides near an end.  It is summed from its last row
    back, as DuckDB's lists of such a self-join come: a sum's last bit depends on the
    order, and decides where a rounded shift lies half way.
    """
    pos, n = F.row_number().over((order or in_order(stream))), F.count(F.lit(1)).over(W.partitionBy(*segment_keys(stream)))
    df = stream.withColumn("_m", F.least(F.lit(reach), pos - 1, n - pos)).withColumn("_w", F.collect_list(quantiles).over((order or in_order(stream)).rowsBetween(-reach, reach)))
    first = F.least(F.lit(reach + 1), pos)  # place of the row itself in its window
    df = df.withColumn("_c", first)
    own = F.slice("_w", F.col("_c") - F.col("_m"), 2 * F.col("_m") + 1)
    total = F.aggregate(F.reverse(own), F.transform(quantiles, lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    df = df.withColumn("reference", F.transform(total, lambda x: x / F.size(own)))
    gap = F.zip_with("reference", quantiles, lambda a, b: a - b)
    return df.withColumn("shift", F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size(quantiles)).drop("_m", "_w", "_c")


def masked_change(rows: DataFrame, static: float, moving: float, order: WindowSpec, skip_head: int = 3, skip_tail: int = 2) -> DataFrame:
    """Per frame of (stream_id, pos, source, candidate): change where the source rests, and distance where it moves."""
    n = F.count(F.lit(1)).over(W.partitionBy("stream_id"))
    ds = F.abs(F.col("source") - F.lag("source").over((order or by_stream())))
    df = rows.withColumn("_n", n).withColumn("flicker", F.when(ds < static, F.abs(F.col("candidate") - F.lag("candidate").over((order or by_stream()))))).withColumn("deviation", F.when(ds > moving, F.abs(F.col("candidate") - F.col("source"))))
    return df.where((F.col("pos") >= skip_head) & (F.col("pos") < F.col("_n") - skip_tail)).drop("_n")
