"""What a run reports: ledgers of stages, cut logs, bands of frames, tracks, orders of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.functions.quantiles import nearest_lower
from loomtick.operators.streams import by_stream


def conform_ledger(source: DataFrame, slots: DataFrame) -> DataFrame:
    """(stream_id, received, emitted, duplicated, dropped, max_shift) of ``timing.conform`` and its source."""
    received = source.groupBy("stream_id").agg(F.count(F.lit(1)).alias("received"))
    # slots of a row are neighbours: a row that begins a run is a distinct one
    new = F.coalesce(F.col("pos") != F.lag("pos").over(W.partitionBy("stream_id").orderBy("slot")), F.lit(True))
    emitted = slots.withColumn("_new", new).groupBy("stream_id").agg(F.count(F.lit(1)).alias("emitted"), F.count_if("_new").alias("_kept"), F.max("shift").alias("max_shift"))
    both = received.join(emitted, "stream_id", "left").na.fill(0, ["emitted", "_kept"])
    return both.select("stream_id", "received", "emitted", (F.col("emitted") - F.col("_kept")).alias("duplicated"), (F.col("received") - F.col("_kept")).alias("dropped"), "max_shift")


def level_ledger(levelled: DataFrame, deadband: float) -> DataFrame:
    """(stream_id, n, mean_shift, p95_shift, corrected) of rows with a ``shift``; p95 is the nearest lower one."""
    size = F.abs("shift")
    sums = levelled.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_shift"), nearest_lower(F.collect_list(size), 0.95).alias("p95_shift"), F.count_if(size > deadband).alias("corrected"))
    return sums


def deflicker_ledger(fixed: DataFrame) -> DataFrame:
    """(stream_id, fired, applied): share of rows that changed, and mean size of the change."""
    change = F.abs(F.col("fixed") - F.col("value"))
    return fixed.groupBy("stream_id").agg(F.avg((change > 0).cast("double")).alias("fired"), F.avg(change).alias("applied"))


def cut_log(stream: DataFrame) -> DataFrame:
    """(stream_id, n, source_index): the row at each cut, in order from 1."""
    cut = F.col("segment_id") > F.lag("segment_id").over(by_stream())
    rows = stream.withColumn("_cut", cut).where("_cut").select("stream_id", F.col("pos").alias("source_index"))
    return rows.select("stream_id", F.row_number().over(W.partitionBy("stream_id").orderBy("source_index")).alias("n"), "source_index")


def band_metrics(frames: DataFrame, height: int, width: int, edge_percent: float, side_percent: float) -> DataFrame:
    """(stream_id, band, mean, std, change) of bands of frames (stream_id, pos, pixels).

    Bands are the outer lines and columns and as many in the middle; ``change`` is the mean
    absolute change from frame to frame, null with a single frame.  Samples are summed up
    before they meet.
    """
    lines, columns = max(1, round(height * edge_percent / 100)), max(1, round(width * side_percent / 100))
    y0, x0 = height // 2 - lines // 2, width // 2 - columns // 2
    y, x = F.floor(F.col("_i") / width), F.col("_i") % width
    rows, cols = (y >= y0) & (y < y0 + lines), (x >= x0) & (x < x0 + columns)
    bands = {"top": y < lines, "bottom": y >= height - lines, "left": x < columns, "right": x >= width - columns, "center_y": rows, "center_x": cols, "center": rows & cols}
    inside = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in bands.items())))
    before = F.lag("pixels").over(by_stream())
    both = F.arrays_zip(F.col("pixels").alias("now"), F.coalesce("_b", F.transform("pixels", lambda v: F.lit(None).cast("double"))).alias("before"))
    samples = frames.withColumn("_b", before).select("stream_id", F.posexplode(both).alias("_i", "_s")).select("stream_id", F.explode(inside).alias("band"), F.col("_s.now").alias("now"), F.abs(F.col("_s.now") - F.col("_s.before")).alias("d"))
    return samples.groupBy("stream_id", "band").agg(F.avg("now").alias("mean"), F.stddev_pop("now").alias("std"), F.avg("d").alias("change"))


def track_summary(tracks: DataFrame, least: int = 1) -> DataFrame:
    """(stream_id, track, frames, first, last, mean_score, mean_area) of tracks of at least ``least`` rows."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sums = tracks.groupBy("stream_id", "track").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.avg("score").alias("mean_score"), F.avg(area).alias("mean_area"))
    return sums.where(F.col("frames") >= least)


def report_order(rows: DataFrame, keys: list[str], scores: list[str], place: str = "place") -> DataFrame:
    """Add the place of each row among its keys: by the first score that it has, the best first, rows without any last."""
    tie = [c for c in rows.columns if c not in keys and c not in scores]
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(F.coalesce(*scores).desc_nulls_last(), *tie)))
