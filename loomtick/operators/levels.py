"""Levelling of frames by the mean quantile function of those around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.operators.streams import in_order, segment_keys

BINS = 1024
#: How far a sample may be scaled.
RATIOS = (0.5, 2.0)


def distribution(samples: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Share of samples of [0, 1] up to each bin."""
    at = np.clip((samples * bins).astype(int), 0, bins - 1)
    return np.cumsum(np.bincount(at.ravel(), minlength=bins)) / samples.size


def quantile_function(cdf: np.ndarray) -> np.ndarray:
    """Inverse of a distribution at the middle of each of as many quantiles, in bins, straight within a bin."""
    bins = len(cdf)
    q = (np.arange(bins) + 0.5) / bins
    k = np.minimum(np.searchsorted(cdf, q), bins - 1)
    left = np.where(k > 0, cdf[k - 1], 0.0)
    width = cdf[k] - left
    inside = np.divide(q - left, width, out=np.zeros(bins), where=width > 1e-9)
    return np.clip(k - 0.5 + inside, 0, bins - 1)


def transfer(cdf: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """What each bin becomes, in [0, 1]: the quantile of its middle, read from the reference."""
    bins = len(cdf)
    middle = cdf - np.diff(cdf, prepend=0.0) / 2
    return np.interp(np.clip(middle * bins - 0.5, 0, bins - 1), np.arange(bins), reference) / (bins - 1)


def levelled(luma: np.ndarray, cdf: np.ndarray, reference: np.ndarray, ratios: tuple[float, float] = RATIOS) -> np.ndarray:
    """Factor for each sample that brings a frame to the reference."""
    bins = len(cdf)
    to = np.interp(np.clip(luma * (bins - 1), 0, bins - 1), np.arange(bins), transfer(cdf, reference))
    return np.clip(to / np.maximum(luma, 1e-4), *ratios)


def level_frames(frames: DataFrame, reach: int = 5, deadband: float = 0.003, bins: int = BINS) -> DataFrame:
    """(stream_id, pos, shift, corrected, pixels) of frames (stream_id, pos, pixels) of luma in [0, 1].

    The reference is the mean quantile function of up to ``reach`` frames on either side,
    as many on both, within a segment.  A frame whose mean displacement from it is above
    the deadband is scaled towards it, by ``RATIOS`` at most.
    """

    def analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [quantile_function(distribution(p.values.to_numpy(zero_copy_only=False).astype(float), bins)) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*names, "qf"])

    keys = segment_keys(frames)
    rows = frames.select(*keys, "pos", F.col("pixels").cast("array<double>").alias("pixels"))
    names = rows.columns
    each = rows.mapInArrow(analysed, ", ".join(f"{k} long" for k in keys) + ", pos long, pixels array<double>, qf array<double>")
    order = in_order(each)
    place = F.struct(F.size(F.collect_list("pos").over(order.rowsBetween(-reach, -1))).alias("before"), F.size(F.collect_list("pos").over(order.rowsBetween(1, reach))).alias("after"))
    around = each.withColumn("_p", place).withColumn("_w", F.collect_list("qf").over(order.rowsBetween(-reach, reach)))

    def corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifts, fixed, out = [], [], []
            for p, around, before, after in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x = p.values.to_numpy(zero_copy_only=False)
                w = around.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, bins)
                m, own = min(before, after), w[before]
                reference = w[before - m : before + m + 1].mean(0)
                shifts.append(float((reference - own).mean()) / (bins - 1))
                fixed.append(abs(shifts[-1]) > deadband)
                out.append(np.clip(x * levelled(x, distribution(x, bins), reference), 0, 1) if fixed[-1] else x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shifts, pa.float64()), pa.array(fixed, pa.bool_()), pa.array(out, pa.list_(pa.float64()))], ["stream_id", "pos", "shift", "corrected", "pixels"])

    return around.select("stream_id", "pos", "pixels", "_w", "_p.before", "_p.after").mapInArrow(corrected, "stream_id long, pos long, shift double, corrected boolean, pixels array<double>")
