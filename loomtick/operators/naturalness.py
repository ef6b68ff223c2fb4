"""Distance of frames from natural ones: 36 measures of each patch, and two Gaussians compared.

A model is fitted here, on frames that are given; none is brought along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.operators.kernels import _blurred, local_std

PATCH = 96
MEASURES = 36
#: Shapes that a generalised normal distribution may have, and its moment ratio and mean factor at each.
SHAPES = 0.2 + 0.001 * np.arange(9801)
_G1, _G2, _G3 = (np.array([math.lgamma(k / g) for g in SHAPES]) for k in (1, 2, 3))
_RATIO = np.exp(_G1 + _G3 - 2 * _G2)
_MEAN = np.exp(_G2 - (_G1 + _G3) / 2)


def _nearest(curve: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of the entry of a monotone curve nearest to each value, the first of equals."""
    up = curve[0] < curve[-1]
    line = curve if up else curve[::-1]
    right = np.clip(np.searchsorted(line, values), 1, len(line) - 1)
    near = right - (np.abs(line[right - 1] - values) <= np.abs(line[right] - values)) if up else right - (np.abs(line[right - 1] - values) < np.abs(line[right] - values))
    return near if up else len(line) - 1 - near


def contrast_normalised(luma: np.ndarray) -> np.ndarray:
    """Distance from the local mean over one plus the local spread."""
    return (luma - _blurred(luma)) / (local_std(luma) + 1)


def _tiles(x: np.ndarray, side: int) -> np.ndarray:
    """(lines, columns, side, side): the whole tiles of a frame."""
    h, w = (n // side for n in x.shape)
    return x[: h * side, : w * side].reshape(h, side, w, side).swapaxes(1, 2)


def _measures(tiles: np.ndarray) -> np.ndarray:
    """18 measures of tiles (n, side, side): shape and spread of the samples, then shape, mean and both spreads of four neighbours' products."""
    flat = lambda t: t.reshape(len(t), -1)
    samples = flat(tiles)
    energy = (samples**2).mean(1)
    shape = SHAPES[_nearest(_RATIO, energy / (np.abs(samples).mean(1) ** 2 + 1e-12))]
    out = [shape, np.sqrt(energy)]
    products = (tiles[:, :, 1:] * tiles[:, :, :-1], tiles[:, 1:] * tiles[:, :-1], tiles[:, 1:, 1:] * tiles[:, :-1, :-1], tiles[:, 1:, :-1] * tiles[:, :-1, 1:])
    for p in map(flat, products):
        below = p < 0
        spread = lambda side, p=p: np.sqrt((p**2 * side).sum(1) / np.maximum(side.sum(1), 1)) + 1e-6
        left, right = spread(below), spread(~below)
        skew = left / right
        ratio = np.abs(p).mean(1) ** 2 / ((p**2).mean(1) + 1e-12) * (skew**3 + 1) * (skew + 1) / (skew**2 + 1) ** 2
        at = _nearest(1 / _RATIO, ratio)
        out += [SHAPES[at], (right - left) * _MEAN[at], left**2, right**2]
    return np.stack(out, 1)


def patch_measures(luma: np.ndarray, side: int = PATCH) -> np.ndarray:
    """(patches, 36): the measures of each whole patch at full and at half size; luma in [0, 1]."""
    full, half = _tiles(contrast_normalised(luma), side), _tiles(contrast_normalised(luma[::2, ::2]), side // 2)
    h, w = min(full.shape[0], half.shape[0]), min(full.shape[1], half.shape[1])
    if not h or not w:
        return np.zeros((0, MEASURES))
    return np.concatenate([_measures(t[:h, :w].reshape(h * w, *t.shape[2:])) for t in (full, half)], axis=1)


@dataclass(frozen=True)
class Gaussian:
    """Mean and covariance of measures of ``n`` patches."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    def distance(self, other: Gaussian) -> float:
        gap = self.mean - other.mean
        return float(math.sqrt(max(0.0, gap @ np.linalg.pinv((self.cov + other.cov) / 2) @ gap)))


def gaussians(frames: DataFrame, side: int = PATCH) -> dict[int, Gaussian]:
    """The Gaussian of each stream of frames (stream_id, pos, height, width, pixels), by sums over all of its patches.

    Each task sums up what it has; the driver gets 1333 numbers a stream, so streams are
    taken in sets that it can hold.
    """
    names = ["stream_id", "n", "sums", "squares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for s, h, w, p in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                m = patch_measures(p.values.to_numpy(zero_copy_only=False).astype(float).reshape(h, w), side)
                own = held.setdefault(s, [0, np.zeros(MEASURES), np.zeros((MEASURES, MEASURES))])
                own[0] += len(m)
                own[1] += m.sum(0)
                own[2] += m.T @ m
        if held:
            columns = [[s for s in held], [v[0] for v in held.values()], [v[1] for v in held.values()], [v[2].ravel() for v in held.values()]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    parts = frames.select("stream_id", "height", "width", "pixels").mapInArrow(run, "stream_id long, n long, sums array<double>, squares array<double>")
    total = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n)))
    each = parts.select("stream_id", "n", "sums", F.posexplode("squares").alias("k", "v")).groupBy("stream_id", "k").agg(F.sum("v").alias("v"))
    squares = each.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("squares"))
    rows = parts.groupBy("stream_id").agg(F.sum("n").alias("n"), total("sums", MEASURES).alias("sums")).join(squares, "stream_id").collect()
    out = {}
    for r in rows:
        mean = np.array(r.sums) / max(1, r.n)
        square = np.array([x.v for x in r.squares]).reshape(MEASURES, MEASURES)
        out[r.stream_id] = Gaussian(r.n, mean, (square - r.n * np.outer(mean, mean)) / max(1, r.n - 1))
    return out
