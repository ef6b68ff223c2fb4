"""Numeric kernels over 2-D samples, in numpy behind Arrow batches.

A frame is a row (stream_id, pos, height, width, pixels) with ``pixels`` row by row in
[0, 1].  Kernels that need a frame alone run row by row; those that need neighbours get
them by a bounded window, never a whole stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.operators.streams import by_stream

#: Luma weights of BT.601 and BT.709 (fixed values).
BT601 = (0.299, 0.587, 0.114)
BT709 = (0.2126, 0.7152, 0.0722)
#: Expected RMS of the largest twentieth of absolute normal values.
TAIL = 2.3616


# --- frames -------------------------------------------------------------------


def _planes(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray | None]:
    for h, w, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(column), strict=True):
        yield np.asarray(p.values.to_numpy(zero_copy_only=False), np.float64).reshape(h, w) if p.is_valid else None


def per_frame(frames: DataFrame, kernel: Callable[[np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """(stream_id, pos, *names) of a kernel that looks at one frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kernel(x) for x in _planes(batch, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[n] for g in got], pa.float64()) for n in names)], ["stream_id", "pos", *names])

    return frames.select("stream_id", "pos", "height", "width", "pixels").mapInArrow(run, "stream_id long, pos long, " + ", ".join(f"{n} double" for n in names))


def per_pair(frames: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """The same of a kernel that looks at a frame and the one before it; first frames are left out."""
    paired = frames.select("stream_id", "pos", "height", "width", "pixels", F.lag("pixels").over(by_stream()).alias("before")).where("before IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kernel(a, b) for a, b in zip(_planes(batch, 5), _planes(batch, 4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[n] for g in got], pa.float64()) for n in names)], ["stream_id", "pos", *names])

    return paired.mapInArrow(run, "stream_id long, pos long, " + ", ".join(f"{n} double" for n in names))


# --- geometry -----------------------------------------------------------------


def crop(x: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    """A window of even size within the frame."""
    height, width = height // 2 * 2, width // 2 * 2
    if height <= 0 or width <= 0 or top < 0 or left < 0 or top + height > x.shape[0] or left + width > x.shape[1]:
        raise ValueError("the window leaves the frame")
    return x[top : top + height, left : left + width]


def resample(x: np.ndarray, width: int, lobes: int = 3) -> np.ndarray:
    """Rows resized to a width with a Lanczos window (widened when shrinking)."""
    n = x.shape[1]
    scale = max(1.0, n / width)
    centre = (np.arange(width) + 0.5) * n / width - 0.5
    taps = np.arange(math.floor(-lobes * scale), math.ceil(lobes * scale) + 1)
    at = np.floor(centre).astype(int)[:, None] + taps
    t = (at - centre[:, None]) / scale
    weight = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
    weight /= weight.sum(1, keepdims=True)
    return np.einsum("hwk,wk->hw", x[:, np.clip(at, 0, n - 1)], weight)


def extend_edges(x: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """Border bands filled with the nearest sample inside."""
    h, w = x.shape
    rows = np.clip(np.arange(h), top, h - 1 - bottom)
    cols = np.clip(np.arange(w), left, w - 1 - right)
    return x[rows][:, cols]


def warp(x: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Samples taken from where the flow (dx, dy) points back to, bilinear, clamped at the border."""
    h, w = x.shape
    yy, xx = np.mgrid[:h, :w]
    px, py = np.clip(xx + flow[..., 0], 0, w - 1), np.clip(yy + flow[..., 1], 0, h - 1)
    x0, y0 = np.minimum(px.astype(int), max(0, w - 2)), np.minimum(py.astype(int), max(0, h - 2))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = px - x0, py - y0
    return (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy


def luma(rgb: np.ndarray, weights: tuple[float, float, float] = BT709) -> np.ndarray:
    return rgb @ np.asarray(weights)


def blend(dry: np.ndarray, wet: np.ndarray, luma_strength: float, chroma_strength: float, weights: tuple[float, float, float] = BT709) -> np.ndarray:
    """Mix of two RGB frames with a strength each for luma and for the rest; not clamped."""
    y, z = luma(dry, weights)[..., None], luma(wet, weights)[..., None]
    return y + luma_strength * (z - y) + (dry - y) + chroma_strength * ((wet - z) - (dry - y))


# --- noise ----------------------------------------------------------------------


def tail_sigma(d: np.ndarray) -> float:
    """Spread of normal noise from the root mean square of the largest twentieth."""
    top = np.sort(np.abs(d), axis=None)[::-1][: max(1, round(0.05 * d.size))]
    return float(np.sqrt((top * top).mean()) / TAIL)


def noise_map(before: np.ndarray, now: np.ndarray, block: int = 16) -> np.ndarray:
    """Spread of each block's change; the lower third of the blocks caps the others.

    Motion changes a block by more than noise would, so no block counts for more
    than thrice what the quiet ones show.
    """
    h, w = (s // block for s in now.shape)
    d = (now - before)[: h * block, : w * block] / math.sqrt(2)
    tiles = d.reshape(h, block, w, block).swapaxes(1, 2).reshape(h, w, -1)
    out = np.array([[tail_sigma(t) for t in row] for row in tiles])
    quiet = np.sort(out, axis=None)[int(0.3 * (out.size - 1))] if out.size else 0.0
    return np.minimum(out, 3 * quiet)


def noise_level(before: np.ndarray, now: np.ndarray) -> dict[str, float]:
    """Lower third of the blocks, their median and their largest value."""
    m = np.sort(noise_map(before, now), axis=None)
    n = len(m)
    return {"floor": float(m[int(0.3 * (n - 1))]), "median": float(m[n // 2]), "top": float(m[-1])} if n else {"floor": 0.0, "median": 0.0, "top": 0.0}


def shift(before: np.ndarray, now: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, peak) by phase correlation, with a parabola through the peak."""
    a, b = np.fft.rfft2(before - before.mean()), np.fft.rfft2(now - now.mean())
    cross = b * np.conj(a)
    surface = np.fft.irfft2(cross / (np.abs(cross) + 1e-9), s=now.shape)
    y, x = np.unravel_index(surface.argmax(), surface.shape)

    def refined(line: np.ndarray, i: int) -> float:
        l, c, r = line[i - 1], line[i], line[(i + 1) % len(line)]
        bend = l - 2 * c + r
        at = i + (0.5 * (l - r) / bend if bend else 0.0)
        return at - len(line) if at > len(line) / 2 else at

    return refined(surface[:, x], int(y)), refined(surface[y], int(x)), float(surface[y, x])


# --- blocks ---------------------------------------------------------------------


def blockiness(x: np.ndarray, period: int = 8) -> dict[str, float]:
    """Strength and phase of a grid: steps across its lines over the steps between them, both ways."""
    out: dict[str, float] = {}
    strengths = []
    for axis, name in ((1, "x"), (0, "y")):
        d = np.abs(np.diff(x, axis=axis)).mean(1 - axis)
        phases = np.array([d[p::period].mean() if len(d[p::period]) else 0.0 for p in range(period)])
        best = int(phases.argmax())
        rest = np.median(np.delete(phases, best))
        strengths.append(max(0.0, phases[best] - rest) / (phases[best] + 1e-9))
        out[f"phase_{name}"] = float((best + 1) % period)
    out["blockiness"] = float(math.sqrt(strengths[0] * strengths[1]))
    return out


def dct8(x: np.ndarray) -> np.ndarray:
    """8 x 8 DCT-II (orthonormal) of all whole blocks, on the scale of bytes around 0."""
    k = np.arange(8)
    basis = np.cos(np.pi * (2 * k + 1) * k[:, None] / 16) * np.where(k[:, None] == 0, math.sqrt(1 / 8), 0.5)
    h, w = (s // 8 for s in x.shape)
    tiles = (x[: h * 8, : w * 8] * 255 - 128).reshape(h, 8, w, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return basis @ tiles @ basis.T


def comb_step(values: np.ndarray, largest: int = 64) -> tuple[float, float]:
    """(step, strength): the spacing that coefficients cluster at, 0 if there is none.

    The characteristic function of values at multiples of q peaks at 1 / q; the
    largest step whose peak comes near the best one is taken, as its parts peak too.
    """
    v = values[np.abs(values) >= 1]
    if len(v) < 50:
        return 0.0, 0.0
    steps = np.arange(2.0, largest + 0.01, 0.25)
    peak = np.abs(np.exp(2j * np.pi * v[:, None] / steps).mean(0))
    spread = np.abs(v).mean()  # beyond it, all values lie near one multiple anyway
    usable = steps <= max(2.0, 2 * spread)
    if not usable.any() or peak[usable].max() < 0.3:
        return 0.0, float(peak.max())
    good = np.flatnonzero(usable & (peak >= 0.8 * peak[usable].max()))
    best = good[-1]
    while best > 0 and peak[best - 1] > peak[best]:
        best -= 1
    return float(steps[best]), float(peak[best])


# --- natural statistics ---------------------------------------------------------


def _blurred(x: np.ndarray, radius: int = 3, sigma: float = 7 / 6) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(w * np.take(padded, np.arange(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return x


def local_std(x: np.ndarray) -> np.ndarray:
    mean = _blurred(x)
    return np.sqrt(np.maximum(_blurred(x * x) - mean * mean, 0))


def normalised(x: np.ndarray) -> np.ndarray:
    """Contrast-normalised samples: distance from the local mean over the local spread."""
    return (x - _blurred(x)) / (local_std(x) + 1 / 255)


def _shape_of(ratio: np.ndarray) -> np.ndarray:
    grid = np.arange(0.2, 10.001, 0.001)
    gamma = np.vectorize(math.lgamma)
    table = np.exp(2 * gamma(2 / grid) - gamma(1 / grid) - gamma(3 / grid))
    return grid[np.abs(table[:, None] - np.atleast_1d(ratio)).argmin(0)]


def statistics(x: np.ndarray) -> dict[str, float]:
    """Shape and spread of generalised normal fits to normalised samples, and of neighbours' products."""
    m = normalised(x)
    shape = float(_shape_of(np.array([np.abs(m).mean() ** 2 / ((m * m).mean() + 1e-12)]))[0])
    out = {"shape": shape, "spread": float((m * m).mean())}
    for name, (dy, dx) in {"h": (0, 1), "v": (1, 0)}.items():
        p = m[: m.shape[0] - dy, : m.shape[1] - dx] * m[dy:, dx:]
        out[f"product_{name}"] = float(p.mean())
    return out


def contrast_risk(reference: np.ndarray, candidate: np.ndarray, least: float = 0.02) -> dict[str, float]:
    """How much more local contrast a candidate has than its reference, and how much so where that one is flat."""
    a, b = local_std(reference), local_std(candidate)
    risk = np.clip((b - a) / (a + b + 1e-6), 0, 1) * (b > least)
    flat = 1 / (1 + 50 * a)
    s = np.sort(risk, axis=None)
    at = lambda q: float(np.interp(q * (len(s) - 1), np.arange(len(s)), s))
    return {"mean": float(risk.mean()), "weighted": float((risk * flat).sum() / flat.sum()), "p95": at(0.95), "p99": at(0.99), "area": float((risk > 0.3).mean())}
