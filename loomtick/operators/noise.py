"""Noise of windows of frames: a battery of measures, spectra of line profiles, and what they are taken for."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtick.operators.evaluation import labels
from loomtick.operators.kernels import BT601

#: Spread of one channel for that of luma.
CHANNEL = 1 / math.sqrt(sum(w * w for w in BT601))
#: Quantiles of absolute normal values, and the root mean square of their largest twentieth and hundredth (fixed values).
NORMAL = {0.50: 0.6745, 0.75: 1.1503, 0.90: 1.6449, 0.95: 1.9600}
TAILS = {"tail5": (0.05, 2.3616), "tail1": (0.01, 2.9110)}


def _over_blocks(v: np.ndarray) -> tuple[float, float]:
    """Upper median and nearest lower 90 % of the blocks' values."""
    s = np.sort(v, axis=None)
    return float(s[len(s) // 2]), float(s[int(0.9 * (len(s) - 1))])


def battery(window: np.ndarray, threshold: float = 2 / 255, block: int = 16) -> dict[str, float]:
    """Measures of the change within a window (frames, lines, columns), in spreads of a channel.

    Block measures come as ``_med`` and ``_p90`` over blocks of the frame.
    """
    d = np.abs(np.diff(window, axis=0)) / math.sqrt(2)
    h, w = (n // block for n in d.shape[1:])
    tiles = d[:, : h * block, : w * block].reshape(len(d), h, block, w, block).transpose(1, 3, 0, 2, 4).reshape(h * w, -1)
    order, n = np.sort(tiles, axis=1), tiles.shape[1]
    moved = tiles > threshold
    count = moved.sum(1)
    blocks = {f"q{round(100 * p)}": order[:, int(p * (n - 1))] * CHANNEL / scale for p, scale in NORMAL.items()}
    blocks["rms"] = np.sqrt((tiles**2).mean(1)) * CHANNEL
    for name, (share, scale) in TAILS.items():
        blocks[name] = np.sqrt((order[:, n - max(1, round(share * n)) :] ** 2).mean(1)) * CHANNEL / scale
    blocks["max"] = order[:, -1] * CHANNEL
    blocks["density"] = count / n
    blocks["amplitude"] = np.sqrt((tiles**2 * moved).sum(1) / np.maximum(count, 1)) * CHANNEL
    out = {f"{k}_{side}": v for k, values in blocks.items() for side, v in zip(("med", "p90"), _over_blocks(values), strict=True)}
    rms = lambda x: float(np.sqrt((x * x).mean()))
    trace = np.sqrt((d * d).mean((1, 2))) * CHANNEL
    out |= {"trace_med": float(np.sort(trace)[len(trace) // 2]), "trace_max": float(trace.max())}
    if len(window) >= 3:
        out["lag2_over_lag1"] = rms((window[2:] - window[:-2]) / math.sqrt(2)) / (rms(d) + 1e-9)
    return out | edges(window, d, threshold) | {"luma_corr": _correlation(window[:, : h * block, : w * block].mean(0).reshape(h, block, w, block).mean((1, 3)).ravel(), np.sqrt((tiles**2).mean(1)))}


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).mean() / (math.sqrt((a * a).mean() * (b * b).mean()) + 1e-12))


def edges(window: np.ndarray, change: np.ndarray, threshold: float) -> dict[str, float]:
    """Change at edges over that beside them, share of samples at rest, and the fine structure of those."""
    mean = window.mean(0)
    slope = np.abs(np.diff(mean, axis=1))[:-1] + np.abs(np.diff(mean, axis=0))[:, :-1]
    at = slope > np.sort(slope, axis=None)[int(0.85 * (slope.size - 1))]
    energy = (change[:, :-1, :-1] ** 2).mean(0)
    on, off = (energy[m].sum() / max(1, m.sum()) for m in (at, ~at))
    still = change.max(0) < threshold
    inner = still[1:-1, 1:-1]
    fine = np.abs(4 * mean[1:-1, 1:-1] - mean[:-2, 1:-1] - mean[2:, 1:-1] - mean[1:-1, :-2] - mean[1:-1, 2:])
    return {"edge_over_flat": math.sqrt(on / (off + 1e-12)), "static_fraction": float(still.mean()), "static_hf": float(fine[inner].sum() / max(1, inner.sum()) / math.sqrt(20) * CHANNEL)}


def channel_spreads(window: np.ndarray) -> dict[str, float]:
    """Spread of the change of each channel of a window (frames, lines, columns, 3)."""
    d = np.diff(window, axis=0) / math.sqrt(2)
    return {f"sigma_{c}": float(np.sqrt((d[..., i] ** 2).mean())) for i, c in enumerate("rgb")}


def profile_spectrum(profiles: np.ndarray, low: float = 2.0, high: float = 32.0, mean_of: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(periods, strengths) of profiles along their last axis, less their moving mean; sizes are averaged, phases are not."""
    profiles = np.atleast_2d(profiles)
    n, r = profiles.shape[1], mean_of // 2
    sums = np.cumsum(np.pad(np.pad(profiles, ((0, 0), (r, r)), mode="edge"), ((0, 0), (1, 0))), axis=1)
    fine = profiles - (sums[:, mean_of:] - sums[:, :-mean_of]) / mean_of
    periods = low + 0.1 * np.arange(int((high - low) / 0.1) + 1)
    waves = np.exp(2j * np.pi * np.arange(n) / periods[:, None])
    return periods, np.abs(waves @ fine.T / n).mean(1)


def spectrum_peak(periods: np.ndarray, strengths: np.ndarray) -> tuple[float, float]:
    """(period, strength over the upper median) of the strongest peak, or of one at about twice its period that is near as strong."""
    usual = float(np.sort(strengths)[len(strengths) // 2])
    if usual <= 0:
        return 0.0, 0.0
    near = np.flatnonzero(strengths >= 0.8 * strengths.max())
    groups = np.split(near, np.flatnonzero(periods[near][1:] > 1.15 * periods[near][:-1]) + 1)
    tops = [g[strengths[g].argmax()] for g in groups]
    best = max(tops, key=lambda i: strengths[i])
    best = next((i for i in tops if 1.85 <= periods[i] / periods[best] <= 2.15), best)
    return float(periods[best]), float(strengths[best] / usual)


def shared_period(window: np.ndarray, low: float = 6.0, high: float = 16.0) -> tuple[float, float, float] | None:
    """(period, strength across, strength down) of a grid that both axes of a window (frames, lines, columns) share.

    Coding grids have one period both ways, also after a resize to a fraction; texture
    rarely has.  None where a side is shorter than three periods or either axis is weak.
    """
    found = []
    for axis in (2, 1):
        profile = np.abs(np.diff(window, axis=axis)).mean(axis=(0, 3 - axis))
        if len(profile) < 3 * int(high):
            return None
        found.append(profile_spectrum(profile, low, high))
    periods = found[0][0]
    shares = [s / usual if (usual := float(np.sort(s)[len(s) // 2])) > 0 else np.zeros(len(s)) for _, s in found]
    if not all(x.any() for x in shares):
        return None
    both = shares[0] + shares[1]
    period, _ = spectrum_peak(periods, both)
    at = int(np.abs(periods - period).argmin())
    if both[at] < 5.5 or min(x[at] for x in shares) < 1.8:
        return None
    return period, float(found[0][1][at]), float(found[1][1][at])


def box(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square of odd size, the border repeated outwards."""
    for axis in (0, 1):
        r = size // 2
        line = np.cumsum(np.pad(np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), [(1, 0) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        n = x.shape[axis]
        x = (np.take(line, np.arange(size, size + n), axis) - np.take(line, np.arange(n), axis)) / size
    return x


def spatial_floor(window: np.ndarray, temporal: float = 0.0) -> dict[str, float]:
    """Spread of fine structure in the flat parts of the mean frame, and what of it does not flicker.

    ``temporal`` is the spread of the noise from frame to frame; it averages out over the window.
    """
    mean = window.mean(0)
    smooth = box(mean, 5)
    slope = np.zeros(mean.shape)
    slope[:, :-1] += np.abs(np.diff(smooth, axis=1))
    slope[:-1] += np.abs(np.diff(smooth, axis=0))
    usual = np.sort(slope, axis=None)[int(0.35 * (slope.size - 1))]
    flat = slope < min(0.060, max(0.016, 1.5 * usual))
    fine = np.sort(np.abs(mean - box(mean, 3))[flat])
    spread = float(fine[len(fine) // 2] * CHANNEL / (NORMAL[0.50] * 0.9428)) if len(fine) >= 64 else 0.0
    rest = temporal / math.sqrt(max(1, len(window) - 1))
    return {"spatial_sigma": spread, "static_grain": math.sqrt(max(0.0, spread**2 - rest**2))}


def _grid_evidence(step: np.ndarray, phase: int, period: int, tile: int) -> np.ndarray:
    """Least step of a tile over the grid's lines in it, less the same half a period off; 0 at least."""
    h, w = step.shape
    padded = np.pad(step, ((0, -h % tile), (0, -w % tile)), mode="edge")
    lines = padded.reshape(padded.shape[0] // tile, tile, -1, tile).mean(1)
    least = lambda p: lines[..., p::period][..., : max(1, (tile - p) // period)].min(-1)
    return np.maximum(least(phase) - least((phase + period // 2) % period), 0)


def block_map(window: np.ndarray, period: int = 8, tile: int = 32, scale: float = 0.006, kept: float = 0.35, smooth: bool = True) -> np.ndarray:
    """How blocky each sample's surroundings are, in [0, 1], over a window (frames, lines, columns).

    The grid's phase is where steps are largest.  A tile counts what all of its grid lines
    show on both axes, so that an edge, or a pattern along one axis, counts nothing.  Where
    most of a frame is blocky, only what stands above its median keeps more than ``kept``.
    """
    h, w = window.shape[1:]
    evidence = []
    for axis in (2, 1):
        step = np.abs(np.diff(window, axis=axis)).mean(0)
        step = step if axis == 2 else step.T
        whole = step[:, : step.shape[1] // period * period]
        phase = int(whole.reshape(len(step), -1, period).mean((0, 1)).argmax()) if whole.size else 0
        found = _grid_evidence(step, phase, period, tile)
        evidence.append(found if axis == 2 else found.T)
    th, tw = (min(e.shape[i] for e in evidence) for i in (0, 1))
    both = np.sqrt(evidence[0][:th, :tw] * evidence[1][:th, :tw])
    full = np.repeat(np.repeat(box(both, 3) if smooth else both, tile, 0), tile, 1)[:h, :w]
    out = np.clip((box(full, tile + 1) if smooth else full) / scale, 0, 1)
    order = np.sort(out, axis=None)
    at = lambda q: order[int(q * (out.size - 1))]
    if at(0.95) > 0.9 and (out > 0.5).mean() > 0.3 and at(0.25) > 0.2:
        usual = order[out.size // 2]
        out = np.minimum(out, kept + (1 - kept) * np.clip((out - usual) / max(1 - usual, 1e-6), 0, 1))
    return out


def windows(frames: DataFrame, names: list[str], measure, size: int = 13) -> DataFrame:
    """(stream_id, window, *names): ``measure`` of each run of ``size`` frames (stream_id, pos, height, width, pixels).

    A window is a group of bounded size; one of fewer than three frames is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, w, h, wide, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                m = measure(np.array([f["pixels"] for f in found], float).reshape(len(found), h, wide))
                out.append((s, w, *(float(m[n]) for n in names)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 2 else pa.float64()) for i in range(2 + len(names))], ["stream_id", "window", *names])

    grouped = frames.groupBy("stream_id", F.floor(F.col("pos") / size).alias("window"))
    lists = grouped.agg(F.first("height").alias("h"), F.first("width").alias("w"), F.sort_array(F.collect_list(F.struct("pos", "pixels"))).alias("frames"))
    return lists.where(F.size("frames") >= 3).mapInArrow(run, "stream_id long, window long, " + ", ".join(f"{n} double" for n in names))


# --- what the measures are taken for ---------------------------------------------

#: Columns that ``classified`` reads, and what a missing one counts as.
MEASURES = {
    "density_med": 0.0, "density_p90": 0.0, "amplitude_p90": 0.0, "tail5_med": 0.0, "tail5_p90": 0.0, "rms_p90": 0.0, "lag2_over_lag1": 0.0, "edge_over_flat": 1.0,
    "static_fraction": 0.0, "static_hf": 0.0, "flat_sigma": 0.0, "flat_lag21": 1.0, "flat_thr": 1.0, "mc_sigma": 0.0, "mc_lag21": 1.0, "row_interlace": 0.0,
    "static_row_period": 0.0, "static_row_strength": 0.0, "static_grain": 0.0, "row_coherence": 0.0, "row_periodicity": 0.0, "trace_med": 0.0, "trace_max": 0.0,
}


def _rules(m) -> list[tuple[str, Column, bool]]:
    """(label, rule, whether it also warns), in the order of the report; labels and limits are fixed values."""
    dense = (m("static_fraction") <= 0.06) & (m("density_p90") >= 0.55) & (m("tail5_p90") >= 0.045)
    by_motion = (m("mc_sigma") > 0) & (m("mc_sigma") <= 0.12)
    by_flat = (m("flat_thr") <= 0.045) & (m("flat_sigma") <= 0.12)
    sensor = by_motion & (m("mc_sigma") >= 0.03) & (m("mc_lag21") <= 1.35) | by_flat & (m("flat_sigma") >= 0.03) & (m("flat_lag21") <= 1.3)
    low = by_motion & (m("mc_sigma") < 0.02) & (m("mc_lag21") <= 1.35)
    unsure = (m("edge_over_flat") < 1.8) & (m("lag2_over_lag1") <= 1.3) & (~by_flat | (m("flat_sigma") < 0.02) | (m("flat_lag21") > 1.3)) & (~by_motion | (m("mc_sigma") < 0.02) | (m("mc_lag21") > 1.35))
    moving = (m("lag2_over_lag1") >= 1.35) & (m("density_p90") >= 0.25)
    grain = (m("static_grain") >= 0.015) & (m("static_fraction") >= 0.1) | (m("static_fraction") >= 0.15) & (m("static_hf") >= 0.006) & (m("density_p90") < 0.25)
    scan = (m("row_periodicity") >= 0.5) & (m("row_coherence") >= 0.05) & (m("density_p90") >= 0.05) & (m("amplitude_p90") >= 0.012)
    return [
        ("low temporal noise", (m("tail5_p90") < 0.012) & (m("density_p90") < 0.1), False),
        ("static/structured grain", grain, True),
        ("interlace/field residue", (m("row_interlace") >= 4) & (m("density_p90") >= 0.1), True),
        ("static row banding", (m("static_row_strength") >= 0.6) & (m("static_row_period") >= 2), True),
        ("sparse edge flicker", (m("edge_over_flat") >= 2.5) & (m("density_p90") < 0.45) & (m("amplitude_p90") >= 0.012), True),
        ("row-coherent scanline flicker", scan, True),
        ("pulsed temporal noise", (m("trace_med") > 0) & (m("trace_max") >= F.greatest(F.lit(0.03), 1.55 * m("trace_med"))), False),
        ("motion-like temporal change", moving, True),
        ("source-wide motion contamination", moving & (m("static_fraction") <= 0.15) & (m("density_med") >= 0.55) & (m("tail5_med") >= 0.08), True),
        ("dense temporal change", dense, False),
        ("dense sensor noise", dense & sensor, False),
        ("dense motion, low noise floor", dense & ~sensor & low, False),
        ("motion/noise ambiguous", dense & ~sensor & ~low & unsure, True),
        ("", dense & ~sensor & ~low & ~unsure & (m("lag2_over_lag1") <= 1.35), True),  # little is at rest: a warning without a label
        ("sparse flashes", (m("amplitude_p90") > F.greatest(F.lit(0.08), 2.5 * F.greatest(m("rms_p90"), F.lit(1e-6)))) & (m("density_p90") < 0.35), False),
    ]


def classified(stats: DataFrame) -> DataFrame:
    """Add ``labels``, ``n_warnings`` and ``risk`` to rows of measures; without a label it is ``mixed/low-confidence``.

    high: motion and noise cannot be told apart, or motion is everywhere; medium: anything
    that warns; low: all else.
    """
    m = lambda name: F.coalesce(F.col(name), F.lit(MEASURES[name])) if name in stats.columns else F.lit(MEASURES[name])
    rules = _rules(m)
    found = labels(*((name, rule) for name, rule, _ in rules if name))
    warned = sum((F.when(rule, 1).otherwise(0) for _, rule, warns in rules if warns), F.lit(0))
    out = stats.withColumn("_l", found).withColumn("n_warnings", warned)
    high = F.arrays_overlap("_l", F.array(F.lit("motion/noise ambiguous"), F.lit("source-wide motion contamination")))
    risk = F.when(high, "high").when(F.col("n_warnings") > 0, "medium").otherwise("low")
    return out.withColumn("risk", risk).withColumn("labels", F.when(F.size("_l") > 0, F.col("_l")).otherwise(F.array(F.lit("mixed/low-confidence")))).drop("_l")
