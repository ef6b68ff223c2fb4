"""Frames in other colour formats, and how a crop compares with what it was made from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtick.plans.spec import luma

#: Scale and offset of luma, and scale of chroma (around 512), in 10 bits: full and video range (fixed values).
RANGES = {True: (1023, 0, 1023), False: (876, 64, 896)}


def planes_422(rgb: np.ndarray, matrix: str = "bt709", full_range: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(luma, chroma) of a frame (lines, even columns, 3) in [0, 1], as 10 bits in the upper part of 16.

    Chroma lies at the even columns, weighed 1, 2, 1 over its neighbours; the two kinds
    alternate along a line.  Rounding is half to even.
    """
    red, green, blue = luma(matrix)
    scale, offset, chroma_scale = RANGES[full_range]
    y = rgb @ np.array([red, green, blue])
    whole = lambda x: np.clip(np.rint(x), 0, 1023).astype(np.uint16) << 6
    out = []
    for channel, weight in ((2, blue), (0, red)):
        c = (rgb[..., channel] - y) / (2 * (1 - weight)) * chroma_scale + 512
        padded = np.concatenate([c[:, :1], c], axis=1)  # the first column stands for the one before it
        out.append(whole((padded[:, 0:-1:2] + 2 * c[:, 0::2] + c[:, 1::2]) / 4))
    return whole(y * scale + offset), np.stack(out, -1).reshape(rgb.shape[:2])


#: How much each ratio below 1 counts for a crop, and what counts against it: (measure, limit, weight), fixed values.
CLEANUP = {"chroma_hf": 0.28, "temporal_hf_diff": 0.24, "row_score": 0.20, "hf_luma": 0.12}
AT_LEAST = (("grad_ratio", 0.970, 2.0), ("ssim_luma", 0.988, 2.2), ("grad_corr", 0.988, 0.7))
AT_MOST = (("mae_luma", 0.006, 8.0), ("chroma_drift", 0.006, 8.0))


def crop_score() -> Column:
    """100 times what a candidate cleans up less what it fails to keep, from columns named as the tables above (``_ratio`` for CLEANUP)."""
    gained = sum((w * (1 - F.col(f"{n}_ratio")) for n, w in CLEANUP.items()), F.lit(0.0))
    lost = sum((w * F.greatest(F.lit(0.0), limit - F.col(n)) for n, limit, w in AT_LEAST), F.lit(0.0))
    lost = sum((w * F.greatest(F.lit(0.0), F.col(n) - limit) for n, limit, w in AT_MOST), lost)
    return 100 * (gained - lost)


def similarity(pairs: DataFrame, keys: list[str], base: str, candidate: str) -> DataFrame:
    """(*keys, ssim, corr, mae) of sample arrays of two crops: one structural similarity over all samples, correlation, mean distance."""
    samples = pairs.select(*keys, F.explode(F.arrays_zip(F.col(base).alias("a"), F.col(candidate).alias("b"))).alias("s")).select(*keys, "s.a", "s.b")
    a, b = F.col("a"), F.col("b")
    sums = samples.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("c"), F.avg(F.abs(b - a)).alias("mae"))
    c = F.col
    ssim = (2 * c("ma") * c("mb") + 1e-4) * (2 * c("c") + 9e-4) / ((c("ma") ** 2 + c("mb") ** 2 + 1e-4) * (c("va") + c("vb") + 9e-4))
    spread = F.sqrt(c("va") * c("vb"))
    return sums.select(*keys, ssim.alias("ssim"), F.when(spread <= 1e-15, 0.0).otherwise(c("c") / F.when(spread > 1e-15, spread)).alias("corr"), "mae")
