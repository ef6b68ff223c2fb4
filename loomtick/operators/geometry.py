"""Windows of frames by aspect and anchor, square pixels, borders that are filled and put back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtick.operators.kernels import extend_edges, resample
from loomtick.operators.selection import taken

#: Where a window lies in what it leaves over, down and across (fixed names).
ANCHORS = {f"{v}-{h}".replace("center-center", "center").replace("center-", "").replace("-center", ""): (y, x) for v, y in (("top", 0), ("center", 0.5), ("bottom", 1)) for h, x in (("left", 0), ("center", 0.5), ("right", 1))}


def aspect_window(width: int, height: int, aspect: tuple[int, int], dx: int = 0, dy: int = 0, anchor: str = "center") -> tuple[int, int, int, int]:
    """(top, bottom, left, right) to cut for the even window nearest to an aspect; of equally near ones the largest.

    Looked at are the largest whole window, and the even ones that fit the width or the height first.
    """
    a, b = aspect
    if a <= 0 or b <= 0:
        raise ValueError(f"an aspect is positive, not {a}:{b}")
    if anchor not in ANCHORS:
        raise ValueError(f"unknown anchor {anchor!r}; known: {', '.join(sorted(ANCHORS))}")
    even = lambda n: n - n % 2
    wide, high = min(width, height * a // b), min(height, width * b // a)
    inner = min(height, wide * b // a)
    found = {(even(min(wide, inner * a // b)), even(inner)), (even(wide), even(min(height, even(wide) * b // a))), (even(min(width, even(high) * a // b)), even(high))}
    found = {(w, h) for w, h in found if w >= 2 and h >= 2}
    if not found:
        raise ValueError(f"{a}:{b} leaves nothing of {width} x {height}")
    w, h = min(found, key=lambda s: (abs(s[0] * b / (s[1] * a) - 1), -s[0] * s[1]))
    y, x = ANCHORS[anchor]
    left = min(max(0, round((width - w) * x) + dx), width - w)
    top = min(max(0, round((height - h) * y) + dy), height - h)
    return top, height - h - top, left, width - w - left


def cut(x: np.ndarray, edges: tuple[int, int, int, int]) -> np.ndarray:
    """A frame without its edges (top, bottom, left, right)."""
    top, bottom, left, right = edges
    return x[top : x.shape[0] - bottom, left : x.shape[1] - right]


def square_width(width: int, pixel_aspect: Fraction) -> int:
    """The even width at which pixels of an aspect become square; the width itself if none of two or more is."""
    made = round(width * pixel_aspect)
    made -= made % 2
    return width if pixel_aspect == 1 or made < 2 else made


def squared(x: np.ndarray, pixel_aspect: Fraction) -> np.ndarray:
    """A frame with square pixels."""
    to = square_width(x.shape[1], pixel_aspect)
    return x if to == x.shape[1] else resample(x, to)


def restored(processed: np.ndarray, original: np.ndarray, edges: tuple[int, int, int, int], feather: int = 0) -> np.ndarray:
    """The original's borders over a processed frame, faded into it over ``feather`` samples inside."""
    h, w = processed.shape[:2]
    top, bottom, left, right = edges
    y, x = np.arange(h)[:, None], np.arange(w)[None, :]
    far = np.full((h, w), np.inf)  # how far inside the nearest border band
    for size, inside in ((top, y - top), (bottom, h - 1 - bottom - y), (left, x - left), (right, w - 1 - right - x)):
        if size:
            far = np.minimum(far, inside)
    share = np.clip((far + 1) / (feather + 1), 0, 1) if feather else (far >= 0).astype(float)
    return original + share * (processed - original)


def sanitised(x: np.ndarray, edges: tuple[int, int, int, int]) -> np.ndarray:
    """Border bands filled from the inside."""
    return extend_edges(x, *edges)


def mapped(frames: DataFrame, kernel: Callable[..., np.ndarray], extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Frames (height, width, pixels, ...) by a kernel of a frame and ``extra`` pixel columns; a null pixel column is None."""
    names = frames.columns
    at = [names.index(c) for c in ("height", "width", "pixels")]

    def plane(value: pa.Scalar, h: int, w: int) -> np.ndarray | None:
        return np.asarray(value.values.to_numpy(zero_copy_only=False), float).reshape(h, w) if value.is_valid else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = list(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True))
            others = [batch.column(names.index(c)) for c in extra]
            made = [kernel(plane(batch.column(at[2])[i], *s), *(plane(o[i], *s) for o in others)) for i, s in enumerate(shapes)]
            columns = list(batch.columns)
            columns[at[0]] = pa.array([x.shape[0] for x in made], batch.schema.field(at[0]).type)
            columns[at[1]] = pa.array([x.shape[1] for x in made], batch.schema.field(at[1]).type)
            columns[at[2]] = pa.array([x.ravel() for x in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = frames.withColumn("pixels", frames["pixels"].cast("array<double>"))
    return rows.mapInArrow(run, rows.schema)


def with_borders(processed: DataFrame, originals: DataFrame, edges: tuple[int, int, int, int], feather: int = 0) -> DataFrame:
    """Processed frames with the borders of the originals at their stamps; one without an original passes through."""
    both = taken(processed, originals, ["pixels"])
    out = mapped(both, lambda x, o: x if o is None else restored(x, o, edges, feather), ["original_pixels"])
    return out.drop("original_pixels")
