"""State machines over the rows of a segment: an output guard, refreshes at sync rows, recursive filters."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.operators.ordered import ordered
from loomtick.operators.streams import in_order


def smoothstep(t: Column) -> Column:
    """Eased ramp from 0 to 1, clamped outside."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3 - 2 * t)


@dataclass(frozen=True)
class Guard:
    """Settings of ``guarded``: areas are shares of a frame, times are rows."""

    limit: float = 0.1  # a mean change above it is a catastrophe
    trip: float = 0.01
    streak: int = 2  # tripped rows in a row that lock the output
    resume: float = 0.5  # a locked output resumes at this share of the trip area
    hard: float = 0.04  # from this area on there is no fading out
    lockout: int = 48  # rows between probes while locked; 0: never again
    rise: int = 12  # rows to fade in; 0: at once
    fall: int | None = None  # rows to fade out; by default a quarter of the rise, 2 at least

    @property
    def falling(self) -> int:
        return self.fall if self.fall is not None else max(2, self.rise // 4) if self.rise else 0


def guarded(rows: Iterable[tuple[float, float]], g: Guard) -> Iterator[tuple[str, float, bool]]:
    """(state, weight, damped) of rows (area, mean) of a change.

    ``weight`` is the share of the change that is let through, ``damped`` whether its
    hot spots are pressed down before.  state: ``open``; ``tripped``; ``locked`` (not
    looked at); ``held`` (looked at while locked and not clean enough).
    """
    gain, streak, wait = 1.0, 0, None  # wait: rows to the next probe while locked
    up = lambda x: min(1.0, x + 1 / g.rise) if g.rise else 1.0
    down = lambda x: max(0.0, x - 1 / g.falling) if g.falling else 0.0
    eased = lambda x: x * x * (3 - 2 * x)
    for area, mean in rows:
        if wait is not None and (wait := wait - 1) > 0:
            gain = down(gain)
            yield "locked", 0.0, False
            continue
        catastrophe = mean > g.limit
        bad = catastrophe or area >= g.trip
        unsure = wait is not None and area > g.trip * g.resume
        if not bad and not unsure:
            wait, streak, gain = None, 0, up(gain)
            yield "open", eased(gain), False
            continue
        if bad:
            streak += 1
        if wait is not None or catastrophe or streak >= g.streak:
            wait = g.lockout or math.inf
        gain = 0.0 if bad and (catastrophe or area >= g.hard) else down(gain)
        yield ("tripped", eased(gain), gain > 0) if bad else ("held", 0.0, False)


def output_guard(rows: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """(stream_id, pos, state, weight, damped) of rows (stream_id, segment_id, pos, area, mean).

    A new segment begins open.
    """
    return _by_segment(rows.select("stream_id", "segment_id", "pos", "area", "mean"), lambda part: guarded(part, guard), "state string, weight double, damped boolean")


def refreshes(sync: Iterable[bool], window: int = 12, least: int = 6, longest: int = 64) -> Iterator[tuple[bool, int]]:
    """(refreshed, age): when an estimate over the last ``window`` rows is made anew.

    The first one is made once ``least`` rows are there.  Later ones come at a sync row
    when the window holds rows of its own only, or after ``longest`` rows.  ``age``
    counts the rows that an estimate has served; it is 0 where there is none yet too.
    """
    age, seen, made = 0, 0, False
    for s in sync:
        seen += 1
        due = age >= longest or (s and age >= window) or not made
        now = due and min(seen, window) >= least
        made, age = made or now, 0 if now else age + 1
        yield now, age if made else 0


def refresh_at_sync(rows: DataFrame, window: int = 12, least: int = 6, longest: int = 64) -> DataFrame:
    """(stream_id, pos, refreshed, age) of rows (stream_id, segment_id, pos, is_sync), by ``refreshes``."""
    return _by_segment(rows.select("stream_id", "segment_id", "pos", "is_sync"), lambda part: refreshes((s for (s,) in part), window, least, longest), "refreshed boolean, age long")


def recursive_blend(rows: DataFrame, strength: float, sigma: float) -> DataFrame:
    """(stream_id, pos, blended): each row mixed with the blend before it, the less the farther it lies.

    The weight of the past is strength * exp(-(distance / sigma)^2) against 1; the blend
    stays within the row and what came before.  A segment starts anew.
    """

    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        past = None
        for (value,) in part:
            w = 0.0 if past is None else strength * math.exp(-(((value - past) / sigma) ** 2))
            past = (value + w * (past or 0.0)) / (1 + w)
            yield (past,)

    return _by_segment(rows.select("stream_id", "segment_id", "pos", "value"), run, "blended double")


def guarded_output(rows: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """``rows`` (stream_id, pos, value, candidate, area, mean, ...) with the share of ``candidate`` that the guard lets through as value.

    ``candidate`` is what a model made of the row elsewhere; adds ``state`` and ``weight``.
    """
    df = rows if "segment_id" in rows.columns else rows.withColumn("segment_id", F.lit(0).cast("long"))
    made = output_guard(df, guard).select("stream_id", "pos", "state", "weight")
    mixed = F.col("value") + F.col("weight") * (F.col("candidate") - F.col("value"))
    return rows.join(made, ["stream_id", "pos"]).withColumn("value", mixed)


def held_estimate(rows: DataFrame, estimate: str, window: int = 12, least: int = 6, longest: int = 64) -> DataFrame:
    """Add ``held``: the estimate of the last row at which one was made anew (see ``refreshes``); null before the first."""
    df = rows if "segment_id" in rows.columns else rows.withColumn("segment_id", F.lit(0).cast("long"))
    made = df.join(refresh_at_sync(df, window, least, longest).select("stream_id", "pos", "refreshed"), ["stream_id", "pos"])
    so_far = in_order(made).rowsBetween(W.unboundedPreceding, 0)
    held = F.last(F.when(F.col("refreshed"), F.col(estimate)), ignorenulls=True).over(so_far)
    return made.withColumn("held", held).select(*rows.columns, "held")


def admission(current: Column, plain: Column, aligned: Column, strength: float = 1.0, ramp: float = 0.004, sigma: float = 0.035) -> Column:
    """How much history a row admits: it has to come nearer when aligned, and near at all."""
    near, far = F.abs(current - aligned), F.abs(current - plain)
    better = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (far - near) / ramp))
    return strength * better * F.exp(-F.pow(near / sigma, 2))


def _by_segment(rows: DataFrame, fold, schema: str) -> DataFrame:
    """A fold over (stream_id, segment_id, pos, *inputs) that starts anew with each segment."""

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        head = next(stream, None)
        while head is not None:
            segment, names, ahead = head[1], deque(), [head]

            def inputs() -> Iterator[tuple]:
                while ahead and ahead[0][1] == segment:  # noqa: B023
                    row = ahead.pop()  # noqa: B023
                    names.append(row[:3:2])  # noqa: B023
                    yield row[3:]
                    if (row := next(stream, None)) is not None:
                        ahead.append(row)  # noqa: B023

            for out in fold(inputs()):
                yield (*names.popleft(), *out)
            head = ahead[0] if ahead else None

    return ordered(rows, ["segment_id", "pos"], run, f"stream_id long, pos long, {schema}")
