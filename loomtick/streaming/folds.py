"""Stateful operators as streaming queries: one fold for each stream, the state kept by Spark.

A fold is a pure function of (state, row); the batch operators and these give the same
results on the same rows in the same order.  Rows of a stream have to arrive in order
of ``pos``; a row that is not after the last one stops the query, as out-of-order
input does in batch.  State is a small JSON text, so a lost executor costs a replay
from the checkpoint and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[dict[str, Any], int, int, float], tuple[dict[str, Any], float]]


def cut_step(threshold: float) -> Step:
    """Number of the segment: grows where the value jumps by more than the threshold."""

    def step(state: dict[str, Any], pos: int, pts: int, value: float) -> tuple[dict[str, Any], float]:
        segment = state.get("segment", 0) + ("last" in state and abs(value - state["last"]) > threshold)
        return {"segment": segment, "last": value}, float(segment)

    return step


def ema_step(alpha: float) -> Step:
    def step(state: dict[str, Any], pos: int, pts: int, value: float) -> tuple[dict[str, Any], float]:
        e = alpha * value + (1 - alpha) * state["e"] if "e" in state else value
        return {"e": e}, e

    return step


def pulse_step(history: int = 48, least: int = 8, floor: float = 0.002, low: float = 0.6, high: float = 1.8) -> Step:
    def step(state: dict[str, Any], pos: int, pts: int, value: float) -> tuple[dict[str, Any], float]:
        # the window holds `history` rows, of which the first one of a stream has no spread
        past = state.get("past", [])
        spread = abs(value - state["last"]) / 1.4142135623730951 if "last" in state else None
        past = [*past, spread][-history:]
        known = sorted(x for x in past if x is not None)
        gain = 1.0
        if spread is not None and len(known) >= least and (ref := known[len(known) // 2]) >= floor:
            gain = max(low, min(high, spread / ref))
        return {"last": value, "past": past}, gain

    return step


def difference_step() -> Step:
    """Distance of the row before from the mean of its neighbours; the answer comes a row late (null until then)."""

    def step(state: dict[str, Any], pos: int, pts: int, value: float) -> tuple[dict[str, Any], float]:
        v = int(value // 1)
        last = [*state.get("last", []), v][-3:]
        out = abs(last[1] - (last[0] + last[2]) // 2) if len(last) == 3 else float("nan")
        return {"last": last}, float(out)

    return step


def fold(stream: DataFrame, step: Step) -> DataFrame:
    """(stream_id, pos, pts, out) of a streaming DataFrame with stream_id, pos, pts and value.

    With a ``segment_id``, each segment starts from an empty state.
    """
    cuts = "segment_id" in stream.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"pos": None, "segment": None, "fold": {}}
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for pos, pts, value, segment in rows[["pos", "pts", "value", "segment"]].itertuples(index=False):
            if now["pos"] is not None and pos <= now["pos"]:
                raise ValueError(f"stream {key[0]}: row {pos} came after row {now['pos']}")
            if segment != now["segment"]:
                now["segment"], now["fold"] = int(segment), {}
            now["fold"], result = step(now["fold"], int(pos), int(pts), float(value))
            now["pos"] = int(pos)
            out.append((key[0], int(pos), int(pts), result))
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=["stream_id", "pos", "pts", "out"])

    schema = "stream_id long, pos long, pts long, out double"
    segment = F.col("segment_id") if cuts else F.lit(0)
    return stream.select("stream_id", "pos", "pts", "value", segment.cast("long").alias("segment")).groupBy("stream_id").applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def centered(stream: DataFrame, radius: int, reduce: Callable[[list[float], int], float]) -> DataFrame:
    """(stream_id, pos, pts, out) of a function of the rows around each row and its place among them.

    A row comes out once ``radius`` rows follow it.  A cut (``segment_id``) ends a window: the rows
    before it come out with the rows that they have, as the last ones of a stream do once
    its next segment begins.  The state is 2 * radius rows.
    """
    cuts = "segment_id" in stream.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"segment": None, "rows": [], "next": 0}
        out: list[tuple] = []

        def emit(most: int) -> None:
            """Rows with all that will ever follow them, or ``radius`` rows at least."""
            while now["next"] < most:
                i = now["next"]
                lo = max(0, i - radius)
                around = [r[2] for r in now["rows"][lo : i + radius + 1]]
                out.append((key[0], *now["rows"][i][:2], reduce(around, i - lo)))
                now["next"] += 1
            gone = max(0, now["next"] - radius)
            now["rows"], now["next"] = now["rows"][gone:], now["next"] - gone

        for pos, pts, value, segment in pd.concat(list(frames)).sort_values("pos")[["pos", "pts", "value", "segment"]].itertuples(index=False):
            if now["rows"] and pos <= now["rows"][-1][0]:
                raise ValueError(f"stream {key[0]}: row {pos} came after row {now['rows'][-1][0]}")
            if segment != now["segment"]:
                emit(len(now["rows"]))
                now.update(segment=int(segment), rows=[], next=0)
            now["rows"].append([int(pos), int(pts), float(value)])
            emit(len(now["rows"]) - radius)
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=["stream_id", "pos", "pts", "out"])

    schema = "stream_id long, pos long, pts long, out double"
    segment = F.col("segment_id") if cuts else F.lit(0)
    rows = stream.select("stream_id", "pos", "pts", "value", segment.cast("long").alias("segment"))
    return rows.groupBy("stream_id").applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in time windows, final once the watermark has passed them."""
    w = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts of events of each user in sessions that a gap ends."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
