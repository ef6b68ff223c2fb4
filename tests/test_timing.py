"""Exact values of the time operators, and folds against their definition."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomtick.functions.rational import half_even
from loomtick.operators import evaluation, streams, timing


def stream(spark, *times, values=None):
    rows = [(s, i, t, float(values[i] if values else i)) for s, ts in enumerate(times) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "stream_id long, pos long, pts long, value double")


def test_half_even(spark):
    rows = [(n, d) for n in range(-30, 31) for d in (1, 2, 3, 4, 7, 10)]
    out = spark.createDataFrame(rows, "n long, d long").select("n", "d", half_even(F.col("n"), F.col("d")).alias("q")).collect()
    assert all(r.q == round(Fraction(r.n, r.d)) for r in out)


def test_verdicts(spark):
    exact, cfr, gapped, vfr, single, twice = [0, 40, 80, 120], [0, 33, 67, 100], [0, 40, 120, 160], [0, 10, 47, 300], [5], [0, 0, 40]
    out = timing.verdict(stream(spark, exact, cfr, gapped, vfr, single, twice)).orderBy("stream_id").collect()
    assert [r.verdict for r in out] == ["exact_cfr", "cfr", "gapped_cfr", "vfr", "single", "vfr"]
    assert [r.interval for r in out] == [40, None, 40, None, None, None]


def conformed(times, interval):
    """Row by row: each slot goes to the nearest row, the earlier of two."""
    zero, out = times[0], []
    slot = 0
    for i, t in enumerate(times):
        limit = Fraction(t - zero + (times[i + 1] - zero if i + 1 < len(times) else t - zero + interval), 2)
        while slot * interval <= limit:
            out.append((slot, i))
            slot += 1
    return out


def test_conform_matches_a_state_machine(spark):
    rng = random.Random(3)
    many = []
    for _ in range(60):
        t, ts = rng.randrange(100), []
        for _ in range(rng.randrange(1, 15)):
            ts.append(t)
            t += rng.randrange(1, 130)
        many.append(ts)
    out = timing.conform(stream(spark, *many), 40).collect()
    for s, ts in enumerate(many):
        assert sorted((r.slot, r.pos) for r in out if r.stream_id == s) == conformed(ts, 40)


def test_fan_out_is_refused(spark):
    with pytest.raises(Exception, match="10000 slots"):
        timing.conform(stream(spark, [0, 10_000_000]), 10).collect()


def test_unwrap():
    clean = [i * 40_000 for i in range(400)]
    assert timing.unwrap_clock(clean) == clean
    reset = clean + [i * 40_000 for i in range(50)]
    assert timing.unwrap_clock(reset) == [i * 40_000 for i in range(450)]
    outlier = clean[:300] + [0] + clean[301:]
    assert timing.unwrap_clock(outlier)[301:] == clean[301:]  # one row behind is no reset
    assert timing.unwrap_clock([0, 10_000_000, 0, 40_000])[2:] == [0, 40_000]  # exactly the limit is none


def test_sync_windows_emit_each_row_once():
    rng = random.Random(5)
    assert timing.sync_windows([True, False, False, True, False], 2, 10) == [(0, 4, 0, 3), (3, 5, 3, 5)]
    assert timing.sync_windows([False] * 7, 2, 3) == [(0, 5, 0, 3), (1, 7, 3, 6), (4, 7, 6, 7)]
    assert timing.sync_windows([], 2, 3) == []
    for _ in range(300):
        sync = [rng.random() < 0.2 for _ in range(rng.randrange(40))]
        windows = timing.sync_windows(sync, 3, 8)
        assert [p for w in windows for p in range(w[2], w[3])] == list(range(len(sync)))
        assert all(w[0] <= w[2] and w[3] <= w[1] for w in windows)


def test_fixed_windows(spark):
    out = spark.range(1, 40).select("id", timing.fixed_windows(F.col("id"), 10, 2).alias("w")).collect()
    for r in out:
        assert [p for w in r.w for p in range(w.emit_from, w.emit_to)] == list(range(r.id))
        assert all(w.process_from <= w.emit_from and w.emit_to <= w.process_to <= r.id for w in r.w)


def test_segments_equal_runs_apart(spark):
    whole = streams.with_segments(stream(spark, range(6), values=[0, 0, 50, 50, 0, 0]), streams.jump(10))
    assert [r.segment_id for r in whole.orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2]


def test_gop_positions_before_the_first_sync(spark):
    df = stream(spark, range(5)).withColumn("k", F.col("pos").isin(2, 4))
    out = streams.gop_positions(df, F.col("k")).orderBy("pos").collect()
    assert [(r.gop_ordinal, r.gop_length) for r in out] == [(0, 2), (1, 2), (0, 2), (1, 2), (0, 1)]
    none = streams.gop_positions(df, F.lit(False)).collect()
    assert all(r.gop_ordinal is None for r in none)


def test_tracks(spark):
    rows = [(1, 0, 0.9, 0, 0, 10, 10), (1, 0, 0.8, 100, 0, 110, 10), (1, 1, 0.7, 1, 0, 11, 10), (1, 3, 0.9, 101, 0, 111, 10), (1, 20, 0.9, 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "stream_id long, frame long, score double, x0 long, y0 long, x1 long, y1 long")
    assert [r.track for r in evaluation.tracks(df).orderBy("frame", F.desc("score")).collect()] == [1, 2, 1, 2, 3]


def test_as_of_keeps_left_rows(spark):
    left = stream(spark, [5, 10, 10], [1])
    right = stream(spark, [1, 10], [2])
    out = timing.as_of(left, right, ["stream_id"], "pts", ["value"]).orderBy("stream_id", "pos").collect()
    assert [r.value_as_of for r in out] == [0.0, 1.0, 1.0, None]
