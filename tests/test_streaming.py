"""Streaming folds give what the batch operators give; writers publish together."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from loomtick.operators import streams, temporal
from loomtick.sources import tables
from loomtick.streaming import folds

SCHEMA = "stream_id long, pos long, pts long, value double"


def files(spark, tmp_path, n=60, parts=3):
    rows = [(s, i, i * 40_000, float((i * 37 + s * 11) % 23) + (100 if i % 17 == s else 0)) for s in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    for p in range(parts):  # later rows in later files
        df.where((F.col("pos") >= p * n // parts) & (F.col("pos") < (p + 1) * n // parts)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def streamed(spark, tmp_path, step, name):
    q = folds.fold(tables.read_stream(spark, str(tmp_path / "in"), SCHEMA), step).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.stream_id, r.pos): r.out for r in spark.table(name).collect()}


def test_folds_match_batch(spark, tmp_path):
    df = files(spark, tmp_path)
    last = F.lag("value").over(streams.by_stream())
    spread = F.abs(F.col("value") - last) / 1.4142135623730951
    batch = {
        "seg": ({(r.stream_id, r.pos): r.segment_id for r in streams.with_segments(df, streams.jump(30)).collect()}, folds.cut_step(30)),
        "ema": ({(r.stream_id, r.pos): r.ema for r in temporal.ema(df, 0.3).collect()}, folds.ema_step(0.3)),
        "pulse": ({(r.stream_id, r.pos): r.gain for r in temporal.pulse_gain(df, spread, history=20).collect()}, folds.pulse_step(history=20)),
    }
    for name, (want, step) in batch.items():
        got = streamed(spark, tmp_path, step, name)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want), name
    late = streamed(spark, tmp_path, folds.difference_step(), "tsd")
    want = {(r.stream_id, r.pos + 1): r.tsd for r in temporal.temporal_difference(df).collect()}
    assert {k: v for k, v in late.items() if v is not None} == want


CUT = SCHEMA + ", segment_id long"


def cut_files(spark, tmp_path):
    rows = [(s, i, i * 40_000, float((i * 37 + s * 11) % 23), 0 if i < 17 else 1 if i < 18 + s else 2) for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, CUT)
    for lo, hi in ((0, 13), (13, 30), (30, 40)):
        df.where(F.col("pos").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def results(spark, tmp_path, made, name):
    q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.stream_id, r.pos): r.out for r in spark.table(name).collect()}


def test_folds_and_windows_start_anew_at_cuts(spark, tmp_path):
    df = cut_files(spark, tmp_path)
    source = lambda: tables.read_stream(spark, str(tmp_path / "in"), CUT)
    got = results(spark, tmp_path, folds.fold(source(), folds.ema_step(0.3)), "ema_cuts")
    want = {(r.stream_id, r.pos): r.ema for r in temporal.ema(df, 0.3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    got = results(spark, tmp_path, folds.centered(source(), 3, lambda around, i: sum(around) / len(around)), "mean_cuts")
    mean = F.avg("value").over(streams.in_order(df).rowsBetween(-3, 3))
    want = {(r.stream_id, r.pos): r.m for r in df.withColumn("m", mean).collect()}
    assert all(math.isclose(v, want[k], abs_tol=1e-9) for k, v in got.items())
    assert set(want) - set(got) == {(s, p) for s in (1, 2) for p in (37, 38, 39)}  # no row follows the last ones


def test_rows_out_of_order_are_refused(spark, tmp_path):
    for p in (5, 3):
        spark.createDataFrame([(1, p, 0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="came after row|terminated"):
        streamed(spark, tmp_path, folds.ema_step(0.5), "bad")


def test_publish(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tables.publish({a: spark.range(3), b: spark.range(4)})
    assert spark.read.parquet(a).count() == 3
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        tables.publish({a: spark.range(9), b: broken})
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 4
    tables.publish({a: spark.range(9)})
    assert spark.read.parquet(a).count() == 9 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    for bad in ({a: spark.range(1), a + "/x": spark.range(1)}, {a: spark.range(1), a + "/": spark.range(1)}):
        with pytest.raises(ValueError):
            tables.publish(bad)


def test_manifest_and_durations(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.bin").write_bytes(b"x")
    (tmp_path / "m/y.bin").write_bytes(b"y")
    rows = [("x.bin", hashlib.sha256(b"x").hexdigest()), ("y.bin", "00"), ("z.bin", "00")]
    out = dict(map(tuple, tables.manifest_check(spark, str(tmp_path / "m"), spark.createDataFrame(rows, "path string, sha256 string")).collect()))
    assert out == {"x.bin": "ok", "y.bin": "changed", "z.bin": "missing"}
    df = spark.createDataFrame([(1, i, t, 0.0) for i, t in enumerate([0, 10, 40, 50])] + [(2, 0, 0, 0.0)], SCHEMA)
    assert [r.duration for r in tables.with_durations(df, 7).orderBy("stream_id", "pos").collect()] == [10, 30, 10, 10, 7]
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")
