"""Folds, guards, sample windows, cadences and the time grammar against plain definitions."""

import random
import tomllib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomtick.__main__ import main
from loomtick.functions import clock
from loomtick.operators import evaluation, guards, samples, temporal, timing
from loomtick.operators.ordered import ordered
from loomtick.plans import compiler, config
from loomtick.plans.spec import StreamSpec
from loomtick.sources.tables import with_durations


def stream(spark, *times):
    return spark.createDataFrame([(s, i, t) for s, ts in enumerate(times) for i, t in enumerate(ts)], "stream_id long, pos long, pts long")


def test_ordered_keeps_keys_and_order_apart(spark):
    rows = [(k, i, None if i == 3 else float(i)) for k in (None, 1, 2, 3) for i in random.Random(1).sample(range(20_000), 20_000 if k == 1 else 20)]
    df = spark.createDataFrame(rows, "stream_id long, pos long, value double")
    out = ordered(df, ["pos"], lambda part: [(next(part)[0], 1 + sum(1 for _ in part))], "stream_id long, n long")
    assert sorted(out.collect(), key=str) == sorted([(None, 20), (1, 20_000), (2, 20), (3, 20)], key=str)
    assert ordered(df.where("pos < 0"), ["pos"], lambda part: part, df.schema.simpleString()[7:-1].replace(":", " ")).count() == 0
    seen = ordered(df.where("stream_id = 1"), ["pos"], lambda part: ((p[0], p[1]) for p in part), "stream_id long, pos long")
    assert [r.pos for r in seen.collect()] == list(range(20_000))
    with pytest.raises(ValueError, match="first column"):
        ordered(df.select("pos", "stream_id"), ["pos"], lambda part: part, "a long")


def test_ema_passes_over_nulls(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 4.0), (1, 2, None), (1, 3, 8.0)], "stream_id long, pos long, value double")
    assert [r.ema for r in temporal.ema(df, 0.5).orderBy("pos").collect()] == [None, 4.0, 4.0, 6.0]


def rows(areas, mean=0.0):
    return [(a, mean) for a in areas]


def test_guard_locks_and_resumes():
    g = guards.Guard(lockout=4, rise=4)
    got = list(guards.guarded(rows([0, 0.02, 0.02, *[0] * 12]), g))
    assert [s for s, _, _ in got] == ["open", "tripped", "tripped", "locked", "locked", "locked", *["open"] * 9]
    assert [w for _, w, _ in got][:3] == [1.0, 0.5, 0.0] and got[1][2] and not got[2][2]  # fades out over two rows
    rising = [w for _, w, _ in got][6:10]
    assert rising == sorted(rising) and rising[-1] == 1.0 and rising[0] == pytest.approx(0.15625)


def test_guard_edges():
    g = guards.Guard(lockout=3)
    one = list(guards.guarded(rows([0.02, 0, 0.02, 0]), g))
    assert [s for s, _, _ in one] == ["tripped", "open", "tripped", "open"]  # single rows do not lock
    held = list(guards.guarded(rows([0.02, 0.02, 0, 0, 0.007, 0, 0, 0.004]), g))
    assert [s for s, _, _ in held][4:] == ["held", "locked", "locked", "open"]
    assert list(guards.guarded(rows([0.05]), g)) == [("tripped", 0.0, False)]  # too large to fade
    wild = list(guards.guarded([(0.0, 0.2), *rows([0] * 100)], guards.Guard(lockout=0)))
    assert wild[0] == ("tripped", 0.0, False) and {s for s, _, _ in wild[1:]} == {"locked"}


def test_guard_begins_anew_with_a_segment(spark):
    df = spark.createDataFrame([(1, i // 5, i, 0.5 if i == 2 else 0.0, 0.0) for i in range(15)], "stream_id long, segment_id long, pos long, area double, mean double")
    out = guards.output_guard(df, guards.Guard(streak=1, lockout=0)).orderBy("pos").collect()
    assert [r.state for r in out] == ["open"] * 2 + ["tripped", "locked", "locked"] + ["open"] * 10
    assert [r.pos for r in out] == list(range(15)) and guards.output_guard(df.where("pos < 0")).count() == 0


def test_refresh():
    sync = [i in (3, 8, 30) for i in range(120)]
    at = [i for i, (now, _) in enumerate(guards.refreshes(sync)) if now]
    assert at == [5, 30, 95]  # sixth row; a sync row 12 rows on; 64 rows served without one
    assert not any(now for now, _ in guards.refreshes([True] * 5))


def test_sample_window_rounds_the_cap_by_itself(spark):
    cases = [(1000, 1500, 5500, None), (1000, 500, None, 1500), (1000, 2500, 2500, None), (4, 0, 9_000_000, None), (None, 1500, 4500, 2500), (3, 9_000_000, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, total long, a long, z long, cap long")
    first, stop = samples.sample_window(F.col("total"), 1000, F.col("a"), F.col("z"), F.col("cap"))
    for r in df.select("*", first.alias("first"), stop.alias("stop")).collect():
        n = lambda t: max(0, round(Fraction(t * 1000, 1_000_000)))
        lo = n(r.a) if r.total is None else min(n(r.a), r.total)
        hi = r.total if r.z is None else n(r.z) if r.total is None else min(n(r.z), r.total)
        hi = hi if r.cap is None else min(hi, lo + n(r.cap))
        assert (r.first, r.stop) == (lo, max(lo, hi))
    with pytest.raises(Exception, match="no usable end"):
        spark.range(1).select(samples.sample_window(F.lit(None).cast("long"), 1000, F.lit(0), F.lit(None).cast("long"), F.lit(5))[1]).collect()


def test_segments_and_gaps(spark):
    assert list(samples.snapped_starts(iter([(0, 10), (11, 10), (19, 10), (40, 5)]), Fraction(1, 3))) == [(0, 10), (10, 20), (20, 30), (40, 45)]
    with pytest.raises(ValueError, match="overlaps"):
        list(samples.snapped_starts(iter([(0, 10), (7, 10)]), Fraction(2)))
    df = spark.createDataFrame([(1, 0, 5, 10), (1, 1, 10, 20), (1, 2, 35, 40), (2, 0, 90, 95)], "stream_id long, pos long, start long, stop long")
    out = samples.fill_gaps(df, F.lit(2), F.lit(38)).orderBy("stream_id", "start").collect()
    assert [tuple(r) for r in out] == [(1, 2, 5, None), (1, 5, 10, 0), (1, 10, 20, 1), (1, 20, 35, None), (1, 35, 38, 2), (2, 2, 38, None)]
    met = samples.place(F.col("a"), F.col("b"), F.lit(10), F.lit(20), F.lit(None).cast("long"))
    got = spark.createDataFrame([(0, 15), (12, 30), (20, 30)], "a long, b long").select(met.alias("p")).collect()
    assert [r.p and tuple(r.p) for r in got] == [(10, 0, 5), (0, 2, 8), None]


def test_cadence(spark):
    ntsc = [round(Fraction(i * 1001 * 1_000_000, 30000)) for i in range(50)]
    lost = ntsc[:20] + ntsc[23:]
    out = {r.stream_id: r for r in timing.cadence(stream(spark, ntsc, lost, [0, 40_000, 80_000], [0, 40_000, 120_000], [0, 10, 47, 300], [7], [0, 0, 4])).collect()}
    assert [out[i].verdict for i in range(7)] == ["uniform", "gapped", "uniform", "gapped", "variable", "variable", "variable"]
    for i, interval in {0: Fraction(1001_000_000, 30000), 1: Fraction(1001_000_000, 30000), 2: 40_000, 3: 40_000}.items():
        assert Fraction(out[i].num, out[i].den) == interval
    coarse = timing.cadence(stream(spark, [0, 1, 2, 4, 5]), ticks=25, nominal=Fraction(25)).first()
    assert (coarse.verdict, coarse.num, coarse.den) == ("gapped", 1, 1)  # a lost row, as the clock is exact
    lengths = spark.createDataFrame([(s, i, i * 40, d) for s, last in enumerate((13, 90)) for i, d in enumerate([40, None, 40, last])], "stream_id long, pos long, pts long, duration long")
    assert [r.verdict for r in timing.cadence(lengths).orderBy("stream_id").collect()] == ["uniform", "variable"]


def test_durations(spark):
    out = with_durations(stream(spark, [0, 10, 30, 60, 61], [4])).orderBy("stream_id", "pos").collect()
    assert [r.duration for r in out] == [10, 20, 30, 1, 20, 40_000]  # upper median of 1, 10, 20, 30


def test_outgoing(spark):
    df = stream(spark, [-10, 0, 10, 20]).withColumn("duration", F.lit(10).cast("long"))
    assert [(r.pts, r.duration) for r in timing.outgoing(df, 24).orderBy("pos").collect()] == [(0, 10), (10, 10), (20, 4)]
    assert [(r.pts, r.duration) for r in timing.outgoing(df, 5, 2).orderBy("pos").collect()] == [(0, 10), (10, 1)]


def test_clock(spark):
    texts = {"120": 120, "120f": 120, "5s": 120, "2.5S": 60, "1.5": 36, "1:30": 2160, "1:02:03": 89352, "0:04.5": 108, " 7 ": 7}
    df = spark.createDataFrame([(t,) for t in [*texts, "", "5x", "1:2:3:4", None]], "t string")
    assert [r.f for r in df.select(clock.frames_column(F.col("t"), 24).alias("f")).collect()] == [*texts.values(), None, None, None, None]
    assert [config.to_frames(t, 24) for t in texts] == list(texts.values())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "base.toml").write_text('pipeline = ["cut", "blend"]\n[cut]\nprocessor = "cut_detect"\nthreshold = 5\n[blend]\nprocessor = "mc"\n')
    (tmp_path / "more.toml").write_text("[cut]\nthreshold = 3\n")
    files = [str(tmp_path / "base.toml"), str(tmp_path / "more.toml")]
    assert main(["config", *files, "--set", "blend.window=2"]) == 0
    assert tomllib.loads(capsys.readouterr().out) == {"pipeline": ["cut", "blend"], "cut": {"processor": "cut_detect", "threshold": 3}, "blend": {"processor": "mc", "window": 2}}
    assert main(["stages"]) == 0 and "deflicker" in capsys.readouterr().out.split()
    stream(spark, [0, 1, 2]).withColumn("value", F.col("pos").cast("double")).write.parquet(str(tmp_path / "in"))
    assert main(["run", *files, "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert main(["config", files[1]]) == 2 and capsys.readouterr().err.startswith("loomtick: ")


def test_recursive_stage(spark):
    df = stream(spark, [0, 1, 2, 3], [0]).withColumn("value", F.when(F.col("pos") == 3, 9.0).otherwise(F.col("pos").cast("double")))
    chain = {"pipeline": ["cut", "mc"], "cut": {"processor": "cut_detect", "threshold": 5}, "mc": {"processor": "mc", "window": 0, "sigma": 1e9, "strength": 1.0}}
    out = compiler.run(chain, compiler.TypedStream(df, StreamSpec())).df.orderBy("stream_id", "pos").collect()
    assert [r.value for r in out] == pytest.approx([0, 0.5, 1.25, 9, 0])  # the cut starts it anew


def test_zip_refuses_drift(spark):
    a = stream(spark, [1, 2, 3]).withColumnRenamed("pts", "value")
    assert evaluation.zipped(a, a.where("pos < 2"), "value").count() == 2
    assert evaluation.zipped(a, a, "value", strict=True).count() == 3
    with pytest.raises(Exception, match="drift"):
        evaluation.zipped(a, a.where("pos < 2"), "value", strict=True).collect()
