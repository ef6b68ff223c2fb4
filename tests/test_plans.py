"""Configs, specs and the compiler."""

import tomllib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomtick.plans import compiler, config, spec

CHAIN = {"pipeline": ["cuts", "denoise"], "cuts": {"processor": "cut_detect", "threshold": 5.0}, "denoise": {"processor": "mc", "profile": "strong", "window": 2}}


def test_merge():
    a, b = {"t": {"x": 1, "y": [1, 2]}, "s": 1}, {"t": {"y": [3]}, "s": {"k": 2}}
    assert config.merged(a, b) == {"t": {"x": 1, "y": [3]}, "s": {"k": 2}}
    assert config.merged(b, a)["s"] == 1 and a["t"]["y"] == [1, 2]


def test_override():
    out = config.override({"a": {"b": 1}}, ["a.b=2.5", "a.c.d=x=y", "a.e=[1, 2]", "a.b=true"])
    assert out == {"a": {"b": True, "c": {"d": "x=y"}, "e": [1, 2]}}
    for bad in ("a.b", "a=1", "a..b=1", "a.b.c=1"):
        with pytest.raises(config.ConfigError):
            config.override({"a": {"b": 1}}, [bad])


def test_dump_round_trip():
    c = config.merged(CHAIN, {"settings": {"name": 'a "b"\n', "deep": {"x": 1.5, "on": False, "list": ["a", 1]}}, "input": {}})
    assert tomllib.loads(config.dumped(c)) == c


@pytest.mark.parametrize("change", [{"pipeline": "cuts"}, {"pipeline": [1]}, {"pipeline": ["input"]}, {"pipeline": ["absent"]}, {"cuts": {}}, {"extra": {}}, {"extra": 1}, {"cuts": {"processor": "cut_detect", "profile": 1}}])
def test_structure(change):
    with pytest.raises(config.ConfigError):
        config.checked({**CHAIN, **change})


def test_allowed_structures(spark):
    assert config.checked({})["pipeline"] == []
    assert compiler.resolve({**CHAIN, "pipeline": []}) == []
    spare = {**CHAIN, "spare": {"processor": "conform"}, "settings": {}}
    assert [r.name for r in compiler.resolve({**spare, "pipeline": ["denoise", "cuts", "denoise"]})] == ["denoise", "cuts", "denoise"]
    df = spark.createDataFrame([(1, 0, 0, 1.0)], "stream_id long, pos long, pts long, value double")
    assert compiler.run({"pipeline": []}, compiler.TypedStream(df, spec.StreamSpec())).df.count() == 1


def test_one_time_grammar(spark):
    from loomtick.functions.clock import frames_column

    texts = ["120", "120F", " 5s", "0.5", "1:30", "1:02:03", "0:00.5", "5.", ".5", ".5s", "1:2", "x", "", "1:", "1:2:3:4", "-1", "1f2", "5.s", "00:10.", "1.5f"]
    column = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", frames_column(F.col("t"), 25).alias("f")).orderBy("i").collect()]
    single = []
    for t in texts:
        try:
            single.append(config.to_frames(t, 25))
        except config.ConfigError:
            single.append(None)
    assert column == single


@pytest.mark.parametrize(("text", "frames"), [("120", 120), ("120F", 120), ("5s", 125), ("0.5", 12), ("1:30", 2250), ("1:02:03", 93075), ("0:00.5", 12)])
def test_time(text, frames):
    assert config.to_frames(text, 25) == frames


def test_trim_range():
    assert config.trim_range("10", "99", 25, 50) == (10, 50)
    for a, b in (("50", None), ("10", "10"), ("x", None)):
        with pytest.raises(config.ConfigError):
            config.trim_range(a, b, 25, 50)


def test_settings():
    out = config.settings({"n": int, "on": bool}, {"P_N": "3", "P_ON": "yes"}, "P_", {"n": None, "on": False}, {"n": 1})
    assert out == {"n": 3, "on": False}


def test_specs():
    with pytest.raises(ValueError):
        spec.FrameSpec(layout=spec.Layout.NV12)
    s = spec.StreamSpec()
    assert [v.name for v in spec.violations(s, {"dtype": ("uint8",), "timeline.cadence": ("variable",)})] == ["dtype"]
    assert abs(sum(spec.luma("bt601")) - 1) < 1e-12


def test_resolve():
    cuts, mc = compiler.resolve(CHAIN)
    assert mc.keys == {"window": 2, "sigma": 0.1, "strength": 1.0} and mc.buffered == 3
    made = compiler.resolve({"pipeline": ["c"], "c": {"processor": "conform", "fps": "30000/1001"}})
    assert made[0].after.timeline.cadence == Fraction(30000, 1001)
    for change in ({"processor": "cut_detekt"}, {"processor": "cut_detect", "treshold": 1}, {"processor": "cut_detect", "capability": "denoise"}, {"processor": "mc", "profile": "x"}):
        with pytest.raises(config.ConfigError, match="did you mean|capability|profile"):
            compiler.resolve({"pipeline": ["s"], "s": change})
    with pytest.raises(config.ConfigError):
        compiler.register("mc", "x:y")


def test_run(spark):
    rows = [(1, i, i * 40_000, float(v)) for i, v in enumerate([1, 2, 9, 9, 1])]
    df = spark.createDataFrame(rows, "stream_id long, pos long, pts long, value double")
    out = compiler.run(CHAIN, compiler.TypedStream(df, spec.StreamSpec()))
    assert [r.segment_id for r in out.df.orderBy("pos").collect()] == [0, 0, 1, 1, 2]
    half = compiler.run({"pipeline": ["c"], "c": {"processor": "conform", "fps": 12.5}}, compiler.TypedStream(df, spec.StreamSpec()))
    assert [(r.pos, r.value) for r in half.df.orderBy("pos").collect()] == [(0, 1.0), (1, 9.0), (2, 1.0)]


def test_stages_keep_to_segments(spark):
    """What a chain makes of a stream with a cut is what it makes of the parts."""
    values = [0.0, 0.1, 0.05, 0.12, 0.02, 0.07, 0.9, 0.8, 0.95, 0.85, 0.9, 0.88, 0.2, 0.25]
    rows = [(1, i, i * 40_000, v) for i, v in enumerate(values)]
    schema = "stream_id long, pos long, pts long, value double"
    chains = {"mc": {"processor": "mc", "window": 4, "sigma": 1.0}, "recursive": {"processor": "mc", "window": 0, "sigma": 1.0}, "deflicker": {"processor": "deflicker", "window": 3, "band": 0.5, "max_fix": 1.0}}
    for name, table in chains.items():
        c = {"pipeline": ["cuts", name], "cuts": {"processor": "cut_detect", "threshold": 0.5}, name: table}
        whole = compiler.run(c, compiler.TypedStream(spark.createDataFrame(rows, schema), spec.StreamSpec())).df
        got = [round(r.value, 9) for r in whole.orderBy("pos").collect()]
        want = []
        for part in (rows[:6], rows[6:12], rows[12:]):
            alone = compiler.run({"pipeline": [name], name: table}, compiler.TypedStream(spark.createDataFrame([(1, i, *r[2:]) for i, r in enumerate(part)], schema), spec.StreamSpec())).df
            want += [round(r.value, 9) for r in alone.orderBy("pos").collect()]
        assert got == want, name
        assert name == "deflicker" or got != values
