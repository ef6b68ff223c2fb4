"""The stage catalog, and configs compiled into one DataFrame plan.

Stages that keep state keep it within a segment, once a stage before them has cut the stream.

A stage is a pure function of a stream; all that is decided on the driver (keys,
defaults, specs) is decided before a row moves, and the chain becomes one plan.
"""

from __future__ import annotations

import contextlib
import importlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.operators import geometry, guards, levels, streams, temporal, timing
from loomtick.plans import config as C
from loomtick.plans.spec import Mode, StreamSpec, violations


@dataclass(frozen=True)
class Stage:
    """A kind of stage: its keys with defaults, what it takes, makes and does."""

    name: str
    defaults: Mapping[str, Any]
    apply: Callable[[DataFrame, Mapping[str, Any]], DataFrame]
    capability: str = "preprocess"
    mode: Mode = Mode.PER_FRAME
    radius: Callable[[Mapping[str, Any]], int] = lambda keys: 0
    accepts: Mapping[str, tuple] = field(default_factory=dict)
    produces: Callable[[StreamSpec, Mapping[str, Any]], StreamSpec] = lambda spec, keys: spec
    profiles: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    emits_cuts: bool = False


_CATALOG: dict[str, Stage | str] = {}


def register(name: str, stage: Stage | str) -> None:
    """Add a stage, or ``module:attribute`` of one that is imported when first used."""
    if name in _CATALOG:
        raise C.ConfigError(f"processor {name!r} is registered already")
    _CATALOG[name] = stage


def stage_of(name: str) -> Stage:
    found = _CATALOG.get(name)
    if found is None:
        raise C.ConfigError(f"unknown processor {name!r}{C.suggestion(name, _CATALOG)}")
    if isinstance(found, str):
        module, _, attribute = found.partition(":")
        found = _CATALOG[name] = getattr(importlib.import_module(module), attribute)
    return found


def names() -> list[str]:
    return sorted(_CATALOG)


@dataclass(frozen=True)
class Resolved:
    name: str
    stage: Stage
    keys: Mapping[str, Any]
    before: StreamSpec
    after: StreamSpec

    @property
    def buffered(self) -> int:
        """Rows that the stage holds at once."""
        r = self.stage.radius(self.keys)
        return {Mode.CENTERED: 2 * r + 1, Mode.CAUSAL: r + 1}.get(self.stage.mode, 1)


def resolve(config: Mapping[str, Any], spec: StreamSpec | None = None) -> list[Resolved]:
    """The chain with all keys filled in and the spec threaded through it; refuses what cannot run."""
    config = C.checked(config)
    spec = spec or StreamSpec()
    out = []
    for name in config["pipeline"]:
        own = dict(config[name])
        stage = stage_of(own.pop("processor"))
        if (wanted := own.pop("capability", stage.capability)) != stage.capability:
            raise C.ConfigError(f"stage {name!r}: {stage.name} has no capability {wanted!r}")
        profile = own.pop("profile", None)
        if profile is not None and profile not in stage.profiles:
            raise C.ConfigError(f"stage {name!r}: unknown profile {profile!r}{C.suggestion(profile, stage.profiles)}")
        C.check_keys(f"stage {name!r}", own, stage.defaults)
        keys = {**stage.defaults, **stage.profiles.get(profile, {}), **own}
        if bad := violations(spec, stage.accepts):
            raise C.ConfigError(f"stage {name!r} takes {bad[0].name} of {bad[0].accepted}, not {bad[0].actual}")
        after = stage.produces(spec, keys)
        out.append(Resolved(name, stage, keys, spec, after))
        spec = after
    return out


@dataclass(frozen=True)
class TypedStream:
    """A stream with its description."""

    df: DataFrame
    spec: StreamSpec


class Session:
    """A chain over one stream, to be run once; what it opened is closed once, however it ends.

    An error of the run comes first; one of closing is raised only if the run had none.
    """

    def __init__(self, config: Mapping[str, Any], stream: TypedStream, close: Callable[[], None] = lambda: None):
        self._config, self._stream, self._close, self._used, self._closed = config, stream, close, False, False

    def run(self, sink: Callable[[TypedStream], Any]) -> Any:
        if self._used:
            raise RuntimeError("this session has been run; open another one for the next stream")
        self._used = True
        try:
            out = sink(run(self._config, self._stream))
        except BaseException:
            with contextlib.suppress(Exception):
                self.close()
            raise
        self.close()
        return out

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self._close()


def run(config: Mapping[str, Any], stream: TypedStream) -> TypedStream:
    """Compile the chain over a stream: one lazy plan, run by the caller's action."""
    df, spec = stream.df, stream.spec
    for r in resolve(config, spec):
        df, spec = r.stage.apply(df, r.keys), r.after
    return TypedStream(df, spec)


def _interval(keys: Mapping[str, Any]) -> int:
    return round(Fraction(1_000_000) / Fraction(str(keys["fps"])))


def _new_rows(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("slot", "pos")


def _conform(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    slots = timing.conform(df, _interval(keys)).withColumnRenamed("pos", "source_pos")
    payload = df.select("stream_id", F.col("pos").alias("source_pos"), *[c for c in df.columns if c not in ("stream_id", "pos", "pts")])
    return _new_rows(slots.drop("shift").join(payload, ["stream_id", "source_pos"]).drop("source_pos"))


def _interpolate(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    step = _interval(keys)
    return _new_rows(timing.interpolate(df, step).withColumn("pts", F.col("slot") * step).drop("phase"))


def _replace(made: DataFrame, column: str) -> DataFrame:
    return made.withColumn("value", F.col(column)).drop(column)


def _motion_blend(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    """A window of 0 blends with the blend before, any other with that many rows before."""
    if keys["window"]:
        return _replace(temporal.fir_blend(df, keys["window"], keys["sigma"], keys["strength"]), "blended")
    rows = df if "segment_id" in df.columns else df.withColumn("segment_id", F.lit(0).cast("long"))
    made = guards.recursive_blend(rows, keys["strength"], keys["sigma"])
    return _replace(df.join(made, ["stream_id", "pos"]), "blended")


def _constant(spec: StreamSpec, keys: Mapping[str, Any]) -> StreamSpec:
    return spec.with_timeline(cadence=Fraction(str(keys["fps"])), cardinality_kept=False)


def _level(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    made = levels.level_frames(df, keys["window"], keys["deadband"], keys["bins"]).select("stream_id", "pos", "pixels")
    return df.drop("pixels").join(made, ["stream_id", "pos"])


def _edges(keys: Mapping[str, Any]) -> tuple[int, int, int, int]:
    return keys["top"], keys["bottom"], keys["left"], keys["right"]


def _crop(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    """Edge bands, or the largest window of an aspect where one is given."""

    def kernel(x):
        if keys["aspect"] is None:
            return geometry.cut(x, _edges(keys))
        wide, high = map(int, keys["aspect"].split(":"))
        return geometry.cut(x, geometry.aspect_window(x.shape[1], x.shape[0], (wide, high), keys["dx"], keys["dy"], keys["anchor"]))

    return geometry.mapped(df, kernel)


for _stage in (
    Stage("cut_detect", {"threshold": 0.25}, lambda df, k: streams.with_segments(df, streams.jump(k["threshold"])), mode=Mode.CAUSAL, radius=lambda k: 1, emits_cuts=True),
    Stage("conform", {"fps": 25}, _conform, mode=Mode.CENTERED, radius=lambda k: 1, produces=_constant),
    Stage("interpolate", {"fps": 25}, _interpolate, capability="interpolate", produces=_constant),
    Stage("deflicker", {"window": 8, "band": 0.1, "frac": 0.6, "max_fix": 0.1, "step": 1.5 / 255}, lambda df, k: _replace(temporal.deflicker(df, k["window"], k["band"], k["frac"], k["max_fix"], k["step"]), "fixed"), mode=Mode.CENTERED, radius=lambda k: k["window"]),
    Stage("mc", {"window": 4, "sigma": 0.05, "strength": 0.8}, _motion_blend, capability="denoise", mode=Mode.CAUSAL, radius=lambda k: max(1, k["window"]), profiles={"strong": {"strength": 1.0, "sigma": 0.1}}),
    Stage("level", {"window": 5, "deadband": 0.003, "bins": levels.BINS}, _level, mode=Mode.CENTERED, radius=lambda k: k["window"]),
    Stage("crop", {"top": 0, "bottom": 0, "left": 0, "right": 0, "aspect": None, "anchor": "center", "dx": 0, "dy": 0}, _crop),
    Stage("square_pixels", {"pixel_aspect": "1"}, lambda df, k: geometry.mapped(df, lambda x: geometry.squared(x, Fraction(str(k["pixel_aspect"]))))),
    Stage("sanitize_edges", {"top": 0, "bottom": 0, "left": 0, "right": 0}, lambda df, k: geometry.mapped(df, lambda x: geometry.sanitised(x, _edges(k)))),
    Stage("nafnet", {"trip": 0.01, "lockout": 48, "rise": 12}, lambda df, k: guards.guarded_output(df, guards.Guard(trip=k["trip"], lockout=k["lockout"], rise=k["rise"])), capability="restore", mode=Mode.CAUSAL),
    Stage("fbcnn", {"estimate": "value", "window": 12, "least": 6, "longest": 64}, lambda df, k: guards.held_estimate(df, k["estimate"], k["window"], k["least"], k["longest"]), capability="deblock", mode=Mode.CAUSAL),
    Stage("trim", {"start": 0, "end": 1 << 62}, lambda df, k: streams.trim(df, F.lit(k["start"]), F.lit(k["end"])), produces=lambda s, k: s.with_timeline(cardinality_kept=False)),
):
    register(_stage.name, _stage)
