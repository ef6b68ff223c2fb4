"""Layered configs: merge, overrides, checks, dump, time expressions and settings."""

from __future__ import annotations

import difflib
import json
import re
import tomllib
from collections.abc import Iterable, Mapping
from fractions import Fraction
from typing import Any

from loomtick.functions import clock

RESERVED = ("settings", "input", "output", "diagnostics")


class ConfigError(ValueError):
    """A config that cannot be used, with what would help."""


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers win; tables are merged key by key, anything else is replaced. Inputs stay as they are."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            old = out.get(key)
            out[key] = merged(old if isinstance(old, dict) else {}, value) if isinstance(value, Mapping) else value
    return out


def override(config: Mapping[str, Any], arguments: Iterable[str]) -> dict[str, Any]:
    """Apply ``table.key=value`` arguments in order; values are TOML, or else plain strings."""
    out = merged(config)
    for argument in arguments:
        path, sign, text = argument.partition("=")
        keys = [k.strip() for k in path.split(".")]
        if not sign or len(keys) < 2 or not all(keys):
            raise ConfigError(f"{argument!r} is not of the form table.key=value")
        try:
            value = tomllib.loads(f"x = {text}")["x"]
        except tomllib.TOMLDecodeError:
            value = text
        table = out
        for key in keys[:-1]:
            table = table.setdefault(key, {})
            if not isinstance(table, dict):
                raise ConfigError(f"{argument!r}: {key} is not a table")
        table[keys[-1]] = value
    return out


def suggestion(name: str, known: Iterable[str]) -> str:
    near = difflib.get_close_matches(name, list(known), 1)
    return f"; did you mean {near[0]!r}?" if near else ""


def check_keys(where: str, table: Mapping[str, Any], known: Iterable[str]) -> None:
    """Refuse keys that nothing reads."""
    known = list(known)
    for key in table:
        if key not in known:
            raise ConfigError(f"{where}: unknown key {key!r}{suggestion(key, known)}")


def checked(config: Mapping[str, Any]) -> dict[str, Any]:
    """The config, if it names stages that each have a table with a processor.

    A stage may stand in the pipeline more than once, each time as a stage of its own; a
    table that the pipeline does not name has to be a stage too, or one of ``RESERVED``.  An
    empty pipeline passes everything through.
    """
    stages = config.get("pipeline", [])
    if not isinstance(stages, list) or not all(isinstance(s, str) for s in stages):
        raise ConfigError("pipeline is a list of stage names")
    tables = {k: v for k, v in config.items() if k != "pipeline"}
    for name, table in tables.items():
        if not isinstance(table, Mapping):
            raise ConfigError(f"{name!r} has to be a table")
        if name in RESERVED:
            continue
        if not isinstance(table.get("processor"), str) or not table["processor"]:
            raise ConfigError(f"table {name!r} needs a processor{suggestion(name, RESERVED)}")
        for key in ("capability", "profile"):
            if not isinstance(table.get(key, ""), str):
                raise ConfigError(f"{key} of {name!r} is a string")
    for s in stages:
        if s in RESERVED:
            raise ConfigError(f"{s!r} is reserved and cannot be a stage")
        if s not in tables:
            raise ConfigError(f"stage {s!r} has no table{suggestion(s, tables)}")
    return {**config, "pipeline": stages}


def dumped(config: Mapping[str, Any]) -> str:
    """TOML text that loads to the same config."""

    def scalar(v: Any) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(scalar, v)) + "]"
        if isinstance(v, Mapping):
            return "{" + ", ".join(f"{json.dumps(k)} = {scalar(x)}" for k, x in v.items()) + "}"
        return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else repr(v) if isinstance(v, (int, float)) else str(v)

    key = lambda k: k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k)

    def table(path: list[str], t: Mapping[str, Any]) -> list[str]:
        own = [f"{key(k)} = {scalar(v)}" for k, v in t.items() if not isinstance(v, Mapping)]
        out = ([f"[{'.'.join(map(key, path))}]"] if path and (own or not t) else []) + own
        for k, v in t.items():
            if isinstance(v, Mapping):
                out += ["", *table([*path, k], v)]
        return out

    return "\n".join(table([], config)).strip() + "\n"


def parse_time(text: str) -> tuple[str, Fraction]:
    """("frames", n) or ("seconds", s), by the patterns of ``functions.clock``."""
    s = text.strip().lower()
    if m := re.fullmatch(clock.WHOLE, s):
        return "frames", Fraction(m[1])
    if m := re.fullmatch(clock.CLOCK, s):
        return "seconds", int(m[1] or 0) * 3600 + int(m[2]) * 60 + Fraction(m[3])
    if m := re.fullmatch(clock.SECONDS, s):
        return "seconds", Fraction(m[1])
    raise ConfigError(f"{text!r} is neither a number of frames nor a time")


def to_frames(text: str, rate: Fraction | float) -> int:
    """Frames of a time expression at a rate, halves to even."""
    unit, n = parse_time(text)
    return int(n) if unit == "frames" else round(n * Fraction(rate).limit_denominator(1001))


def trim_range(start: str | None, end: str | None, rate: Fraction | float, total: int) -> tuple[int, int]:
    """Half-open range of positions; the end is clamped, an empty range refused."""
    a = to_frames(start, rate) if start else 0
    b = min(to_frames(end, rate), total) if end else total
    if not 0 <= a < b:
        raise ConfigError(f"nothing lies between {start!r} and {end!r} of {total} frames")
    return a, b


def settings(fields: Mapping[str, type], environment: Mapping[str, str], prefix: str, overrides: Mapping[str, Any] | None = None, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Each field from its override if not null, else the environment, else its default."""
    out = dict(defaults or {})
    for name, kind in fields.items():
        raw = environment.get(f"{prefix}{name.upper()}")
        if raw is not None:
            out[name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return out | {k: v for k, v in (overrides or {}).items() if v is not None}
