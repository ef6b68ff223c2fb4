"""Positions written as frames, seconds or clock times: one grammar for columns and, in ``plans.config``, single texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: ``120`` and ``120f`` are frames; ``mm:ss`` and ``hh:mm:ss``, then ``5s`` and ``1.5``, are seconds.
WHOLE = r"^([0-9]+)f?$"
CLOCK = r"^(?:([0-9]+):)?([0-9]+):([0-9]+\.?[0-9]*)$"
SECONDS = r"^([0-9]+\.?[0-9]*|\.[0-9]+)s?$"


def frames_column(text: Column, fps: float) -> Column:
    """Frames at a rate, rounded half to even; null where the text cannot be read.

    ``120`` and ``120f`` are frames; ``5s``, ``1.5``, ``mm:ss`` and ``hh:mm:ss`` are seconds.
    """
    s = F.lower(F.trim(text))
    number = lambda t: F.when(t != "", t).cast("double")
    part = lambda pattern, k: number(F.regexp_extract(s, pattern, k))
    seconds = F.when(s.rlike(CLOCK), F.coalesce(part(CLOCK, 1), F.lit(0.0)) * 3600 + part(CLOCK, 2) * 60 + part(CLOCK, 3)).otherwise(part(SECONDS, 1))
    return F.when(s.rlike(WHOLE), F.regexp_extract(s, WHOLE, 1).cast("long")).otherwise(F.rint(seconds * fps).cast("long"))
