"""Typed descriptions of streams: what each edge of a chain carries."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from fractions import Fraction


class DType(str, Enum):
    FLOAT32 = "float32"
    FLOAT16 = "float16"
    UINT8 = "uint8"


class Layout(str, Enum):
    RGB_HWC = "rgb_hwc"
    BGRA = "bgra"
    RGBA_HALF = "rgba_half"
    NV12 = "nv12"


class Domain(str, Enum):
    CODED = "coded"
    UNIT = "unit"
    UNIT_SANITIZED = "unit_sanitized"


class Mode(str, Enum):
    PER_FRAME = "per_frame"
    CAUSAL = "causal"
    CENTERED = "centered"
    SEQUENCE = "sequence"


#: Layouts that go with one sample type only.
FIXED_DTYPE = {Layout.BGRA: DType.UINT8, Layout.RGBA_HALF: DType.FLOAT16, Layout.NV12: DType.UINT8}

#: Weights of red and blue in luma, by matrix (fixed values).
LUMA = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


@dataclass(frozen=True)
class FrameSpec:
    layout: Layout = Layout.RGB_HWC
    dtype: DType = DType.FLOAT32
    domain: Domain = Domain.UNIT
    width: int = 0
    height: int = 0
    matrix: str = "bt709"
    full_range: bool = True

    def __post_init__(self) -> None:
        need = FIXED_DTYPE.get(self.layout)
        if need and need != self.dtype:
            raise ValueError(f"{self.layout.value} samples are {need.value}, not {self.dtype.value}")


@dataclass(frozen=True)
class TimelineSpec:
    """``cadence`` None means variable; ``nominal`` is a hint and never enters time math."""

    time_base: Fraction = Fraction(1, 1_000_000)
    cadence: Fraction | None = None
    nominal: Fraction | None = None
    cardinality_kept: bool = True


@dataclass(frozen=True)
class StreamSpec:
    frame: FrameSpec = field(default_factory=FrameSpec)
    timeline: TimelineSpec = field(default_factory=TimelineSpec)
    seekable: bool = True
    lookahead: bool = True

    def with_frame(self, **changes) -> StreamSpec:
        return replace(self, frame=replace(self.frame, **changes))

    def with_timeline(self, **changes) -> StreamSpec:
        return replace(self, timeline=replace(self.timeline, **changes))


@dataclass(frozen=True)
class Violation:
    """One field that a stage cannot take; refusals are data until someone raises them."""

    name: str
    accepted: tuple
    actual: object


def violations(spec: StreamSpec, accepts: dict[str, tuple]) -> list[Violation]:
    """Fields of the frame (or ``timeline.x``) whose value is not among the accepted ones."""
    out = []
    for name, allowed in accepts.items():
        holder = spec.timeline if name.startswith("timeline.") else spec.frame
        actual = getattr(holder, name.removeprefix("timeline."))
        if name == "timeline.cadence":
            actual = "variable" if actual is None else "constant"
        if actual not in allowed:
            out.append(Violation(name, allowed, actual))
    return out


def luma(matrix: str) -> tuple[float, float, float]:
    """Weights of red, green and blue."""
    red, blue = LUMA[matrix]
    return red, 1 - red - blue, blue
