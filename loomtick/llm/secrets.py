"""Secret scans that unwrap nested encodings until nothing new appears."""

from __future__ import annotations

import base64
import bisect
import contextlib
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import in_arrow, text_slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Bytes of an unpacked layer that are scanned at once; a larger one is scanned in windows that overlap.
MAX_LAYER = 1 << 26
OVERLAP = 1 << 16
#: Bytes that a decompressor takes and gives at a time.
PIECE = 1 << 20

Span = tuple[int, int]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, leftmost and non-overlapping by kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


# --- layers: (name, text, map from a span of the text to a span of the layer above) ----------

_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_GZIP, _ZSTD = b"\x1f\x8b\x08", b"\x28\xb5\x2f\xfd"
_BOM = re.compile(rb"\xff\xfe|\xfe\xff")


def _piecewise(text: str, pattern: re.Pattern, value: Callable[[str], str | None]) -> tuple[str, list[int], list[int]] | None:
    """Replace matches; also where each run of the result begins, and where that is in ``text``."""
    out, new, old, at, n = [], [0], [0], 0, 0
    for m in pattern.finditer(text):
        if (to := value(m[0])) is None:
            continue
        out += [text[at : m.start()], to]
        n += m.start() - at
        new += [n, n + len(to)]
        old += [m.start(), m.end()]
        n += len(to)
        at = m.end()
    if at == 0:
        return None
    out.append(text[at:])
    return "".join(out), new, old


class Place:
    """Where spans of a layer stand in the original text; a whole run that was decoded maps as one."""

    def __call__(self, a: int, b: int) -> Span:
        raise NotImplementedError


class Same(Place):
    def __call__(self, a: int, b: int) -> Span:
        return a, b


class Fixed(Place):
    """All of the layer stands for one span, as what was compressed does."""

    def __init__(self, span: Span):
        self.span = span

    def __call__(self, a: int, b: int) -> Span:
        return self.span


class Within(Place):
    """A span by way of the layer above; only base64 and bytes nest so, and each is shorter than the one above."""

    def __init__(self, place: Callable[[int, int], Span], above: Place):
        self.place, self.above = place, above

    def __call__(self, a: int, b: int) -> Span:
        return self.above(*self.place(a, b))


class Pieces(Place):
    """Runs that are copied or replaced, in turn: ``new`` and ``old`` are where each begins here and above.

    ``ends`` is where each run ends above.  Over another layer of pieces the two are
    made one, so thousands of nested ones take one step.
    """

    def __init__(self, new: list[int], old: list[int], ends: list[int], copied: list[bool], above: Place):
        self.new, self.old, self.ends, self.copied, self.above = new, old, ends, copied, above

    @classmethod
    def over(cls, new: list[int], old: list[int], length: int, above: Place) -> Place:
        """Runs that begin at ``new`` here and ``old`` above, every second one replaced; ``length`` of the text above."""
        if isinstance(above, Fixed):
            return above
        ends = [*old[1:], length]
        copied = [i % 2 == 0 for i in range(len(new))]
        if not isinstance(above, Pieces):
            return cls(new, old, ends, copied, above)
        out: tuple[list, ...] = ([], [], [], [])
        for at, x, y, plain in zip(new, old, ends, copied, strict=True):
            if not plain:
                for column, value in zip(out, (at, *above._span(x, y), False), strict=True):
                    column.append(value)
                continue
            i = max(0, bisect.bisect_right(above.new, x) - 1)
            while x < y:
                stop = min(y, above.new[i + 1]) if i + 1 < len(above.new) else y
                if stop > x:
                    shift = above.old[i] + x - above.new[i] if above.copied[i] else above.old[i]
                    for column, value in zip(out, (at, shift, shift + stop - x if above.copied[i] else above.ends[i], above.copied[i]), strict=True):
                        column.append(value)
                at, x, i = at + stop - x, stop, i + 1
        return cls(*out, above.above) if out[0] else cls([0], [0], [0], [True], above.above)

    def _span(self, a: int, b: int) -> Span:
        i = max(0, bisect.bisect_right(self.new, a) - 1)
        j = max(i, bisect.bisect_left(self.new, b) - 1)
        start = self.old[i] + a - self.new[i] if self.copied[i] else self.old[i]
        end = self.old[j] + b - self.new[j] if self.copied[j] else self.ends[j]
        return start, max(start, end)

    def __call__(self, a: int, b: int) -> Span:
        return self.above(*self._span(a, b))


def _percent_text(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")
    except ValueError:
        return None


_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _escape_text(one: str) -> str | None:
    number = int(one[3:-1], 16) if one[:3] == "&#x" else int(one[2:-1]) if one[0] == "&" else int(one[2:], 16)
    return chr(number) if 0 < number < 0xD800 or 0xDFFF < number <= 0x10FFFF else None


class _Stream:
    """Contents of a gzip (of any number of members), zlib or zstd stream, piece by piece.

    Once read, ``used`` is its length and ``whole`` tells whether its end was met.
    """

    def __init__(self, data: bytes, start: int):
        self.data, self.start, self.used, self.whole = memoryview(data), start, 0, False

    def __iter__(self) -> Iterator[bytes]:
        with contextlib.suppress(Exception):  # a damaged stream gives what stands before the damage
            if self.data[self.start : self.start + 4] == _ZSTD:
                yield from self._zstd()
            else:
                yield from self._members()

    def _zstd(self) -> Iterator[bytes]:
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(self.data[self.start :], read_across_frames=True) as r:
            while out := r.read(PIECE):
                yield out
        self.used, self.whole = len(self.data) - self.start, True

    def _members(self) -> Iterator[bytes]:
        at = self.start
        while True:
            d, feed = zlib.decompressobj(47), b""
            while not d.eof:
                if not feed:
                    feed = self.data[at : at + PIECE]
                    at += len(feed)
                ended = not feed
                out = d.decompress(feed, PIECE)
                feed = d.unconsumed_tail
                if out:
                    yield out
                elif ended and not d.eof:
                    self.whole = False  # cut short
                    return
            at -= len(d.unused_data)
            self.used, self.whole = at - self.start, True
            if self.data[at : at + 3] != _GZIP:
                return
            self.whole = False


def _windows(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Parts joined up to MAX_LAYER bytes; a window begins with the end of the one before."""
    held, size, fresh = [], 0, False
    for part in parts:
        held.append(part)
        size, fresh = size + len(part), True
        if size >= MAX_LAYER:
            window = b"".join(held)
            yield window
            held, fresh = [window[-OVERLAP:]], False
            size = len(held[0])
    if fresh:
        yield b"".join(held)


Layer = tuple[str, str | bytes | None, Place]


def _from_bytes(data: bytes, above: Place) -> Iterator[Layer]:
    """Texts and streams in ``data``.

    What is not UTF-8 is read byte by byte (all patterns are ASCII), so no byte
    hides a secret beside it; and as UTF-16 from each byte order mark on.
    """
    marks = [*_BOM.finditer(data)]
    for m, stop in zip(marks, [*(x.start() for x in marks[1:]), len(data)], strict=False):
        if stop - m.end() >= 12:
            wide = data[m.end() : stop].decode("utf-16-le" if m[0] == b"\xff\xfe" else "utf-16-be", "replace")
            places = [*itertools.accumulate((2 + 2 * (c > "\uffff") for c in wide), initial=m.end())]
            yield "", wide, _within(lambda a, b, places=places, stop=stop: (places[a], min(stop, places[b])), above)
    at = 0
    while m := _STREAM.search(data, at):
        stream = _Stream(data, m.start())
        for window in _windows(stream):
            end = m.start() + stream.used if stream.whole else len(data)
            yield "compressed", window, Fixed(above(m.start(), end))
        if not stream.whole and m[0] in (_GZIP, _ZSTD):
            yield "compressed", None, Fixed(above(m.start(), len(data)))
        at = m.start() + (max(1, stream.used) if stream.whole else 1)
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
        yield "", text, above
        return
    if len(text) == len(data):
        yield "", text, above
    else:
        ends = [0, *itertools.accumulate(len(c.encode()) for c in text)]
        yield "", text, _within(lambda a, b: (ends[a], ends[b]), above)


def _within(place: Callable[[int, int], Span], above: Place) -> Place:
    return above if isinstance(above, Fixed) else Within(place, above)


def _unwrapped(text: str, above: Place) -> Iterator[Layer]:
    """Layers right below ``text``; those that are as long as the whole text come last."""
    for m in _BASE64.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, *m.span())]
        firsts = [0, *itertools.accumulate(b - a for a, b in lines)]
        run = "".join(text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")

        def place(a: int, b: int, start: int, m=m, lines=lines, firsts=firsts) -> Span:
            at = lambda k: lines[i := bisect.bisect_right(firsts, k, 0, len(lines)) - 1][0] + k - firsts[i]
            last = start - (-b // 3) * 4
            return at(start + a // 3 * 4), m.end() if last >= firsts[-1] else at(last - 1) + 1

        for start in range(4):  # what begins anywhere in the run is whole in one of the alignments
            part = run[start:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            yield "base64", data, _within(lambda a, b, start=start, place=place: place(a, b, start), above)
    if ("\\" in text or "&#" in text) and _ESCAPE.search(text):
        if got := _piecewise(text, _ESCAPE, _escape_text):
            yield "unicode", got[0], Pieces.over(got[1], got[2], len(text), above)
    if "%" in text and _PERCENT.search(text):
        if got := _piecewise(text, _PERCENT_RUN, _percent_text):
            yield "url", got[0], Pieces.over(got[1], got[2], len(text), above)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]], int]:
    """Base spans, (start, end, kind, layers) found below, and the number of streams that end in damage.

    Layer after layer is unwrapped, depth first, until no new one appears.  A layer
    whose content was seen before in the same place is not unwrapped again, so an
    encoding that decodes to itself ends.  Layers are kept on a list of work, and one
    is let go as its last inner layer is taken, so thousands may be nested.  Base64
    runs have 16 characters at least: the shortest secret, ``token=`` and six characters,
    has twelve bytes.
    """
    base = base_spans(text)
    found: dict[tuple[int, int, str], str] = {}
    unread = 0
    seen = {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), str, 0, len(text))}
    work: list[tuple[Iterator[Layer], Layer | None, str]] = []

    def push(layers: Iterator[Layer], chain: str) -> None:
        if first := next(layers, None):
            work.append((layers, first, chain))

    push(_unwrapped(text, Same()), "")
    while work:
        layers, (name, inner, place), names = work.pop()
        push(layers, names)
        if inner is None:
            unread += 1
        if not inner:
            continue
        data = inner.encode("utf-8", "surrogatepass") if isinstance(inner, str) else inner
        mark = (hashlib.sha256(data).digest(), type(inner), *place(0, len(inner)))
        if mark in seen:
            continue
        seen.add(mark)
        chain = _longer(names, name)
        if isinstance(inner, str):
            for a, b, kind in base_spans(inner):
                found.setdefault((*place(a, b), kind), chain)
        push(_unwrapped(inner, place) if isinstance(inner, str) else _from_bytes(inner, place), chain)
    for span in base:
        found.pop(span, None)
    return base, [(*k, v) for k, v in found.items()], unread


def _longer(names: str, name: str) -> str:
    """``names`` with one more; a name that repeats is counted (``url*3``)."""
    if not name:
        return names
    before, _, last = names.rpartition("+")
    kind, _, count = last.partition("*")
    if kind != name:
        return f"{names}+{name}" if names else name
    return f"{before}+{name}*{int(count or 1) + 1}" if before else f"{name}*{int(count or 1) + 1}"


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed, then end."""
    order = sorted({(s[0], KINDS.index(s[2]), s[1]) for s in spans})
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in order)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Secrets in every whole text: one row for each row of ``docs``.

    doc_id, n_assign, n_access, n_hex (plain patterns), base_sha256, spans (plain
    and unwrapped, as code points of the original text), n_unwrapped, layers (how
    each unwrapped one was encoded) and n_unread (gzip and zstd streams that end in
    damage; what stands before it is scanned).  A null text counts as empty.
    Works row by row, so copies, ties and skew make no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            cols: list[list] = [[] for _ in range(8)]
            for value in batch.column(1):
                base, more, unread = scan(value.as_py() or "")
                kinds = [k for _, _, k in base]
                row = [kinds.count(k) for k in KINDS]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + [m[:3] for m in more]), len(more), ",".join(sorted({m[3] for m in more})), unread]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_unwrapped", "layers", "n_unread"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).transform(in_arrow, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_unwrapped long, layers string, n_unread long")
