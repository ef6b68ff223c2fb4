"""Cadence verdicts, resampling to a grid, and pairing by time; exact in integer ticks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import chain, tee

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomtick.functions.rational import floor_div, half_even
from loomtick.operators.ordered import ordered
from loomtick.operators.streams import by_stream, in_order

#: A row that would fan out to more slots than this is refused.
MAX_FAN_OUT = 10_000


def in_display_order(stream: DataFrame) -> WindowSpec:
    """The rows of each stream by time; samples can be listed in the order of decoding."""
    return W.partitionBy("stream_id").orderBy("pts", "pos")


def verdict(stream: DataFrame, tick: int = 1) -> DataFrame:
    """One row a stream: n, first_pts, span, interval and verdict.

    exact_cfr: all deltas equal; cfr: all within a tick of the mean; gapped_cfr:
    all whole multiples (one of them larger) of the modal or smallest delta; else
    vfr.  Deltas that do not grow make a stream vfr; a single row has no verdict but
    ``single``.  Rows count in the order of display.  Ties for the modal delta go to the smaller one.
    """
    deltas = stream.withColumn("d", F.lead("pts").over(in_display_order(stream)) - F.col("pts"))
    counts = deltas.where("d IS NOT NULL").groupBy("stream_id", "d").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy("stream_id").agg(F.min_by("d", F.struct(-F.col("c"), F.col("d"))).alias("modal"))
    sums = deltas.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.last("d", True).alias("d_any"))
    base = sums.join(modal, "stream_id", "left")
    total, gaps = F.col("last_pts") - F.col("first_pts"), F.col("n") - 1
    # |d - total / gaps| <= tick, in integers
    even = (F.abs(F.col("d_max") * gaps - total) <= tick * gaps) & (F.abs(F.col("d_min") * gaps - total) <= tick * gaps)
    tests = deltas.where("d IS NOT NULL").join(base.select("stream_id", "modal", "d_min"), "stream_id")
    fits = lambda c: F.bool_and((F.col(c) > 0) & (F.pmod("d", F.when(F.col(c) > 0, F.col(c)).otherwise(1)) == 0))
    gapped = tests.groupBy("stream_id").agg(fits("modal").alias("by_modal"), fits("d_min").alias("by_min"))
    kind = (
        F.when(F.col("n") == 1, "single")
        .when(F.col("d_min") <= 0, "vfr")
        .when(F.col("d_min") == F.col("d_max"), "exact_cfr")
        .when(even, "cfr")
        .when(F.col("by_modal") | F.col("by_min"), "gapped_cfr")
        .otherwise("vfr")
    )
    interval = F.when(kind == "gapped_cfr", F.when(F.col("by_modal"), F.col("modal")).otherwise(F.col("d_min"))).when(kind.isin("exact_cfr"), F.col("d_min"))
    return base.join(gapped, "stream_id", "left").select("stream_id", "n", "first_pts", total.alias("span"), interval.alias("interval"), kind.alias("verdict"))


def _meets(x: int, interval: Fraction) -> bool:
    """Whether x ticks can stand for an interval on a clock of whole ticks."""
    return abs(x - interval) <= (interval.denominator > 1)


def uniform_interval(n: int, span: int, low: int | None, high: int | None, durations: tuple[int | None, int | None, int | None] = (None, None, None), ticks: int = 1_000_000, nominal: Fraction | None = None) -> Fraction | None:
    """The one interval in ticks that n rows keep, or None, from their span and extreme steps.

    Tried in this order: the nominal rate, an exact step, the rate over 1001 next to the
    mean (four ticks a row at least), the mean.  Durations (least and largest before
    the last row, the last) have to agree; a last one may be cut short.
    """
    least, most, tail = durations
    named = ticks / nominal if nominal else None
    if n == 1:
        found = named or (Fraction(tail) if tail and tail > 0 else None)
    elif low <= 0 or max(abs(low * (n - 1) - span), abs(high * (n - 1) - span)) > n - 1:
        return None
    else:
        mean = Fraction(span, n - 1)
        fits = lambda i: i and _meets(span, (n - 1) * i) and _meets(low, i) and _meets(high, i)
        if fits(named):
            found = named
        elif low == high:
            found = mean
        else:
            near = over_1001(mean, ticks)
            found = None if mean < 4 else near if fits(near) else mean
    if found is None or not all(d is None or _meets(d, found) for d in (least, most)):
        return None
    return found if tail is None or _meets(tail, found) or tail < found else None


def over_1001(interval: Fraction, ticks: int) -> Fraction | None:
    """The interval of the nearest rate of whole 1001ths a second, None if that is 0."""
    rate = round(1001 * ticks / interval)
    return Fraction(1001 * ticks, rate) if rate else None


def cadence(stream: DataFrame, ticks: int = 1_000_000, nominal: Fraction | None = None) -> DataFrame:
    """One row a stream: n, first_pts, span, verdict and the interval in ticks as ``num`` / ``den``.

    uniform: one interval within what a clock of whole ticks may round (see
    ``uniform_interval``; a ``duration`` column has its say).  gapped: all steps are
    whole multiples of one interval and some are more than one; tried are the nominal,
    the modal and the smallest step, the last two also over 1001.  variable: all else,
    steps that do not grow among it.  An interval of whole ticks is held to exactly,
    any other to one tick.

    Only the summary of a stream is judged in Python; its steps are counted and tested
    in the JVM, distinct ones once.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    steps = stream.withColumn("d", F.lead("pts").over(in_display_order(stream)) - F.col("pts"))
    own = F.col("duration") if "duration" in stream.columns else F.lit(None).cast("long")
    inner = F.when(F.col("d").isNotNull(), own)
    base = steps.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pts").alias("first_pts"), (F.max("pts") - F.min("pts")).alias("span"), F.min("d").alias("low"), F.max("d").alias("high"),
        F.min(inner).alias("least"), F.max(inner).alias("most"), F.max(F.when(F.col("d").isNull(), own)).alias("tail"),
    )
    counts = steps.where("d IS NOT NULL").groupBy("stream_id", "d").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy("stream_id").agg(F.min_by("d", F.struct(-F.col("c"), F.col("d"))).alias("modal"))
    names = ["stream_id", "n", "first_pts", "span", "low", "high", "least", "most", "tail", "modal"]
    interval = "struct<num:bigint,den:bigint>"
    schema = f"stream_id long, n long, first_pts long, span long, uniform {interval}, tries array<{interval}>"
    made = to_arrow_schema(StructType.fromDDL(schema))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = lambda i: i and {"num": i.numerator, "den": i.denominator}
        for batch in batches:
            out = []
            for stream_id, n, first, span, low, high, least, most, tail, usual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = uniform_interval(n, span, low, high, (least, most, tail), ticks, nominal)
                tries = [ticks / nominal] if nominal else []
                if low is not None and low > 0:
                    tries += [i for d in (usual, low) for i in (Fraction(d), over_1001(Fraction(d), ticks)) if i]
                out.append({"stream_id": stream_id, "n": n, "first_pts": first, "span": span, "uniform": pair(one), "tries": [pair(i) for i in tries] if one is None and low and low > 0 else []})
            yield pa.RecordBatch.from_pylist(out, schema=made)

    judged = base.join(modal, "stream_id", "left").select(*names).mapInArrow(judge, schema)
    tested = counts.join(judged.select("stream_id", F.posexplode("tries").alias("place", "p")), "stream_id").select("stream_id", "place", "p", big("d").alias("d"), big("p.num").alias("a"), big("p.den").alias("b"))
    tested = tested.withColumn("m", half_even(F.col("d") * F.col("b"), F.col("a")).cast("decimal(38,0)")).withColumn("whole", F.col("m") * F.col("a"))
    slack = F.when(F.col("whole") % F.col("b") == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.col("b"))
    fits = (F.col("m") >= 1) & (F.abs(F.col("d") * F.col("b") - F.col("whole")) <= slack)
    grids = tested.groupBy("stream_id", "place", "p").agg(F.bool_and(fits).alias("all"), F.max("m").alias("most")).where("all AND most > 1")
    gapped = grids.groupBy("stream_id").agg(F.min_by("p", "place").alias("gapped"))
    kind = F.when(F.col("uniform").isNotNull(), "uniform").when(F.col("gapped").isNotNull(), "gapped").otherwise("variable")
    found = judged.drop("tries").join(gapped, "stream_id", "left").withColumn("p", F.coalesce("uniform", "gapped"))
    return found.select("stream_id", "n", "first_pts", "span", kind.alias("verdict"), F.col("p.num").alias("num"), F.col("p.den").alias("den"))


def outgoing(stream: DataFrame, end: int | None = None, most: int | None = None) -> DataFrame:
    """What a sink takes of a stream with ``duration``: no row before 0, ``most`` rows at the most.

    The last row is cut at ``end`` but keeps one tick.
    """
    kept = stream.where("pts >= 0")
    if most is not None:
        kept = kept.withColumn("_n", F.row_number().over(by_stream())).where(F.col("_n") <= most).drop("_n")
    if end is None:
        return kept
    last = F.lead("pts").over(by_stream()).isNull()
    cut = F.greatest(F.lit(1), F.least(F.lit(end), F.col("pts") + F.col("duration")) - F.col("pts"))
    return kept.withColumn("_last", last).withColumn("duration", F.when(F.col("_last"), cut).otherwise(F.col("duration"))).drop("_last")


def conform(stream: DataFrame, interval: int, origin: Column | None = None) -> DataFrame:
    """Resample to a slot every ``interval`` ticks: each slot takes the row nearest in time.

    Returns stream_id, slot, pts, pos (of the source row), shift.  A slot halfway
    between two rows goes to the earlier; the last row keeps the slots up to half an
    interval after it.  Rows without a slot are dropped.  Slot numbers go on across
    segments.  More than ``MAX_FAN_OUT`` slots for a row stop the query.
    """
    zero = F.first("pts").over(by_stream().rowsBetween(W.unboundedPreceding, 0)) if origin is None else origin
    df = stream.withColumn("t", F.col("pts") - zero)
    nxt = F.lead("t").over(by_stream())
    # floor((t + next) / 2 / interval), exactly
    upper = F.when(nxt.isNotNull(), floor_div(F.col("t") + nxt, F.lit(2 * interval))).otherwise(floor_div(2 * F.col("t") + interval, F.lit(2 * interval)))
    df = df.withColumn("upper", upper)
    lower = F.coalesce(F.max("upper").over(by_stream().rowsBetween(W.unboundedPreceding, -1)) + 1, -floor_div(-F.col("t"), F.lit(interval)))
    df = df.withColumn("lower", lower).where("lower <= upper")
    fan = F.when(F.col("upper") - F.col("lower") >= MAX_FAN_OUT, F.raise_error(F.lit("a gap needs more than 10000 slots"))).otherwise(F.sequence("lower", "upper"))
    df = df.withColumn("slot", F.explode(fan))
    return df.select("stream_id", "slot", (F.col("pts") - F.col("t") + F.col("slot") * interval).alias("pts"), "pos", F.abs(F.col("slot") * interval - F.col("t")).alias("shift"))


def interpolate(stream: DataFrame, interval: int, hold: int | None = None) -> DataFrame:
    """Values on a grid of ``interval`` ticks by linear interpolation between the rows around.

    stream_id, slot, phase, value; a slot on a row has phase 0.  The numeric value
    stands in for a synthesised payload.  Nothing is made out of two segments: up to a
    cut the row before it is held.  With ``hold``, so is the last row, for its own
    ``duration`` if it has one above 0 and ``hold`` ticks otherwise; ``duration`` is then
    added, and cut at the end of the input.
    """
    order = by_stream()
    df = stream.withColumn("t", F.col("pts") - F.first("pts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("t2", F.lead("t").over(order)).withColumn("v2", F.lead("value").over(in_order(stream)))
    if hold is not None:
        own = F.when(F.col("duration") > 0, F.col("duration")) if "duration" in stream.columns else F.lit(None).cast("long")
        df = df.withColumn("end", F.when(F.col("t2").isNull(), F.col("t") + F.coalesce(own, F.lit(hold)))).withColumn("t2", F.coalesce("t2", "end"))
    df = df.where("t2 > t")
    ceil = lambda c: -floor_div(-F.col(c), F.lit(interval))
    df = df.withColumn("lo", ceil("t")).withColumn("hi", ceil("t2") - 1).where("lo <= hi")
    fan = F.when(F.col("hi") - F.col("lo") >= MAX_FAN_OUT, F.raise_error(F.lit("a gap needs more than 10000 slots"))).otherwise(F.sequence("lo", "hi"))
    df = df.withColumn("slot", F.explode(fan))
    phase = F.when(F.col("v2").isNull(), 0.0).otherwise((F.col("slot") * interval - F.col("t")) / (F.col("t2") - F.col("t")))
    value = F.col("value") + (F.coalesce("v2", "value") - F.col("value")) * phase
    length = [F.least(F.lit(interval), F.coalesce("end", F.lit(1 << 62)) - F.col("slot") * interval).cast("long").alias("duration")] if hold is not None else []
    return df.select("stream_id", "slot", phase.alias("phase"), value.alias("value"), *length)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_columns: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it (nulls if there is none).

    Both sides are laid into one order by key and time, so nothing is joined and a
    key with many rows on either side costs a sort.
    """
    mark = F.struct(*[F.col(c).alias(c) for c in right_columns])
    l = left.select(*left.columns, F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_m"), F.lit(1).alias("_side"))
    r = right.select(*[F.col(c) if c in keys or c == time else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], mark.alias("_m"), F.lit(0).alias("_side"))
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_m.{c}").alias(f"{c}_as_of") for c in right_columns])


def unwrapped(times: Iterable[int], reset: int = 10_000_000, default_stitch: int = 40_000) -> Iterator[int]:
    """Stamps in stream order without clock resets; keeps 15 steps and no stamps.

    A jump back of more than ``reset`` is held; it counts only if the next row stays
    behind (else it was an outlier).  A reset is stitched with the lower median of the
    last 15 forward steps, from which wide gaps are left out.
    """
    steps: list[int] = []
    offset, before, top, held = 0, None, None, None
    stitch = lambda: sorted(steps)[(len(steps) - 1) // 2] if steps else default_stitch
    for t in times:
        if held is not None:
            if before - t > reset:  # still behind: the clock was set back
                offset, before = held[1], held[0]
            held = None
        if before is not None and before - t > reset:
            candidate = top + stitch() - t
            held = (t, candidate)
            now = t + candidate
        else:
            if before is not None and 0 < t - before <= max(1_000_000, 4 * stitch()):
                steps = [*steps[-14:], t - before]
            before = t
            now = t + offset
        top = now if top is None else max(top, now)
        yield now


def unwrap_clock(times: Iterable[int], reset: int = 10_000_000, default_stitch: int = 40_000) -> list[int]:
    """``unwrapped`` as a list."""
    return list(unwrapped(times, reset, default_stitch))


def epoch_unwrap(stream: DataFrame, reset: int = 10_000_000) -> DataFrame:
    """Add ``adjusted``: the clock of each stream without its resets, by ``unwrapped``."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        rows, stamps = tee(rows)  # both advance together
        for row, now in zip(rows, unwrapped((r[2] for r in stamps), reset), strict=True):
            yield (*row, now)

    return ordered(stream.select("stream_id", "pos", "pts"), ["pos"], run, "stream_id long, pos long, pts long, adjusted long")


def windows_at_sync(sync: Iterable[bool], least: int, most: int, overlap: int = 2) -> Iterator[tuple[int, int, int, int]]:
    """(process from, to, emit from, to) of windows that close at sync rows.

    A window closes at a sync row at least ``least`` rows after its anchor, whose row
    it still processes; without one it is split after ``most`` rows, with
    ``overlap`` rows on either side of the split.  Every row is emitted once.
    """
    emit = anchor = total = 0
    first = lambda: emit if emit == anchor else max(anchor, emit - overlap)
    for pos, closes in enumerate(sync):
        total = pos + 1
        if not closes or pos - anchor < least or pos == emit:
            continue
        while pos - emit > most:
            yield first(), min(pos, emit + most + overlap), emit, emit + most
            emit += most
        yield first(), pos + 1, emit, pos
        emit = anchor = pos
    while total - emit > most:
        yield first(), min(total, emit + most + overlap), emit, emit + most
        emit += most
    if emit < total:
        yield first(), total, emit, total


def sync_windows(sync: Iterable[bool], least: int, most: int, overlap: int = 2) -> list[tuple[int, int, int, int]]:
    """``windows_at_sync`` as a list."""
    return list(windows_at_sync(sync, least, most, overlap))


def gop_windows(stream: DataFrame, least: int, most: int) -> DataFrame:
    """Windows of each stream with a ``is_sync`` column, by ``windows_at_sync``."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        head = next(rows)
        for window in windows_at_sync((r[2] for r in chain([head], rows)), least, most):
            yield (head[0], *window)

    return ordered(stream.select("stream_id", "pos", "is_sync"), ["pos"], run, "stream_id long, process_from long, process_to long, emit_from long, emit_to long")


def fixed_windows(total: Column, window: int, trim: int) -> Column:
    """Windows of ``window`` rows that advance by window - 2 * trim, each row emitted once.

    An array of structs (process_from, process_to, emit_from, emit_to).
    """
    step = window - 2 * trim
    # the k-th full window begins at k * step; the first also emits its head
    full = F.when(total >= window, F.floor((total - window) / step) + 1).otherwise(0).cast("int")
    whole = F.transform(
        F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct((k * step).cast("long").alias("process_from"), (k * step + window).cast("long").alias("process_to"), F.when(k == 0, 0).otherwise(k * step + trim).cast("long").alias("emit_from"), (k * step + window - trim).cast("long").alias("emit_to")),
    )
    done = F.when(full > 0, (full - 1) * step + window - trim).otherwise(0).cast("long")
    start = F.greatest(F.lit(0).cast("long"), F.least(done - trim, total - window).cast("long"))
    rest = F.struct(start.alias("process_from"), total.cast("long").alias("process_to"), done.alias("emit_from"), total.cast("long").alias("emit_to"))
    return F.when(done < total, F.array_append(whole, rest)).otherwise(whole)

