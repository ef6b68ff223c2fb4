"""Evaluation of variants: baselines, gates, labels, votes, intervals and tracks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.functions.rational import half_even
from loomtick.operators.ordered import ordered
from loomtick.operators.streams import by_stream


def baseline_delta(rows: DataFrame, source: str, mode: str, baseline: str, value: str, order: str) -> DataFrame:
    """Each row with the last baseline row of its source, by ``order``, and its distance from it (null without one)."""
    base = rows.where(F.col(mode) == baseline).groupBy(source).agg(F.max_by(value, order).alias("baseline"))
    return rows.join(base, source, "left").withColumn("delta", F.col(value) - F.col("baseline"))


def regression_gate(runs: DataFrame, keys: list[str], value: str, is_baseline: Column, fraction: float) -> DataFrame:
    """Whether the median of the current runs stays within the allowed margin of the baseline's.

    The margin is the larger of ``fraction`` of the baseline and three standard
    deviations of its runs (0 for fewer than three runs).
    """
    v = F.col(value)
    out = runs.groupBy(*keys).agg(
        F.percentile(F.when(is_baseline, v), F.lit(0.5)).alias("baseline"),
        F.percentile(F.when(~is_baseline, v), F.lit(0.5)).alias("current"),
        F.count(F.when(is_baseline, v)).alias("_n"),
        F.stddev_samp(F.when(is_baseline, v)).alias("_s"),
    )
    noise = F.when(F.col("_n") >= 3, 3 * F.col("_s")).otherwise(F.lit(0.0))
    out = out.withColumn("margin", F.greatest(noise, fraction * F.col("baseline"))).withColumn("delta", F.col("current") - F.col("baseline"))
    return out.withColumn("pass", F.col("delta") <= F.col("margin")).drop("_n", "_s")


def labels(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def vote(steps: DataFrame, keys: list[str], position: str, step: str, candidates: DataFrame, candidate: str, expected: Column, least: int = 3) -> DataFrame:
    """The candidate whose expected steps meet most of the measured ones; the first of equals.

    A hit lies within max(1, 8 %) of the expected step; fewer than ``least`` hits
    give null.  ``candidates`` is a fixed list of settings.
    """
    hit = F.abs(F.col(step) - expected) <= F.greatest(F.lit(1.0), 0.08 * expected)
    hits = steps.join(candidates, F.lit(True)).groupBy(*keys, candidate).agg(F.count_if(hit).alias("hits"))
    best = hits.groupBy(*keys).agg(F.max_by(F.struct(candidate, "hits"), F.struct(F.col("hits"), -F.col(candidate))).alias("b"))
    return best.select(*keys, F.when(F.col("b.hits") >= least, F.col(f"b.{candidate}")).alias("best"), F.col("b.hits").alias("hits"))


def unanimous_prefix(flags: DataFrame, keys: list[str], line: str, ok: str, least: int = 3) -> DataFrame:
    """Length of the run of lines from 0 on at which every sample agrees (at least ``least`` samples)."""
    lines = flags.groupBy(*keys, line).agg(F.bool_and(ok).alias("ok"), F.count(F.lit(1)).alias("n"))
    stop = F.min(F.when(~F.col("ok") | (F.col("n") < least), F.col(line)))
    return lines.groupBy(*keys).agg(F.coalesce(stop, F.max(line) + 1).cast("long").alias("width"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open intervals share, null if none."""
    n = F.least(a1, b1) - F.greatest(a0, b0)
    return F.when(n > 0, n)


def union_of_metrics(*frames: DataFrame) -> DataFrame:
    """All rows under the sorted union of the columns; what a frame lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def iou(a: list[float], b: list[float]) -> float:
    """Intersection over union of two boxes x0, y0, x1, y1."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def tracks(observations: DataFrame, gap: int = 8, least: float = 0.1) -> DataFrame:
    """Assign observations (stream_id, frame, score, x0, y0, x1, y1) to tracks.

    Within a frame the highest score chooses first; it takes the open track (seen at
    most ``gap`` frames ago) that it overlaps most, if by at least ``least``, and
    otherwise starts a new one.  Tracks count from 1.  Order matters, so a stream is
    read in order; only its open tracks are kept.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: dict[int, tuple[int, list[float]]] = {}  # open tracks: last frame and box
        taken: set[int] = set()
        now, count = None, 1
        for row in rows:
            frame, box = row[1], list(row[3:7])
            if frame != now:
                now, taken = frame, set()
                seen = {k: v for k, v in seen.items() if frame - v[0] <= gap}
            fits = {k: v for k, (_, at) in seen.items() if k not in taken and (v := iou(box, at)) >= least}
            found = max(fits, key=lambda k: (fits[k], -k), default=count)
            count += found == count
            seen[found] = (frame, box)
            taken.add(found)
            yield (*row, found)

    names = ["stream_id long", "frame long", "score double", "x0 double", "y0 double", "x1 double", "y1 double"]
    typed = observations.select(*(F.col(n).cast(t) for n, t in map(str.split, names)))
    return ordered(typed, ["frame", F.desc("score"), "x0", "y0"], run, ", ".join([*names, "track long"]))


def zipped(left: DataFrame, right: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """(stream_id, pos, value, other) of two streams row by row, up to the end of the shorter.

    With ``strict``, a row without a partner stops the query instead.
    """
    other = right.select("stream_id", "pos", F.col(value).alias("other"), F.lit(True).alias("_r"))
    both = left.select("stream_id", "pos", value, F.lit(True).alias("_l")).join(other, ["stream_id", "pos"], "full" if strict else "inner")
    if strict:
        both = both.where(F.when(F.col("_l") & F.col("_r"), True).otherwise(F.raise_error(F.concat(F.lit("streams drift apart at row "), F.col("pos")))))
    return both.drop("_l", "_r")


def clean_comparison(pairs: DataFrame, keys: list[str], reference: str, candidate: str) -> DataFrame:
    """Mean, worst and root-mean distance from a clean reference, the last as PSNR (99 if there is none)."""
    d = F.abs(F.col(reference) - F.col(candidate))
    out = pairs.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_abs"), F.percentile(d, F.lit(0.95)).alias("p95"), F.max(d).alias("worst"), F.avg(d * d).alias("_mse"))
    return out.withColumn("psnr", F.when(F.col("_mse") <= 0, 99.0).otherwise(-10 * F.log10("_mse"))).drop("_mse")


def label_counts(rows: DataFrame, keys: list[str], labels: str) -> DataFrame:
    """(*keys, label, n, place): how often each label was given, the most frequent first, equals by name."""
    counts = rows.select(*keys, F.explode(labels).alias("label")).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "label")))


def worst_of(scale: list[str], column: str) -> Column:
    """Aggregate: the highest step of an ordered scale; its first one where nothing is known."""
    steps = F.array(*map(F.lit, scale))
    return F.element_at(steps, F.greatest(F.lit(1), F.coalesce(F.max(F.array_position(steps, F.col(column))), F.lit(1))).cast("int"))


def nearby_pairs(stream: DataFrame, reach: int, value: str = "value") -> DataFrame:
    """(stream_id, pos, later, value, later_value): each pair of rows at most ``reach`` apart, once.

    A bounded window hands each row the next ones, so nothing is joined.
    """
    ahead = F.collect_list(F.struct(F.col("pos").alias("later"), F.col(value).alias("later_value"))).over(by_stream().rowsBetween(1, reach))
    pairs = stream.select("stream_id", "pos", value, ahead.alias("_a")).select("stream_id", "pos", value, F.explode("_a").alias("_p"))
    return pairs.where(F.col("_p.later") - F.col("pos") <= reach).select("stream_id", "pos", "_p.later", value, "_p.later_value")


def filled_tiles(tiles: DataFrame, keys: list[str], value: str, whole: DataFrame, fallback: float) -> DataFrame:
    """Tiles with their own value, else that of the whole (*keys, overall), else a fallback; and the share that had one."""
    coverage = F.avg(F.col(value).isNotNull().cast("double")).over(W.partitionBy(*keys))
    out = tiles.withColumn("coverage", coverage).join(whole, keys, "left")
    return out.withColumn("filled", F.coalesce(value, "overall", F.lit(fallback))).drop("overall")


def spread_runs(total: Column, most: int, length: int = 3) -> Column:
    """Starts of runs of neighbouring rows spread evenly over ``total`` rows, ``most`` rows in all.

    A total within ``most`` is one run from 0.
    """
    runs = max(2, most // length)
    even = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda i: half_even(i.cast("long") * (total - length), F.lit(runs - 1)))
    return F.when(total <= most, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(even)))


def persistence(stream: DataFrame, value: str = "value") -> DataFrame:
    """(stream_id, lag2_over_lag1): energy of the change over two rows over that of one; flicker stays near 1."""
    v = F.col(value)
    d = stream.select("stream_id", (v - F.lag(v, 1).over(by_stream())).alias("d1"), (v - F.lag(v, 2).over(by_stream())).alias("d2"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return d.groupBy("stream_id").agg((rms("d2") / (rms("d1") + 1e-9)).alias("lag2_over_lag1"))
