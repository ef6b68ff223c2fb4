"""The registered queries over the driver tables, and their SQL.

The tables hold no media, so each operator runs over a stream made of ``events`` (one
for each user) or over rows of another table.  The relational queries at the end are
Spark's own, over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtick.functions import clock as C
from loomtick.functions import quantiles as Q
from loomtick.functions.rational import floor_div
from loomtick.operators import evaluation as E
from loomtick.operators import guards as G
from loomtick.operators import samples as A
from loomtick.operators import streams as S
from loomtick.operators import temporal as T
from loomtick.operators import timing as M

HOUR = 3_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The event stream and its parts, as SQL.
STREAM_SQL = """s AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
 epoch_us(ts) AS pts, value, event_type FROM events)"""


#: The same stream cut where its value jumps, as SQL; filters keep to a segment.
CUTS_SQL = """g AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY pos)) > 200, false) AS cut FROM s),
x AS (SELECT *, sum(cut::INT) OVER (PARTITION BY stream_id ORDER BY pos) AS segment_id FROM g)"""


def _query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{S}", STREAM_SQL).replace("{CUTS}", CUTS_SQL)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _s(spark: SparkSession, d: str) -> DataFrame:
    return S.event_stream(_t(spark, d, "events"))


def _r(c, n: int = 6):
    return F.round(c, n)


def _scaled(c, n: int):
    """Rounded as DuckDB does: Spark's round takes a number's shortest decimals, DuckDB's the number times a power of ten."""
    return F.round(F.col(c) * 10.0**n) / 10.0**n



def _sync():
    return F.col("event_type") == "purchase"



@_query("""WITH {S}, c AS (SELECT *, CASE WHEN abs(value - lag(value) OVER w) > 200 THEN 1 ELSE 0 END AS cut FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id ORDER BY pos) AS segment_id FROM c)
SELECT stream_id, segment_id::BIGINT AS segment_id, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[floor(0.9 * (count(*) - 1))::INT + 1] AS p90 FROM g GROUP BY 1, 2""")
def segments_summary(spark, d):
    s = S.with_segments(_s(spark, d), S.jump(200))
    return s.groupBy("stream_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("value")).alias("mean"), Q.nearest_lower(F.collect_list("value"), 0.9).alias("p90"))



def _embedded():
    return W.partitionBy("label").orderBy("vec_id")



@_query("""WITH p AS (SELECT vec_id, label, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
m AS (SELECT vec_id, label, CASE WHEN a IS NOT NULL THEN list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(b) END AS mad FROM p)
SELECT vec_id, label, round(mad, 6) AS mad, coalesce(mad > 0.13, false) AS is_cut FROM m""")
def cut_simple(spark, d):
    e = _t(spark, d, "embeddings")
    mad = S.array_mad(F.col("embedding"), F.lag("embedding").over(_embedded()))
    return e.withColumn("m", mad).select("vec_id", "label", _r("m").alias("mad"), F.coalesce(F.col("m") > 0.13, F.lit(False)).alias("is_cut"))


@_query("""WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(floor(least(greatest((v::DOUBLE + 1) * 128, 0), 255)) * 32 / 256)) AS bins FROM embeddings),
h AS (SELECT vec_id, label, list_transform(range(0, 32), lambda k: len(list_filter(bins, lambda x: x = k))::DOUBLE) AS now FROM b),
p AS (SELECT vec_id, label, now, lag(now) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM h),
m AS (SELECT vec_id, label, CASE WHEN before IS NOT NULL THEN list_sum(list_transform(list_zip(before, now), lambda x: (x[1] - x[2]) * (x[1] - x[2]) / (x[1] + x[2] + 1e-6))) / (list_sum(before) + 1e-6) END AS chi FROM p)
SELECT vec_id, label, round(chi, 6) AS chi, coalesce(chi > 0.25, false) AS is_cut FROM m""")
def cut_hist(spark, d):
    e = _t(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda v: F.floor(F.least(F.greatest((v.cast("double") + 1) * 128, F.lit(0.0)), F.lit(255.0))))
    h = e.select("vec_id", "label", S.histogram(scaled).alias("now")).withColumn("before", F.lag("now").over(_embedded()))
    return h.withColumn("c", S.chi_square(F.col("before"), F.col("now"))).select("vec_id", "label", _r("c").alias("chi"), F.coalesce(F.col("c") > 0.25, F.lit(False)).alias("is_cut"))


@_query("""WITH {S}, f AS (SELECT stream_id * 5 + k AS stream_id, pos,
 CASE k WHEN 0 THEN pts WHEN 1 THEN pos * 40000 WHEN 2 THEN pos * 40000 + (pos % 3 = 1)::INT WHEN 3 THEN (pos + pos // 7) * 40000 ELSE (pos // 3 * 3 + (pos * 2) % 3) * 40000 END AS pts FROM s, range(0, 5) r(k)),
d AS (SELECT *, lead(pts) OVER (PARTITION BY stream_id ORDER BY pts, pos) - pts AS d FROM f),
c AS (SELECT stream_id, d, count(*) AS c FROM d WHERE d IS NOT NULL GROUP BY 1, 2),
m AS (SELECT stream_id, arg_min(d, (-c)::HUGEINT * 1000000000000000 + d) AS modal FROM c GROUP BY 1),
b AS (SELECT d.stream_id, count(*) AS n, min(pts) AS first_pts, max(pts) - min(pts) AS span, min(d) AS d_min, max(d) AS d_max FROM d GROUP BY 1),
t AS (SELECT d.stream_id, bool_and(modal > 0 AND d % nullif(modal, 0) = 0) AS bm, bool_and(d_min > 0 AND d % nullif(d_min, 0) = 0) AS bn FROM d JOIN m USING (stream_id) JOIN b USING (stream_id) WHERE d IS NOT NULL GROUP BY 1),
v AS (SELECT b.*, modal, bm, CASE WHEN n = 1 THEN 'single' WHEN d_min <= 0 THEN 'vfr' WHEN d_min = d_max THEN 'exact_cfr'
 WHEN abs(d_max * (n - 1) - span) <= n - 1 AND abs(d_min * (n - 1) - span) <= n - 1 THEN 'cfr' WHEN bm OR bn THEN 'gapped_cfr' ELSE 'vfr' END AS verdict FROM b LEFT JOIN m USING (stream_id) LEFT JOIN t USING (stream_id))
SELECT stream_id, n, first_pts::BIGINT AS first_pts, span::BIGINT AS span, (CASE WHEN verdict = 'gapped_cfr' THEN CASE WHEN bm THEN modal ELSE d_min END WHEN verdict = 'exact_cfr' THEN d_min END)::BIGINT AS "interval", verdict FROM v""")
def timing_verdict(spark, d):
    s = _s(spark, d)
    k = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    pts = F.when(F.col("k") == 0, F.col("pts")).when(F.col("k") == 1, F.col("pos") * 40000).when(F.col("k") == 2, F.col("pos") * 40000 + (F.col("pos") % 3 == 1).cast("int")).when(F.col("k") == 3, (F.col("pos") + F.floor(F.col("pos") / 7)) * 40000).otherwise((F.floor(F.col("pos") / 3) * 3 + F.col("pos") * 2 % 3) * 40000)
    f = k.select((F.col("stream_id") * 5 + F.col("k")).alias("stream_id"), "pos", pts.cast("long").alias("pts"))
    return M.verdict(f)


@_query("""WITH {S}, g AS (SELECT *, event_type = 'purchase' AS is_sync, sum((event_type = 'purchase')::INT) OVER (PARTITION BY stream_id ORDER BY pos) AS gop FROM s)
SELECT stream_id, pos, is_sync, CASE WHEN any_sync THEN o END AS gop_ordinal, CASE WHEN any_sync THEN l END AS gop_length FROM
(SELECT stream_id, pos, is_sync, bool_or(is_sync) OVER (PARTITION BY stream_id) AS any_sync, row_number() OVER (PARTITION BY stream_id, gop ORDER BY pos) - 1 AS o, count(*) OVER (PARTITION BY stream_id, gop) AS l FROM g)""")
def gop_positions(spark, d):
    return S.gop_positions(_s(spark, d), _sync()).select("stream_id", "pos", "is_sync", "gop_ordinal", "gop_length")


AT = 1_705_000_000_000_000


@_query(f"WITH {{S}} SELECT stream_id, arg_min(pos, abs(pts - {AT})::HUGEINT * 1000000 + pos) AS snapped FROM s WHERE event_type = 'purchase' GROUP BY 1")
def snap_start(spark, d):
    return S.snap_start(_s(spark, d), _sync(), F.lit(AT))


@_query(f"""WITH {{S}}, f AS (SELECT *, coalesce(max(CASE WHEN pts <= {AT} THEN pos END) OVER (PARTITION BY stream_id), 0) AS first FROM s)
SELECT stream_id, pos, pts, value FROM f WHERE pos >= first AND pts < {AT + 100 * HOUR}""")
def trim_window(spark, d):
    return S.trim(_s(spark, d), F.lit(AT), F.lit(AT + 100 * HOUR)).select("stream_id", "pos", "pts", "value")


@_query(f"""WITH {{S}}, t AS (SELECT *, pts - first_value(pts) OVER w AS t FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
n AS (SELECT *, lead(t) OVER (PARTITION BY stream_id ORDER BY pos) AS nxt FROM t),
u AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN (t + nxt) // {2 * HOUR} ELSE (2 * t + {HOUR}) // {2 * HOUR} END AS up FROM n),
l AS (SELECT *, coalesce(max(up) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS lo FROM u)
SELECT stream_id, slot::BIGINT AS slot, (pts - t + slot * {HOUR})::BIGINT AS pts, pos, abs(slot * {HOUR} - t)::BIGINT AS shift FROM (SELECT *, unnest(range(lo::BIGINT, up::BIGINT + 1)) AS slot FROM l WHERE lo <= up)""")
def conform_hourly(spark, d):
    return M.conform(_s(spark, d), HOUR)


@_query(f"""WITH {{S}}, t AS (SELECT *, pts - first_value(pts) OVER (PARTITION BY stream_id ORDER BY pos) AS t FROM s),
n AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
g AS (SELECT *, unnest(range(((t + {6 * HOUR - 1}) // {6 * HOUR})::BIGINT, ((t2 + {6 * HOUR - 1}) // {6 * HOUR})::BIGINT)) AS slot FROM n WHERE t2 > t)
SELECT stream_id, slot, round((slot * {6 * HOUR} - t) / (t2 - t), 6) AS phase, round(value + (v2 - value) * ((slot * {6 * HOUR} - t) / (t2 - t)), 6) AS value FROM g""")
def interpolate_grid(spark, d):
    return M.interpolate(_s(spark, d), 6 * HOUR).select("stream_id", "slot", _r("phase").alias("phase"), _r("value").alias("value"))


@_query("""WITH {S}, p AS (SELECT * FROM s WHERE event_type = 'purchase'), v AS (SELECT * FROM s WHERE event_type = 'view')
SELECT p.stream_id, p.pos, p.pts, v.pos AS pos_as_of, v.value AS value_as_of FROM p ASOF LEFT JOIN v ON p.stream_id = v.stream_id AND p.pts >= v.pts""")
def asof_pair(spark, d):
    s = _s(spark, d).select("stream_id", "pos", "pts", "value", "event_type")
    left = s.where("event_type = 'purchase'").select("stream_id", "pos", "pts")
    return M.as_of(left, s.where("event_type = 'view'"), ["stream_id"], "pts", ["pos", "value"])


TSD_SQL = """t AS (SELECT stream_id, pos, abs(floor(value) - floor((lag(floor(value)) OVER w + lead(floor(value)) OVER w) / 2))::BIGINT AS tsd FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos))"""


@_query("WITH {S}, " + TSD_SQL + """ SELECT stream_id, count(*) AS n, round(avg(tsd), 6) AS mean, round(stddev_pop(tsd), 6) AS std, round(quantile_cont(tsd, 0.95), 6) AS p95, max(tsd) AS worst, arg_max(pos, tsd * 1000000 - pos) AS worst_pos, quantile_cont(tsd, 0.5) AS median FROM t WHERE tsd IS NOT NULL GROUP BY 1""")
def tsd_shimmer(spark, d):
    t = T.temporal_difference(_s(spark, d))
    return t.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("tsd")).alias("mean"), _r(F.stddev_pop("tsd")).alias("std"), _r(F.percentile("tsd", F.lit(0.95))).alias("p95"), F.max("tsd").alias("worst"), F.max_by("pos", F.struct(F.col("tsd"), -F.col("pos"))).alias("worst_pos"), F.percentile("tsd", F.lit(0.5)).alias("median"))


@_query("WITH {S}, " + TSD_SQL + " SELECT stream_id, (pos - 1) // 24 AS bucket, count(*) AS n, round(avg(tsd), 6) AS mean FROM t WHERE tsd IS NOT NULL GROUP BY 1, 2")
def tsd_buckets(spark, d):
    t = T.temporal_difference(_s(spark, d))
    return t.groupBy("stream_id", F.floor((F.col("pos") - 1) / 24).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg("tsd")).alias("mean"))


MASK_SQL = """x AS (SELECT stream_id, pos, value AS src, value * 0.9 + (pos % 5) AS cand, count(*) OVER (PARTITION BY stream_id) AS n FROM s),
m AS (SELECT *, abs(src - lag(src) OVER w) AS ds, abs(cand - lag(cand) OVER w) AS dc FROM x WINDOW w AS (PARTITION BY stream_id ORDER BY pos)),
k AS (SELECT *, CASE WHEN ds < 20 THEN dc END AS flicker, CASE WHEN ds > 60 THEN abs(cand - src) END AS deviation FROM m WHERE pos >= 3 AND pos < n - 2)"""


def _masked(spark, d):
    s = _s(spark, d).select("stream_id", "pos", F.col("value").alias("source"), (F.col("value") * 0.9 + F.col("pos") % 5).alias("candidate"))
    return T.masked_change(s, 20, 60, S.by_stream())


@_query("WITH {S}, " + MASK_SQL + " SELECT stream_id, round(avg(flicker) * 1000, 4) AS flicker_e3, count(flicker) AS n FROM k GROUP BY 1")
def flicker_masked(spark, d):
    return _masked(spark, d).groupBy("stream_id").agg(_r(F.avg("flicker") * 1000, 4).alias("flicker_e3"), F.count("flicker").alias("n"))


@_query("WITH {S}, " + MASK_SQL + " SELECT stream_id, round(list_sort(list(deviation))[floor(0.9 * (count(deviation) - 1))::INT + 1] * 1000, 4) AS moving_dev_e3 FROM k WHERE deviation IS NOT NULL GROUP BY 1")
def moving_dev(spark, d):
    k = _masked(spark, d).where("deviation IS NOT NULL")
    return k.groupBy("stream_id").agg(_r(Q.nearest_lower(F.collect_list("deviation"), 0.9) * 1000, 4).alias("moving_dev_e3"))


@_query("""WITH q AS (SELECT vec_id, label, list_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS q, row_number() OVER w AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
l AS (SELECT a.vec_id, a.label, a.q, list(b.q) AS w FROM q a JOIN q b ON a.label = b.label AND abs(a.p - b.p) <= least(5, a.p - 1, a.n - a.p) GROUP BY ALL)
SELECT vec_id, label, len(w)::INT AS n, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: list_sum(list_transform(w, lambda x: x[i])) / len(w) - q[i])) / len(q), 6) + 0.0 AS shift FROM l""")
def level_scalar(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label", F.col("label").cast("long").alias("stream_id"), F.array_sort(F.transform("embedding", lambda x: x.cast("double"))).alias("q"))
    pos, n = F.row_number().over(_embedded()), F.count(F.lit(1)).over(W.partitionBy("label"))
    size = (2 * F.least(F.lit(5), pos - 1, n - pos) + 1).cast("int")
    return T.level(e.withColumn("n", size), "q", 5, _embedded()).select("vec_id", "label", "n", (_r("shift") + 0.0).alias("shift"))


@_query("""WITH {S}, w AS (SELECT stream_id, pos, value, list(value) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS w, list(value) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l, list(value) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS r FROM s),
m AS (SELECT *, list_sort(w)[(len(w) - 1) // 2 + 1] AS med, coalesce(list_sum(list_transform(range(1, len(w)), lambda i: abs(w[i + 1] - w[i]))), 0) AS swing, abs(w[len(w)] - w[1]) AS drift FROM w),
i AS (SELECT *, list_filter(w, lambda x: abs(x - med) < 120) AS inb FROM m)
SELECT stream_id, pos, round(CASE WHEN len(w) >= 6 AND drift <= 0.6 * swing + 1.5 AND len(inb) >= 0.6 * len(w) AND (coalesce(len(l), 0) = 0 OR len(list_filter(l, lambda x: abs(x - med) < 120)) > 0) AND (coalesce(len(r), 0) = 0 OR len(list_filter(r, lambda x: abs(x - med) < 120)) > 0) AND abs(list_sum(inb) / len(inb) - value) < 80 THEN list_sum(inb) / len(inb) ELSE value END, 6) AS fixed FROM i""")
def deflicker_1d(spark, d):
    return T.deflicker(_s(spark, d), 8, 120, 0.6, 80, 1.5).select("stream_id", "pos", _r("fixed").alias("fixed"))


@_query("""WITH {S}, w AS (SELECT *, coalesce(list(value) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS p FROM s)
SELECT stream_id, pos, round((value + coalesce(list_sum(list_transform(p, lambda x: 0.8 * exp(-pow((x - value) / 60.0, 2)) * x)), 0)) / (1 + coalesce(list_sum(list_transform(p, lambda x: 0.8 * exp(-pow((x - value) / 60.0, 2)))), 0)), 6) AS blended FROM w""")
def fir_blend(spark, d):
    return T.fir_blend(_s(spark, d), 4, 60.0, 0.8).select("stream_id", "pos", _r("blended").alias("blended"))


@_query("""WITH RECURSIVE {S}, e AS (SELECT stream_id, pos, value AS ema FROM s WHERE pos = 0 UNION ALL SELECT s.stream_id, s.pos, 0.3 * s.value + 0.7 * e.ema FROM e JOIN s ON s.stream_id = e.stream_id AND s.pos = e.pos + 1)
SELECT stream_id, pos, round(ema, 6) AS ema FROM e""")
def ema_tracker(spark, d):
    return T.ema(_s(spark, d), 0.3).select("stream_id", "pos", _r("ema").alias("ema"))


@_query("""WITH {S}, g AS (SELECT stream_id, pos, abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY pos)) / 1.4142135623730951 AS sg FROM s),
h AS (SELECT *, list(sg) FILTER (sg IS NOT NULL) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS h FROM g),
r AS (SELECT *, list_sort(h)[len(h) // 2 + 1] AS ref FROM h)
SELECT stream_id, pos, round(CASE WHEN sg IS NULL OR len(h) < 8 OR ref < 0.002 THEN 1.0 ELSE greatest(0.6, least(1.8, sg / ref)) END, 6) AS gain FROM r""")
def pulse_gain(spark, d):
    s = _s(spark, d)
    return T.pulse_gain(s, T.spread(s)).select("stream_id", "pos", _r("gain").alias("gain"))


def _cut(spark, d):
    return S.with_segments(_s(spark, d), S.jump(200))


@_query("""WITH {S}, {CUTS}, w AS (SELECT *, coalesce(list(value) OVER (PARTITION BY stream_id, segment_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS p FROM x)
SELECT stream_id, pos, round((value + coalesce(list_sum(list_transform(p, lambda x: 0.8 * exp(-pow((x - value) / 60.0, 2)) * x)), 0)) / (1 + coalesce(list_sum(list_transform(p, lambda x: 0.8 * exp(-pow((x - value) / 60.0, 2)))), 0)), 6) AS blended FROM w""")
def fir_blend_cuts(spark, d):
    return T.fir_blend(_cut(spark, d), 4, 60.0, 0.8).select("stream_id", "pos", _r("blended").alias("blended"))


@_query("""WITH {S}, {CUTS}, w AS (SELECT stream_id, pos, value, list(value) OVER (PARTITION BY stream_id, segment_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS w, list(value) OVER (PARTITION BY stream_id, segment_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l, list(value) OVER (PARTITION BY stream_id, segment_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS r FROM x),
m AS (SELECT *, list_sort(w)[(len(w) - 1) // 2 + 1] AS med, coalesce(list_sum(list_transform(range(1, len(w)), lambda i: abs(w[i + 1] - w[i]))), 0) AS swing, abs(w[len(w)] - w[1]) AS drift FROM w),
i AS (SELECT *, list_filter(w, lambda x: abs(x - med) < 120) AS inb FROM m)
SELECT stream_id, pos, round(CASE WHEN len(w) >= 6 AND drift <= 0.6 * swing + 1.5 AND len(inb) >= 0.6 * len(w) AND (coalesce(len(l), 0) = 0 OR len(list_filter(l, lambda x: abs(x - med) < 120)) > 0) AND (coalesce(len(r), 0) = 0 OR len(list_filter(r, lambda x: abs(x - med) < 120)) > 0) AND abs(list_sum(inb) / len(inb) - value) < 80 THEN list_sum(inb) / len(inb) ELSE value END, 6) AS fixed FROM i""")
def deflicker_cuts(spark, d):
    return T.deflicker(_cut(spark, d), 8, 120, 0.6, 80, 1.5).select("stream_id", "pos", _r("fixed").alias("fixed"))


@_query("""WITH {S}, {CUTS}, gg AS (SELECT stream_id, segment_id, pos, abs(value - lag(value) OVER (PARTITION BY stream_id, segment_id ORDER BY pos)) / 1.4142135623730951 AS sg FROM x),
h AS (SELECT *, list(sg) FILTER (sg IS NOT NULL) OVER (PARTITION BY stream_id, segment_id ORDER BY pos ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS h FROM gg),
r AS (SELECT *, list_sort(h)[len(h) // 2 + 1] AS ref FROM h)
SELECT stream_id, pos, round(CASE WHEN sg IS NULL OR len(h) < 8 OR ref < 0.002 THEN 1.0 ELSE greatest(0.6, least(1.8, sg / ref)) END, 6) AS gain FROM r""")
def pulse_gain_cuts(spark, d):
    s = _cut(spark, d)
    return T.pulse_gain(s, T.spread(s)).select("stream_id", "pos", _r("gain").alias("gain"))


@_query("""WITH {S}, {CUTS}, q AS (SELECT *, [value, value * value / 500] AS q, row_number() OVER (PARTITION BY stream_id, segment_id ORDER BY pos) AS p, count(*) OVER (PARTITION BY stream_id, segment_id) AS n FROM x),
l AS (SELECT a.stream_id, a.pos, a.q, list(b.q) AS w FROM q a JOIN q b ON a.stream_id = b.stream_id AND a.segment_id = b.segment_id AND abs(a.p - b.p) <= least(5, a.p - 1, a.n - a.p) GROUP BY ALL)
SELECT stream_id, pos, round(list_sum(list_transform([1, 2], lambda i: list_sum(list_transform(w, lambda v: v[i])) / len(w) - q[i])) / 2, 5) + 0.0 AS shift FROM l""")
def level_cuts(spark, d):
    s = _cut(spark, d).withColumn("q", F.array("value", F.col("value") * F.col("value") / 500))
    return T.level(s, "q", 5).select("stream_id", "pos", (_scaled("shift", 5) + 0.0).alias("shift"))


@_query("""WITH RECURSIVE {S}, {CUTS}, e AS (SELECT stream_id, pos, value AS ema FROM x WHERE pos = 0 UNION ALL SELECT x.stream_id, x.pos, CASE WHEN x.cut THEN x.value ELSE 0.3 * x.value + 0.7 * e.ema END FROM e JOIN x ON x.stream_id = e.stream_id AND x.pos = e.pos + 1)
SELECT stream_id, pos, round(ema, 6) AS ema FROM e""")
def ema_cuts(spark, d):
    return T.ema(_cut(spark, d), 0.3).select("stream_id", "pos", _r("ema").alias("ema"))


@_query("""WITH RECURSIVE {S}, t AS (SELECT stream_id, count(*) AS total FROM s GROUP BY 1), y AS (SELECT stream_id, pos FROM s WHERE event_type = 'purchase'),
a AS (SELECT stream_id, 0::BIGINT AS a FROM t UNION ALL SELECT a.stream_id, min(y.pos) FROM a JOIN y ON y.stream_id = a.stream_id AND y.pos >= a.a + 4 GROUP BY a.stream_id, a.a),
g AS (SELECT stream_id, a, total, lead(a) OVER (PARTITION BY stream_id ORDER BY a) AS nxt FROM a JOIN t USING (stream_id)), e AS (SELECT *, coalesce(nxt, total) AS stop FROM g WHERE a < total),
p AS (SELECT *, a + 12 * unnest(range(0, (stop - a + 11) // 12)) AS f FROM e)
SELECT stream_id, (CASE WHEN f = a THEN a ELSE greatest(a, f - 2) END)::BIGINT AS process_from, (CASE WHEN f + 12 < stop THEN least(stop, f + 14) WHEN nxt IS NULL THEN total ELSE nxt + 1 END)::BIGINT AS process_to, f::BIGINT AS emit_from, least(stop, f + 12)::BIGINT AS emit_to FROM p""")
def gop_windows(spark, d):
    return M.gop_windows(S.gop_positions(_s(spark, d), _sync()), 4, 12)


@_query(f"""WITH RECURSIVE {{S}}, q AS (SELECT stream_id, pos, (pts - pos // 20 * {48 * HOUR})::BIGINT AS t FROM s),
e AS (SELECT stream_id, -1::BIGINT AS pos, 0::BIGINT AS pts, []::BIGINT[] AS steps, 0::BIGINT AS off, NULL::BIGINT AS bef, NULL::BIGINT AS top, NULL::BIGINT AS ht, NULL::BIGINT AS hc, 0::BIGINT AS adjusted FROM q WHERE pos = 0 UNION ALL
 SELECT stream_id, pos, t, CASE WHEN NOT back AND bef IS NOT NULL AND t > bef AND t - bef <= greatest(1000000, 4 * st) THEN list_append(steps[-14:], t - bef) ELSE steps END, off, CASE WHEN back THEN bef ELSE t END,
  greatest(coalesce(top, t + off), CASE WHEN back THEN top + st ELSE t + off END), CASE WHEN back THEN t END, CASE WHEN back THEN top + st - t END, CASE WHEN back THEN top + st ELSE t + off END FROM (
 SELECT *, bef IS NOT NULL AND bef - t > 10000000 AS back, coalesce(list_sort(steps)[(len(steps) + 1) // 2], 40000) AS st FROM (
 SELECT q.stream_id, q.pos, q.t, steps, top, CASE WHEN ht IS NOT NULL AND bef - q.t > 10000000 THEN hc ELSE off END AS off, CASE WHEN ht IS NOT NULL AND bef - q.t > 10000000 THEN ht ELSE bef END AS bef FROM e JOIN q ON q.stream_id = e.stream_id AND q.pos = e.pos + 1)))
SELECT stream_id, pos, pts, adjusted FROM e WHERE pos >= 0""")
def epoch_unwrap(spark, d):
    # the clock is set back by two days after every 20th row
    s = _s(spark, d).withColumn("pts", F.col("pts") - F.floor(F.col("pos") / 20) * 48 * HOUR)
    return M.epoch_unwrap(s)


@_query("""WITH t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)
SELECT user_id, k.process_from::BIGINT AS process_from, k.process_to::BIGINT AS process_to, k.emit_from::BIGINT AS emit_from, k.emit_to::BIGINT AS emit_to FROM (
SELECT user_id, unnest(CASE WHEN total < 10 THEN [{'process_from': 0, 'process_to': total, 'emit_from': 0, 'emit_to': total}] ELSE
 list_concat(list_transform(range(0, (total - 10) // 6 + 1), lambda k: {'process_from': k * 6, 'process_to': k * 6 + 10, 'emit_from': CASE WHEN k = 0 THEN 0 ELSE k * 6 + 2 END, 'emit_to': k * 6 + 8}),
 CASE WHEN ((total - 10) // 6) * 6 + 8 < total THEN [{'process_from': greatest(0, least(((total - 10) // 6) * 6 + 6, total - 10)), 'process_to': total, 'emit_from': ((total - 10) // 6) * 6 + 8, 'emit_to': total}] ELSE [] END) END) AS k FROM t)""")
def sliding_windows(spark, d):
    t = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return t.select("user_id", F.explode(M.fixed_windows(F.col("total"), 10, 2)).alias("w")).select("user_id", "w.*")


@_query("""WITH r AS (SELECT o_orderpriority AS source, o_orderstatus AS mode, date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3), b AS (SELECT source, arg_max(v, month) AS baseline FROM r WHERE mode = 'O' GROUP BY 1)
SELECT source, mode, month, round(v, 4) AS v, round(baseline, 4) AS baseline, round(v - baseline, 4) + 0.0 AS delta FROM r LEFT JOIN b USING (source)""")
def baseline_delta(spark, d):
    month = F.trunc(F.to_date("o_orderdate"), "month")
    r = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("mode"), month.alias("month")).agg(F.avg("o_totalprice").alias("v"))
    return E.baseline_delta(r, "source", "mode", "O", "v", "month").select("source", "mode", "month", _r("v", 4).alias("v"), _r("baseline", 4).alias("baseline"), (_r("delta", 4) + 0.0).alias("delta"))


@_query("""SELECT o_orderpriority AS grp, count(*) AS n, count(*) FILTER (o_totalprice < 100000) AS low, count(*) FILTER (o_totalprice >= 100000 AND o_totalprice < 300000) AS medium, count(*) FILTER (o_totalprice >= 300000) AS high, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY 1""")
def group_summary(spark, d):
    p = F.col("o_totalprice")
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if(p < 100000).alias("low"), F.count_if((p >= 100000) & (p < 300000)).alias("medium"), F.count_if(p >= 300000).alias("high"), _r(F.percentile(p, F.lit(0.5)), 4).alias("median"))


@_query("""WITH g AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) FILTER (l_linenumber <= 3) AS b, quantile_cont(l_extendedprice, 0.5) FILTER (l_linenumber > 3) AS c, count(*) FILTER (l_linenumber <= 3) AS n, stddev_samp(l_extendedprice) FILTER (l_linenumber <= 3) AS s FROM lineitem GROUP BY 1),
m AS (SELECT *, greatest(CASE WHEN n >= 3 THEN 0.01 * 3 * s ELSE 0 END, 0.0 * b) AS x FROM g)
SELECT l_suppkey, round(b, 4) AS baseline, round(c, 4) AS current, round(greatest(CASE WHEN n >= 3 THEN 3 * s ELSE 0.0 END, 0.03 * b), 4) AS margin, round(c - b, 4) + 0.0 AS delta, (c - b) <= greatest(CASE WHEN n >= 3 THEN 3 * s ELSE 0.0 END, 0.03 * b) AS pass FROM m""")
def regression_gate(spark, d):
    g = E.regression_gate(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", F.col("l_linenumber") <= 3, 0.03)
    return g.select("l_suppkey", _r("baseline", 4).alias("baseline"), _r("current", 4).alias("current"), _r("margin", 4).alias("margin"), (_r("delta", 4) + 0.0).alias("delta"), "pass")


@_query("""WITH {S}, g AS (SELECT stream_id, avg(value) AS m, stddev_pop(value) AS sd, max(value) AS mx, count(*) AS n FROM s GROUP BY 1)
SELECT stream_id, array_to_string(list_filter([CASE WHEN sd > 60 THEN 'spread' END, CASE WHEN mx > 400 THEN 'spikes' END, CASE WHEN sd > 1.1 * m THEN 'bursty' END, CASE WHEN n < 40 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS labels FROM g""")
def noise_labels(spark, d):
    g = _s(spark, d).groupBy("stream_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.max("value").alias("mx"), F.count(F.lit(1)).alias("n"))
    found = E.labels(("spread", F.col("sd") > 60), ("spikes", F.col("mx") > 400), ("bursty", F.col("sd") > 1.1 * F.col("m")), ("short", F.col("n") < 40))
    return g.select("stream_id", F.array_join(found, ",").alias("labels"))


@_query("""WITH h AS (SELECT p_brand, q, count(*) FILTER (abs(p_size - (p_partkey % 7 + 1) * (100 - q) / 20.0) <= greatest(1.0, 0.08 * ((p_partkey % 7 + 1) * (100 - q) / 20.0))) AS hits FROM part, range(5, 99) r(q) GROUP BY 1, 2),
b AS (SELECT p_brand, max(hits) AS hits, arg_max(q, hits * 1000 - q) AS best FROM h GROUP BY 1)
SELECT p_brand, (CASE WHEN hits >= 3 THEN best END)::INT AS best, hits FROM b""")
def qf_vote(spark, d):
    expected = (F.col("p_partkey") % 7 + 1) * (100 - F.col("q")) / 20.0
    candidates = spark.range(5, 99).select(F.col("id").cast("int").alias("q"))
    return E.vote(_t(spark, d, "part"), ["p_brand"], "p_partkey", "p_size", F.broadcast(candidates), "q", expected)


@_query("""WITH f AS (SELECT label, unnest(range(0, len(embedding))) AS line, unnest(embedding)::DOUBLE AS v FROM embeddings), l AS (SELECT label, line, bool_and(v < 0.4) AS ok, count(*) AS n FROM f GROUP BY 1, 2)
SELECT label, coalesce(min(line) FILTER (NOT ok OR n < 3), max(line) + 1)::BIGINT AS width FROM l GROUP BY 1""")
def bars_unanimous(spark, d):
    f = _t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("line", "v")).select("label", "line", (F.col("v").cast("double") < 0.4).alias("ok"))
    return E.unanimous_prefix(f, ["label"], "line", "ok")


SPAN_SQL = "sp AS (SELECT o_custkey, min(epoch_us(o_orderdate)) AS a, max(epoch_us(o_orderdate)) AS b FROM orders GROUP BY 1)"


@_query("WITH " + SPAN_SQL + """ SELECT x.o_custkey, y.o_custkey AS other, (least(x.b, y.b) - greatest(x.a, y.a))::BIGINT AS shared FROM sp x JOIN sp y ON y.o_custkey = x.o_custkey + 1 WHERE least(x.b, y.b) - greatest(x.a, y.a) > 0""")
def window_overlap(spark, d):
    at = F.expr("unix_micros(cast(convert_timezone('UTC', current_timezone(), o_orderdate) as timestamp))")
    sp = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    y = sp.select(F.col("o_custkey").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    both = sp.join(y, F.col("other") == F.col("o_custkey") + 1)
    return both.select("o_custkey", "other", E.overlap(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")).alias("shared")).where("shared IS NOT NULL")


@_query("""WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, min(day) AS a, max(day) AS z FROM c GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM b) SELECT event_type, day, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, day)""")
def gap_fill(spark, d):
    c = _t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    grid = c.groupBy("event_type").agg(F.min("day").alias("a"), F.max("day").alias("z")).select("event_type", F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("day"))
    return grid.join(c, ["event_type", "day"], "left").select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n"))


@_query("""SELECT event_type AS name, round(avg(value), 6) AS mean, NULL::BIGINT AS rows, NULL::DOUBLE AS worst FROM events GROUP BY 1 UNION ALL SELECT o_orderstatus, NULL, count(*), NULL FROM orders GROUP BY 1 UNION ALL SELECT l_returnflag, NULL, NULL, max(l_tax) FROM lineitem GROUP BY 1""")
def metric_union(spark, d):
    a = _t(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(_r(F.avg("value")).alias("mean"))
    b = _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    c = _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.max("l_tax").alias("worst"))
    return E.union_of_metrics(a, b, c)


@_query("""WITH {S}, g AS (SELECT stream_id, pos, CASE WHEN pos % 11 = 5 THEN (pos - 1) * 40000 WHEN pos % 13 = 7 THEN pos * 40000 + 17 ELSE pos * 40000 END AS pts FROM s),
v AS (SELECT *, lag(pts) OVER (PARTITION BY stream_id ORDER BY pos) AS before FROM g)
SELECT stream_id, pos, 'not_increasing' AS rule FROM v WHERE pts <= before UNION ALL SELECT stream_id, pos, 'off_grid' FROM v WHERE least(pts % 40000, 40000 - pts % 40000) > 1""")
def timeline_violations(spark, d):
    pts = F.when(F.col("pos") % 11 == 5, (F.col("pos") - 1) * 40000).when(F.col("pos") % 13 == 7, F.col("pos") * 40000 + 17).otherwise(F.col("pos") * 40000)
    return S.violations(_s(spark, d).withColumn("pts", pts), 40000)


@_query()
def face_tracks(spark, d):
    v = F.col("value")
    o = _s(spark, d).select("stream_id", F.floor(F.col("pos") / 2).alias("frame"), (v / 500).alias("score"), (v % 40).alias("x0"), (v % 30).alias("y0"), (v % 40 + 50).alias("x1"), (v % 30 + 50).alias("y1"))
    return E.tracks(o)


@_query("""WITH {S}, g AS (SELECT stream_id, list_sort(list(value)) AS v, count(*) AS n, quantile_cont(value, 0.5) AS averaging, quantile_cont(value, 0.95) AS p95 FROM s GROUP BY 1)
SELECT stream_id, v[n // 2 + 1] AS upper, v[(n - 1) // 2 + 1] AS lower, round(averaging, 6) AS averaging, v[floor(0.3 * (n - 1))::INT + 1] AS p30, round(p95, 6) AS p95,
 round(sqrt(list_sum(list_transform(list_reverse_sort(v)[:greatest(1, round_even(n * 0.05, 0)::INT)], lambda x: x * x)) / greatest(1, round_even(n * 0.05, 0)::INT)) / 2.3616, 6) AS tail FROM g""")
def quantile_conventions(spark, d):
    g = _s(spark, d).groupBy("stream_id").agg(F.collect_list("value").alias("v"))
    v = F.col("v")
    return g.select("stream_id", Q.upper_median(v).alias("upper"), Q.lower_median(v).alias("lower"), _r(Q.averaging_median(v)).alias("averaging"), Q.nearest_lower(v, 0.3).alias("p30"), _r(Q.linear(v, 0.95)).alias("p95"), _r(Q.tail_rms(v)).alias("tail"))


def _he(n: str, d: str) -> str:
    """SQL: n / d rounded half to even, for numbers from 0 on."""
    n, d = f"({n})", f"({d})"
    return f"({n} // {d} + CASE WHEN 2 * ({n} % {d}) > {d} OR (2 * ({n} % {d}) = {d} AND ({n} // {d}) % 2 = 1) THEN 1 ELSE 0 END)"


def _within(x: str, n: str, d: str) -> str:
    """SQL: x lies at n / d, exactly if that is whole and within 1 otherwise."""
    return f"abs(({x}) * ({d}) - ({n})) <= CASE WHEN ({n}) % ({d}) = 0 THEN 0 ELSE ({d}) END"


K1001 = "1001000000::HUGEINT"


@_query(f"""WITH {{S}}, f AS (SELECT stream_id * 5 + k AS stream_id, pos, CASE k WHEN 0 THEN pts WHEN 1 THEN pos * 40000 WHEN 2 THEN (pos * 200200 + 3) // 6 WHEN 3 THEN ((pos + pos // 7) * 200200 + 3) // 6 ELSE (pos + pos // 9) * 40000 END AS pts FROM s, range(0, 5) r(k)),
d AS (SELECT *, lead(pts) OVER (PARTITION BY stream_id ORDER BY pos) - pts AS d FROM f), c AS (SELECT stream_id, d::HUGEINT AS d, count(*) AS c FROM d WHERE d IS NOT NULL GROUP BY 1, 2),
m AS (SELECT stream_id, arg_min(d, (-c)::HUGEINT * 1000000000000000 + d) AS modal FROM c GROUP BY 1),
b AS (SELECT stream_id, count(*) AS n, min(pts) AS first_pts, (max(pts) - min(pts))::HUGEINT AS span, min(d)::HUGEINT AS lo, max(d)::HUGEINT AS hi, (count(*) - 1)::HUGEINT AS g FROM d GROUP BY 1),
u AS (SELECT *, lo > 0 AND abs(hi * g - span) <= g AND abs(lo * g - span) <= g AS even, CASE WHEN span > 0 THEN {_he(K1001 + ' * g', 'span')} END AS k FROM b),
v AS (SELECT *, CASE WHEN n = 1 OR NOT even THEN 0 WHEN lo = hi THEN 1 WHEN span < 4 * g THEN 0 WHEN k > 0 AND {_within('span', 'g * ' + K1001, 'nullif(k, 0)')} AND {_within('lo', K1001, 'nullif(k, 0)')} AND {_within('hi', K1001, 'nullif(k, 0)')} THEN 2 ELSE 1 END AS kind FROM u),
x AS (SELECT stream_id, lo, modal FROM v JOIN m USING (stream_id) WHERE kind = 0 AND lo > 0),
cand AS (SELECT stream_id, 1 AS o, modal AS a, 1::HUGEINT AS b FROM x UNION ALL SELECT stream_id, 2, {K1001}, {_he(K1001, 'modal')} FROM x UNION ALL SELECT stream_id, 3, lo, 1 FROM x UNION ALL SELECT stream_id, 4, {K1001}, {_he(K1001, 'lo')} FROM x),
t AS (SELECT stream_id, o, a, b, d, {_he('d * b', 'a')} AS mul FROM cand JOIN c USING (stream_id) WHERE b > 0),
g AS (SELECT stream_id, arg_min(a, o) AS a, arg_min(b, o) AS b FROM (SELECT stream_id, o, a, b FROM t GROUP BY ALL HAVING bool_and(mul >= 1 AND abs(d * b - mul * a) <= CASE WHEN (mul * a) % b = 0 THEN 0 ELSE b END) AND max(mul) > 1) GROUP BY 1),
r AS (SELECT stream_id, n, first_pts, span, CASE WHEN kind > 0 THEN 'uniform' WHEN a IS NOT NULL THEN 'gapped' ELSE 'variable' END AS verdict,
 (CASE kind WHEN 1 THEN span WHEN 2 THEN {K1001} ELSE a END)::BIGINT AS num, (CASE kind WHEN 1 THEN v.g WHEN 2 THEN k ELSE b END)::BIGINT AS den FROM v LEFT JOIN g USING (stream_id))
SELECT stream_id, n, first_pts::BIGINT AS first_pts, span::BIGINT AS span, verdict, num // gcd(num, den) AS num, den // gcd(num, den) AS den FROM r""")
def cadence_verdict(spark, d):
    pos, k = F.col("pos"), F.col("k")
    ntsc = lambda p: floor_div(p * 200200 + 3, F.lit(6))
    pts = F.when(k == 0, F.col("pts")).when(k == 1, pos * 40000).when(k == 2, ntsc(pos)).when(k == 3, ntsc(pos + F.floor(pos / 7))).otherwise((pos + F.floor(pos / 9)) * 40000)
    s = _s(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return M.cadence(s.select((F.col("stream_id") * 5 + k).alias("stream_id"), "pos", pts.cast("long").alias("pts")))


@_query(f"""WITH o AS (SELECT o_orderkey, 1000 + o_custkey % 997 * 50 AS total, o_orderkey * 7919 % 40000000 AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 104729 % 90000000 END AS z, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 1299 % 5000000 END AS cap FROM orders),
i AS (SELECT *, least({_he('a * 1000', '1000000')}, total) AS first, least(coalesce({_he('z * 1000', '1000000')}, total), total) AS z1, {_he('cap * 1000', '1000000')} AS c1 FROM o)
SELECT o_orderkey, first::BIGINT AS first, greatest(first, least(z1, coalesce(first + c1, z1)))::BIGINT AS stop FROM i""")
def sample_window(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(k, (1000 + F.col("o_custkey") % 997 * 50).alias("total"), (k * 7919 % 40000000).alias("a"), F.when(k % 5 > 0, k * 104729 % 90000000).alias("z"), F.when(k % 3 == 0, k * 1299 % 5000000).alias("cap"))
    first, stop = A.sample_window(F.col("total"), 1000, F.col("a"), F.col("z"), F.col("cap"))
    return o.select(k, first.alias("first"), stop.alias("stop"))


SEGMENTS_SQL = """p AS (SELECT stream_id, pos, pos * 100 + (CASE WHEN pos % 6 = 5 THEN 40 ELSE 0 END) AS start, pos * 100 + 100 AS stop FROM s)"""


def _segments(spark, d):
    pos = F.col("pos")
    return _s(spark, d).select("stream_id", "pos", (pos * 100 + F.when(pos % 6 == 5, 40).otherwise(0)).alias("start"), (pos * 100 + 100).alias("stop"))


@_query("WITH {S}, " + SEGMENTS_SQL + """, l AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY stream_id ORDER BY pos), 150) AS before FROM p),
u AS (SELECT stream_id, greatest(before, 150) AS start, least(start, 2075) AS stop, NULL::BIGINT AS pos FROM l UNION ALL SELECT stream_id, greatest(start, 150), least(stop, 2075), pos FROM l)
SELECT stream_id, start::BIGINT AS start, stop::BIGINT AS stop, pos FROM u WHERE start < stop""")
def silence_runs(spark, d):
    return A.fill_gaps(_segments(spark, d), F.lit(150), F.lit(2075))


@_query("WITH {S}, " + SEGMENTS_SQL + """ SELECT stream_id, pos, pos * 100 + (CASE WHEN pos % 6 = 5 THEN 40 ELSE 0 END) AS start, pos * 100 + 100 AS stop FROM p""")
def snapped_segments(spark, d):
    # starts are reported up to two samples off; a true gap is 40 samples wide
    off = F.when(F.col("pos") % 6 == 5, 0).otherwise(F.col("pos") % 5 - 2)
    s = _segments(spark, d).withColumn("length", F.col("stop") - F.col("start")).withColumn("start", F.when(F.col("pos") == 0, F.col("start")).otherwise(F.col("start") + off))
    return A.snap_segments(s, Fraction(2))


@_query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 AS t0, l_partkey % 500 + l_quantity::BIGINT * 5 AS t1, CASE WHEN l_linenumber % 2 = 0 THEN 60 END AS cap FROM lineitem),
y AS (SELECT *, greatest(0, 200 - t0) AS skip, greatest(0, t0 - 200) AS "offset", least(least(300, t1) - greatest(200, t0), CASE WHEN cap IS NULL THEN 1000000 ELSE greatest(0, cap - greatest(0, t0 - 200)) END) AS length FROM x)
SELECT l_orderkey, l_linenumber, skip::BIGINT AS skip, "offset"::BIGINT AS "offset", length::BIGINT AS length FROM y WHERE length > 0""")
def track_placement(spark, d):
    t0 = F.col("l_partkey") % 500
    met = A.place(t0, t0 + F.col("l_quantity").cast("long") * 5, F.lit(200), F.lit(300), F.when(F.col("l_linenumber") % 2 == 0, 60))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", met.alias("p")).where("p IS NOT NULL").select("l_orderkey", "l_linenumber", "p.*")


def _changes(spark, d):
    s = S.with_segments(_s(spark, d), S.jump(300))
    return s.withColumn("area", F.col("value") / 16000).withColumn("mean", F.col("value") / 4800).withColumn("is_sync", _sync())


GUARD_SQL = """SELECT q.stream_id, q.pos, q.area, q.mean, CASE WHEN new THEN 1.0 ELSE gain END AS g, CASE WHEN new THEN 0 ELSE streak END AS k, CASE WHEN NOT new THEN wait END AS w FROM e JOIN q ON q.stream_id = e.stream_id AND q.pos = e.pos + 1"""


@_query(f"""WITH RECURSIVE {{S}}, q AS (SELECT stream_id, pos, value / 16000 AS area, value / 4800 AS mean, coalesce(abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY pos)) > 300, false) OR pos = 0 AS new FROM s),
e AS (SELECT stream_id, -1::BIGINT AS pos, 1.0::DOUBLE AS gain, 0 AS streak, NULL::INT AS wait, '' AS state, 0.0::DOUBLE AS weight, false AS damped FROM q WHERE pos = 0 UNION ALL
 SELECT stream_id, pos, gain, streak, wait, state, CASE WHEN state IN ('open', 'tripped') THEN gain * gain * (3 - 2 * gain) ELSE 0.0 END, state = 'tripped' AND gain > 0 FROM (
 SELECT stream_id, pos, state, CASE state WHEN 'open' THEN least(1.0, g + 1.0 / 12) WHEN 'locked' THEN greatest(0.0, g - 1.0 / 3) ELSE CASE WHEN bad AND (mean > 0.1 OR area >= 0.04) THEN 0.0 ELSE greatest(0.0, g - 1.0 / 3) END END AS gain,
  CASE state WHEN 'open' THEN 0 WHEN 'locked' THEN k ELSE k + bad::INT END AS streak, CASE state WHEN 'open' THEN NULL WHEN 'locked' THEN w - 1 ELSE CASE WHEN w IS NOT NULL OR mean > 0.1 OR k + bad::INT >= 2 THEN 6 END END AS wait FROM (
 SELECT *, mean > 0.1 OR area >= 0.01 AS bad, CASE WHEN w IS NOT NULL AND w - 1 > 0 THEN 'locked' WHEN mean > 0.1 OR area >= 0.01 THEN 'tripped' WHEN w IS NOT NULL AND area > 0.005 THEN 'held' ELSE 'open' END AS state FROM ({GUARD_SQL}))))
SELECT stream_id, pos, state, round(weight, 6) AS weight, damped FROM e WHERE pos >= 0""")
def guard_states(spark, d):
    return G.output_guard(_changes(spark, d), G.Guard(lockout=6)).select("stream_id", "pos", "state", _r("weight").alias("weight"), "damped")


@_query("""WITH RECURSIVE {S}, q AS (SELECT stream_id, pos, event_type = 'purchase' AS y, coalesce(abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY pos)) > 300, false) OR pos = 0 AS new FROM s),
e AS (SELECT stream_id, -1::BIGINT AS pos, 0::BIGINT AS age, 0 AS seen, false AS made, false AS refreshed FROM q WHERE pos = 0 UNION ALL
 SELECT stream_id, pos, CASE WHEN now THEN 0 ELSE age + 1 END, seen, made OR now, now FROM (
 SELECT *, (age >= 64 OR (y AND age >= 12) OR NOT made) AND least(seen, 12) >= 6 AS now FROM (
 SELECT q.stream_id, q.pos, q.y, CASE WHEN new THEN 0 ELSE e.age END AS age, CASE WHEN new THEN 1 ELSE e.seen + 1 END AS seen, NOT new AND e.made AS made FROM e JOIN q ON q.stream_id = e.stream_id AND q.pos = e.pos + 1)))
SELECT stream_id, pos, refreshed, CASE WHEN made THEN age ELSE 0 END AS age FROM e WHERE pos >= 0""")
def sync_refresh(spark, d):
    return G.refresh_at_sync(_changes(spark, d))


@_query("""WITH RECURSIVE {S}, q AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY pos)) > 300, false) AS cut FROM s),
e AS (SELECT stream_id, pos, value AS blended FROM q WHERE pos = 0 UNION ALL SELECT q.stream_id, q.pos, CASE WHEN cut THEN value ELSE (value + 0.7 * exp(-pow((value - blended) / 80.0, 2)) * blended) / (1 + 0.7 * exp(-pow((value - blended) / 80.0, 2))) END FROM e JOIN q ON q.stream_id = e.stream_id AND q.pos = e.pos + 1)
SELECT stream_id, pos, round(blended, 5) AS blended FROM e""")
def recursive_blend(spark, d):
    return G.recursive_blend(_changes(spark, d), 0.7, 80.0).select("stream_id", "pos", _r("blended", 5).alias("blended"))


@_query("""WITH {S}, l AS (SELECT stream_id, pos, value / 500 AS v, lag(value) OVER w / 500 AS p, (lag(value) OVER w + value * 3) / 2000 AS a FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos))
SELECT stream_id, pos, round(greatest(0, least(1, (abs(v - p) - abs(v - a)) / 0.004)) * exp(-pow(abs(v - a) / 0.035, 2)), 6) AS gate FROM l WHERE p IS NOT NULL""")
def history_gate(spark, d):
    before = F.lag("value").over(S.by_stream())
    l = _s(spark, d).select("stream_id", "pos", (F.col("value") / 500).alias("v"), (before / 500).alias("p"), ((before + F.col("value") * 3) / 2000).alias("a")).where("p IS NOT NULL")
    return l.select("stream_id", "pos", _r(G.admission(F.col("v"), F.col("p"), F.col("a"))).alias("gate"))


@_query("""WITH t AS (SELECT p_partkey, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN round_even(p_partkey * 23.976, 0)::BIGINT WHEN 3 THEN round_even((p_partkey + 0.25) * 23.976, 0)::BIGINT
 WHEN 4 THEN round_even((p_partkey * 60 + 7.5) * 23.976, 0)::BIGINT END AS frames FROM t""")
def time_grammar(spark, d):
    n = F.col("p_partkey").cast("string")
    k = F.col("p_partkey") % 6
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("F"))).when(k == 2, F.concat(n, F.lit("s "))).when(k == 3, F.concat(n, F.lit(".25"))).when(k == 4, F.concat(n, F.lit(":07.5"))).otherwise(F.concat(n, F.lit(" minutes")))
    return _t(spark, d, "part").select("p_partkey", C.frames_column(text, 23.976).alias("frames"))


@_query("""WITH l AS (SELECT o_orderpriority AS grp, unnest(list_filter([CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'F' THEN 'done' END, CASE WHEN o_custkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS label FROM orders)
SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, label)::INT AS place FROM (SELECT grp, label, count(*) AS n FROM l GROUP BY 1, 2)""")
def label_ranking(spark, d):
    found = E.labels(("large", F.col("o_totalprice") > 200000), ("done", F.col("o_orderstatus") == "F"), ("even", F.col("o_custkey") % 2 == 0))
    return E.label_counts(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), found.alias("labels")), ["grp"], "labels")


@_query("""SELECT user_id, CASE max(CASE WHEN value > 450 THEN 3 WHEN value > 300 THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS risk FROM events WHERE event_type <> 'view' GROUP BY 1""")
def risk_summary(spark, d):
    v = F.col("value")
    e = _t(spark, d, "events").where("event_type <> 'view'").withColumn("risk", F.when(v > 450, "high").when(v > 300, "medium").otherwise("low"))
    return e.groupBy("user_id").agg(E.worst_of(["low", "medium", "high"], "risk").alias("risk"))


@_query("""WITH {S}, x AS (SELECT a.stream_id, abs(a.value - b.value) / 500 AS d FROM s a JOIN s b ON b.stream_id = a.stream_id + 1 AND b.pos = a.pos)
SELECT stream_id, count(*) AS n, round(avg(d), 6) AS mean_abs, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS worst, round(CASE WHEN avg(d * d) <= 0 THEN 99 ELSE -10 * log10(avg(d * d)) END, 6) AS psnr FROM x GROUP BY 1""")
def clean_comparison(spark, d):
    s = _s(spark, d).withColumn("value", F.col("value") / 500)
    both = E.zipped(s, s.withColumn("stream_id", F.col("stream_id") - 1), "value")
    out = E.clean_comparison(both, ["stream_id"], "value", "other")
    return out.select("stream_id", "n", *(_r(c).alias(c) for c in ("mean_abs", "p95", "worst", "psnr")))


@_query("""WITH {S} SELECT a.stream_id, a.pos, b.pos AS later, round(abs(a.value - b.value), 6) AS distance FROM s a JOIN s b ON a.stream_id = b.stream_id AND b.pos > a.pos AND b.pos <= a.pos + 3""")
def nearby_pairs(spark, d):
    return E.nearby_pairs(_s(spark, d), 3).select("stream_id", "pos", "later", _r(F.abs(F.col("value") - F.col("later_value"))).alias("distance"))


@_query("""WITH t AS (SELECT l_suppkey, l_linenumber, CASE WHEN count(*) >= 20 THEN round(avg(l_tax), 6) END AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT l_suppkey, CASE WHEN count(*) >= 100 THEN round(avg(l_tax), 6) END AS overall FROM lineitem GROUP BY 1)
SELECT l_suppkey, l_linenumber, v, round(count(v) OVER (PARTITION BY l_suppkey) / count(*) OVER (PARTITION BY l_suppkey), 6) AS coverage, coalesce(v, overall, 0.5) AS filled FROM t LEFT JOIN w USING (l_suppkey)""")
def tile_fill(spark, d):
    li = _t(spark, d, "lineitem")
    mean = lambda n: F.when(F.count(F.lit(1)) >= n, _r(F.avg("l_tax")))
    tiles, whole = li.groupBy("l_suppkey", "l_linenumber").agg(mean(20).alias("v")), li.groupBy("l_suppkey").agg(mean(100).alias("overall"))
    return E.filled_tiles(tiles, ["l_suppkey"], "v", whole, 0.5).withColumn("coverage", _r("coverage"))


@_query(f"""WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, unnest(CASE WHEN n <= 24 THEN [0::BIGINT] ELSE list_distinct(list_transform(range(0, 8), lambda i: {_he('i * (n - 3)', '7')}::BIGINT)) END) AS start FROM t""")
def spread_runs(spark, d):
    t = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("user_id", F.explode(E.spread_runs(F.col("n"), 24)).alias("start"))


@_query("""WITH {S}, l AS (SELECT stream_id, value - lag(value, 1) OVER w AS a, value - lag(value, 2) OVER w AS b FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos))
SELECT stream_id, round(sqrt(avg(b * b)) / (sqrt(avg(a * a)) + 1e-9), 6) AS lag2_over_lag1 FROM l GROUP BY 1""")
def flicker_persistence(spark, d):
    return E.persistence(_s(spark, d)).withColumn("lag2_over_lag1", _r("lag2_over_lag1"))


@_query(f"""WITH {{S}}, t AS (SELECT stream_id, pos, pts - {AT} AS pts, coalesce(lead(pts) OVER (PARTITION BY stream_id ORDER BY pos) - pts, {HOUR}) AS duration FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS n, lead(pts) OVER (PARTITION BY stream_id ORDER BY pos) AS nxt FROM t WHERE pts >= 0)
SELECT stream_id, pos, pts, (CASE WHEN nxt IS NULL OR n = 20 THEN greatest(1, least({100 * HOUR}, pts + duration) - pts) ELSE duration END)::BIGINT AS duration FROM k WHERE n <= 20""")
def outgoing_rows(spark, d):
    s = _s(spark, d).withColumn("duration", F.coalesce(F.lead("pts").over(S.by_stream()) - F.col("pts"), F.lit(HOUR)))
    return M.outgoing(s.withColumn("pts", F.col("pts") - AT), 100 * HOUR, 20).select("stream_id", "pos", "pts", "duration")


# --- Spark's own relational operators over the driver tables (no counterpart to match) ---


@_query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def rel_pricing(spark, d):
    li = _t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(_r(F.sum("l_quantity"), 2).alias("sum_qty"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), _r(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@_query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ROLLUP (r_name, n_name)""")
def rel_rollup(spark, d):
    t = lambda n: _t(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count_distinct("c_custkey").alias("customers"), _r(F.sum("o_totalprice"), 2).alias("total"))


@_query("""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def rel_semi_anti(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    on = F.col("o_custkey") == F.col("c_custkey")
    return c.join(o.where("o_orderstatus = 'F'"), on, "left_semi").join(o.where("o_totalprice > 400000"), on, "left_anti").select("c_custkey", "c_mktsegment")


@_query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events), k AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, min(t)::BIGINT AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, k""")
def rel_sessions(spark, d):
    e = _t(spark, d, "events").withColumn("t", F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)"))
    return e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.min(F.unix_micros("t")).alias("start_us"), F.count(F.lit(1)).alias("n"), _r(F.sum("value"), 4).alias("total")).drop("session_window")


@_query("""SELECT * FROM (SELECT p_brand, p_partkey, round(sum(l_extendedprice), 2) AS revenue, row_number() OVER (PARTITION BY p_brand ORDER BY sum(l_extendedprice) DESC, p_partkey) AS place FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2) WHERE place <= 3""")
def rel_top_parts(spark, d):
    g = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_partkey").agg(F.sum("l_extendedprice").alias("r"))
    w = W.partitionBy("p_brand").orderBy(F.desc("r"), "p_partkey")
    return g.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("p_brand", "p_partkey", _r("r", 2).alias("revenue"), "place")


@_query("""(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0""")
def rel_set_operations(spark, d):
    c, s = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select("s_nationkey")
    return c.intersect(s).subtract(_t(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


from loomtick.plans import analysis_queries as _analysis_queries  # noqa: E402, F401  its queries register themselves here
