"""Registered queries of selection, reports, levels and noise; ``registry`` takes them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtick.operators import colour as K
from loomtick.operators import levels as L
from loomtick.operators import noise as N
from loomtick.operators import report as P
from loomtick.operators import selection as C
from loomtick.operators import streams as S
from loomtick.operators import temporal as T
from loomtick.operators import timing as M
from loomtick.plans.registry import HOUR, _cut, _he, _query, _r, _s, _sync, _t


def _frames(spark, d):
    """``embeddings`` as frames of 8 x 8 samples, a stream for each label."""
    w = S.W.partitionBy("label").orderBy("vec_id")
    pixels = F.transform("embedding", lambda v: F.least(F.greatest(v.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)))
    return _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))


FRAMES_SQL = """f AS (SELECT label::BIGINT AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda v: least(greatest(v::DOUBLE + 0.5, 0.0), 1.0)) AS px FROM embeddings)"""


@_query("WITH {S} SELECT stream_id, pos, value FROM s WHERE pos >= 3 AND (pos - 3) % 7 = 0")
def strided_rows(spark, d):
    return C.strided(_s(spark, d), 7, 3).select("stream_id", "pos", "value")


@_query("""WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), o AS (SELECT user_id, n, i, CASE WHEN n > 39 THEN floor(i * ((n - 39) / 3) + (n - 39) / 3 / 2)::BIGINT ELSE 0 END AS o FROM t, range(0, 3) r(i))
SELECT user_id, i::INT AS clip, k::INT AS k, ((o + k * 10) % n)::BIGINT AS position FROM o, range(0, 4) q(k)""")
def clip_positions(spark, d):
    t = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    clips = t.select("user_id", F.posexplode(C.clip_positions(F.col("n"), 4, 3, 10)).alias("clip", "p"))
    return clips.select("user_id", "clip", F.posexplode("p").alias("k", "position"))


@_query("""WITH {S}, z AS (SELECT *, max(CASE WHEN event_type = 'purchase' AND pos <= 12 THEN pos END) OVER w AS first, max(CASE WHEN pos = 12 THEN pts END) OVER w AS zero FROM s WINDOW w AS (PARTITION BY stream_id))
SELECT stream_id, pos, (pts - zero)::BIGINT AS pts FROM z WHERE pos >= coalesce(first, 12) AND zero IS NOT NULL""")
def context_rows(spark, d):
    return C.with_context(_s(spark, d), _sync(), F.lit(12).cast("long")).select("stream_id", "pos", "pts")


@_query(f"""WITH {{S}}, o AS (SELECT *, min(pts) OVER (PARTITION BY stream_id) AS origin FROM s)
SELECT stream_id, pos, {_he("(pts - origin)::HUGEINT * 24", "1001000000")}::BIGINT AS number FROM o""")
def display_numbers(spark, d):
    s = _s(spark, d).withColumn("origin", F.min("pts").over(S.W.partitionBy("stream_id")))
    return s.select("stream_id", "pos", C.display_index(F.col("pts"), F.col("origin"), (24, 1001)).cast("long").alias("number"))


@_query("""WITH d AS (SELECT l_suppkey AS stream_id, list(DISTINCT (l_linenumber * (1 + l_partkey % 3) * CASE WHEN l_suppkey % 4 = 0 THEN 1000003 ELSE 100 END)::HUGEINT) AS x FROM lineitem GROUP BY 1),
l AS (SELECT stream_id, list_reduce(x, lambda a, b: lcm(a, b)) AS own FROM d)
SELECT stream_id, (CASE WHEN lcm(own, 600::HUGEINT) <= 2147483647 THEN lcm(own, 600::HUGEINT) WHEN own <= 2147483647 THEN own END)::BIGINT AS base FROM l""")
def time_bases(spark, d):
    den = F.col("l_linenumber") * (1 + F.col("l_partkey") % 3) * F.when(F.col("l_suppkey") % 4 == 0, 1000003).otherwise(100)
    return C.time_base(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("stream_id"), den.cast("long").alias("den")), "den")


@_query("""WITH e AS (SELECT vec_id, unnest([0, 2, 4, 6, 16, 18, 20, 22, 32, 34, 36, 38, 48, 50, 52, 54]) AS i, unnest(range(0, 16)) AS place, embedding FROM embeddings) SELECT vec_id, place::INT AS place, embedding[i + 1] AS sample FROM e""")
def thumbnails(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode(C.thumbnail(F.col("embedding"), 8, 8, 4)).alias("place", "sample"))


@_query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'bt2020' END, CASE WHEN p_partkey % 2 = 0 THEN 'smpte170m' END, 'bt709') AS primaries, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'pq' END, 'bt709') AS transfer,
 coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'bt601' END, 'bt709') AS matrix, coalesce(CASE WHEN p_partkey % 7 < 3 THEN p_partkey % 7 = 1 END, false) AS "full" FROM part""")
def resolved_colours(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    tags = {"tag_primaries": F.when(k % 3 == 0, "bt2020"), "guess_primaries": F.when(k % 2 == 0, "smpte170m"), "tag_transfer": F.when(k % 5 == 0, "pq"), "guess_transfer": none, "tag_matrix": none, "guess_matrix": F.when(k % 2 == 0, "bt601"), "tag_full": F.when(k % 7 < 3, k % 7 == 1)}
    return C.resolved_colour(_t(spark, d, "part").withColumns(tags)).select("p_partkey", "primaries", "transfer", "matrix", "full")


@_query("""SELECT n_name, v.variant, v.window, v.strength FROM nation, (VALUES ('plain', 0, NULL::DOUBLE), ('strong', 4, 1.0)) v(variant, "window", strength)""")
def variant_rows(spark, d):
    table = [{"variant": "plain", "window": 0, "strength": None}, {"variant": "strong", "window": 4, "strength": 1.0}]
    out = C.variants(_t(spark, d, "nation").select("n_name"), table)
    return out.withColumn("strength", F.col("strength").cast("double"))


@_query("""WITH {S}, o AS (SELECT stream_id, pos // 3 AS pts, arg_max(value, pos) AS v FROM s GROUP BY 1, 2), n AS (SELECT stream_id, pos, pos // 2 AS pts, row_number() OVER (PARTITION BY stream_id, pos // 2 ORDER BY pos) AS n FROM s)
SELECT n.stream_id, n.pos, n.pts, CASE WHEN n.n = 1 THEN o.v END AS original_value FROM n LEFT JOIN o ON o.stream_id = n.stream_id AND o.pts = n.pts""")
def taken_rows(spark, d):
    s = _s(spark, d)
    outputs = s.select("stream_id", "pos", F.floor(F.col("pos") / 2).alias("pts"))
    return C.taken(outputs, s.select("stream_id", "pos", F.floor(F.col("pos") / 3).alias("pts"), "value"), ["value"])


@_query("""WITH {S}, v AS (SELECT * FROM s WHERE event_type = 'view'), p AS (SELECT *, CASE WHEN pos % 2 = 0 THEN pos - 1 END AS source_index FROM s WHERE event_type = 'purchase')
SELECT p.stream_id, p.pos, p.pts, p.source_index, CASE WHEN p.source_index IS NOT NULL THEN x.value ELSE v.value END AS source_value FROM p ASOF LEFT JOIN v ON p.stream_id = v.stream_id AND p.pts >= v.pts LEFT JOIN v x ON x.stream_id = p.stream_id AND x.pos = p.source_index""")
def compared_rows(spark, d):
    s = _s(spark, d).select("stream_id", "pos", "pts", "value", "event_type")
    outputs = s.where("event_type = 'purchase'").select("stream_id", "pos", "pts", F.when(F.col("pos") % 2 == 0, F.col("pos") - 1).alias("source_index"))
    return C.compared(outputs, s.where("event_type = 'view'"), ["value"])


@_query("""WITH {S}, t AS (SELECT stream_id, pos, lead(pts) OVER (PARTITION BY stream_id ORDER BY pos) - pts AS d, pts, CASE WHEN stream_id % 3 = 0 THEN 7 END AS own FROM s WHERE stream_id % 5 > 0 OR pos = 0),
g AS (SELECT stream_id, arg_max(coalesce(own, -1), pos) AS own, list_sort(list(d) FILTER (d > 0)) AS ds, max(pts) - min(pts) AS span, count(*) AS n FROM t GROUP BY 1)
SELECT stream_id, coalesce(nullif(own, -1), ds[len(ds) // 2 + 1], CASE WHEN span > 0 THEN floor(span / n) END, 40000)::BIGINT AS tail FROM g""")
def tail_durations(spark, d):
    s = _s(spark, d).where("stream_id % 5 > 0 OR pos = 0")
    return C.tail_duration(s.withColumn("duration", F.when(F.col("stream_id") % 3 == 0, F.lit(7).cast("long"))))


@_query("""WITH {S}, o AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY stream_id ORDER BY pos) AS gop FROM s), n AS (SELECT stream_id, pos, value, row_number() OVER (PARTITION BY stream_id, gop ORDER BY pos) - 1 AS since FROM o)
SELECT stream_id, pos, CASE WHEN since > 3 AND value / 200 > 1 THEN 1.0 ELSE value / 200 END AS gain FROM n""")
def zoned_gain(spark, d):
    rows = _s(spark, d).withColumn("gop", F.sum(_sync().cast("int")).over(S.by_stream().rowsBetween(S.W.unboundedPreceding, 0)))
    since = F.row_number().over(S.W.partitionBy("stream_id", "gop").orderBy("pos")) - 1
    return rows.withColumn("since", since).select("stream_id", "pos", C.pulse_zone(F.col("value") / 200, F.col("since")).alias("gain"))


_SLOTS_SQL = f"""t AS (SELECT *, pts - first_value(pts) OVER w AS t FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY pos)), n AS (SELECT *, lead(t) OVER (PARTITION BY stream_id ORDER BY pos) AS nxt FROM t),
u AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN (t + nxt) // {2 * HOUR} ELSE (2 * t + {HOUR}) // {2 * HOUR} END AS up FROM n), l AS (SELECT *, coalesce(max(up) OVER (PARTITION BY stream_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS lo FROM u),
x AS (SELECT stream_id, pos, greatest(0, up - lo + 1) AS slots, abs(lo * {HOUR} - t) AS a, abs(up * {HOUR} - t) AS b FROM l)"""


@_query("WITH {S}, " + _SLOTS_SQL + """ SELECT stream_id, count(*) AS received, sum(slots)::BIGINT AS emitted, (sum(slots) - count(*) FILTER (slots > 0))::BIGINT AS duplicated, count(*) FILTER (slots = 0) AS dropped, max(greatest(a, b)) FILTER (slots > 0)::BIGINT AS max_shift FROM x GROUP BY 1""")
def conform_ledger(spark, d):
    s = _s(spark, d)
    return P.conform_ledger(s, M.conform(s, HOUR))


@_query("""WITH {S}, g AS (SELECT stream_id, list_sort(list(abs(value - 250) / 500)) AS v FROM s GROUP BY 1)
SELECT stream_id, len(v) AS n, round(list_avg(v), 6) AS mean_shift, round(v[floor(0.95 * (len(v) - 1))::INT + 1], 6) AS p95_shift, len(list_filter(v, lambda x: x > 0.2)) AS corrected FROM g""")
def level_ledger(spark, d):
    out = P.level_ledger(_s(spark, d).withColumn("shift", (F.col("value") - 250) / 500), 0.2)
    return out.select("stream_id", "n", _r("mean_shift").alias("mean_shift"), _r("p95_shift").alias("p95_shift"), "corrected")


@_query("""WITH {S} SELECT stream_id, round(avg(CASE WHEN value > 300 THEN 1.0 ELSE 0.0 END), 6) AS fired, round(avg(abs(least(value, 300) - value)), 6) AS applied FROM s GROUP BY 1""")
def deflicker_ledger(spark, d):
    out = P.deflicker_ledger(_s(spark, d).withColumn("fixed", F.least("value", F.lit(300.0))))
    return out.select("stream_id", _r("fired").alias("fired"), _r("applied").alias("applied"))


@_query("WITH {S}, {CUTS} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos)::INT AS n, pos AS source_index FROM x WHERE cut")
def cut_log(spark, d):
    return P.cut_log(_cut(spark, d))


@_query("WITH " + FRAMES_SQL + """, b AS (SELECT *, lag(px) OVER (PARTITION BY stream_id ORDER BY pos) AS before FROM f), i AS (SELECT stream_id, px, before, unnest(range(0, 64)) AS i FROM b),
v AS (SELECT stream_id, i // 8 AS y, i % 8 AS x, px[i + 1] AS now, abs(px[i + 1] - before[i + 1]) AS d FROM i),
k AS (SELECT *, unnest(list_filter([CASE WHEN y < 2 THEN 'top' END, CASE WHEN y >= 6 THEN 'bottom' END, CASE WHEN x < 1 THEN 'left' END, CASE WHEN x >= 7 THEN 'right' END, CASE WHEN y IN (3, 4) THEN 'center_y' END, CASE WHEN x = 4 THEN 'center_x' END, CASE WHEN y IN (3, 4) AND x = 4 THEN 'center' END], lambda b: b IS NOT NULL)) AS band FROM v)
SELECT stream_id, band, round(avg(now), 6) AS mean, round(stddev_pop(now), 6) AS std, round(avg(d), 6) AS change FROM k GROUP BY 1, 2""")
def band_metrics(spark, d):
    out = P.band_metrics(_frames(spark, d), 8, 8, 25, 12.5)
    return out.select("stream_id", "band", *(_r(c).alias(c) for c in ("mean", "std", "change")))


@_query("""WITH {S} SELECT stream_id, pos % 9 AS track, count(*) AS frames, min(pos) AS first, max(pos) AS last, round(avg(value), 6) AS mean_score, round(avg((value + 1) * 2), 6) AS mean_area FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def track_lengths(spark, d):
    s = _s(spark, d).select("stream_id", (F.col("pos") % 9).alias("track"), F.col("pos").alias("frame"), F.col("value").alias("score"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("y0"), (F.col("value") + 1).alias("x1"), F.lit(3.0).alias("y1"))
    return P.track_summary(s, 3).withColumn("mean_score", _r("mean_score")).withColumn("mean_area", _r("mean_area"))


@_query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal / 2 END) DESC NULLS LAST, c_custkey)::INT AS place FROM customer""")
def report_places(spark, d):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    c = _t(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(k % 3 == 0, v).alias("a"), F.when(k % 3 == 1, v / 2).alias("b"))
    return P.report_order(c, ["c_nationkey"], ["a", "b"]).select("c_nationkey", "c_custkey", "place")


_BINS = 16
_Q = f"(j + 0.5) / {_BINS}"
_K = f"least({_BINS - 1}, len(list_filter(cdf, lambda c: c < {_Q})))"
_LEFT = f"CASE WHEN {_K} > 0 THEN cdf[{_K}] ELSE 0 END"


@_query("WITH " + FRAMES_SQL + f""", p AS (SELECT *, list_transform(range(0, {_BINS}), lambda k: len(list_filter(px, lambda x: least({_BINS - 1}, floor(x * {_BINS})) = k)) / 64) AS pmf FROM f),
c AS (SELECT *, list_transform(range(1, {_BINS + 1}), lambda i: list_sum(pmf[1:i])) AS cdf, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS r, count(*) OVER (PARTITION BY stream_id) AS n FROM p),
q AS (SELECT *, list_transform(range(0, {_BINS}), lambda j: greatest(0, least({_BINS - 1}, {_K} - 0.5 + CASE WHEN cdf[{_K} + 1] - {_LEFT} > 1e-9 THEN ({_Q} - {_LEFT}) / (cdf[{_K} + 1] - {_LEFT}) ELSE 0 END))) AS qf FROM c),
w AS (SELECT a.stream_id, a.pos, a.px, a.pmf, a.cdf, a.qf, list(b.qf) AS w FROM q a JOIN q b ON a.stream_id = b.stream_id AND abs(a.r - b.r) <= least(2, a.r - 1, a.n - a.r) GROUP BY ALL),
m AS (SELECT *, list_transform(range(1, {_BINS + 1}), lambda i: list_avg(list_transform(w, lambda x: x[i]))) AS ref FROM w),
s AS (SELECT *, list_avg(list_transform(range(1, {_BINS + 1}), lambda i: ref[i] - qf[i])) / {_BINS - 1} AS shift, list_transform(range(1, {_BINS + 1}), lambda i: greatest(0, least({_BINS - 1}, (cdf[i] - pmf[i] / 2) * {_BINS} - 0.5))) AS spot FROM m),
l AS (SELECT *, list_transform(spot, lambda a: (ref[floor(a)::INT + 1] * (1 - (a - floor(a))) + ref[least({_BINS - 1}, floor(a)::INT + 1) + 1] * (a - floor(a))) / {_BINS - 1}) AS lut FROM s),
o AS (SELECT stream_id, pos, shift, CASE WHEN abs(shift) > 0.003 THEN list_transform(px, lambda x: least(1, greatest(0, x * greatest(0.5, least(2.0, (lut[floor(x * {_BINS - 1})::INT + 1] * (1 - (x * {_BINS - 1} - floor(x * {_BINS - 1}))) + lut[least({_BINS - 1}, floor(x * {_BINS - 1})::INT + 1) + 1] * (x * {_BINS - 1} - floor(x * {_BINS - 1}))) / greatest(x, 1e-4)))))) ELSE px END AS out FROM l)
SELECT stream_id, pos, round(shift, 6) + 0.0 AS shift, abs(shift) > 0.003 AS corrected, round(list_avg(out), 6) AS mean, round(list_max(out), 6) AS top FROM o""")
def levelled_frames(spark, d):
    out = L.level_frames(_frames(spark, d), 2, 0.003, _BINS)
    mean = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return out.select("stream_id", "pos", (_r("shift") + 0.0).alias("shift"), "corrected", _r(mean).alias("mean"), _r(F.array_max("pixels")).alias("top"))


@_query("WITH " + FRAMES_SQL + """, b AS (SELECT stream_id, pos // 13 AS w, pos, px, lag(px) OVER (PARTITION BY stream_id, pos // 13 ORDER BY pos) AS before, count(*) OVER (PARTITION BY stream_id, pos // 13) AS n FROM f),
e AS (SELECT stream_id, w, pos, unnest(list_transform(range(1, 65), lambda i: abs(px[i] - before[i]) / sqrt(2))) AS v FROM b WHERE before IS NOT NULL AND n >= 3),
g AS (SELECT stream_id, w, list_sort(list(v)) AS v FROM e GROUP BY 1, 2), t AS (SELECT stream_id, w, max(r) AS top FROM (SELECT stream_id, w, pos, sqrt(avg(v * v)) AS r FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2), k AS (SELECT 1 / sqrt(0.299 * 0.299 + 0.587 * 0.587 + 0.114 * 0.114) AS k)
SELECT g.stream_id, g.w::BIGINT AS "window", round(v[floor(0.5 * (len(v) - 1))::INT + 1] * k / 0.6745, 6) AS q50_med, round(v[floor(0.9 * (len(v) - 1))::INT + 1] * k / 1.6449, 6) AS q90_med, round(sqrt(list_avg(list_transform(v, lambda x: x * x))) * k, 6) AS rms_med,
 round(v[len(v)] * k, 6) AS max_med, round(len(list_filter(v, lambda x: x > 2 / 255)) / len(v), 6) AS density_med, round(top * k, 6) AS trace_max,
 round(sqrt(list_avg(list_transform(v[len(v) - greatest(1, round_even(0.05 * len(v), 0)::INT) + 1:], lambda x: x * x))) * k / 2.3616, 6) AS tail5_med FROM g JOIN t USING (stream_id, w), k""")
def noise_battery(spark, d):
    names = ["q50_med", "q90_med", "rms_med", "max_med", "density_med", "trace_max", "tail5_med"]
    out = N.windows(_frames(spark, d), names, lambda w: N.battery(w, block=8))
    return out.select("stream_id", "window", *(_r(n).alias(n) for n in names))


#: Ranges of made-up measures: every rule holds for some parts.
_RANGES = {"density_med": 1, "density_p90": 1, "amplitude_p90": 0.2, "tail5_med": 0.15, "tail5_p90": 0.15, "rms_p90": 0.05, "lag2_over_lag1": 2, "edge_over_flat": 4, "static_fraction": 0.2, "static_hf": 0.02, "flat_sigma": 0.15, "flat_lag21": 2, "flat_thr": 0.09, "mc_sigma": 0.15, "mc_lag21": 2, "row_interlace": 6, "static_row_period": 8, "static_row_strength": 0.8, "static_grain": 0.02, "row_coherence": 0.1, "row_periodicity": 0.8, "trace_med": 0.05, "trace_max": 0.1}
_MADE = ", ".join(f"(p_partkey * {7919 + 2 * i} + {i * 37}) % 997 / 997 * {r} AS {n}" for i, (n, r) in enumerate(_RANGES.items()))


@_query(f"""WITH m AS (SELECT p_partkey, {_MADE} FROM part),
t AS (SELECT *, static_fraction <= 0.06 AND density_p90 >= 0.55 AND tail5_p90 >= 0.045 AS dense, mc_sigma > 0 AND mc_sigma <= 0.12 AS mct, flat_thr <= 0.045 AND flat_sigma <= 0.12 AS ft, lag2_over_lag1 >= 1.35 AND density_p90 >= 0.25 AS moving FROM m),
u AS (SELECT *, (mct AND mc_sigma >= 0.03 AND mc_lag21 <= 1.35) OR (ft AND flat_sigma >= 0.03 AND flat_lag21 <= 1.3) AS sensor, mct AND mc_sigma < 0.02 AND mc_lag21 <= 1.35 AS low,
 edge_over_flat < 1.8 AND lag2_over_lag1 <= 1.3 AND (NOT ft OR flat_sigma < 0.02 OR flat_lag21 > 1.3) AND (NOT mct OR mc_sigma < 0.02 OR mc_lag21 > 1.35) AS unsure FROM t),
r AS (SELECT p_partkey, [tail5_p90 < 0.012 AND density_p90 < 0.1, (static_grain >= 0.015 AND static_fraction >= 0.1) OR (static_fraction >= 0.15 AND static_hf >= 0.006 AND density_p90 < 0.25), row_interlace >= 4 AND density_p90 >= 0.1, static_row_strength >= 0.6 AND static_row_period >= 2,
 edge_over_flat >= 2.5 AND density_p90 < 0.45 AND amplitude_p90 >= 0.012, row_periodicity >= 0.5 AND row_coherence >= 0.05 AND density_p90 >= 0.05 AND amplitude_p90 >= 0.012, trace_med > 0 AND trace_max >= greatest(0.03, 1.55 * trace_med), moving,
 moving AND static_fraction <= 0.15 AND density_med >= 0.55 AND tail5_med >= 0.08, dense, dense AND sensor, dense AND NOT sensor AND low, dense AND NOT sensor AND NOT low AND unsure, dense AND NOT sensor AND NOT low AND NOT unsure AND lag2_over_lag1 <= 1.35, amplitude_p90 > greatest(0.08, 2.5 * greatest(rms_p90, 1e-6)) AND density_p90 < 0.35] AS h FROM u),
x AS (SELECT p_partkey, h, len(list_filter([2, 3, 4, 5, 6, 8, 9, 13, 14], lambda i: h[i])) AS n_warnings, list_transform(list_filter(range(1, 16), lambda i: h[i] AND i <> 14), lambda i: ['low temporal noise', 'static/structured grain', 'interlace/field residue', 'static row banding', 'sparse edge flicker', 'row-coherent scanline flicker', 'pulsed temporal noise', 'motion-like temporal change',
 'source-wide motion contamination', 'dense temporal change', 'dense sensor noise', 'dense motion, low noise floor', 'motion/noise ambiguous', '', 'sparse flashes'][i]) AS l FROM r)
SELECT p_partkey, CASE WHEN len(l) = 0 THEN 'mixed/low-confidence' ELSE array_to_string(l, '; ') END AS labels, n_warnings::INT AS n_warnings, CASE WHEN h[13] OR h[9] THEN 'high' WHEN n_warnings > 0 THEN 'medium' ELSE 'low' END AS risk FROM x""")
def noise_classes(spark, d):
    k = F.col("p_partkey")
    made = {n: (k * (7919 + 2 * i) + i * 37) % 997 / 997 * r for i, (n, r) in enumerate(_RANGES.items())}
    out = N.classified(_t(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in made.items())))
    return out.select("p_partkey", F.array_join("labels", "; ").alias("labels"), "n_warnings", "risk")


@_query(f"""WITH {{S}}, {{CUTS}}, t AS (SELECT *, pts - first_value(pts) OVER (PARTITION BY stream_id ORDER BY pos) AS t FROM x),
n AS (SELECT *, lead(t) OVER (PARTITION BY stream_id ORDER BY pos) AS t1, lead(value) OVER (PARTITION BY stream_id, segment_id ORDER BY pos) AS v2 FROM t), e AS (SELECT *, CASE WHEN t1 IS NULL THEN t + {20 * HOUR} END AS fin, coalesce(t1, t + {20 * HOUR}) AS t2 FROM n),
h AS (SELECT *, unnest(range(((t + {6 * HOUR - 1}) // {6 * HOUR})::BIGINT, ((t2 + {6 * HOUR - 1}) // {6 * HOUR})::BIGINT)) AS slot FROM e WHERE t2 > t), p AS (SELECT *, CASE WHEN v2 IS NULL THEN 0 ELSE (slot * {6 * HOUR} - t) / (t2 - t) END AS phase FROM h)
SELECT stream_id, slot, round(phase, 6) AS phase, round(value + (coalesce(v2, value) - value) * phase, 6) AS value, least({6 * HOUR}, coalesce(fin, 1::BIGINT << 62) - slot * {6 * HOUR})::BIGINT AS duration FROM p""")
def interpolate_cuts(spark, d):
    out = M.interpolate(_cut(spark, d), 6 * HOUR, 20 * HOUR)
    return out.select("stream_id", "slot", _r("phase").alias("phase"), _r("value").alias("value"), "duration")


@_query("WITH " + FRAMES_SQL + """, i AS (SELECT stream_id, pos, unnest(px) AS a, unnest(list_transform(range(1, 65), lambda i: px[i] * 0.9 + (i % 3) * 0.01)) AS b FROM f),
g AS (SELECT stream_id, pos, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c, avg(abs(b - a)) AS mae FROM i GROUP BY 1, 2)
SELECT stream_id, pos, round((2 * ma * mb + 1e-4) * (2 * c + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4)), 6) AS ssim, round(c / sqrt(va * vb), 6) AS corr, round(mae, 6) AS mae FROM g""")
def crop_similarity(spark, d):
    f = _frames(spark, d).withColumn("other", F.transform("pixels", lambda v, i: v * 0.9 + ((i + 1) % 3) * 0.01))
    return K.similarity(f, ["stream_id", "pos"], "pixels", "other").select("stream_id", "pos", *(_r(c).alias(c) for c in ("ssim", "corr", "mae")))


_CROP = {"chroma_hf_ratio": (0.7, 0.6), "temporal_hf_diff_ratio": (0.5, 0.9), "row_score_ratio": (0.6, 0.8), "hf_luma_ratio": (0.8, 0.4), "grad_ratio": (0.9, 0.15), "ssim_luma": (0.95, 0.05), "grad_corr": (0.96, 0.04), "mae_luma": (0, 0.012), "chroma_drift": (0, 0.012)}
_CROP_SQL = ", ".join(f"{a} + (p_partkey * {101 + 2 * i}) % 211 / 211 * {r} AS {n}" for i, (n, (a, r)) in enumerate(_CROP.items()))


@_query(f"""WITH c AS (SELECT p_partkey, {_CROP_SQL} FROM part)
SELECT p_partkey, round(100 * (0.28 * (1 - chroma_hf_ratio) + 0.24 * (1 - temporal_hf_diff_ratio) + 0.20 * (1 - row_score_ratio) + 0.12 * (1 - hf_luma_ratio) - 2.0 * greatest(0, 0.970 - grad_ratio) - 2.2 * greatest(0, 0.988 - ssim_luma)
 - 0.7 * greatest(0, 0.988 - grad_corr) - 8 * greatest(0, mae_luma - 0.006) - 8 * greatest(0, chroma_drift - 0.006)), 6) AS score FROM c""")
def crop_scores(spark, d):
    made = {n: a + (F.col("p_partkey") * (101 + 2 * i)) % 211 / 211 * r for i, (n, (a, r)) in enumerate(_CROP.items())}
    return _t(spark, d, "part").withColumns(made).select("p_partkey", _r(K.crop_score()).alias("score"))
