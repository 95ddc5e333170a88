"""Queries by name, each an operator of the library on the driver's tables, with DuckDB SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetrace.functions import columns as C
from kinetrace.functions import kernels as N
from kinetrace.operators import evaluation as E
from kinetrace.operators import features as K
from kinetrace.operators import folds as D
from kinetrace.operators import joins as J
from kinetrace.operators import kernel_machine as H
from kinetrace.operators import learning as L
from kinetrace.operators import quality as Q
from kinetrace.operators import rejection as X
from kinetrace.operators import resample as R
from kinetrace.operators import robust as B
from kinetrace.operators import rules as U
from kinetrace.operators import segment as S
from kinetrace.operators import signal as G
from kinetrace.operators import similarity as M
from kinetrace.operators import skeleton as T
from kinetrace.operators import windows as W
from kinetrace.operators.recursion import System
from kinetrace.plans.base import ITEMS, SAMPLES, items, micros, samples, table, windows_sql
from kinetrace.plans.sql import WIDTHS, far_sql, filtered_query, peaks_sql, tilt_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BY, ORDER = ["user_id"], ["us", "seq"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    """Rounded where float sums may differ in their last bits; the data have two decimals, so no ties at six."""
    return F.round(c, 6)


def r6_scaled(c):
    """As r6 for means of 32 or 64 values, which do have ties at six: scaled and rounded to a whole number, as DuckDB does it."""
    return F.round(F.col(c) * 1e6) / 1e6


# ---- the flagship: windows, rules, smoothing, timeline

_RULES_SQL = """CASE WHEN mx > 250 AND sd < 80 THEN 'jump' WHEN ptp BETWEEN 60 AND 120 AND nz >= 3 THEN 'dribble'
 WHEN sd > 50 AND mx > 120 THEN 'shot' WHEN sd > 30 AND nz <= 12 THEN 'pass' WHEN mean > 40 THEN 'sprint' ELSE 'idle' END"""


_TIMELINE_SQL = f"""WITH {SAMPLES}, {windows_sql(20, 10)},
f AS (SELECT user_id, window_id, avg(x) AS mean, stddev_pop(x) AS sd, max(x) AS mx, max(x) - min(x) AS ptp, min(us) AS a, max(us) AS b, count(*) FILTER (x > 30) AS nz FROM w GROUP BY ALL),
p AS (SELECT *, {_RULES_SQL} AS pred, CASE WHEN {_RULES_SQL} = 'jump' THEN 0.65 WHEN {_RULES_SQL} = 'dribble' THEN 0.7 WHEN {_RULES_SQL} = 'shot' THEN 0.6 WHEN {_RULES_SQL} = 'pass' THEN 0.55 ELSE 0.5 END AS conf FROM f),
v AS (SELECT p.user_id, p.window_id, q.pred, count(*) AS c FROM p JOIN p q ON p.user_id = q.user_id AND abs(p.window_id - q.window_id) <= 2 GROUP BY ALL),
m AS (SELECT user_id, window_id, pred AS smooth FROM v QUALIFY row_number() OVER (PARTITION BY user_id, window_id ORDER BY c DESC, pred) = 1),
s AS (SELECT p.*, smooth, CASE WHEN lag(smooth) OVER (PARTITION BY p.user_id ORDER BY p.window_id) = smooth THEN 0 ELSE 1 END AS st FROM p JOIN m USING (user_id, window_id)),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY window_id) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS event, CASE WHEN count(*) >= CASE WHEN smooth IN ('jump', 'pass') THEN 2 ELSE 3 END THEN smooth ELSE 'unknown' END AS label,
       min(a) AS start, max(b) AS "end", count(*) AS windows, round(avg(conf), 6) AS confidence
FROM g GROUP BY user_id, run, smooth"""


@query(_TIMELINE_SQL)
def rule_timeline(spark, d):
    """Events to sliding windows, rules, majority smoothing and an event timeline."""
    f = W.sliding(samples(spark, d), BY, ORDER, 20, 10).groupBy("user_id", "window_id").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.max("x").alias("mx"), (F.max("x") - F.min("x")).alias("ptp"), F.min("us").alias("a"), F.max("us").alias("b"), F.count_if(F.col("x") > 30).alias("nz"))
    c = F.col
    label, sure = U.first_match([
        ("jump", 0.65, (c("mx") > 250) & (c("sd") < 80)), ("dribble", 0.7, c("ptp").between(60, 120) & (c("nz") >= 3)), ("shot", 0.6, (c("sd") > 50) & (c("mx") > 120)),
        ("pass", 0.55, (c("sd") > 30) & (c("nz") <= 12)), ("sprint", 0.5, c("mean") > 40)], ("idle", 0.5))
    f = f.withColumns({"pred": label, "conf": sure})
    f = f.withColumn("smooth", W.majority("pred", W.over(BY, ["window_id"])))
    return S.timeline(f, BY, ["window_id"], "smooth", "a", "b", "conf", {"jump": 2, "pass": 2}, 3).withColumn("confidence", r6(F.col("confidence")))


@query(f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, event) AS event_id, round(start / 1e6, 2) AS start_s, round("end" / 1e6, 2) AS end_s, round(("end" - start) / 1e6, 2) AS duration_s, label,
 CASE label WHEN 'jump' THEN '跳' WHEN 'shot' THEN '投' ELSE label END AS label_shown, round(confidence, 3) AS avg_confidence, windows AS n_windows FROM ({_TIMELINE_SQL})""")
def event_table(spark, d):
    return S.event_table(rule_timeline(spark, d), BY, {"jump": "跳", "shot": "投"})


# ---- projections and filters

@query(f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, l_suppkey, round(sqrt(ax*ax + ay*ay + az*az), 6) AS acc_mag FROM li")
def sensor_norm(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", r6(C.norm("ax", "ay", "az")).alias("acc_mag"))


@query("""SELECT event_id, round(value * 9.80665, 8) AS ms2, round(radians(value), 6) AS rad, value / 16384.0 AS g, round(value / 131.0, 9) AS dps,
 round(value * (4.0 * 9.80665 / 32768.0), 9) AS si_acc, round(radians(value * (512.0 / 32768.0)), 9) AS si_gyr FROM events""")
def unit_convert(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(C.g_to_ms2(v), 8).alias("ms2"), r6(F.radians(v)).alias("rad"), C.counts_to_g(v).alias("g"), F.round(C.counts_to_dps(v), 9).alias("dps"), F.round(C.counts_to_si(v, False), 9).alias("si_acc"), F.round(C.counts_to_si(v, True), 9).alias("si_gyr"))


@query(f"WITH {SAMPLES} SELECT user_id, seq, round((us - min(us) OVER (PARTITION BY user_id)) / 1e6, 6) AS t_rel FROM ev")
def relative_time(spark, d):
    return samples(spark, d).select("user_id", "seq", r6((F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 1e6).alias("t_rel"))


@query("""SELECT event_id, CAST(sign(value - 50) AS DOUBLE) AS sgn, abs(value - 50) AS dist, least(greatest(value, 10.0), 90.0) AS clipped, round(degrees(atan2(value, 50)), 6) AS angle,
 round(log2(value + 1), 6) AS lg, round(degrees(asin(least(1.0, value / 500))), 6) AS tilt FROM events""")
def scalar_functions(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.signum(v - 50).alias("sgn"), F.abs(v - 50).alias("dist"), C.clip(v, 10.0, 90.0).alias("clipped"), r6(F.degrees(F.atan2(v, F.lit(50)))).alias("angle"), r6(F.log2(v + 1)).alias("lg"), r6(F.degrees(F.asin(F.least(F.lit(1.0), v / 500)))).alias("tilt"))


@query(f"""WITH {ITEMS}, p AS (SELECT *, lag(ax) OVER w AS px, lag(ay) OVER w AS py, lag(az) OVER w AS pz, lead(ax) OVER w AS nx, lead(ay) OVER w AS ny, lead(az) OVER w AS nz FROM li WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, ax, ay)),
u AS (SELECT l_orderkey, l_linenumber, l_suppkey, ax, ay, ((px-ax)*(nx-ax)+(py-ay)*(ny-ay)+(pz-az)*(nz-az)) / (sqrt((px-ax)*(px-ax)+(py-ay)*(py-ay)+(pz-az)*(pz-az)) * sqrt((nx-ax)*(nx-ax)+(ny-ay)*(ny-ay)+(nz-az)*(nz-az)) + 1e-9) AS c FROM p WHERE px IS NOT NULL AND nx IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_suppkey, ax, ay, round(degrees(acos(greatest(-1.0, least(1.0, c)))), 3) AS angle FROM u""")
def joint_angles(spark, d):
    rows = items(spark, d)
    w = W.over(["l_suppkey"], ["l_orderkey", "l_linenumber", "ax", "ay"])
    axes = ("ax", "ay", "az")
    rows = rows.withColumns({f"p{a}": F.lag(a).over(w) for a in axes} | {f"n{a}": F.lead(a).over(w) for a in axes}).where("pax IS NOT NULL AND nax IS NOT NULL")
    pick = lambda p: tuple(F.col(p + a) for a in axes)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "ax", "ay", F.round(C.joint_angle(pick("p"), pick(""), pick("n")), 3).alias("angle"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN '看' WHEN 'click' THEN '点' ELSE event_type END AS label, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'ok' END AS state FROM events")
def label_translate(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", C.translated(F.col("event_type"), {"view": "看", "click": "点"}).alias("label"), F.when(F.col("event_type") == "error", "bad").otherwise("ok").alias("state"))


@query("""WITH q AS (SELECT user_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events GROUP BY user_id)
SELECT event_id, round(0.8 + greatest(0.0, least(1.0, (value - a) / greatest(b - a, 1e-9))) * 0.4, 6) AS scaled, CAST(1.0 AS DOUBLE) AS missing FROM events JOIN q USING (user_id)""")
def quantile_scaling(spark, d):
    e = B.quantile_scaled(table(spark, d, "events"), ["user_id"], "value", 0.8, 1.2)
    return B.quantile_scaled(e, ["user_id"], "no_such_column", 0.8, 1.2, "missing").select("event_id", r6("scaled").alias("scaled"), "missing")


@query("SELECT event_id, lpad(CAST(CAST(floor(value) AS INT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value) AS INT) % 60 AS VARCHAR), 2, '0') AS mmss, 'C' || lpad(CAST(user_id AS VARCHAR), 3, '0') AS code FROM events")
def time_labels(spark, d):
    return table(spark, d, "events").select("event_id", C.minutes_seconds(F.col("value")).alias("mmss"), C.lettered("C", F.col("user_id"), 3).alias("code"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, replace(p_brand, 'Brand#', 'B') AS brand, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INT) AS number, starts_with(p_name, 'small') AS small FROM part")
def string_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("brand"), F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("int").alias("number"), F.startswith("p_name", F.lit("small")).alias("small"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, strftime(ts, '%Y%m%d_%H%M%S') AS run_id FROM events")
def json_and_dates(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("run_id"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('view', 'click') AND value >= 20 AND NOT (value = 32767)")
def filter_labelled(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click") & (F.col("value") >= 20) & ~(F.col("value") == 32767)).select("event_id", "user_id", "value")


@query(f"""WITH {SAMPLES}, z AS (SELECT * REPLACE (CASE WHEN x < 5 THEN NULL ELSE x END AS x) FROM ev), {windows_sql(20, 10, 'z')}
SELECT user_id, window_id, round(count(*) FILTER (x IS NULL) / 20.0, 6) AS null_ratio FROM w GROUP BY ALL HAVING count(*) FILTER (x IS NULL) / 20.0 <= 0.1""")
def null_ratio_windows(spark, d):
    rows = samples(spark, d).withColumn("x", F.when(F.col("x") >= 5, F.col("x")))
    return W.null_ratio(W.sliding(rows, BY, ORDER, 20, 10), BY, ["x"]).where("null_ratio <= 0.1").select("user_id", "window_id", r6(F.col("null_ratio")).alias("null_ratio"))


@query(f"WITH {SAMPLES} SELECT user_id, seq, round(x, 6) AS x FROM ev WHERE user_id <> 8")
def hold_out_recording(spark, d):
    rest, held = L.hold_out(samples(spark, d), "user_id", 8)
    return L.checked_apart(rest, held, "user_id").select("user_id", "seq", r6(F.col("x")).alias("x"))


@query("""WITH v AS (SELECT 'c' AS feature, stddev_pop(1.0) AS std FROM events UNION ALL SELECT 'x', stddev_pop(value) FROM events UNION ALL SELECT 'u', stddev_pop(user_id) FROM events)
SELECT feature, round(std, 6) AS std FROM v WHERE std > 0""")
def constant_columns(spark, d):
    e = table(spark, d, "events").select(F.lit(1.0).alias("c"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("u"))
    names = B.varying(e, e.columns)
    spread = e.agg(*[F.stddev_pop(c).alias(c) for c in names])
    return spread.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), r6(F.col(c)).alias("std")) for c in names])).alias("f")).select("f.*")


@query(f"""WITH {SAMPLES} SELECT seq, x FROM ev WHERE user_id % 2 = 0 UNION ALL SELECT seq, y AS x FROM ev WHERE user_id % 2 = 1""")
def union_by_name(spark, d):
    s = samples(spark, d)
    return s.where("user_id % 2 = 0").select("seq", "x").unionByName(s.where("user_id % 2 = 1").select(F.col("y").alias("x"), "seq"))


@query(f"""WITH {SAMPLES} SELECT seq, round(0.6 * x + sin(y / 50.0) * 2, 6) AS vertical FROM ev""")
def synthetic_mix(spark, d):
    return samples(spark, d).select("seq", r6(0.6 * F.col("x") + F.sin(F.col("y") / 50.0) * 2).alias("vertical"))


@query(f"""WITH {SAMPLES}, a AS (SELECT seq, x / 100 AS roll, y / 100 AS pitch, x AS ax, y AS ay, x - y AS az FROM ev),
v AS (SELECT *, -sin(pitch) * ax + cos(pitch) * sin(roll) * ay + cos(pitch) * cos(roll) * az AS up FROM a)
SELECT seq, round(up - 9.80665, 6) AS a_vert, round(sqrt(greatest(0.0, ax*ax + ay*ay + az*az - up*up)), 5) AS a_horiz FROM v""")
def gravity_split(spark, d):
    x, y = F.col("x"), F.col("y")
    up, flat = C.complementary_gravity(x / 100, y / 100, x, y, x - y)
    return samples(spark, d).select("seq", r6(up).alias("a_vert"), F.round(flat, 5).alias("a_horiz"))


@query(f"""WITH {SAMPLES}, q AS (SELECT seq, cos(x / 200) AS w, sin(x / 200) AS z FROM ev)
SELECT seq, round(atan2(2 * w * z, 1 - 2 * z * z), 6) AS yaw, round(w * w - z * z, 6) AS turned_x, round(2 * w * z, 6) AS turned_y FROM q""")
def quaternion_rotate(spark, d):
    zero = F.lit(0.0)
    q = (F.cos(F.col("x") / 200), zero, zero, F.sin(F.col("x") / 200))
    v = C.rotated(q, (F.lit(1.0), zero, zero))
    return samples(spark, d).select("seq", r6(C.euler(q)[2]).alias("yaw"), r6(v[0]).alias("turned_x"), r6(v[1]).alias("turned_y"))


@query(f"""WITH {SAMPLES}, a AS (SELECT seq, x, y * cos(x / 100) - (x - y) * sin(x / 100) AS wy, y * sin(x / 100) + (x - y) * cos(x / 100) AS wz FROM ev)
SELECT seq, round(wz + 9.80665, 6) AS a_vert, round(sqrt(x * x + wy * wy), 6) AS a_horiz FROM a""")
def quaternion_split(spark, d):
    zero, x, y = F.lit(0.0), F.col("x"), F.col("y")
    up, flat = C.quaternion_gravity((F.cos(x / 200), F.sin(x / 200), zero, zero), (x, y, x - y))
    return samples(spark, d).select("seq", r6(up).alias("a_vert"), r6(flat).alias("a_horiz"))


# ---- joins

@query("""SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def meta_left_join(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    dim = J.lookup(n.withColumnRenamed("n_regionkey", "r_regionkey"), r, ["r_regionkey"]).withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup(table(spark, d, "customer"), dim, ["c_nationkey"]).select("c_custkey", "c_mktsegment", "n_name", "r_name")


_TICKS = f"""{SAMPLES}, k AS (SELECT us // 600000000 AS tick, node, min(x) AS x FROM ev GROUP BY ALL),
p AS (SELECT tick, {', '.join(f'min(CASE WHEN node = {n} THEN x END) AS x_n{n}' for n in range(1, 5))}, count(DISTINCT node) AS c FROM k GROUP BY tick)"""


@query(f"WITH {_TICKS} SELECT tick, x_n1, x_n2, x_n3, x_n4 FROM p WHERE c = 4")
def node_pivot_inner(spark, d):
    return R.pivot_nodes(samples(spark, d).withColumn("tick", F.floor(F.col("us") / 600_000_000)), ["tick"], "node", [1, 2, 3, 4], ["x"])


def _filled_sql(n: int) -> str:
    return f"""f{n} AS (SELECT rec, i, x_n{n} AS x, last_value(x_n{n} IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x_n{n} IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
 first_value(x_n{n} IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN x_n{n} IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM g
 WINDOW b AS (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"""WITH {SAMPLES}, p AS (SELECT user_id % 5 AS rec, us // 600000000 AS tick, min(CASE WHEN node = 1 THEN x END) AS x_n1, min(CASE WHEN node = 2 THEN x END) AS x_n2 FROM ev GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY tick) AS i FROM p), {_filled_sql(1)}, {_filled_sql(2)}
SELECT rec, tick, round(CASE WHEN f1.i1 IS NULL OR f1.i1 = f1.i0 THEN f1.x0 ELSE f1.x0 + (f1.x1 - f1.x0) * (g.i - f1.i0) / (f1.i1 - f1.i0) END, 6) AS x_n1,
       round(CASE WHEN f2.i1 IS NULL OR f2.i1 = f2.i0 THEN f2.x0 ELSE f2.x0 + (f2.x1 - f2.x0) * (g.i - f2.i0) / (f2.i1 - f2.i0) END, 6) AS x_n2
FROM g JOIN f1 USING (rec, i) JOIN f2 USING (rec, i) WHERE f1.i0 IS NOT NULL AND f2.i0 IS NOT NULL""")
def node_outer_interp(spark, d):
    s = samples(spark, d).withColumns({"tick": F.floor(F.col("us") / 600_000_000), "rec": F.col("user_id") % 5})
    wide = R.pivot_nodes(s, ["rec", "tick"], "node", [1, 2, 3, 4], ["x"], whole=False)
    filled = R.fill_by_row(wide, ["rec"], ["tick"], ["x_n1", "x_n2"])
    return filled.select("rec", "tick", r6(F.col("x_n1")).alias("x_n1"), r6(F.col("x_n2")).alias("x_n2"))


@query("""WITH o AS (SELECT o_custkey AS c, epoch_us(o_orderdate) // 86400000000 AS day, o_orderkey FROM orders),
h AS (SELECT c, year(make_timestamp(day * 86400000000)) AS y, min(day) AS a FROM o GROUP BY ALL)
SELECT o_orderkey, coalesce((SELECT arg_min('Y' || y, (a, y)) FROM h WHERE h.c = o.c AND o.day BETWEEN h.a AND h.a + 60), 'unknown') AS phase FROM o""")
def phase_interval_join(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.floor(micros("o_orderdate") / 86_400_000_000).alias("day"), "o_orderkey", F.year("o_orderdate").alias("y"))
    h = o.groupBy("c", "y").agg(F.min("day").alias("a")).select("c", "a", (F.col("a") + 60).alias("b"), F.concat(F.lit("Y"), F.col("y")).alias("name"))
    return J.interval_join(o, h, ["c"], "day", "a", "b", "name").select("o_orderkey", F.col("interval_label").alias("phase"))


@query("""WITH o AS (SELECT o_custkey AS c, epoch_us(o_orderdate) // 86400000000 AS day, year(o_orderdate) AS y, o_orderkey FROM orders), h AS (SELECT c, 'Y' || y AS name, min(day) AS a FROM o GROUP BY c, y)
SELECT o_orderkey, coalesce((SELECT arg_min(name, (a, name)) FROM h WHERE h.c = o.c AND o.day BETWEEN h.a AND h.a + 500), 'unknown') AS phase FROM o""")
def first_interval_join(spark, d):
    """Intervals that overlap: the first that holds a point."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.floor(micros("o_orderdate") / 86_400_000_000).alias("day"), "o_orderkey", F.year("o_orderdate").alias("y"))
    h = o.groupBy("c", "y").agg(F.min("day").alias("a")).select("c", "a", (F.col("a") + 500).alias("b"), F.concat(F.lit("Y"), F.col("y")).alias("name"))
    return J.interval_join(o, h, ["c"], "day", "a", "b", "name").select("o_orderkey", F.col("interval_label").alias("phase"))


@query(f"""WITH {SAMPLES}, c AS (SELECT * FROM ev WHERE label = 'click'), v AS (SELECT user_id, us, min('v' || seq) AS name FROM ev WHERE label = 'view' GROUP BY ALL),
n AS (SELECT c.user_id, c.seq, v.us, v.name, abs(v.us - c.us) AS far FROM c LEFT JOIN v USING (user_id) QUALIFY row_number() OVER (PARTITION BY c.seq ORDER BY abs(v.us - c.us), v.us) = 1)
SELECT user_id, seq, CASE WHEN far <= 21600000000 THEN name END AS event, round(far / 1e6, 6) AS distance FROM n""")
def nearest_event(spark, d):
    s = samples(spark, d)
    events = s.where("label = 'view'").select("user_id", "us", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("name"))
    out = J.nearest_event(s.where("label = 'click'").select("user_id", "seq", "us"), events, BY, "us", "name", 21_600_000_000)
    return out.select("user_id", "seq", "event", r6(F.col("distance") / 1e6).alias("distance"))


@query(f"""WITH {SAMPLES}, c AS (SELECT * FROM ev WHERE label = 'click'), v AS (SELECT * FROM ev WHERE label = 'view')
SELECT c.seq, round(v.x, 6) AS nearest, round(abs(v.us - c.us) / 1e6, 6) AS distance FROM c JOIN v USING (user_id)
QUALIFY row_number() OVER (PARTITION BY c.seq ORDER BY abs(v.us - c.us), v.us, v.seq) = 1""")
def nearest_asof(spark, d):
    s = samples(spark, d)
    right = s.where("label = 'view'")
    out = J.nearest_join(s.where("label = 'click'").select("user_id", "seq", "us"), right.select("user_id", "us", "x"), BY, "us", "x")
    return out.where("nearest IS NOT NULL").select("seq", r6(F.col("nearest")).alias("nearest"), r6(F.col("distance") / 1e6).alias("distance"))


@query(f"""WITH {SAMPLES}, {windows_sql(20, 10)}, s AS (SELECT user_id, window_id, min(us) AS a, max(us) AS b FROM w GROUP BY ALL), e AS (SELECT user_id, us - 3600000000 AS rs, us + 3600000000 AS re FROM ev WHERE x > 300)
SELECT user_id, window_id FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND NOT (s.b < e.rs OR s.a > e.re))""")
def overlap_anti_join(spark, d):
    s = samples(spark, d)
    win = W.sliding(s, BY, ORDER, 20, 10).groupBy("user_id", "window_id").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    hot = s.where("x > 300").select("user_id", (F.col("us") - 3_600_000_000).alias("rs"), (F.col("us") + 3_600_000_000).alias("re"))
    return J.not_overlapping(win, hot, BY).select("user_id", "window_id")


@query(f"""WITH {SAMPLES}, a AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS k FROM ev WHERE label = 'click'), b AS (SELECT user_id, x AS y, row_number() OVER (PARTITION BY user_id ORDER BY us, seq) AS k FROM ev WHERE label = 'view')
SELECT user_id, k, x, y FROM a JOIN b USING (user_id, k)""")
def ordinal_zip_join(spark, d):
    s = samples(spark, d)
    return J.zip_join(s.where("label = 'click'").select("user_id", "us", "seq", "x"), s.where("label = 'view'").select("user_id", F.col("us").alias("us2"), F.col("seq").alias("seq2"), F.col("x").alias("y")), BY, ORDER, ["us2", "seq2"]).select("user_id", "k", "x", "y")


@query("""WITH p AS (SELECT q.vec_id AS qid, t.vec_id AS id, t.label, round(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(t.embedding[i] AS DOUBLE), 2))), 9) AS d
 FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, id) <= 5), v AS (SELECT qid, label, count(*) AS votes FROM n GROUP BY ALL)
SELECT qid, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1""")
def knn_classify(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return J.nearest_neighbours(e.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"), e)


@query(ORACLES["knn_classify"])
def knn_pruned(spark, d):
    """The same neighbours where rings of rows that are too far are left out."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return J.pruned_neighbours(e.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"), e)[0]


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def class_pairs(spark, d):
    r = table(spark, d, "region")
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, F.col("a.r_regionkey") < F.col("b.r_regionkey")).select(F.col("a.r_name").alias("a"), F.col("b.r_name").alias("b"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def recording_semi_join(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


# ---- aggregates and stream quality

@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id % 10 AS g, " + ", ".join(f"round(count(*) FILTER (event_type = '{t}') / count(*), 2) AS {t}" for t in _TYPES) + " FROM events GROUP BY g")
def crosstab_norm(spark, d):
    return Q.crosstab(table(spark, d, "events").withColumn("g", F.col("user_id") % 10), "g", "event_type", list(_TYPES))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def size_unstack(spark, d):
    return Q.size_table(table(spark, d, "events"), BY, "event_type", list(_TYPES))


@query(f"WITH {SAMPLES} SELECT user_id, string_agg(label, ' → ' ORDER BY us, seq) AS sequence, sum(x) > 0 AS any FROM ev GROUP BY user_id")
def ordered_string_agg(spark, d):
    return with_any(samples(spark, d))


def with_any(s: DataFrame) -> DataFrame:
    found = s.groupBy(F.col("user_id").alias("__user")).agg((F.sum("x") > 0).alias("any"))
    return Q.joined_in_order(s, BY, ORDER, "label").join(found, F.col("user_id").eqNullSafe(F.col("__user"))).drop("__user")


@query(f"WITH {SAMPLES}, e AS (SELECT user_id % 10 AS rec, node, min(us) AS a, max(us) AS b FROM ev GROUP BY ALL) SELECT rec, max(a) AS lo, min(b) AS hi, count(*) AS nodes FROM e GROUP BY rec")
def overlap_bounds(spark, d):
    return R.common_bounds(samples(spark, d).withColumn("rec", F.col("user_id") % 10), ["rec"], "node", "us")


@query(f"""WITH {SAMPLES}, t AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, seq) AS dt FROM ev)
SELECT user_id, count(*) AS rows, max(us) - min(us) AS duration, quantile_cont(dt, 0.5) AS median_dt, round(1 - count(DISTINCT seq) / (max(seq) - min(seq) + 1), 9) AS loss, count(*) FILTER (x > 300) AS saturated FROM t GROUP BY user_id""")
def packet_loss(spark, d):
    return Q.packet_loss(samples(spark, d), BY, "seq", "us", F.col("x") > 300).drop("hz").withColumn("loss", F.round("loss", 9))


@query(f"""WITH {SAMPLES}, t AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS dt FROM ev)
SELECT user_id, count(*) FILTER (dt > 1.5 * 21600000000) AS gaps, round(avg(CASE WHEN dt > 1.5 * 21600000000 THEN 1.0 WHEN dt IS NOT NULL THEN 0.0 END), 6) AS gap_ratio, max(dt) AS max_gap, CAST(floor((max(us) - min(us)) / 21600000000) + 1 AS BIGINT) AS expected FROM t GROUP BY user_id""")
def dropout_summary(spark, d):
    return Q.dropouts(samples(spark, d), BY, "us", 21_600_000_000).withColumn("gap_ratio", r6(F.col("gap_ratio")))


@query(f"""WITH {SAMPLES}, t AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS dt FROM ev), m AS (SELECT user_id, quantile_cont(dt, 0.5) AS md FROM t GROUP BY user_id)
SELECT user_id, round(avg(CASE WHEN abs(dt - md) > 0.2 * md THEN 1.0 ELSE 0.0 END), 6) AS jitter, avg(CASE WHEN abs(dt - md) > 0.2 * md THEN 1.0 ELSE 0.0 END) > 0.05 AS warn FROM t JOIN m USING (user_id) WHERE dt IS NOT NULL GROUP BY user_id""")
def jitter_ratio(spark, d):
    return Q.jitter(samples(spark, d), BY, "us").withColumn("jitter", r6(F.col("jitter")))


@query(f"""WITH {SAMPLES}, h AS (SELECT *, us - min(us) OVER (PARTITION BY user_id) AS r FROM ev), a AS (SELECT user_id, avg(x) AS m, stddev_pop(x) AS s FROM h WHERE r <= 86400000000 GROUP BY user_id)
SELECT user_id, round(m, 6) AS mean_norm, round(s, 6) AS std_norm, CASE WHEN abs(m - 50) <= 20 THEN 'static' WHEN s <= 20 THEN 'offset' ELSE 'moving' END AS status FROM a""")
def baseline_check(spark, d):
    out = Q.baseline(samples(spark, d), BY, "us", F.col("x"), 86_400_000_000, 50.0, 20.0)
    return out.withColumns({"mean_norm": r6(F.col("mean_norm")), "std_norm": r6(F.col("std_norm"))})


@query(f"""WITH {SAMPLES}, a AS (SELECT user_id, avg(x) AS acc_mean, stddev_samp(x) AS acc_std, avg(y - 50) AS vertical_mean, stddev_samp(y - 50) AS vertical_std, avg(y / 100) AS gyr_mean, stddev_samp(y / 100) AS gyr_std FROM ev GROUP BY user_id)
SELECT user_id, round(acc_mean, 6) AS acc_mean, round(acc_std, 6) AS acc_std, round(vertical_mean, 6) AS vertical_mean, round(vertical_std, 6) AS vertical_std, round(gyr_mean, 6) AS gyr_mean, round(gyr_std, 6) AS gyr_std,
 coalesce(abs(acc_mean - 50) < 32 AND acc_std < 32 AND abs(vertical_mean) < 32 AND vertical_std < 32 AND gyr_mean < 0.5, false) AS passed FROM a""")
def static_check(spark, d):
    """Whether recordings are at rest: acceleration, its vertical part and rotation."""
    s = samples(spark, d).withColumns({"v": F.col("y") - 50, "g": F.col("y") / 100})
    out = Q.static_check(s, BY, "x", "v", "g", 50.0, 32.0, 0.5)
    return out.withColumns({c: r6_scaled(c) for c in out.columns if c.endswith(("_mean", "_std"))})


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def phase_summary(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("user_id").alias("users"))
    return g.join(Q.exact_quantile(e, ["event_type"], "value", 0.5, "median").withColumn("median", r6("median")), "event_type")


_R = f"""{SAMPLES}, c AS (SELECT node, label, user_id, count(*) AS n, corr(x, y) AS r FROM ev GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"WITH {_R} SELECT node, label, user_id, n, round(r, 6) AS r FROM c")
def pearson_pairs(spark, d):
    return Q.pearson(samples(spark, d), ["node", "label", "user_id"], "x", "y", least=3).withColumn("r", r6(F.col("r")))


@query(f"WITH {_R} SELECT node, label, grouping(node) * 2 + grouping(label) AS level, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM c GROUP BY CUBE (node, label)")
def similarity_marginals(spark, d):
    c = Q.pearson(samples(spark, d), ["node", "label", "user_id"], "x", "y", least=3)
    return M.similarity_table(c, "node", "label").withColumns({"mean": r6(F.col("mean")), "std": r6(F.col("std"))})


@query(f"WITH {_R} SELECT count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS median, round(stddev_pop(r), 6) AS std, round(max(r) - min(r), 6) AS range, round(avg((abs(r) > 0.3)::INT), 6) AS over_03, round(avg((abs(r) > 0.5)::INT), 6) AS over_05, round(avg((r > 0)::INT), 6) AS positive FROM c")
def similarity_shares(spark, d):
    s = M.similarity_summary(Q.pearson(samples(spark, d), ["node", "label", "user_id"], "x", "y", least=3))
    return s.select("n", *[r6(F.col(c)).alias(c) for c in s.columns[1:]])


@query(f"WITH {_R}, m AS (SELECT label, round(avg(r), 9) AS mean FROM c GROUP BY label) SELECT label, round(mean, 6) AS mean FROM m ORDER BY mean DESC, label LIMIT 1")
def most_similar_label(spark, d):
    c = Q.pearson(samples(spark, d), ["node", "label", "user_id"], "x", "y", least=3)
    return M.most_similar(c, "label").withColumn("mean", r6(F.col("mean")))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) IS NOT NULL AS has FROM events GROUP BY user_id")
def first_row_in_group(spark, d):
    return first_of(table(spark, d, "events"))


def first_of(e: DataFrame) -> DataFrame:
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").isNotNull().alias("has"))


# ---- ordered windows

_W = "WINDOW o AS (PARTITION BY user_id ORDER BY us, seq)"


@query(f"WITH {SAMPLES} SELECT user_id, seq, round(x - coalesce(lag(x) OVER o, x), 6) AS diff, round((lead(x) OVER o - x) * 50.0, 6) AS jerk FROM ev {_W}")
def differences(spark, d):
    w = W.over(BY, ORDER)
    return samples(spark, d).select("user_id", "seq", r6(W.difference("x", w)).alias("diff"), r6(W.forward_jerk("x", w, 50.0)).alias("jerk"))


@query(f"WITH {SAMPLES} SELECT user_id, seq, round(avg(x) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS rolled FROM ev")
def rolling_mean_shrink(spark, d):
    return samples(spark, d).select("user_id", "seq", r6(W.rolling_mean("x", W.over(BY, ORDER), 9)).alias("rolled"))


@query(f"WITH {SAMPLES} SELECT user_id, seq, round(sum(x) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS moved FROM ev")
def moving_avg_zeropad(spark, d):
    return samples(spark, d).select("user_id", "seq", r6(W.moving_average("x", W.over(BY, ORDER), 5)).alias("moved"))


@query(f"WITH {SAMPLES} SELECT user_id, seq, round(CASE WHEN lag(x) OVER o IS NULL THEN lead(x) OVER o - x WHEN lead(x) OVER o IS NULL THEN x - lag(x) OVER o ELSE (lead(x) OVER o - lag(x) OVER o) / 2 END * 50.0, 6) AS grad FROM ev {_W}")
def gradient_uniform(spark, d):
    return samples(spark, d).select("user_id", "seq", r6(W.gradient("x", W.over(BY, ORDER), 50.0)).alias("grad"))


@query(f"""WITH {SAMPLES}, g AS (SELECT user_id, seq, x, us / 1e9 AS t, lag(x) OVER o AS xb, lead(x) OVER o AS xa, us / 1e9 - lag(us / 1e9) OVER o AS hs, lead(us / 1e9) OVER o - us / 1e9 AS hd FROM ev {_W})
SELECT user_id, seq, round(CASE WHEN xb IS NULL THEN (xa - x) / hd WHEN xa IS NULL THEN (x - xb) / hs ELSE (hs*hs*xa + (hd*hd - hs*hs)*x - hd*hd*xb) / (hs*hd*(hs+hd)) END, 6) AS grad FROM g""")
def gradient_nonuniform(spark, d):
    s = samples(spark, d).withColumn("t", F.col("us") / 1e9)
    return s.select("user_id", "seq", r6(W.gradient_uneven("x", "t", W.over(BY, ORDER))).alias("grad"))


@query(f"""WITH {SAMPLES}, v AS (SELECT a.user_id, a.i, a.seq, b.label, count(*) AS c FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.i - b.i) <= 2 WHERE b.label <> 'unknown' GROUP BY ALL),
m AS (SELECT user_id, seq, label FROM v QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY c DESC, label) = 1)
SELECT ev.user_id, ev.seq, coalesce(m.label, 'unknown') AS smooth FROM ev LEFT JOIN m ON ev.seq = m.seq""")
def majority_smooth(spark, d):
    return samples(spark, d).select("user_id", "seq", W.majority("label", W.over(BY, ORDER)).alias("smooth"))


_RUNS = f"""{SAMPLES}, s AS (SELECT *, CASE WHEN lag(label) OVER o IS NOT DISTINCT FROM label AND i > 0 THEN 0 ELSE 1 END AS st FROM ev {_W}), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, seq) AS run FROM s)"""


@query(f"WITH {_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, min(label) AS label, count(*) AS n, min(us) AS first, max(us) AS last FROM r GROUP BY user_id, run")
def run_length(spark, d):
    return W.run_lengths(samples(spark, d), BY, ORDER, "label")


@query(f"""WITH {SAMPLES}, h AS (SELECT *, x < 30 AS hit FROM ev), s AS (SELECT *, CASE WHEN lag(hit) OVER o IS NOT DISTINCT FROM hit AND i > 0 THEN 0 ELSE 1 END AS st FROM h {_W}), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, seq) AS run FROM s),
n AS (SELECT user_id, run, count(*) FILTER (hit) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) / 50.0 AS longest FROM n GROUP BY user_id""")
def longest_run(spark, d):
    return W.longest_run(samples(spark, d), BY, ORDER, F.col("x") < 30, 50.0)


@query(f"""WITH {SAMPLES}, k AS (SELECT user_id, seq, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE x > 100 {_W})
SELECT user_id, seq, ['dribble', 'shot', 'pass'][CAST(k % 3 + 1 AS INT)] AS name, CAST(k // 3 + 1 AS INT) AS cycle FROM k WHERE k < n // 3 * 3""")
def cyclic_labels(spark, d):
    return W.alternate(samples(spark, d).where("x > 100"), BY, ORDER, ["dribble", "shot", "pass"]).select("user_id", "seq", "name", "cycle")


@query(f"WITH {SAMPLES} SELECT user_id, seq, x, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, us, seq) AS rank FROM ev QUALIFY rank <= 5")
def highest_samples(spark, d):
    return W.tallest(samples(spark, d), BY, "x", ORDER, 5).select("user_id", "seq", "x", "rank")


@query(f"WITH {SAMPLES}, {peaks_sql()} SELECT pp.user_id, seq, x, round(prominence, 6) AS prominence, row_number() OVER (PARTITION BY pp.user_id ORDER BY round(prominence, 6) DESC, us, seq) AS rank FROM pp JOIN ev USING (user_id, i) QUALIFY rank <= 5")
def prominent_peaks(spark, d):
    """The five most prominent peaks of each recording; the rank is that of prominence, rows may be sorted by time again."""
    p = G.peak_shapes(samples(spark, d), BY, ORDER, "x").withColumn("prominence", r6("prominence"))
    return W.tallest(p, BY, "prominence", ORDER, 5).select("user_id", "seq", "x", "prominence", "rank")


@query(f"""WITH {SAMPLES}, {windows_sql(20, 10)} SELECT user_id, window_id, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, round(max(x) - min(x), 6) AS ptp, round(sqrt(avg(x * x)), 6) AS rms,
 round((avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*pow(avg(x), 3)) / pow(stddev_pop(x), 3), 5) AS skew, round(kurtosis_pop(x), 5) AS kurt, min(us) AS t_first, max(us) AS t_last, (min(us) + max(us)) / 2 AS t_center FROM w GROUP BY ALL""")
def sliding_features(spark, d):
    f = W.window_stats(W.sliding(samples(spark, d), BY, ORDER, 20, 10), BY, "x", "us")
    return f.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "ptp", "rms")} | {c: F.round(c, 5) for c in ("skew", "kurt")})


@query(f"""WITH {SAMPLES}, {windows_sql(20, 5)}, c AS (SELECT user_id, window_id, label, count(*) AS n FROM w GROUP BY ALL)
SELECT user_id, window_id, label, n / 20.0 AS purity FROM c QUALIFY row_number() OVER (PARTITION BY user_id, window_id ORDER BY n DESC, label) = 1 AND n / 20.0 >= 0.3""")
def sliding_purity(spark, d):
    return W.window_labels(W.sliding(samples(spark, d), BY, ORDER, 20, 5), BY, "label", 20).where("purity >= 0.3")


@query(f"WITH {SAMPLES}, {windows_sql(15, 2)} SELECT user_id, window_id, round(sqrt(avg(x * x)), 6) AS rms, window_id * 2 + 7 AS center FROM w GROUP BY ALL")
def rms_envelope(spark, d):
    return W.energy_envelope(samples(spark, d), BY, ORDER, "x", 15, 2).withColumn("rms", r6(F.col("rms")))


_ANCHOR = f"""{SAMPLES}, a AS (SELECT user_id, seq AS anchor_id, us AS anchor FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x DESC, us, seq) = 1),
n AS (SELECT ev.user_id, anchor_id, ev.x, ev.us, row_number() OVER (PARTITION BY ev.user_id ORDER BY us, seq) - 1 AS k, count(*) OVER (PARTITION BY ev.user_id) AS c FROM ev JOIN a USING (user_id) WHERE us BETWEEN anchor - 86400000000 AND anchor + 129600000000)"""


@query(f"WITH {_ANCHOR} SELECT user_id, anchor_id, count(*) AS n, round(avg(x), 6) AS mean FROM n WHERE c >= 3 GROUP BY ALL")
def anchored_windows(spark, d):
    s = samples(spark, d)
    a = W.tallest(s, BY, "x", ORDER, 1).select("user_id", F.col("seq").alias("anchor_id"), F.col("us").alias("anchor"))
    return W.anchored(s, a, BY, "us", 86_400_000_000, 129_600_000_000, 3).groupBy("user_id", "anchor_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean"))


@query(f"WITH {SAMPLES} SELECT user_id, i // 60 AS w, count(*) AS used, 60 AS size, round(sum(x * (i % 60 + 1)), 6) AS weighted FROM ev GROUP BY ALL")
def padded_windows(spark, d):
    """The whole of each recording in windows of 60, the last one filled with zeros."""
    s = samples(spark, d).select("user_id", F.floor(F.col("i") / 60).alias("w"), (F.col("i") % 60).alias("i"), "x")
    total = F.aggregate(F.zip_with("samples", F.sequence(F.lit(1), F.lit(60)), lambda x, k: x * k), F.lit(0.0), lambda a, x: a + x)
    n = s.groupBy("user_id", "w").agg(F.count(F.lit(1)).alias("used"))
    return W.padded(s, ["user_id", "w"], "i", "x", 60).join(n, ["user_id", "w"]).select("user_id", "w", "used", F.size("samples").alias("size"), r6(total).alias("weighted"))


#: A second view of the samples as events: the channel y names them, places count in samples.
_NAMED = f"""{SAMPLES}, nm AS (SELECT *, CASE WHEN y < 30 THEN 'null' WHEN y < 65 THEN 'pass' ELSE 'shot' END AS event, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
rn AS (SELECT *, sum(CASE WHEN event = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, seq) AS run FROM (SELECT *, lag(event) OVER (PARTITION BY user_id ORDER BY us, seq) AS before FROM nm)),
sf AS (SELECT user_id, run, event, lag(event) OVER (PARTITION BY user_id ORDER BY run) AS last FROM (SELECT user_id, run, any_value(event) AS event FROM rn WHERE event <> 'null' GROUP BY ALL)),
sg AS (SELECT rn.user_id AS u, rn.run, rn.user_id * 1000000 + rn.run AS user_id, i AS place, i - min(i) OVER (PARTITION BY rn.user_id, rn.run) AS i, x, n, rn.event FROM rn JOIN sf ON rn.user_id = sf.user_id AND rn.run = sf.run AND sf.last IS DISTINCT FROM sf.event)"""
_ANCHORS = f"""{_NAMED}, {peaks_sql("sg")}, {far_sql(5)}, sd AS (SELECT user_id, any_value(u) AS u, any_value(run) AS segment, any_value(event) AS event, min(place) AS first, count(*) AS m, stddev_pop(x) AS sd, sum(x * x) AS energy, sum(i * x * x) AS moment, any_value(n) AS n FROM sg GROUP BY user_id),
tp AS (SELECT f.user_id, arg_min(f.i, {{'v': -f.v, 'i': f.i}}) AS i FROM far f JOIN sd USING (user_id) WHERE f.prominence >= 1.5 * sd GROUP BY f.user_id),
an AS (SELECT sd.u, segment, event, n, first + CASE WHEN tp.i IS NOT NULL THEN tp.i WHEN energy < 1e-12 THEN m // 2 ELSE least(CAST(floor(moment / energy) AS BIGINT), m - 1) END AS anchor,
 CASE WHEN tp.i IS NOT NULL THEN 'peak' WHEN energy < 1e-12 THEN 'middle' ELSE 'centroid' END AS kind FROM sd LEFT JOIN tp USING (user_id))"""


def _cut_sql(windows: str, size: int, least: int = 1) -> str:
    """Sums over the windows [a, b) of view ``windows``, which are cut to ``size``."""
    return f"""SELECT w.* EXCLUDE (a, b, n), least(b - a, {size}) AS used, round(coalesce(sum(ev.x * (ev.i - a + 1)), 0), 6) AS weighted FROM {windows} w JOIN ev ON ev.user_id = w.user_id AND ev.i >= a AND ev.i < least(b, a + {size}) WHERE b - a >= {least} GROUP BY ALL"""


def _anchors(spark, d):
    s = samples(spark, d).withColumn("event", F.when(F.col("y") < 30, "null").when(F.col("y") < 65, "pass").otherwise("shot"))
    return s, W.event_anchors(W.event_segments(s, BY, ORDER, "event"), BY, "i", "x", "event")


def _weighted(windows: DataFrame, keys: list[str]) -> DataFrame:
    total = F.aggregate(F.transform("x", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return windows.select(*keys, F.size("x").cast("long").alias("used"), r6(total).alias("weighted"))


@query(f"""WITH RECURSIVE {_ANCHORS}, os AS (SELECT unnest([0, 5, -10]) AS shift), w AS (SELECT u AS user_id, segment, event, kind, anchor, shift, greatest(0, anchor + shift - 25) AS a, least(n, anchor + shift + 35) AS b, n FROM an, os) {_cut_sql("w", 60, 30)}""")
def event_windows(spark, d):
    """60 samples round the anchor of each event, and two shifts of them; cut at the borders, filled with zeros."""
    s, a = _anchors(spark, d)
    # y goes along to the blocks, so that events and blocks come from one shuffle of the samples
    windows = W.cut_samples(s, a.withColumnRenamed("anchor", "center"), BY, ORDER, ["x", "y"], 25, 35, 60, least=30, shifts=[0, 5, -10])
    return _weighted(windows.withColumnRenamed("center", "anchor"), ["user_id", "segment", "event", "kind", "anchor", "shift"])


_PEAK = f"pk1 AS (SELECT user_id, i AS center, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY x DESC, us, seq) = 1)"


def _tallest(spark, d):
    s = samples(spark, d)
    return s, W.tallest(s, BY, "x", ORDER, 1).select("user_id", F.col("i").alias("center"))


@query(f"""WITH {SAMPLES}, {_PEAK}, w AS (SELECT user_id, center, n, greatest(0, least(greatest(0, center - 20), n - 50)) AS a, least(n, greatest(least(n, center + 30), 50)) AS b FROM pk1) {_cut_sql("w", 50)}""")
def shifted_windows(spark, d):
    """50 samples round the highest one, moved inside at the borders."""
    s, c = _tallest(spark, d)
    return _weighted(W.cut_samples(s, c, BY, ORDER, ["x"], 20, 30, 50, "shift"), ["user_id", "center"])


@query(f"""WITH {SAMPLES}, {_PEAK}, w AS (SELECT user_id, center, n, center - 16 AS a, center + 19 AS b FROM pk1 WHERE center >= 16 AND center + 19 <= n) {_cut_sql("w", 35)}""")
def inclusive_windows(spark, d):
    """16 samples before the highest one to 18 after it, both ends included; none where a border is in the way."""
    s, c = _tallest(spark, d)
    return _weighted(W.cut_samples(s, c, BY, ORDER, ["x"], 16, 19, 35, "drop"), ["user_id", "center"])


#: Segments of 16 samples with what the physical check looks at.
_CHECKED = f"""{SAMPLES}, sg AS (SELECT user_id AS u, i // 16 AS segment, user_id * 1000000 + i // 16 AS user_id, i % 16 AS i, abs(x - 30) AS x, y AS h, y AS pitch, x / 50 AS up, CASE WHEN (user_id + i // 16) % 2 = 0 THEN 'dribble' ELSE 'shot' END AS label FROM ev)"""


@query(f"""WITH RECURSIVE {_CHECKED}, {peaks_sql("sg")}, {far_sql(2)}, lv AS (SELECT user_id, any_value(u) AS u, any_value(segment) AS segment, any_value(label) AS label, greatest(1.5 * avg(x), 1e-6) AS level, max(pitch) - min(pitch) AS pitch_range, max(up) AS vertical_peak, count(*) AS m FROM sg GROUP BY user_id),
ft AS (SELECT f.user_id, f.i, f.v, level FROM far f JOIN lv USING (user_id) WHERE f.prominence >= level),
rc AS (SELECT t.user_id, t.i, any_value(t.v) AS v, coalesce(max(s.i) FILTER (s.i < t.i AND s.x <= level), 0) AS l, coalesce(min(s.i) FILTER (s.i > t.i AND s.x <= level), max(s.i)) AS r, any_value(s.h) FILTER (s.i = t.i) AS h FROM ft t JOIN sg s USING (user_id) GROUP BY ALL),
sh AS (SELECT user_id, count(*) AS peaks, bool_or((r - l) / 50.0 < 0.05) AS narrow, bool_or(v > h) AS upright FROM rc GROUP BY user_id),
al AS (SELECT u AS user_id, segment, label, pitch_range, vertical_peak, coalesce(peaks, 0) AS peaks, coalesce(narrow, false) AS narrow, coalesce(upright, false) AS upright FROM lv LEFT JOIN sh ON sh.user_id = lv.user_id),
rs AS (SELECT *, CASE WHEN label = 'dribble' AND NOT narrow THEN 'no narrow impact' WHEN label = 'dribble' AND NOT upright THEN 'not vertical' WHEN label = 'shot' AND pitch_range < 0.01 THEN 'no pitch' WHEN label = 'shot' AND pitch_range < 80 THEN 'little pitch' WHEN label = 'shot' AND vertical_peak < 2.0 THEN 'weak peak' ELSE '' END AS reason FROM al)
SELECT user_id, segment, label, round(pitch_range, 6) AS pitch_range, round(vertical_peak, 6) AS vertical_peak, peaks, narrow, upright, reason, reason NOT IN ('', 'no pitch') AS suspicious FROM rs""")
def physical_check(spark, d):
    """Whether segments can be the dribble or shot that they are said to be, and why not."""
    s = samples(spark, d).withColumns({"segment": F.floor(F.col("i") / 16), "v": F.col("x") - 30, "up": F.col("x") / 50})
    s = s.withColumn("label", F.when((F.col("user_id") + F.col("segment")) % 2 == 0, "dribble").otherwise("shot"))
    c = K.validated(s, ["user_id", "segment"], ORDER, "label", "v", "y", "y", "up", 50.0, 0.05, 1.5, 80.0, 2.0)
    return c.withColumns({n: r6(F.col(n)) for n in ("pitch_range", "vertical_peak")})


@query(f"WITH {SAMPLES}, c AS (SELECT label, count(*) AS n FROM ev GROUP BY label), k AS (SELECT CAST(floor(1.5 * (SELECT max(n) FROM c WHERE label <> 'unknown')) AS BIGINT) AS most) SELECT label, CASE WHEN label = 'unknown' THEN least(n, most) ELSE n END AS n FROM c, k")
def undersampled_counts(spark, d):
    """Rows of each class when the unknown ones are cut to half more than the largest other class."""
    return E.undersampled(samples(spark, d), "label", "unknown", "user_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- resampling

_GRID = f"""{SAMPLES}, s AS (SELECT user_id, us, x FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, us ORDER BY seq) = 1), b AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM s GROUP BY user_id),
g AS (SELECT user_id, CAST(unnest(range(0, (hi - lo) // 21600000000 + 1)) AS INT) AS k, lo FROM b), p AS (SELECT user_id, k, lo + CAST(k AS BIGINT) * 21600000000 AS t FROM g)"""


@query(f"""WITH {_GRID}, q AS (SELECT p.user_id, p.k, p.t, a.us AS t0, a.x AS x0 FROM p ASOF JOIN s a ON p.user_id = a.user_id AND p.t >= a.us), z AS (SELECT q.*, c.us AS t1, c.x AS x1 FROM q ASOF LEFT JOIN s c ON q.user_id = c.user_id AND q.t <= c.us)
SELECT user_id, k, t AS us, round(CASE WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, 6) AS x FROM z""")
def uniform_resample(spark, d):
    s = R.first_of_each(samples(spark, d), BY, "us", ["seq"])
    return R.uniform_grid(s, BY, "us", ["x"], 21_600_000_000).select("user_id", "k", "us", r6(F.col("x")).alias("x"))


@query(f"""WITH {SAMPLES}, s AS (SELECT user_id % 10 AS rec, node, us, min(x) AS x FROM ev GROUP BY ALL), e AS (SELECT rec, node, min(us) AS a, max(us) AS b FROM s GROUP BY ALL), b AS (SELECT rec, max(a) AS lo, min(b) AS hi FROM e GROUP BY rec HAVING max(a) <= min(b)),
g AS (SELECT rec, lo, CAST(unnest(range(0, (hi - lo) // 3600000000 + 1)) AS INT) AS k FROM b), p AS (SELECT g.rec, node, k, lo + CAST(k AS BIGINT) * 3600000000 AS t FROM g JOIN e USING (rec)),
q AS (SELECT p.rec, p.node, p.k, p.t, a.us AS t0, a.x AS x0 FROM p ASOF JOIN s a ON p.rec = a.rec AND p.node = a.node AND p.t >= a.us), z AS (SELECT q.*, c.us AS t1, c.x AS x1 FROM q ASOF LEFT JOIN s c ON q.rec = c.rec AND q.node = c.node AND q.t <= c.us),
l AS (SELECT rec, k, t AS us, node, CASE WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END AS x FROM z)
SELECT rec, k, us, {', '.join(f'round(min(CASE WHEN node = {n} THEN x END), 6) AS x_n{n}' for n in range(1, 5))} FROM l GROUP BY rec, k, us""")
def common_grid(spark, d):
    """All nodes of a recording on one clock over the time that they share."""
    s = samples(spark, d).withColumn("rec", F.col("user_id") % 10)
    out = R.common_grid(s, ["rec"], "node", "us", ["x"], 3_600_000_000, [1, 2, 3, 4])
    return out.withColumns({f"x_n{n}": r6(F.col(f"x_n{n}")) for n in range(1, 5)})


@query(f"""WITH {SAMPLES}, a AS (SELECT user_id, list(x ORDER BY us, seq) AS s FROM ev GROUP BY user_id), p AS (SELECT user_id, s, unnest(range(0, 21)) AS j FROM a), q AS (SELECT *, j * (len(s) - 1) / 20.0 AS pos FROM p), f AS (SELECT *, greatest(0, least(CAST(floor(pos) AS INT), len(s) - 2)) AS b FROM q)
SELECT user_id, CAST(j AS INT) AS j, round(s[b + 1] + (s[b + 2] - s[b + 1]) * (pos - b), 6) AS x FROM f""")
def stretch_to_length(spark, d):
    a = samples(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "x"))), lambda v: v["x"]).alias("s"))
    return a.select("user_id", F.posexplode(R.stretched(F.col("s"), 21)).alias("j", "x")).withColumn("x", r6(F.col("x")))


@query(f"""WITH {SAMPLES}, a AS (SELECT user_id, list(x ORDER BY us, seq) AS s FROM ev GROUP BY user_id), p AS (SELECT user_id, s, (len(s) - 1) / 3.0 AS piv, unnest(range(0, 21)) AS j FROM a), q AS (SELECT *, CASE WHEN j <= 0.47 * 20 THEN j / (0.47 * 20) * piv ELSE piv + (j - 0.47 * 20) / (20 - 0.47 * 20) * (len(s) - 1 - piv) END AS pos FROM p), f AS (SELECT *, greatest(0, least(CAST(floor(pos) AS INT), len(s) - 2)) AS b FROM q)
SELECT user_id, CAST(j AS INT) AS j, round(s[b + 1] + (s[b + 2] - s[b + 1]) * (pos - b), 5) AS x FROM f""")
def warp_on_release(spark, d):
    a = samples(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "x"))), lambda v: v["x"]).alias("s"))
    return a.select("user_id", F.posexplode(R.warped(F.col("s"), 21, (F.size("s") - 1) / 3.0, 0.47)).alias("j", "x")).withColumn("x", F.round("x", 5))


@query(f"""WITH {SAMPLES}, g AS (SELECT user_id, seq, us, i, CASE WHEN y >= 35 THEN x END AS x FROM ev), f AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(x IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM g
 WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, seq, round(CASE WHEN i1 IS NULL OR i1 = i0 THEN x0 ELSE x0 + (x1 - x0) * (i - i0) / (i1 - i0) END, 6) AS x FROM f WHERE i0 IS NOT NULL""")
def visibility_fill(spark, d):
    return R.gated(samples(spark, d), BY, ORDER, ["x"], "y", 35.0).select("user_id", "seq", r6(F.col("x")).alias("x"))


_GATED = f"""{SAMPLES}, gt AS (SELECT user_id, seq, us, i, CASE WHEN y >= 35 THEN x END AS x FROM ev), gf AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS x0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(x IGNORE NULLS) OVER a AS x1, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM gt
 WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT user_id, seq, i, CASE WHEN i1 IS NULL OR i1 = i0 THEN x0 ELSE x0 + (x1 - x0) * (i - i0) / (i1 - i0) END AS x FROM gf WHERE i0 IS NOT NULL)"""


@query(f"WITH {_GATED} SELECT user_id, seq, round(sum(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS x FROM fl")
def visibility_smooth(spark, d):
    """Values of low visibility filled, then smoothed over five rows."""
    return R.gated(samples(spark, d), BY, ORDER, ["x"], "y", 35.0, smooth=5).select("user_id", "seq", r6(F.col("x")).alias("x"))


# ---- robust statistics

@query(f"""WITH {SAMPLES}, m AS (SELECT user_id, quantile_cont(x, 0.5) AS m FROM ev GROUP BY user_id), a AS (SELECT user_id, quantile_cont(abs(x - m), 0.5) * 1.4826 AS mad, stddev_pop(x) AS sd FROM ev JOIN m USING (user_id) GROUP BY user_id)
SELECT user_id, seq, round((x - m) / CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS z FROM ev JOIN m USING (user_id) JOIN a USING (user_id)""")
def robust_z(spark, d):
    return B.robust_z(samples(spark, d), BY, "x").select("user_id", "seq", r6(F.col("z")).alias("z"))


@query(f"""WITH {SAMPLES}, q AS (SELECT user_id, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM ev GROUP BY user_id) SELECT seq, round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), x)), 6) AS clipped FROM ev JOIN q USING (user_id)""")
def iqr_clip(spark, d):
    return B.iqr_clip(samples(spark, d), BY, "x", 1.5).select("seq", r6(F.col("clipped")).alias("clipped"))


@query(f"""WITH {SAMPLES} SELECT seq, round((x - avg(x) OVER p) / CASE WHEN stddev_samp(x) OVER p <= 1e-9 THEN 1 ELSE stddev_samp(x) OVER p END, 6) AS z, round((x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-8), 6) AS z0 FROM ev WINDOW p AS (PARTITION BY user_id)""")
def zscores(spark, d):
    z = B.zscore(samples(spark, d), BY, "x").withColumnRenamed("z", "z1")
    return B.zscore(z, BY, "x", sample=False, add=1e-8).select("seq", r6(F.col("z1")).alias("z"), r6(F.col("z")).alias("z0"))


@query(f"""WITH {SAMPLES}, m AS (SELECT user_id, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM ev GROUP BY user_id), a AS (SELECT user_id, quantile_cont(abs(x - mx), 0.5) * 1.4826 AS dx, quantile_cont(abs(y - my), 0.5) * 1.4826 AS dy FROM ev JOIN m USING (user_id) GROUP BY user_id)
SELECT seq, round(0.45 * abs((x - mx) / dx) + 0.55 * abs((y - my) / dy), 6) AS energy FROM ev JOIN m USING (user_id) JOIN a USING (user_id)""")
def fused_energy(spark, d):
    z = B.robust_z(B.robust_z(samples(spark, d), BY, "x").withColumnRenamed("z", "zx"), BY, "y")
    return z.select("seq", r6(C.fused_energy(F.col("zx"), F.col("z"))).alias("energy"))


_AXES = {"x": "x", "y": "y", "s": "x + y", "t": "x - y", "u": "x * 0.5 + y", "v": "y - x * 0.25"}


@query(f"""WITH {SAMPLES}, ax AS (SELECT user_id, seq, {", ".join(f"{e} AS c_{n}" for n, e in _AXES.items())} FROM ev), m AS (SELECT user_id, {", ".join(f"quantile_cont(c_{n}, 0.5) AS m_{n}" for n in _AXES)} FROM ax GROUP BY user_id),
a AS (SELECT user_id, {", ".join(f"quantile_cont(abs(c_{n} - m_{n}), 0.5) * 1.4826 AS d_{n}" for n in _AXES)} FROM ax JOIN m USING (user_id) GROUP BY user_id)
SELECT seq, round(0.45 * ({" + ".join(f"abs((c_{n} - m_{n}) / d_{n})" for n in "xys")}) / 3 + 0.55 * ({" + ".join(f"abs((c_{n} - m_{n}) / d_{n})" for n in "tuv")}) / 3, 6) AS energy FROM ax JOIN m USING (user_id) JOIN a USING (user_id)""")
def fused_energy_axes(spark, d):
    """Energy of a node by the mean over three axes of either sensor."""
    rows = samples(spark, d).select(*BY, "seq", *[F.expr(e).alias(f"c_{n}") for n, e in _AXES.items()])
    for n in _AXES:
        rows = B.robust_z(rows, BY, f"c_{n}").withColumnRenamed("z", f"z_{n}")
    z = lambda names: [F.col(f"z_{n}") for n in names]
    return rows.select("seq", r6(C.fused_energy(z("xys"), z("tuv"))).alias("energy"))


@query(f"""WITH {SAMPLES} SELECT user_id, 'x' AS "column", round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(x) AS n FROM ev GROUP BY user_id UNION ALL SELECT user_id, 'y', round(avg(y), 6), round(stddev_samp(y), 6), count(y) FROM ev GROUP BY user_id""")
def zscore_stats(spark, d):
    """What each recording is scaled by."""
    s = B.zscore_stats(samples(spark, d), BY, ["x", "y"])
    return s.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(f"""WITH {SAMPLES}, l AS (SELECT 'x' AS "column", x AS v FROM ev UNION ALL SELECT 'y', y FROM ev) SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM l GROUP BY 1""")
def described(spark, d):
    """Count, mean, deviation and quartiles of two channels."""
    t = Q.described(samples(spark, d), ["x", "y"])
    return t.withColumns({c: r6(c) for c in ("mean", "std", "q25", "q50", "q75")})


# ---- segments and labels

@query(f"""WITH {SAMPLES}, q AS (SELECT user_id, quantile_cont(x, 0.1) AS q FROM ev GROUP BY user_id), l AS (SELECT ev.*, last_value(CASE WHEN x > 5 * q THEN true WHEN x < 2 * q THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM ev JOIN q USING (user_id)),
n AS (SELECT *, coalesce(st, false) AS act FROM l), s AS (SELECT *, CASE WHEN lag(act) OVER o IS NOT DISTINCT FROM act AND i > 0 THEN 0 ELSE 1 END AS b FROM n {_W}), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, seq) AS run FROM s), g AS (SELECT user_id, min(us) AS a, max(us) AS b, count(*) AS n FROM r WHERE act GROUP BY user_id, run),
h AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 43200000000 THEN 0 ELSE 1 END AS nw FROM g), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a) AS segment FROM h)
SELECT user_id, min(a) AS start, max(b) AS "end", CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY user_id, segment HAVING sum(n) >= 2""")
def hysteresis_segments(spark, d):
    return S.hysteresis(samples(spark, d), BY, ORDER, "x", gap=43_200_000_000, least=2).select("user_id", "start", "end", "n")


#: Active segments in SQL: k has their parts.
_SEGMENTS = f"""q AS (SELECT user_id, quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.9) AS c FROM ev GROUP BY user_id), n AS (SELECT ev.*, x > greatest(b + 0.25 * (c - a), 1.5 * a) AS act FROM ev JOIN q USING (user_id)),
s AS (SELECT *, CASE WHEN lag(act) OVER o IS NOT DISTINCT FROM act AND i > 0 THEN 0 ELSE 1 END AS bb FROM n {_W}), r AS (SELECT *, sum(bb) OVER (PARTITION BY user_id ORDER BY us, seq) AS run FROM s), g AS (SELECT user_id, min(us) AS a, max(us) AS b, count(*) AS n FROM r WHERE act GROUP BY user_id, run HAVING count(*) >= 2),
h AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 86400000000 THEN 0 ELSE 1 END AS nw FROM g), k AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a) AS segment FROM h)"""


@query(f"""WITH {SAMPLES}, {_SEGMENTS}
SELECT user_id, CAST(segment AS BIGINT) AS segment, min(a) AS start, max(b) AS "end", CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY user_id, segment""")
def adaptive_segments(spark, d):
    return S.adaptive(samples(spark, d), BY, ORDER, "x", 2, 86_400_000_000)


@query(f"""WITH {SAMPLES}, q AS (SELECT user_id, quantile_cont(x, 0.1) AS q, min(us) AS a, max(us) AS b FROM ev GROUP BY user_id) SELECT seq, CASE WHEN x < 1.5 * q OR us < a + 86400000000 OR us > b - 86400000000 THEN 'null' ELSE label END AS assigned FROM ev JOIN q USING (user_id)""")
def continuous_labels(spark, d):
    return S.continuous_labels(samples(spark, d), BY, ORDER, "x", "us", "label", 86_400_000_000).select("seq", "assigned")


@query(f"""WITH {SAMPLES}, {windows_sql(10, 4)}, e AS (SELECT user_id, window_id, sqrt(avg(x * x)) AS e FROM w GROUP BY ALL), q AS (SELECT user_id, quantile_cont(e, 0.1) AS rest FROM e GROUP BY user_id),
m AS (SELECT w.user_id, w.i, max(e) AS most FROM w JOIN e USING (user_id, window_id) GROUP BY ALL)
SELECT ev.user_id, ev.seq, CASE WHEN rest IS NULL OR coalesce(most, 0) < 1.5 * rest OR i < 3 OR i >= count(*) OVER (PARTITION BY ev.user_id) - 3 THEN 'null' ELSE label END AS assigned FROM ev LEFT JOIN m USING (user_id, i) LEFT JOIN q USING (user_id)""")
def smeared_labels(spark, d):
    return S.smeared_labels(samples(spark, d), BY, ORDER, "x", "label", 10, 4, 3).select("user_id", "seq", "assigned")


@query(f"""WITH {SAMPLES}, {windows_sql(10, 4)}, we AS (SELECT user_id, window_id, sqrt(avg(x * x)) AS e FROM w GROUP BY ALL), wq AS (SELECT user_id, quantile_cont(e, 0.1) AS rest FROM we GROUP BY user_id),
wm AS (SELECT w.user_id, w.i, max(e) AS most FROM w JOIN we USING (user_id, window_id) GROUP BY ALL), {_SEGMENTS},
f AS (SELECT user_id, min(a) AS a, max(b) AS b FROM k GROUP BY user_id, segment), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS c, CASE WHEN user_id % 3 = 0 THEN ['catch', 'aim', 'throw'] ELSE ['run', 'stop'] END AS names FROM f),
u AS (SELECT * FROM p WHERE j < CASE WHEN c < len(names) THEN c ELSE c - c % len(names) END)
SELECT ev.user_id, seq, CASE WHEN rest IS NULL OR coalesce(most, 0) < 1.5 * rest OR i < 3 OR i >= count(*) OVER (PARTITION BY ev.user_id) - 3 THEN 'null' ELSE 'walk' END AS assigned, CAST(0 AS BIGINT) AS cycle FROM ev LEFT JOIN wm USING (user_id, i) LEFT JOIN wq USING (user_id) WHERE user_id % 4 IN (0, 2)
UNION ALL SELECT ev.user_id, seq, coalesce(names[j % len(names) + 1], 'null'), coalesce(j // len(names), -1) FROM ev LEFT JOIN u ON ev.user_id = u.user_id AND us BETWEEN a AND b WHERE ev.user_id % 4 = 1
UNION ALL SELECT user_id, seq, 'null', -1 FROM ev WHERE user_id % 4 = 3""")
def routed_labels(spark, d):
    """Labels by the kind of each recording: one action throughout, separate actions in a cycle, or not known."""
    s = samples(spark, d)
    kind = F.when(F.col("user_id") % 2 == 0, "continuous").when(F.col("user_id") % 4 == 1, "discrete").otherwise("other")
    names = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("walk"))).when(F.col("user_id") % 3 == 0, F.array(*map(F.lit, ("catch", "aim", "throw")))).otherwise(F.array(F.lit("run"), F.lit("stop")))
    recordings = s.select("user_id").distinct().select("user_id", kind.alias("kind"), names.alias("names"))
    return S.routed_labels(s, recordings, BY, ORDER, "x", 10, 4, 3, 2, 86_400_000_000).select("user_id", "seq", "assigned", "cycle")


_RELEASE = """m AS (SELECT user_id, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM ev GROUP BY user_id), a AS (SELECT user_id, quantile_cont(abs(x - mx), 0.5) * 1.4826 AS dx, quantile_cont(abs(y - my), 0.5) * 1.4826 AS dy, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM ev JOIN m USING (user_id) GROUP BY user_id),
z AS (SELECT user_id, i, 0.6 * greatest(0, (x - mx) / CASE WHEN dx > 1e-12 THEN dx WHEN sx > 1e-12 THEN sx ELSE 1 END) + 0.4 * greatest(0, (y - my) / CASE WHEN dy > 1e-12 THEN dy WHEN sy > 1e-12 THEN sy ELSE 1 END) AS raw FROM ev JOIN m USING (user_id) JOIN a USING (user_id)),
s AS (SELECT *, sum(raw) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS score, count(*) OVER (PARTITION BY user_id) AS n FROM z)"""
_PICK = """SELECT user_id, arg_min(i, (-round(score, 9), i)) AS place, round(max(score), 6) AS score, min(n) AS n FROM s WHERE i >= round_even(n * CAST(0.35 AS DOUBLE), 0) AND i < round_even(n * CAST(0.7 AS DOUBLE), 0) GROUP BY user_id"""


@query(f"WITH {SAMPLES}, {_RELEASE} {_PICK}")
def release_score(spark, d):
    return S.release_score(samples(spark, d), BY, ORDER, {"x": 0.6, "y": 0.4}).withColumn("score", r6(F.col("score")))


@query(f"""WITH {SAMPLES}, {_RELEASE.replace("AS raw FROM ev", "AS bare, ev.y FROM ev").replace("s AS (", "v AS (SELECT user_id, i, bare * greatest(0, least(1, y / 50)) AS raw FROM z), s AS (").replace("AS n FROM z)", "AS n FROM v)")}
SELECT user_id, i, round(score, 6) AS score FROM s""")
def visible_release_score(spark, d):
    """The score of every sample, weakened where it is hard to see."""
    s = S.rectified_score(samples(spark, d).withColumn("seen", F.col("y") / 50), BY, ORDER, {"x": 0.6, "y": 0.4}, 5, "seen")
    return s.select("user_id", "i", r6(F.col("score")).alias("score"))


@query(f"""WITH {SAMPLES}, {_RELEASE}, r AS ({_PICK}), g AS (SELECT user_id, i, abs(CASE WHEN lag(x) OVER o IS NULL THEN lead(x) OVER o - x WHEN lead(x) OVER o IS NULL THEN x - lag(x) OVER o ELSE (lead(x) OVER o - lag(x) OVER o) / 2 END) AS g FROM ev {_W}),
e AS (SELECT user_id, i, sum(g) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM g),
b AS (SELECT user_id, n, place AS r, greatest(0, place - 10) AS g, greatest(0, greatest(0, place - 10) - 12) AS f FROM r), h AS (SELECT e.*, quantile_cont(e, 0.7) OVER (PARTITION BY user_id) AS q FROM e JOIN b USING (user_id) WHERE i >= f AND i < greatest(f + 1, b.g)),
k AS (SELECT user_id, CASE WHEN count(*) < 3 THEN min(i) ELSE max(CASE WHEN e >= q THEN i END) END AS k FROM h GROUP BY user_id), x AS (SELECT user_id, k, g, greatest(r - 2, 0) AS s, least(n - 1, r + 2) AS t, least(n - 1, r + 8) AS u, n - 1 AS z FROM b JOIN k USING (user_id)),
p AS (SELECT user_id, unnest([{{'p': 'preparation', 'a': 0, 'b': greatest(k - 1, 0)}}, {{'p': 'last_dribble', 'a': k, 'b': greatest(g - 1, k)}}, {{'p': 'gather', 'a': g, 'b': greatest(s - 1, g)}}, {{'p': 'release', 'a': s, 'b': t}}, {{'p': 'follow_through', 'a': t + 1, 'b': u}}, {{'p': 'recovery', 'a': u + 1, 'b': z}}]) AS v FROM x)
SELECT user_id, v.p AS phase, v.a AS phase_start, v.b AS phase_end FROM p WHERE v.a <= v.b""")
def shot_phases(spark, d):
    """Six phases about the release, the first two parted by the last impact before the gather."""
    s, o = samples(spark, d), W.over(BY, ORDER)
    s = s.withColumn("g", F.abs(W.gradient("x", o))).withColumn("energy", W.moving_average("g", o, 5))
    r = S.release_score(s, BY, ORDER, {"x": 0.6, "y": 0.4}).select("user_id", F.col("place").alias("release"), "n")
    return S.shot_phases(S.last_impact(s, r, BY, "i", "energy", 10, 12), 2, 10, 8).select("user_id", "phase", "phase_start", "phase_end")


@query(f"""WITH {SAMPLES}, p AS (SELECT *, coalesce(x > lag(x) OVER o AND x > lead(x) OVER o AND x > 100, false) AS p FROM ev {_W}), k AS (SELECT *, sum(p::INT) OVER (PARTITION BY user_id ORDER BY us, seq) AS k FROM p), v AS (SELECT user_id, k, arg_min(us, (x, us)) AS valley FROM k WHERE NOT p GROUP BY ALL)
SELECT k.user_id, CAST(k.k AS BIGINT) AS k, k.us AS peak, l.valley AS "left", r.valley AS "right" FROM k LEFT JOIN v l ON l.user_id = k.user_id AND l.k = k.k - 1 LEFT JOIN v r ON r.user_id = k.user_id AND r.k = k.k WHERE p""")
def peak_segments(spark, d):
    return S.between_peaks(samples(spark, d), BY, ORDER, "x", 100.0)


_PHASES = {"gather": (-3.0, -1.0), "raise": (-1.0, 0.0), "release": (0.0, 0.5), "follow": (0.5, 2.0)}


@query("""WITH e AS (SELECT o_orderkey, o_custkey % 5 AS s, o_custkey % 5 + 2 AS r, o_custkey % 5 + 3 AS e FROM orders), p AS (SELECT o_orderkey, unnest([0, 1, 2, 3]) AS phase_no, s, r, e FROM e),
q AS (SELECT o_orderkey, phase_no, ['gather', 'raise', 'release', 'follow'][phase_no + 1] AS phase, greatest(s, r + [-3.0, -1.0, 0.0, 0.5][phase_no + 1])::DOUBLE AS phase_start, least(e, r + [-1.0, 0.0, 0.5, 2.0][phase_no + 1])::DOUBLE AS phase_end FROM p)
SELECT * FROM q WHERE phase_start < phase_end""")
def phase_split(spark, d):
    k = (F.col("o_custkey") % 5).cast("double")
    e = table(spark, d, "orders").select("o_orderkey", k.alias("s"), (k + 2).alias("r"), (k + 3).alias("e"))
    return S.phases(e, "s", "r", "e", _PHASES).select("o_orderkey", "phase_no", "phase", "phase_start", "phase_end")


@query(f"""WITH {SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, arg_min(i, (-x, i)) AS place, max(x) AS score FROM n WHERE i >= floor(0.35 * n) AND i < floor(0.7 * n) GROUP BY user_id""")
def release_point(spark, d):
    return S.best_in_share(samples(spark, d), BY, "i", "x", 0.35, 0.7)


@query(f"""WITH {SAMPLES}, k AS (SELECT user_id, seq, label, ['click', 'view', 'signup'][CAST((row_number() OVER o - 1) % 3 + 1 AS INT)] AS expected FROM ev {_W}) SELECT user_id, seq, expected, expected = label AS conforms FROM k""")
def cycle_conformance(spark, d):
    return S.conformance(samples(spark, d), BY, ORDER, "label", ["click", "view", "signup"]).select("user_id", "seq", "expected", "conforms")


@query(f"""WITH {SAMPLES}, z AS (SELECT seq, (x - avg(x) OVER (PARTITION BY user_id)) / stddev_pop(x) OVER (PARTITION BY user_id) AS z, y / 100 AS c FROM ev)
SELECT seq, abs(z) > 2.5 AS outlier, c < 0.5 AS weak, CASE WHEN abs(z) > 2.5 AND c < 0.5 THEN 'reject' WHEN abs(z) > 2.5 THEN 'check' WHEN c < 0.5 THEN 'weak' ELSE 'ok' END AS status, CASE WHEN abs(z) > 2.5 AND c < 0.5 THEN 1 WHEN abs(z) > 2.5 THEN 2 WHEN c < 0.5 THEN 3 ELSE 4 END AS priority FROM z""")
def prediction_review(spark, d):
    z = B.zscore(samples(spark, d), BY, "x", sample=False).withColumn("c", F.col("y") / 100)
    return S.review(z, "z", "c", far=2.5).select("seq", "outlier", "weak", "status", "priority")


# ---- rules, models, evaluation

_F = f"""{ITEMS}, f AS (SELECT l_suppkey, l_orderkey, max(sqrt(ax*ax + ay*ay + az*az)) AS acc_mag_max, stddev_pop(ax) AS acc_mag_std, max(ay) - min(ay) AS acc_mag_range, count(*) AS peak_count FROM li GROUP BY ALL)"""
#: Bounds of the second engine's labels, on this table's scale, and their order.
BOUNDS: U.Bounds = {
    "collision": {"acc_mag_max_min": 95.0, "peak_count_max": 2}, "jump": {"acc_mag_max_min": 85.0, "acc_mag_range_min": 20.0}, "shot": {"acc_mag_max_min": 80.0, "acc_mag_range_min": 5.0},
    "pass": {"acc_mag_max_min": 70.0, "peak_count_min": 1, "peak_count_max": 3}, "dribble": {"acc_mag_std_min": 2.5, "peak_count_min": 2}, "sprint": {"acc_mag_std_min": 0.5}, "idle": {"acc_mag_std_max": 0.2, "acc_mag_range_max": 0.6},
}
PRIORITY = ["collision", "jump", "shot", "pass", "dribble", "sprint", "idle"]


def _item_features(spark, d):
    return items(spark, d).groupBy("l_suppkey", "l_orderkey").agg(F.max(C.norm("ax", "ay", "az")).alias("acc_mag_max"), F.stddev_pop("ax").alias("acc_mag_std"), (F.max("ay") - F.min("ay")).alias("acc_mag_range"), F.count(F.lit(1)).alias("peak_count"))


@query(f"""WITH {_F} SELECT l_suppkey, l_orderkey, CASE WHEN acc_mag_max >= 95 AND peak_count <= 2 THEN 'collision' WHEN acc_mag_max >= 85 AND acc_mag_range >= 20 THEN 'jump' WHEN acc_mag_max >= 80 AND acc_mag_range >= 5 THEN 'shot'
 WHEN acc_mag_max >= 70 AND peak_count BETWEEN 1 AND 3 THEN 'pass' WHEN acc_mag_std >= 2.5 AND peak_count >= 2 THEN 'dribble' WHEN acc_mag_std >= 0.5 THEN 'sprint' WHEN acc_mag_std <= 0.2 AND acc_mag_range <= 0.6 THEN 'idle' ELSE 'unknown' END AS pred FROM f""")
def rules_priority(spark, d):
    label, _ = U.by_priority(BOUNDS, PRIORITY)
    return _item_features(spark, d).select("l_suppkey", "l_orderkey", label.alias("pred"))


@query(f"""WITH {_F} SELECT l_suppkey, l_orderkey, (acc_mag_max > 85 AND acc_mag_range > 20)::DOUBLE AS rule_jump, (acc_mag_std > 2.5 AND peak_count >= 2)::DOUBLE AS rule_dribble, (acc_mag_std < 0.2 AND acc_mag_range < 0.6)::DOUBLE AS rule_idle FROM f""")
def rules_scored(spark, d):
    s = U.scored({k: BOUNDS[k] for k in ("jump", "dribble", "idle")})
    return _item_features(spark, d).select("l_suppkey", "l_orderkey", *[c.alias(k) for k, c in s.items()])


_ALL_RULES = """(acc_mag_max > 95 AND peak_count <= 2)::INT AS collision, (acc_mag_max > 85 AND acc_mag_range > 20)::INT AS jump, (acc_mag_max > 80 AND acc_mag_range > 5)::INT AS shot, (acc_mag_max > 70 AND peak_count BETWEEN 1 AND 3)::INT AS pass,
 (acc_mag_std > 2.5 AND peak_count >= 2)::INT AS dribble, (acc_mag_std > 0.5)::INT AS sprint, (acc_mag_std < 0.2 AND acc_mag_range < 0.6)::INT AS idle"""


@query(f"""WITH {_F}, r AS (SELECT l_suppkey, l_orderkey, {_ALL_RULES} FROM f) SELECT l_suppkey, l_orderkey, collision + jump + shot + pass + dribble + sprint + idle AS met,
 CASE WHEN collision = 1 THEN 'collision' WHEN jump = 1 THEN 'jump' WHEN shot = 1 THEN 'shot' WHEN pass = 1 THEN 'pass' WHEN dribble = 1 THEN 'dribble' WHEN sprint = 1 THEN 'sprint' WHEN idle = 1 THEN 'idle' ELSE 'unknown' END AS pred FROM r""")
def rules_best(spark, d):
    """The label of the highest score of all seven rules, and how many of them are met."""
    label, _ = U.best_scored(BOUNDS)
    met = sum((c for c in U.scored(BOUNDS).values()), F.lit(0.0)).cast("int")
    return _item_features(spark, d).select("l_suppkey", "l_orderkey", met.alias("met"), label.alias("pred"))


@query(f"""WITH {_F}, v AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey % 7 END AS speed FROM f) SELECT l_suppkey, l_orderkey, CASE WHEN acc_mag_std >= 0.5 AND (speed IS NULL OR speed >= 3.5) THEN 'sprint' WHEN acc_mag_std <= 0.2 THEN 'idle' ELSE 'unknown' END AS pred FROM v""")
def rules_configured(spark, d):
    """Rules of a configuration, with a bound on speed where a row has one."""
    config = {"thresholds": {"sprint": {"acc_std_min": 0.5, "uwb_vel_min": 3.5}, "idle": {"acc_std_max": 0.2}}, "priority": ["sprint", "idle"]}
    f = _item_features(spark, d).withColumn("speed", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 7))
    bounds, priority = U.from_config(config, {"acc_std": "acc_mag_std", "uwb_vel": "speed"})
    label, _ = U.by_priority(bounds, priority, optional=("speed",), columns=f.columns)
    return f.select("l_suppkey", "l_orderkey", label.alias("pred"))


@query(f"""WITH {SAMPLES} SELECT seq, CASE WHEN x > 25 AND y < 8 THEN 'jump' WHEN x / 20 BETWEEN 1.5 AND 4.5 AND user_id % 7 >= 3 THEN 'dribble' WHEN y > 5 AND x > 12 THEN 'shot' WHEN y > 3 AND user_id % 7 <= 2 THEN 'pass' WHEN x / 20 > 0.8 AND x > 13 THEN 'sprint' ELSE 'idle' END AS rule_pred FROM ev""")
def rules_first_match(spark, d):
    label, _ = U.motion_rules(F.col("x"), F.col("x") / 20, F.col("user_id") % 7, F.col("y"))
    return samples(spark, d).select("seq", label.alias("rule_pred"))


@query(f"""WITH {SAMPLES}, p AS (SELECT seq, label, x / 500 AS p, y AS dist FROM ev) SELECT seq, CASE WHEN p < 0.05 OR dist > 80 THEN 'unknown' ELSE label END AS label, round(CASE WHEN p < 0.05 OR dist > 80 THEN 1 - p ELSE p END, 6) AS confidence FROM p""")
def open_set_rejection(spark, d):
    s = samples(spark, d)
    label, p = U.rejected(F.col("x") / 500, F.col("y"), 0.05, F.lit(80), F.col("label"))
    return s.select("seq", label.alias("label"), r6(p).alias("confidence"))


@query("SELECT doc_id, quality <> toxic AS disagree FROM labels")
def model_disagreement(spark, d):
    return table(spark, d, "labels").select("doc_id", U.disagreement(F.col("quality"), F.col("toxic")).alias("disagree"))


@query("""WITH g AS (SELECT unnest([0, 1]) AS truth), h AS (SELECT unnest([0, 1]) AS predicted) SELECT truth, predicted, (SELECT count(*) FROM labels WHERE quality = truth AND toxic = predicted) AS n FROM g, h""")
def confusion_matrix(spark, d):
    return E.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


@query("""WITH c AS (SELECT CAST(x AS VARCHAR) AS label FROM (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels)), s AS (SELECT label, (SELECT count(*) FROM labels WHERE CAST(quality AS VARCHAR) = label AND quality = toxic) AS tp, (SELECT count(*) FROM labels WHERE CAST(quality AS VARCHAR) = label) AS support, (SELECT count(*) FROM labels WHERE CAST(toxic AS VARCHAR) = label) AS found FROM c)
SELECT label, tp, support, found, round(CASE WHEN found > 0 THEN tp / found ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(2 * tp / (support + found), 6) AS f1 FROM s""")
def class_scores(spark, d):
    s = E.class_scores(table(spark, d, "labels"), "quality", "toxic")
    return s.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@query("""WITH c AS (SELECT unnest([0, 1]) AS k), s AS (SELECT k, (SELECT count(*) FROM labels WHERE quality = k AND toxic = k) AS tp, (SELECT count(*) FROM labels WHERE quality = k) AS t, (SELECT count(*) FROM labels WHERE toxic = k) AS p FROM c)
SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(2 * tp / (t + p)), 6) AS macro_f1, round(avg(CASE WHEN k <> 0 THEN 2 * tp / (t + p) END), 6) AS action_f1 FROM s""")
def macro_f1(spark, d):
    s = E.overall_scores(table(spark, d, "labels"), "quality", "toxic", "0")
    return s.select(*[r6(F.col(c)).alias(c) for c in s.columns])


@query(f"""WITH {SAMPLES}, t AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3]) AS threshold), p AS (SELECT label AS truth, CASE WHEN x > 30 THEN 'view' ELSE 'click' END AS pred, x / 200 AS p FROM ev),
s AS (SELECT threshold, avg((p < threshold)::INT) AS rejected, count(*) FILTER (p >= threshold) AS kept, count(*) FILTER (p >= threshold AND truth = pred) AS rt FROM p, t GROUP BY threshold), a AS (SELECT threshold, rejected, CASE WHEN kept > 0 THEN rt / kept ELSE 0 END AS accuracy FROM s)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(rejected, 6) AS rejected, round(accuracy, 6) AS accuracy, rejected <= 0.3 AND row_number() OVER (ORDER BY CASE WHEN rejected <= 0.3 THEN 0 ELSE 1 END, accuracy DESC, threshold) = 1 AS chosen FROM a""")
def threshold_scan(spark, d):
    p = samples(spark, d).select(F.col("label").alias("truth"), F.when(F.col("x") > 30, "view").otherwise("click").alias("pred"), (F.col("x") / 200).alias("p"))
    s = E.threshold_scan(p, "truth", "pred", "p", [0.05, 0.1, 0.15, 0.2, 0.3])
    return s.withColumns({c: r6(F.col(c)) for c in ("rejected", "accuracy")})


_POINTS = [round(0.3 + 0.05 * k, 2) for k in range(14)]


@query(f"""WITH {SAMPLES}, t AS (SELECT unnest({_POINTS}) AS threshold), p AS (SELECT CASE WHEN label = 'unknown' THEN 'null' ELSE label END AS truth, CASE WHEN y > 60 THEN 'view' WHEN y > 30 THEN 'click' ELSE 'null' END AS pred, 1 - x / 200 AS p FROM ev),
s AS (SELECT threshold, 1 - avg((p >= threshold)::INT) AS rejected FROM p, t GROUP BY threshold), l AS (SELECT DISTINCT truth AS l FROM p WHERE truth <> 'null' UNION SELECT DISTINCT pred FROM p WHERE pred <> 'null'),
f AS (SELECT threshold, l, count(*) FILTER (truth = l AND pred = l AND p >= threshold) AS tp, count(*) FILTER (truth = l AND p >= threshold) + count(*) FILTER (pred = l AND truth <> 'null' AND p >= threshold) AS n FROM p, t, l GROUP BY ALL),
a AS (SELECT threshold, avg(CASE WHEN n > 0 THEN 2 * tp / n ELSE 0 END) AS f1 FROM f GROUP BY threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(rejected, 6) AS rejected, round(f1, 6) AS action_f1, row_number() OVER (ORDER BY CASE WHEN rejected <= 0.3 THEN 0 ELSE 1 END, round(f1, 12) DESC, threshold) = 1 AS chosen FROM s JOIN a USING (threshold)""")
def working_point(spark, d):
    p = samples(spark, d).select(F.when(F.col("label") == "unknown", "null").otherwise(F.col("label")).alias("truth"), F.when(F.col("y") > 60, "view").when(F.col("y") > 30, "click").otherwise("null").alias("pred"), (1 - F.col("x") / 200).alias("p"))
    s = E.working_point(p, "truth", "pred", "p", _POINTS, "null")
    return s.withColumns({c: r6(F.col(c)) for c in ("rejected", "action_f1")})


@query(f"""WITH {SAMPLES}, r AS (SELECT user_id, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR))) <= floor(0.7 * count(*) OVER ()) AS train FROM (SELECT DISTINCT user_id FROM ev))
SELECT seq, train, ('0x' || substr(md5(CAST(seq AS VARCHAR)), 1, 8))::BIGINT / 4294967296 < 0.8 AS random_train FROM ev JOIN r USING (user_id)""")
def train_splits(spark, d):
    """Whole recordings, and single rows, for training."""
    s = E.split_recordings(samples(spark, d), "user_id", 0.7)
    return s.select("seq", "train", E.hashed_share(F.col("seq"), 0.8).alias("random_train"))


_LONG = "lf AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _long(spark, d):
    return E.long_form(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding")


@query(f"""WITH {_LONG}, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM lf GROUP BY ALL), h AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM g GROUP BY feature),
s AS (SELECT feature, sum(n * pow(m - gm, 2)) AS b, sum(n * v) AS w, count(*) AS k, sum(n) AS n FROM g JOIN h USING (feature) GROUP BY feature) SELECT feature, round((b / (k - 1)) / (w / (n - k)), 5) AS f FROM s""")
def anova_f(spark, d):
    return E.anova_f(_long(spark, d), "label").withColumn("f", F.round("f", 5))


@query(f"""WITH {_LONG}, g AS (SELECT feature, count(*) FILTER (label = 0) AS na, count(*) FILTER (label = 1) AS nb, avg(x) FILTER (label = 0) AS ma, avg(x) FILTER (label = 1) AS mb, var_samp(x) FILTER (label = 0) AS va, var_samp(x) FILTER (label = 1) AS vb FROM lf GROUP BY feature)
SELECT feature, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 5) AS t FROM g""")
def t_statistic(spark, d):
    return E.t_statistic(_long(spark, d), "label", 0, 1).withColumn("t", F.round("t", 5))


@query(f"""WITH {_LONG}, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM lf GROUP BY ALL)
SELECT a.feature, a.label AS class_a, b.label AS class_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 5) AS d FROM g a JOIN g b ON a.feature = b.feature AND a.label < b.label""")
def cohens_d(spark, d):
    return E.cohens_d(_long(spark, d), "label").withColumn("d", F.round("d", 5))


@query(f"""WITH {_LONG}, g AS (SELECT feature, label, avg(x) AS m, var_pop(x) AS v FROM lf GROUP BY ALL)
SELECT a.label AS class_a, b.label AS class_b, round(sum(0.25 * pow(a.m - b.m, 2) / (a.v + b.v + 2e-9) + 0.5 * ln((a.v + b.v + 2e-9) / (2 * sqrt((a.v + 1e-9) * (b.v + 1e-9))))), 5) AS distance FROM g a JOIN g b ON a.feature = b.feature AND a.label < b.label GROUP BY ALL""")
def class_distances(spark, d):
    return E.bhattacharyya(_long(spark, d), "label").withColumn("distance", F.round("distance", 5))


@query("""WITH q AS (SELECT q.vec_id AS qid, q.label AS own, t.label, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(t.embedding[i] AS DOUBLE), 2)))) AS d FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 50 = 0),
m AS (SELECT qid, own, label, avg(d) AS d FROM q GROUP BY ALL), s AS (SELECT qid, own, max(CASE WHEN label = own THEN d END) AS a, min(CASE WHEN label <> own THEN d END) AS b FROM m GROUP BY ALL)
SELECT qid, own AS label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM s""")
def silhouette(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return E.silhouette(e.where("id % 50 = 0").select(F.col("id").alias("qid"), "v", "label"), e).withColumn("s", r6(F.col("s")))


@query("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY label")
def class_weights(spark, d):
    return E.class_weights(table(spark, d, "embeddings"), "label").withColumn("weight", r6(F.col("weight")))


@query(f"""WITH {SAMPLES}, r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM label THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY us, seq) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY node ORDER BY us, seq) AS before FROM ev)),
s AS (SELECT node, label, run, dense_rank() OVER (PARTITION BY node, label ORDER BY run) - 1 AS ordinal, row_number() OVER (PARTITION BY node, run ORDER BY us, seq) - 1 AS pos, x FROM r WHERE label IN ('click', 'view')),
p AS (SELECT a.label, a.ordinal, count(*) AS n, corr(a.x, b.x) AS r, stddev_pop(a.x) AS sa, stddev_pop(b.x) AS sb FROM s a JOIN s b USING (label, ordinal, pos) WHERE a.node = 1 AND b.node = 2 GROUP BY ALL)
SELECT label, ordinal, n, round(CASE WHEN sa < 1e-12 OR sb < 1e-12 OR r IS NULL OR isnan(r) THEN 0 ELSE r END, 6) AS r FROM p WHERE n >= 2""")
def segment_similarity(spark, d):
    s = M.labelled_segments(samples(spark, d), ["node"], ORDER, "label", ["click", "view"])
    return M.segment_correlations(s.where("node = 1"), s.where("node = 2"), ["label"], "x").withColumn("r", r6(F.col("r")))


@query(f"""WITH {SAMPLES}, r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM label THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY us, seq) AS run FROM (SELECT *, lag(label) OVER (PARTITION BY node ORDER BY us, seq) AS before FROM ev)),
s AS (SELECT node, label, run, dense_rank() OVER (PARTITION BY node, label ORDER BY run) - 1 AS ordinal, row_number() OVER (PARTITION BY node, run ORDER BY us, seq) - 1 AS pos, x FROM r WHERE label IN ('click', 'view', 'purchase')),
p AS (SELECT a.label, a.ordinal, count(*) AS n, corr(a.x, b.x) AS r, stddev_pop(a.x) AS sa, stddev_pop(b.x) AS sb FROM s a JOIN s b USING (label, ordinal, pos) WHERE a.node = 1 AND b.node = 3 GROUP BY ALL)
SELECT label, ordinal, n, round(r, 6) AS r FROM p WHERE n >= 3 AND sa >= 1e-12 AND sb >= 1e-12 AND r IS NOT NULL AND NOT isnan(r)""")
def three_action_similarity(spark, d):
    """Segments of three actions of at least three samples; those that do not vary are left out."""
    s = M.labelled_segments(samples(spark, d), ["node"], ORDER, "label", ["click", "view", "purchase"])
    return M.segment_correlations(s.where("node = 1"), s.where("node = 3"), ["label"], "x", flat=None, least=3).withColumn("r", r6(F.col("r")))


_JOINTS = ["left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip"]
_POSE = f"""{SAMPLES}, jn AS (SELECT unnest(range(0, 8)) AS j, unnest({_JOINTS!r}) AS joint), ps AS (SELECT user_id, i AS frame, joint, x / 100 + j AS px, y / 100 - j % 2 AS py, (x - y) / 200 + j * 0.5 AS pz FROM ev, jn WHERE i < 24),
ct AS (SELECT user_id, frame, avg(CASE WHEN joint LIKE '%_hip' THEN px END) AS rx, avg(CASE WHEN joint LIKE '%_hip' THEN py END) AS ry, avg(CASE WHEN joint LIKE '%_hip' THEN pz END) AS rz, avg(CASE WHEN joint LIKE '%_shoulder' THEN px END) AS sx, avg(CASE WHEN joint LIKE '%_shoulder' THEN py END) AS sy, avg(CASE WHEN joint LIKE '%_shoulder' THEN pz END) AS sz FROM ps GROUP BY ALL),
sc AS (SELECT user_id, 1.75 * 0.29 / greatest(quantile_cont(sqrt(pow(sx - rx, 2) + pow(sy - ry, 2) + pow(sz - rz, 2)), 0.5), 1e-6) AS k FROM ct GROUP BY user_id),
tm AS (SELECT frame, joint, quantile_cont((px - rx) * k, 0.5) AS x, quantile_cont(-(pz - rz) * k, 0.5) AS y, quantile_cont(-(py - ry) * k, 0.5) AS z, count(*) AS n FROM ps JOIN ct USING (user_id, frame) JOIN sc USING (user_id) GROUP BY ALL)"""


def _template(spark, d):
    s = samples(spark, d).where("i < 24")
    joints = s.select("user_id", F.col("i").alias("frame"), "x", "y", F.posexplode(F.array(*[F.lit(j) for j in _JOINTS])).alias("j", "joint"))
    pose = joints.select("user_id", "frame", "joint", (F.col("x") / 100 + F.col("j")).alias("x"), (F.col("y") / 100 - F.col("j") % 2).alias("y"), ((F.col("x") - F.col("y")) / 200 + F.col("j") * 0.5).alias("z"))
    return T.skeleton_template(pose, ["user_id"], "frame", "joint")


@query(f"WITH {_POSE} SELECT frame, joint, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n FROM tm")
def skeleton_template(spark, d):
    """Median skeleton of all recordings, frame by frame."""
    return _template(spark, d).withColumns({a: r6(a) for a in "xyz"})


@query(f"""WITH {_POSE}, wn AS (SELECT user_id, count(*) AS n, arg_min(i, {{'x': -x, 'i': i}}) AS rel, 0.9 + (user_id % 5) * 0.05 AS s1, 1.1 - (user_id % 3) * 0.1 AS s2, 1.0 + (user_id % 7) * 0.02 AS s3 FROM ev GROUP BY user_id),
fr AS (SELECT *, unnest(range(0, n)) AS frame FROM wn), pl AS (SELECT *, CASE WHEN frame <= rel THEN frame / greatest(rel, 1) * 11 ELSE 11 + (frame - rel) / greatest(n - 1 - rel, 1) * 12 END AS pos FROM fr),
ix AS (SELECT *, greatest(0, least(CAST(floor(pos) AS BIGINT), 22)) AS k FROM pl),
at AS (SELECT ix.user_id, ix.frame, a.joint, a.x + (b.x - a.x) * (pos - k) AS x, a.y + (b.y - a.y) * (pos - k) AS y, a.z + (b.z - a.z) * (pos - k) AS z, s1, s2, s3 FROM ix JOIN tm a ON a.frame = k JOIN tm b ON b.frame = k + 1 AND b.joint = a.joint),
w AS (SELECT user_id, frame, any_value(s1) AS s1, any_value(s2) AS s2, any_value(s3) AS s3, {", ".join(f"max({a}) FILTER (joint = '{j}') AS {j}_{a}" for j in _JOINTS for a in "xyz")} FROM at GROUP BY ALL),
e AS (SELECT *, {", ".join(f"{side}_shoulder_{a} + ({side}_elbow_{a} - {side}_shoulder_{a}) * (1 + 0.15 * ({s} - 1)) AS {side}_e_{a}" for side, s in (("right", "s1"), ("left", "s3")) for a in "xyz")} FROM w)
SELECT user_id, frame, round(frame / 50.0, 6) AS time_s, {", ".join(f"round({side}_e_{a}, 6) AS {side}_elbow_{a}, round({side}_e_{a} + ({side}_wrist_{a} - {side}_elbow_{a}) * (1 + 0.15 * ({s} - 1)), 6) AS {side}_wrist_{a}" for side, s in (("right", "s2"), ("left", "s3")) for a in "xyz")}, {", ".join(f"round((left_hip_{a} + right_hip_{a}) / 2, 6) AS hips_{a}" for a in "xyz")} FROM e""".replace("at AS (SELECT ix", "atj AS (SELECT ix").replace("FROM at GROUP", "FROM atj GROUP"))
def fused_animation(spark, d):
    """The template at the pace of each recording, its arms scaled."""
    s = samples(spark, d)
    w = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("i", F.struct(-F.col("x"), "i")).alias("release"))
    w = w.withColumns({"s1": 0.9 + (F.col("user_id") % 5) * 0.05, "s2": 1.1 - (F.col("user_id") % 3) * 0.1, "s3": 1.0 + (F.col("user_id") % 7) * 0.02})
    f = T.fused_frames(w, T.framed(_template(spark, d), "frame", "joint"), BY, 24, _JOINTS)
    parts = {f"{j}_{a}": F.col(f"joints.{j}")[k] for j in ("right_elbow", "right_wrist", "left_elbow", "left_wrist") for k, a in enumerate("xyz")}
    return f.select("user_id", "frame", r6("time_s").alias("time_s"), *[c.alias(n) for n, c in parts.items()], *[F.col("hips")[k].alias(f"hips_{a}") for k, a in enumerate("xyz")])


@query(f"""WITH {SAMPLES}, l AS (SELECT unnest(range(-5, 6)) AS lag), p AS (SELECT a.user_id, l.lag, corr(a.x, b.y) AS r FROM ev a, l JOIN ev b ON b.user_id = a.user_id AND b.i = a.i + l.lag GROUP BY ALL)
SELECT user_id, CAST(lag AS INT) AS lag, round(r, 6) AS r FROM p WHERE r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(r, 9) DESC, abs(lag), lag) = 1""")
def xcorr_lag(spark, d):
    return M.lagged_correlation(samples(spark, d).drop("i"), BY, ORDER, "x", "y", 5).withColumn("r", r6(F.col("r")))


@query(f"WITH {SAMPLES} SELECT node, i, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, round(quantile_cont(x, 0.5), 8) AS median, count(x) AS n FROM ev GROUP BY ALL")
def mean_template(spark, d):
    return M.mean_template(samples(spark, d), ["node"], "i", "x").withColumns({c: F.round(c, 8) for c in ("mean", "std", "median")})


@query(f"""WITH {SAMPLES}, t AS (SELECT i, avg(x) AS m FROM ev GROUP BY i) SELECT user_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12), 6) AS cosine, round(greatest(0.0, least(100.0, (sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12) + 1) * 50)), 5) AS score FROM ev JOIN t USING (i) GROUP BY user_id""")
def cosine_template(spark, d):
    s = samples(spark, d)
    out = M.cosine_to_template(s, M.mean_template(s, [], "i", "x"), BY, "i", "x")
    return out.select("user_id", r6(F.col("cosine")).alias("cosine"), F.round(C.consistency(F.col("cosine")), 5).alias("score"))


# ---- signal kernels and models: no SQL form, or a partial one

@query(f"""WITH {SAMPLES}, s AS (SELECT user_id, i, x, count(*) OVER (PARTITION BY user_id) AS n FROM ev QUALIFY n >= 4), f AS (SELECT user_id, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT user_id, n FROM s)),
p AS (SELECT user_id, n, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) AS a FROM s JOIN f USING (user_id, n) GROUP BY ALL)
SELECT user_id, round(arg_max(k, a) * 50.0 / min(n), 9) AS dom_freq, round(max(a * a) / (sum(a * a) + 1e-12), 5) AS dom_power, round(sum(k * 50.0 / n * a) / (sum(a) + 1e-12), 5) AS centroid FROM p GROUP BY user_id""")
def dominant_freq(spark, d):
    """The spectrum of each whole recording of four samples or more."""
    a = samples(spark, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "x"))), lambda v: v["x"]).alias("samples")).where(F.size("samples") >= 4)
    f = G.window_features(a, ["user_id"], "samples", 50.0)
    return f.select("user_id", F.round("dom_freq", 9).alias("dom_freq"), F.round("dom_power", 5).alias("dom_power"), F.round("centroid", 5).alias("centroid"))


@query(f"""WITH {SAMPLES}, {windows_sql(32, 16)}, f AS (SELECT unnest(range(1, 17)) AS k),
p AS (SELECT user_id, window_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 32)), 2) + pow(sum(x * sin(2 * pi() * k * i / 32)), 2)) AS a FROM w, f GROUP BY ALL)
SELECT user_id, window_id, arg_max(k, a) * 50 / 32.0 AS dom_freq, round(max(a * a) / (sum(a * a) + 1e-12), 5) AS dom_power, round(sum(k * 50 / 32.0 * a) / (sum(a) + 1e-12), 5) AS centroid FROM p GROUP BY ALL""")
def sliding_dominant_freq(spark, d):
    """The same of every window of a recording."""
    f = G.window_features(W.sliding_samples(samples(spark, d), BY, ORDER, "x", 32, 16), ["user_id", "window_id"], "samples", 50.0)
    return f.select("user_id", "window_id", "dom_freq", F.round("dom_power", 5).alias("dom_power"), F.round("centroid", 5).alias("centroid"))


#: Recordings are filtered in chunks of a week.
_CHUNK = 7 * 86_400_000_000
_LOW, _HIGH, _BAND = N.butterworth(3, 8.0, 50.0), N.butterworth(4, 0.5, 50.0, True), N.bandpass(4, 1.0, 8.0, 50.0)


@query(filtered_query(System.of_filter(*_LOW), 12))
def butter_lowpass(spark, d):
    return G.smoothed(samples(spark, d), BY, ORDER, "x", 8.0, 50.0, 3, span=_CHUNK).select(*BY, *ORDER, "x", r6("x_filtered").alias("x_filtered"))


@query(f"""WITH {SAMPLES}, s AS (SELECT *, CASE WHEN lag(x) OVER o = x THEN 0 ELSE 1 END AS st FROM ev {_W}), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY us, seq) AS run FROM s), l AS (SELECT user_id, run, min(x) AS level, (min(i) + max(i)) // 2 AS middle FROM r GROUP BY ALL),
p AS (SELECT *, coalesce(level > lag(level) OVER q AND level > lead(level) OVER q, false) AS top FROM l WINDOW q AS (PARTITION BY user_id ORDER BY run)) SELECT r.user_id, us, seq, x, top AND i = middle AS is_peak FROM r JOIN p USING (user_id, run)""")
def find_peaks(spark, d):
    """Local maxima of all samples; a flat top counts once, at its middle."""
    return G.peaks(samples(spark, d), BY, ORDER, "x")


@query(f"WITH RECURSIVE {SAMPLES}, {peaks_sql()}, {far_sql(4)} SELECT ev.user_id, us, seq, x, coalesce(prominence >= 20.0, false) AS is_peak FROM ev LEFT JOIN far ON far.user_id = ev.user_id AND far.i = ev.i")
def prominent_far_peaks(spark, d):
    return G.peaks(samples(spark, d), BY, ORDER, "x", distance=4, prominence=20.0)


@query(f"WITH RECURSIVE {SAMPLES}, {peaks_sql()}, {far_sql(3)}, {WIDTHS} SELECT far.user_id, us, seq, x, round(prominence, 6) AS prominence, round(width, 6) AS width FROM far JOIN wd USING (user_id, i) JOIN ev USING (user_id, i)")
def peak_shapes(spark, d):
    """Prominence and width of all peaks three samples apart."""
    return G.peak_shapes(samples(spark, d), BY, ORDER, "x", 3).select(*BY, *ORDER, "x", r6("prominence").alias("prominence"), r6("width").alias("width"))


@query(f"""WITH RECURSIVE {SAMPLES}, {peaks_sql()}, {far_sql(3)}, qs AS (SELECT unnest(range(0, 30)) AS step),
qv AS (SELECT user_id, list(x ORDER BY x) AS xs FROM ev GROUP BY user_id),
qc AS (SELECT user_id, step, (0.9 + step * ((0.45 - 0.9) / 29)) * (len(xs) - 1) AS pos, 0.25 * (len(xs) - 1) AS low, xs FROM qv, qs),
qx AS (SELECT user_id, step, greatest(xs[CAST(floor(pos) AS INT) + 1] + (pos - floor(pos)) * (xs[CAST(ceil(pos) AS INT) + 1] - xs[CAST(floor(pos) AS INT) + 1]) - (xs[CAST(floor(low) AS INT) + 1] + (low - floor(low)) * (xs[CAST(ceil(low) AS INT) + 1] - xs[CAST(floor(low) AS INT) + 1])), 1e-9) AS least FROM qc),
qn AS (SELECT q.user_id, q.step, q.least, count(*) FILTER (f.prominence >= q.least) AS n FROM qx q JOIN far f USING (user_id) GROUP BY ALL),
qb AS (SELECT user_id, least FROM qn QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(n - 5), step) = 1),
top AS (SELECT f.user_id, f.i FROM far f JOIN qb USING (user_id) WHERE f.prominence >= least QUALIFY row_number() OVER (PARTITION BY f.user_id ORDER BY f.prominence DESC, f.i DESC) <= 5)
SELECT ev.user_id, us, seq, x, top.i IS NOT NULL AS is_peak FROM ev LEFT JOIN top ON top.user_id = ev.user_id AND top.i = ev.i""")
def peaks_for_count(spark, d):
    return G.counted_peaks(samples(spark, d), BY, ORDER, "x", 5, 3)


@query(filtered_query(System.of_filter(*_HIGH), 15))
def butter_highpass(spark, d):
    return G.smoothed(samples(spark, d), BY, ORDER, "x", 0.5, 50.0, 4, high=True, span=_CHUNK).select(*BY, *ORDER, "x", r6("x_filtered").alias("x_filtered"))


@query(filtered_query(System.of_filter(*_BAND), 27))
def butter_bandpass(spark, d):
    return G.banded(samples(spark, d), BY, ORDER, "x", 1.0, 8.0, 50.0, span=_CHUNK).select(*BY, *ORDER, "x", r6("x_filtered").alias("x_filtered"))


def _motion(spark, d):
    return samples(spark, d).withColumns({"z": F.lit(9.8), "g": F.col("y") / 100, "g2": F.col("y") / 200, "g3": -F.col("y") / 100})


@query(tilt_query(0.98, 0.02))
def tilt_filter(spark, d):
    t = G.tilted(_motion(spark, d), BY, ORDER, ["x", "y", "z"], ["g", "g2", "g3"], 0.02, span=_CHUNK)
    return t.select(*BY, *ORDER, r6("roll").alias("roll"), r6("pitch").alias("pitch"))


@query()
def complementary_attitude(spark, d):
    return G.oriented(_motion(spark, d), BY, ORDER, ["x", "y", "z"], ["g", "g2", "g3"], 0.02, "complementary")


@query()
def gravity_frame(spark, d):
    return G.gravity_frame(_motion(spark, d), BY, ORDER, ["x", "y", "z"], 50.0)


#: Windows of 32 as groups of their own, places counted from 0.
_WINDOWS = f"""{SAMPLES}, {windows_sql(32, 16)}, wv AS (SELECT user_id AS u, window_id, user_id * 100000 + window_id AS user_id, i - min(i) OVER (PARTITION BY user_id, window_id) AS i, x, y FROM w)"""


@query(f"""WITH {_WINDOWS}, {peaks_sql("wv")}, mo AS (SELECT user_id, any_value(u) AS u, any_value(window_id) AS window_id, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, sqrt(avg(x * x)) AS rms FROM wv GROUP BY user_id),
ms AS (SELECT user_id, avg(pow(x - mean, 3)) AS m3, avg(pow(x - mean, 4)) AS m4 FROM wv JOIN mo USING (user_id) GROUP BY user_id),
nb AS (SELECT *, lag(x) OVER q AS b, lead(x) OVER q AS a FROM wv WINDOW q AS (PARTITION BY user_id ORDER BY i)),
jk AS (SELECT user_id, count(*) FILTER (x * b < 0) AS zero_cross, max(abs(CASE WHEN b IS NULL THEN (a - x) * 50 WHEN a IS NULL THEN (x - b) * 50 ELSE (a - b) * 25 END)) AS jerk FROM nb GROUP BY user_id),
pc AS (SELECT mo.user_id, count(*) FILTER (prominence >= 0.5 * std) AS peaks FROM mo LEFT JOIN pp USING (user_id) GROUP BY mo.user_id),
ks AS (SELECT unnest(range(0, 17)) AS k), df AS (SELECT user_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 32)), 2) + pow(sum(x * sin(2 * pi() * k * i / 32)), 2)) AS a FROM wv, ks GROUP BY ALL),
tt AS (SELECT user_id, sum(a * a) FILTER (k > 0) + 1e-12 AS total FROM df GROUP BY user_id),
sp AS (SELECT user_id, arg_max(k, a) FILTER (k > 0) * 50 / 32.0 AS dom_freq, max(a * a) FILTER (k > 0) / any_value(total) AS dom_power, sum(k * 50 / 32.0 * a) / (sum(a) FILTER (k > 0) + 1e-12) AS centroid, -sum(a * a / total * log2(a * a / total + 1e-12)) FILTER (k > 0) AS entropy,
 sum(a * a) FILTER (k * 50 / 32.0 < 3) / any_value(total) AS b0, sum(a * a) FILTER (k * 50 / 32.0 >= 3 AND k * 50 / 32.0 < 8) / any_value(total) AS b3, sum(a * a) FILTER (k * 50 / 32.0 >= 8 AND k * 50 / 32.0 < 25) / any_value(total) AS b8 FROM df JOIN tt USING (user_id) GROUP BY user_id)
SELECT u AS user_id, window_id, round(mean, 8) AS mean, round(std, 5) AS std, min, max, round(max - min, 5) AS ptp, round(rms, 5) AS rms, round(m3 / pow(std, 3), 5) AS skew, round(m4 / pow(std, 4) - 3, 5) AS kurt, CAST(zero_cross AS DOUBLE) AS zero_cross, CAST(peaks AS DOUBLE) AS peaks, round(jerk, 5) AS jerk_peak,
 round(dom_freq, 5) AS dom_freq, round(dom_power, 5) AS dom_power, round(centroid, 5) AS centroid, round(entropy, 5) AS entropy, round(b0, 5) AS band_0_3, round(b3, 5) AS band_3_8, round(b8, 5) AS band_8_25 FROM mo JOIN ms USING (user_id) JOIN jk USING (user_id) JOIN pc USING (user_id) JOIN sp USING (user_id)""")
def window_spectrum(spark, d):
    """Entropy and band shares, with all other features, of every window of a recording."""
    f = G.window_features(W.sliding_samples(samples(spark, d), BY, ORDER, "x", 32, 16), ["user_id", "window_id"], "samples", 50.0)
    return f.withColumns({c: F.round(c, 8 if c == "mean" else 5) for c in f.columns if c not in ("user_id", "window_id", "min", "max")})


@query(f"""WITH RECURSIVE {_WINDOWS}, ce AS (SELECT user_id, any_value(u) AS u, any_value(window_id) AS window_id, list(x - m ORDER BY i) AS a, list(y - n ORDER BY i) AS b, stddev_pop(x) * stddev_pop(y) * 31 + 1e-12 AS size FROM (SELECT *, avg(x) OVER (PARTITION BY user_id) AS m, avg(y) OVER (PARTITION BY user_id) AS n FROM wv) GROUP BY user_id),
lg AS (SELECT unnest(range(-31, 32)) AS lag), cc AS (SELECT user_id, lag, list_sum(list_transform(range(greatest(1, 1 - lag), least(32, 32 - lag) + 1), lambda j: a[j + lag] * b[j])) AS c FROM ce, lg),
mx AS (SELECT user_id, max(c) AS c, arg_max(lag, c) AS lag FROM cc GROUP BY user_id), al AS (SELECT unnest(range(0, 32)) AS lag),
ac AS (SELECT user_id, lag, list_sum(list_transform(range(1, 33 - lag), lambda j: a[j + lag] * a[j])) AS c FROM ce, al), av AS (SELECT user_id, lag - 3 AS i, c AS x FROM ac WHERE lag >= 3), {peaks_sql("av")}, {far_sql(3)},
fp AS (SELECT user_id, min(i) + 3 AS period FROM far GROUP BY user_id)
SELECT u AS user_id, window_id, round(mx.c / size, 5) AS sync_max, round(mx.lag / 50.0, 5) AS sync_lag, round(coalesce(ac.c / (a0.c + 1e-12), 0), 5) AS period_height, round(coalesce(period / 50.0, 0), 5) AS period_lag
 FROM ce JOIN mx USING (user_id) JOIN ac a0 ON a0.user_id = ce.user_id AND a0.lag = 0 LEFT JOIN fp ON fp.user_id = ce.user_id LEFT JOIN ac ON ac.user_id = ce.user_id AND ac.lag = fp.period""")
def envelope_sync(spark, d):
    """How two channels of a window agree, and the period of the first."""
    s = G.synchrony(_arrays(spark, d), ["user_id", "window_id"], "x", "y", 50.0)
    return s.withColumns({c: F.round(c, 5) for c in ("sync_max", "sync_lag", "period_height", "period_lag")})


def _arrays(spark, d):
    """Windows of 32 samples with three channels as arrays."""
    s, keys = samples(spark, d), ["user_id", "window_id"]
    rows = W.sliding(s.select(*BY, *ORDER, "x", "y"), BY, ORDER, 32, 16).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("s"))
    channel = lambda c: F.transform("s", lambda v: v[c]).alias(c)
    return rows.select(*keys, channel("x"), channel("y"), F.transform("s", lambda v: v["x"] - v["y"]).alias("z"))


@query()
def window_channel_features(spark, d):
    """Statistics, strongest frequency and peaks of every channel of a window and of their norm."""
    w = _arrays(spark, d).withColumn("mag", K.magnitudes("x", "y", "z"))
    return K.channel_features(w, ["user_id", "window_id"], ["x", "y", "z", "mag"], 50.0, 0.125, absolute=True)


@query(f"""WITH {SAMPLES}, {windows_sql(32, 16)}, b AS (SELECT user_id, window_id, list(x ORDER BY i) AS a, list(y ORDER BY i) AS b FROM w GROUP BY ALL),
l AS (SELECT user_id, window_id, list_transform(a, lambda v: (v - list_avg(a)) / (list_stddev_pop(a) + 1e-9)) AS a, list_transform(b, lambda v: (v - list_avg(b)) / (list_stddev_pop(b) + 1e-9)) AS b, unnest(range(-10, 11)) AS lag FROM b),
c AS (SELECT user_id, window_id, lag, round(list_sum(list_transform(range(greatest(1, 1 + lag), least(32, 32 + lag) + 1), lambda j: a[j] * b[j - lag])) / 32, 9) AS corr FROM l)
SELECT user_id, window_id, CAST(arg_min(lag, {{'c': -corr, 'l': lag}}) AS INT) AS gyro_lag, round(max(corr), 6) AS gyro_corr FROM c GROUP BY ALL""")
def node_lag(spark, d):
    """How well two nodes agree at their best shift, and which it is."""
    w = K.best_lag(_arrays(spark, d), ["user_id", "window_id"], "x", "y", 10, "gyro")
    return w.select("user_id", "window_id", "gyro_lag", r6(F.round("gyro_corr", 9)).alias("gyro_corr"))


@query()
def class_distance_matrix(spark, d):
    """Mahalanobis and Bhattacharyya distances of all pairs of classes."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding").alias("v"))
    return spark.createDataFrame(X.distance_matrix(X.class_models(e, "v", "label")), f"class_a {e.schema['label'].dataType.simpleString()}, class_b {e.schema['label'].dataType.simpleString()}, mahalanobis double, bhattacharyya double")


@query()
def pose_release_candidates(spark, d):
    """Likely releases of recordings seen as pose tables."""
    joints = {j: k for k, j in enumerate(("right_shoulder", "right_elbow", "right_wrist", "left_wrist"))}
    s = samples(spark, d).withColumns({f"{j}_{a}": F.col(c) / 100 * (1 + k) + k for j, k in joints.items() for a, c in zip("xyz", ("x", "y", "x"))})
    s = s.withColumns({f"visibility_{j}": F.col("y") / 100 for j in ("right_wrist", "right_elbow")})
    return K.release_candidates(K.pose_motion(s, BY, ORDER, 30.0), BY, ORDER, 30.0, 5, 0.2)


@query()
def mahalanobis_rejection(spark, d):
    """Open-set rejection of all vectors by their distance to the class that they are said to have, each class with the
    threshold that 95 of 100 of its training rows keep to."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    learn = E.fold(F.col("vec_id"), 4) != 0
    far = X.mahalanobis(e, "v", "label", X.class_models(e.where(learn), "v", "label"))
    out = X.rejected_by_class(far, "label", F.lit(0.9), X.class_thresholds(far.where(learn), "label"), 0.5)
    return out.select("vec_id", "distance", "threshold", F.col("final").alias("label"), "confidence")


@query()
def madgwick(spark, d):
    return G.oriented(_motion(spark, d), BY, ORDER, ["x", "y", "z"], ["g", "g2", "g3"], 0.02)


@query()
def rf_classify(spark, d):
    """One row for each window of 32 of the recordings held out."""
    p = W.sliding_samples(samples(spark, d), BY, ORDER, "x", 32, 16)
    f = G.window_features(p, ["user_id", "window_id"], "samples", 50.0).withColumn("label", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    names = ["mean", "std", "ptp", "rms", "dom_freq", "centroid"]
    model = L.random_forest(f.where(E.fold(F.col("user_id"), 4) != 0), names, "label", trees=20, depth=4)
    return model.transform(f.where(E.fold(F.col("user_id"), 4) == 0)).select("user_id", "window_id", "label", F.col("prediction").alias("predicted"))


_COSTS, _GAMMAS = [0.1, 1.0, 10.0], [0.002, 0.01, 0.05]


def _vectors(spark, d):
    return H.prepared(table(spark, d, "embeddings"), "embedding", "label", "vec_id", 5)


@query()
def kernel_machine_grid(spark, d):
    """How many vectors of each fold are named rightly by machines fitted on the others, for each cost and kernel width."""
    rows = _vectors(spark, d)
    return H.scored_grid(rows, H.fit_grid(rows, _COSTS, _GAMMAS, 100))


@query()
def kernel_machine(spark, d):
    """Class and probability of every vector by the machine of one cell."""
    rows = _vectors(spark, d)
    grid = H.fit_grid(rows, [1.0], [0.01], 100)
    return H.classified(rows, grid, H.machine(rows, grid, 0.01, 1.0), 0.01).select("id", "label", "predicted", r6("probability").alias("probability"))


@query()
def fold_sweep(spark, d):
    """How many vectors of each fold four models get right that have not seen it."""
    models = {"centroids": D.centroids(), "neighbours": D.neighbours(5), "machine": D.machine(), "forest": D.forest(20, 6)}
    p = D.swept(_vectors(spark, d), models, 2000)
    return p.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("predicted") == F.col("label")).cast("int")).alias("right"))


@query(f"""WITH {_LONG}, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v, var_samp(x) AS s FROM lf GROUP BY ALL), h AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM g GROUP BY feature),
a AS (SELECT feature, round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f FROM g JOIN h USING (feature) GROUP BY feature),
b AS (SELECT feature, count(*) FILTER (label = 0) AS na, count(*) FILTER (label = 1) AS nb, avg(x) FILTER (label = 0) AS ma, avg(x) FILTER (label = 1) AS mb, var_samp(x) FILTER (label = 0) AS va, var_samp(x) FILTER (label = 1) AS vb FROM lf GROUP BY feature),
t AS (SELECT feature, round(abs((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb))), 5) AS t FROM b),
r AS (SELECT feature, f, t, row_number() OVER (ORDER BY f DESC, feature) AS by_f, row_number() OVER (ORDER BY t DESC, feature) AS by_t FROM a JOIN t USING (feature))
SELECT feature, f, t, by_f, by_t, (by_f + by_t) / 2.0 AS mean_rank FROM r QUALIFY row_number() OVER (ORDER BY (by_f + by_t) / 2.0, feature) <= 40""")
def feature_ranks(spark, d):
    """The 40 features that are first by the mean of their places by variance ratio and by t."""
    f = E.rank_by(E.anova_f(_long(spark, d), "label").withColumn("f", F.round("f", 5)), "f", "feature", "by_f")
    t = E.rank_by(E.t_statistic(_long(spark, d), "label", 0, 1).select("feature", F.round(F.abs("t"), 5).alias("t")), "t", "feature", "by_t")
    both = f.select("feature", "f", F.col("by_f").cast("long").alias("by_f")).join(t.select("feature", "t", F.col("by_t").cast("long").alias("by_t")), "feature")
    return both.withColumn("mean_rank", (F.col("by_f") + F.col("by_t")) / 2).orderBy("mean_rank", "feature").limit(40)


@query()
def importance_ranks(spark, d):
    """Features by their worth to forests."""
    worth = D.forest_importances(_vectors(spark, d), [f"f{k}" for k in range(64)], 20, 6, 2000)
    return E.rank_by(worth, "importance", "feature")


@query(f"WITH {SAMPLES} SELECT node, round(quantile_cont(x, 0.9), 6) AS q FROM ev GROUP BY node")
def exact_quantiles(spark, d):
    """The ninth decile of each node's samples, exact."""
    return Q.exact_quantile(samples(spark, d), ["node"], "x", 0.9, "q").withColumn("q", r6("q"))


_CHANNELS = [f"{c}_{n}" for n in K.NODES for c in ("ax", "ay", "az", "gx", "gy", "gz", "a_mag", "a_vert", "a_horiz", "pitch")]


@query()
def four_node_features(spark, d):
    """Mean of every feature over all windows of four nodes with ten channels each."""
    w = _arrays(spark, d)
    channels = F.create_map(*[x for k, c in enumerate(_CHANNELS) for x in (F.lit(c), _mixed(k))])
    return K.mean_features(w.select(channels.alias("channels")), "channels", 50.0, pairs=True).withColumn("mean", r6("mean"))


def _mixed(k: int):
    """A channel made of the three that windows have."""
    return F.transform(("x", "y", "z")[k % 3], lambda v, i: v * (1 + 0.1 * k) + (i * (k + 1)) % 7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
