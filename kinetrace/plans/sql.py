"""DuckDB SQL of operators that take more than a clause: recursive filters, peaks with their shapes."""

from __future__ import annotations

from kinetrace.operators.recursion import System
from kinetrace.plans.base import SAMPLES


def _sum(weights, names) -> str:
    return " + ".join(f"({float(w)!r} * {n})" for w, n in zip(weights, names))


def filter_sql(system: System, pad: int, source: str = "ev", x: str = "x") -> str:
    """Views ``forth`` and ``back`` (user_id, k, y): passes over the samples of ``source`` extended by ``pad`` at both ends,
    one sample at a time."""
    n = len(system.b)
    old = [f"z{k}" for k in range(n)]

    def passing(view: str, rows: str, v: str, first: str, step: str) -> str:
        start = [f"({float(s)!r} * {v})" for s in system.steady]
        after = lambda z: ", ".join(f"{_sum([*system.a[k], system.b[k]], [*z, v])} AS z{k}" for k in range(n))
        y = lambda z: _sum([*system.c, system.d], [*z, v])
        held = [f"p.{z}" for z in old]
        return (f"{view} AS (SELECT user_id, k, {y(start)} AS y, {after(start)} FROM {rows} WHERE {first} "
                f"UNION ALL SELECT w.user_id, w.k, {y(held)}, {after(held)} FROM {view} p JOIN {rows} w ON w.user_id = p.user_id AND w.k = p.k {step})")

    return f"""fe AS (SELECT user_id, i, {x} AS v, count(*) OVER (PARTITION BY user_id) AS n, first_value({x}) OVER (PARTITION BY user_id ORDER BY i) AS v0,
 first_value({x}) OVER (PARTITION BY user_id ORDER BY i DESC) AS v1 FROM {source} QUALIFY n > {pad}),
wide AS (SELECT user_id, i AS k, v, n FROM fe UNION ALL SELECT user_id, -i, 2 * v0 - v, n FROM fe WHERE i BETWEEN 1 AND {pad}
 UNION ALL SELECT user_id, 2 * (n - 1) - i, 2 * v1 - v, n FROM fe WHERE i BETWEEN n - 1 - {pad} AND n - 2),
{passing("forth", "wide", "v", f"k = -{pad}", "+ 1")},
turned AS (SELECT f.user_id, f.k, f.y AS u, w.n FROM forth f JOIN wide w USING (user_id, k)),
{passing("back", "turned", "u", f"k = n - 1 + {pad}", "- 1")}"""


#: Peaks of ``source`` (user_id, i, x): local maxima, a flat top at its middle, with the prominence of each.
def peaks_sql(source: str = "ev", x: str = "x") -> str:
    return f"""ps AS (SELECT user_id, i, {x} AS v, CASE WHEN lag({x}) OVER (PARTITION BY user_id ORDER BY i) = {x} THEN 0 ELSE 1 END AS st FROM {source}),
pn AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY i) AS run FROM ps),
pl AS (SELECT user_id, run, min(v) AS v, (min(i) + max(i)) // 2 AS i FROM pn GROUP BY ALL),
pk AS (SELECT user_id, i, v FROM pl QUALIFY v > lag(v) OVER (PARTITION BY user_id ORDER BY run) AND v > lead(v) OVER (PARTITION BY user_id ORDER BY run)),
pb AS (SELECT p.user_id, p.i, any_value(p.v) AS v, coalesce(max(e.i) FILTER (e.i < p.i AND e.v > p.v), -1) AS lb, coalesce(min(e.i) FILTER (e.i > p.i AND e.v > p.v), 1000000000) AS rb FROM pk p JOIN ps e USING (user_id) GROUP BY ALL),
pp AS (SELECT b.user_id, b.i, any_value(b.v) AS v, any_value(b.v) - greatest(min(e.v) FILTER (e.i <= b.i AND e.i > lb), min(e.v) FILTER (e.i >= b.i AND e.i < rb)) AS prominence FROM pb b JOIN ps e USING (user_id) GROUP BY ALL)"""


def far_sql(distance: int) -> str:
    """View ``far``: the peaks of ``pp`` that stay ``distance`` apart, higher ones first, of equals the later. Recursive."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, i DESC) AS k FROM pp),
chosen AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held FROM (SELECT DISTINCT user_id FROM pp)
 UNION ALL SELECT c.user_id, c.k + 1, CASE WHEN len(list_filter(held, lambda h: abs(h - r.i) < {distance})) = 0 THEN list_append(held, CAST(r.i AS BIGINT)) ELSE held END FROM chosen c JOIN ranked r ON r.user_id = c.user_id AND r.k = c.k + 1),
ends AS (SELECT user_id, arg_max(held, k) AS held FROM chosen GROUP BY user_id),
far AS (SELECT pp.* FROM pp JOIN ends USING (user_id) WHERE list_contains(held, pp.i))"""


#: Widths of ``far`` peaks at half their prominence, by straight lines between samples.
WIDTHS = """wl AS (SELECT f.user_id, f.i, any_value(f.v - 0.5 * f.prominence) AS h, max(e.i) FILTER (e.i < f.i AND e.v <= f.v - 0.5 * f.prominence) AS l, min(e.i) FILTER (e.i > f.i AND e.v <= f.v - 0.5 * f.prominence) AS r FROM far f JOIN ps e USING (user_id) GROUP BY ALL),
wd AS (SELECT w.user_id, w.i, w.r - CASE WHEN d.v < h THEN (h - d.v) / (c.v - d.v) ELSE 0 END - (w.l + CASE WHEN a.v < h THEN (h - a.v) / (b.v - a.v) ELSE 0 END) AS width
 FROM wl w JOIN ps a ON a.user_id = w.user_id AND a.i = w.l JOIN ps b ON b.user_id = w.user_id AND b.i = w.l + 1 JOIN ps c ON c.user_id = w.user_id AND c.i = w.r - 1 JOIN ps d ON d.user_id = w.user_id AND d.i = w.r)"""


def filtered_query(system: System, pad: int) -> str:
    return f"""WITH RECURSIVE {SAMPLES}, {filter_sql(system, pad)}
SELECT ev.user_id, us, seq, x, round(coalesce(back.y, x), 6) AS x_filtered FROM ev LEFT JOIN back ON back.user_id = ev.user_id AND back.k = ev.i"""


def tilt_query(alpha: float, dt: float) -> str:
    keep = 1 - alpha
    step = lambda old, g, seen: f"{alpha!r} * {old} + {alpha!r} * ({g}) * {dt!r} + {keep!r} * {seen}"
    roll, pitch = "atan2(m.y, 9.8)", "atan2(-m.x, sqrt(m.y * m.y + 9.8 * 9.8))"
    return f"""WITH RECURSIVE {SAMPLES}, t AS (
 SELECT m.user_id, m.i, {step("0.0", "m.y / 100", roll)} AS roll, {step("0.0", "m.y / 200", pitch)} AS pitch FROM ev m WHERE m.i = 0
 UNION ALL SELECT m.user_id, m.i, {step("t.roll", "m.y / 100", roll)}, {step("t.pitch", "m.y / 200", pitch)} FROM t JOIN ev m ON m.user_id = t.user_id AND m.i = t.i + 1)
SELECT user_id, us, seq, round(roll, 6) AS roll, round(pitch, 6) AS pitch FROM t JOIN ev USING (user_id, i)"""
