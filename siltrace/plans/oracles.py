"""SQL of the registered wafer queries, for an independent engine on the same tables."""

from __future__ import annotations

from siltrace.functions.columns import ERFC
from siltrace.operators.metrics import FAR
from siltrace.operators.rules import CALIBRATED, DEFAULT, GRIDS
from siltrace.plans.adapters import PLANTED
from siltrace.sources.dimensions import ACTIONS, CLASSES, CLASSES9


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _values(names) -> str:
    return ", ".join(f"('{n}')" for n in names)


ORACLES: dict[str, str] = {}


def _add(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    head = "WITH RECURSIVE " if recursive else "WITH "
    ORACLES[name] = head + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


# --- wafers ---

_TRUTH = "CASE pm " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(PLANTED)) + " END"
DIES = f"""
grid AS (SELECT a.x, b.y FROM range(0, 31) a(x), range(0, 31) b(y) WHERE (a.x - 15) * (a.x - 15) + (b.y - 15) * (b.y - 15) <= 225),
hits AS (
  SELECT DISTINCT l_suppkey AS wafer, (l_orderkey * 7 + l_linenumber * 3) % 31 AS x, (l_partkey * 11 + l_linenumber * 5) % 31 AS y
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= CASE WHEN l_suppkey % 9 = 8 THEN 2 ELSE 10 END),
base AS (
  SELECT s_suppkey AS wafer, s_suppkey // 5 AS lot, s_suppkey % 9 AS pm, x, y, x - 15 AS dx, 15 - y AS dy, (x - 15) * (x - 15) + (15 - y) * (15 - y) AS d2
  FROM supplier, grid WHERE NOT (s_suppkey % 4 = 1 AND x < 4)),
dies AS (
  SELECT b.wafer, b.lot, b.pm, {_TRUTH} AS y_true, b.x, b.y, b.dx, b.dy, b.d2,
    CASE WHEN h.wafer IS NOT NULL OR CASE pm
      WHEN 0 THEN d2 >= 152 WHEN 1 THEN d2 <= 10 WHEN 2 THEN d2 BETWEEN 36 AND 86
      WHEN 3 THEN d2 >= 144 AND abs(degrees(atan2(CAST(dy AS DOUBLE), CAST(dx AS DOUBLE))) - 45) <= 35
      WHEN 4 THEN abs({_d(-0.5)} * dx + {_d(0.866)} * dy) <= 1
      WHEN 5 THEN (b.x - 22) * (b.x - 22) + (b.y - 15) * (b.y - 15) <= 9
      WHEN 6 THEN (b.x * 7 + b.y * 13 + b.wafer * 5) % 10 < 7
      WHEN 7 THEN (b.x * b.x * 3 + b.y * b.y * 5 + b.x * b.y * 7 + b.wafer) % 11 = 0
      ELSE false END THEN 2 ELSE 1 END AS v
  FROM base b LEFT JOIN hits h ON h.wafer = b.wafer AND h.x = b.x AND h.y = b.y),
pos AS (
  SELECT *, CAST(dx AS DOUBLE) * 10 AS die_x, CAST(dy AS DOUBLE) * 10 AS die_y, sqrt(CAST(100 * d2 AS DOUBLE)) AS radius,
    degrees(atan2(CAST(dy AS DOUBLE), CAST(dx AS DOUBLE))) AS angle_deg
  FROM dies)
"""
GLOBAL = """
g0 AS (
  SELECT wafer, any_value(lot) AS lot, any_value(pm) AS pm, any_value(y_true) AS y_true, count(*) AS n_die, count(*) FILTER (v = 2) AS n_fail,
    avg(CASE WHEN v = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fail_frac,
    avg(radius) FILTER (v = 2) / max(radius) AS r_mean, median(radius) FILTER (v = 2) / max(radius) AS r_med,
    stddev_pop(radius) FILTER (v = 2) / max(radius) AS r_std,
    sqrt(avg(sin(radians(angle_deg))) FILTER (v = 2) ** 2 + avg(cos(radians(angle_deg))) FILTER (v = 2) ** 2) AS dir_c,
    sqrt(avg(sin(2 * radians(angle_deg))) FILTER (v = 2) ** 2 + avg(cos(2 * radians(angle_deg))) FILTER (v = 2) ** 2) AS axial_c
  FROM pos GROUP BY wafer),
g AS (
  SELECT wafer, lot, pm, y_true, n_die, n_fail, fail_frac,
    CASE WHEN fail_frac > 0.02::DOUBLE THEN coalesce(r_mean, 0) ELSE 0 END AS r_mean, CASE WHEN fail_frac > 0.02::DOUBLE THEN coalesce(r_med, 0) ELSE 0 END AS r_med,
    CASE WHEN fail_frac > 0.02::DOUBLE THEN coalesce(r_std, 0) ELSE 0 END AS r_std, CASE WHEN fail_frac > 0.02::DOUBLE THEN coalesce(dir_c, 0) ELSE 0 END AS dir_c,
    CASE WHEN fail_frac > 0.02::DOUBLE THEN coalesce(axial_c, 0) ELSE 0 END AS axial_c
  FROM g0)
"""


def _rule(p: dict[str, object], structural: bool = False) -> str:
    q = {k: _d(v) if isinstance(v, float) else v for k, v in p.items()}
    first = (
        f"WHEN n_comp >= {q['random_ncomp_min']} THEN 'RANDOM' WHEN elongation >= {q['scratch_elong_min']} AND largest_frac >= {q['scratch_largest_min']} THEN 'SCRATCH'"
        if structural
        else ""
    )
    center = f"AND prof0 >= {q['center_prof0_min']}" if structural else ""
    ring = f"outer_cover >= {q['ring_cover_min']}" if structural else f"r_std <= {q['ring_std']} AND dir_c <= {q['ring_dir']}"
    return f"""CASE WHEN fail_frac <= {q["clean_frac"]} THEN 'CLEAN' WHEN fail_frac >= {q["nearfull_frac"]} THEN 'NEAR_FULL' {first}
      WHEN r_med <= {q["center_r"]} AND dir_c < {q["loc_dir"]} AND r_std >= {q["center_std_min"]} {center} THEN 'CENTER'
      WHEN r_mean >= {q["edge_r"]} AND {ring} THEN 'EDGE_RING' WHEN r_mean >= {q["edge_r"]} THEN 'EDGE_LOC'
      WHEN r_med BETWEEN {q["donut_lo"]} AND {q["donut_hi"]} AND r_std <= {q["donut_std"]} AND dir_c <= {q["ring_dir"]} THEN 'DONUT'
      WHEN axial_c >= {q["scratch_axial"]} AND dir_c <= {q["scratch_dir"]} THEN 'SCRATCH'
      WHEN dir_c >= {q["loc_dir"]} THEN 'LOC' ELSE 'RANDOM' END"""


VERDICT = f"""
v AS (SELECT *, {_rule(DEFAULT)} AS y_pred FROM g)
"""
_B = "CAST({} AS BIGINT) AS {}".format
_n = lambda *names: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in names)
_r = lambda *names: ", ".join(f"round({c}, 6) AS {c}" for c in names)

_add("rule_classify", "SELECT wafer, CAST(lot AS BIGINT) AS lot, y_true, y_pred FROM v", DIES, GLOBAL, VERDICT)
_SCORE = """round(least(greatest(CASE y_pred WHEN 'CLEAN' THEN 1 - fail_frac / 0.02::DOUBLE WHEN 'NEAR_FULL' THEN fail_frac
  WHEN 'CENTER' THEN 1 - r_med / 0.30::DOUBLE WHEN 'EDGE_RING' THEN r_mean * (1 - 0.5::DOUBLE * r_std / 0.15::DOUBLE) WHEN 'EDGE_LOC' THEN greatest(dir_c, r_mean)
  WHEN 'DONUT' THEN 1 - r_std / 0.16::DOUBLE WHEN 'SCRATCH' THEN axial_c * (1 - dir_c) WHEN 'LOC' THEN dir_c ELSE 1 - greatest(dir_c, axial_c) END, 0.0::DOUBLE), 1.0::DOUBLE), 6)"""
_add(
    "rule_score",
    f"SELECT wafer, y_pred, {_SCORE} AS score FROM v",
    DIES, GLOBAL, VERDICT,
)
_add(
    "classify_all",
    f"""SELECT wafer, CAST(lot AS BIGINT) AS lot, y_true, CASE WHEN ok THEN y_pred END AS y_pred, CAST(CASE WHEN error IS NULL THEN n END AS BIGINT) AS n_die, NOT ok AS skipped,
  CASE WHEN ok THEN {_SCORE} END AS score, {", ".join(f"CASE WHEN ok THEN round({c}, 6) END AS {c}" for c in ("fail_frac", "r_mean", "r_std", "dir_c", "axial_c"))}, error
FROM (SELECT v.*, error, CASE WHEN wafer % 10 = 0 THEN few.n ELSE n_die END AS n, error IS NULL AND CASE WHEN wafer % 10 = 0 THEN few.n ELSE n_die END >= 100 AS ok FROM v JOIN er USING (wafer) LEFT JOIN few USING (wafer))""",
    DIES, GLOBAL, VERDICT,
    "few AS (SELECT wafer, count(*) AS n FROM dies WHERE x <= 4 GROUP BY wafer)",
    "er AS (SELECT wafer, CASE WHEN wafer % 11 = 5 THEN 'no map' WHEN wafer % 7 = 3 THEN 'rows of unequal length' WHEN wafer % 13 = 6 THEN 'unknown cell code' END AS error FROM v)",
)
_add("wafer_yield", f"SELECT wafer, {_n('n_die', 'n_fail')}, round(fail_frac, 6) AS fail_frac, round((1 - fail_frac) * 100, 6) AS yield_pct FROM g0", DIES, GLOBAL)
_add("die_explode", f"SELECT wafer, {_n('x', 'y')}, {_r('die_x', 'die_y', 'radius', 'angle_deg')}, CASE v WHEN 2 THEN 'FAIL' ELSE 'PASS' END AS status FROM pos", DIES)
_add("map_roundtrip", f"SELECT wafer, 31::BIGINT AS height, 31::BIGINT AS width, {_n('x', 'y', 'v')} FROM dies", DIES)
_add(
    "geometry_infer",
    "SELECT wafer, round(coalesce(min(gap), 1), 6) AS pitch, round(max(r) + coalesce(min(gap), 1) / 2 * 1.4142135623730951::DOUBLE, 6) AS radius FROM c GROUP BY wafer",
    DIES, "c AS (SELECT wafer, die_x, max(radius) AS r, die_x - lag(die_x) OVER (PARTITION BY wafer ORDER BY die_x) AS gap FROM pos GROUP BY wafer, die_x)",
)
_add("global_features", f"SELECT wafer, {_n('n_die', 'n_fail')}, {_r('fail_frac', 'r_mean', 'r_med', 'r_std', 'dir_c', 'axial_c')} FROM g", DIES, GLOBAL)
_add(
    "clean_zeroing",
    "SELECT wafer, round(fail_frac, 6) AS fail_frac, round(coalesce(r_mean, 0), 6) AS r_mean, round(coalesce(dir_c, 0), 6) AS dir_c, 0.0::DOUBLE AS r_mean_held, 0.0::DOUBLE AS dir_c_held FROM g0 WHERE fail_frac <= 0.02::DOUBLE",
    DIES, GLOBAL,
)
_add("rule_param_global", f"SELECT wafer, {_rule({k: v for k, v in CALIBRATED.items() if k in DEFAULT})} AS y_pred FROM g", DIES, GLOBAL)

_MACRO = """
f1 AS (SELECT {key} name, 2.0::DOUBLE * count(*) FILTER (y_true = name AND y_pred = name) / nullif(count(*) FILTER (y_true = name) + count(*) FILTER (y_pred = name), 0) AS f1,
  count(*) FILTER (y_true = name) AS support, count(*) FILTER (y_true = name AND y_pred = name) AS tp, count(*) FILTER (y_pred = name) AS named
  FROM {rows}, (VALUES {names}) AS k(name) GROUP BY {key} name)
"""
_add(
    "calib_sweep",
    "SELECT round(candidate, 6) AS candidate, round(avg(coalesce(f1, 0)), 6) AS macro_f1 FROM f1 GROUP BY candidate",
    DIES, GLOBAL,
    f"c AS (SELECT *, {_rule({**DEFAULT, 'center_r': 'candidate'})} AS y_pred FROM g, (VALUES {', '.join(f'({_d(x)})' for x in GRIDS['center_r'])}) AS t(candidate))",
    _MACRO.format(key="candidate,", rows="c", names=_values(CLASSES)),
)

BOX = """
bx AS (SELECT wafer, (max(x) + min(x)) / 2.0::DOUBLE AS mx, (max(y) + min(y)) / 2.0::DOUBLE AS my, greatest((max(x) - min(x)) / 2.0::DOUBLE, 1e-9) AS hx, greatest((max(y) - min(y)) / 2.0::DOUBLE, 1e-9) AS hy FROM dies GROUP BY wafer),
b0 AS (SELECT d.*, hx, hy, (x - mx) / hx AS ux, (y - my) / hy AS uy FROM dies d JOIN bx USING (wafer)),
b AS (SELECT *, sqrt(ux * ux + uy * uy) AS rn, CASE WHEN uy = 0 AND ux < 0 THEN -pi() ELSE atan2(0.0::DOUBLE - uy, ux) END AS ang FROM b0)
"""
_prof = lambda i: f"rnd >= {_d(i / 5)} AND rnd {'<' if i < 4 else '<='} {_d((i + 1) / 5)}"
_profiles = ", ".join(
    f"CASE WHEN count(*) FILTER ({_prof(i)}) >= 5 AND avg(f) > 0 THEN avg(f) FILTER ({_prof(i)}) / avg(f) ELSE 1 END AS prof{i}" for i in range(5)
)
RING = f"""
br AS (SELECT *, round(rn, 9) AS rnd, CASE v WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f,
  least(greatest(floor(round((ang + pi()) / (2 * pi()) * 24, 9)), 0), 23) AS bin FROM b),
sf AS (SELECT wafer, coalesce(count(DISTINCT bin) FILTER (rnd >= 0.75::DOUBLE AND v = 2)::DOUBLE / nullif(count(DISTINCT bin) FILTER (rnd >= 0.75::DOUBLE), 0), 0) AS outer_cover,
  coalesce(avg(f) FILTER (rnd >= 0.75::DOUBLE), 0) AS outer_rate, {_profiles} FROM br GROUP BY wafer)
"""
_add("radial_profile", f"SELECT wafer, {_r(*[f'prof{i}' for i in range(5)])} FROM sf", DIES, BOX, RING)
_add("angular_cover", f"SELECT wafer, {_r('outer_cover', 'outer_rate')} FROM sf", DIES, BOX, RING)

LABELS = """
cells AS MATERIALIZED (SELECT wafer, x, y, y * 31 + x AS id FROM dies WHERE v = 2),
edges AS MATERIALIZED (SELECT a.wafer, a.id, c.id AS other FROM cells a JOIN (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) AS o(ox, oy) ON true
  JOIN cells c ON c.wafer = a.wafer AND c.x = a.x + o.ox AND c.y = a.y + o.oy),
lab(wafer, id, comp) USING KEY (wafer, id) AS (
  SELECT wafer, id, id FROM cells
  UNION
  (SELECT e.wafer, e.other, min(l.comp) FROM lab l JOIN edges e ON e.wafer = l.wafer AND e.id = l.id JOIN recurring.lab p ON p.wafer = e.wafer AND p.id = e.other
   WHERE l.comp < p.comp GROUP BY e.wafer, e.other))
"""
COMPS = """
nb AS (SELECT wafer, id, count(*) AS k FROM edges GROUP BY wafer, id),
dieset AS MATERIALIZED (SELECT wafer, x, y FROM dies),
four AS (SELECT a.wafer, a.x, a.y, count(*) AS k FROM dieset a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(ox, oy) ON true
  JOIN dieset c ON c.wafer = a.wafer AND c.x = a.x + o.ox AND c.y = a.y + o.oy GROUP BY a.wafer, a.x, a.y),
fc AS MATERIALIZED (SELECT l.wafer, l.comp, b.x, b.y, ux, uy, hx, hy, rn, ang, coalesce(nb.k, 0) AS nbs, CASE WHEN coalesce(four.k, 0) < 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS edge
  FROM lab l JOIN b ON b.wafer = l.wafer AND b.y * 31 + b.x = l.id LEFT JOIN nb ON nb.wafer = l.wafer AND nb.id = l.id
  LEFT JOIN four ON four.wafer = l.wafer AND four.x = b.x AND four.y = b.y),
cs AS MATERIALIZED (SELECT wafer, comp, count(*) AS size, sum(nbs) AS nbs, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy,
  atan2(round(2 * covar_samp(ux, uy), 12) + 0.0::DOUBLE, round(var_samp(ux) - var_samp(uy), 12) + 0.0::DOUBLE) / 2 AS theta, avg(ux) AS mux, avg(uy) AS muy, min(rn) AS rn_min,
  atan2(round(avg(sin(ang)), 12) + 0.0::DOUBLE, round(avg(cos(ang)), 12) + 0.0::DOUBLE) AS mean_ang, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, any_value(hx) AS hx, any_value(hy) AS hy, avg(edge) AS big_edge_touch
  FROM fc GROUP BY wafer, comp),
sp AS (SELECT fc.wafer, fc.comp, max(atan2(sin(ang - mean_ang), cos(ang - mean_ang))) - min(atan2(sin(ang - mean_ang), cos(ang - mean_ang))) AS span,
  max(ux * cos(theta) + uy * sin(theta)) - min(ux * cos(theta) + uy * sin(theta)) AS len FROM fc JOIN cs ON cs.wafer = fc.wafer AND cs.comp = fc.comp GROUP BY fc.wafer, fc.comp),
ct AS (SELECT cs.*, CASE WHEN size >= 3 THEN sqrt(greatest((vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + vxy * vxy), 1e-9) / greatest((vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + vxy * vxy), 1e-9)) ELSE 1 END AS elongation,
  sqrt(mux * mux + muy * muy) AS big_r, CASE WHEN size > 1 THEN degrees(span) ELSE 0 END AS big_span, rn_min AS big_r_min, size::DOUBLE / (w * h) AS big_extent,
  CASE WHEN size >= 3 THEN len ELSE greatest(h / hy, w / hx) END AS big_len FROM cs JOIN sp ON sp.wafer = cs.wafer AND sp.comp = cs.comp),
cf AS (SELECT wafer, count(*)::DOUBLE AS n_comp, max(size)::DOUBLE / sum(size) AS largest_frac, avg(size) AS comp_size_mean,
  arg_max(elongation, size * 1000 - comp) AS elongation, arg_max(big_r, size * 1000 - comp) AS big_r, arg_max(big_span, size * 1000 - comp) AS big_span, arg_max(big_r_min, size * 1000 - comp) AS big_r_min,
  count(*) FILTER (size = 1)::DOUBLE / sum(size) AS isolated_frac, count(*) FILTER (size >= 3)::DOUBLE AS n_comp_sig, coalesce(sum(size) FILTER (size >= 3), 0)::DOUBLE / sum(size) AS sig_frac,
  sum(nbs)::DOUBLE / sum(size) AS fail_nb_mean, arg_max(big_extent, size * 1000 + comp) AS big_extent, arg_max(big_len, size * 1000 + comp) AS big_len,
  arg_max(big_edge_touch, size * 1000 + comp) AS big_edge_touch, coalesce(list_sort(list(size), 'DESC')[2]::DOUBLE / max(size), 0) AS second_frac
  FROM ct GROUP BY wafer)
"""
_add("components", f"SELECT wafer, CAST(id % 31 AS BIGINT) AS x, CAST(id // 31 AS BIGINT) AS y, {_n('comp')} FROM lab", DIES, LABELS, recursive=True)
_SIZES = ("n_comp", "largest_frac", "comp_size_mean", "isolated_frac", "n_comp_sig", "sig_frac", "second_frac")
_add("component_sizes", f"SELECT wafer, {_r(*_SIZES)} FROM cf", DIES, BOX, LABELS, COMPS, recursive=True)
_add("elongation", "SELECT wafer, round(elongation, 3) AS elongation FROM cf", DIES, BOX, LABELS, COMPS, recursive=True)
_add("largest_position", f"SELECT wafer, {_r('big_r', 'big_span', 'big_r_min')} FROM cf", DIES, BOX, LABELS, COMPS, recursive=True)
_add("neighbour_mean", f"SELECT wafer, {_r('fail_nb_mean')} FROM cf", DIES, BOX, LABELS, COMPS, recursive=True)
_add("big_shape", f"SELECT wafer, {_r('big_extent', 'big_len')} FROM cf", DIES, BOX, LABELS, COMPS, recursive=True)
_add("edge_touch", f"SELECT wafer, {_r('big_edge_touch')} FROM cf", DIES, BOX, LABELS, COMPS, recursive=True)
_ALL = f"""
fa AS (SELECT g.*, outer_cover, outer_rate, prof0, prof1, prof2, prof3, prof4, coalesce(elongation, 1) AS elongation,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*_SIZES, "big_r", "big_span", "big_r_min", "fail_nb_mean", "big_extent", "big_len", "big_edge_touch"))}
  FROM g JOIN sf USING (wafer) LEFT JOIN cf USING (wafer))
"""
_FEATURES = ("fail_frac", "r_mean", "r_med", "r_std", "dir_c", "axial_c", "outer_cover", "outer_rate", *[f"prof{i}" for i in range(5)], *_SIZES, "big_r", "big_span", "big_r_min", "fail_nb_mean", "big_extent", "big_len", "big_edge_touch")
_add(
    "features28",
    f"SELECT wafer, {_n('lot', 'pm', 'n_die')}, y_true, round(elongation, 3) AS elongation, {_r(*_FEATURES)} FROM fa",
    DIES, GLOBAL, BOX, RING, LABELS, COMPS, _ALL, recursive=True,
)
_add("rule_param_struct", f"SELECT wafer, {_rule(CALIBRATED, structural=True)} AS y_pred FROM fa", DIES, GLOBAL, BOX, RING, LABELS, COMPS, _ALL, recursive=True)
_add("expected_match", "SELECT wafer, y_true, y_pred, y_true = y_pred OR (y_true = 'LOC' AND y_pred = 'RANDOM') AS matched FROM v", DIES, GLOBAL, VERDICT)
_add("action_lookup", f"SELECT wafer, y_pred, CASE y_pred {' '.join(f"WHEN '{k}' THEN '{a}'" for k, a in ACTIONS.items())} END AS action FROM v", DIES, GLOBAL, VERDICT)
_add("quality_filter", "SELECT wafer, count(*) AS n_die, count(*) < 100 AS skipped FROM dies WHERE NOT (wafer % 10 = 0 AND x > 6) GROUP BY wafer", DIES)
_add(
    "spec_yield",
    f"""SELECT wafer, count(z) AS n_die, count(*) FILTER (z < {_d(413.25)} OR z > {_d(456.75)}) AS n_fail,
  round((1 - count(*) FILTER (z < {_d(413.25)} OR z > {_d(456.75)}) / count(z)::DOUBLE) * 100, 6) AS yield_pct, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS z_std FROM f GROUP BY wafer""",
    DIES, "f AS (SELECT wafer, CASE WHEN x <> 15 THEN 435 - 4 * (sqrt(CAST(d2 AS DOUBLE)) / 15) - CASE v WHEN 2 THEN 45 ELSE 0 END END AS z FROM dies)",
)
_add("title_stats", f"SELECT wafer, {_n('n_die', 'n_fail')}, round((1 - fail_frac) * 100, 6) AS yield_pct, y_pred FROM v", DIES, GLOBAL, VERDICT)
_add(
    "lot_summary",
    """SELECT s.lot, s.n AS n_wafers, round(mean_yield, 6) AS mean_yield, round(min_yield, 6) AS min_yield, y_pred AS top_pattern, k AS top_count, round(match_rate, 6) AS match_rate,
  CASE WHEN mean_yield < 90 THEN 'review' ELSE 'ok' END AS verdict
FROM (SELECT CAST(lot AS BIGINT) AS lot, count(*) AS n, avg((1 - fail_frac) * 100) AS mean_yield, min((1 - fail_frac) * 100) AS min_yield, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS match_rate FROM v GROUP BY lot) s
JOIN (SELECT lot, y_pred, count(*) AS k, row_number() OVER (PARTITION BY lot ORDER BY count(*) DESC, y_pred) AS i FROM v GROUP BY lot, y_pred) t ON t.lot = s.lot AND t.i = 1""",
    DIES, GLOBAL, VERDICT,
)

# --- metrics ---

_add("label_dist", "SELECT y_true, count(*) AS n FROM g GROUP BY y_true", DIES, GLOBAL)
_add(
    "class_feature_medians",
    "SELECT y_true AS name, count(*) AS n, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, "
    + ", ".join(f"round(median({c}), 6) AS {c}" for c in ("fail_frac", "r_mean", "r_std", "dir_c", "axial_c"))
    + " FROM v GROUP BY y_true",
    DIES, GLOBAL, VERDICT,
)
NINE = """
nine AS (SELECT wafer, fail_frac, CASE y_true WHEN 'CLEAN' THEN 'NONE' ELSE y_true END AS y_true, CASE y_pred WHEN 'CLEAN' THEN 'NONE' ELSE y_pred END AS y_pred FROM v)
"""
_add(
    "confusion9",
    f"SELECT a.name AS truth, b.name AS pred, count(n.wafer) AS n FROM (VALUES {_values(CLASSES9)}) a(name) CROSS JOIN (VALUES {_values(CLASSES9)}) b(name) LEFT JOIN nine n ON n.y_true = a.name AND n.y_pred = b.name GROUP BY 1, 2",
    DIES, GLOBAL, VERDICT, NINE,
)
_EIGHT = _MACRO.format(key="", rows="v", names=_values(CLASSES))
_add(
    "class_report",
    "SELECT name, support, round(coalesce(tp::DOUBLE / nullif(named, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(support, 0), 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1 FROM f1",
    DIES, GLOBAL, VERDICT, _EIGHT,
)
_add("macro_f1", "SELECT round(avg(coalesce(f1, 0)), 6) AS macro_f1, round(avg(coalesce(f1, 0)) FILTER (support > 0), 6) AS macro_f1_present FROM f1", DIES, GLOBAL, VERDICT, _EIGHT)
_add(
    "balanced_acc",
    "SELECT round((SELECT avg(tp::DOUBLE / support) FROM f1 WHERE support > 0), 6) AS balanced_accuracy, round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM v",
    DIES, GLOBAL, VERDICT, _MACRO.format(key="", rows="v", names=_values((*CLASSES, "CLEAN"))),
)
FEATURE_CTES = (DIES, GLOBAL, BOX, RING, LABELS, COMPS, _ALL)
AUC = f"""
u AS (SELECT wafer, y_true, feature, value FROM (UNPIVOT (SELECT wafer, y_true, round(elongation, 3) AS elongation, {_r(*_FEATURES)} FROM fa) ON elongation, {", ".join(_FEATURES)} INTO NAME feature VALUE value)),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM u),
auc AS (SELECT name, feature, coalesce((sum(r) FILTER (y_true = name) - count(*) FILTER (y_true = name) * (count(*) FILTER (y_true = name) + 1) / 2.0::DOUBLE)
  / nullif(count(*) FILTER (y_true = name) * count(*) FILTER (y_true <> name), 0)::DOUBLE, 0.5::DOUBLE) AS auc FROM rk, (VALUES {_values(CLASSES)}) k(name) GROUP BY name, feature)
"""
_add("auc_ovr_table", "SELECT name, feature, round(auc, 6) AS auc FROM auc", *FEATURE_CTES, AUC, recursive=True)
_add("auc_rank", "SELECT name, feature, round(auc, 6) AS auc FROM auc ORDER BY round(abs(auc - 0.5::DOUBLE), 9) DESC, name, feature LIMIT 10", *FEATURE_CTES, AUC, recursive=True)

SCORES = """
s AS (SELECT l.doc_id, 1.0::DOUBLE / (1 + n_chars / 1000.0::DOUBLE) AS p, quality = 0 AS is_defect, source AS y_true FROM labels l JOIN documents d USING (doc_id))
"""
ROC = """
bt AS (SELECT p AS threshold, count(*) FILTER (is_defect) AS d, count(*) FILTER (NOT is_defect) AS n FROM s GROUP BY p),
roc AS (SELECT threshold, sum(d) OVER w AS tp, sum(n) OVER w AS fp, sum(d) OVER w / (SELECT sum(d) FROM bt)::DOUBLE AS tpr, sum(n) OVER w / (SELECT sum(n) FROM bt)::DOUBLE AS fpr FROM bt
  WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
"""
_FARS = ", ".join(f"({_d(f)})" for f in FAR)
CUTS = "cut AS (" + " UNION ALL ".join(f"SELECT {_d(f)} AS far, quantile_cont(p, {_d(1.0 - f)}) AS threshold FROM s WHERE NOT is_defect" for f in FAR) + ")"
_add("roc_points", f"SELECT round(threshold, 6) AS threshold, {_n('tp', 'fp')}, {_r('tpr', 'fpr')} FROM roc", SCORES, ROC)
_add(
    "avg_precision",
    "SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc, round(sum((tpr - pt) * tp / (tp + fp)), 6) AS average_precision FROM (SELECT *, lag(fpr, 1, 0.0::DOUBLE) OVER (ORDER BY threshold DESC) AS pf, lag(tpr, 1, 0.0::DOUBLE) OVER (ORDER BY threshold DESC) AS pt FROM roc)",
    SCORES, ROC,
)
_add(
    "recall_at_far",
    f"""SELECT round(far, 6) AS far, round(a.tpr + coalesce((b.tpr - a.tpr) / (b.fpr - a.fpr) * (far - a.fpr), 0), 6) AS recall FROM (
  SELECT far, max(struct_pack(fpr := fpr, tpr := tpr)) FILTER (fpr <= far) AS a, min(struct_pack(fpr := fpr, tpr := tpr)) FILTER (fpr > far) AS b
  FROM (SELECT fpr, tpr FROM roc UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE), (VALUES {_FARS}) t(far) GROUP BY far)""",
    SCORES, ROC,
)
_add("far_threshold", f"SELECT {_r('far', 'threshold')} FROM cut", SCORES, CUTS)
_F1 = "CASE WHEN p > threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_add(
    "operating_points",
    f"SELECT {_r('far', 'threshold')}, round(avg({_F1}) FILTER (NOT is_defect), 6) AS actual_far, round(avg({_F1}) FILTER (is_defect), 6) AS recall, round(avg({_F1}), 6) AS review FROM s, cut GROUP BY far, threshold",
    SCORES, CUTS,
)
_add(
    "miss_table",
    "SELECT y_true AS name, count(*) AS total, count(*) FILTER (NOT p > 0.5::DOUBLE) AS missed, round(avg(CASE WHEN p > 0.5::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS miss_rate FROM s WHERE is_defect GROUP BY y_true",
    SCORES,
)
_add(
    "cascade_eval",
    "SELECT round((SELECT avg(coalesce(f1, 0)) FROM fc1), 6) AS f1_cascade, round((SELECT avg(coalesce(f1, 0)) FROM fp1), 6) AS f1_perfect",
    DIES, GLOBAL, VERDICT, NINE,
    "ca AS (SELECT y_true, CASE WHEN fail_frac > 0.05::DOUBLE THEN y_pred ELSE 'NONE' END AS y_pred FROM nine)",
    "pe AS (SELECT y_true, CASE WHEN y_true = 'NONE' THEN 'NONE' ELSE y_pred END AS y_pred FROM nine)",
    _MACRO.format(key="", rows="ca", names=_values(CLASSES)).replace("f1 AS (", "fc1 AS (", 1),
    _MACRO.format(key="", rows="pe", names=_values(CLASSES)).replace("f1 AS (", "fp1 AS (", 1),
)
_add(
    "paired_models",
    """SELECT a.model, round(avg(a.f1), 6) AS mean, round(stddev_samp(a.f1), 6) AS std, round(min(a.f1), 6) AS low, round(max(a.f1), 6) AS high,
  round(avg(round(a.f1 - b.f1, 9)), 6) AS mean_gain, count(*) FILTER (round(a.f1 - b.f1, 9) > 0) AS wins, count(*) AS n
FROM acc a JOIN acc b ON b.seed = a.seed AND b.model = 'default' GROUP BY a.model""",
    DIES, GLOBAL,
    f"rows2 AS (SELECT lot % 5 AS seed, y_true, 'default' AS model, {_rule(DEFAULT)} AS y_pred FROM g UNION ALL SELECT lot % 5, y_true, 'calibrated', {_rule({k: v for k, v in CALIBRATED.items() if k in DEFAULT})} FROM g)",
    _MACRO.format(key="model, seed,", rows="rows2", names=_values(CLASSES)),
    "acc AS (SELECT model, seed, avg(coalesce(f1, 0)) AS f1 FROM f1 GROUP BY model, seed)",
)
_add(
    "operating_curve",
    "SELECT round(far, 6) AS far, round(avg(recall), 6) AS mean, round(min(recall), 6) AS low, round(max(recall), 6) AS high FROM oc GROUP BY far",
    SCORES, CUTS, f"oc AS (SELECT doc_id % 4 AS seed, far, avg({_F1}) AS recall FROM s, cut WHERE is_defect GROUP BY 1, 2)",
)

# --- process control ---

_KINDS = "('click'), ('error'), ('purchase'), ('signup'), ('view')"


def _stream(planted: bool) -> str:
    kind = "CASE WHEN event_id >= (SELECT (max(event_id) + 1) * 8 // 10 FROM events) AND event_id % 5 = 0 THEN 'error' ELSE event_type END" if planted else "event_type"
    return f"""
st AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, CAST(user_id AS VARCHAR) AS lot, CAST(event_id // 17 AS VARCHAR) AS run_lot, {kind} AS y_pred,
  1 - least(value, 100) / 100.0::DOUBLE AS confidence, value / 500.0::DOUBLE AS fail_frac FROM events),
hit AS (SELECT c.chart, idx, lot, CASE WHEN y_pred = c.chart THEN 1 ELSE 0 END AS hit FROM st, (VALUES {_KINDS}) c(chart)),
nb AS (SELECT count(*) // 2 AS half, count(*) AS total FROM events)
"""


_GROUPS = """
sz AS (SELECT chart, CAST(ceil(5.0::DOUBLE / avg(hit) FILTER (idx < (SELECT half FROM nb)) / 25) * 25 AS BIGINT) AS size FROM hit GROUP BY chart HAVING avg(hit) FILTER (idx < (SELECT half FROM nb)) > 0),
gr AS (SELECT h.*, idx // size AS gid FROM hit h JOIN sz USING (chart), nb WHERE NOT (total % size > 0 AND 2 * (total % size) < size AND idx >= total - total % size)),
lots AS (SELECT chart, gid, lot, count(*) AS n, sum(hit) AS hit, max(idx) AS last, min(idx) AS first FROM gr GROUP BY ALL),
sg AS (SELECT chart, gid, sum(n) AS n, sum(hit) AS count, max(last) AS end_idx, array_to_string(list(lot ORDER BY first)[1:3], ',') || CASE WHEN count(*) > 3 THEN '…' ELSE '' END AS lots FROM lots GROUP BY chart, gid),
sb AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY gid) - 1 AS i, greatest(3, sum(CASE WHEN end_idx < (SELECT half FROM nb) THEN 1 ELSE 0 END) OVER (PARTITION BY chart)) AS n_base, count(*) OVER (PARTITION BY chart) AS n_groups FROM sg),
sc AS (SELECT *, count / n::DOUBLE AS value, sum(count) FILTER (i < n_base) OVER (PARTITION BY chart) / (sum(n) FILTER (i < n_base) OVER (PARTITION BY chart))::DOUBLE AS center FROM sb WHERE n_groups - n_base >= 2),
s0 AS (SELECT *, sqrt(center * (1 - center) / n) AS sg0, (value - center) / sqrt(center * (1 - center) / n) AS z0 FROM sc WHERE center > 0 AND center < 1),
s1 AS (SELECT *, CASE WHEN i < n_base THEN abs(z0 - lag(z0) OVER (PARTITION BY chart ORDER BY i)) END AS step FROM s0),
s2 AS (SELECT *, greatest(1.0::DOUBLE, avg(step) OVER (PARTITION BY chart) / 1.128::DOUBLE) AS sigma_z FROM s1),
ch AS (SELECT *, sg0 * sigma_z AS sigma, (value - center) / (sg0 * sigma_z) AS z, least(greatest(center + 3 * sg0 * sigma_z, 0.0::DOUBLE), 1.0::DOUBLE) AS ucl, least(greatest(center - 3 * sg0 * sigma_z, 0.0::DOUBLE), 1.0::DOUBLE) AS lcl FROM s2)
"""


def _we(k: int, least: int, beyond: str) -> str:
    w = f"OVER (PARTITION BY chart ORDER BY i ROWS {k - 1} PRECEDING)"
    return f"(count(*) {w} = {k} AND (count(*) FILTER (z > {beyond}) {w} >= {least} OR count(*) FILTER (z < -{beyond}) {w} >= {least}))"


_WE = f"""
we AS (SELECT *, abs(z) > 3 AS r1, {_we(3, 2, "2")} AS r2, {_we(5, 4, "1")} AS r3, {_we(8, 8, "0")} AS r4 FROM ch)
"""
# The fold as a weighted sum over each chart's points so far.
_EW = """
ew AS (SELECT a.chart, a.i, sum(0.2::DOUBLE * pow(0.8::DOUBLE, a.i - b.i) * b.z) AS ewma, 2.7::DOUBLE * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (a.i + 1)))) AS ewma_limit FROM ch a JOIN ch b ON b.chart = a.chart AND b.i <= a.i GROUP BY a.chart, a.i)
"""
_AL = """
al AS (SELECT chart, i, end_idx, value, z, n_base, unnest(['R1', 'R2', 'R3', 'R4', 'EWMA']) AS rule, unnest([r1, r2, r3, r4, abs(ewma) > ewma_limit]) AS hot FROM we JOIN ew USING (chart, i)),
alarm AS (SELECT chart, CAST(i AS BIGINT) AS subgroup, CAST(end_idx AS BIGINT) AS end_idx, CASE WHEN i < n_base THEN 'baseline' ELSE 'monitor' END AS phase, rule, round(value, 6) AS value, round(z, 6) AS z, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction FROM al WHERE hot),
fd AS (SELECT chart, rule, min(end_idx) AS first_idx FROM alarm WHERE phase = 'monitor' GROUP BY chart, rule)
"""
_add(
    "subgroups_fixed",
    f"SELECT chart, gid, {_n('n', 'count', 'end_idx')}, lots FROM sg",
    _stream(False),
    "gr AS (SELECT h.*, idx // 30 AS gid FROM hit h, nb WHERE NOT (total % 30 > 0 AND 2 * (total % 30) < 30 AND idx >= total - total % 30))",
    *_GROUPS.strip().split(",\n")[2:4],
)
_add(
    "subgroups_by_lot",
    """SELECT f.run, first_idx, size, lot, CASE WHEN gid = (SELECT max(gid) FROM f) AND 2 * (SELECT n FROM f ORDER BY run DESC LIMIT 1) < 50 AND (SELECT n FROM f ORDER BY run DESC LIMIT 1) < 50 THEN -1 ELSE gid END AS gid
FROM f JOIN runs USING (run)""",
    _stream(False),
    "ch0 AS (SELECT idx, run_lot, CASE WHEN run_lot IS DISTINCT FROM lag(run_lot) OVER (ORDER BY idx) OR idx = 0 THEN 1 ELSE 0 END AS new FROM st)",
    "rn AS (SELECT *, sum(new) OVER (ORDER BY idx) - 1 AS run FROM ch0)",
    "runs AS (SELECT CAST(run AS BIGINT) AS run, min(idx) AS first_idx, count(*) AS size, any_value(run_lot) AS lot FROM rn GROUP BY run)",
    """f(run, gid, n) AS (SELECT run, 0::BIGINT, size FROM runs WHERE run = 0 UNION ALL
  SELECT r.run, CASE WHEN f.n >= 50 THEN f.gid + 1 ELSE f.gid END, CASE WHEN f.n >= 50 THEN r.size ELSE f.n + r.size END FROM f JOIN runs r ON r.run = f.run + 1)""",
    recursive=True,
)
_add(
    "adaptive_size",
    f"SELECT chart, {_n('size')}, (SELECT total FROM nb) AS total FROM sz",
    _stream(False).replace("FROM st, (VALUES", "FROM st, (VALUES").replace("c(chart)),", "c(chart) UNION ALL SELECT 'LOW_CONFIDENCE', idx, lot, CASE WHEN confidence < 0.7::DOUBLE THEN 1 ELSE 0 END FROM st),"),
    _GROUPS.strip().split(",\n")[0],
)
_add("p_chart", f"SELECT chart, {_n('i', 'n', 'count', 'end_idx')}, lots, {_r('value', 'center', 'sigma', 'z', 'ucl', 'lcl')} FROM ch", _stream(False), _GROUPS)
_add("laney_factor", f"SELECT DISTINCT chart, round(sigma_z, 6) AS sigma_z, {_n('n_base')} FROM ch", _stream(False), _GROUPS)
_add(
    "imr_chart",
    "SELECT 'FAIL_FRAC_MEAN' AS chart, CAST(gid AS BIGINT) AS i, round(value, 6) AS value, round(center, 6) AS center, round(sigma, 6) AS sigma, round((value - center) / sigma, 6) AS z FROM m3 WHERE sigma > 0",
    _stream(False),
    "m1 AS (SELECT idx // 25 AS gid, avg(fail_frac) AS value, max(idx) AS end_idx FROM st, nb WHERE NOT (total % 25 > 0 AND 2 * (total % 25) < 25 AND idx >= total - total % 25) GROUP BY 1)",
    "m2 AS (SELECT *, greatest(3, (SELECT count(*) FROM m1 WHERE end_idx < (SELECT half FROM nb))) AS n_base, abs(value - lag(value) OVER (ORDER BY gid)) AS step FROM m1)",
    "m3 AS (SELECT *, avg(value) FILTER (gid < n_base) OVER () AS center, avg(step) FILTER (gid < n_base) OVER () / 1.128::DOUBLE AS sigma FROM m2)",
)
_add("western_electric", f"SELECT chart, {_n('i')}, r1 AS R1, r2 AS R2, r3 AS R3, r4 AS R4 FROM we", _stream(True), _GROUPS, _WE)
_add("ewma", f"SELECT chart, {_n('i')}, {_r('ewma', 'ewma_limit')}, abs(ewma) > ewma_limit AS above_ewma FROM ew", _stream(True), _GROUPS, _EW)
_add("alarm_log", "SELECT * FROM alarm", _stream(True), _GROUPS, _WE, _EW, _AL)
_add("first_detection", "SELECT * FROM fd", _stream(True), _GROUPS, _WE, _EW, _AL)
_add(
    "rule_pivot",
    "SELECT chart, " + ", ".join(f"coalesce(CAST(min(first_idx) FILTER (rule = '{r}') AS VARCHAR), '-') AS {r}" for r in ("R1", "R2", "R3", "R4", "EWMA")) + " FROM fd GROUP BY chart",
    _stream(True), _GROUPS, _WE, _EW, _AL,
)
_add(
    "baseline_alarm_rate",
    "SELECT alarms, groups, round(alarms / groups::DOUBLE, 6) AS rate, alarms / groups::DOUBLE > 0.05::DOUBLE AS warn FROM (SELECT (SELECT count(*) FROM alarm WHERE phase = 'baseline') AS alarms, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT max(n_base) AS n FROM ch GROUP BY chart)) AS groups)",
    _stream(True), _GROUPS, _WE, _EW, _AL,
)

# --- commonality ---

_T3 = "((l_partkey % 200) * (l_partkey % 200) * 5 + (l_partkey % 200) * 22) % 97 % 4"


def _traced(planted: bool = True, p: str = "") -> str:
    hit = f"l_returnflag = 'R' OR ({_T3} = 2 AND l_quantity > 35)" if planted else "l_returnflag = 'R'"
    return f"""
{p}rates AS (SELECT l_partkey % 200 AS lot, count(*) AS n_wafers, avg(CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM lineitem GROUP BY 1)
"""


HISTORY = """
lots0 AS (SELECT DISTINCT l_partkey % 200 AS lot, CAST(l_linenumber AS BIGINT) AS step FROM lineitem),
hist AS (SELECT lot, step, CAST(CASE WHEN step = 5 AND (lot * lot * 5 + lot * 22) % 97 % 4 = 2 AND lot % 4 < 3 THEN 1 ELSE (lot * lot * (step + 2) + lot * (step * 7 + 1)) % 97 % 4 END AS BIGINT) AS tool FROM lots0)
"""


def _tail(z: str) -> str:
    x, t = f"(abs({z}) / sqrt(2.0::DOUBLE))", f"(1.0::DOUBLE / (1.0::DOUBLE + abs({z}) / sqrt(2.0::DOUBLE) * 0.5::DOUBLE))"
    poly = _d(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({_d(c)} + {t} * {poly})"
    tail = f"({t} * exp(-{x} * {x} + {poly}) * 0.5::DOUBLE)"
    return f"CASE WHEN {z} >= 0 THEN {tail} WHEN {z} < 0 THEN 1 - {tail} END"


def _test(p: str = "", rates: str = "rates", last: str = "ct") -> str:
    return f"""
{p}rk AS (SELECT step, tool, h.lot, rate, rank() OVER (PARTITION BY step ORDER BY rate) + (count(*) OVER (PARTITION BY step, rate) - 1) / 2.0::DOUBLE AS r FROM hist h JOIN {rates} USING (lot)),
{p}ti AS (SELECT step, sum(c * c * c - c) AS ties, count(*) AS kinds, sum(c) AS total, sum(c * rate) AS allr FROM (SELECT step, rate, count(*) AS c FROM {p}rk GROUP BY step, rate) GROUP BY step),
{p}t0 AS (SELECT k.step, tool, count(*) AS n_lots, any_value(total) - count(*) AS n_others, avg(rate) AS rate_through, (any_value(allr) - sum(rate)) / nullif(any_value(total) - count(*), 0) AS rate_others,
  sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE AS u, any_value(ties) AS ties, any_value(kinds) AS kinds, any_value(total)::DOUBLE AS n FROM {p}rk k JOIN {p}ti USING (step) GROUP BY k.step, tool),
{p}t1 AS (SELECT *, rate_through - rate_others AS delta, CASE WHEN n_lots >= 5 AND n_others >= 5 AND kinds > 1 THEN (u - n_lots * n_others / 2.0::DOUBLE - 0.5::DOUBLE) / nullif(sqrt(n_lots * n_others / 12.0::DOUBLE * ((n + 1) - ties::DOUBLE / (n * (n - 1)))), 0) END AS z FROM {p}t0),
{p}t2 AS (SELECT *, {_tail("z")} AS p FROM {p}t1),
{p}t3 AS (SELECT *, CASE WHEN p IS NOT NULL THEN p * count(p) OVER () / row_number() OVER (PARTITION BY p IS NULL ORDER BY p, step, tool) END AS raw, CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY p IS NULL ORDER BY p, step, tool) END AS k FROM {p}t2),
{p}{last} AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, min(raw) OVER (PARTITION BY p IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS p_adj FROM {p}t3)
"""


_PLACE = """
pl AS (SELECT *, row_number() OVER (ORDER BY round(p_adj, 12) NULLS LAST, round(delta, 9) DESC NULLS LAST, step, tool) AS place FROM ct)
"""
_CONF = (
    """
hd AS (SELECT step AS s, tool AS t FROM pl WHERE place = 1 AND p_adj < 0.05::DOUBLE),
rest AS (SELECT * FROM rates WHERE lot NOT IN (SELECT lot FROM hist, hd WHERE step = s AND tool = t))
"""
    + ","
    + _test("b_", "rest")
    + """,
cf AS (SELECT pl.*, CASE WHEN (SELECT count(*) FROM pl WHERE p_adj < 0.05::DOUBLE) >= 2 AND (SELECT count(*) FROM rest) >= 10 AND pl.p_adj < 0.05::DOUBLE AND place > 1 THEN
    CASE WHEN b.step IS NULL THEN (SELECT s || '/' || t || ' (no lots)' FROM hd) WHEN b.p_adj IS NULL OR b.p_adj >= 0.05::DOUBLE THEN (SELECT s || '/' || t FROM hd) ELSE '' END ELSE '' END AS confounded_with
  FROM pl LEFT JOIN b_ct b ON b.step = pl.step AND b.tool = pl.tool)
"""
)
_add("lot_rates", "SELECT lot, n_wafers, round(rate, 6) AS rate FROM rates", _traced())
_add(
    "history_dups",
    "SELECT lot, step, count(DISTINCT tool) AS n_tools FROM (SELECT * FROM hist UNION ALL SELECT lot, step, tool + 10 FROM hist WHERE step = 2 AND lot % 3 = 0) GROUP BY lot, step HAVING count(DISTINCT tool) > 1",
    HISTORY,
)
_add("commonality", f"SELECT step, tool, {_n('n_lots', 'n_others')}, {_r('rate_through', 'rate_others', 'delta', 'u', 'z', 'p', 'p_adj')} FROM ct", _traced(), HISTORY, _test())
_add(
    "bh_adjust",
    "SELECT step, tool, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM ct",
    HISTORY,
    "t2 AS (SELECT DISTINCT step, tool, CASE WHEN (step * 37 + tool * 101) % 97 % 7 <> 0 THEN ((step * 37 + tool * 101) % 97) / 997.0::DOUBLE END AS p FROM hist)",
    *_test().strip().split(",\n")[-2:],
)
_add("confounding", "SELECT step, tool, round(p_adj, 6) AS p_adj, place, confounded_with FROM cf", _traced(), HISTORY, _test(), _PLACE, _CONF)
_add(
    "verdict",
    "SELECT step, tool, place, CASE WHEN p IS NULL THEN 'held' WHEN p_adj >= 0.05::DOUBLE THEN 'not significant' WHEN confounded_with = '' THEN 'independent' ELSE 'confounded' END AS verdict FROM cf",
    _traced(), HISTORY, _test(), _PLACE, _CONF,
)
_add(
    "top_per_pattern",
    """SELECT * FROM (SELECT 'planted' AS pattern, step, tool, round(delta, 6) AS delta, round(p_adj, 6) AS p_adj, p_adj < 0.05::DOUBLE AS significant FROM ct ORDER BY round(ct.p_adj, 12) NULLS LAST, round(ct.delta, 9) DESC, step, tool LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'null', step, tool, round(delta, 6), round(p_adj, 6), p_adj < 0.05::DOUBLE FROM n_ct ORDER BY round(n_ct.p_adj, 12) NULLS LAST, round(n_ct.delta, 9) DESC, step, tool LIMIT 1)""",
    _traced(), _traced(False, "n_"), HISTORY, _test(), _test("n_", "n_rates"),
)
_add(
    "tool_rates",
    "SELECT h.step, h.tool, h.lot, round(rate, 6) AS rate FROM hist h JOIN rates USING (lot) WHERE h.step IN (SELECT step FROM pl GROUP BY step ORDER BY min(place) LIMIT 3)",
    _traced(), HISTORY, _test(), _PLACE,
)
_add(
    "lot_overlap",
    "SELECT (SELECT count(*) FROM (SELECT lot FROM rates WHERE rate > 0.3::DOUBLE INTERSECT SELECT lot FROM hist WHERE tool = 2)) AS both, (SELECT count(*) FROM (SELECT lot FROM rates WHERE rate > 0.3::DOUBLE UNION SELECT lot FROM hist WHERE tool = 2)) AS either",
    _traced(), HISTORY,
)

# --- splits, labels, lots as subgroups ---

_MD5 = "CAST('0x' || substr(md5('42:' || CAST(lot AS VARCHAR)), 1, 8) AS BIGINT)"
_add(
    "lot_split",
    "SELECT wafer, g.lot, k < floor(n * 0.3::DOUBLE + 1e-9::DOUBLE) AS is_test FROM g JOIN ls USING (lot)",
    DIES, GLOBAL,
    f"ls AS (SELECT lot, row_number() OVER (ORDER BY {_MD5}, lot) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lot FROM g))",
)
_add(
    "lot_folds",
    "SELECT wafer, g.lot, CAST(fold AS BIGINT) AS fold FROM g JOIN lf USING (lot)",
    DIES, GLOBAL,
    "ls AS MATERIALIZED (SELECT lot, n, row_number() OVER (ORDER BY n DESC, lot) AS k FROM (SELECT lot, count(*) AS n FROM g GROUP BY lot))",
    """lf(k, lot, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([0, 0, 0, 0] AS BIGINT[])
  UNION ALL
  SELECT ls.k, ls.lot, list_position(loads, list_min(loads)) - 1,
    list_transform(range(1, 5), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN n ELSE 0 END)
  FROM lf JOIN ls ON ls.k = lf.k + 1)""",
    recursive=True,
)
_add(
    "pairwise_auc",
    """SELECT name, other, feature, round(coalesce(sum(CASE WHEN a.value > b.value THEN 1.0::DOUBLE WHEN a.value = b.value THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / nullif(count(b.value), 0), 0.5::DOUBLE), 6) AS auc
FROM (VALUES ('EDGE_LOC', 'LOC'), ('SCRATCH', 'LOC')) AS p(name, other) CROSS JOIN (SELECT DISTINCT feature FROM u) f
JOIN u a ON a.y_true = name AND a.feature = f.feature JOIN u b ON b.y_true = other AND b.feature = f.feature GROUP BY name, other, f.feature""".replace("SELECT name, other, feature", "SELECT name, other, f.feature AS feature"),
    *FEATURE_CTES, AUC, recursive=True,
)
_add(
    "cascade_none",
    """SELECT round(coalesce(avg(CASE WHEN y_true = 'NONE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (y_pred = 'NONE'), 0), 6) AS none_precision,
  round(avg(CASE WHEN y_pred = 'NONE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (y_true = 'NONE'), 6) AS none_recall,
  round(avg(CASE WHEN y_pred <> 'NONE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS review_frac FROM ca""",
    DIES, GLOBAL, VERDICT, NINE,
    "ca AS (SELECT y_true, CASE WHEN fail_frac > 0.05::DOUBLE THEN y_pred ELSE 'NONE' END AS y_pred FROM nine)",
)
_SHOWN = "(SELECT DISTINCT wafer, lot, y_true FROM dies)"
_add("labelled_wafers", f"SELECT CAST(lot AS BIGINT) AS lot, wafer AS wafer_index, CASE y_true WHEN 'CLEAN' THEN 'NONE' ELSE y_true END AS y_true, CAST(31 AS BIGINT) AS height FROM {_SHOWN} WHERE wafer % 7 <> 0", DIES)
_add(
    "raw_labels",
    f"""SELECT CASE WHEN wafer % 7 = 0 THEN NULL ELSE CASE y_true WHEN 'CLEAN' THEN 'none' WHEN 'CENTER' THEN 'Center' WHEN 'DONUT' THEN 'Donut' WHEN 'EDGE_LOC' THEN 'Edge-Loc' WHEN 'EDGE_RING' THEN 'Edge-Ring'
  WHEN 'LOC' THEN 'Loc' WHEN 'NEAR_FULL' THEN 'Near-full' WHEN 'RANDOM' THEN 'Random' WHEN 'SCRATCH' THEN 'Scratch' END END AS ftype, count(*) AS n FROM {_SHOWN} GROUP BY 1""",
    DIES,
)
_add("map_shapes", f"SELECT count(DISTINCT CASE WHEN wafer % 3 <> 0 THEN 31 ELSE 31 - wafer % 4 END) AS n_shapes FROM {_SHOWN}", DIES)
ORACLES["ordered_predictions"] = (
    "SELECT event_id, CAST(event_id // 17 AS VARCHAR) AS lot, event_type AS y_pred, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0"
)
# Whole runs merged until they hold a chart's size, one chart after the other; the last open group counts from half of it.
_add(
    "p_chart_by_lot",
    f"SELECT chart, {_n('i', 'n', 'count', 'end_idx')}, {_r('value', 'center', 'sigma', 'z')} FROM ch",
    _stream(False),
    "ch0 AS (SELECT idx, run_lot, CASE WHEN run_lot IS DISTINCT FROM lag(run_lot) OVER (ORDER BY idx) OR idx = 0 THEN 1 ELSE 0 END AS new FROM st)",
    "rn AS (SELECT *, sum(new) OVER (ORDER BY idx) - 1 AS run FROM ch0)",
    "runs AS (SELECT CAST(run AS BIGINT) AS run, count(*) AS len FROM rn GROUP BY run)",
    _GROUPS.strip().split(",\n")[0],
    """f(chart, size, run, gid, n) AS (SELECT chart, size, run, 0::BIGINT, len FROM sz, runs WHERE run = 0 UNION ALL
  SELECT f.chart, f.size, r.run, CASE WHEN f.n >= f.size THEN f.gid + 1 ELSE f.gid END, CASE WHEN f.n >= f.size THEN r.len ELSE f.n + r.len END FROM f JOIN runs r ON r.run = f.run + 1)""",
    "tail AS (SELECT chart, arg_max(gid, run) AS gid, arg_max(n, run) AS n, any_value(size) AS size FROM f GROUP BY chart)",
    """sg AS (SELECT h.chart, f.gid, count(*) AS n, sum(hit) AS count, max(h.idx) AS end_idx FROM hit h JOIN rn USING (idx) JOIN f ON f.chart = h.chart AND f.run = rn.run
  JOIN tail t ON t.chart = h.chart WHERE NOT (f.gid = t.gid AND 2 * t.n < t.size) GROUP BY h.chart, f.gid)""",
    *_GROUPS.strip().split(",\n")[4:],
    recursive=True,
)
