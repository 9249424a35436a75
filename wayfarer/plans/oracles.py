"""DuckDB SQL for the registered queries, written from their definitions."""

from __future__ import annotations

_SIGNALS = r"""e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events),
s AS (SELECT event_id, regexp_replace(printf('%06x%06x', user_id % 25, user_id), '(..)(..)(..)(..)(..)(..)', '\1:\2:\3:\4:\5:\6') mac_address,
 ts date_time, CASE user_id % 3 WHEN 0 THEN 'Mall of Mauritius' WHEN 1 THEN 'Phoenix Mall' ELSE 'Home & Leisure' END AS location,
 CASE event_type WHEN 'signup' THEN 'A' || (101 + k % 5) WHEN 'view' THEN 'B' || (101 + k % 7) WHEN 'click' THEN 'B' || (108 + k % 7)
  WHEN 'purchase' THEN 'B' || (115 + k % 7) END store_id, value x, CAST(k AS DOUBLE) y,
 CASE k % 5 WHEN 0 THEN 'wifiuser' WHEN 1 THEN 'lawifiuser' WHEN 2 THEN 'Discovered-AP' WHEN 3 THEN 'fatti Bot ' ELSE 'unknown' END wifi_type FROM e)"""
_COARSE = _SIGNALS + """,
c AS (SELECT * REPLACE (date_trunc('day', date_time) + INTERVAL 6 HOUR * (hour(date_time) // 6) AS date_time) FROM s)"""
_OUI = "oui AS (SELECT upper(printf('%06x', n_nationkey)) prefix, n_name manufacturer FROM nation)"


def _round(expr: str, digits: int = 6) -> str:
    return f"(round({expr} + 3e-{digits + 3}, {digits}) + 0.0)"


def _seconds(a: str, b: str) -> str:
    d = f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 1e6) AS BIGINT)"
    return f"((({d} % 86400) + 86400) % 86400)"


def _tod(t: str = "date_time") -> str:
    return f"((epoch_us({t}) % 86400000000) / 1e6)"


def _bin(t: str, minutes: int) -> str:
    w = minutes * 60_000_000
    return f"make_timestamp(CAST(round_even(epoch_us({t}) / {w}.0::DOUBLE, 0) AS BIGINT) * {w})"


def _steps(source: str = "s", keys: str = "mac_address") -> str:
    """Steps and turns over the signals of ``source``."""
    return f"""st0 AS (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1, lead(x, 2) OVER w x2, lead(y, 2) OVER w y2, lead(date_time) OVER w t1,
 row_number() OVER w n FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY date_time, event_id)),
st1 AS (SELECT *, x1 - x dx, y1 - y dy, x2 - x1 ex, y2 - y1 ey, {_seconds('date_time', 't1')} ds, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) chord FROM st0),
st2 AS (SELECT *, sqrt(dx * dx + dy * dy) d, sqrt(ex * ex + ey * ey) e FROM st1),
st3 AS (SELECT *, (dx * ex + dy * ey) / nullif(d * e, 0) cosine, (d + e) / nullif(chord, 0) straight FROM st2),
st4 AS (SELECT *, CASE WHEN abs(cosine) <= 1 THEN acos(cosine) END theta FROM st3),
st AS (SELECT *, lead(theta) OVER (PARTITION BY {keys} ORDER BY date_time, event_id) next_theta FROM st4)"""


_NO_REPEATS = """u AS (SELECT * FROM (SELECT *, lead(store_id) OVER (PARTITION BY mac_address ORDER BY date_time, event_id) after_store FROM s)
 WHERE after_store IS NULL OR store_id IS NULL OR after_store <> store_id)"""
_MEASURES = ", ".join(
    f"{_round(e)} {n}"
    for n, e in {
        "av_speed": "avg(CASE WHEN ds > 0 THEN d / ds END)",
        "av_turning_angle": "avg(theta)",
        "total_turning_angle": "CASE WHEN count(*) > 2 THEN coalesce(sum(abs(theta)), 0.0) END",
        "av_turning_angle_velocity": "avg(next_theta - theta)",
        "av_path_length": "avg(d)",
        "total_path_length": "sum(d)",
        "av_straightness": "avg(straight)",
    }.items()
)
_GYRATION = f"{_round('avg(x)')} centroid_x, {_round('avg(y)')} centroid_y, {_round('sqrt(var_pop(x) + var_pop(y))')} radius_of_gyration"
_WIFI = """list_extract(['wifiuser', 'lawifiuser', 'Discovered-AP', 'fatti Bot ', 'unknown'], CAST(min(CASE wifi_type WHEN 'wifiuser' THEN 1
 WHEN 'lawifiuser' THEN 2 WHEN 'Discovered-AP' THEN 3 WHEN 'fatti Bot ' THEN 4 ELSE 5 END) AS INTEGER))"""

#: Devices with the few features that later queries use, unrounded.
_DEVICES = f"""{_SIGNALS}, {_steps()},
d AS (SELECT mac_address, count(*) frequency, sqrt(var_pop(x) + var_pop(y)) radius_of_gyration, avg(d) av_path_length, sum(d) total_path_length, avg(theta) av_turning_angle,
 CAST('0x' || right(mac_address, 2) AS INTEGER) no FROM st GROUP BY ALL),
f AS (SELECT *, CASE no % 4 WHEN 0 THEN 'Stationary' WHEN 1 THEN 'Shopper' WHEN 2 THEN 'Mall Worker' ELSE 'Not Classified' END dbscan_label, no % 2 is_out_of_hours FROM d)"""


#: Largest difference ``kd (k, d, na, nb)`` of the values ``p (k, v, g)``.
_KS_1D = """kq AS (SELECT k, v, sum(sum(CASE WHEN g = 0 THEN 1 ELSE 0 END)) OVER w a, sum(sum(CASE WHEN g = 1 THEN 1 ELSE 0 END)) OVER w b FROM p WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY k, v WINDOW w AS (PARTITION BY k ORDER BY v)),
kd AS (SELECT k, max(abs(a / na - b / nb)) d, any_value(na) na, any_value(nb) nb FROM kq JOIN (SELECT k, max(a) na, max(b) nb FROM kq GROUP BY 1) USING (k) GROUP BY 1)"""


def _ks_probability(z: str) -> str:
    return f"CASE WHEN {z} < 0.05 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda t: CASE WHEN t % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * t * t * ({z}) * ({z})))))) END"


#: Statistic and probability ``kp (k, d, p)`` of the points ``p (k, x, y, g)``: all pairs.
_KS_2D = f"""kn AS (SELECT k, count(*) FILTER (g = 0) n0, count(*) FILTER (g = 1) n1, corr(x, y) FILTER (g = 0) r0, corr(x, y) FILTER (g = 1) r1 FROM p GROUP BY 1),
ko AS (SELECT k, x, y, g, row_number() OVER () i FROM p),
kq AS (SELECT k, o.i, o.g og, q.g, [count(*) FILTER (q.x > o.x AND q.y > o.y), count(*) FILTER (q.x <= o.x AND q.y > o.y), count(*) FILTER (q.x > o.x AND q.y <= o.y),
 count(*) FILTER (q.x <= o.x AND q.y <= o.y) - CASE WHEN any_value(o.g) = any_value(q.g) THEN 1 ELSE 0 END] c, count(*) n FROM ko o JOIN p q USING (k) GROUP BY k, o.i, o.g, q.g),
km AS (SELECT k, a.og, max(list_max(list_transform(range(1, 5), lambda t: greatest((a.c[t] + 1) / a.n - b.c[t] / b.n, b.c[t] / b.n - a.c[t] / a.n)))) d
 FROM kq a JOIN kq b USING (k, i) WHERE a.g = a.og AND b.g <> b.og GROUP BY 1, 2),
kd AS (SELECT k, CASE WHEN count(*) = 2 THEN avg(d) END d FROM km GROUP BY 1),
kz AS (SELECT k, d, d * sqrt(n0 * n1 / (n0 + n1)) / (1 + sqrt(1 - (r0 * r0 + r1 * r1) / 2) * (0.25 - 0.75 / sqrt(n0 * n1 / (n0 + n1)))) z FROM kd JOIN kn USING (k)),
kp AS (SELECT k, d, {_ks_probability('z')} p FROM kz)"""


def _kde(classes: str) -> str:
    """Likelihoods ``lk (mac_address, feature, k, l)`` of all devices with the class of ``f`` given by an expression."""
    return f"""lv AS (SELECT mac_address, frequency, {classes} k, unnest(['radius_of_gyration', 'av_path_length']) feature, unnest([radius_of_gyration, av_path_length]) v FROM f),
tr AS (SELECT feature, k, v FROM lv WHERE frequency > 10 AND k IS NOT NULL AND v IS NOT NULL),
h AS (SELECT feature, k, count(*) n, stddev_samp(v) * pow(count(*), -0.2) h FROM tr GROUP BY ALL),
lk AS (SELECT l.mac_address, l.feature, h.k, sum(exp(-pow((l.v - tr.v) / h.h, 2) / 2)) / any_value(h.n) / any_value(h.h) / sqrt(2 * pi()) l
 FROM lv l JOIN tr ON tr.feature = l.feature JOIN h ON h.feature = tr.feature AND h.k = tr.k GROUP BY ALL)"""


_THREE = "CASE dbscan_label WHEN 'Stationary' THEN 0 WHEN 'Shopper' THEN 1 WHEN 'Mall Worker' THEN 2 END"
_TWO = "1 - is_out_of_hours"
_WIDE = """lw AS (SELECT mac_address, """ + ", ".join(
    f"max(l) FILTER (feature = '{f}' AND k = {k}) {n}{k}" for n, f in (("a", "radius_of_gyration"), ("b", "av_path_length")) for k in range(3)
) + " FROM lk GROUP BY ALL)"


def _sequential(prior: tuple[float, float, float]) -> str:
    p, q, r = prior
    return f"""{_DEVICES}, {_kde(_THREE)}, {_WIDE},
p1 AS (SELECT lw.*, a0 * {p} / nullif(a0 * {p} + a1 * {q} + a2 * {r}, 0) p0, a1 * {q} / nullif(a0 * {p} + a1 * {q} + a2 * {r}, 0) p1, a2 * {r} / nullif(a0 * {p} + a1 * {q} + a2 * {r}, 0) p2
 FROM lw JOIN f USING (mac_address) WHERE f.frequency > 10 AND dbscan_label = 'Not Classified'),
p2 AS (SELECT *, p0 * b0 / nullif(p0 * b0 + p1 * b1 + p2 * b2, 0) q0, p1 * b1 / nullif(p0 * b0 + p1 * b1 + p2 * b2, 0) q1, p2 * b2 / nullif(p0 * b0 + p1 * b1 + p2 * b2, 0) q2 FROM p1)"""


_STORES = """stores AS (SELECT store_id, avg(x) x, avg(y) y, count(DISTINCT mac_address) visitors FROM s WHERE store_id IS NOT NULL GROUP BY ALL)"""


def _adjacency(source: str = "s", frame: str = "") -> str:
    g = f"{frame}, " if frame else ""
    return f"""(SELECT {g}src, store_id dst, count(*) weight FROM (SELECT *, lag(store_id) OVER (PARTITION BY {g}mac_address ORDER BY date_time, event_id) src
 FROM {source} WHERE store_id IS NOT NULL) WHERE src <> store_id GROUP BY ALL)"""


def _frames(window: int, slide: int, compat: bool) -> str:
    w, s = window * 60_000_000, slide * 60_000_000
    last = "" if compat else " + 1"
    hi = f"ceil(t / {s}.0) - 1" if compat else f"floor(t / {s}.0)"
    return f"""dayt AS (SELECT * FROM s WHERE {_tod()} > 25200),
b AS (SELECT min(epoch_us(date_time)) t0, max(epoch_us(date_time)) t1 FROM dayt),
fr0 AS (SELECT dayt.*, epoch_us(date_time) - t0 t, CAST(floor((t1 - t0 - {w}) / {s}.0) AS BIGINT){last} frames FROM dayt, b),
fr1 AS (SELECT *, greatest(0, CAST(floor((t - {w}) / {s}.0) AS BIGINT) + 1) lo, least(frames - 1, CAST({hi} AS BIGINT)) hi FROM fr0),
fr AS (SELECT *, unnest(range(lo, hi + 1)) frame FROM fr1 WHERE lo <= hi)"""


_TRANS = """tc AS (SELECT src, dst, count(*) n FROM (SELECT store_id src, lead(store_id) OVER (PARTITION BY mac_address ORDER BY date_time, event_id) dst
 FROM s WHERE store_id IS NOT NULL) WHERE dst IS NOT NULL GROUP BY ALL),
ta AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) p FROM tc),
i0 AS (SELECT st, count(*) n FROM (SELECT mac_address, arg_min(store_id, (date_time, event_id)) st FROM s WHERE store_id IS NOT NULL GROUP BY 1) GROUP BY 1),
ini AS (SELECT a.store_id, coalesce(n, 0) n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () p FROM (SELECT DISTINCT store_id FROM s WHERE store_id IS NOT NULL) a LEFT JOIN i0 ON st = store_id)"""
_PIVOT = "v AS (SELECT mac_address, store_id, count(*) n FROM s WHERE store_id LIKE '%B%' GROUP BY ALL)"
_CLASSES = (
    "st AS (SELECT mac_address, string_agg(store_id, ',' ORDER BY store_id) stores FROM v GROUP BY 1), "
    "cls AS (SELECT stores, min(mac_address) AS class FROM st GROUP BY 1), p AS (SELECT cls.class, v.store_id FROM cls JOIN v ON v.mac_address = cls.class)"
)
_Z = """z AS (SELECT mac_address id, (radius_of_gyration - avg(radius_of_gyration) OVER ()) / stddev_pop(radius_of_gyration) OVER () u,
 (av_path_length - avg(av_path_length) OVER ()) / stddev_pop(av_path_length) OVER () v FROM f)"""
_DEVICE_PATHS = """dp AS (SELECT DISTINCT mac_address, x, y FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
dn AS (SELECT p.mac_address a, q.mac_address b, p.x, p.y, min(sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))) d FROM dp p JOIN dp q ON p.mac_address <> q.mac_address GROUP BY ALL),
dd AS (SELECT a, b, max(d) d FROM dn GROUP BY ALL), u AS (SELECT x.a, x.b, greatest(x.d, y.d) distance FROM dd x JOIN dd y ON x.a = y.b AND x.b = y.a)"""
_PATHS = """dp AS (SELECT store_id, CAST(date_time AS DATE) AS dd, round(avg(x), 6) x, round(avg(y), 6) y FROM s WHERE store_id IS NOT NULL GROUP BY ALL),
near AS (SELECT a.store_id a, b.store_id b, a.dd, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) m FROM dp a JOIN dp b ON a.store_id <> b.store_id GROUP BY ALL),
hd AS (SELECT a, b, max(m) distance FROM near GROUP BY ALL)"""


def _angle(x: str, y: str) -> str:
    a = f"atan2({y} - 75.0, {x} - 175.0)"
    return f"(CASE WHEN {a} <= 0 THEN {a} + 2 * pi() ELSE {a} END)"


def _way(a: str, b: str) -> str:
    d = f"(({b} - {a}) - floor(({b} - {a}) / (2 * pi())) * (2 * pi()))"
    return f"(CASE WHEN {a} = {b} THEN NULL WHEN {d} < 2 * pi() / 3 THEN -1 WHEN {d} > 2 * (2 * pi()) / 3 THEN 1 ELSE 0 END)"


ORACLES: dict[str, str] = {
    "device_features": f"""WITH {_SIGNALS}, {_OUI}, {_steps()},
bins AS (SELECT mac_address, {_bin('date_time', 5)} b, count(*) n FROM s GROUP BY ALL),
dens AS (SELECT mac_address, {_round('stddev_samp(n)')} count_density_variance FROM bins GROUP BY ALL),
a AS (SELECT mac_address, count(*) frequency, {_round('sqrt(var_pop(x) + var_pop(y))')} radius_of_gyration, {_seconds('min(date_time)', 'max(date_time)')} length_of_stay,
 max(CASE WHEN {_tod()} BETWEEN 10800 AND 18000 THEN 1 ELSE 0 END) is_out_of_hours, {_MEASURES}, {_WIFI} wifi_type, min(date_time) start_time, max(date_time) end_time,
 count(DISTINCT CASE WHEN store_id LIKE 'B%' THEN store_id END) number_of_shops,
 {_round(f"sum(d) / nullif({_seconds('min(date_time)', 'max(date_time)')}, 0)")} av_speed_from_total,
 {_round('CASE WHEN count(*) > 2 THEN coalesce(sum(abs(theta)), 0.0) END / nullif(sum(d), 0)')} turning_angle_density,
 {_round('avg(x)')} centroid_x, {_round('avg(y)')} centroid_y, {_round('arg_min(x, (date_time, event_id))')} start_coordinate_x, {_round('arg_min(y, (date_time, event_id))')} start_coordinate_y,
 {_round('arg_max(x, (date_time, event_id))')} end_coordinate_x, {_round('arg_max(y, (date_time, event_id))')} end_coordinate_y FROM st GROUP BY ALL)
SELECT a.*, count_density_variance, manufacturer FROM a JOIN dens USING (mac_address) LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6))""",
    "device_frequency": f"WITH {_SIGNALS} SELECT mac_address, count(*) frequency FROM s GROUP BY ALL",
    "radius_of_gyration": f"WITH {_SIGNALS} SELECT mac_address, {_GYRATION} FROM s GROUP BY ALL",
    "gyration_without_repeats": f"WITH {_SIGNALS}, {_NO_REPEATS} SELECT mac_address, {_GYRATION} FROM u GROUP BY ALL",
    "length_of_stay": f"""WITH {_SIGNALS} SELECT mac_address, {_seconds('min(date_time)', 'max(date_time)')} length_of_stay,
 CAST(floor((epoch_us(max(date_time)) - epoch_us(min(date_time))) / 1e6) AS BIGINT) total_stay FROM s GROUP BY ALL""",
    "out_of_hours": f"WITH {_SIGNALS} SELECT mac_address, max(CASE WHEN {_tod()} BETWEEN 10800 AND 18000 THEN 1 ELSE 0 END) is_out_of_hours FROM s GROUP BY ALL",
    "count_density_std": f"""WITH {_SIGNALS}, bins AS (SELECT mac_address, {_bin('date_time', 60)} b, count(*) n FROM s GROUP BY ALL)
SELECT mac_address, {_round('stddev_samp(n)')} count_density_variance FROM bins GROUP BY ALL""",
    "step_features": f"WITH {_SIGNALS}, {_steps()} SELECT mac_address, {_MEASURES} FROM st GROUP BY ALL",
    "step_features_without_repeats": f"WITH {_SIGNALS}, {_NO_REPEATS}, {_steps('u')} SELECT mac_address, {_MEASURES} FROM st GROUP BY ALL",
    "wifi_type_priority": f"WITH {_SIGNALS} SELECT mac_address, {_WIFI} wifi_type FROM s GROUP BY ALL",
    "start_end": f"""WITH {_SIGNALS} SELECT mac_address, arg_min(x, (date_time, event_id)) start_x, arg_min(y, (date_time, event_id)) start_y,
 arg_max(x, (date_time, event_id)) end_x, arg_max(y, (date_time, event_id)) end_y, min(date_time) start_time, max(date_time) end_time FROM s GROUP BY ALL""",
    "shops_visited": f"WITH {_SIGNALS} SELECT mac_address, count(DISTINCT CASE WHEN store_id LIKE 'B%' THEN store_id END) number_of_shops FROM s GROUP BY ALL",
    "forward_probability": f"""WITH {_SIGNALS}, {_steps()}, m AS (SELECT *, lead(dx) OVER w nx, lead(dy) OVER w ny FROM st WHERE d > 0 WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id))
SELECT mac_address, {_round('avg(CASE WHEN dx * nx + dy * ny > 0 THEN 1.0 WHEN nx IS NOT NULL THEN 0.0 END)')} forwards FROM m GROUP BY ALL""",
    "remove_consecutive_runs": f"WITH {_SIGNALS}, {_NO_REPEATS} SELECT event_id, mac_address, store_id FROM u",
    "first_of_run": f"""WITH {_SIGNALS}, b AS (SELECT *, lag(store_id) OVER (PARTITION BY mac_address ORDER BY date_time, event_id) p FROM s)
SELECT event_id, mac_address, store_id FROM b WHERE p IS NULL OR p <> store_id""",
    "turning_runs": f"""WITH {_SIGNALS}, {_steps()}, m AS (SELECT *, coalesce(CAST(lag(theta) OVER w > pi() / 2 AS INTEGER), 0) sharp FROM st WHERE d IS NOT NULL WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id)),
r AS (SELECT *, CAST(sum(sharp) OVER (PARTITION BY mac_address ORDER BY date_time, event_id) AS BIGINT) run FROM m) SELECT mac_address, run, {_round('sum(d)')} length FROM r GROUP BY ALL""",
    "msd_curve": f"""WITH {_SIGNALS}, a AS (SELECT *, first_value(x) OVER w x0, first_value(y) OVER w y0, CAST(row_number() OVER w - 1 AS INTEGER) n FROM s WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id))
SELECT mac_address, n, {_round('avg(pow(x - x0, 2) + pow(y - y0, 2)) OVER (PARTITION BY mac_address ORDER BY date_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 4)} msd FROM a""",
    "fraction_visited": f"""WITH {_SIGNALS} SELECT mac_address, {_round("count(DISTINCT coalesce(store_id, 'none')) / (SELECT count(DISTINCT coalesce(store_id, 'none')) FROM s)")} fraction FROM s GROUP BY ALL""",
    "direction_bias": f"""WITH {_SIGNALS}, {_STORES}, a AS (SELECT s.*, {_angle('stores.x', 'stores.y')} angle FROM s JOIN stores USING (store_id) WHERE store_id LIKE 'B%'),
m AS (SELECT *, lead(angle) OVER (PARTITION BY mac_address ORDER BY date_time, event_id) nxt FROM a), g AS (SELECT *, {_way('angle', 'nxt')} way FROM m WHERE nxt IS NOT NULL)
SELECT mac_address, count(*) FILTER (way = 1) clockwise, count(*) FILTER (way = -1) anticlockwise, count(*) FILTER (coalesce(way, 0) = 0) neutral, count(*) FILTER (way IS NULL) "none", count(*) moves FROM g GROUP BY ALL""",
    "manufacturer_join": f"""WITH {_SIGNALS}, {_OUI} SELECT manufacturer, count(*) signals, count(DISTINCT mac_address) devices FROM s LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6)) GROUP BY ALL""",
    "label_threshold": f"""WITH {_SIGNALS}, p AS (SELECT mac_address, round(count(DISTINCT coalesce(store_id, 'none')) / (SELECT count(DISTINCT coalesce(store_id, 'none')) FROM s) * 1.2::DOUBLE, 6) p FROM s GROUP BY ALL)
SELECT mac_address, {_round('p')} p, CAST(CASE WHEN p > 0.95 THEN 1 WHEN p < 0.05 THEN 0 ELSE 0.5 END AS DOUBLE) "label" FROM p""",
    "semi_devices": f"WITH {_SIGNALS} SELECT event_id, mac_address FROM s WHERE mac_address IN (SELECT mac_address FROM s GROUP BY 1 HAVING count(*) % 2 = 0)",
    "anti_devices": f"WITH {_SIGNALS} SELECT event_id, mac_address FROM s WHERE mac_address NOT IN (SELECT mac_address FROM s GROUP BY 1 HAVING count(*) % 2 = 0)",
    "legacy_clean": f"""WITH {_SIGNALS}, {_steps()}, o AS (SELECT mac_address, max(CASE WHEN {_tod()} BETWEEN 0 AND 3600 THEN 1 ELSE 0 END) shut, count(*) n, avg(CASE WHEN d / nullif(ds, 0) < 1e5 THEN d / nullif(ds, 0) END) v FROM st GROUP BY ALL)
SELECT event_id, mac_address FROM s WHERE mac_address IN (SELECT mac_address FROM o WHERE shut = 0 AND n >= 10 AND coalesce(v, 0) <= 0.5)""",
    "first_last_arrival": f"""WITH {_SIGNALS} SELECT mac_address, min(date_time) arrive, max(date_time) leave, arg_min_null(store_id, (date_time, event_id)) arrive_store, arg_max_null(store_id, (date_time, event_id)) leave_store FROM s GROUP BY ALL""",
    "composite_key_overwrite": f"""WITH {_SIGNALS}, fx AS (SELECT DISTINCT ON (mac_address, date_time) mac_address, date_time, x + 1 nx, 0.0::DOUBLE ny FROM s WHERE y > 90)
SELECT event_id, {_round('coalesce(nx, x)')} x, {_round('coalesce(ny, y)')} y FROM s LEFT JOIN fx USING (mac_address, date_time)""",
    "shop_corridor_ratio": f"""WITH {_SIGNALS}, c AS (SELECT store_id, count(*) n FROM s WHERE store_id IS NOT NULL GROUP BY ALL)
SELECT b.store_id, a.store_id area_id, b.n shop_count, a.n area_count, {_round('b.n / a.n')} ratio FROM c b JOIN c a ON substr(a.store_id, 2) = substr(b.store_id, 2) AND a.store_id LIKE 'A%' WHERE b.store_id LIKE 'B%' AND length(b.store_id) = 4""",
    "store_categories": f"""WITH {_SIGNALS}, {_STORES} SELECT CASE WHEN visitors IS NULL THEN 'None' WHEN visitors % 2 = 0 THEN 'even' ELSE 'odd' END store_category, count(*) n
FROM s LEFT JOIN (SELECT * FROM stores WHERE store_id <> 'B101') q USING (store_id) GROUP BY ALL""",
    "duplicate_fill": f"""WITH {_COARSE}, w AS (SELECT *, row_number() OVER w rn, coalesce(lag(x) OVER w, last_value(x) OVER (PARTITION BY mac_address ORDER BY date_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) px,
 coalesce(lag(y) OVER w, last_value(y) OVER (PARTITION BY mac_address ORDER BY date_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) py, lead(x, 2) OVER w nx, lead(y, 2) OVER w ny,
 lead(x) OVER g gx, lead(y) OVER g gy FROM c WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id), g AS (PARTITION BY mac_address, date_time ORDER BY event_id)),
g AS (SELECT mac_address, date_time, avg(x) mx, avg(y) my, arg_min(px, rn) px, arg_min(py, rn) py, arg_max_null(nx, rn) nx, arg_max_null(ny, rn) ny,
 coalesce(bool_or(sqrt(pow(gx - x, 2) + pow(gy - y, 2)) > 15), false) apart FROM w GROUP BY ALL HAVING count(*) > 1),
cd AS (SELECT w.mac_address, w.date_time, w.rn, w.x, w.y, CASE WHEN g.nx IS NULL THEN sqrt(pow(g.px - w.x, 2) + pow(g.py - w.y, 2))
 ELSE (sqrt(pow(g.px - w.x, 2) + pow(g.py - w.y, 2)) + sqrt(pow(g.nx - w.x, 2) + pow(g.ny - w.y, 2))) / 2 END dist FROM w JOIN g USING (mac_address, date_time)),
best AS (SELECT mac_address, date_time, arg_min(x, (dist, rn)) bx, arg_min(y, (dist, rn)) by_ FROM cd GROUP BY ALL),
fx AS (SELECT mac_address, date_time, CASE WHEN apart THEN bx ELSE mx END qx, CASE WHEN apart THEN by_ ELSE my END qy FROM g JOIN best USING (mac_address, date_time)),
o AS (SELECT event_id, mac_address, date_time, location, coalesce(qx, x) x, coalesce(qy, y) y FROM c LEFT JOIN fx USING (mac_address, date_time)),
k AS (SELECT *, row_number() OVER (PARTITION BY mac_address, date_time, location, x, y ORDER BY event_id) copy FROM o)
SELECT event_id, mac_address, date_time, {_round('x')} x, {_round('y')} y FROM k WHERE copy = 1""",
    "duplicate_devices": f"""WITH {_COARSE}, l AS (SELECT *, lead(date_time) OVER w t1, lead(x) OVER w x1, lead(y) OVER w y1 FROM c WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id))
SELECT mac_address, count(*) equal_times, count(*) FILTER (x <> x1 OR y <> y1) moved FROM l WHERE t1 = date_time GROUP BY ALL""",
    "around_duplicates": f"""WITH {_COARSE}, l AS (SELECT *, CAST(row_number() OVER w AS INTEGER) n, lead(date_time) OVER w t1, CAST(count(*) OVER f AS INTEGER) size, sum(x + y) OVER f total FROM c
 WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id), f AS (PARTITION BY mac_address ORDER BY date_time, event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
SELECT mac_address, n, size, {_round('total')} total FROM l WHERE t1 = date_time""",
    "signal_periods": f"WITH {_SIGNALS}, {_steps()} SELECT mac_address, CAST(n AS INTEGER) n, ds AS seconds FROM st WHERE ds IS NOT NULL",
    "out_of_hour_periods": f"""WITH {_SIGNALS}, {_steps()} SELECT mac_address, ({_tod()} < 28800 OR {_tod()} > 79200) off_hours, count(*) periods, {_round('avg(ds)')} mean_seconds FROM st WHERE ds IS NOT NULL GROUP BY ALL""",
    "unrealistic_speeds": f"""WITH {_SIGNALS}, {_steps()} SELECT mac_address, count(*) fast_steps FROM st WHERE (ds = 0 AND d - 2 > 0) OR (d - 2) / nullif(ds, 0) > 0.02 GROUP BY ALL HAVING count(*) > 1""",
    "store_neighbours": f"""WITH {_SIGNALS}, q AS (SELECT *, lag(store_id) OVER w bs, lead(store_id) OVER w afs FROM s WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id)), {_steps('q')}
SELECT mac_address, count(*) fast_steps, {_round('avg((CAST(bs IS NULL AS INTEGER) + CAST(store_id IS NULL AS INTEGER) + CAST(afs IS NULL AS INTEGER)) / 3)')} null_share FROM st WHERE d / nullif(ds, 0) > 0.02 GROUP BY ALL""",
    "store_outliers": f"""WITH {_SIGNALS}, p AS (SELECT store_id, x, y, count(*) signals FROM s WHERE store_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
n AS (SELECT a.store_id, a.x, a.y, any_value(a.signals) signals, sum(b.signals) >= 10 is_core FROM p a JOIN p b ON a.store_id = b.store_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 8.0::DOUBLE * 8.0::DOUBLE GROUP BY ALL)
SELECT store_id, {_round('a.x')} x, {_round('a.y')} y, signals, is_core, NOT EXISTS (SELECT 1 FROM n b WHERE b.is_core AND a.store_id = b.store_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 8.0::DOUBLE * 8.0::DOUBLE) is_outlier FROM n a""",
    "store_two_means_step": f"""WITH {_SIGNALS}, p AS (SELECT store_id, x, y FROM s WHERE store_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL), c AS (SELECT store_id, min((x, y)) a, max((x, y)) b FROM p GROUP BY 1),
q AS (SELECT *, pow(x - b[1], 2) + pow(y - b[2], 2) < pow(x - a[1], 2) + pow(y - a[2], 2) far FROM p JOIN c USING (store_id))
SELECT store_id, {_round('coalesce(avg(x) FILTER (NOT far), any_value(a[1]))')} ax, {_round('coalesce(avg(y) FILTER (NOT far), any_value(a[2]))')} ay, {_round('coalesce(avg(x) FILTER (far), any_value(b[1]))')} bx, {_round('coalesce(avg(y) FILTER (far), any_value(b[2]))')} "by" FROM q GROUP BY 1""",
    "stationary_devices": f"""WITH {_SIGNALS} SELECT mac_address, count(*) n FROM s GROUP BY ALL HAVING count(*) > 10 AND count(DISTINCT floor(x / 100)) < 5 AND count(DISTINCT floor(y / 25)) < 5""",
    "knn_store_clean": f"""WITH {_SIGNALS}, g AS (SELECT a.event_id, count(*) n FROM s a JOIN s b ON a.store_id = b.store_id AND sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) <= 1 GROUP BY ALL)
SELECT event_id, store_id FROM s WHERE store_id IS NULL OR event_id IN (SELECT event_id FROM g WHERE n >= 3)""",
    "kth_neighbour_distance": f"""WITH {_SIGNALS}, {_STORES}, p AS (SELECT store_id id, round(x, 6) x, round(y, 6) y FROM stores),
r AS (SELECT a.id, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) r FROM p a, p b)
SELECT 'all' store_id, id point_id, {_round('d')} distance FROM r WHERE r = 5""",
    "kth_neighbour_signals": f"""WITH {_SIGNALS}, r AS (SELECT a.store_id, a.event_id point_id, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) d, row_number() OVER (PARTITION BY a.event_id ORDER BY sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2))) r
 FROM s a JOIN s b USING (store_id) WHERE a.x IS NOT NULL AND a.y IS NOT NULL) SELECT store_id, point_id, {_round('d')} distance FROM r WHERE r = 5""",
    "signals_per_bin": f"WITH {_SIGNALS} SELECT {_bin('date_time', 15)} bin, count(*) signals, count(DISTINCT mac_address) devices FROM s GROUP BY ALL",
    "arrivals_per_bin": f"WITH {_SIGNALS}, a AS (SELECT mac_address, min(date_time) t FROM s GROUP BY 1) SELECT {_bin('t', 30)} bin, count(DISTINCT mac_address) devices FROM a GROUP BY ALL",
    "stay_by_band": f"""WITH {_SIGNALS}, a AS (SELECT mac_address, CAST(date_time AS DATE) AS dd, min(date_time) st, max(date_time) en FROM s GROUP BY ALL),
q AS (SELECT {_seconds('st', 'en')} los, {_tod('st')} tod FROM a),
b AS (SELECT los, CASE WHEN tod > 32400 AND tod < 43200 THEN '9-12' WHEN tod > 43200 AND tod < 54000 THEN '12-15' WHEN tod > 54000 AND tod < 64800 THEN '15-18' WHEN tod > 64800 AND tod < 75600 THEN '18-21' WHEN tod > 75600 AND tod < 86400 THEN '21-24' END band FROM q),
m AS (SELECT *, min(los) OVER (PARTITION BY band) lo FROM b WHERE band IS NOT NULL) SELECT band, CAST(floor((los - lo) / 1000) AS BIGINT) bucket, count(*) devices FROM m GROUP BY ALL""",
    "sliding_flow": f"WITH {_SIGNALS}, {_frames(1440, 720, True)} SELECT * FROM {_adjacency('fr', 'frame')}",
    "sliding_flow_half_open": f"WITH {_SIGNALS}, {_frames(1440, 720, False)} SELECT * FROM {_adjacency('fr', 'frame')}",
    "sliding_shopper_count": f"WITH {_SIGNALS}, {_frames(60, 30, True)} SELECT frame, store_id, count(DISTINCT mac_address) + 1 frequency FROM fr WHERE store_id IS NOT NULL GROUP BY ALL",
    "net_flow": f"""WITH {_SIGNALS}, a AS (SELECT * FROM {_adjacency()}) SELECT coalesce(a.src, b.dst) src, coalesce(a.dst, b.src) dst, coalesce(a.weight, 0) - coalesce(b.weight, 0) net FROM a FULL JOIN a b ON a.src = b.dst AND a.dst = b.src""",
    "in_degree": f"WITH {_SIGNALS} SELECT dst store_id, CAST(sum(weight) AS BIGINT) in_degree FROM {_adjacency()} GROUP BY ALL",
    "store_visitors": f"""WITH {_SIGNALS}, {_STORES} SELECT store_id, visitors count_of_shoppers FROM stores UNION ALL SELECT 'B999', NULL""",
    "store_position": f"WITH {_SIGNALS}, {_STORES} SELECT store_id, {_round('x')} x, {_round('y')} y, visitors FROM stores",
    "shop_frequency": f"WITH {_SIGNALS} SELECT store_id, count(*) frequency FROM s WHERE store_id LIKE 'B%' GROUP BY ALL",
    "shop_area_v1": f"""WITH {_SIGNALS}, h AS (SELECT store_id, x, max(y) - min(y) h FROM s WHERE store_id LIKE 'B%' GROUP BY ALL) SELECT store_id, {_round('sum(h)')} area FROM h GROUP BY ALL""",
    "shop_area_v2": f"""WITH {_SIGNALS}, h AS (SELECT store_id, round_even(x, 0) xx, CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END h FROM s WHERE store_id LIKE 'B%' GROUP BY ALL) SELECT store_id, {_round('sum(h)')} area FROM h GROUP BY ALL""",
    "area_power_law": f"""WITH {_SIGNALS}, h AS (SELECT store_id, round_even(x, 0) xx, CASE WHEN max(y) = min(y) THEN 1.0 ELSE max(y) - min(y) END h FROM s WHERE store_id LIKE 'B%' GROUP BY ALL),
p AS (SELECT log10(sum(h)) x, log10((SELECT count(DISTINCT mac_address) FROM s WHERE s.store_id = h.store_id)) y FROM h GROUP BY store_id)
SELECT {_round('regr_slope(y, x)')} slope, {_round('regr_intercept(y, x)')} intercept, {_round('corr(y, x)')} r, {_round('sqrt((1 - corr(y, x) ** 2) * regr_syy(y, x) / (regr_sxx(y, x) * (count(*) - 2)))')} stderr, count(*) n FROM p""",
    "in_degree_rank": f"""WITH {_SIGNALS}, c AS (SELECT store_id, count(*) frequency FROM s WHERE store_id LIKE 'B%' GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY frequency DESC, store_id) - 1 AS INTEGER) "rank" FROM c""",
    "rank_probability": f"""WITH {_SIGNALS}, q AS (SELECT store_id, count(*) frequency FROM s WHERE store_id LIKE 'B%' GROUP BY ALL), c AS (SELECT frequency, count(*) c FROM q GROUP BY 1)
SELECT frequency, {_round('sum(c) OVER (ORDER BY frequency DESC) / sum(c) OVER () * count(*) OVER ()')} "rank" FROM c""",
    "top_manufacturers": f"""WITH {_SIGNALS}, {_OUI}, q AS (SELECT DISTINCT mac_address FROM s) SELECT manufacturer, count(*) n FROM q LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6)) GROUP BY ALL ORDER BY n DESC, manufacturer LIMIT 10""",
    "top_lines_per_part": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey) r FROM lineitem) SELECT l_partkey, count(*) n, round(sum(l_extendedprice), 2) price FROM r WHERE r <= 3 GROUP BY ALL""",
    "mall_venn": f"""WITH {_SIGNALS}, m AS (SELECT store_id, CAST(bit_or(CASE location WHEN 'Mall of Mauritius' THEN 1 WHEN 'Phoenix Mall' THEN 2 ELSE 4 END) AS INTEGER) region FROM s WHERE store_id IS NOT NULL GROUP BY 1) SELECT region, count(*) size FROM m GROUP BY ALL""",
    "manufacturer_venn": f"""WITH {_DEVICES}, {_OUI}, m AS (SELECT mac_address, CASE manufacturer WHEN 'FRANCE' THEN 1 WHEN 'KENYA' THEN 2 WHEN 'PERU' THEN 4 ELSE 0 END + CASE WHEN dbscan_label = 'Stationary' THEN 8 ELSE 0 END region
 FROM f LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6))) SELECT CAST(region AS INTEGER) region, count(*) size FROM m WHERE region > 0 GROUP BY 1""",
    "manufacturer_circles": f"""WITH RECURSIVE {_DEVICES}, {_OUI}, m AS (SELECT manufacturer, dbscan_label = 'Stationary' own FROM f LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6))),
c AS (SELECT manufacturer, count(*) FILTER (own) inside, count(*) n, sqrt((SELECT count(*) FROM m WHERE own) / pi()) r1, sqrt(count(*) / pi()) r2, (SELECT count(*) FROM m WHERE own) whole FROM m WHERE manufacturer IN ('FRANCE', 'KENYA', 'PERU', 'CHINA') GROUP BY 1),
b(i, manufacturer, lo, hi) AS (SELECT 0, manufacturer, abs(r1 - r2), r1 + r2 FROM c UNION ALL
 SELECT i + 1, manufacturer, CASE WHEN a < inside THEN lo ELSE mid END, CASE WHEN a < inside THEN mid ELSE hi END FROM (SELECT i, manufacturer, lo, hi, mid, inside,
  r2 * r2 * acos(greatest(-1, least(1, (mid * mid + r2 * r2 - r1 * r1) / (2 * mid * r2)))) + r1 * r1 * acos(greatest(-1, least(1, (mid * mid + r1 * r1 - r2 * r2) / (2 * mid * r1))))
  - sqrt(greatest(0, (r1 + r2 - mid) * (mid + r2 - r1) * (mid - r2 + r1) * (mid + r2 + r1))) / 2 a FROM (SELECT *, (lo + hi) / 2 mid FROM b JOIN c USING (manufacturer) WHERE i < 60))),
g AS (SELECT manufacturer, inside, n - inside outside, r2, CASE WHEN inside = 0 THEN r1 + r2 WHEN inside = least(whole, n) THEN abs(r1 - r2) ELSE (lo + hi) / 2 END d,
 pi() / 2 * (list_position(['FRANCE', 'KENYA', 'PERU', 'CHINA'], manufacturer) - 1) w FROM c JOIN b USING (manufacturer) WHERE i = 60)
SELECT manufacturer, inside, outside, {_round('r2')} radius, {_round('d')} distance, {_round('d * cos(w)')} x, {_round('d * sin(w)')} y FROM g""",
    "pair_plot": f"""WITH {_DEVICES}, q AS (SELECT is_out_of_hours, radius_of_gyration a, av_path_length b, av_turning_angle c FROM f WHERE radius_of_gyration IS NOT NULL AND av_path_length IS NOT NULL AND av_turning_angle IS NOT NULL)
"""
    + " UNION ALL ".join(
        f"SELECT is_out_of_hours, '{names[i]}' x_name, '{names[j]}' y_name, {_round('abc'[i])} x, {_round('abc'[j])} y FROM q"
        for names in [("radius_of_gyration", "av_path_length", "av_turning_angle")]
        for i in range(3)
        for j in range(3)
        if i != j
    ),
    "confident_posteriors": f"""WITH {_sequential((0.05, 0.9, 0.05))}, v AS (SELECT q1 v FROM p2 WHERE q1 > 0.5), b AS (SELECT min(v) lo, max(v) hi, count(*) total FROM v),
r AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS BIGINT), 9) bucket, (hi - lo) / 10 w, total FROM v, b) SELECT bucket, count(*) n, {_round('count(*) / (any_value(total) * any_value(w))', 4)} density FROM r GROUP BY 1""",
    "clean_texts": r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(trim(text), '[ \t\n\x0B\f\r]+'), lambda w: NOT regexp_matches(w, '[#@äó»=&_+%©çéèåî¾à±º¦â]')), ' ')) cleaned FROM documents""",
    "distinct_signals": f"WITH {_COARSE}, q AS (SELECT DISTINCT mac_address, date_time, store_id FROM c) SELECT mac_address, count(*) n FROM q GROUP BY ALL",
    "union_malls": f"WITH {_SIGNALS} SELECT location, store_id, count(*) n FROM s GROUP BY ALL",
    "label_difference": f"WITH {_DEVICES} SELECT mac_address FROM f WHERE frequency > 10 AND dbscan_label <> 'Not Classified'",
    "community_store_visits": f"WITH {_SIGNALS} SELECT CAST('0x' || right(mac_address, 2) AS INTEGER) % 3 community, store_id, count(*) visits FROM s WHERE store_id IS NOT NULL GROUP BY ALL",
    "manufacturer_stats": f"""WITH {_DEVICES}, {_OUI} SELECT manufacturer, count(*) n, {_round('avg(radius_of_gyration)')} mean, {_round('stddev_samp(radius_of_gyration)')} deviation
FROM f LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6)) GROUP BY ALL HAVING count(*) >= 3""",
    "kde_likelihood": f"""WITH {_DEVICES}, {_kde(_THREE)}, {_WIDE} SELECT mac_address, {', '.join(f"{_round(f'{n}{k}', 8)} l_{f}_{k}" for n, f in (('a', 'radius_of_gyration'), ('b', 'av_path_length')) for k in range(3))} FROM lw""",
    "sequential_bayes": f"""WITH {_sequential((0.05, 0.9, 0.05))} SELECT mac_address, {', '.join(f"{_round(f'p{k}')} p_{k}_0, {_round(f'q{k}')} p_{k}_1, {_round(f'q{k}')} p_{k}" for k in range(3))} FROM p2""",
    "bayes_labels": f"""WITH {_sequential((0.025, 0.95, 0.025))} SELECT mac_address, dbscan_label, CASE WHEN p2.mac_address IS NULL THEN NULL WHEN q0 > 0.5 THEN 'Stationary' WHEN q1 > 0.5 THEN 'Shopper' WHEN q2 > 0.5 THEN 'Mall Worker' ELSE 'Not Classified' END bayesian_label
FROM f LEFT JOIN p2 USING (mac_address)""",
    "bayes_progress": f"""WITH {_sequential((0.05, 0.9, 0.05))} SELECT 0::INTEGER step, {_round('avg(CASE WHEN p0 > 0.04 THEN 1.0 ELSE 0.0 END)')} stationary_share FROM p2 UNION ALL SELECT 1, {_round('avg(CASE WHEN q0 > 0.04 THEN 1.0 ELSE 0.0 END)')} FROM p2""",
    "naive_bayes": f"""WITH {_DEVICES}, {_kde(_TWO)} SELECT mac_address, {_round("max(l) FILTER (lk.k = 0 AND feature = 'radius_of_gyration') * max(l) FILTER (lk.k = 0 AND feature = 'av_path_length') * 0.5", 8)} stationary,
 {_round("max(l) FILTER (lk.k = 1 AND feature = 'radius_of_gyration') * max(l) FILTER (lk.k = 1 AND feature = 'av_path_length') * 0.5", 8)} shopper FROM lk JOIN f USING (mac_address) WHERE f.frequency > 10 GROUP BY ALL""",
    "two_class_labels": f"""WITH {_DEVICES}, {_kde(_TWO)}, q AS (SELECT mac_address, max(l) FILTER (lk.k = 0 AND feature = 'radius_of_gyration') * max(l) FILTER (lk.k = 0 AND feature = 'av_path_length') a,
 max(l) FILTER (lk.k = 1 AND feature = 'radius_of_gyration') * max(l) FILTER (lk.k = 1 AND feature = 'av_path_length') b FROM lk JOIN f USING (mac_address) WHERE f.frequency > 10 GROUP BY ALL)
SELECT mac_address, {_round('b / nullif(a + b, 0)')} shopper_probability, CAST(CASE WHEN b / nullif(a + b, 0) > 0.95 THEN 1 WHEN b / nullif(a + b, 0) < 0.05 THEN 0 ELSE 0.5 END AS DOUBLE) shopper_label FROM q""",
    "cumulative_ks": f"""WITH {_DEVICES}, {_kde(_THREE)}, gr AS (SELECT feature, i, i * max(v) / 99 x FROM lv, (SELECT unnest(range(100)) i) GROUP BY feature, i),
av AS (SELECT gr.feature, gr.i, h.k, sum(exp(-pow((gr.x - tr.v) / h.h, 2) / 2)) / any_value(h.n) / any_value(h.h) / sqrt(2 * pi()) l FROM gr JOIN tr ON tr.feature = gr.feature JOIN h ON h.feature = tr.feature AND h.k = tr.k WHERE h.k < 2 GROUP BY ALL),
p AS (SELECT feature k, sum(l) OVER (PARTITION BY feature, k ORDER BY i) v, av.k g FROM av), {_KS_1D} SELECT k feature, {_round('d')} d, {_round(_ks_probability('sqrt(na * nb / (na + nb)) * d'))} p FROM kd""",
    "density_check": f"""WITH {_DEVICES}, o AS (SELECT radius_of_gyration v, frequency FROM f WHERE dbscan_label = 'Shopper'), tr AS (SELECT v FROM o WHERE frequency > 10 AND v IS NOT NULL), h AS (SELECT count(*) n, stddev_samp(v) * pow(count(*), -0.2) h FROM tr),
gr AS (SELECT i, i * 1.2::DOUBLE * (SELECT max(v) FROM o) / 999 x FROM (SELECT unnest(range(1000)) i)), b AS (SELECT min(v) lo, max(v) hi, count(*) total FROM o),
q AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 25)) AS BIGINT), 24) i, count(*) n FROM o, b GROUP BY 1)
SELECT 'kernel' part, CAST(i AS INTEGER) place, {_round('x')} x, {_round('sum(exp(-pow((x - tr.v) / h.h, 2) / 2)) / any_value(h.n) / any_value(h.h) / sqrt(2 * pi())')} density FROM gr, tr, h GROUP BY i, x
UNION ALL SELECT 'histogram', CAST(i AS INTEGER), {_round('lo + i * (hi - lo) / 25')}, {_round('n / (total * ((hi - lo) / 25))')} FROM q, b""",
    "ks_1d": f"""WITH {_DEVICES}, p AS (SELECT '' AS k, radius_of_gyration v, is_out_of_hours g FROM f), {_KS_1D} SELECT {_round('d')} d, {_round(_ks_probability('sqrt(na * nb / (na + nb)) * d'))} p FROM kd""",
    "ks_features": f"""WITH {_DEVICES}, p AS (SELECT unnest(['frequency', 'radius_of_gyration', 'av_path_length', 'av_turning_angle', 'total_path_length']) k,
 unnest([CAST(frequency AS DOUBLE), radius_of_gyration, av_path_length, av_turning_angle, total_path_length]) v, is_out_of_hours g FROM f), {_KS_1D}
SELECT k feature, {_round('d')} d, {_round(_ks_probability('sqrt(na * nb / (na + nb)) * d'))} p FROM kd""",
    "ks_2d": f"""WITH {_DEVICES}, p AS (SELECT '' AS k, CAST(frequency AS DOUBLE) x, radius_of_gyration y, is_out_of_hours g FROM f), {_KS_2D} SELECT {_round('d')} d, {_round('p')} p FROM kp""",
    "ks_normal": f"""WITH {_SIGNALS}, t AS (SELECT mac_address k, x - avg(x) OVER (PARTITION BY mac_address) x, y - avg(y) OVER (PARTITION BY mac_address) y FROM s WHERE x IS NOT NULL AND y IS NOT NULL),
i AS (SELECT unnest(range(1000)) i), a AS (SELECT sqrt(-2 * ln((i + 0.5::DOUBLE) / 1000)) r, 2 * pi() * (i * ((sqrt(5) - 1) / 2) - floor(i * ((sqrt(5) - 1) / 2))) w FROM i),
p AS (SELECT k, x, y, 0 g FROM t UNION ALL SELECT k, r * cos(w), r * sin(w), 1 FROM (SELECT DISTINCT k FROM t), a), {_KS_2D} SELECT k mac_address, {_round('d')} d, {_round('p')} p FROM kp""",
    "energy_statistic": f"""WITH {_DEVICES}, z AS (SELECT is_out_of_hours g, (radius_of_gyration - avg(radius_of_gyration) OVER ()) / stddev_pop(radius_of_gyration) OVER () u, (av_path_length - avg(av_path_length) OVER ()) / stddev_pop(av_path_length) OVER () v
 FROM f WHERE radius_of_gyration IS NOT NULL AND av_path_length IS NOT NULL),
m AS (SELECT a.g ga, b.g gb, avg(CASE WHEN a.u = b.u AND a.v = b.v THEN 0.0 ELSE ln(sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2))) END) l FROM z a, z b GROUP BY ALL) SELECT {_round('sum(CASE WHEN ga = gb THEN -l ELSE l END) / 2')} statistic FROM m""",
    "linear_histogram": f"""WITH b AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, count(*) total FROM orders), q AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 20)) AS BIGINT), 19) bucket, (hi - lo) / 20 w, total FROM orders, b)
SELECT bucket, count(*) n, {_round('count(*) / (any_value(total) * any_value(w))', 12)} density FROM q GROUP BY 1""",
    "log_bin": f"""WITH RECURSIVE ed(i, lo, hi, w) AS (SELECT 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE + 1000.0, 1000.0::DOUBLE UNION ALL SELECT i + 1, hi, hi + w * 1.6::DOUBLE, w * 1.6::DOUBLE FROM ed WHERE hi <= (SELECT max(o_totalprice) FROM orders))
SELECT i bucket, {_round('lo', 12)} lo, {_round('hi', 12)} hi, {_round('sqrt(lo * hi)', 12)} centre, {_round('(SELECT count(*) FROM orders WHERE (o_totalprice >= ed.lo OR ed.i = 0) AND o_totalprice < ed.hi) / (SELECT count(*) FROM orders) / (hi - lo)', 12)} density FROM ed""",
    "value_frequency": "SELECT l_linenumber AS value, count(*) frequency FROM lineitem GROUP BY ALL",
    "loglog_regression": f"""WITH {_DEVICES}, p AS (SELECT log10(frequency) x, log10(total_path_length) y FROM f WHERE total_path_length > 0)
SELECT {_round('regr_slope(y, x)')} slope, {_round('regr_intercept(y, x)')} intercept, {_round('corr(y, x)')} r, {_round('sqrt((1 - corr(y, x) ** 2) * regr_syy(y, x) / (regr_sxx(y, x) * (count(*) - 2)))')} stderr, count(*) n FROM p""",
    "matrix_correlation": f"""WITH {_SIGNALS}, e1 AS (SELECT * FROM s WHERE day(date_time) <= 15), e2 AS (SELECT * FROM s WHERE day(date_time) > 15), a AS (SELECT * FROM {_adjacency('e1')}), b AS (SELECT * FROM {_adjacency('e2')})
SELECT {_round('corr(coalesce(a.weight, 0), coalesce(b.weight, 0))')} r FROM a FULL JOIN b USING (src, dst)""",
    "zscore": f"WITH {_DEVICES}, {_Z} SELECT id mac_address, {_round('u')} radius_of_gyration, {_round('v')} av_path_length FROM z",
    "dbscan_core_points": f"""WITH {_DEVICES}, {_Z}, p AS (SELECT id, round(u, 9) u, round(v, 9) v FROM z) SELECT a.id, count(*) neighbours, CAST(count(*) >= 6 AS INTEGER) is_core FROM p a JOIN p b ON pow(a.u - b.u, 2) + pow(a.v - b.v, 2) <= 0.45::DOUBLE * 0.45::DOUBLE GROUP BY 1""",
    "mixture_step": f"""WITH {_DEVICES}, {_Z}, q AS (SELECT id, round(u, 9) u, round(v, 9) v, CASE WHEN dbscan_label = 'Mall Worker' THEN 0 ELSE 1 END k FROM z JOIN f ON mac_address = id WHERE u IS NOT NULL AND v IS NOT NULL),
g AS (SELECT k, count(*) / (SELECT count(*) FROM q) w, avg(u) mu, avg(v) mv, covar_samp(u, u) a, covar_samp(u, v) b, covar_samp(v, v) c FROM q GROUP BY 1),
l AS (SELECT q.id, q.u, q.v, g.k, w / sqrt(a * c - b * b) * exp(-(c * pow(u - mu, 2) - 2 * b * (u - mu) * (v - mv) + a * pow(v - mv, 2)) / (2 * (a * c - b * b))) l FROM q, g),
r AS (SELECT u, v, k, l / sum(l) OVER (PARTITION BY id) r FROM l),
m AS (SELECT k, sum(r) n, sum(r * u) / sum(r) mu, sum(r * v) / sum(r) mv FROM r GROUP BY 1)
SELECT CAST(k AS INTEGER) "cluster", {_round('any_value(n) / (SELECT count(*) FROM q)')} weight, {_round('any_value(mu)')} mean_u, {_round('any_value(mv)')} mean_v, {_round('sum(r * pow(u - mu, 2)) / sum(r) + 1e-6')} cov_uu,
 {_round('sum(r * (u - mu) * (v - mv)) / sum(r)')} cov_uv, {_round('sum(r * pow(v - mv, 2)) / sum(r) + 1e-6')} cov_vv FROM r JOIN m USING (k) GROUP BY k""",
    "bayesian_mixture_step": f"""WITH {_DEVICES}, {_Z}, q AS (SELECT round(u, 9) u, round(v, 9) v, coalesce({_THREE}, 3) k FROM z JOIN f ON mac_address = id WHERE u IS NOT NULL AND v IS NOT NULL),
ev AS (SELECT avg(u) u0, avg(v) v0, covar_samp(u, u) + 1e-6 a, covar_samp(u, v) b, covar_samp(v, v) + 1e-6 c FROM q),
g AS (SELECT k, count(*) n, avg(u) mu, avg(v) mv, count(*) * covar_pop(u, u) su, count(*) * covar_pop(u, v) sv, count(*) * covar_pop(v, v) sw FROM q GROUP BY 1)
SELECT CAST(k AS INTEGER) "cluster", {_round('0.25 + n')} alpha, {_round('1.0 + n')} beta, {_round('(u0 + n * mu) / (1 + n)')} mean_u, {_round('(v0 + n * mv) / (1 + n)')} mean_v, {_round('2.0 + n')} nu,
 {_round('a + su + n / (1 + n) * pow(mu - u0, 2)')} spread_uu, {_round('b + sv + n / (1 + n) * (mu - u0) * (mv - v0)')} spread_uv, {_round('c + sw + n / (1 + n) * pow(mv - v0, 2)')} spread_vv FROM g, ev""",
    "markov_transitions": f"WITH {_SIGNALS}, {_TRANS} SELECT src, dst, {_round('p')} p FROM ta",
    "markov_transitions_collapsed": f"WITH {_SIGNALS}, {_TRANS}, q AS (SELECT * FROM tc WHERE src <> dst) SELECT src, dst, {_round('n / sum(n) OVER (PARTITION BY src)')} p FROM q",
    "markov_initial": f"WITH {_SIGNALS}, {_TRANS} SELECT store_id, n, {_round('p')} p FROM ini",
    "markov_step": f"WITH {_SIGNALS}, {_TRANS} SELECT dst store_id, {_round('sum(ini.p * ta.p)')} p FROM ini JOIN ta ON src = store_id GROUP BY ALL",
    "markov_steady_state": f"""WITH {_SIGNALS}, {_TRANS}, """
    + ", ".join(f"m{i} AS (SELECT dst store_id, sum(q.p * ta.p) p FROM {'ini' if i == 1 else f'm{i - 1}'} q JOIN ta ON src = q.store_id GROUP BY ALL)" for i in range(1, 6))
    + f" SELECT store_id, {_round('p')} p FROM m5",
    "markov_residuals": f"""WITH {_SIGNALS}, {_TRANS}, m0 AS (SELECT store_id, p FROM ini), """
    + ", ".join(f"m{i} AS (SELECT dst store_id, sum(q.p * ta.p) p FROM m{i - 1} q JOIN ta ON src = q.store_id GROUP BY ALL)" for i in range(1, 5))
    + " UNION ALL ".join(
        f"{' ' if i else ' SELECT * FROM ('}SELECT CAST({i} AS INTEGER) step, {_round('sum(pow(coalesce(a.p, 0) - coalesce(b.p, 0), 2))', 9)} residual FROM m{i + 1} a FULL JOIN m{i} b USING (store_id)" for i in range(4)
    )
    + ")",
    "class_statistics": f"""WITH {_DEVICES} SELECT dbscan_label, count(*) n, {_round('avg(radius_of_gyration)')} mean_radius_of_gyration, {_round('stddev_samp(radius_of_gyration)')} std_radius_of_gyration,
 {_round('avg(av_path_length)')} mean_av_path_length, {_round('stddev_samp(av_path_length)')} std_av_path_length FROM f GROUP BY 1""",
    "largest_classes": f"""WITH {_DEVICES} SELECT dbscan_label, mac_address FROM f WHERE dbscan_label IN (SELECT dbscan_label FROM f GROUP BY 1 ORDER BY count(*) DESC, dbscan_label LIMIT 2)""",
    "markov_stationary": f"""WITH {_SIGNALS}, {_TRANS}, w0 AS (SELECT src, dst, p FROM ta), """
    + ", ".join(f"w{i} AS MATERIALIZED (SELECT l.src, r.dst, sum(l.p * r.p) p FROM w{i - 1} l JOIN w{i - 1} r ON l.dst = r.src GROUP BY ALL)" for i in range(1, 11))
    + f" SELECT dst store_id, {_round('avg(p)')} p FROM w10 GROUP BY 1",
    "ingoing_probability": f"WITH {_SIGNALS}, {_TRANS} SELECT dst store_id, {_round('sum(p)')} ingoing FROM ta GROUP BY ALL",
    "visit_pivot_long": f"WITH {_SIGNALS}, {_PIVOT} SELECT * FROM v",
    "analysis_ready": f"WITH {_SIGNALS}, {_steps()}, f AS (SELECT mac_address, count(*) frequency, {_MEASURES} FROM st GROUP BY 1) SELECT mac_address, frequency, av_speed, av_straightness FROM f WHERE frequency > 10 AND isfinite(av_speed) AND isfinite(av_straightness)",
    "track_slopes": f"WITH {_SIGNALS} SELECT event_id, {_round('(lead(y) OVER w - y) / nullif(lead(x) OVER w - x, 0)')} slope FROM s WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id)",
    "signals_with_directory": f"WITH {_SIGNALS}, {_STORES} SELECT event_id, {_round('s.x')} x, {_round('s.y')} y, {_round('stores.x')} x_actual, {_round('stores.y')} y_actual FROM s LEFT JOIN stores USING (store_id)",
    "data_gaps": f"""WITH {_SIGNALS}, {_OUI}, m AS (SELECT s.* FROM s JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6)) WHERE manufacturer = 'FRANCE'),
l AS (SELECT *, lead(date_time) OVER (PARTITION BY mac_address ORDER BY date_time, event_id) t1 FROM m) SELECT mac_address, event_id, {_seconds('date_time', 't1')} gap FROM l WHERE t1 IS NOT NULL""",
    "signals_without_store": f"WITH {_SIGNALS} SELECT mac_address, event_id, {_round('x')} x, {_round('y')} y FROM s WHERE store_id IS NULL OR store_id NOT LIKE 'B%'",
    "duplicate_manufacturers": f"""WITH {_COARSE}, {_OUI}, l AS (SELECT *, lead(date_time) OVER w t1, lead(x) OVER w x1, lead(y) OVER w y1 FROM c WINDOW w AS (PARTITION BY mac_address ORDER BY date_time, event_id)),
d AS (SELECT DISTINCT mac_address FROM l WHERE t1 = date_time AND (x <> x1 OR y <> y1)) SELECT manufacturer, count(*) devices FROM d LEFT JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6)) GROUP BY ALL""",
    "step_speeds": f"WITH {_SIGNALS}, {_steps()} SELECT mac_address, event_id, {_round('d / nullif(ds, 0)')} speed FROM st WHERE x1 IS NOT NULL",
    "manufacturer_volume": f"""WITH {_SIGNALS}, {_OUI}, m AS (SELECT s.*, manufacturer FROM s JOIN oui ON prefix = upper(substr(replace(mac_address, ':', ''), 1, 6))),
top AS (SELECT manufacturer, count(DISTINCT mac_address) n FROM m GROUP BY 1 ORDER BY n DESC, manufacturer LIMIT 30)
SELECT manufacturer, {_bin('date_time', 60)} bin, count(*) signals, count(DISTINCT mac_address) devices FROM m SEMI JOIN top USING (manufacturer) GROUP BY ALL""",
    "gyration_by_mall": f"WITH {_SIGNALS}, g AS (SELECT mac_address, location, sqrt(var_pop(x) + var_pop(y)) r FROM s GROUP BY ALL) SELECT location, count(r) n, {_round('avg(r)')} mean, {_round('stddev_samp(r)')} std FROM g GROUP BY ALL",
    "likeliest_start": f"WITH {_SIGNALS}, {_TRANS} SELECT store_id, {_round('p')} p FROM ini ORDER BY ini.p DESC, store_id LIMIT 1",
    "store_codes": f"WITH {_SIGNALS}, k AS (SELECT store_id, CAST(row_number() OVER (ORDER BY store_id) - 1 AS INTEGER) code FROM (SELECT DISTINCT store_id FROM s WHERE store_id IS NOT NULL)) SELECT event_id, store_id, code, CASE WHEN code IS NOT NULL THEN (SELECT count(*) FROM k) END size FROM s LEFT JOIN k USING (store_id)",
    "similarity_slice": f"WITH {_SIGNALS}, {_PIVOT}, {_CLASSES}, n AS (SELECT class, count(*) n FROM p GROUP BY 1), w AS (SELECT DISTINCT class FROM st JOIN cls USING (stores) WHERE mac_address LIKE '%0') SELECT a.class a, b.class b, {_round('count(*) / any_value(n.n)')} AS value FROM p a JOIN p b USING (store_id) JOIN n ON n.class = b.class WHERE a.class IN (FROM w) AND b.class IN (FROM w) GROUP BY ALL",
    "store_classes": f"WITH {_SIGNALS}, {_PIVOT}, {_CLASSES} SELECT mac_address, class FROM st JOIN cls USING (stores)",
    "common_stores": f"WITH {_SIGNALS}, {_PIVOT}, {_CLASSES} SELECT a.class a, b.class b, count(*) common, string_agg(a.store_id, ',' ORDER BY a.store_id) stores FROM p a JOIN p b USING (store_id) GROUP BY ALL",
    "similarity_col": f"WITH {_SIGNALS}, {_PIVOT}, {_CLASSES}, n AS (SELECT class, count(*) n FROM p GROUP BY 1) SELECT a.class a, b.class b, {_round('count(*) / any_value(n.n)')} AS value FROM p a JOIN p b USING (store_id) JOIN n ON n.class = b.class GROUP BY ALL",
    "similarity_row": f"WITH {_SIGNALS}, {_PIVOT}, {_CLASSES}, n AS (SELECT class, count(*) n FROM p GROUP BY 1) SELECT a.class a, b.class b, {_round('count(*) / any_value(n.n)')} AS value FROM p a JOIN p b USING (store_id) JOIN n ON n.class = a.class GROUP BY ALL",
    "list_overlap": f"WITH {_SIGNALS}, {_PIVOT} SELECT a.mac_address a, b.mac_address b, CAST(sum(a.n * b.n) AS BIGINT) overlap FROM v a JOIN v b USING (store_id) WHERE a.mac_address <= b.mac_address GROUP BY ALL",
    "trajectory_paths": f"""WITH {_SIGNALS} SELECT mac_address, CAST(count(*) AS INTEGER) n, arg_min(x, (date_time, event_id)) x0, arg_min(y, (date_time, event_id)) y0, arg_max(x, (date_time, event_id)) x1, arg_max(y, (date_time, event_id)) y1 FROM s GROUP BY ALL""",
    "hausdorff_directed": f"WITH {_SIGNALS}, {_PATHS} SELECT a, b, {_round('distance')} distance FROM hd",
    "hausdorff_undirected": f"WITH {_SIGNALS}, {_PATHS}, u AS (SELECT x.a, x.b, greatest(x.distance, y.distance) d FROM hd x JOIN hd y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b) SELECT a, b, {_round('d / max(d) OVER ()')} distance FROM u",
    "hausdorff_within": f"WITH {_SIGNALS}, {_DEVICE_PATHS} SELECT a, b, {_round('distance')} distance FROM u WHERE a < b AND u.distance <= 30.0",
    "hausdorff_nearest": f"WITH {_SIGNALS}, {_DEVICE_PATHS} SELECT a, CAST(row_number() OVER w AS INTEGER) rank, b, {_round('distance')} distance FROM u WINDOW w AS (PARTITION BY a ORDER BY u.distance, b) QUALIFY row_number() OVER w <= 3",
    "hausdorff_core_points": f"""WITH {_SIGNALS}, {_PATHS}, u AS (SELECT x.a, x.b, greatest(x.distance, y.distance) d FROM hd x JOIN hd y ON x.a = y.b AND x.b = y.a UNION ALL SELECT DISTINCT a, a, 0.0 FROM hd),
m AS (SELECT a, b, coalesce((d - avg(d) OVER w) / nullif(stddev_pop(d) OVER w, 0), 0) z FROM u WINDOW w AS (PARTITION BY b)),
n AS (SELECT i.a id, j.a other FROM m i JOIN m j USING (b) GROUP BY ALL HAVING sqrt(sum(pow(i.z - j.z, 2))) <= 3.0)
SELECT id, count(*) neighbours, CAST(count(*) >= 3 AS INTEGER) is_core FROM n GROUP BY 1""",
    "animation_frames": f"WITH {_COARSE} SELECT date_time, count(DISTINCT mac_address) devices FROM c GROUP BY ALL",
    "store_pairs": f"""WITH {_SIGNALS}, {_STORES}, p AS (SELECT store_id, round(x, 6) x, round(y, 6) y FROM stores), q AS (SELECT a.store_id src, b.store_id dst, b.x - a.x dx, b.y - a.y dy, {_angle('a.x', 'a.y')} a1, {_angle('b.x', 'b.y')} a2 FROM p a, p b)
SELECT src, dst, {_round('dx')} dx, {_round('dy')} dy, {_round('sqrt(dx * dx + dy * dy)')} distance, CAST(CASE {_way('a1', 'a2')} WHEN -1 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) turn FROM q""",
    "polygon_store_id": f"""WITH {_SIGNALS}, {_STORES}, n AS (SELECT store_id, CAST(substr(store_id, 2, 3) AS INTEGER) i FROM stores WHERE store_id LIKE 'B%'),
sd AS (SELECT unnest([0, 90, 80, 10]) x1, unnest([0, 10, 60, 55]) y1, unnest([90, 80, 10, 0]) x2, unnest([10, 60, 55, 0]) y2),
ed AS (SELECT store_id nm, CAST(x1 + (i % 7) * 60 AS DOUBLE) x1, CAST(y1 + ((i // 7) % 3) * 30 AS DOUBLE) y1, CAST(x2 + (i % 7) * 60 AS DOUBLE) x2, CAST(y2 + ((i // 7) % 3) * 30 AS DOUBLE) y2 FROM n, sd),
h AS (SELECT event_id, nm FROM s, ed WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
g AS (SELECT event_id, count(*) c, min(nm) nm FROM h GROUP BY 1) SELECT event_id point_id, CASE WHEN c > 1 THEN 'more than 1 shop' ELSE nm END "label" FROM s LEFT JOIN g USING (event_id)""",
    "modularity": f"""WITH {_SIGNALS}, e2 AS (SELECT substr(src, 1, 1) cs, substr(dst, 1, 1) cd, weight w FROM {_adjacency()}), t AS (SELECT sum(w) m FROM e2),
q AS (SELECT c, (SELECT coalesce(sum(w), 0) FROM e2 WHERE cs = c AND cd = c) i, (SELECT coalesce(sum(w), 0) FROM e2 WHERE cs = c) o, (SELECT coalesce(sum(w), 0) FROM e2 WHERE cd = c) k FROM (VALUES ('A'), ('B')) v(c)) SELECT {_round('sum(i / m - o / m * k / m)')} q FROM q, t""",
    "modularity_as_written": f"""WITH {_SIGNALS}, e2 AS (SELECT substr(src, 1, 1) cs, substr(dst, 1, 1) cd, weight w FROM {_adjacency()}), t AS (SELECT sum(w) / 2 m FROM e2),
q AS (SELECT c, (SELECT coalesce(sum(w), 0) FROM e2 WHERE cs = c AND cd = c) i, (SELECT coalesce(sum(w), 0) FROM e2 WHERE cs = c) o, (SELECT coalesce(sum(w), 0) FROM e2 WHERE cd = c) k FROM (VALUES ('A'), ('B')) v(c)) SELECT {_round('sum(i / m - o / m * k / m)')} q FROM q, t""",
    "mac_bits": f"""WITH {_SIGNALS}, m AS (SELECT DISTINCT mac_address, CAST('0x' || replace(mac_address, ':', '') AS BIGINT) v FROM s) SELECT mac_address, lpad(bin(v), 48, '0') bits FROM m""",
    "reverse_mac": f"""WITH {_SIGNALS}, m AS (SELECT DISTINCT mac_address FROM s), o AS (SELECT mac_address, generate_subscripts(string_split(mac_address, ':'), 1) i, unnest(string_split(mac_address, ':')) h FROM m),
r AS (SELECT mac_address, i, list_sum(list_transform(range(8), lambda b: ((CAST('0x' || h AS INTEGER) >> b) & 1) << (7 - b))) v FROM o) SELECT mac_address, string_agg(printf('%02x', CAST(v AS INTEGER)), ':' ORDER BY i) reversed FROM r GROUP BY 1""",
}
