"""Pieces of oracle SQL (DuckDB) that several queries share, as WITH entries that follow the adapter's tables."""

from __future__ import annotations


def seconds(x: str) -> str:
    p = lambda i: f"try_cast(split_part({x}, ':', {i}) AS INT)"
    return f"CASE WHEN len(string_split({x}, ':')) = 3 AND {p(1)} IS NOT NULL AND {p(2)} BETWEEN 0 AND 59 AND {p(3)} BETWEEN 0 AND 59 THEN {p(1)} * 3600 + {p(2)} * 60 + {p(3)} END"


CANON = "canon AS (SELECT stop_id, coalesce(nullif(parent_station, ''), stop_id) AS canonical FROM stops)"
COORDS = "coords AS (SELECT canonical AS stop, arg_min(stop_lat, s.stop_id) AS lat, arg_min(stop_lon, s.stop_id) AS lon FROM stops s JOIN canon USING (stop_id) WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL GROUP BY 1)"
TIMED = f"""timed AS (SELECT trip_id, stop_sequence AS seq, coalesce(canonical, st.stop_id) AS stop,
    {seconds("coalesce(nullif(arrival_time, ''), nullif(departure_time, ''))")} AS arr, {seconds("coalesce(nullif(departure_time, ''), nullif(arrival_time, ''))")} AS dep
    FROM stop_times st LEFT JOIN canon USING (stop_id))"""
PAIRS = """pairs AS (SELECT *, CASE WHEN arr >= dep THEN arr - dep END AS weight FROM (
    SELECT trip_id, lag(stop) OVER w AS from_stop, stop AS to_stop, lag(dep) OVER w AS dep, arr FROM timed WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) p
    WHERE from_stop IS NOT NULL AND from_stop <> to_stop)"""
MERGED = """runs AS (SELECT *, sum(nw) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY trip_id ORDER BY seq) = stop THEN 0 ELSE 1 END AS nw FROM timed) a),
merged AS (SELECT trip_id, (run - 1)::INT AS pos, any_value(stop) AS stop, min(arr) AS arr, max(dep) AS dep, max((arr IS NULL OR dep IS NULL)::INT) AS bad FROM runs GROUP BY trip_id, run)"""
VALID = """checked AS (SELECT *, CASE WHEN bad = 1 OR dep < arr OR arr < lag(dep) OVER (PARTITION BY trip_id ORDER BY pos) THEN 1 ELSE 0 END AS b FROM merged),
good AS (SELECT trip_id FROM checked GROUP BY trip_id HAVING max(b) = 0 AND count(*) >= 2),
valid AS (SELECT trip_id, pos, stop, arr, dep FROM checked WHERE trip_id IN (SELECT trip_id FROM good))"""
PATTERNS = """seqs AS (SELECT trip_id, list(stop ORDER BY pos) AS stops, arg_min(dep, pos) AS first_dep, arg_max(arr, pos) AS last_arr FROM valid GROUP BY trip_id),
keyed AS (SELECT s.*, t.route_id, t.direction_id, 'pattern_' || substr(md5(coalesce(t.route_id, '') || '|' || coalesce(t.direction_id::VARCHAR, '') || '|' || array_to_string(stops, ',')), 1, 12) AS pattern
    FROM seqs s LEFT JOIN trips t USING (trip_id)),
patterns AS (SELECT trip_id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY first_dep, last_arr, trip_id) - 1 AS trip_index, route_id, direction_id, stops FROM keyed)"""
TRANSFERS = """moves AS (SELECT coalesce(a.canonical, from_stop_id) AS from_stop, coalesce(b.canonical, to_stop_id) AS to_stop, min_transfer_time AS weight
    FROM transfers LEFT JOIN canon a ON a.stop_id = from_stop_id LEFT JOIN canon b ON b.stop_id = to_stop_id WHERE coalesce(a.canonical, from_stop_id) <> coalesce(b.canonical, to_stop_id))"""


def walks(metres: int, speed: float, cap: int) -> str:
    return f"""xy AS (SELECT stop, radians(lon) * 6371000.0 * greatest(cos(radians((SELECT avg(lat) FROM coords))), 1e-8) AS x, radians(lat) * 6371000.0 AS y FROM coords),
near AS (SELECT a.stop AS from_stop, b.stop AS to_stop, round_even(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 0)::INT AS metres
    FROM xy a JOIN xy b ON a.stop <> b.stop AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) > 0 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= {metres}.0 * {metres}.0),
walks AS (SELECT from_stop, to_stop, metres, greatest(1, round_even(metres / {speed}::DOUBLE, 0)::INT) AS seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY from_stop ORDER BY metres, to_stop) AS r FROM near WHERE (from_stop, to_stop) NOT IN (SELECT (from_stop, to_stop) FROM moves)) q WHERE r <= {cap})"""


PATHS = """paths AS (SELECT from_stop, to_stop, seconds, is_walk FROM (SELECT *, row_number() OVER (PARTITION BY from_stop, to_stop ORDER BY is_walk, seconds) AS r FROM (
    SELECT from_stop, to_stop, greatest(0, coalesce(weight, 0))::INT AS seconds, 0 AS is_walk FROM moves UNION ALL SELECT from_stop, to_stop, seconds, 1 FROM walks) u WHERE from_stop <> to_stop) v WHERE r = 1)"""


#: The ends of rounds(): the stations of a request's two stops.
STATIONS = "starts AS MATERIALIZED (SELECT query_id, canonical AS stop, 0 AS seconds FROM requests JOIN canon ON stop_id = origin), ends AS MATERIALIZED (SELECT query_id, canonical AS stop, 0 AS egress FROM requests JOIN canon ON stop_id = destination)"


def rounds(n: int, wait: int = 1200, horizon: int = 14_400, ends: str = STATIONS) -> str:
    """Labels by rounds as plain SQL, after PATHS, VALID and PATTERNS, for all requests: lab(query_id, rnd, stop, t, w, trip_id,
    from_pos, from_stop, pos, dep, sec, foot) and z(query_id, round, arrival). Walks are closed beforehand over up to 64 paths."""
    out = ["w0 AS MATERIALIZED (SELECT from_stop, to_stop, seconds, is_walk = 1 AS foot FROM paths)"]
    for i in range(1, 7):
        out.append(f"""w{i} AS MATERIALIZED (SELECT from_stop, to_stop, min(seconds) AS seconds, arg_min(foot, (seconds, foot)) AS foot FROM (SELECT * FROM w{i - 1}
    UNION ALL SELECT a.from_stop, b.to_stop, a.seconds + b.seconds, a.foot OR b.foot FROM w{i - 1} a JOIN w{i - 1} b ON a.to_stop = b.from_stop AND a.from_stop <> b.to_stop) u GROUP BY ALL)""")
    out.append(f"q AS MATERIALIZED (SELECT query_id, depart, depart + {horizon} AS lim FROM requests), {ends}")
    out.append(f"calls AS MATERIALIZED (SELECT v.*, p.pattern, p.trip_index, v.dep // {wait} AS bin FROM valid v JOIN patterns p USING (trip_id))")
    out.append("r0 AS MATERIALIZED (SELECT query_id, stop, depart + seconds AS t, 0 AS w, NULL::VARCHAR AS trip_id, NULL::INT AS from_pos, NULL::VARCHAR AS from_stop, NULL::INT AS pos, NULL::INT AS dep, NULL::INT AS sec, NULL::BOOLEAN AS foot FROM q JOIN starts USING (query_id) WHERE depart + seconds <= lim)")
    for i in range(n + 1):
        if i:
            out.append(f"""o{i} AS (SELECT f.query_id, c.pattern, c.pos AS from_pos, any_value(f.stop) AS from_stop, arg_min(c.trip_id, (c.dep, c.trip_index)) AS trip_id, min(c.dep) AS dep
    FROM (SELECT *, unnest([t // {wait}, t // {wait} + 1]) AS bin FROM l{i - 1}) f JOIN q USING (query_id) JOIN calls c ON c.stop = f.stop AND c.bin = f.bin AND c.dep >= f.t AND c.dep <= f.t + {wait} AND c.dep <= lim GROUP BY f.query_id, c.pattern, c.pos),
t{i} AS (SELECT query_id, trip_id, min(from_pos) AS from_pos, arg_min(from_stop, from_pos) AS from_stop, arg_min(dep, from_pos) AS dep FROM o{i} GROUP BY ALL),
r{i} AS MATERIALIZED (SELECT g.query_id, g.stop, g.t, 0 AS w, trip_id, from_pos, from_stop, pos, dep, NULL::INT AS sec, NULL::BOOLEAN AS foot FROM (
    SELECT t.query_id, c.stop, c.arr AS t, t.trip_id, t.from_pos, t.from_stop, c.pos, t.dep, row_number() OVER (PARTITION BY t.query_id, c.stop ORDER BY c.arr, t.trip_id, t.from_pos, c.pos) AS n
    FROM t{i} t JOIN calls c ON c.trip_id = t.trip_id AND c.pos > t.from_pos JOIN q ON q.query_id = t.query_id WHERE c.arr <= lim) g LEFT JOIN b{i - 1} b ON b.query_id = g.query_id AND b.stop = g.stop WHERE n = 1 AND (b.t IS NULL OR g.t < b.t))""")
        best = f"SELECT query_id, stop, t FROM r{i}" + (f" UNION ALL SELECT query_id, stop, t FROM b{i - 1}" if i else "")
        out.append(f"""k{i} AS (SELECT g.* FROM (SELECT r.query_id, w.to_stop AS stop, r.t + w.seconds AS t, r.stop AS from_stop, w.seconds AS sec, w.foot, row_number() OVER (PARTITION BY r.query_id, w.to_stop ORDER BY r.t + w.seconds, r.stop) AS n
    FROM r{i} r JOIN w6 w ON w.from_stop = r.stop JOIN q ON q.query_id = r.query_id WHERE r.t + w.seconds <= lim) g LEFT JOIN (SELECT query_id, stop, min(t) AS t FROM ({best}) x GROUP BY ALL) b ON b.query_id = g.query_id AND b.stop = g.stop WHERE n = 1 AND (b.t IS NULL OR g.t < b.t)),
l{i} AS MATERIALIZED (SELECT r.* FROM r{i} r ANTI JOIN k{i} k ON k.query_id = r.query_id AND k.stop = r.stop UNION ALL SELECT query_id, stop, t, 1, NULL, NULL, from_stop, NULL, NULL, sec, foot FROM k{i}),
b{i} AS MATERIALIZED (SELECT query_id, stop, min(t) AS t FROM (SELECT query_id, stop, t FROM l{i}""" + (f" UNION ALL SELECT * FROM b{i - 1}" if i else "") + ") u GROUP BY ALL)")
    out.append("lab AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS rnd, * FROM l{i}" for i in range(n + 1)) + ")")
    out.append("z AS MATERIALIZED (SELECT * FROM (SELECT *, min(arrival) OVER (PARTITION BY query_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT query_id, rnd AS round, min(t + egress) AS arrival FROM lab JOIN ends USING (query_id, stop) JOIN q USING (query_id) WHERE t + egress <= lim GROUP BY ALL) g) h WHERE e IS NULL OR arrival < e)")
    return ", ".join(out)


#: The steps of each option of z, from rounds(): j(query_id, round, pos, kind, label, from_stop, to_stop, dep, arr, seconds, trip_id, from_pos, to_pos).
JOURNEYS = """back AS (SELECT z.query_id, z.round, arg_min(l.stop, (egress, l.stop)) AS stop, z.round AS rnd, 0 AS n FROM z JOIN lab l ON l.query_id = z.query_id AND l.rnd = z.round JOIN ends e ON e.query_id = l.query_id AND e.stop = l.stop AND t + egress = arrival GROUP BY z.query_id, z.round
    UNION ALL SELECT p.query_id, p.round, l.from_stop, l.rnd - 1 + l.w, p.n + 1 FROM back p JOIN lab l ON l.query_id = p.query_id AND l.stop = p.stop AND l.rnd = p.rnd WHERE l.from_stop IS NOT NULL),
j AS (SELECT p.query_id, p.round, row_number() OVER (PARTITION BY p.query_id, p.round ORDER BY p.n DESC) - 1 AS pos, CASE WHEN l.w = 0 THEN 'trip' ELSE 'transfer' END AS kind, CASE WHEN l.w = 1 AND l.foot THEN 'walk' END AS label,
    l.from_stop, l.stop AS to_stop, CASE WHEN l.w = 0 THEN l.dep ELSE l.t - l.sec END AS dep, l.t AS arr, CASE WHEN l.w = 0 THEN l.t - l.dep ELSE l.sec END AS seconds, l.trip_id, l.from_pos, l.pos AS to_pos
    FROM back p JOIN lab l ON l.query_id = p.query_id AND l.stop = p.stop AND l.rnd = p.rnd WHERE l.from_stop IS NOT NULL)"""


def relaxed(steps: int, route_penalty: int = 0, penalty: int = 60, wait: int = 1200, horizon: int = 14_400) -> str:
    """Labels of the label-correcting search as plain SQL, after PAIRS and TRANSFERS, for all requests: lab(query_id, step, stop,
    active, t, kind, trip_id, from_stop, from_active, dep), and g(query_id, t, step, stop, active), the goals' earliest ones."""
    out = ["q AS MATERIALIZED (SELECT query_id, depart + %d AS lim, depart, a.canonical AS src, b.canonical AS dst FROM requests JOIN canon a ON a.stop_id = origin JOIN canon b ON b.stop_id = destination)" % horizon]
    out.append(f"rides AS MATERIALIZED (SELECT from_stop, to_stop, dep, arr, trip_id, route_id, dep // {wait} AS bin FROM pairs LEFT JOIN trips USING (trip_id) WHERE weight IS NOT NULL)")
    out.append(f"hopped AS MATERIALIZED (SELECT from_stop, to_stop, min(weight) + {penalty} AS cost FROM moves WHERE weight IS NOT NULL GROUP BY ALL)")
    out.append("f0 AS MATERIALIZED (SELECT query_id, src AS stop, '' AS active, depart AS t, NULL::INT AS kind, NULL::VARCHAR AS trip_id, NULL::VARCHAR AS from_stop, NULL::VARCHAR AS from_active, NULL::INT AS dep FROM q), b0 AS MATERIALIZED (SELECT query_id, stop, active, t FROM f0)")
    active = "d.route_id" if route_penalty else "''"
    for i in range(1, steps + 1):
        out.append(f"""n{i} AS (SELECT query_id, to_stop AS stop, {active} AS active, d.arr + CASE WHEN from_active <> '' AND from_active <> d.route_id THEN {route_penalty} ELSE 0 END AS t, 0 AS kind, d.trip_id AS trip_id, from_stop, from_active, d.dep AS dep FROM (
    SELECT f.query_id, r.to_stop, f.stop AS from_stop, f.active AS from_active, arg_min(struct_pack(dep := r.dep, trip_id := r.trip_id, arr := r.arr, route_id := r.route_id), (r.dep, r.trip_id)) AS d
    FROM (SELECT *, unnest([t // {wait}, t // {wait} + 1]) AS bin FROM f{i - 1}) f JOIN q USING (query_id) JOIN rides r ON r.from_stop = f.stop AND r.bin = f.bin AND r.dep >= f.t AND r.dep <= f.t + {wait} AND r.dep <= lim GROUP BY f.query_id, f.stop, f.active, r.to_stop) x
    UNION ALL SELECT f.query_id, to_stop, '', f.t + cost, 1, NULL, f.stop, f.active, NULL FROM f{i - 1} f JOIN hopped h ON h.from_stop = f.stop),
f{i} AS MATERIALIZED (SELECT n.* EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, stop, active ORDER BY t, kind, trip_id, from_stop, from_active) AS rn FROM n{i}) n JOIN q USING (query_id) LEFT JOIN b{i - 1} b ON b.query_id = n.query_id AND b.stop = n.stop AND b.active = n.active
    WHERE rn = 1 AND n.t <= lim AND (b.t IS NULL OR n.t < b.t)),
b{i} AS MATERIALIZED (SELECT query_id, stop, active, min(t) AS t FROM (SELECT * FROM b{i - 1} UNION ALL SELECT query_id, stop, active, t FROM f{i}) u GROUP BY ALL)""".replace("n.* EXCLUDE (rn)", "n.query_id, n.stop, n.active, n.t, n.kind, n.trip_id, n.from_stop, n.from_active, n.dep"))
    out.append("lab AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS step, * FROM f{i}" for i in range(steps + 1)) + ")")
    out.append("g AS MATERIALIZED (SELECT query_id, t, step, stop, active FROM (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY t, step, active) AS n FROM lab l JOIN q USING (query_id) WHERE stop = dst) x WHERE n = 1)")
    return ", ".join(out)


def edge_search(steps: int, state: str = "route", change: int = 0, penalty: int = 60, wait: int = 1200, horizon: int = 14_400) -> str:
    """relaxed() over a table edges(ride, from_stop, to_stop, weight, headway, dep, arr, trip_id, route_id), where of the rides of one
    route (or trip) at a label only the first to leave is taken. lab and g as in relaxed()."""
    out = ["q AS MATERIALIZED (SELECT query_id, depart + %d AS lim, depart, a.canonical AS src, b.canonical AS dst FROM requests JOIN canon a ON a.stop_id = origin JOIN canon b ON b.stop_id = destination)" % horizon]
    key = f"coalesce({state}_id, {'trip' if state == 'route' else 'route'}_id)"
    out.append(f"timed_edges AS MATERIALIZED (SELECT *, {key} AS grp, dep // {wait} AS bin FROM edges WHERE ride AND dep IS NOT NULL AND arr >= dep)")
    out.append(f"""steady AS MATERIALIZED (SELECT * FROM (SELECT *, {key} AS grp, coalesce(headway // 2, 0) AS waits, row_number() OVER (PARTITION BY from_stop, {key} ORDER BY coalesce(headway // 2, 0), weight, to_stop, trip_id) AS n
    FROM edges WHERE ride AND dep IS NULL AND weight IS NOT NULL AND coalesce(headway // 2, 0) <= {wait}) x WHERE n = 1)""")
    out.append(f"hopped AS MATERIALIZED (SELECT from_stop, to_stop, min(weight) + {penalty} AS cost FROM edges WHERE NOT ride AND weight IS NOT NULL GROUP BY ALL)")
    out.append("f0 AS MATERIALIZED (SELECT query_id, src AS stop, '' AS active, depart AS t, NULL::INT AS kind, NULL::VARCHAR AS trip_id, NULL::VARCHAR AS from_stop, NULL::VARCHAR AS from_active, NULL::INT AS dep FROM q), b0 AS MATERIALIZED (SELECT query_id, stop, active, t FROM f0)")
    on = f"d.{state}_id"
    for i in range(1, steps + 1):
        out.append(f"""n{i} AS (SELECT query_id, d.to_stop AS stop, {on if change else "''"} AS active, d.arr + CASE WHEN from_active <> '' AND from_active <> {on} THEN {change} ELSE 0 END AS t, 0 AS kind, d.trip_id AS trip_id, from_stop, from_active, d.dep AS dep FROM (
    SELECT query_id, from_stop, from_active, arg_min(struct_pack(arr := arr, to_stop := to_stop, trip_id := trip_id, route_id := route_id, dep := dep), (leaves, arr, to_stop, trip_id)) AS d FROM (
        SELECT f.query_id, f.stop AS from_stop, f.active AS from_active, e.grp, e.dep AS leaves, e.arr, e.to_stop, e.trip_id, e.route_id, e.dep
        FROM (SELECT *, unnest([t // {wait}, t // {wait} + 1]) AS bin FROM f{i - 1}) f JOIN q USING (query_id) JOIN timed_edges e ON e.from_stop = f.stop AND e.bin = f.bin AND e.dep >= f.t AND e.dep <= f.t + {wait} WHERE f.t <= lim
        UNION ALL SELECT f.query_id, f.stop, f.active, e.grp, f.t + waits, f.t + waits + e.weight, e.to_stop, e.trip_id, e.route_id, NULL FROM f{i - 1} f JOIN q USING (query_id) JOIN steady e ON e.from_stop = f.stop WHERE f.t <= lim) c
    GROUP BY query_id, from_stop, from_active, grp) x
    UNION ALL SELECT f.query_id, to_stop, '', f.t + cost, 1, NULL, f.stop, f.active, NULL FROM f{i - 1} f JOIN q USING (query_id) JOIN hopped h ON h.from_stop = f.stop WHERE f.t <= lim),
f{i} AS MATERIALIZED (SELECT n.query_id, n.stop, n.active, n.t, n.kind, n.trip_id, n.from_stop, n.from_active, n.dep FROM (SELECT *, row_number() OVER (PARTITION BY query_id, stop, active ORDER BY t, kind, trip_id, from_stop, from_active) AS rn FROM n{i}) n
    LEFT JOIN b{i - 1} b ON b.query_id = n.query_id AND b.stop = n.stop AND b.active = n.active WHERE rn = 1 AND (b.t IS NULL OR n.t < b.t)),
b{i} AS MATERIALIZED (SELECT query_id, stop, active, min(t) AS t FROM (SELECT * FROM b{i - 1} UNION ALL SELECT query_id, stop, active, t FROM f{i}) u GROUP BY ALL)""")
    out.append("lab AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS step, * FROM f{i}" for i in range(steps + 1)) + ")")
    out.append("g AS MATERIALIZED (SELECT query_id, t, step, stop, active FROM (SELECT l.*, row_number() OVER (PARTITION BY query_id ORDER BY t, step, active) AS n FROM lab l JOIN q USING (query_id) WHERE stop = dst) x WHERE n = 1)")
    return ", ".join(out)


#: BLD-7's rides, after PAIRS: anytime(trip_id, route_id, from_stop, to_stop, weight, headway).
ANYTIME = """medians AS (SELECT route_id, service_id, direction_id, from_stop, to_stop, floor(median(weight))::INT AS median_sec FROM pairs LEFT JOIN trips USING (trip_id) WHERE weight IS NOT NULL GROUP BY ALL),
firsts AS (SELECT trip_id, arg_min(dep, seq) AS dep FROM timed GROUP BY 1), gaps AS (SELECT route_id, service_id, direction_id, dep - lag(dep) OVER (PARTITION BY route_id, service_id, direction_id ORDER BY dep, trip_id) AS gap FROM firsts LEFT JOIN trips USING (trip_id) WHERE dep IS NOT NULL),
headways AS (SELECT route_id, service_id, direction_id, floor(median(CASE WHEN gap > 0 THEN gap END))::INT AS headway_sec FROM gaps GROUP BY ALL),
anytime AS (SELECT p.trip_id, t.route_id, p.from_stop, p.to_stop, coalesce(median_sec, weight) AS weight, coalesce(headway_sec, 900) AS headway FROM pairs p LEFT JOIN trips t USING (trip_id)
    LEFT JOIN medians m ON m.route_id = t.route_id AND m.service_id = t.service_id AND m.direction_id = t.direction_id AND m.from_stop = p.from_stop AND m.to_stop = p.to_stop
    LEFT JOIN headways h ON h.route_id = t.route_id AND h.service_id = t.service_id AND h.direction_id = t.direction_id)"""
_WALKED = "UNION ALL SELECT false, from_stop, to_stop, weight, NULL, NULL, NULL, NULL, NULL FROM moves"
_RIDDEN = "SELECT true AS ride, from_stop, to_stop, weight, headway, NULL::INT AS dep, NULL::INT AS arr, trip_id, route_id FROM anytime"
_TIMED = "SELECT true AS ride, from_stop, to_stop, NULL::INT AS weight, NULL::INT AS headway, dep, arr, trip_id, route_id FROM pairs LEFT JOIN trips USING (trip_id) WHERE weight IS NOT NULL"
ODD = "substr(route_id, 2)::INT % 2 = 1"
#: edges of edge_search(): rides without clock times; odd routes by the clock and the others without; all by the clock.
ANYTIME_EDGES = f"edges AS MATERIALIZED ({_RIDDEN} {_WALKED})"
MIXED_EDGES = f"edges AS MATERIALIZED ({_TIMED} AND {ODD} UNION ALL {_RIDDEN} WHERE NOT {ODD} {_WALKED})"
TIMED_EDGES = f"edges AS MATERIALIZED ({_TIMED} {_WALKED})"


#: The way to each goal, from relaxed(): h(query_id, pos, kind, from_stop, to_stop, trip_id, dep, arr).
HOPS = """back AS (SELECT query_id, step, stop, active FROM g UNION ALL SELECT p.query_id, p.step - 1, l.from_stop, l.from_active FROM back p JOIN lab l ON l.query_id = p.query_id AND l.step = p.step AND l.stop = p.stop AND l.active = p.active WHERE l.from_stop IS NOT NULL),
h AS (SELECT p.query_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.step) - 1 AS pos, CASE WHEN l.kind = 0 THEN 'trip' ELSE 'transfer' END AS kind, l.from_stop, l.stop AS to_stop, l.trip_id, l.dep, l.t AS arr
    FROM back p JOIN lab l ON l.query_id = p.query_id AND l.step = p.step AND l.stop = p.stop AND l.active = p.active WHERE l.from_stop IS NOT NULL)"""


#: journeys' steps j with what routes and stops say: e.
DESCRIBED = """e AS (SELECT j.*, t.shape_id, coalesce(route_short_name, t.route_id) AS line, CASE WHEN regexp_matches(ltrim(trim(route_color), '#'), '^[0-9A-Fa-f]{6}$') THEN '#' || upper(ltrim(trim(route_color), '#')) END AS colour, a.stop_name AS from_name, b.stop_name AS to_name
    FROM j LEFT JOIN trips t ON t.trip_id = j.trip_id LEFT JOIN routes r ON r.route_id = t.route_id LEFT JOIN stops a ON a.stop_id = from_stop LEFT JOIN stops b ON b.stop_id = to_stop)"""
#: Lines of e's steps: m(query_id, round, pos, line_string).
GEOMETRY = """pts AS (SELECT shape_id, list(lat ORDER BY shape_pt_sequence) AS la, list(lon ORDER BY shape_pt_sequence) AS lo FROM shapes GROUP BY 1),
pr AS (SELECT DISTINCT e.shape_id, from_stop, to_stop, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM e JOIN coords a ON a.stop = from_stop JOIN coords b ON b.stop = to_stop),
vx AS (SELECT shape_id, from_stop, to_stop, la, lo, list_position(d1, list_min(d1)) - 1 AS va, list_position(d2, list_min(d2)) - 1 AS vb, len(la) AS n FROM (SELECT pr.*, la, lo, list_transform(generate_series(1, len(la)), lambda i: pow(la[i] - lat1, 2) + pow(lo[i] - lon1, 2)) AS d1,
    list_transform(generate_series(1, len(la)), lambda i: pow(la[i] - lat2, 2) + pow(lo[i] - lon2, 2)) AS d2 FROM pr JOIN pts USING (shape_id)) y),
vs AS (SELECT *, CASE WHEN va = vb THEN least(va + 1, n - 1) ELSE greatest(va, vb) END AS hi, least(va, vb) AS lw FROM vx),
vt AS (SELECT shape_id, from_stop, to_stop, va > vb AS back, list_transform(generate_series(CASE WHEN lw = hi THEN greatest(lw - 1, 0) ELSE lw END + 1, hi + 1), lambda i: printf('%.5f %.5f', lo[i], la[i])) AS ps FROM vs WHERE n >= 2),
m AS (SELECT query_id, round, pos, CASE WHEN ps IS NOT NULL THEN array_to_string(CASE WHEN back THEN list_reverse(ps) ELSE ps END, ',') WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN printf('%.5f %.5f', a.lon, a.lat) || ',' || printf('%.5f %.5f', b.lon, b.lat) END AS line_string
    FROM e LEFT JOIN vt ON vt.shape_id = e.shape_id AND vt.from_stop = e.from_stop AND vt.to_stop = e.to_stop LEFT JOIN coords a ON a.stop = e.from_stop LEFT JOIN coords b ON b.stop = e.to_stop)"""
#: e's steps as answers. Walks are closed, so no two transfers follow each other and each is a leg; rides of one line that follow each other are one.
ANSWERS = """s1 AS (SELECT *, CASE WHEN kind = 'trip' THEN line ELSE label END AS lb FROM e),
s2 AS (SELECT *, sum(CASE WHEN kind = 'trip' AND coalesce(pk = 'trip' AND pl = lb, false) THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, round ORDER BY pos) AS leg FROM (SELECT *, lag(kind) OVER (PARTITION BY query_id, round ORDER BY pos) AS pk, lag(lb) OVER (PARTITION BY query_id, round ORDER BY pos) AS pl FROM s1) x),
s3 AS (SELECT query_id, round, leg, sum(seconds + CASE WHEN kind = 'trip' THEN 0 ELSE 300 END)::BIGINT AS sec, arg_min(from_stop, pos) AS a, arg_max(to_stop, pos) AS b FROM s2 GROUP BY ALL),
s4 AS (SELECT query_id, round, string_agg(a || ' -> ' || b || ': ' || sec || ' sec (' || printf('%.1f', round_even(sec / 6.0::DOUBLE, 0) / 10) || ' min)', '; ' ORDER BY leg) AS legs, count(*) AS n_legs FROM s3 GROUP BY ALL),
rides AS (SELECT query_id, round, colour, row_number() OVER (PARTITION BY query_id, round ORDER BY pos) - 1 AS i FROM e WHERE kind = 'trip'),
drawn AS (SELECT query_id, round, -1::BIGINT AS i, '' AS c FROM (SELECT DISTINCT query_id, round FROM rides) x
    UNION ALL SELECT r.query_id, r.round, r.i, CASE WHEN colour IS NOT NULL AND colour <> c THEN colour WHEN p[(r.i % 4 + 1)::INT] <> c THEN p[(r.i % 4 + 1)::INT] ELSE p[((r.i + 1) % 4 + 1)::INT] END
    FROM drawn d JOIN rides r ON r.query_id = d.query_id AND r.round = d.round AND r.i = d.i + 1, (SELECT ['#1B6CA8', '#D1495B', '#2F9E44', '#8E5BA6'] AS p) q),
s5 AS (SELECT query_id, round, string_agg(c, ',' ORDER BY i) AS colours, count(*)::INT AS n_rides FROM drawn WHERE i >= 0 GROUP BY ALL),
opts AS (SELECT query_id, round, arrival::INT AS arrival, greatest(round - 1, 0) AS transfers FROM z),
answers AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arrival DESC, transfers, n_legs, round) - 1 AS place, row_number() OVER (PARTITION BY query_id ORDER BY arrival, transfers, round) = 1 AS best, min(transfers) OVER (PARTITION BY query_id) AS fewest FROM (
    SELECT o.*, coalesce(legs, '') AS legs, coalesce(n_legs, 0) AS n_legs, coalesce(colours, '') AS colours, coalesce(n_rides, 0) AS n_rides FROM opts o LEFT JOIN s4 USING (query_id, round) LEFT JOIN s5 USING (query_id, round)) y)"""


def laea(e: str, n: str, name: str, source: str) -> str:
    """name: source's rows with lat and lon of its columns e, n in LAEA Europe (EPSG:3035), as WITH entries. The inverse of the
    spherical form on the authalic sphere, whose latitude goes back to the ellipsoid's by a series in the eccentricity."""
    import math

    a, f = 6_378_137.0, 1 / 298.257222101
    k = f * (2 - f)
    q = lambda s: (1 - k) * (s / (1 - k * s * s) - math.log((1 - math.sqrt(k) * s) / (1 + math.sqrt(k) * s)) / (2 * math.sqrt(k)))
    s0, c0 = math.sin(math.radians(52)), math.cos(math.radians(52))
    r = a * math.sqrt(q(1.0) / 2)
    sb = q(s0) / q(1.0)
    cb = math.sqrt(1 - sb * sb)
    d = a * c0 / math.sqrt(1 - k * s0 * s0) / (r * cb)
    g = (k / 3 + 31 * k**2 / 180 + 517 * k**3 / 5040, 23 * k**2 / 360 + 251 * k**3 / 3780, 761 * k**3 / 45360)
    v = lambda x: repr(float(x)) + "::DOUBLE"
    return f"""{name}1 AS (SELECT *, {e} - 4321000.0::DOUBLE AS x_, {n} - 3210000.0::DOUBLE AS y_ FROM {source}),
{name}2 AS (SELECT *, sqrt(pow(x_ / {v(d)}, 2) + pow(y_ * {v(d)}, 2)) AS r_ FROM {name}1), {name}3 AS (SELECT *, 2 * asin(r_ / {v(2 * r)}) AS c_ FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN r_ > 0 THEN asin(cos(c_) * {v(sb)} + {v(d * cb)} * y_ * sin(c_) / r_) ELSE asin({v(sb)}) END AS b_, CASE WHEN r_ > 0 THEN atan2(x_ * sin(c_), {v(d * cb)} * r_ * cos(c_) - {v(d * d * sb)} * y_ * sin(c_)) ELSE 0 END AS l_ FROM {name}3),
{name} AS (SELECT *, degrees(b_ + {v(g[0])} * sin(2 * b_) + {v(g[1])} * sin(4 * b_) + {v(g[2])} * sin(6 * b_)) AS lat, 10 + degrees(l_) AS lon FROM {name}4)"""


def utm32(e: str, n: str, name: str, source: str) -> str:
    """name: source's rows with lat and lon of its columns e, n in UTM zone 32 (EPSG:25832), as WITH entries: the inverse series of the
    third flattening."""
    f = 1 / 298.257222101
    m = f / (2 - f)
    r = 6_378_137.0 / (1 + m) * (1 + m**2 / 4 + m**4 / 64) * 0.9996
    b = (m / 2 - 2 * m**2 / 3 + 37 * m**3 / 96, m**2 / 48 + m**3 / 15, 17 * m**3 / 480)
    d = (2 * m - 2 * m**2 / 3 - 2 * m**3, 7 * m**2 / 3 - 8 * m**3 / 5, 56 * m**3 / 15)
    v = lambda x: repr(float(x)) + "::DOUBLE"
    xi = " ".join(f"- {v(b[j])} * sin({2 * j + 2} * x_) * (exp({2 * j + 2} * y_) + exp(-{2 * j + 2} * y_)) / 2" for j in range(3))
    eta = " ".join(f"- {v(b[j])} * cos({2 * j + 2} * x_) * (exp({2 * j + 2} * y_) - exp(-{2 * j + 2} * y_)) / 2" for j in range(3))
    lat = " ".join(f"+ {v(d[j])} * sin({2 * j + 2} * c_)" for j in range(3))
    return f"""{name}1 AS (SELECT *, {n} / {v(r)} AS x_, ({e} - 500000.0::DOUBLE) / {v(r)} AS y_ FROM {source}), {name}2 AS (SELECT *, x_ {xi} AS u_, y_ {eta} AS w_ FROM {name}1),
{name}3 AS (SELECT *, asin(sin(u_) / ((exp(w_) + exp(-w_)) / 2)) AS c_ FROM {name}2), {name} AS (SELECT *, degrees(c_ {lat}) AS lat, 9 + degrees(atan2((exp(w_) - exp(-w_)) / 2, cos(u_))) AS lon FROM {name}3)"""


def values(rows: dict) -> str:
    return ", ".join(f"('{k}', {v!r})" for k, v in rows.items())
