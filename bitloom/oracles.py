"""DuckDB SQL of the longer queries: ladders, order-dependent encoders, series and exponential online encoders."""

from __future__ import annotations

import math

import numpy as np

from bitloom.functions.thermo import probabilities

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) + "::DOUBLE" for v in values) + "]"


def at(p: str, values: str = "sl") -> str:
    """The interpolated quantile p of a sorted list."""
    place = f"(({p}) * (len({values}) - 1)::DOUBLE)"
    low, high = f"{values}[1 + floor({place})::BIGINT]", f"{values}[1 + ceil({place})::BIGINT]"
    return f"({low} + ({high} - {low}) * ({place} - floor({place})))"


def quantiles(probs, values: str = "sl") -> str:
    return f"list_transform({numbers(probs)}, lambda p: {at('p', values)})"


def between(lo: float, hi: float, n: str, values: str = "sl") -> str:
    """Quantiles at n even places strictly between lo and hi; n an SQL expression."""
    return f"list_transform(range(1, ({n}) + 1), lambda i: {at(f'{lo!r}::DOUBLE + i * (({hi!r}::DOUBLE - {lo!r}::DOUBLE) / (({n}) + 1))', values)})"


def merged(*lists: str) -> str:
    both = lists[0]
    for more in lists[1:]:
        both = f"list_concat({both}, {more})"
    return f"list_sort(list_distinct({both}))"


def step(source: str, name: str, **columns: str) -> str:
    """One more CTE: all columns of a source and new ones."""
    return f",\n{name} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {source})"


def thin(values: str, n: str) -> str:
    """n places spread evenly over a list, as whole numbers."""
    return f"CASE WHEN len({values}) <= {n} THEN {values} ELSE list_transform(range({n}), lambda i: {values}[1 + CASE WHEN i = {n} - 1 THEN len({values}) - 1 ELSE floor(i * ((len({values}) - 1) / greatest({n} - 1, 1)))::BIGINT END]) END"


LINEITEM = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x FROM lineitem" for f in FEATURES)
EVENTS = "SELECT 'value' AS feature, value::DOUBLE AS x FROM events"


def bits(ctes: str, thresholds: str, source: str, rows: str = LINEITEM, first: str = "") -> str:
    """(feature, bit, threshold, ones); at hand in ``z``: n, lo, hi, mu, sd, sk, ku, nu, dv (distinct values), sl (all, sorted)."""
    return f"""
WITH {first} long AS ({rows}),
m AS (SELECT feature, avg(x) AS mu0, stddev_pop(x) AS sd0 FROM long GROUP BY feature),
z AS (SELECT long.feature, count(*) AS n, min(x) AS lo, max(x) AS hi, any_value(mu0) AS mu, any_value(sd0) AS sd, avg(((x - mu0) / sd0) ** 3) AS sk,
  avg(((x - mu0) / sd0) ** 4) - 3 AS ku, count(DISTINCT x) AS nu, list_sort(list(DISTINCT x)) AS dv, list_sort(list(x)) AS sl FROM long JOIN m USING (feature) GROUP BY long.feature){ctes},
t0 AS (SELECT feature, unnest(list_sort({thresholds})) AS threshold, generate_subscripts({thresholds}, 1) AS bit FROM {source}),
t AS (SELECT feature, bit, threshold + 1e-10 * (row_number() OVER (PARTITION BY feature, threshold ORDER BY bit) - 1) AS threshold FROM t0)
SELECT t.feature, t.bit, round(t.threshold, 6) AS threshold, count(*) FILTER (WHERE long.x >= t.threshold) AS ones
FROM t JOIN long USING (feature) GROUP BY t.feature, t.bit, t.threshold
"""


def ladder(ctes: str, placed: str, source: str, most: int, **more) -> str:
    few = "list_transform(range(1, nu), lambda i: (dv[i] + dv[i + 1]) / 2)"
    ctes += step(source, "placed", tt=f"CASE WHEN nu <= 1 THEN [lo + 1e-10] WHEN nu <= {most} THEN {few} ELSE {placed} END")
    return bits(ctes, "tt", "placed", **more)


# --- encoders with fixed thresholds -----------------------------------------------------------------------------------

Q8 = quantiles(probabilities(8))

FUSION = bits(
    step("z", "a", q=Q8, kf="greatest(0, least(1, greatest(-2, least(30, ku)) / 15))", sk3="greatest(-3, least(3, sk))")
    + ",\nmode AS (SELECT feature, max(c) / sum(c) AS share FROM (SELECT feature, round(x, 8) AS v, count(*) AS c FROM long GROUP BY ALL) GROUP BY feature)"
    + ",\nb AS (SELECT a.*, q[8] - q[1] >= 1e-15 AND nu > 4 AND share <= 0.3 AS moves FROM a JOIN mode USING (feature))"
    + step("b", "c", q1="CASE WHEN kf > 0.05 THEN list_transform(range(8), lambda i: (1 - 0.5 * 0.3 * kf) * q[i + 1] + 0.5 * 0.3 * kf * (q[1] + (q[8] - q[1]) * (sign(2.0 * i / 7 - 1) * abs(2.0 * i / 7 - 1) ** (1 + 2 * kf * 0.3) + 1) / 2)) ELSE q END")
    + step("c", "d", q2="list_transform(q1, lambda t: t + CASE WHEN abs(sk3) > 0.3 THEN 0.05 * sk3 * sd * 0.3 ELSE 0 END)")
    + step("d", "e", q3="CASE WHEN moves THEN list_transform(range(1, 9), lambda i: q2[i] + (len(list_filter(sl, lambda v: v >= q2[i])) / n - 1 + i / 9) * sd * 0.2 * 0.3) ELSE q END"),
    "q3",
    "e",
)

DENSITY_EDGES = bits(
    step("z", "a", q=Q8, e0="lo - 0.02::DOUBLE * (hi - lo)", e1="hi + 0.02::DOUBLE * (hi - lo)")
    + ",\nh AS (SELECT feature, i, count(x) AS c FROM a CROSS JOIN range(32) AS r(i) JOIN long USING (feature) WHERE x >= i * ((e1 - e0) / 32) + e0 AND (i = 31 OR x < (i + 1) * ((e1 - e0) / 32) + e0) GROUP BY ALL)"
    + ",\nd AS (SELECT a.feature, r.i, coalesce(c, 0) / (n + 1e-10) AS d, (r.i + 0.5) * ((e1 - e0) / 32) + e0 AS mid FROM a CROSS JOIN range(32) AS r(i) LEFT JOIN h ON h.feature = a.feature AND h.i = r.i)"
    + ",\nj AS (SELECT *, coalesce(abs(lead(d) OVER w - d), abs(d - lag(d) OVER w)) AS jump FROM d WINDOW w AS (PARTITION BY feature ORDER BY i))"
    + ",\nw AS (SELECT *, sum(0.7 * (d + 1e-10) + 0.3 * (jump + 1e-10)) OVER (PARTITION BY feature ORDER BY i) / sum(0.7 * (d + 1e-10) + 0.3 * (jump + 1e-10)) OVER (PARTITION BY feature) AS w FROM j)"
    + ",\nl AS (SELECT feature, list(w ORDER BY i) AS ws, list(mid ORDER BY i) AS ms FROM w GROUP BY feature)"
    + ",\nmode AS (SELECT feature, max(c) / sum(c) AS share FROM (SELECT feature, round(x, 8) AS v, count(*) AS c FROM long GROUP BY ALL) GROUP BY feature)"
    + ",\nb AS (SELECT a.*, ws, ms, share FROM a JOIN l USING (feature) JOIN mode USING (feature))"
    + step("b", "along", g="list_transform(range(1, 9), lambda i: len(list_filter(ws, lambda v: v <= i / 9)))")
    + step("along", "f", u="list_transform(range(1, 9), lambda i: CASE WHEN g[i] = 0 THEN ms[1] ELSE ms[g[i]] + (ms[g[i] + 1] - ms[g[i]]) * (i / 9 - ws[g[i]]) / (ws[g[i] + 1] - ws[g[i]]) END)"),
    "CASE WHEN hi - lo >= 1e-15 AND nu > 4 AND share <= 0.5 THEN list_transform(range(1, 9), lambda i: 0.7 * q[i] + 0.3 * u[i]) ELSE q END",
    "f",
)

BUDGETED = bits(
    step("z", "a", spread=f"{at('0.75')} - {at('0.25')}", cap="least(greatest(1, ceil(log2(n)) + 1), greatest(1, nu - 1))::BIGINT")
    + step("a", "b", k="CASE WHEN spread <= 0 THEN cap ELSE least(greatest(1, ceil((hi - lo) / (2 * spread * n ** (-1.0 / 3)))), cap)::BIGINT END")
    + step("b", "c", q=f"list_transform(range(1, k + 1), lambda i: {at('i / (k + 1)')})")
    + ",\nu AS (SELECT feature, n, unnest(q) AS t, sl FROM c)"
    + ",\no AS (SELECT feature, n, t, len(list_filter(sl, lambda v: v >= t)) AS c FROM u)"
    + ",\np AS (SELECT feature, c, min(t) AS t FROM o WHERE c > 0 AND c < n GROUP BY feature, c)"
    + ",\ng AS (SELECT feature, list(t ORDER BY t) AS tt FROM p GROUP BY feature)",
    "tt",
    "g",
)

PACKED = f"""WITH s AS (SELECT quantile_cont(o_totalprice, [{", ".join(repr(p) for p in probabilities(12))}]) AS q FROM orders),
b AS (SELECT o_orderkey, list_transform(range(1, 17), lambda i: CASE WHEN i <= 12 AND o_totalprice >= q[i] THEN 1 ELSE 0 END) AS b FROM orders, s)
SELECT o_orderkey, upper(printf('%04x', list_sum(list_transform(range(1, 17), lambda i: b[i] * (1 << (16 - i)::INTEGER)))::INTEGER)) AS packed FROM b"""


# --- ladders ----------------------------------------------------------------------------------------------------------


def _dense(bins: int, n_dense: int) -> str:
    """CTEs up to ``dn``: z with ``cc``, the centres of the densest quantile bins."""
    return (
        step("z", "d0", b=f"least({bins}, nu)")
        + step("d0", "d1", e=f"list_transform(range(b + 1), lambda i: {at('CASE WHEN i = b THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / b) END')})")
        + ",\nd2 AS (SELECT feature, i, greatest(e[i + 1] - e[i], 1e-15) AS w, (e[i] + e[i + 1]) / 2 AS c FROM (SELECT feature, e, unnest(range(1, b + 1)) AS i FROM d1))"
        + f",\nd3 AS (SELECT feature, list(c ORDER BY c) AS centres FROM (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY 1 / w DESC, i DESC) <= {3 * n_dense}) GROUP BY feature)"
        + f",\ndn AS (SELECT z.*, {thin('centres', str(n_dense))} AS cc FROM z JOIN d3 USING (feature))"
    )


DENSE_BINS = ladder(_dense(256, 7) + step("dn", "d4", all_=merged("cc", between(0.02, 0.98, "3"))), thin("all_", "10"), "d4", 10)

WIDTH = ladder(
    step("z", "a", share="least(1.0, sd / abs(mu) / 2)")
    + step("a", "b", k="greatest(4, least(12, 4 + floor((0.5 * least(1.0, log2(nu) / 10) + 0.5 * share) * 8)))::BIGINT")
    + step("b", "c", dense="greatest(1, floor(k * 0.6::DOUBLE))::BIGINT", p2=at("0.02::DOUBLE"), p98=at("0.98::DOUBLE"))
    + step("c", "d", all_=merged(between(0.02, 0.98, "dense"), "list_transform(range(1, k - dense + 1), lambda i: p2 + i * ((p98 - p2) / (k - dense + 1)))")),
    thin("all_", "k"),
    "d",
    12,
)

CORE_AND_EDGES = ladder(
    step("z", "a", p15=at("0.15::DOUBLE"), p85=at("0.85::DOUBLE"))
    + step("a", "b", core="list_filter(sl, lambda v: v >= p15 AND v <= p85)")
    + step("b", "c", inner_=f"CASE WHEN len(core) > 10 THEN {between(0.05, 0.95, '6', 'core')} ELSE {between(0.05, 0.95, '6')} END")
    + step("c", "d", t1=merged("inner_", quantiles([0.01, 0.15, 0.85, 0.99])))
    + step("d", "e", t2=f"CASE WHEN len(t1) < 10 THEN {merged('t1', between(0.05, 0.95, '10 - len(t1)'))} ELSE t1 END"),
    thin("t2", "10"),
    "e",
    10,
)

WIDEST_GAPS = ladder(
    step("z", "a", v=f"CASE WHEN nu <= 1000 THEN dv ELSE {thin('dv', '1000')} END")
    + step("a", "b", gaps="list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i])")
    + step("b", "c", usual="list_median(gaps)")
    + step("c", "d", k="greatest(4, least(12, 4 + floor((0.5 * least(1.0, log2(nu) / 10) + 0.5 * least(1.0, CASE WHEN usual > 0 THEN len(list_filter(gaps, lambda g: g > 3 * usual)) / 10 ELSE 0 END)) * 8)))::BIGINT")
    + step("d", "e", ng="greatest(1, k // 2)")
    + ",\nw AS (SELECT feature, (v[i] + v[i + 1]) / 2 AS mid FROM (SELECT feature, v, gaps, ng, unnest(range(1, len(v))) AS i FROM e) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gaps[i] DESC, i DESC) <= 2 * ng)"
    + ",\nf AS (SELECT e.*, mids FROM e JOIN (SELECT feature, list_sort(list(DISTINCT mid)) AS mids FROM w GROUP BY feature) USING (feature))"
    + step("f", "g", chosen=thin("mids", "ng"))
    + step("g", "h", t1=merged("chosen", between(0.02, 0.98, "k - ng")))
    + step("h", "i", t2=thin("t1", "k")),
    "t2",
    "i",
    12,
)

AROUND_MODE = ladder(
    ",\nmode AS (SELECT feature, max(c) / sum(c) AS share FROM (SELECT feature, x, count(*) AS c FROM long GROUP BY ALL) GROUP BY feature)"
    + step("z JOIN mode USING (feature)", "a", q=f"list_sort(list_distinct({quantiles(probabilities(10))}))")
    + step("a", "b", fine=merged("q", quantiles(np.linspace(0.01, 0.99, 30)))),
    f"CASE WHEN share > 0.5 THEN NULL WHEN len(q) = 10 THEN q ELSE {thin('fine', '10')} END",
    "b",
    10,
)

SPARSE_AWARE = bits(
    step("z", "a", e0=f"list_sort(list_distinct({quantiles(probabilities(15))}))", gaps="list_transform(range(1, len(dv)), lambda i: dv[i + 1] - dv[i])", mids="list_transform(range(1, len(dv)), lambda i: (dv[i] + dv[i + 1]) / 2)", zero="len(list_filter(sl, lambda v: v = 0)) / n")
    + step("a", "b", snaps="list_max(gaps) > 5 * list_median(gaps)")
    + step("b", "c", near="list_transform(e0, lambda t: [list_max(list_filter(mids, lambda m: m < t)), list_min(list_filter(mids, lambda m: m >= t))])")
    + step("c", "d", e1="CASE WHEN snaps THEN list_sort(list_distinct(list_transform(range(1, len(e0) + 1), lambda i: CASE WHEN near[i][2] IS NULL OR (near[i][1] IS NOT NULL AND e0[i] - near[i][1] < near[i][2] - e0[i]) THEN near[i][1] ELSE near[i][2] END))) ELSE e0 END")
    + step("d", "e", ends="list_concat(list_concat([lo], e1), [hi])")
    + step("e", "f", options="list_transform(range(2, len(ends)), lambda i: [ends[i] - (ends[i] - ends[i - 1]) * 0.25, ends[i], ends[i] + (ends[i + 1] - ends[i]) * 0.25])")
    + step("f", "g", shares="list_transform(options, lambda o: list_transform(o, lambda c: len(list_filter(sl, lambda v: v >= c)) / n))")
    + step("g", "h", best="list_transform(range(1, len(options) + 1), lambda i: options[i][CASE WHEN shares[i][1] * (1 - shares[i][1]) >= greatest(shares[i][2] * (1 - shares[i][2]), shares[i][3] * (1 - shares[i][3])) THEN 1 WHEN shares[i][2] * (1 - shares[i][2]) >= shares[i][3] * (1 - shares[i][3]) THEN 2 ELSE 3 END])")
    + step("h", "i", tt="list_transform(CASE WHEN nu <= 15 THEN dv[2:] WHEN zero > 0.3 THEN NULL ELSE list_sort(list_distinct(best))[1:15] END, lambda v: v::FLOAT::DOUBLE)"),
    "tt",
    "i",
).replace("round(t.threshold, 6)", "round_even(t.threshold, 6)")  # single precision ends in halves

VALLEYS = bits(
    step("z", "a", bins="least(200, n // 5 + 1)")
    + ",\nh AS (SELECT feature, i, count(x) AS c FROM a CROSS JOIN LATERAL (SELECT unnest(range(bins)) AS i) JOIN long USING (feature) WHERE x >= i * ((hi - lo) / bins) + lo AND (x < (i + 1) * ((hi - lo) / bins) + lo OR i = bins - 1) GROUP BY ALL)"
    + ",\nd AS (SELECT g.feature, g.i, g.bins, (g.i + 0.5) * ((g.hi - g.lo) / g.bins) + g.lo AS mid, coalesce(c, 0) AS c FROM (SELECT feature, bins, lo, hi, unnest(range(bins)) AS i FROM a) g LEFT JOIN h ON h.feature = g.feature AND h.i = g.i)"
    + ",\ns AS (SELECT *, sum(c) OVER (PARTITION BY feature ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS sm FROM d)"
    + ",\nl AS (SELECT *, lag(sm) OVER w AS a, lead(sm) OVER w AS b FROM s WINDOW w AS (PARTITION BY feature ORDER BY i))"
    + ",\nv AS (SELECT feature, list(mid) AS found FROM (SELECT * FROM l WHERE sm < a AND sm < b QUALIFY row_number() OVER (PARTITION BY feature ORDER BY sm, i) <= 8) GROUP BY feature)"
    + ",\ng AS (SELECT z.*, coalesce(found, []::DOUBLE[]) AS found FROM z LEFT JOIN v USING (feature))"
    + step("g", "k", tt=f"list_concat(found, list_transform(range(1, 9 - len(found)), lambda i: {at('i / (9 - len(found))')}))"),
    "tt",
    "k",
)


# --- encoders that depend on order -------------------------------------------------------------------------------------

_PLACED = "rows_ AS (SELECT value::DOUBLE AS x, row_number() OVER (ORDER BY event_id) - 1 AS pl, count(*) OVER () AS total FROM events),"
_PROBS = np.linspace(0.02, 0.98, 20)

SLIDING = ladder(
    f""",
sizes AS (SELECT greatest(20, floor(any_value(total) * 0.25)::BIGINT) AS size, any_value(total) AS total FROM rows_),
steps AS (SELECT *, greatest(1, size // 4) AS step FROM sizes),
wins AS (SELECT unnest(range(greatest(1, (total - size) // step + 1))) AS w, size, step FROM steps),
parts AS (SELECT w, avg(x) AS m, quantile_cont(x, {numbers(_PROBS)}) AS q FROM wins JOIN rows_ ON pl >= w * step AND pl < w * step + size GROUP BY w),
cols AS (SELECT i, list_sort(list(q[i])) AS c FROM parts CROSS JOIN range(1, 21) AS r(i) GROUP BY i),
picks AS (SELECT list({at('0.5', 'c')}) AS mid, list({at('0.1::DOUBLE', 'c')}) AS low, list({at('0.9::DOUBLE', 'c')}) AS high FROM cols),
drift AS (SELECT stddev_pop(m) AS s FROM parts)"""
    + step("z, picks, drift", "a", t1=f"CASE WHEN s / (sd + 1e-15) > 0.3 THEN {merged('mid', 'low', 'high')} ELSE list_sort(list_distinct(mid)) END"),
    thin("t1", "10"),
    "a",
    10,
    rows=EVENTS,
    first=_PLACED,
)


def _segments(n: int) -> str:
    """CTEs: ``segs`` with each segment's mean and sorted values, ``drift`` with the spread of the means."""
    return f""",
seg_of AS (SELECT x, pl // greatest(10, total // {n}) AS part FROM rows_),
segs AS (SELECT part, avg(x) AS m, list_sort(list(x)) AS sv FROM seg_of GROUP BY part HAVING count(*) >= 5),
drift AS (SELECT stddev_pop(m) AS s, list_sort(list(m)) AS means, count(*) AS parts FROM segs)"""


SEGMENTS = ladder(
    _segments(4)
    + step("z, drift", "a", dr="s / (sd + 1e-15)")
    + step("a", "b", k="greatest(4, least(12, 4 + floor((0.4 * least(1.0, log2(nu) / 10) + 0.6 * least(1.0, 2 * dr)) * 8)))::BIGINT")
    + step("b", "c", per="greatest(2, k // parts)")
    + f",\nown AS (SELECT list({at('p', 'sv')}) AS sq FROM (SELECT sv, 0.05::DOUBLE + i * (0.9 / (per + 1)) AS p FROM c CROSS JOIN LATERAL (SELECT unnest(range(1, per + 1)) AS i) CROSS JOIN segs))"
    + step("c, own", "d", t1=f"CASE WHEN dr > 0.2 THEN {merged('sq', 'list_transform(range(1, len(means)), lambda i: (means[i] + means[i + 1]) / 2)')} ELSE list_sort(list_distinct({between(0.02, 0.98, 'k')})) END")
    + step("d", "e", t2=thin("t1", "k")),
    "t2",
    "e",
    12,
    rows=EVENTS,
    first=_PLACED,
)

SEGMENTS_OR_DENSITY = ladder(
    _segments(4)
    + _dense(128, 5)
    + step("dn, drift", "a", dr="s / (sd + 1e-15)")
    + f",\nown AS (SELECT list({at('p', 'sv')}) AS sq FROM (SELECT sv, 0.05::DOUBLE + i * (0.9 / 3) AS p FROM segs CROSS JOIN range(1, 3) AS r(i)))"
    + step("a, own", "b", t1=f"CASE WHEN dr > 0.15 THEN {merged('sq', 'list_transform(range(1, len(means)), lambda i: (means[i] + means[i + 1]) / 2)')} ELSE {merged('cc', between(0.02, 0.98, '5'))} END"),
    thin("t1", "10"),
    "b",
    10,
    rows=EVENTS,
    first=_PLACED,
)


# --- exponential online encoders: a recursive step a row of each stream ------------------------------------------------

_ROWS = "rows_ AS (SELECT event_type, event_id, value::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events)"


def rate(a: float) -> str:
    """An averaging rate at place t, corrected for the empty start."""
    return f"CASE WHEN t < 200 THEN least({a!r}::DOUBLE / greatest(1 - (1 - {a!r}::DOUBLE) ** t, 1e-12), 1) ELSE {a!r}::DOUBLE END"


def recursion(start: dict[str, str], *moves: dict[str, str], bits: str, last: bool = True, more: str = "") -> str:
    """Replays the streams: ``start`` gives the state of the first row, each of ``moves`` new columns from those before (o_ of
    the last row), ``bits`` the string."""
    names = list(start)
    inner = "SELECT n.event_type, n.event_id, n.x, n.t, " + ", ".join(f"r.{c} AS o_{c}" for c in names) + " FROM r JOIN rows_ n ON n.event_type = r.event_type AND n.t = r.t + 1"
    for move in moves:
        inner = "SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in move.items()) + f" FROM ({inner})"
    return f"""WITH RECURSIVE {more}{_ROWS},
r AS (SELECT event_type, event_id, x, t, {", ".join(f"{e} AS {c}" for c, e in start.items())} FROM rows_ WHERE t = 1
UNION ALL SELECT event_type, event_id, x, t, {", ".join(names)} FROM ({inner}))
SELECT event_type, event_id, {bits} AS bits FROM r"""


def joined(conditions: list[str]) -> str:
    return " || ".join(f"CASE WHEN {c} THEN '1' ELSE '0' END" for c in conditions)


def _band(levels, mean: str, unit: str) -> list[str]:
    return [f"x >= {mean} + {float(z)!r}::DOUBLE * {unit}" for z in levels]


_M, _V = "(SELECT avg(value) FROM events)", "(SELECT var_pop(value) FROM events)"
_unit = "sqrt(greatest(v, 1e-6))"
GAUSSIAN = recursion(
    {"mu": f"{_M} + 0.1::DOUBLE * (x - {_M})", "v": f"(1 - 0.1::DOUBLE) * ({_V} + 0.1::DOUBLE * (x - {_M}) * (x - {_M}))"},
    {"mu": "o_mu + 0.1::DOUBLE * (x - o_mu)", "v": "(1 - 0.1::DOUBLE) * (o_v + 0.1::DOUBLE * (x - o_mu) * (x - o_mu))"},
    bits=joined(_band(np.linspace(-2, 2, 8), "mu", _unit)),
)

_Z = np.linspace(-2.5, 2.5, 10)[1:-1]


def _latched(z: float, bit: str, mean: str, unit: str, share: float) -> str:
    t = f"({mean} + {float(z)!r}::DOUBLE * {unit})"
    return f"CASE WHEN {bit} = 0 THEN (x >= {t} + {share!r}::DOUBLE * {unit})::INTEGER ELSE (x > {t} - {share!r}::DOUBLE * {unit})::INTEGER END"


MOVING = recursion(
    {"mu": "x", "v": "0.0::DOUBLE", **{f"b{i}": _latched(z, "0", "x", "sqrt(1e-20)", 0.1) for i, z in enumerate(_Z)}},
    {"a": rate(0.02)},
    {"mu": "o_mu + a * (x - o_mu)", "v": "(1 - a) * (o_v + a * (x - o_mu) * (x - o_mu))"},
    {"u": "sqrt(greatest(v, 1e-20))"},
    {f"b{i}": _latched(z, f"o_b{i}", "mu", "u", 0.1) for i, z in enumerate(_Z)},
    bits=" || ".join(f"b{i}::VARCHAR" for i in range(8)),
)

RANGE = recursion(
    {"mu": "x", "w": "0.0::DOUBLE", "p": "x"},
    {"a": rate(0.01), "b": rate(0.05)},
    {"mu": "o_mu + a * (x - o_mu)", "w": "(1 - b) * o_w + b * abs(x - o_p)", "p": "x"},
    bits=joined(_band(np.linspace(-2, 2, 10)[1:-1], "mu", "greatest(w, 1e-12)")),
)

_zeros = {c: "0.0::DOUBLE" for c in ("unit", "gain", "loss", "now", "usual")}
OSCILLATOR = recursion(
    {"mu": "x", "near": "x", "far": "x", "p": "x", **_zeros, "d": "NULL::DOUBLE", "crossed": "false"},
    {"s": rate(0.1), "g": rate(0.02), "k": rate(0.07)},
    {"d": "x - o_p", "mu": "o_mu + g * (x - o_mu)", "near": "o_near + s * (x - o_near)", "far": "o_far + g * (x - o_far)", "p": "x"},
    {"unit": "o_unit + s * (abs(d) - o_unit)", "gain": "o_gain + k * (greatest(d, 0) - o_gain)", "loss": "o_loss + k * (greatest(-d, 0) - o_loss)", "now": "o_now + s * (d * d - o_now)", "usual": "o_usual + g * (d * d - o_usual)", "crossed": "(o_p > mu) <> (x > mu)"},
    bits="CASE WHEN d IS NULL THEN '00000000' ELSE "
    + joined(["d > 0", "crossed", "1 - 1 / (1 + gain / (loss + 1e-12)) > 0.5", "1 - 1 / (1 + gain / (loss + 1e-12)) > 0.7::DOUBLE", "near - far > 0", "abs(near - far) > unit", "now > usual", "x > mu"])
    + " END",
)

STEP_SIZE = recursion(
    {"p": "x", "d": "NULL::DOUBLE", "od": "NULL::DOUBLE", "unit": "0.0::DOUBLE", "speed": "0.0::DOUBLE", "top": "x"},
    {"a": rate(0.05), "m": rate(0.1)},
    {"d": "x - o_p", "od": "o_d", "p": "x"},
    {"unit": "o_unit + a * (abs(d) - o_unit)", "speed": "o_speed + m * (d - o_speed)", "top": "greatest(o_top * 0.999::DOUBLE, x)"},
    bits="CASE WHEN d IS NULL THEN '00000000' ELSE "
    + joined(["d > 0", *(f"abs(d) > {f} * greatest(unit, 1e-12)" for f in ("0.5::DOUBLE", "1", "2")), "speed > 0", "abs(speed) > greatest(unit, 1e-12) / 2", "x >= top - greatest(unit, 1e-12)", "coalesce(d > od, false)"])
    + " END",
)

_SLOW = 0.25 / 3
MOMENTUM = recursion(
    {"near": "x", "far": "x", "unit": "1e-8::DOUBLE", "p": "x", "b": "0"},
    {"near": "o_near + 0.25::DOUBLE * (x - o_near)", "far": f"o_far + {_SLOW!r}::DOUBLE * (x - o_far)", "unit": f"o_unit + {_SLOW!r}::DOUBLE * (abs(x - o_p) - o_unit)", "p": "x"},
    {"v": "(near - far) / (unit + 1e-8::DOUBLE)"},
    {"b": "CASE WHEN v > 1.5 THEN 1 WHEN v < -0.75 THEN 0 ELSE o_b END"},
    bits="b::VARCHAR",
)

MOMENTUM_SERIES = f"""WITH RECURSIVE s AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, len(embedding) AS m FROM embeddings),
r AS (SELECT vec_id, e, m, 1 AS i, e[1] AS near, e[1] AS far, 0.0::DOUBLE AS unit, 0 AS b, '0' AS bits, 1 AS events FROM s
UNION ALL SELECT vec_id, e, m, i, near, far, unit, b, bits || b, events + (b <> ob)::INTEGER FROM (
  SELECT *, CASE WHEN v > 1.5 THEN 1 WHEN v < -0.75 THEN 0 ELSE ob END AS b FROM (
    SELECT *, (near - far) / (unit + 1e-8::DOUBLE) AS v FROM (
      SELECT vec_id, e, m, i + 1 AS i, near + 0.25::DOUBLE * (e[i + 1] - near) AS near, far + {_SLOW!r}::DOUBLE * (e[i + 1] - far) AS far,
        unit + {_SLOW!r}::DOUBLE * (abs(e[i + 1] - e[i]) - unit) AS unit, b AS ob, bits, events FROM r WHERE i < m))))
SELECT vec_id, bits, events::BIGINT AS n_events, (m - len(replace(bits, '0', ''))) / m AS sparsity, m / greatest(events, 1) AS compression FROM r WHERE i = m"""


def sampled(refit: str) -> str:
    """Bits against quantiles found anew every 100 values of each stream, over the values that ``refit`` names (of a, at r)."""
    p = numbers(probabilities(8))
    return f"""WITH {_ROWS},
fits AS (SELECT a.event_type, a.t AS r, quantile_cont(b.x, {p}) AS q FROM rows_ a JOIN rows_ b ON a.event_type = b.event_type AND b.t <= a.t{refit} WHERE a.t % 100 = 0 GROUP BY ALL)
SELECT n.event_type, event_id, array_to_string(list_transform(range(1, 9), lambda i: CASE WHEN q IS NOT NULL AND n.x >= q[i] THEN '1' ELSE '0' END), '') AS bits
FROM rows_ n LEFT JOIN fits f ON f.event_type = n.event_type AND f.r = (n.t - 1) // 100 * 100"""


#: While a stream has no more values than the sample holds (4096).
RESERVOIR = sampled("")
WINDOW = sampled(" AND b.t > a.t - 1000")


# --- series -------------------------------------------------------------------------------------------------------------


def frequency(window: int = 16, bands: int = 4) -> str:
    """CTEs ``fr``: event_id and ``bands`` (null without a whole window)."""
    turn = 2 * math.pi * np.arange(window) / window
    size = window // 2 // bands
    dot = lambda w: f"list_inner_product(w, {numbers(w)})"
    power = lambda f: f"{dot(np.cos(f * turn))} ** 2 + {dot(np.sin(f * turn))} ** 2"
    made = ", ".join("CASE WHEN len(w) = " + str(window) + " THEN round(" + " + ".join(power(f + 1) for f in range(b * size, (b + 1) * size)) + f", 9) END AS e{b}" for b in range(bands))
    qs = ", ".join(f"quantile_cont(e{b}, 0.5) OVER (PARTITION BY event_type) AS q{b}" for b in range(bands))
    return f"""f0 AS (SELECT event_id, event_type, list(value::DOUBLE) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS w FROM events),
f1 AS (SELECT event_id, event_type, {made} FROM f0),
f2 AS (SELECT *, {qs} FROM f1),
fr AS (SELECT event_id, {joined([f"e{b} > q{b}" for b in range(bands)])} AS bands FROM f2 WHERE e0 IS NOT NULL)"""


FREQUENCY = f"WITH {frequency()} SELECT event_id, bands FROM fr"


def chronological(phase: str, logic: str, gate: str) -> str:
    return f"""WITH ph AS ({phase}), lo AS ({logic}), ga AS (SELECT event_id, bits::INTEGER AS gate FROM ({gate})), {frequency(8)}
SELECT event_id, CASE WHEN gate = 1 THEN phase || bands || logic ELSE translate(phase || bands || logic, '1', '0') END AS bits FROM ph JOIN lo USING (event_id) JOIN ga USING (event_id) JOIN fr USING (event_id)"""


def entropies(counts: str, entropy: str) -> str:
    """CTEs up to ``h``: the entropy of each row's last 8 values over even bins of its stream's range."""
    return f"""l AS (SELECT event_id, event_type, value, min(value) OVER (PARTITION BY event_type) - 1e-8 AS lo, max(value) OVER (PARTITION BY event_type) + 1e-8 AS hi FROM events),
b AS (SELECT *, {" + ".join(f"(value >= lo + (hi - lo) / 8 * {i})::INTEGER" for i in range(1, 8))} AS b FROM l),
p AS (SELECT *, {counts}, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
h AS (SELECT event_id, event_type, CASE WHEN n = 8 THEN round(-({entropy}), 9) END AS h FROM p)"""


def moving_gate(counts: str, entropy: str, start: str = "2.0::DOUBLE") -> str:
    """``start``: the first threshold; ``mean`` is the stream's mean entropy."""
    return f"""WITH RECURSIVE {entropies(counts, entropy)},
rows_ AS (SELECT event_type, event_id, h AS x, avg(h) OVER (PARTITION BY event_type) AS mean, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM h WHERE h IS NOT NULL),
r AS (SELECT event_type, event_id, t, (x > {start})::INTEGER AS gate, 0.9::DOUBLE * {start} + (1 - 0.9::DOUBLE) * x AS tau FROM rows_ WHERE t = 1
UNION ALL SELECT n.event_type, n.event_id, n.t, (n.x > r.tau)::INTEGER, 0.9::DOUBLE * r.tau + (1 - 0.9::DOUBLE) * n.x FROM r JOIN rows_ n ON n.event_type = r.event_type AND n.t = r.t + 1)
SELECT event_type, event_id, gate::VARCHAR AS bits FROM r"""
