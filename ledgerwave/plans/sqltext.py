"""Reference SQL fragments (DuckDB dialect) that the registered checks share."""

from __future__ import annotations


def _list(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _period(expr: str, freq: str) -> str:
    d = f"CAST({expr} AS DATE)"
    return {
        "D": d,
        "W-MON": f"CAST(date_trunc('week', {d}) AS DATE)",
        "W-SUN": f"CAST({d} - CAST(dayofweek({d}) AS INTEGER) AS DATE)",
        "MS": f"CAST(date_trunc('month', {d}) AS DATE)",
        "QS": f"CAST(date_trunc('quarter', {d}) AS DATE)",
        "YS": f"CAST(date_trunc('year', {d}) AS DATE)",
    }[freq]


STEP = {"D": "1 DAY", "W-MON": "7 DAY", "W-SUN": "7 DAY", "MS": "1 MONTH", "QS": "3 MONTH", "YS": "1 YEAR"}


def series(table: str, date: str, value: str, keys=(), freq: str = "D", name: str = "s") -> str:
    """CTE `name(keys…, ds, y)`: one row per period that has rows."""
    return (
        f"{name} AS (SELECT {_list(keys)}{_period(date, freq)} AS ds, CAST({value} AS DOUBLE) AS y "
        f"FROM {table} GROUP BY ALL)"
    )


def filled(keys=(), freq: str = "D", src: str = "s", name: str = "f") -> str:
    """CTEs up to `name(keys…, ds, y, is_gap)`: calendar filled, ≤3 carried on."""
    using = f"USING ({', '.join([*keys, 'ds'])})"
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
b AS (SELECT {_list(keys)}min(ds) AS lo, max(ds) AS hi FROM {src} {group}),
g AS (SELECT {_list(keys)}CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {STEP[freq]})) AS DATE) AS ds FROM b),
r AS (SELECT {_list(keys)}ds, {src}.y AS y0 FROM g LEFT JOIN {src} {using}),
{name} AS (SELECT {_list(keys)}ds,
  coalesce(y0, last_value(y0 IGNORE NULLS) OVER ({part}ORDER BY ds ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS y,
  y0 IS NULL AS is_gap FROM r)"""


def prepared(table, date, value, keys=(), freq="D") -> str:
    return f"{series(table, date, value, keys, freq)},{filled(keys, freq)}"


def fixed(x: str, digits: int) -> str:
    return f"CAST(CAST(round({x}, {digits}) AS DECIMAL(38,{digits})) AS VARCHAR)"


def label(score: str, direction: str) -> str:
    return (
        f"{fixed(f'abs({score})', 1)} || 'σ ' || CASE WHEN {direction} > 0 THEN 'above' ELSE 'below' END || ' expected'"
    )


def values(rows: list[tuple], columns: list[str], name: str) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES\n{body})"


def forest(keys, src: str) -> str:
    """CTEs up to `found(keys…, ds, y, score, side)`: rows whose isolation forest score is above the 95th percentile.
    100 trees over 256 rows each, drawn and split by MD5."""
    k, part = _list(keys), f"PARTITION BY {', '.join(keys)}" if keys else ""
    tree = f"{k}tree"

    def hashed(*parts):
        return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"

    below = ("CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::DOUBLE "
             "WHEN {n} = 2 THEN 1.0 ELSE 0.0 END")
    levels = "".join(f""",
v{d} AS (SELECT *, CASE WHEN low + share * (high - low) >= high THEN low ELSE low + share * (high - low) END AS cut,
  low < high AND least(total, 256) > {2 ** d} AS split FROM (
  SELECT *, min(y) OVER n AS low, max(y) OVER n AS high, x2 * (x2 % 65536 + 3) % 2147483647 / 2147483647.0::DOUBLE AS share
  FROM (SELECT *, x1 * (x1 % 65536 + 1) % 2147483647 * 69621 % 2147483647 AS x2 FROM (
    SELECT *, (CAST(tree * 512 + node AS BIGINT) + 1) * 48271 % 2147483647 AS x1 FROM t{d}))
  WINDOW n AS (PARTITION BY {tree}, node))),
t{d + 1} AS MATERIALIZED (SELECT {tree}, total, y, CASE WHEN NOT split THEN node WHEN y <= cut THEN 2 * node ELSE 2 * node + 1 END AS node,
  CASE WHEN split THEN depth + 1 ELSE depth END AS depth, CASE WHEN split AND y <= cut THEN cut ELSE upper END AS upper FROM v{d})"""
                     for d in range(8))
    same = " AND ".join([f"rw.{c} = st.{c}" for c in keys] + ["rw.y > st.edge"])
    return f"""
c0 AS (SELECT {k}ds, y, row_number() OVER (PARTITION BY {k}ds, y) - 1 AS copy, count(*) OVER ({part}) AS total
  FROM {src} WHERE y IS NOT NULL),
c1 AS (SELECT *, (y - floor(y)) * 4503599627370496.0::DOUBLE AS fine FROM c0),
c2 AS (SELECT *, {hashed('ds', 'CAST(floor(y) AS BIGINT)', 'CAST(floor(fine) AS BIGINT)',
                         'CAST(floor((fine - floor(fine)) * 4503599627370496.0::DOUBLE) AS BIGINT)', 'copy')} AS h FROM c1),
c3 AS (SELECT *, CAST(ceil(least(100.0::DOUBLE, 25600.0::DOUBLE / total) - (h // 100) / 45035996273704.0::DOUBLE) AS BIGINT) AS arc FROM c2),
t0 AS MATERIALIZED (SELECT {k}total, y, (unnest(range(0, arc)) - h % 100 + 100) % 100 AS tree, 1 AS node, 0 AS depth,
  NULL::DOUBLE AS upper FROM c3 WHERE arc > 0){levels},
l0 AS (SELECT {tree}, node, depth * 1048576 + CAST(round(({below.format(n='count(*)')}) * 1048576) AS BIGINT) AS path, upper
  FROM t8 GROUP BY {tree}, node, depth, upper),
l1 AS (SELECT *, lead(path) OVER w - path AS change, row_number() OVER w AS place FROM l0
  WINDOW w AS (PARTITION BY {tree} ORDER BY upper NULLS LAST)),
lo AS (SELECT {k}sum(path) AS base, count(*) AS trees FROM l1 WHERE place = 1 GROUP BY ALL),
ed AS (SELECT {k}upper AS edge, sum(change) AS change FROM l1 WHERE upper IS NOT NULL GROUP BY ALL),
st AS (SELECT {k}edge, sum(change) OVER ({part} ORDER BY edge) AS change FROM ed),
rw AS (SELECT c0.* EXCLUDE (copy), base, trees, avg(y) OVER ({part}) AS mean FROM c0 {f"JOIN lo USING ({', '.join(keys)})" if keys else ", lo"}),
pa AS (SELECT rw.*, base + coalesce(change, 0) AS path FROM rw ASOF LEFT JOIN st ON {same}),
s0 AS (SELECT *, {below.format(n='least(total, 256)')} AS usual FROM pa),
s1 AS (SELECT *, pow(2.0, -(path / 1048576.0::DOUBLE / trees) / CASE WHEN usual = 0 THEN 1.0 ELSE usual END) AS score FROM s0),
found AS (SELECT {k}ds, y, score, CASE WHEN y > mean THEN 1 ELSE -1 END AS side FROM s1
  QUALIFY score > quantile_cont(score, 0.95) OVER ({part}))"""


def holt_winters(keys, src: str, period: int, horizon: int) -> str:
    """CTEs up to `ahead(keys…, step, last_ds, yhat, sd)`: a recursion over time for every parameter set of every
    series, round by round.  Wants WITH RECURSIVE."""
    k, using = _list(keys), f"USING ({', '.join(keys)})"
    coarse, finer = "[0.05, 0.2, 0.4, 0.6, 0.9]::DOUBLE[]", (0.1, 0.05, 0.02)

    def around(name, width):
        return (f"unnest(list_transform([-1.0, 0.0, 1.0]::DOUBLE[], lambda x : "
                f"least(greatest({name} + x * {width}::DOUBLE, 0.01::DOUBLE), 0.99::DOUBLE)))")

    def tried(r):
        return f"""u{r}(sa, sb, sg, {k}i, l, b, ring, s1, s2) AS (
SELECT g{r}.a, g{r}.b, g{r}.g, {_list(keys, 'm1.')}CAST(0 AS BIGINT), l, m1.b, ring, 0.0::DOUBLE, 0.0::DOUBLE FROM g{r} JOIN m1 {using}
UNION ALL SELECT sa, sb, sg, {_list(keys, 'x.')}i + 1, l + b + sa * e, b + sa * sb * e, list_append(ring[2:], ring[1] + sg * e), s1 + e, s2 + e * e
FROM (SELECT u{r}.*, y[i + 1] - l - b - ring[1] AS e FROM u{r} JOIN q1 {using} WHERE i < n) x),
w{r} AS MATERIALIZED (SELECT u{r}.* FROM u{r} JOIN q1 {using} WHERE i = n
  QUALIFY row_number() OVER (PARTITION BY {_list(keys)[:-2]} ORDER BY s2, sa, sb, sg) = 1)"""

    rounds = [f"""g0 AS (SELECT {k}a, b, CASE WHEN m > 1 THEN g ELSE 0.0 END AS g FROM q1,
  (SELECT unnest({coarse}) AS a), (SELECT unnest({coarse}) AS b), (SELECT unnest({coarse}) AS g) WHERE m > 1 OR g = 0.05),
{tried(0)}"""]
    for r, width in enumerate(finer):
        rounds.append(f"""ga{r + 1} AS (SELECT {k}sb, sg, {around('sa', width)} AS a FROM w{r}),
gb{r + 1} AS (SELECT {k}a, sg, {around('sb', width)} AS b FROM ga{r + 1}),
gc{r + 1} AS (SELECT {k}a, b, {around('sg', width)} AS g FROM gb{r + 1}),
g{r + 1} AS (SELECT DISTINCT {k}a, b, CASE WHEN m > 1 THEN g ELSE 0.0 END AS g FROM gc{r + 1} JOIN q1 {using}),
{tried(r + 1)}""")
    body = ",\n".join(rounds)
    last = len(finer)
    return f"""q0 AS (SELECT {k}list(y ORDER BY ds) AS y, max(ds) AS last_ds, count(*) AS n FROM {src} WHERE y IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 4),
q1 AS MATERIALIZED (SELECT *, CASE WHEN {period} > 1 AND n >= 2 * {period} THEN {period} ELSE 1 END AS m FROM q0),
q2 AS (SELECT *, least(n // m, 5) AS cycles, least(n, 10) AS k FROM q1),
q3 AS (SELECT *, (list_sum(y[m + 1:2 * m]) - list_sum(y[1:m])) / (m * m) AS slope, list_sum(y[1:cycles * m]) / (cycles * m) AS mean,
  (cycles * m - 1) / 2 AS mid, (k + 1) / 2 AS centre, list_sum(y[1:k]) / k AS height FROM q2),
q4 AS (SELECT *, list_transform(range(0, m), lambda j : list_sum(list_transform(range(0, cycles),
    lambda c : y[c * m + j + 1] - (mean + slope * (c * m + j - mid)))) / cycles) AS raw,
  list_sum(list_transform(range(1, k + 1), lambda i : (i - centre) * (y[i] - height))) /
  list_sum(list_transform(range(1, k + 1), lambda i : (i - centre) * (i - centre))) AS tilt FROM q3),
m1 AS MATERIALIZED (SELECT {k}CASE WHEN m > 1 THEN mean - slope * mid - slope ELSE height - tilt * centre END AS l,
  CASE WHEN m > 1 THEN slope ELSE tilt END AS b,
  CASE WHEN m > 1 THEN list_transform(raw, lambda v : v - list_sum(raw) / m) ELSE [0.0::DOUBLE] END AS ring FROM q4),
{body},
ahead AS (SELECT {_list(keys, 'q1.')}CAST(step AS INTEGER) AS step, last_ds, l + b * step + ring[(step - 1) % m + 1] AS yhat,
  sqrt(greatest((s2 - s1 * s1 / n) / (n - 1), 0)) AS sd FROM w{last} JOIN q1 {using}, range(1, {horizon + 1}) t(step))"""


def _loess(y: str, rho: str, q: str, places: str) -> str:
    """Local lines of the list y (weights rho) at 0-based places; null where no neighbour has a weight."""
    n = f"len({y})"
    first = f"greatest(0, least(x - ({q} + 1) // 2 + 1, {n} - {q}))"
    reach = f"(greatest(p.x - p.a, p.a + least({q}, {n}) - 1 - p.x) + greatest(0, ({q} - {n}) // 2))"
    weight = (f"CASE WHEN abs(i - p.x) <= 0.001 * {reach} THEN 1.0 WHEN abs(i - p.x) <= 0.999 * {reach} "
              f"THEN pow(1 - pow(abs(i - p.x) / {reach}::DOUBLE, 3), 3) ELSE 0.0 END")

    def moment(factors):
        return f"list_sum(list_transform(p.w, lambda w, j : w * {factors}))"

    away = "(p.a + j - 1 - p.x)"
    moments = (f"{{'s0': list_sum(p.w), 's1': {moment(away)}, 's2': {moment(f'{away} * {away}')}, "
               f"'t0': {moment(f'{y}[p.a + j]')}, 't1': {moment(f'{away} * {y}[p.a + j]')}}}")
    spread = "(s.s2 / s.s0 - (s.s1 / s.s0) * (s.s1 / s.s0))"
    fit = (f"CASE WHEN s.s0 = 0 THEN NULL WHEN sqrt(greatest({spread}, 0)) > 0.001 * ({n} - 1) "
           f"THEN s.t0 / s.s0 - s.s1 / s.s0 * (s.t1 / s.s0 - s.s1 / s.s0 * (s.t0 / s.s0)) / {spread} ELSE s.t0 / s.s0 END")
    return (f"list_transform(list_transform(list_transform(list_transform({places}, lambda x : {{'x': x, 'a': {first}}}), "
            f"lambda p : {{'x': p.x, 'a': p.a, 'w': list_transform(range(p.a, p.a + least({q}, {n})), "
            f"lambda i : {rho}[i + 1] * ({weight})::DOUBLE)}}), lambda p : {moments}), lambda s : {fit})")


def _mended(fit: str, y: str) -> str:
    """A fit at every place of y, with y where there is none."""
    return f"list_transform({fit}, lambda v, j : coalesce(v, {y}[j]))"


def stl(keys, src: str, period: int) -> str:
    """CTEs up to `parts(keys…, ds, y, trend, seasonal, residual)`: robust STL of series with two cycles at least, a
    recursion over its 32 passes.  Wants WITH RECURSIVE."""
    k, p = _list(keys), period
    trend_q, low_q = (int(-(-x // 1)) | 1 for x in (1.5 * p / (1 - 1.5 / 7), p + 1))
    ends = ("list_concat([coalesce({e}[1], {e}[2], {s}[1])], list_transform({e}[2:-2], lambda v, j : coalesce(v, {s}[j])), "
            "[coalesce({e}[-1], {e}[-2], {s}[-1])])")
    smooth = _loess("c.v", "c.r", "7", "range(-1, len(c.v) + 1)")

    def mean(name, width):
        return (f"list_transform(range(1, len({name}) - {width} + 2), lambda i : "
                f"list_sum({name}[i:i + {width} - 1]) / {width})")

    return f"""a0 AS MATERIALIZED (SELECT {k}list(y ORDER BY ds) AS y, list(ds ORDER BY ds) AS dates, count(*) AS n FROM {src} WHERE y IS NOT NULL
  GROUP BY ALL HAVING count(*) >= {2 * p}),
a1({k}y, n, pass, trend, seasonal, rho, live) AS (
SELECT {k}y, n, 0, list_transform(y, lambda v : 0.0::DOUBLE), list_transform(y, lambda v : 0.0::DOUBLE),
  list_transform(y, lambda v : 1.0::DOUBLE), true FROM a0
UNION ALL SELECT {k}y, n, pass, trend, seasonal, CASE WHEN pass % 2 = 1 OR scale = 0 THEN rho ELSE list_transform(rest, lambda v :
    (CASE WHEN abs(v) <= 0.001 * scale THEN 1.0 WHEN abs(v) <= 0.999 * scale THEN pow(1 - pow(abs(v) / scale, 2), 2) ELSE 0.0 END)::DOUBLE) END,
  pass % 2 = 1 OR scale > 1e-9 * list_max(list_transform(y, lambda v : abs(v))) FROM (
SELECT *, 6 * list_median(list_transform(rest, lambda v : abs(v))) AS scale FROM (
SELECT *, list_transform(range(1, n + 1), lambda i : y[i] - trend[i] - seasonal[i]) AS rest FROM (
SELECT * EXCLUDE (bare), {_mended(_loess('bare', 'rho', str(trend_q), 'range(0, len(bare))'), 'bare')} AS trend FROM (
SELECT * EXCLUDE (cycle, low, ones), list_transform(range(1, n + 1), lambda i : cycle[i + {p}] - low[i]) AS seasonal,
  list_transform(range(1, n + 1), lambda i : y[i] - (cycle[i + {p}] - low[i])) AS bare FROM (
SELECT * EXCLUDE (smooth), {_mended(_loess('smooth', 'ones', str(low_q), 'range(0, len(smooth))'), 'smooth')} AS low FROM (
SELECT *, {mean('two', 3)} AS smooth, list_transform(range(0, n), lambda i : 1.0::DOUBLE) AS ones FROM (
SELECT *, {mean('one', p)} AS two FROM (SELECT *, {mean('cycle', p)} AS one FROM (
SELECT * EXCLUDE (part), list_transform(range(0, n + {2 * p}), lambda t : part[t % {p} + 1][t // {p} + 1]) AS cycle FROM (
SELECT * EXCLUDE (phases), list_transform(list_transform(phases, lambda c : {{'e': {smooth}, 's': c.v}}), lambda c : {ends.format(e='c.e', s='c.s')}) AS part FROM (
SELECT {k}y, n, pass + 1 AS pass, rho, list_transform(range(0, {p}), lambda j : {{'v': list_transform(range(j, n, {p}), lambda i : y[i + 1] - trend[i + 1]),
  'r': list_transform(range(j, n, {p}), lambda i : rho[i + 1])}}) AS phases
FROM a1 WHERE live AND pass < 32)))))))))))),
a2 AS (SELECT * FROM a1 WHERE pass % 2 = 0 AND pass > 0 QUALIFY row_number() OVER (PARTITION BY {k[:-2]} ORDER BY pass DESC) = 1),
parts AS (SELECT {k}ds, yy AS y, t AS trend, s AS seasonal, yy - t - s AS residual FROM (
  SELECT {_list(keys, 'a2.')}unnest(dates) AS ds, unnest(a2.y) AS yy, unnest(trend) AS t, unnest(seasonal) AS s FROM a2 JOIN a0 USING ({k[:-2]})))"""
