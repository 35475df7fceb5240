"""The same results in plain SQL, for an independent engine."""

from __future__ import annotations

import math
from fractions import Fraction

from checks.queries import LRC1, LRC2, MEASURE_CODE, REGION_OFFSET

TRACE = """
ev AS (
  SELECT user_id, event_type, round(value * 100) AS i,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events
)"""

SWEPT = TRACE + """,
sw AS (
  SELECT user_id, event_type, i, CAST(floor(pos / 16.0) AS INT) + 1 AS sweep,
         pos % 16 AS sample_idx, (pos % 16) * 0.01::DOUBLE AS t
  FROM ev
)"""

LEVEL = TRACE + """,
lv AS (
  SELECT user_id, (avg(i) FILTER (pos < 5) + avg(i) FILTER (pos >= 40)) / 2 AS thresh
  FROM ev GROUP BY user_id
),
side AS (
  SELECT user_id, pos, sign(i - thresh) AS s FROM ev JOIN lv USING (user_id)
),
turn AS (
  SELECT user_id, pos,
         lead(s) OVER (PARTITION BY user_id ORDER BY pos) - s AS d FROM side
),
half AS (
  SELECT user_id, min(pos) AS t_half FROM turn WHERE d <> 0 GROUP BY user_id
)"""

MEASURES = """
o AS (
  SELECT o_orderkey, o_custkey AS id, o_orderstatus AS cond, round(o_totalprice * 100) AS i
  FROM orders
),
m AS (SELECT id, cond, avg(i) AS i_0, max(i) AS mp FROM o GROUP BY id, cond)"""

PAIRS = MEASURES + """,
kept AS (SELECT * FROM m WHERE cond IN ('F', 'O')),
base AS (
  SELECT id, max(i_0) FILTER (cond = 'F') AS b, count(*) FILTER (cond = 'F') AS nb
  FROM kept GROUP BY id
),
blocked AS (
  SELECT id, cond, i_0, mp,
         CASE WHEN nb = 1 THEN (1 - i_0 / nullif(b, 0)) * 100 END AS block
  FROM kept JOIN base USING (id)
),
pairs AS (
  SELECT l.id, l.i_0, l.mp, r.block, r.mp AS mp_treated, r.mp - l.mp AS mp_shift
  FROM blocked l LEFT JOIN blocked r ON l.id = r.id AND r.cond <> 'F'
  WHERE l.cond = 'F'
)"""

IV = """
iv AS (
  SELECT l_suppkey AS id, l_returnflag AS flag, l_quantity - 25 AS v,
         round(l_extendedprice * 100) / 100 - 35000 AS i
  FROM lineitem
),
vc AS (SELECT id, flag, min_by(v, (abs(i), v)) AS v_crit FROM iv GROUP BY id, flag)"""

FITS = IV + """,
near AS (
  SELECT id, flag, v_crit, v - v_crit AS x, i AS y
  FROM iv JOIN vc USING (id, flag) WHERE abs(v - v_crit) < 30
),
sums AS (
  SELECT id, flag, v_crit, count(*) AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3,
         sum(x*x*x*x) AS s4, sum(y) AS sy, sum(x*y) AS sxy, sum(x*x*y) AS sx2y,
         sum(y*y) AS syy
  FROM near GROUP BY id, flag, v_crit
),
cof AS (
  SELECT *, s2*s4 - s3*s3 AS k00, s2*s3 - s1*s4 AS k01, s1*s3 - s2*s2 AS k02,
         n*s4 - s2*s2 AS k11, s1*s2 - n*s3 AS k12, n*s2 - s1*s1 AS k22
  FROM sums
),
dt AS (
  SELECT *, CASE WHEN abs(n*k00 + s1*k01 + s2*k02) > 1e-12*n*s2*s4
                 THEN n*k00 + s1*k01 + s2*k02 END AS det
  FROM cof
),
cen AS (
  SELECT *, (k00*sy + k01*sxy + k02*sx2y) / det AS c0,
         (k01*sy + k11*sxy + k12*sx2y) / det AS c1,
         (k02*sy + k12*sxy + k22*sx2y) / det AS c2
  FROM dt
),
fit AS (
  SELECT *, c0 - c1*v_crit + c2*v_crit*v_crit AS b0, c1 - 2*c2*v_crit AS b1, c2 AS b2,
         CASE WHEN c0 IS NOT NULL
              THEN greatest(syy - c0*sy - c1*sxy - c2*sx2y, 0) END AS sse
  FROM cen
)"""

REVERSAL = FITS + """,
roots AS (
  SELECT *, c1*c1 - 4*c2*c0 AS disc,
         (-c1 - sqrt(greatest(c1*c1 - 4*c2*c0, 0))) / nullif(2*c2, 0) AS r1,
         (-c1 + sqrt(greatest(c1*c1 - 4*c2*c0, 0))) / nullif(2*c2, 0) AS r2
  FROM fit
),
test AS (
  SELECT *, CASE WHEN c2 = 0 THEN -c0 / nullif(c1, 0)
                 WHEN abs(r1) < abs(r2) THEN r1 WHEN abs(r2) < abs(r1) THEN r2
                 ELSE least(r1, r2) END AS e_test
  FROM roots
),
rev AS (
  SELECT id, flag, v_crit, n, v_crit + e_test AS e_rev, e_test, abs(e_test) > 10 AS bad,
         c2 <> 0 AND disc < 0 AS complex_root
  FROM test
)"""

VECTOR = """
tr AS (
  SELECT vec_id, unnest(range(len(embedding))) AS sample_idx,
         unnest(embedding)::DOUBLE AS i
  FROM embeddings
)"""


def _weights() -> str:
    """Smoothing weights (window row, offset in the window) as a literal table.

    Cubic through 11 equidistant points, exactly, from the orthogonal polynomials of
    -5 .. 5: each is x times the last minus a multiple of the one before.
    """
    x = [Fraction(k) for k in range(-5, 6)]
    polynomials = [[Fraction(1)] * 11, x]
    for _ in range(2):
        a, b = polynomials[-2:]
        back = sum(u * u for u in b) / sum(u * u for u in a)
        polynomials.append([u * w - back * v for u, w, v in zip(x, b, a)])

    def weight(r: int, k: int) -> float:
        return float(sum(p[r] * p[k] / sum(u * u for u in p) for p in polynomials))

    return ", ".join(
        f"({r}, {k}, {weight(r, k)!r}::DOUBLE)" for r in range(11) for k in range(11)
    )


SMOOTH = VECTOR + f""",
w(r, k, weight) AS (VALUES {_weights()}),
pos AS (
  SELECT vec_id, sample_idx,
         least(greatest(sample_idx - 5, 0), count(*) OVER (PARTITION BY vec_id) - 11) AS lo
  FROM tr
),
sm AS (
  SELECT pos.vec_id, pos.sample_idx, sum(w.weight * tr.i) AS i_smooth
  FROM pos JOIN w ON w.r = pos.sample_idx - pos.lo
  JOIN tr ON tr.vec_id = pos.vec_id AND tr.sample_idx = pos.lo + w.k
  GROUP BY pos.vec_id, pos.sample_idx
)"""

_POINTS = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a in LRC1 for b in LRC2)

GRID = VECTOR + f""",
g(lrc1, lrc2) AS (VALUES {_POINTS}),
ex AS (
  SELECT vec_id, lrc1, lrc2, i AS y, exp(-exp(lrc1) * (sample_idx / 100.0::DOUBLE)) AS e1,
         exp(-exp(lrc2) * (sample_idx / 100.0::DOUBLE)) AS e2
  FROM tr, g
),
gs AS (
  SELECT vec_id, lrc1, lrc2, count(*) AS n, sum(y) AS r3, sum(y*y) AS syy,
         sum(e1*e1) AS m11, sum(e1*e2) AS m12, sum(e1) AS m13, sum(e2*e2) AS m22,
         sum(e2) AS m23, sum(e1*y) AS r1, sum(e2*y) AS r2
  FROM ex GROUP BY vec_id, lrc1, lrc2
),
gc AS (
  SELECT *, m22*n - m23*m23 AS k11, m13*m23 - m12*n AS k12, m12*m23 - m13*m22 AS k13,
         m11*n - m13*m13 AS k22, m12*m13 - m11*m23 AS k23, m11*m22 - m12*m12 AS k33
  FROM gs
),
gd AS (
  SELECT *, m11*k11 + m12*k12 + m13*k13 AS det FROM gc
),
gp AS (
  SELECT vec_id, n, lrc1, lrc2, syy, r1, r2, r3,
         (k11*r1 + k12*r2 + k13*r3) / det AS a1, (k12*r1 + k22*r2 + k23*r3) / det AS a2,
         (k13*r1 + k23*r2 + k33*r3) / det AS c
  FROM gd
),
ge AS (
  SELECT *, greatest(syy - a1*r1 - a2*r2 - c*r3, 0) AS sse FROM gp
),
best AS (
  SELECT vec_id, n, lrc1, lrc2, a1, a2, c, sse FROM ge
  QUALIFY row_number() OVER (
    PARTITION BY vec_id ORDER BY round(sse, 9), lrc1, lrc2) = 1
)"""

PARTS = GRID + """,
pair AS (
  SELECT vec_id, 1 AS component, a1 AS a, lrc1 AS l, exp(-lrc1) AS tau, c FROM best
  UNION ALL
  SELECT vec_id, 2, a2, lrc2, exp(-lrc2), c FROM best
),
parts AS (
  SELECT *, CASE row_number() OVER (PARTITION BY vec_id ORDER BY tau, component)
            WHEN 1 THEN 'fast' ELSE 'slow' END AS speed
  FROM pair
)"""


def r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def rs(digits: int, *names: str) -> str:
    return ", ".join(r(n, digits, n) for n in names)


def _phase(zero: str, one: str) -> str:
    return f"""WITH {SWEPT},
    st AS (
      SELECT user_id, sweep, avg(i) FILTER ({zero}) AS z, avg(i) FILTER ({one}) AS o
      FROM sw GROUP BY user_id, sweep
    )
    SELECT user_id, sweep, sample_idx, {r('z', 8, '"offset"')}, {r('o - z', 8, 'norm')},
           {r('(i - z) / nullif(o - z, 0)', 8, 'i_norm')},
           {r('t - 0.0 + 0.001::DOUBLE', 8, 't_fit')}
    FROM sw JOIN st USING (user_id, sweep)"""


_lookup = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in REGION_OFFSET.items())
_codes = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in MEASURE_CODE.items())
_first3, _last3 = "sample_idx < 3", "sample_idx > 12"
_windows = """avg(i) FILTER (pos < 5) AS i_inst, avg(i) FILTER (pos > 9 AND pos < 13) AS i_50,
  avg(i) FILTER (pos > 29 AND pos < 35) AS i_tail,
  avg(i) FILTER (pos > 34 AND pos < 40) AS i_tail_ss, avg(i) FILTER (pos > 39) AS i_ss"""
_sse_var = "sse / nullif(greatest(n - 3, 0), 0)"
_sst = "(syy - sy*sy/n)"
_loglik = f"(-n / 2.0 * ({math.log(2 * math.pi)!r} + ln(nullif(sse, 0) / n) + 1))"

KNOWN = """
k AS (
  SELECT vec_id, vec_id % 50 = 0 AS empty,
         0.6 + least(greatest(round(embedding[1]::DOUBLE * 100) / 1000, -0.3), 0.3) AS a1,
         4.4 + vec_id % 7 / 10.0::DOUBLE AS l1,
         0.4 + least(greatest(round(embedding[2]::DOUBLE * 100) / 1000, -0.3), 0.3) AS a2,
         1.6 + vec_id % 9 / 10.0::DOUBLE AS l2,
         0.05 + vec_id % 5 / 100.0::DOUBLE AS c
  FROM embeddings
),
terms AS (
  SELECT vec_id, empty, unnest(['A1', 'lrc1', 'A2', 'lrc2', 'C']) AS term,
         unnest([a1, l1, a2, l2, c]) AS value
  FROM k
)"""


def _swept(k: int, names: list[str]) -> str:
    """The symmetric matrix after the sweep of pivot ``k``, an entry a column."""
    at = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    n = len(names)
    out = []
    for i in range(n):
        for j in range(i, n):
            if i == k and j == k:
                e = f"-1 / {at(k, k)}"
            elif k in (i, j):
                e = f"{at(i, j)} / {at(k, k)}"
            else:
                e = f"{at(i, j)} - {at(i, k)} * {at(k, j)} / {at(k, k)}"
            out.append(f"{e} AS {at(i, j)}")
    return ", ".join(out)


#: Chance that |t| with 295 degrees of freedom is below some value, as a finite series.
def _within(t: str) -> str:
    angle = f"atan(abs({t}) / sqrt(295.0))"
    series = f"""list_sum([exp(lgamma(j) - lgamma(j + 0.5)) * sqrt(pi()) / 2 * pow(cos({angle}), 2 * j - 1)
                           for j in range(1, 148)])"""
    return f"(2 / pi() * ({angle} + sin({angle}) * {series}))"


_SLOPES = ["e1", "-a1 * k1 * t * e1", "e2", "-a2 * k2 * t * e2", "1.0", "off"]
#: Names of the trace files, one for each event type.
NAMES = """
  kinds AS (
    SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)
  ),
  names AS (
    SELECT *, 'c' || k AS id, 'Chan' || event_type AS channel, '5K-Na' AS "Pip",
           event_type || '+tpa.00' || k || '.txt' AS last, CASE WHEN k = 1 THEN 'again ' ELSE '' END AS extra
    FROM kinds
  ),
  files AS (
    SELECT event_type, k, id, channel, "Pip", id || ' ' || channel || ' ' || "Pip" || ' ' || extra || last AS file_name,
           CASE WHEN k = 1 THEN 'again' ELSE last END AS file
    FROM names
  )"""
#: Parameters, residual and covariance of the traces with a known residual.
RESIDUAL = f"""
  RECURSIVE width(k, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 10.0::DOUBLE
    UNION ALL
    SELECT k + 1, CASE WHEN {_within('(lo + hi) / 2')} < 0.95 THEN (lo + hi) / 2 ELSE lo END,
           CASE WHEN {_within('(lo + hi) / 2')} < 0.95 THEN hi ELSE (lo + hi) / 2 END
    FROM width WHERE k < 50
  ),
  truth AS (
    SELECT vec_id, embedding,
           0.6 + least(greatest(round(embedding[1]::DOUBLE * 100) / 1000, -0.3), 0.3) AS a1,
           4.4 + (vec_id % 7) / 10 AS l1,
           0.4 + least(greatest(round(embedding[2]::DOUBLE * 100) / 1000, -0.3), 0.3) AS a2,
           1.6 + (vec_id % 9) / 10 AS l2, (vec_id % 5) / 500 AS c
    FROM embeddings
  ),
  points AS (
    SELECT vec_id, a1, a2, exp(l1) AS k1, exp(l2) AS k2, i * 0.002 AS t, 0.1 * embedding[i % 64 + 1]::DOUBLE AS off
    FROM truth, range(300) AS r(i)
  ),
  slopes AS (
    SELECT vec_id, {', '.join(f'{e} AS s{k}' for k, e in enumerate(_SLOPES))}
    FROM (SELECT *, exp(-k1 * t) AS e1, exp(-k2 * t) AS e2 FROM points)
  ),
  w0 AS (
    SELECT vec_id, {', '.join(f'sum(s{i} * s{j}) AS m{i}{j}' for i in range(6) for j in range(i, 6))}
    FROM slopes GROUP BY vec_id
  ),
  {', '.join(f'w{k + 1} AS (SELECT vec_id, {_swept(k, _SLOPES)} FROM w{k})' for k in range(5))},
  -- what is left of the squares, and less the inverse of the slopes' products
  terms AS (
    SELECT vec_id, unnest(['A1', 'lrc1', 'A2', 'lrc2', 'C']) AS term,
           unnest([a1, l1, a2, l2, c]) AS value,
           unnest([-m00, -m11, -m22, -m33, -m44]) * m55 / 295 AS variance
    FROM truth JOIN w5 USING (vec_id)
  ),
  errors AS (
    SELECT *, sqrt(variance) AS std_error, (SELECT lo FROM width WHERE k = 50) * sqrt(variance) AS half FROM terms
  )"""


def _known(name: str, digits: int = 6) -> str:
    return f"CASE WHEN NOT empty THEN round({name}, {digits}) + 0.0 END"


#: The reversal potentials with the line number as part of the flag.
TWO_TIMES = REVERSAL.replace(
    "l_returnflag AS flag", "l_returnflag || ':' || l_linenumber AS flag"
).replace("FROM lineitem", "FROM lineitem WHERE l_linenumber <= 2")

ORACLE: dict[str, str] = {
    "q_biexp_refine": f"""WITH {KNOWN}
        SELECT vec_id, CASE WHEN empty THEN 0 ELSE 300 END::BIGINT AS n, empty AS failed,
               CASE WHEN empty THEN 'no values' END AS error, {_known('a1')} AS "A1",
               {_known('l1')} AS lrc1, {_known('a2')} AS "A2", {_known('l2')} AS lrc2,
               {_known('c')} AS "C", CASE WHEN empty THEN -5 ELSE 295 END::BIGINT AS df_residual
        FROM k""",
    "q_refine_terms": f"""WITH {KNOWN}
        SELECT vec_id, term, {_known('value')} AS estimate, {_known('0.0')} AS std_error,
               {_known('0.0')} AS p_value, {_known('value', 4)} AS conf_lo,
               {_known('value', 4)} AS conf_hi,
               CASE WHEN empty THEN -5 ELSE 295 END::DOUBLE AS df_residual
        FROM terms""",
    "q_refine_taus": f"""WITH {KNOWN}
        SELECT vec_id, {_known('exp(-value)', 5)} AS tau, term, {_known('exp(-value)', 5)} AS conf_lo,
               {_known('exp(-value)', 5)} AS conf_hi,
               CASE WHEN term = 'lrc1' THEN 'fast' ELSE 'slow' END AS component
        FROM terms WHERE term LIKE 'lrc%'""",
    "q_refine_errors": f"""WITH {RESIDUAL}
        SELECT vec_id, 295.0::DOUBLE AS df_residual, term, {r('value', 3, 'estimate')},
               {r('std_error', 6, 'std_error')}, {r('value / std_error', 1, 'statistic')},
               {r(f"1 - {_within('value / std_error')}", 3, 'p_value')},
               {r('value - half', 3, 'conf_lo')}, {r('value + half', 3, 'conf_hi')}
        FROM errors""",
    "q_refine_tau_limits": f"""WITH {RESIDUAL}
        SELECT vec_id, term, {r('exp(-value)', 4, 'tau')}, {r('exp(-(value + half))', 4, 'conf_lo')},
               {r('exp(-(value - half))', 4, 'conf_hi')},
               CASE WHEN term = 'lrc1' THEN 'fast' ELSE 'slow' END AS component
        FROM errors WHERE term LIKE 'lrc%'""",
    "q_refine_noise": f"""WITH {GRID}
        SELECT vec_id, n, true AS same, true AS no_worse, round(sse, 6) AS grid_sse FROM best""",
    "q_extremal_tail": f"""WITH {SWEPT},
        f AS (
          SELECT user_id AS recording, sweep, max(round(i / 2000)) FILTER (sample_idx = 2) AS v_pulse,
                 sum(i) FILTER (sample_idx < 4) AS i_tail, sum(i) FILTER (sample_idx >= 4) AS i_tail_ss
          FROM sw GROUP BY 1, 2
        ),
        e AS (
          SELECT recording, arg_max(i_tail, (v_pulse, sweep)) AS peak,
                 arg_min(i_tail_ss, (v_pulse, sweep)) AS low
          FROM (SELECT recording, sweep, v_pulse, coalesce(i_tail, 'nan') AS i_tail,
                       coalesce(i_tail_ss, 'nan') AS i_tail_ss FROM f WHERE v_pulse IS NOT NULL)
          GROUP BY recording
        ),
        n AS (SELECT recording, CASE WHEN NOT isnan(peak) THEN peak END AS peak,
                     CASE WHEN NOT isnan(low) THEN low END AS low FROM e)
        SELECT recording, sweep, v_pulse, i_tail, i_tail_ss, {r('low', 8, 'i_tail_ss_full')},
               {r('i_tail / nullif(peak, 0)', 8, 'norm_tail')}, {r('i_tail - low', 8, 'td_tail')},
               {r('(i_tail + low) / 2', 8, 'thresh_tail')}
        FROM f LEFT JOIN n USING (recording)""",
    "q_probe_beside": f"""WITH {SWEPT}
        SELECT user_id, sweep, max(i) FILTER (sample_idx = 8) AS near_8,
               max(i) FILTER (sample_idx = 9) AS near_9,
               coalesce(max(i) FILTER (sample_idx = 8), max(i) FILTER (sample_idx = 9)) AS earlier,
               NULL::DOUBLE AS out_of_reach
        FROM sw GROUP BY user_id, sweep""",
    "q_half_time": f"WITH {LEVEL} SELECT user_id, t_half FROM half",
    "q_sweep_number": f"""WITH {TRACE},
        tot AS (SELECT user_id, count(*) AS total FROM ev GROUP BY user_id)
        SELECT user_id, CAST(floor(pos / 16.0) AS INT) + 1 AS sweep,
               CAST(floor(pos / 16.0) AS INT) + 1 <= floor(total / 16.0) AS complete,
               count(*) AS n, max(pos % 16) AS last_idx, sum(i) AS sum_i
        FROM ev JOIN tot USING (user_id) GROUP BY 1, 2, 3""",
    "q_phase_norm_act": _phase(_first3, _last3),
    "q_phase_norm_deact": _phase(_last3, _first3),
    "q_tail_norm_ref": f"""WITH {SWEPT},
        z AS (
          SELECT user_id, avg(i) FILTER (sweep = 1 AND {_last3}) AS z
          FROM sw GROUP BY user_id
        ),
        o AS (
          SELECT user_id, sweep, avg(i) FILTER ({_first3}) AS o FROM sw GROUP BY ALL
        )
        SELECT user_id, sweep, sample_idx, {r('z', 8, '"offset"')},
               {r('(i - z) / nullif(o - z, 0)', 8, 'i_norm')}
        FROM sw JOIN z USING (user_id) JOIN o USING (user_id, sweep)""",
    "q_step_voltage": f"""WITH {SWEPT}
        SELECT user_id, sweep,
               CAST(round_even(max(i / 10) FILTER (sample_idx = 8), 0) AS DOUBLE) AS v_pulse
        FROM sw GROUP BY user_id, sweep""",
    "q_sweep_features": f"""WITH {LEVEL},
        w AS (SELECT user_id, {_windows} FROM ev GROUP BY user_id)
        SELECT user_id, {rs(8, 'i_inst', 'i_50', 'i_tail', 'i_tail_ss', 'i_ss')},
               {r('i_ss - i_inst', 8, 'td_current')},
               {r('(i_ss - i_inst) / nullif(i_ss, 0)', 8, 'td_ratio')},
               {r('i_tail / nullif(i_tail_ss, 0)', 8, 'frac_tail')},
               {r('i_inst + (i_ss - i_inst) / 2', 8, 'thresh')}, t_half
        FROM w LEFT JOIN half USING (user_id)""",
    "q_zero_crossing_mean": f"""
        SELECT user_id, {r("avg(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT))"
                           " FILTER (abs(value - 50) < 5)", 8, 'mp')}
        FROM events GROUP BY user_id""",
    "q_phase_filter": f"""WITH {SWEPT},
        st AS (
          SELECT user_id, sweep,
                 CAST(round_even(max(i / 10) FILTER (sample_idx = 8), 0) AS DOUBLE) AS v_pulse
          FROM sw GROUP BY user_id, sweep
        )
        SELECT CAST(user_id AS VARCHAR) AS id, event_type AS channel,
               CAST(sweep AS VARCHAR) AS sweep, sample_idx, v_pulse, i / 1000 AS i_na
        FROM sw JOIN st USING (user_id, sweep)
        WHERE v_pulse > 200 AND event_type IN ('click', 'view')""",
    "q_sweep_average": f"""WITH {SWEPT}
        SELECT event_type, sample_idx, {r('min(t)', 8, 't')}, {r('avg(-i)', 8, 'i')}
        FROM sw WHERE t > 0.015 AND t < 0.125 GROUP BY event_type, sample_idx""",
    "q_cohort_curve": f"""WITH {SWEPT}
        SELECT event_type, sample_idx, count(*) AS n, {r('avg(i)', 6, 'i_avg')},
               {r('avg(i) - stddev_samp(i) / sqrt(count(i))', 6, 'i_lo')},
               {r('avg(i) + stddev_samp(i) / sqrt(count(i))', 6, 'i_hi')},
               count(*) - count(i) AS i_null
        FROM sw GROUP BY event_type, sample_idx""",
    "q_cohort_state": f"""WITH {SWEPT},
        c AS (
          SELECT event_type, sample_idx, count(*) AS n, avg(i) AS mean, stddev_samp(i) / sqrt(count(i)) AS se,
                 count(*) - count(i) AS i_null
          FROM sw GROUP BY event_type, sample_idx
        )
        SELECT event_type, sample_idx, n, round(mean + 1e-8, 6) AS i_avg, round(mean - se + 1e-8, 6) AS i_lo,
               round(mean + se + 1e-8, 6) AS i_hi, i_null
        FROM c""",
    "q_nest_unnest": f"""WITH {TRACE}
        SELECT user_id, count(*) AS n, sum(pos * i) AS checksum FROM ev GROUP BY user_id""",
    "q_pixel_columns": f"""WITH {TRACE},
        c AS (
          SELECT user_id, least(pos // 20, 49) AS pixel, min(pos)::DOUBLE AS x0, arg_min(i, pos) AS y0,
                 max(pos)::DOUBLE AS x1, arg_max(i, pos) AS y1, min(i) AS low, max(i) AS high
          FROM ev WHERE pos BETWEEN 0 AND 1000 GROUP BY ALL
        )
        SELECT user_id, pixel, 'first' AS kind, x0 AS sample_idx, y0 AS i FROM c
        UNION ALL
        SELECT user_id, pixel, 'low', (x0 + x1) / 2, low FROM c WHERE low < least(y0, y1)
        UNION ALL
        SELECT user_id, pixel, 'high', (x0 + x1) / 2, high FROM c WHERE high > greatest(y0, y1)
        UNION ALL
        SELECT user_id, pixel, 'last', x1, y1 FROM c WHERE x1 > x0""",
    "q_summary_files": f"""WITH {SWEPT}
        SELECT event_type, sample_idx, count(*) AS n, {r('avg(i)', 6, 'i_avg')}
        FROM sw GROUP BY event_type, sample_idx""",
    "q_summary_commits": f"""WITH {TRACE},
        s AS (SELECT user_id, count(*) AS n, sum(i) AS sum_i, max(i) AS hi, min(i) AS lo FROM ev GROUP BY user_id)
        SELECT user_id, n, CASE WHEN lo >= 100 THEN sum_i END AS sum_i,
               CASE WHEN lo >= 100 AND sum_i > 5000 * n THEN hi END AS hi,
               CASE WHEN lo < 100 THEN lo END AS lo
        FROM s""",
    "q_landed_table": f"""WITH {TRACE}
        SELECT user_id, event_type, count(*) AS n, sum(i) AS sum_i FROM ev
        GROUP BY user_id, event_type""",
    "q_trace_files": """
        SELECT event_id, round(value * 100) AS i, true AS in_place FROM events""",
    "q_trace_meta": f"""WITH {NAMES},
        ev AS (
          SELECT event_type, event_id, round(value * 100) AS i, count(*) OVER (PARTITION BY event_type) AS n,
                 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos
          FROM events
        )
        SELECT file_name, id, channel, "Pip", file, string_split(file, '.')[1] AS cond, pos // 16 + 1 AS sweep,
               pos % 16 AS sample_idx, 0.25::DOUBLE AS t, i, event_id, pos < n - n % 16 AS complete
        FROM ev JOIN files USING (event_type)""",
    "q_trace_landed": f"""WITH {NAMES},
        ev AS (
          SELECT event_type, event_id, round(value * 100) AS i, count(*) OVER (PARTITION BY event_type) AS n,
                 row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos
          FROM events
        )
        SELECT id, channel, "Pip", file, pos // 16 + 1 AS sweep, pos % 16 AS sample_idx, i, event_id,
               pos < n - n % 16 AS complete
        FROM ev JOIN files USING (event_type)""",
    "q_trace_names": f"""WITH {NAMES}
        SELECT file_name, id, channel, "Pip", file, len(string_split(file_name, ' ')) AS n_tokens, k <> 1 AS ok,
               true AS has_bytes, CASE WHEN k = 2 THEN 'late' ELSE 'top' END AS folder
        FROM files""",
    "q_preview": """SELECT event_id, user_id, event_type, value FROM events
        ORDER BY ts, event_id LIMIT 6""",
    "q_union_protocols": """
        SELECT user_id, event_id, value, NULL::VARCHAR AS props, 'deact. pre p.' AS protocol
        FROM events WHERE event_type = 'click'
        UNION ALL
        SELECT user_id, event_id, NULL, props, 'act. pre p.' FROM events
        WHERE event_type = 'view'""",
    "q_baseline_norm": f"""WITH {MEASURES},
        b AS (SELECT id, avg(i) FILTER (cond = 'F') AS b FROM o GROUP BY id)
        SELECT o_orderkey, id, {r('i / nullif(b, 0)', 8, 'i_norm')} FROM o JOIN b USING (id)""",
    "q_percent_block": f"""WITH {MEASURES},
        b AS (
          SELECT id, max(i_0) FILTER (cond = 'F') AS b,
                 count(*) FILTER (cond = 'F') AS n_baseline,
                 count(*) = 2 AS block_measured, bool_or(cond = 'F') AS has_baseline,
                 bool_or(cond <> 'F') AS has_treated
          FROM m GROUP BY id
        )
        SELECT id, cond, {r('i_0', 6, 'i_0')}, n_baseline,
               {r('CASE WHEN n_baseline = 1 THEN (1 - i_0 / nullif(b, 0)) * 100 END', 6,
                  'block')},
               block_measured, has_baseline, has_treated
        FROM m JOIN b USING (id)""",
    "q_pair_table": f"""WITH {PAIRS}
        SELECT id, {r('i_0', 6, 'i_0')}, mp, {r('block', 6, 'block')}, mp_treated, mp_shift
        FROM pairs""",
    "q_quality_points": f"""WITH {PAIRS}
        SELECT id, mp, mp_treated, {r('block', 6, 'block')} FROM pairs
        WHERE mp BETWEEN 5e6 AND 5e7 AND mp_treated BETWEEN 5e6 AND 5e7""",
    "q_extremal_norm": f"""WITH {MEASURES},
        e AS (
          SELECT id, max_by(i, o_orderkey) AS at_max, min_by(i, o_orderkey) AS at_min
          FROM o GROUP BY id
        )
        SELECT o_orderkey, {r('i / nullif(at_max, 0)', 8, 'norm_tail')},
               i - at_min AS td_tail
        FROM o JOIN e USING (id)""",
    "q_distinct_n": """
        SELECT c_mktsegment AS segment, o_orderstatus AS cond,
               count(DISTINCT o_custkey) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "q_id_listing": """
        SELECT DISTINCT c_mktsegment AS segment, o_custkey AS id
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""",
    "q_coverage": """
        WITH a AS (
          SELECT o_custkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')
          UNION SELECT user_id FROM events
        )
        SELECT CAST(a.id AS VARCHAR) AS id,
          CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
               THEN true END AS act_pre,
          CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
               THEN true END AS deact_pre,
          CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
               THEN true END AS ramp,
          CASE WHEN id IN (SELECT user_id FROM events) THEN true END AS dt
        FROM a""",
    "q_coverage_state": """
        WITH a AS (
          SELECT o_custkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')
          UNION SELECT user_id FROM events
        )
        SELECT CAST(a.id AS VARCHAR) AS id,
          CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
               THEN true END AS act_pre,
          CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
               THEN true END AS deact_pre,
          CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
               THEN true END AS ramp,
          CASE WHEN id IN (SELECT user_id FROM events) THEN true END AS dt
        FROM a""",
    "q_distinct_state": """
        SELECT c_mktsegment AS segment, o_orderstatus AS cond,
               count(DISTINCT o_custkey) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "q_common_ids": """
        SELECT segment, count(*) AS n FROM (
          SELECT c_mktsegment AS segment, o_custkey
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
          HAVING count(DISTINCT o_orderstatus) = 3
        ) GROUP BY segment""",
    "q_lookup_correct": f"""
        WITH k(region, e_junc) AS (VALUES {_lookup})
        SELECT c_custkey, r_name AS region, {r('c_acctbal + e_junc', 6, 'v_corr')}
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN k ON r_name = k.region""",
    "q_timepoints": f"""
        WITH k(timepoint, time) AS (VALUES {_codes}),
        long AS (
          SELECT l_partkey, 'l_quantity' AS timepoint, l_quantity AS value FROM lineitem
          UNION ALL SELECT l_partkey, 'l_discount', l_discount FROM lineitem
          UNION ALL SELECT l_partkey, 'l_tax', l_tax FROM lineitem
        )
        SELECT l_partkey, timepoint, time, count(*) AS n, sum(round(value * 100)) AS total
        FROM long LEFT JOIN k USING (timepoint) GROUP BY 1, 2, 3""",
    "q_critical_voltage": f"""WITH {IV}
        SELECT id, flag, v_crit, count(*) AS n_near, min(v) AS v_lo, max(v) AS v_hi
        FROM iv JOIN vc USING (id, flag) WHERE abs(v - v_crit) < 10 GROUP BY 1, 2, 3""",
    "q_reversal": f"""WITH {REVERSAL}
        SELECT id, flag, v_crit, n, {rs(4, 'e_rev', 'e_test')}, bad, complex_root FROM rev""",
    "q_dubious": f"""WITH {REVERSAL}
        SELECT id, flag, {rs(4, 'e_rev')} FROM rev WHERE bad""",
    "q_quad_stats": f"""WITH {FITS},
        s AS (
          SELECT id, flag, n, n - 3 AS df_residual, 1 - sse / nullif({_sst}, 0) AS r_squared,
                 sqrt({_sse_var}) AS sigma,
                 (({_sst}) - sse) / 2 / nullif({_sse_var}, 0) AS statistic,
                 {_loglik} AS log_lik
          FROM fit
        )
        SELECT id, flag, n, df_residual, {rs(4, 'r_squared')},
          {r('1 - (1 - r_squared) * (n - 1) / nullif(greatest(n - 3, 0), 0)', 4,
             'adj_r_squared')},
          {rs(4, 'sigma', 'statistic')},
          {r('CASE WHEN n > 3 THEN pow(1 + 2 * statistic / nullif(n - 3, 0), -(n - 3) / 2.0)'
             ' END', 4, 'p_value')},
          {rs(4, 'log_lik')}, {r('-2 * log_lik + 8', 4, 'aic')},
          {r('-2 * log_lik + 4 * ln(n)', 4, 'bic')}
        FROM s""",
    "q_quad_terms": f"""WITH {FITS},
        v AS (
          SELECT *, {_sse_var} AS s2e, k00/det + v_crit**2*k11/det + v_crit**4*k22/det
                 - 2*v_crit*k01/det + 2*v_crit**2*k02/det - 2*v_crit**3*k12/det AS v0,
                 k11/det - 4*v_crit*k12/det + 4*v_crit**2*k22/det AS v1, k22/det AS v2
          FROM fit
        ),
        t AS (
          SELECT id, flag, '(Intercept)' AS term, b0 AS estimate,
                 sqrt(CASE WHEN s2e*v0 < 0 THEN 0 ELSE s2e*v0 END) AS std_error FROM v
          UNION ALL
          SELECT id, flag, 'v', b1, sqrt(CASE WHEN s2e*v1 < 0 THEN 0 ELSE s2e*v1 END) FROM v
          UNION ALL
          SELECT id, flag, 'v^2', b2, sqrt(CASE WHEN s2e*v2 < 0 THEN 0 ELSE s2e*v2 END) FROM v
        )
        SELECT id, flag, term, {rs(4, 'estimate', 'std_error')},
               {r('estimate / nullif(std_error, 0)', 4, 'statistic')}
        FROM t""",
    "q_quad_p_values": f"""WITH {FITS},
        v AS (
          SELECT *, {_sse_var} AS s2e, k00/det + v_crit**2*k11/det + v_crit**4*k22/det
                 - 2*v_crit*k01/det + 2*v_crit**2*k02/det - 2*v_crit**3*k12/det AS v0,
                 k11/det - 4*v_crit*k12/det + 4*v_crit**2*k22/det AS v1, k22/det AS v2
          FROM fit
        ),
        t AS (
          SELECT id, flag, n, '(Intercept)' AS term, b0 AS estimate,
                 sqrt(CASE WHEN s2e*v0 < 0 THEN 0 ELSE s2e*v0 END) AS std_error FROM v
          UNION ALL
          SELECT id, flag, n, 'v', b1, sqrt(CASE WHEN s2e*v1 < 0 THEN 0 ELSE s2e*v1 END) FROM v
          UNION ALL
          SELECT id, flag, n, 'v^2', b2, sqrt(CASE WHEN s2e*v2 < 0 THEN 0 ELSE s2e*v2 END) FROM v
        ),
        s AS (
          SELECT id, flag, term, (n - 3)::BIGINT AS df, estimate, std_error,
                 estimate / nullif(std_error, 0) AS statistic
          FROM t
        ),
        -- the finite series of the t distribution for whole degrees of freedom
        a AS (
          SELECT *, atan(abs(statistic) / sqrt(df)) AS angle,
                 unnest(range(greatest((df - df % 2) // 2, 1))) AS j
          FROM s WHERE df > 0 AND statistic IS NOT NULL
        ),
        terms AS (
          SELECT *, coalesce(exp(sum(CASE WHEN j = 0 THEN 0 WHEN df % 2 = 1 THEN ln(2.0*j / (2*j + 1))
                                          ELSE ln((2.0*j - 1) / (2*j)) END)
                    OVER (PARTITION BY id, flag, term ORDER BY j)), 1)
                    * pow(cos(angle), 2*j + df % 2) AS part
          FROM a
        ),
        inside AS (
          SELECT id, flag, term,
                 CASE WHEN any_value(df) % 2 = 0 THEN sin(any_value(angle)) * sum(part)
                      WHEN any_value(df) = 1 THEN 2 / pi() * any_value(angle)
                      ELSE 2 / pi() * (any_value(angle) + sin(any_value(angle)) * sum(part)) END AS p_in
          FROM terms GROUP BY id, flag, term
        )
        SELECT id, flag, term, df::DOUBLE AS df_residual, {rs(6, 'estimate', 'std_error', 'statistic')},
               {r('1 - p_in', 6, 'p_value')}
        FROM s LEFT JOIN inside USING (id, flag, term)""",
    "q_quad_curve": f"""WITH {FITS},
        g AS (SELECT unnest(range(-25, 26))::DOUBLE AS v)
        SELECT id, flag, v, {r('b0 + b1*v + b2*v*v', 3, 'fitted')} FROM fit, g""",
    "q_reversal_shift": f"""WITH {REVERSAL},
        p AS (
          SELECT id, max(e_rev) FILTER (flag = 'R') AS e_rev_inst,
                 max(e_rev) FILTER (flag = 'A') AS e_rev_steady
          FROM rev GROUP BY id
        )
        SELECT id, {rs(4, 'e_rev_inst', 'e_rev_steady')},
               {r('e_rev_inst - e_rev_steady', 4, 'e_rev_shift')} FROM p""",
    "q_cell_measures": f"""WITH {TWO_TIMES},
        p AS (
          SELECT id, split_part(flag, ':', 1) AS channel,
                 max(e_rev) FILTER (split_part(flag, ':', 2) = '1') AS e_rev_inst,
                 max(e_rev) FILTER (split_part(flag, ':', 2) = '2') AS e_rev_steady
          FROM rev GROUP BY 1, 2
        ),
        c AS (
          SELECT l_suppkey AS id, l_returnflag AS channel,
                 sum(l_quantity) FILTER (l_linenumber = 2) AS top,
                 count(*) FILTER (l_linenumber = 2) AS n
          FROM lineitem GROUP BY 1, 2
        )
        SELECT id, channel, {r('top / nullif(n, 0)', 4, 'fold_100')}, 'deactivating' AS prepulse,
               {rs(4, 'e_rev_inst', 'e_rev_steady')},
               {r('e_rev_inst - e_rev_steady', 4, 'e_rev_shift')}
        FROM c LEFT JOIN p USING (id, channel)""",
    "q_pick_ratio": f"""WITH {IV}
        SELECT id, {r("sum(v) FILTER (flag = 'N')"
                      " / nullif(count(*) FILTER (flag = 'N'), 0) * 100", 6,
                      'steady_percent')},
               nullif(count(*) FILTER (flag = 'R'), 0) AS n_r
        FROM iv GROUP BY id""",
    "q_reversal_summary": f"""WITH {REVERSAL}
        SELECT flag, count(*) AS n, {r('avg(e_rev)', 4, 'e_rev_avg')},
               {r('avg(e_rev) - stddev_samp(e_rev) / sqrt(count(e_rev))', 4, 'e_rev_lo')},
               {r('avg(e_rev) + stddev_samp(e_rev) / sqrt(count(e_rev))', 4, 'e_rev_hi')},
               count(*) - count(e_rev) AS e_rev_null
        FROM rev WHERE e_rev BETWEEN -20 AND 20 GROUP BY flag""",
    "q_box_stats": f"""
        WITH q AS (
          SELECT l_returnflag, count(l_extendedprice) AS n,
                 quantile_cont(l_extendedprice, 0.25) AS q1,
                 quantile_cont(l_extendedprice, 0.5) AS median,
                 quantile_cont(l_extendedprice, 0.75) AS q3
          FROM lineitem GROUP BY l_returnflag
        ),
        x AS (
          SELECT *, l_extendedprice BETWEEN q1 - 1.5*(q3 - q1) AND q3 + 1.5*(q3 - q1) AS inside
          FROM lineitem JOIN q USING (l_returnflag)
        )
        SELECT l_returnflag, n, {rs(4, 'q1', 'median', 'q3')},
               {r('min(l_extendedprice) FILTER (inside)', 4, 'whisker_lo')},
               {r('max(l_extendedprice) FILTER (inside)', 4, 'whisker_hi')},
               count(*) FILTER (NOT inside) AS n_outliers
        FROM x GROUP BY l_returnflag, n, q1, median, q3""",
    "q_savgol": f"""WITH {SMOOTH}
        SELECT vec_id, sample_idx, {rs(6, 'i_smooth')} FROM sm""",
    "q_savgol_sums": f"""WITH {SMOOTH}
        SELECT vec_id, sample_idx, {rs(6, 'i_smooth')} FROM sm""",
    "q_savgol_half_time": f"""WITH {SMOOTH},
        lv AS (SELECT vec_id, avg(i) AS thresh FROM tr GROUP BY vec_id),
        s AS (
          SELECT vec_id, sample_idx, sign(i_smooth - thresh) AS s
          FROM sm JOIN lv USING (vec_id)
        ),
        d AS (
          SELECT vec_id, sample_idx,
                 lead(s) OVER (PARTITION BY vec_id ORDER BY sample_idx) - s AS d FROM s
        )
        SELECT vec_id, min(sample_idx) / 100.0::DOUBLE AS t_half FROM d WHERE d <> 0
        GROUP BY vec_id""",
    "q_array_to_rows": f"""WITH {VECTOR},
        p AS (
          SELECT vec_id, sample_idx // 32 + 1 AS sweep, sample_idx % 32 // 16 AS ch,
                 sample_idx % 16 AS idx, i
          FROM tr
        )
        SELECT vec_id, sweep, idx AS sample_idx, idx * 50.0::DOUBLE / 1000 AS time_ms,
               max(i) FILTER (ch = 0) AS i, max(i) FILTER (ch = 1) AS v
        FROM p GROUP BY 1, 2, 3""",
    "q_tile_time": f"""WITH {VECTOR}
        SELECT vec_id, CAST(sample_idx // 16 + 1 AS INT) AS sweep,
               sample_idx % 16 AS sample_idx, (sample_idx % 16) * 2.0::DOUBLE / 1000 AS t, i
        FROM tr""",
    "q_biexp_grid": f"""WITH {GRID},
        s AS (
          SELECT *, sqrt(sse / (n - 5)) AS sigma,
                 -n / 2.0 * ({math.log(2 * math.pi)!r} + ln(sse / n) + 1) AS log_lik
          FROM best
        )
        SELECT vec_id, n, n - 5 AS df_residual, lrc1, lrc2, {r('a1', 5, '"A1"')},
               {r('a2', 5, '"A2"')}, {r('c', 5, '"C"')}, {rs(5, 'sse', 'sigma', 'log_lik')},
               {r('-2 * log_lik + 12', 5, 'aic')}, {r('-2 * log_lik + 6 * ln(n)', 5, 'bic')}
        FROM s""",
    "q_components": f"""WITH {PARTS}
        SELECT vec_id, component, l, {r('a', 5, '"A"')}, {r('c', 5, '"C"')},
               {rs(5, 'tau')}, speed
        FROM parts""",
    "q_spread_terms": f"""WITH {GRID}
        SELECT vec_id, {r('a1', 5, '"A1"')}, {r('a2', 5, '"A2"')}, {r('c', 5, '"C"')}
        FROM best""",
    "q_fit_curve": f"""WITH {GRID},
        tg AS (SELECT unnest(range(0, 64)) * 0.01::DOUBLE AS t)
        SELECT vec_id, {rs(5, 't')},
               {r('a1*exp(-exp(lrc1)*t) + a2*exp(-exp(lrc2)*t) + c', 5, 'fitted')}
        FROM best, tg""",
    "q_component_curves": f"""WITH {PARTS},
        tg AS (SELECT unnest(range(0, 64)) * 0.01::DOUBLE AS t)
        SELECT vec_id, speed, {rs(5, 't')}, {r('a*exp(-exp(l)*t) + c', 5, 'fitted')}
        FROM parts, tg""",
    "q_text_lines": r"""
        WITH s AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS parts FROM documents)
        SELECT doc_id, unnest(range(len(parts))) AS pos, trim(unnest(parts), ' ') AS line
        FROM s""",
    "q_label_clean": """
        SELECT p_partkey, split_part(p_name || '.001.txt', '.', 1) AS cond,
               'file_' || replace(p_name, ' ', '_') AS key,
               left(p_name || '.001.txt', length(p_name || '.001.txt') - 4) AS stem
        FROM part""",
    "q_tokens": r"""
        SELECT c_custkey, string_split(c_name, '#')[1] AS kind,
               CAST(len(string_split(c_name, '#')) AS INT) AS n_tokens,
               CAST(regexp_extract(c_name, '(\d+)', 1) AS INT) AS number,
               left(c_name, 1) AS letter
        FROM customer""",
    "q_nernst": f"""
        SELECT p_partkey,
               {r('8.314::DOUBLE * 293 / 96485 * 1000 * ln(p_size / p_retailprice)', 6,
                  'e_mv')}
        FROM part""",
}
