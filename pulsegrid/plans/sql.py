"""The SQL of each query, for DuckDB over the same tables."""

from __future__ import annotations

from pulsegrid.functions import features as phys

#: The ad hoc patterns of pattern_lookup.
LOOKED_UP = (
    {"d0": (1, 1)}, {"d2": (4, 0, 2)}, {"d0": (0, 1, 0), "d1": (1, 1, 1)}, {"d0": (1, 0), "d1": (2, 2), "d2": (4, 4)},
    {"d1": (0, 0, 0, 0, 0)}, {"d1": (0, 2, 0)},
)
RUN = "year, month, day, pass"

SERIES = """r AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, event_id AS iteration,
    year(ts) AS year, month(ts) AS month, day(ts) AS day, CAST(floor(hour(ts) / 6) AS INTEGER) AS pass,
    CAST(round(value * 100) AS BIGINT) AS err, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CAST(trunc(value / 50) AS INTEGER) AS d0, CAST(floor(hour(ts) / 8) AS INTEGER) AS d1,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS d2,
    CAST(floor(CAST(json_extract_string(props, '$.k') AS BIGINT) / 25) AS INTEGER) AS d3,
    CAST(floor(user_id / 50) AS INTEGER) AS d4, CAST(event_id % 3 AS INTEGER) AS d5, CAST(event_id % 2 AS INTEGER) AS d6
  FROM events
)"""


def _unbroken(n: int) -> str:
    ends = " AND ".join(f"lead({c}, {n - 1}) OVER o = {c}" for c in RUN.split(", "))
    return f"coalesce(lead(iteration, {n - 1}) OVER o - iteration + 1 = {n} AND {ends}, false)"


def flagged(condition: str, n: int = 3) -> str:
    """w: the series with s, lo, hi (sum, least, greatest error of the window), sk, e (last error), bad."""
    frame = f"(ORDER BY idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    return f"""{SERIES}, v AS (
  SELECT *, sum(err) OVER {frame} AS s, min(err) OVER {frame} AS lo, max(err) OVER {frame} AS hi,
    sum(k) OVER {frame} AS sk, lead(err, {n - 1}) OVER o AS e, lead(iteration, {n - 1}) OVER o AS it_e, {_unbroken(n)} AS whole
  FROM r WINDOW o AS (ORDER BY idx)
), w AS (SELECT *, coalesce(whole AND ({condition}), false) AS bad FROM v)"""


RISES = "(err > 0 AND e > err AND 100 * (e - err) / err > 50)"
CONDITIONS = {
    "windows_abs_std": "hi <= 30000 AND s > 0 AND s / 3 > 5000",
    "windows_abs_all_rows": "hi <= 30000 AND lo > 1000 AND s > 0 AND err > 0 AND s / 3 > 1000 AND s / 3 > 2000",
    "windows_rel_std": "hi <= 30000 AND s > 0 AND s / 3 > 5000",
    "windows_rel_increase_sum": f"hi <= 30000 AND s > 0 AND s > 20000 AND {RISES}",
    "windows_rel_increase_avg": f"hi <= 30000 AND s > 0 AND s / 3 > 5000 AND {RISES}",
    "windows_rel_guard40": "hi <= 20000 AND s > 0 AND s / 3 > 3000",
    "windows_theory_increase": f"hi <= 30000 AND s > 0 AND {RISES}",
    "windows_brake_specific": "hi <= 30000 AND sk > 0 AND 3600 * s / sk > 300000",
    "windows_brake_specific_increase": f"hi <= 30000 AND sk > 0 AND 3600 * s / sk > 300000 AND {RISES}",
    "windows_co2_specific": "sk > 0 AND 3600 * s / sk > 300000",
    "windows_co2_specific_increase": f"sk > 0 AND {RISES}",
    "windows_brake_specific_idle": f"hi <= 30000 AND sk - 150 > 0 AND {RISES}",
    "windows_co2_specific_idle": f"sk - 150 > 0 AND 3600 * s / (sk - 150) > 300000 AND {RISES}",
    "windows_model_error_all": "s > 0 AND abs(100 * ((sk * 100) / 3 - s / 3) / (s / 3)) > 50",
    "windows_model_error_under": "s > 0 AND 100 * ((sk * 100) / 3 - s / 3) / (s / 3) < -50",
    "windows_model_error_over": "s > 0 AND 100 * ((sk * 100) / 3 - s / 3) / (s / 3) > 50",
}
BAD = "s > 0 AND s / 3 > 6000"


def _listing(condition: str) -> str:
    return f"""WITH {flagged(condition)}
SELECT idx AS start_idx, idx + 2 AS end_idx, iteration AS start_iteration, it_e AS end_iteration,
  '<' || iteration || ',' || it_e || '>' AS label
FROM w WHERE bad"""


def mined(dims: tuple[str, ...] = ("d0", "d1", "d2"), condition: str = BAD, length: int = 3, window: int = 3, lag: int = 1,
          support: float = 0.004, within: bool = False) -> str:
    """c: the candidates with their measures."""
    seq = ", ".join(
        f"concat_ws(' ', {', '.join(f'lead({d}, {k}) OVER o' for k in range(length))}) AS p_{d}" for d in dims
    )
    names = ", ".join(f"p_{d}" for d in dims)
    used = " + ".join(f"CAST(p_{d} IS NOT NULL AS INTEGER)" for d in dims)
    ok = f"lead(idx, {length - 1}) OVER o IS NOT NULL" + (f" AND {_unbroken(length)}" if within else "")
    return f"""{flagged(condition, window)}, j AS (
  SELECT *, {seq}, sum(CAST(bad AS INTEGER)) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND {lag} FOLLOWING) AS nj,
    bool_or(bad) OVER (PARTITION BY {RUN} ORDER BY iteration RANGE BETWEEN CURRENT ROW AND {lag} FOLLOWING) AS cand, {ok} AS fits
  FROM w WINDOW o AS (ORDER BY idx)
), n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS a FROM w),
g AS (
  SELECT {names}, {used} AS n_dims, CAST(count(*) AS BIGINT) AS cnt, CAST(sum(nj) AS BIGINT) AS join_cnt,
    CAST(sum(CAST(nj > 0 AS INTEGER)) AS BIGINT) AS distinct_join, bool_or(cand) AS cand
  FROM j WHERE fits GROUP BY CUBE ({names})
), c AS (
  SELECT {names}, CAST({length} AS INTEGER) AS pattern_len, n_dims, cnt, join_cnt, distinct_join,
    CAST(cnt AS DOUBLE) / CAST(n AS DOUBLE) AS support,
    CAST(n * join_cnt AS DOUBLE) / (CAST(cnt AS DOUBLE) * a) AS k_value,
    distinct_join / CAST(cnt AS DOUBLE) AS confidence
  FROM g, n WHERE cand AND n_dims > 0 AND CAST(cnt AS DOUBLE) / CAST(n AS DOUBLE) >= {support}
)"""


def _patterns(k: float = 1.0, more: str = "", **how) -> str:
    return f"WITH {mined(**how)} SELECT *{more} FROM c WHERE k_value > {k}"


WIDE = ("d0", "d1", "d2", "d3", "d4")
SEVEN = (*WIDE, "d5", "d6")
RANK = "k_value DESC, join_cnt DESC, pattern_len, p_d0 NULLS FIRST, p_d1 NULLS FIRST, p_d2 NULLS FIRST"


def _top(n: int) -> str:
    return f"{_patterns()} ORDER BY {RANK} LIMIT {n}"


def _log(n: int, lag: int = 1) -> str:
    same = " AND ".join(f"(t.p_{d} IS NULL OR t.p_{d} = j.p_{d})" for d in ("d0", "d1", "d2"))
    return f"""{mined(lag=lag)}, t AS (SELECT * FROM c WHERE k_value > 1 ORDER BY {RANK} LIMIT {n}),
log AS (SELECT t.p_d0, t.p_d1, t.p_d2, t.pattern_len, j.idx AS start_idx, t.k_value, j.bad
  FROM t JOIN j ON {same} WHERE j.fits AND j.nj > 0)"""


VALUE = "CASE WHEN err / 100 - 20 < 0 THEN 0 ELSE err / 100 - 20 END"
POINTS = f"{flagged(BAD)}, p AS (SELECT DISTINCT idx + x.n AS idx FROM w, (VALUES (0), (1), (2), (3), (4)) x(n) WHERE bad)"
ENGINE = f"""{SERIES}, m AS (
  SELECT idx, d2, (err % 400) / 10.0::DOUBLE + 273.0::DOUBLE AS intake_k, (100 + k / 2.0::DOUBLE) * 1000.0::DOUBLE AS intake_pa,
    200 + (err % 1000) / 5.0::DOUBLE AS air, 5 + k / 20.0::DOUBLE AS fuel, 10 + (err % 97) / 9.0::DOUBLE AS egr,
    60 + k / 2.0::DOUBLE AS rail, 800.0::DOUBLE + (err % 1500) AS rpm, 0.01::DOUBLE + (err % 713) / 5000.0::DOUBLE AS nox_gps
  FROM r
)"""


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


_T_PEAK = f"intake_k * {_num((phys.opening_volume() / phys.CLEARANCE) ** (phys.POLYTROPIC - 1))}"
_RATIO = f"({_num(phys.STOICHIOMETRIC_AIR)} / (air / fuel))"
_X_EXH = f"(({_num(0.21)} * air - {_num(568 / 167 * 0.98)} * fuel) / (air + fuel - egr))"
_RATE = f"({_num(0.86 * 7 * 3.141592653589793 * 0.00018**2 / 4)} * sqrt({_num(1744.0)} * (rail * 1e6::DOUBLE - intake_pa)))"
_AIR = f"({_num(phys.STOICHIOMETRIC_AIR * 190.649)} / ({_RATIO} * {_num(28.84)}))"
_N2, _O2 = f"({_num(0.79)} * {_AIR})", f"(({_AIR} - {_num(phys.AIR_MOLES_NEEDED)}) * {_num(0.21)})"


def _mix(c: tuple[float, ...]) -> str:
    fixed = phys.CO2_MOLES * c[0] + phys.WATER_MOLES * c[1]
    return f"(({_num(fixed)} + {_N2} * {_num(c[2])} + {_O2} * {_num(c[3])}) * {_num(phys.GAS_CONSTANT)})"


_LIN, _QUAD = _mix(phys.HEAT_LINEAR), _mix(phys.HEAT_QUADRATIC)
_ENERGY = _num(2.0 * phys.HEATING_VALUE * phys.FUEL_MOLE)
_FLAME = f"((sqrt({_LIN} * {_LIN} + {_QUAD} * {_ENERGY}) - {_LIN}) / {_QUAD} + {_T_PEAK})"
_INDEX = "(nox_gps / (fuel / 3600.0::DOUBLE))"
_NOX = f"({_INDEX} / 38.0::DOUBLE * fuel)"
_PRODUCTS = f"(({_N2} + {_O2} + {_num(phys.CO2_MOLES + phys.WATER_MOLES)}) * fuel / {_num(phys.FUEL_MOLE)})"

#: Two-sided p of the correlation under Student's t: with t = sqrt(v) tan(x) its density is a power of a cosine, here
#: summed by Simpson's rule (the trapezoid rule at these steps is off by 5e-7, which six digits show).
_R2 = "least(1, corr(err, k * 100) * corr(err, k * 100))"
_V = "(count(*) - 2)::DOUBLE"
_FROM = f"atan(sqrt({_R2} / greatest(1 - {_R2}, 1e-300)))"
_STEP = f"((pi() / 2 - {_FROM}) / 20000)"
_P_VALUE = f"""CASE WHEN count(*) <= 2 THEN 'nan'::DOUBLE WHEN {_R2} >= 1 THEN 0 ELSE least(1, 2 * {_STEP} * list_sum(list_transform(range(20001),
  lambda i: exp(({_V} - 1) * ln(greatest(cos({_FROM} + i * {_STEP}), 1e-300)) + lgamma(({_V} + 1) / 2) - lgamma({_V} / 2) - ln(pi()) / 2)
    * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 3))) END"""

ORACLES: dict[str, str] = {name: _listing(c) for name, c in CONDITIONS.items()}
ORACLES |= {
    "discretize_width": f"WITH {SERIES} SELECT idx, CAST(trunc(({VALUE} - -10) / 7.5::DOUBLE) AS INTEGER) AS code FROM r",
    "discretize_explicit": f"""WITH {SERIES}, x AS (SELECT idx, {VALUE} AS v FROM r)
SELECT idx, CASE WHEN v < 1 THEN 0 WHEN v < 40 THEN 1 WHEN v < 80 THEN 2 ELSE 3 END AS code FROM x""",
    "discretize_hybrid": f"""WITH {SERIES}, x AS (SELECT idx, {VALUE} AS v FROM r)
SELECT idx, CASE WHEN v < 30 THEN CAST(trunc(v / 12) AS INTEGER) WHEN v < 45 THEN 3 WHEN v < 90 THEN 4
  ELSE CAST(trunc((v - 90) / 12) AS INTEGER) + 2 + 3 END AS code FROM x""",
    "discretize_text": f"WITH {SERIES} SELECT idx, CAST(err AS VARCHAR) AS code FROM r",
    "window_counts_by_length": " UNION ALL ".join(
        f"SELECT {n} AS length, n_windows FROM (WITH {flagged(f'hi <= 30000 AND s > 0 AND s / {n} > 5000', n)} "
        "SELECT CAST(count(*) FILTER (bad) AS BIGINT) AS n_windows FROM w)"
        for n in (2, 3, 5, 10)
    ),
    "candidate_starts": f"""WITH {flagged(BAD)}, c AS (
  SELECT idx, iteration, bool_or(bad) OVER (PARTITION BY {RUN} ORDER BY iteration RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS cand FROM w
) SELECT idx, iteration FROM c WHERE cand""",
    "transitions": f"""WITH {SERIES}, t AS (
  SELECT idx, lead(idx) OVER o AS nx, d0 || '-' || lead(d0) OVER o AS d0, d1 || '-' || lead(d1) OVER o AS d1, d2 || '-' || lead(d2) OVER o AS d2
  FROM r WINDOW o AS (ORDER BY idx)
), u AS (UNPIVOT (SELECT * FROM t WHERE nx IS NOT NULL) ON d0, d1, d2 INTO NAME dimension VALUE transition)
SELECT dimension, transition, count(*) AS cnt, min(idx) AS first_idx, max(idx) AS last_idx FROM u GROUP BY 1, 2""",
    "transition_index": f"""WITH {SERIES}, t AS (SELECT idx, d2 || '-' || lead(d2) OVER (ORDER BY idx) AS transition FROM r)
SELECT transition, idx FROM t WHERE transition IS NOT NULL""",
    "slice_rows": f"WITH {SERIES} SELECT idx, iteration, err FROM r WHERE idx BETWEEN 500 AND 559",
    "patterns_cube": _patterns(),
    "patterns_levelwise": _patterns(dims=("d0", "d1", "d2", "d3", "d4")),
    "patterns_bounded": _patterns(dims=SEVEN),
    "patterns_topk_bounded": f"""{_patterns(dims=SEVEN)}
ORDER BY k_value DESC, join_cnt DESC, pattern_len, {", ".join(f"p_{d} NULLS FIRST" for d in SEVEN)} LIMIT 100""",
    "patterns_len_trie": " UNION ALL ".join(f"SELECT * FROM ({_patterns(dims=WIDE, length=n)})" for n in (2, 3, 4)),
    "singleton_patterns": f"WITH {mined()} SELECT * FROM c WHERE n_dims = 1",
    "patterns_topk20": _top(20),
    "patterns_topk100": _top(100),
    "patterns_top4": _top(4),
    "patterns_ranked_k": f"{_patterns()} ORDER BY {RANK}",
    "patterns_ranked_join": f"{_patterns()} ORDER BY join_cnt DESC, k_value DESC",
    "patterns_len_sweep": " UNION ALL ".join(f"SELECT * FROM ({_patterns(length=n)})" for n in (2, 3, 4)),
    "patterns_lag_sweep": " UNION ALL ".join(f"SELECT * FROM ({_patterns(lag=n, more=f', {n} AS lag')})" for n in (0, 1, 3)),
    "patterns_short_lag3": _patterns(1.2, condition="s > 0 AND s / 2 > 6000", window=2, length=2, lag=3, support=0.002),
    "patterns_within_run": _patterns(within=True),
    "patterns_error_type": " UNION ALL ".join(
        f"SELECT *, '{t}' AS error_type FROM ({_patterns(condition=CONDITIONS[f'windows_model_error_{t}'])})" for t in ("all", "under", "over")
    ),
    "crossk_avg_stddev": f"""WITH {mined()} SELECT pattern_len, count(*) AS n_candidates, round(avg(k_value), 6) AS avg_k,
  round(stddev_pop(k_value), 6) AS std_k FROM c GROUP BY pattern_len""",
    "pattern_sizes": f"""WITH {mined()} SELECT pattern_len, n_dims, count(*) AS n_candidates,
  CAST(count(*) FILTER (k_value > 1) AS BIGINT) AS n_kept FROM c GROUP BY pattern_len, n_dims""",
    "pattern_texts": f"""WITH {mined()} SELECT concat_ws(chr(10), 'd0:' || chr(9) || p_d0, 'd1:' || chr(9) || p_d1, 'd2:' || chr(9) || p_d2)
  AS pattern, cnt, k_value FROM c WHERE k_value > 1""",
    "pattern_occurrences": f"WITH {_log(20)} SELECT p_d0, p_d1, p_d2, pattern_len, start_idx, k_value FROM log",
    "pattern_window_pairs": f"""WITH {_log(20, 3)} SELECT p_d0, p_d1, p_d2, pattern_len, start_idx, k_value, w.idx AS window_start
FROM log JOIN w ON w.bad AND w.idx BETWEEN start_idx AND start_idx + 3""",
    "pattern_lookup": f"WITH {SERIES} " + " UNION ALL ".join(
        f"SELECT {n} AS pattern, count(*) AS cnt FROM (SELECT {', '.join(f'lead({d}, {k}) OVER o = {c} AS {d}_{k}' for d, codes in p.items() for k, c in enumerate(codes))}"
        f" FROM r WINDOW o AS (ORDER BY idx)) WHERE {' AND '.join(f'{d}_{k}' for d, codes in p.items() for k in range(len(codes)))}"
        for n, p in enumerate(LOOKED_UP)
    ),
    "pattern_points": f"WITH {POINTS} SELECT idx FROM p",
    "pattern_points_complement": f"WITH {POINTS} SELECT idx FROM r WHERE idx NOT IN (SELECT idx FROM p)",
    "pattern_points_after": f"""WITH {_log(4)}, s AS (SELECT * FROM log WHERE bad),
l AS (SELECT p_d0, p_d1, p_d2, max(start_idx) AS last FROM s GROUP BY 1, 2, 3)
SELECT s.p_d0, s.p_d1, s.p_d2, s.start_idx + x.n AS idx FROM s, l, (VALUES (0), (1), (2)) x(n)
WHERE s.p_d0 IS NOT DISTINCT FROM l.p_d0 AND s.p_d1 IS NOT DISTINCT FROM l.p_d1 AND s.p_d2 IS NOT DISTINCT FROM l.p_d2
  AND s.start_idx + x.n < l.last AND NOT EXISTS (SELECT 1 FROM s t WHERE t.start_idx = s.start_idx + x.n
    AND t.p_d0 IS NOT DISTINCT FROM s.p_d0 AND t.p_d1 IS NOT DISTINCT FROM s.p_d1 AND t.p_d2 IS NOT DISTINCT FROM s.p_d2)""",
    "lead_target": f"WITH {SERIES} SELECT idx, err, coalesce(lead(err) OVER (ORDER BY idx), err) AS err_lead FROM r",
    "divergence_split": f"""WITH {SERIES} SELECT CASE WHEN k * 100 >= err THEN 'positive' ELSE 'negative' END AS label, count(*) AS n
FROM r GROUP BY 1""",
    "features_peak": f"""WITH {ENGINE} SELECT idx, round({_T_PEAK}, 6) AS t_peak,
  round(pow({_T_PEAK} / intake_k, {_num(phys.POLYTROPIC / (phys.POLYTROPIC - 1))}) * intake_pa, 3) AS p_peak, round({_RATIO}, 6) AS ratio FROM m""",
    "features_oxygen": f"""WITH {ENGINE} SELECT idx, round({_X_EXH}, 6) AS x_exh,
  round(({_num(0.21)} * air + {_X_EXH} * egr) / (air + egr + fuel), 6) AS x_o2 FROM m""",
    "features_injection": f"WITH {ENGINE} SELECT idx, round({_RATE}, 8) AS rate, round(fuel / ({_RATE} * 30.0::DOUBLE * rpm), 8) AS t_inj FROM m",
    "features_flame": f"WITH {ENGINE} SELECT idx, round({_FLAME}, 5) AS t_flame, round({_INDEX}, 6) AS ei_nox FROM m",
    "features_ppm": f"WITH {ENGINE} SELECT idx, round({_NOX} / ({_PRODUCTS} + {_NOX}) * 1e6::DOUBLE, 5) AS ppm FROM m",
    "prediction_scores": f"""WITH {SERIES} SELECT d2, count(*) AS n, round(corr(err, k * 100) * corr(err, k * 100), 6) AS r2,
  round(sqrt(avg(CAST((err - k * 100) * (err - k * 100) AS DOUBLE))), 6) AS rmse, round(avg(CAST(abs(err - k * 100) AS DOUBLE)), 6) AS mae, round({_P_VALUE}, 6) AS p_value FROM r GROUP BY d2""",
    "pattern_log_filter": f"""WITH {_log(20)}, b AS (
  SELECT k_value, p_d0, p_d1, p_d2, count(*) AS n_starts FROM log GROUP BY ALL
), c2 AS (
  SELECT row_number() OVER (ORDER BY k_value DESC, p_d0 NULLS FIRST, p_d1 NULLS FIRST, p_d2 NULLS FIRST) - 1 AS block, k_value, n_starts,
    sum(n_starts) OVER () + count(*) OVER () AS lines FROM b
) SELECT block, k_value, n_starts FROM c2 WHERE k_value >= 1.4 AND n_starts >= 0.05::DOUBLE * lines""",
    "pattern_reports": f"""WITH {mined()} SELECT concat_ws(chr(10), 'd0:' || chr(9) || p_d0, 'd1:' || chr(9) || p_d1, 'd2:' || chr(9) || p_d2,
  printf('count %d, support %.6f', cnt, round(support, 6)), printf('windows %d, support %.6f', a, round(CAST(a AS DOUBLE) / n, 6)),
  printf('joint %d (%d distinct), support %.6f', join_cnt, distinct_join, round(CAST(join_cnt AS DOUBLE) / n, 6)),
  printf('cross-K %.6f, confidence %.6f', round(k_value, 6), round(confidence, 6))) AS report, cnt FROM c, n WHERE k_value > 1""",
    "sample_windows": f"""WITH {SERIES}, s AS (SELECT idx, (SELECT count(*) FROM r) AS n FROM r),
a AS (SELECT idx, 5 AS l FROM s WHERE idx + 5 <= n ORDER BY md5('1:' || idx), idx LIMIT 10),
b AS (SELECT idx, 15 AS l FROM s WHERE idx + 15 <= n ORDER BY md5('2:' || idx), idx LIMIT 10)
SELECT idx AS start_idx, idx + l - 1 AS end_idx, l AS length FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "sample_flagged_windows": f"""WITH {flagged(BAD)}, l AS (
  SELECT idx AS start_idx, idx + 2 AS end_idx, iteration AS start_iteration, it_e AS end_iteration,
    '<' || iteration || ',' || it_e || '>' AS label, row_number() OVER (ORDER BY idx) - 1 AS k FROM w WHERE bad
) SELECT start_idx, end_idx, start_iteration, end_iteration, label FROM l
WHERE k IN (SELECT ('0x' || substr(md5('3:' || i), 1, 8))::BIGINT % (SELECT count(*) FROM l) FROM range(10) t(i))""",
    "sample_other_rows": f"""WITH {POINTS}, o AS (SELECT idx FROM r WHERE idx NOT IN (SELECT idx FROM p))
SELECT idx FROM o ORDER BY md5('4:' || idx), idx LIMIT 30000""",
    "pattern_min_merge": f"""WITH {POINTS} SELECT r.idx, CASE WHEN p.idx IS NULL THEN k * 100 ELSE least(k * 100, err) END AS predicted
FROM r LEFT JOIN p USING (idx)""",
    "predictions_recombined": f"WITH {SERIES} SELECT idx, least(k * 100, err) AS predicted FROM r",
}
