"""Report texts against the SQL's rounding."""

import duckdb

from pulsegrid.operators import patterns

ROWS = 6_000_000


def wanted(counts, windows):
    return duckdb.sql(
        f"""SELECT concat_ws(chr(10), 'a:' || chr(9) || '0', printf('count %d, support %.6f', n, round(n / {ROWS}::DOUBLE, 6)),
  printf('windows %d, support %.6f', {windows}, round(CAST({windows} AS DOUBLE) / {ROWS}, 6)), printf('joint %d (%d distinct), support %.6f', n, n, round(CAST(n AS DOUBLE) / {ROWS}, 6)),
  printf('cross-K %.6f, confidence %.6f', round(n / 640::DOUBLE, 6), round(n / 1920::DOUBLE, 6))) FROM (SELECT unnest({counts}::BIGINT[]) AS n) ORDER BY n"""
    ).fetchall()


def test_halves_are_rounded_as_the_sql_does(spark):
    """n / 6e6 ends in a half of the sixth digit for n = 6 m + 3; times 1e6, some of these doubles lie just below it."""
    counts = sorted({747, 753, 1467, 41, 323, 641, 651, *range(3, 20_000, 6)})
    for windows in (747, 1479):
        df = spark.createDataFrame([(n,) for n in counts], "cnt long").selectExpr(
            "'0' AS p_a", "cnt", f"cnt / {ROWS}.0D AS support", "cnt AS join_cnt", "cnt AS distinct_join", "cnt / 640.0D AS k_value", "cnt / 1920.0D AS confidence"
        )
        got = patterns.report(df, ROWS, windows).orderBy("cnt").select("report").collect()
        assert [r.report for r in got] == [r for (r,) in wanted(counts, windows)]
