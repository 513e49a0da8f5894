"""SQL for the results of ``workload.queries``, written on its own terms:
calendars by ``generate_series``, neighbours by ``IGNORE NULLS`` windows and
autocorrelation by a join, where the Spark side does none of these."""

REF = "DATE '1995-01-01' AND DATE '1999-12-31'"

ORDERS = """orders_by_day AS (
    SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS prio, o_custkey, o_orderstatus,
           o_totalprice, CASE WHEN o_orderstatus = 'F' THEN ln(o_totalprice) END AS v
    FROM orders)"""
DAILY = ORDERS + """, series AS (SELECT 0 AS k, d, avg(v) AS v FROM orders_by_day GROUP BY d)"""
PRIORITY = ORDERS + """, series AS (
    SELECT prio AS k, d, avg(v) AS v FROM orders_by_day GROUP BY prio, d)"""
NATION = ORDERS + """, series AS (
    SELECT CAST(c_nationkey AS BIGINT) AS k, d, avg(v) AS v
    FROM orders_by_day JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
NATION_GRID = ORDERS + """, grid AS (
    SELECT d AS date, CAST(25 + 5 * floor(c_nationkey / 5) AS DOUBLE) AS lat,
           CAST(110 + 5 * (c_nationkey % 5) AS DOUBLE) AS lon, avg(v) AS sst
    FROM orders_by_day JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""
SUPPLIER_GRID = """grid AS (
    SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 25 * CAST(0.5 AS DOUBLE) + 30 AS lat,
           floor(l_suppkey / 25) % 40 * CAST(0.5 AS DOUBLE) + 115 AS lon,
           avg(CASE WHEN l_quantity <= 40 THEN ln(l_extendedprice) END) AS sst
    FROM lineitem GROUP BY 1, 2, 3)"""
SUPPLIER_BOX = SUPPLIER_GRID + """, box AS (
    SELECT *, greatest(cos(radians(lat)), 0) AS w FROM grid
    WHERE lat BETWEEN 31 AND 39 AND lon BETWEEN 115 AND 127),
full_weight AS (
    SELECT (SELECT sum(greatest(cos(radians(lat)), 0)) FROM (SELECT DISTINCT lat FROM box))
         * (SELECT count(DISTINCT lon) FROM box) AS fw),
coverage AS (
    SELECT date, sum(w * sst) / nullif(sum(CASE WHEN sst IS NOT NULL THEN w END), 0) AS mean,
           coalesce(sum(CASE WHEN sst IS NOT NULL THEN w END), 0) AS vw, any_value(fw) AS fw
    FROM box, full_weight GROUP BY date)"""
BOX_SERIES = SUPPLIER_BOX + """, series AS (
    SELECT 0 AS k, date AS d, CASE WHEN vw / fw >= 0.15 THEN mean END AS v FROM coverage)"""
REGION_TABLE = """boxes AS (
    SELECT r_name AS region, 3 * r_regionkey + 24 AS s, 3 * r_regionkey + 36 AS n,
           2 * r_regionkey + 109 AS w, 2 * r_regionkey + 120 AS e
    FROM region)"""
REGIONS_DAILY = NATION_GRID + ", " + REGION_TABLE + """, cells AS (
    SELECT DISTINCT region, lat, lon FROM (
        SELECT DISTINCT CAST(25 + 5 * floor(c_nationkey / 5) AS DOUBLE) AS lat,
               CAST(110 + 5 * (c_nationkey % 5) AS DOUBLE) AS lon FROM customer)
    JOIN boxes ON lat BETWEEN s AND n AND lon BETWEEN w AND e),
total AS (
    SELECT a.region, sw * nlon AS fw
    FROM (SELECT region, sum(cos(radians(lat))) AS sw
          FROM (SELECT DISTINCT region, lat FROM cells) GROUP BY region) a
    JOIN (SELECT region, count(DISTINCT lon) AS nlon FROM cells GROUP BY region) b
      ON a.region = b.region),
summed AS (
    SELECT region, date, sum(cos(radians(lat)) * sst) AS t,
           sum(CASE WHEN sst IS NOT NULL THEN cos(radians(lat)) END) AS vw
    FROM grid JOIN boxes ON lat BETWEEN s AND n AND lon BETWEEN w AND e
    GROUP BY region, date),
regions_daily AS (
    SELECT d.region, d.date, CASE WHEN vw / fw >= 0.2 THEN t / vw END AS mean
    FROM summed d JOIN total ON total.region = d.region)"""
PAIRS = """pairs AS (
    SELECT event_type,
           CASE WHEN hour(ts) = 1 THEN NULL WHEN hour(ts) = 2 THEN CAST('Infinity' AS DOUBLE)
                ELSE ln(value + 1) END AS observed,
           CASE WHEN hour(ts) = 3 THEN CAST('NaN' AS DOUBLE)
                WHEN hour(ts) = 4 THEN CAST('-Infinity' AS DOUBLE)
                ELSE ln(value * 2 + 3) END AS predicted
    FROM events),
finite AS (SELECT * FROM pairs WHERE isfinite(observed) AND isfinite(predicted))"""

CALENDAR = """calendar AS (
    SELECT k, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
    FROM (SELECT k, min(d) AS lo, max(d) AS hi FROM series GROUP BY k)),
observed AS (SELECT c.k, c.d, s.v FROM calendar c LEFT JOIN series s ON s.k = c.k AND s.d = c.d)"""


def filled(limit: int) -> str:
    """CTEs from ``series(k, d, v)`` to ``filled(k, d, v, interpolated)``."""
    return CALENDAR + f""", around AS (
    SELECT k, d, v,
           last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER before AS pd,
           last_value(v IGNORE NULLS) OVER before AS pv,
           first_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER after AS nd,
           first_value(v IGNORE NULLS) OVER after AS nv
    FROM observed
    WINDOW before AS (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           after AS (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
    SELECT k, d,
           CASE WHEN v IS NOT NULL THEN v
                WHEN nd IS NOT NULL AND date_diff('day', pd, d) <= {limit}
                THEN pv + (nv - pv) * date_diff('day', pd, d) / date_diff('day', pd, nd) END AS v,
           v IS NULL AND nd IS NOT NULL AND pd IS NOT NULL
               AND date_diff('day', pd, d) <= {limit} AS interpolated
    FROM around)"""


def anomalies(limit: int = 3, season: str = "strftime(d, '%m-%d')", period: str = REF) -> str:
    """CTEs up to ``anomaly(k, d, v, interpolated, c, a)``."""
    return filled(limit) + f""", cycle AS (
    SELECT k, {season} AS s, avg(v) AS c FROM filled
    WHERE d BETWEEN {period} AND v IS NOT NULL GROUP BY 1, 2),
anomaly AS (
    SELECT f.k, f.d, f.v, f.interpolated, y.c, f.v - y.c AS a
    FROM filled f LEFT JOIN cycle y ON y.k = f.k AND y.s = {season.replace('(d,', '(f.d,').replace('(d)', '(f.d)')})"""


def forecast(fraction: str = "0.2") -> str:
    """CTEs from ``anomaly`` to ``test`` and ``meta``."""
    return f"""ordered AS (
    SELECT k, d, a, lag(a) OVER (PARTITION BY k ORDER BY d) AS p,
           row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS pos,
           count(*) OVER (PARTITION BY k) AS n
    FROM anomaly),
marked AS (
    SELECT k, d, a, p, p - a AS e,
           pos >= greatest(1, floor(n * (1 - CAST({fraction} AS DOUBLE))))
           AND a IS NOT NULL AND p IS NOT NULL AS scored FROM ordered),
test AS (SELECT * FROM marked WHERE scored),
meta AS (
    SELECT k, 'one-day persistence' AS baseline, 'sst anomaly (degrees Celsius)' AS target,
           'final chronological fraction' AS split_method,
           CAST({fraction} AS DOUBLE) AS test_fraction,
           strftime(min(d) FILTER (scored), '%Y-%m-%d') AS test_start,
           strftime(max(d) FILTER (scored), '%Y-%m-%d') AS test_end,
           CAST(42 AS BIGINT) AS random_seed, count(*) FILTER (scored) AS n,
           round(avg(abs(e)) FILTER (scored), 6) AS mae,
           round(sqrt(avg(e * e) FILTER (scored)), 6) AS rmse
    FROM marked GROUP BY k)"""


META = (
    "baseline, target, split_method, test_fraction, test_start, test_end, random_seed, n, mae, rmse"
)
TABLE = """d AS date, round(v, 6) AS sst_celsius, interpolated AS is_interpolated,
    round(c, 6) AS climatology_celsius, round(a, 6) AS anomaly_celsius"""
PREDICTIONS = """d AS date, round(a, 6) AS observed_anomaly_celsius,
    round(p, 6) AS predicted_anomaly_celsius, round(e, 6) AS error_celsius"""
FILLED = "d AS date, round(v, 6) AS sst_celsius, interpolated AS is_interpolated"


def autocorrelation(longest: int) -> str:
    """CTEs from ``anomaly`` to ``acf(k, lag, r, n)`` by a join on positions."""
    return f"""dev AS (
    SELECT k, a - avg(a) OVER (PARTITION BY k) AS c,
           row_number() OVER (PARTITION BY k ORDER BY d) AS pos, count(*) OVER (PARTITION BY k) AS n
    FROM anomaly WHERE a IS NOT NULL),
shifted AS (SELECT k, c, unnest(range(1, {longest} + 1)) AS lag, pos, n FROM dev),
acf AS (
    SELECT x.k, x.lag, x.n, sum(x.c * y.c) / nullif(any_value(z.s), 0) AS r
    FROM shifted x JOIN dev y ON y.k = x.k AND y.pos = x.pos + x.lag
    JOIN (SELECT k, sum(c * c) AS s FROM dev GROUP BY k) z ON z.k = x.k
    WHERE x.lag <= x.n // 2 - 1
    GROUP BY x.k, x.lag, x.n)"""


BAND = """round(1.959963984540054 * sqrt((1 + 2 * CASE WHEN lag = 1 THEN 0 ELSE sum(r * r) OVER (
    PARTITION BY k ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END) / n), 6)
    AS half_width"""


def histogram(source: str, bins: int) -> str:
    """CTEs from values ``source(k, x)`` to ``bars(k, bin, lo, hi, n)``."""
    return f"""ends AS (
    SELECT k, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
           CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
    FROM {source} WHERE x IS NOT NULL GROUP BY k),
edges AS (
    SELECT k, i AS bin, lo + i * ((hi - lo) / {bins}) AS l,
           CASE WHEN i = {bins} - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS r
    FROM ends, range({bins}) t(i)),
bars AS (
    SELECT e.k, e.bin, e.l, e.r, count(s.x) AS n
    FROM edges e LEFT JOIN {source} s ON s.k = e.k
      AND s.x >= e.l AND (s.x < e.r OR (e.bin = {bins} - 1 AND s.x <= e.r))
    GROUP BY e.k, e.bin, e.l, e.r)"""


def density(source: str) -> str:
    """CTEs from values ``source(k, x)`` to ``curve(k, point, gx, y)``."""
    return f"""shape AS (
    SELECT k, min(x) AS lo, max(x) AS hi, count(x) AS n,
           stddev_samp(x) * pow(count(x), -0.2) AS h
    FROM {source} WHERE x IS NOT NULL GROUP BY k),
places AS (SELECT *, i AS point, lo + i * ((hi - lo) / 199) AS gx FROM shape, range(200) t(i)),
curve AS (
    SELECT p.k, p.point, p.gx,
           (any_value(hi) - any_value(lo)) / 50 / (any_value(h) * sqrt(2 * pi()))
           * sum(exp(-0.5 * pow((p.gx - s.x) / p.h, 2))) AS y
    FROM places p JOIN {source} s ON s.k = p.k WHERE s.x IS NOT NULL
    GROUP BY p.k, p.point, p.gx)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


WANTED = """wanted AS (
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi
          FROM orders)),
stored AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"""
URL = """'https://www.ncei.noaa.gov/data/sea-surface-temperature-optimum-interpolation/v2.1/access/avhrr/'
    || strftime(date, '%Y%m') || '/oisst-avhrr-v02r01.' || strftime(date, '%Y%m%d') || '.nc' AS url"""
DESTINATION = """'raw/' || strftime(date, '%Y%m') || '/oisst-avhrr-v02r01.'
    || strftime(date, '%Y%m%d') || '.nc' AS destination"""


def _counts(downloaded: str, skipped: str, planned: str) -> str:
    return _with(WANTED) + f"""SELECT a.action, CAST(CASE a.action WHEN 'downloaded' THEN {downloaded}
    WHEN 'skipped' THEN {skipped} ELSE {planned} END AS BIGINT) AS n
FROM (VALUES ('downloaded'), ('skipped'), ('planned')) a(action)"""


ALL_DAYS = "(SELECT count(*) FROM wanted)"
STORED_DAYS = "(SELECT count(*) FROM wanted SEMI JOIN stored USING (date))"


def oracle_sql() -> dict[str, str]:
    sql = {
        "gen_calendar": _with(WANTED) + "SELECT date FROM wanted",
        "gen_file_keys": _with(WANTED) + f"SELECT date, {URL}, {DESTINATION} FROM stored",
        "gen_parse_dates": """
            SELECT text, CASE WHEN regexp_full_match(text, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')
                              THEN TRY_CAST(text AS DATE) END AS parsed
            FROM (SELECT DISTINCT unnest([
                strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%-m-%-d'),
                strftime(o_orderdate, '%Y%m%d'), strftime(o_orderdate, '%d/%m/%Y'),
                strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y-%m-31')]) AS text
                FROM orders)""",
        "ingest_plan": _with(WANTED) + f"""SELECT w.date, {URL.replace('(date', '(w.date')},
            {DESTINATION.replace('(date', '(w.date')},
            CASE WHEN s.date IS NULL THEN 'downloaded' ELSE 'skipped' END AS action
            FROM wanted w LEFT JOIN stored s ON s.date = w.date""",
        "ingest_counts": _counts(f"{ALL_DAYS} - {STORED_DAYS}", STORED_DAYS, "0"),
        "ingest_counts_overwrite": _counts(ALL_DAYS, "0", "0"),
        "ingest_counts_dry_run": _counts("0", "0", ALL_DAYS),
        "ingest_missing": _with(WANTED)
        + "SELECT date FROM wanted WHERE date NOT IN (SELECT date FROM stored)",
        "region_valid": """
            SELECT c_custkey, s >= -90 AND s < n AND n <= 90 AND w >= -180 AND w < e AND e <= 360
                   AS valid
            FROM (SELECT c_custkey, c_acctbal / 80 - 40 AS s, c_acctbal / 100 + c_nationkey - 30 AS n,
                         c_acctbal / 20 - 150 AS w, c_acctbal / 25 AS e FROM customer)""",
        "lon_convert": """
            SELECT c_custkey, round(((v % 360) + 360) % 360, 6) AS lon_0_360,
                   round((((v + 180) % 360) + 360) % 360 - 180, 6) AS lon_180_180
            FROM (SELECT c_custkey, c_acctbal / 10 - 300 AS v FROM customer)""",
        "grid_labels": _with(SUPPLIER_GRID) + """
            SELECT round((SELECT sum(cos(radians(lat))) FROM (SELECT DISTINCT lat FROM grid))
                         * (SELECT count(DISTINCT lon) FROM grid), 6) AS full_weight,
                   (SELECT count(DISTINCT lat) * count(DISTINCT lon) FROM grid) AS cell_count,
                   (SELECT min(lon) >= 0 FROM grid) AS nonnegative_lon""",
        "region_box": _with(NATION_GRID) + """SELECT date, lat, lon, round(sst, 6) AS sst
            FROM grid WHERE lat BETWEEN 29 AND 41 AND lon BETWEEN 114 AND 126""",
        "region_box_lon180": _with(NATION_GRID) + """
            SELECT date, lat, lon - 240 AS lon, round(sst, 6) AS sst
            FROM grid WHERE lat BETWEEN 29 AND 41 AND lon - 240 BETWEEN 234 - 360 AND 246 - 360""",
        "regions_join": _with(NATION_GRID, REGION_TABLE) + """
            SELECT region, date, lat, lon, round(sst, 6) AS sst
            FROM grid JOIN boxes ON lat BETWEEN s AND n AND lon BETWEEN w AND e""",
        "regions_mean": _with(REGIONS_DAILY) + """SELECT region, date, round(mean, 6) AS sst
            FROM regions_daily""",
        "region_wrap": _with(NATION_GRID) + """
            SELECT date, lat, CASE WHEN lon + 60 >= 180 THEN lon - 300 ELSE lon + 60 END AS lon,
                   round(sst, 6) AS sst
            FROM grid WHERE lat BETWEEN 29 AND 41 AND lon + 60 BETWEEN 174 AND 186""",
        "regions_quarantined": _with(NATION_GRID) + """, boxes AS (
                SELECT c_custkey, c_acctbal / 80 - 40 AS s, c_acctbal / 100 + c_nationkey - 30 AS n,
                       c_acctbal / 20 - 150 AS w, c_acctbal / 25 AS e FROM customer),
            turned AS (SELECT *, ((w % 360) + 360) % 360 AS w0, ((e % 360) + 360) % 360 AS e0 FROM boxes),
            cells AS (SELECT DISTINCT 25 + 5 * floor(c_nationkey / 5) AS lat, 110 + 5 * (c_nationkey % 5) AS lon
                      FROM customer),
            met AS (SELECT DISTINCT c_custkey FROM turned
                    JOIN cells ON lat BETWEEN s AND n AND lon BETWEEN w0 AND e0)
            SELECT c_custkey, CASE
                WHEN NOT (s >= -90 AND s < n AND n <= 90 AND w >= -180 AND w < e AND e <= 360)
                    THEN 'region bounds are out of range or out of order'
                WHEN w0 >= e0 THEN 'the box wraps around at the antimeridian, which is not possible'
                WHEN c_custkey NOT IN (SELECT c_custkey FROM met)
                    THEN 'no cell of the grid lies in the box' END AS reason
            FROM turned""",
        "grid_stream_late": _with(SUPPLIER_BOX) + """, parts AS (
                SELECT date, CASE WHEN month(date) % 2 = 0 AND lat >= 34 THEN 1 ELSE 0 END AS part FROM box)
            SELECT part AS batch, count(*) AS rows,
                   count(*) FILTER (part = 1 AND date < (SELECT max(date) FROM parts WHERE part = 0) - 30)
                       AS late_rows
            FROM parts GROUP BY part""",
        "grid_extent": _with(NATION_GRID) + """
            SELECT count(*) AS rows, min(date) AS date_min, max(date) AS date_max, min(lat) AS lat_min,
                   max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM grid""",
        "weighted_mean": _with(SUPPLIER_BOX) + """SELECT date,
            CASE WHEN vw / fw >= 0.001 THEN round(mean, 6) END AS sst FROM coverage""",
        "valid_fraction": _with(SUPPLIER_BOX) + """SELECT date, round(vw, 6) AS valid_weight,
            round(fw, 6) AS full_weight, round(vw / fw, 6) AS valid_fraction FROM coverage""",
        "coverage_mask": _with(SUPPLIER_BOX) + """SELECT date,
            CASE WHEN vw / fw >= 0.15 THEN round(mean, 6) END AS sst FROM coverage""",
        "regularize": _with(PRIORITY, CALENDAR)
        + "SELECT k AS series_id, d AS date, round(v, 6) AS sst_celsius FROM observed",
        "asof_valid": _with(PRIORITY) + """
            SELECT s.k AS series_id, s.d AS date, p.d AS previous_date,
                   round(p.v, 6) AS previous_value, n.d AS following_date,
                   round(n.v, 6) AS following_value
            FROM series s
            ASOF LEFT JOIN (SELECT * FROM series WHERE v IS NOT NULL) p
              ON p.k = s.k AND s.d >= p.d
            ASOF LEFT JOIN (SELECT * FROM series WHERE v IS NOT NULL) n
              ON n.k = s.k AND s.d < n.d""",
        "fill_gap_0": _with(PRIORITY, CALENDAR) + """SELECT k AS series_id, d AS date,
            round(v, 6) AS sst_celsius, false AS is_interpolated FROM observed""",
        "fill_gap_1": _with(PRIORITY, filled(1)) + f"SELECT k AS series_id, {FILLED} FROM filled",
        "fill_gap_3": _with(PRIORITY, filled(3)) + f"SELECT k AS series_id, {FILLED} FROM filled",
        "fill_single": _with(DAILY, filled(3)) + f"SELECT {FILLED} FROM filled",
        "fill_multi": _with(NATION, filled(2)) + f"SELECT k AS nation, {FILLED} FROM filled",
        "align_series": _with(DAILY, SUPPLIER_GRID) + """
            SELECT coalesce(o.d, s.date) AS date, round(o.v, 6) AS ordered,
                   round(s.x, 6) AS shipped
            FROM series o FULL JOIN (SELECT date, avg(sst) AS x FROM grid GROUP BY date) s
              ON s.date = o.d""",
        "union_periods": _with(NATION_GRID)
        + "SELECT date, lat, lon, round(sst, 6) AS sst FROM grid",
        "ref_period": _with(DAILY) + """SELECT d AS date, round(v, 6) AS sst_celsius FROM series
            WHERE v IS NOT NULL AND d BETWEEN DATE '1995-03-01' AND DATE '1999-12-31'""",
        "clim_day": _with(DAILY) + f"""SELECT strftime(d, '%m-%d') AS season,
            round(avg(v), 6) AS sst_celsius FROM series
            WHERE v IS NOT NULL AND d BETWEEN {REF} GROUP BY 1""",
        "clim_month": _with(PRIORITY) + f"""SELECT k AS series_id, month(d) AS season,
            round(avg(v), 6) AS sst_celsius FROM series
            WHERE v IS NOT NULL AND d BETWEEN {REF} GROUP BY 1, 2""",
        "clim_map": _with(PRIORITY) + """, cycle AS (
                SELECT k, month(d) AS m, day(d) AS dd, avg(v) AS c FROM series
                WHERE v IS NOT NULL AND year(d) = 1995 GROUP BY 1, 2, 3)
            SELECT s.k AS series_id, s.d AS date, round(c, 6) AS climatology_celsius
            FROM series s LEFT JOIN cycle y ON y.k = s.k AND y.m = month(s.d) AND y.dd = day(s.d)""",
        "anomaly_table": _with(DAILY, anomalies()) + f"SELECT {TABLE} FROM anomaly",
        "anomaly_by_nation": _with(NATION, anomalies(2))
        + f"SELECT k AS nation, {TABLE} FROM anomaly",
        "anomaly_monthly": _with(PRIORITY, anomalies(season="month(d)"))
        + f"SELECT k AS series_id, {TABLE} FROM anomaly",
        "grid_to_anomaly": _with(BOX_SERIES, anomalies(1)) + f"SELECT {TABLE} FROM anomaly",
        "persistence": _with(PRIORITY, CALENDAR) + """SELECT k AS series_id, d AS date,
            round(lag(v) OVER (PARTITION BY k ORDER BY d), 6) AS predicted_anomaly_celsius
            FROM observed""",
        "chrono_split": _with(PRIORITY, CALENDAR) + """, placed AS (
                SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS pos,
                       count(*) OVER (PARTITION BY k) AS n FROM calendar)
            SELECT p.k AS series_id, p.d AS date, pos AS position, n AS days,
                   pos >= greatest(1, floor(n * (1 - CAST(0.3 AS DOUBLE)))) AS is_test
            FROM placed p JOIN series s ON s.k = p.k AND s.d = p.d""",
        "persistence_eval": _with(NATION, anomalies(), forecast())
        + f"SELECT k AS nation, {PREDICTIONS} FROM test",
        "persistence_meta": _with(DAILY, anomalies(), forecast()) + f"SELECT {META} FROM meta",
        "persistence_meta_by_nation": _with(NATION, anomalies(), forecast())
        + f"SELECT k AS nation, {META} FROM meta",
        "grid_to_forecast": _with(BOX_SERIES, anomalies(1), forecast())
        + f"SELECT {META} FROM meta",
        "regions_to_forecast": _with(
            REGIONS_DAILY,
            "series AS (SELECT region AS k, date AS d, mean AS v FROM regions_daily)",
            anomalies(),
            forecast(),
        )
        + f"SELECT k AS region, {META} FROM meta",
        "regions_supplier": _with(SUPPLIER_GRID, """boxes AS (
                SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation, 30 + c_nationkey % 7 AS s,
                       33 + c_nationkey % 7 AS n, 115 + c_nationkey % 12 AS w,
                       119 + c_nationkey % 12 AS e FROM customer),
            inside AS (
                SELECT nation, date, lat, lon, sst, cos(radians(lat)) AS c
                FROM grid JOIN boxes ON lat BETWEEN s AND n AND lon BETWEEN w AND e),
            total AS (
                SELECT nation, sum(c) * any_value(lons) AS fw FROM (
                    SELECT DISTINCT nation, lat, c FROM inside)
                JOIN (SELECT nation, count(DISTINCT lon) AS lons FROM inside GROUP BY nation)
                USING (nation) GROUP BY nation)""") + """
            SELECT nation, date, CASE WHEN coalesce(sum(c) FILTER (sst IS NOT NULL), 0) / any_value(fw) >= 0.2
                THEN round(sum(c * sst) / sum(c) FILTER (sst IS NOT NULL), 6) END AS sst_celsius
            FROM inside JOIN total USING (nation) GROUP BY nation, date""",
        "region_cells": _with(REGION_TABLE) + """
            SELECT b.region, count(lat) AS cells
            FROM (SELECT * FROM boxes UNION ALL
                  SELECT region || ' SOUTH', s - 100, n - 100, w, e FROM boxes) b
            LEFT JOIN (SELECT DISTINCT CAST(25 + 5 * floor(c_nationkey / 5) AS DOUBLE) AS lat,
                              CAST(110 + 5 * (c_nationkey % 5) AS DOUBLE) AS lon FROM customer)
              ON lat BETWEEN s AND n AND lon BETWEEN w AND e
            GROUP BY b.region""",
        "coverage_quality": """
            WITH measured AS (
                SELECT CAST(l_shipdate AS DATE) AS date,
                       l_suppkey % 25 * CAST(0.5 AS DOUBLE) + 30 AS lat,
                       floor(l_suppkey / 25) % 40 * CAST(0.5 AS DOUBLE) + 115 AS lon,
                       l_quantity <= 40 AS valid FROM lineitem),
            per_cell AS (
                SELECT date, lat, lon, count(*) AS n, bool_or(valid) AS valid
                FROM measured GROUP BY ALL)
            SELECT date, CAST(sum(n) AS BIGINT) AS rows, count(*) AS cells,
                round(coalesce(sum(cos(radians(lat))) FILTER (valid), 0) / (
                    (SELECT sum(cos(radians(lat))) FROM (SELECT DISTINCT lat FROM measured))
                    * (SELECT count(DISTINCT lon) FROM measured)), 6) AS valid_fraction
            FROM per_cell GROUP BY date""",
        "forecast_status_by_key": _with(ORDERS) + """, s AS (
                SELECT o_custkey AS k, d, avg(v) AS v FROM orders_by_day GROUP BY 1, 2),
            placed AS (
                SELECT s.k, s.d, s.v, y.v AS p, s.d - min(s.d) OVER w AS pos,
                       max(s.d) OVER w - min(s.d) OVER w + 1 AS n
                FROM s LEFT JOIN s y ON y.k = s.k AND y.d = s.d - 1
                WINDOW w AS (PARTITION BY s.k)),
            marked AS (
                SELECT *, v IS NOT NULL AND p IS NOT NULL
                    AND pos >= greatest(1, floor(n * CAST(0.8 AS DOUBLE))) AS scored FROM placed)
            SELECT CAST(k AS BIGINT) AS custkey, count(*) FILTER (scored) AS n,
                round(avg(abs(p - v)) FILTER (scored), 6) AS mae,
                strftime(min(d) FILTER (scored), '%Y-%m-%d') AS test_start,
                strftime(max(d) FILTER (scored), '%Y-%m-%d') AS test_end
            FROM marked GROUP BY k""",
        "exploration_tables": _with(
            DAILY, anomalies(), "vals AS (SELECT k, a AS x FROM anomaly)", histogram("vals", 50),
            density("vals"), autocorrelation(365),
        ) + """
            SELECT 'profile' AS view, unnest([1, 2, 3, 4])::BIGINT AS place,
                   unnest([count(v), count(interpolated), count(c), count(a)])::DOUBLE AS value
            FROM anomaly
            UNION ALL SELECT 'sst', date_diff('day', DATE '1970-01-01', d), round(v, 6) FROM anomaly
            UNION ALL SELECT 'anomaly', date_diff('day', DATE '1970-01-01', d), round(a, 6) FROM anomaly
            UNION ALL SELECT 'monthly_means', month(d), round(avg(v), 6) FROM anomaly GROUP BY 2
            UNION ALL SELECT 'histogram', bin, n FROM bars
            UNION ALL SELECT 'density', point, round(y, 6) FROM curve
            UNION ALL SELECT 'autocorrelation', lag, round(r, 6) FROM acf""",
        "grid_listing": _with(NATION_GRID) + """
            SELECT ym, row_number() OVER (ORDER BY ym) AS position
            FROM (SELECT DISTINCT strftime(date, '%Y%m') AS ym FROM grid)""",
        "grid_time_column": _with(NATION_GRID)
        + "SELECT date, lat, lon, round(sst, 6) AS sst FROM grid",
        "finite_pairs": _with(PAIRS) + """SELECT event_type, round(observed, 6) AS observed,
            round(predicted, 6) AS predicted FROM finite""",
        "metrics": _with(PAIRS) + """SELECT count(*) AS n,
            round(avg(abs(predicted - observed)), 6) AS mae,
            round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse FROM finite""",
        "metrics_by_type": _with(PAIRS) + """SELECT event_type, count(*) AS n,
            round(avg(abs(predicted - observed)), 6) AS mae,
            round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse
            FROM finite GROUP BY event_type""",
        "monthly_means": _with(PRIORITY) + """SELECT k AS series_id, month(d) AS month,
            round(avg(v), 6) AS sst_celsius FROM series GROUP BY 1, 2""",
        "histogram50": _with(
            DAILY, anomalies(), "vals AS (SELECT k, a AS x FROM anomaly)", histogram("vals", 50)
        )
        + """SELECT bin, round(l, 6) AS left_edge, round(r, 6) AS right_edge, n AS count FROM bars""",
        "histogram_orders": _with(
            ORDERS, "vals AS (SELECT prio AS k, v AS x FROM orders_by_day)", histogram("vals", 40)
        )
        + """SELECT k AS series_id, bin, round(l, 6) AS left_edge, round(r, 6) AS right_edge,
            n AS count FROM bars""",
        "kde200": _with(
            DAILY, anomalies(), "vals AS (SELECT k, a AS x FROM anomaly)", density("vals")
        )
        + "SELECT point, round(gx, 6) AS x, round(y, 6) AS density FROM curve",
        "kde_orders": _with(
            "vals AS (SELECT o_orderstatus AS k, ln(o_totalprice) AS x FROM orders)",
            density("vals"),
        )
        + """SELECT k AS o_orderstatus, point, round(gx, 6) AS x, round(y, 6) AS density
            FROM curve""",
        "acf": _with(DAILY, anomalies(), autocorrelation(365))
        + "SELECT lag, round(r, 6) AS acf, n FROM acf",
        "acf_band": _with(DAILY, anomalies(), autocorrelation(365))
        + f"SELECT lag, round(r, 6) AS acf, n, {BAND} FROM acf",
        "acf_by_nation": _with(NATION, anomalies(), autocorrelation(365))
        + f"SELECT k AS nation, lag, round(r, 6) AS acf, n, {BAND} FROM acf",
        "profile": _with(DAILY, anomalies()) + """, one AS (
                SELECT count(*) AS row_count, min(d) AS first_date, max(d) AS last_date,
                       count(v) AS nv, count(interpolated) AS ni, count(c) AS nc, count(a) AS na
                FROM anomaly)
            SELECT 'sst_celsius' AS "column", 'double' AS type, nv AS non_null, row_count,
                   first_date, last_date FROM one
            UNION ALL SELECT 'is_interpolated', 'boolean', ni, row_count, first_date, last_date FROM one
            UNION ALL SELECT 'climatology_celsius', 'double', nc, row_count, first_date, last_date FROM one
            UNION ALL SELECT 'anomaly_celsius', 'double', na, row_count, first_date, last_date FROM one""",
        "dup_dates": _with(ORDERS) + """SELECT prio AS series_id, d AS date, count(*) AS n
            FROM orders_by_day GROUP BY 1, 2 HAVING count(*) > 1""",
        "dup_cells": """SELECT CAST(l_shipdate AS DATE) AS date,
                   l_suppkey % 25 * CAST(0.5 AS DOUBLE) + 30 AS lat,
                   floor(l_suppkey / 25) % 40 * CAST(0.5 AS DOUBLE) + 115 AS lon, count(*) AS n
            FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""",
        "grid_files": _with(NATION_GRID) + """SELECT date, lat, lon, round(sst, 6) AS sst FROM grid
            WHERE date BETWEEN DATE '1996-02-01' AND DATE '1998-01-15'""",
        "grid_file_months": _with(NATION_GRID)
        + "SELECT DISTINCT strftime(date, '%Y%m') AS ym FROM grid",
    }
    sql["regions_wrap_mean"] = sql["regions_mean"]
    sql["forecast_of_stored"] = sql["persistence_meta_by_nation"]
    sql["grid_streamed"] = sql["coverage_mask"]
    sql["ingest_listing"] = sql["ingest_plan"]
    sql["clim_window"] = sql["clim_map"]
    sql["anomaly_csv"] = sql["grid_to_anomaly"]
    sql["predictions_csv"] = sql["persistence_eval"]
    sql["metadata_by_nation_json"] = sql["persistence_meta_by_nation"]
    sql["metadata_json"] = sql["persistence_meta"]
    return sql
