"""The same results in DuckDB SQL, written independently of the plans."""

from __future__ import annotations

from datetime import date, timedelta

# The names of the test data, written out here and not taken from the code under test.
TRUCKS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [f"NATION_{i}" for i in range(25)]
CUSTOMERS = [n for n in NATIONS if n != "NATION_1"]

# --- inputs as common table expressions ------------------------------------------

PLACES = """places AS (
  SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""

SHIPMENTS = """shipments AS (
  SELECT 'DOM.' || l_orderkey AS shipment_gid, l_orderkey AS shipment_xid, 'CARRIER.' || l_suppkey AS servprov_gid,
    CAST(l_linenumber AS DOUBLE) AS total_ship_unit_count, l_extendedprice AS total_weight,
    l_quantity AS total_volume, 'DOM.' || p_type AS equipment_gid, p_name AS equipment_ref_unit_gid,
    p_brand AS icon_gid, 'DRIVER.' || l_linenumber AS driver_id, 'VEHICLE.' || l_partkey AS vehicle_no,
    l_extendedprice * (1.0::DOUBLE - l_discount) AS total_actual_cost, l_tax AS loaded_distance,
    'CUST.' || o_custkey AS dest_location_gid, 'SUPP.' || l_suppkey AS source_location_gid,
    l_returnflag AS principal, o_orderpriority AS route, 'MODE.' || o_orderstatus AS transport_mode_gid,
    p_name AS term_location_text, p_brand AS domain_name, l_linestatus AS perspective,
    l_shipdate AS start_ts, l_shipdate + INTERVAL 1 DAY AS end_ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

LOCATIONS = f"""{PLACES}, locations AS (
  SELECT 'CUST.' || c_custkey AS location_gid, n_name AS location_name, r_name AS province, c_name AS city,
    n_name AS zone1, r_name AS zone2, c_mktsegment AS segment, 'BASE/CUST' AS domain_name
  FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'SUPP.' || s_suppkey, n_name, r_name, s_name, n_name, r_name, NULL, 'BASE/SUPP'
  FROM supplier JOIN places ON s_nationkey = n_nationkey)"""

BOTH = f"{SHIPMENTS}, {LOCATIONS}"

RESOLVED = """resolved AS (
  SELECT l_orderkey AS shipment_xid, l_shipdate AS start_ts, CAST(l_shipdate AS DATE) AS ship_date,
    l_quantity AS total_volume, l_extendedprice AS total_weight, 'DOM.' || p_type AS equipment_gid,
    p_type AS truck, c_mktsegment AS segment, n_name AS dest_name, r_name AS dest_zone2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

REGION_ROWS = f"""{RESOLVED}, rows_r AS (
  SELECT ship_date, dest_zone2 AS entity, equipment_gid, shipment_xid, total_volume, truck
  FROM resolved WHERE segment IN ('AUTOMOBILE', 'HOUSEHOLD')),
top_r AS (SELECT equipment_gid, count(*) AS n_rows FROM rows_r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2),
prep_r AS (SELECT * FROM rows_r WHERE equipment_gid IN (SELECT equipment_gid FROM top_r))"""

CUSTOMER_PART = """rows_c AS (
  SELECT ship_date, CASE dest_name WHEN 'NATION_1' THEN 'NATION_0' ELSE dest_name END AS entity,
    equipment_gid, shipment_xid, total_volume, truck
  FROM resolved WHERE segment IN ('BUILDING', 'MACHINERY')),
top_c AS (SELECT equipment_gid, count(*) AS n_rows FROM rows_c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4),
trucked_c AS (SELECT * FROM rows_c WHERE equipment_gid IN (SELECT equipment_gid FROM top_c)),
top_e AS (SELECT entity, sum(total_volume) AS total_volume FROM trucked_c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9),
prep_c AS (SELECT * FROM trucked_c WHERE entity IN (SELECT entity FROM top_e))"""

CUSTOMER_ROWS = f"{RESOLVED}, {CUSTOMER_PART}"

#: Days held out of training, and the uploaded days and customers.
HELD = "datediff('day', DATE '1970-01-01', ship_date) % 5 = 4"
CUSTOMER_DAYS = """uploads AS (
  SELECT CAST(o_orderdate AS DATE) AS ship_date, CASE n_name WHEN 'NATION_1' THEN 'NATION_0' ELSE n_name END AS entity
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
upload_days AS (SELECT DISTINCT ship_date FROM uploads),
upload_names AS (SELECT DISTINCT entity FROM uploads)"""

CALENDAR = """CAST(year(ship_date) AS INT) AS year, CAST(month(ship_date) AS INT) AS month,
  CAST(isodow(ship_date) AS INT) AS weekday"""


def _abt(rows: str) -> str:
    counts = ", ".join(
        f"count(DISTINCT shipment_xid) FILTER (WHERE truck = '{t}') AS \"{t}\"" for t in TRUCKS
    )
    return f"""SELECT ship_date, entity, sum(total_volume) AS total_volume, {CALENDAR}, {counts}
  FROM {rows} GROUP BY ship_date, entity"""


ABT_R = f"{REGION_ROWS}, abt_r AS ({_abt('prep_r')})"
ABT_C = f"{CUSTOMER_ROWS}, abt_c AS ({_abt('prep_c')})"

ACTUALS = f"""{ABT_R}, actuals AS (
  SELECT a.ship_date, a.entity, a.total_volume, t.truck,
    (SELECT count(DISTINCT shipment_xid) FROM prep_r p
     WHERE p.ship_date = a.ship_date AND p.entity = a.entity AND p.truck = t.truck) AS n_shipments
  FROM abt_r a, (SELECT substr(equipment_gid, 5) AS truck FROM top_r) t)"""


def _forecast(entity: str) -> str:
    return f"""forecast AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y/%b/%d') AS date_str, c_mktsegment AS segment,
    lower({entity}) AS cust_region, o_totalprice AS volume_forecast
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
parsed AS (
  SELECT CAST(strptime(date_str, '%Y/%b/%d') AS DATE) AS ship_date, segment, upper(cust_region) AS entity,
    volume_forecast AS total_volume, date_str FROM forecast)"""


FORECAST = _forecast("r_name")
VOLUMES = f"""{FORECAST}, volumes AS (
  SELECT ship_date, entity, round_even(sum(total_volume), 2) AS total_volume
  FROM parsed WHERE segment IN ('AUTOMOBILE', 'HOUSEHOLD') GROUP BY 1, 2)"""
CUSTOMER_VOLUMES = f"""{_forecast("n_name")}, volumes AS (
  SELECT ship_date, entity, round_even(sum(total_volume), 2) AS total_volume
  FROM parsed WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2)"""

V_LOADS = {"MEDIUM": "40000.0", "STANDARD": "90000.0"}
LOADS = {"ECONOMY": "8.0", "LARGE": "10.0", "MEDIUM": "16.0", "PROMO": "20.0", "SMALL": "32.0", "STANDARD": "40.0"}
RULES = [("rule_8", "8.0"), ("rule_20", "20.0"), ("rule_40", "40.0"), ("rule_80", "80.0"), ("rule_8_again", "8.0")]
WEEK = [date(2001, 7, 26) + timedelta(days=i) for i in range(7)]


def _pivot(table: str, entities: list[str]) -> str:
    cells = ", ".join(
        f"coalesce(round_even(sum(total_volume) FILTER (WHERE entity = '{e}'), 2), 0) AS \"{e}\"" for e in entities
    )
    return f"SELECT ship_date, {cells} FROM {table} GROUP BY ship_date"


def _matrix(table: str, loads: dict[str, str]) -> str:
    cells = ", ".join(
        f"coalesce(max(CAST(round_even(total_volume / {load}::DOUBLE, 0) AS BIGINT)) "
        f"FILTER (WHERE entity = '{e}'), 0) AS \"{e}-{t}\""
        for e in REGIONS
        for t, load in loads.items()
    )
    return f"SELECT ship_date, {cells} FROM {table} GROUP BY ship_date"


SPINE = """spine AS (SELECT DISTINCT ship_date FROM volumes),
fleet AS (
  SELECT ship_date, entity, 'MEDIUM' AS truck, CAST(round_even(total_volume / 40000.0::DOUBLE, 0) AS BIGINT) AS forecast
  FROM volumes WHERE total_volume > 0
  UNION ALL
  SELECT ship_date, entity, 'STANDARD', CAST(round_even(total_volume / 90000.0::DOUBLE, 0) AS BIGINT)
  FROM volumes WHERE total_volume > 0)"""

MATRIX = f"{VOLUMES}, matrix AS ({_matrix('volumes', V_LOADS)})"

GRID = f"""{VOLUMES}, grid AS (
  SELECT d.ship_date, r.r_name AS entity, coalesce(v.total_volume, 0) AS total_volume
  FROM (SELECT DISTINCT ship_date FROM volumes) d CROSS JOIN region r
  LEFT JOIN volumes v ON v.ship_date = d.ship_date AND v.entity = r.r_name)"""

EDITED = f"""{GRID}, edited AS (
  SELECT ship_date, entity,
    CASE WHEN isodow(ship_date) = 6 THEN total_volume * 2 + 1000 ELSE total_volume END AS total_volume FROM grid)"""

BACKTEST = f"""{ACTUALS}, backtest AS (
  SELECT ship_date, entity, truck, CAST(n_shipments AS DOUBLE) AS a, round_even(total_volume / 40.0::DOUBLE, 0) AS f
  FROM actuals),
zeroed AS (
  SELECT *, CASE WHEN a = 0 AND f <> 0 THEN 1.0 WHEN a = 0 THEN 0.0 ELSE abs((a - f) / a) END::DOUBLE AS ape,
    CASE WHEN a = 0 AND f <> 0 THEN 1.0 WHEN a = 0 THEN 0.0 ELSE abs(a - f) / (abs(a) + abs(f)) END::DOUBLE AS sape
  FROM backtest),
stats AS (
  SELECT entity, truck, avg(a) AS mean, stddev_pop(a) AS sd, avg(abs(a - f)) AS mae, avg((a - f) * (a - f)) AS mse,
    sqrt(avg((a - f) * (a - f))) AS rmse, max(a) - min(a) AS spread,
    quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS iq, avg(ape) AS mape, avg(sape) AS smape
  FROM zeroed GROUP BY 1, 2)"""

MODELS = f"""{ACTUALS}, models(model, load, pos) AS (
  VALUES {", ".join(f"('{m}', {load}::DOUBLE, {i})" for i, (m, load) in enumerate(RULES))}),
maes AS (
  SELECT entity, model, pos, avg(mae) AS mae FROM (
    SELECT entity, model, pos, truck, avg(abs(n_shipments - round_even(total_volume / load, 0))) AS mae
    FROM actuals, models GROUP BY ALL) GROUP BY ALL)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _csv_types() -> str:
    """Refused cells of each column of the orders, the forms of the types written out."""
    forms = {
        "boolean": "^(?i:true|false)$",
        "bigint": "^[+-]?[0-9]{1,18}$",
        "double": "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$",
        "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
        "timestamp_ntz": "^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?)?$",
    }
    chosen = {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    }
    parts = []
    for column, kind in chosen.items():
        cell = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f')" if column == "o_orderdate" else f"{column}::VARCHAR"
        refused = ", ".join(f"count(*) FILTER (NOT regexp_matches({cell}, '{form}')) AS not_{k}" for k, form in forms.items())
        parts.append(
            f"""SELECT '{column}' AS column_name, count({column}) AS n_cells, count(*) FILTER ({column} IS NULL) AS n_empty,
            {refused}, '{kind}' AS chosen FROM orders"""
        )
    return " UNION ALL ".join(parts)


def all_oracles() -> dict[str, str]:
    r6 = "round_even({0}, 6) AS {1}".format
    load_cases = " ".join(f"WHEN '{t}' THEN {load}" for t, load in LOADS.items())
    week_columns = ", ".join(
        f"coalesce(sum(total_volume) FILTER (WHERE ship_date = DATE '{d}'), 0) AS \"{d.strftime('%b %d %Y')}\""
        for d in WEEK
    )
    week_cells = f"""{VOLUMES}, names AS (SELECT r_name AS entity FROM region),
      days AS (SELECT CAST(unnest(generate_series(DATE '2001-07-26', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE)
        AS ship_date),
      cells AS (SELECT d.ship_date, n.entity, coalesce(v.total_volume, 0) AS total_volume
        FROM days d CROSS JOIN names n LEFT JOIN volumes v ON v.ship_date = d.ship_date AND v.entity = n.entity)"""
    return {
        # scans, sources, sinks
        "scan_forecast": _with(FORECAST, "SELECT * FROM forecast"),
        "scan_forecast_current": _with(
            FORECAST,
            "SELECT * FROM forecast WHERE CAST(strptime(date_str, '%Y/%b/%d') AS DATE) >= DATE '2001-06-01'",
        ),
        "scan_shipments": _with(SHIPMENTS, "SELECT * FROM shipments"),
        "recent_shipments_sql": _with(
            BOTH,
            """SELECT s.shipment_gid, s.shipment_xid, s.servprov_gid, s.total_ship_unit_count, s.total_weight,
              s.total_volume, s.equipment_gid, s.equipment_ref_unit_gid, s.icon_gid,
              s.driver_id AS "ATTRIBUTE4(DRIVER_ID)", s.vehicle_no AS "ATTRIBUTE5(VEHICLE_NO)", s.total_actual_cost,
              s.loaded_distance, s.dest_location_gid, s.principal, s.route AS "ATTRIBUTE2(ROUTE)",
              s.transport_mode_gid, s.term_location_text, n.location_name AS source_name,
              d.location_name AS dest_name, d.province AS region, d.city, d.zone1 AS dest_zone1,
              d.zone2 AS dest_zone2, d.segment, s.start_ts, s.end_ts
            FROM shipments s LEFT JOIN locations d ON s.dest_location_gid = d.location_gid
            LEFT JOIN locations n ON s.source_location_gid = n.location_gid
            WHERE s.principal = 'N' AND s.domain_name = 'Brand#1' AND s.perspective = 'O'
              AND s.start_ts >= TIMESTAMP '2001-05-01'""",
        ),
        "training_shipments_sql": _with(
            BOTH,
            """SELECT s.shipment_xid, s.start_ts, s.total_ship_unit_count, s.total_weight, s.total_volume,
              s.equipment_gid, s.principal, d.location_name AS dest_name, d.province AS region, d.city,
              d.zone1 AS dest_zone1, d.zone2 AS dest_zone2, d.segment
            FROM shipments s JOIN locations d ON s.dest_location_gid = d.location_gid
            WHERE s.principal = 'N' AND s.perspective = 'O' AND s.domain_name LIKE '%Brand#1%'
              AND d.domain_name LIKE '%BASE/%' AND d.segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')
              AND s.start_ts BETWEEN TIMESTAMP '1999-05-01' AND TIMESTAMP '2001-06-01'""",
        ),
        "csv_types": _csv_types(),
        "csv_inferred": "SELECT * FROM orders",
        "csv_headerless": _with(
            FORECAST, "SELECT CAST(id AS INTEGER) AS id, date_str, segment, cust_region, volume_forecast FROM forecast"
        ),
        "csv_roundtrip": _with(
            RESOLVED,
            """SELECT shipment_xid, start_ts, ship_date, total_volume, equipment_gid, segment, dest_name, dest_zone2
            FROM resolved""",
        ),
        "json_stage": _with(VOLUMES, "SELECT * FROM volumes"),
        "forecast_fallback_hit": _with(FORECAST, "SELECT * FROM parsed WHERE ship_date >= DATE '2001-06-01'"),
        "forecast_fallback_miss": _with(FORECAST, "SELECT * FROM parsed"),
        "matrix_sink": _with(MATRIX, "SELECT * FROM matrix"),
        "wide_forecast_tail": _with(MATRIX, "SELECT * FROM matrix ORDER BY ship_date DESC LIMIT 7"),
        # projections, filters, predicates
        "project_alias": _with(
            SHIPMENTS,
            """SELECT shipment_xid, driver_id AS "ATTRIBUTE4(DRIVER_ID)", vehicle_no AS "ATTRIBUTE5(VEHICLE_NO)",
              route AS "ATTRIBUTE2(ROUTE)", total_volume FROM shipments""",
        ),
        "features": _with(ABT_R, "SELECT ship_date, entity, total_volume, year, month, weekday FROM abt_r"),
        "filter_eq": _with(
            SHIPMENTS,
            """SELECT shipment_xid, principal, perspective, total_volume FROM shipments
            WHERE principal = 'N' AND perspective = 'O'""",
        ),
        "filter_like": _with(
            SHIPMENTS,
            "SELECT shipment_xid, domain_name, total_volume FROM shipments WHERE domain_name LIKE '%Brand#1%'",
        ),
        "filter_in": _with(
            RESOLVED,
            """SELECT shipment_xid, segment, total_volume FROM resolved
            WHERE segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')""",
        ),
        "filter_trailing_25m": _with(
            SHIPMENTS,
            """SELECT shipment_xid, start_ts, total_volume FROM shipments
            WHERE start_ts BETWEEN TIMESTAMP '2001-06-01' - INTERVAL 25 MONTH AND TIMESTAMP '2001-06-01'""",
        ),
        "filter_trailing_1m": _with(
            SHIPMENTS,
            """SELECT shipment_xid, start_ts, total_volume FROM shipments
            WHERE start_ts >= TIMESTAMP '2001-06-01' - INTERVAL 1 MONTH""",
        ),
        "entity_allowlist": _with(
            RESOLVED,
            """SELECT dest_name AS entity, shipment_xid, total_volume FROM resolved
            WHERE dest_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
              WHERE s_acctbal > 9000)""",
        ),
        "entity_canonicalise": _with(
            RESOLVED,
            """SELECT shipment_xid, CASE dest_name WHEN 'NATION_1' THEN 'NATION_0' ELSE dest_name END AS dest_name,
              total_volume FROM resolved""",
        ),
        "round_all_doubles": _with(
            SHIPMENTS,
            """SELECT shipment_xid, principal, round_even(total_weight, 2) AS total_weight,
              round_even(total_actual_cost, 2) AS total_actual_cost,
              round_even(loaded_distance, 2) AS loaded_distance FROM shipments""",
        ),
        "empty_default": """SELECT DATE '2009-01-01' AS ship_date, 'none' AS entity, 0.0::DOUBLE AS total_volume
            WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderdate >= TIMESTAMP '2009-01-01')""",
        "empty_default_unused": _with(VOLUMES, "SELECT * FROM volumes"),
        "error_widths": _with(
            REGION_ROWS,
            """SELECT ship_date, entity, y, y_ub, y_lb, y_ub - y AS error_up, y - y_lb AS error_down FROM (
              SELECT ship_date, entity, avg(total_volume) AS y, max(total_volume) AS y_ub, min(total_volume) AS y_lb
              FROM rows_r GROUP BY 1, 2)""",
        ),
        "entities_uncovered": _with(
            VOLUMES, "SELECT entity, count(*) AS n_rows FROM volumes WHERE entity = 'ASIA' GROUP BY 1"
        ),
        # joins
        "join_inner_dest": _with(
            BOTH,
            """SELECT s.shipment_xid, s.dest_location_gid, d.location_name AS dest_name, d.province AS region, d.city,
              d.zone1 AS dest_zone1, d.zone2 AS dest_zone2, d.segment, s.total_volume
            FROM shipments s JOIN locations d ON s.dest_location_gid = d.location_gid""",
        ),
        "join_left_dest": _with(
            BOTH,
            """SELECT s.shipment_xid, s.dest_location_gid, d.location_name AS dest_name, d.segment, s.total_volume
            FROM shipments s LEFT JOIN locations d ON s.dest_location_gid = d.location_gid
              AND d.segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')""",
        ),
        "join_two_roles": _with(
            BOTH,
            """SELECT s.shipment_xid, n.location_name AS source_name, d.location_name AS dest_name,
              d.zone2 AS dest_zone2, s.total_volume
            FROM shipments s LEFT JOIN locations d ON s.dest_location_gid = d.location_gid
            LEFT JOIN locations n ON s.source_location_gid = n.location_gid""",
        ),
        "scalar_subquery_lookup": _with(
            BOTH,
            """SELECT shipment_xid, total_volume,
              (SELECT location_name FROM locations WHERE location_gid = dest_location_gid) AS dest_name,
              (SELECT zone2 FROM locations WHERE location_gid = dest_location_gid) AS dest_zone2
            FROM shipments""",
        ),
        "backtest_join": _with(
            ACTUALS,
            f"""SELECT ship_date, entity, truck, n_shipments AS actual,
              CAST(round_even(total_volume / (CASE truck {load_cases} END)::DOUBLE, 0) AS BIGINT) AS forecast
            FROM actuals WHERE datediff('day', DATE '1970-01-01', ship_date) % 5 = 4""",
        ),
        "fleet_spine_join": _with(
            f"{VOLUMES}, {SPINE}",
            """SELECT spine.ship_date, entity, truck, forecast
            FROM spine LEFT JOIN fleet ON spine.ship_date = fleet.ship_date""",
        ),
        "semi_topk": _with(
            REGION_ROWS, "SELECT ship_date, entity, equipment_gid, shipment_xid, total_volume FROM prep_r"
        ),
        "anti_topk": _with(
            REGION_ROWS,
            """SELECT ship_date, entity, equipment_gid, shipment_xid, total_volume FROM rows_r
            WHERE equipment_gid NOT IN (SELECT equipment_gid FROM top_r)""",
        ),
        # aggregations
        "truck_counts": _with(
            REGION_ROWS,
            """SELECT ship_date, entity, truck, count(DISTINCT shipment_xid) AS n_shipments
            FROM rows_r GROUP BY 1, 2, 3""",
        ),
        "daily_volume": _with(
            REGION_ROWS, "SELECT ship_date, entity, sum(total_volume) AS total_volume FROM rows_r GROUP BY 1, 2"
        ),
        "volume_by_customer": _with(
            CUSTOMER_ROWS,
            "SELECT entity, sum(total_volume) AS total_volume FROM rows_c GROUP BY 1 ORDER BY 2 DESC, 1",
        ),
        "truck_frequency": _with(
            CUSTOMER_ROWS, "SELECT equipment_gid, count(*) AS n_rows FROM rows_c GROUP BY 1"
        ),
        "abt_customer": _with(ABT_C, "SELECT * FROM abt_c"),
        "abt_region": _with(ABT_R, "SELECT * FROM abt_r"),
        "date_span": _with(RESOLVED, "SELECT min(ship_date) AS min_date, max(ship_date) AS max_date FROM resolved"),
        "metrics_basic": _with(
            BACKTEST,
            f"""SELECT entity, truck, {r6('mean', 'mean')}, {r6('sd', 'sd')},
              {r6('sd / nullif(mean, 0)', 'cv')} FROM stats""",
        ),
        "metrics_errors": _with(
            BACKTEST, f"SELECT entity, truck, {r6('mae', 'mae')}, {r6('mse', 'mse')}, {r6('rmse', 'rmse')} FROM stats"
        ),
        "metrics_nrmse": _with(
            BACKTEST,
            """SELECT entity, truck, round_even(rmse / nullif(sd, 0), 3) AS nrmse_sd,
              round_even(rmse / nullif(mean, 0), 3) AS nrmse_mean,
              round_even(rmse / nullif(spread, 0), 3) AS nrmse_maxmin,
              round_even(rmse / nullif(iq, 0), 3) AS nrmse_iq FROM stats""",
        ),
        "metrics_mape": _with(BACKTEST, f"SELECT entity, truck, {r6('mape', 'mape')} FROM stats"),
        "metrics_smape": _with(BACKTEST, f"SELECT entity, truck, {r6('smape', 'smape')} FROM stats"),
        "metrics_clock": _with(
            BACKTEST, "SELECT entity, truck, current_date AS day, TRUE AS one_moment FROM stats"
        ),
        "metrics_table": _with(
            BACKTEST,
            """SELECT entity, truck, round_even(mean, 2) AS mean, round_even(sd, 2) AS sd,
              round_even(sd / nullif(mean, 0), 2) AS cv, round_even(mae, 2) AS mae, round_even(mse, 2) AS mse,
              round_even(rmse, 2) AS rmse,
              round_even(round_even(rmse / nullif(mean, 0), 3), 2) AS nrmse_mean,
              round_even(round_even(rmse / nullif(sd, 0), 3), 2) AS nrmse_sd,
              round_even(round_even(rmse / nullif(iq, 0), 3), 2) AS nrmse_iq,
              round_even(mape, 2) AS mape, round_even(smape, 2) AS smape FROM stats""",
        ),
        "model_mae": _with(MODELS, f"SELECT entity, model, {r6('mae', 'mae')} FROM maes"),
        "model_select": _with(
            MODELS,
            f"SELECT entity, arg_min(model, (mae, pos)) AS model, {r6('min(mae)', 'mae')} FROM maes GROUP BY 1",
        ),
        "distinct_entities": _with(RESOLVED, "SELECT DISTINCT dest_name, dest_zone2 FROM resolved"),
        # sort, limit, top-k
        "topk_trucks_4": _with(CUSTOMER_ROWS, "SELECT * FROM top_c"),
        "topk_trucks_2": _with(REGION_ROWS, "SELECT * FROM top_r"),
        "topk_customers_9": _with(CUSTOMER_ROWS, "SELECT * FROM top_e"),
        "abt_tail_63": _with(ABT_C, "SELECT * FROM abt_c ORDER BY ship_date DESC, entity DESC LIMIT 63"),
        "abt_tail_28": _with(ABT_R, "SELECT * FROM abt_r ORDER BY ship_date DESC, entity DESC LIMIT 28"),
        "head_5": _with(ABT_R, "SELECT * FROM abt_r ORDER BY ship_date, entity LIMIT 5"),
        # set operations
        "segment_union": _with(
            RESOLVED,
            """SELECT shipment_xid, segment, dest_zone2, total_volume FROM resolved WHERE segment = 'AUTOMOBILE'
            UNION ALL
            SELECT shipment_xid, segment, dest_zone2, total_volume FROM resolved WHERE segment = 'HOUSEHOLD'""",
        ),
        "matrix_dedup": _with(MATRIX, "SELECT DISTINCT * FROM matrix"),
        # scalar functions
        "parse_dates": _with(
            FORECAST,
            "SELECT id, date_str, CAST(strptime(date_str, '%Y/%b/%d') AS DATE) AS ship_date FROM forecast",
        ),
        "rejected_dates": """SELECT count(*) FILTER (WHERE o_totalprice < 10000) AS n_rejected, count(*) AS n_rows
            FROM orders""",
        "upper_region": _with(FORECAST, "SELECT id, upper(cust_region) AS cust_region FROM forecast"),
        "ts_to_date": "SELECT event_id, ts, CAST(ts AS DATE) AS event_date FROM events",
        "calendar_features": _with(
            RESOLVED, f"SELECT ship_date, {CALENDAR} FROM (SELECT DISTINCT ship_date FROM resolved)"
        ),
        "date_labels": _with(
            RESOLVED,
            """SELECT ship_date, strftime(ship_date, '%b %d %Y') AS label, strftime(ship_date, '%b %d') AS short_label,
              CAST(strptime(strftime(ship_date, '%b %d %Y'), '%b %d %Y') AS DATE) AS parsed
            FROM (SELECT DISTINCT ship_date FROM resolved)""",
        ),
        "truck_short_name": """SELECT DISTINCT 'DOM.' || p_type AS equipment_gid, p_type AS truck
            FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "round_half_even": _with(
            SHIPMENTS,
            """SELECT shipment_xid, round_even(total_actual_cost, 2) AS cost,
              CAST(round_even(total_volume / 4, 0) AS BIGINT) AS trucks, sqrt(abs(0 - total_volume)) AS root
            FROM shipments""",
        ),
        # reshaping
        "vol_pivot_region": _with(VOLUMES, _pivot("volumes", REGIONS)),
        "vol_pivot_customer": _with(CUSTOMER_VOLUMES, _pivot("volumes", NATIONS)),
        "abt_vol_pivot": _with(
            f"{ABT_C}, tail AS (SELECT * FROM abt_c ORDER BY ship_date DESC, entity DESC LIMIT 63)",
            _pivot("tail", CUSTOMERS),
        ),
        "unpivot_volumes": _with(
            f"{VOLUMES}, wide AS ({_pivot('volumes', REGIONS)})",
            " UNION ALL ".join(
                f"SELECT ship_date, '{e}' AS entity, \"{e}\" AS total_volume FROM wide" for e in REGIONS
            ),
        ),
        "transpose_volumes": _with(week_cells, f"SELECT entity, {week_columns} FROM cells GROUP BY entity"),
        "transpose_roundtrip": _with(week_cells, "SELECT * FROM cells"),
        "fleet_wide": _with(ABT_R, _matrix("abt_r", LOADS)),
        "fleet_rule_matrix": _with(MATRIX, "SELECT * FROM matrix"),
        "what_if_volumes": _with(
            EDITED, f"SELECT ship_date, entity, total_volume, {CALENDAR} FROM edited"
        ),
        "what_if_fleet": _with(EDITED, _matrix("edited", V_LOADS)),
        "what_if_delta": _with(EDITED, _matrix("edited", V_LOADS)),
        "volume_grid": _with(GRID, "SELECT * FROM grid"),
        "rejected_edits": _with(
            GRID,
            """SELECT count(*) FILTER (WHERE isodow(ship_date) = 7) AS n_rejected, count(*) AS n_rows
            FROM grid WHERE isodow(ship_date) >= 6""",
        ),
        "prep_customer": _with(
            CUSTOMER_ROWS, "SELECT ship_date, entity, equipment_gid, shipment_xid, total_volume, truck FROM prep_c"
        ),
        "prep_region": _with(
            REGION_ROWS, "SELECT ship_date, entity, equipment_gid, shipment_xid, total_volume, truck FROM prep_r"
        ),
        # forecasting
        "model_store": _with(
            ACTUALS,
            """SELECT entity, truck, count(*) AS n_forecasts, CAST(0 AS BIGINT) AS n_changed
            FROM actuals GROUP BY 1, 2""",
        ),
        "fit_coverage": _with(
            ACTUALS,
            """SELECT entity, truck, model, count(*) AS n_cells, CAST(0 AS BIGINT) AS n_missing,
              CAST(0 AS BIGINT) AS n_outside, CAST(sum(n_shipments) AS DOUBLE) AS shipped
            FROM actuals, (VALUES ('random_forest'), ('adaboost'), ('extra_trees'), ('gradient_boosting'),
              ('random_forest_2')) m(model)
            WHERE datediff('day', DATE '1970-01-01', ship_date) % 5 = 4 GROUP BY 1, 2, 3""",
        ),
        "fleet_coverage": _with(
            f"{REGION_ROWS}, {GRID}",
            """SELECT entity, substr(equipment_gid, 5) AS truck, count(*) AS n_forecasts,
              count(DISTINCT ship_date) AS n_days, CAST(0 AS BIGINT) AS n_wrong
            FROM grid, top_r GROUP BY 1, 2""",
        ),
        "train_sides_digest": _with(
            f"{REGION_ROWS}, {CUSTOMER_PART}",
            f"""SELECT 'region' AS side, entity, count(DISTINCT ship_date) AS n_held, TRUE AS is_lowest
            FROM prep_r WHERE {HELD} GROUP BY entity
            UNION ALL
            SELECT 'customer', entity, count(DISTINCT ship_date), TRUE FROM prep_c WHERE {HELD} GROUP BY entity""",
        ),
        "train_all_digest": _with(
            REGION_ROWS,
            f"""SELECT entity, count(DISTINCT ship_date) AS n_held, TRUE AS is_lowest
            FROM prep_r WHERE {HELD} GROUP BY entity""",
        ),
        **{
            name: _with(
                ACTUALS,
                f"""SELECT a.truck, count(*) AS n_cells, CAST(sum(n_shipments) AS DOUBLE) AS shipped,
                  round_even(avg(abs(n_shipments - mean)) * 1000000, 0) / 1000000 AS mean_mae, TRUE AS learned
                FROM actuals a JOIN (SELECT entity, truck, avg(n_shipments) AS mean FROM actuals WHERE NOT {HELD} GROUP BY 1, 2) m
                  ON a.entity = m.entity AND a.truck = m.truck
                WHERE {HELD} GROUP BY 1""",
            )
            for name in ("fit_rf_digest", "fit_adaboost_digest", "fit_extratrees_digest", "fit_gbt_digest", "fit_rf_2_digest")
        },
        "accuracy_digest": _with(
            ACTUALS,
            f"""SELECT entity, truck, round_even(avg(n_shipments) * 1000000, 0) / 1000000 AS mean,
              round_even(stddev_pop(n_shipments) * 1000000, 0) / 1000000 AS sd,
              round_even(stddev_pop(n_shipments) / nullif(avg(n_shipments), 0) * 1000000, 0) / 1000000 AS cv, TRUE AS ordered
            FROM actuals WHERE {HELD} GROUP BY 1, 2""",
        ),
        "resolved_run": _with(
            BOTH,
            """SELECT CAST(start_ts AS DATE) AS ship_date, location_name AS dest_name, segment, count(*) AS n_rows,
              sum(total_volume) AS total_volume
            FROM shipments s JOIN locations d ON s.dest_location_gid = d.location_gid
            WHERE principal = 'N' AND perspective = 'O' AND s.domain_name LIKE '%Brand#1%' AND d.domain_name LIKE '%CUST%'
              AND start_ts BETWEEN TIMESTAMP '1999-05-01' AND TIMESTAMP '2001-06-01' GROUP BY 1, 2, 3""",
        ),
        "fleet_region_shape": _with(
            GRID,
            "SELECT ship_date, CAST(10 AS BIGINT) AS n_columns, TRUE AS sends_trucks FROM grid GROUP BY 1",
        ),
        "fleet_customer_coverage": _with(
            f"{CUSTOMER_ROWS}, {CUSTOMER_DAYS}",
            """SELECT entity, substr(equipment_gid, 5) AS truck, count(*) AS n_forecasts,
              count(DISTINCT ship_date) AS n_days, CAST(0 AS BIGINT) AS n_wrong
            FROM upload_days, top_e, top_c GROUP BY 1, 2""",
        ),
        "fleet_customer_missing": _with(
            f"{CUSTOMER_ROWS}, {CUSTOMER_DAYS}",
            """SELECT entity, (SELECT count(*) FROM upload_days) AS n_rows FROM upload_names
            WHERE entity NOT IN (SELECT entity FROM top_e)""",
        ),
        "fleet_tail_coverage": _with(
            ABT_R,
            """SELECT ship_date, entity, CAST(2 AS BIGINT) AS n_trucks, CAST(0 AS BIGINT) AS n_wrong
            FROM (SELECT ship_date, entity FROM abt_r ORDER BY 1 DESC, 2 DESC LIMIT 35)""",
        ),
        "holdout_exact": _with(
            ABT_R,
            """SELECT ship_date, entity, total_volume,
              row_number() OVER (PARTITION BY entity ORDER BY md5('42|' || ship_date::VARCHAR || '|' || entity))
                <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY entity)) AS is_train FROM abt_r""",
        ),
        "reload_daily": _with(ACTUALS, "SELECT ship_date, entity, total_volume, truck, n_shipments FROM actuals"),
        "holdout_split": _with(
            ABT_R,
            """SELECT ship_date, entity, total_volume,
              datediff('day', DATE '1970-01-01', ship_date) % 5 < 4 AS is_train FROM abt_r""",
        ),
    }
