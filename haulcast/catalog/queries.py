"""Every operator as a query over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast import schemas
from haulcast.functions import dates
from haulcast.functions.numbers import quoted, round_all_doubles, round_even, whole
from haulcast.functions.text import fleet_column_names, truck_short_name
from haulcast.models import training
from haulcast.models.candidates import Settings
from haulcast.operators import abt, filters, joins, metrics, reshape, split, topk
from haulcast.plans import batch, forecast, history, reload, volume
from haulcast.session import tune
from haulcast.sources import files, inference, sqltext, standin
from haulcast.staging import new_path, stage_table

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2001, 6, 1)  # inside the forecast table
AS_OF_LAST_WEEK = date(2001, 7, 26)  # seven forecast days remain
AS_OF_AFTER = date(2009, 1, 1)  # nothing remains
WEEK = [AS_OF_LAST_WEEK + timedelta(days=i) for i in range(7)]

SEGMENTS = [*standin.CUSTOMER_SEGMENTS, *standin.REGION_SEGMENTS]
CUSTOMER_SIDE = history.customer_side(standin.CUSTOMER_SEGMENTS, standin.SYNONYMS)
REGION_SIDE = history.region_side(standin.REGION_SEGMENTS)

#: Volume per truck of the fixed forecast rule, and the rules compared as models.
LOADS = {"ECONOMY": 8.0, "LARGE": 10.0, "MEDIUM": 16.0, "PROMO": 20.0, "SMALL": 32.0, "STANDARD": 40.0}
RULES = {"rule_8": 8.0, "rule_20": 20.0, "rule_40": 40.0, "rule_80": 80.0, "rule_8_again": 8.0}
V_LOADS = {"MEDIUM": 40000.0, "STANDARD": 90000.0}

#: Models of a side are fitted once for a session and its tables, with all candidates.
_FITTED: dict[tuple[str, str, str], tuple[training.Trained, DataFrame, DataFrame]] = {}
_ON_TRAINING_DAYS: dict[tuple[str, str], DataFrame] = {}

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    # A trailing underscore keeps a query apart from the operator it shows.
    _REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return {name: partial(_tuned, fn) for name, fn in _REGISTRY.items()}


def _tuned(fn: Query, spark: SparkSession, sf: str) -> DataFrame:
    return fn(tune(spark), sf)


# --- shared inputs ---------------------------------------------------------


def _region_rows(spark: SparkSession, sf: str) -> DataFrame:
    return history.side_rows(standin.resolved(spark, sf), REGION_SIDE)


def _customer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return history.side_rows(standin.resolved(spark, sf), CUSTOMER_SIDE)


def _trucked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("truck", truck_short_name(F.col("equipment_gid")))


def _side(spark: SparkSession, sf: str, side: history.Side) -> history.SideHistory:
    return history.open_side(standin.resolved(spark, sf), side)


def _region_abt(spark: SparkSession, sf: str) -> DataFrame:
    return _side(spark, sf, REGION_SIDE).base_table(standin.TRUCKS)


def _customer_abt(spark: SparkSession, sf: str) -> DataFrame:
    return _side(spark, sf, CUSTOMER_SIDE).base_table(standin.TRUCKS)


def _parsed(spark: SparkSession, sf: str, entity: str = "r_name") -> DataFrame:
    return volume.parse(standin.volume_forecast(spark, sf, entity))


def _region_volumes(spark: SparkSession, sf: str) -> DataFrame:
    return volume.daily(_parsed(spark, sf), standin.REGION_SEGMENTS)


def _region_grid(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.volume_grid(_region_volumes(spark, sf), standin.REGIONS)


def _last_week(spark: SparkSession, sf: str) -> DataFrame:
    loaded = volume.load(standin.volume_forecast(spark, sf), AS_OF_LAST_WEEK)
    return reshape.volume_pivot(volume.daily(loaded, standin.REGION_SEGMENTS), standin.REGIONS)


def _weekend_edits(volumes: DataFrame) -> DataFrame:
    """Edited cells as text: Saturdays doubled and raised, Sundays left unreadable."""
    weekday = F.weekday("ship_date")
    return volumes.where(weekday >= 5).select(
        "ship_date",
        "entity",
        F.when(weekday == 5, (F.col("total_volume") * 2 + 1000).cast("string")).otherwise(F.lit("n/a")).alias("volume_text"),
    )


def _actuals(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts of the region side's top trucks, zero days included."""
    return _side(spark, sf, REGION_SIDE).long_counts()


def _backtest(spark: SparkSession, sf: str, rules: dict[str, float]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias("model"), F.rint(F.col("total_volume") / F.lit(load)).alias("forecast"))
        for name, load in rules.items()
    ]
    return _actuals(spark, sf).select(
        "ship_date",
        "entity",
        "truck",
        F.col("n_shipments").cast("double").alias("actual"),
        F.explode(F.array(cells)).alias("cell"),
    ).select("ship_date", "entity", "truck", "cell.model", "actual", "cell.forecast")


def _rule_matrix(spark: SparkSession, sf: str) -> DataFrame:
    features = volume.features(_region_grid(spark, sf))
    fleet = forecast.linear_rule(features, V_LOADS)
    return forecast.matrix(features, fleet, standin.REGIONS, list(V_LOADS))


# --- scans, sources, sinks ---------------------------------------------------


@query
def scan_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return sqltext.run(spark, "forecast_all", forecast=standin.volume_forecast(spark, sf))


@query
def scan_forecast_current(spark: SparkSession, sf: str) -> DataFrame:
    return sqltext.run(
        spark, "forecast_current", {"as_of": AS_OF}, forecast=standin.volume_forecast(spark, sf)
    )


@query
def scan_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return standin.shipments(spark, sf).select([f.name for f in schemas.SHIPMENTS.fields])


@query
def recent_shipments_sql(spark: SparkSession, sf: str) -> DataFrame:
    args = {"principal": "N", "domain": "Brand#1", "perspective": "O", "as_of": str(AS_OF)}
    return sqltext.run(
        spark,
        "shipments_recent",
        args,
        shipments=standin.shipments(spark, sf),
        locations=standin.locations(spark, sf),
    )


@query
def training_shipments_sql(spark: SparkSession, sf: str) -> DataFrame:
    args = {
        "principal": "N",
        "perspective": "O",
        "domain_pattern": "%Brand#1%",
        "location_domain_pattern": "%BASE/%",
        "as_of": str(AS_OF),
        **{f"segment_{i + 1}": s for i, s in enumerate(SEGMENTS)},
    }
    return sqltext.run(
        spark,
        "shipments_training",
        args,
        shipments=standin.shipments(spark, sf),
        locations=standin.locations(spark, sf),
    )


@query
def csv_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types found in a CSV copy of the orders, and how many cells refuse each other type."""
    path = new_path(spark, "csv")
    files.write_csv(standin.table(spark, sf, "orders"), path)
    return inference.column_types(inference.read_text_columns(spark, path))


@query
def csv_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """The orders, read back from CSV without a schema."""
    path = new_path(spark, "csv")
    files.write_csv(standin.table(spark, sf, "orders"), path)
    return inference.read_csv_inferred(spark, path)


@query
def csv_headerless(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast table as exported: nine columns, no header."""
    rows = standin.volume_forecast(spark, sf)
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.VOLUME_FORECAST.fields if f.name not in rows.columns]
    path = new_path(spark, "csv")
    rows.select("*", *more).select(*schemas.VOLUME_FORECAST.names).write.csv(path)
    return files.read_forecast_csv(spark, path).select(*rows.columns)


@query
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    out = standin.resolved(spark, sf).select(
        "shipment_xid", "start_ts", "ship_date", "total_volume", "equipment_gid", "segment", "dest_name", "dest_zone2"
    )
    path = new_path(spark, "csv")
    files.write_csv(out, path)
    return files.read_csv(spark, path, out.schema)


@query
def json_stage(spark: SparkSession, sf: str) -> DataFrame:
    out = _region_volumes(spark, sf)
    path = new_path(spark, "json")
    files.write_json(out, path)
    return files.read_json(spark, path, out.schema)


@query
def forecast_fallback_hit(spark: SparkSession, sf: str) -> DataFrame:
    return volume.load(standin.volume_forecast(spark, sf), AS_OF)


@query
def forecast_fallback_miss(spark: SparkSession, sf: str) -> DataFrame:
    return volume.load(standin.volume_forecast(spark, sf), AS_OF_AFTER)


@query
def matrix_sink(spark: SparkSession, sf: str) -> DataFrame:
    out = _rule_matrix(spark, sf)
    path = new_path(spark, "matrix")
    files.write_matrix(out, path, "csv")
    return files.read_matrix(spark, path, out.schema, "csv")


@query
def wide_forecast_tail(spark: SparkSession, sf: str) -> DataFrame:
    out = _rule_matrix(spark, sf)
    path = new_path(spark, "matrix")
    files.write_matrix(out, path)
    return topk.last_rows(files.read_matrix(spark, path, out.schema), 7, ["ship_date"])


# --- projections, filters, predicates -----------------------------------------


@query
def project_alias(spark: SparkSession, sf: str) -> DataFrame:
    return standin.shipments(spark, sf).select(
        "shipment_xid",
        F.col("driver_id").alias("ATTRIBUTE4(DRIVER_ID)"),
        F.col("vehicle_no").alias("ATTRIBUTE5(VEHICLE_NO)"),
        F.col("route").alias("ATTRIBUTE2(ROUTE)"),
        F.col("total_volume"),
    )


@query
def features(spark: SparkSession, sf: str) -> DataFrame:
    return _region_abt(spark, sf).select("ship_date", "entity", *dates.FEATURES)


@query
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    kept = standin.shipments(spark, sf).where((F.col("principal") == "N") & (F.col("perspective") == "O"))
    return kept.select("shipment_xid", "principal", "perspective", "total_volume")


@query
def filter_like(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.contains(standin.shipments(spark, sf), "domain_name", "Brand#1")
    return kept.select("shipment_xid", "domain_name", "total_volume")


@query
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.in_segments(standin.resolved(spark, sf), SEGMENTS)
    return kept.select("shipment_xid", "segment", "total_volume")


@query
def filter_trailing_25m(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.trailing_months(standin.shipments(spark, sf), "start_ts", 25, AS_OF, closed=True)
    return kept.select("shipment_xid", "start_ts", "total_volume")


@query
def filter_trailing_1m(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.trailing_months(standin.shipments(spark, sf), "start_ts", 1, AS_OF, closed=False)
    return kept.select("shipment_xid", "start_ts", "total_volume")


@query
def entity_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    """Destinations that also have a supplier-side location with a positive balance."""
    supplier, nation = standin.table(spark, sf, "supplier"), standin.table(spark, sf, "nation")
    listed = (
        supplier.where(F.col("s_acctbal") > 9000)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("entity"))
    )
    rows = standin.resolved(spark, sf).withColumnRenamed("dest_name", "entity")
    return filters.allowed_entities(rows, listed).select("entity", "shipment_xid", "total_volume")


@query
def entity_canonicalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = standin.resolved(spark, sf).select("shipment_xid", "dest_name", "total_volume")
    pairs = spark.createDataFrame(list(standin.SYNONYMS.items()), "variant string, name string")
    return filters.canonicalise(rows, pairs, "dest_name")


@query
def round_all_doubles_(spark: SparkSession, sf: str) -> DataFrame:
    rows = standin.shipments(spark, sf).select(
        "shipment_xid", "principal", "total_weight", "total_actual_cost", "loaded_distance"
    )
    return round_all_doubles(rows)


def _or_zero_row(rows: DataFrame) -> DataFrame:
    default = {"ship_date": F.lit(AS_OF_AFTER), "entity": F.lit("none"), "total_volume": F.lit(0.0)}
    return filters.or_default(volume.daily(rows), default, probe=rows)


@query
def empty_default(spark: SparkSession, sf: str) -> DataFrame:
    """No forecast day is left, so the display gets its one zero row."""
    rows = filters.in_segments(_parsed(spark, sf), standin.REGION_SEGMENTS)
    return _or_zero_row(rows.where(F.col("ship_date") >= F.lit(AS_OF_AFTER)))


@query
def empty_default_unused(spark: SparkSession, sf: str) -> DataFrame:
    return _or_zero_row(filters.in_segments(_parsed(spark, sf), standin.REGION_SEGMENTS))


@query
def error_widths(spark: SparkSession, sf: str) -> DataFrame:
    rows = _region_rows(spark, sf).groupBy("ship_date", "entity").agg(
        F.avg("total_volume").alias("y"), F.max("total_volume").alias("y_ub"), F.min("total_volume").alias("y_lb")
    )
    return reshape.error_widths(rows, "y", "y_ub", "y_lb")


@query
def entities_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    listed = [r for r in standin.REGIONS if r != "ASIA"]
    return filters.uncovered(_region_volumes(spark, sf), listed)


# --- joins ---------------------------------------------------------------------


@query
def join_inner_dest(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.with_destination(standin.shipments(spark, sf), standin.locations(spark, sf), "inner")
    return out.select("shipment_xid", "dest_location_gid", *joins.DESTINATION.values(), "total_volume")


@query
def join_left_dest(spark: SparkSession, sf: str) -> DataFrame:
    """Locations outside the four segments are left out, so some rows stay unmatched."""
    known = filters.in_segments(standin.locations(spark, sf), SEGMENTS)
    out = joins.with_destination(standin.shipments(spark, sf), known, "left")
    return out.select("shipment_xid", "dest_location_gid", "dest_name", "segment", "total_volume")


@query
def join_two_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Orders get their destination before the lines meet them: an order's lines share it, and the lines are shuffled once less."""
    locations = standin.locations(spark, sf)
    heads = joins.with_destination(standin.order_heads(spark, sf), locations, "left")
    out = joins.with_source(standin.shipments(spark, sf, heads), locations)
    return out.select("shipment_xid", "source_name", "dest_name", "dest_zone2", "total_volume")


@query
def scalar_subquery_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return sqltext.run(
        spark, "location_lookup", shipments=standin.shipments(spark, sf), locations=standin.locations(spark, sf)
    )


@query
def backtest_join(spark: SparkSession, sf: str) -> DataFrame:
    held = _actuals(spark, sf).where(~metrics.is_training_day(F.col("ship_date")))
    predicted = forecast.linear_rule(held.select("ship_date", "entity", "total_volume").distinct(), LOADS)
    out = metrics.with_forecasts(held, predicted)
    return out.select("ship_date", "entity", "truck", F.col("n_shipments").alias("actual"), "forecast")


@query
def fleet_spine_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every forecast day of every region; days without volumes to score stay."""
    feats = volume.features(_region_volumes(spark, sf))
    fleet = forecast.linear_rule(feats.where(F.col("total_volume") > 0), V_LOADS)
    return reshape.spine_join(feats, fleet)


@query
def semi_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _region_rows(spark, sf)
    top = topk.top_k(topk.frequencies(rows, "equipment_gid"), "equipment_gid", "n_rows", 2)
    return topk.keep_top(rows, "equipment_gid", top)


@query
def anti_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _region_rows(spark, sf)
    top = topk.top_k(topk.frequencies(rows, "equipment_gid"), "equipment_gid", "n_rows", 2)
    return topk.drop_top(rows, "equipment_gid", top)


# --- aggregations ----------------------------------------------------------------


@query
def truck_counts(spark: SparkSession, sf: str) -> DataFrame:
    return abt.truck_counts(_trucked(_region_rows(spark, sf)))


@query
def daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    return abt.daily_volume(_region_rows(spark, sf))


@query
def volume_by_customer(spark: SparkSession, sf: str) -> DataFrame:
    out = history.volume_by_entity(history.profile(_customer_rows(spark, sf)))
    return out.orderBy(F.desc("total_volume"), "entity")


@query
def truck_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return topk.frequencies(_customer_rows(spark, sf), "equipment_gid")


@query
def abt_customer(spark: SparkSession, sf: str) -> DataFrame:
    return _customer_abt(spark, sf)


@query
def abt_region(spark: SparkSession, sf: str) -> DataFrame:
    return _region_abt(spark, sf)


@query
def date_span(spark: SparkSession, sf: str) -> DataFrame:
    return standin.resolved(spark, sf).agg(F.min("ship_date").alias("min_date"), F.max("ship_date").alias("max_date"))


def _metrics(spark: SparkSession, sf: str, **columns) -> DataFrame:
    rows = _backtest(spark, sf, {"rule_40": RULES["rule_40"]})
    return rows.groupBy("entity", "truck").agg(*[round_even(c, 6).alias(n) for n, c in columns.items()])


@query
def metrics_basic(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, mean=metrics.mean(), sd=metrics.sd(), cv=metrics.cv())


@query
def metrics_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, mae=metrics.mae(), mse=metrics.mse(), rmse=metrics.rmse())


@query
def metrics_nrmse(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, **{f"nrmse_{k}": metrics.nrmse(k) for k in ("sd", "mean", "maxmin", "iq")})


@query
def metrics_mape(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, mape=metrics.mape())


@query
def metrics_smape(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, smape=metrics.smape())


@query
def metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_table(_backtest(spark, sf, {"rule_40": RULES["rule_40"]}), places=2)


@query
def metrics_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The moment that a metric table carries: one for all rows, of today."""
    table = metrics.metric_table(_backtest(spark, sf, {"rule_40": RULES["rule_40"]}), clock=True)
    one = (F.col("date_time") == F.current_timestamp()).alias("one_moment")
    return table.select("entity", "truck", F.to_date("date_time").alias("day"), one)


@query
def model_mae(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.model_mae(_backtest(spark, sf, RULES))
    return out.withColumn("mae", round_even(F.col("mae"), 6))


@query
def model_select(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.select_model(metrics.model_mae(_backtest(spark, sf, RULES)), list(RULES))
    return out.withColumn("mae", round_even(F.col("mae"), 6))


@query
def distinct_entities(spark: SparkSession, sf: str) -> DataFrame:
    return standin.resolved(spark, sf).select("dest_name", "dest_zone2").distinct()


# --- sort, limit, top-k ------------------------------------------------------------


@query
def topk_trucks_4(spark: SparkSession, sf: str) -> DataFrame:
    return history.top_trucks(history.profile(_customer_rows(spark, sf)), 4)


@query
def topk_trucks_2(spark: SparkSession, sf: str) -> DataFrame:
    return history.top_trucks(history.profile(_region_rows(spark, sf)), 2)


@query
def topk_customers_9(spark: SparkSession, sf: str) -> DataFrame:
    profiled = history.profile(_customer_rows(spark, sf))
    return history.top_entities(profiled, history.top_trucks(profiled, 4), 9)


@query
def abt_tail_63(spark: SparkSession, sf: str) -> DataFrame:
    return topk.last_rows(_customer_abt(spark, sf), 7 * 9, ["ship_date", "entity"])


@query
def abt_tail_28(spark: SparkSession, sf: str) -> DataFrame:
    return topk.last_rows(_region_abt(spark, sf), 7 * 4, ["ship_date", "entity"])


@query
def head_5(spark: SparkSession, sf: str) -> DataFrame:
    return topk.first_rows(_region_abt(spark, sf), 5, ["ship_date", "entity"])


# --- set operations -----------------------------------------------------------------


@query
def segment_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = standin.resolved(spark, sf).select("shipment_xid", "segment", "dest_zone2", "total_volume")
    first, second = (rows.where(F.col("segment") == s) for s in standin.REGION_SEGMENTS)
    return first.unionByName(second)


@query
def matrix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The spine repeats a day once per region, as the scoring loop's index does."""
    spine = _region_volumes(spark, sf).select("ship_date")
    return reshape.dedup_matrix(spine.join(_rule_matrix(spark, sf), "ship_date", "left"))


# --- scalar functions -----------------------------------------------------------------


@query
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = standin.volume_forecast(spark, sf)
    return raw.select("id", "date_str", dates.forecast_date(F.col("date_str")).alias("ship_date"))


@query
def rejected_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text is no date; here the low-price rows carry a damaged one."""
    raw = standin.volume_forecast(spark, sf)
    damaged = raw.withColumn(
        "date_str", F.when(F.col("volume_forecast") < 10000, F.lit("2001/Foo/99")).otherwise(F.col("date_str"))
    )
    return volume.rejected_dates(damaged)


@query
def upper_region(spark: SparkSession, sf: str) -> DataFrame:
    raw = standin.volume_forecast(spark, sf)
    return raw.select("id", F.upper("cust_region").alias("cust_region"))


@query
def ts_to_date(spark: SparkSession, sf: str) -> DataFrame:
    return standin.table(spark, sf, "events").select(
        "event_id", "ts", F.to_date("ts").alias("event_date")
    )


@query
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    return dates.with_calendar(standin.resolved(spark, sf).select("ship_date").distinct())


@query
def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    days = standin.resolved(spark, sf).select("ship_date").distinct()
    long, short = dates.label(F.col("ship_date")), dates.label(F.col("ship_date"), dates.LABEL_SHORT)
    return days.select(
        "ship_date", long.alias("label"), short.alias("short_label"), dates.label_to_date(long).alias("parsed")
    )


@query
def truck_short_name_(spark: SparkSession, sf: str) -> DataFrame:
    gids = standin.resolved(spark, sf).select("equipment_gid").distinct()
    return gids.select("equipment_gid", truck_short_name(F.col("equipment_gid")).alias("truck"))


@query
def round_half_even(spark: SparkSession, sf: str) -> DataFrame:
    rows = standin.shipments(spark, sf)
    return rows.select(
        "shipment_xid",
        round_even(F.col("total_actual_cost"), 2).alias("cost"),
        whole(F.col("total_volume") / 4).alias("trucks"),
        F.sqrt(F.abs(F.lit(0.0) - F.col("total_volume"))).alias("root"),
    )


# --- reshaping ----------------------------------------------------------------------


@query
def vol_pivot_region(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.volume_pivot(_region_volumes(spark, sf), standin.REGIONS)


@query
def vol_pivot_customer(spark: SparkSession, sf: str) -> DataFrame:
    daily = volume.daily(_parsed(spark, sf, "n_name"), standin.CUSTOMER_SEGMENTS)
    return reshape.volume_pivot(daily, standin.NATIONS)


@query
def abt_vol_pivot(spark: SparkSession, sf: str) -> DataFrame:
    tail = topk.last_rows(_customer_abt(spark, sf), 7 * 9, ["ship_date", "entity"])
    return reshape.volume_pivot(tail, standin.CUSTOMERS)


@query
def unpivot_volumes(spark: SparkSession, sf: str) -> DataFrame:
    wide = reshape.volume_pivot(_region_volumes(spark, sf), standin.REGIONS)
    return reshape.volume_unpivot(wide, standin.REGIONS)


@query
def volume_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _region_grid(spark, sf)


@query
def transpose_volumes(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.transpose_days(_last_week(spark, sf), standin.REGIONS, WEEK)


@query
def transpose_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    shown = reshape.transpose_days(_last_week(spark, sf), standin.REGIONS, WEEK)
    return reshape.days_to_rows(shown, [dates.label_of(d) for d in WEEK])


@query
def fleet_wide(spark: SparkSession, sf: str) -> DataFrame:
    feats = _region_abt(spark, sf).select("ship_date", "entity", *dates.FEATURES)
    fleet = forecast.linear_rule(feats, LOADS)
    return forecast.matrix(feats, fleet, standin.REGIONS, standin.TRUCKS)


@query
def fleet_rule_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_matrix(spark, sf)


@query
def what_if_volumes(spark: SparkSession, sf: str) -> DataFrame:
    grid = _region_grid(spark, sf)
    return volume.features(volume.what_if(grid, _weekend_edits(grid)))


@query
def what_if_fleet(spark: SparkSession, sf: str) -> DataFrame:
    grid = _region_grid(spark, sf)
    feats = volume.features(volume.what_if(grid, _weekend_edits(grid)))
    fleet = forecast.linear_rule(feats, V_LOADS)
    return forecast.matrix(feats, fleet, standin.REGIONS, list(V_LOADS))


@query
def what_if_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The same matrix, from the forecast before the edits and the edited cells alone."""
    grid = _region_grid(spark, sf)
    changed = volume.changed_cells(grid, _weekend_edits(grid))
    before = forecast.linear_rule(volume.features(grid), V_LOADS)
    fleet = forecast.rescored(before, changed, lambda cells: forecast.linear_rule(cells, V_LOADS))
    return forecast.matrix(volume.features(grid), fleet, standin.REGIONS, list(V_LOADS))


@query
def rejected_edits(spark: SparkSession, sf: str) -> DataFrame:
    return volume.rejected_edits(_weekend_edits(_region_grid(spark, sf)))


@query
def prep_customer(spark: SparkSession, sf: str) -> DataFrame:
    return history.open_side(history.clean(standin.resolved(spark, sf)), CUSTOMER_SIDE).prepared()


@query
def prep_region(spark: SparkSession, sf: str) -> DataFrame:
    return history.open_side(history.clean(standin.resolved(spark, sf)), REGION_SIDE).prepared()


# --- forecasting ----------------------------------------------------------------------


@query
def holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = _region_abt(spark, sf).select("ship_date", "entity", "total_volume")
    return rows.withColumn("is_train", metrics.is_training_day(F.col("ship_date")))


@query
def holdout_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Of each region's days exactly the floor of 80 % train."""
    rows = _region_abt(spark, sf).select("ship_date", "entity", "total_volume")
    return split.exact_split(rows, "entity", ["ship_date", "entity"], 0.8, seed=42)


@query
def reload_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Counts from a store whose last week came in late: first loaded in part, then made anew for its days."""
    rows, path = _region_rows(spark, sf), new_path(spark, "daily")
    late = F.col("ship_date").isin(WEEK) & (F.col("shipment_xid") % 2 == 0)
    reload.load_all(path, rows.where(~late))
    reload.reload_days(spark, path, rows, WEEK)
    base = reload.base_table(reload.stored(spark, path), REGION_SIDE)
    trucks = [c for c in base.columns if c not in ("ship_date", "entity", *dates.FEATURES)]
    return abt.long_counts(base, trucks).select("ship_date", "entity", "total_volume", "truck", "n_shipments")


def _fitted(spark: SparkSession, sf: str, side: history.Side) -> tuple[training.Trained, DataFrame, DataFrame]:
    """All five candidates of a side, the base table they were fitted on, and all their forecasts for its held-out days.

    Fitting is the same work for every query below, so a session does it once per
    side; the written base table and the models are what the queries share.
    """
    key = (spark.sparkContext.applicationId, sf, side.name)
    if key not in _FITTED:
        opened = _side(spark, sf, side)
        base = stage_table(opened.base_table(), f"abt-{side.name}")
        entities = opened.kept_entities or filters.names(base, "entity")
        trained = training.fit(side.name, base, opened.truck_names(), entities, settings=Settings())
        forecasts = stage_table(trained.backtest(_held(base), rounded=False), f"backtest-{side.name}")
        trained.choices = stage_table(training.choose_by(trained, forecasts, base), f"choice-{side.name}")
        trained.accuracy = stage_table(training.own_accuracy(trained, forecasts), f"accuracy-{side.name}")
        _FITTED[key] = trained, base, forecasts
    return _FITTED[key]


def _held(rows: DataFrame) -> DataFrame:
    return rows.where(~metrics.is_training_day(F.col("ship_date")))


def _region_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of every candidate for the days it was fitted on."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ON_TRAINING_DAYS:
        trained, base, _ = _fitted(spark, sf, REGION_SIDE)
        days = base.where(metrics.is_training_day(F.col("ship_date")))
        _ON_TRAINING_DAYS[key] = stage_table(trained.backtest(days, rounded=False), "fit-region")
    return _ON_TRAINING_DAYS[key]


def _against_mean(trained: training.Trained, forecasts: DataFrame, candidate: str) -> DataFrame:
    """Per truck: held-out cells, MAE of the entities' training means there, and whether the candidate learned.

    It learned if its MAE on the training days is below that of the training means.
    """
    held = ~metrics.is_training_day(F.col("ship_date"))
    first = forecasts.where(~held & (F.col("model") == candidate))
    means = first.groupBy("entity", "truck").agg(F.avg("actual").alias("mean"))
    cells = forecasts.where(F.col("model") == candidate).join(means, ["entity", "truck"])
    by_mean, own = F.abs(F.col("actual") - F.col("mean")), F.abs(F.col("actual") - F.col("forecast"))
    return cells.groupBy("truck").agg(
        F.count_if(held).alias("n_cells"),
        F.sum(F.when(held, F.col("actual"))).alias("shipped"),
        round_even(F.avg(F.when(held, by_mean)), 6).alias("mean_mae"),
        (F.avg(F.when(~held, own)) < F.avg(F.when(~held, by_mean))).alias("learned"),
    )


def _fit_one(candidate: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Actual and forecast of one candidate on every held-out day, region and truck."""
        _, _, forecasts = _fitted(spark, sf, REGION_SIDE)
        mine = _held(forecasts).where(F.col("model") == candidate)
        return mine.select("ship_date", "entity", "truck", "actual", "forecast")

    return run


def _fit_digest(candidate: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """One candidate over every region, against forecasting the mean."""
        trained, _, forecasts = _fitted(spark, sf, REGION_SIDE)
        return _against_mean(trained, forecasts.unionByName(_region_fit(spark, sf)), candidate)

    return run


for _name, _candidate in (
    ("fit_rf", "random_forest"),
    ("fit_adaboost", "adaboost"),
    ("fit_extratrees", "extra_trees"),
    ("fit_gbt", "gradient_boosting"),
    ("fit_rf_2", "random_forest_2"),
):
    _REGISTRY[_name] = _fit_one(_candidate)
    _REGISTRY[f"{_name}_digest"] = _fit_digest(_candidate)


@query
def fit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate forecasts every held-out cell once.

    Trees that average or pick training values stay within the range of those
    values; boosting by gradients adds trees up and may leave it.
    """
    trained, base, forecasts = _fitted(spark, sf, REGION_SIDE)
    trained_on = base.where(metrics.is_training_day(F.col("ship_date")))
    ranges = abt.long_counts(trained_on, trained.trucks).groupBy("truck").agg(
        F.min("n_shipments").alias("low"), F.max("n_shipments").alias("high")
    )
    cells = _held(forecasts).withColumn("forecast", F.rint("forecast")).join(ranges, "truck")
    outside = ~F.col("forecast").between(F.col("low"), F.col("high")) & (F.col("model") != "gradient_boosting")
    return cells.groupBy("entity", "truck", "model").agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.col("forecast").isNull()).alias("n_missing"),
        F.count_if(outside).alias("n_outside"),
        F.sum("actual").alias("shipped"),
    )


def _choice_is_lowest(trained: training.Trained, base: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per entity: held-out days, and whether no candidate has a smaller error than the chosen one."""
    maes = metrics.model_mae(_held(forecasts))
    least = maes.groupBy("entity").agg(F.min("mae").alias("least"))
    days = _held(base).groupBy("entity").agg(F.count("*").alias("n_held"))
    own = trained.choices.join(maes.withColumnRenamed("mae", "own"), ["entity", "model"])
    return own.join(least, "entity").join(days, "entity").select(
        "entity", "n_held", (F.abs(F.col("own") - F.col("least")) < 1e-9).alias("is_lowest")
    )


@query
def train_all(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate that each region is given, and its error on the held-out days."""
    return _fitted(spark, sf, REGION_SIDE)[0].choices


@query
def train_all_digest(spark: SparkSession, sf: str) -> DataFrame:
    return _choice_is_lowest(*_fitted(spark, sf, REGION_SIDE))


def _both_sides(spark: SparkSession, sf: str, of: Callable[..., DataFrame]) -> DataFrame:
    parts = [of(*_fitted(spark, sf, s)).withColumn("side", F.lit(s.name)) for s in (REGION_SIDE, CUSTOMER_SIDE)]
    return parts[0].unionByName(parts[1])


@query
def train_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The choices of both sides."""
    return _both_sides(spark, sf, lambda trained, base, forecasts: trained.choices)


@query
def train_sides_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides, each entity with the candidate of the lowest error."""
    return _both_sides(spark, sf, _choice_is_lowest)


@query
def accuracy_table(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the held-out days by each entity's own model."""
    return _fitted(spark, sf, REGION_SIDE)[0].accuracy.drop("date_time")


@query
def accuracy_digest(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on the actuals alone."""
    table = round_all_doubles(_fitted(spark, sf, REGION_SIDE)[0].accuracy, 6)
    return table.select("entity", "truck", "mean", "sd", "cv", (F.col("rmse") >= F.col("mae")).alias("ordered"))


@query
def resolved_run(spark: SparkSession, sf: str) -> DataFrame:
    """The rows a run counts: one principal and perspective, domains by their text, the last 25 months."""
    keep = filters.SourceFilter("N", "O", domain_contains="Brand#1", location_domain_contains="CUST")
    rows = batch.resolve(standin.shipments(spark, sf), standin.locations(spark, sf), 25, AS_OF, True, keep)
    return rows.groupBy("ship_date", "dest_name", "segment").agg(
        F.count("*").alias("n_rows"), F.sum("total_volume").alias("total_volume")
    )


def _shape(matrix: DataFrame) -> DataFrame:
    """Per day of a matrix: its columns, and whether trucks are asked for at all and none below zero."""
    cells = [F.col(quoted(c)) for c in matrix.columns if c != "ship_date"]
    total, least = sum(cells[1:], cells[0]), F.least(*cells)
    n_columns = F.lit(len(cells)).cast("long").alias("n_columns")
    return matrix.select("ship_date", n_columns, ((total > 0) & (least >= 0)).alias("sends_trucks"))


@query
def fleet_region(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded volumes scored by models fitted on the history, as a matrix."""
    trained, _, _ = _fitted(spark, sf, REGION_SIDE)
    return forecast.forecast(trained, volume.features(_region_grid(spark, sf)))


@query
def fleet_region_shape(spark: SparkSession, sf: str) -> DataFrame:
    return _shape(fleet_region(spark, sf))


@query
def fleet_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every uploaded day of every region gets one forecast per kept truck."""
    trained, _, _ = _fitted(spark, sf, REGION_SIDE)
    fleet = trained.score(volume.features(_region_grid(spark, sf)))
    return _covered(fleet)


def _covered(fleet: DataFrame) -> DataFrame:
    return fleet.groupBy("entity", "truck").agg(
        F.count("*").alias("n_forecasts"),
        F.countDistinct("ship_date").alias("n_days"),
        F.count_if(F.col("forecast").isNull()).alias("n_wrong"),
    )


def _customer_features(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded customer volumes under the names of the history."""
    parsed = _parsed(spark, sf, "n_name")
    named = parsed.withColumn("entity", history.entity_key(F.col("entity"), CUSTOMER_SIDE))
    return volume.features(reshape.volume_grid(volume.daily(named, standin.CUSTOMER_SEGMENTS)))


@query
def fleet_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Uploaded volumes of the kept customers, spelling variants under their name."""
    trained, _, _ = _fitted(spark, sf, CUSTOMER_SIDE)
    return trained.score(_customer_features(spark, sf))


@query
def fleet_customer_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _covered(fleet_customer(spark, sf))


@query
def fleet_customer_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of the upload that no model covers, with their days."""
    trained, _, _ = _fitted(spark, sf, CUSTOMER_SIDE)
    return forecast.missing_entities(trained, _customer_features(spark, sf))


@query
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts that change when models are written and read back: none."""
    trained, base, _ = _fitted(spark, sf, REGION_SIDE)
    path = new_path(spark, "models")
    trained.save(path, spark)
    loaded = training.Trained.load(path, REGION_SIDE.name, spark)
    feats = base.select("ship_date", "entity", *dates.FEATURES)
    after = loaded.score(feats).withColumnRenamed("forecast", "after")
    both = trained.score(feats).join(after, ["ship_date", "entity", "truck"], "full")
    same = F.col("forecast").eqNullSafe(F.col("after"))
    return both.groupBy("entity", "truck").agg(
        F.count("*").alias("n_forecasts"), F.count_if(~same).alias("n_changed")
    )


@query
def fleet_history_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The history form: the last rows of the base table are scored directly."""
    trained, base, _ = _fitted(spark, sf, REGION_SIDE)
    table = base.select("ship_date", "entity", *dates.FEATURES)
    tail = topk.last_rows(table, 7 * len(standin.REGIONS), ["ship_date", "entity"])
    return trained.score(tail)


@query
def fleet_tail_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return fleet_history_tail(spark, sf).groupBy("ship_date", "entity").agg(
        F.count("*").alias("n_trucks"), F.count_if(F.col("forecast").isNull()).alias("n_wrong")
    )
