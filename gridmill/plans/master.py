"""Hourly series of load, forecast, wind, solar and prices, and the master table that joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.functions import timeparse as T
from gridmill.functions.text import net_load, number
from gridmill.operators.aggregates import mean_by_time, resample
from gridmill.operators.joins import join_series


def _hourly(df: DataFrame, day: str, hour: str, values: dict[str, str], strict: bool = False) -> DataFrame:
    """Means by beginning hour. An hour column that holds a full time (old files) counts by that, unless strict."""
    begun = T.he_begin(T.parse_date(day).cast("date"), T.parse_hour_ending(hour))
    full = T.parse_datetime(hour)
    ts = begun if strict else F.coalesce(F.when(full.isNotNull(), full - F.expr("interval 1 hour")), begun)
    return mean_by_time(df.select(ts.alias("ts_local"), *[number(f"`{c}`").alias(n) for n, c in values.items()]), "ts_local", {n: n for n in values})


def load(df: DataFrame) -> DataFrame:
    return _hourly(df, "OperDay", "HourEnding", {"load_total": "TOTAL"})


def forecast(df: DataFrame, in_use: bool = False, latest: bool = False) -> DataFrame:
    """Mean over models and vintages. in_use: only models in use; latest: of each target hour and model only the last vintage posted before it."""
    if in_use:
        df = df.where(F.col("InUseFlag") == "Y")
    if latest:
        target = T.he_begin(T.parse_date("DeliveryDate").cast("date"), T.parse_hour_ending("HourEnding"))
        df = df.withColumn("__t", target).withColumn("__i", T.issue_time(df.columns)).where(F.col("__i") <= F.col("__t"))
        df = df.groupBy("__t", "Model", "DeliveryDate", "HourEnding").agg(F.max_by("SystemTotal", "__i").alias("SystemTotal"))
    return _hourly(df, "DeliveryDate", "HourEnding", {"load_forecast": "SystemTotal"})


def wind(df: DataFrame, strict: bool = False) -> DataFrame:
    return _hourly(df, "DELIVERY_DATE", "HOUR_ENDING", {"wind": "ACTUAL_SYSTEM_WIDE"}, strict)


def solar(df: DataFrame, strict: bool = False) -> DataFrame:
    return _hourly(df, "DELIVERY_DATE", "HOUR_ENDING", {"solar": "SYSTEM_WIDE_GEN"}, strict)


def price_times(df: DataFrame) -> DataFrame:
    ts = T.interval_begin(T.parse_date("DeliveryDate").cast("date"), T.parse_hour_ending("DeliveryHour"), F.col("DeliveryInterval").try_cast("int"))
    return df.withColumn("ts_15m", ts).withColumn("price", number("SettlementPointPrice"))


def price(df: DataFrame, fill_gaps: bool = True) -> DataFrame:
    """Hourly mean over all points; hours without rows are there, null."""
    return resample(price_times(df), "ts_15m", {"price": "price"}, fill_gaps=fill_gaps)


def price_by_point(df: DataFrame) -> DataFrame:
    return resample(price_times(df), "ts_15m", {"price": "price"}, "SettlementPointName")


def master(load_df: DataFrame, forecast_df: DataFrame, wind_df: DataFrame, solar_df: DataFrame, price_df: DataFrame, how: str = "outer") -> DataFrame:
    """One row an hour; net load is null unless load, wind and solar are all there."""
    joined = join_series([load_df, forecast_df, wind_df, solar_df, price_df], how=how)
    return joined.withColumn("net_load", net_load("load_total", "wind", "solar")).orderBy("ts_local")
