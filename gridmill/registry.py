"""Datasets, profiles, aliases, earliest dates and keys. Fixed values, in their natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: id -> (title, category)
DATASETS = {
    "NP6-346-CD": ("Actual System Load by Forecast Zone", "load"),
    "NP3-565-CD": ("Seven-Day Load Forecast by Model and Weather Zone", "load_forecast"),
    "NP4-732-CD": ("Wind Power Production - Hourly Averaged Actual and Forecasted Values", "renewables"),
    "NP4-745-CD": ("Solar Power Production - Hourly Averaged Actual and Forecasted Values", "renewables"),
    "NP6-905-CD": ("Settlement Point Prices at Resource Nodes, Hubs and Load Zones", "real_time_prices"),
    "NP6-788-CD": ("LMPs by Resource Nodes, Load Zones and Trading Hubs", "real_time_prices"),
    "NP4-523-CD": ("DAM System Lambda", "day_ahead_prices"),
    "NP6-331-CD": ("Real-Time Clearing Prices for Capacity by 15-Minute Settlement Interval", "ancillary_services"),
    "NP4-188-CD": ("DAM Clearing Prices for Capacity", "ancillary_services"),
    "NP3-233-CD": ("Hourly Resource Outage Capacity", "reliability"),
    "NP3-911-ER": ("2-Day DAM Ancillary Services Reports", "ancillary_services"),
}
PROFILES = {
    "core": ["NP6-346-CD", "NP3-565-CD", "NP4-732-CD", "NP4-745-CD", "NP6-905-CD", "NP4-523-CD", "NP3-233-CD"],
    "market": ["NP6-905-CD", "NP6-788-CD", "NP4-523-CD", "NP6-331-CD", "NP4-188-CD"],
    "reliability": ["NP3-233-CD", "NP3-911-ER", "NP6-346-CD", "NP3-565-CD"],
    "all": list(DATASETS),
}
DEFAULT_PROFILE = "core"
ALIASES = {
    "NP6-348-CD": "NP3-565-CD",
    "NP6-787-ER": "NP4-523-CD",
    "NP6-788-ER": "NP6-788-CD",
    "NP6-86-CP": "NP6-331-CD",
    "NP6-975-MCPE": "NP4-188-CD",
}
EARLIEST = {
    "NP6-346-CD": "2017-06-29",
    "NP6-905-CD": "2010-11-30",
    "NP4-732-CD": "2010-11-28",
    "NP4-745-CD": "2022-06-30",
    "NP3-233-CD": "2013-10-20",
    "NP3-565-CD": "2017-06-28",
    "NP4-523-CD": "2013-12-11",
    "NP6-788-CD": "2010-11-30",
    "NP6-331-CD": "2025-12-05",
    "NP4-188-CD": "2010-11-29",
    "NP3-911-ER": "2011-01-29",
    "NP3-912-ER": None,
}
TIERS = {
    "Tier 1": ["NP6-346-CD", "NP6-905-CD", "NP4-732-CD", "NP4-745-CD", "NP3-233-CD"],
    "Tier 2": ["NP3-565-CD", "NP4-523-CD", "NP6-788-CD"],
    "Tier 3": ["NP6-331-CD", "NP4-188-CD", "NP3-911-ER", "NP3-912-ER"],
}
#: Columns by which rows are deduplicated.
KEYS = {
    "NP6-346-CD": ["OperDay", "HourEnding"],
    "NP3-565-CD": ["DeliveryDate", "HourEnding", "Model", "InUseFlag"],
    "NP4-732-CD": ["DELIVERY_DATE", "HOUR_ENDING"],
    "NP4-745-CD": ["DELIVERY_DATE", "HOUR_ENDING"],
    "NP6-905-CD": ["DeliveryDate", "DeliveryHour", "DeliveryInterval", "SettlementPointName"],
}
#: Names of the posting-time column, the preferred one first.
POSTING_NAMES = ["postDateTime", "postDatetime", "PostingTime", "post_datetime"]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DATASETS.items()], "dataset_id string, title string, category string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, i, d) for p, ids in PROFILES.items() for i, d in enumerate(ids)], "profile string, position int, dataset_id string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "old_id string, new_id string")


def resolve_ids(profile_names: list[str] = (), ids: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Ids of the profiles, then the explicit ones, trimmed, upper-cased, with old ids replaced, each once, in order; excluded ones are left out.

    Without either, the default profile; an unknown profile is an error, an id outside the catalog is not.
    """
    for p in profile_names:
        if p not in PROFILES:
            raise ValueError(f"unknown profile {p!r}; there are {', '.join(sorted(PROFILES))}")
    names = list(profile_names) or ([] if ids else [DEFAULT_PROFILE])
    wanted = [d for p in names for d in PROFILES[p]] + [i.strip().upper() for i in ids if i.strip()]
    out = {ALIASES.get(e.strip().upper(), e.strip().upper()) for e in exclude}
    return [d for d in dict.fromkeys(ALIASES.get(i, i) for i in wanted) if d not in out]


def resolved(requests: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """request, dataset_id, position (from 0) of requests (request, place, value), whose values are names of profiles or ids, as resolve_ids does it for one.

    A request's profiles stand for their ids, ids are trimmed and upper-cased, old ones replaced, each counts once, at its
    first place; excluded ones are left out. Profiles and aliases are fixed tables of a few rows.
    """
    spark = requests.sparkSession
    named = F.broadcast(profiles(spark).withColumnRenamed("dataset_id", "member"))
    rows = requests.join(named, F.lower(F.trim("value")) == F.col("profile"), "left").withColumn("old_id", F.coalesce("member", F.upper(F.trim("value")))).where("old_id <> ''")
    rows = rows.join(F.broadcast(aliases(spark)), "old_id", "left").withColumn("dataset_id", F.coalesce("new_id", "old_id"))
    out = {ALIASES.get(e.strip().upper(), e.strip().upper()) for e in exclude}
    first = rows.where(~F.col("dataset_id").isin(*out)) if out else rows
    first = first.groupBy("request", "dataset_id").agg(F.min(F.struct("place", "position")).alias("at"))
    return first.select("request", "dataset_id", (F.row_number().over(Window.partitionBy("request").orderBy("at")) - 1).alias("position"))


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, d) for t, ids in TIERS.items() for i, d in enumerate(ids)], "tier string, position int, dataset_id string")
