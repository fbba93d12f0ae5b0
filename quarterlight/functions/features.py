"""Groups of model features by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules (pattern, group); the first that a name meets gives its group.
# Names are lower-cased before these rules.
FEATURE_GROUPS = [
    ("exaa", "EXAA d"),
    ("price_d1", "Price d-1"),
    ("price_d2", "Price d-2"),
    ("price_d7", "Price d-7"),
    ("load_d0", "Load d"),
    ("wind", "Wind d"),
    ("ssrd|sw_dir|sw_dif", "Solar d"),
    ("^weekday_", "Weekday"),
    ("is_holiday", "Holiday"),
    ("is_15min_market", "15-min market dummy"),
]
# Coarser groups, on lower-cased names.
IMPORTANCE_GROUPS = [
    ("^reserve_|_reserve_", "Reserve market"),
    ("exaa", "EXAA prices"),
    ("^price_|_price_", "Price lags"),
    ("^weekday_|^is_15min_market$|month|weekend|holiday|post_regime", "Calendar"),
    ("residual_load|^rl_|rl_hat", "Residual load forecast"),
    ("load", "Load forecast"),
    ("renewable|solar|wind_proxy|wind_generation|ren_", "Renewable forecast"),
    ("ssrd|aswdir|aswdifd|sw_dir|sw_dif|radiation|wind_speed|wind_direction|t2m|d2m|temperature|precip|snow|weather|vmax|u10|v10|pressure|humidity", "Raw weather"),
]
# Subgroups, on names as they are.
SUBGROUPS = [
    ("^exaa", "EXAA price"),
    ("^reserve_", "Reserve market"),
    ("^price_d1_", "Lagged price (day d-1)"),
    ("^price_d2_", "Lagged price (day d-2)"),
    ("^price_d7_", "Lagged price (day d-7)"),
    ("^Residual_Load_Proxy_MW_ramp", "Residual load ramp"),
    ("^Residual_Load_Proxy_MW", "Residual load"),
    ("^wind_speed", "Wind speed"),
    ("^sw_dif", "Shortwave diffuse radiation"),
    ("^sw_dir", "Shortwave direct radiation"),
    ("^Renewable_Wind", "Wind generation"),
    ("^Renewable_Solar", "Solar generation"),
    ("^Renewable_Total", "Total renewable generation"),
    ("^load_d0", "Load forecast"),
]
# Where a name carries its cluster's number.
WIND_CLUSTER, SOLAR_CLUSTER, SOLAR_NAMES = r"wind_speed_cluster_(\d+)_h\d+", r"cluster_(\d+)_h\d+", "ssrd|sw_dir|sw_dif"


def first_match(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The group of the first rule whose pattern occurs in the name; the default for others and for null."""
    groups = F.array(*[F.when(name.rlike(pattern), group) for pattern, group in rules])
    return F.coalesce(F.get(F.array_compact(groups), F.lit(0)), F.lit(default))


def feature_group(name: Column) -> Column:
    return first_match(F.lower(name), FEATURE_GROUPS, "Other")


def importance_group(name: Column) -> Column:
    return first_match(F.lower(name), IMPORTANCE_GROUPS, "Other")


def subgroup(name: Column) -> Column:
    return first_match(name, SUBGROUPS, "Calendar/other")


def wind_cluster(name: Column) -> Column:
    """Number of the wind cluster in the name, else null."""
    return F.nullif(F.regexp_extract(F.lower(name), WIND_CLUSTER, 1), F.lit("")).cast("int")


def solar_cluster(name: Column) -> Column:
    """Number of the radiation cluster in the name, else null."""
    found = F.nullif(F.regexp_extract(F.lower(name), SOLAR_CLUSTER, 1), F.lit("")).cast("int")
    return F.when(F.lower(name).rlike(SOLAR_NAMES), found)


def feature_kind(name: Column) -> Column:
    """How a feature is scaled: radiation, load, wind, price, calendar or other. A name that fits several takes the first of these."""
    low = F.lower(name)
    kind = F.when(low.rlike(SOLAR_NAMES), "radiation").when(low.contains("load"), "load").when(low.contains("wind_speed"), "wind")
    return kind.when(name.rlike("^(price_d|exaa_d)"), "price").when(name.rlike("^weekday_|^is_15min_market$|^is_holiday$"), "calendar").otherwise("other")
