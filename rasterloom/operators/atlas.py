"""The map's questions of the site table: filters, a chosen metric, derived figures, documented sites, frames near a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("v5", "gng", "ndvi")
#: Column of each metric, by method.
METRICS = {"new": "newly_{}_ha", "rate": "rate_{}_ha_yr", "pct": "pct_{}", "peak": "peak_{}_ha"}
# Class edges of each metric, for the older detectors and for the current one.
STOPS = {"new": (0.01, 2, 5), "rate": (0.05, 0.5, 1.5), "pct": (0.5, 2, 5), "peak": (0.01, 2, 5)}
STOPS_V5 = {"new": (0.1, 1, 3), "rate": (0.05, 0.2, 0.5), "pct": (0.05, 0.25, 1), "peak": (0.1, 1, 5)}


def filtered(sites: DataFrame, county: str | None = None, designation: str | None = None) -> DataFrame:
    """Sites of a county, and with a designation: one that a label names, or the bare one alone."""
    out = sites.filter(F.col("county") == county) if county else sites
    if designation == "NHA-only":
        return out.filter(F.col("designation") == "NHA")
    return out.filter(F.col("designation").contains(designation)) if designation else out


def metric(name: str, method: str) -> Column:
    """The chosen figure, 0 where it is missing."""
    return F.coalesce(F.col(METRICS[name].format(method)), F.lit(0.0))


def colour_class(value: Column, name: str, method: str) -> Column:
    out = F.lit(0)
    for edge in (STOPS_V5 if method == "v5" else STOPS)[name]:
        out = out + F.when(value >= edge, 1).otherwise(0)
    return out


def derived(series: DataFrame, site: str = "site") -> DataFrame:
    """Peak, change between first and last, and trend (three years or more) of the years that no flag leaves out."""
    clean = series.filter(~F.coalesce("flagged", F.lit(False)))
    by = clean.groupBy(site).agg(
        F.greatest(F.lit(0.0), F.max("ha")).alias("peak"), F.when(F.count("*") > 1, F.max_by("ha", "yr") - F.min_by("ha", "yr")).otherwise(0.0).alias("newly"),
        F.when(F.count("*") > 2, F.coalesce(F.regr_slope("ha", "yr"), F.lit(0.0))).otherwise(0.0).alias("rate"),
    )
    return series.select(site).distinct().join(by, site, "left").select(site, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("peak", "newly", "rate")])


def documented(sites: DataFrame, series: DataFrame, site: str = "site", least: float = 0.1, inclusive: bool = True) -> DataFrame:
    """Sites with recorded plots in some year, and whether the detector finds anything in one of those years.

    sites: site, yr, plots; series: site, yr, ha.
    """
    recorded = sites.filter(F.col("plots").isNotNull())
    hit = F.col("ha") >= least if inclusive else F.col("ha") > least
    return recorded.join(series.select(site, "yr", "ha"), [site, "yr"], "left").groupBy(site).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def upper_bound(excluded: Column) -> Column:
    """Whether the figure is an upper bound: more than a quarter of the site is tidal."""
    return F.coalesce(excluded, F.lit(0.0)) > 25


def short_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r" Bog (SAC|NHA)$", ""), r" (SAC|NHA)$", "")


def near_frame(cards: DataFrame, frames: DataFrame, keys: list[str], days: int = 10) -> DataFrame:
    """Each card's frame, if its date is at most `days` off."""
    f = frames.select(*keys, F.col("day").alias("frame_day"), "frame")
    ok = F.abs(F.datediff("day", "frame_day")) <= days
    return cards.join(f, keys, "left").select(*keys, "day", F.when(ok, F.col("frame")).alias("frame"))


def target_years(release: DataFrame, site: str = "site", least: float = 0.1) -> DataFrame:
    """One year of each site: that of its largest area without a flag, if there is enough, else its latest."""
    clean = F.when(~F.col("flagged"), F.struct(F.col("ha").alias("ha"), (-F.col("yr")).alias("k")))
    by = release.groupBy(site).agg(F.max(clean).alias("_b"), F.max("yr").alias("_last"))
    return by.select(site, F.when(F.col("_b.ha") >= least, -F.col("_b.k")).otherwise(F.col("_last")).alias("yr"))
