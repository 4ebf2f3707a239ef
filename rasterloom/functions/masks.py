"""Pixel predicates. A NULL band makes a mask false, never true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.indices import brightness, mndwi, nbr, ndwi, ratio, ratio_eps, ratio_zero, swir_ratio

#: Scene classes that hide the ground: no data, saturated, shadow, clouds and cirrus, snow.
HIDDEN_CLASSES = (0, 1, 3, 8, 9, 10, 11)


def sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def visible(scl: Column) -> Column:
    return sure(~scl.isin(*HIDDEN_CLASSES))


def qa_clear(qa: Column) -> Column:
    """No fill, dilated-cloud, cloud or shadow bit, and something observed."""
    return sure((qa.bitwiseAND(0b11010) == 0) & (qa > 1))


def low_vegetation(threshold: float = 0.25) -> Column:
    return sure(ratio_zero("nir", "red") < threshold)


def bare_by_ndvi(threshold: float = 0.25, dark: float = 0.30) -> Column:
    return sure((ratio_eps("nir", "red") < threshold) & (brightness() < dark))


def not_soil() -> Column:
    """Open water or a surface too dark in the short-wave infrared."""
    return sure((ratio_eps("green", "swir1") > 0) | (F.col("swir1") / 10000 < 0.07))


def bare_by_rules(threshold: Column) -> Column:
    """The rule detector under a scene's own NDVI threshold."""
    return sure(~not_soil() & (ratio_eps("nir", "red") < threshold) & (ratio_eps("nir", "swir2") > 0))


def dry_bare() -> Column:
    """Dry exposed soil by the short-wave infrared."""
    return sure((nbr() < 0) & (F.col("swir1") / 10000 >= 0.22) & (swir_ratio() >= 1.25) & (mndwi() <= -0.30))


def wet_bare() -> Column:
    """Wet exposed soil: dark in the near infrared, not water, not dry bare."""
    return sure((F.col("nir") / 10000 < 0.20) & (nbr() < 0.30) & (ratio("nir", "red") < 0.60) & (mndwi() <= -0.30) & (F.col("swir1") / 10000 >= 0.14)) & ~dry_bare()


def not_wet() -> Column:
    return sure(mndwi() <= -0.30)


def fine_candidate(threshold: Column) -> Column:
    """Candidate on a fine grid with green, red and near infrared only."""
    return sure((ratio("nir", "red") < threshold) & (ndwi() <= 0))


def persistent(early: str, late: str, low: float = 0.25, high: float = 0.35, dry: float = 0.07) -> Column:
    """Two-date gate: bare early and not green late, neither date wet or dark; columns are prefixed by date."""
    e, t = (lambda b: F.col(f"{early}_{b}")), (lambda b: F.col(f"{late}_{b}"))
    index = lambda f, a, b: (f(a) - f(b)) / (f(a) + f(b) + 1e-9)
    both = [index(f, "nir", "red") < limit for f, limit in ((e, low), (t, high))]
    both += [index(f, "nir", "swir2") > 0 for f in (e, t)]
    both += [index(f, "green", "swir1") <= 0 for f in (e, t)]
    both += [f("swir1") / 10000 >= dry for f in (e, t)]
    out = both[0]
    for c in both[1:]:
        out = out & c
    return sure(out)


def scene_ok(haze: Column, hot: Column, clear: Column) -> Column:
    return sure((haze <= 0.15) & (hot <= 0.15) & (clear >= 0.85))


def class_break(x: Column, edges: list[float]) -> Column:
    """Number of edges that x reaches; NULL stays NULL."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= e, 1).otherwise(0)
    return F.when(x.isNotNull(), out)


def site_type(lon: Column, elevation: Column, west: float = -9.2, high: float = 130.0) -> Column:
    return F.when((lon < west) | sure(elevation >= high), "blanket").otherwise("raised")


def designation(sac: Column, spa: Column) -> Column:
    return F.concat_ws(" + ", F.lit("NHA"), F.when(sure(sac), F.lit("SAC")), F.when(sure(spa), F.lit("SPA")))


def closed_season(day: Column) -> Column:
    """1 March to 31 August, both in."""
    return sure((F.month(day) >= 3) & (F.month(day) <= 8))


def change_class(before: Column, after: Column, both: Column) -> Column:
    """0 never, 1 stable, 2 new, 3 revegetated, 4 not seen on both dates."""
    return F.when(~sure(both), 4).when(before & after, 1).when(after, 2).when(before, 3).otherwise(0).cast("tinyint")
