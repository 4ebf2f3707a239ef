"""Detectors over tall pixel tables: one dispatcher for rules and learnt prototypes, two-date trajectories, fine grids,
and the pipelines of a site's years that are built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import indices, masks
from rasterloom.operators import cluster, measures, raster, scenes

BANDS = indices.BANDS
METHODS = ("gng", "kmeans", "rules")


def complete(prefix: str = "") -> Column:
    out = F.lit(True)
    for b in BANDS:
        out = out & F.col(prefix + b).isNotNull()
    return out


def reflectances(prefix: str = "") -> list[Column]:
    return [F.col(prefix + b) / 10000 for b in BANDS]


def spectral_bare(px: DataFrame, keys: list[str], order: str, method: str = "rules", cap: float = 0.25, adaptive: bool = True, dark: float = 0.30, **fit: int) -> DataFrame:
    """px (bands, valid, inside) with `bare`: below the scene's threshold, not water or shadow, not burnt.

    All methods share support, threshold and guards; water and shadow are told by the pixel's own spectrum (rules) or
    by that of its nearest prototype, learnt from at most 8,000 trusted pixels of each scene. Scenes with fewer than two
    trusted pixels go by the rules.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    trusted = masks.sure(F.col("valid") & F.col("inside") & complete() & (indices.brightness() < dark))
    own = px.filter(trusted).withColumn("f", F.array(*reflectances(), indices.ratio_eps("nir", "red"), indices.ratio_eps("green", "swir1"), indices.ratio_eps("swir1", "swir2")))
    least = 100 if adaptive else 1 << 60
    limits = measures.adaptive_threshold(own, keys, indices.ratio_eps("nir", "red"), F.lit(True), cap, least=least).select(*keys, F.col("threshold").alias("_limit"))
    wet = lambda f: (f[7] > 0) | (f[4] < 0.07)
    if method == "rules":
        told = own.withColumn("_wet", wet(F.col("f")))
    else:
        z, scale = cluster.standardised(own, keys, "f", 9)
        sample = cluster.bounded_sample(z.filter("_n >= 2").select(*keys, order, "z"), keys, order)
        nodes = (cluster.fit_gas if method == "gng" else cluster.fit_means)(sample, keys, "z", order, **fit)
        wet_nodes = cluster.raw_prototypes(nodes, scale, keys).select(*keys, "node", wet(F.col("raw")).alias("_wet_node"))
        near = cluster.nearest_node(z.select(*keys, order, "z"), nodes, keys, "z").join(wet_nodes, [*keys, "node"]).select(*keys, order, "_wet_node")
        told = own.join(near, [*keys, order], "left").withColumn("_wet", F.coalesce("_wet_node", wet(F.col("f")))).drop("_wet_node")
    low = told.join(limits, keys).filter((F.col("f")[6] < F.col("_limit")) & ~F.col("_wet") & (indices.ratio_eps("nir", "swir2") > 0))
    hit = low.select(*keys, order, F.lit(True).alias("_hit"))
    return px.join(hit, [*keys, order], "left").withColumn("bare", F.col("_hit").isNotNull()).drop("_hit")


def date_indices(prefix: str) -> list[Column]:
    """NDVI, NBR, first short-wave infrared and MNDWI of a date whose bands have a prefix."""
    r = lambda a, b: indices.ratio_eps(prefix + a, prefix + b)
    return [r("nir", "red"), r("nir", "swir2"), F.col(prefix + "swir1") / 10000, r("green", "swir1")]


def trajectory() -> Column:
    """Twelve features of a pixel at two dates (early_, late_): four indices at each, and late less early."""
    a, b = date_indices("early_"), date_indices("late_")
    return F.array(*a, *b, *[y - x for x, y in zip(a, b, strict=True)])


def early_candidates(px: DataFrame, keys: list[str], prefix: str = "early_", dark: float = 0.30) -> DataFrame:
    """px with `early_rule` and `early_limit`: the single-date guards under the date's own threshold."""
    clear = masks.sure(F.col(f"{prefix}valid") & F.col("inside") & complete(prefix))
    x = date_indices(prefix)
    limit = measures.adaptive_threshold(px, keys, x[0], clear).select(*keys, F.col("threshold").alias("early_limit"))
    bright = (F.col(f"{prefix}blue") + F.col(f"{prefix}green") + F.col(f"{prefix}red")) / 30000
    rule = clear & (x[0] < F.col("early_limit")) & (x[1] > 0) & (x[2] >= 0.07) & (x[3] <= 0) & (bright < dark)
    return px.join(limit, keys).withColumn("early_rule", masks.sure(rule))


def persists(f: Column, early: Column, late: Column, greenup: float = 0.10, dry: float = 0.07) -> Column:
    """Low vegetation, no water and no burn at both dates, and hardly greener at the second."""
    both = (f[0] < early) & (f[4] < late) & (f[8] <= greenup) & (f[1] > 0) & (f[5] > 0)
    return masks.sure(both & (f[2] >= dry) & (f[6] >= dry) & (f[3] <= 0) & (f[7] <= 0))


def detect_trajectory(px: DataFrame, keys: list[str], order: str, learnt: bool = True, dark: float = 0.30, **fit: int) -> DataFrame:
    """Pixels (early_, late_ bands and valid, inside) with early_rule, support, rules and, if learnt, gng and node.

    Each date's threshold comes from its own clear pixels. Rules and prototypes speak on pixels clear at both dates
    alone; elsewhere both are false and node is -1.
    """
    with_early = early_candidates(px, keys)
    late_clear = masks.sure(F.col("late_valid") & F.col("inside") & complete("late_"))
    late = measures.adaptive_threshold(px, keys, date_indices("late_")[0], late_clear).select(*keys, F.col("threshold").alias("late_limit"))
    support = masks.sure(F.col("early_valid") & F.col("inside") & complete("early_")) & late_clear
    bright = lambda p: (F.col(f"{p}blue") + F.col(f"{p}green") + F.col(f"{p}red")) / 30000 < dark
    out = with_early.join(late, keys).withColumn("support", support).withColumn("f", trajectory())
    rules = F.col("support") & persists(F.col("f"), F.col("early_limit"), F.col("late_limit")) & masks.sure(bright("early_") & bright("late_"))
    out = out.withColumn("rules", rules)
    if not learnt:
        return out.drop("f")
    z, scale = cluster.standardised(out.filter("support").select(*keys, order, "f"), keys, "f", 12)
    sample = cluster.bounded_sample(z.filter("_n >= 2").select(*keys, order, "z"), keys, order)
    nodes = cluster.fit_gas(sample, keys, "z", order, **fit)
    limits = out.select(*keys, "early_limit", "late_limit").distinct()
    good = cluster.raw_prototypes(nodes, scale, keys).join(limits, keys).select(*keys, "node", persists(F.col("raw"), F.col("early_limit"), F.col("late_limit")).alias("_good"))
    near = cluster.nearest_node(z.select(*keys, order, "z"), nodes, keys, "z").join(good, [*keys, "node"]).select(*keys, order, "node", "_good")
    out = out.join(near, [*keys, order], "left")
    return out.withColumn("gng", F.col("rules") & F.coalesce("_good", F.lit(True))).withColumn("node", F.coalesce("node", F.lit(-1))).drop("f", "_good")


def candidate_cover(px: DataFrame, keys: list[str], candidate: str, seen: str) -> DataFrame:
    """keys, candidates, those seen, and their share, NULL without candidates."""
    n, m = F.count_if(candidate), F.count_if(F.col(candidate) & masks.sure(F.col(seen)))
    return px.groupBy(*keys).agg(n.alias("candidates"), m.alias("seen"), F.try_divide(m.cast("double"), n).alias("cover"))


def fine_candidates(px: DataFrame, keys: list[str], order: str, limit: float, learnt: bool = True, **fit: int) -> DataFrame:
    """px (blue, green, red, nir, analysis) with `candidate`: the fine grid's gate, less pixels whose prototype is water."""
    ndvi, ndwi = indices.ratio_eps("nir", "red"), indices.ratio_eps("green", "nir")
    out = px.withColumn("candidate", masks.sure(F.col("analysis") & (ndvi < limit) & (ndwi <= 0)))
    if not learnt:
        return out
    seen = px.filter(F.col("analysis") & F.col("nir").isNotNull()).withColumn("f", F.array("blue", "green", "red", "nir", ndvi, ndwi))
    z, scale = cluster.standardised(seen, keys, "f", 6)
    nodes = cluster.fit_gas(cluster.bounded_sample(z.filter("_n >= 2").select(*keys, order, "z"), keys, order), keys, "z", order, **fit)
    water = cluster.raw_prototypes(nodes, scale, keys).select(*keys, "node", (F.col("raw")[5] > 0).alias("_water"))
    near = cluster.nearest_node(z.select(*keys, order, "z"), nodes, keys, "z").join(water, [*keys, "node"]).select(*keys, order, "_water")
    return out.join(near, [*keys, order], "left").withColumn("candidate", F.col("candidate") & ~F.coalesce("_water", F.lit(False))).drop("_water")


def detected_scenes(px: DataFrame, keys: list[str], detector: Column, bare: Column, inside: Column, pixel_ha: float = 0.01) -> DataFrame:
    """A row for each scene: shares, matrix greenness (NULL below 100 pixels), and hectares by two detectors."""
    valid = masks.visible(F.col("scl"))
    ndvi = F.when(valid & inside, indices.ndvi())
    on = inside & valid
    return px.groupBy(*keys).agg(
        measures.share(valid, inside).alias("clear"), measures.share(F.col("scl") == 10, inside).alias("haze"), F.when(F.count(ndvi) >= 100, F.percentile(ndvi, F.lit(0.75))).alias("matrix"),
        (F.count_if(detector & on) * pixel_ha).alias("ha"), (F.count_if(bare & on) * pixel_ha).alias("ndvi_ha"),
    )


def annual(px: DataFrame, detector: Column, least_clear: float = 0.85, most_haze: float = 0.15, pixel_ha: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Season maxima of each site and year, and each site's change between its first and last year.

    px: site, yr, scene, day, r, c, bands, scl. Pixels that any scene has as water are left out of detection, but not
    of the support of the change, which is the whole site seen on both dates.
    """
    wet = scenes.ever(px, ["site", "r", "c"], F.col("scl") == 6).withColumnRenamed("ever", "tidal")
    px = px.join(wet, ["site", "r", "c"])
    inside = ~F.col("tidal")
    per = detected_scenes(px, ["site", "yr", "scene", "day"], detector, masks.bare_by_ndvi(), inside, pixel_ha)
    good = per.filter((F.col("clear") >= least_clear) & (F.col("haze") <= most_haze))
    best = scenes.season_max(good)
    ends = best.groupBy("site").agg(F.min("yr").alias("first"), F.max("yr").alias("last"), measures.rate("yr", "ha").alias("rate"), F.count("*").alias("years"))
    chosen = px.join(best.select("site", "yr", "scene"), ["site", "yr", "scene"]).join(ends, "site")
    seen = masks.visible(F.col("scl"))
    cell = chosen.filter("first < last").groupBy("site", "r", "c").agg(
        *[F.bool_or(F.when(F.col("yr") == F.col(y), v)).alias(f"{n}_{y}") for y in ("first", "last") for n, v in (("m", detector & seen & inside), ("s", seen))]
    )
    both = F.col("s_first") & F.col("s_last")
    change = cell.groupBy("site").agg((F.count_if(both & F.col("m_last") & ~F.col("m_first")) * pixel_ha).alias("newly"), (F.count_if(both & F.col("m_first") & ~F.col("m_last")) * pixel_ha).alias("reveg"), F.count_if(both).alias("both"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return best, ends.join(change, "site", "left").select("site", "first", "last", "years", "rate", zero("newly"), zero("reveg"), F.coalesce("both", F.lit(0)).alias("both"))


def clearest_release(px: DataFrame, fires: DataFrame, detector: Column, least_clear: float = 0.85, days: int = 400, metres: float = 500.0, pixel_ha: float = 0.01) -> DataFrame:
    """The clearest scene of each site and year: hectares, patches, the largest one, and whether a fire came before it."""
    valid = masks.visible(F.col("scl"))
    per = px.groupBy("site", "yr", "scene", "day").agg(measures.share(valid, F.lit(True)).alias("clear"))
    best = scenes.first_by(per.filter(F.col("clear") >= least_clear), ["site", "yr"], F.desc("clear"), F.col("day"), F.col("scene"))
    seen = px.join(best.select("site", "yr", "scene"), ["site", "yr", "scene"]).withColumn("m", detector & valid)
    sizes = raster.patch_sizes(raster.labelled(seen.select("site", "yr", "r", "c", "m"), ["site", "yr"], "m"), ["site", "yr"])
    patches = sizes.groupBy("site", "yr").agg(F.count("*").alias("patches"), (F.max("cells") * pixel_ha).alias("largest"), (F.sum("cells") * pixel_ha).alias("ha"))
    burnt = fires.filter(F.col("distance") <= metres).select("site", F.col("day").alias("fire"))
    after = best.join(burnt, "site").filter(F.datediff("day", "fire").between(0, days)).select("site", "yr").distinct().withColumn("after_fire", F.lit(True))
    out = best.join(patches, ["site", "yr"], "left").join(after, ["site", "yr"], "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return out.select("site", "yr", "scene", "clear", zero("ha", 0.0), zero("patches", 0), zero("largest", 0.0), zero("after_fire", False))


def site_record(release: DataFrame, site_ha: Column, large: float = 10.0) -> DataFrame:
    """Headlines of each site over its clean years: peak, mean share, years with any, and large workings.

    Two or more years with a large patch mark large workings, and only then such years stay in; years after a fire never do.
    """
    working = F.count_if(F.col("largest") >= large).over(Window.partitionBy("site")) >= 2
    clean = release.withColumn("large_working", working).filter(~F.col("after_fire") & ((F.col("largest") < large) | F.col("large_working")))
    return clean.groupBy("site").agg(F.max("ha").alias("peak_ha"), (F.avg("ha") / site_ha * 100).alias("mean_pct"), F.count_if(F.col("ha") > 0).alias("years_with"), F.bool_or("large_working").alias("large_working"))


Detector = Callable[[DataFrame], DataFrame]


def sweep(px: DataFrame, scenarios: dict[str, Detector], keys: list[str], reference: str, pixel_ha: float = 0.01) -> DataFrame:
    """Each scenario's mask against one of them: hectares, intersection over union, and what is removed and added."""
    every = None
    for name, detector in scenarios.items():
        one = detector(px).select("*").withColumn("scenario", F.lit(name)).select("scenario", *keys, "id", "bare")
        every = one if every is None else every.unionByName(one)
    base = every.filter(F.col("scenario") == reference).select(*keys, "id", F.col("bare").alias("_ref"))
    a, b = F.col("_ref"), F.col("bare")
    return every.join(base, [*keys, "id"]).groupBy("scenario", *keys).agg(
        (F.count_if(b) * pixel_ha).alias("ha"), F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b)).alias("iou"), (F.count_if(a & ~b) * pixel_ha).alias("removed_ha"), (F.count_if(b & ~a) * pixel_ha).alias("added_ha")
    )
