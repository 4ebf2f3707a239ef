"""Time series of pixels, fields and sites: exposure dates, fire signals, thermal and radar contrasts, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import indices, masks
from rasterloom.operators import events, measures, ranks, scenes


def dense_cube(px: DataFrame, keys: list[str], valid: Column, inside: Column, least: float = 0.5) -> DataFrame:
    """Pixels of one scene a day, the least cloudy, on days that see at least this share of the site."""
    days = scenes.one_per_day(px.select(*keys, "scene", "day", "cloud").distinct(), *keys)
    clear = px.groupBy(*keys, "scene").agg(measures.clear_share(valid, inside).alias("clear")).filter(F.col("clear") >= least)
    return px.join(days.join(clear, [*keys, "scene"]).select(*keys, "scene", "clear"), [*keys, "scene"])


def area_series(px: DataFrame, keys: list[str], bare: Column, valid: Column, least: float = 0.8, pixel_ha: float = 0.01) -> DataFrame:
    """Hectares of each clear scene over its clear share, as if the whole site had been seen."""
    by = px.groupBy(*keys, "scene", "day").agg(F.count_if(bare & valid).alias("_n"), (F.count_if(valid) / F.count("*")).alias("clear"))
    return by.filter(F.col("clear") >= least).select(*keys, "scene", "day", (F.col("_n") * pixel_ha / F.greatest("clear", F.lit(1e-9))).alias("ha"), "clear")


def brackets(turns: DataFrame, keys: list[str], n: int = 12, pixel_ha: float = 0.01) -> DataFrame:
    """The pairs of dates between which most pixels turned: pixels, hectares, days between."""
    by = turns.groupBy(*keys, "before", "after").agg(F.count("*").alias("pixels"))
    top = scenes.first_by(by, keys, F.desc("pixels"), F.col("before"), F.col("after"), n=n)
    return top.select(*keys, "before", "after", "pixels", (F.col("pixels") * pixel_ha).alias("ha"), F.datediff("after", "before").alias("days"))


def bracket_days(turns: DataFrame, keys: list[str], pixel_ha: float = 0.01) -> DataFrame:
    """Quartiles of the days between the two dates of a turn, and hectares turned, by year of the later date."""
    t = turns.withColumn("_d", F.datediff("after", "before").cast("double"))
    by = t.groupBy(*keys, F.year("after").alias("yr")).agg((F.count("*") * pixel_ha).alias("ha"), F.percentile("_d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return by.select(*keys, "yr", "ha", *[F.col("_q")[k].alias(c) for k, c in enumerate(("p25", "median", "p75"))])


def fire_signal(px: DataFrame, keys: list[str], fires: DataFrame, pre: int = 270, post: int = 45, drop: float = 0.15, still: float = 0.05, least: float = 0.6) -> DataFrame:
    """Medians of each scene over burnt and control pixels: those whose NBR fell by `drop` or hardly at all.

    px: keys, r, c, scene, day, valid, nbr. The fire's own day is in neither window; scenes that see less than `least`
    of the burn are left out.
    """
    t = px.join(fires.select(*keys, "fire"), keys).withColumn("_d", F.datediff("day", "fire"))
    seen = F.when(F.col("valid"), F.col("nbr"))
    before, after = F.when(F.col("_d").between(-pre, -1), seen), F.when(F.col("_d").between(1, post - 1), seen)
    by = t.groupBy(*keys, "fire", "r", "c").agg(F.median(before).alias("_a"), F.median(after).alias("_b"))
    fall = F.col("_a") - F.col("_b")
    kind = by.select(*keys, "fire", "r", "c", F.when(fall >= drop, "burn").when(fall < still, "control").alias("kind")).filter("kind is not null")
    sizes = kind.filter("kind = 'burn'").groupBy(*keys, "fire").agg(F.count("*").alias("_size"))
    on = t.filter("valid").join(kind, [*keys, "fire", "r", "c"]).groupBy(*keys, "fire", "scene", "_d").agg(
        F.count_if(F.col("kind") == "burn").alias("_n"), *[F.median(F.when(F.col("kind") == k, F.col("nbr"))).alias(f"{k}_nbr") for k in ("burn", "control")]
    )
    return on.join(sizes, [*keys, "fire"]).filter(F.col("_n") >= least * F.col("_size")).select(*keys, "fire", "scene", F.col("_d").alias("days"), "burn_nbr", "control_nbr")


def best_of(scenes_: DataFrame, keys: list[str], n: int = 8, enough: float = 0.97, least: float = 0.8) -> DataFrame:
    """In order of cloud, of the first n scenes of a group: the first that is clear enough, else the clearest; none below `least`."""
    first = scenes.first_by(scenes_, keys, F.col("cloud"), F.col("scene"), n=n)
    return scenes.pick_clear(first, keys, enough).filter(F.col("clear") >= least)


def outside_normal(series: DataFrame, keys: list[str], day: str, value: str, event: str, sds: float = 2.0) -> DataFrame:
    """Mean and deviation of the days before an event, and the days from it on that lie further off than `sds` of them."""
    d = series.withColumn("_d", F.datediff(day, event))
    base = d.filter("_d < 0").groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n_before"))
    off = F.abs(F.col(value) - F.col("mean")) > sds * F.col("sd")
    return d.filter("_d >= 0").join(base, keys).filter(off).select(*keys, F.col("_d").alias("days"), value, "mean", "sd", "n_before")


def frequency_masks(px: DataFrame, keys: list[str], valid: Column, bare: Column, field: float = 0.4, least: int = 20) -> DataFrame:
    """Pixels bare on at least `field` of the dates they are seen on, and those never bare on `least` dates or more."""
    by = px.groupBy(*keys).agg(F.count_if(valid).alias("seen"), F.count_if(valid & bare).alias("bare"))
    share = F.col("bare") / F.greatest(F.col("seen"), F.lit(1))
    return by.select(*keys, "seen", share.alias("share"), (share >= field).alias("field"), ((F.col("bare") == 0) & (F.col("seen") >= least)).alias("intact"))


def zone_statistics(px: DataFrame, keys: list[str], value: str, least: int = 20) -> DataFrame:
    """Median, 99th percentile and maximum of each zone with at least `least` values."""
    by = px.groupBy(*keys).agg(F.median(value).alias("median"), F.percentile(value, F.lit(0.99)).alias("p99"), F.max(value).alias("top"), F.count(value).alias("n"))
    return by.filter(F.col("n") >= least)


def paired_difference(stats: DataFrame, keys: list[str], zone: str, value: str, one: str, two: str) -> DataFrame:
    """Difference between two zones on the dates that have both: median, range and how many."""
    a, b = (stats.filter(F.col(zone) == z).select(*keys, F.col(value).alias(n)) for z, n in ((one, "_a"), (two, "_b")))
    d = a.join(b, keys).withColumn("_d", F.col("_a") - F.col("_b"))
    return d.agg(F.count("*").alias("n"), F.median("_d").alias("median"), F.min("_d").alias("low"), F.max("_d").alias("high"))


def persistence(points: DataFrame, obs: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Points with `others`: on how many other dates, seen and bare, each was detected again."""
    other = points.select(key, F.col(day).alias("_own")).join(obs, key).filter(F.col(day) != F.col("_own"))
    n = other.groupBy(key).agg(F.count_if(F.col("valid") & F.col("bare")).alias("others"))
    return points.join(n, key, "left").withColumn("others", F.coalesce("others", F.lit(0)))


def persistence_rules(points: DataFrame, strata: list[str], truth: Column, predicted: Column, most: int = 3) -> DataFrame:
    """Scores of the detector alone and of it with at least k other dates, plain and weighted by stratum population."""
    sized = points.withColumn("_n", F.count("*").over(Window.partitionBy(*strata)))
    ks = F.explode(F.array(*[F.lit(k) for k in range(most + 1)]))
    tall = sized.withColumn("k", ks).withColumn("_p", predicted & (F.col("others") >= F.col("k"))).withColumn("_t", truth)
    out = None
    for scope, w in (("sample", F.lit(1.0)), ("weighted", F.col("population") / F.col("_n"))):
        s = measures.scores(tall.groupBy("k").agg(*measures.confusion(F.col("_t"), F.col("_p"), w))).select("k", F.lit(scope).alias("scope"), "precision", "recall", "f1")
        out = s if out is None else out.unionByName(s)
    return out


def wet_dry(series: DataFrame, keys: list[str], daily: DataFrame, day: str, value: str, k: int = 7, wet: float = 20.0) -> DataFrame:
    """Medians after wet and after dry spells, U of the wet ones, and the rank correlation with rain and balance.

    daily has day, rain and et0; the balance is rain less evaporation over the k days before.
    """
    summed = events.rain_before(events.rain_before(daily, "day", "rain", k, "rain_k"), "day", "et0", k, "et0_k")
    s = series.join(summed.select(F.col("day").alias(day), "rain_k", (F.col("rain_k") - F.col("et0_k")).alias("balance")), day)
    by = s.groupBy(*keys).agg(F.median(F.when(F.col("rain_k") >= wet, F.col(value))).alias("wet"), F.median(F.when(F.col("rain_k") < wet, F.col(value))).alias("dry"))
    u = ranks.mann_whitney(s, keys, F.col("rain_k") >= wet, value).select(*keys, "n1", "n2", "u", "auc")
    rho = ranks.spearman(s, keys, value, "rain_k", least=8).select(*keys, F.col("rho").alias("rho_rain"))
    balance = ranks.spearman(s, keys, value, "balance", least=8).select(*keys, F.col("rho").alias("rho_balance"))
    return by.join(u, keys).join(rho, keys).join(balance, keys)


def radar_contrast(obs: DataFrame, keys: list[str], zone: str = "zone") -> DataFrame:
    """Medians of a polarisation in fields and intact ground by scene, and the fields' less the intact ones'."""
    by = obs.groupBy(*keys).agg(*[F.median(F.when(F.col(zone) == z, F.col("db"))).alias(z) for z in ("field", "intact")])
    return by.filter("field is not null and intact is not null").withColumn("contrast", F.col("field") - F.col("intact"))


def yearly_auc(obs: DataFrame, zone: str = "zone", months: tuple[int, int] = (4, 9)) -> DataFrame:
    """How well a value tells fields from intact ground, by year, in the months of growth."""
    season = obs.filter(F.month("day").between(*months)).withColumn("yr", F.year("day"))
    return ranks.mann_whitney(season, ["yr"], F.col(zone) == "field", "db").select("yr", "n1", "n2", "auc")


def gaps_filled(radar: DataFrame, optical: DataFrame, key: str, gap: int = 30) -> DataFrame:
    """Gaps of more than `gap` days between optical dates, and how many radar dates fall into each."""
    w = Window.partitionBy(key).orderBy("day")
    gaps = optical.select(key, "day").distinct().withColumn("until", F.lead("day").over(w)).filter(F.datediff("until", "day") > gap)
    inside = (F.col("_day") > F.col("day")) & (F.col("_day") < F.col("until"))
    hit = gaps.join(radar.select(F.col(key).alias("_key"), F.col("day").alias("_day")).distinct(), (F.col(key) == F.col("_key")) & inside, "left")
    return hit.groupBy(key, "day", "until").agg(F.count("_day").alias("seen"))


def dry_grass(px: DataFrame, keys: list[str], green: float = 0.5) -> DataFrame:
    """Old candidates that are green in summer: how many the detector flags, and how many fail each of its tests.

    px: keys, old (a flag), valid, summer (NDVI), bands.
    """
    grass = px.filter(F.col("old") & F.col("valid") & (F.col("summer") >= green))
    fails = {"nbr_not_negative": ~masks.sure(indices.nbr() < 0), "swir1_low": ~masks.sure(F.col("swir1") / 10000 >= 0.22), "ratio_low": ~masks.sure(indices.swir_ratio() >= 1.25)}
    return grass.groupBy(*keys).agg(F.count("*").alias("grass"), F.count_if(masks.dry_bare()).alias("flagged"), *[F.count_if(v).alias(k) for k, v in fails.items()])


def pooled_spectra(px: DataFrame, keys: list[str]) -> DataFrame:
    """Median indices of the pixels of each class, and how many there are."""
    ix = {"ndvi": indices.ratio("nir", "red"), "nbr": indices.nbr(), "swir1": F.col("swir1") / 10000, "ratio": indices.swir_ratio()}
    return px.groupBy(*keys).agg(F.count("*").alias("n"), *[F.median(v).alias(f"m_{k}") for k, v in ix.items()])


def silence(off: DataFrame, fires: DataFrame, key: str, day: str, days: int = 10) -> DataFrame:
    """Days off after a day on, with whether any fire of their key came within `days` before or after."""
    f = fires.select(F.col(key).alias("_key"), F.col("day").alias("_fire")).distinct()
    near = off.join(f, (F.col(key) == F.col("_key")) & (F.abs(F.datediff(day, "_fire")) <= days), "left_semi").select("row_id").withColumn("fire", F.lit(True))
    return off.join(near, "row_id", "left").withColumn("fire", F.coalesce("fire", F.lit(False)))


def calendar(scenes_: DataFrame, best: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every date's clear share with a verdict, and the best days of each site, unknown shares left out."""
    verdict = F.when(F.col("clear") >= 0.85, "usable").when(F.col("clear") >= 0.5, "partly").otherwise("cloudy")
    marked = scenes_.withColumn("verdict", verdict)
    top = scenes.first_by(marked.filter(F.col("clear").isNotNull()), ["site"], F.desc("clear"), F.col("day"), F.col("scene"), n=best)
    return marked, top
