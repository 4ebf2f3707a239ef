"""Queries of detectors and of time: site years, trajectories, fires, weather, radar and thermal series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import indices, masks
from rasterloom.operators import cluster, detectors, events, ranks, scenes, series
from rasterloom.plans import standins as S
from rasterloom.plans.catalogue import DRY, MNDWI_E, NBR, NBR_E, NDVI, NDVI_E, query, rounded

BRIGHT = "(blue + green + red) / 3 / 10000 < 0.30"
SOUND = "blue is not null and green is not null and red is not null and nir is not null and swir1 is not null and swir2 is not null"
VISIBLE = "scl not in (0, 1, 3, 8, 9, 10, 11)"

RULES = f"""with x as (select *, {SOUND} and {VISIBLE} and c % 10 > 0 and {BRIGHT} as own from t), th as (select site, yr,
case when count(*) >= 100 then least(0.25, greatest(quantile_cont({NDVI_E}, 0.75) - 0.18,
0.10)) else 0.25 end as th from x where own group by site, yr)
select id, coalesce(own and not ({MNDWI_E} > 0 or swir1 / 10000 < 0.07) and {NDVI_E} < th and {NBR_E} > 0,
false) as bare from x left join th using (site, yr)"""


def supported(t: DataFrame) -> DataFrame:
    return t.withColumn("valid", masks.visible(F.col("scl"))).withColumn("inside", F.col("c") % 10 > 0)


@query("m06_spectral_rules", S.PX, RULES)
def m06_spectral_rules(t):
    return detectors.spectral_bare(supported(t), ["site", "yr"], "id", "rules").select("id", "bare")


@query("m06_spectral_gng", S.PX)
def m06_spectral_gng(t):
    return detectors.spectral_bare(supported(t), ["site", "yr"], "id", "gng").select("id", "bare")


@query("m06_spectral_kmeans", S.PX)
def m06_spectral_kmeans(t):
    return detectors.spectral_bare(supported(t), ["site", "yr"], "id", "kmeans").select("id", "bare")


#: Two dates of the same cells: orders one apart.
PAIRS = "select a.id as id, a.site as site, " + ", ".join(f"{p}.{b} as {n}_{b}" for p, n in (("a", "early"), ("b", "late")) for b in indices.BANDS) + ", a.scl <> 8 as early_valid, b.scl <> 8 as late_valid, a.c % 10 > 0 as inside from (" + S.PX + ") as a join (" + S.PX + ") as b on b.id = a.id + 1"


def dated(p: str) -> dict[str, str]:
    r = lambda a, b: f"(({p}_{a} - {p}_{b}) / ({p}_{a} + {p}_{b} + 2e-9 - 1e-9))"
    return {"ndvi": r("nir", "red"), "nbr": r("nir", "swir2"), "swir": f"({p}_swir1 / 10000)", "wet": r("green", "swir1"), "bright": f"(({p}_blue + {p}_green + {p}_red) / 30000)", "sound": " and ".join(f"{p}_{b} is not null" for b in indices.BANDS)}


E_, L_ = dated("early"), dated("late")
LIMITS = "".join(f""", {p} as (select site, case when count(*) >= 100 then least(0.25, greatest(quantile_cont({d['ndvi']},
0.75) - 0.18, 0.10)) else 0.25 end as {p}_th from t where {p}_valid and inside and {d['sound']} group by site)""" for p, d in (("early", E_), ("late", L_))).removeprefix(", ")
GUARDS = f"{{d[nbr]}} > 0 and {{d[swir]}} >= 0.07 and {{d[wet]}} <= 0 and {{d[bright]}} < 0.30"
EARLY_RULE = f"coalesce(early_valid and inside and {E_['sound']} and {E_['ndvi']} < early_th and {GUARDS.format(d=E_)}, false)"


@query("p06_trajectory", PAIRS, "select id, " + ", ".join(f"round({v}, 6) as f{k}" for k, v in enumerate([*[d[x] for d in (E_, L_) for x in ("ndvi", "nbr", "swir", "wet")], *[f"{L_[x]} - {E_[x]}" for x in ("ndvi", "nbr", "swir", "wet")]])) + " from t")
def p06_trajectory(t):
    return t.withColumn("f", detectors.trajectory()).select("id", *[F.round(F.col("f")[k], 6).alias(f"f{k}") for k in range(12)])


@query("p21_early_candidates", PAIRS, f"with {LIMITS} select id, {EARLY_RULE} as early_rule from t left join early using (site)")
def p21_early_candidates(t):
    return detectors.early_candidates(t, ["site"]).select("id", "early_rule")


@query("m07_trajectory_rules", PAIRS, f"""with {LIMITS} select id, {EARLY_RULE} as early_rule,
coalesce(early_valid and late_valid and inside and {E_['sound']} and {L_['sound']}, false) as support,
coalesce(early_valid and late_valid and inside and {E_['ndvi']} < early_th and {L_['ndvi']} < late_th and {L_['ndvi']} - {E_['ndvi']} <= 0.10 and {GUARDS.format(d=E_)} and {GUARDS.format(d=L_)},
false) as rules from t left join early using (site) left join late using (site)""")
def m07_trajectory_rules(t):
    return detectors.detect_trajectory(t, ["site"], "id", learnt=False).select("id", "early_rule", "support", "rules")


@query("m07_trajectory_gng", PAIRS)
def m07_trajectory_gng(t):
    return detectors.detect_trajectory(t, ["site"], "id").select("id", "rules", "gng", "node")


FINE = f"select id, coalesce(c % 10 > 0 and {NDVI_E} < 0.25 and (green - nir) / (green + nir + 1e-9) <= 0, false) as candidate from t"


@query("m08_fine_rules", S.PX, FINE)
def m08_fine_rules(t):
    return detectors.fine_candidates(t.withColumn("analysis", F.col("c") % 10 > 0), ["site", "yr"], "id", 0.25, learnt=False).select("id", "candidate")


@query("m08_fine_gng", S.PX)
def m08_fine_gng(t):
    return detectors.fine_candidates(t.withColumn("analysis", F.col("c") % 10 > 0), ["site", "yr"], "id", 0.25).select("id", "candidate")


@query("p19_fine_candidate", S.PX, f"select id, coalesce((nir - red) / nullif(nir + red, 0) < 0.3 and (green - nir) / nullif(green + nir, 0) <= 0, false) as candidate from t")
def p19_fine_candidate(t):
    return t.select("id", masks.fine_candidate(F.lit(0.3)).alias("candidate"))


@query("p18_filtered", """select id, r, c, m, mndwi from (select o_orderkey as id, cast(floor(o_orderkey / 100.0) as int) as r,
cast(o_orderkey % 100 as int) as c, o_totalprice % 10 < 9 as m, round(-(o_totalprice % 1), 4) as mndwi
from {orders}) as x""",
       """select t.r, t.c, t.m and coalesce(a.m, false) and coalesce(b.m, false) and coalesce(l.m,
false) and coalesce(q.m, false) and coalesce(t.mndwi <= -0.30, false) as kept from t
left join t as a on a.r = t.r - 1 and a.c = t.c left join t as b on b.r = t.r + 1 and b.c = t.c left
join t as l on l.r = t.r and l.c = t.c - 1 left join t as q on q.r = t.r and q.c = t.c + 1""")
def p18_filtered(t):
    from rasterloom.operators import raster

    return raster.interior(t, [], "m").select("r", "c", (F.col("interior") & masks.sure(F.col("mndwi") <= -0.30)).alias("kept"))


ON = f"{VISIBLE} and not tidal"
PER = f"""w as (select site, r, c, bool_or(scl = 6) as tidal from t group by site, r, c), x as (select t.*, tidal from t
join w using (site, r, c)),
s as (select site, yr, scene, day, sum(case
when {VISIBLE} and not tidal then 1 else 0 end) * 1e0 / greatest(sum(case when not tidal then 1 else 0 end),
1) as clear, sum(case when scl = 10 and not tidal then 1 else 0 end) * 1e0 / greatest(sum(case
when not tidal then 1 else 0 end), 1) as haze,
case when count(case when {ON} then {NDVI} end) >= 100 then quantile_cont(case when {ON} then {NDVI} end,
0.75) end as matrix, sum(case when {DRY} and {ON} then 1 else 0 end) * 1e-2 as ha, sum(case
when coalesce({NDVI_E} < 0.25 and {BRIGHT}, false) and {ON} then 1 else 0 end) * 1e-2 as ndvi_ha from x
group by site, yr, scene, day),
b as (select * from (select *, row_number() over (partition by site, yr order by ha desc, day, scene) as k
from s where clear >= 0.3 and haze <= 0.3) where k = 1)"""


@query("t02_detected_scenes", S.CELLS, f"""with {PER} select site, yr, scene, round(clear, 6) as clear, round(haze, 6) as haze, round(matrix,
6) as matrix, round(ha, 4) as ha, round(ndvi_ha, 4) as ndvi_ha from s""")
def t02_detected_scenes(t):
    tidal = scenes.ever(t, ["site", "r", "c"], F.col("scl") == 6)
    d = detectors.detected_scenes(t.join(tidal, ["site", "r", "c"]), ["site", "yr", "scene", "day"], masks.dry_bare(), masks.bare_by_ndvi(), ~F.col("ever"))
    return rounded(rounded(d.drop("day"), "ha", "ndvi_ha", digits=4), "clear", "haze", "matrix")


@query("t01_annual_maxima", S.CELLS, f"with {PER} select site, yr, scene, round(ha, 4) as ha, round(ndvi_ha, 4) as ndvi_ha from b")
def t01_annual_maxima(t):
    best, _ = detectors.annual(t, masks.dry_bare(), 0.3, 0.3)
    return rounded(best.select("site", "yr", "scene", "ha", "ndvi_ha"), "ha", "ndvi_ha", digits=4)


@query("t01_annual_change", S.CELLS, f"""with {PER}, e as (select site, min(yr) as first, max(yr) as last, cast(count(*) as bigint) as years, case
when count(*) >= 2 then coalesce(regr_slope(ha, yr), 0) else 0 end as rate from b group by site),
o as (select x.site, x.yr, x.r, x.c, {VISIBLE} as v, {DRY} and {ON} as m from x join b on b.site = x.site and b.yr = x.yr and b.scene = x.scene),
g as (select e.site, sum(case when f.v and l.v and l.m and not f.m then 1e-2 else 0 end) as newly, sum(case
when f.v and l.v and f.m and not l.m then 1e-2 else 0 end) as reveg, sum(case
when f.v and l.v then 1 else 0 end) as both_ from e join o as f on f.site = e.site and f.yr = e.first
join o as l on l.site = e.site and l.yr = e.last and l.r = f.r and l.c = f.c where e.first < e.last group by e.site)
select e.site, first, last, years, round(rate, 6) as rate, round(coalesce(newly, 0), 4) as newly,
round(coalesce(reveg, 0), 4) as reveg, cast(coalesce(both_, 0) as bigint) as both_ from e left
join g using (site)""")
def t01_annual_change(t):
    _, change = detectors.annual(t, masks.dry_bare(), 0.3, 0.3)
    return rounded(rounded(change.withColumnRenamed("both", "both_"), "newly", "reveg", digits=4), "rate")


@query("t03_release", S.CELLS, f"""with s as (select site, yr, scene, day, sum(case when {VISIBLE} then 1 else 0 end) * 1e0 / count(*) as clear
from t group by all), b as (select * from (select *, row_number() over (partition by site, yr
order by clear desc, day, scene) as k from s where clear >= 0.3) where k = 1),
h as (select t.site, t.yr, sum(case when {DRY} and {VISIBLE} then 1 else 0 end) * 1e-2 as ha from t
join b using (site, yr, scene) group by t.site, t.yr)
select b.site, b.yr, b.scene, round(b.clear, 6) as clear, round(ha, 4) as ha, exists (select 1 from fires as f
where f.site = b.site and f.distance <= 500 and date_diff('day', f.day,
b.day) between 0 and 400) as after_fire from b join h on h.site = b.site and h.yr = b.yr""",
       fires="select cast(o_custkey % 5 as int) as site, cast(o_orderdate as date) as day, o_totalprice as distance from {orders} where o_custkey % 31 = 0")
def t03_release(t, fires):
    got = detectors.clearest_release(t, fires, masks.dry_bare(), 0.3)
    return rounded(rounded(got.select("site", "yr", "scene", "clear", "ha", "after_fire"), "ha", digits=4), "clear")


@query("a32_site_record", S.RELEASE, """with w as (select *, count(*) filter (where largest >= 10) over (partition by site) >= 2 as large_working
from t), c as (select * from w where not after_fire and (largest < 10 or large_working))
select site, round(max(ha), 4) as peak_ha, round(avg(ha) / 50 * 100, 5) as mean_pct,
cast(count(*) filter (where ha > 0) as bigint) as years_with, bool_or(large_working) as large_working from c
group by site""")
def a32_site_record(t):
    return rounded(rounded(detectors.site_record(t, F.lit(50.0)), "peak_ha", digits=4), "mean_pct", digits=5)


@query("t04_dense_cube", S.CELLS, f"""with f as (select site, yr, scene, day, min(cloud) as cloud, coalesce(sum(case
when {VISIBLE} and c % 10 > 0 then 1 else 0 end) * 1.0 / nullif(sum(case when c % 10 > 0 then 1 else 0 end),
0), 0) as clear from (select *, scene * 7 % 5 as cloud from t) group by all),
d as (select * from (select *, row_number() over (partition by site, yr, day order by cloud, scene) as k
from f) where k = 1 and clear >= 0.5) select t.site, t.yr, t.scene, cast(count(*) as bigint) as cells,
round(max(clear), 6) as clear from t join d on d.site = t.site and d.yr = t.yr and d.scene = t.scene
group by t.site, t.yr, t.scene""")
def t04_dense_cube(t):
    cube = series.dense_cube(t.withColumn("cloud", F.col("scene") * 7 % 5), ["site", "yr"], masks.visible(F.col("scl")), F.col("c") % 10 > 0)
    return rounded(cube.groupBy("site", "yr", "scene").agg(F.count("*").alias("cells"), F.max("clear").alias("clear")), "clear")


@query("t05_area_series", S.CELLS, f"""select site, yr, scene, day, round(sum(case
when {DRY} and {VISIBLE} then 1 else 0 end) * 1e-2 / greatest(sum(case
when {VISIBLE} then 1 else 0 end) * 1e0 / count(*), 1e-9), 6) as ha, round(sum(case
when {VISIBLE} then 1 else 0 end) * 1e0 / count(*), 6) as clear from t group by site, yr, scene, day
having sum(case when {VISIBLE} then 1 else 0 end) * 1e0 / count(*) >= 0.4""")
def t05_area_series(t):
    return rounded(series.area_series(t, ["site", "yr"], masks.dry_bare(), masks.visible(F.col("scl")), 0.4), "ha", "clear")


TURNS = """select cast(o_custkey % 20 as int) as site, cast(o_orderdate as date) as before,
cast(o_orderdate as date) + cast(1 + o_orderkey % 30 as int) as after from {orders} where o_custkey % 4 < 3"""


@query("l03_brackets", TURNS, """with b as (select site, before, after, count(*) as pixels from t group by all) select site, before, after,
cast(pixels as bigint) as pixels, round(pixels * 1e-2, 4) as ha, cast(date_diff('day', before,
after) as int) as days from (select *, row_number() over (partition by site order by pixels desc, before,
after) as k from b) where k <= 12""")
def l03_brackets(t):
    return rounded(series.brackets(t, ["site"]), "ha", digits=4)


@query("t05_bracket_days", TURNS, """select site, cast(year(after) as int) as yr, round(count(*) * 1e-2, 4) as ha, quantile_cont(date_diff('day',
before, after), 0.25) as p25, quantile_cont(date_diff('day', before, after), 0.5) as median,
quantile_cont(date_diff('day', before, after), 0.75) as p75 from t group by site, year(after)""")
def t05_bracket_days(t):
    return rounded(series.bracket_days(t, ["site"]), "ha", digits=4)


@query("t06_fire_signal", S.CELLS, f"""with x as (select t.*, {NBR} as nbr, {VISIBLE} as valid, cast(date_diff('day', fire, day) as int) as d, fire
from t join fires using (site)),
k as (select site, fire, r, c, median(case when valid and d between -270 and -1 then nbr end) - median(case
when valid and d between 1 and 44 then nbr end) as fall from x group by site, fire, r, c), z as (select *,
case when fall >= 0.15 then 'burn' when fall < 0.05 then 'control' end as kind from k),
n as (select site, fire, count(*) as size from z where kind = 'burn' group by site, fire),
s as (select x.site, x.fire, x.yr, x.scene, d, count(case when kind = 'burn' then 1 end) as hits, median(case
when kind = 'burn' then nbr end) as burn_nbr, median(case when kind = 'control' then nbr end) as control_nbr
from x join z using (site, fire, r, c) where valid and kind is not null group by all)
select s.site, s.scene, d as days, round(burn_nbr, 6) as burn_nbr, round(control_nbr, 6) as control_nbr from s
join n using (site, fire) where hits >= 0.6 * size""",
       fires="select cast(n_nationkey as int) as site, cast('1998-06-05' as date) as fire from {nation}")
def t06_fire_signal(t, fires):
    got = series.fire_signal(t.withColumn("nbr", indices.nbr()).withColumn("valid", masks.visible(F.col("scl"))), ["site"], fires)
    return rounded(got.select("site", F.col("scene"), "days", "burn_nbr", "control_nbr"), "burn_nbr", "control_nbr")


@query("t07_best_of", S.SCENES, """with f as (select * from (select *, row_number() over (partition by site, yr order by cloud, scene) as k
from t) where k <= 8)
select site, yr, scene, clear from (select *, row_number() over (partition by site, yr order by case
when clear >= 0.97 then 0 else 1 end, case when clear >= 0.97 then cloud end nulls first, clear desc,
scene) as j from f) where j = 1 and clear >= 0.8""")
def t07_best_of(t):
    return series.best_of(t, ["site", "yr"]).select("site", "yr", "scene", "clear")


BEFORE = "select cast(user_id % 40 as int) as site, event_id as row_id, cast(ts as date) as day, cast('2024-01-15' as date) as event, value from {events}"


@query("w17_outside_normal", BEFORE, """with b as (select site, avg(value) as mean, stddev_pop(value) as sd, count(*) as n from t where day < event group by site)
select site, cast(date_diff('day', event, day) as int) as days, value, round(mean, 5) as mean, round(sd,
5) as sd, cast(n as bigint) as n_before from t join b using (site)
where day >= event and abs(value - mean) > 2 * sd""")
def w17_outside_normal(t):
    return rounded(series.outside_normal(t, ["site"], "day", "value", "event"), "mean", "sd", digits=5)


OBS = """select cast(user_id % 40 as int) as site, cast(event_id % 20 as int) as cell, event_id as row_id,
cast(ts as date) as day, value, value % 4 < 3 as valid, value > 80 as bare, cast(case
when user_id % 3 = 0 then 'field' else 'intact' end as varchar(6)) as zone from {events}"""


@query("a30_frequency_masks", OBS, """select site, cell, cast(sum(case when valid then 1 else 0 end) as bigint) as seen, round(sum(case
when valid and bare then 1 else 0 end) * 1e0 / greatest(sum(case when valid then 1 else 0 end), 1), 6) as share,
sum(case when valid and bare then 1 else 0 end) * 1e0 / greatest(sum(case when valid then 1 else 0 end),
1) >= 0.3 as field, sum(case when valid and bare then 1 else 0 end) = 0 and sum(case
when valid then 1 else 0 end) >= 5 as intact from t group by site, cell""")
def a30_frequency_masks(t):
    return rounded(series.frequency_masks(t, ["site", "cell"], F.col("valid"), F.col("bare"), 0.3, 5), "share")


ZONES = """select site, zone, cast(count(*) as bigint) as n, round(median(value), 6) as median,
round(quantile_cont(value, 0.99), 6) as p99, max(value) as top from t group by site, zone
having count(*) >= 20"""


@query("a29_zone_statistics", OBS, ZONES)
def a29_zone_statistics(t):
    return rounded(series.zone_statistics(t, ["site", "zone"], "value"), "median", "p99")


@query("t12_paired_thermal", OBS, """with s as (select site, day, zone, median(value) as m from t group by site, day, zone having count(*) >= 2),
d as (select a.m - b.m as d from s as a join s as b on a.site = b.site and a.day = b.day and a.zone = 'field' and b.zone = 'intact')
select cast(count(*) as bigint) as n, round(median(d), 6) as median, round(min(d), 6) as low, round(max(d),
6) as high from d""")
def t12_paired_thermal(t):
    s = series.zone_statistics(t, ["site", "day", "zone"], "value", 2)
    return rounded(series.paired_difference(s, ["site", "day"], "zone", "median", "field", "intact"), "median", "low", "high")


@query("t11_radar_contrast", OBS, """with m as (select site, day, median(case when zone = 'field' then ln(value + 1) end) as field, median(case
when zone = 'intact' then ln(value + 1) end) as intact from t group by site, day) select site, day,
round(field, 6) as field, round(intact, 6) as intact, round(field - intact, 6) as contrast from m
where field is not null and intact is not null""")
def t11_radar_contrast(t):
    return rounded(series.radar_contrast(t.withColumn("db", F.log(F.col("value") + 1)), ["site", "day"]), "field", "intact", "contrast")


@query("t11_yearly_auc", OBS, """with r as (select zone = 'field' as g, rank() over (partition by cast(year(day) as int)
order by value) + (count(*) over (partition by year(day), value) - 1) / 2.0 as k, cast(year(day) as int) as yr
from t where month(day) between 1 and 9), s as (select yr, sum(case when g then 1 else 0 end) as n1, sum(case
when g then 0 else 1 end) as n2, sum(case when g then k end) as s from r group by yr)
select yr, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2,
round((s - n1 * (n1 + 1) / 2.0) / nullif(n1 * n2, 0), 6) as auc from s""")
def t11_yearly_auc(t):
    return rounded(series.yearly_auc(t.withColumn("db", F.col("value")), months=(1, 9)), "auc")


@query("t11_gaps_filled", "select distinct cast(user_id % 40 as int) as site, cast(ts as date) as day from {events} where event_type = 'signup' and value > 60", """with g as (select site, day, lead(day) over (partition by site order by day) as until from other)
select g.site, g.day, g.until, cast(count(t.day) as bigint) as seen from g left
join t on t.site = g.site and t.day > g.day and t.day < g.until where date_diff('day', g.day, g.until) > 3
group by g.site, g.day, g.until""",
       other="select distinct cast(user_id % 40 as int) as site, cast(ts as date) as day from {events} where event_type = 'error' and value > 80")
def t11_gaps_filled(t, other):
    return series.gaps_filled(t, other, "site", 3)


RAIN = "select cast(ts as date) as day, floor(round(sum(value), 2) % 11) as rain, floor(round(sum(value), 2) % 3) as et0 from {events} group by 1"


@query("t10_wet_dry", OBS, """with r as (select a.day, coalesce((select sum(b.rain) from other as b
where b.day >= a.day - 7 and b.day < a.day), 0) as rain_k, coalesce((select sum(b.et0) from other as b
where b.day >= a.day - 7 and b.day < a.day), 0) as et0_k from other as a),
s as (select t.zone, t.value, rain_k, rain_k - et0_k as balance from t join r using (day)), k as (select *,
rank() over (partition by zone order by value) + (count(*) over (partition by zone, value) - 1) / 2.0 as x,
rank() over (partition by zone order by round(rain_k, 6)) + (count(*) over (partition by zone, round(rain_k,
6)) - 1) / 2.0 as y, rank() over (partition by zone order by round(balance,
6)) + (count(*) over (partition by zone, round(balance, 6)) - 1) / 2.0 as z from s)
select zone, round(median(case when rain_k >= 20 then value end), 6) as wet, round(median(case
when rain_k < 20 then value end), 6) as dry, cast(sum(case
when rain_k >= 20 then 1 else 0 end) as bigint) as n1, round(corr(x, y), 5) as rho_rain, round(corr(x, z),
5) as rho_balance from k group by zone""", other=RAIN)
def t10_wet_dry(t, other):
    got = series.wet_dry(t, ["zone"], other.withColumns({"rain": F.col("rain"), "et0": F.col("et0")}), "day", "value")
    return rounded(rounded(got.select("zone", "wet", "dry", "n1", "rho_rain", "rho_balance"), "wet", "dry"), "rho_rain", "rho_balance", digits=5)


GRASS = "select site, yr, id, blue, green, red, nir, swir1, swir2, id % 3 > 0 as old, scl <> 8 as valid, round(n / 8.0, 4) as summer from (" + S.PX + ") as px"


@query("t13_dry_grass", GRASS, f"""select site, yr, cast(count(*) as bigint) as grass, cast(sum(case
when {DRY} then 1 else 0 end) as bigint) as flagged, cast(sum(case when not coalesce({NBR} < 0, false) then 1 else 0 end) as bigint) as nbr_not_negative,
cast(sum(case when not coalesce(swir1 / 10000 >= 0.22, false) then 1 else 0 end) as bigint) as swir1_low,
cast(sum(case when not coalesce(swir1 / nullif(swir2, 0) >= 1.25,
false) then 1 else 0 end) as bigint) as ratio_low from t where old and valid and summer >= 0.5 group by site,
yr""")
def t13_dry_grass(t):
    return series.dry_grass(t, ["site", "yr"])


@query("a35_pooled_spectra", S.PX, f"""select scl, cast(count(*) as bigint) as n, round(median((nir - red) / nullif(nir + red, 0)), 6) as m_ndvi,
round(median({NBR}), 6) as m_nbr, round(median(swir1 / 10000), 6) as m_swir1,
round(median(swir1 / nullif(swir2, 0)), 6) as m_ratio from t group by scl""")
def a35_pooled_spectra(t):
    return rounded(series.pooled_spectra(t, ["scl"]), "m_ndvi", "m_nbr", "m_swir1", "m_ratio")


@query("t14_silence", S.EVENTS, """with w as (select *, value > 60 as lit, last_value(case
when value > 60 then ts end ignore nulls) over (partition by site
order by ts rows between unbounded preceding and 1 preceding) as last_on from t)
select row_id, exists (select 1 from other as o where o.site = w.site and abs(date_diff('day', o.day,
w.day)) <= 1) as fire from w where not lit and last_on is not null""",
       other="select distinct cast(user_id % 40 as int) as site, cast(ts as date) as day from {events} where event_type = 'error' and value > 150")
def t14_silence(t, other):
    off = events.off_after_on(t.withColumn("lit", F.col("value") > 60), "site", "ts", "lit")
    return series.silence(off, other, "site", "day", 1).select("row_id", "fire")


@query("w16_persistence", "select doc_id as point_id, cast(date '2020-01-01' + cast(doc_id % 5 as int) as date) as day from {documents}", """select t.point_id, cast(sum(case
when o.day <> t.day and o.valid and o.bare then 1 else 0 end) as bigint) as others from t left
join obs as o on o.point_id = t.point_id group by t.point_id""",
       obs="""select doc_id as point_id, cast(date '2020-01-01' + k as date) as day, (doc_id + k) % 3 > 0 as valid,
(n_chars + k) % 2 = 0 as bare from {documents} cross join (select cast(0 as int) as k union all select 1
union all select 2 union all select 3 union all select 4) as d""")
def w16_persistence(t, obs):
    return series.persistence(t, obs, "point_id").select("point_id", "others")


@query("t15_persistence_rules", S.REVIEW, """with x as (select *, yr - 2018 as others, count(*) over (partition by site, stratum) as n from t
where truth <> 'unsure'), k as (select * from x cross join (select unnest([0, 1, 2, 3]) as k) as u),
c as (select k, s.scope, sum(case
when by_size = 1 and others >= k and truth = 'bare_peat' then w else 0 end) as tp, sum(case when by_size = 1 and others >= k and truth <> 'bare_peat' then w else 0 end) as fp,
sum(case when not (by_size = 1 and others >= k) and truth = 'bare_peat' then w else 0 end) as fn
from (select *, 'sample' as scope, 1.0 as w from k union all select *, 'weighted', population * 1.0 / n
from k) as s group by k, s.scope)
select cast(k as int) as k, scope, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn,
0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c""")
def t15_persistence_rules(t):
    p = t.filter("truth <> 'unsure'").withColumn("others", F.col("yr") - 2018)
    return rounded(series.persistence_rules(p, ["site", "stratum"], F.col("truth") == "bare_peat", F.col("by_size") == 1), "precision", "recall", "f1")


CAL = "select site, day, scene, case when scene % 17 = 0 then null else clear end as clear from (" + S.SCENES + ") as s"


@query("t18_calendar", CAL, "select site, scene, case when clear >= 0.85 then 'usable' when clear >= 0.5 then 'partly' else 'cloudy' end as verdict from t")
def t18_calendar(t):
    return series.calendar(t)[0].select("site", "scene", "verdict")


@query("l04_best_days", CAL, """select site, scene, clear from (select *, row_number() over (partition by site order by clear desc, day,
scene) as k from t where clear is not null) where k <= 5""")
def l04_best_days(t):
    return series.calendar(t)[1].select("site", "scene", "clear")


@query("t17_documented", S.SERIES, """with g as (select site, site % 6 = 0 as known, max(ha) as ha from t group by site), r as (select known,
rank() over (order by ha) + (count(*) over (partition by ha) - 1) / 2.0 as k, ha from g)
select cast(sum(case when known then 1 else 0 end) as bigint) as n1, cast(sum(case
when known then 0 else 1 end) as bigint) as n2, round(sum(case when known then k end) - sum(case
when known then 1 else 0 end) * (sum(case when known then 1 else 0 end) + 1) / 2.0, 4) as u, round(median(case
when known then ha end), 6) as median_known, round(median(case when not known then ha end), 6) as median_other
from r""")
def t17_documented(t):
    g = t.groupBy("site").agg(F.max("ha").alias("ha")).withColumns({"known": F.col("site") % 6 == 0, "g": F.lit(0)})
    u = ranks.mann_whitney(g, ["g"], F.col("known"), "ha").select("g", "n1", "n2", "u")
    m = g.groupBy("g").agg(F.median(F.when(F.col("known"), F.col("ha"))).alias("median_known"), F.median(F.when(~F.col("known"), F.col("ha"))).alias("median_other"))
    return rounded(rounded(u.join(m, "g").drop("g"), "u", digits=4), "median_known", "median_other")


SWEEP = f"""with d as (select 'low' as scenario, site, id, coalesce({NDVI_E} < 0.20 and {BRIGHT}, false) as bare from t
union all select 'mid', site, id, coalesce({NDVI_E} < 0.25 and {BRIGHT}, false) from t union all select 'dry',
site, id, {DRY} from t), b as (select site, id, bare as ref from d where scenario = 'mid')
select scenario, site, round(sum(case when bare then 1e-2 else 0 end), 4) as ha, round(sum(case
when bare and ref then 1 else 0 end) * 1.0 / nullif(sum(case when bare or ref then 1 else 0 end), 0),
6) as iou, round(sum(case when ref and not bare then 1e-2 else 0 end), 4) as removed_ha, round(sum(case
when bare and not ref then 1e-2 else 0 end), 4) as added_ha from d join b using (site, id) group by scenario,
site"""


@query("t19_sweep", S.PX, SWEEP)
def t19_sweep(t):
    """Scenarios of thresholds and methods against one of them."""
    cases = {"low": lambda x: x.withColumn("bare", masks.bare_by_ndvi(0.20)), "mid": lambda x: x.withColumn("bare", masks.bare_by_ndvi(0.25)), "dry": lambda x: x.withColumn("bare", masks.dry_bare())}
    return rounded(rounded(detectors.sweep(t, cases, ["site"], "mid"), "ha", "removed_ha", "added_ha", digits=4), "iou")


@query("t20_control_cases", S.PX, f"""with x as (select *, case when site in (0, 2) then 'control' else 'known' end as kind from t),
d as (select site, yr, kind, round(sum(case when {DRY} then 1e-2 else 0 end), 4) as ha from x group by all)
select kind, cast(count(*) as bigint) as site_years, cast(sum(case
when ha > 0.02 then 1 else 0 end) as bigint) as flagged, round(max(ha), 4) as most from d group by kind""")
def t20_control_cases(t):
    d = t.withColumn("kind", F.when(F.col("site").isin(0, 2), "control").otherwise("known")).groupBy("site", "yr", "kind").agg(F.round(F.count_if(masks.dry_bare()) * 0.01, 4).alias("ha"))
    return rounded(d.groupBy("kind").agg(F.count("*").alias("site_years"), F.count_if(F.col("ha") > 0.02).alias("flagged"), F.max("ha").alias("most")), "most", digits=4)


@query("t16_predictions", PAIRS, f"""with {LIMITS}, m as (select id,
coalesce(early_valid and late_valid and inside and {E_['ndvi']} < early_th and {L_['ndvi']} < late_th and {L_['ndvi']} - {E_['ndvi']} <= 0.10 and {GUARDS.format(d=E_)} and {GUARDS.format(d=L_)},
false) as rules, coalesce(early_valid and late_valid and inside and {E_['sound']} and {L_['sound']},
false) as support from t left join early using (site) left join late using (site))
select p.point_id, case when m.support then cast(m.rules as int) end as predicted from points as p left
join m on m.id = p.id""", points="select doc_id as point_id, doc_id * 3 as id from {documents}")
def t16_predictions(t, points):
    """Predictions at points; where either date did not see the pixel there is none, never 0."""
    m = detectors.detect_trajectory(t, ["site"], "id", learnt=False).select("id", "rules", "support")
    return points.join(m, "id", "left").select("point_id", F.when(F.col("support"), F.col("rules").cast("int")).alias("predicted"))


@query("m09_low_cluster", """select vec_id as id, cast(label as int) as cluster, cast(vec_id % 3 as int) as site,
round(cast(vec_id % 97 as double) / 97, 4) as ndvi from {embeddings}""", """with m as (select site, cluster, avg(ndvi) as m from t group by all), b as (select site, arg_min(cluster,
m) as low from m group by site) select id, cluster = low and ndvi < 0.4 as bare from t join b using (site)""")
def m09_low_cluster(t):
    return cluster.low_cluster(t, ["site"], "cluster", "ndvi", 0.4).select("id", "bare")


@query("m10_discovery", S.PX)
def m10_discovery(t):
    """Prototypes learnt on all scenes at once, named by labelled pixels, against K-means on the same sample."""
    from rasterloom.operators import review

    px = t.filter("nir is not null").withColumn("f", F.array(*[F.col(b) / 10000 for b in indices.BANDS])).withColumn("g", F.lit(0)).withColumn("label", F.when(F.col("id") % 5 == 0, masks.dry_bare()))
    z, _ = cluster.standardised(px, ["g"], "f", 6)
    sample = cluster.bounded_sample(z.select("g", "site", "id", "z"), ["g", "site"], "id", 2000)
    out = None
    for name, nodes in (("gas", cluster.fit_gas(sample, ["g"], "z", "id")), ("means", cluster.fit_means(sample, ["g"], "z", "id"))):
        near = review.node_votes(cluster.nearest_node(z.select("g", "id", "z", "label"), nodes, ["g"], "z"), ["g"], "node", "label")
        one = near.agg(F.count_if("named").alias("named"), F.count("*").alias("pixels")).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("m12_detection_limit", S.PX, f"""with w as (select unnest([2.0, 5.0, 8.0, 20.0]) as width), x as (select width, least(width / 10, 1) as f, nir,
swir1, swir2, green, red from t cross join w where nir is not null), m as (select width,
nir * (1 - f) + 2000 * f as nir, swir1 * (1 - f) + 3000 * f as swir1, swir2 * (1 - f) + 2200 * f as swir2,
green * (1 - f) + 600 * f as green from x)
select cast(width as double) as width, cast(count(*) as bigint) as n, round(avg(case
when {DRY} then 1.0 else 0 end), 6) as share from m group by width""")
def m12_detection_limit(t):
    """Share of pixels in which a strip of bare soil of each width is seen."""
    w = t.filter("nir is not null").withColumn("width", F.explode(F.array(*[F.lit(float(x)) for x in (2, 5, 8, 20)])))
    pure = {"nir": 2000, "swir1": 3000, "swir2": 2200, "green": 600}
    mixed = w.withColumns({b: indices.mixed(indices.strip_share(F.col("width")), F.lit(float(v)), F.col(b)) for b, v in pure.items()})
    return rounded(mixed.groupBy("width").agg(F.count("*").alias("n"), F.avg(masks.dry_bare().cast("double")).alias("share")), "share")


@query("j12_rain_by_site", "select cast(user_id % 7 as int) as site, cast(ts as date) as day, round(sum(value) % 11, 6) as rain from {events} group by 1, 2", """select site, day, round(coalesce((select sum(b.rain) from t as b
where b.site = a.site and b.day >= a.day - 3 and b.day < a.day), 0), 6) as rain3 from t as a""")
def j12_rain_by_site(t):
    return rounded(events.rain_before(t, "day", "rain", 3, "rain3", ["site"]).select("site", "day", "rain3"), "rain3")


#: Days of seven years, from orders: whole windows for the normal.
DAYS = "select cast(o_orderdate as date) as day, round(sum(o_totalprice) % 11, 4) as rain from {orders} group by 1"


@query("a28_normal", "select distinct cast(o_orderkey as bigint) as event, cast(o_orderdate as date) as day from {orders}", """with y as (select distinct cast(year(day) as int) as y from other), e as (select event, t.day, y,
t.day + to_months(cast(12 * (y - year(t.day)) as int)) as until from t cross join y where y <> year(t.day)),
w as (select event, y, count(d.rain) as n, sum(d.rain) as total from e
join other as d on d.day >= cast(until as date) - 5 and d.day < cast(until as date) group by event, y
having count(d.rain) = 5) select event, round(median(total), 4) as normal, cast(count(*) as bigint) as years
from w group by event""", other=DAYS)
def a28_normal(t, other):
    return rounded(events.window_normal(t, other, 5), "normal", digits=4)


