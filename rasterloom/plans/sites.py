"""Queries of catalogues, labels, sites and the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import indices, lookups, masks
from rasterloom.operators import atlas, events, measures, review, scenes
from rasterloom.plans import standins as S
from rasterloom.plans.catalogue import MNDWI_E, NDVI_E, query, rounded
from rasterloom.sources import readers

BOXES = """select o_orderkey as scene, cast(o_orderdate as date) as day, round(o_totalprice % 100 / 100, 6) as cloud,
case when o_custkey % 9 = 0 then null else round((o_totalprice % 83) / 83, 6) end as clear,
cast(o_custkey % 50 as double) as west, cast(o_custkey % 50 + 2 as double) as east,
cast(o_orderkey % 40 as double) as south, cast(o_orderkey % 40 + 3 as double) as north, case
when o_custkey % 2 = 0 then 'planetary' else 'earth' end as provider from {orders}"""
MEETS = "west <= 25 and east >= 20 and south <= 20 and north >= 10"


@query("s02_provider", BOXES, "select scene, true as signed from t where provider = 'planetary'")
def s02_provider(t):
    return scenes.provided(t, "planetary").select("scene", "signed")


@query("s03_search", BOXES, f"select scene, cloud from t where {MEETS} and day between date '1996-01-01' and date '1999-12-31' and cloud < 0.4 order by cloud, scene limit 7")
def s03_search(t):
    return scenes.search(t, (20, 10, 25, 20), "1996-01-01", "1999-12-31", 0.4, 7).select("scene", "cloud")


@query("s03_search_none", BOXES, f"select scene, cloud from t where {MEETS} and day < date '1900-01-01' limit 1")
def s03_search_none(t):
    return scenes.search(t, (20, 10, 25, 20), "1800-01-01", "1899-12-31", 0.4).select("scene", "cloud")


@query("s18_around", BOXES, f"""select scene, cast(date_diff('day', date '1997-06-15', day) as int) as delta, coalesce(clear, 0) as clear
from t where {MEETS} and day between date '1997-06-05' and date '1997-06-25' and cloud <= 0.5""")
def s18_around(t):
    return scenes.around(t, (20, 10, 25, 20), "1997-06-15", 10).select("scene", "delta", "clear")


@query("s04_band_asset", "select o_orderkey as scene, cast(o_custkey % 3 as int) as style from {orders}", "select scene, case style when 0 then 'up' when 1 then 'low' else 'name' end as href from t")
def s04_band_asset(t):
    names = F.when(F.col("style") == 0, F.create_map(F.lit("B04"), F.lit("up"))).when(F.col("style") == 1, F.create_map(F.lit("b04"), F.lit("low"))).otherwise(F.create_map(F.lit("red"), F.lit("name")))
    return t.withColumn("assets", names).select("scene", readers.band_asset("assets", "b04", ["red"]).alias("href"))


@query("s09_landsat", "select l_orderkey as k, l_linenumber as j, cast(l_extendedprice as double) as dn, cast(l_quantity as double) as q from {lineitem}",
       """select k, j, round((dn * 0.0000275 - 0.2) * 10000, 6) as refl,
(dn * 0.0000275 - 0.2) * 10000 > -1000 and (q * 0.0000275 - 0.2) * 10000 > -1000 and (dn * 0.0000275 - 0.2) * 10000 <> -2000 as seen
from t""")
def s09_landsat(t):
    a, b = lookups.landsat_reflectance(F.col("dn")), lookups.landsat_reflectance(F.col("q"))
    return t.select("k", "j", F.round(a, 6).alias("refl"), lookups.landsat_seen([a, b], a).alias("seen"))


@query("s10_surface_celsius", "select event_id as id, value - 50 as st from {events}", "select id, round(case when st > 0 then st * 0.00341802 + 149.0 - 273.15 end, 6) as celsius from t")
def s10_surface_celsius(t):
    return t.select("id", F.round(lookups.surface_celsius(F.col("st")), 6).alias("celsius"))


@query("s11_decibel", "select event_id as id, value / 1000 as power from {events}", "select id, round(case when power > 1e-4 then 10 * log10(power) end, 6) as db from t")
def s11_decibel(t):
    return t.select("id", F.round(lookups.decibel(F.col("power")), 6).alias("db"))


@query("s16_chunks", """select n_nationkey as k, cast(date '2020-01-01' + n_nationkey * 3 as date) as first,
cast(date '2020-01-01' + n_nationkey * 7 as date) as last from {nation}""",
       """with c as (select k, unnest(range(0, cast(date_diff('day', first, last) as int) + 1, 10)) as off, first, last
from t) select k, cast(first + cast(off as int) as date) as start, cast(least(10, date_diff('day', first,
last) + 1 - off) as int) as days from c""")
def s16_chunks(t):
    return events.requests(t, "first", "last", 10).select("k", "start", "days")


WEATHER = """select round(event_id % 50 / 7.0, 3) as lat, round(event_id % 30 / 7.0, 3) as lon, cast(ts as date) as day,
round(sum(value), 4) as rain from {events} group by 1, 2, 3"""


@query("s19_weather", "select event_id as id, event_id % 50 / 7.0 as lat, event_id % 30 / 7.0 as lon, cast(ts as date) as day from {events}", "select t.id, w.rain from t join weather as w on w.lat = round(t.lat, 3) and w.lon = round(t.lon, 3) and w.day = t.day", weather=WEATHER)
def s19_weather(t, weather):
    return events.weather_at(t, weather).select("id", "rain")


@query("s14_joined_objects", "select conv_id, turn, role, text from {conversations}", "select conv_id, turn, role as label from t where role in ('user', 'assistant')")
def s14_joined_objects(t):
    """A conversation's objects on one line, with and without a space between, read back; labels outside the list are left out."""
    line = F.to_json(F.struct("conv_id", "turn", F.col("role").alias("label")))
    several = t.groupBy("conv_id").agg(F.collect_list(line).alias("v"))
    lines = several.select(F.when(F.col("conv_id") % 2 == 0, F.array_join("v", " ")).otherwise(F.array_join("v", "")).alias("value"))
    return readers.split_objects(lines, "conv_id long, turn long, label string", ["user", "assistant"])


@query("p04_all_features", S.PX, f"""select id, round(blue, 6) as f0, round(swir2, 6) as f5, round({NDVI_E}, 6) as f6, round({MNDWI_E}, 6) as f7,
round((swir1 - swir2) / (swir1 + swir2 + 1e-9), 6) as f8 from t""")
def p04_all_features(t):
    return t.withColumn("f", indices.features()).select("id", *[F.round(F.col("f")[k], 6).alias(f"f{k}") for k in (0, 5, 6, 7, 8)])


@query("p10_swir_stretch", S.PX, """select id, round(power(least(greatest(swir1 / 10000 * 2.5, 0), 1), 1 / 1.2), 6) as swir,
round(power(least(greatest(nir / 10000 * 2.2, 0), 1), 1.0), 6) as false_colour from t""")
def p10_swir_stretch(t):
    return t.select("id", F.round(lookups.swir_stretch(F.col("swir1") / 10000), 6).alias("swir"), F.round(indices.stretch(F.col("nir") / 10000, 2.2, 1.0), 6).alias("false_colour"))


@query("p22_scene_ok", S.PX, """with q as (select site, yr, avg(case when scl = 10 then 1.0 else 0 end) as haze, avg(case
when scl = 9 then 1.0 else 0 end) as hot, avg(case when scl in (3, 8, 9, 10) then 0.0 else 1 end) as clear
from t group by all) select site, yr, haze <= 0.15 and hot <= 0.15 and clear >= 0.6 as ok,
haze <= 0.15 and hot <= 0.15 and clear >= 0.85 as strict from q""")
def p22_scene_ok(t):
    q = measures.quality(t, ["site", "yr"], *[F.col("scl") == k for k in (10, 9, 8, 3)], F.lit(True))
    return q.select("site", "yr", (masks.scene_ok(F.col("haze"), F.col("hot"), F.lit(1.0)) & (F.col("clear") >= 0.6)).alias("ok"), masks.scene_ok(F.col("haze"), F.col("hot"), F.col("clear")).alias("strict"))


@query("p25_first_county", "select c_custkey as id, c_mktsegment || ', ' || case when c_custkey % 2 = 0 then 'Mayo ' else 'Clare' end || ' ,Galway' as counties from {customer}", "select id, case when counties like '%Mayo%' then 'Mayo' else 'Galway' end as county from t")
def p25_first_county(t):
    return t.select("id", lookups.first_listed(F.col("counties"), ["Galway", "Mayo", "Roscommon"]).alias("county"))


RAW = """select event_id as id, cast(date '2024-03-30' + cast(event_id % 3 as int) as date) as day,
cast(event_id % 24 * 100 + event_id % 60 as int) as acq_time, case
when user_id % 4 = 0 then 'MODIS' else 'VIIRS' end as instrument from {events}"""


@query("p28_normalised", RAW, """select id, cast(day as timestamp) + to_minutes(cast(floor(acq_time / 100.0) * 60 + acq_time % 100 + case
when cast(day as timestamp) + to_minutes(cast(floor(acq_time / 100.0) * 60 + acq_time % 100 as int)) >= timestamp '2024-03-31 01:00:00' then 60 else 0 end as int)) as local,
cast(case when instrument = 'MODIS' then 1000 else 375 end as int) as footprint from t""")
def p28_normalised(t):
    """The clock goes forward on the last Sunday of March at one o'clock."""
    n = events.normalised(t.withColumn("acq_date", F.date_format("day", "yyyy-MM-dd")))
    return n.select("id", F.col("local").cast("timestamp_ntz").alias("local"), lookups.footprint(F.col("instrument")).alias("footprint"))


@query("p29_dry", """select event_id as id, case when event_id % 7 = 0 then '>=30'
when event_id % 7 = 1 then null else cast(event_id % 20 as varchar(3)) end as spell, case
when event_id % 5 = 0 then null else value end as rain, case
when event_id % 11 = 0 then null else 60.0 end as normal from {events}""", """select id, coalesce(case when spell like '>=%' then true else cast(spell as int) >= 10 end,
false) or coalesce(rain < 0.5 * normal, false) as dry from t""")
def p29_dry(t):
    return t.select("id", events.dry(F.col("spell"), F.col("rain"), F.col("normal").cast("double")).alias("dry"))


@query("p30_sun", """select event_id as id, case when event_id % 3 = 0 then null else value end as a, case
when event_id % 5 = 0 then null else value + 1 end as b, case
when event_id % 2 = 0 then null else value / 10 end as z, case
when event_id % 7 = 0 then null else value / 8 end as e from {events}""",
       """select id, case when coalesce(a, b) is not null and coalesce(z, 90 - e) is not null then round(coalesce(a, b),
6) end as azimuth, case when coalesce(a, b) is not null and coalesce(z,
90 - e) is not null then round(coalesce(z, 90 - e), 6) end as zenith from t""")
def p30_sun(t):
    az, zen = lookups.sun(*[F.col(c) for c in "abze"])
    return t.select("id", F.round(az, 6).alias("azimuth"), F.round(zen, 6).alias("zenith"))


@query("p31_season", """select o_orderkey as id, cast(year(o_orderdate) as int) as yr, case o_custkey % 3 when 0 then 'raised'
when 1 then 'blanket' end as kind from {orders}""", "select id, case when kind = 'blanket' then yr || '-04-15/' || yr || '-06-30' else yr || '-04-01/' || yr || '-06-15' end as dates from t")
def p31_season(t):
    return t.select("id", lookups.season(F.col("yr"), F.col("kind")).alias("dates"))


@query("p32_note_class", """select p_partkey as id, case p_partkey % 6 when 0 then 'Dead grass at the edge' when 1 then 'a TRACK beside'
when 2 then 'revegetating' when 3 then 'mixed pixel' when 4 then p_name end as note from {part}""",
       """select id, case when lower(coalesce(note,
'')) similar to '.*(dead|dry grass|senescent|molinia|straw|bleached|withered).*' then 'dry or dead vegetation'
when lower(coalesce(note, '')) similar to '.*(track|road|gravel).*' then 'track or road'
when lower(coalesce(note, '')) like '%revegetat%' then 'revegetating cutaway' when lower(coalesce(note,
'')) similar to '.*(edge|margin|beside|adjacent|nearby|just |between|next to|mixed|boundary|border).*' then 'mixed pixel at a cut face or strip edge' else 'other' end as class
from t""")
def p32_note_class(t):
    return t.select("id", lookups.note_class(F.col("note")).alias("class"))


@query("p34_fate", S.PX, """with f as (select site, yr, case when nir is null then null else (nir - red) / (nir + red + 1e-9) end as v
from t) select site, yr, cast(count(*) as bigint) as n, cast(count(v) as bigint) as seen, cast(sum(case
when v >= 0.5 then 1 else 0 end) as bigint) as green, cast(sum(case
when v < 0.35 then 1 else 0 end) as bigint) as bare from f group by site, yr""")
def p34_fate(t):
    f = t.withColumn("f", lookups.fate(indices.ratio_eps("nir", "red")))
    return f.groupBy("site", "yr").agg(F.count("*").alias("n"), F.count_if(F.col("f") != "unseen").alias("seen"), F.count_if(F.col("f") == "green").alias("green"), F.count_if(F.col("f") == "bare").alias("bare"))


@query("p36_point_parts", """select doc_id as id, case
when doc_id % 4 = 0 then 'plain' else 'a_r1_' || source || '_r' || (doc_id % 90) || '_c' || (doc_id % 70) end as name
from {documents}""",
       "select id, case when name = 'plain' then null else regexp_extract(name, '^(.+)_r(\\d+)_c(\\d+)$', 1) end as stem, case when name <> 'plain' then cast(id % 90 as int) end as r, case when name <> 'plain' then cast(id % 70 as int) end as c from t")
def p36_point_parts(t):
    s, r, c = lookups.point_parts(F.col("name"))
    return t.select("id", s.alias("stem"), r.alias("r"), c.alias("c"))


NAMES = """select c_custkey as id, case c_custkey % 4 when 0 then c_name || ' Bog SAC' when 1 then c_name || ' NHA'
when 2 then c_name || ' Bog' else c_name || ' Bog NHA' end as name, case
when c_custkey % 5 = 0 then null else c_acctbal / 100 end as excluded from {customer}"""


@query("p37_short_name", NAMES, """select id, case id % 4 when 0 then substr(name, 1, length(name) - 8) when 1 then substr(name, 1,
length(name) - 4) when 2 then name else substr(name, 1, length(name) - 8) end as short, coalesce(excluded,
0) > 25 as upper_bound from t""")
def p37_short_name(t):
    return t.select("id", atlas.short_name(F.col("name")).alias("short"), atlas.upper_bound(F.col("excluded")).alias("upper_bound"))


@query("p38_strict", S.REVIEW, "select point_id, case when truth = 'bare_peat' and cast(point_id as bigint) % 6 = 0 then 'vegetated' else truth end as truth from t")
def p38_strict(t):
    return review.strict(t, t.filter("cast(point_id as bigint) % 6 = 0")).select("point_id", "truth")


@query("p38_summer_checked", S.REVIEW, """select point_id, truth = 'bare_peat' and ndvi >= 0.5 and cast(point_id as bigint) % 3 > 0 as changed, case
when truth = 'bare_peat' and ndvi >= 0.5 and cast(point_id as bigint) % 3 > 0 then 'vegetated' else truth end as truth
from t""")
def p38_summer_checked(t):
    return review.summer_checked(t.drop("ndvi"), t.filter("cast(point_id as bigint) % 3 > 0"), 0.5).select("point_id", "changed", "truth")


@query("p39_tolerant", "select o_orderkey as scene, case when o_custkey % 7 = 0 then 'broken' else cast(o_totalprice as varchar(20)) end as raw from {orders}", "select scene, case when raw = 'broken' then 'failed' else 'ok' end as status, round(try_cast(raw as double), 2) as value from t")
def p39_tolerant(t):
    """A value that cannot be read fails its own row alone."""
    v = F.col("raw").try_cast("double")
    return t.select("scene", F.when(v.isNull(), "failed").otherwise("ok").alias("status"), F.round(v, 2).alias("value"))


@query("j02_merged", S.REVIEW, "select t.point_id, t.truth, o.label, o.pass from t join other as o on cast(o.doc_id as varchar) = t.point_id", other=S.VOTES)
def j02_merged(t, other):
    return t.join(other.withColumn("point_id", F.col("doc_id").cast("string")), "point_id").select("point_id", "truth", "label", "pass")


@query("j03_point_lookup", "select doc_id as point_id, cast(doc_id % 130 as int) as r, cast(doc_id % 100 as int) as c from {documents}", "select t.point_id, case when m.m is null then '' when m.m then '1' else '0' end as predicted from t left join mask as m on m.r = t.r and m.c = t.c", mask=S.mask(50))
def j03_point_lookup(t, mask):
    return measures.looked_up(t, mask, ["r", "c"], "m").select("point_id", "predicted")


@query("j04_mapped", "select s_suppkey as site, s_nationkey from {supplier}", "select site, plots, coalesce(plots, 0) > 10 as many from t left join plots as p on p.k = t.s_nationkey", plots="select n_nationkey as k, n_regionkey * 5 as plots from {nation} where n_nationkey % 2 = 0")
def j04_mapped(t, plots):
    return t.join(plots.withColumnRenamed("k", "s_nationkey"), "s_nationkey", "left").select("site", "plots", (F.coalesce("plots", F.lit(0)) > 10).alias("many"))


@query("j10_published_context", """select o_orderkey as event, cast(o_custkey % 200 as int) as site, cast(o_orderdate as date) as day,
cast(year(o_orderdate) as int) as yr from {orders} where o_custkey % 10 = 3""", """select t.event, a.ha is not null as published, a.ha as ha, b.ha as ha_next from t left
join release as a on a.site = t.site and a.yr = t.yr left
join release as b on b.site = t.site and b.yr = t.yr + 1""", release=S.RELEASE)
def j10_published_context(t, release):
    return events.published_context(t, release, "site").select("event", "published", "ha", "ha_next")


@query("j14_scenarios", S.SERIES, """select threshold, cast(count(*) as bigint) as site_years, cast(sum(case
when ha >= threshold then 1 else 0 end) as bigint) as over from t cross join (select unnest([50e0, 100e0,
200e0]) as threshold) as u group by threshold""")
def j14_scenarios(t):
    w = t.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (50.0, 100.0, 200.0)])))
    return w.groupBy("threshold").agg(F.count("*").alias("site_years"), F.count_if(F.col("ha") >= F.col("threshold")).alias("over"))


@query("j15_card_check", S.SERIES, "select site, yr, 'area' as fault from t where site % 9 = 0 union all select site, yr, 'missing' from t where site % 9 = 1")
def j15_card_check(t):
    """Cards against the cache that they were made from: none is missing and no figure differs."""
    cards = t.filter("site % 9 <> 1").withColumn("ha", F.when(F.col("site") % 9 == 0, F.col("ha") + 1).otherwise(F.col("ha")))
    return measures.mismatches(t, cards, ["site", "yr"], "ha", "area")


@query("a11_faults", S.REVIEW, """select point_id, 'truth' as fault from t where truth not in ('bare_peat', 'vegetated', 'unsure') union all
select point_id, 'by_lang' from t where cast(point_id as bigint) % 17 = 0 and by_lang is not null""")
def a11_faults(t):
    bad = t.withColumn("by_lang", F.when(F.col("by_lang").isNotNull() & (F.col("point_id").cast("long") % 17 == 0), 7).otherwise(F.col("by_lang")))
    return review.faults(bad, ["by_size", "by_lang"], ["bare_peat", "vegetated", "unsure"])


@query("a11_readiness", S.REVIEW, """select cast(count(*) as bigint) as points, cast(sum(case
when truth <> 'unsure' then 1 else 0 end) as bigint) as labelled, case when sum(case
when truth = 'unsure' then 1 else 0 end) = 0 then 'complete' else 'awaiting_labels' end as status, sum(case
when truth = 'unsure' then 1 else 0 end) = 0 as weighted, cast(count(distinct version) as bigint) as versions
from t""")
def a11_readiness(t):
    return review.readiness(review.one_version(t), ["stratum"])


@query("a12_usable", S.REVIEW, "select point_id, cast(count(*) over (partition by stratum) as bigint) as sample from t where truth <> 'unsure'")
def a12_usable(t):
    return review.usable(t, ["stratum"]).select("point_id", "sample")


@query("a12_sample_scores", S.REVIEW, """with c as (select site, count(*) as n, sum(case
when truth = 'bare_peat' and by_lang = 1 then 1 else 0 end) as tp, sum(case
when truth <> 'bare_peat' and by_lang = 1 then 1 else 0 end) as fp, sum(case
when truth = 'bare_peat' and by_lang = 0 then 1 else 0 end) as fn from t
where truth <> 'unsure' and by_lang is not null group by site)
select site, cast(n as bigint) as n, round(tp * 1.0 / nullif(tp + fp, 0), 6) as precision,
round(tp * 1.0 / nullif(tp + fn, 0), 6) as recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1
from c""")
def a12_sample_scores(t):
    return rounded(review.sample_scores(t, "by_lang", ["site"]).select("site", "n", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("a12_errors", S.REVIEW, """select 'false_positive' as kind, truth as of, cast(count(*) as bigint) as n from t where coalesce(by_lang = 1,
false) and truth <> 'bare_peat' group by truth union all select 'miss', site || ' ' || yr,
cast(count(*) as bigint) from t where not coalesce(by_lang = 1, false) and truth = 'bare_peat' group by site,
yr""")
def a12_errors(t):
    return review.errors(t, "by_lang", ["site", "yr"])


@query("a14_weighted_share", S.REVIEW, "select round(sum(population * by_lang) * 1.0 / nullif(sum(case when by_lang is not null then population end), 0), 6) as share from t")
def a14_weighted_share(t):
    return rounded(review.weighted_share(t, "population", F.col("by_lang")), "share")


@query("a24_voted", S.VOTES, """with c as (select doc_id, label, count(*) as v from t group by all), n as (select doc_id, sum(v) as votes
from c group by doc_id), m as (select doc_id, max(v) as top from c where label <> 'unsure' group by doc_id),
w as (select doc_id, top, count(*) as same, min(label) as label from m join c using (doc_id)
where c.v = top and c.label <> 'unsure' group by doc_id, top)
select n.doc_id, case when same = 1 and (top >= 3 or 2 * top >= votes) then label else 'unsure' end as label,
case when same = 1 and top >= 3 then 'agree'
when same = 1 and 2 * top >= votes then 'majority' else 'disagree' end as status,
cast(votes as bigint) as votes from n left join w using (doc_id)""")
def a24_voted(t):
    return review.voted(t, "doc_id", "label", 3)


PASSES = """select doc_id as item, case doc_id % 5 when 0 then null when 1 then 'unsure'
when 2 then 'a' else 'b' end as a, case doc_id % 7 when 0 then null when 1 then 'unsure'
when 2 then 'b' else 'a' end as b, cast(doc_id % 3 as int) as a_level, cast(doc_id % 4 % 3 as int) as b_level,
case when doc_id % 2 = 0 then 'a' when doc_id % 11 = 0 then 'b' end as earlier from {documents}"""


@query("a24_consensus", PASSES, """select item, case when a is null and b is null then null when a is null or b is null then coalesce(a, b)
when a = b then a when a = 'unsure' then b when b = 'unsure' then a when a_level > b_level then a
when b_level > a_level then b when earlier in (a, b) then earlier else 'unsure' end as label,
case when a is null and b is null then null when a is null or b is null then 'low'
when a = b then case least(a_level, b_level) when 0 then 'low'
when 1 then 'medium' else 'high' end else 'low' end as confidence, case
when a is null and b is null then 'missing' when a is null or b is null then 'single pass'
when a = b then 'agree' else 'disagree' end as status from t""")
def a24_consensus(t):
    return review.consensus(t)


@query("a27_kinds", S.EVENTS, """with f as (select *, case when date_diff('day', lag(day) over (partition by site order by day, row_id),
day) > 3 then 1 else 0 end as new from t), s as (select *, sum(new) over (partition by site order by day,
row_id rows unbounded preceding) as session from f), c as (select site, session, kind, count(*) as n from s group by all)
select site, cast(session as bigint) as session, string_agg(kind || '=' || n, ',' order by kind) as kinds
from c group by site, session""")
def a27_kinds(t):
    s = events.session_summary(t, "site", "day", "value", "kind")
    return s.select("site", "session", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("kinds"))


@query("a33_insight", S.RELEASE, """with s as (select site, max(case when not flagged then ha end) as peak from t group by site)
select cast(count(*) as bigint) as sites, cast(sum(case
when peak >= 1 then 1 else 0 end) as bigint) as with_any, (select cast(count(*) as bigint) from t
where flagged) as left_out, round(max(peak), 4) as largest from s""")
def a33_insight(t):
    d = atlas.derived(t)
    left = t.agg(F.count_if("flagged").alias("left_out"))
    return d.agg(F.count("*").alias("sites"), F.count_if(F.col("peak") >= 1).alias("with_any"), F.round(F.max("peak"), 4).alias("largest")).crossJoin(F.broadcast(left)).select("sites", "with_any", "left_out", "largest")


@query("a34_guards", S.RELEASE, """with s as (select site, sum(ha) as ha, 20.0 + site % 3 as register, sum(largest) as before from t
group by site) select site, 'register' as rule from s where abs(ha - register) > 0.08 * register union all
select site, 'drop' from s where ha < 0.85 * before""")
def a34_guards(t):
    s = t.groupBy("site").agg(F.sum("ha").alias("ha"), F.sum("largest").alias("before")).withColumn("register", 20.0 + F.col("site") % 3)
    return measures.violations(s, "site", {"register": measures.near_register(F.col("ha"), F.col("register")), "drop": measures.no_drop(F.col("ha"), F.col("before"))})


@query("q01_filtered", """select s_suppkey as site, case s_suppkey % 3 when 0 then 'Galway'
when 1 then 'Mayo' else 'Clare' end as county, case s_nationkey % 4 when 0 then 'NHA' when 1 then 'NHA + SAC'
when 2 then 'SAC + SPA' else 'NHA + SAC + SPA' end as designation from {supplier}""", """select 'sac' as kind, site from t where county = 'Galway' and designation like '%SAC%' union all select 'nha',
site from t where designation = 'NHA' union all select 'spa', site from t where designation like '%SPA%'""")
def q01_filtered(t):
    one = lambda k, *a: atlas.filtered(t, *a).select(F.lit(k).alias("kind"), "site")
    return one("sac", "Galway", "SAC").union(one("nha", None, "NHA-only")).union(one("spa", None, "SPA"))


FIGURES = "select site, max(ha) as peak_v5_ha, min(ha) as newly_v5_ha, case when site % 4 = 0 then null else avg(ha) end as pct_gng from (" + S.RELEASE + ") as r group by site"


@query("q02_metric", FIGURES, """select site, round(peak_v5_ha, 6) as peak, cast(case when peak_v5_ha >= 5 then 3 when peak_v5_ha >= 1 then 2
when peak_v5_ha >= 0.1 then 1 else 0 end as int) as class, round(coalesce(pct_gng, 0), 6) as pct, cast(case
when coalesce(pct_gng, 0) >= 5 then 3 when coalesce(pct_gng, 0) >= 2 then 2 when coalesce(pct_gng,
0) >= 0.5 then 1 else 0 end as int) as pct_class from t""")
def q02_metric(t):
    peak, pct = atlas.metric("peak", "v5"), atlas.metric("pct", "gng")
    return t.select("site", F.round(peak, 6).alias("peak"), atlas.colour_class(peak, "peak", "v5").alias("class"), F.round(pct, 6).alias("pct"), atlas.colour_class(pct, "pct", "gng").alias("pct_class"))


@query("q03_derived", S.RELEASE, """with c as (select * from t where not flagged), d as (select site, greatest(0, max(ha)) as peak, case
when count(*) > 1 then arg_max(ha, yr) - arg_min(ha, yr) else 0 end as newly, case
when count(*) > 2 then coalesce(regr_slope(ha, yr), 0) else 0 end as rate from c group by site)
select s.site, round(coalesce(peak, 0), 4) as peak, round(coalesce(newly, 0), 4) as newly,
round(coalesce(rate, 0), 5) as rate from (select distinct site from t) as s left join d using (site)""")
def q03_derived(t):
    """A slope of four-digit figures over at most seven years that is no half of the fifth digit is 2.5e-8 or more off
    one, so nine digits first take away what the order of rows adds, and halves go away from zero."""
    return rounded(rounded(atlas.derived(t), "peak", "newly", digits=4).withColumn("rate", F.round("rate", 9)), "rate", digits=5)


PLOTS = """select cast(c_custkey % 250 as int) as site, cast(1995 + c_custkey % 7 as int) as yr, max(case
when c_nationkey % 3 = 0 then null else c_nationkey end) as plots from {customer} group by 1, 2"""


@query("q05_documented", PLOTS, """select p.site, coalesce(bool_or(r.ha >= 3), false) as found from t as p left
join release as r on r.site = p.site and r.yr = p.yr where plots is not null group by p.site""", release=S.RELEASE)
def q05_documented(t, release):
    return atlas.documented(t, release, "site", 3.0)


@query("q06_near_frame", "select cast(o_custkey % 200 as int) as site, cast(year(o_orderdate) as int) as yr, min(cast(o_orderdate as date)) as day from {orders} group by 1, 2", """select t.site, t.yr, t.day, case when abs(date_diff('day', f.day, t.day)) <= 10 then f.frame end as frame
from t left join frames as f on f.site = t.site and f.yr = t.yr""",
       frames="""select cast(o_custkey % 200 as int) as site, cast(year(o_orderdate) as int) as yr,
min(cast(o_orderdate as date)) as day, min(o_orderkey) as frame from {orders} where o_orderkey % 3 > 0
group by 1, 2""")
def q06_near_frame(t, frames):
    return atlas.near_frame(t, frames, ["site", "yr"])


@query("l06_target_years", S.RELEASE, """with c as (select site, arg_max(yr, ha) as yr, max(ha) as ha from t where not flagged group by site)
select s.site, cast(case when c.ha >= 0.1 then c.yr else s.last end as int) as yr from (select site,
max(yr) as last from t group by site) as s left join c using (site)""")
def l06_target_years(t):
    return atlas.target_years(t)


@query("u01_all_sites", "select s_suppkey as code, s_name as name, s_acctbal as ha from {supplier}", "select code, name, 'NHA' as source, null as plots from t union all select code, name, 'SAC', plots from other", other="select c_custkey as code, c_name as name, c_nationkey as plots from {customer}")
def u01_all_sites(t, other):
    return t.select("code", "name", F.lit("NHA").alias("source"), F.lit(None).cast("int").alias("plots")).unionByName(other.select("code", "name", F.lit("SAC").alias("source"), "plots"))


@query("u02_two_archives", S.EVENTS, "select kind, day, site, min(row_id) as row_id from t group by kind, day, site")
def u02_two_archives(t):
    """Detections of an archive and of a recent feed, with other columns, each once."""
    one = t.withColumns({"lat": F.lit(1.0005), "lon": F.col("site") / 7}).drop("value")
    both = readers.detections(one, one.filter("row_id % 3 = 0").drop("ts").withColumn("row_id", F.col("row_id") + (1 << 40)))
    return events.without_repeats(both, ["kind", "day", "site"], "row_id").select("kind", "day", "site", "row_id")


@query("u03_pooled", S.REVIEW, "select point_id, truth, by_lang from t union all select 'x' || point_id, truth, null from t where cast(point_id as bigint) % 5 = 0")
def u03_pooled(t):
    more = t.filter("cast(point_id as bigint) % 5 = 0").select(F.concat(F.lit("x"), "point_id").alias("point_id"), "truth")
    return t.select("point_id", "truth", "by_lang").unionByName(more, allowMissingColumns=True)


@query("u04_xor", S.PX, "select id from t where scl < 6 and not id % 4 = 0 union all select id from t where id % 4 = 0 and not scl < 6")
def u04_xor(t):
    a, b = t.filter("scl < 6").select("id"), t.filter("id % 4 = 0").select("id")
    return a.exceptAll(b).union(b.exceptAll(a))


@query("u06_fresh_sample", S.REVIEW, """select point_id, stratum from (select *, row_number() over (partition by stratum
order by md5('7:' || point_id), point_id) as k from t where cast(point_id as bigint) % 4 > 0) where k <= 6""")
def u06_fresh_sample(t):
    fresh = t.join(t.filter("cast(point_id as bigint) % 4 = 0").select("point_id"), "point_id", "left_anti")
    return measures.stratified(fresh, "stratum", "point_id", 6, 7).select("point_id", "stratum")


COVERING = """select cast(o_custkey % 40 as int) as site, o_orderkey as scene, cast(o_orderdate as date) as day,
cast(o_orderkey % 5 as int) - 2 as delta, round(o_totalprice % 1, 4) as clear,
cast(o_orderkey % 8 as bigint) as first, cast(o_orderkey % 8 + 4 + o_custkey % 3 as bigint) as last
from {orders} where o_totalprice % 1 >= 0.3"""


@query("w04_covering", COVERING)
def w04_covering(t):
    frames = t.withColumn("cells", F.expr("filter(sequence(first, last), x -> x < 10)"))
    return scenes.covering(frames, t.select("site").distinct().withColumn("n", F.lit(10)), ["site"], least=0.6).select("site", "day", F.array_join(F.transform("scenes", lambda x: x.cast("string")), ",").alias("scenes"), F.round("cover", 6).alias("cover"))


@query("f_bit_packed", S.mask(50), "select tile, r, c, m from t")
def f_bit_packed(t):
    """A row's flags eight to a byte and back."""
    row = t.groupBy("tile", "r").agg(F.array_sort(F.collect_list(F.struct("c", "m"))).alias("v"))
    packed = row.select("tile", "r", F.transform("v", lambda x: x["c"]).alias("cs"), lookups.packed_bits(F.transform("v", lambda x: x["m"])).alias("bits"))
    each = packed.select("tile", "r", "bits", F.posexplode("cs").alias("at", "c"))
    return each.select("tile", "r", "c", lookups.bit_at(F.col("bits"), F.col("at")).alias("m"))


@query("k04_csv_fields", S.REVIEW, "select point_id || ',' || truth || ',' || stratum as line from t")
def k04_csv_fields(t):
    return t.select(F.to_csv(F.struct("point_id", "truth", "stratum")).alias("line"))


@query("k05_updated", S.REVIEW, "select point_id, case when cast(point_id as bigint) % 4 = 0 then 'checked' else truth end as truth from t")
def k05_updated(t):
    from rasterloom.sources.sinks import updated

    new = t.filter("cast(point_id as bigint) % 4 = 0").select("point_id", F.lit("checked").alias("truth"))
    return updated(t.select("point_id", "truth"), new, "point_id", ["truth"])

