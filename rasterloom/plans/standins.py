"""Stand-ins for imagery over the driver tables: SQL that Spark and DuckDB read alike, so an oracle sees the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "conversations")

#: Six bands on a raster 100 cells wide; orders without lines are pixels without data.
PX = """
select cast(floor(o_orderkey / 100.0) as int) as r, cast(o_orderkey % 100 as int) as c, cast(o_custkey % 5 as int) as site,
  cast(year(o_orderdate) as int) as yr, o_orderkey as id, cast(o_custkey % 12 as int) as scl,
  round(200 + 8 * q, 6) as blue, round(300 + 10 * q, 6) as green, round(300 + 20000 * d, 6) as red, round(400 + p / 20, 6) as nir,
  round(100 + 50000 * t, 6) as swir1, round(100 + 30000 * t + 10 * q, 6) as swir2, cast(n as bigint) as n
from {orders} left join (
  select l_orderkey, avg(l_quantity) as q, avg(l_extendedprice) as p, avg(l_discount) as d, avg(l_tax) as t, count(*) as n
  from {lineitem} group by l_orderkey) as x on l_orderkey = o_orderkey
"""
MASK = """select cast(floor(event_id / 100.0) as int) as r, cast(event_id % 100 as int) as c,
cast(floor(event_id / 2500.0) as int) as tile, value, value > {t} as m from {{events}}"""
SCENES = """
select o_orderkey as scene, cast(o_orderdate as date) as day, round(o_totalprice % 100, 6) as cloud, round((o_totalprice % 83) / 83, 6) as clear,
  cast(o_custkey % 50 as int) as site, cast(year(o_orderdate) as int) as yr, o_orderpriority as tile, round(o_totalprice % 997, 6) as ha
from {orders}
"""
SERIES = """
select cast(o_custkey % 200 as int) as site, cast(year(o_orderdate) as int) as yr, round(sum(o_totalprice),
2) / 1000 as ha, round(max(o_totalprice), 4) as top, count(*) as n
from {orders} group by 1, 2
"""
EVENTS = "select event_id as row_id, cast(ts as date) as day, ts, cast(user_id % 40 as int) as site, event_type as kind, value from {events}"
DAILY = "select cast(ts as date) as day, case when sum(value) % 7 < 1 then null else round(sum(value) % 11, 6) end as rain from {events} group by 1"
POINTS = """
select d.doc_id as point_id, l.quality = 1 as truth, d.source as stratum, cast(case when d.n_chars > 900 then 1 else 0 end as int) as by_size,
  cast(case when d.doc_id % 11 = 0 then null when d.lang = 'en' then 1 else 0 end as int) as by_lang,
  count(*) over (partition by d.source) as sample, 3 * count(*) over (partition by d.source) + 7 as population
from {documents} as d join {labels} as l on d.doc_id = l.doc_id
"""
VOTES = """
select doc_id, 1 as pass, case when quality = 1 then 'a' else 'b' end as label from {labels}
union all select doc_id, 2, case when toxic = 1 then 'b' when doc_id % 9 = 0 then 'unsure' else 'a' end from {labels}
union all select doc_id, 3, case when doc_id % 3 = 0 then 'b' else 'a' end from {labels}
"""


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A stand-in's rows."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The stand-in over views of the tables' names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def mask(threshold: float) -> str:
    return MASK.format(t=threshold)

#: Quadrilaterals, one for each nation, and larger ones for each region, as edges.
QUADS = """
select poly, cast(0 as int) as ring, k as seq, cx + case k when 1 then -h when 2 then h
when 3 then h - 1 else 2 - h end as ax, cy + case k when 1 then -h when 2 then 2 - h when 3 then h else h - 1 end as ay,
  cx + case k when 1 then h when 2 then h - 1 when 3 then 2 - h else -h end as bx, cy + case k
when 1 then 2 - h when 2 then h when 3 then h - 1 else -h end as by_
from ({centres}) as p cross join (select 1 as k union all select 2 union all select 3 union all select 4) as q
"""
EDGES = QUADS.format(centres="""select n_nationkey as poly, cast(10 + n_nationkey % 5 * 20 as double) as cx,
cast(10 + floor(n_nationkey / 5.0) * 20 as double) as cy, cast(6 + n_nationkey % 4 as double) as h
from {nation}""")
OTHERS = QUADS.format(centres="""select r_regionkey as poly, cast(15 + r_regionkey * 20 as double) as cx,
cast(30 + r_regionkey * 10 as double) as cy, cast(14 as double) as h from {region}""")
DEGREES = QUADS.format(centres="""select n_nationkey as poly, cast(-9.5 + n_nationkey * 0.1 as double) as cx,
cast(52 + n_nationkey * 0.05 as double) as cy, cast(3 as double) as h from {nation}""")
DOTS = """select event_id as pid, cast(event_id % 100 as double) + 0.3 as x,
cast(floor(event_id / 100.0) % 100 as double) + 0.7 as y, value, cast(case
when user_id % 3 = 0 then 8 else 3 end as double) as footprint, cast(2015 + event_id % 9 as int) as yr
from {events}"""
#: Scenes of pixels that meet again: 40 cells of a row for each site, year and scene.
CELLS = """
select site, yr, cast(id % 3 as int) as scene, cast(concat(cast(yr as varchar(4)), '-0',
cast(5 + id % 3 as varchar(1)), '-15') as date) as day, cast(0 as int) as r, cast(c % 40 as int) as c,
  round(avg(blue), 4) as blue, round(avg(green), 4) as green, round(avg(red), 4) as red, round(avg(nir),
4) as nir, round(avg(swir1), 4) as swir1, round(avg(swir2), 4) as swir2, min(scl) as scl
from (""" + PX + """) as px group by site, yr, id % 3, c % 40
"""
#: Labelled points with populations and a detector's version.
REVIEW = """
select cast(d.doc_id as varchar(20)) as point_id, case when l.quality = 1 then 'bare_peat'
when l.doc_id % 13 = 0 then 'unsure' when l.doc_id % 2 = 0 then 'vegetated' else 'water' end as truth,
d.source as stratum, d.lang as site,
  cast(2018 + d.doc_id % 4 as int) as yr, cast(case when d.n_chars > 900 then 1 else 0 end as int) as by_size,
cast(case when d.doc_id % 11 = 0 then null when d.lang = 'en' then 1 else 0 end as int) as by_lang,
  count(*) over (partition by d.source) as sample,
3 * count(*) over (partition by d.source) + 7 as population, 'v5' as version, round(d.n_chars % 97 / 97.0, 4) as ndvi
from {documents} as d join {labels} as l on d.doc_id = l.doc_id
"""
#: Yearly figures of sites with flags.
RELEASE = """
select cast(o_custkey % 200 as int) as site, cast(year(o_orderdate) as int) as yr,
round(sum(o_totalprice) / 100000, 4) as ha, sum(o_orderkey) % 5 = 0 as flagged,
sum(o_orderkey) % 7 = 0 as after_fire, round(cast(sum(o_orderkey) % 17 as double), 4) as largest
from {orders} group by 1, 2
"""
