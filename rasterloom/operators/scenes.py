"""Scene catalogue: push-down search, rankings, greedy picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def least_cloud(scenes: DataFrame, max_cloud: float, n: int = 1) -> DataFrame:
    return scenes.filter(F.col("cloud") < max_cloud).orderBy("cloud", "scene").limit(n)


def one_per_day(scenes: DataFrame, *keys: str) -> DataFrame:
    """The least cloudy scene of each day."""
    return first_by(scenes, [*keys, "day"], F.col("cloud"), F.col("scene"))


def clear_scenes(scenes: DataFrame, keys: list[str], k: int, accepted: Column) -> DataFrame:
    """A scene a day, months first in turn, then by cloud; the first k accepted, in order of time."""
    day = one_per_day(scenes, *keys).withColumn("_m", F.row_number().over(Window.partitionBy(*keys, F.month("day")).orderBy("cloud", "scene")))
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("_m") == 1, 0).otherwise(1), "cloud", "scene")
    ranked = day.withColumn("_ok", accepted.cast("int")).withColumn("_n", F.sum("_ok").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter((F.col("_ok") == 1) & (F.col("_n") <= k)).drop("_m", "_ok", "_n")


def pick_clear(scenes: DataFrame, keys: list[str], min_clear: float) -> DataFrame:
    """The first scene in order of cloud that is clear enough, else the clearest."""
    good = F.col("clear") >= min_clear
    return first_by(scenes, keys, F.when(good, 0).otherwise(1), F.when(good, F.col("cloud")), F.desc("clear"), F.col("scene"))


def composite_order(scenes: DataFrame, month: int, target: str) -> DataFrame:
    """Scenes ordered by season, nearness to a date, cloud and name; one for each day and tile."""
    order = [F.when(F.month("day") == month, 0).otherwise(1), F.abs(F.datediff("day", F.lit(target).cast("date"))), F.col("cloud"), F.col("scene")]
    by = F.when(F.month("day") == month, 0).otherwise(1) * 100_000 + F.abs(F.datediff("day", F.lit(target).cast("date")))
    return ranked(first_by(scenes, ["day", "tile"], *order), by, *order, out="rank")


def ranked(df: DataFrame, by: Column, *order: Column, out: str = "rank", parts: int = 256) -> DataFrame:
    """Rows numbered from 1 by a total order: stretches of `by`, a number that grows with it, are sorted on their own and
    shifted by the rows before each. The stretches are of one width between its least and its greatest value, so that
    every evaluation cuts them alike."""
    ends = df.agg(F.min(by).cast("double").alias("_lo"), F.max(by).cast("double").alias("_hi"))
    at = F.floor(F.try_divide((by - F.col("_lo")) * parts, F.col("_hi") - F.col("_lo")))
    cut = df.crossJoin(F.broadcast(ends)).withColumn("_p", F.when(by.isNull(), -1).otherwise(F.coalesce(F.least(at, F.lit(parts - 1)), F.lit(0))).cast("int")).drop("_lo", "_hi")
    sizes = cut.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each stretch
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = cut.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    shift = sizes.withColumn("_before", before).select("_p", "_before")
    return own.join(F.broadcast(shift), "_p").withColumn(out, (F.col("_i") + F.col("_before")).cast("int")).drop("_p", "_i", "_before")


def provided(scenes: DataFrame, provider: str, signed: tuple[str, ...] = ("planetary",)) -> DataFrame:
    """The scenes of one provider, with whether its addresses have to be signed: a partition of the catalogue."""
    return scenes.filter(F.col("provider") == provider).withColumn("signed", F.lit(provider in signed))


def search(scenes: DataFrame, box: tuple[float, float, float, float], first: str, last: str, max_cloud: float, limit: int = 1) -> DataFrame:
    """The least cloudy scenes that meet a box within two dates; empty when there is none. All filters reach the scan."""
    west, south, east, north = box
    meets = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return scenes.filter(meets & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("cloud") < max_cloud)).orderBy("cloud", "scene").limit(limit)


def around(scenes: DataFrame, box: tuple[float, float, float, float], day: str, days: int, max_cloud: float = 0.5) -> DataFrame:
    """Scenes that meet a box at most `days` from a date, with the difference in days and a missing clear share as 0."""
    west, south, east, north = box
    d0 = F.lit(day).cast("date")
    meets = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    near = F.col("day").between(F.date_sub(d0, days), F.date_add(d0, days))
    return scenes.filter(meets & near & (F.col("cloud") <= max_cloud)).withColumn("delta", F.datediff("day", d0)).withColumn("clear", F.coalesce("clear", F.lit(0.0)))


def covering(frames: DataFrame, site_cells: DataFrame, keys: list[str], enough: float = 0.95, least: float = 0.90) -> DataFrame:
    """For each site the frames to take: the nearest gap of days that covers it, the best date of that gap.

    frames: keys, scene, day, delta, clear and the cells (array) that it has; site_cells: keys and how many cells (n) a
    site has. On a date, frames are taken clearest first, those without new cells left out, until `enough` is covered;
    dates compare by whether that was reached, cover, and fewer frames. A site's frames of one date are few, so a fold
    over them is bounded.
    """
    f = frames.join(site_cells, keys).withColumn("gap", F.abs("delta"))
    by = f.groupBy(*keys, "gap", "day").agg(F.sort_array(F.collect_list(F.struct((-F.col("clear")).alias("a"), (-F.size("cells")).alias("b"), "scene", "cells"))).alias("_f"), F.max("n").alias("n"))
    zero = F.expr("named_struct('seen', cast(array() as array<bigint>), 'kept', cast(array() as array<bigint>))")

    def step(a: Column, x: Column) -> Column:
        new = F.array_union(a["seen"], x["cells"])
        take = (F.size(new) > F.size(a["seen"])) & (F.size(a["seen"]) < enough * F.col("n"))
        return F.when(take, F.struct(new.alias("seen"), F.concat(a["kept"], F.array(x["scene"])).alias("kept"))).otherwise(a)

    dates = by.withColumn("_c", F.aggregate("_f", zero, step)).select(*keys, "gap", "day", F.col("_c.kept").alias("scenes"), (F.size("_c.seen") / F.col("n")).alias("cover"))
    dates = dates.filter(F.size("scenes") > 0)
    best = first_by(dates, [*keys, "gap"], F.desc(F.col("cover") >= enough), F.desc("cover"), F.size("scenes"), F.col("day"))
    return first_by(best.filter(F.col("cover") >= least), keys, F.col("gap")).drop("gap")


def season_max(site_scenes: DataFrame, value: str = "ha") -> DataFrame:
    """The scene with the largest area of a site and year, the earliest of equals."""
    return first_by(site_scenes, ["site", "yr"], F.desc(value), F.col("day"), F.col("scene"))


def ever(px: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    return px.groupBy(*keys).agg(F.bool_or(flag).alias("ever"))


def thinned(dates: DataFrame, key: str, step: int) -> DataFrame:
    """Dates at least step days after the last kept one: a fold over the ordered days of a key."""
    days = dates.groupBy(key).agg(F.sort_array(F.collect_set("day")).alias("days"))
    fold = F.aggregate("days", F.expr("cast(array() as array<date>)"), lambda a, d: F.when((F.size(a) == 0) | (F.datediff(d, F.element_at(a, -1)) >= step), F.concat(a, F.array(d))).otherwise(a))
    return days.select(key, F.explode(fold).alias("day"))


def first_fit(rows: DataFrame, key: str, cap: float) -> DataFrame:
    """Rows in order that fit under a cap with those kept before; a later smaller row may still fit."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "amount"))).alias("rows"))
    zero = F.expr("named_struct('used', 0D, 'kept', cast(array() as array<bigint>))")
    fold = F.aggregate(
        "rows", zero,
        lambda a, x: F.when(a["used"] + x["amount"] <= cap, F.struct((a["used"] + x["amount"]).alias("used"), F.concat(a["kept"], F.array(x["ord"])).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    return listed.select(key, F.explode(fold).alias("ord"))


def nearest(left: DataFrame, right: DataFrame, key: str, days: int) -> DataFrame:
    """For each left date the nearest right date within some days either way; of equals the smaller value."""
    r = right.select(F.col(key).alias("_key"), F.col("day").alias("other_day"), F.col("value").alias("other"))
    near = left.join(r, (F.col(key) == F.col("_key")) & (F.abs(F.datediff("day", "other_day")) <= days))
    return first_by(near, [key, "day"], F.abs(F.datediff("day", "other_day")), F.col("other")).drop("_key")
