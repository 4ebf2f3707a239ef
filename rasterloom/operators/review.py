"""Reference labels: gates before scoring, votes and their merging, relabelling, errors by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import measures

POSITIVE, UNSURE = "bare_peat", "unsure"


def faults(points: DataFrame, methods: list[str], classes: list[str]) -> DataFrame:
    """point_id, fault of rows that no score may be made from: no or repeated id, unknown label, value not 0 or 1."""
    w = Window.partitionBy("point_id")
    rules = {"id": F.col("point_id").isNotNull() & (F.trim(F.col("point_id").cast("string")) != "") & (F.count("*").over(w) == 1)}
    rules["truth"] = F.coalesce(F.col("truth"), F.lit("")).isin("", *classes)
    rules |= {m: F.col(m).isNull() | F.col(m).isin(0, 1) for m in methods}
    named = points.select("point_id", *[ok.alias(f"_{k}") for k, ok in rules.items()])
    return named.select("point_id", F.explode(F.array_compact(F.array(*[F.when(~F.col(f"_{k}"), F.lit(k)) for k in rules]))).alias("fault"))


def readiness(points: DataFrame, strata: list[str]) -> DataFrame:
    """One row: points, labelled ones, status, whether weights are known, and how many detector versions are mixed.

    Weights need every label decided, and one whole population, not below the sample, and the sample's own size in each stratum.
    """
    by = points.groupBy(*strata).agg(F.countDistinct("population").alias("p"), F.countDistinct("sample").alias("s"), F.max("population").alias("population"), F.max("sample").alias("sample"), F.count("*").alias("n"))
    ok = (F.col("p") == 1) & (F.col("s") == 1) & (F.col("sample") == F.col("n")) & (F.col("population") >= F.col("sample")) & (F.col("population") == F.floor("population"))
    known = by.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("_known"))
    decided = F.coalesce(~F.col("truth").isin("", UNSURE), F.lit(False))
    every = points.agg(F.count("*").alias("points"), F.count_if(decided).alias("labelled"), F.countDistinct("version").alias("versions"))
    complete = (F.col("points") > 0) & (F.col("points") == F.col("labelled"))
    return every.crossJoin(F.broadcast(known)).select("points", "labelled", F.when(complete, "complete").otherwise("awaiting_labels").alias("status"), (complete & F.col("_known")).alias("weighted"), "versions")


def one_version(points: DataFrame) -> DataFrame:
    """The points; an error when they come from several versions of a detector."""
    n = points.agg(F.countDistinct("version").alias("_v"))
    ok = F.assert_true(F.col("_v") <= 1, F.lit("mixed detector versions: score each run on its own"))
    return points.crossJoin(F.broadcast(n)).filter(ok.isNull()).drop("_v")


def usable(points: DataFrame, strata: list[str]) -> DataFrame:
    """Decided points, each stratum's sample size counted anew."""
    kept = points.filter(F.coalesce(~F.col("truth").isin("", UNSURE), F.lit(False)))
    return kept.withColumn("sample", F.count("*").over(Window.partitionBy(*strata)))


def sample_scores(points: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """Scores over the points that the method and the label decide."""
    ok = points.filter(F.col(method).isin(0, 1) & F.coalesce(~F.col("truth").isin("", UNSURE), F.lit(False)))
    by = ok.groupBy(*keys).agg(F.count("*").alias("n"), *measures.confusion(F.col("truth") == POSITIVE, F.col(method) == 1))
    return measures.scores(by)


def errors(points: DataFrame, method: str, place: list[str]) -> DataFrame:
    """Counts of false positives by their true label and of misses by place, in one table."""
    hit, true = F.col(method) == 1, F.col("truth") == POSITIVE
    wrong = points.withColumn("_p", F.coalesce(hit, F.lit(False))).filter(F.col("_p") != true)
    what = F.when(F.col("_p"), F.col("truth")).otherwise(F.concat_ws(" ", *[F.col(c).cast("string") for c in place]))
    return wrong.groupBy(F.when(F.col("_p"), "false_positive").otherwise("miss").alias("kind"), what.alias("of")).agg(F.count("*").alias("n"))


def strict(points: DataFrame, contested: DataFrame) -> DataFrame:
    """Contested positives count as vegetated."""
    c = contested.select("point_id").distinct().withColumn("_c", F.lit(True))
    truth = F.when(F.col("_c") & (F.col("truth") == POSITIVE), "vegetated").otherwise(F.col("truth"))
    return points.join(c, "point_id", "left").withColumn("truth", truth).drop("_c")


def summer_checked(points: DataFrame, summer: DataFrame, green: float) -> DataFrame:
    """Positives whose pixel is green the summer after count as vegetated; `changed` marks them."""
    flip = F.coalesce((F.col("truth") == POSITIVE) & (F.col("ndvi") >= green), F.lit(False))
    return points.join(summer.select("point_id", "ndvi"), "point_id", "left").withColumn("changed", flip).withColumn("truth", F.when(F.col("changed"), "vegetated").otherwise(F.col("truth"))).drop("ndvi")


def voted(votes: DataFrame, item: str, label: str, agree: int) -> DataFrame:
    """Label, status and votes of each item: agreed by `agree` or more, a majority of at least half, or unsure."""
    cells = votes.groupBy(item, label).agg(F.count("*").alias("_v"))
    every = cells.groupBy(item).agg(F.sum("_v").alias("votes"))
    w = Window.partitionBy(item).orderBy(F.desc("_v"), label)
    top = cells.filter(F.col(label) != UNSURE).withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_v").over(w)).filter("_k = 1")
    single = ~F.coalesce(F.col("_v") == F.col("_next"), F.lit(False)) & F.col("_v").isNotNull()
    status = F.when(single & (F.col("_v") >= agree), "agree").when(single & (2 * F.col("_v") >= F.col("votes")), "majority").otherwise("disagree")
    out = every.join(top, item, "left").withColumn("status", status)
    return out.select(item, F.when(F.col("status") == "disagree", UNSURE).otherwise(F.col(label)).alias("label"), "status", "votes")


def consensus(pairs: DataFrame) -> DataFrame:
    """label, confidence, status from two passes (a, b with a_level, b_level 0 to 2) and an earlier label.

    Agreement keeps the lower level. Otherwise an unsure pass gives way, then the lower level does, then the pass that
    the earlier label does not side with; failing that the item is unsure.
    """
    a, b, x, y = F.col("a"), F.col("b"), F.coalesce("a_level", F.lit(1)), F.coalesce("b_level", F.lit(1))
    split = F.when(a == UNSURE, b).when(b == UNSURE, a).when(x > y, a).when(y > x, b).when((F.col("earlier") == a) | (F.col("earlier") == b), F.col("earlier")).otherwise(UNSURE)
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(x, y) + 1)
    none, one = a.isNull() & b.isNull(), a.isNull() | b.isNull()
    label = F.when(one, F.coalesce(a, b)).when(a == b, a).otherwise(split)
    return pairs.select("item", label.alias("label"), F.when(none, None).when(one, "low").when(a == b, level).otherwise("low").alias("confidence"), F.when(none, "missing").when(one, "single pass").when(a == b, "agree").otherwise("disagree").alias("status"))


def weighted_share(df: DataFrame, weight: str, value: Column) -> DataFrame:
    """Share by area: the mean of each row's value, weighted."""
    return df.agg(F.try_divide(F.sum(F.col(weight) * value), F.sum(F.when(value.isNotNull(), F.col(weight)))).alias("share"))


def node_votes(px: DataFrame, keys: list[str], node: str, label: str) -> DataFrame:
    """Pixels with whether their node is named positive: more than half of its labelled points are."""
    by = px.filter(F.col(label).isNotNull()).groupBy(*keys, node).agg((F.avg(F.col(label).cast("double")) > 0.5).alias("named"))
    return px.join(by, [*keys, node], "left").withColumn("named", F.coalesce("named", F.lit(False)))
