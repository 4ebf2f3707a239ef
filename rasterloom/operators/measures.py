"""Aggregates over pixels, scenes, samples and labels. Undefined shares are NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area_ha(mask: Column, a: float = 10.0, e: float = -10.0) -> Column:
    return F.count_if(mask) * abs(a * e) / 10000


def clear_share(valid: Column, inside: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(valid & inside), F.count_if(inside)), F.lit(0.0))


def share(flag: Column, of: Column) -> Column:
    """Share of flagged among `of`, 0 when there are none."""
    return F.count_if(flag & of) / F.greatest(F.count_if(of), F.lit(1))


def quality(px: DataFrame, keys: list[str], haze: Column, hot: Column, cloud: Column, shadow: Column, inside: Column) -> DataFrame:
    """Shares of a scene inside a site, in one pass."""
    out = {"haze": haze, "hot": hot, "cloud": cloud, "shadow": shadow, "clear": ~(haze | hot | cloud | shadow)}
    return px.groupBy(*keys).agg(*[share(v, inside).alias(k) for k, v in out.items()])


def adaptive_threshold(px: DataFrame, keys: list[str], ndvi: Column, trusted: Column, cap: float = 0.25, floor: float = 0.10, drop: float = 0.18, least: int = 100, floor_first: bool = True) -> DataFrame:
    """A scene's NDVI threshold from its upper quartile over trusted pixels.

    floor_first: min(cap, max(p75 - drop, floor)), so a cap below the floor holds; else max(floor, min(cap, ...)).
    Scenes with fewer than `least` trusted pixels keep the cap.
    """
    seen = F.when(trusted, ndvi)
    by = px.groupBy(*keys).agg(F.percentile(seen, F.lit(0.75)).alias("p75"), F.count(seen).alias("n"))
    own = F.col("p75") - drop
    value = F.least(F.lit(cap), F.greatest(own, F.lit(floor))) if floor_first else F.greatest(F.lit(floor), F.least(F.lit(cap), own))
    return by.withColumn("threshold", F.when(F.col("n") >= least, value).otherwise(F.lit(cap)))


def z_scores(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns less their mean over population deviation plus 1e-9, by group: an aggregate joined back."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    out = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # without keys: one row
    for c in columns:
        out = out.withColumn(f"z_{c}", (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def confusion(truth: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    w = F.lit(1) if weight is None else weight
    cell = lambda t, p: F.sum(F.when(t & p, w).otherwise(0))
    return [cell(truth, predicted).alias("tp"), cell(~truth, predicted).alias("fp"), cell(truth, ~predicted).alias("fn"), cell(~truth, ~predicted).alias("tn")]


def scores(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of confusion counts, NULL on empty denominators."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return df.select("*", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def score_points(points: DataFrame, methods: list[str], truth: Column, population: str, sample: str) -> DataFrame:
    """Sample and population-weighted scores of each method; unobserved predictions are left out."""
    tall = points.withColumn("_truth", truth).unpivot([c for c in (*points.columns, "_truth") if c not in methods], methods, "method", "predicted").filter("predicted is not null")
    by = {}
    for scope, w in (("sample", F.lit(1)), ("weighted", F.try_divide(F.col(population).cast("double"), F.col(sample)))):
        by[scope] = scores(tall.groupBy("method").agg(*confusion(F.col("_truth"), F.col("predicted") == 1, w))).withColumn("scope", F.lit(scope)).select("method", "scope", *[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy")])
    return by["sample"].unionByName(by["weighted"])


def distribution(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    v = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    names = [f"p{round(p * 100)}" for p in at]
    agg = df.groupBy(*keys).agg(F.percentile(v, F.array(*[F.lit(p) for p in at])).alias("q"), F.count(v).alias("n"))
    return agg.select(*keys, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def overlap(a: Column, b: Column, support: Column) -> list[Column]:
    """Intersection over union, NULL when empty, and what is in one mask only."""
    both, either = F.count_if(a & b & support), F.count_if((a | b) & support)
    return [F.try_divide(both, either).alias("iou"), F.count_if(a & ~b & support).alias("only_a"), F.count_if(~a & b & support).alias("only_b"), F.try_divide(F.count_if((a == b) & support), F.count_if(support)).alias("agreement")]


def ols(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, correlation (NULL for a constant y) and RMSE of y on x."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    by = ok.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"), F.when(F.var_pop(y) > 0, F.corr(x, y)).alias("r"),
        F.count("*").alias("n"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"), F.regr_sxx(y, x).alias("_xx"),
    )
    rest = F.greatest(F.col("_yy") - F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx")), F.lit(0.0))
    return by.select(*keys, "a", "b", "r", "n", F.sqrt(rest / F.col("n")).alias("rmse"))


def rate(year: str, value: str, least: int = 2) -> Column:
    """Slope for each year, 0 when there are too few or a single year."""
    return F.when(F.count(value) >= least, F.coalesce(F.regr_slope(value, year), F.lit(0.0))).otherwise(0.0)


def cohen(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters; NULL when chance agreement is whole."""
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    n = F.sum("n").over(Window.partitionBy(*keys))
    cells = cells.withColumn("_n", n).withColumn("_a", F.sum("n").over(Window.partitionBy(*keys, a))).withColumn("_b", F.sum("n").over(Window.partitionBy(*keys, b)))
    # each label's marginals meet once, where both raters' label is the same, or as a pair of totals
    po = F.sum(F.when(F.col(a) == F.col(b), F.col("n"))) / F.max("_n")
    left = cells.groupBy(*keys, F.col(a).alias("_label")).agg(F.max("_a").alias("x"), F.max("_n").alias("_n"))
    right = cells.groupBy(*keys, F.col(b).alias("_label")).agg(F.max("_b").alias("y"))
    pe = left.join(right, [*keys, "_label"]).groupBy(*keys).agg((F.sum(F.col("x") / F.col("_n") * F.col("y") / F.col("_n"))).alias("pe"))
    seen = cells.groupBy(*keys).agg(F.coalesce(po, F.lit(0.0)).alias("po"), F.max("_n").alias("n"))
    both = seen.join(pe, keys, "left") if keys else seen.crossJoin(F.broadcast(pe))
    return both.select(*keys, "n", "po", F.coalesce("pe", F.lit(0.0)).alias("pe"), F.try_divide(F.col("po") - F.coalesce("pe", F.lit(0.0)), 1 - F.coalesce("pe", F.lit(0.0))).alias("kappa"))


def fleiss(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Fleiss' kappa over items with equally many votes."""
    cells = votes.groupBy(item, label).agg(F.count("*").alias("v"))
    items = cells.groupBy(item).agg(F.sum("v").alias("k"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    p = items.select(F.try_divide(F.col("vv") - F.col("k"), F.col("k") * (F.col("k") - 1)).alias("p")).agg(F.avg("p").alias("po"))
    pe = cells.groupBy(label).agg(F.sum("v").alias("v")).withColumn("s", F.col("v") / F.sum("v").over(Window.partitionBy())).agg(F.sum(F.col("s") * F.col("s")).alias("pe"))
    return p.crossJoin(F.broadcast(pe)).select("po", "pe", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def majority(votes: DataFrame, item: str, label: str, tie: str = "unsure") -> DataFrame:
    """The label with most votes of each item; ties are unsure."""
    cells = votes.filter(F.col(label) != tie).groupBy(item, label).agg(F.count("*").alias("v"))
    w = Window.partitionBy(item).orderBy(F.desc("v"), label)
    ranked = cells.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("v").over(w)).filter("_k = 1")
    every = votes.select(item).distinct()
    picked = ranked.select(item, F.when(F.col("v") == F.col("_next"), tie).otherwise(F.col(label)).alias("label"), "v")
    return every.join(picked, item, "left").select(item, F.coalesce("label", F.lit(tie)).alias("label"), F.coalesce("v", F.lit(0)).alias("votes"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum without replacement, by a hash of seed and key: the same whatever the partitions."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).filter(F.col("_k") <= n).drop("_k")


def post_stratified(df: DataFrame, stratum: str, population: DataFrame, value: str) -> DataFrame:
    """Population-weighted mean of strata means; population has stratum, pop."""
    means = df.groupBy(stratum).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    return means.join(population, stratum).agg(F.try_divide(F.sum(F.col("pop") * F.col("m")), F.sum("pop")).alias("estimate"), F.sum("n").alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Counts between fixed bounds; the last bin is open."""
    bin_ = F.lit(-1)
    for b in bounds:
        bin_ = bin_ + F.when(F.col(value) >= b, 1).otherwise(0)
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).filter("bin >= 0")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each broken rule of each row; a rule that cannot be decided is broken."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(key, F.explode(F.array_compact(checks)).alias("rule"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has; empty where the sets are equal."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).union(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def looked_up(points: DataFrame, mask: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Points with the mask's value at their pixel as text: "" where there is none, never 0."""
    m = mask.select(*keys, F.col(flag).alias("_m"))
    return points.join(m, keys, "left").withColumn("predicted", F.when(F.col("_m").isNull(), "").when(F.col("_m"), "1").otherwise("0")).drop("_m")


def mismatches(cache: DataFrame, cards: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, fault: cards that are missing, and those whose value differs from the cache's."""
    c = cards.select(*keys, F.col(value).alias("_card"), F.lit(True).alias("_there"))
    both = cache.join(c, keys, "left")
    fault = F.when(F.col("_there").isNull(), "missing").when(~F.col(value).eqNullSafe(F.col("_card")), name)
    return both.withColumn("fault", fault).filter("fault is not null").select(*keys, "fault")


def near_register(value: Column, register: Column, share: float = 0.08) -> Column:
    """Within a share of the registered figure."""
    return F.abs(value - register) <= share * register


def no_drop(value: Column, before: Column, share: float = 0.15) -> Column:
    """No more than a share below the last build."""
    return value >= (1 - share) * before
