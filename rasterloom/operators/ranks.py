"""Rank and trend tests: built-in windows for the statistics, vectorised functions for the p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(1 + num * d, tiny) if 1 + num * d >= 0 else 1 / min(1 + num * d, -tiny)
        c = 1 + num / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * f


@F.pandas_udf(DoubleType())
def two_sided_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x or n <= 0 else beta_fraction(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype="float64")


def mann_kendall(df: DataFrame, key: str, time: str, value: str, least: int = 4) -> DataFrame:
    """Sign sum over all ordered pairs of a short series, its tie-corrected variance, z with continuity correction."""
    series = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("s"))
    pairs = F.expr("aggregate(sequence(1, size(s)), 0L, (a, i) -> a + aggregate(slice(s, i + 1, size(s)), 0L, (b, x) -> b + cast(sign(x.v - element_at(s, i).v) as bigint)))")
    ties = F.expr("aggregate(array_distinct(transform(s, x -> x.v)), 0L, (a, v) -> a + size(filter(s, x -> x.v = v)) * (size(filter(s, x -> x.v = v)) - 1L) * (2L * size(filter(s, x -> x.v = v)) + 5L))")
    out = series.filter(F.size("s") >= least).select(key, F.size("s").cast("long").alias("n"), pairs.alias("S"), ties.alias("_t"))
    out = out.withColumn("var", (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("_t")) / 18.0)
    z = F.when(F.col("S") > 0, F.try_divide(F.col("S") - 1, F.sqrt("var"))).when(F.col("S") < 0, F.try_divide(F.col("S") + 1, F.sqrt("var"))).otherwise(0.0)
    return out.withColumn("z", z).drop("_t")


def mean_rank(value: str, *keys: str) -> Column:
    """Rank with equals sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 4) -> DataFrame:
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.withColumn("_x", mean_rank(x, *keys)).withColumn("_y", mean_rank(y, *keys))
    return ranked.groupBy(*keys).agg(F.when(F.count("*") >= least, F.corr("_x", "_y")).alias("rho"), F.count("*").alias("n"))


def spearman_p(rho: Column, n: Column) -> Column:
    return two_sided_t(rho * F.sqrt(F.try_divide(n - 2, 1 - rho * rho)), (n - 2).cast("double"))


def mann_whitney(df: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """U of the first group, its area under the curve, and z with tie and continuity correction."""
    ranked = df.filter(F.col(value).isNotNull()).withColumn("_g", group).withColumn("_r", mean_rank(value, *keys))
    ranked = ranked.withColumn("_e", F.count("*").over(Window.partitionBy(*keys, value)))
    by = ranked.groupBy(*keys).agg(F.count_if("_g").alias("n1"), F.count_if(~F.col("_g")).alias("n2"), F.sum(F.when(F.col("_g"), F.col("_r"))).alias("_s"), F.sum(F.col("_e") * F.col("_e") - 1).cast("double").alias("_t"))
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("_t"), (n * (n - 1)).cast("double"))))
    return by.withColumn("u", u).select(*keys, "n1", "n2", "u", F.try_divide(u, (F.col("n1") * F.col("n2")).cast("double")).alias("auc"), F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 - 0.5, sd).alias("z"))
