"""Queries that ran over a part of their tables cover every row."""

import pytest

from rasterloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table, times", [("r16_upsampled", "events", 9), ("t08_weather", "events", 1)])
def test_every_event(spark, name, table, times):
    assert catalogue.QUERIES[name](spark, SF).count() == times * spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["j09_nearest_date", "w05_thinned"])
def test_every_site(spark, name):
    sites = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_custkey % 50 as site").distinct().count()
    assert catalogue.QUERIES[name](spark, SF).select("site").distinct().count() == sites


def test_every_day_and_tile(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("cast(o_orderdate as date) as day", "o_orderpriority as tile")
    assert catalogue.QUERIES["w03_composite_order"](spark, SF).count() == rows.distinct().count()


def test_normal_of_every_event_over_thirty_days(spark, tmp_path):
    """The tables' events lie in one year, for which there is no normal; these lie in two."""
    days = spark.sql("select explode(sequence(date '2022-01-01', date '2023-12-31', interval 1 day)) as day")
    days.selectExpr("cast(datediff(day, date '2022-01-01') as bigint) as event_id", "cast(day as timestamp) as ts", "2.0d as value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event: r.normal for r in catalogue.QUERIES["t09_normal"](spark, str(tmp_path)).collect()}
    # the first 30 days of 2022 are preceded, in 2023, by whole windows; those of 2023 have none in 2022
    assert got == {i: 60.0 for i in range(730) if not 365 <= i < 395}


def test_production_parameters(spark, monkeypatch):
    """Gas and bootstrap queries leave sample, steps, nodes and replicates to the operators."""
    given = []
    for of, name in ((catalogue.cluster, "bounded_sample"), (catalogue.cluster, "fit_gas"), (catalogue.resampling, "intervals"), (catalogue.resampling, "mean_interval")):
        monkeypatch.setattr(of, name, lambda *a, _f=getattr(of, name), **k: (given.append((_f.__name__, [x for x in a if type(x) is int], k)), _f(*a, **k))[1])
    for q in ("m01_neural_gas", "m13_bootstrap", "m14_mean_interval"):
        assert catalogue.QUERIES[q](spark, SF).count()
    assert given == [(f, [], {}) for f in ("bounded_sample", "fit_gas", "intervals", "mean_interval")]
