"""Last digits: queries whose rounded numbers lie on halves, exactly against their SQL."""

from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from rasterloom.plans import catalogue
from rasterloom.plans import standins as S


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_aligned_to_the_last_digit(spark, sf):
    got = catalogue.QUERIES["s08_aligned"](spark, f"/root/testdata/{sf}")
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '/root/testdata/{sf}/events.parquet'")
        want = db.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLES['s08_aligned']})").fetchall()
    assert {tuple(r) for r in got.collect()} == set(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_slopes_to_the_last_digit(spark, sf):
    """Against exact fractions, halves away from zero: the SQL's own runs disagree where a slope is a half."""
    by = defaultdict(list)
    for site, yr, ha in S.rows(spark, f"/root/testdata/{sf}", S.RELEASE).filter("not flagged").select("site", "yr", "ha").collect():
        by[site].append((yr, Fraction(str(ha))))
    want = defaultdict(float)
    for site, p in by.items():
        n, x, y = len(p), sum(a for a, _ in p), sum(b for _, b in p)
        if n > 2:
            slope = (n * sum(a * b for a, b in p) - x * y) / (n * sum(a * a for a, _ in p) - x * x) * 100_000
            want[site] = int(abs(slope) + Fraction(1, 2)) * (1 if slope > 0 else -1) / 100_000
    got = {r.site: r.rate for r in catalogue.QUERIES["q03_derived"](spark, f"/root/testdata/{sf}").collect()}
    assert got == {site: want[site] for site in got}
