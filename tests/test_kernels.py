"""Operators that SQL cannot state, against small cases by hand or brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rasterloom.functions import geodesy, indices
from rasterloom.operators import cluster, polygons, raster, resampling, review, scenes


def blobs(seed=0, n=400):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal((0, 0), 0.1, (n, 2)), rng.normal((5, 5), 0.1, (n, 2))])


def test_gas_follows_its_sample():
    x = blobs()
    a, b = cluster.NeuralGas(nodes=20, steps=3000).fit(x), cluster.NeuralGas(nodes=20, steps=3000).fit(x)
    assert np.array_equal(a.w, b.w) and a.edges == b.edges
    assert 2 < len(a.w) <= 20
    assert max(np.sqrt(((a.w - p) ** 2).sum(1)).min() for p in ((0, 0), (5, 5))) < 0.3
    label = a.components(1.5)
    assert len({int(c) for c, w in zip(label, a.w, strict=True) if w[0] < 2.5} & {int(c) for c, w in zip(label, a.w, strict=True) if w[0] > 2.5}) == 0


def test_gas_inserts_ages_and_prunes():
    gas = cluster.NeuralGas(nodes=4, steps=1)
    gas.w, gas.error = np.array([[0.0], [1.0], [10.0]]), np.array([1.0, 5.0, 2.0])
    gas.ages = np.array([[-1, 0, -1], [0, -1, 3], [-1, 3, -1]])
    gas.insert()  # between 1 (largest error) and 2 (the worse of its neighbours)
    assert gas.w.ravel().tolist() == [0, 1, 10, 5.5]
    assert gas.error.tolist() == [1, 2.5, 1, 2.5]
    assert gas.edges == {frozenset((0, 1)): 0, frozenset((1, 3)): 0, frozenset((2, 3)): 0}
    gas.age = 2
    gas.ages[2, 3] = gas.ages[3, 2] = 2
    gas.learn(np.array([5.0]))  # the winner is 3: its old edge to 2 goes, and 2 with it
    assert gas.w.shape == (3, 1) and not any(abs(w - 10) < 1e-9 for w in gas.w.ravel())
    assert all(a <= 2 for a in gas.edges.values())


def test_means_finds_the_cheapest():
    c = cluster.means(blobs(1), 2, 4, 0)
    assert sorted(np.round(c[:, 0]).tolist()) == [0, 5]
    assert len(cluster.means(np.zeros((5, 2)), 6, 4, 0)) == 1


def test_simplified_ring(spark):
    ring = [(math.cos(t / 50 * math.pi), math.sin(t / 50 * math.pi)) for t in range(100)]
    ring.append(ring[0])
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "k int, ring array<struct<x: double, y: double>>")
    few = [(p.x, p.y) for p in df.select(polygons.simplified("ring", 0.05).alias("r")).first().r]
    assert few[0] == few[-1] == ring[0] and 4 < len(few) < 30 and set(few) <= set(ring)
    for x, y in ring:
        gaps = []
        for (ax, ay), (bx, by) in zip(few, few[1:], strict=False):
            t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            gaps.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        assert min(gaps) <= 0.05 + 1e-9
    assert len(df.select(polygons.simplified("ring", 1e-6, 10).alias("r")).first().r) < 10


def test_holes_are_outside(spark):
    rings = [[(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]
    shape = [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    e = polygons.edges_of(spark.createDataFrame([(7, shape)], "poly int, rings array<array<struct<x: double, y: double>>>"))
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 5.0, 2.0), (4, 3.5, 2.5)], "pid int, x double, y double")
    assert sorted(r.pid for r in polygons.inside(p, e).collect()) == [1, 4]
    s = polygons.shoelace(e).first()
    assert (s.area, s.x, s.y) == (12.0, 2.0, 2.0)
    near = {r.pid: r.distance for r in polygons.within_reach(p, e, 1.5).collect()}
    assert near == {1: 0.0, 2: 1.0, 3: 1.0, 4: 0.0}


def test_area_of_a_band_of_the_globe(spark):
    """A closed form: the whole globe's area is 510.0656 million km2."""
    rows = [(1, -180.0, -90.0, 180.0, -90.0), (1, 180.0, -90.0, 180.0, 90.0), (1, 180.0, 90.0, -180.0, 90.0), (1, -180.0, 90.0, -180.0, -90.0)]
    e = spark.createDataFrame(rows, "poly int, ax double, ay double, bx double, by double")
    assert polygons.geodesic_area(e).first().km2 == pytest.approx(510065621.724, rel=1e-9)


def test_box_in_degrees_holds_the_corners(spark):
    rows = [(1, 500000.0, 700000.0, 501000.0, 700000.0), (1, 501000.0, 700000.0, 500500.0, 702000.0), (1, 500500.0, 702000.0, 500000.0, 700000.0)]
    box = polygons.bounds_degrees(spark.createDataFrame(rows, "poly int, ax double, ay double, bx double, by double"), 300.0).first()
    corners = spark.createDataFrame([(x, y) for x in (499700.0, 501300.0) for y in (699700.0, 702300.0)], "x double, y double")
    for lon, lat in corners.select(*geodesy.unproject(F.col("x"), F.col("y"))).collect():
        assert box.west - 1e-9 <= lon <= box.east + 1e-9 and box.south - 1e-9 <= lat <= box.north + 1e-9


def test_nearest_cells_through_a_projection(spark):
    px = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.col("id").alias("v"))
    same = polygons.nearest_cells(px, "v", 20, 20, 10.0, 600000.0, 750000.0, 10.0, geodesy.ITM, geodesy.ITM).collect()
    assert all(x.v == x.r * 20 + x.c for x in same)
    other = geodesy.Grid(-8.0, 53.5, 0.99982, 600000.0, 750000.0, f=1 / 298.257223563)  # a hair's breadth off
    moved = polygons.nearest_cells(px, "v", 20, 20, 10.0, 600000.0, 750000.0, 10.0, other, geodesy.ITM).collect()
    assert sum(x.v != x.r * 20 + x.c for x in moved) <= 40


def test_covering_by_brute_force(spark):
    """The greedy choice of frames, written out."""
    r = random.Random(3)
    frames = [(s, k, f"2024-06-{10 + d:02d}", d - 3, round(r.random(), 3), sorted(r.sample(range(12), r.randrange(0, 9)))) for s in range(8) for k, d in enumerate(r.choices(range(7), k=14))]
    df = spark.createDataFrame(frames, "site int, scene long, day string, delta int, clear double, cells array<long>").withColumn("day", F.to_date("day"))
    got = {x.site: (str(x.day), x.scenes, x.cover) for x in scenes.covering(df, spark.range(8).select(F.col("id").cast("int").alias("site"), F.lit(12).alias("n")), ["site"]).collect()}
    for s in range(8):
        want = None
        for gap in sorted({abs(f[3]) for f in frames if f[0] == s}):
            best = None
            for day in sorted({f[2] for f in frames if f[0] == s and abs(f[3]) == gap}):
                seen, kept = set(), []
                for f in sorted((f for f in frames if f[0] == s and f[2] == day), key=lambda f: (-f[4], -len(f[5]), f[1])):
                    if set(f[5]) - seen and len(seen) < 0.95 * 12:
                        seen |= set(f[5])
                        kept.append(f[1])
                if kept:
                    score = (len(seen) >= 0.95 * 12, len(seen), -len(kept))
                    if best is None or score > best[0]:
                        best = (score, day, kept, len(seen) / 12)
            if best and best[3] >= 0.9:
                want = best[1:]
                break
        assert got.get(s) == want


def test_intervals_over_defined_replicates(spark):
    rows = [(0, i, "a", 40.0, i % 2 == 0, int(i % 4 < 2)) for i in range(20)] + [(0, 100 + i, "b", 6.0, True, 0) for i in range(6)]
    rows += [(1, i, "a", 40.0, False, 0) for i in range(5)] + [(2, 0, "a", 9.0, True, 1)]
    df = spark.createDataFrame(rows, "g int, point_id int, stratum string, population double, truth boolean, predicted int")
    got = {(r.g, r.metric): r for r in resampling.intervals(df, ["g"], replicates=400).collect()}
    assert got[0, "precision"].status == "complete" and 0.1 < got[0, "precision"].lower < 0.5 < got[0, "precision"].upper < 0.9
    assert got[0, "positive_pixels"].lower >= 6 and got[0, "recall"].defined == 400
    assert got[1, "precision"].defined == 0 and got[1, "precision"].lower is None and got[1, "accuracy"].lower == 1.0
    assert got[2, "recall"].status == "unavailable"


def test_mixed_versions_are_an_error(spark):
    one = spark.createDataFrame([("a", "v4"), ("b", "v5")], "point_id string, version string")
    assert review.one_version(one.filter("version = 'v4'")).count() == 1
    with pytest.raises(PySparkException, match="mixed detector versions"):
        review.one_version(one).collect()


@pytest.mark.parametrize("name", ["r13_regrid", "r14_coarse_label"])
def test_regrid_of_a_raster_longer_than_the_grid(spark, tmp_path, name):
    """The query has the cells of its SQL's grid; the operator without a frame has all that the pixels meet."""
    import duckdb

    from rasterloom.plans import catalogue

    spark.range(133_000, 134_000).selectExpr("id as event_id", "case when id % 5 > 0 then cast(id % 97 as double) end as value").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        want = db.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    px = spark.range(133_000, 134_000).selectExpr("cast(id div 100 as int) as r", "cast(id % 100 as int) as c", "1 as m")
    assert raster.regrid(px, [], "m", 3.0, 10.0).agg(F.sum(F.col("mean") * F.col("coverage")) * 100).first()[0] == pytest.approx(9000)


def test_edge_distance_by_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.random((14, 17)) < 0.9
    df = spark.createDataFrame([(r, c, bool(m[r, c])) for r in range(14) for c in range(17)], "r int, c int, m boolean")
    holes = np.argwhere(~m)
    for x in raster.edge_distance(df, [], "m").filter("m").collect():
        assert x.distance == pytest.approx(np.sqrt(((holes - (x.r, x.c)) ** 2).sum(1).min()))


def test_edge_distance_of_awkward_grids(spark):
    """Keys, gaps, cells without a mask or a place, rows and columns without a hole, a grid without any: brute force over what is there."""
    rng = np.random.default_rng(3)
    cells = [(k, int(r), int(c), None if rng.random() < 0.05 else bool(rng.random() < (0.97, 1.1)[k // 4])) for k in range(5) for r in range(0, 40) for c in range(9) if rng.random() < 0.8]
    cells += [(0, None, 3, False), (0, None, 4, True), (0, 3, None, False), (1, 5, None, True)]
    df = spark.createDataFrame(cells, "k int, r int, c int, m boolean")
    got = raster.edge_distance(df, ["k"], "m").collect()
    assert sorted(str((x.k, x.r, x.c, x.m)) for x in got) == sorted(str(x) for x in cells)
    for x in got:
        holes = [math.dist((r, c), (x.r, x.c)) for k, r, c, m in cells if k == x.k and m is False and None not in (r, c, x.r, x.c)]
        assert x.distance == (pytest.approx(min(holes)) if x.m and holes else None)


def test_edge_distance_of_a_long_column(spark):
    """One hole above 60,000 rows: pairs of rows would be 3.6 thousand million, and a squared gap beyond an int."""
    df = spark.range(120_000).selectExpr("cast(id div 2 as int) as r", "cast(id % 2 as int) as c", "id > 0 as m")
    far = raster.edge_distance(df, [], "m").orderBy("r", "c").select("distance").collect()
    assert far[0].distance is None
    assert all(x.distance == pytest.approx(math.hypot(i // 2, i % 2)) for i, x in enumerate(far) if i)


def test_baseline_without_a_dot(spark):
    df = spark.createDataFrame([("4", 1500.0), ("03.01", 1500.0)], "b string, dn double")
    none = F.lit(None).cast("double")
    got = df.select(indices.harmonised(F.col("dn"), F.col("b"), none, none, F.lit(False)).alias("v")).collect()
    assert [r.v for r in got] == [500.0, 1500.0]
