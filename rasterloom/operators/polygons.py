"""Polygons as tables of directed edges (poly, ax, ay, bx, by): masks, zones, distances, overlaps, areas.

Every join is an equi-join on a band of rows or a cell of a grid, never a nested loop. A ring's holes are edges of the
same poly: crossings are counted whatever the ring.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from rasterloom.functions.geodesy import ITM, Grid, crosses, project, segment_distance, unproject


def edges_of(polygons: DataFrame, poly: str = "poly", rings: str = "rings") -> DataFrame:
    """Edges of polygons given as arrays of closed rings of x, y."""
    ring = polygons.select(poly, F.posexplode(rings).alias("ring", "r"))
    pairs = F.expr("transform(sequence(1, size(r) - 1), i -> named_struct('seq', i, 'a', element_at(r, i), 'b', element_at(r, i + 1)))")
    e = ring.filter("size(r) > 1").select(F.col(poly).alias("poly"), "ring", F.explode(pairs).alias("e"))
    return e.select("poly", "ring", "e.seq", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def bands(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def inside(points: DataFrame, edges: DataFrame, band: float = 1.0) -> DataFrame:
    """pid, poly of points (pid, x, y) in polygons: odd crossings, points and edges meeting by bands of rows."""
    e = edges.select("poly", "ax", "ay", "bx", "by", bands(F.least("ay", "by"), F.greatest("ay", "by"), band).alias("_band"))
    p = points.select("pid", "x", "y").withColumn("_band", F.floor(F.col("y") / band))
    hit = p.join(e, "_band").filter(crosses(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return hit.groupBy("pid", "poly").agg(F.count("*").alias("_n")).filter("_n % 2 = 1").select("pid", "poly")


def within_reach(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """pid, poly, distance of points no further than `reach` from a polygon, 0 inside; a point may have several.

    Edges enter all cells of a grid of `reach` that their widened box meets, so a point looks into its own cell alone.
    """
    x = bands(F.least("ax", "bx") - reach, F.greatest("ax", "bx") + reach, reach)
    y = bands(F.least("ay", "by") - reach, F.greatest("ay", "by") + reach, reach)
    e = edges.withColumn("_i", x).withColumn("_j", y).select("poly", "ax", "ay", "bx", "by", "_i", "_j")
    p = points.select("pid", "x", "y").withColumn("_i", F.floor(F.col("x") / reach)).withColumn("_j", F.floor(F.col("y") / reach))
    d = segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = p.join(e, ["_i", "_j"]).withColumn("distance", d).filter(F.col("distance") <= reach).select("pid", "poly", "distance")
    return near.union(inside(points, edges, max(1.0, reach)).withColumn("distance", F.lit(0.0))).groupBy("pid", "poly").agg(F.min("distance").alias("distance"))


def footprint_matches(detections: DataFrame, edges: DataFrame, sizes: tuple[float, ...] = (375.0, 1000.0)) -> DataFrame:
    """Detections (pid, x, y, footprint) with every polygon within their own footprint, and the distance."""
    out = None
    for size in sizes:
        hit = within_reach(detections.filter(F.col("footprint") == size), edges, size)
        out = hit if out is None else out.unionByName(hit)
    return out


def near_in_time(events: DataFrame, places: DataFrame, reach: float, years: int) -> DataFrame:
    """Events (pid, x, y, yr) near places (poly, px, py, pyr) by distance and difference of years: cells, then both tests."""
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = places.withColumn("_o", step).select("poly", "px", "py", "pyr", (F.floor(F.col("px") / reach) + F.col("_o.i")).alias("_i"), (F.floor(F.col("py") / reach) + F.col("_o.j")).alias("_j"))
    e = events.withColumn("_i", F.floor(F.col("x") / reach)).withColumn("_j", F.floor(F.col("y") / reach))
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    hit = e.join(p, ["_i", "_j"]).withColumn("distance", d)
    return hit.filter((F.col("distance") <= reach) & (F.abs(F.col("yr") - F.col("pyr")) <= years)).select("pid", "poly", "distance")


def cells(edges: DataFrame, size: float) -> DataFrame:
    """poly, i, j of the cells of a common grid whose centres are in each polygon: per row, between crossings in pairs."""
    e = edges.select("poly", "ax", "ay", "bx", "by", F.explode(F.sequence(F.floor(F.least("ay", "by") / size - 0.5).cast("long"), F.floor(F.greatest("ay", "by") / size + 0.5).cast("long"))).alias("j"))
    y = (F.col("j") + 0.5) * size
    cut = e.filter((F.col("ay") > y) != (F.col("by") > y)).withColumn("x", (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    row = cut.groupBy("poly", "j").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = row.select("poly", "j", F.explode(F.expr("transform(sequence(1, cast(size(xs) / 2 as int)), k -> named_struct('a', element_at(xs, 2 * k - 1), 'b', element_at(xs, 2 * k)))")).alias("s"))
    # a centre is in a pair where it is at its left end or right of it, and left of its right end
    first, last = F.ceil(F.col("s.a") / size - 0.5).cast("long"), F.ceil(F.col("s.b") / size - 0.5).cast("long") - 1
    return spans.filter(first <= last).select("poly", "j", F.explode(F.sequence(first, last)).alias("i"))


def overlap_share(edges: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """poly, cells, share of each polygon's cells that are in any of the others."""
    union = cells(others, size).select("i", "j").distinct().withColumn("_in", F.lit(True))
    return cells(edges, size).join(union, ["i", "j"], "left").groupBy("poly").agg(F.count("*").alias("cells"), (F.count("_in") / F.count("*")).alias("share"))


def without_copies(edges: DataFrame, others: DataFrame, size: float, most: float = 0.5) -> DataFrame:
    """Polygons less than `most` of which is in any of the others."""
    return overlap_share(edges, others, size).filter(F.col("share") < most)


def zonal(px: DataFrame, edges: DataFrame, value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """poly, n and quantiles of the pixels (pid, x, y, value) whose centres are in each polygon."""
    own = px.filter(F.col(value).isNotNull())
    hit = inside(own, edges).join(own.select("pid", value), "pid")
    by = hit.groupBy("poly").agg(F.count("*").alias("n"), F.percentile(value, F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    return by.select("poly", "n", *[F.col("_q")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(quantiles)])


def shoelace(edges: DataFrame) -> DataFrame:
    """poly, area and centroid: signed sums over edges, outer rings one way round and holes the other."""
    w = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    by = edges.groupBy("poly").agg(F.sum(w).alias("_w"), F.sum((F.col("ax") + F.col("bx")) * w).alias("_x"), F.sum((F.col("ay") + F.col("by")) * w).alias("_y"))
    return by.select("poly", (F.abs("_w") / 2).alias("area"), F.try_divide(F.col("_x"), 3 * F.col("_w")).alias("x"), F.try_divide(F.col("_y"), 3 * F.col("_w")).alias("y"))


def vertex_mean(edges: DataFrame) -> DataFrame:
    """poly, x, y: the mean of the vertices of the ring that has most, its closing vertex counted as in a closed list."""
    closing = F.max(F.struct("seq", "bx", "by"))
    rings = edges.groupBy("poly", "ring").agg(F.count("*").alias("n"), F.sum("ax").alias("sx"), F.sum("ay").alias("sy"), closing.alias("z"))
    best = rings.withColumn("_k", F.row_number().over(Window.partitionBy("poly").orderBy(F.desc("n"), "ring"))).filter("_k = 1")
    return best.select("poly", ((F.col("sx") + F.col("z.bx")) / (F.col("n") + 1)).alias("x"), ((F.col("sy") + F.col("z.by")) / (F.col("n") + 1)).alias("y"))


def bounds(edges: DataFrame, buffer: float = 0.0) -> DataFrame:
    """poly, x0, y0, x1, y1 of the widened box."""
    return edges.groupBy("poly").agg((F.min("ax") - buffer).alias("x0"), (F.min("ay") - buffer).alias("y0"), (F.max("ax") + buffer).alias("x1"), (F.max("ay") + buffer).alias("y1"))


def bounds_degrees(edges: DataFrame, buffer: float = 300.0, grid: Grid = ITM) -> DataFrame:
    """poly and the box in degrees that holds the four corners of the box in metres."""
    b = bounds(edges, buffer)
    corners = [unproject(F.col(x), F.col(y), grid) for x in ("x0", "x1") for y in ("y0", "y1")]
    lon, lat = [c[0] for c in corners], [c[1] for c in corners]
    return b.select("poly", F.least(*lon).alias("west"), F.least(*lat).alias("south"), F.greatest(*lon).alias("east"), F.greatest(*lat).alias("north"))


# Semi-major axis and flattening of WGS 84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def authalic(lat: Column) -> Column:
    """Sine of the authalic latitude: what an equal-area cylinder has for its height."""
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    q = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
    return q(F.sin(F.radians(lat))) / q(F.lit(1.0))


def geodesic_area(edges: DataFrame, pieces: int = 16) -> DataFrame:
    """poly, km2: area on the ellipsoid, edges in degrees taken in short pieces; holes run the other way round."""
    k = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    e = edges.withColumn("_k", k)
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / pieces)
    height = lambda i: authalic(at("ay", "by", i))
    strip = (at("ax", "bx", F.col("_k") + 1) - at("ax", "bx", F.col("_k"))) * (height(F.col("_k")) + height(F.col("_k") + 1)) / 2
    n = math.sqrt(WGS84_F * (2 - WGS84_F))
    radius2 = WGS84_A**2 / 2 * (1 + (1 - n * n) / n * math.atanh(n))
    return e.groupBy("poly").agg((F.abs(F.sum(strip)) * math.radians(1) * radius2 / 1e6).alias("km2"))


RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def kept_vertices(ring: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Vertices that stay: none that goes is further than the tolerance from the line between those that do."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        dx, dy = bx - ax, by - ay
        long, far, at = math.hypot(dx, dy), -1.0, -1
        for i in range(a + 1, b):
            x, y = ring[i][0] - ax, ring[i][1] - ay
            d = abs(x * dy - y * dx) / long if long else math.hypot(x, y)
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def simplified(ring: str, tolerance: float, most: int | None = None) -> Column:
    """A closed ring with fewer vertices; with `most`, the tolerance grows by 1.4 until fewer than that are left."""

    @F.pandas_udf(RING)
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for r in rings:
            if r is None or len(r) < 4:
                out.append(r)
                continue
            points, t = [(p["x"], p["y"]) for p in r], tolerance
            half = max(range(len(points)), key=lambda i: math.dist(points[i], points[0]))  # a closed ring has no ends
            while True:
                kept = kept_vertices(points[: half + 1], t) + [half + i for i in kept_vertices(points[half:], t)[1:]]
                if most is None or len(kept) < most:
                    break
                t *= 1.4
            out.append([{"x": points[i][0], "y": points[i][1]} for i in kept])
        return pd.Series(out)

    return run(F.col(ring))


def nearest_cells(px: DataFrame, value: str, rows: int, cols: int, size: float, left: float, top: float, target: float, to: Grid, fro: Grid) -> DataFrame:
    """r, c, value on a target grid: each cell takes the source pixel that its centre falls in after projection, NULL outside."""
    frame = px.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    x, y = left + (F.col("c") + 0.5) * target, top - (F.col("r") + 0.5) * target
    sx, sy = (x, y) if to == fro else project(*unproject(x, y, to), fro)
    at = frame.withColumn("_c", F.floor((sx - left) / size).cast("int")).withColumn("_r", F.floor((top - sy) / size).cast("int"))
    return at.join(px.select(F.col("r").alias("_r"), F.col("c").alias("_c"), value), ["_r", "_c"], "left").select("r", "c", value)
