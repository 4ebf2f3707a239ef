"""Neighbourhood and regrid operators on tall pixel tables with keys, r, c."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dilate_square(px: DataFrame, keys: list[str], mask: str, k: int, out: str = "dilated") -> DataFrame:
    """True within k rows and columns of a true pixel: a running maximum by row, then by column."""
    if k < 0:
        raise ValueError("the width of a dilation is a whole number from 0")
    across = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-k, k)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-k, k)
    m = px.withColumn("_m", F.max(F.col(mask).cast("int")).over(across))
    return m.withColumn(out, F.max("_m").over(down) == 1).drop("_m")


def disk(k: float) -> list[tuple[int, int]]:
    n = int(k)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= k * k]


def diamond(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i) + abs(j) <= k]


def spread(px: DataFrame, keys: list[str], mask: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells reached from true pixels by offsets, with how many reach each."""
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    hit = px.filter(mask).select(*keys, "r", "c", moves.alias("o"))
    return hit.groupBy(*keys, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c")).agg(F.count("*").alias("hits"))


def near(px: DataFrame, keys: list[str], mask: str, offsets: list[tuple[int, int]], out: str = "near") -> DataFrame:
    """Whether a true pixel is within the offsets (symmetric) of each pixel."""
    reached = spread(px, keys, mask, offsets)
    return px.join(reached, [*keys, "r", "c"], "left").withColumn(out, F.col("hits").isNotNull()).drop("hits")


def opened(px: DataFrame, keys: list[str], mask: str, offsets: list[tuple[int, int]], out: str = "opened") -> DataFrame:
    """Erosion, then dilation, by a footprint; outside the grid counts as false."""
    core = spread(px, keys, mask, offsets).filter(F.col("hits") == len(offsets)).select(*keys, "r", "c", F.lit(True).alias("_core"))
    return px.join(spread(core, keys, "_core", offsets), [*keys, "r", "c"], "left").withColumn(out, F.col("hits").isNotNull() & F.col(mask)).drop("hits")


def interior(px: DataFrame, keys: list[str], mask: str, out: str = "interior") -> DataFrame:
    """True pixels whose four edge neighbours are true; missing neighbours count as outside."""
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")

    def side(w, axis: str, step: int) -> Column:
        there = F.lag(axis, 1).over(w) == F.col(axis) - 1 if step < 0 else F.lead(axis, 1).over(w) == F.col(axis) + 1
        value = F.lag(mask, 1).over(w) if step < 0 else F.lead(mask, 1).over(w)
        return F.coalesce(there & value, F.lit(False))

    px = px.withColumn("_row", side(row, "c", -1) & side(row, "c", 1)).withColumn("_col", side(column, "r", -1) & side(column, "r", 1))
    return px.withColumn(out, F.col(mask) & F.col("_row") & F.col("_col")).drop("_row", "_col")


def interior_wide(px: DataFrame, keys: list[str], mask: str, n: float, out: str = "interior") -> DataFrame:
    """True pixels further than n pixels from any that is not, outside the grid included: the whole disk must be true."""
    offsets = disk(n)
    core = spread(px, keys, mask, offsets).filter(F.col("hits") == len(offsets)).select(*keys, "r", "c", F.lit(True).alias("_core"))
    return px.join(core, [*keys, "r", "c"], "left").withColumn(out, F.col("_core").isNotNull()).drop("_core")


def edges_inside(px: DataFrame, keys: list[str], mask: str, out: str = "edge") -> DataFrame:
    """True pixels whose mask differs from the upper or left neighbour's: the one-sided outline."""
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    left = (F.lag("c").over(row) == F.col("c") - 1) & (F.lag(mask).over(row) != F.col(mask))
    above = (F.lag("r").over(column) == F.col("r") - 1) & (F.lag(mask).over(column) != F.col(mask))
    return px.withColumn("_a", left).withColumn("_b", above).withColumn(out, F.col(mask) & (F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)))).drop("_a", "_b")


def edges_eroded(px: DataFrame, keys: list[str], mask: str, out: str = "edge") -> DataFrame:
    """True pixels that erosion by the four edge neighbours takes away."""
    return interior(px, keys, mask, "_in").withColumn(out, F.col(mask) & ~F.col("_in")).drop("_in")


def edges(px: DataFrame, keys: list[str], mask: str, out: str = "edge") -> DataFrame:
    """Pixels whose mask differs from a right or lower neighbour's."""
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    right = (F.lead("c").over(row) == F.col("c") + 1) & (F.lead(mask).over(row) != F.col(mask))
    below = (F.lead("r").over(column) == F.col("r") + 1) & (F.lead(mask).over(column) != F.col(mask))
    return px.withColumn("_a", right).withColumn("_b", below).withColumn(out, F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))).drop("_a", "_b")


def shifted(px: DataFrame, keys: list[str], value: str, dr: int, dc: int) -> DataFrame:
    """A value moved by rows and columns, 0 where nothing moves in."""
    moved = px.select(*keys, (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col(value).alias("moved"))
    return px.join(moved, [*keys, "r", "c"], "left").withColumn("moved", F.coalesce("moved", F.lit(0)))


def shadows(px: DataFrame, keys: list[str], cloud: str, azimuth: float, zenith: float, heights: list[float], dark: Column, pixel: float = 10.0) -> DataFrame:
    """Dark pixels, not cloud, where clouds at some height would cast a shadow."""
    import math

    reach = [h * math.tan(math.radians(zenith)) / pixel for h in heights]
    moves = [(round(d * math.cos(math.radians(azimuth))), round(-d * math.sin(math.radians(azimuth)))) for d in reach]
    hit = spread(px, keys, cloud, sorted(set(moves)))
    return px.join(hit, [*keys, "r", "c"], "left").withColumn("shadow", F.col("hits").isNotNull() & dark & ~F.col(cloud)).drop("hits")


def labelled(px: DataFrame, keys: list[str], mask: str, eight: bool = True) -> DataFrame:
    """Connected patches of true pixels, each named by its smallest cell: runs by row, then joined runs per scene.

    The runs of one scene's mask, a few bytes each, meet in one task of that scene.
    """
    import pandas as pd

    row = Window.partitionBy(*keys, "r").orderBy("c")
    runs = px.filter(mask).withColumn("_g", F.col("c") - F.row_number().over(row)).groupBy(*keys, "r", "_g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    reach = 1 if eight else 0

    def union(runs_: pd.DataFrame) -> pd.DataFrame:
        runs_ = runs_.sort_values(["r", "c0"]).reset_index(drop=True)
        up = list(range(len(runs_)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        r, a, b = (runs_[c].tolist() for c in ("r", "c0", "c1"))
        j = 0
        for i in range(len(r)):
            while j < i and (r[j] < r[i] - 1 or (r[j] == r[i] - 1 and b[j] + reach < a[i])):
                j += 1
            k = j
            while k < i and r[k] == r[i] - 1 and a[k] <= b[i] + reach:
                x, y = root(k), root(i)
                up[max(x, y)] = min(x, y)
                k += 1
        runs_["patch"] = [r[root(i)] * 1_000_000 + a[root(i)] for i in range(len(r))]
        return runs_[[*keys, "r", "c0", "c1", "patch"]]

    kinds = dict(px.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", r {kinds['r']}, c0 {kinds['c']}, c1 {kinds['c']}, patch long"
    found = runs.groupBy(*keys).applyInPandas(union, schema) if keys else runs.groupBy(F.lit(0)).applyInPandas(union, schema.lstrip(", "))
    return found.select(*keys, "patch", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def patch_sizes(patches: DataFrame, keys: list[str]) -> DataFrame:
    return patches.groupBy(*keys, "patch").agg(F.count("*").alias("cells"))


def overlaps(lo: Column, hi: Column, origin: float, size: float) -> Column:
    """Target cells that an interval meets."""
    first = F.floor((lo - origin) / size).cast("int")
    last = F.greatest(first, F.ceil((hi - origin) / size).cast("int") - 1)
    return F.explode(F.sequence(first, last))


def regrid(px: DataFrame, keys: list[str], value: str, size: float, target: float, dr: float = 0.0, dc: float = 0.0, frame: tuple[int, int] | None = None) -> DataFrame:
    """Exact area-weighted mean on a coarser grid, with the share of each cell that is assessed; NULLs are not assessed.

    The grid goes as far as the pixels do, or has the rows and columns of a frame, from 0.
    """
    y0, x0 = F.col("r") * size + dr, F.col("c") * size + dc
    rows = px.withColumn("_y", y0).withColumn("_x", x0).withColumn("R", overlaps(F.col("_y"), F.col("_y") + size, 0.0, target))
    cells = rows.withColumn("C", overlaps(F.col("_x"), F.col("_x") + size, 0.0, target))
    if frame:
        cells = cells.filter(F.col("R").between(0, frame[0] - 1) & F.col("C").between(0, frame[1] - 1))
    wy = F.least(F.col("_y") + size, (F.col("R") + 1) * target) - F.greatest(F.col("_y"), F.col("R") * target)
    wx = F.least(F.col("_x") + size, (F.col("C") + 1) * target) - F.greatest(F.col("_x"), F.col("C") * target)
    w = cells.withColumn("_w", F.when(F.col(value).isNotNull(), wx * wy))
    by = w.groupBy(*keys, "R", "C").agg(F.sum(F.col("_w") * F.col(value).cast("double")).alias("_s"), F.sum("_w").alias("_t"))
    return by.select(*keys, "R", "C", F.try_divide("_s", "_t").alias("mean"), (F.coalesce("_t", F.lit(0.0)) / (target * target)).alias("coverage"))


def coarse_label(mean: Column | str, coverage: Column | str) -> Column:
    mean, coverage = (F.col(x) if isinstance(x, str) else x for x in (mean, coverage))
    return F.coalesce((mean >= 0.5) & (coverage >= 0.95 - 1e-12), F.lit(False))


def bilinear(px: DataFrame, points: DataFrame, value: str) -> DataFrame:
    """Value at points (pid, y, x in cells) from the four pixels around, weights made one over those not NULL.

    The four are added from the last row and column to the first, so that the last bit does not hang on their order.
    """
    base = points.withColumn("_r", F.floor("y")).withColumn("_c", F.floor("x"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    four = base.withColumn("o", corner).withColumn("r", (F.col("_r") + F.col("o.i")).cast("int")).withColumn("c", (F.col("_c") + F.col("o.j")).cast("int"))
    w = (1 - F.abs(F.col("y") - F.col("r"))) * (1 - F.abs(F.col("x") - F.col("c")))
    got = four.withColumn("w", w).join(px.select("r", "c", F.col(value).alias("_v")), ["r", "c"], "left")
    seen = F.when(F.col("_v").isNotNull(), F.col("w"))

    def added(x: Column) -> Column:
        a, b, c, d = (F.coalesce(F.sum(F.when((F.col("o.i") == i) & (F.col("o.j") == j), x)), F.lit(0.0)) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0)))
        return a + b + c + d

    return got.groupBy("pid").agg(F.try_divide(added(seen * F.col("_v")), added(seen)).alias("value"))


def footprint(width: float, dx: float, dy: float) -> list[tuple[int, int]]:
    """Offsets of a disk of this width in metres on a grid of dx by dy: pixel centres no further than half of it."""
    import math

    rows, cols = math.ceil(width / 2 / dy), math.ceil(width / 2 / dx)
    return [(i, j) for i in range(-rows, rows + 1) for j in range(-cols, cols + 1) if (i * dy) ** 2 + (j * dx) ** 2 <= (width / 2) ** 2]


def narrow(px: DataFrame, keys: list[str], mask: str, width: float = 10.0, dx: float = 3.0, dy: float = 3.0) -> DataFrame:
    """keys, pixels, hectares and share of a mask that opening by a disk takes away; the share is NULL without a mask."""
    o = opened(px, keys, mask, footprint(width, dx, dy), "_o")
    gone = F.count_if(F.col(mask) & ~F.col("_o"))
    aggs = [gone.alias("pixels"), (gone * (dx * dy / 10000)).alias("ha"), F.try_divide(gone.cast("double"), F.count_if(mask)).alias("share")]
    return o.groupBy(*keys).agg(*aggs) if keys else o.agg(*aggs)


def first_clear(frames: DataFrame, keys: list[str], covered: str, clear: str, rank: str) -> DataFrame:
    """The clear flag of the first frame that covers each cell."""
    return frames.filter(covered).groupBy(*keys, "r", "c").agg(F.min_by(clear, rank).alias(clear))


def compared(fine: DataFrame, coarse: DataFrame, size: float, target: float) -> DataFrame:
    """One row about a fine mask (r, c, m, assessed) and a coarse one (r, c, m, seen) of the same place.

    The fine mask is aggregated to the coarse grid; cells that both assess are the common support.
    """
    grid = regrid(fine.withColumn("_v", F.when(F.col("assessed"), F.col("m").cast("double"))), [], "_v", size, target)
    cells = grid.select(F.col("R").alias("r"), F.col("C").alias("c"), coarse_label("mean", "coverage").alias("f"), (F.col("coverage") >= 0.95 - 1e-12).alias("_ok"))
    both = coarse.join(cells, ["r", "c"], "left").select("m", F.coalesce("f", F.lit(False)).alias("f"), (F.coalesce("_ok", F.lit(False)) & F.col("seen")).alias("common"))
    a, b, s = F.col("f") & F.col("common"), F.col("m") & F.col("common"), target * target / 10000
    report = both.agg(
        F.count_if("common").alias("support"), (F.count_if(a) * s).alias("fine_common_ha"), (F.count_if(b) * s).alias("coarse_ha"), F.try_divide(F.count_if(a).cast("double"), F.count_if(b)).alias("ratio"),
        F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b)).alias("iou"), F.count_if(a & ~b).alias("only_fine"), F.count_if(b & ~a).alias("only_coarse"), F.count_if(a & b).alias("shared"),
    )
    own = fine.withColumn("m", F.col("m") & F.col("assessed"))
    area = own.agg((F.count_if("m") * (size * size / 10000)).alias("fine_ha"))
    return report.crossJoin(F.broadcast(area)).crossJoin(F.broadcast(narrow(own, [], "m", dx=size, dy=size).select(F.col("ha").alias("narrow_ha"), F.col("share").alias("narrow_share"))))


def envelope(at: list[int], least: list[int]) -> tuple[list[int], list[int]]:
    """The lower envelope over whole q of the parabolas (q - at)^2 + least, `at` rising: its members and the first q of each."""
    kept: list[int] = []
    starts: list[int] = []
    for j, (p, f) in enumerate(zip(at, least, strict=True)):
        start = -(1 << 62)
        while kept:
            i = kept[-1]
            # the first q that is no further from j than from i
            start = -((least[i] + at[i] * at[i] - f - p * p) // (2 * (p - at[i])))
            if start > starts[-1]:
                break
            kept.pop()
            starts.pop()
        kept.append(j)
        starts.append(start if starts else -(1 << 62))
    return kept, starts


def edge_distance(px: DataFrame, keys: list[str], mask: str, out: str = "distance") -> DataFrame:
    """Distance of each true pixel to the nearest that is not, NULL without any: along its row, then down its column by
    the lower envelope of what the rows offer there, so that work grows with the grid alone. Cells that a row lacks
    between the grid's first and last column are filled in meanwhile, as the row's pixels are near to them too.

    One column of one scene meets in one task.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    row = Window.partitionBy(*keys, "r")
    none = F.when(~F.col(mask), F.col("c"))
    left, right = F.max(none).over(row.orderBy("c")), F.min(none).over(row.orderBy(F.desc("c")))
    ends = [F.min("c").alias("_c0"), F.max("c").alias("_c1")]
    here = px.join(px.groupBy(*keys).agg(*ends), keys, "left") if keys else px.crossJoin(F.broadcast(px.agg(*ends)))
    here = here.withColumn("_right", right).withColumn("_left", left)
    here = here.withColumn("_after", F.lead("_right").over(row.orderBy("c"))).withColumn("_stop", F.coalesce(F.lead("c").over(row.orderBy("c")), F.col("_c1") + 1) - 1)
    here = here.withColumn("_start", F.when(F.lag("c").over(row.orderBy("c")).isNull(), F.col("_c0")))
    after = F.when((F.col("_stop") > F.col("c")) & F.coalesce("_left", "_after").isNotNull(), F.sequence(F.col("c") + 1, F.col("_stop")))
    before = F.when((F.col("_start") < F.col("c")) & F.col("_right").isNotNull(), F.sequence(F.col("_start"), F.col("c") - 1))
    none_of = F.array().cast(f"array<{dict(px.dtypes)['c']}>")
    at = here.withColumn("_at", F.explode(F.concat(F.array("c"), F.coalesce(after, none_of), F.coalesce(before, none_of))))
    to_left = F.when(F.col("_at") >= F.col("c"), F.col("_at") - F.col("_left"))
    to_right = F.when(F.col("_at") > F.col("c"), F.col("_after")).otherwise(F.col("_right")) - F.col("_at")
    offers = at.select(*px.columns, "_at", F.col("_at").eqNullSafe(F.col("c")).alias("_own"), F.when(F.col("r").isNotNull(), F.least(to_left, to_right)).cast("long").alias("_g"))

    def down(column: pa.Table) -> pa.Table:
        r, offered = (column[x].combine_chunks() for x in ("r", "_g"))
        at, which = np.unique(r.filter(offered.is_valid()).to_numpy().astype(np.int64), return_inverse=True)
        own = column.filter(column["_own"])
        q, far = pc.fill_null(own["r"], 0).to_numpy().astype(np.int64), np.full(len(own), np.nan)
        if len(at):
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, which, offered.drop_null().to_numpy() ** 2)
            kept, starts = envelope(at.tolist(), least.tolist())
            best = np.array(kept)[np.searchsorted(np.array(starts), q, side="right") - 1]
            far = np.sqrt((q - at[best]) ** 2 + least[best])
        wanted = pc.and_(pc.fill_null(own[mask], False), pc.is_valid(own["r"])).to_numpy()
        return own.drop_columns(["_at", "_own", "_g"]).append_column(out, pa.array(far, mask=np.isnan(far) | ~wanted))

    return offers.groupBy(*keys, "_at").applyInArrow(down, T.StructType([*px.schema, T.StructField(out, T.DoubleType())]))


def most_central(px: DataFrame, keys: list[str], mask: str, avoid: DataFrame, core: int, gap: int, border: int) -> DataFrame:
    """keys, r, c of the pixel furthest from a patch's edge whose square of `core` is whole, `gap` from every avoided
    pixel and `border` from the grid's edge; the first row, then column, of equals."""
    square = [(i, j) for i in range(-core, core + 1) for j in range(-core, core + 1)]
    pure = spread(px, keys, mask, square).filter(F.col("hits") == len(square)).select(*keys, "r", "c")
    size = px.groupBy(*keys).agg(F.max("r").alias("_mr"), F.max("c").alias("_mc")) if keys else px.agg(F.max("r").alias("_mr"), F.max("c").alias("_mc"))
    pure = pure.join(F.broadcast(size), keys) if keys else pure.crossJoin(F.broadcast(size))
    pure = pure.filter((F.col("r") >= border) & (F.col("c") >= border) & (F.col("r") <= F.col("_mr") - border) & (F.col("c") <= F.col("_mc") - border))
    wide = [(i, j) for i in range(-gap, gap + 1) for j in range(-gap, gap + 1)]
    taken = spread(avoid.withColumn("_t", F.lit(True)), keys, "_t", wide).select(*keys, "r", "c")
    free = pure.join(taken, [*keys, "r", "c"], "left_anti")
    far = edge_distance(px.select(*keys, "r", "c", mask), keys, mask, "distance").select(*keys, "r", "c", "distance")
    best = F.max_by(F.struct("r", "c", "distance"), F.struct("distance", -F.col("r"), -F.col("c")))
    got = free.join(far, [*keys, "r", "c"])
    by = got.groupBy(*keys).agg(best.alias("b")) if keys else got.agg(best.alias("b"))
    return by.filter("b is not null").select(*keys, "b.r", "b.c", "b.distance")


def densest(px: DataFrame, mask: str, rows: int, cols: int) -> DataFrame:
    """The window of rows x cols cells with most true pixels, by running sums both ways; ties to the first row, column."""
    a = px.withColumn("_s", F.sum(F.col(mask).cast("int")).over(Window.partitionBy("r").orderBy("c").rangeBetween(0, cols - 1)))
    b = a.withColumn("hits", F.sum("_s").over(Window.partitionBy("c").orderBy("r").rangeBetween(0, rows - 1)))
    top = px.agg(F.max("r").alias("_mr"), F.max("c").alias("_mc"))
    b = b.crossJoin(F.broadcast(top)).filter((F.col("r") + rows - 1 <= F.col("_mr")) & (F.col("c") + cols - 1 <= F.col("_mc")))
    return b.orderBy(F.desc("hits"), "r", "c").limit(1).select("r", "c", "hits")


def inside_polygon(points: DataFrame, edges_: DataFrame) -> DataFrame:
    """Point ids with the polygons they are in: odd crossings, points and edges meeting by rows."""
    from rasterloom.operators.polygons import inside

    return inside(points, edges_)


def mosaic(frames: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """The first covering frame's value of each cell."""
    return frames.filter(F.col(value).isNotNull()).groupBy(*keys, "r", "c").agg(F.min_by(value, rank).alias(value))


def upsampled(px: DataFrame, k: int = 3) -> DataFrame:
    cell = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1)))
    return px.withColumn("_o", cell).withColumn("r", F.col("r") * k + F.floor(F.col("_o") / k).cast("int")).withColumn("c", F.col("c") * k + F.col("_o") % k).drop("_o")


def chip(px: DataFrame, r0: int, c0: int, half: int) -> DataFrame:
    """A square around a pixel, missing pixels as NULL rows."""
    n = 2 * half + 1
    frame = px.sparkSession.range(n * n).select((F.floor(F.col("id") / n).cast("int") + r0 - half).alias("r"), ((F.col("id") % n).cast("int") + c0 - half).alias("c"))
    return F.broadcast(frame).join(px, ["r", "c"], "left")
