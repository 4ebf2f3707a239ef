"""Best-fit packing (8): variable-capacity best-fit over several permitted sequence lengths.

Only sizes matter to a packing, so the plan is made over the histogram of sizes, whose length is bounded by the
largest permitted capacity whatever the corpus: bins of equal contents are one group with a multiplicity. Sizes go
from large to small; pieces of a size go to the open bins with the least room that fits, and what is left opens bins
of the capacity with the least cost for each unit filled, judged over all sizes that are still to come; at the end each
bin is downsized to the smallest capacity that holds its contents. Pieces are then dealt to the plan by their rank within their size. Ranks come from counts
by size and salt and a row number within each, so no task gets all pieces of one size.

A document larger than the largest capacity is cut into pieces of that capacity and a rest. Null, zero or negative
sizes take no bin: their rows come back with null bin and capacity. Repeated rows are packed one by one. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
#: Cost of a bin besides its capacity: the share of a step that does not depend on its length.
OPENING = 64
#: Dealings (48 bytes each) that are broadcast at most.
MOST_DEALS = 1_000_000


def opening(size: int, left: int, below: list[int], histogram: dict[int, int], capacities: tuple[int, ...], fixed: int) -> int:
    """The capacity of the bins to open for `left` pieces of a size, over the mix of sizes that is still to come.

    For each capacity a bin is filled as best fit will fill it: copies of the size, then the largest of the sizes below
    (ascending) that fits, each shared between the bins that would be opened. The least cost for each unit filled wins,
    the bin downsized to what it then holds.
    """
    best = None
    for c in capacities:
        if c < size:
            continue
        copies = min(left, c // size)
        bins, filled = -(-left // copies), copies * size
        at = bisect.bisect_right(below, c - filled)
        while at:
            s = below[at - 1]
            more = min(histogram[s] // bins, (c - filled) // s)
            filled += more * s
            at = min(at - 1, bisect.bisect_right(below, c - filled))
        cost = (next(x for x in capacities if x >= filled) + fixed) / filled
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, fixed: int = OPENING) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, last rank, first bin, offset in the bin, capacity) of every dealing, bins numbered from 0.

    A group is [room, multiplicity, contents]; contents are (size, first rank, offset). Splitting a group shares its
    contents between the parts, with the ranks moved on.
    """
    capacities = tuple(sorted(capacities))
    room: list[int] = []  # rooms of open groups, ascending
    groups: dict[int, list[list]] = {}
    done: list[list] = []

    def put(r: int, n: int, contents: list) -> None:
        if r == 0:
            done.append([r, n, contents])
            return
        if r not in groups:
            bisect.insort(room, r)
            groups[r] = []
        groups[r].append([r, n, contents])

    below = sorted(histogram)
    for size in sorted(histogram, reverse=True):
        below.pop()  # sizes that are still to come
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(room, size)
            if at == len(room):
                c = opening(size, left, below, histogram, capacities, fixed)
                k = c // size
                full, rest = divmod(left, k)
                for many, copies in ((full, k), (1 if rest else 0, rest)):
                    if many:
                        put(c - copies * size, many, [(size, rank + j * many, j * size) for j in range(copies)])
                        rank += many * copies
                left = 0
                break
            r = room[at]
            g = groups[r].pop()
            if not groups[r]:
                del groups[r]
                room.pop(at)
            m = min(left, g[1])
            if g[1] > m:  # the bins that get nothing now
                put(r, g[1] - m, [(s, a + m, o) for s, a, o in g[2]])
            used = max((o + s for s, _, o in g[2]), default=0)
            put(r - size, m, [*g[2], (size, rank, used)])
            rank, left = rank + m, left - m
    out, first = [], 0
    for g in [*done, *(g for r in room for g in groups[r])]:
        filled = max(o + s for s, _, o in g[2])
        c = next(c for c in capacities if c >= filled)
        out += [(s, a, a + g[1] - 1, first, o, c) for s, a, o in g[2]]
        first += g[1]
    return out


def pieces(docs: DataFrame, size: str, largest: int) -> DataFrame:
    """doc_id, piece, piece_start, piece_size: documents cut to the largest capacity."""
    n = F.greatest(F.lit(1), F.ceil(F.col("_n") / largest)).cast("int")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(size).cast("long").alias("_n"))
        .select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)).alias("piece"))
        .select("doc_id", "piece", (F.col("piece") * F.lit(largest).cast("long")).alias("piece_start"), F.when(F.col("_n").isNotNull(), F.least(F.lit(largest).cast("long"), F.col("_n") - F.col("piece") * F.lit(largest).cast("long"))).alias("piece_size"))
    )


def pack(docs: DataFrame, size: str, capacities: tuple[int, ...] = CAPACITIES, fixed: int = OPENING, per_salt: int = 50_000) -> DataFrame:
    """doc_id, piece, piece_start, piece_size, bin_id, bin_offset, capacity: one row for each piece."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    capacities = tuple(sorted(capacities))
    cut = ws.save(pieces(docs, size, capacities[-1]), "pieces")
    salts = max(64, -(-cut.count() // per_salt))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = ws.save(salted.filter("piece_size > 0").groupBy("piece_size", "salt").agg(F.count("*").alias("n")), "counts")
    total = counts.groupBy("piece_size").agg(F.sum("n").alias("n")).toArrow()  # at most the largest capacity in rows
    dealt = plan(dict(zip(total.column(0).to_pylist(), total.column(1).to_pylist(), strict=True)), capacities, fixed)
    names = ["piece_size", "r0", "r1", "bin0", "bin_offset", "capacity"]
    table = pa.table({k: pa.array([d[i] for d in dealt], pa.int64()) for i, k in enumerate(names)})
    # For each size: where each dealing begins, so that a rank finds its own by position.
    deals = (
        spark.createDataFrame(table)
        .groupBy("piece_size")
        .agg(F.sort_array(F.collect_list(F.struct("r0", "r1", "bin0", "bin_offset", "capacity"))).alias("deals"))
    )
    before = Window.partitionBy("piece_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("piece_size", "salt", "before")
    # one row for each size at most, with some ten dealings each whatever the corpus: their number is checked all the same
    offsets = offsets.join(F.broadcast(deals) if len(dealt) <= MOST_DEALS else deals, "piece_size")
    # Dealings that meet this salt's ranks: few of them, found before the join with the pieces.
    last = F.lead("before").over(Window.partitionBy("piece_size").orderBy("salt"))
    offsets = offsets.withColumn("after", F.coalesce(last, F.lit(1 << 62))).withColumn("deals", F.expr("filter(deals, d -> d.r1 >= before and d.r0 < after)")).drop("after")
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("piece_size", "salt").orderBy("doc_id", "piece")) - 1)
    found = F.expr("filter(deals, d -> before + k between d.r0 and d.r1)[0]")
    rank = F.col("before") + F.col("k")
    return (
        ranked.join(offsets, ["piece_size", "salt"], "left")
        .withColumn("d", F.when(F.col("deals").isNotNull(), found))
        .select("doc_id", "piece", "piece_start", "piece_size", (F.col("d.bin0") + rank - F.col("d.r0")).alias("bin_id"), F.col("d.bin_offset").alias("bin_offset"), F.col("d.capacity").alias("capacity"))
    )
