"""Connected components against a union-find."""

import random

from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace
from rasterloom.llm.graph import components


def test_components(spark):
    """A chain, a hub and random links, in shuffled names; repeated links, links both ways and loops change nothing."""
    r = random.Random(5)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(200, 260)]
    names = list(range(300))
    r.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    links += [(b, a) for a, b in links[:50]] + links[20:90]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    rows = components(df, Workspace(spark)).collect()
    assert len(rows) == len({x.node for x in rows})
    assert {x.node: x.component for x in rows} == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_components_of_nothing(spark):
    links = spark.createDataFrame([(1, 1)], "u long, v long").filter(F.col("u") < 1)
    assert components(links, Workspace(spark)).count() == 0
