"""Connected components of a link table, by alternating stars; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root) for every node of a link; root is the smallest node reachable.

    A large star hangs a node's larger neighbours on its smallest one, a small star its
    smaller neighbours. Minima are partial aggregates and settled before they are joined,
    so neither a hub's minimum nor its links are one task's: the join's rows of a hot key
    can be split. The number of rounds is logarithmic in the longest path. All is done when
    a node that has a smaller neighbour has no other: then each hangs on its root.
    """
    edges = settle(links.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    smaller, larger = F.count(F.when(F.col("b") < F.col("a"), 1)), F.count(F.when(F.col("b") > F.col("a"), 1))
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        loose = ((smaller > 1) | (smaller > 0) & (larger > 0)).alias("loose")
        low = settle(both.groupBy("a").agg(F.min("b").alias("m"), loose).selectExpr("a", "least(a, m) as m", "loose"))
        if low.filter("loose").isEmpty():
            return low.selectExpr("a as node", "m as root")
        large = settle(both.join(low, "a").filter("b > a").selectExpr("b as a", "m as b"))
        small_low = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(small_low, "a")
        edges = settle(hung.filter("b <> m").selectExpr("b as a", "m as b").unionByName(small_low.selectExpr("a", "m as b")).distinct())
