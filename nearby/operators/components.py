"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearby.plans.session import release

#: Edges of a node that count as many. The nodes that have as many, or a ``SHARE``-th of all edges, are
#: at most 2 * ``SHARE`` and may be broadcast.
MANY, SHARE = 1_000, 50_000


def with_low(edges: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """``edges`` with the ``low`` of their ``n``; ``low`` has (n, low, deg).

    Edges of a node with more than ``most`` of them never meet in one task: the few such nodes are broadcast.
    """
    low = low.select(F.col("n").alias("_n"), "low", "deg")
    hubs = low.where(F.col("deg") > most).drop("deg")
    at_hubs = edges.join(F.broadcast(hubs), F.col("n") == F.col("_n"), "left")
    rest = at_hubs.where("_n is null").drop("_n", "low").join(low.where(F.col("deg") <= most).drop("deg"), F.col("n") == F.col("_n"))
    return at_hubs.where("_n is not null").unionByName(rest).drop("_n")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each round hooks every node to the smallest neighbour of its neighbourhood (large star, then
    small star), which halves the longest chain at least, so rounds grow with the logarithm of a
    component's diameter. Each round's table is checkpointed in the shared folder: lineage stays
    short and a lost executor costs one round; files of rounds past are released. Minima are combined before the shuffle, and edges of
    hot nodes get theirs without one. Null ends and self-loops are no edges.
    """
    left, right = F.least("a", "b"), F.greatest("a", "b")
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(right.alias("n"), left.alias("m")).distinct().checkpoint()
    most = max(MANY, links.count() // SHARE)
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("m").alias("n"), F.col("n").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"), F.count("*").alias("deg"))
        large = with_low(both.where("m > n"), low, most).select(F.col("m").alias("n"), F.col("low").alias("m")).distinct()
        down = large.groupBy("n").agg(F.min("m").alias("low"), F.count("*").alias("deg"))
        small = with_low(large, down, most).where("m <> low").select(F.col("m").alias("n"), F.col("low").alias("m"))
        nxt = small.union(down.select("n", F.col("low").alias("m"))).where("n <> m").distinct().checkpoint()
        # A star forest is a fixed point: no hub is itself hooked to another node.
        open_hubs = nxt.select(F.col("m").alias("n")).distinct().join(nxt.select("n").distinct(), "n", "left_semi").limit(1).count()
        double = nxt.groupBy("n").count().where("count > 1").limit(1).count() if not open_hubs else 1
        links = nxt
        del both, low, large, down, small, nxt  # the round's files may go
        release(links.sparkSession)
        if not open_hubs and not double:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("n").alias("node"), F.col("m").alias("component")).union(links.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
