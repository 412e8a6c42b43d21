"""Connected components by repeated contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


EDGES_PER_FILE = 25_000
#: From so many rows on, keys with a thousandth of the rows are looked up by broadcast: a thousand of them at most.
HUB_ROWS = 1_000_000


def looked_up(rows: DataFrame, key: str, names: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows (n of them) joined with names, which has each key once. Rows of a hub, a key that many of them have, stay where
    they are and meet its name by broadcast; only the others are exchanged. The result of so many rows is cut."""
    if n < HUB_ROWS:
        return rows.join(names, key, how)
    hubs = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * 1000 > n).select(key).coalesce(1))
    near = F.broadcast(cut(hubs.join(names, key, how).coalesce(1)))
    return cut(rows.join(near, key).unionByName(rows.join(F.broadcast(hubs), key, "left_anti").join(names, key, how)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the ends of all edges; component: the smallest node that can be reached. Nulls and loops are ignored.

    Each round, every node points to its smallest neighbour (a partial aggregate, so that hubs gather nothing), pointers are
    followed to their roots by doubling, and the edges between different roots go on. Every tree has two nodes at least and
    its root is its smallest, so rounds are few; each is kept as a written table, from which lost executors recover. No join
    sends the rows of a hub to one task.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
    e = cut(e.distinct())
    rounds: list[DataFrame] = []
    n = 0
    while size := e.count():
        n = max(n, size)
        parts = 1 + size // EDGES_PER_FILE  # shrinking graphs are kept in few files
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")).coalesce(parts))
        while True:
            next_hop = point.select(F.col("node").alias("to"), F.col("to").alias("on"))
            jumped = cut(looked_up(point, "to", next_hop, size).select("node", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")).coalesce(parts))
            point = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(point)
        left, right = point.select(F.col("node").alias("a"), F.col("to").alias("ra")), point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        e = looked_up(looked_up(e, "a", left, size), "b", right, size).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        e = cut(e.distinct().coalesce(parts))
    if not rounds:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    labels = rounds[0].withColumnRenamed("to", "component")
    for point in rounds[1:]:
        step = point.select(F.col("node").alias("component"), F.col("to").alias("root"))
        labels = looked_up(labels, "component", step, n, "left").select("node", F.coalesce("root", "component").alias("component"))
    return labels
