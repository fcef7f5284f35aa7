"""Connected components by contraction: nodes follow the neighbour of least hash, hashes are drawn anew in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.tables import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node of the component. Stored.

    In round r a node points to that of itself and its neighbours with the least hash of (r, node), and follows
    pointers twice more; both ends of every edge are replaced. A node is left only if it is pointed to. On a path, in
    whatever order its nodes are numbered, that holds for a third of the nodes and few more, so a path of n nodes
    takes about log3(n) rounds; denser graphs take fewer. Pointers go down in the hash, so they never form a
    cycle. Both sides of every join are stored tables, so that adaptive execution may split a hub; tables of earlier
    rounds are removed. Loops and repeated edges are ignored; no edges give no rows.
    """
    return _components(edges)[0]


def _components(edges: DataFrame) -> tuple[DataFrame, int]:
    """The components, and in how many rounds."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots, rounds = None, 0
    while not edges.isEmpty():
        rounds += 1
        rank = lambda c, r=rounds: F.struct(F.xxhash64(F.lit(r), c).alias("hash"), F.col(c).alias("id"))
        both = edges.union(edges.select("b", "a"))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m")).select("node", F.least(rank("node"), "m")["id"].alias("up")), "pointers")
        for _ in range(2):
            over = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            last, step = step, stored(step.join(over, "up").select("node", F.col("top").alias("up")), "pointers")
            discard(last)
        if roots is None:
            roots = stored(step.withColumnRenamed("up", "root"), "roots")
        else:
            moved = step.select(F.col("node").alias("root"), "up")
            last, roots = roots, stored(roots.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
            discard(last)
        low = step.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        high = step.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        half = stored(edges.join(low, "a").select("b", "a_up"), "edges")
        moved = half.join(high, "b").where("a_up <> b_up")
        last, edges = edges, stored(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        discard(last, half, step)
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")), rounds
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    found = stored(roots.join(least, "root").select("node", F.col("least").alias("root")), "components")
    discard(edges, roots)
    return found, rounds
