"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from understory.session import written


#: Edges in a file of a round; a graph of few edges then takes few tasks, however many partitions a shuffle has.
ROWS = 200_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung to the least node around it; equal edges may come up."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pairs = edges.join(least, "a").select(F.explode(F.array(
        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return pairs.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has an edge ``(a, b)``: the least node of its component.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    Loops, repeated edges and an empty table are fine.
    """
    turned = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    turned = written(turned, "edges")
    current = written(turned.distinct().coalesce(turned.count() // ROWS + 1), "edges")
    state = _state(current)
    while state[0]:
        after = written(small_star(large_star(current)).coalesce(state[0] // ROWS + 1), "edges")
        known, state = state, _state(after)
        current = after
        if known == state:
            break
    # In the end every edge leads from a node to the root of its star.
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
