"""Connected components as a mapping from node to representative (the smallest node)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node of its component.

    Union-find without a driver: rounds of the large-star and small-star
    operations, each an aggregation and a join on the node, until no link moves.
    The number of rounds grows with the logarithm of a component's diameter.
    Links with a null end and links of a node to itself are left out.
    """
    # Each link is kept as (high, low): child and parent.
    edges = cut(
        links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    previous = None
    while True:
        # Large star: each node sends its larger neighbours to the smallest of its neighbourhood.
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        smallest = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = both.where("other > node").join(smallest, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        # Small star: each node sends its smaller neighbours, and itself, to the smallest of them.
        parents = large.groupBy("high").agg(F.min("low").alias("least"))
        joined = large.join(parents, "high")
        edges = cut(
            joined.select(F.col("low").alias("high"), F.col("least").alias("low"))
            .unionByName(parents.select("high", F.col("least").alias("low")))
            .where("high <> low")
            .distinct()
        )
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("s")).first()
        if state == previous:
            break
        previous = state
    nodes = edges.groupBy("high").agg(F.min("low").alias("root")).select(F.col("high").alias("node"), "root")
    roots = nodes.select(F.col("root").alias("node"), "root").distinct()
    return nodes.unionByName(roots)
