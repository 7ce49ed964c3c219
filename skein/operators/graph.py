"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.scratch import write_table


def components(links: DataFrame, tag: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b) that isn't the smallest of its component.

    Each round points every node at the smallest one it can see (large star, then small
    star) and writes the edges as a table; after about log(size) rounds every component is
    a star around its smallest node. A node of very many links is only joined on, never
    collected. A round's table is deleted once the next is written. No links: no rows.
    """
    edges = write_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    state = None
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_table(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), tag, instead_of=edges)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
