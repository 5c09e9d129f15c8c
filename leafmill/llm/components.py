"""Connected components of a link table, without gathering a component anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that links reach, for every node that has a link.

    Alternates two steps until nothing changes: every node hands its larger neighbours
    its smallest neighbour (large star), then its smaller ones (small star). Each step is
    one aggregate that combines before the shuffle and one join on the node, whose skewed
    partitions Spark can split, so a hub of any degree is fine. Every round ends with a
    checkpoint. Null ends and self links count for nothing; an empty table gives none.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large star: both directions; each node passes its minimum (itself included) to its larger neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node passes its minimum to itself and its smaller neighbours
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # stable when every node has one link and no root is itself below another
        state = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
