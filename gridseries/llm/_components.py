"""Connected components of an edge table, by shortening paths to stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.session import scratch_path


def connected(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached.

    ``edges`` has columns ``a`` and ``b``; nodes without an edge to another node
    do not appear. Each round links the larger neighbours of a node to its least
    neighbour, then the smaller ones; paths halve, so a path of a billion nodes
    takes some thirty rounds. Rounds are written to the shared scratch folder,
    one row for each edge, and joined back by node, where Spark splits a node
    that has very many edges. Nothing but one checksum comes to the driver.
    """
    spark = edges.sparkSession

    def written(frame: DataFrame) -> DataFrame:
        path = scratch_path(spark, "edges")
        frame.write.parquet(path)
        return spark.read.parquet(path)

    def least(links: DataFrame) -> DataFrame:
        # Written, so that the join with it reads nothing but two exchanges, of
        # which Spark can split the rows of one node.
        return written(links.groupBy("u").agg(F.min("v").alias("m")))

    # Edges run from a node u to a smaller or equal node v.
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    down = written(down.filter("u <> v").distinct())
    known = None
    for _ in range(most_rounds):
        # Larger neighbours of each node move to the least node near it.
        both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct())
        # Smaller neighbours of each node, and the node, move to the least of them.
        low = least(large)
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nodes = low.select("u", F.col("m").alias("v"))
        down = written(moved.union(nodes).filter("u <> v").distinct())
        check = down.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(check) == known:
            break
        known = tuple(check)
    else:
        raise RuntimeError("the components did not settle")
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
