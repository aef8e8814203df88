"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step moves links towards the smallest node they can see. Minima are aggregated before
they are joined back, so a node with very many links is spread by the join, not gathered.
Links stay in tables; only their number and a checksum reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardfit.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node, component` of every linked node; the component is its smallest node.

    `links`: columns `a, b` of whole numbers; null ends and loops are left out, repeated links
    count once. Without links the result is empty.
    """
    links = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        marks = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(marks) == state:
            break
        state = tuple(marks)
        links = written(_small_star(_large_star(links)))
    roots = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
