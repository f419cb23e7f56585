"""Connected components of a table of links, by alternating stars.

Links between a node's neighbours are replaced by links to the least of them
until nothing changes. Every round is two aggregations and two joins; a node
with very many links is one row of its aggregate, and Spark splits its side of
the join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.tables import drop, new_path, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every neighbour larger (large star) or not larger than the node gets a link to the least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b): root is the least node that it reaches, itself included.

    Nodes without links are not listed; loops and repeated links do no harm; an
    empty table gives no rows.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), path)
    before, state = None, _state(now)
    while state != before and state[0]:
        next_path = new_path(spark, "links")
        now = written(_star(_star(now, True), False), next_path)
        drop(spark, path)
        path, before, state = next_path, state, _state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
