"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written


ROWS_PER_TASK = 50_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; the root is the smallest node of its component.

    Large-star and small-star steps in turn: every node points its larger neighbours, then its
    smaller ones, to the smallest it knows, until nothing changes; few rounds for shallow graphs.
    Links are summed up per node, so a node with very many links costs one row in a final task.
    Rounds are short and many, so their tasks follow the number of links.
    """
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = links.count()
    if not n:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tasks = min(most, 4 + n // ROWS_PER_TASK)

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)

    edges = written(links.select("a", "b").filter("a <> b").distinct().coalesce(tasks))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(smallest(both), "a").coalesce(tasks).filter("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct().coalesce(tasks)
        # Each node's own smaller neighbours meet at the smallest of them.
        least = smallest(large)
        met = large.join(least, "a").coalesce(tasks)
        small = met.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct().coalesce(tasks))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(tasks))
