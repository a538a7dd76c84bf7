"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import pin


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b).

    Each round every node hooks to the neighbour (or itself) of least priority, a hash that
    changes by round, and the links are contracted along the hooks; the number of links
    falls by a constant share a round whatever the graph's shape. All steps are equi-joins
    and minima, so a hub with very many links is combined before the shuffle. Rounds are cut
    by tables in the shared folder; only their emptiness is seen by the driver."""
    links = pin(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    labels = pin(labels, "labels")
    turn = 0
    while not links.isEmpty():
        turn += 1
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        hooks = pin(least.select(F.col("a").alias("u"), F.least(rank("a"), F.col("least"))["v"].alias("hook")), "hooks")
        labels = pin(
            labels.join(hooks, F.col("root") == F.col("u"), "left").select("node", F.coalesce("hook", "root").alias("root")), "labels")
        left = links.join(hooks.withColumnsRenamed({"u": "ua", "hook": "ha"}), F.col("a") == F.col("ua"))
        left = left.join(hooks.withColumnsRenamed({"u": "ub", "hook": "hb"}), F.col("b") == F.col("ub"))
        left = left.where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
        links = pin(left.distinct(), "links")
    return labels
