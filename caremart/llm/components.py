"""Connected components of an edge table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of the edges (a, b).

    Each round takes the smallest label among a node's own, its neighbours' and its label's
    own label, so chains shorten by doubling; labels only fall, and the rounds end when their
    sum stays.  Every round is a stored table.  Nothing but that sum reaches the driver.
    Loops, repeated and null-ended edges are fine; no edges give no rows.
    """
    plain = cut(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
                .filter("low < high").distinct(), "edges")
    # hang every node and its other smaller neighbours on its smallest one: the components stay, and
    # the many edges that different stars give the same few nodes become one
    lowest = plain.groupBy("high").agg(F.min("low").alias("m"))
    stars = lowest.select(F.col("m").alias("a"), F.col("high").alias("b")).union(
        plain.join(lowest, "high").filter("low > m").select("m", "low")).distinct()
    plain = cut(stars, "stars")
    both = cut(plain.union(plain.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("component")), "labels")

    def weight() -> int:
        return labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]

    total = weight()
    while total is not None:
        over = labels.select(F.col("node").alias("over"), F.col("component").alias("higher"))
        jumped = cut(labels.join(over, F.col("component") == F.col("over")).select("node", F.col("higher").alias("component")),
                     "jumped")
        near = (both.join(jumped, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near")))
        labels = cut(jumped.join(near, F.col("node") == F.col("a"))
                     .select("node", F.least("component", "near").alias("component")), "labels")
        before, total = total, weight()
        if total == before:
            break
    return labels
