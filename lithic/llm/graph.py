"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lithic.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Every node of a link with its component, the smallest node reachable: node, component.

    A round, one job, takes the least label of a node and all its neighbours, then the label of that label, so rounds grow with
    the logarithm of the longest path. Minima are pre-aggregated and labels are joined by node, so a node with very many
    links is spread by AQE. Labels only fall, so they are final once the sum of their hashes stays.
    """
    a, b = F.col("a"), F.col("b")
    both = links.select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")), F.struct(a.alias("a"), a.alias("b")), F.struct(b.alias("a"), b.alias("b")))).alias("x"))
    both = stored(both.select("x.a", "x.b").distinct(), "links")
    labels, last = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"))
        further = near.select(F.col("node").alias("component"), F.col("component").alias("further"))
        watch = Observation()
        jumped = near.join(further, "component").select("node", F.least("component", "further").alias("component"))
        before, labels = labels, stored(jumped.observe(watch, F.sum(F.xxhash64("component").cast("decimal(38,0)")).alias("sum")), "labels")
        if last is not None:
            discard(before)
        if watch.get["sum"] == last:
            discard(both)
            return labels
        last = watch.get["sum"]
