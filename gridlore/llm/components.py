"""Connected components of a table of links, by labels that fall to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import clears_steps, materialise


@clears_steps
def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of ``links`` (a, b).

    In every round a node takes the smallest label among its own and its neighbours', then the label of
    that label: the number of rounds grows with the logarithm of the longest chain.  Each round is a
    written table; only the count of changes comes to the driver.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
    both = materialise(both.filter("node <> near").distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("near")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("said")), "near").groupBy("node").agg(F.min("said").alias("said"))
        lower = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "said").alias("now"))
        # hooks: the old label's own node also learns of the lower one, then everyone jumps
        told = lower.filter("now < was").groupBy(F.col("was").alias("node")).agg(F.min("now").alias("told"))
        mid = materialise(lower.join(told, "node", "left").select("node", "was", F.least("now", F.coalesce("told", "now")).alias("now")), "labels")
        up = mid.select(F.col("node").alias("now"), F.col("now").alias("next"))
        after = materialise(mid.join(up, "now", "left").select("node", "was", F.coalesce("next", "now").alias("component")), "labels")
        changed = after.filter("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
