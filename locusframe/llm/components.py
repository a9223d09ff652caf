"""Connected components of an edge table, by min-label propagation with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): component is the smallest id reachable. edges: (a, b), both of one ordered type; directions and repeats are free.

    A round gives every vertex the smallest label among its neighbours' labels (a partial aggregate, so a vertex with very
    many edges costs one row a task), then follows labels once more. Rounds grow with the logarithm of the longest path.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("l")), "labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("l").alias("m"))
        nxt = label.join(near, label["id"] == near["a"]).select("id", F.least("l", "m").alias("m"), F.col("l").alias("was"))
        hop = label.select(F.col("id").alias("hop_id"), F.col("l").alias("hop"))
        step = nxt.join(hop, nxt["m"] == hop["hop_id"], "left").select("id", F.least("m", F.coalesce("hop", "m")).alias("l"), "was")
        step = written(step, "labels")
        if step.where("l <> was").limit(1).count() == 0:
            return step.select("id", F.col("l").alias("component"))
        label = step.select("id", "l")
