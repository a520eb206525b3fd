"""Connected components by label propagation with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import stash, unstash


def components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the edges, read as undirected; both ends are longs.

    A round takes the smallest label of the neighbours and then the label of that label, so labels double their reach. Each
    round is a written table; nodes without edges are not in the result. Nothing is collected but a count of changes.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    pairs = stash(spark, both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stash(spark, pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "cc-labels")
    for _ in range(most_rounds):
        near = pairs.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a")).agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("far"))
        moved = stash(spark, step.join(jump, F.col("mid") == F.col("at")).select("node", "old", F.least("mid", "far").alias("comp")), "cc-labels")
        changed = moved.where("old <> comp").limit(1).count()
        unstash(spark, labels)
        labels = moved.select("node", "comp")
        labels._stash_path = moved._stash_path
        if not changed:
            unstash(spark, pairs)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
