"""Classes of a graph: stars around representatives, and connected components.

Labels and edges stay distributed; only a count comes back to the driver per round. Lineage is
cut with checkpoint() in the folder the session names in spark.checkpoint.dir, so a lost executor
costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactweave.session import ensure_checkpoint_dir

__all__ = ["connected", "ensure_checkpoint_dir", "stars"]


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of every node that has an edge: each node of a star is a neighbour of its root.

    `nodes`: (id, weight), ids strings; `edges`: (a, b) in either direction. The heaviest node of its
    neighbourhood (ties: the greater id) becomes a root, its neighbours join the heaviest root beside them, and so
    on among the nodes that are left; one left alone is its own root. So classes never chain: whatever
    is linked lies within one edge of the representative. Every round assigns all local maxima at once.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # what the edges are made of is planned once
    both = edges.filter("a <> b").select(turned.alias("e")).select("e.*").distinct()
    rank = lambda x: nodes.select(F.col("id").alias(x), F.struct("weight", "id").alias(f"p{x}"))
    left = both.join(rank("a"), "a").join(rank("b"), "b").checkpoint()
    everyone = left.select(F.col("a").alias("id")).distinct()
    done = None
    while True:
        roots = left.groupBy("a").agg(F.max("pb").alias("top"), F.max("pa").alias("pa")).filter("pa > top").select("a")
        joined = left.join(roots.select(F.col("a").alias("b")), "b").groupBy("a").agg(F.max("pb").alias("best"))
        now = roots.select(F.col("a").alias("id"), F.col("a").alias("root")).unionByName(joined.select(F.col("a").alias("id"), F.col("best.id").alias("root"))).checkpoint()
        done = now if done is None else done.unionByName(now)
        gone = now.select("id")
        left = left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").checkpoint()
        if left.isEmpty():
            return everyone.join(done, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def connected(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) for every node; `edges`: (a, b) in either direction. Ids are strings or longs.

    Each round every node takes the smallest label among its own and its neighbours', then the
    label of that label. Ends when no label changes.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = both.checkpoint()
    # the first round needs no join: every node takes its smallest neighbour
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("root")).checkpoint()
    for _ in range(rounds):
        offered = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        stepped = labels.join(offered, "id", "left").select(
            "id", "root", F.least("root", F.coalesce("near", "root")).alias("new")
        )
        jump = stepped.select(F.col("id").alias("new"), F.col("new").alias("far"))
        nxt = (
            stepped.join(jump, "new", "left")
            .select("id", "root", F.least("new", F.coalesce("far", "new")).alias("new"))
            .checkpoint()
        )
        changed = nxt.filter(F.col("new") != F.col("root")).count()
        labels = nxt.select("id", F.col("new").alias("root"))
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
