"""Connected components of an edge table by DataFrame operations.

Rounds of hooking and shortcutting on a label per node: a node's label falls to
the smallest label among its neighbours, the root it pointed to follows, then
labels jump to the labels of their labels.  Stars end in two rounds, paths in a
number of rounds that grows with the logarithm of their length.  Each round's
labels are a table in shared storage, so lineage stays short; nothing but the
count of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b).

    Nodes may be of any orderable type.  Loops, repeated edges and both directions
    are allowed, edges with a null end are ignored, and no edges give no rows.  With
    fewer rounds than it takes, component is some smaller node that is reachable.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = materialize(clean.unionAll(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{label}-0")
    for k in range(1, max_rounds + 1):
        # for every edge: the neighbour's label, offered to the node and to the node's present root
        offers = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("offer"))
        own = labels.join(offers, labels["node"] == offers["a"]).select("node", "component", F.least("component", "offer").alias("offer"))
        hooks = own.groupBy("component").agg(F.min("offer").alias("hook")).where("hook < component")
        hooked = own.join(hooks.withColumnRenamed("component", "root"), own["node"] == F.col("root"), "left")
        new = hooked.select("node", "component", F.least("offer", F.coalesce("hook", "offer")).alias("new"))
        new = materialize(new, f"{label}-h{k}")
        up = new.select(F.col("node").alias("up"), F.col("new").alias("over"))
        jumped = new.join(up, new["new"] == up["up"], "left").select("node", "component", F.least("new", F.coalesce("over", "new")).alias("new"))
        jumped = materialize(jumped, f"{label}-{k}")
        changed = k < max_rounds and jumped.where("new < component").limit(1).count()
        discard(new)
        discard(labels)
        labels = jumped.select("node", F.col("new").alias("component"))
        labels._tallyspark_path = jumped._tallyspark_path
        if not changed:
            break
    discard(both)
    return labels
