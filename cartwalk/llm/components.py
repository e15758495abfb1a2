"""Connected components by randomised contraction.

Every round gives each node a fresh pseudo-random priority; a node adopts the
neighbour of smallest priority (itself included), edges are renamed to the
adopted nodes, and loops and repeats fall away.  The graph shrinks by a
constant factor a round in expectation, whatever its shape, so chains need no
more rounds than stars.  All steps are joins and partial aggregates; the round's
tables are written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwalk.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any one type -> (node, root): nodes of a component
    share the root, which is one of them.  Nodes without an edge to another
    node don't appear.  Repeated, reversed and looping edges are harmless;
    edges with a null end are ignored."""
    def tidy(e):
        return (e.filter(F.col("a") != F.col("b"))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    left = stored(tidy(edges))
    labels, turn = None, 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        def rank(c, turn=turn):
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("n"))
        adopted = stored(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["n"].alias("root")))
        if labels is None:
            labels = adopted
        else:
            step = adopted.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = stored(labels.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        one, two = (adopted.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in ("a", "b"))
        left = stored(tidy(left.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        turn += 1
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
