"""Connected components of a graph given by its edges, by hooking roots and contracting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import removed, settled, stored


def flat(hooks: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by the end of its path through other rows; deletes the table it is given.
    Labels are less than their nodes, so paths end; each jump halves what is left of them."""
    while True:
        above = hooks.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stored(hooks.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "jumped")
        removed(hooks)
        hooks = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node that has an edge; label is the least node of its component.

    Each phase hooks every root that has a lower neighbour to its least one, flattens the trees, and keeps the edges
    between different trees, moved to their roots. A root without a lower neighbour is joined by a neighbour, or
    its neighbours all join lower roots and it has a lower neighbour in the next phase. So two phases at least halve
    the roots that have edges, and phases go on until no edge is left: none is cut off.

    Null ends, loops and repeated edges are ignored; no edges give no rows. Hot nodes only meet partial minima
    and joins that Spark can split. Tables between the steps are stored and not checkpointed: a checkpoint keeps the
    optimiser's constraints, which multiply from phase to phase.
    """
    between = lambda df: stored(df.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "between")
    first = rest = between(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    phases = []
    while not phases or not rest.isEmpty():
        hooks = flat(stored(rest.groupBy("high").agg(F.min("low").alias("low")).select(F.col("high").alias("node"), F.col("low").alias("label")), "hooks"))
        phases.append(hooks)
        lower = hooks.select(F.col("node").alias("low"), F.col("label").alias("a"))
        upper = hooks.select(F.col("node").alias("high"), F.col("label").alias("b"))
        before, rest = rest, between(rest.join(upper, "high").join(lower, "low", "left").select(F.coalesce("a", "low").alias("a"), "b"))
        if before is not first:
            removed(before)
    # A node is hooked in one phase at most, so the phases together are a forest, no deeper than they are many.
    hooks = phases[0] if len(phases) == 1 else flat(reduce(DataFrame.union, phases))
    nodes = first.select(F.col("low").alias("node")).union(first.select("high")).distinct()
    labels = settled(nodes.join(hooks, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    removed(first, rest, hooks)
    return labels
