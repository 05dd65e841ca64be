"""Connected components of a table of links, by contraction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: (a long, b long). (node, label): the least node of each linked node's component.

    In each round a node joins the one of itself and its neighbours that comes first in an order drawn anew by hash, and
    links between nodes that are one now go. That leaves a fraction of the nodes and links, whatever the graph's shape, so
    rounds are about the logarithm of the nodes and all of them together read little more than the first. It goes on until
    no link is left. Rounds are written tables; the driver sees whether links are left.
    """
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-links-0")
    roots = None
    for k in itertools.count():
        order = lambda c, k=k: F.struct(F.xxhash64(c, F.lit(k)), F.col(c))
        first = both.groupBy("a").agg(F.min(order("b")).alias("near")).select(F.col("a").alias("node"), F.when(F.col("near") < order("a"), F.col("near.b")).otherwise(F.col("a")).alias("to"))
        step = scratch.write(first, f"{name}-step-{k}")
        if roots is None:
            roots = step.select("node", F.col("to").alias("root"))
        else:
            joined = roots.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
            roots = scratch.write(joined.select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots-{k}")
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        left = both.join(a, "a").join(b, "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct()
        both = scratch.write(left, f"{name}-links-{k + 1}")
        scratch.drop(f"{name}-links-{k}", f"{name}-roots-{k - 1}")
        if both.isEmpty():
            break
    least = roots.groupBy("root").agg(F.min("node").alias("label"))
    labels = scratch.write(roots.join(least, "root").select("node", "label"), f"{name}-labels")
    scratch.drop(*(f"{name}-step-{i}" for i in range(k + 1)))
    return labels
