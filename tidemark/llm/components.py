"""Connected components of a link table by repeated hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """links: columns u, w (BIGINT). One row v, root for every end of a link; root is one node of v's component.

    Each round every node hooks onto its smallest neighbour, jumps once more, and links are contracted; nothing is
    collected but the number of links that are left. Written tables cut the lineage of each round.
    """
    edges = links.filter("u <> w").select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct()
    edges = scratch.put(f"{name}_edges0", edges)
    nodes = edges.select(F.col("u").alias("v")).union(edges.select("w")).distinct()
    member = scratch.put(f"{name}_member0", nodes.select("v", F.col("v").alias("root")))
    k = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("w", "u"))
        hook = both.groupBy("u").agg(F.min("w").alias("low")).select(F.col("u").alias("v"), F.least("u", "low").alias("root"))
        hook = scratch.put(f"{name}_hook{k}", hook)
        jump = hook.alias("a").join(hook.alias("b"), F.col("a.root") == F.col("b.v")).select(F.col("a.v").alias("v"), F.col("b.root").alias("root"))
        jump = scratch.put(f"{name}_jump{k}", jump)
        to = lambda c: jump.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root"))
        moved = member.join(jump.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = scratch.put(f"{name}_member{k + 1}", moved.select("v", F.coalesce("next", "root").alias("root")))
        left = edges.join(to("u"), "u").join(to("w"), "w").select(F.greatest("u_root", "w_root").alias("u"), F.least("u_root", "w_root").alias("w"))
        left = scratch.put(f"{name}_edges{k + 1}", left.filter("u <> w").distinct())
        scratch.drop(f"{name}_hook{k}", f"{name}_jump{k}", f"{name}_edges{k}", f"{name}_member{k}")
        edges, member, k = left, moved, k + 1
    return member
