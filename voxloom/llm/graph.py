"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); the root is the component's smallest node.

    Each round hooks every root to its smallest neighbouring root, follows these hooks to their end
    by doubling, and contracts the edges; an edge inside a tree goes. A root that is not the
    smallest around it always hooks, so the number of rounds is logarithmic. What a round leaves is
    written to the shared folder; joins are on node columns of tables read from there, which
    adaptive execution can split where one node has many edges. A root has no parent and a node that
    has one is in no contracted edge, so the tables of nodes never overlap.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.table(edges, "edges")
    parent: DataFrame | None = None
    while not edges.isEmpty():
        # a larger end may hook to the smaller one; the smallest of a root's neighbours is its parent
        hook = scratch.table(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = hook.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            jumped = scratch.table(jumped, "hooks")
            scratch.drop(hook)
            hook, done = jumped, jumped.filter("moved").isEmpty()
            if done:
                break
        a, b = (hook.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        left = edges.join(a, "a").join(b, "b", "left").select(F.col("ra").alias("a"), F.coalesce("rb", "b").alias("b"))
        left = left.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        left = scratch.table(left, "edges")
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = hook.select("node", "root")
        if parent is not None:
            moved = parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionAll(moved)
        moved = scratch.table(moved, "parents")
        scratch.drop(edges, hook, parent)
        parent, edges = moved, left
    if parent is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = parent.select("root").distinct().select(F.col("root").alias("node"), "root")
    out = scratch.table(parent.unionAll(roots), "components")
    scratch.drop(edges, parent)
    return out
