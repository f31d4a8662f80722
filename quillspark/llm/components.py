"""Connected components of a link table by contraction, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a long, b long): the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows that hook once more, and
    contracts; rounds grow with the logarithm of a component's size.  Each round's result is
    written to the shared folder.  Self-links and null ends are ignored.
    """
    edges = stored(links.filter("a != b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "links")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        hooks = stored(hooks, "hooks")
        onward = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = stored(hooks.join(onward, "up").select("node", "top"), "jump")
        if found is None:
            found = jump.select("node", F.col("top").alias("component"))
        else:
            step = jump.select(F.col("node").alias("component"), "top")
            found = stored(found.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "found")
        ends = [jump.select(F.col("node").alias(x), F.col("top").alias(f"t{x}")) for x in "ab"]
        after = edges.join(ends[0], "a").join(ends[1], "b").filter("ta != tb")
        after = stored(after.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        dropped(edges)
        dropped(hooks)
        edges = after
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def roots(n: int, left, right):
    """For local nodes 0..n-1 with links left[i] - right[i]: each node's smallest reachable node (numpy)."""
    import numpy as np

    up = np.arange(n)
    left, right = np.asarray(left), np.asarray(right)
    while True:
        was = up.copy()
        low = np.minimum(up[left], up[right])
        np.minimum.at(up, left, low)
        np.minimum.at(up, right, low)
        np.minimum.at(up, was, up)  # a node's old top follows it
        up = up[up]
        if (up == was).all():
            return up
