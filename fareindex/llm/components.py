"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

SMALL_EDGES = 20_000  # edge lists up to this size take one task a round and no shuffle; longer ones are dealt out


def _together(df: DataFrame, small: bool) -> DataFrame:
    return df.coalesce(1) if small else df


def _stars(edges: DataFrame, both: bool, small: bool = False) -> DataFrame:
    """Join the neighbours of each node to its smallest one: its larger neighbours, or (not `both`) its smaller ones and itself.

    Edges lead from the larger node `a` to the smaller `b`. The smallest neighbour is a map-side combined minimum that is joined back, so
    a hub's neighbours are never brought together, and each edge is joined once.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = _together(edges.unionByName(turned), small) if both else edges
    low = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    if both:
        return turned.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    rows = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return _together(rows.unionByName(low.select("a", F.col("low").alias("b"))), small).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`id` and `component` (the smallest id that it reaches) of every node with an edge; `edges` has long columns `a` and `b`.

    Alternates large and small stars until nothing changes, a number of rounds that grows with the logarithm of the longest path. Each
    round is a written table. Loops and repeated edges do no harm; no edges give no rows. A list of few edges is not dealt out: its rounds
    would be nothing but the start of tasks. Rounds never add edges, so it stays short.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, small = None, False
    while True:
        new_mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new_mark == mark or not new_mark[0]:
            break
        small = small or new_mark[0] <= SMALL_EDGES
        mark, now = new_mark, _together(now, small)
        now = written(_stars(_stars(now, True, small), False, small), "edges")
    ends = _together(now, small).select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("id"), "component").distinct())


def merged(found: DataFrame, added: DataFrame) -> DataFrame:
    """The components `found` (`id`, `component`) after further links `added` (`a`, `b`).

    The links are taken between components, so only these go through the rounds, not the edges that were settled before. Each document is
    joined with the new name of its component once; names that change are few, and a component with a large share of the documents is split
    by adaptive execution or meets a broadcast table.
    """
    own = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = added.join(own("a"), "a", "left").join(own("b"), "b", "left").select(
        F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct()
    moved = written(components(between), "moved")
    nodes = found.unionByName(moved.select("id", F.col("id").alias("component")).join(found.select("id"), "id", "left_anti"))
    names = moved.select(F.col("id").alias("component"), F.col("component").alias("into"))
    return nodes.join(names, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
