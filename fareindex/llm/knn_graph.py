"""Approximate nearest neighbours by inner product: NN-descent builds the graph, queries walk it greedily; both as Spark joins."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import written

EDGES = "node long, near long, score double"


@dataclass(frozen=True)
class Graph:
    """What the graph and the search are made with; no vector is left out of either."""

    neighbours: int = 24        # that each node keeps
    trees: int = 6              # random orders that the first neighbours come from
    block: int = 192            # consecutive nodes of such an order that are compared
    group: int = 48             # lists that may name a node before its neighbourhood is dealt into several groups
    enough: float = 0.01        # share of changed neighbours below which the rounds end
    beam: int = 128             # candidates that a query keeps
    expand: int = 48            # of them that a step looks up the neighbours of
    entries: int = 256          # nodes from which queries start that are not in the graph


@contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows while the body runs: its rows are lists of vectors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """`vec_id` and `vec` (array<double>) of the rows that take part, and their number of components.

    Out are null ids and vectors, zero vectors, those with null or non-finite components and those without the commonest number of
    components (of equally common ones the smallest).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    limit = F.lit(float("inf"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("vec", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    dim = sizes["size"] if sizes else 1
    return rows.filter(F.size("vec") == dim), dim


def nodes_of(rows: DataFrame, most: int) -> DataFrame:
    """One node for equal vectors: `node` (their smallest id), `vec` and `ids`, the smallest of their ids, as many as a result can need."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    return (kept.groupBy("vec").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "vec", "ids")
            .groupBy("node").agg(F.first("vec").alias("vec"), F.first("ids").alias("ids")))


def _best(edges: DataFrame, k: int, *keep: str) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc("score"), "near")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _ordered_blocks(dim: int, g: Graph) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nearest neighbours within runs of `block` consecutive rows of one random order."""
    def edges(ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
        score = vecs @ vecs.T
        np.fill_diagonal(score, -np.inf)
        k = min(g.neighbours, len(ids) - 1)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.argsort(-score, axis=1)[:, :k]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[near].ravel()), pa.array(np.take_along_axis(score, near, 1).ravel())], ["node", "near", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, vecs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dim))
        for batch in batches:
            tree = np.r_[tree, batch.column("tree").to_numpy()]
            ids = np.r_[ids, batch.column("node").to_numpy()]
            vecs = np.r_[vecs, _matrix(batch.column("vec"), dim)]
            start = 0
            while len(ids) - start > 2 * g.block:  # the last rows wait, so that no block is left with a few
                end = start + min(g.block, int(np.searchsorted(tree[start:], tree[start], "right")))
                if end - start > 1:
                    yield edges(ids[start:end], vecs[start:end])
                start = end
            tree, ids, vecs = tree[start:], ids[start:], vecs[start:]
        while len(ids):
            end = int(np.searchsorted(tree, tree[0], "right"))
            end = end if end <= 2 * g.block else g.block
            if end > 1:
                yield edges(ids[:end], vecs[:end])
            tree, ids, vecs = tree[end:], ids[end:], vecs[end:]

    return run


def first_neighbours(nodes: DataFrame, dim: int, g: Graph) -> DataFrame:
    """Neighbours to begin with. Each tree orders the nodes by the signs of random projections, then by a last one; the orders are dealt
    by ranges of about 64 blocks, whatever Spark's settings, so every block has the same size however dense the vectors lie."""
    rows = nodes.count()
    bits = max(6, math.ceil(math.log2(max(1, rows / g.block))))  # as many cells as blocks
    planes = np.random.default_rng(11).standard_normal((g.trees, bits + 1, dim))

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _matrix(batch.column("vec"), dim)
            for tree in range(g.trees):
                value = vecs @ planes[tree].T
                code = (value[:, :bits] > 0) @ (1 << np.arange(bits))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vecs), tree)), pa.array(code.astype(np.int64)), pa.array(value[:, bits]), batch.column("node"), batch.column("vec")],
                                                 ["tree", "code", "along", "node", "vec"])

    parts = max(1, g.trees * rows // (64 * g.block))
    laid = nodes.select("node", "vec").mapInArrow(project, "tree long, code long, along double, node long, vec array<double>")
    laid = laid.repartitionByRange(parts, "tree", "code", "along", "node").sortWithinPartitions("tree", "code", "along", "node")
    return _best(laid.select("tree", "node", "vec").mapInArrow(_ordered_blocks(dim, g), EDGES).distinct(), g.neighbours)


def _compare(dim: int, g: Graph) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within each neighbourhood: for each member the others that are nearer than its farthest neighbour, as many as it can keep."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            ends = np.r_[0, np.cumsum(pa.compute.list_value_length(members).to_numpy(zero_copy_only=False))]
            flat = members.flatten()
            ids, fresh, worst = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("id", "fresh", "worst"))
            vecs = _matrix(flat.field("vec"), dim)
            node, near, score = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                dots = vecs[a:b] @ vecs[a:b].T
                dots[(ids[a:b, None] == ids[None, a:b]) | ~(fresh[a:b, None] | fresh[None, a:b]) | (dots <= worst[a:b, None])] = -np.inf
                if b - a > g.neighbours:
                    low = np.partition(dots, b - a - g.neighbours, axis=1)[:, b - a - g.neighbours]
                    dots[dots < low[:, None]] = -np.inf
                i, j = np.nonzero(dots > -np.inf)
                node.append(ids[a + i])
                near.append(ids[a + j])
                score.append(dots[i, j])
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(near)), pa.array(np.concatenate(score))], ["node", "near", "score"])

    return run


def _listed(edges: DataFrame, g: Graph) -> DataFrame:
    """The nearest `neighbours` of each node, `worst`, the score that a further one must exceed, and `first`, true in one row of each node."""
    whole = Window.partitionBy("node")
    order = whole.orderBy(F.desc("score"), "near")
    kept = edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= g.neighbours)
    worst = F.when(F.count(F.lit(1)).over(whole) >= g.neighbours, F.min("score").over(whole)).otherwise(F.lit(float("-inf")))
    return kept.select("node", "near", "score", "fresh", worst.alias("worst"), (F.col("place") == 1).alias("first"))


def _crowds(graph: DataFrame, dealt: DataFrame | None, g: Graph) -> DataFrame:
    """Nodes that more than `group` others list, or that were such a round before: `node`, `groups`."""
    lists = graph.select(F.col("near").alias("node"), F.lit(1).alias("one"), F.lit(False).alias("dealt"))
    if dealt is not None:
        lists = lists.unionByName(dealt.select("node", F.lit(0).alias("one"), F.lit(True).alias("dealt")))
    counted = lists.groupBy("node").agg(F.ceil(F.sum("one") / g.group).cast("int").alias("groups"), F.max("dealt").alias("dealt"))
    return counted.filter("groups > 1 OR dealt").select("node", F.greatest("groups", F.lit(1)).alias("groups"))


def build(nodes: DataFrame, dim: int, g: Graph = Graph()) -> DataFrame:
    """The neighbour graph: `node`, `near`, `score`, up to `neighbours` rows a node.

    A round joins the neighbours of each node, in both directions, with their vectors and compares those that have not met; what is nearer
    than a member's farthest neighbour is merged into its list. A hub's many reverse neighbours are dealt into groups, anew each round; as
    its pairs meet only when they fall into one group, none of them counts as compared, until one group holds them all. Rounds end when few
    lists change. Each round's graph is a written table, the only one beside the short list of hubs.
    """
    spark = nodes.sparkSession
    vectors = nodes.select("node", "vec")
    with _small_batches(spark, 2000):
        graph = written(_listed(first_neighbours(nodes, dim, g).withColumn("fresh", F.lit(True)), g), "knn")
    dealt = None  # nodes whose neighbours were in several groups in the round before
    for turn in itertools.count():
        hubs = written(_crowds(graph, dealt, g), "knn-hubs")
        dealt = hubs.filter("groups > 1")
        both = graph.select("node", "near", "fresh").unionByName(graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "fresh"))
        around = both.groupBy("node", "near").agg(F.max("fresh").alias("fresh")).join(hubs, "node", "left")
        info = vectors.join(graph.filter("first").select("node", "worst"), "node").select(F.col("node").alias("near"), "vec", "worst")
        member = F.struct(F.col("near").alias("id"), "fresh", "worst", "vec")
        groups = (around.withColumn("fresh", F.col("fresh") | F.col("groups").isNotNull())
                  .withColumn("part", F.pmod(F.xxhash64("near", F.lit(turn)), F.coalesce("groups", F.lit(1)))).join(info, "near")
                  .groupBy("node", "part").agg(F.collect_list(member).alias("members")).filter(F.exists("members", lambda m: m["fresh"])))
        with _small_batches(spark, 500):
            found = groups.select("members").mapInArrow(_compare(dim, g), EDGES)
            old = graph.select("node", "near", "score", F.lit(False).alias("fresh"))
            merged = old.unionByName(found.withColumn("fresh", F.lit(True))).groupBy("node", "near").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
            graph = written(_listed(merged, g), "knn")
        changed = graph.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fresh").cast("long")).alias("fresh")).first()
        if not changed.n or changed.fresh <= g.enough * changed.n:
            break
    return graph.select("node", "near", "score")


STATE = "query long, query_vec array<double>, node array<long>, score array<double>, done array<boolean>, nears array<long>, met array<long>, asks array<long>"
ANSWERS = "query long, node long, score double, nears array<long>"


def _answer(dim: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of nodes for the queries that ask for them, in double precision, beside the nodes' neighbours."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", _matrix(batch.column("vec"), dim), _matrix(batch.column("query_vec"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score), batch.column("nears")], ["query", "node", "score", "nears"])

    return run


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, each as an array; a null one is empty."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _advance(g: Graph) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One step of each query: its new answers join its candidates, the best stay, and the nearest not looked up yet name the nodes to ask for next."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column("got")
            fields = {name: _rows(pa.ListArray.from_arrays(got.offsets, got.values.field(name))) for name in ("node", "score")}
            fields["nears"] = [x.reshape(-1, g.neighbours) for x in _rows(pa.ListArray.from_arrays(pa.compute.multiply(got.offsets, g.neighbours), got.values.field("nears").flatten()))]
            old = {name: _rows(batch.column(name)) for name in ("node", "score", "done", "nears", "met")}
            out = {name: [] for name in ("node", "score", "done", "nears", "met", "asks")}
            for i in range(len(batch)):
                node = np.r_[old["node"][i], fields["node"][i]].astype(np.int64)
                score = np.r_[old["score"][i], fields["score"][i]].astype(float)
                done = np.r_[old["done"][i], np.zeros(len(fields["node"][i]), bool)].astype(bool)
                nears = np.r_[old["nears"][i].reshape(-1, g.neighbours), fields["nears"][i]].astype(np.int64)
                best = np.lexsort((node, -score))[:g.beam]
                node, score, done, nears = node[best], score[best], done[best], nears[best]
                met, asks = old["met"][i].astype(np.int64), np.zeros(0, np.int64)
                while not len(asks) and not done.all():
                    now = np.flatnonzero(~done)[:g.expand]
                    asks = np.setdiff1d(nears[now], met)
                    done[now] = True
                for name, value in zip(out, (node, score, done, nears.ravel(), np.r_[met, asks], asks)):
                    out[name].append(value)
            lists = {name: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)), pa.array(np.concatenate(rows)))
                     for name, rows in out.items() if len(batch)}
            if lists:
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("query_vec"), *lists.values()], ["query", "query_vec", *lists])

    return run


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int, g: Graph = Graph()) -> DataFrame:
    """Greedy search: `query`, `node`, `score` of up to `beam` nodes a query. `queries` has `query`, `query_vec` and `start` (a node, or null).

    A node's vector and its list of neighbours are one row of a table written once. Each step sends the nodes that a query asks for there,
    scores them in double precision and hands back score and neighbours; the query keeps the best `beam` and asks for the neighbours,
    not met before, of the nearest `expand` it has not looked up. It ends when all that it keeps have been looked up and leaves the later
    steps. The steps of all queries run as one join; the state of those under way, one row each, is a written table. Queries without start
    begin at the nearest of `entries` nodes.
    """
    spark = nodes.sparkSession
    near = graph.groupBy("node").agg(F.collect_list("near").alias("near"))
    listed = F.coalesce("near", F.array().cast("array<long>"))
    padded = F.concat(listed, F.array_repeat("node", F.lit(g.neighbours) - F.size(listed)))  # a node among its own neighbours has been met
    places = written(nodes.select("node", "vec").join(near, "node", "left").select("node", "vec", padded.alias("nears")), "knn-places")
    doors = places.orderBy(F.xxhash64("node"), "node").limit(g.entries).collect() if not queries.filter("start IS NULL").isEmpty() else []
    door_ids, door_vecs = np.array([r.node for r in doors], np.int64), np.array([r.vec for r in doors], float).reshape(-1, dim)

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(door_ids):
                best = door_ids[np.argmax(_matrix(batch.column("query_vec"), dim) @ door_vecs.T, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("query_vec"), pa.array(best)], ["query", "query_vec", "start"])

    starts = queries.filter("start IS NOT NULL").select("query", "query_vec", "start")
    if doors:
        starts = starts.unionByName(queries.filter("start IS NULL").select("query", "query_vec").mapInArrow(enter, "query long, query_vec array<double>, start long"))
    none = {"node": "array<long>", "score": "array<double>", "done": "array<boolean>", "nears": "array<long>"}
    asks = F.array("start")
    state = starts.select("query", "query_vec", *[F.array().cast(kind).alias(name) for name, kind in none.items()], asks.alias("met"), asks.alias("asks"))
    with _small_batches(spark, 1000):
        state, ended = written(state, "knn-state"), []
        while not state.filter("size(asks) > 0").isEmpty():
            asked = state.filter("size(asks) > 0")
            answers = (asked.select("query", "query_vec", F.explode("asks").alias("node")).join(places, "node")
                       .select("query", "node", "query_vec", "vec", "nears").mapInArrow(_answer(dim), ANSWERS)
                       .groupBy("query").agg(F.collect_list(F.struct("node", "score", "nears")).alias("got")))
            state = written(asked.drop("asks").join(answers, "query").mapInArrow(_advance(g), STATE), "knn-state")
            ended.append(state.filter("size(asks) = 0"))
    found = functools.reduce(DataFrame.unionByName, ended, state.limit(0))
    return found.select("query", F.explode(F.arrays_zip("node", "score")).alias("hit")).select("query", "hit.node", "hit.score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, g: Graph = Graph()) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `k` nearest rows found of every query row among all rows but itself, ties to the smaller id.

    Equal vectors are one node of graph and search and are told apart again in the result. Rows that take no part are described in
    `usable`; a query among them has no result. Rows that repeat an id count once. An empty table gives no rows.
    """
    rows, dim = usable(vectors)
    rows = written(rows.dropDuplicates(["vec_id"]), "knn-rows")
    nodes = written(nodes_of(rows, k + 1), "knn-nodes")
    graph = build(nodes, dim, g)
    asked = rows.filter(is_query).join(nodes.select(F.col("node").alias("start"), "vec"), "vec").select(F.col("vec_id").alias("query"), F.col("vec").alias("query_vec"), "start")
    found = search(graph, nodes, asked, dim, g).join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
