"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, texts_of, written
from .components import components, merged

SKETCH = "doc_id long, n_shingles long, sum_hash long, xor_hash long, slots array<long>"
BLOCK_SHINGLES, BLOCK_MEMBERS = 100_000, 512  # of a block of open documents, about; a larger set is a block of its own
U = np.uint64
_SPREAD, _FINAL = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Near:
    """What is near, and how it is looked for.

    Two collections of `side` short bands of `hashes` minhashes each give side * side tables, the key of a table being a band of one
    collection with a band of the other: 2 * side * hashes minhashes do the work of side * side * 2 * hashes. A pair at the limit of
    similarity s is missed with probability about 2 * (1 - s ** hashes) ** side.
    """

    words: int = 5
    percent: int = 80
    side: int = 16
    hashes: int = 3
    star_rounds: int = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * _FINAL
    return x ^ (x >> U(29))


def _odd_numbers(n: int, salt: int) -> np.ndarray:
    return _mix((np.arange(1, n + 1, dtype=np.uint64) + U(salt)) * _SPREAD) | U(1)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: A-Z in lower case, `size` words a shingle, all words together if fewer."""
    index: dict[bytes, int] = {}
    place = index.setdefault
    codes = [np.array([place(w, len(index)) for w in (t or "").encode("utf-8", "surrogatepass").lower().split()], np.int64) for t in texts]
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
    factors = _odd_numbers(size, 7)
    out = []
    for at in codes:
        h = hashed[at]
        n = len(h)
        if n == 0:
            out.append(h)
        elif n < size:
            total = U(n)
            for x in h:
                total = _mix(np.array([total]) * _SPREAD + x)[0]
            out.append(np.array([total], np.uint64))
        else:
            total = h[: n - size + 1] * factors[0]
            for k in range(1, size):
                total = total + h[k : n - size + 1 + k] * factors[k]
            out.append(np.unique(_mix(total)))
    return out


def band_values(shingles: np.ndarray, near: Near) -> np.ndarray:
    """One value for each short band of both collections."""
    n = 2 * near.side * near.hashes
    a, b = _odd_numbers(n, 1000)[:, None], _odd_numbers(n, 5000)[:, None]
    low = np.full(n, ~U(0))
    step = max(1, 400_000 // n)
    for i in range(0, len(shingles), step):
        low = np.minimum(low, (shingles[None, i : i + step] * a + b).min(axis=1))
    bands = low.reshape(2 * near.side, near.hashes)
    value = np.arange(1, 2 * near.side + 1, dtype=np.uint64) * _SPREAD
    for k in range(near.hashes):
        value = _mix(value * _FINAL + bands[:, k])
    return value.view(np.int64)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """Set size, a 128-bit hash of the set and the band values of each row; no values without shingles."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets = shingle_sets(batch.column("text").to_pylist(), near.words)
                sums = [int(_mix(s + U(17)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                xors = [int(np.bitwise_xor.reduce(_mix(s * _SPREAD), initial=U(0)).view(np.int64)) for s in sets]
                values = [band_values(s, near) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()),
                                                  pa.array(values, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "sum_hash", "xor_hash", "slots"])

    return texts_of(docs).mapInArrow(run, SKETCH)


def _sets(docs: DataFrame, ids: DataFrame, near: Near) -> DataFrame:
    """`id`, `n` and the full shingle set of the named documents."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets = [s.view(np.int64) for s in shingle_sets(batch.column("text").to_pylist(), near.words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "shingles"])

    wanted = texts_of(docs).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id long, n long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Those of the distinct pairs (`a`, `b`) whose full sets are near enough; sizes are compared before the sets."""
    sized = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    close = (sized.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a")
             .filter(F.lit(100) * F.least("na", "nb") >= F.lit(near.percent) * F.greatest("na", "nb")))
    both = close.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return (both.select("a", "b", "na", "nb", common.alias("common"))
            .filter(F.lit(100) * F.col("common") >= F.lit(near.percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))


def bucket_members(reps: DataFrame, near: Near) -> DataFrame:
    """`id`, `key` and `lead` (the bucket's smallest id) of all table buckets with more than one document.

    A table key can only be shared where both of its bands are, so bands that no other document has go first and the tables are
    formed from the others.
    """
    bands = reps.select("id", F.posexplode("slots").alias("slot", "value"))
    shared = bands.groupBy("slot", "value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("slot", "value")
    left = bands.join(shared, ["slot", "value"], "left_semi")
    sides = left.groupBy("id").agg(F.collect_set(F.when(F.col("slot") < near.side, F.col("value"))).alias("one"),
                                   F.collect_set(F.when(F.col("slot") >= near.side, F.col("value"))).alias("two"))
    sides = written(sides.filter((F.size("one") > 0) & (F.size("two") > 0)), "bands")
    keys = sides.select("id", F.explode("one").alias("x"), "two").select("id", "x", F.explode("two").alias("y")).select("id", F.xxhash64("x", "y").alias("key"))
    full = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead <> last").select("key", "lead")
    return keys.join(full, "key")


def _overlap_counts(owner: np.ndarray, shingles: np.ndarray, n: int, split: int) -> np.ndarray:
    """Shared shingles of each document below `split` with each one from `split` on (of all with all where it is 0), as products of incidence
    matrices over some thousand shingles at a time. Shingles that only one side holds are left out first."""
    _, at = np.unique(shingles, return_inverse=True)
    left = np.bincount(at[owner < split] if split else at, minlength=at.max(initial=-1) + 1)
    right = np.bincount(at[owner >= split], minlength=len(left))
    used = (left > 0) & (right > 0) if split else left > 1
    number = np.cumsum(used) - 1
    keep = used[at]
    owner, at = owner[keep], number[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    rows = (split or n, n - split)
    out = np.zeros(rows, np.float32)
    for low in range(0, int(at.max(initial=-1)) + 1, 4096):
        i, j = np.searchsorted(at, (low, low + 4096))
        held = np.zeros((n, 4096), np.float32)
        held[owner[i:j], at[i:j] - low] = 1.0
        out += held[: split or n] @ held[split:].T
    return out


def _forest(components: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[int]:
    """Of linked pairs those that join components not yet joined by the ones before: at most one fewer than there are components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kinds = np.stack((np.minimum(components[rows], components[columns]), np.maximum(components[rows], components[columns])), axis=1)
    _, first = np.unique(kinds, axis=0, return_index=True)
    out = []
    for k in first.tolist():
        a, b = find(int(components[rows[k]])), find(int(components[columns[k]]))
        if a != b:
            root[a] = b
            out.append(k)
    return out


def _links_of_blocks(part: pa.Table, near: Near) -> pa.Table:
    """Links of two blocks, or within one, that connect different components."""
    side = part.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    part = part.take(pa.array(order))
    ids, comps, sizes = (part.column(c).to_numpy() for c in ("id", "component", "n"))
    lists = part.column("shingles").combine_chunks()
    lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(ids)), lengths)
    split = int((side == 0).sum()) if (side == 1).any() else 0
    if len(ids) < 2 or (side == 1).all():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    shingles = lists.flatten().to_numpy(zero_copy_only=False)
    kinds, kind, counts = np.unique(comps, return_inverse=True, return_counts=True)
    apart = np.flatnonzero(kind != counts.argmax())  # no pair of the commonest component can be wanted
    if not len(apart):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if 2 * len(apart) * len(ids) < (split or len(ids)) * (len(ids) - split):
        # Those of other components, once more and in front, are compared with all.
        picked = np.isin(owner, apart)
        number = np.zeros(len(ids), np.int64)
        number[apart] = np.arange(len(apart))
        one_owner, one = number[owner[picked]], shingles[picked]
        shared = np.isin(shingles, one)
        common = _overlap_counts(np.concatenate((one_owner, owner[shared] + len(apart))), np.concatenate((one, shingles[shared])), len(apart) + len(ids), len(apart))
        rows, columns, two_sides = apart, np.arange(len(ids)), side[order][apart, None] != side[order][None, :] if split else True
    else:
        common = _overlap_counts(owner, shingles, len(ids), split)
        rows, columns, two_sides = np.arange(split or len(ids)), np.arange(split, len(ids)), True
    common = common.astype(np.int64)
    union = sizes[rows, None] + sizes[None, columns] - common
    at_rows, at_columns = np.nonzero((100 * common >= near.percent * union) & (comps[rows, None] != comps[None, columns]) & two_sides)
    rows, columns = rows[at_rows], columns[at_columns]
    found = _forest(comps, rows, columns)
    one, two = ids[rows[found]], ids[columns[found]]
    return pa.table({"a": pa.array(np.maximum(one, two)), "b": pa.array(np.minimum(one, two))})


def _rest_links(open_: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links across components within the buckets (`id`, `key`, `component`, `lead`) that stars could not settle; none between different
    components of a bucket is lost, up to those that a given one makes superfluous.

    Buckets of one lead are a family: leads are chosen by a hash of the document alone, so the buckets of a group of copies have few. Its
    members are dealt into classes of set sizes, as wide as the limit lets a partner's size differ, so partners are in one class or
    neighbouring ones, and classes into blocks of bounded content. Each pair of blocks
    is one group: a task compares the two in full and gives out a spanning forest of the components that it joins, so no row stands for a
    pair. A member goes to as many groups as its class and its neighbours have blocks.
    """
    ratio = math.log(100.0 / near.percent)
    members = open_.select("id", "component", F.col("lead").alias("family")).distinct().join(sets, "id")
    members = written(members.withColumn("size", F.floor(F.log(F.col("n")) / ratio + 1e-9).cast("int")), "open-members")
    dealt = members.groupBy("family", "size").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    above = dealt.select("family", (F.col("size") - 1).alias("size"), F.col("blocks").alias("above"))
    below = dealt.select("family", (F.col("size") + 1).alias("size"), F.col("blocks").alias("below"))
    dealt = dealt.join(above, ["family", "size"], "left").join(below, ["family", "size"], "left").na.fill(0, ["above", "below"])
    rows = members.join(dealt, ["family", "size"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own, at, size = F.col("block"), lambda *x: F.struct(*[c.alias(n) for c, n in zip(x, ("lo", "lo_block", "hi", "hi_block", "side"))]), F.col("size")
    zero, one = F.lit(0), F.lit(1)
    groups = F.concat(
        F.transform(numbers(F.col("blocks")), lambda k: at(size, F.least(own, k), size, F.greatest(own, k), F.when(own > k, one).otherwise(zero))),
        F.transform(numbers(F.col("above")), lambda k: at(size, own, size + 1, k, zero)),
        F.transform(numbers(F.col("below")), lambda k: at(size - 1, k, size, own, one)),
    )
    key = ["family", "lo", "lo_block", "hi", "hi_block"]
    groups = rows.select("family", "id", "component", "n", "shingles", F.explode(groups).alias("g")).select("family", "g.*", "id", "component", "n", "shingles")

    def compare(part: pa.Table) -> pa.Table:
        return _links_of_blocks(part, near)

    return groups.groupBy(*key).applyInArrow(compare, "a long, b long").distinct()


def link(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept` of each row: the smallest id that it reaches by links, and whether that is itself.

    Equal sets are one node, its smallest id. In each bucket every member is compared with the bucket's lead; while a bucket still holds
    more than one component, further leads are tried as long as they link a fair part, and what they leave is compared block by block inside tasks. So no link between
    documents of one bucket is lost that would change a component, and no row stands for a pair of a group. Texts without words, and rows without id, have no
    links: the first are their own component, the others have none and are kept. Rows that repeat an id share its node and its fate.
    """
    sketched = written(sketches(docs, near), "sketches")
    whole = ["n_shingles", "sum_hash", "xor_hash"]
    classes = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*whole).agg(F.min("doc_id").alias("rep"))
    members = written(sketched.join(classes, whole, "left").select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("slots")).alias("slots")), "members")
    reps = members.filter("slots IS NOT NULL").select(F.col("rep").alias("id"), "slots")
    buckets = written(bucket_members(reps, near), "buckets")
    ids = buckets.select("id").distinct()
    sets = written(_sets(docs, ids, near).dropDuplicates(["id"]), "sets")
    edges = confirmed(buckets.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), sets, near)
    # A document that has several sets is the node of all of them.
    same_id = members.filter("rep IS NOT NULL AND rep <> doc_id").join(reps.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = written(components(edges.unionByName(same_id)), "components")
    last = near.star_rounds
    for turn in range(1, near.star_rounds + 1):
        placed = buckets.join(found, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("lead"),
                                          F.min_by("component", F.xxhash64("id", F.lit(turn))).alias("lead_component")).filter("lo <> hi")
        open_ = written(placed.join(mixed.select("key", "lead", "lead_component"), "key"), "open-buckets")
        rows = open_.count()
        if not rows:
            break
        if turn < last:
            more = open_.filter("component <> lead_component").select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
            buckets = open_.select("id", "key")
            added = written(confirmed(more, sets, near), "links")
        else:
            added = written(_rest_links(open_, sets, near), "links")
        links = added.count()
        if links:
            found = written(merged(found, added), "components")
        if turn >= last:
            break
        # A document is in side * side buckets at most. Where fewer than a tenth of the open ones found a link, another lead would do no better.
        if links * 10 * near.side ** 2 < rows:
            last = turn + 1
    out = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group of near duplicates: the one of the smallest id. Of rows that
    repeat an id one stays; rows without id all stay."""
    gone = link(docs, near).filter("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    again = docs.select("doc_id").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
