"""Near duplicates, neighbours, mixing, url templates, revisits and the pipeline beside brute-force versions or SQL."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fareindex.llm import knn_graph, minhash, mixing, queries, revisits, url_templates
from fareindex.llm.components import components
from tools_check import compare, connect

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, copies int"


def union_find(n, pairs):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {i: c for i, c in want.items() if any(a != b and i in (a, b) for a, b in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def linked(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return union_find(sets, near)


def chained_texts():
    """Copies, a chain of small edits, a star of edits of one text and texts with a large common part that stay apart."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [word() for _ in range(120)]
    out, now = [" ".join(base)] * 3 + [" ".join(base).upper()], list(base)
    for _ in range(25):
        now[rng.randrange(120)] = word()
        out.append(" ".join(now))
    for _ in range(25):
        edited = list(base)
        for _ in range(2):
            edited[rng.randrange(120)] = word()
        out.append(" ".join(edited))
    common = [word() for _ in range(90)]
    out += [" ".join(common + [word() for _ in range(25)]) for _ in range(25)]
    return out + ["", None, "one", "ONE", "one two", " \n", "x " * 500, "x " * 900] + [" ".join(word() for _ in range(60)) for _ in range(30)]


@pytest.mark.parametrize("rounds", [1, 3])
@pytest.mark.parametrize("size, percent, side", [(3, 85, 12), (5, 80, 16)])
def test_near_duplicates_equal_all_pairs(spark, size, percent, side, rounds):
    rows = list(enumerate(chained_texts()))
    frame = spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in rows], DOCS)
    got = minhash.link(frame, minhash.Near(size, percent, side, star_rounds=rounds)).collect()
    want = linked(rows, size, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id], size)) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, "en", "s", 0, "c", 1), (7, text, "en", "s", 0, "c", 1), (9, text, None, None, None, None, None), (None, text, None, None, None, None, None), (None, None, None, None, None, None, None), (11, None, "en", "s", 0, "c", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in minhash.link(frame).collect())
    assert got == {(7, 7, True): 2, (9, 7, False): 1, (None, None, True): 2, (11, 11, True): 1}
    kept = minhash.keep_first(frame)
    assert kept.columns == frame.columns and collections.Counter(r.doc_id for r in kept.collect()) == {7: 1, None: 2, 11: 1}
    assert minhash.link(spark.createDataFrame([], DOCS)).count() == 0


def test_minhash_count_is_the_square_root():
    near = minhash.Near()
    with np.errstate(over="ignore"):
        values = minhash.band_values(minhash.shingle_sets(["a b c d e f g"], 5)[0], near)
    assert len(values) == 2 * near.side  # bands; the tables are side * side


def exact_neighbours(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in usable:
        if q % 20 == 0:
            out[q] = sorted(((-float(v @ w), i) for i, w in usable if i != q))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.4 * rng.standard_normal(8)]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]
    odd = [(5000, None), (5020, [0.0] * 8), (5040, [1.0] * 7 + [None]), (5060, [1.0] * 7 + [float("nan")]), (5080, [1.0, 2.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    want = exact_neighbours(rows, 20)
    got = collections.defaultdict(list)
    for r in knn_graph.nearest(frame, F.col("vec_id") % 20 == 0, 20, knn_graph.Graph(neighbours=16, block=64, group=24)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    vectors = dict(rows)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and found == sorted(found, key=lambda x: (-x[2], x[1]))
        assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[i])), abs=1e-12) for _, i, s in found)


def test_search_from_outside_and_tiny_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable, dim = knn_graph.usable(frame)
    nodes = knn_graph.nodes_of(usable, 11)
    graph = knn_graph.build(nodes, dim)
    asked = spark.createDataFrame([(1, [float(x) for x in rng.standard_normal(8)], None)], "query long, query_vec array<double>, start long")
    best = knn_graph.search(graph, nodes, asked, dim).orderBy(F.desc("score")).limit(10).collect()
    q = np.array(asked.first().query_vec)
    exact = sorted((-float(q @ np.array(v)), i) for i, v in rows)[:10]
    assert len({r.node for r in best} & {i for _, i in exact}) >= 9
    for n in (0, 1, 2):
        few = spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
        assert knn_graph.nearest(few, F.lit(True)).count() == n * (n - 1)


def test_pairs_of_a_hub_meet_in_later_rounds(spark):
    rng = np.random.default_rng(2)
    vecs = rng.standard_normal((600, 12))
    vecs[:8] *= 6  # hubs under the inner product
    nodes = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "node long, vec array<double>")
    found = collections.defaultdict(set)
    for r in knn_graph.build(nodes, 12, knn_graph.Graph(neighbours=12, trees=2, block=24, group=8)).collect():
        found[r.node].add(r.near)
    scores = vecs @ vecs.T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(found[i] & set(near.tolist())) for i, near in enumerate(np.argsort(-scores, axis=1)[:, :12]))
    assert hits >= 0.95 * 12 * len(vecs)


@pytest.mark.parametrize("n", [10, 40])
def test_few_vectors_and_many_shuffle_partitions(spark, n):
    rng = np.random.default_rng(n)
    rows = [(20 * i, [float(x) for x in rng.standard_normal(8)]) for i in range(n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        found = knn_graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).orderBy("query_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = collections.defaultdict(list)
    for r in found:
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for _, i in near] for q, near in exact_neighbours(rows, 20).items()}


def test_rates_equal_a_plain_fit(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 100, 300)
    frame = spark.createDataFrame([(i, int(t), int(a), int(100 - a)) for i, (t, a) in enumerate(zip(rng.integers(1, 500, 300), p))], "doc_id long, n_tokens long, p0 int, p1 int")
    options = mixing.Mixing(rounds=60)
    got = {r.doc_id: r for r in mixing.rated(frame, mixing.fit_rates(frame, ["x", "y"], {"x": 0.8, "y": 0.2}, options)).collect()}
    rows = frame.collect()
    t, s = np.array([r.n_tokens for r in rows], float), np.array([[r.p0, r.p1] for r in rows]) / 100
    base, goal, rate = t @ s, np.array([0.8, 0.2]) * t.sum(), np.ones(300)
    for _ in range(60):
        rate = np.maximum(0, rate - ((((t * rate) @ s - goal) / base) @ s.T + options.pull * (rate - 1)) / (1 + options.pull))
    assert [got[i].rate for i in range(300)] == pytest.approx(rate.tolist(), abs=1e-6)
    assert (t * rate) @ s / t.sum() == pytest.approx([0.8, 0.2], abs=0.02) and min(rate) >= 0


def test_mixing_whole(spark):
    rng = random.Random(9)
    make = lambda i: " ".join(rng.choices("red green blue".split() if i % 2 else "one two three".split(), k=30))
    rows = [(i, make(i), "en", "s", 0, "c", 1) for i in range(200)] + [(None, "red", "en", "s", 0, "c", 1), (300, None, "en", "s", 0, "c", 1), (300, "", "en", "s", 0, "c", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200) if i % 7] + [(None, "a"), (5, None)], "doc_id long, domain string")
    got = mixing.mix(frame, labels, {"a": 0.7, "b": 0.3}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and sum(r.posterior) == pytest.approx(1) for r in got)
    assert all(r.domain == "ab"[r.doc_id % 2] for r in got if r.doc_id is not None and r.doc_id < 200)
    total = sum(r.n_tokens * r.rate for r in got)
    assert sum(r.n_tokens * r.rate * r.posterior[0] for r in got) / total == pytest.approx(0.7, abs=0.03)
    copies = mixing.repeat(frame, mixing.mix(frame, labels, {"a": 0.7, "b": 0.3}))
    assert copies.columns == frame.columns and copies.filter("doc_id IS NULL").count() == 1
    assert mixing.mix(frame, labels.limit(0), {"a": 1.0}).count() == len(rows)
    assert mixing.mix(spark.createDataFrame([], DOCS), labels, {"a": 1.0}).count() == 0
    plan = mixing.mix(frame, labels, {"a": 0.7, "b": 0.3})._jdf.queryExecution().toString()
    assert not any(node in plan for node in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "InPandas"))


RULES = queries.URL_RULES


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("HTTP://WWW.Example.ORG/a/B?x#y", "www.example.org", "/a/B", "org/", "allow"), ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"), ("x://y.com/de/", "y.com", "/de/", "com/de/", "block"),
    ("x://y.com/fr/a", "y.com", "/fr/a", "com/fr/", "allow"), ("x://org?q=1", "org", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
    ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("a://b://c/d", "b:", "//c/d", None, None)])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "v")], "page_id long, url string, verdict string")
    r = url_templates.judge(pages, spark.createDataFrame([], "page_id long, good int"), RULES).first()
    assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}/p{i % 3}") for i in range(200)] + [(None, "http://h.net/news/1"), (201, "http://h.net" + "/x" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 120)] + [(None, 1), (3, None)], "page_id long, good int")
    got = {r.page_id: r for r in url_templates.judge(pages, labels, []).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(200)) and len(got) == 202
    assert got[0].template.startswith("/news/{number}/")
    assert url_templates.judge(pages.limit(0), labels, RULES).count() == 0


@here
@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    verdict, _ = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert verdict.startswith("ok"), verdict


RECORD = "record_id long, url string, time long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>, status string"


def test_revisits(spark):
    h = lambda **kw: [(k.replace("_", "-"), v) for k, v in kw.items()]
    rows = [
        (1, "http://A.com:80/p/?b=2&utm_x=1&a=1#f", 10, "response", '"1"', "d1", h(Content_Type="t", Age="1", Set_Cookie="x"), "c"), (2, "https://a.com/p?a=1&b=2", 20, "response", '"2"', None, h(Content_Type="t2"), "c"),
        (3, "http://a.com/p?a=1&b=2", 15, "revisit", 'W/"1"', None, h(age="2", content_type="no", X="y"), "c"), (4, "http://a.com/p?a=1&b=2", 20, "revisit", '"1"', None, h(), "c"),
        (5, "http://a.com/p?a=1&b=2", 21, "revisit", '"1"', "d1", None, "c"), (6, "http://a.com/p?a=1&b=2", 5, "revisit", '"1"', None, h(), "c"),
        (7, "http://a.com/p?a=1&b=2", 22, "revisit", None, None, None, "c"), (8, None, 22, "revisit", None, None, None, None), (9, "http://a.com/p", None, "revisit", None, None, None, None), (10, "http://a.com/p", 1, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, RECORD)
    got = {r.record_id: (r.response_id, r.status, [tuple(x) for x in r.headers or []]) for r in revisits.resolve(frame).collect()}
    assert got[3] == (1, "validated", [("Content-Type", "t"), ("Set-Cookie", "x"), ("age", "2"), ("X", "y")])
    assert got[4][:2] == (1, "validated") and got[5][:2] == (2, "mismatch") and got[6][:2] == (None, "no_response") and got[7][:2] == (2, "unchecked")
    assert got[8][:2] == got[9][:2] == (None, "no_response") and set(got) == {3, 4, 5, 6, 7, 8, 9}
    assert revisits.resolve(frame.limit(0)).count() == 0


def test_revisits_of_one_hot_url(spark):
    frame = spark.range(4000).select(F.col("id").alias("record_id"), F.lit("http://h.com/").alias("url"), (F.col("id") / 3).cast("long").alias("time"), F.when(F.col("id") % 97 == 0, "response").otherwise("revisit").alias("kind"),
                                     F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.array().cast("array<struct<name:string,value:string>>").alias("headers"))
    times = {i: i // 3 for i in range(0, 4000, 97)}
    for r in revisits.resolve(frame).collect():
        want = max(((t, i) for i, t in times.items() if t < r.time), default=(None, None))[1]
        assert r.response_id == want


@here
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == docs.columns, name
        sizes.append(frame.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0 and frame.select("doc_id").distinct().count() <= sizes[3]
    out = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert out.count() == sizes[-1] and out.filter("NOT round_trip").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_blocks_of_open_buckets_join_what_all_pairs_join(spark, monkeypatch):
    rng = np.random.default_rng(4)
    near = minhash.Near(words=1, percent=80)
    sets = {}
    for i in range(240):  # copies of one text that differ too much from most others, and texts of other lengths
        base = np.arange(60 if i % 5 else 20)
        sets[i] = np.unique(np.where(rng.random(len(base)) < 0.12, 1000 + rng.integers(0, 5000, len(base)), base))
    sets[240], sets[241] = np.arange(9000), np.arange(100, 9100)
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    rows = spark.createDataFrame([(i, len(s), s.tolist()) for i, s in sets.items()], "id long, n long, shingles array<long>")
    start = {i: (i if i % 7 else 7 * (i // 14)) for i in sets}  # some components from before
    open_ = spark.createDataFrame([(i, 1, start[i], 0) for i in sets], "id long, key long, component long, lead long")

    def joined(links):
        root = {c: c for c in start.values()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(start[a])] = find(start[b])
        groups = collections.defaultdict(set)
        for i in sets:
            groups[find(start[i])].add(i)
        return sorted(map(sorted, groups.values()))

    want = joined([(a, b) for a in sets for b in sets if b < a and linked(a, b)])
    for members, shingles in ((512, 100_000), (16, 100_000), (512, 300)):
        monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        links = [(r.a, r.b) for r in minhash._rest_links(open_, rows, near).collect()]
        assert joined(links) == want and all(linked(a, b) and start[a] != start[b] for a, b in links)
        assert len(want) > 1 and len(links) < 20 * len(sets)


def test_merged_components_equal_components_of_all_links(spark):
    from fareindex.llm.components import components, merged

    rng = random.Random(2)
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    for _ in range(3):
        first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 20))
        want = {r.id: r.component for r in components(frame(first + more)).collect()}
        got = merged(components(frame(first)), frame(more)).collect()
        assert {r.id: r.component for r in got if r.id in want} == want and len(got) == len({r.id for r in got})
        assert all(r.component == r.id for r in got if r.id not in want)
    assert merged(components(frame([])), frame([(5, 3)])).count() == 2


def test_few_edges_are_not_dealt_out(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").coalesce(1)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few-edges", "few edges")
    try:
        assert {(r.id, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(31)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numCompletedTasks for s in stages if s) < 200


def test_blocks_compare_only_what_can_join_components(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    near, sets = minhash.Near(words=1, percent=80), [np.where((x := rng.random(40)) < 0.08, 1000 + rng.integers(0, 90, 40), np.arange(40)) for _ in range(60)]
    sets = [np.unique(s) for s in sets]
    compared, plain = [], minhash._overlap_counts
    monkeypatch.setattr(minhash, "_overlap_counts", lambda owner, shingles, n, split: compared.append(split) or plain(owner, shingles, n, split))

    def links(comps, sides):
        part = pa.table({"id": pa.array(range(60), pa.int64()), "component": pa.array(comps, pa.int64()), "n": pa.array(map(len, sets), pa.int64()),
                         "side": pa.array(sides, pa.int32()), "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))})
        return [tuple(r.values()) for r in minhash._links_of_blocks(part, near).to_pylist()]

    for sides in ([0] * 60, [i % 2 for i in range(60)]):
        assert links([0] * 60, sides) == [] and not compared
        comps = [i if i in (7, 20, 41) else 0 for i in range(60)]
        wanted = {(a, b) for a in range(60) for b in range(a) if comps[a] != comps[b] and (sides[a] != sides[b] or not any(sides))
                  and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        found = links(comps, sides)
        assert compared == [3] and set(found) <= wanted
        assert union_find(set(comps), [(comps[a], comps[b]) for a, b in found]) == union_find(set(comps), [(comps[a], comps[b]) for a, b in wanted])
        assert wanted
        compared.clear()


def test_leads_that_link_nothing_are_not_tried_again(spark, monkeypatch):
    rng, base, labels, plain = random.Random(3), [f"w{i}" for i in range(120)], [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, label: labels.append(label) or plain(df, label))
    texts = [" ".join(rng.choice(("x", "y", "z")) + str(i) if rng.random() < 0.04 else w for w in base) for i in range(60)]  # alike, yet below the limit
    near = minhash.Near(words=3, percent=85, side=12, star_rounds=6)
    rows = minhash.link(spark.createDataFrame([(i, t, "en", "s", len(t), None, 1) for i, t in enumerate(texts)], DOCS), near).collect()
    sets = minhash.shingle_sets(texts, 3)
    pairs = [(a, b) for a in range(60) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert {r.doc_id: r.component_id for r in rows} == union_find(range(60), pairs)
    assert labels.count("open-buckets") == 2 and "open-members" in labels
