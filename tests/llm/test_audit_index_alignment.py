"""Filter audit, positional index and token alignment beside brute-force versions."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fareindex.llm import alignment, filter_audit, positional_index

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, part string, window string, start string, n string, _row string, failed string, digest string"
LABELS = "doc_id long, quality int, toxic int, part string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["clash"] * 7) for i, t, lang in rows], SCHEMA)


# ---- filter audit

def audit_rows():
    rng = random.Random(5)
    words = "a b c Dd e f gg # the of".split()
    made = [" ".join(rng.choices(words[: rng.choice([3, 10])], k=rng.choice([5, 150, 199, 200, 260]))) for _ in range(30)]
    many = " ".join(f"w{k}" for k in range(400))
    rows = [(i, t, rng.choice(["en", "fr", None, ""])) for i, t in enumerate(made + [many, None, "", many.upper(), "x" * 50_000, "é" * 300 + " A" * 8])]
    rows += [(90, made[0], "de"), (91, made[0], "en"), (4, made[4], "en"), (4, made[4], "fr"), (92, None, "fr"), (93, made[4], "fr"), (None, made[4], "en"), (None, "only here", None)]
    return rows


def audit_labels():
    return [(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(3, 0, 0), (4, None, 1), (90, 1, None), (None, 1, 1)]


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for step, f in enumerate(order, 1):
            for part in {d[0] for d in docs}:
                c = [0] * 6
                for lang, fails, g, x in docs:
                    if lang != part:
                        continue
                    gone = any(fails[e] for e in order[: step - 1])
                    removed = fails[f] and not gone
                    c = [a + b for a, b in zip(c, [not fails[f] and not gone, removed, fails[f] and gone, fails[f] and sum(fails.values()) == 1, removed and g, removed and x])]
                out[part, "".join(order), step] = c
                shapley[part, f] += c[1]
    return {k: (*c, shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit_equals_a_walk_through_every_order(spark):
    labels = spark.createDataFrame([(*r, "clash", "clash") for r in audit_labels()], LABELS)
    got = filter_audit.audit(frame(spark, audit_rows()), labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute_audit(audit_rows(), audit_labels())
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    rows = filter_audit.audit(frame(spark, [(1, "one", "en")]), labels).collect()
    assert len(rows) == 600 and sum(r.removed for r in rows if r.step == 1) == 24 and all(r.good_lost == 0 for r in rows)


def test_contraction_selects_along_each_axis():
    tensor = np.arange(32).reshape((2,) * 5)
    at = filter_audit.ORDERS.index("CAEBD") * 5 + 2
    assert filter_audit.contract(tensor, filter_audit.SELECT["removed"])[at] == tensor[0, :, 0, :, 1].sum()
    assert filter_audit.contract(tensor, filter_audit.SELECT["alone"])[at] == tensor[0, 0, 0, 0, 1]


# ---- positional index

def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, size):
    windows = {(i or "", *w[s : s + size]) for i, t in items if (w := lowered(t)) for s in range(max(1, len(w) - size + 1))}
    out = []
    for doc_id, text, _ in docs:
        w, hit, found = lowered(text), set(), set()
        for item, *k in windows:
            for s in range(len(w) - len(k) + 1):
                if w[s : s + len(k)] == k:
                    hit |= set(range(s, s + len(k)))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


def index_rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(12)] + ["the"] * 8 + ["Über", "ÜBER", "a1"]
    items = [(str(k), " ".join(rng.choices(words, k=rng.choice([2, 4, 7, 15])))) for k in range(12)]
    items += [("s", "the"), ("t", "the the the the the"), (None, "w1 the"), ("u", None), ("v", " .. "), ("0", "w3 w3 w4 w5 w6"), ("x", items[3][1]), ("y", "neverseen w1")]
    docs = []
    for i in range(40):
        text = rng.choices(words, k=rng.randint(0, 60))
        if i % 3 == 0:
            text += [", The-" if x == "the" else x for x in items[i % 12][1].split()] + ["tail"]
        docs.append((i, rng.choice(["", ". "]) + " ".join(text).upper().replace("ÜBER", "Über") + rng.choice(["", "\n"]), "en"))
    docs += [(50, None, "en"), (51, "", "en"), (52, "the " * 3000, "en"), (53, docs[0][1], "en"), (0, "another text w1 the", "en"), docs[3], docs[3], (None, docs[6][1], None), (None, "the", None)]
    return docs, items


@pytest.mark.parametrize("size", [3, 10])
def test_hits_equal_a_search_of_every_run(spark, size):
    docs, items = index_rows()
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, doc_id string")
    got = positional_index.decontaminate(frame(spark, docs), table, size).collect()
    assert collections.Counter(map(tuple, got)) == brute_hits(docs, items, size)


def test_hits_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    row = positional_index.decontaminate(frame(spark, [(1, "a b", "en")]), none).collect()
    assert [tuple(r) for r in row] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert positional_index.decontaminate(frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_proximity_lets_terms_move_beside_their_places(spark):
    docs, items = index_rows()
    docs = [d for d in docs if d[0] is not None][:44]
    table = spark.createDataFrame([i for i in items if i[0]], "item_id string, text string")
    windows = positional_index.item_windows(table, 4).cache()
    index = positional_index.build_index(frame(spark, docs))
    ranked = positional_index.rank_terms(windows, index)
    terms = {r.window: list(r.terms) for r in windows.collect()}
    rarest = {r.window: r.place for r in ranked.filter("rank = 1").collect()}
    for slack in (0, 1):
        got = {(r.document, r.window, r.start) for r in positional_index.matches(index, ranked, slack).collect()}
        want = set()
        for doc_id, text, _ in docs:
            w = lowered(text)
            shift = int(bool(text) and not re.match(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", text))  # a separator in front is place 0
            for window, place in rarest.items():
                k = terms[window]
                for s in range(-len(k), len(w)):
                    near = lambda j, t: any(0 <= s + j + m < len(w) and w[s + j + m] == t for m in range(-slack, slack + 1))
                    if 0 <= s + place < len(w) and w[s + place] == k[place] and all(near(j, t) for j, t in enumerate(k) if j != place):
                        want.add((doc_id, window, s + shift))
        assert got == want


def test_postings_name_every_place_of_the_vocabulary(spark):
    docs = frame(spark, [(1, "The cat, the-dog", "en")])
    assert positional_index.build_index(docs).count() == 4
    some = positional_index.build_index(docs, spark.createDataFrame([("the",)], "word string"))
    assert sorted(r.position for r in some.collect()) == [0, 2]


# ---- alignment

def aligned_texts():
    rng = random.Random(3)
    words = "the cat sat on a mat and was, is. or To be naïve über 東京 😀 don't 1234 <b> # ... unbelievable".split()
    made = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(25)]
    return made + [None, "", " ", "  a  b", "\n\n\t x", "a<|endoftext|>b", "<s> hi </s>", "▁x y", "y" * 3000, "".join(rng.choices("abcdefgh", k=20_000)), "é́​\u0000", made[0], made[0]]


def tokens(text, library, model, a, b):
    if not text:
        return [], []
    both = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    same = all(b"".join(side.bytes[side.starts[i] : side.starts[i] + side.lengths[i]].tobytes() for i in ids) == (" " + text).encode() for side, ids in zip((a, b), both))
    return both if same else ([], [])


def brute_alignment(texts):
    library, model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    library.encode_special_tokens = True
    a, b = alignment.sides(BPE, MODEL)
    found, counts = [], collections.Counter()
    for text in texts:
        ids_a, ids_b = tokens(text, library, model, a, b)
        ends_a, ends_b = np.cumsum(a.lengths[ids_a]).tolist() if ids_a else [], np.cumsum(b.lengths[ids_b]).tolist() if ids_b else []
        place = {e: j for j, e in enumerate(ends_b)}
        links = [(i, place[e]) for i, e in enumerate(ends_a) if e in place]
        parts, p, q = [], 0, 0
        for i, j in links:
            parts.append(",".join(map(str, ids_a[p : i + 1])) + "|" + ",".join(map(str, ids_b[q : j + 1])))
            p, q = i + 1, j + 1
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        counts.update(pairs)
        found.append((len(ids_a), len(ids_b), pairs, hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, len(p), len(p), sum(counts[k] == best[k[1]] for k in p), sum(counts[k] for k in p), sha) for n_a, n_b, p, sha in found]


def test_alignment_equals_the_libraries_and_plain_sets_of_ends(spark):
    texts = aligned_texts()
    got = alignment.align(frame(spark, [(None if i == 2 else i, t, "en") for i, t in enumerate(texts)]).repartition(3), BPE, MODEL).collect()
    want = collections.Counter((None if i == 2 else i, *r) for i, r in enumerate(brute_alignment(texts)))
    assert collections.Counter(map(tuple, got)) == want
    assert any(r.n_best < r.n_links for r in got) and sum(r.n_a == 0 for r in got) == 3
    assert alignment.align(frame(spark, []), BPE, MODEL).count() == 0


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_any_size_give_the_overlaps_of_the_whole(work):
    rng = np.random.default_rng(work)
    for _ in range(30):
        a, b = (np.cumsum(rng.integers(1, 4, rng.integers(1, 40))) for _ in range(2))
        if a[-1] != b[-1]:  # both end with the text
            a, b = (np.r_[x, max(a[-1], b[-1])] if x[-1] < max(a[-1], b[-1]) else x for x in (a, b))
        at_a, at_b, ends, both = alignment.overlaps(a, b, work)
        want = sorted(set(a.tolist()) | set(b.tolist()))
        assert ends.tolist() == want
        assert at_a.tolist() == [next(i for i, e in enumerate(a) if e >= w) for w in want]
        assert at_b.tolist() == [next(i for i, e in enumerate(b) if e >= w) for w in want]
        assert both.tolist() == [w in set(a.tolist()) and w in set(b.tolist()) for w in want]
        cut_a, cut_b = alignment.diagonals(a, b, work)
        assert set(np.diff(cut_a + cut_b)[:-1].tolist()) <= {work} and (np.diff(cut_a) >= 0).all() and (np.diff(cut_b) >= 0).all()


def test_overlaps_are_listed_with_both_ids(spark):
    row = alignment.overlapping(frame(spark, [(1, "unbelievable don't", "en"), (2, None, "en")]), BPE, MODEL).orderBy("doc_id").collect()
    first = row[0]
    assert first.end[-1] == len(" unbelievable don't") and first.both_end[-1]
    assert len(first.a) == len(first.b) == len(first.end) == (first.a_index[-1] + 1) + (first.b_index[-1] + 1) - sum(first.both_end)
    assert row[1].end == []
