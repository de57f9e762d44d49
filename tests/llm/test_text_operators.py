"""Token counts, subword encoding, likelihood, quality and toxicity beside brute-force versions."""

import collections
import itertools
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fareindex.llm import divergence, lattice_lm, sentencepiece_codec as codec, token_counts, toxicity
from fareindex.llm.common import bucket

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, ids string, score string"
WORDS = "the cat sat on a mat and was, is. or To be naïve über 東京 😀 don't 1234 <b> # ...".split()


def texts():
    rng = random.Random(3)
    made = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(40)]
    return made + ["", None, " ", "\n\n\t x", "  two  spaces ", "a<|endoftext|>b<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", "x" * 3000, "é\u0301\u200b", made[0], made[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else "fr", "s", 0, "clash", "clash", "clash", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [(None, "no id", None, None, None, None, None, None, None), rows[0]], SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_the_library(spark, docs):
    library = Tokenizer.from_file(BPE)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    rows = token_counts.count_tokens(docs, BPE, 20).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 20) for r in rows)
    assert token_counts.count_tokens(empty(spark), BPE).count() == 0


def test_long_pre_tokens_equal_the_library():
    merges, library, rng = token_counts.merge_table(BPE), Tokenizer.from_file(BPE), random.Random(2)
    made = ["".join(rng.choices(letters, k=n)) for letters in ("etaoinshrdlu", "aab", "東京都中国日本語", "=-#") for n in (511, 512, 513, 4000)]
    made += [c * n for c in ("a", "ab", "=", "=-") for n in (600, 601, 3001)] + [" " + "th" * 700, "x" * 700 + " the " + "the" * 400]
    assert merges.count_texts(made) == [len(library.encode(t, add_special_tokens=False).ids) for t in made]
    assert not any(len(t) > token_counts.CACHE_CHARS for t in merges.cache)


def test_a_megabyte_without_spaces():
    rng = random.Random(4)
    text = "".join(rng.choices("etaoinshrdlucmfwyp", k=1_000_000))
    start = time.monotonic()
    parts = token_counts.merge_table(BPE).count_texts([text])[0]
    p = codec.load_pieces(MODEL)
    value = lattice_lm.log_marginals(p, lattice_lm.vocabulary_weights(p), [codec.SPACE + text])[0]
    assert 300_000 < parts < 800_000 and -math.inf < value < 0
    assert time.monotonic() - start < 120


def whole_lattice(p, written):
    """Viterbi with every position held."""
    best, back = [0.0] + [-math.inf] * len(written), [None] * (len(written) + 1)
    for s in range(len(written)):
        single = False
        for k in range(1, min(p.longest, len(written) - s) + 1):
            if (got := p.id_of.get(written[s : s + k])) is not None:
                single |= k == 1
                if best[s] + got[1] > best[s + k]:
                    best[s + k], back[s + k] = best[s] + got[1], (s, [got[0]])
        if not single and best[s] + p.unknown_score > best[s + 1]:
            best[s + 1], back[s + 1] = best[s] + p.unknown_score, (s, p.unmatched(written[s]))
    out, at = [], len(written)
    while at:
        at, ids = back[at][0], back[at][1]
        out = ids + out
    return out


def test_streaming_equals_whole_lattice(docs):
    p = codec.load_pieces(MODEL)
    for r in codec.encode(docs, MODEL).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        written = codec.SPACE + r.text.replace(" ", codec.SPACE) if r.text else ""
        assert r.ids == whole_lattice(p, written), r.text
        assert r.round_trip and r.n_ids == len(r.ids)


@pytest.mark.parametrize("step", [1, 3, 50])
def test_stream_in_parts_and_its_window(step):
    p = codec.load_pieces(MODEL)
    rng = random.Random(5)
    written = "".join(rng.choices("abcdeilnorstuéü", k=4000)) + codec.SPACE * 40 + "end"
    stream, out, widest = codec.StreamingViterbi(p), [], 0
    for i in range(0, len(written), step):
        out += stream.feed(written[i : i + step])
        widest = max(widest, stream.at)
    out += stream.finish()
    assert out == whole_lattice(p, written)
    assert widest < 20 * p.longest  # ids are given out on the way, not at the end


def test_scores_are_those_of_the_model():
    p, library = codec.load_pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, _, scores = codec.encode_texts(p, ["the cat and"])
    assert scores[0] == pytest.approx(sum(library.get_score(i) for i in ids.tolist()))


def test_encoding_of_odd_rows(spark, docs):
    rows = {r.doc_id: r for r in codec.encode(docs, MODEL).collect()}
    assert rows[40].ids == [] and rows[41].ids == [] and rows[41].round_trip and rows[None].n_ids > 0
    assert codec.encode(docs, MODEL).count() == docs.count() and codec.encode(empty(spark), MODEL).count() == 0
    back = {r.doc_id: r.text for r in codec.decode(codec.encode(docs, MODEL), MODEL).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts()))


def segmentations(p, log_p, written):
    """Sum over all segmentations, one by one."""
    if not written:
        return 1.0
    total, single = 0.0, False
    for k in range(1, min(p.longest, len(written)) + 1):
        if (got := p.id_of.get(written[:k])) is not None:
            single |= k == 1
            total += math.exp(log_p[got[0]]) * segmentations(p, log_p, written[k:])
    return total if single else total + math.exp(sum(log_p[i] for i in p.unmatched(written[0]))) * segmentations(p, log_p, written[1:])


def test_marginals_and_expected_counts():
    p = codec.load_pieces(MODEL)
    log_p = lattice_lm.vocabulary_weights(p)
    strings = ["▁the", "▁and", "▁x", "▁naïve", "▁東😀b", "▁the"]
    got = lattice_lm.log_marginals(p, log_p, strings)
    assert got == pytest.approx([math.log(segmentations(p, log_p, s)) for s in strings])
    counts = lattice_lm.expected_counts(p, log_p, strings, np.ones(len(strings)))
    step = 1e-6
    for piece in ("▁the", "h", "and"):  # the expected count is the slope of the log marginal
        moved = log_p.copy()
        moved[p.id_of[piece][0]] += step
        slope = (lattice_lm.log_marginals(p, moved, strings) - got).sum() / step
        assert counts[p.id_of[piece][0]] == pytest.approx(slope, abs=1e-4)


def test_long_strings_equal_short_ones(monkeypatch):
    p, rng = codec.load_pieces(MODEL), random.Random(6)
    log_p = lattice_lm.vocabulary_weights(p)
    strings = [codec.SPACE + "".join(rng.choices("abcdeilnorstué東😀", k=n)) for n in (1, 63, 64, 65, 200, 1000)] + ["x" * 300, "the"]
    times = np.arange(1.0, len(strings) + 1)
    monkeypatch.setattr(lattice_lm, "LONG", 10**9)
    together, counts = lattice_lm.log_marginals(p, log_p, strings), lattice_lm.expected_counts(p, log_p, strings, times)
    for limit in (0, 64):
        monkeypatch.setattr(lattice_lm, "LONG", limit)
        assert lattice_lm.log_marginals(p, log_p, strings) == pytest.approx(together, rel=1e-12)
        assert lattice_lm.expected_counts(p, log_p, strings, times) == pytest.approx(counts, rel=1e-8, abs=1e-12)


def test_score_of_a_text_sums_all_its_segmentations(spark):
    rows = [(1, "the cat", "x"), (2, None, "x"), (3, "", "x"), (4, "Und 東 x", "x"), (1, "the cat", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    counts = lattice_lm.word_counts(frame.select("text"))
    model = lattice_lm.fit_pieces(counts, frame.count(), MODEL)
    p = codec.load_pieces(MODEL)
    got = lattice_lm.score(frame, counts, frame.count(), model, MODEL, F.lit(False)).collect()
    want = [(math.log(math.prod(segmentations(p, model.log_p, codec.SPACE + w) for w in (t or "").lower().split())) + model.end) / math.log(10) for _, t, _ in rows]
    assert sorted(r.score for r in got) == pytest.approx(sorted(want))


@pytest.mark.parametrize("head", [3, 10_000])
def test_likelihood_base(docs, spark, head):
    held = bucket(F.col("doc_id"), 5) == 1
    rows = lattice_lm.fit_and_score(docs, MODEL, held, lattice_lm.Training(head_words=head)).collect()
    tokens = lambda t: (t or "").encode().lower().split() + ["end"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = collections.Counter(w for r in docs.collect() if not out(r.doc_id) for w in tokens(r.text))
    total, below = sum(seen.values()), sum(seen.values()) + 0.5 * (len(seen) + 1)
    want = sorted((r.doc_id or -1, len(tokens(r.text)), sum(seen[w] > 0 for w in tokens(r.text)), round(sum(math.log10((seen[w] + 0.5) / below) for w in tokens(r.text)), 6)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {total} and all(r.held_out == out(r.doc_id) for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lattice_lm.fit_and_score(empty(spark), MODEL, held).count() == 0


def plain_counts(text):
    words = (text or "").encode().split()
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, again = (text or "").split("\n"), [], 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            again += line in seen
            seen.append(line)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(inside)


def test_quality_counts(spark, docs):
    more = ["a b c a b c a", "a a a a a", "x y\nx y\n\nx y\n z", "# | <b> $\n#", "w " * 60, "one two three " * 40]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1000 + i, t, "xx") for i, t in enumerate(more)], "doc_id long, text string, lang string"))
    by_id = {r.doc_id: r for r in divergence.assess(frame, divergence.language_references(frame)).collect()}
    for r in frame.collect():
        got = by_id[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == plain_counts(r.text), r.text
        assert got.base_failed == (got.n_words < 50 or 100 * got.n_repeat_words > 50 * got.n_words) and not (got.base_failed and got.kept)
    assert divergence.language_references(empty(spark)) == {} and divergence.assess(empty(spark), {}).count() == 0


def test_quality_distance_and_guards(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choices("the of and to in is it was for on with as".split() + [f"word{i}" for i in range(300)], k=150)) for _ in range(60)]
    junk = [clean[0].upper(), " ".join(w + "###$$" for w in clean[1].split())]
    rows = [(i, t, "en", "keep") for i, t in enumerate(clean + junk + ["SHORT BUT FINE " * 2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    refs = divergence.language_references(frame)
    kept = {r.doc_id for r in divergence.keep(frame, refs).collect()}
    assert kept == set(range(60)) and divergence.keep(frame, refs).columns == frame.columns
    p, q = np.array([1.0, 3.0]), np.array([0.5, 0.5])
    m = (p / 4 + q) / 2
    assert divergence.distance(p, q) == pytest.approx(math.sqrt(sum(a * math.log2(a / b) for a, b in zip(p / 4, m)) / 2 + sum(a * math.log2(a / b) for a, b in zip(q, m)) / 2))
    assert divergence.distance(np.array([0.0, 1.0]), np.array([1.0, 0.0])) == pytest.approx(1.0)
    assert divergence.distances("x" * 50, divergence.measure("x" * 50), refs["en"], divergence.Rules()) == (None, None)


def test_quality_of_rare_and_missing_languages(spark):
    rng = random.Random(9)
    some = lambda letters, n=90: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n)) + "."
    latin, kanji, signs = "aeioutnrs", "東京都中国日本語海山川空", "#$%&*@~^0123456789"
    rows = [(i, some(latin), "en") for i in range(400)]
    rows += [(1000, some(latin), None), (1001, some(latin), "zz"), (1002, some(latin).upper(), None), (1003, some(kanji), "ja"),
             (1004, some(kanji).replace(" ", "。 "), None), (2000, some(signs), None), (2001, some(signs), "zz"), (2002, "", None), (2003, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rules = divergence.Rules(min_share=0.005)  # two rows of 409 are a language
    refs = divergence.language_references(frame, rules)
    assert set(refs) == {"en", divergence.POOLED} and refs[None].pooled and refs[None].classes.sum() == pytest.approx(1)
    by_id = {r.doc_id: r for r in divergence.assess(frame, refs, rules).collect()}
    assert {i for i, r in by_id.items() if r.kept} == set(range(400)) | {1000, 1001, 1002, 1003, 1004}
    assert all(by_id[i].class_distance > rules.pooled_limit and by_id[i].word_distance is None for i in (2000, 2001))
    assert {r.doc_id for r in divergence.keep(frame, refs, rules).collect()} == {i for i, r in by_id.items() if r.kept}
    ample = divergence.Rules(min_share=0.5, ample_rows=2)
    assert set(divergence.language_references(frame, ample)) == {"en", "zz", None}
    nameless = divergence.language_references(frame.withColumn("lang", F.lit(None).cast("string")))
    assert set(nameless) == {None}
    assert divergence.language_references(frame.filter("doc_id >= 2002")) == {}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    plain = [f"w{i}x" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.choices(plain, k=60) + (["morontrash", "Scum!"] if toxic else [])), "clash"))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(rows + [(None, None, None), (700, "", None), rows[0]], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, marks, toxicity.not_held_out())
    got = [r for r in toxicity.score(frame, model).collect()]
    assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    assert toxicity.keep(frame, model).columns == frame.columns
    one_class = toxicity.fit(frame, marks.filter("toxic = 0"))
    assert one_class.weights.sum() == 0 and toxicity.fit(empty(spark), marks).bias == 0.0


def test_naive_bayes_ratios_scale_the_features():
    chosen = toxicity.present("trash")
    assert set(toxicity.present("TRASH\n")) <= set(toxicity.present(" trash ")) | set(toxicity.present("trash \n")) and len(chosen) == 5 + 4 + 3
    assert len(set(itertools.chain(toxicity.present(None), toxicity.present("")))) == 0


def toxic_rows(spark, n=60):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices("sun tree lake good warm kind".split(), k=12) + (["vile", "scum"] if i % 3 == 0 else [])), "en", "s", 0, None, None, None, None) for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int"), rows


def test_weights_are_the_log_count_ratios_times_the_minimiser(spark):
    frame, marks, rows = toxic_rows(spark)
    training = toxicity.Training(features=40, rounds=60)
    model = toxicity.fit(frame, marks, training=training)
    have = [set(toxicity.present(r[1]).tolist()) for r in rows]
    label = np.array([i % 3 == 0 for i in range(len(rows))])
    counts = {b: (sum(b in h for h, y in zip(have, label) if y), sum(b in h for h, y in zip(have, label) if not y)) for b in set().union(*have)}
    a, b = (sum(c[k] + 1 for c in counts.values()) for k in (0, 1))
    ratio = {k: math.log((x + 1) / a) - math.log((y + 1) / b) for k, (x, y) in counts.items()}
    sure = {k: abs(ratio[k]) / math.sqrt(1 / (x + 1) + 1 / (y + 1)) for k, (x, y) in counts.items()}
    chosen = sorted(counts, key=lambda k: (-sure[k], k))[:40]
    assert set(np.flatnonzero(model.weights).tolist()) <= set(chosen)
    x = np.array([[ratio[k] if k in h else 0.0 for k in chosen] for h in have])
    theta = np.array([model.weights[k] / ratio[k] for k in chosen])
    weight = np.where(label, training.toxic_weight, 1.0)

    def loss(t, bias):
        m = x @ t + bias
        return (weight * np.logaddexp(0, np.where(label, -m, m))).sum() / weight.sum() + training.penalty / 2 * t @ t

    best = loss(theta, model.bias)
    rng = np.random.default_rng(1)
    assert all(loss(theta + d, model.bias + e) >= best - 1e-4 for d, e in ((rng.normal(0, 0.05, 40), rng.normal(0, 0.05)) for _ in range(50)))
    scores = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert scores == pytest.approx({i: 1 / (1 + math.exp(-m)) for i, m in enumerate(x @ theta + model.bias)})


def test_gradient_is_that_of_the_loss(spark):
    rows = spark.createDataFrame([(1, [0, 2], [0.5, -1.0]), (0, [1], [2.0]), (0, [], []), (1, [0, 1, 2], [0.5, 2.0, -1.0])], "label int, at array<int>, ratio array<double>")
    at = np.array([0.3, -0.2, 0.1, 0.05])
    evaluate = lambda t: toxicity._objective(rows, 7.0, 3, t, 0.01, 1.5, 2.0)
    value, slope = evaluate(at)
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        assert (evaluate(at + step)[0] - evaluate(at - step)[0]) / 2e-5 == pytest.approx(slope[k], abs=1e-6)


def test_learning_reads_a_bounded_number_of_rows(spark):
    frame, marks, rows = toxic_rows(spark, 600)
    taken, seen, part = toxicity.labelled(frame, marks, F.lit(True), 50)
    assert seen[0] + seen[1] == taken.count() and all(20 <= n <= 90 for n in seen.values()) and part[0] == pytest.approx(50 / 400)
    assert all(a == b for a, b in zip(sorted(r.text for r in taken.collect()), sorted(r.text for r in toxicity.labelled(frame, marks, F.lit(True), 50)[0].collect())))
    # One id on a third of all rows is thinned too.
    many = spark.createDataFrame(rows + [rows[3]] * 600, SCHEMA)
    _, seen, part = toxicity.labelled(many, marks, F.lit(True), 400)
    assert seen[1] < 520 and part[1] < 0.6
