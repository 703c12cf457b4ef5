"""Operators that compare rows or learn from the corpus, against brute force and held-out rows."""

import collections
import contextlib
import itertools
import math
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmark.llm import crf, kneser_ney, prob_minhash, vectors
from glossmark.llm.common import held_out
from glossmark.llm.components import components
from glossmark.session import stage, staging_dir

SF = "/root/testdata/sf0.001"


def classes_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (203, 203)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = classes_of({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n in got}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b") is None


# ---- ProbMinHash


def brute_similarity(a, b):
    x, y = (collections.Counter(zip(*[t.split()[i:] for i in range(5)])) if len(t.split()) >= 5 else collections.Counter([tuple(t.split())]) for t in (a, b))
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_exact_similarity_equals_its_definition():
    rng = random.Random(2)
    hashes = prob_minhash._Hashes(0)
    for _ in range(40):
        a = " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        b = " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        sets = [prob_minhash.shingles(hashes.of(prob_minhash.words_of(t)), 5) for t in (a, b)]
        assert math.isclose(prob_minhash.probability_jaccard(*sets), brute_similarity(a, b), abs_tol=1e-12)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(3)
    element = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    x, y = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    exact = prob_minhash.probability_jaccard(*[(np.sort(e), w[np.argsort(e)]) for e, w in ((element[:300], x), (element[100:], y))])
    agree = []
    for turn in range(60):
        salt = np.uint64(int(rng.integers(0, 1 << 62)))
        e = prob_minhash.mixed(element ^ salt)
        owner = np.repeat([0, 1], 300)
        got = prob_minhash.signatures(owner, np.concatenate([e[:300], e[100:]]), np.concatenate([x, y]), 2)
        agree.append((got[0] == got[1]).mean())
    assert abs(np.mean(agree) - exact) < 0.02


@pytest.mark.parametrize("block", [1024, 5])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(3, 90))) for _ in range(30)]
    for i in range(60):
        words = texts[i % 12].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 999)}"
        texts.append(" ".join(words))
    texts += [texts[0] + "  ", "one two", "one two", "one  two", None, "", "", "\n", "word", "a b " * 300, "a b " * 301, "a b " * 300]
    rows = [(i * 3 % 211, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: (r.class_id, r.kept) for r in prob_minhash.label(df, block=block).collect()}
    links = [(a, b) for (a, s), (b, t) in itertools.combinations([(i, t) for i, t in rows if (t or "").split()], 2) if brute_similarity(s, t) >= 0.8]
    want = classes_of([i for i, _ in rows], links)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(kept == (i == want[i]) for i, (_, kept) in got.items())
    kept = prob_minhash.deduplicate(df, block=block)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u"), (None, "q r s t u"), (5, None), (5, None), (7, "m n o p q"), (7, "u v w x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in prob_minhash.deduplicate(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (None, "q r s t u"), (5, None), (5, None), (7, "m n o p q"), (7, "u v w x y")], key=str)
    assert prob_minhash.label(df.where("false")).count() == 0


# ---- vectors


@pytest.mark.parametrize("block", [1024, 8])
def test_vector_links_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(300):
        v = base[i % 12 if i < 150 else i % 30] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.3])
        rows.append((int(i * 7 % 1009), [float(x) for x in v * rng.choice([1e-30, 1.0, 1e30])], int(i % 12 % 3)))
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(20)]
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [], 1), (3003, [float("nan")] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1)]
    rows += [(3005, [float("inf")] * 16, 1), (3006, rows[0][1], None), (3007, rows[0][1], None), (3008, [1.0, 2.0], 1), (3009, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("links", F.lit(1)).withColumn("l", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, block=block).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = []
    for (a, x, i), (b, y, j) in itertools.combinations(good, 2):
        if i == j and len(x) == len(y):
            x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links.append((a, b))
    count = collections.Counter(x for p in links for x in p)
    want = classes_of([r[0] for r in rows], links)
    assert got == {i: (count[i], c, i == c) for i, c in want.items()}
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_passes_find_pairs_at_the_threshold(spark):
    """Recall of the passes alone, for pairs whose cosine is just the threshold, is at least 0.9."""
    rng = np.random.default_rng(6)
    a = rng.standard_normal((600, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((600, 32))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9305 * a + math.sqrt(1 - 0.9305**2) * side
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vectors.near_vectors(df).where("n_links > 0").count()
    assert got >= 0.9 * 1200


def crowded_pairs(n, pairs, mean, cosine, seed, size=64):
    """``n`` vectors with a mean cosine of ``mean``; the first ``2 * pairs`` are pairs at exactly ``cosine``."""
    rng = np.random.default_rng(seed)
    u = rng.standard_normal((n, size))
    u[:, 0] = 0
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, side = u[: 2 * pairs : 2], rng.standard_normal((pairs, size))
    side[:, 0] = 0
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = (cosine - mean) / (1 - mean)
    u[1 : 2 * pairs : 2] = near * a + math.sqrt(1 - near * near) * side
    v = math.sqrt(1 - mean) * u
    v[:, 0] = math.sqrt(mean)
    return v


@pytest.mark.parametrize("mean, block", [(0.8, 1024), (0.6, 16)])
def test_vectors_that_share_a_direction_keep_their_links(spark, mean, block):
    v = crowded_pairs(4000, 500, mean, 0.9301, 8)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in vectors.near_vectors(df, block=block).collect()}
    missed = sum(got[2 * i] != got[2 * i + 1] for i in range(500))
    assert missed <= 4


def test_crowded_labels_get_more_passes(spark):
    rows = [(i, i, x.tolist(), int(mean * 10)) for mean in (0.0, 0.6, 0.8) for i, x in enumerate(crowded_pairs(4000, 1, mean, 0.95, 9))]
    heads = spark.createDataFrame(rows, "node long, h long, v array<double>, g long")
    got = {r.g: r for r in vectors._passes(heads, vectors._means(heads), 0.93, 1e-3, 0).collect()}
    assert 1 < got[0].passes < got[6].passes < got[8].passes < vectors.MOST_PASSES
    assert all(r.window == vectors.window_of(4000) == 500 for r in got.values())
    # the label's own direction is taken out
    assert np.linalg.norm(got[8].mean) == pytest.approx(math.sqrt(0.8), abs=0.02)


def test_prefixes_and_passes():
    codes = np.array([0b000, 0b001, 0b010, 0b111], np.int64) << (vectors.BITS - 3)
    assert vectors.depths(codes, 1).tolist() == [3, 3, 2, 1] and vectors.depths(codes, 3).tolist() == [1, 1, 1, 1] and not vectors.depths(codes, 4).any()
    assert vectors.passes_for(np.array([0.5]), 1e-3) == 10 and vectors.passes_for(np.zeros(3), 0.5) == vectors.MOST_PASSES
    assert vectors.same_sign(np.array([1.0]), 0.93)[0] == pytest.approx(1 - math.acos(0.93) / math.pi)


def test_the_query_hashes_and_compares_windows(spark, monkeypatch):
    """On the given table every label is in several blocks and sorted several times; far fewer pairs meet than a label has."""
    from glossmark.llm.queries import op3_near_vectors

    seen = {}
    windows = vectors._windows

    def spy(turns, parts):
        seen["turns"], seen["blocks"] = turns, windows(turns, parts)
        return seen["blocks"]

    monkeypatch.setattr(vectors, "_windows", spy)
    op3_near_vectors(spark, SF).count()
    labels = seen["turns"].groupBy("g").agg(F.countDistinct("node").alias("n"), F.countDistinct("turn").alias("turns"), F.countDistinct("code").alias("codes")).collect()
    assert labels and all(r.n > 30 and r.turns > 3 and r.codes > r.n for r in labels)
    sizes = seen["blocks"].groupBy("g", "turn", "block").agg(F.count_if("own").alias("own"), F.count(F.lit(1)).alias("n")).collect()
    number = {r.g: r.n for r in labels}
    assert all(r.own <= vectors.window_of(number[r.g]) and r.n <= 2 * vectors.window_of(number[r.g]) < number[r.g] for r in sizes)


def test_vector_links_do_not_depend_on_partitions(spark):
    v = crowded_pairs(60, 30, 0.0, 0.9301, 12)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found[parts] = sorted(tuple(r) for r in vectors.near_vectors(df, block=16).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[1] == found[8] == found[200]
    assert [r[1] for r in found[1]] == [1] * 60


def test_vectors_of_two_sizes_in_one_label(spark):
    """Every second vector has another size; pairs at the threshold are found among both."""
    long, short = (crowded_pairs(1500, 300, 0.0, 0.9301, 13 + size, size) for size in (64, 32))
    rows = [(2 * i + k, x.tolist(), 0) for k, v in enumerate((long, short)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in vectors.near_vectors(df).collect()}
    missed = sum(got[4 * i + k] != got[4 * i + 2 + k] for i in range(300) for k in (0, 1))
    assert missed <= 4


def disk_used(spark):
    """Bytes of shuffle files and staged tables."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [f.getPath() for f in manager.localDirs()] + [staging_dir(spark).removeprefix("file:")]
    found = 0
    for path in (os.path.join(d, name) for top in tops for d, _, names in os.walk(top) for name in names):
        with contextlib.suppress(OSError):  # a file may go meanwhile
            found += os.path.getsize(path)
    return found


def test_vector_passes_keep_within_four_times_the_input(spark, monkeypatch):
    """Passes and block pairs in many rounds and stretches give the rows of one round, and no round leaves its vectors on disk."""
    v = crowded_pairs(12_000, 500, 0.3, 0.9301, 17).astype(np.float32)
    v[2000:2100] = v[2000] + np.random.default_rng(18).standard_normal((100, 64)).astype(np.float32) * 0.01
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    df = stage(df, "vectors")
    want = sorted(tuple(r) for r in vectors.near_vectors(df).collect())
    monkeypatch.setattr(vectors, "ROUND_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(vectors, "STRETCH", 2, raising=False)
    before, real, peak = disk_used(spark), vectors.stage, [0]

    def watched(*args, **more):
        out = real(*args, **more)
        least = disk_used(spark) - before
        for _ in range(30):  # files go a moment after their query
            if least <= 4 * v.nbytes:
                break
            time.sleep(0.1)
            least = min(least, disk_used(spark) - before)
        peak[0] = max(peak[0], least)
        return out

    monkeypatch.setattr(vectors, "stage", watched)
    got = sorted(tuple(r) for r in vectors.near_vectors(df, block=16).collect())
    assert got == want and sum(r[1] for r in got) > 9000
    assert peak[0] <= 4 * v.nbytes


def test_rank_among_cuts():
    rng = np.random.default_rng(19)
    cuts = sorted({(int(c), int(n)) for c, n in zip(rng.integers(0, 5, 40), rng.integers(0, 30, 40))})
    code, node = rng.integers(0, 6, 500), rng.integers(0, 31, 500)
    want = [sum(cut <= (c, n) for cut in cuts) for c, n in zip(code.tolist(), node.tolist())]
    assert vectors._rank(tuple(np.array(cuts).T), code, node).tolist() == want


def test_close_cosines_are_decided_in_double_precision():
    rng = np.random.default_rng(20)
    rows = rng.standard_normal((300, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    threshold = (rows[3] * rows[7]).sum()
    assert (vectors._above(rows, rows, threshold) == ((rows[:, None] * rows[None]).sum(2) >= threshold)).all()


# ---- language model


def direct_model(seqs):
    big, uni = collections.Counter(), collections.Counter()
    for q in seqs:
        big.update(zip(q, q[1:]))
        uni.update(q[1:])
    cont = collections.Counter(w for _, w in big)
    upper, lower = (kneser_ney.discounts([sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]) for t in (big, cont))
    cut = lambda c, d: [0, *d][min(c, 3)]
    rest = sum(cut(c, lower) for c in cont.values()) / max(1, len(big)) if big else 1.0
    total, freed = collections.Counter(), collections.Counter()
    for (v, _), c in big.items():
        total[v] += c
        freed[v] += cut(c, upper)

    def one(w):
        return (max(cont[w] - cut(cont[w], lower), 0) / len(big) if big else 0) + rest / (len(uni) + 1)

    def two(v, w):
        if v not in total:
            return one(w)
        return max(big[v, w] - cut(big[v, w], upper), 0) / total[v] + freed[v] / total[v] * one(w)

    return uni, two


@pytest.mark.parametrize("shards,mapped", [(None, True), (7, True), (3, False)])
def test_kneser_ney_equals_a_direct_model(spark, shards, mapped):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("the the the a b c d e F g".split()) + str(rng.randint(0, 3) or "") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    texts += [None, "", "The\tthe  \n THE", "ÉÉ éé", texts[0], "the " * 500]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("out", held_out(F.col("doc_id"), 7))
    model = kneser_ney.train(df.where("NOT out"), shards=shards)
    got = {r.doc_id: r.s for r in df.select("doc_id", kneser_ney.score_column(model, mapped)(F.col("text")).alias("s")).collect()}
    seqs = {i: [kneser_ney.BEGIN, *kneser_ney.words_of(t), kneser_ney.END] for i, t in rows}
    uni, two = direct_model([q for i, q in seqs.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    assert model.tokens == sum(uni.values()) and model.distinct == len(uni)
    for i, q in seqs.items():
        assert (got[i].n_tokens, got[i].n_known) == (len(q) - 1, sum(w in uni for w in q[1:]))
        assert math.isclose(got[i].score, sum(math.log10(two(v, w)) for v, w in zip(q, q[1:])), rel_tol=1e-9)
        assert math.isclose(got[i].base, sum(math.log10((uni[w] + 1) / (model.tokens + model.distinct + 1)) for w in q[1:]), rel_tol=1e-9)


def test_kneser_ney_without_training_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kneser_ney.train(df.where("false"))
    got = {r.doc_id: r.s for r in df.select("doc_id", kneser_ney.score_column(model)(F.col("text")).alias("s")).collect()}
    assert (model.tokens, got[1].n_tokens, got[1].n_known, got[1].score, got[2].n_tokens) == (0, 3, 0, 0.0, 1)


def test_packed_arrays_round_trip():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (kneser_ney.unpack(kneser_ney.pack(keys)) == keys).all()
    assert (kneser_ney.unplain(kneser_ney.plain(np.arange(70000))) == np.arange(70000)).all()


# ---- language identification


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(10)
    lengths = np.array([3, 1, 0, 4])
    e, moves = rng.standard_normal((8, 3)), rng.standard_normal((3, 3))
    post, expected, total = crf.posteriors(e, lengths, moves)
    want_post, want_moves, want_total, at = np.zeros_like(e), np.zeros((3, 3)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n)))
        score = np.array([sum(e[at + i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        p_all = np.exp(score - np.logaddexp.reduce(score))
        want_total += np.logaddexp.reduce(score)
        for p, w in zip(paths, p_all):
            for i, y in enumerate(p):
                want_post[at + i, y] += w
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += w
        at += n
    assert np.allclose(post, want_post) and np.allclose(expected, want_moves) and math.isclose(total, want_total)


def test_language_of_held_out_documents_and_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("out", held_out(F.col("doc_id"), 4))
    field = crf.train(docs.where("NOT out"), rows=60)
    got = docs.where("out").select("lang", crf.language(spark, field, F.col("text")).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang for r in got]) >= 0.95
    assert all(0 <= r.p.score <= 1 for r in got)
    one = {r.lang: r.text for r in docs.orderBy(F.length("text").desc()).collect()}
    parts = [(c, crf.words_of(one[c])[:40]) for c in ("de", "en", "fr")]
    words, post = next(crf.label_words(field, [" ".join(w for _, ws in parts for w in ws)]))
    labels = [field.languages[i] for i in post.argmax(1)]
    truth = [c for c, ws in parts for _ in ws]
    assert np.mean([a == b for a, b in zip(labels, truth)]) >= 0.9


def test_language_of_odd_rows(spark):
    rows = [(1, "de", "der die das und"), (2, "en", "the of and to"), (3, None, "was"), (4, "fr", None), (5, "en", "!!! 123"), (6, "de", " ")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("h", F.lit(1)).withColumn("language", F.lit(2))
    field = crf.train(df)
    got = {r.doc_id: r.p for r in df.select("doc_id", crf.language(spark, field, F.col("text")).alias("p")).collect()}
    assert [got[i].lang for i in (4, 5, 6)] == ["und"] * 3 and got[5].score == 0 and got[1].lang in ("de", "en")
    none = crf.train(df.where("false"))
    assert {r.p.lang for r in df.select(crf.language(spark, none, F.col("text")).alias("p")).collect()} == {"und"}
    single = crf.train(df.where("lang = 'en'"))
    assert df.where("doc_id = 1").select(crf.language(spark, single, F.col("text")).alias("p")).first().p.lang == "en"


def test_numbers_are_no_letters(spark):
    """Superscripts, fractions, circled and letter numbers make no word; letters around them do."""
    assert crf.words_of("½ ² ① Ⅷ _ 12") == [] and crf.words_of("x² Ab①cd É") == ["x", "ab", "cd", "é"]
    rows = [("aa bb", "x")] * 4 + [("cc dd", "y")] * 4
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string")
    field = crf.train(df)
    got = spark.createDataFrame([("½ ² ① Ⅷ",), ("12",), (None,), ("aa²",)], "t string").select(crf.language(spark, field, F.col("t")).alias("p"))
    assert [r.p.lang for r in got.collect()] == ["und", "und", "und", "x"]


def test_a_language_with_one_row_is_learned():
    words = {c: [f"{c}{v}{c}" for v in "aeiou"] for c in "bcdfg"}
    rows = [(c, " ".join(words[c])) for c in "bcdf" for _ in range(12)] + [("g", " ".join(words["g"] * 3))]
    field = crf.fit(rows)
    ((_, post),) = crf.label_words(field, [" ".join(words["g"])])
    assert field.languages[int(post.mean(0).argmax())] == "g"


def test_mixed_texts_fit_whatever_the_number_of_languages(spark):
    """Four equal parts in a fit with ten languages: no share prevails, but every word fits one."""
    import corpus_pipeline

    words = {c: [f"{c}{v}{c}{w}" for v in "aeiou" for w in "aeiou"] for c in "bcdfghjklm"}
    rng = random.Random(3)
    rows = [(f"lang-{c}", " ".join(rng.choice(words[c]) for _ in range(40))) for c in words for _ in range(8)]
    mixed = " ".join(" ".join(rng.choice(words[c]) for _ in range(20)) for c in "bcdf")
    frame = [(i, t, c, "s", len(t)) for i, (c, t) in enumerate(rows)] + [(500, mixed, None, "s", len(mixed)), (501, "12 ½", None, "s", 4), (502, None, None, "s", None)]
    docs = spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == set(range(len(rows))) | {500}
