"""Translation metrics against hand-computed and brute-force values."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossmark.functions.text import plain_tokens
from glossmark.operators import metrics as mt
from glossmark.operators import shifts as shifts_module
from glossmark.operators import segments as sg
from glossmark.plans import jobs


def segments(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seg_id long, hyp string, ref0 string, ref1 string")


def bleu(spark, rows, refs=("ref0", "ref1"), **options):
    stats = mt.bleu_stats(segments(spark, rows), ["seg_id"], list(refs), plain_tokens, **options)
    return mt.corpus_bleu(stats, []).first()


def test_identity_is_100(spark):
    same = "the cat sat on the mat"
    row = bleu(spark, [(same, same, "something else")])
    assert row.bleu == pytest.approx(100) and row.brevity_penalty == 1


def test_closest_reference_prefers_the_shorter(spark):
    row = bleu(spark, [("a b c d e", "a b c d", "a b c d e f")])
    assert (row.hyp_len, row.ref_len) == (5, 4)


def test_empty_and_short_hypotheses(spark):
    assert bleu(spark, [("", "a b c d", "a")]).bleu == 0
    assert bleu(spark, [("a b", "a b", "a b")]).bleu == 0  # no 3- or 4-grams


def test_clipping_uses_the_best_reference(spark):
    row = bleu(spark, [("the the the cat", "the cat", "the the dog")])
    assert row.precision_1 == pytest.approx(75.0)


def test_brevity_penalty(spark):
    row = bleu(spark, [("a b c d", "a b c d e f g h", "a b c d e f g h")])
    assert row.brevity_penalty == pytest.approx(math.exp(1 - 8 / 4))
    assert row.bleu == pytest.approx(100 * math.exp(-1))


def test_lowercase_is_ascii_only(spark):
    stats = mt.bleu_stats(segments(spark, [("A b É", "a B é", "")]), ["seg_id"], ["ref0"], plain_tokens, lowercase=True)
    assert stats.first().match_1 == 2


def test_chrf(spark):
    rows = segments(spark, [("abc", "abc", ""), ("", "x", "")])
    stats = mt.chrf_stats(rows.filter("seg_id = 0"), ["seg_id"], "ref0")
    assert mt.corpus_chrf(stats, []).first().chrf == pytest.approx(100)
    row = mt.chrf_stats(segments(spark, [("ab", "abc", "")]), ["seg_id"], "ref0").first()
    assert [row[f"{n}_{k}"] for k in (1, 2, 3, 4) for n in ("hyp", "ref", "match")] == [2, 3, 2, 1, 2, 1, 0, 1, 0, 0, 0, 0]
    # orders 1 and 2 count: precision (1 + 1) / 2, recall (2/3 + 1/2) / 2
    score = mt.corpus_chrf(mt.chrf_stats(segments(spark, [("ab", "abc", "")]), ["seg_id"], "ref0"), []).first().chrf
    p, r = 1.0, (2 / 3 + 1 / 2) / 2
    assert score == pytest.approx(100 * 5 * p * r / (4 * p + r))


def direct_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits_by_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "bb", "ccc", "é", "日本"]
    rows = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(2)) + ("",) for _ in range(60)]
    got = {r.seg_id: r.edits for r in mt.edit_stats(segments(spark, rows), ["seg_id"], "ref0").collect()}
    assert got == {i: direct_edits(h.split(), r.split()) for i, (h, r, _) in enumerate(rows)}


def test_many_distinct_words_stay_distinct(spark):
    a = " ".join(f"w{i}" for i in range(40000))
    b = " ".join(f"w{i}" for i in range(1, 40001))
    row = mt.edit_stats(segments(spark, [(a, b, "")]).limit(1), ["seg_id"], "ref0")
    coded = row.first()
    assert (coded.edits, coded.ref_words) == (2, 40000)


def test_bootstrap_weights_are_poisson(spark):
    stats = spark.range(4000).selectExpr("id", "1 AS one")
    scores = mt.bootstrap_scores(stats, [], F.col("id").cast("string"), ["one"], F.col("one") / 4000, 50, 1)
    values = [r.score for r in scores.collect()]
    assert len(values) == 50
    assert sum(values) / 50 == pytest.approx(1, abs=0.02)
    spread = math.sqrt(sum((v - 1) ** 2 for v in values) / 50)
    assert spread == pytest.approx(1 / math.sqrt(4000), rel=0.35)


def test_accuracy_and_f1(spark):
    rows = [("A", "A"), ("A", "O"), ("O", "B"), ("B", "A"), ("O", "O")]
    df = spark.createDataFrame(rows, "label string, predicted string")
    assert mt.accuracy(df, []).first().accuracy == pytest.approx(40)
    assert mt.micro_f1(df, []).first().f1 == pytest.approx(200 * 1 / (3 + 3))


def direct_counts(sides, orders):
    """Hypothesis, first reference and clipped matches per order."""
    out = []
    for n in range(1, orders + 1):
        grams = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in sides]
        best = {g: min(c, max(r[g] for r in grams[1:])) for g, c in grams[0].items()}
        out += [sum(grams[0].values()), sum(grams[1].values()), sum(best.values())]
    return out


@pytest.mark.parametrize("slice_tokens", [1_000_000, 40])
def test_batch_counts_by_brute_force(slice_tokens, monkeypatch):
    monkeypatch.setattr(sg, "SLICE_TOKENS", slice_tokens)
    rng = random.Random(2)
    rows = [[[rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(3)] for _ in range(50)]
    got = []
    sizes = np.array([sum(map(len, r)) for r in rows])
    for a, b in sg._slices(sizes):
        sides = []
        for k in range(3):
            tokens = np.array([ord(t) - 97 for r in rows[a:b] for t in r[k]], np.int64)
            sides.append((tokens, np.repeat(np.arange(b - a), [len(r[k]) for r in rows[a:b]])))
        got += sg._count(sides, b - a, 4).tolist()
    assert got == [direct_counts(r, 4) for r in rows]


def test_counts_need_no_shuffle(spark):
    rows = spark.range(0, 100, 1, 16).selectExpr("id AS seg_id", "'a b' AS hyp", "'a c' AS ref0")
    for stats in (mt.bleu_stats(rows, ["seg_id"], ["ref0"]), mt.chrf_stats(rows, ["seg_id"], "ref0", 2), mt.edit_stats(rows, ["seg_id"], "ref0")):
        assert "Exchange" not in stats._jdf.queryExecution().executedPlan().toString()


def test_resamples_weigh_every_segment_alike(spark):
    """Sums of a resample do not depend on how segments are spread over tasks and batches."""
    stats = spark.range(300).selectExpr("id", "id % 3 AS g", "id * 7 AS x")

    def sums(df):
        scores = mt.bootstrap_scores(df, ["g"], F.col("id").cast("string"), ["x"], F.col("x"), 30, 5)
        return sorted((r.g, r.resample, r.score) for r in scores.collect())

    assert sums(stats.repartition(1)) == sums(stats.repartition(7))


def test_metric_report_does_not_smooth(spark):
    rows = spark.createDataFrame([(i, "a b c d e f", "a x c y e z") for i in range(20)], "seg_id long, hyp string, ref string")
    found = {r.metric: r.mean for r in jobs.metric_report(rows, [], resamples=40).collect()}
    assert found["BLEU"] == found["BLEU-mteval"] == 0
    smooth = {r.metric: r.mean for r in jobs.metric_report(rows, [], resamples=40, smooth=True).collect()}
    assert smooth["BLEU"] > 0


def test_subword_bleu_counts_the_library_pieces(spark):
    """Pieces are the library's, and the report names its row after them; counts equal those over the pieces as words."""
    import public_tokenizers
    import sentencepiece

    from glossmark.functions.text import sentence_pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["The cat sat on the mat.", "  odd  blanks\tand signs ½ é 日本", "", None, "Der Donaudampfschifffahrtskapitän"]
    rows = spark.createDataFrame([(i, t, t if i % 2 else (t or "") + " more") for i, t in enumerate(texts)], "seg_id long, hyp string, ref string")
    cut = sentence_pieces(path)
    got = rows.select("seg_id", cut(F.col("hyp")).alias("p")).collect()
    assert all(r.p == model.encode(texts[r.seg_id] or "", out_type=str) for r in got)
    spaced = rows.select("seg_id", *[F.array_join(cut(F.col(c)), " ").alias(c) for c in ("hyp", "ref")])
    whole = lambda df, t: mt.corpus_bleu(mt.bleu_stats(df, ["seg_id"], ["ref"], t), []).first()
    assert whole(rows, cut) == whole(spaced, lambda c: F.filter(F.split(c, " "), lambda w: w != ""))
    report = {r.metric: r.mean for r in jobs.metric_report(rows, [], cut, resamples=40).collect()}
    assert set(report) == {"spBLEU", "BLEU", "chrF2++", "chrF2", "edit_rate"}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_ter(hyp, ref):
    """The greedy search written out: every run of the hypothesis at every place the rules allow, plain edit distances."""
    if not ref:
        return int(bool(hyp))
    shifts = 0
    while True:
        place, wrong_ref, wrong_hyp = shifts_module.Reference(ref).aligned(hyp)
        found = []
        for i in range(len(hyp)):
            for length in range(1, min(10, len(hyp) - i) + 1):
                for j in range(len(ref) - length + 1):
                    if hyp[i : i + length] != ref[j : j + length] or not any(wrong_hyp[i : i + length]) or not any(wrong_ref[j : j + length]) or i <= place[j] < i + length:
                        continue
                    for k in range(j - 1, j + length):
                        to = 0 if k < 0 else place[k] + 1
                        rest = hyp[:i] + hyp[i + length :]
                        at = to if to <= i else max(i, to - length)
                        found.append((plain_distance(hyp, ref) - plain_distance(rest[:at] + hyp[i : i + length] + rest[at:], ref), length, -i, -to, at))
        if not found or max(found)[0] <= 0:
            return shifts + plain_distance(hyp, ref)
        _, length, i, _, at = max(found)
        rest = hyp[:-i] + hyp[-i + length :]
        hyp, shifts = rest[:at] + hyp[-i : -i + length] + rest[at:], shifts + 1


def test_ter_equals_the_search_written_out(spark):
    rng = random.Random(2)
    pairs = [("b c a", "a b c"), ("", "a"), ("a", ""), ("", ""), ("the cat sat on", "on the cat sat"), ("A B", "a b"), ("x y z", "p q")]
    for _ in range(150):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(words))
        turned = words[cut:] + words[:cut]
        if turned and rng.random() < 0.5:
            turned[rng.randrange(len(turned))] = "z"
        pairs.append((" ".join(turned), " ".join(words)))
    for hyp, ref in pairs:
        h, r = hyp.lower().split(), ref.lower().split()
        assert shifts_module.Reference(r).distance(h) == plain_distance(h, r)
        assert shifts_module.edits(h, r) == plain_ter(h, r), (hyp, ref)
    assert shifts_module.edits("on the cat sat".split(), "the cat sat on".split()) == 1
    rows = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)] + [(999, None, "a b"), (1000, "q", None)], "seg_id long, hyp string, ref string")
    got = {r.seg_id: (r.edits, r.ref_words) for r in shifts_module.ter_stats(rows, ["seg_id"], "ref").collect()}
    assert all(got[i] == (plain_ter(h.lower().split(), r.lower().split()), len(r.split())) for i, (h, r) in enumerate(pairs))
    assert got[999] == (2, 2) and got[1000] == (1, 0)
    report = {r.metric: r.mean for r in jobs.metric_report(rows, [], resamples=40, shifts=True).collect()}
    assert 0 < report["TER"] < report["edit_rate"]


def test_exact_resamples_draw_every_group_whole(spark):
    """Weights of every resample add up to the group's size, whatever the buckets and partitions, and vary as draws with replacement do."""
    rows = spark.createDataFrame([(f"s{i}", "a" if i < 300 else "b", 1 << (i % 3 * 20), i) for i in range(340)], "k string, lang string, bit long, x long")
    got = {}
    for parts in (1, 5):
        sums = sg.exact_resample_sums(rows.repartition(parts), ["lang"], "k", ["bit", "x"], 200, 7, bucket_rows=32)
        got[parts] = sorted(tuple(r) for r in sums.collect())
    assert got[1] == got[5] and len(got[1]) == 400
    for lang, n in (("a", 300), ("b", 40)):
        mine = [r for r in got[1] if r[0] == lang]
        assert all(r[2] == n for r in mine)
        assert all((r[3] & 0xFFFFF) + (r[3] >> 20 & 0xFFFFF) + (r[3] >> 40) == n for r in mine)
        values = [i for i in range(340) if (i < 300) == (lang == "a")]
        means = np.array([r[4] / n for r in mine])
        assert abs(means.mean() - np.mean(values)) < 4 * np.std(values) / math.sqrt(n * 200)
        assert means.std() == pytest.approx(np.std(values) / math.sqrt(n), rel=0.2)
    report = jobs.metric_report(rows.selectExpr("k AS seg_id", "lang", "'a b c d e' AS hyp", "'a b c d x' AS ref"), ["lang"], resamples=40, exact=True)
    assert report.where("metric = 'edit_rate' AND mean = 20 AND se = 0").count() == 2


def test_batches_cut_texts_as_the_columns_do(spark):
    """Words, marks at word edges, mteval tokens and characters of a batch are those of the column functions, whatever the text."""
    from glossmark.functions import text as tx

    rng = random.Random(5)
    signs = list("ab9 .,-&<>;'\"\t\n\x0b\x1c\x85\xa0 　é日😀") + ["&quot;", "-\n", "<skipped>", "...", " , "]
    texts = ["", " ", ".", "..", "a."] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i")
    want = rows.select(
        tx.plain_tokens(F.col("t")), tx.edge_split_words(F.col("t")), tx.mteval_tokens(F.col("t")), F.regexp_replace("t", r"(?U)\s+", "")
    ).collect()
    column = pa.array(texts)

    def lists(words, owner):
        out = [[] for _ in texts]
        for w, i in zip(words.to_pylist(), owner.tolist()):
            out[i].append(w)
        return out

    assert lists(*sg._words(column)) == [r[0] for r in want]
    assert lists(*sg._edge_split(*sg._words(column))) == [r[1] for r in want]
    assert lists(*sg._words(tx.mteval_texts(column))) == [r[2] for r in want]
    codes, owner = sg._characters(column)
    assert ["".join(map(chr, codes[owner == i])) for i in range(len(texts))] == [r[3] for r in want]


def test_mteval_tokens_are_those_of_the_published_rules(spark):
    from glossmark.functions import text as tx

    texts = ["a,b, ,c ,. ..5 5-6-x", "{x} & y -\nz &lt;p&gt; 1,000. 2.", ". . , ,1 ..", "..5 ...6 ,.7 8.,"]
    text = F.col("t")
    for literal, replacement in tx.MTEVAL_CLEANUP:
        text = F.regexp_replace(text, literal, replacement)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in tx.MTEVAL_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select(tx.mteval_tokens(F.col("t")).alias("got"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("want")).collect():
        assert r.got == r.want


def test_counts_number_runs_anew_when_they_would_not_fit():
    """Large token numbers: the runs of higher orders do not fit 64 bits; counts stay those of brute force."""
    rng = random.Random(3)
    rows = [[[rng.choice([0, 5, 1 << 20, (1 << 22) + 1]) for _ in range(rng.randint(0, 12))] for _ in range(2)] for _ in range(40)]
    sides = [(np.array([t for r in rows for t in r[k]], np.int64), np.repeat(np.arange(40), [len(r[k]) for r in rows])) for k in range(2)]
    assert sg._count(sides, 40, 6).tolist() == [direct_counts(r, 6) for r in rows]


def test_draws_are_the_digests():
    import hashlib

    heads = [f"12345|{b}|".encode() for b in range(12)]
    keys = ["", "7-1", "12-3", "é" * 9, "x" * 44, "x" * 70, "99"]
    got = sg.md5_words(heads, [k.encode() for k in keys])
    for i, k in enumerate(keys):
        for j, h in enumerate(heads):
            assert got[i, j].tolist() == np.frombuffer(hashlib.md5(h + k.encode()).digest(), ">u4").tolist()


def test_report_counts_in_one_pass_of_one_worker(spark):
    """All counts of a report are one Python step, and no count runs a shuffle of its own."""
    rows = spark.createDataFrame([(i, "a b c d", "a b x d") for i in range(8)], "seg_id long, hyp string, ref string")
    counts, numbers, _ = jobs._metrics(None, False, True)
    table = rows.select("seg_id", *[c.alias(n) for n, c in counts.items()]).select("seg_id", *[n for part in numbers.values() for n in part])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_edit_counts_of_long_texts_stay_quick(spark):
    """Edits are counted on bit vectors: two texts of 20,000 words are 20,000 steps, not 400 million cells."""
    import time

    a = " ".join(str(i % 977) for i in range(20_000))
    b = " ".join(str(i % 971) for i in range(20_000))
    start = time.process_time()
    found = sg._edits(a.split(), b.split())
    assert 0 < found <= 20_000 and time.process_time() - start < 10
    assert sg._edits(list("kitten"), list("sitting")) == 3 and sg._edits([], list("ab")) == 2 and sg._edits(list("ab"), list("ab")) == 0


def test_shifts_are_measured_side_by_side(monkeypatch):
    rng = random.Random(11)
    for n in (1, 2, 7, 64, 90):
        ref = shifts_module.Reference([rng.choice("abcdef") for _ in range(n)])
        hyp = [rng.choice("abcdef") for _ in range(rng.choice([8, 40, 300]))]
        start, stop = sorted(rng.sample(range(len(hyp) + 1), 2))
        orders = [hyp[:start] + rng.sample(hyp[start:stop], stop - start) + hyp[stop:] for _ in range(20)]
        assert ref.distances(orders, start, stop, ref.states(hyp)) == [ref.distance(words) for words in orders]
    # none is measured alone
    real = shifts_module.distance
    monkeypatch.setattr(shifts_module, "distance", lambda hyp, bits, n, state=None: pytest.fail("one by one") if state else real(hyp, bits, n))
    assert shifts_module.edits("c d e f g a b".split(), "a b c d e f g".split()) == 1


def test_hopeless_shifts_are_not_measured(monkeypatch):
    """A hypothesis that only lacks words cannot gain by a shift, so none is looked for; one that uses up the tries makes none."""
    monkeypatch.setattr(shifts_module, "shifts", lambda *_: pytest.fail("looked for shifts"))
    ref = [f"w{i % 40}" for i in range(200)]
    assert shifts_module.edits(ref[:50] + ref[60:], ref) == 10
    monkeypatch.undo()
    monkeypatch.setattr(shifts_module, "distance", lambda hyp, bits, n, state=None: pytest.fail("measured a shift") if state else 7)
    assert shifts_module.edits(["a", "b"] * 60, ["b", "a", "a", "b"] * 30) == 7
