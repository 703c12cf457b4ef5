"""Corpus statistics against direct computation."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmark.operators import ranking, stats


def lines_frame(spark, corpora):
    rows = [(c, i, line.split()) for c, lines in corpora.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "corpus string, line_no long, tokens array<string>")


def direct_tfidf(doc1, doc2):
    """Walk doc1 in chunks of doc2's length and compare smooth two-document TF-IDF vectors."""
    distances = []
    for start in range(0, len(doc1), len(doc2)):
        part = doc1[start : start + len(doc2)]
        c1 = Counter(w for x in part for w in x.split())
        c2 = Counter(w for x in doc2[: len(part)] for w in x.split())
        vector = lambda c: {w: n * (math.log(3 / (1 + (w in c1) + (w in c2))) + 1) for w, n in c.items()}
        v1, v2 = vector(c1), vector(c2)
        norm = math.sqrt(sum(x * x for x in v1.values()) * sum(x * x for x in v2.values()))
        if norm:
            distances.append(1 - sum(v1[w] * v2.get(w, 0) for w in v1) / norm)
    return sum(distances) / len(distances) if distances else None


@pytest.mark.parametrize("shape", [(6, 3), (7, 3), (2, 5), (3, 3), (1, 1)])
def test_tfidf_chunks(spark, shape):
    rng = random.Random(sum(shape))
    text = lambda n, words: [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    corpora = {"a": text(shape[0], list("abcdef")), "b": text(shape[1], list("defghi"))}
    pairs = spark.createDataFrame([("a", "b", *map(int, shape))], "corpus1 string, corpus2 string, len1 long, len2 long")
    got = stats.tfidf_pairs(lines_frame(spark, corpora), pairs).first()
    assert got.distance == pytest.approx(direct_tfidf(corpora["a"], corpora["b"]), abs=1e-12)


def test_tfidf_disjoint_and_empty(spark):
    frame = lines_frame(spark, {"a": ["x y"], "b": ["z"]})
    schema = "corpus1 string, corpus2 string, len1 long, len2 long"
    pairs = spark.createDataFrame([("a", "b", 1, 1), ("a", "none", 1, 0)], schema)
    rows = stats.tfidf_pairs(frame, pairs).collect()
    assert [(r.corpus2, r.distance) for r in rows] == [("b", pytest.approx(1.0))]


def sides_frame(spark, train, dev, test):
    rows = [("g", s, w, n) for s, c in (("train", train), ("dev", dev), ("test", test)) for w, n in c.items()]
    counts = spark.createDataFrame(rows, "g string, split string, token string, n long")
    return stats.side_counts(counts, ["g"])


def test_jensen_shannon_limits(spark):
    sides = sides_frame(spark, {"a": 3, "b": 1}, {"a": 6, "b": 2}, {"c": 5})
    row = stats.jensen_shannon(sides, stats.vocabulary_stats(sides, ["g"]), ["g"]).first()
    assert row.train_dev_jsd == pytest.approx(0, abs=1e-9)
    assert row.train_test_jsd == pytest.approx(math.sqrt(math.log(2)))


def test_overlap_ttr_and_empty_side(spark):
    sides = sides_frame(spark, {"a": 3, "b": 1}, {"b": 2, "c": 2}, {})
    sizes = spark.createDataFrame([("g", 2, 1, 0)], "g string, train_size long, dev_size long, test_size long")
    row = stats.derived_stats(sizes.join(stats.vocabulary_stats(sides, ["g"]), "g")).first()
    assert row.train_dev_word_overlap == 1 / 4
    assert row.ttr_train == 0.5 and row.avg_train_sentence_length == 2.0
    assert row.train_dev_ttr_distance == 0.0
    assert row.avg_test_sentence_length is None and row.ttr_test is None and row.dev_test_ttr_distance is None
    jsd = stats.jensen_shannon(sides, stats.vocabulary_stats(sides, ["g"]), ["g"]).first()
    assert jsd.train_test_jsd is None and jsd.train_dev_jsd > 0


def test_clean_counts(spark):
    counts = spark.createDataFrame([("g", "the", 9), ("g", "runs", 2), ("g", "run", 1)], "g string, token string, n long")
    lemmas = spark.createDataFrame([("runs", "run")], "form string, lemma string")
    assert [tuple(r) for r in stats.clean_counts(counts, ["the"], lemmas).collect()] == [("g", "run", 3)]


def test_running_offset_and_rank(spark):
    df = spark.range(5000).selectExpr("id * 7 AS key", "if(id < 4000, 'hot', 'cold') AS g", "id % 5 AS n")
    for width in (3, 64, 4096):
        out = ranking.running_offset(df, ["g"], "key", "n", "before", width).toPandas().sort_values("key")
        expected = out.groupby("g")["n"].cumsum() - out["n"]
        assert (out["before"] == expected).all()
    ranked = ranking.seeded_rank(df, ["g"], F.col("key").cast("string"), 42, "r").toPandas()
    for _, part in ranked.groupby("g"):
        assert sorted(part["r"]) == list(range(1, len(part) + 1))


def test_experiment_features_match_group_features(spark):
    corpora = {"g|train": ["a b c", "b c", "d"], "g|dev": ["a d", "e"], "g|test": ["b", "c c", "f", "a"]}
    lines = lines_frame(spark, corpora)
    rows = spark.createDataFrame([(1, "g|train", "g|dev", "g|test"), (2, "g|train", "g|dev", "missing")],
                                 "id int, train_corpus string, dev_corpus string, test_corpus string")
    got = {r.id: r for r in stats.experiment_features(rows, lines).collect()}
    split = lines.selectExpr("'g' AS g", "substring_index(corpus, '|', -1) AS split", "line_no", "tokens")
    sizes = stats.corpus_sizes(split, ["g"])
    group = stats.tfidf_distance(split, sizes, ["g"]).first()
    sides = stats.side_counts(stats.token_counts(split, ["g", "split"]), ["g"])
    jsd = stats.jensen_shannon(sides, stats.vocabulary_stats(sides, ["g"]), ["g"]).first()
    for a, b in stats.PAIRS:
        assert got[1][f"{a}_{b}_tf_idf"] == pytest.approx(group[f"{a}_{b}_tf_idf"])
        assert got[1][f"{a}_{b}_jsd"] == pytest.approx(jsd[f"{a}_{b}_jsd"])
    assert got[2].train_test_tf_idf is None and got[2].test_size is None
    assert got[2].train_dev_tf_idf == got[1].train_dev_tf_idf


@pytest.mark.parametrize("size, error", [(18, 0), (9, 0.15)])
def test_sketched_vocabularies(spark, size, error):
    """Exact while a sketch holds all distinct tokens, near it beyond; sketches of parts merge to that of the whole."""
    rng = random.Random(size)
    rows = [(lang, split, [f"{lang}{rng.randint(low, low + 3000)}" for _ in range(40)]) for lang in "xy" for split, low in (("train", 0), ("dev", 1500), ("test", 9000)) for _ in range(120)]
    lines = spark.createDataFrame([r for r in rows if r[:2] != ("y", "test")], "lang string, split string, tokens array<string>")
    want = {r.lang: r for r in stats.vocabulary_stats(stats.side_counts(stats.token_counts(lines, ["lang", "split"]), ["lang"]), ["lang"]).collect()}
    for parts in (1, 6):
        for r in stats.sketched_vocabulary_stats(lines.repartition(parts), ["lang"], size).collect():
            for c, v in want[r.lang].asDict().items():
                assert c == "lang" or abs(r[c] - v) <= error * max(v, 1000 if error else 0), (c, r[c], v)


def test_rows_per_token_carry_numbers_of_pairs_only(spark):
    """Rows per token are shuffled by the number of a walk or pair, not by corpus names and lengths."""
    lines = spark.createDataFrame(
        [("a", 0, "x y x"), ("a", 1, "y z"), ("a", 2, "x"), ("b", 0, "x w"), ("c", 0, "z z")], "corpus string, line_no long, text string"
    )
    tokenised = stats.bags(lines, "word")
    pairs = spark.createDataFrame([("a", "b", 3, 1), ("a", "c", 3, 1)], "corpus1 string, corpus2 string, len1 long, len2 long")
    counts = stats.token_counts(tokenised, ["corpus"])
    for found in (stats.tfidf_pairs(tokenised, pairs), stats.vocabulary_pairs(counts, stats.corpus_profiles(tokenised, counts), pairs)):
        by_token = [p for p in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in p and "token" in p.split("]")[0]]
        assert by_token and not any("corpus1" in p.split("]")[0] for p in by_token)
        assert found.count() == 2
