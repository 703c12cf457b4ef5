"""The pipeline's stages on a table with odd rows and planted cases."""

import itertools
import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from glossmark.llm import byte_bpe, prob_minhash, substrings, wu_manber
from glossmark.llm.queries import BPE_RANKS, QUERIES

SF = "/root/testdata/sf0.001"


def through(spark, docs, folder):
    tables = [docs]
    for name, function in corpus_pipeline.STAGES:
        function(spark, tables[-1], SF).write.parquet(f"{folder}/{name}")
        tables.append(spark.read.parquet(f"{folder}/{name}"))
    return tables


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(11)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in source.collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    top = max(r[0] for r in rows)
    passage = " ".join(rows[3][1].split()[:60]) + " " + " ".join(f"es{i}" for i in range(20))
    near = rows[5][1].split()
    near[len(near) // 2] = "andere"
    planted = [(None, "en"), ("", "en"), ("123 !!!", "en"), (" ".join(near), rows[5][2]), (rows[5][1], rows[5][2]), (item, "en")]
    planted += [(" ".join(rng.choice("the of and to in".split()) + f"on{rng.randint(0, 99)}" for _ in range(90)) + " " + passage, "en") for _ in range(3)]
    rows += [(top + 1 + i, t, c, None, None if t is None else len(t)) for i, (t, c) in enumerate(planted)]
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, source.schema).withColumn("hits", F.lit("h")).withColumn("language", F.lit(1))
    tables = through(spark, docs, tmp_path)
    for t in tables[:-1]:
        assert t.columns == docs.columns
    got = [[(r.doc_id, r.text) for r in t.select("doc_id", "text").collect()] for t in tables[:-1]]

    # language: what has no letters goes, the others are clean
    assert {top + 1, top + 2, top + 3}.isdisjoint(i for i, _ in got[1]) and len(got[1]) == len(rows) - 3

    # near duplicates
    hashes = prob_minhash._Hashes(0)
    sets = [prob_minhash.shingles(hashes.of(prob_minhash.words_of(t)), 5) for _, t in got[1]]
    up = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if up[a] != up[b] and prob_minhash.probability_jaccard(sets[a], sets[b]) >= 0.8:
            up = [up[a] if u == up[b] else u for u in up]
    groups = {}
    for (i, _), u in zip(got[1], up):
        groups.setdefault(u, []).append(i)
    assert sorted(i for i, _ in got[2]) == sorted(min(g) for g in groups.values())

    # passages
    lists = [(i, substrings.words_of(t)) for i, t in got[2]]
    first = {}
    for i, w in lists:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = {}
    for (i, text), (_, w) in zip(got[2], lists):
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        if not gone:
            want[i] = text
        elif len(gone) < len(w):
            want[i] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode()
    assert dict(got[3]) == want and any(t != dict(got[2])[i] for i, t in want.items())
    assert tables[3].where("n_chars <> length(text) AND n_chars IS NOT NULL").count() == 0

    # benchmark passages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    search = wu_manber.build([(str(i), t) for i, t in items])
    left = []
    for i, t in got[3]:
        words = wu_manber.words_of(t)
        hit = sum(b - a for a, b in wu_manber.scan(words, search)[0])
        if not (hit and 20 * hit >= len(words)):
            left.append(i)
    assert sorted(i for i, _ in got[4]) == sorted(left) and top + 6 not in left

    # ids
    encoder = byte_bpe._encoding(public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)
    texts = dict(got[4])
    final = {r.doc_id: r for r in tables[5].collect()}
    assert set(final) == set(texts) and all(r.ids == encoder.encode_ordinary(texts[i]) and r.exact for i, r in final.items())


def test_stages_take_an_empty_table_and_tables_without_labels(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert [t.count() for t in through(spark, source.where("false"), tmp_path / "a")] == [0] * 6
    bare = source.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert through(spark, bare, tmp_path / "b")[1].count() == 20


def test_queries_take_empty_tables(spark, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()  # the test data's own folder may be read-only
    for name in ("documents", "embeddings", "pages", "benchmark"):
        table = spark.read.parquet(f"{SF}/{name}.parquet").where("false")
        table.write.parquet(f"{folder}/empty/{name}.parquet")
    for name, (query, _) in QUERIES.items():
        assert query(spark, f"{folder}/empty").count() == 0, name
