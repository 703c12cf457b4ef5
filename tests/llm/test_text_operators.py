"""Operators on single texts against brute force, and their defined results for odd rows."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossmark.llm import byte_bpe, sharding, substrings, token_counts, url_rules, wu_manber

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [None, "", " ", "\n\t ", "a", "é", "x" * 5000, "It's  we'll\n\n \t done.  ", "日本語 текст 12345 !!! <|endoftext|>", "á   b", "'l'll 's"]


def frame(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(v).alias(k) for k, v in extra.items()])


def library():
    import tiktoken

    return byte_bpe._encoding(RANKS, PATTERN), tiktoken


# ---- byte-level BPE


def test_bpe_equals_the_library_on_odd_texts(spark):
    encoder, _ = library()
    texts = [*ODD, ODD[7]]
    got = {r.doc_id: r for r in byte_bpe.encode(frame(spark, texts, ids=1, body="x"), RANKS, PATTERN).withColumn("raw", byte_bpe.decode(F.col("ids"), RANKS, PATTERN)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == encoder.encode_ordinary(t or "")
        assert bytes(got[i].raw) == (t or "").encode()
        assert got[i].body == "x"


def test_bpe_stitches_long_texts_like_the_whole(spark):
    encoder, _ = library()
    rng = random.Random(5)
    alphabet = ["word", " ", "  ", "\n", "\n\n ", "'ll", "'s", "'", "!", "é", "12", "日本", "\t", "x" * 40, "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(50, 400))) for _ in range(40)]
    texts += ["z" * 900 + " end", "a" * 300 + " b " + "c" * 300, texts[0], texts[0], "\n" * 700, "!" * 200 + "'ll" * 100]
    got = {r.doc_id: r.ids for r in byte_bpe.encode(frame(spark, texts), RANKS, PATTERN, chunk=64, overlap=16).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == encoder.encode_ordinary(t), repr(t[:80])


def test_bpe_of_an_empty_table(spark):
    empty = frame(spark, ["x"]).where("false")
    assert byte_bpe.encode(empty, RANKS, PATTERN).count() == 0


# ---- token counts


def test_token_counts_with_cold_warm_and_doubled_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [*ODD, "Two  words", "Two words", "ΣΑΣ ΣΑΣ", "<|startoftext|>x<|endoftext|>y", "é É"]
    df = frame(spark, texts, n_tokens=7, digest="d", source="s")
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for round_ in range(3):
        got = token_counts.count_tokens(df, ["doc_id", "source", "digest"], str(tmp_path / "cache"), path).collect()
        assert {r.doc_id: r.n_tokens for r in got} == want
        assert {r.doc_id: r.n_bytes for r in got} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
        shelf = spark.read.parquet(str(tmp_path / "cache"))
        if round_ == 0:
            same = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ") for t in texts}
            assert shelf.count() == shelf.select("digest").distinct().count() == len(same)
        if round_ == 1:  # nothing was encoded again; now another run appends the same counts
            once = shelf.count()
            spark.createDataFrame(shelf.select("digest", "n_tokens").collect(), "digest binary, n_tokens long").write.mode("append").parquet(
                str(tmp_path / "cache" / f"tokenizer={token_counts.tokenizer_digest(path)}")
            )
            assert spark.read.parquet(str(tmp_path / "cache")).count() == 2 * once
    whole = token_counts.count_tokens(df, ["doc_id"], str(tmp_path / "other"), path, whole_texts=True).collect()
    assert {r.doc_id: r.n_tokens for r in whole} == want
    assert token_counts.count_tokens(df.where("false"), ["doc_id"], str(tmp_path / "none"), path).count() == 0


# ---- Wu-Manber


def brute_hits(text, items, window=13):
    words = wu_manber.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        if item is None or body is None:
            continue
        pattern = wu_manber.words_of(body)
        size = min(window, len(pattern))
        for k in range(len(pattern) - size + 1 if pattern else 0):
            part = pattern[k : k + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == part:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [1 << 20, 150])
def test_wu_manber_equals_brute_force(spark, max_bytes):
    rng = random.Random(3)
    words = "aa bb cc dd ee Ff".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 20, 40])]
    items += [(3, items[3][1]), (99, None), (None, "aa bb cc"), (98, " ... "), (97, "ÄÖ-ü 1st"), (10, items[9][1])]
    texts = [*ODD, "äö ÄÖ ü 1ST x", items[9][1].upper() + ". " + items[7][1]] + [
        " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(25)
    ]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    got = {r.doc_id: r for r in wu_manber.find_items(frame(spark, texts, hits="old", item="i"), table, max_bytes=max_bytes).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        r = got[i].hits
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found)
        assert sum(s.stop - s.start for s in r.spans) == hit
    none = wu_manber.find_items(frame(spark, texts), table.where("false")).where("hits.n_hit > 0 OR hits.n_words IS NULL")
    assert none.count() == 0
    assert wu_manber.find_items(frame(spark, texts).where("false"), table).count() == 0


def test_contamination_rule(spark):
    rows = spark.createDataFrame([((20, 1),), ((21, 1),), ((0, 0),)], "hits struct<n_words:bigint,n_hit:bigint>")
    assert [r[0] for r in rows.select(wu_manber.contaminated(F.col("hits"))).collect()] == [True, False, False]


# ---- passages


def brute_removed(rows, window):
    first = {}
    lists = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in lists:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in lists:
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("hot", [10_000, 2])
def test_passages_equal_brute_force(spark, hot):
    rng = random.Random(7)
    passages = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) for n in (6, 8, 9, 15, 40)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 12))) for _ in range(5)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    texts += [texts[0], texts[0], texts[5] + " ", *ODD, "a b " * 40, "a b " * 40, "a b " * 30, passages[4]]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(50, passages[3] + " x"), (50, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dedup", F.lit(0)).withColumn("f1", F.lit("c")).withColumn("doc", F.lit(1))
    got = substrings.remove_repeats(df, window=8, hot=hot).collect()
    assert sorted((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept) for r in got) == brute_removed(rows, 8)
    assert all(sum(s.stop - s.start for s in r.dedup.spans) == r.dedup.n_removed for r in got)
    assert {r.f1 for r in got} == {"c"}


def test_passages_of_odd_tables(spark):
    df = frame(spark, ["a b c d e f"] * 2)
    assert substrings.remove_repeats(df.where("false"), window=3).count() == 0
    null_ids = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.text): r.dedup.n_removed for r in substrings.remove_repeats(null_ids, window=3).collect()}
    assert got == {(None, "a b c d"): 4, (3, "a b c d"): 0, (None, None): 0}


# ---- shards


def test_shards_follow_the_mixture_and_hold_every_row_once(spark):
    rows = [(i if i % 50 else 7, None if i % 11 == 0 else f"s{min(i % 7, 3)}", "t") for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("shard", F.lit("x")).withColumn("row", F.lit(1)).withColumn("n", F.lit(2))
    got = sharding.interleave(df, 8, bucket_rows=64).collect()
    assert sorted((r.doc_id, str(r.source)) for r in got) == sorted((a, str(b)) for a, b, _ in rows)
    sizes, mix = {}, {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
        mix[(r.shard, r.source)] = mix.get((r.shard, r.source), 0) + 1
    assert sorted(sizes) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    for source in {r.source for r in got}:
        share = sum(r.source == source for r in got) / 8
        assert all(abs(mix.get((s, source), 0) - share) <= 2 for s in range(8))
    again = sharding.interleave(df.repartition(3), 8, bucket_rows=1000).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 7) == sorted((r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 7)
    assert sharding.interleave(df.where("false"), 8).count() == 0
    few = sharding.interleave(df.limit(3), 8).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def test_shards_are_written_in_slot_order(spark, tmp_path):
    df = frame(spark, ["x"] * 100, source="a")
    sharding.write_shards(sharding.interleave(df, 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").count().where("count = 25").count() == 4


def test_names_that_differ_by_case_are_replaced(spark, tmp_path):
    df = frame(spark, ["a b", "a b", None], source="s", Shard=1, SLOT=2, Dedup=3, Hits=4, IDS=5, N_Tokens=6, _size=7, _next=8, more=9)
    sharded = sharding.interleave(df, 2)
    assert sharded.select("shard", "slot", "_next").count() == 3 and "Shard" not in sharded.columns
    assert substrings.remove_repeats(df).select("dedup.n_words", "hits", "_size").count() == 3
    items = spark.createDataFrame([(f"i{i}", w) for i, w in enumerate(["a b", "b c", "x y z"])], "item_id string, text string")
    found = wu_manber.find_items(df, items, max_bytes=4)
    assert {(r.hits.n_hit, r._next, r.more) for r in found.collect()} == {(2, 8, 9), (0, 8, 9)} and "Hits" not in found.columns
    encoded = byte_bpe.encode(df, RANKS, PATTERN)
    assert {r["_next"] for r in encoded.select("ids", "_next").collect()} == {8}
    counted = token_counts.count_tokens(df, ["doc_id", "_size", "N_Tokens", "IDS"], f"{tmp_path}/cache", public_tokenizers.path("word_bpe_49k.json"))
    assert counted.columns == ["doc_id", "_size", "IDS", "digest", "n_bytes", "n_tokens"] and {r._size for r in counted.collect()} == {7}


# ---- URL rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
PATTERNS = ["||ads.", "/banner/*.gif|", "@@||ads.good.org^", "track", "|ftp://", "a|b|"]


def test_url_rules(spark):
    urls = [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/x", "m.example.com", "/en/x", "example.com/en/", "block"),
        ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("http://net/es/", "net", "/es/", "net/es/", "block"),
        ("http://ads.x.org/", "ads.x.org", "/", None, "block"),
        ("http://ads.good.org/", "ads.good.org", "/", None, "allow"),
        ("http://badads.x.org/", "badads.x.org", "/", None, "allow"),
        ("http://x.org/banner/1/z.GIF", "x.org", "/banner/1/z.GIF", None, "block"),
        ("http://x.org/banner/1/z.gif?a", "x.org", "/banner/1/z.gif", None, "allow"),
        ("http://x.org/mytracker", "x.org", "/mytracker", None, "block"),
        ("ftp://x.org", "x.org", "", None, "block"),
        ("http://x.org/\nq?://y", "x.org", "/\nq", None, "allow"),
        ("http://x.org/a|b", "x.org", "/a|b", None, "block"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("row", F.lit(2))
    got = {r.page_id: r for r in url_rules.judge(df, "url", RULES, PATTERNS).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), urls[i]
    assert url_rules.judge(df.where("false"), "url", RULES, PATTERNS).count() == 0
    assert {r.verdict for r in url_rules.judge(df, "url", [], []).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://x.org/ads/foo",)] * 3 + [("http://x.org/foo",)] * 2, "url string")
    index = url_rules.rule_index(df.select(F.col("url").alias("u")).distinct(), ["/ads/foo^", "track", "||x.org^", "track"])
    assert {r.pattern: r.t for r in index.collect()} == {"/ads/foo^": "ads", "||x.org^": "org"} and index.count() == 2


def test_many_rules(spark):
    """50,000 pattern rules and as many host rules; one of each fits."""
    urls = [(i, f"http://host{i}.org/p{i}/x") for i in range(0, 60_000, 997)] + [(-1, "http://host5.org/p5/x")] * 3
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("HOST", F.lit("mine")).withColumn("Patterns", F.lit(1))
    patterns = [f"||host{i}.org/p{i}/" for i in range(50_000)]
    rules = [(f"host{i}.org", f"/p{i}/x", "block") for i in range(50_000, 100_000)]
    got = url_rules.judge(df, "url", rules, patterns)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "patterns"]
    rows = got.collect()
    assert len(rows) == len(urls) and all(r.verdict == "block" for r in rows)
    for r in rows:
        n = int(r.url.split("/")[2][4:-4])
        assert (r.patterns, r.rule) == (([f"||host{n}.org/p{n}/"], None) if n < 50_000 else ([], f"host{n}.org/p{n}/x"))


def test_sha_of_no_items_is_that_of_empty_text(spark):
    row = spark.range(1).select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()
