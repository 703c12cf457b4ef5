"""Importance resampling, tokenizer alignment and packed token files against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossmark.llm import alignment, packed_ids, resampling
from glossmark.llm.word_bpe import WordBpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n", "a", "A b\nc  d\n\ne", "é ½ ² Ⅷ", "x" * 3000, "It's  we'll\n\n \t done.  ", "日本語 текст 12345 !!! <|endoftext|>", "á   b",
    "<|startoftext|>a<|endoftext|> <s> </s> <0x41>", "a　b▁c   d\x1c e\x85f \xa0 g", "▁▁ a", "a ▁", "﻿ a ​ b", "ΣΑΣ ΑΣ.",
    "\x00\x01 \x02", "🙂🙃 👩‍👩‍👧 done", "a\tb \t c", "  lead and trail  ", "word " * 400,
]


def frame(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(v).alias(k) for k, v in extra.items()])


def mixed(seed, n):
    rng = random.Random(seed)
    alphabet = ["word", "other", " ", " ", " ", "  ", "\n", "\n\n ", "'ll", "'s", "'", "!", "é", "12", "日本", "\t", "x" * 40, ".", "▁", "\xa0", "THE", "the"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


# ---- resampling


def brute_importance(texts, target, keys, order, buckets, seed):
    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return [b" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)

    def counts(some):
        return Counter(zlib.crc32(f) % buckets for t in some for f in features(t)[0])

    s, t = counts(texts), counts(target)
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    out = []
    for key, text in zip(keys, texts):
        found, n = features(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_importance_equals_brute_force(spark, order):
    texts = [*ODD, *mixed(order, 60), ODD[5], ODD[5], "the word\nthe word\nother"]
    target = ["the word other\nother the", "12 日本 word", None, "!!"]
    df = frame(spark, texts, Weight=1, part="p", row="r")
    got = resampling.importance(df, frame(spark, target), keep=["doc_id", "Weight", "part", "row"], order=order, buckets=97, seed=7)
    assert got.columns == ["doc_id", "part", "row", "n_words", "n_features", "weight", "score"]
    want = brute_importance(texts, target, range(len(texts)), order, 97, 7)
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got.collect()) == sorted(want)


def test_draw_orders_by_score_and_key(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, rng.choice([5, 20, 40]), rng.randint(-3, 3)) for i in range(400)] + [(7, 20, 1)] * 30
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long").withColumn("RANK", F.lit(5)).withColumn("part", F.lit(1))
    got = resampling.draw(scored, (10, 100)).collect()
    able = sorted(((-s, k is not None, k or 0) for k, n, s in rows if n >= 20))
    drawn = sorted((r["rank"], -r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, len(able) // 10 + 1))
    assert [d[1:] for d in drawn] == able[: len(drawn)]
    assert len(got) == len(rows) and all(r["rank"] is None for r in got if r.n_words < 20)
    assert set(got[0].asDict()) == {"doc_id", "n_words", "score", "rank", "part"}


def test_resample_returns_whole_rows_and_takes_empty_tables(spark):
    texts = [f"{'alpha beta ' * 12}{i}" if i % 2 else f"{'gamma delta ' * 12}{i}" for i in range(100)]
    df = frame(spark, texts, tie="t", place=3)
    got = resampling.resample(df, frame(spark, ["alpha beta " * 500]), (20, 100)).collect()
    assert len(got) == 20 and all(r.text == texts[r.doc_id] and r.tie == "t" and r.place == 3 for r in got)
    assert sum("alpha" in r.text for r in got) > 15
    empty = df.where("false")
    assert resampling.resample(empty, df, (10, 100)).count() == 0
    assert resampling.importance(df, empty).count() == 100


def test_repeated_and_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, None), (None, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_features) for r in resampling.importance(rows, rows).collect())
    assert got == [(0, 0), (0, 2), (1, 1), (1, 2), (1, 2)]


# ---- alignment


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    signs = alignment.byte_alphabet()
    rows, counts = [], Counter()
    for text in texts:
        row = {"a": [], "b": [], "links": [], "groups": ""}
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
            raw_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                cuts = sorted(set(end_a) & set(end_b))
                groups, low = [], 0
                for c in cuts:
                    groups.append(",".join(str(i) for i, e in zip(ids_a, end_a) if low < e <= c) + "|" + ",".join(str(i) for i, e in zip(ids_b, end_b) if low < e <= c))
                    low = c
                spans_a, spans_b = list(zip([0, *end_a], end_a)), list(zip([0, *end_b], end_b))
                links = [(i, j) for i, (s, e) in zip(ids_a, spans_a) for j, (p, q) in zip(ids_b, spans_b) if s < q and p < e]
                row = {"a": ids_a, "b": ids_b, "links": links, "groups": ";".join(groups), "n": len(groups)}
                counts.update(links)
        rows.append(row)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [
        (
            len(r["a"]), len(r["b"]), r.get("n", 0), len(r["links"]), sum(counts[x] == most[x[1]] for x in r["links"]), sum(counts[x] for x in r["links"]),
            hashlib.sha256(r["groups"].encode()).hexdigest() if r["a"] else "", r["groups"],
        )
        for r in rows
    ]


@pytest.mark.parametrize("frequent", [0, 40, 200_000])
def test_alignment_equals_brute_force(spark, frequent):
    texts = [*ODD, *mixed(frequent, 40), *[ODD[9]] * 5]
    got = alignment.align(frame(spark, texts, N_A=1, row="r", body="b"), A, B, ["doc_id", "N_A", "row", "body"], written=True, frequent=frequent)
    assert got.columns == ["doc_id", "row", "body", *alignment.MEASURES, "groups_sha256", "groups"]
    rows = sorted(got.collect())
    assert [tuple(r)[3:] for r in rows] == brute_alignment(texts) and [r.doc_id for r in rows] == list(range(len(texts)))


def test_pair_counts_and_empty_table(spark):
    texts = alignment.align_texts(frame(spark, ["the cat", "the cat", "the dog"]), A, B)
    pairs = alignment.pair_counts(texts).collect()
    assert sum(r["count"] for r in pairs) == 6 and all(r.pair == r.a << alignment.BITS | r.b for r in pairs)
    assert alignment.align(frame(spark, ["x"]).where("false"), A, B, ["doc_id"]).count() == 0
    assert alignment.align(frame(spark, [None, ""]), A, B, ["doc_id"]).count() == 2


# ---- packed ids


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    block = packed_ids.BLOCK
    rows = [
        np.zeros(block), np.full(block, 2**32 - 1), rng.integers(0, 2**32, block), rng.integers(0, 100, block), np.r_[np.zeros(block - 1), 2**32 - 1],
        np.where(rng.random(block) < 0.08, 2**31, rng.integers(500, 600, block)), np.arange(block),
    ]
    ids = np.concatenate(rows).astype(np.int64)
    for percentile in (0.0, 0.5, 0.9, 1.0):
        blocks = packed_ids.pack(ids, percentile)
        starts = np.r_[0, np.cumsum([len(b) for b in blocks])[:-1]]
        raw = np.frombuffer(b"".join(blocks), np.uint8)
        assert (packed_ids.unpack(raw, starts) == ids).all()
        assert (packed_ids.unpack(raw, starts[2:4]) == ids[2 * block : 4 * block]).all()
    # the patch keeps a block with few outliers narrow
    assert len(packed_ids.pack(rows[5].astype(np.int64))[0]) < block * 7 // 8 + 5 * 30 + 8


def library_ids(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [t.encode(x or "", add_special_tokens=False).ids + ([end] if end is not None else []) for x in texts]


def test_word_encoder_equals_the_library_for_every_sign_it_takes():
    """Signs in front of, between and behind others; and every text of the other tests."""
    encoder = WordBpe(WORDS)
    assert encoder.ranked is not None
    signs = [chr(c) for c in range(0x260) if not chr(c).isspace() or c > 0x80]
    texts = [f.format(c) for c in signs for f in ("a{0}b", "{0}", "{0}{0}1", "1{0}'s", "!{0}x", "Ab{0}", "{0}'LL")] + ["<|endoftext|>x", "a<|b", "café\u0301", "'Re'ven't"]
    flat, starts, sizes = encoder.stretches(texts)
    assert [flat[a : a + n].tolist() for a, n in zip(starts, sizes)] == library_ids(texts, None)
    import pyarrow as pa

    whole = [t or "" for t in [*ODD, *mixed(9, 50)]]
    ids, sizes = encoder.encode(pa.array(whole), 1)
    assert [r.tolist() for r in np.split(ids, np.cumsum(sizes)[:-1])] == library_ids(whole)


def test_merges_must_reach_every_token():
    assert WordBpe.plain([("a", "b"), ("ab", "c")], "</w>")
    assert WordBpe.plain([("a", "b</w>"), ("c", "ab</w>")], "</w>")
    assert not WordBpe.plain([("a", "b"), ("b", "c"), ("a", "bc")], "</w>")  # abc merges to ab, c


def test_files_give_the_library_ids_back(spark, tmp_path):
    texts = [*ODD, *mixed(4, 80), "word other " * 3000, *ODD]
    want = library_ids(texts)
    manifest = packed_ids.write_ids(frame(spark, texts, key=1, tie=2, IDS=3), f"{tmp_path}/a", WORDS, end=1, file_bytes=900)
    assert manifest.count() > 4 and manifest.agg(F.sum("n_ids")).first()[0] == sum(map(len, want))
    rows = packed_ids.read_ids(spark, f"{tmp_path}/a").orderBy("doc_id").collect()
    starts = np.r_[0, np.cumsum([len(w) for w in want])]
    assert [(r.doc_id, r.start, r.n_ids) for r in rows] == [(i, s, len(w)) for i, (s, w) in enumerate(zip(starts.tolist(), want))]
    assert all(bytes(r.ids) == struct.pack(f"<{len(w)}I", *w) for r, w in zip(rows, want))
    first, last = int(starts[10]) + 1, int(starts[40])
    some = packed_ids.read_ids(spark, f"{tmp_path}/a", first=first, last=last).orderBy("doc_id").collect()
    assert [r.doc_id for r in some] == list(range(10, 40)) and all(bytes(r.ids) == struct.pack(f"<{len(want[r.doc_id])}I", *want[r.doc_id]) for r in some)


def test_files_of_odd_keys_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(5, "a"), (None, "b c"), (5, "a"), (-3, None), (5, "d e f"), (None, None)], "doc_id long, text string")
    packed_ids.write_ids(rows, f"{tmp_path}/b", WORDS)
    got = packed_ids.read_ids(spark, f"{tmp_path}/b").collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_ids) for r in got) == [((False, 0), 0), ((False, 0), 2), ((True, -3), 0), ((True, 5), 1), ((True, 5), 1), ((True, 5), 3)]
    keys = [r.doc_id for r in sorted(got, key=lambda r: (r.start, r.start + r.n_ids)) if r.n_ids]
    assert keys == [None, 5, 5, 5] and sorted(r.start for r in got if r.n_ids)[0] == 0
    packed_ids.write_ids(rows.where("false"), f"{tmp_path}/c", WORDS, end=1)
    assert packed_ids.read_ids(spark, f"{tmp_path}/c").count() == 0
