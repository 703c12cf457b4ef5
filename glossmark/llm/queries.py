"""Queries on whole tables, one per operator, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm import (
    alignment, byte_bpe, crf, kneser_ney, packed_ids, prob_minhash, resampling, sharding, substrings, token_counts, url_rules, vectors,
    wu_manber,
)
from glossmark.llm.common import crc32_sql, held_out, table
from glossmark.session import staging_dir

SHARDS = 40
SHARD_SEED = 42
TOKEN_LIMIT = 2048
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
DRAW_SEED = 2024
DRAW_SHARE = (10, 100)
END_ID = 1

HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PATTERN_RULES = [
    "||casino-win.",
    "||ads-track.",
    "||cheap-pills.",
    "||spam-farm.",
    "||free-bets.",
    "||adult-x.",
    "/adserver/",
    "/banners/*.gif|",
    "&affiliate=",
    "/wp-login.php",
    "*.exe|",
    "@@||spam-farm.example.org/en/*.html|",
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.interleave(rows, SHARDS, seed=SHARD_SEED)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP1_SQL = f"""
WITH ranked AS (
    SELECT doc_id, text, source, md5('{SHARD_SEED}|' || coalesce(doc_id::VARCHAR, '')) AS h,
        row_number() OVER (PARTITION BY source ORDER BY md5('{SHARD_SEED}|' || coalesce(doc_id::VARCHAR, ''))) AS r,
        count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (
        ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END, h) - 1 AS p
    FROM ranked)
SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
    'rows' AS law, (p * {SHARDS} // total)::INTEGER AS shard,
    p - ((p * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept"), 256).alias("kept_sha256")
    )


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM docs WHERE len(w) >= 50) AS x),
least AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
    FROM windows JOIN least USING (k) WHERE least < doc_id),
gaps AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
words AS (
    SELECT docs.doc_id, p + 1 AS place, w[p + 1] AS word
    FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM docs) AS docs
    WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = docs.doc_id AND gone.p = docs.p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM words GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN gaps USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound AS a JOIN sound AS b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
    least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)) AS component_id,
    vec_id = least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)) AS kept
FROM embeddings
"""


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out"))
    model = kneser_ney.train(docs.where(~F.col("held_out")))
    scored = docs.withColumn("s", kneser_ney.score_column(model)(F.col("text")))
    return scored.select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("s.base").alias("base_score"), "s.score",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = f"{staging_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counts = token_counts.count_tokens(docs, ["doc_id"], cache, tokenizer_path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks, pattern = tokenizer_path(BPE_RANKS), tokenizer_pattern()
    encoded = byte_bpe.encode(docs, ranks, pattern).select("doc_id", "ids", byte_bpe.decode(F.col("ids"), ranks, pattern).alias("raw"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.label(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wu_manber.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        wu_manber.contaminated(F.col("hits")).alias("contaminated"),
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP8_SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
patterns AS (
    SELECT item, len(p) AS size, array_to_string(p, ' ') AS p FROM (
        SELECT item, unnest([w[i + 1 : i + least(13, len(w))] FOR i IN range(len(w) - least(13, len(w)) + 1)]) AS p
        FROM items WHERE len(w) > 0) AS x),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (
    SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS p
    FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size) AS x),
found AS (SELECT doc_id, item, i, windows.size FROM windows JOIN patterns USING (p) WHERE windows.size = patterns.size),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) AS x GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4).alias("held_out"))
    field = crf.train(docs.where(~F.col("held_out")))
    found = docs.select("doc_id", "held_out", crf.language(spark, field, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, "url", HOST_RULES, PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


def _op10_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in HOST_RULES)

    def any_of(patterns: list[str]) -> str:
        return " OR ".join(f"coalesce(regexp_matches(lower(url), '{url_rules.regex_of(p)}'), false)" for p in patterns)

    block = any_of([p for p in PATTERN_RULES if not p.startswith("@@")])
    excepted = any_of([p for p in PATTERN_RULES if p.startswith("@@")])
    return f"""
    WITH cut AS (
        SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE {fits} END AS rule, ({block}) AND NOT ({excepted}) AS blocked FROM parts)
    SELECT page_id, host, path, rule,
        CASE rule {verdicts} ELSE CASE WHEN blocked THEN 'block' ELSE 'allow' END END AS verdict FROM ruled"""


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    scored = resampling.importance(docs, target, seed=DRAW_SEED)
    return resampling.draw(scored, DRAW_SHARE).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = rf"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT {_WORDS_SQL} AS w FROM benchmark),
vocabulary AS (
    SELECT word, crc % {resampling.BUCKETS} AS b FROM (
        SELECT word, {crc32_sql("word")} AS crc
        FROM (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM docs UNION ALL SELECT w FROM items) AS x) AS y) AS z),
source AS (SELECT b, count(*) AS s FROM (SELECT unnest(w) AS word FROM docs) AS x JOIN vocabulary USING (word) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM (SELECT unnest(w) AS word FROM items) AS x JOIN vocabulary USING (word) GROUP BY b),
totals AS (
    SELECT coalesce((SELECT sum(s) FROM source), 0)::DOUBLE + {resampling.BUCKETS} AS big_s,
        coalesce((SELECT sum(t) FROM target), 0)::DOUBLE + {resampling.BUCKETS} AS big_t),
gains AS (
    SELECT n.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * big_s / ((coalesce(s, 0) + 1)::DOUBLE * big_t)))::BIGINT AS gain
    FROM (SELECT unnest(range({resampling.BUCKETS})) AS b) AS n LEFT JOIN source USING (b) LEFT JOIN target USING (b), totals),
sums AS (
    SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM (SELECT doc_id, unnest(w) AS word FROM docs) AS x JOIN vocabulary USING (word) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{DRAW_SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {resampling.LEAST_WORDS}),
size AS (SELECT {DRAW_SHARE[0]} * count(*) // {DRAW_SHARE[1]} AS n FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (doc_id), size
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aligned = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])
    return aligned.select("doc_id", *alignment.MEASURES, "groups_sha256")


def op13_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_dir(spark)}/ids-{uuid.uuid4().hex}"
    packed_ids.write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end=END_ID)
    back = packed_ids.read_ids(spark, folder)
    return back.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES: dict = {
    "op1_sharding": (op1_sharding, OP1_SQL),
    "op2_substrings": (op2_substrings, OP2_SQL),
    "op3_near_vectors": (op3_near_vectors, OP3_SQL),
    "op4_kneser_ney": (op4_kneser_ney, None),
    "op5_token_counts": (op5_token_counts, None),
    "op6_byte_bpe": (op6_byte_bpe, None),
    "op7_near_duplicates": (op7_near_duplicates, None),
    "op8_decontamination": (op8_decontamination, OP8_SQL),
    "op9_language": (op9_language, None),
    "op10_url_rules": (op10_url_rules, _op10_sql()),
    "op11_importance": (op11_importance, OP11_SQL),
    "op12_alignment": (op12_alignment, None),
    "op13_packed_ids": (op13_packed_ids, None),
}
