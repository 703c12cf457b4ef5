"""Queries whose inputs make the rare branches happen, and file jobs that write and read back.

The SQL is written from the definitions, not from the constants of the code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions import text
from glossmark.functions.text import bags
from glossmark.operators import corpus, stats
from glossmark.operators import features as ft
from glossmark.plans import fixtures as fx
from glossmark.plans import jobs
from glossmark.plans.corpus_queries import PAIRS_SQL, rounded
from glossmark.plans.model_queries import ONE, task_table
from glossmark.plans.oracle_queries import PROXY_TASK, TASK_LOLO_SQL, _task
from glossmark.plans.regression import Setup, run_experiment
from glossmark.session import spread, stage, staging_dir
from glossmark.sources import tables
from glossmark.sources import text as sources
from glossmark.sources.text import zip_lines

# Sides that are empty, of one sign, very long, or plain lines. Valid in both engines.
_SOURCE = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 1) WHEN 2 THEN repeat(replace(text, chr(10), ' ') || ' ', 4) ELSE replace(text, chr(10), '  ') END"
_TARGET = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN repeat('a ', 1022) || 'b' WHEN 3 THEN repeat('a ', 1023) || 'b' ELSE replace(text, chr(10), ' ') END"
_EDGE_SQL = f"edges AS (SELECT doc_id, {_SOURCE} AS source_text, {_TARGET} AS target_text FROM documents)"
_PIECES = "len(string_split(source_text, ' ')) < 1024 AND len(string_split(target_text, ' ')) < 1024"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.selectExpr("doc_id", f"{_SOURCE} AS source_text", f"{_TARGET} AS target_text")


def pair_length_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = corpus.filter_pairs(_edges(spark, sf_dir), count_newline=True)
    return kept.select("doc_id", F.length("source_text").alias("source_chars"), F.length("target_text").alias("target_chars"))


# A line's end counts, so one sign is enough.
PAIR_EDGES_SQL = f"""WITH {_EDGE_SQL}
SELECT doc_id, length(source_text)::INTEGER AS source_chars, length(target_text)::INTEGER AS target_chars FROM edges
WHERE source_text <> '' AND target_text <> '' AND {_PIECES}"""


def translation_record_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(F.create_map(F.lit("ind"), "source_text", F.lit("eng"), "target_text").alias("translation"))
    lines = _edges(spark, sf_dir).select("doc_id", F.to_json(record).alias("text"))
    kept = corpus.filter_pairs(sources.parse_translations(lines, "ind"))
    return kept.select("doc_id", F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5"))


RECORD_EDGES_SQL = f"""WITH {_EDGE_SQL}
SELECT doc_id, md5(source_text) AS source_md5, md5(target_text) AS target_md5 FROM edges
WHERE length(source_text) > 1 AND length(target_text) > 1 AND {_PIECES}"""

_MARKUP = r"&quot;a &amp; b&lt;c&gt; <skipped>well-' || chr(10) || 'known 3-4 1,000.5 end.- (x) &amp;lt; "


def mteval_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric tokens of texts with entities, skip marks and hyphens at line ends."""
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", f"'{_MARKUP}' || text AS text")
    tokens = text.mteval_tokens(F.col("text"))
    return docs.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


MTEVAL_MARKUP_SQL = rf"""WITH a AS (
  SELECT doc_id, replace(replace(replace('{_MARKUP}' || text, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ') AS t FROM documents),
b AS (SELECT doc_id, ' ' || replace(replace(replace(replace(t, '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ' AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '([\x20-\x26\x28-\x2B\x3A-\x40\x5B-\x60\x7B-\x7E/])', ' \1 ', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g') AS t FROM c),
e AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '([0-9])(-)', '\1 \2 ', 'g'), '\s+', ' ', 'g')) AS t FROM d)
SELECT doc_id, len(string_split(t, ' ')) AS n_tokens, md5(t) AS tokens_md5 FROM e"""


def corpus_prefix_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that every corpus exceeds, and one line in each that many numbers lie before."""
    pairs = corpus.filter_pairs(fx.chat_pairs(spark, sf_dir), count_newline=True)
    numbered = pairs.withColumn("corpus", F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"))).withColumn("line_no", F.col("conv_id") * 1000 + F.col("turn"))
    return corpus.first_pairs(numbered, ["corpus"], 17).select("corpus", "line_no", F.md5("source_text").alias("source_md5"))


PREFIX_SHORT_SQL = f"""WITH {PAIRS_SQL},
ranked AS (
  SELECT 'c' || CAST(conv_id % 3 AS VARCHAR) AS corpus, conv_id * 1000 + turn AS line_no, source_text,
    row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) AS r FROM kept)
SELECT corpus, line_no, md5(source_text) AS source_md5 FROM ranked WHERE r <= 17"""


def positional_zip_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train lines of a language zipped with its dev lines."""
    lines = stage(fx.numbered_corpus_lines(spark, sf_dir), "lines")
    zipped = zip_lines(lines.filter("split = 'train'"), lines.filter("split = 'dev'"), ["lang"])
    return zipped.select("lang", F.col("line_no").cast("long").alias("line_no"), F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5"))


ZIP_TRAIN_SQL = f"""WITH {fx.LINES_SQL}
SELECT a.lang, a.line_no, md5(a.text) AS source_md5, md5(b.text) AS target_md5
FROM lines a JOIN lines b ON a.lang = b.lang AND a.line_no = b.line_no WHERE a.split = 'train' AND b.split = 'dev'"""


def source_only_lolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that never are a target keep a row whose target error is null."""
    rows = task_table(spark, sf_dir).filter("target_lang NOT IN ('L03', 'L07')")
    setup = Setup(dataset="intent", mode="lolo", regressor="poly", model="aya", config=ONE, combos=[PROXY_TASK])
    return _task(run_experiment(rows, setup))


SOURCE_ONLY_SQL = TASK_LOLO_SQL.replace("trfm_spBLEU_mean AS x, k FROM exp)", "trfm_spBLEU_mean AS x, k FROM exp WHERE target_lang NOT IN ('L03', 'L07'))")

_CODES = ["deu", "eng", "fra", "jav", "asm", "zho", "kab", "ita", "kor", "tat"]


def covered_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows of the learnt metric: pairs with a covered language on either side."""
    code = lambda c: F.array(*[F.lit(x) for x in _CODES])[F.ascii(F.substring(c, 3, 1)) % len(_CODES)]
    rows = fx.experiments(spark, sf_dir)
    named = rows.withColumns({"key": fx.experiment_key(), "source_lang": code("source_lang"), "target_lang": code("target_lang")})
    return ft.complete_rows(named, "comet").select("key", "source_lang", "target_lang", "trfm_spBLEU_mean")


_CODE_SQL = "[{}][ascii(substr({{}}, 3, 1)) % 10 + 1]".format(", ".join(f"'{x}'" for x in _CODES))
COVERED_SQL = f"""{fx.EXPERIMENTS_SQL},
named AS (SELECT k AS key, {_CODE_SQL.format("source_lang")} AS source_lang, {_CODE_SQL.format("target_lang")} AS target_lang, trfm_spBLEU_mean FROM exp)
SELECT * FROM named WHERE source_lang IN ('deu', 'fra', 'jav', 'zho', 'kor') OR target_lang IN ('deu', 'fra', 'jav', 'zho', 'kor')"""


def experiments_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment table written as CSV and read back; incomplete rows go."""
    rows = fx.experiments(spark, sf_dir)
    path = f"{staging_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(rows, path)
    back = tables.read_experiments(spark, path, rows.columns)
    return back.select(*fx.EXPERIMENT_IDS, "dataset_size", "trfm_spBLEU_mean", "m2m100_ft_spBLEU_mean")


CSV_SQL = f"""{fx.EXPERIMENTS_SQL}
SELECT source_lang, target_lang, train_dataset, test_dataset, dataset_size, trfm_spBLEU_mean, m2m100_ft_spBLEU_mean FROM exp"""


def prepared_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dev and test lines of every language as aligned files, prepared into one output, all languages in one job.

    Preparing the corpora again changes nothing; all corpora of the output are read back together.
    """
    lines = fx.numbered_corpus_lines(spark, sf_dir).select("lang", "split", "line_no", "text")
    root, out = (f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("files", "prepared"))
    sources.write_sets(lines, root, ["lang", "split"])
    back = sources.read_sets(spark, root, ["lang", "split"])
    named = back.withColumn("corpus", F.concat(F.lit("dev-test/"), "lang"))
    dev, test = (named.where(F.col("split") == s).withColumn("split", F.lit("train")) for s in ("dev", "test"))
    for _ in range(2):
        found = jobs.prepare_corpora(dev, test, out, size=50)
    return found.select("lang", "corpus", F.col("line_no").cast("long").alias("line_no"), F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5"))


PREPARED_SQL = f"""WITH {fx.LINES_SQL},
zipped AS (
  SELECT a.lang, a.line_no, a.text AS source_text, b.text AS target_text FROM lines a JOIN lines b ON a.lang = b.lang AND a.line_no = b.line_no
  WHERE a.split = 'dev' AND b.split = 'test' AND a.text <> '' AND b.text <> '' AND len(string_split(a.text, ' ')) < 1024 AND len(string_split(b.text, ' ')) < 1024),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY line_no) AS r FROM zipped)
SELECT lang, 'dev-test/' || lang AS corpus, line_no, md5(source_text) AS source_md5, md5(target_text) AS target_md5 FROM ranked WHERE r <= 50"""


def experiment_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding distances attached to experiment rows."""
    langs, splits = "array('de', 'en', 'es', 'fr')", "array('train', 'dev', 'test')"
    rows = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"concat({langs}[cast(o_custkey % 4 AS int)], '|train') AS train_corpus",
        f"concat({langs}[cast(o_custkey % 4 AS int)], '|dev') AS dev_corpus", f"concat({langs}[cast(o_orderkey % 4 AS int)], '|test') AS test_corpus",
    )
    lines = fx.numbered_corpus_lines(spark, sf_dir).selectExpr("concat(lang, '|', split) AS corpus", "line_no", "text")
    vectors = fx.table(spark, sf_dir, "embeddings").selectExpr(
        f"concat({langs}[cast(vec_id % 4 AS int)], '|', {splits}[cast(vec_id % 3 AS int)]) AS corpus", "embedding"
    )
    found = stats.experiment_features(rows, bags(lines, "word"), vectors)
    names = [f"{a}_{b}_st_similarity" for a, b in stats.PAIRS]
    return rounded(found.select("o_orderkey", *names), names)


VECTORS_SQL = """WITH e AS (
  SELECT ['de', 'en', 'es', 'fr'][vec_id % 4 + 1] || '|' || ['train', 'dev', 'test'][vec_id % 3 + 1] AS corpus, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) AS p FROM embeddings),
m AS (SELECT corpus, p, avg(x) AS x FROM e GROUP BY corpus, p),
d AS (
  SELECT a.corpus AS c1, b.corpus AS c2, 1 - sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS d
  FROM m a JOIN m b USING (p) GROUP BY a.corpus, b.corpus),
r AS (
  SELECT o_orderkey, ['de', 'en', 'es', 'fr'][o_custkey % 4 + 1] AS own, ['de', 'en', 'es', 'fr'][o_orderkey % 4 + 1] AS other FROM orders)
SELECT o_orderkey, round(x.d, 6) AS train_dev_st_similarity, round(y.d, 6) AS train_test_st_similarity, round(z.d, 6) AS dev_test_st_similarity
FROM r LEFT JOIN d x ON x.c1 = own || '|train' AND x.c2 = own || '|dev'
LEFT JOIN d y ON y.c1 = own || '|train' AND y.c2 = other || '|test' LEFT JOIN d z ON z.c1 = own || '|dev' AND z.c2 = other || '|test'"""

QUERIES = {
    "pair_length_edges": (pair_length_edges, PAIR_EDGES_SQL),
    "translation_record_edges": (translation_record_edges, RECORD_EDGES_SQL),
    "mteval_markup": (mteval_markup, MTEVAL_MARKUP_SQL),
    "corpus_prefix_short": (corpus_prefix_short, PREFIX_SHORT_SQL),
    "positional_zip_train": (positional_zip_train, ZIP_TRAIN_SQL),
    "source_only_lolo": (source_only_lolo, SOURCE_ONLY_SQL),
    "covered_languages": (covered_languages, COVERED_SQL),
    "experiments_csv": (experiments_csv, CSV_SQL),
    "prepared_corpora": (prepared_corpora, PREPARED_SQL),
    "experiment_vectors": (experiment_vectors, VECTORS_SQL),
}
