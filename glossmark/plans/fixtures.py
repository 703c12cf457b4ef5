"""Inputs derived from the given tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.operators.corpus import number_sentences, sentences
from glossmark.session import spread

EXPERIMENT_IDS = ["source_lang", "target_lang", "train_dataset", "test_dataset"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lang(nation):
    return F.concat(F.lit("L"), F.lpad(nation.cast("string"), 2, "0"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the columns the experiment table is made of."""
    items = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("cn"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("sn"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumns(
            {
                "source_lang": _lang(F.col("sn")),
                "target_lang": F.when(F.col("cn") == 0, "eng").otherwise(_lang(F.col("cn"))),
                "train_dataset": F.concat(F.lit("d"), (F.col("l_partkey") % 4).cast("string")),
                "test_dataset": F.concat(F.lit("d"), (F.col("l_orderkey") % 4).cast("string")),
            }
        )
    )


def _mean(column, unit: int):
    """Mean of a two-decimal column from whole cents, so every engine gets the same bits."""
    column = F.col(column) if isinstance(column, str) else column
    cents = F.round(column * 100).cast("long")
    return F.sum(cents) / F.nullif(F.count(column) * unit, F.lit(0).cast("long")).cast("double")


def experiments_from(rows: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice")
    odd = F.col("l_linenumber") % 2 == 1
    grouped = rows.groupBy(*EXPERIMENT_IDS, "sn", "cn").agg(
        (F.count(F.lit(1)) * 1000).alias("dataset_size"),
        F.avg("l_quantity").alias("avg_train_sentence_length"),
        _mean("l_discount", 100).alias("ttr_train"),
        _mean("l_tax", 100).alias("ttr_test"),
        F.avg("p_size").alias("train_word_vocab_size"),
        _mean(price, 100_000).alias("m2m100_ft_spBLEU_mean"),
        (F.stddev_pop(price) / 1000).alias("m2m100_ft_spBLEU_se"),
        _mean(F.when(odd, price), 100_000).alias("trfm_spBLEU_mean"),
        _mean("o_totalprice", 100_000).alias("small100_ft_spBLEU_mean"),
    )
    sn, cn = F.col("sn"), F.col("cn")
    return grouped.select(
        *EXPERIMENT_IDS,
        "dataset_size",
        (F.abs(sn - cn) / 25).alias("genetic"),
        (((sn * 7 + cn * 3) % 100) / 100).alias("geographic"),
        (((sn * 5 + cn) % 50) / 50).alias("syntactic"),
        F.lit(1.0).alias("test_size"),
        "train_word_vocab_size", "avg_train_sentence_length", "ttr_train", "ttr_test",
        (F.col("target_lang") == "eng").cast("int").alias("eng_target"),
        "trfm_spBLEU_mean", "small100_ft_spBLEU_mean", "m2m100_ft_spBLEU_mean", "m2m100_ft_spBLEU_se",
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment table, incomplete rows included."""
    return experiments_from(sales(spark, sf_dir))


def experiment_key():
    return F.concat_ws("|", *EXPERIMENT_IDS)


SALES_SQL = """
sales AS (
  SELECT l.*, o_totalprice, p_size, s_nationkey AS sn, c_nationkey AS cn,
    'L' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS source_lang,
    CASE WHEN c_nationkey = 0 THEN 'eng'
         ELSE 'L' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS target_lang,
    'd' || CAST(l_partkey % 4 AS VARCHAR) AS train_dataset,
    'd' || CAST(l_orderkey % 4 AS VARCHAR) AS test_dataset
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey)"""


def _mean_sql(column: str, unit: int) -> str:
    return f"(sum(CAST(round(({column}) * 100) AS BIGINT))::DOUBLE / nullif(count({column}) * {unit}, 0)::DOUBLE)"


def experiments_sql(name: str = "exp_all", where: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT source_lang, target_lang, train_dataset, test_dataset,
    count(*) * 1000 AS dataset_size,
    abs(sn - cn) / 25.0 AS genetic, ((7 * sn + 3 * cn) % 100) / 100.0 AS geographic,
    ((5 * sn + cn) % 50) / 50.0 AS syntactic, 1.0::DOUBLE AS test_size,
    avg(p_size) AS train_word_vocab_size, avg(l_quantity) AS avg_train_sentence_length,
    {_mean_sql("l_discount", 100)} AS ttr_train, {_mean_sql("l_tax", 100)} AS ttr_test,
    CASE WHEN target_lang = 'eng' THEN 1 ELSE 0 END AS eng_target,
    {_mean_sql("CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END", 100000)} AS trfm_spBLEU_mean,
    {_mean_sql("o_totalprice", 100000)} AS small100_ft_spBLEU_mean,
    {_mean_sql("l_extendedprice", 100000)} AS m2m100_ft_spBLEU_mean,
    stddev_pop(l_extendedprice) / 1000 AS m2m100_ft_spBLEU_se,
    source_lang || '|' || target_lang || '|' || train_dataset || '|' || test_dataset AS k
  FROM sales WHERE {where} GROUP BY source_lang, target_lang, train_dataset, test_dataset, sn, cn)"""


EXPERIMENTS_SQL = f"WITH {SALES_SQL}, {experiments_sql()}, exp AS (SELECT * FROM exp_all WHERE trfm_spBLEU_mean IS NOT NULL)"


def document_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as train, dev and test corpora per language."""
    tenth = F.col("doc_id") % 10
    split = F.when(tenth < 8, "train").when(tenth == 8, "dev").otherwise("test")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", split.alias("split"), "text")


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(document_splits(spark, sf_dir), ["lang", "split"])


def numbered_corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_sentences(document_splits(spark, sf_dir), ["lang", "split"])


LINES_SQL = r"""
pieces AS (
  SELECT doc_id, lang,
    CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split,
    unnest(string_split(text, chr(10))) AS text,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
lines AS (
  SELECT lang, split, text,
    row_number() OVER (PARTITION BY lang, split ORDER BY doc_id, pos) - 1 AS line_no
  FROM pieces WHERE trim(text) <> ''),
norm AS (
  SELECT lang, split, line_no,
    regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}\s]', '', 'g') AS text FROM lines)"""

CHAR_TOKENS_SQL = r"""
toks AS (
  SELECT lang, split, line_no, unnest(string_split(regexp_replace(text, '\s+', '', 'g'), '')) AS token
  FROM norm WHERE regexp_replace(text, '\s+', '', 'g') <> '')"""

WORD_TOKENS_SQL = r"""
words AS (
  SELECT lang, split, line_no, unnest(string_split_regex(text, '\s+')) AS token FROM norm),
toks AS (SELECT * FROM words WHERE token <> '')"""


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns paired with the assistant's next turn, numbered densely."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source_text"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text")
    )
    return user.join(reply, ["conv_id", "turn"])


def hyp_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of every document as a segment: hypothesis and two references
    with some words left out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    lines = docs.selectExpr("doc_id", "lang", "posexplode(split(text, '\\n')) AS (pos, line)").filter("trim(line) <> ''")
    words = lines.selectExpr("doc_id", "concat_ws('-', doc_id, pos + 1) AS seg_id", "lang", "split(line, ' ') AS w")
    return words.selectExpr(
        "seg_id", "lang",
        "array_join(filter(w, (x, i) -> i % 7 <> doc_id % 7), ' ') AS hyp",
        "array_join(w, ' ') AS ref0",
        "array_join(filter(w, (x, i) -> i % 11 <> 0), ' ') AS ref1",
    )


HYP_REF_SQL = """
doc_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
base AS (
  SELECT doc_id, doc_id || '-' || pos AS seg_id, lang, string_split(line, ' ') AS w FROM doc_lines WHERE trim(line) <> ''),
spread AS (
  SELECT doc_id, seg_id, lang, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM base),
hr AS (
  SELECT seg_id, lang,
    coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE p % 7 <> doc_id % 7), '') AS hyp,
    string_agg(word, ' ' ORDER BY p) AS ref0,
    coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE p % 11 <> 0), '') AS ref1
  FROM spread GROUP BY seg_id, lang)"""


def embedding_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    split = F.when(label < 7, "train").when(label < 9, "dev").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(split.alias("split"), "embedding", "vec_id")
