"""The training-data pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's documents. All but the last return the columns of their input. An empty table gives an empty
result in every stage; texts are taken whole, however long; repeated rows are treated alike, but for near copies, of
which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm import byte_bpe, crf, prob_minhash, substrings, wu_manber
from glossmark.llm.common import fresh, table
from glossmark.llm.queries import BPE_RANKS, tokenizer_path, tokenizer_pattern
from glossmark.session import stage

# A document goes if it has no letters or if its words fit all learned languages nearly alike (0: alike, 1: each word is of
# one language for sure). Documents in several languages fit well, however many languages there are.
LEAST_FIT = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null texts among them) and those whose words fit no learned language.

    The classifier is fitted on labelled documents of the input; without any, only letters count.
    """
    field = crf.train(docs)
    name = fresh(docs, "language")
    found = docs.withColumn(name, crf.language(spark, field, F.col("text")))
    if field.languages:
        keep = (F.col(f"{name}.lang") != crf.UNKNOWN) & (F.col(f"{name}.fit") >= LEAST_FIT)
    else:
        keep = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(keep).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id."""
    return prob_minhash.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are taken out; a document left empty goes.

    Texts that lose nothing stay as they are; in the others words are joined by one blank.
    """
    name = fresh(docs, "dedup")
    done = substrings.remove_repeats(docs, out=name)
    cut = F.col(f"{name}.n_removed") > 0
    done = done.where(~cut | (F.col(f"{name}.n_removed") < F.col(f"{name}.n_words")))
    text = F.when(cut, F.col(f"{name}.kept")).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words at least a twentieth lie in windows of the benchmark."""
    name = fresh(docs, "hits")
    found = wu_manber.find_items(docs, table(spark, sf_dir, "benchmark"), out=name)
    return found.where(~wu_manber.contaminated(F.col(name))).drop(name)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document, and whether decoding gives its bytes back."""
    ranks, pattern = tokenizer_path(BPE_RANKS), tokenizer_pattern()
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    same = byte_bpe.decode(F.col("ids"), ranks, pattern) == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("exact"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# The classifier, the signatures and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
