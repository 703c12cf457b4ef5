"""Token counts through a digest cache.

A text's digest (SHA-256 of its content with white space runs made one blank and trimmed, which the
tokenizers used here do not tell apart) is joined to the counts stored under the tokenizer's own digest.
Only distinct texts that the cache lacks are encoded, and their counts are appended to it.

Encoding goes by stretches free of white space: the tokenizer drops white space and never joins
characters across it, so a text's count is the sum over its stretches, each of which is encoded once
per worker. ``whole_texts=True`` encodes whole texts instead, for tokenizers without that property.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import tidy

# Entries of a worker's own memo of stretches; it starts anew when full, so memory stays bounded.
MEMO = 200_000
# The ASCII white space that normalisation may touch.
GAP = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty, runs of ASCII white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " "))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str, whole_texts: bool):
    @F.arrow_udf("bigint")
    @tidy
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def sizes(texts: list[str]) -> list[int]:
            return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        memo: dict[str, int] = {}
        for batch in batches:
            texts = batch.to_pylist()
            if whole_texts:
                yield pa.array(sizes(texts), pa.int64())
                continue
            counts = []
            for text in texts:
                words = text.split(" ")
                missing = list({w for w in words if w not in memo})
                if len(memo) + len(missing) > MEMO:
                    memo.clear()
                    missing = list(set(words))
                for i in range(0, len(missing), 10_000):
                    part = missing[i : i + 10_000]
                    memo.update(zip(part, sizes(part)))
                counts.append(sum(map(memo.__getitem__, words)))
            yield pa.array(counts, pa.int64())

    return count.asNondeterministic()


def count_tokens(
    df: DataFrame, keep: list[str], cache: str, tokenizer: str, text: str = "text", whole_texts: bool = False,
) -> DataFrame:
    """The columns ``keep`` of ``df`` with ``digest``, ``n_bytes`` and ``n_tokens``, one row per row.

    ``cache`` is a folder that all executors reach; it holds one folder per tokenizer version with
    (digest, n_tokens) and may be absent or warm. Null counts as empty text. Copies of a text are
    encoded once; a digest found twice in the cache (two runs appended it) counts once.
    Columns of ``keep`` named like the outputs, but for case, are replaced. An empty table gives no rows. Texts are
    encoded whole, however long; repeated rows get equal counts.
    """
    spark = df.sparkSession
    shelf = f"{cache}/tokenizer={tokenizer_digest(tokenizer)}"
    outputs = ("digest", "n_bytes", "n_tokens")
    body = F.col(f"`{text}`")
    digest = F.unhex(F.sha2(normalised(body), 256))
    keep = [c for c in keep if c.lower() not in outputs]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]

    missing = df.select(digest.alias("digest"), normalised(body).alias("body"))
    try:
        missing = missing.join(spark.read.parquet(shelf).select("digest"), "digest", "left_anti")
    except AnalysisException:  # no counts of this tokenizer yet
        pass
    count = _counter(tokenizer, whole_texts)
    fresh = missing.dropDuplicates(["digest"]).select("digest", count(F.col("body")).alias("n_tokens"))
    fresh.write.mode("append").parquet(shelf)

    counts = spark.read.parquet(shelf).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    rows = df.select(
        F.struct(*kept, F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("size")).alias("row"), digest.alias("digest")
    )
    return rows.join(counts, "digest").select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "digest", F.col("row.size").alias("n_bytes"), "n_tokens",
    )
