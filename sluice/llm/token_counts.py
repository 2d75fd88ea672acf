"""Token counts behind a digest cache.

A count belongs to (digest of the normalised content, digest of the tokenizer file).  Known pairs come
from the cache by a join; of the others each distinct content is encoded once, and the new counts are
appended to the cache.  Normalising may not change a count: for tokenizers whose text steps never look
across ASCII white space it makes every run of that one space and drops it at both ends; for all others
content stays as it is.

Defined results: null text counts as empty (0 tokens); repeated rows each get a row; a null doc_id
stays null; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh_path, need
from sluice.llm.tokenizing import encoder, free_of_spaces, tokenizer_digest

#: Texts that a worker holds at a time.
_ROWS = 500
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [n for at in range(0, batch.num_rows, _ROWS) for n in encoder(path).counts(batch.column("_text").slice(at, _ROWS).to_pylist())]
            digests = batch.column("content_digest")
            yield pa.RecordBatch.from_arrays([digests, pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def _has_files(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``cache_path`` names the cache, a Parquet folder that may exist already; without it a new one
    is begun in the shared folder.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    cache_path = cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0B\\x0C]+", " ")) if free_of_spaces(tokenizer_path) else text
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), plain.alias("_text")).withColumn("content_digest", F.unhex(F.sha2("_text", 256)))

    def cached() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens").distinct()

    unknown = keyed.select("content_digest", "_text")
    if _has_files(docs, cache_path):
        unknown = unknown.join(cached(), "content_digest", "left_anti")
    distinct = unknown.groupBy("content_digest").agg(F.first("_text").alias("_text"))
    distinct.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # Every content has a count now; a cache that lost files fails the job rather than drop rows.
    lost = F.raise_error(F.lit("the cache of token counts lacks a content")).cast("long")
    counted = keyed.select("doc_id", "n_bytes", "content_digest").join(cached(), "content_digest", "left").withColumn("n_tokens", F.coalesce("n_tokens", lost))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
