"""Token counts with a digest cache.

The cache is a Parquet table (content_digest, tokenizer_version, n_tokens) in a folder of the caller's
choice. A count depends on the text's bytes and on the tokenizer file, so those two digests are its
key; the text is taken as it is, null as empty (anything more would change counts). Documents join
the cache on their digest; of the texts without an entry one row each is encoded; the new counts are
appended. A text that many rows share is encoded once and moved once.

Two runs that append the same digest leave two equal entries; reading takes one of them. A null
text has no bytes and no tokens. Ids may repeat or be null; further columns play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import freed_shuffles, materialize, row_key, scratch_path, small_batches, steps, trimmed
from .tokens import STEP_BYTES, encoder, version

LIMIT = 1024
_CACHE = "content_digest binary, tokenizer_version string, n_tokens long"


def _encode(path: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = []
            for _, _, texts in steps(b.column("text"), STEP_BYTES):
                n += [len(x) for x in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array(n, pa.int64())], names=["content_digest", "n_tokens"])

    return run


def read_cache(spark, cache: str) -> DataFrame:
    """The cache table, one entry a key; empty if nothing was ever stored."""
    try:
        table = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)
    return table.groupBy("content_digest", "tokenizer_version").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row. tokenizer: path of a tokenizers .json file."""
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or scratch_path(spark, "token-cache")
    made_by = version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest")
    rows = materialize(docs.select("doc_id", row_key().alias("row"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "op7-digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer_version") == made_by).select("content_digest", "n_tokens")
    missing = rows.groupBy("content_digest").agg(F.min("row").alias("row")).join(stored, "content_digest", "left_anti")
    texts = docs.select(row_key().alias("row"), text.alias("text")).join(missing, "row")
    fresh = texts.select("content_digest", "text").mapInArrow(trimmed(_encode(tokenizer)), "content_digest binary, n_tokens long")
    with freed_shuffles(spark):
        fresh.select("content_digest", F.lit(made_by).alias("tokenizer_version"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer_version") == made_by).select("content_digest", "n_tokens")
    out = rows.join(counts, "content_digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
