"""Token counts through a cache of content digests.

Each text is named by the SHA-256 of its normalised content (null counts as
empty; nothing else may change, as counts depend on every byte) and each
tokenizer by the SHA-256 of its file. Counts already stored for both digests
are joined; of the others one text for each digest is encoded, and its count is
appended to the cache. One writer at a time may append to a cache.
"""

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight.llm.encode import encoder
from procsight.llm.tables import exists, utf8
from procsight.llm.words import slices

CACHE = "version binary, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _digest(column: str):
    return F.unhex(F.sha2(utf8(column), 256))


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of the stored counts of one tokenizer version."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    stored = spark.read.schema(CACHE).parquet(cache)
    return stored.where(F.col("version") == F.unhex(F.lit(version))).select("digest", "n_tokens")


def encode_misses(docs: DataFrame, cache: str, tokenizer: str, text: str = "text") -> None:
    """Count each distinct text that the cache lacks, and append the counts.

    Copies are dropped before the shuffle, so a text that a third of all rows
    share arrives once from each map task.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    distinct = docs.select(_digest(text).alias("digest"), utf8(text).alias("text")).dropDuplicates(["digest"])
    missing = distinct.join(cached_counts(spark, cache, version), "digest", "left_anti") if exists(spark, cache) else distinct

    def count(batches):
        ids = encoder(tokenizer).ids
        for batch in batches:
            for some in slices(batch, 1):
                texts = [t.decode("utf-8", "replace") for t in some.column(1).to_pylist()]
                n = pa.array([len(x) // 4 for x in ids(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), n], ["digest", "n_tokens"])

    counted = missing.mapInArrow(count, "digest binary, n_tokens bigint")
    counted.select(F.unhex(F.lit(version)).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def token_counts(
    docs: DataFrame, cache: str, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """For each row of `docs`: key, n_bytes, n_tokens, over_limit, digest.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, null keys
    and rows that share a text each keep their row. Other columns of `docs`
    are not read; an empty table gives no rows.
    """
    encode_misses(docs, cache, tokenizer, text)
    rows = docs.select(
        F.col(key), F.octet_length(utf8(text)).cast("bigint").alias("n_bytes"), _digest(text).alias("digest")
    )
    counts = cached_counts(docs.sparkSession, cache, tokenizer_version(tokenizer))
    return rows.join(counts, "digest").select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest")
    )


def new_cache(folder: str) -> str:
    return f"{folder}/token-counts-{uuid.uuid4().hex}"
