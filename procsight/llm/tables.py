"""Intermediate tables in the cluster's shared folder, and the columns that operators read."""

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight.llm.words import slices
from procsight.session import shared_folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to `path` and read it back: the lineage ends, a lost executor costs a scan."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    return written(df, new_path(df.sparkSession, name))


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no later job reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand workers fewer rows at a time: texts are long, and a batch is held by Spark and by the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(column: str):
    """The column's bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def held_out(column: str = "doc_id", remainder: int = 2, of: int = 4):
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False))


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows chosen by a hash of `key`: the same rows in every run; all, if there are no more."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("bounded"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def bounded_by(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each value of a text column, chosen by a hash of `key`; all of a value that has no more.

    The values' counts over all rows come to the driver, so they must be few.
    """
    counts = {r[group]: r["count"] for r in df.where(F.col(group).isNotNull()).groupBy(group).count().collect()}
    if not counts:
        return df.where(F.lit(False))
    limits = {g: int((1 << 30) * min(1.0, most / n)) for g, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col(group))
    return df.where(F.pmod(F.xxhash64(F.lit("bounded"), F.col(key)), F.lit(1 << 30)) < limit)


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of `docs` whose texts `keep` marks, with all their columns: no join, nothing is shuffled."""
    at = docs.columns.index(text)

    def filtered(batches):
        for batch in batches:
            for some in slices(batch, at):
                yield some.filter(pa.array(keep(pc.fill_null(some.column(at), "").cast(pa.binary()))))

    return docs.mapInArrow(filtered, docs.schema)
