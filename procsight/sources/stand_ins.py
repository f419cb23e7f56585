"""Measurement tables derived from the given driver tables.

The same definitions exist in SQL in `checks/oracles.py`.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight import KEY, LABEL

WIDE = [f"X{i}" for i in range(1, 50)]
SCALE = [f"X{i}" for i in range(1, 10)]
TEXTS = [f"X{i}" for i in range(1, 4)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a stream of its files, be the table one file or a folder of them."""
    whole = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(whole)
    # A stream reads folders only.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


# Rows that a task should get, and those of a table that every task may hold.
ROWS_PER_TASK, SMALL = 1_000_000, 2_000_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a table that comes in fewer files than there are cores.

    A table of many files, or of more rows than the cores' tasks should get, is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.count() <= cores * ROWS_PER_TASK
    return df.repartition(cores, key) if few else df


def _met(df: DataFrame, key: str, rows: int, other: DataFrame, other_key: str, other_rows: int) -> DataFrame:
    """An equi-join in tasks of bounded size, so that they sort in memory; a small `other` is sent to all of them."""
    on = df[key] == other[other_key]
    if other_rows <= SMALL:
        return df.join(F.broadcast(other), on)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_TASK))
    return df.repartition(parts, key).join(other.repartition(parts, other_key), on)


def measurements_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """49 measurements per row, label = (class 0)."""
    return embedding_measurements(table(spark, sf_dir, "embeddings"))


def embedding_measurements(vectors: DataFrame) -> DataFrame:
    """The same of any table, or stream, of vectors."""
    return vectors.select(
        F.col("vec_id").alias(KEY),
        *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(WIDE)],
        (F.col("label") == 0).cast("int").alias(LABEL),
    )


def measurements_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`measurements_embeddings` where some sensors lose readings beyond a limit."""
    full = measurements_embeddings(spark, sf_dir)
    lost = {c: F.when(F.abs(F.col(c)) <= 0.25, F.col(c)) for c in ("X8", "X10", "X15", "X16")}
    lost["X42"] = F.when(F.col("X42") >= -0.2, F.col("X42"))
    return full.withColumns(lost)


def measurements_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`measurements_embeddings` with text in X1..X3, some of it not a number."""
    full = measurements_embeddings(spark, sf_dir)

    def spoiled(name: str):
        value = F.col(name)
        return (
            F.when(value > 0.25, "n/a")
            .when(value < -0.25, "")
            .when(value > 0.2, "NaN")
            .when(value < -0.2, F.concat(F.lit(" "), value.cast("string"), F.lit("f")))
            .otherwise(F.concat(F.lit(" "), value.cast("string"), F.lit(" ")))
        )

    return full.withColumns({name: spoiled(name) for name in TEXTS})


def measurements_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine measurements per order line, about 5 % positives.

    The key is the text of (order, line, part, supplier, ship day), unique at any size.
    """
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    lines, bills, parts, clients, makers = (x.count() for x in (line, orders, part, customer, supplier))
    # The lines, by far the most rows, meet the orders when these have found their customers: each join deals the lines out anew.
    bought = _met(orders, "o_custkey", bills, customer, "c_custkey", clients)
    joined = _met(spread(line, "l_orderkey"), "l_orderkey", lines, bought, "o_orderkey", bills)
    joined = _met(joined, "l_partkey", lines, part, "p_partkey", parts)
    joined = _met(joined, "l_suppkey", lines, supplier, "s_suppkey", makers)
    sources = {
        "X1": "l_quantity",
        "X2": "l_extendedprice",
        "X3": "l_discount",
        "X4": "l_tax",
        "X5": "p_size",
        "X6": "p_retailprice",
        "X7": "s_acctbal",
        "X8": "o_totalprice",
        "X9": "c_acctbal",
    }
    return joined.select(
        line_key().alias(KEY),
        *[F.col(column).cast("double").alias(name) for name, column in sources.items()],
        ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).cast("int").alias(LABEL),
    )


def line_key():
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *parts, F.date_format("l_shipdate", "yyyyMMdd"))


def measurements_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length measurements of the labelled documents, label = toxic."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias(KEY),
        F.col("n_chars").cast("double").alias("X1"),
        F.length("text").cast("double").alias("X2"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
        .cast("double")
        .alias("X3"),
        F.col("toxic").cast("int").alias(LABEL),
    )


def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length measurements of all documents, without a label."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(KEY),
        F.col("n_chars").cast("double").alias("X1"),
        F.length("text").cast("double").alias("X2"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
        .cast("double")
        .alias("X3"),
    )


def measurements_taxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`measurements_lineitem` with a label that fills a corner of (discount, tax): cells with defects only."""
    corner = (F.col("X3") >= 0.08) & (F.col("X4") >= 0.06)
    return measurements_lineitem(spark, sf_dir).withColumn(LABEL, corner.cast("int"))


def scores_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, p, y): a score with at most 50 distinct values, so with many ties."""
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        line_key().alias(KEY),
        (F.col("l_quantity") / 50.0).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def scores_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, p, y): a score with nearly as many distinct values as rows."""
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        line_key().alias(KEY),
        (F.col("l_extendedprice") / 110000.0).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold result table (model, fold, metric, value) derived from order lines.

    Each return flag plays a model, each line number a fold and each mean a metric.
    """
    line = table(spark, sf_dir, "lineitem")
    means = line.groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linenumber").cast("int").alias("fold")
    ).agg(
        F.avg(F.col("l_quantity") / 50).alias("roc_auc"),
        F.avg(F.col("l_discount") * 10).alias("f1"),
        F.avg(F.col("l_tax") * 10).alias("precision"),
        F.avg((F.col("l_linestatus") == "O").cast("double")).alias("recall"),
        F.avg(F.col("l_extendedprice") / 110000).alias("accuracy"),
    )
    metrics = ["roc_auc", "f1", "precision", "recall", "accuracy"]
    return means.unpivot(["model", "fold"], metrics, "metric", "value")
