"""Synthetic minority rows between near neighbours.

The neighbour search is exact (see `balltree`). It runs over distinct points, so a
point that very many rows share is searched for once; only the first keys of
its rows can be anyone's neighbours.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.operators.balltree import ROWS_PER_LEAF, nearest_points
from procsight.operators.sampling import SEED, class_weights, hashed, numbered, unit
from procsight.session import stored


def nearest_neighbours(
    df: DataFrame,
    features: list[str],
    key: str = KEY,
    k: int = 3,
    rows_per_leaf: int = ROWS_PER_LEAF,
) -> DataFrame:
    """(key, neighbour, place, distance): the k nearest other rows of each row, ties by key.

    Rows that lack a feature have no place and take no part.
    """
    return searched(df, features, key, k, rows_per_leaf)[0]


def searched(
    df: DataFrame, features: list[str], key: str = KEY, k: int = 3, rows_per_leaf: int = ROWS_PER_LEAF
) -> tuple[DataFrame, float]:
    """`nearest_neighbours`, and how many leaves of the tree a distinct point visited on average."""
    point = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(key, point.alias("point")).filter(F.forall("point", lambda x: x.isNotNull() & ~F.isnan(x)))
    n = rows.count()
    if n <= k:
        raise ValueError(f"{n} rows have no {k} neighbours each")
    # The first k + 1 keys of each point; the limit holds in each map task already.
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("point").orderBy(key))).filter(F.col("nth") <= k + 1)
    points = stored(
        first.groupBy("point")
        .agg(F.sort_array(F.collect_list(key)).alias("keys"))
        .withColumn("id", F.col("keys")[0])
    )
    hits, visited = nearest_points(points.select("id", "point"), k, rows_per_leaf)

    def named(keys, distance):
        return F.transform(keys, lambda name: F.struct(distance.alias("distance"), name.alias("neighbour")))

    others = (
        hits.join(points.select(F.col("id").alias("other"), "keys"), "other")
        .select("id", F.explode(named(F.slice("keys", 1, k), F.col("distance"))).alias("x"))
        .groupBy("id")
        .agg(F.collect_list("x").alias("others"))
    )
    # A point's own rows are at distance 0; one of the k + 1 may be the row itself.
    near = points.join(others, "id", "left").select(
        "point",
        F.slice(
            F.sort_array(F.concat(named(F.col("keys"), F.lit(0.0)), F.coalesce("others", F.array()))), 1, k + 1
        ).alias("near"),
    )
    own = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col(key)), 1, k)
    found = rows.join(near, "point").select(key, F.posexplode(own).alias("place", "x"))
    return found.select(key, "x.neighbour", (F.col("place") + 1).alias("place"), "x.distance"), visited


def smote(
    df: DataFrame,
    features: list[str],
    label: str = LABEL,
    key: str = KEY,
    k: int = 3,
    seed: int = SEED,
    rows_per_leaf: int = ROWS_PER_LEAF,
) -> DataFrame:
    """The table plus synthetic minority rows that bring the classes to 1:1.

    Columns: key (null for synthetic rows), features, label, synthetic,
    source, copy, neighbour, gap. The synthetic rows are dealt evenly over the
    minority rows; neighbour and gap of each come from a hash.
    """
    rows = df.select(key, *features, label)
    sizes = {row[label]: row["count"] for row in rows.groupBy(label).count().collect()}
    minority, majority = sorted(sizes, key=lambda value: (sizes[value], -value))[:2]
    short = sizes[majority] - sizes[minority]
    kind = dict(df.dtypes)[key]
    originals = rows.withColumns(
        {
            "synthetic": F.lit(False),
            "source": F.lit(None).cast(kind),
            "neighbour": F.lit(None).cast(kind),
            "gap": F.lit(None).cast("double"),
            "copy": F.lit(None).cast("int"),
        }
    )
    if short == 0:
        return originals
    few = rows.filter(F.col(label) == minority)
    near = nearest_neighbours(few, features, key, k, rows_per_leaf).select(key, "neighbour", "place")
    share, extra = divmod(short, sizes[minority])
    # What a row's copies can end at, gathered by row, so that copies, up to a table of them, are made after the last shuffle.
    ends = few.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"__to_{c}") for c in features])
    targets = near.join(ends, "neighbour").groupBy(key).agg(
        F.collect_list(F.struct("place", "neighbour", *[f"__to_{c}" for c in features])).alias("__targets")
    )
    made = (
        numbered(few, [label], [key], "__place", seed)
        .withColumn("__copies", F.lit(share) + (F.col("__place") < extra).cast("int"))
        .filter(F.col("__copies") > 0)
        .join(targets, key)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .withColumn("__turn", (F.pmod(hashed([key, "__copy"], seed + 3), F.lit(k)) + 1).cast("int"))
        .withColumn("gap", unit(hashed([key, "__copy"], seed + 4)))
        .select(key, *features, label, "gap", "__copy", F.inline(F.filter("__targets", lambda x: x["place"] == F.col("__turn"))))
        .select(
            F.lit(None).cast(kind).alias(key),
            *[(F.col(c) + F.col("gap") * (F.col(f"__to_{c}") - F.col(c))).alias(c) for c in features],
            F.col(label),
            F.lit(True).alias("synthetic"),
            F.col(key).alias("source"),
            "neighbour",
            "gap",
            F.col("__copy").cast("int").alias("copy"),
        )
    )
    return originals.unionByName(made)


def hybrid_resample(
    df: DataFrame, features: list[str], label: str = LABEL, key: str = KEY, weight: float = 20.0, **options
) -> DataFrame:
    """Synthetic oversampling to 1:1, then a weight on the positive class."""
    return class_weights(smote(df, features, label, key, **options), label, weight)
