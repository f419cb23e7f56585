"""Tree ensembles: presets, fitting, cross-validation, out-of-fold scores, importance."""

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.operators.evaluate import fold_metrics, roc_auc
from procsight.operators.sampling import (
    SEED,
    balanced_bags,
    class_weights,
    numbered,
    stratified_folds,
)
from procsight.operators.smote import smote
from procsight.session import stored


@dataclass(frozen=True)
class ModelSpec:
    """What to fit: the ensemble, how to weight the classes, and whether to resample."""

    name: str
    kind: str = "boosted"
    trees: int = 200
    depth: int = 5
    rate: float = 0.05
    rows: float = 1.0
    columns: float | None = None
    least_leaf: int = 1
    weight: str | float | None = None
    resample: str | None = None
    bags: int = 10
    seed: int = SEED


# The published model settings.
PRESETS = {
    "boosted": ModelSpec("boosted", rows=0.8, columns=0.8, weight=19.5),
    "unbalanced": ModelSpec("unbalanced", rows=0.8, columns=0.8, weight="unbalance"),
    "forest": ModelSpec("forest", "forest", depth=10, least_leaf=2, weight="balanced"),
    "weighted": ModelSpec("weighted", rows=0.8, columns=0.8, weight=19.5),
    "focal": ModelSpec(
        "focal", trees=300, depth=8, rate=0.03, rows=0.7, columns=0.7, least_leaf=5, weight=50.0
    ),
    "smote": ModelSpec("smote", rows=0.8, columns=0.8, resample="smote"),
    "bagging": ModelSpec("bagging", "bagging", trees=50, depth=10),
    "hybrid": ModelSpec(
        "hybrid", trees=250, depth=6, rate=0.04, rows=0.75, columns=0.75, weight=20.0, resample="smote"
    ),
}
# Columns that exist only between the stages of a model.
MODEL_COLUMNS = {
    "featuresCol": "__features",
    "rawPredictionCol": "__margin",
    "probabilityCol": "__probability",
    "predictionCol": "__prediction",
}
BASELINES = ["boosted", "unbalanced", "forest"]
STRATEGIES = ["weighted", "focal", "smote", "bagging", "hybrid"]


@dataclass
class Fitted:
    """One or more fitted pipelines; several are averaged."""

    spec: ModelSpec
    features: list[str]
    models: list[PipelineModel] = field(default_factory=list)

    def score(self, df: DataFrame, name: str = "probability_raw") -> DataFrame:
        """Add the positive-class probability."""
        parts = []
        for i, model in enumerate(self.models):
            part = f"__p{i}"
            df = model.transform(df).withColumn(part, vector_to_array(MODEL_COLUMNS["probabilityCol"])[1])
            df = df.drop(*MODEL_COLUMNS.values())
            parts.append(part)
        mean = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
        return df.withColumn(name, mean).drop(*parts)


def preset(name: str, **changes) -> ModelSpec:
    return replace(PRESETS[name], **changes)


def _estimator(spec: ModelSpec, features: list[str], label: str, weighted: bool) -> Pipeline:
    common = dict(
        featuresCol=MODEL_COLUMNS["featuresCol"],
        predictionCol=MODEL_COLUMNS["predictionCol"],
        labelCol=label,
        maxDepth=spec.depth,
        minInstancesPerNode=spec.least_leaf,
        seed=spec.seed,
    )
    if weighted:
        common["weightCol"] = "weight"
    share = str(spec.columns) if spec.columns and spec.columns < 1 else "auto"
    if spec.kind == "boosted":
        trees = GBTClassifier(
            maxIter=spec.trees,
            stepSize=spec.rate,
            subsamplingRate=spec.rows,
            featureSubsetStrategy=share if share != "auto" else "all",
            **common,
        )
    else:
        trees = RandomForestClassifier(
            numTrees=spec.trees, subsamplingRate=spec.rows, featureSubsetStrategy=share, **common
        )
    trees = trees.setRawPredictionCol(MODEL_COLUMNS["rawPredictionCol"])
    trees = trees.setProbabilityCol(MODEL_COLUMNS["probabilityCol"])
    assembler = VectorAssembler(inputCols=features, outputCol=MODEL_COLUMNS["featuresCol"])
    return Pipeline(stages=[assembler, trees])


def fit(
    spec: ModelSpec, train: DataFrame, features: list[str], label: str = LABEL, key: str = KEY
) -> Fitted:
    """Fit one spec: resample, weight, then train."""
    if spec.resample == "smote":
        train = stored(smote(train, features, label, key, seed=spec.seed))
    if spec.kind == "bagging":
        return fit_balanced_bagging(spec, train, features, label, key)
    if spec.weight is not None:
        train = class_weights(train, label, spec.weight)
    model = _estimator(spec, features, label, spec.weight is not None).fit(train)
    return Fitted(spec, features, [model])


def fit_gbt(
    train: DataFrame, features: list[str], label: str = LABEL, key: str = KEY, name: str = "boosted", **changes
) -> Fitted:
    return fit(preset(name, **changes), train, features, label, key)


def fit_random_forest(
    train: DataFrame, features: list[str], label: str = LABEL, key: str = KEY, **changes
) -> Fitted:
    return fit(preset("forest", **changes), train, features, label, key)


def fit_balanced_bagging(
    spec: ModelSpec, train: DataFrame, features: list[str], label: str = LABEL, key: str = KEY
) -> Fitted:
    """One forest per balanced bag; their probabilities are averaged."""
    # Every bag is a pass over the same drawn rows, which are small against the table.
    drawn = stored(balanced_bags(train.select(key, *features, label), label, key, spec.bags, spec.seed))
    pipeline = _estimator(replace(spec, kind="forest"), features, label, False)
    models = [pipeline.fit(drawn.filter(F.col("bag") == bag)) for bag in range(spec.bags)]
    return Fitted(spec, features, models)


def oof_predictions(
    df: DataFrame,
    features: list[str],
    spec: ModelSpec,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    seed: int = SEED,
    train_scores: bool = False,
    then: Callable[[Fitted, DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(key, label, fold, part, probability): each row scored by a model that has not seen it.

    Resampling happens inside the fold, on its training rows only. `then` may
    rework the scored rows of a fold given the model and its training rows.
    """
    folded = stored(stratified_folds(df.select(key, *features, label), label, key, k, seed, df.count()))
    scored = []
    for fold in range(k):
        train, held = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        model = fit(spec, train, features, label, key)
        parts = [("test", held), ("train", train.withColumn("fold", F.lit(fold)))]
        for part, rows in parts[: 2 if train_scores else 1]:
            out = model.score(rows, "probability").withColumn("part", F.lit(part))
            if then:
                out = then(model, train, out)
            scored.append(out.drop(*features))
    everything = scored[0]
    for more in scored[1:]:
        everything = everything.unionByName(more)
    return everything


def leaky_rows(
    df: DataFrame, features: list[str], label: str = LABEL, key: str = KEY, seed: int = SEED
) -> DataFrame:
    """The table oversampled before it is split into folds, with a key for synthetic rows too.

    Reproduces the published, inflated scores; do not use it to judge a model.
    """
    made = F.concat_ws("~", F.col("source").cast("string"), F.col("copy").cast("string"))
    rows = stored(smote(df, features, label, key, seed=seed))
    return rows.select(F.coalesce(F.col(key).cast("string"), made).alias(key), *features, label)


def fold_scores(
    df: DataFrame,
    features: list[str],
    spec: ModelSpec,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    resample: str = "inside",
    train_scores: bool = False,
) -> DataFrame:
    """`oof_predictions`, written once, as metrics and curves take several passes over them."""
    if resample == "before" and spec.resample:
        df = leaky_rows(df, features, label, key, spec.seed)
        spec = replace(spec, resample=None)
    elif resample not in ("inside", "before"):
        raise ValueError(f"unknown resample mode: {resample}")
    return stored(oof_predictions(df, features, spec, label, key, k, spec.seed, train_scores))


def measured(scored: DataFrame, name: str, label: str = LABEL, threshold: float = 0.5) -> DataFrame:
    """(model, fold, part, metric, value), all folds measured by one grouped aggregation."""
    metrics = fold_metrics(scored, "probability", label, ["fold", "part"], threshold)
    return metrics.select(F.lit(name).alias("model"), "fold", "part", "metric", "value")


def cross_validate(
    df: DataFrame,
    features: list[str],
    spec: ModelSpec,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    resample: str = "inside",
    train_scores: bool = False,
    threshold: float = 0.5,
) -> DataFrame:
    """(model, fold, part, metric, value) of one model."""
    return measured(fold_scores(df, features, spec, label, key, k, resample, train_scores), spec.name, label, threshold)


def compare_models(
    df: DataFrame, features: list[str], specs: list[ModelSpec], label: str = LABEL, key: str = KEY, **options
) -> DataFrame:
    """Fold results of several specs, appended."""
    results = [cross_validate(df, features, spec, label, key, **options) for spec in specs]
    everything = results[0]
    for more in results[1:]:
        everything = everything.unionByName(more)
    return everything


def feature_importance(fitted: list[Fitted], spark) -> DataFrame:
    """(feature, importance, model): impurity gain per feature, normalised to 1 per model."""
    rows = []
    for one in fitted:
        weights = [m.stages[-1].featureImportances.toArray() for m in one.models]
        mean = sum(weights) / len(weights)
        share = mean / mean.sum() if mean.sum() else mean
        rows += [(name, float(value), one.spec.name) for name, value in zip(one.features, share)]
    return spark.createDataFrame(rows, "feature string, importance double, model string").orderBy(
        "model", F.desc("importance"), "feature"
    )


def top_importance(importance: DataFrame, k: int = 20) -> DataFrame:
    """The k leading features of each model, with their place."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def save_model(fitted: Fitted, path: str) -> None:
    """Write every pipeline in Spark's own format under `path`."""
    for i, model in enumerate(fitted.models):
        model.write().overwrite().save(f"{path}/part={i}")


def load_model(spec: ModelSpec, features: list[str], path: str, parts: int = 1) -> Fitted:
    models = [PipelineModel.load(f"{path}/part={i}") for i in range(parts)]
    return Fitted(spec, features, models)


# A split in the public description of a tree.
_SPLIT = re.compile(r"If \(feature (\d+) ")


def permutation_importance(
    fitted: Fitted,
    df: DataFrame,
    label: str = LABEL,
    key: str = KEY,
    repeats: int = 10,
    seed: int = SEED,
) -> DataFrame:
    """(feature, drop_mean, drop_std): loss of ROC-AUC when one feature is shuffled.

    Each repeat joins every row once with the row at its place in another hash
    order; a row's variants take one feature each from that partner. Both orders
    are numbered without a global sort. A feature that no tree splits on cannot
    change a score: its loss is 0 and none of its variants is scored.
    """
    names = fitted.features
    used = [names[i] for i in sorted({int(i) for m in fitted.models for i in _SPLIT.findall(m.stages[-1].toDebugString)})]
    # Stored, as every repeat numbers all rows.
    rows = stored(df.select(key, *names, label)).withColumn("__all", F.lit(0))
    placed = stored(numbered(rows, ["__all"], [key], "__place", seed))
    variants = F.array(
        *[
            F.struct(F.lit(one).alias("feature"), *[F.col(f"__other_{c}" if c == one else c).alias(c) for c in names])
            for one in used
        ]
    )
    unused = df.sparkSession.createDataFrame([(c, 0.0, 0.0) for c in names if c not in used], "feature string, drop_mean double, drop_std double")
    if not used:
        return unused
    swapped = None
    for repeat in range(repeats):
        other = numbered(rows.drop(label), ["__all"], [key], "__place", seed + 1 + repeat)
        partner = other.select("__place", *[F.col(c).alias(f"__other_{c}") for c in used])
        part = placed.join(partner, "__place").select(key, label, F.lit(repeat).alias("repeat"), F.explode(variants).alias("__v"))
        swapped = part if swapped is None else swapped.unionByName(part)
    # Stored, as ranks take several passes and a pass would score all variants again.
    scored = stored(fitted.score(swapped.select(key, label, "repeat", "__v.*"), "probability").select("feature", "repeat", label, "probability"))
    whole = roc_auc(fitted.score(rows, "probability"), "probability", label).first()["roc_auc"]
    areas = roc_auc(scored, "probability", label, ["feature", "repeat"])
    found = areas.groupBy("feature").agg(
        F.avg(F.lit(whole) - F.col("roc_auc")).alias("drop_mean"),
        F.stddev_pop("roc_auc").alias("drop_std"),
    )
    return found.unionByName(unused)


def soft_vote(fitted: list[Fitted], df: DataFrame, name: str = "probability") -> DataFrame:
    """Mean probability of several models."""
    for i, one in enumerate(fitted):
        df = one.score(df, f"__vote{i}")
    votes = [F.col(f"__vote{i}") for i in range(len(fitted))]
    mean = sum(votes[1:], votes[0]) / len(votes)
    return df.withColumn(name, mean).drop(*[f"__vote{i}" for i in range(len(fitted))])


def stack(
    df: DataFrame, features: list[str], specs: list[ModelSpec], label: str = LABEL, key: str = KEY, k: int = 5
):
    """A logistic regression on the out-of-fold scores of several models, and those scores."""
    joined, names = None, []
    for spec in specs:
        part = oof_predictions(df, features, spec, label, key, k).select(
            key, label, F.col("probability").alias(spec.name)
        )
        joined = part if joined is None else joined.join(part.drop(label), key)
        names.append(spec.name)
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol=label),
        ]
    )
    return pipeline.fit(joined), joined
