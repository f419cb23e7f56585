"""Sigmoid calibration of scores, and the calibrated variants of the training flow."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.operators.models import (
    Fitted,
    ModelSpec,
    fit,
    load_model,
    oof_predictions,
    save_model,
)
from procsight.operators.sampling import SEED, numbered, stratified_folds
from procsight.session import stored


def platt_calibrate(scored: DataFrame, score: str, label: str = LABEL) -> PipelineModel:
    """Fit a sigmoid on (score, label) with smoothed targets.

    A row with target t enters twice, as a positive of weight t and a negative
    of weight 1 - t, which has the same optimum as the smoothed likelihood.
    """
    sizes = scored.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).first()
    if not sizes["pos"] or not sizes["neg"]:
        raise ValueError("calibration needs both classes")
    high = (sizes["pos"] + 1.0) / (sizes["pos"] + 2.0)
    low = 1.0 / (sizes["neg"] + 2.0)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    sides = F.array(
        F.struct(F.lit(1.0).alias("side"), target.alias("share")),
        F.struct(F.lit(0.0).alias("side"), (1 - target).alias("share")),
    )
    doubled = scored.select(F.col(score).alias("__score"), F.inline(sides))
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=["__score"], outputCol="__scores"),
            LogisticRegression(
                featuresCol="__scores",
                labelCol="side",
                weightCol="share",
                regParam=0.0,
                maxIter=200,
                tol=1e-10,
                probabilityCol="__calibrated",
                rawPredictionCol="__raw",
                predictionCol="__side",
            ),
        ]
    )
    return pipeline.fit(doubled)


def apply_platt(
    df: DataFrame, model: PipelineModel, score: str, name: str = "probability_calibrated"
) -> DataFrame:
    out = model.transform(df.withColumn("__score", F.col(score)))
    out = out.withColumn(name, vector_to_array("__calibrated")[1])
    return out.drop("__score", "__scores", "__raw", "__calibrated", "__side")


class CalibratedEnsemble:
    """k base models, each with the sigmoid fitted on the rows it has not seen; scores are averaged."""

    def __init__(self, members: list[tuple[Fitted, PipelineModel]]):
        self.members = members

    def score(self, df: DataFrame, name: str = "probability_calibrated") -> DataFrame:
        parts = []
        for i, (model, sigmoid) in enumerate(self.members):
            df = apply_platt(model.score(df, "__base"), sigmoid, "__base", f"__c{i}").drop("__base")
            parts.append(f"__c{i}")
        mean = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
        return df.withColumn(name, mean).drop(*parts)

    def save(self, path: str) -> None:
        for i, (model, sigmoid) in enumerate(self.members):
            save_model(model, f"{path}/member={i}/model")
            sigmoid.write().overwrite().save(f"{path}/member={i}/sigmoid")

    @classmethod
    def load(cls, path: str, spec: ModelSpec, features: list[str], k: int = 5) -> "CalibratedEnsemble":
        return cls(
            [
                (
                    load_model(spec, features, f"{path}/member={i}/model"),
                    PipelineModel.load(f"{path}/member={i}/sigmoid"),
                )
                for i in range(k)
            ]
        )


def calibrate_cv(
    df: DataFrame,
    features: list[str],
    spec: ModelSpec,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    seed: int = SEED,
) -> CalibratedEnsemble:
    """Refit the base model on k-1 parts, fit the sigmoid on the remaining one, k times."""
    folded = stored(stratified_folds(df.select(key, *features, label), label, key, k, seed))
    members = []
    for fold in range(k):
        model = fit(spec, folded.filter(F.col("fold") != fold), features, label, key)
        held = model.score(folded.filter(F.col("fold") == fold), "__base")
        members.append((model, platt_calibrate(held, "__base", label)))
    return CalibratedEnsemble(members)


def calibrated_oof(
    df: DataFrame,
    features: list[str],
    spec: ModelSpec,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    seed: int = SEED,
) -> DataFrame:
    """(key, label, fold, probability, probability_calibrated): each fold's scores are calibrated
    by the sigmoid fitted on the other folds' out-of-fold scores."""
    scored = stored(oof_predictions(df, features, spec, label, key, k, seed))
    parts = []
    for fold in range(k):
        sigmoid = platt_calibrate(scored.filter(F.col("fold") != fold), "probability", label)
        parts.append(apply_platt(scored.filter(F.col("fold") == fold), sigmoid, "probability"))
    everything = parts[0]
    for more in parts[1:]:
        everything = everything.unionByName(more)
    return everything


def calibrated_oof_mixed(
    df: DataFrame,
    features: list[str],
    spec: ModelSpec,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    inner: int = 5,
    seed: int = SEED,
) -> DataFrame:
    """The published variant: in every validation fold the first half keeps raw scores, the second
    half gets those of a calibrated ensemble fitted on the first half.

    Raw and calibrated scores come from different models there; `calibrated_oof`
    is the sound form.
    """
    plain = ModelSpec(**{**spec.__dict__, "resample": None})

    def mix(model: Fitted, train: DataFrame, scored: DataFrame) -> DataFrame:
        scored = stored(scored)
        half = scored.count() // 2
        placed = stored(
            numbered(scored.withColumn("__all", F.lit(0)), ["__all"], [key], "__place", seed).drop("__all")
        )
        first = placed.filter(F.col("__place") < half).drop("__place")
        second = placed.filter(F.col("__place") >= half).drop("__place")
        ensemble = calibrate_cv(first, features, plain, label, key, inner, seed)
        return first.withColumn("probability_mixed", F.col("probability")).unionByName(
            ensemble.score(second, "probability_mixed")
        )

    return oof_predictions(df, features, spec, label, key, k, seed, then=mix)
