"""The training flows: baselines, imbalance strategies, and the final calibrated model."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.operators import charts, evaluate, explain, features as engineered, models
from procsight.operators.calibrate import CalibratedEnsemble, calibrate_cv, calibrated_oof
from procsight.session import stored
from procsight.sources.tables import write_reports


def resized(names: list[str], trees: int | None) -> list[models.ModelSpec]:
    """Presets, optionally with another number of trees."""
    specs = [models.PRESETS[name] for name in names]
    return [replace(spec, trees=trees) for spec in specs] if trees else specs


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    return whole


def run_baselines(
    train: DataFrame,
    features: list[str],
    folder: str,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    trees: int | None = None,
) -> dict[str, DataFrame]:
    """Cross-validated baselines: results, ROC curves by fold, importance, attributions, and the first model's best threshold."""
    specs = resized(models.BASELINES, trees)
    # One set of fold scores of each model serves the results, the curves and the thresholds.
    scored = {spec.name: models.fold_scores(train, features, spec, label, key, k, train_scores=True) for spec in specs}
    results = _all([models.measured(rows, name, label) for name, rows in scored.items()])
    held = {name: rows.filter("part = 'test'") for name, rows in scored.items()}
    curves = [
        evaluate.roc_curve(rows, "probability", label, ["fold"]).withColumn("model", F.lit(name)) for name, rows in held.items()
    ]
    fitted = [models.fit(spec, train, features, label, key) for spec in specs]
    importance = stored(models.feature_importance(fitted, train.sparkSession))
    sweep = evaluate.threshold_sweep(held[specs[0].name], "probability", label, evaluate.threshold_grid(100))
    reports = {
        "model_comparison": evaluate.model_comparison(results.filter("part = 'test'")),
        "fold_results": results,
        "roc_by_fold": _all(curves),
        "feature_importance": importance,
        "feature_importance_top": models.top_importance(importance),
        "threshold_curve": sweep,
        "optimal_threshold": evaluate.optimal_threshold(sweep, "f1", fallback=None),
    }
    boosted = [one for one in fitted if one.spec.kind == "boosted"]
    if boosted:
        # Boosted models are explained on their training rows, the first one's first defect also by itself.
        explained = {
            one.spec.name: stored(explain.tree_attributions(train, features, one.models[0].stages[-1], key, label)) for one in boosted
        }
        reports["attributions"] = _all(
            [explain.global_attributions(rows, features).withColumn("model", F.lit(name)) for name, rows in explained.items()]
        )
        first = next(iter(explained.values()))
        reports["attributions_first_defect"] = explain.explain_first_defect(first, features, key, label)
    write_reports(reports, folder)
    for one in fitted:
        models.save_model(one, f"{folder}/models/{one.spec.name}")
    return reports


def run_strategies(
    train: DataFrame,
    features: list[str],
    folder: str,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    trees: int | None = None,
    resample: str = "inside",
) -> dict[str, DataFrame]:
    """Feature set 1, the five imbalance strategies, and threshold curves of three of them."""
    stats = engineered.fit_statistics(train, features, label)
    # Every fit below reads the engineered rows many times.
    wide = stored(engineered.features_set1(train, stats, features))
    names = [*features, *engineered.set1_registry(features)]
    specs = resized(models.STRATEGIES, trees)
    results = models.compare_models(wide, names, specs, label, key, k=k, resample=resample)
    comparison = stored(evaluate.strategy_comparison(results))
    reports = {"strategy_comparison": comparison, "strategy_chart": charts.strategy_chart(comparison)}
    for spec in specs[:3]:
        # The curves score models fitted on the rows as they are, as the comparison table does not.
        scored = models.oof_predictions(wide, names, replace(spec, resample=None), label, key, k)
        reports[f"threshold_curve_{spec.name}"] = evaluate.threshold_sweep(scored, "probability", label)
    registry = engineered.set1_registry(features)
    reports["engineered_features"] = engineered.feature_registry(train, registry)
    reports["feature_types"] = engineered.feature_type_counts(reports["engineered_features"])
    write_reports(reports, folder)
    return reports


@dataclass
class Final:
    model: models.Fitted
    calibrator: CalibratedEnsemble
    sweep: DataFrame
    features: list[str]


def run_final(
    train: DataFrame,
    features: list[str],
    folder: str,
    label: str = LABEL,
    key: str = KEY,
    k: int = 5,
    trees: int | None = None,
) -> Final:
    """Feature set 2, the hybrid model, its calibrated ensemble, and the out-of-fold threshold curve."""
    wide = stored(engineered.features_set2(train, features))
    names = [*features, *engineered.set2_registry()]
    spec = resized(["hybrid"], trees)[0]
    scored = stored(calibrated_oof(wide, names, spec, label, key, k))
    sweep = evaluate.threshold_sweep(scored, "probability_calibrated", label)
    model = models.fit(spec, wide, names, label, key)
    calibrator = calibrate_cv(wide, names, replace(spec, resample=None), label, key, k)
    write_reports(
        {
            "threshold_curve": sweep,
            "optimal_threshold": evaluate.optimal_threshold(sweep, "f1", fallback=None),
            "engineered_features": engineered.feature_registry(train, engineered.set2_registry()),
        },
        folder,
    )
    models.save_model(model, f"{folder}/models/raw")
    calibrator.save(f"{folder}/models/calibrated")
    return Final(model, calibrator, sweep, names)
