"""The scoring flow: load the trained models, score a table, write the result tables.

Training is not repeated per scoring run; the models are loaded.
"""

from pyspark.sql import DataFrame

from procsight import KEY
from procsight.operators import features as engineered, models, scoring
from procsight.operators.calibrate import CalibratedEnsemble
from procsight.session import stored
from procsight.sources.tables import write_predictions


class Scorer:
    """Feature set 2, raw and calibrated probability; works on batch and streaming frames."""

    def __init__(self, model: models.Fitted, calibrator: CalibratedEnsemble, features: list[str]):
        self.model, self.calibrator, self.features = model, calibrator, features

    @classmethod
    def load(cls, folder: str, features: list[str], folds: int = 5) -> "Scorer":
        names = [*features, *engineered.set2_registry()]
        spec = models.PRESETS["hybrid"]
        return cls(
            models.load_model(spec, names, f"{folder}/models/raw"),
            CalibratedEnsemble.load(f"{folder}/models/calibrated", spec, names, folds),
            features,
        )

    def __call__(self, rows: DataFrame) -> DataFrame:
        wide = engineered.features_set2(rows, self.features)
        return self.calibrator.score(self.model.score(wide, "probability_raw"), "probability_calibrated")


def run_scoring(
    rows: DataFrame, scorer: Scorer, folder: str, key: str = KEY, threshold: float = scoring.THRESHOLD
) -> dict[str, DataFrame]:
    """Predictions, detailed predictions and the summary, written and returned."""
    scored = stored(scorer(rows))
    new = list(engineered.set2_registry())
    predictions = scoring.predictions_table(scored, key=key, threshold=threshold)
    tables = {
        "predictions": predictions,
        "predictions_detailed": scoring.predictions_detailed(
            scored, scorer.features, new, key=key, threshold=threshold
        ),
        "prediction_summary": scoring.prediction_summary(
            predictions, threshold=threshold, original=len(scorer.features), engineered=len(new)
        ),
    }
    write_predictions(*tables.values(), folder)
    return tables
