"""The exploratory flow: clean both tables, compute every report, write them."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from procsight import KEY, LABEL
from procsight.functions.columns import feature_columns
from procsight.operators import charts, cleaning, correlation, interactions, isolation, latent
from procsight.operators import univariate, windows
from procsight.session import stored
from procsight.sources.tables import write_cleaned, write_reports


@dataclass
class Cleaned:
    train: DataFrame
    test: DataFrame
    features: list[str]
    violations: DataFrame


def clean(train: DataFrame, test: DataFrame, label: str = LABEL) -> Cleaned:
    """Coerce, fill by training medians, validate."""
    features = feature_columns(train)
    train = cleaning.coerce_numeric(train, features)
    test = cleaning.coerce_numeric(test, [c for c in features if c in test.columns])
    medians = cleaning.fit_median(train, features)
    train, test = cleaning.apply_fill(train, medians), cleaning.apply_fill(test, medians)
    return Cleaned(train, test, features, cleaning.validate_clean(train, test, features, label))


def eda_reports(
    train: DataFrame, features: list[str], label: str = LABEL, key: str = KEY
) -> dict[str, DataFrame]:
    """All per-feature and per-pair reports of a clean, labelled table.

    The ranking of the features is the only result later reports depend on; it
    is read once (15 names).
    """
    ranked = univariate.ranked_features(train, features, label, interactions.TOP_FEATURES)
    density = interactions.defect_density_map(train, interactions.pair_list(ranked), label)
    density = stored(density)
    pairs = interactions.risk_score(interactions.interaction_strength(density))
    profile = univariate.ClassProfile(train, features, label)
    sliding = windows.operating_windows(train, ranked[: windows.TOP_FEATURES], label, key, top=None)
    return {
        "dataset": cleaning.dataset_profile(train, features),
        "low_variance": cleaning.low_variance_features(train, features),
        "classes": cleaning.class_distribution(train, label),
        "imbalance": cleaning.imbalance_ratio(train, label),
        "univariate": univariate.univariate_stats(train, features, label, profile=profile),
        "instability": univariate.cv_instability(train, features, label, profile),
        "outliers": univariate.iqr_outliers(train, features, label, profile=profile),
        "redundancy": correlation.redundancy(train, features),
        "breakdowns": correlation.correlation_breakdowns(train, features, label),
        "blocks": correlation.feature_blocks(train, features),
        "stages": correlation.process_stages(train, features),
        "interactions": pairs.drop("pair_index"),
        "conditional": interactions.conditional_cells(density),
        "unstable_regions": interactions.exclusive_cells(density),
        "thresholds": windows.critical_threshold(sliding),
        "histograms": charts.histogram_by_class(train, ranked[: charts.CHART_FEATURES], label, top=None),
        "boxplots": charts.boxplot_by_class(train, ranked[: charts.CHART_FEATURES], label, top=None),
        "significance_chart": charts.significance_chart(train, features, label),
        "heatmap": charts.heatmap_long(train, features, label),
        "diversity": univariate.profile_diversity(train, features, label, profile),
        "entropy": univariate.signature_entropy(train, features, label, profile),
    }


def latent_reports(
    train: DataFrame, features: list[str], label: str = LABEL, key: str = KEY
) -> dict[str, DataFrame]:
    """Clusters, anomalies, components and regimes."""
    flagged = isolation.isolation_forest(train, features, key, label)
    components = latent.pca_profile(train, features)
    return {
        "defect_clusters": latent.defect_clusters(train, features, label),
        "anomaly_share": isolation.anomaly_share(flagged, label),
        "anomalies": charts.anomaly_chart(flagged, label),
        "components": components,
        "component_points": charts.pca_points(train, features, label),
        "regime_points": charts.regime_points(train, features, label),
        "components_needed": latent.components_needed(components),
        "regimes": charts.regime_chart(latent.operating_regimes(train, features, label)),
    }


def run_eda(
    train: DataFrame, test: DataFrame, folder: str, label: str = LABEL, key: str = KEY, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """Clean, write the clean tables, then compute and write all reports.

    The reports read the written clean table, so a lost executor costs a scan
    and not the cleaning.
    """
    cleaned = clean(train, test, label)
    broken = cleaned.violations.filter("check_name = 'null_in_train'").count()
    if broken:
        raise ValueError(f"{broken} features still have gaps")
    train_path, _ = write_cleaned(cleaned.train, cleaned.test, folder, "parquet")
    stored = train.sparkSession.read.parquet(train_path)
    reports = eda_reports(stored, cleaned.features, label, key)
    reports |= latent_reports(stored, cleaned.features, label, key)
    write_reports(reports, f"{folder}/reports", fmt)
    return reports
