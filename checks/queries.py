"""Registered queries: every operator on the given tables, whole.

Doubles are rounded and integers widened so that two engines can be compared.
"""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight import KEY, LABEL
from procsight.operators import charts, cleaning, correlation, drift, evaluate, features, interactions
from procsight.operators import isolation, latent, models, sampling, scoring, univariate, windows
from procsight.operators.calibrate import (
    apply_platt,
    calibrate_cv,
    calibrated_oof,
    calibrated_oof_mixed,
    platt_calibrate,
)
from procsight.operators.explain import (
    attribution_rows,
    explain_first_defect,
    global_attributions,
    tree_attributions,
)
from procsight.operators.smote import hybrid_resample, nearest_neighbours, smote
from procsight.session import shared_folder, stored
from procsight.sources import stand_ins as given
from procsight.plans import training
from procsight.sources import tables
from procsight.streaming.scoring import start_drift, stream_drift, stream_monitor, stream_score

WIDE, SCALE = given.WIDE, given.SCALE
DOCS = ["X1", "X2", "X3"]
# Small ensembles: these queries check the flow, not the published tree counts.
TREES = {"trees": 5}
FOLDS = 5


# Columns too large for six decimals in a double.
COARSE = {"tie_term": 0, "u_defect": 1, "u_normal": 1}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), COARSE.get(name, digits)) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "boolean":
            column = column.cast("int").cast("bigint")
        columns.append(column.alias(name))
    return df.select(*columns)


def scratch(spark: SparkSession) -> str:
    """A new folder inside the shared one."""
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def embeddings(spark, sf):
    return given.measurements_embeddings(spark, sf)


def lines(spark, sf):
    return given.measurements_lineitem(spark, sf)


def kept_lines(spark, sf):
    """The same rows, joined and written once, for operators that read them several times."""
    return stored(lines(spark, sf))


def large_lines(columns=None):
    """`kept_lines` of some columns where the lines are many; few are joined again by each pass, which takes no disk."""

    def rows(spark, sf):
        df = lines(spark, sf).select(*columns) if columns else lines(spark, sf)
        return stored(df) if given.table(spark, sf, "lineitem").count() > given.ROWS_PER_TASK else df

    return rows


def _on(source, operator, digits=6):
    """A query that applies `operator` to a stand-in table."""
    return lambda spark, sf: tidy(operator(source(spark, sf)), digits)


# --- sources and sinks -----------------------------------------------------------------------


def read_measurements(spark, sf):
    raw = tables.read_measurements(spark, f"{sf}/lineitem.parquet", "parquet")
    return tidy(
        raw.groupBy("l_returnflag").agg(
            F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
        )
    )


def read_cleaned(spark, sf):
    return tidy(
        tables.read_cleaned(spark, f"{sf}/documents.parquet")
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    )


def write_cleaned(spark, sf):
    raw = given.measurements_gaps(spark, sf)
    medians = cleaning.fit_median(raw, WIDE)
    train = cleaning.apply_fill(raw, medians)
    paths = tables.write_cleaned(train, train.drop(LABEL), scratch(spark), "csv")
    back = tables.read_cleaned(spark, paths[0], "csv")
    return tidy(back.groupBy(LABEL).agg(F.count("*").alias("n"), F.avg("X8").alias("mean_x8")))


def write_reports(spark, sf):
    df = embeddings(spark, sf)
    reports = {
        "univariate": univariate.univariate_stats(df, WIDE),
        "instability": univariate.cv_instability(df, WIDE),
        "redundancy": correlation.redundancy(df, WIDE),
        "interactions": interactions.risk_score(interactions.interaction_scan(df, WIDE)),
    }
    folder = scratch(spark)
    tables.write_reports(reports, folder)
    back = tables.read_eda_tables(spark, folder)
    sizes = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("report"), "n") for name, t in back.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).unionByName(sizes[3])


# --- cleaning --------------------------------------------------------------------------------


def coerce_numeric(spark, sf):
    raw = given.measurements_text(spark, sf)
    return tidy(cleaning.coerce_numeric(raw, given.TEXTS).select(KEY, *given.TEXTS))


def fill_report(spark, sf):
    raw = given.measurements_gaps(spark, sf)
    return tidy(cleaning.fill_report(raw, cleaning.fit_median(raw, WIDE)))


def apply_fill(spark, sf):
    raw = given.measurements_gaps(spark, sf)
    filled = cleaning.apply_fill(raw, cleaning.fit_median(raw, WIDE))
    return tidy(filled.select(KEY, "X8", "X10", "X15", "X16", "X42"))


def validate_clean(spark, sf):
    raw = given.measurements_gaps(spark, sf)
    return tidy(cleaning.validate_clean(raw, embeddings(spark, sf).drop(LABEL), WIDE))


def class_filter(spark, sf):
    rows = cleaning.class_filter(lines(spark, sf), 1)
    return tidy(rows.agg(F.count("*").alias("n"), F.sum("X1").alias("quantity")))


def duplicate_count(spark, sf):
    return cleaning.duplicate_count(given.table(spark, sf, "documents"))


def impute_mean(spark, sf):
    filled = cleaning.impute(given.measurements_gaps(spark, sf), WIDE, "mean")
    return tidy(filled.select(KEY, "X8", "X42"))


def impute_drop(spark, sf):
    kept = cleaning.impute(given.measurements_gaps(spark, sf), WIDE, "drop")
    return tidy(kept.agg(F.count("*").alias("n"), F.avg("X1").alias("mean_x1")))


def drop_sparse_columns(spark, sf):
    full = given.table(spark, sf, "documents").join(given.table(spark, sf, "labels"), "doc_id", "left")
    named = full.select(
        "doc_id", F.col("n_chars").alias("X1"), F.col("quality").alias("X2"), F.col("toxic").alias("X3")
    )
    kept = cleaning.drop_sparse_columns(named, ["X1", "X2", "X3"], 0.5)
    return tidy(kept.agg(F.count("*").alias("n"), F.lit(len(kept.columns)).alias("columns_left")))


# --- interactions and windows ----------------------------------------------------------------


def quantile_bins(spark, sf):
    binned = interactions.quantile_bins(lines(spark, sf), SCALE)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bin").alias("bin")) for c in SCALE]
    return tidy(binned.select(F.inline(F.array(*cells))).groupBy("feature", "bin").agg(F.count("*").alias("n")))


def defect_density_map(df):
    return interactions.defect_density_map(df, interactions.pair_list(SCALE)).drop("pair_index")


def interaction_scan(df, names=WIDE):
    return interactions.interaction_scan(df, names).drop("pair_index", "risk_range")


def risk_score(df):
    return (
        interactions.risk_score(interactions.interaction_scan(df, WIDE))
        .select("feature_pair", "risk_score")
    )


def interaction_chart(df):
    return charts.interaction_chart(interactions.interaction_scan(df, WIDE))


def critical_threshold(df, names):
    return windows.critical_threshold(windows.operating_windows(df, names))


# --- features --------------------------------------------------------------------------------


def set1(names):
    def run(spark, sf):
        df = embeddings(spark, sf)
        return tidy(features.features_set1(df, features.fit_statistics(df, WIDE), WIDE).select(KEY, *names))

    return run


def set2(names):
    def run(spark, sf):
        out = features.features_set2(embeddings(spark, sf), WIDE)
        return tidy(out.select(KEY, *[F.col(f"`{c}`") for c in names]))

    return run


def select_interaction_pairs(spark, sf):
    scan = interactions.interaction_scan(embeddings(spark, sf), WIDE)
    pairs = interactions.select_interaction_pairs(scan, 5)
    products = features.interaction_product(pairs).values()
    df = embeddings(spark, sf)
    # One row per pair, numbered from the highest risk down, as the chosen names depend on the data.
    cells = [F.struct(F.lit(i + 1).alias("place"), v.alias("product")) for i, v in enumerate(products)]
    return tidy(df.select(KEY, F.inline(F.array(*cells))))


# --- folds and resampling --------------------------------------------------------------------


def stratified_folds(spark, sf):
    return tidy(sampling.stratified_folds(lines(spark, sf)).select(KEY, LABEL, "fold"))


def class_weights(mode):
    def run(spark, sf):
        weighted = sampling.class_weights(lines(spark, sf), mode=mode)
        return tidy(weighted.groupBy(LABEL, "weight").agg(F.count("*").alias("n")))

    return run


def smote_rows(spark, sf):
    made = smote(kept_lines(spark, sf), SCALE).filter("synthetic")
    return tidy(made.select("source", "copy", "neighbour", "gap", LABEL, *SCALE))


def smote_sizes(spark, sf):
    made = smote(kept_lines(spark, sf), SCALE)
    return tidy(made.groupBy(LABEL, "synthetic").agg(F.count("*").alias("n")))


def hybrid_rows(spark, sf):
    made = hybrid_resample(embeddings(spark, sf), WIDE)
    means = [F.avg(c).alias(f"mean_{c}") for c in WIDE]
    return tidy(made.groupBy(LABEL, "weight").agg(F.count("*").alias("n"), *means))


def neighbours(spark, sf):
    few = cleaning.class_filter(embeddings(spark, sf), 1)
    return tidy(nearest_neighbours(few, WIDE))


def balanced_bags(spark, sf):
    """How many rows each bag has, and what they add up to."""
    bags = sampling.balanced_bags(kept_lines(spark, sf), bags=10)
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("X1", "X5")]
    return tidy(bags.groupBy("bag", LABEL).agg(F.count("*").alias("n"), F.max("copy").alias("copies"), *sums))


# --- models ----------------------------------------------------------------------------------


def scored_by(name, **changes):
    def run(spark, sf):
        df = embeddings(spark, sf)
        spec = models.preset(name, **{**TREES, **changes})
        fitted = models.fit(spec, df, WIDE)
        return tidy(fitted.score(df).select(KEY, LABEL, "probability_raw"))

    return run


def published(name):
    """Scores of a model with the published settings."""

    def run(spark, sf):
        df = embeddings(spark, sf)
        return tidy(models.fit(models.preset(name), df, WIDE).score(df).select(KEY, LABEL, "probability_raw"))

    return run


def cross_validate(spark, sf):
    return tidy(
        models.cross_validate(
            embeddings(spark, sf), WIDE, models.preset("forest"), k=FOLDS, train_scores=True
        )
    )


def oof_predictions(spark, sf):
    spec = models.preset("forest", trees=5, depth=5)
    return tidy(models.oof_predictions(large_lines()(spark, sf), SCALE, spec, k=FOLDS))


def strategy_comparison(spark, sf):
    specs = [
        models.preset(name, trees=3, depth=3, bags=2) for name in models.STRATEGIES
    ]
    results = models.compare_models(embeddings(spark, sf), WIDE, specs, k=2)
    return tidy(evaluate.strategy_comparison(results))


def feature_importance(spark, sf):
    df = large_lines([*SCALE, LABEL])(spark, sf)
    fitted = [
        models.fit(models.preset("boosted", **TREES), df, SCALE),
        models.fit(models.preset("forest", trees=5, depth=5), df, SCALE),
    ]
    return tidy(models.feature_importance(fitted, spark))


def attributed(spark, sf):
    df = embeddings(spark, sf)
    fitted = models.fit(models.preset("boosted", trees=5, depth=4), df, WIDE)
    path = f"{scratch(spark)}/explained"
    fitted.models[0].stages[-1].write().overwrite().save(path)
    return tree_attributions(df, WIDE, path)


def save_load_model(spark, sf):
    df = lines(spark, sf)
    fitted = models.fit(models.preset("forest", trees=5, depth=5), df, SCALE)
    path = f"{scratch(spark)}/model"
    models.save_model(fitted, path)
    back = models.load_model(fitted.spec, SCALE, path)
    return tidy(
        back.score(df).groupBy(LABEL).agg(F.count("*").alias("n"), F.avg("probability_raw").alias("mean"))
    )


def platt(spark, sf):
    scored = given.scores_lineitem(spark, sf)
    model = platt_calibrate(scored, "p", "y")
    curve = apply_platt(scored, model, "p").groupBy("p").agg(
        F.count("*").alias("n"), F.avg("probability_calibrated").alias("calibrated")
    )
    return tidy(curve)


def calibrated_scores(spark, sf):
    df = embeddings(spark, sf)
    ensemble = calibrate_cv(df, WIDE, models.preset("forest"), k=FOLDS)
    return ensemble.score(df)


def calibrate(spark, sf):
    return tidy(calibrated_scores(spark, sf).select(KEY, LABEL, "probability_calibrated"))


def oof_calibrated(spark, sf):
    spec = models.preset("forest", trees=5, depth=5)
    return tidy(calibrated_oof(embeddings(spark, sf), WIDE, spec, k=FOLDS))


def oof_mixed(spark, sf):
    spec = models.preset("forest", trees=5, depth=5)
    return tidy(calibrated_oof_mixed(embeddings(spark, sf), WIDE, spec, k=2, inner=2))


def permutation(spark, sf):
    df = given.measurements_documents(spark, sf)
    if given.table(spark, sf, "documents").count() > given.ROWS_PER_TASK:
        # Each pass would read all texts for three numbers.
        df = stored(df)
    fitted = models.fit(models.preset("forest"), df, DOCS)
    return tidy(models.permutation_importance(fitted, df, repeats=10))


def soft_vote(spark, sf):
    df = given.measurements_documents(spark, sf)
    fitted = [
        models.fit(models.preset("boosted", **TREES), df, DOCS),
        models.fit(models.preset("forest", trees=5, depth=5), df, DOCS),
    ]
    return tidy(models.soft_vote(fitted, df).select(KEY, LABEL, "probability"))


def stacked(spark, sf):
    df = given.measurements_documents(spark, sf)
    specs = [models.preset("boosted", **TREES), models.preset("forest", trees=5, depth=5)]
    model, scored = models.stack(df, DOCS, specs, k=2)
    out = model.transform(scored).select(KEY, LABEL, F.col("probability").alias("v"))
    return tidy(out.select(KEY, LABEL, vector_to_array("v")[1].alias("probability")))


# --- evaluation ------------------------------------------------------------------------------


def decided(spark, sf, threshold=0.5):
    return given.scores_lineitem(spark, sf).withColumn("pred", (F.col("p") >= threshold).cast("int"))


def sweep(spark, sf, points=101):
    return evaluate.threshold_sweep(
        given.scores_lineitem(spark, sf), "p", "y", evaluate.threshold_grid(points)
    )


def optimal_threshold(spark, sf):
    swept = sweep(spark, sf)
    best = evaluate.optimal_threshold(swept, "f1")
    for metric in ("recall", "precision", "industrial_score"):
        best = best.unionByName(evaluate.optimal_threshold(swept, metric))
    return tidy(best)


def grouped_scores(spark, sf):
    line = given.table(spark, sf, "lineitem")
    return line.select(
        F.col("l_linestatus").alias("model"),
        F.col("l_linenumber").alias("fold"),
        (F.col("l_extendedprice") / 110000.0).alias("p"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


# --- scoring ---------------------------------------------------------------------------------


def predictions(spark, sf):
    scored = given.scores_lineitem(spark, sf).withColumn("raw", F.col("p") * F.col("p"))
    return scoring.predictions_table(scored, "raw", "p")


def predictions_with_id(spark, sf):
    return tidy(scoring.with_sample_id(predictions(spark, sf)))


def predictions_detailed(spark, sf):
    scored = calibrated_scores(spark, sf)
    out = features.features_set2(scored, WIDE)
    return tidy(scoring.predictions_detailed(out, WIDE, list(features.set2_registry())))


def prediction_summary(spark, sf):
    summary = scoring.prediction_summary(predictions(spark, sf))
    return summary.select("metric", "value")


def predictions_written(spark, sf):
    """All three result tables and the text summary, written and read back."""
    folder = scratch(spark)
    rows = kept_lines(spark, sf).withColumn("p", F.col("X1") / 50.0)
    table = scoring.predictions_table(rows.withColumn("raw", F.col("p") * F.col("p")), "raw", "p")
    summary = scoring.prediction_summary(table)
    detailed = scoring.predictions_detailed(rows, SCALE, [], "p")
    tables.write_predictions(table, detailed, summary, folder)
    tables.write_summary_text(summary, f"{folder}/summary.txt")
    sizes = [
        spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("kind"), F.count("*").cast("string").alias("line"))
        for name in ("predictions", "predictions_detailed", "prediction_summary")
    ]
    lines_ = spark.read.text(f"{folder}/summary.txt").select(F.lit("text").alias("kind"), F.col("value").alias("line"))
    return sizes[0].union(sizes[1]).union(sizes[2]).union(lines_)


def model_reports(spark, sf):
    """What must hold of the baselines' reports: curves of every fold from (0, 0) to (1, 1), shares of importance, one row a feature."""
    folder = f"{scratch(spark)}/baselines"
    training.run_baselines(given.measurements_documents(spark, sf), DOCS, folder, trees=5)
    read = tables.read_reports(spark, folder, ["roc_by_fold", "feature_importance_top", "attributions", "threshold_curve"])
    ends = F.count_if((F.col("fpr") == 0) & (F.col("tpr") == 0)), F.count_if((F.col("fpr") == 1) & (F.col("tpr") == 1))
    curves = read["roc_by_fold"].groupBy("model", "fold").agg(
        F.least(ends[0], F.lit(1)).alias("starts"), F.least(ends[1], F.lit(1)).alias("ends")
    )
    whole = read["feature_importance_top"].groupBy("model").agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("importance")
    )
    explained = read["attributions"].groupBy("model").agg(F.count("*").alias("explained"))
    return tidy(
        curves.join(whole, "model")
        .join(explained, "model", "left")
        .withColumn("thresholds", F.lit(read["threshold_curve"].count()))
        .withColumn("explained", F.coalesce("explained", F.lit(0)))
    )


def defects_only(spark, sf):
    return tidy(scoring.defects_only(predictions(spark, sf)).select(KEY, "probability_calibrated"))


# --- latent structure ------------------------------------------------------------------------


def regimes(spark, sf):
    return latent.operating_regimes(embeddings(spark, sf), WIDE)


def flagged(spark, sf):
    return isolation.isolation_forest(kept_lines(spark, sf), SCALE)


def isolation_samples(spark, sf):
    """Every tree has its number of different rows."""
    rows = lines(spark, sf).select(KEY)
    drawn = isolation.tree_samples(rows, KEY, rows.count())
    return tidy(drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct(KEY).alias("keys")))


# --- drift, streaming ------------------------------------------------------------------------


def drift_report(spark, sf):
    df = lines(spark, sf)
    early = cleaning.class_filter(df, 0)
    return tidy(drift.drift_report(early, cleaning.class_filter(df, 1), SCALE))


def rolling_std(spark, sf):
    line = given.table(spark, sf, "lineitem").select(
        "l_suppkey", given.line_key().alias(KEY), F.col("l_quantity").alias("X1")
    )
    return tidy(drift.rolling_std(line, ["X1"], KEY, ["l_suppkey"]).select(KEY, "X1_rolling_std"))


def rolling_std_whole(spark, sf):
    line = given.table(spark, sf, "lineitem").select(given.line_key().alias(KEY), F.col("l_quantity").alias("X1"))
    return tidy(drift.rolling_std(line, ["X1"], KEY, rows_per_part=5000).select(KEY, "X1_rolling_std"))


def stream_events(spark, sf, as_stream=True):
    events = (given.table_stream if as_stream else given.table)(spark, sf, "events")
    return events.withColumn("flag", (F.col("event_type") == "error").cast("int"))


def monitor(spark, sf):
    """The monitor over `events` read as a stream: each batch appends the windows that changed to a table of files.

    Of a window the last batch counts. The watermark drops windows that are past.
    """
    folder = scratch(spark)

    def append(changed, batch):
        changed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/windows")

    query = (
        stream_monitor(stream_events(spark, sf), "ts", "flag", "value", "1 hour")
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/windows")
    last = written.groupBy("window_start").agg(F.max("batch").alias("batch"))
    counted = written.join(last, ["window_start", "batch"])
    epoch = F.unix_timestamp("window_start").alias("window_start")
    return tidy(counted.select(epoch, "n", "n_positive", "positive_rate", "mean_value"))


def event_sizes(events):
    """Two measurements of an event."""
    return events.select("event_type", "value", F.hour("ts").cast("double").alias("hour"))


def streamed_drift(spark, sf):
    """All events as a stream, against the stored bins of the errors among them."""
    folder = scratch(spark)
    known = event_sizes(given.table(spark, sf, "events")).filter("event_type = 'error'")
    edges = drift.open_edges(known, ["value", "hour"])
    reference = stored(drift.bin_counts(known, edges))
    start_drift(event_sizes(stream_events(spark, sf)), edges, folder).awaitTermination()
    return tidy(stream_drift(spark, folder, reference))


def streamed_model(spark, sf):
    """A saved model on a stream: rows, and the largest difference from its scores in batch."""
    folder = scratch(spark)
    df = embeddings(spark, sf)
    models.save_model(models.fit(models.preset("forest"), df, WIDE), f"{folder}/model")
    model = models.load_model(models.preset("forest"), WIDE, f"{folder}/model")

    def score(rows):
        return model.score(rows, "probability_calibrated")

    raw = given.embedding_measurements(given.table_stream(spark, sf, "embeddings"))
    query = (
        stream_score(raw, score)
        .select(KEY, "probability_calibrated", "prediction")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/scores")
    )
    query.awaitTermination()
    streamed = spark.read.parquet(f"{folder}/scores")
    batch = score(df).select(KEY, F.col("probability_calibrated").alias("p"))
    gap = F.abs(F.col("probability_calibrated") - F.col("p"))
    decided = F.count_if(F.col("prediction") == (F.col("p") >= scoring.THRESHOLD).cast("int"))
    return tidy(streamed.join(batch, KEY).agg(F.count("*").alias("n"), F.max(gap).alias("gap"), decided.alias("decided")))


def streamed_scores(spark, sf):
    """Decisions on `events` read as a stream."""
    folder = scratch(spark)
    highest = given.table(spark, sf, "events").agg(F.max("value").alias("v")).first()["v"]
    rows = stream_events(spark, sf).select("event_id", "value")
    query = (
        stream_score(rows, lambda df: df.withColumn("probability_calibrated", F.col("value") / highest))
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/scores")
    )
    query.awaitTermination()
    return tidy(spark.read.parquet(f"{folder}/scores"))


# --- what must hold of results that SQL cannot repeat -----------------------------------------------


def pca_squares(spark, sf):
    """The squared eigenvalues of a correlation matrix add up to its squared entries."""
    profile = latent.pca_profile(embeddings(spark, sf), WIDE)
    value = F.col("variance_ratio") * len(WIDE)
    return tidy(profile.agg(F.count("*").alias("n"), F.sum(value * value).alias("squares")), 4)


def pca_norms(spark, sf):
    """Over all components a row keeps its squared length."""
    names = [f"pc{i + 1}" for i in range(len(SCALE))]
    rows = latent.pca_project(lines(spark, sf), SCALE, len(SCALE))
    norm = sum(F.col(c) * F.col(c) for c in names)
    return tidy(rows.groupBy(LABEL).agg(F.count("*").alias("n"), F.avg(norm).alias("norm")), 4)


def bag_balance(spark, sf):
    """Every bag has as many rows of either class."""
    sizes = sampling.balanced_bags(stored(lines(spark, sf).select(KEY, LABEL)), bags=10).groupBy("bag").agg(
        F.count_if(F.col(LABEL) == 0).alias("n0"), F.count_if(F.col(LABEL) == 1).alias("n1")
    )
    return tidy(sizes.select("bag", ((F.col("n0") == F.col("n1")) & (F.col("n0") > 0)).alias("balanced")))


def oof_folds(spark, sf):
    """Every row is scored once, by the model of its fold."""
    spec = models.preset("forest", trees=5, depth=5)
    scored = models.oof_predictions(large_lines()(spark, sf), SCALE, spec, k=FOLDS)
    return tidy(scored.groupBy(LABEL, "fold").agg(F.count("*").alias("n"), F.countDistinct(KEY).alias("keys")))


def regime_totals(spark, sf):
    return tidy(
        regimes(spark, sf).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("defect_rate_pct") / 100).alias("defects"))
    )


def cluster_totals(spark, sf):
    clusters = latent.defect_clusters(lines(spark, sf), SCALE)
    return tidy(clusters.agg(F.sum("n").alias("n"), F.sum("pct").alias("pct")))


def attribution_gap(spark, sf):
    """Base and attributions add up to the model's margin, row by row."""
    df = embeddings(spark, sf)
    fitted = models.fit(models.preset("boosted", trees=5, depth=4), df, WIDE)
    path = f"{scratch(spark)}/explained"
    fitted.models[0].stages[-1].write().overwrite().save(path)
    margin = fitted.models[0].transform(df).select(KEY, vector_to_array("__margin")[1].alias("margin"))
    added = F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda a, b: a + b)
    gaps = tree_attributions(df, WIDE, path).join(margin, KEY).select(F.abs(added - F.col("margin")).alias("gap"))
    return tidy(gaps.agg(F.count("*").alias("n"), F.max("gap").alias("gap")))


def registered() -> dict:
    """Query name -> callable(spark, sf_dir)."""
    return {
        "read_measurements": read_measurements,
        "read_cleaned": read_cleaned,
        "write_cleaned": write_cleaned,
        "write_reports": write_reports,
        "coerce_numeric": coerce_numeric,
        "missing_profile": _on(given.measurements_gaps, lambda df: cleaning.missing_profile(df, WIDE)),
        "fit_median": fill_report,
        "apply_fill": apply_fill,
        "validate_clean": validate_clean,
        "class_distribution": _on(lines, cleaning.class_distribution),
        "imbalance_ratio": _on(lines, cleaning.imbalance_ratio),
        "dataset_profile": _on(
            kept_lines, lambda df: cleaning.dataset_profile(df, SCALE).drop("min_variance"), 2
        ),
        "duplicate_count": duplicate_count,
        "low_variance_features": _on(embeddings, lambda df: cleaning.low_variance_features(df, WIDE), 9),
        "class_filter": class_filter,
        "variance_range": _on(embeddings, lambda df: cleaning.variance_range(df, WIDE), 9),
        "univariate_stats": _on(embeddings, lambda df: univariate.univariate_stats(df, WIDE).drop("p_value")),
        "univariate_stats_lineitem": _on(
            kept_lines, lambda df: univariate.univariate_stats(df, SCALE).drop("p_value"), 4
        ),
        "mann_whitney": _on(embeddings, lambda df: univariate.mann_whitney(df, WIDE).drop("p_value")),
        "mann_whitney_lineitem": _on(kept_lines, lambda df: univariate.mann_whitney(df, SCALE).drop("p_value")),
        "significance": _on(embeddings, lambda df: univariate.significance(df, WIDE)),
        "top_significant": _on(embeddings, lambda df: univariate.top_significant(df, WIDE).drop("p_value")),
        "cv_instability": _on(embeddings, lambda df: univariate.cv_instability(df, WIDE), 4),
        "cv_instability_lineitem": _on(lines, lambda df: univariate.cv_instability(df, SCALE), 4),
        "iqr_outliers": _on(embeddings, lambda df: univariate.iqr_outliers(df, WIDE)),
        "iqr_outliers_lineitem": _on(kept_lines, lambda df: univariate.iqr_outliers(df, SCALE)),
        "profile_diversity": _on(lines, lambda df: univariate.profile_diversity(df, SCALE), 2),
        "signature_entropy": _on(embeddings, lambda df: univariate.signature_entropy(df, WIDE)),
        "correlation_matrix": _on(embeddings, lambda df: correlation.correlation_matrix(df, WIDE)),
        "correlation_matrix_gaps": _on(
            given.measurements_gaps, lambda df: correlation.correlation_matrix(df, WIDE)
        ),
        "correlation_by_class": _on(lines, lambda df: correlation.correlation_by_class(df, SCALE)),
        "high_correlation_pairs": _on(
            given.document_lengths, lambda df: correlation.high_correlation_pairs(df, DOCS)
        ),
        "feature_blocks": _on(
            given.document_lengths, lambda df: correlation.feature_blocks(df, DOCS)
        ),
        "redundancy": _on(lines, lambda df: correlation.redundancy(df, SCALE)),
        "redundancy_counts": _on(embeddings, lambda df: correlation.redundancy_counts(df, WIDE)),
        "correlation_breakdowns": _on(
            embeddings, lambda df: correlation.correlation_breakdowns(df, WIDE)
        ),
        "top_k": _on(
            embeddings,
            lambda df: correlation.top_k(
                univariate.iqr_outliers(df, WIDE), [F.desc("outliers_defect"), F.asc("feature")]
            ),
        ),
        "quantile_bins": quantile_bins,
        "defect_density_map": _on(lines, defect_density_map),
        "interaction_scan": _on(embeddings, interaction_scan),
        "interaction_scan_lineitem": _on(kept_lines, lambda df: interaction_scan(df, SCALE)),
        "risk_score": _on(embeddings, risk_score),
        "conditional_regions": _on(embeddings, lambda df: interactions.conditional_regions(df, WIDE)),
        "exclusive_regions": _on(
            given.measurements_taxed, lambda df: interactions.exclusive_regions(df, ["X1", "X2", "X3", "X4"])
        ),
        "exclusive_regions_per_class": _on(
            embeddings, lambda df: interactions.exclusive_regions(df, WIDE, edges="per_class")
        ),
        "interaction_scan_small": _on(
            embeddings,
            lambda df: interactions.interaction_scan_small(df, WIDE).drop("pair_index", "risk_range"),
        ),
        "operating_windows": _on(embeddings, lambda df: windows.operating_windows(df, WIDE)),
        "operating_windows_lineitem": _on(kept_lines, lambda df: windows.operating_windows(df, SCALE)),
        "critical_threshold": _on(embeddings, lambda df: critical_threshold(df, WIDE)),
        "standardize": _on(
            embeddings, lambda df: latent.standardize(df, WIDE).select(KEY, *WIDE)
        ),
        "scale_minmax": _on(
            embeddings, lambda df: latent.scale(df, WIDE, "minmax").select(KEY, *WIDE)
        ),
        "scale_robust": _on(
            embeddings, lambda df: latent.scale(df, WIDE, "robust").select(KEY, *WIDE)
        ),
        "defect_clusters": _on(lines, lambda df: latent.defect_clusters(df, SCALE)),
        "isolation_samples": isolation_samples,
        "isolation_forest": lambda spark, sf: tidy(flagged(spark, sf)),
        "anomaly_share": lambda spark, sf: tidy(isolation.anomaly_share(flagged(spark, sf))),
        "pca_profile": _on(embeddings, lambda df: latent.pca_profile(df, WIDE)),
        "components_needed": _on(
            embeddings, lambda df: latent.components_needed(latent.pca_profile(df, WIDE))
        ),
        "pca_project": _on(lines, lambda df: latent.pca_project(df, SCALE)),
        "pca_features": _on(embeddings, lambda df: latent.pca_features(df, WIDE)),
        "operating_regimes": lambda spark, sf: tidy(regimes(spark, sf)),
        "interaction_product": set1([f"{a}x{b}" for a, b in features.SET1_PRODUCTS]),
        "safe_ratio": set1([f"{a}div{b}" for a, b in features.SET1_RATIOS]),
        "difference": set1([f"{a}sub{b}" for a, b in features.SET1_DIFFERENCES]),
        "row_stats": set1(["row_mean", "row_std", "row_max", "row_min"]),
        "row_instability": set1(["instability"]),
        "row_range": set1(["imbalance"]),
        "block_stats": set1([f"{b}_{s}" for b in features.BLOCKS for s in ("mean", "std")]),
        "anomaly_distance": set1(["anomaly_distance"]),
        "regime_anomaly": set1(["regime_anomaly"]),
        "threshold_count": lambda spark, sf: tidy(
            lines(spark, sf)
            .select(features.threshold_count(SCALE, {"X1": 40.0, "X2": 50000.0, "X3": 0.05}).alias("threshold_count"))
            .groupBy("threshold_count")
            .agg(F.count("*").alias("n"))
        ),
        "extreme_count": set1(["threshold_count", "extreme_count"]),
        "block_divergence": set1([f"{b}_divergence" for b in features.BLOCKS]),
        "safe_ratio_eps": set2(["X36/X35", "X36/X34", "X35/X34"]),
        "secondary_mean": set2(["X36xX41", "X35xX41", "X34-X36", "instability", "rolling_mean"]),
        "select_interaction_pairs": select_interaction_pairs,
        "stratified_folds": stratified_folds,
        "class_weights": class_weights(19.5),
        "class_weights_unbalance": class_weights("unbalance"),
        "class_weights_balanced": class_weights("balanced"),
        "smote": smote_rows,
        "smote_sizes": smote_sizes,
        "nearest_neighbours": neighbours,
        "hybrid_resample": hybrid_rows,
        "balanced_bags": balanced_bags,
        "fit_gbt": published("boosted"),
        "fit_gbt_unbalanced": published("unbalanced"),
        "fit_random_forest": published("forest"),
        "fit_balanced_bagging": published("bagging"),
        "cross_validate": cross_validate,
        "oof_predictions": oof_predictions,
        "feature_importance": feature_importance,
        "tree_attributions": lambda spark, sf: tidy(attribution_rows(attributed(spark, sf), WIDE)),
        "global_attributions": lambda spark, sf: tidy(global_attributions(attributed(spark, sf), WIDE)),
        "explain_first_defect": lambda spark, sf: tidy(explain_first_defect(attributed(spark, sf), WIDE)),
        "save_load_model": save_load_model,
        "platt_calibrate": platt,
        "calibrate_cv": calibrate,
        "calibrated_oof": oof_calibrated,
        "calibrated_oof_mixed": oof_mixed,
        "strategy_comparison": strategy_comparison,
        "model_comparison": _on(given.fold_results, evaluate.model_comparison),
        "performance_tracker": _on(given.fold_results, evaluate.performance_tracker),
        "confusion_matrix": lambda spark, sf: tidy(evaluate.confusion_matrix(decided(spark, sf), "y", "pred")),
        "classification_metrics": lambda spark, sf: tidy(
            evaluate.classification_metrics(decided(spark, sf), "y", "pred")
        ),
        "classification_report": lambda spark, sf: tidy(
            evaluate.classification_report(decided(spark, sf), "y", "pred")
        ),
        "roc_curve": _on(given.scores_prices, lambda df: evaluate.roc_curve(df, "p", "y")),
        "roc_auc": _on(given.scores_lineitem, lambda df: evaluate.roc_auc(df, "p", "y")),
        "roc_auc_prices": _on(given.scores_prices, lambda df: evaluate.roc_auc(df, "p", "y")),
        "pr_curve": _on(given.scores_lineitem, lambda df: evaluate.pr_curve(df, "p", "y")),
        "pr_auc": _on(given.scores_prices, lambda df: evaluate.pr_auc(df, "p", "y")),
        "threshold_sweep": lambda spark, sf: tidy(sweep(spark, sf)),
        "threshold_sweep_100": lambda spark, sf: tidy(sweep(spark, sf, 100)),
        "optimal_threshold": optimal_threshold,
        "industrial_score": lambda spark, sf: tidy(evaluate.optimum_row(sweep(spark, sf), "industrial_score")),
        "cost_threshold": lambda spark, sf: tidy(evaluate.cost_threshold(sweep(spark, sf), 10.0, 4.0)),
        "fold_roc_curves": lambda spark, sf: tidy(
            evaluate.roc_curve(grouped_scores(spark, sf), "p", "y", ["model", "fold"])
        ),
        "fold_roc_auc": lambda spark, sf: tidy(
            evaluate.roc_auc(grouped_scores(spark, sf), "p", "y", ["model", "fold"])
        ),
        "score": scored_by("hybrid", depth=3),
        "decide": lambda spark, sf: tidy(
            predictions(spark, sf).groupBy("prediction").agg(F.count("*").alias("n"))
        ),
        "confidence": lambda spark, sf: tidy(
            predictions(spark, sf)
            .groupBy("probability_calibrated")
            .agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
        ),
        "predictions_table": predictions_with_id,
        "predictions_detailed": predictions_detailed,
        "prediction_summary": prediction_summary,
        "write_predictions": predictions_written,
        "model_reports": model_reports,
        "triage_bands": lambda spark, sf: tidy(
            scoring.triage_bands(given.scores_lineitem(spark, sf), "p")
        ),
        "defects_only": defects_only,
        "histogram_by_class": _on(embeddings, lambda df: charts.histogram_by_class(df, WIDE)),
        "histogram_by_class_lineitem": _on(
            lines, lambda df: charts.histogram_by_class(df, SCALE, top=None), 4
        ),
        "boxplot_by_class": _on(kept_lines, lambda df: charts.boxplot_by_class(df, SCALE, top=None)),
        "significance_chart": _on(embeddings, lambda df: charts.significance_chart(df, WIDE)),
        "class_share": _on(lines, charts.class_share),
        "instability_chart": _on(embeddings, lambda df: charts.instability_chart(df, WIDE), 4),
        "outlier_chart": _on(embeddings, lambda df: charts.outlier_chart(df, WIDE)),
        "interaction_chart": _on(embeddings, interaction_chart),
        "heatmap_long": _on(lines, lambda df: charts.heatmap_long(df, SCALE)),
        "window_chart": _on(embeddings, lambda df: charts.window_chart(critical_threshold(df, WIDE))),
        "anomaly_chart": lambda spark, sf: tidy(charts.anomaly_chart(flagged(spark, sf))),
        "anomaly_histogram": lambda spark, sf: tidy(charts.anomaly_histogram(flagged(spark, sf))),
        "pca_chart": _on(embeddings, lambda df: charts.pca_chart(latent.pca_profile(df, WIDE))),
        "binned_points": _on(lines, lambda df: charts.binned_points(df, "X1", "X2", [LABEL])),
        "pca_points": _on(embeddings, lambda df: charts.pca_points(df, WIDE)),
        "pca_point_totals": _on(
            lines,
            lambda df: charts.pca_points(df, SCALE).groupBy("panel", LABEL).agg(F.sum("n").alias("n")),
        ),
        "regime_points": _on(embeddings, lambda df: charts.regime_points(df, WIDE)),
        "regime_point_totals": _on(
            large_lines([*SCALE, LABEL]), lambda df: charts.regime_points(df, SCALE).groupBy(LABEL).agg(F.sum("n").alias("n"))
        ),
        "regime_chart": lambda spark, sf: tidy(charts.regime_chart(regimes(spark, sf))),
        "fingerprints": _on(embeddings, lambda df: charts.fingerprints(df, WIDE)),
        "threshold_chart": lambda spark, sf: tidy(charts.threshold_chart(sweep(spark, sf))),
        "impute_mean": impute_mean,
        "impute_drop": impute_drop,
        "drop_sparse_columns": drop_sparse_columns,
        "rolling_std": rolling_std,
        "rolling_std_whole": rolling_std_whole,
        "permutation_importance": permutation,
        "soft_vote": soft_vote,
        "stack": stacked,
        "drift_report": drift_report,
        "stream_monitor": monitor,
        "stream_score": streamed_scores,
        "stream_score_model": streamed_model,
        "stream_drift": streamed_drift,
        "pca_squares": pca_squares,
        "pca_norms": pca_norms,
        "bag_balance": bag_balance,
        "oof_folds": oof_folds,
        "regime_totals": regime_totals,
        "cluster_totals": cluster_totals,
        "attribution_gap": attribution_gap,
    }
