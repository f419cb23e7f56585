"""SQL equivalents of the registered queries, on the given tables.

Each statement is a chain of named parts ending in one outer SELECT that rounds
doubles and widens integers exactly as `checks.queries.tidy` does.
"""

import itertools
import math

from procsight.operators import features as fe
from procsight.sources.stand_ins import SCALE, TEXTS, WIDE

EMBEDDINGS = (
    "m AS (SELECT vec_id AS CoilID, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(WIDE))
    + ", CAST(label = 0 AS INTEGER) AS Y FROM embeddings)"
)
LINE_KEY = (
    "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'"
    " || strftime(CAST(l_shipdate AS DATE), '%Y%m%d'))"
)
LINES = f"""m AS (
  SELECT {LINE_KEY} AS CoilID, l_quantity AS X1, l_extendedprice AS X2, l_discount AS X3, l_tax AS X4,
         CAST(p_size AS DOUBLE) AS X5, p_retailprice AS X6, s_acctbal AS X7, o_totalprice AS X8,
         c_acctbal AS X9, CAST(l_returnflag = 'R' AND l_discount >= 0.09 AS INTEGER) AS Y
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
DOCUMENTS = """m AS (
  SELECT doc_id AS CoilID, CAST(n_chars AS DOUBLE) AS X1, CAST(length(text) AS DOUBLE) AS X2,
         CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS X3, toxic AS Y
  FROM documents JOIN labels USING (doc_id))"""
LENGTHS = DOCUMENTS.replace(", toxic AS Y", "").replace(" JOIN labels USING (doc_id)", "")
LOST = {c: f"CASE WHEN abs({c}) <= 0.25 THEN {c} END" for c in ("X8", "X10", "X15", "X16")}
LOST["X42"] = "CASE WHEN X42 >= -0.2 THEN X42 END"
GAPS = (
    EMBEDDINGS.replace("m AS", "whole AS", 1)
    + ", m AS (SELECT CoilID, Y, "
    + ", ".join(f"{LOST.get(c, c)} AS {c}" for c in WIDE)
    + " FROM whole)"
)
SCORES = f"""s AS (SELECT {LINE_KEY} AS CoilID, l_quantity / 50.0 AS p,
  CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""
PRICES = f"""s AS (SELECT {LINE_KEY} AS CoilID, l_extendedprice / 110000.0 AS p,
  CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""
# Columns too large for six decimals in a double.
COARSE = {"tie_term": 0, "u_defect": 1, "u_normal": 1}
POSITION = "CAST(substr(feature, 2) AS INTEGER)"


def out(parts, body, doubles=(), integers=(), texts=(), digits=6):
    """WITH parts SELECT the named columns of `body`, rounded and widened."""
    columns = [f'round(CAST("{c}" AS DOUBLE), {COARSE.get(c, digits)}) + 0.0 AS "{c}"' for c in doubles]
    columns += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in integers]
    columns += [f'"{c}"' for c in texts]
    head = "WITH " + ", ".join(parts) + " " if parts else ""
    return f"{head}SELECT {', '.join(columns)} FROM ({body}) final"


def mark(*columns, seed=42):
    """The 60-bit number of some columns and a seed."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(columns)}, '{seed}')), 1, 15) AS BIGINT)"


def unit(number):
    """A number as one in [0, 1)."""
    return f"({number} % 4503599627370496) / 4503599627370496.0"


def long(names, source="m"):
    """(CoilID, Y, feature, value) without nulls."""
    return f"l AS (SELECT * FROM (UNPIVOT {source} ON {', '.join(names)} INTO NAME feature VALUE value))"


MOMENTS = """centre AS (SELECT feature, Y, avg(value) AS mean FROM l GROUP BY feature, Y),
mom AS (SELECT feature, Y, count(*) AS n, any_value(mean) AS mean, stddev_samp(value) AS std,
    stddev_pop(value) AS std_pop, var_samp(value) AS variance,
    avg((value - mean) ^ 3) / pow(stddev_pop(value), 3) AS skew,
    avg((value - mean) ^ 4) / pow(stddev_pop(value), 4) - 3 AS kurtosis
  FROM l JOIN centre USING (feature, Y) GROUP BY feature, Y)"""


def sides(source, names):
    picks = [
        f"max(CASE WHEN Y = {y} THEN {c} END) AS {side}_{c}"
        for c in names
        for y, side in ((0, "normal"), (1, "defect"))
    ]
    return f"sides AS (SELECT feature, {', '.join(picks)} FROM {source} GROUP BY feature)"


RANKS = """d AS (SELECT feature, value, count(*) FILTER (Y = 0) AS n0, count(*) FILTER (Y = 1) AS n1
    FROM l GROUP BY feature, value),
c AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY feature ORDER BY value
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM d),
u AS (SELECT feature, CAST(sum(n0) AS DOUBLE) AS n_normal, CAST(sum(n1) AS DOUBLE) AS n_defect,
    sum(CAST(n1 AS DOUBLE) * (b0 + n0 / 2.0)) AS u_defect,
    sum(CAST(n0 + n1 AS DOUBLE) * (n0 + n1) * (n0 + n1) - (n0 + n1)) AS tie_term FROM c GROUP BY feature),
w AS (SELECT *, n_normal * n_defect - u_defect AS u_normal, n_normal + n_defect AS n FROM u),
mw AS (SELECT *, (greatest(u_defect, u_normal) - n_normal * n_defect / 2 - 0.5)
    / sqrt(n_normal * n_defect / 12 * ((n + 1) - tie_term / (n * (n - 1)))) AS z FROM w)"""


def top(k):
    return (
        f"top AS (SELECT feature, row_number() OVER (ORDER BY z DESC, {POSITION}) AS place FROM mw "
        f"QUALIFY place <= {k})"
    )


QUARTILES = """q AS (SELECT feature, Y, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
    quantile_cont(value, 0.75) AS q3 FROM l GROUP BY feature, Y)"""
OUTLIERS = """o AS (SELECT feature, Y, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
    AS outliers, count(*) AS n, min(value) AS low, max(value) AS high
  FROM l JOIN q USING (feature, Y) GROUP BY feature, Y)"""
OUTLIER_REPORT = """SELECT feature, normal_outliers AS outliers_normal, defect_outliers AS outliers_defect,
  CASE WHEN defect_n > 0 THEN defect_outliers / defect_n ELSE 0 END AS outlier_ratio,
  normal_low AS normal_min, normal_high AS normal_max, defect_low AS defect_min, defect_high AS defect_max
  FROM sides"""
CV = """cv AS (SELECT feature,
    CASE WHEN normal_mean = 0 THEN 0 ELSE normal_std / abs(normal_mean) END AS normal_cv,
    CASE WHEN defect_mean = 0 THEN 0 ELSE defect_std / abs(defect_mean) END AS defect_cv FROM sides),
rep AS (SELECT *, CASE WHEN normal_cv > 0 THEN defect_cv / normal_cv ELSE 0 END AS cv_ratio,
    CASE WHEN normal_cv > 0 THEN (defect_cv / normal_cv - 1) * 100 ELSE 0 END AS relative_instability_pct
  FROM cv)"""


def pearson(names, by_class=False):
    """corr(f1, f2, r[, Y]) for every pair of names, each pair over the rows that have both."""
    group = "GROUP BY Y" if by_class else ""
    keep = "Y, " if by_class else ""
    selects = [
        f"SELECT {keep}'{a}' AS feature_1, '{b}' AS feature_2, {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM m {group}"
        for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)
    ]
    return "pairs AS (" + " UNION ALL ".join(selects) + ")"


BOTH = """sq AS (SELECT feature_1, feature_2, r FROM pairs UNION ALL SELECT feature_2, feature_1, r FROM pairs)"""
REDUNDANCY = """red AS (SELECT feature_1 AS feature, count(*) FILTER (abs(r) > 0.7) AS highly_correlated_pairs,
    max(abs(r)) AS max_correlation, avg(abs(r)) AS avg_correlation FROM sq GROUP BY feature_1),
risk AS (SELECT *, CASE WHEN highly_correlated_pairs > 3 THEN 'HIGH' WHEN highly_correlated_pairs > 1
    THEN 'MEDIUM' ELSE 'LOW' END AS redundancy_risk FROM red)"""


def bin_number(steps):
    """Right-closed bin between the quantiles e[1]..e[steps + 1], counting each distinct inner edge once."""
    return " + ".join(
        f"CAST(e[{i + 1}] > e[{i}] AND e[{i + 1}] < e[{steps + 1}] AND value > e[{i + 1}] AS INTEGER)"
        for i in range(1, steps)
    )


def bins(source="l"):
    """b(CoilID, Y, feature, bin): right-closed thirds, duplicate edges dropped."""
    return f"""ed AS (SELECT feature, quantile_cont(value, [0, 1/3, 2/3, 1]) AS e FROM {source} GROUP BY feature),
b AS (SELECT CoilID, Y, feature, {bin_number(3)} AS bin FROM {source} JOIN ed USING (feature) WHERE e[4] > e[1])"""


DENSITY = """pr AS (SELECT a.feature AS feature_1, z.feature AS feature_2, a.place AS p1, z.place AS p2
    FROM top a JOIN top z ON a.place < z.place),
den AS (SELECT feature_1, feature_2, p1, p2, x.bin AS bin1, v.bin AS bin2, count(*) AS n,
    sum(x.Y) AS n_defect, sum(x.Y) / count(*) AS rate
  FROM pr JOIN b x ON x.feature = feature_1 JOIN b v ON v.feature = feature_2 AND v.CoilID = x.CoilID
  GROUP BY ALL)"""
STRENGTH = """st AS (SELECT feature_1 || ' × ' || feature_2 AS feature_pair, feature_1, feature_2, p1, p2,
    max(rate) AS max_defect_rate, min(rate) AS min_defect_rate, max(rate) - min(rate) AS interaction_strength
  FROM den GROUP BY feature_1, feature_2, p1, p2 HAVING sum(n_defect) > 0 AND sum(n_defect) < sum(n)),
sc AS (SELECT * FROM st WHERE interaction_strength > 0.01)"""
STRONG = "ORDER BY interaction_strength DESC, p1, p2"
SCAN_DOUBLES = ["max_defect_rate", "min_defect_rate", "interaction_strength"]
SCAN_TEXTS = ["feature_pair", "feature_1", "feature_2"]


def scan_parts(source, names, k=15):
    return [source, long(names), RANKS, top(k), bins(), DENSITY, STRENGTH]


# The order of text keys.
TEXT_ORDER = "CAST('0x' || substr(md5(CoilID), 1, 15) AS BIGINT)"
WINDOWS = """rn AS (SELECT feature, value, Y, row_number() OVER (PARTITION BY feature ORDER BY value, CoilID) - 1 AS r
    FROM l JOIN top USING (feature)),
sz AS (SELECT feature, count(*) AS n, greatest(30, count(*) // 10) AS size FROM rn GROUP BY feature),
wi AS (SELECT feature, size, n, unnest(generate_series(0, n // (size // 2))) AS "window" FROM sz),
ws AS (SELECT *, "window" * (size // 2) AS start FROM wi WHERE "window" * (size // 2) < n - size),
ow AS (SELECT ws.feature, "window", start, size, avg(Y) AS defect_rate,
    max(CASE WHEN r = start + size // 2 THEN value END) AS boundary
  FROM ws JOIN rn ON rn.feature = ws.feature AND r >= start AND r < start + size GROUP BY ALL)"""
CRITICAL = """ju AS (SELECT *, abs(lead(defect_rate) OVER (PARTITION BY feature ORDER BY "window") - defect_rate) AS jump
    FROM ow),
fi AS (SELECT feature, boundary AS critical_threshold FROM ju WHERE jump IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY feature ORDER BY jump DESC, "window") = 1),
ct AS (SELECT feature, min(defect_rate) AS safe_rate, max(defect_rate) AS unsafe_rate,
    any_value(critical_threshold) AS critical_threshold, max(defect_rate) - min(defect_rate) AS risk_increase
  FROM ju JOIN fi USING (feature) GROUP BY feature HAVING count(*) > 1)"""

CUMULATIVE = """g AS (SELECT p, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM s GROUP BY p),
cu AS (SELECT *, sum(n1) OVER (ORDER BY p DESC) AS tp, sum(n0) OVER (ORDER BY p DESC) AS fp,
    sum(n1) OVER () AS n_pos, sum(n0) OVER () AS n_neg FROM g)"""


def sweep(points=101):
    return f"""gr AS (SELECT CASE WHEN i = {points - 1} THEN 1.0 ELSE i * (CAST(1 AS DOUBLE) / {points - 1}) END AS threshold FROM range(0, {points}) t(i)),
cn AS (SELECT p, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM s GROUP BY p),
sw0 AS (SELECT threshold, sum(CASE WHEN p >= threshold THEN n1 ELSE 0 END) AS tp,
    sum(CASE WHEN p >= threshold THEN n0 ELSE 0 END) AS fp, sum(CASE WHEN p < threshold THEN n1 ELSE 0 END) AS fn,
    sum(CASE WHEN p < threshold THEN n0 ELSE 0 END) AS tn FROM gr, cn GROUP BY threshold),
sw1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM sw0),
sw AS (SELECT *, 0.6 * recall + 0.4 * precision AS industrial_score FROM sw1)"""


SWEEP_DOUBLES = ["threshold", "precision", "recall", "f1", "industrial_score"]
CELLS = """cells AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM s)"""
PREDICTIONS = """pt AS (SELECT CoilID, p * p AS probability_raw, p AS probability_calibrated,
    CAST(p >= 0.25 AS INTEGER) AS prediction, greatest(least(abs(p - 0.25) / 0.75, 1.0), 0.0) AS confidence,
    0.25 AS threshold FROM s)"""
FOLD_RESULTS = """fr AS (SELECT l_returnflag AS model, l_linenumber AS fold, avg(l_quantity / 50) AS roc_auc,
    avg(l_discount * 10) AS f1, avg(l_tax * 10) AS precision, avg(CAST(l_linestatus = 'O' AS DOUBLE)) AS recall,
    avg(l_extendedprice / 110000) AS accuracy FROM lineitem GROUP BY ALL)"""
METRICS = ["roc_auc", "f1", "precision", "recall", "accuracy"]


def summary(deviation):
    picks = ", ".join(f"avg({m}) AS {m}_mean, {deviation}({m}) AS {m}_std" for m in METRICS)
    return out(
        [FOLD_RESULTS],
        f"SELECT model, {picks} FROM fr GROUP BY model",
        [f"{m}_{s}" for m in METRICS for s in ("mean", "std")],
        texts=["model"],
    )


def total(terms):
    return "(" + " + ".join(terms) + ")"


def row_mean(names):
    return f"({total(names)} / {len(names)})"


def row_std(names):
    mean = row_mean(names)
    return f"sqrt({total([f'({c} - {mean}) * ({c} - {mean})' for c in names])} / {len(names)})"


def ratio(a, b, eps):
    bottom = f"({b} + {eps!r})" if eps else b
    return f"CASE WHEN {bottom} = 0 THEN 0 ELSE coalesce({a} / {bottom}, 0) END"


def engineered(columns, extra=()):
    """CoilID and the named expressions over the embeddings measurements."""
    picks = ", ".join(f'{expression} AS "{name}"' for name, expression in columns.items())
    return out(
        [EMBEDDINGS, *extra],
        f"SELECT CoilID, {picks} FROM m" + (", ts" if extra else ""),
        list(columns),
        ["CoilID"],
    )


def train_part(expressions):
    return "ts AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in expressions.items()) + " FROM m)"


def histogram(parts, digits):
    body = """SELECT feature, Y, bin, low + bin * width AS low, low + (bin + 1) * width AS high,
      coalesce(n, 0) AS n, coalesce(n, 0) / (total * width) AS density
      FROM listed LEFT JOIN hc USING (feature, Y, bin)"""
    spans = """sp0 AS (SELECT feature, Y, min(value) AS mn, max(value) AS mx, count(*) AS total FROM v GROUP BY feature, Y),
sp AS (SELECT feature, Y, total, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS low,
    CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS high FROM sp0),
spw AS (SELECT *, (high - low) / 20 AS width FROM sp),
pl AS (SELECT feature, Y, value, low, width, least(CAST(floor((value - low) / (high - low) * 20) AS INTEGER), 19) AS k
    FROM v JOIN spw USING (feature, Y)),
hc AS (SELECT feature, Y, CASE WHEN value < low + k * width THEN k - 1
    WHEN k < 19 AND value >= low + (k + 1) * width THEN k + 1 ELSE k END AS bin, count(*) AS n
  FROM pl GROUP BY 1, 2, 3),
listed AS (SELECT *, CAST(i AS INTEGER) AS bin FROM spw, range(0, 20) t(i))"""
    return out([*parts, spans], body, ["low", "high", "density"], ["Y", "bin", "n"], ["feature"], digits)


def statements() -> dict[str, str]:
    """Query name -> SQL."""
    sql: dict[str, str] = {}
    emb, lin = [EMBEDDINGS], [LINES]
    emb_long, lin_long, gap_long = long(WIDE), long(SCALE), long(WIDE)

    # sources and cleaning
    sql["read_measurements"] = out(
        [],
        "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
        ["quantity"], ["n"], ["l_returnflag"],
    )
    sql["read_cleaned"] = out(
        [],
        "SELECT lang, count(*) AS n, sum(n_chars) AS n_chars FROM documents GROUP BY 1",
        [], ["n", "n_chars"], ["lang"],
    )
    gap_names = list(LOST)
    medians = "md AS (SELECT " + ", ".join(f"median({c}) AS med_{c}" for c in gap_names) + " FROM m)"
    sql["write_cleaned"] = out(
        [GAPS, medians],
        "SELECT Y, count(*) AS n, avg(coalesce(X8, med_X8)) AS mean_x8 FROM m, md GROUP BY Y",
        ["mean_x8"], ["Y", "n"],
    )
    clean = ", ".join(f"CASE WHEN abs({c}) <= 0.2 THEN {c} END AS {c}" for c in TEXTS)
    sql["coerce_numeric"] = out(emb, f"SELECT CoilID, {clean} FROM m", TEXTS, ["CoilID"])
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, "
        f"(count(*) - count({c})) / count(*) * 100 AS missing_pct FROM m" for c in WIDE
    )
    sql["missing_profile"] = out(
        [GAPS], f"SELECT * FROM ({missing}) WHERE missing > 0", ["missing_pct"], ["missing"], ["feature"]
    )
    filled = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, median({c}) AS median, count(*) - count({c}) AS filled FROM m" for c in WIDE
    )
    sql["fit_median"] = out(
        [GAPS], f"SELECT * FROM ({filled}) WHERE filled > 0", ["median"], ["filled"], ["feature"]
    )
    sql["apply_fill"] = out(
        [GAPS, medians],
        "SELECT CoilID, " + ", ".join(f"coalesce({c}, med_{c}) AS {c}" for c in gap_names) + " FROM m, md",
        gap_names, ["CoilID"],
    )
    sql["validate_clean"] = out(
        [GAPS],
        f"SELECT 'null_in_train' AS check_name, feature, missing AS n FROM ({missing}) WHERE missing > 0",
        [], ["n"], ["check_name", "feature"],
    )
    distribution = """SELECT Y, CASE WHEN Y = 0 THEN 'NORMAL' ELSE 'DEFECT' END AS label_name, count(*) AS n,
      count(*) / sum(count(*)) OVER () * 100 AS pct FROM m GROUP BY Y"""
    sql["class_distribution"] = out(lin, distribution, ["pct"], ["Y", "n"], ["label_name"])
    sql["class_share"] = out(lin, distribution, ["pct"], ["n"], ["label_name"])
    sql["imbalance_ratio"] = out(
        lin,
        """SELECT n_normal, n_defect, n_normal / n_defect AS ratio,
           CASE WHEN n_normal / n_defect > 10 THEN 'SEVERE' ELSE 'MODERATE' END AS severity
           FROM (SELECT count(*) FILTER (Y = 0) AS n_normal, count(*) FILTER (Y = 1) AS n_defect FROM m)""",
        ["ratio"], ["n_normal", "n_defect"], ["severity"],
    )
    variances = "va AS (SELECT feature, var_samp(value) AS variance FROM l GROUP BY feature)"
    line_columns = ", ".join(["CoilID", *SCALE, "Y"])
    sql["dataset_profile"] = out(
        [LINES, lin_long, variances],
        f"""SELECT (SELECT count(*) FROM m) AS rows, 11 AS columns, 9 AS features,
            (SELECT {total([f'count(*) - count({c})' for c in SCALE])} FROM m) AS missing_cells,
            (SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM m GROUP BY {line_columns})) AS duplicates,
            min(variance) AS min_variance, max(variance) AS max_variance,
            quantile_cont(variance, 0.1) AS low_variance_cut FROM va""",
        ["max_variance", "low_variance_cut"],
        ["rows", "columns", "features", "missing_cells", "duplicates"], digits=2,
    )
    sql["duplicate_count"] = out(
        [],
        """SELECT coalesce(sum(k - 1), 0) AS duplicates
           FROM (SELECT count(*) AS k FROM documents GROUP BY doc_id, text, lang, source, n_chars)""",
        [], ["duplicates"],
    )
    sql["low_variance_features"] = out(
        [EMBEDDINGS, emb_long, variances, "ct AS (SELECT quantile_cont(variance, 0.1) AS cut FROM va)"],
        "SELECT feature, variance, cut FROM va, ct WHERE variance < cut",
        ["variance", "cut"], [], ["feature"], digits=9,
    )
    sql["class_filter"] = out(
        lin, "SELECT count(*) AS n, sum(X1) AS quantity FROM m WHERE Y = 1", ["quantity"], ["n"]
    )
    sql["variance_range"] = out(
        [EMBEDDINGS, emb_long, variances],
        "SELECT min(variance) AS min_variance, max(variance) AS max_variance FROM va",
        ["min_variance", "max_variance"], digits=9,
    )

    # univariate
    stat_names = ["mean", "std", "skew", "kurtosis"]
    stat_columns = [f"{s}_{c}" for c in stat_names for s in ("normal", "defect")] + ["mean_diff"]
    # z at which the two-sided 5 % level is reached
    uni = """SELECT *, defect_mean - normal_mean AS mean_diff,
      CASE WHEN z > 1.9599639845400538 THEN 'YES' ELSE 'NO' END AS significant FROM sides JOIN mw USING (feature)"""
    for name, source, names, digits in (
        ("univariate_stats", EMBEDDINGS, WIDE, 6), ("univariate_stats_lineitem", LINES, SCALE, 4)
    ):
        sql[name] = out(
            [source, long(names), MOMENTS, sides("mom", stat_names), RANKS], uni,
            stat_columns, [], ["feature", "significant"], digits,
        )
    for name, source, names in (
        ("mann_whitney", EMBEDDINGS, WIDE), ("mann_whitney_lineitem", LINES, SCALE)
    ):
        sql[name] = out(
            [source, long(names), RANKS], "SELECT * FROM mw",
            ["u_defect", "u_normal", "tie_term", "z"], ["n_normal", "n_defect"], ["feature"],
        )
    sql["significance"] = out(
        [EMBEDDINGS, emb_long, RANKS],
        """SELECT CASE WHEN z > 1.9599639845400538 THEN 'YES' ELSE 'NO' END AS significant, count(*) AS n
           FROM mw GROUP BY 1""",
        [], ["n"], ["significant"],
    )
    sql["top_significant"] = out(
        [EMBEDDINGS, emb_long, MOMENTS, sides("mom", ["mean"]), RANKS, top(10)],
        "SELECT * FROM sides JOIN top USING (feature)", ["normal_mean", "defect_mean"], [], ["feature"],
    )
    cv_columns = ["normal_cv", "defect_cv", "cv_ratio", "relative_instability_pct"]
    for name, source, names in (
        ("cv_instability", EMBEDDINGS, WIDE), ("cv_instability_lineitem", LINES, SCALE)
    ):
        sql[name] = out(
            [source, long(names), MOMENTS, sides("mom", ["mean", "std"]), CV], "SELECT * FROM rep",
            cv_columns, [], ["feature"], 4,
        )
    sql["instability_chart"] = out(
        [EMBEDDINGS, emb_long, MOMENTS, sides("mom", ["mean", "std"]), CV],
        f"SELECT * FROM rep ORDER BY relative_instability_pct DESC, {POSITION} LIMIT 10",
        ["relative_instability_pct", "normal_cv", "defect_cv"], [], ["feature"], 4,
    )
    out_sides = sides("o", ["outliers", "n", "low", "high"])
    out_doubles = ["outlier_ratio", "normal_min", "normal_max", "defect_min", "defect_max"]
    out_ints = ["outliers_normal", "outliers_defect"]
    for name, source, names in (("iqr_outliers", EMBEDDINGS, WIDE), ("iqr_outliers_lineitem", LINES, SCALE)):
        sql[name] = out(
            [source, long(names), QUARTILES, OUTLIERS, out_sides], OUTLIER_REPORT,
            out_doubles, out_ints, ["feature"],
        )
    sql["top_k"] = out(
        [EMBEDDINGS, emb_long, QUARTILES, OUTLIERS, out_sides],
        f"SELECT * FROM ({OUTLIER_REPORT}) ORDER BY outliers_defect DESC, feature LIMIT 10",
        out_doubles, out_ints, ["feature"],
    )
    sql["outlier_chart"] = out(
        [EMBEDDINGS, emb_long, QUARTILES, OUTLIERS, out_sides, f"orp AS ({OUTLIER_REPORT})"],
        f"""(SELECT 'count' AS panel, feature, outliers_defect AS value FROM orp
             ORDER BY outliers_defect DESC, {POSITION} LIMIT 10) UNION ALL
            (SELECT 'ratio', feature, outlier_ratio FROM orp WHERE outliers_defect > 0
             ORDER BY outlier_ratio DESC, {POSITION} LIMIT 10)""",
        ["value"], [], ["panel", "feature"],
    )
    sql["profile_diversity"] = out(
        [LINES, lin_long, MOMENTS],
        """SELECT *, CASE WHEN defect_variance > normal_variance THEN 'MORE_VARIABLE' ELSE 'SIMILAR' END AS verdict
           FROM (SELECT avg(variance) FILTER (Y = 0) AS normal_variance,
                 avg(variance) FILTER (Y = 1) AS defect_variance FROM mom)""",
        ["normal_variance", "defect_variance"], [], ["verdict"], 2,
    )
    sql["signature_entropy"] = out(
        [EMBEDDINGS, emb_long, MOMENTS],
        """SELECT *, CASE WHEN defect_entropy > normal_entropy THEN 'MORE_COMPLEX' ELSE 'SIMPLER' END AS verdict
           FROM (SELECT sum(-std_pop * ln(std_pop + 1e-10)) FILTER (Y = 0) AS normal_entropy,
                 sum(-std_pop * ln(std_pop + 1e-10)) FILTER (Y = 1) AS defect_entropy FROM mom)""",
        ["normal_entropy", "defect_entropy"], [], ["verdict"],
    )

    # correlation
    def whole_matrix(names):
        return BOTH + ", mx AS (SELECT * FROM sq UNION ALL " + " UNION ALL ".join(
            f"SELECT '{c}', '{c}', 1.0" for c in names
        ) + ")"

    def class_matrix(names, pairs="pairs"):
        return (
            f"cm AS (SELECT Y, feature_1, feature_2, r FROM {pairs} UNION ALL SELECT Y, feature_2, feature_1, r FROM {pairs}"
            + "".join(f" UNION ALL SELECT DISTINCT Y, '{c}', '{c}', 1.0 FROM m" for c in names) + ")"
        )

    for name, source in (("correlation_matrix", EMBEDDINGS), ("correlation_matrix_gaps", GAPS)):
        sql[name] = out(
            [source, pearson(WIDE), whole_matrix(WIDE)], "SELECT * FROM mx", ["r"], [], ["feature_1", "feature_2"]
        )
    sql["correlation_by_class"] = out(
        [LINES, pearson(SCALE, True), class_matrix(SCALE)], "SELECT * FROM cm", ["r"], ["Y"], ["feature_1", "feature_2"]
    )
    docs = ["X1", "X2", "X3"]
    sql["high_correlation_pairs"] = out(
        [LENGTHS, pearson(docs)], "SELECT * FROM pairs WHERE abs(r) > 0.8", ["r"], [], ["feature_1", "feature_2"]
    )
    sql["redundancy"] = out(
        [LINES, pearson(SCALE), BOTH, REDUNDANCY], "SELECT * FROM risk",
        ["max_correlation", "avg_correlation"], ["highly_correlated_pairs"], ["feature", "redundancy_risk"],
    )
    sql["redundancy_counts"] = out(
        [EMBEDDINGS, pearson(WIDE), BOTH, REDUNDANCY],
        "SELECT redundancy_risk, count(*) AS n FROM risk GROUP BY 1", [], ["n"], ["redundancy_risk"],
    )
    sql["correlation_breakdowns"] = out(
        [EMBEDDINGS, emb_long,
         f"""nu AS (SELECT *, {POSITION} AS place FROM l),
         pairs AS (SELECT a.Y, a.feature AS feature_1, z.feature AS feature_2, a.place AS i, z.place AS j,
             corr(a.value, z.value) AS r
           FROM nu a JOIN nu z ON a.CoilID = z.CoilID AND a.place < z.place GROUP BY ALL)"""],
        """SELECT a.feature_1, a.feature_2, a.r AS normal_correlation, d.r AS defect_correlation,
           abs(a.r - d.r) AS correlation_change FROM pairs a JOIN pairs d
           ON a.i = d.i AND a.j = d.j AND a.Y = 0 AND d.Y = 1 WHERE abs(a.r - d.r) > 0.3""",
        ["normal_correlation", "defect_correlation", "correlation_change"], [], ["feature_1", "feature_2"],
    )
    sql["heatmap_long"] = out(
        [LINES, pearson(SCALE), whole_matrix(SCALE), pearson(SCALE, True).replace("pairs AS", "cpairs AS", 1),
         class_matrix(SCALE, "cpairs")],
        """SELECT 'overall' AS scope, feature_1, feature_2, r FROM mx UNION ALL
           SELECT CASE WHEN Y = 0 THEN 'normal' ELSE 'defect' END, feature_1, feature_2, r FROM cm""",
        ["r"], [], ["scope", "feature_1", "feature_2"],
    )

    # interactions and windows
    sql["quantile_bins"] = out(
        [LINES, lin_long, bins()],
        "SELECT feature, bin, count(*) AS n FROM b GROUP BY ALL",
        [], ["bin", "n"], ["feature"],
    )
    every = f"top AS (SELECT DISTINCT feature, {POSITION} AS place FROM l)"
    sql["defect_density_map"] = out(
        [LINES, lin_long, every, bins(), DENSITY], "SELECT * FROM den",
        ["rate"], ["bin1", "bin2", "n", "n_defect"], ["feature_1", "feature_2"],
    )
    sql["interaction_scan"] = out(
        scan_parts(EMBEDDINGS, WIDE), "SELECT * FROM sc", SCAN_DOUBLES, [], SCAN_TEXTS
    )
    sql["interaction_scan_lineitem"] = out(
        scan_parts(LINES, SCALE), "SELECT * FROM sc", SCAN_DOUBLES, [], SCAN_TEXTS
    )
    sql["interaction_scan_small"] = out(
        scan_parts(EMBEDDINGS, WIDE, 4), "SELECT * FROM st", SCAN_DOUBLES, [], SCAN_TEXTS
    )
    risk = "SELECT *, 100 * max_defect_rate + 50 * interaction_strength AS risk_score FROM sc"
    sql["risk_score"] = out(scan_parts(EMBEDDINGS, WIDE), risk, ["risk_score"], [], ["feature_pair"])
    sql["select_interaction_pairs"] = out(
        [*scan_parts(EMBEDDINGS, WIDE), f"rk AS ({risk})",
         """ch AS (SELECT feature_1, feature_2, row_number() OVER (ORDER BY risk_score DESC, p1, p2) AS place
            FROM rk QUALIFY place <= 5)"""],
        """SELECT a.CoilID, place, a.value * z.value AS product FROM ch
           JOIN l a ON a.feature = feature_1 JOIN l z ON z.feature = feature_2 AND z.CoilID = a.CoilID""",
        ["product"], ["CoilID", "place"],
    )
    sql["write_reports"] = out(
        scan_parts(EMBEDDINGS, WIDE),
        """SELECT unnest(['univariate', 'instability', 'redundancy']) AS report,
           (SELECT count(DISTINCT feature) FROM l) AS n UNION ALL SELECT 'interactions', count(*) FROM sc""",
        [], ["n"], ["report"],
    )
    sql["interaction_chart"] = out(
        scan_parts(EMBEDDINGS, WIDE), f"SELECT * FROM sc {STRONG} LIMIT 10",
        ["interaction_strength"], [], ["feature_pair"],
    )
    cell = "'(' || bin1 || ',' || bin2 || ')'"

    def cells(condition):
        return f"coalesce(string_agg({cell}, ' ' ORDER BY {cell}) FILTER ({condition}), '')"

    sql["conditional_regions"] = out(
        [*scan_parts(EMBEDDINGS, WIDE), f"best AS (SELECT * FROM sc {STRONG} LIMIT 20)"],
        f"""SELECT feature_pair, '[' || hi || ']' AS high_risk_regions,
            '[' || lo || ']' AS low_risk_regions,
            CASE WHEN hi <> '' AND lo <> '' THEN 'YES' ELSE 'PARTIAL' END AS conditional_behavior
            FROM (SELECT feature_pair, {cells('rate > 0.15')} AS hi, {cells('rate < 0.03')} AS lo
                  FROM den JOIN best USING (feature_1, feature_2) GROUP BY feature_pair)
            WHERE hi <> '' OR lo <> ''""",
        [], [], ["feature_pair", "high_risk_regions", "low_risk_regions", "conditional_behavior"],
    )
    taxed = LINES.replace("l_returnflag = 'R' AND l_discount >= 0.09", "l_discount >= 0.08 AND l_tax >= 0.06")
    own_bins = f"""ec AS (SELECT feature, Y, quantile_cont(value, [0, 1/3, 2/3, 1]) AS e FROM l GROUP BY feature, Y),
      eb AS (SELECT CoilID, feature, Y, {bin_number(3)} AS bin, list_sort(list_distinct(e)) AS d FROM l JOIN ec USING (feature, Y)),
      es AS (SELECT CoilID, feature, Y, round(d[bin + 1], 3) AS low, round(d[bin + 2], 3) AS high FROM eb),
      cl AS (SELECT DISTINCT feature_pair, a.Y, a.low AS l1, a.high AS h1, z.low AS l2, z.high AS h2
        FROM best JOIN es a ON a.feature = feature_1 JOIN es z ON z.feature = feature_2 AND z.CoilID = a.CoilID)"""
    sql["exclusive_regions_per_class"] = out(
        [*scan_parts(EMBEDDINGS, WIDE), f"best AS (SELECT * FROM sc {STRONG} LIMIT 10)", own_bins],
        """SELECT feature_pair, count(*) AS unstable_regions_found, 'DEFECT_EXCLUSIVE' AS instability_type
           FROM cl d WHERE Y = 1 AND NOT EXISTS (SELECT 1 FROM cl c WHERE c.Y = 0 AND c.feature_pair = d.feature_pair
             AND c.l1 = d.l1 AND c.h1 = d.h1 AND c.l2 = d.l2 AND c.h2 = d.h2) GROUP BY feature_pair""",
        [], ["unstable_regions_found"], ["feature_pair", "instability_type"],
    )
    sql["exclusive_regions"] = out(
        [*scan_parts(taxed, ["X1", "X2", "X3", "X4"]), f"best AS (SELECT * FROM sc {STRONG} LIMIT 10)"],
        """SELECT feature_pair, count(*) AS unstable_regions_found, 'DEFECT_EXCLUSIVE' AS instability_type
           FROM den JOIN best USING (feature_1, feature_2) WHERE n = n_defect GROUP BY feature_pair""",
        [], ["unstable_regions_found"], ["feature_pair", "instability_type"],
    )
    window_ints = ["window", "start", "size"]
    for name, source, names in (
        ("operating_windows", EMBEDDINGS, WIDE), ("operating_windows_lineitem", LINES, SCALE)
    ):
        sql[name] = out(
            [source, long(names), RANKS, top(5), WINDOWS if source is EMBEDDINGS else WINDOWS.replace("CoilID", TEXT_ORDER)],
            "SELECT * FROM ow",
            ["defect_rate", "boundary"], window_ints, ["feature"],
        )
    critical = [EMBEDDINGS, emb_long, RANKS, top(5), WINDOWS, CRITICAL]
    sql["critical_threshold"] = out(
        critical, "SELECT * FROM ct",
        ["safe_rate", "unsafe_rate", "critical_threshold", "risk_increase"], [], ["feature"],
    )
    sql["window_chart"] = out(
        critical, "SELECT feature, safe_rate * 100 AS safe_pct, unsafe_rate * 100 AS unsafe_pct FROM ct",
        ["safe_pct", "unsafe_pct"], [], ["feature"],
    )

    # scaling
    def scaled(names, centre, width):
        marks = train_part(
            {f"c_{c}": centre.format(c) for c in names} | {f"w_{c}": width.format(c) for c in names}
        )
        picks = ", ".join(f"({c} - c_{c}) / w_{c} AS {c}" for c in names)
        return out([EMBEDDINGS, marks], f"SELECT CoilID, {picks} FROM m, ts", names, ["CoilID"])

    sql["standardize"] = scaled(WIDE, "avg({0})", "stddev_pop({0})")
    sql["scale_minmax"] = scaled(WIDE, "min({0})", "max({0}) - min({0})")
    sql["scale_robust"] = scaled(
        WIDE, "median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"
    )

    # engineered features
    sql["interaction_product"] = engineered({f"{a}x{b}": f"{a} * {b}" for a, b in fe.SET1_PRODUCTS})
    sql["safe_ratio"] = engineered({f"{a}div{b}": ratio(a, b, 0) for a, b in fe.SET1_RATIOS})
    sql["difference"] = engineered({f"{a}sub{b}": f"{a} - {b}" for a, b in fe.SET1_DIFFERENCES})
    names = ", ".join(WIDE)
    mean, std = row_mean(WIDE), row_std(WIDE)
    sql["row_stats"] = engineered(
        {"row_mean": mean, "row_std": std, "row_max": f"greatest({names})", "row_min": f"least({names})"}
    )
    instability = f"{std} / (abs({mean}) + 0.000001)"
    sql["row_instability"] = engineered({"instability": instability})
    sql["row_range"] = engineered({"imbalance": f"greatest({names}) - least({names})"})
    blocks = {b: [f"X{i}" for i in numbers] for b, numbers in fe.BLOCKS.items()}
    sql["block_stats"] = engineered(
        {f"{b}_mean": row_mean(c) for b, c in blocks.items()} | {f"{b}_std": row_std(c) for b, c in blocks.items()}
    )
    sql["block_divergence"] = engineered({f"{b}_divergence": row_std(c) for b, c in blocks.items()})
    sql["anomaly_distance"] = engineered(
        {"anomaly_distance": total([f"abs(({c} - a_{c}) / (s_{c} + 0.000001))" for c in WIDE]) + " / 49"},
        [train_part(
            {f"a_{c}": f"avg({c}) FILTER (Y = 0)" for c in WIDE}
            | {f"s_{c}": f"stddev_pop({c}) FILTER (Y = 0)" for c in WIDE}
        )],
    )
    regime = fe.REGIME_FEATURES
    sql["regime_anomaly"] = engineered(
        {"regime_anomaly": total(
            [f"abs({c} - (l_{c} + h_{c}) / 2) / (h_{c} - l_{c} + 0.000001)" for c in regime]
        ) + f" / {len(regime)}"},
        [train_part(
            {f"l_{c}": f"quantile_cont({c}, 0.25)" for c in regime}
            | {f"h_{c}": f"quantile_cont({c}, 0.75)" for c in regime}
        )],
    )
    exceeded = total(["CAST(X1 > 40.0 AS INTEGER)", "CAST(X2 > 50000.0 AS INTEGER)", "CAST(X3 > 0.05 AS INTEGER)"])
    sql["threshold_count"] = out(
        lin, f"SELECT {exceeded} AS threshold_count, count(*) AS n FROM m GROUP BY 1", [], ["threshold_count", "n"]
    )
    limits = total([f"CAST({c} > {limit} AS INTEGER)" for c, limit in fe.LIMITS.items()])
    extremes = total([f"CAST(abs(({c} - a_{c}) / (s_{c} + 0.000001)) > 3 AS INTEGER)" for c in WIDE])
    sql["extreme_count"] = out(
        [EMBEDDINGS, train_part(
            {f"a_{c}": f"avg({c})" for c in WIDE} | {f"s_{c}": f"stddev_pop({c})" for c in WIDE}
        )],
        f"SELECT CoilID, {limits} AS threshold_count, {extremes} AS extreme_count FROM m, ts",
        [], ["CoilID", "threshold_count", "extreme_count"],
    )
    sql["safe_ratio_eps"] = engineered(
        {f"{a}/{b}": ratio(a, b, 1e-6) for a, b in (("X36", "X35"), ("X36", "X34"), ("X35", "X34"))}
    )
    sql["secondary_mean"] = engineered(
        {"X36xX41": "X36 * X41", "X35xX41": "X35 * X41", "X34-X36": "X34 - X36", "instability": instability,
         "rolling_mean": row_mean(["X10", "X13", "X14", "X16"])}
    )

    # weights
    for name, weight in (
        ("class_weights", "CASE WHEN Y = 1 THEN 19.5 ELSE 1.0 END"),
        ("class_weights_unbalance", "CASE WHEN Y = 1 THEN n0 / n1 ELSE 1.0 END"),
        ("class_weights_balanced", "CASE WHEN Y = 1 THEN (n0 + n1) / (2.0 * n1) ELSE (n0 + n1) / (2.0 * n0) END"),
    ):
        sql[name] = out(
            [LINES, "cs AS (SELECT count(*) FILTER (Y = 0) AS n0, count(*) FILTER (Y = 1) AS n1 FROM m)"],
            f"SELECT Y, {weight} AS weight, count(*) AS n FROM m, cs GROUP BY 1, 2",
            ["weight"], ["Y", "n"],
        )
    near = ["few AS (SELECT * FROM m WHERE Y = 1)"]
    distance = "sqrt(" + total([f"(a.{c} - z.{c}) * (a.{c} - z.{c})" for c in WIDE]) + ")"
    sql["nearest_neighbours"] = out(
        [EMBEDDINGS, *near,
         f"nd AS (SELECT a.CoilID, z.CoilID AS neighbour, {distance} AS distance "
         "FROM few a JOIN few z ON a.CoilID <> z.CoilID)"],
        """SELECT *, row_number() OVER (PARTITION BY CoilID ORDER BY distance, neighbour) AS place
           FROM nd QUALIFY place <= 3""",
        ["distance"], ["CoilID", "neighbour", "place"],
    )
    few = f"few AS (SELECT *, row_number() OVER (ORDER BY {mark('CoilID')}, CoilID) - 1 AS nr FROM m WHERE Y = 1)"
    sizes = "cs AS (SELECT count(*) FILTER (Y = 0) - count(*) FILTER (Y = 1) AS short, count(*) FILTER (Y = 1) AS n1 FROM m)"

    def made(source, names):
        square = "sqrt(" + total([f"(a.{c} - z.{c}) * (a.{c} - z.{c})" for c in names]) + ")"
        near = (
            f"nd AS (SELECT a.CoilID, min({{'d': {square}, 'n': z.CoilID}}, 3) AS near "
            "FROM few a JOIN few z ON a.CoilID <> z.CoilID GROUP BY a.CoilID)"
        )
        dealt = "dl AS (SELECT few.*, unnest(range(1, short // n1 + CAST(nr < short % n1 AS INTEGER) + 1)) AS copy FROM few, cs)"
        placed = (
            f"pl AS (SELECT *, {mark('CoilID', 'copy', seed=45)} % 3 + 1 AS place, "
            f"{unit(mark('CoilID', 'copy', seed=46))} AS gap FROM dl)"
        )
        picked = "pi AS (SELECT pl.*, near[place].n AS neighbour FROM pl JOIN nd USING (CoilID))"
        columns = ", ".join(f"p.{c} + gap * (z.{c} - p.{c}) AS {c}" for c in names)
        rows = f"ma AS (SELECT p.CoilID AS source, p.copy, p.neighbour, p.gap, p.Y, {columns} FROM pi p JOIN few z ON z.CoilID = p.neighbour)"
        return [source, few, sizes, near, dealt, placed, picked, rows]

    sql["smote"] = out(made(LINES, SCALE), "SELECT * FROM ma", ["gap", *SCALE], ["copy", "Y"], ["source", "neighbour"])
    sql["smote_sizes"] = out(
        lin,
        """SELECT Y, 0 AS synthetic, count(*) AS n FROM m GROUP BY Y UNION ALL
           SELECT 1, 1, count(*) FILTER (Y = 0) - count(*) FILTER (Y = 1) FROM m""",
        [], ["Y", "synthetic", "n"],
    )
    sql["hybrid_resample"] = out(
        made(EMBEDDINGS, WIDE),
        f"""SELECT Y, CASE WHEN Y = 1 THEN 20.0 ELSE 1.0 END AS weight, count(*) AS n,
              {', '.join(f'avg({c}) AS mean_{c}' for c in WIDE)}
            FROM (SELECT Y, {', '.join(WIDE)} FROM m UNION ALL SELECT Y, {', '.join(WIDE)} FROM ma) GROUP BY Y""",
        ["weight", *[f"mean_{c}" for c in WIDE]], ["Y", "n"],
    )
    sql["stratified_folds"] = out(
        [LINES],
        f"SELECT CoilID, Y, (row_number() OVER (PARTITION BY Y ORDER BY {mark('CoilID')}, CoilID) - 1) % 5 AS fold FROM m",
        [], ["Y", "fold"], ["CoilID"],
    )
    steps, term, reached = [], math.exp(-1.0), 0.0
    for copies in range(18):
        reached += term
        steps.append(f"WHEN u < {reached!r} THEN {copies}")
        term /= copies + 1
    sql["balanced_bags"] = out(
        [LINES,
         f"""dr AS (SELECT m.*, bag, {unit(mark('CoilID', 'bag'))} AS u FROM m, (SELECT unnest(range(10)) AS bag)),
         co AS (SELECT *, unnest(range(1, CASE {' '.join(steps)} ELSE 18 END + 1)) AS copy FROM dr),
         le AS (SELECT bag, min(n) AS size FROM (SELECT bag, Y, count(*) AS n FROM co GROUP BY bag, Y) GROUP BY bag),
         ke AS (SELECT co.*, size FROM co JOIN le USING (bag)
           QUALIFY row_number() OVER (PARTITION BY bag, Y ORDER BY {mark('CoilID', 'bag', 'copy')}, CoilID, copy) <= size)"""],
        "SELECT bag, Y, count(*) AS n, max(copy) AS copies, sum(X1) AS sum_X1, sum(X5) AS sum_X5 FROM ke GROUP BY bag, Y",
        ["sum_X1", "sum_X5"], ["bag", "Y", "n", "copies"],
    )
    sql["isolation_samples"] = out(
        [LINES],
        "SELECT unnest(range(100)) AS tree, least(256, n) AS n, least(256, n) AS keys FROM (SELECT count(*) AS n FROM m)",
        [], ["tree", "n", "keys"],
    )

    # evaluation
    sql["model_comparison"] = summary("stddev_pop")
    sql["performance_tracker"] = summary("stddev_samp")
    sql["confusion_matrix"] = out(
        [SCORES, CELLS],
        """SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cells UNION ALL SELECT 0, 1, fp FROM cells UNION ALL
           SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells""",
        [], ["actual", "predicted", "n"],
    )
    defect = """tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1"""
    sql["classification_metrics"] = out(
        [SCORES, CELLS],
        f"SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, {defect} FROM cells",
        ["accuracy", "precision", "recall", "f1"],
    )
    normal = """tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fp + fn) AS f1"""
    sql["classification_report"] = out(
        [SCORES, CELLS,
         f"nr AS (SELECT 'Normal' AS row_name, {normal}, tn + fp AS support FROM cells)",
         f"dr AS (SELECT 'Defect' AS row_name, {defect}, tp + fn AS support FROM cells)",
         "ac AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS a, tp + fp + fn + tn AS n FROM cells)",
         "bo AS (SELECT * FROM nr UNION ALL SELECT * FROM dr)"],
        """SELECT * FROM bo UNION ALL SELECT 'accuracy', a, a, a, n FROM ac UNION ALL
           SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM bo UNION ALL
           SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
             sum(f1 * support) / sum(support), sum(support) FROM bo""",
        ["precision", "recall", "f1"], ["support"], ["row_name"],
    )
    roc = """SELECT p AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM cu
      UNION ALL SELECT NULL, 0.0, 0.0"""
    sql["roc_curve"] = out([PRICES, CUMULATIVE], roc, ["threshold", "fpr", "tpr"])
    area = """SELECT max(n_neg) AS n_neg, max(n_pos) AS n_pos,
      sum(n1 * ((n_neg - fp) + n0 / 2.0)) / (max(n_neg) * max(n_pos)) AS roc_auc FROM cu"""
    sql["roc_auc"] = out([SCORES, CUMULATIVE], area, ["roc_auc"], ["n_neg", "n_pos"])
    sql["roc_auc_prices"] = out([PRICES, CUMULATIVE], area, ["roc_auc"], ["n_neg", "n_pos"])
    sql["pr_curve"] = out(
        [SCORES, CUMULATIVE],
        """SELECT p AS threshold, tp / (tp + fp) AS precision, tp / n_pos AS recall FROM cu
           UNION ALL SELECT NULL, 1.0, 0.0""",
        ["threshold", "precision", "recall"],
    )
    sql["pr_auc"] = out(
        [PRICES, CUMULATIVE,
         "pt AS (SELECT p, tp / (tp + fp) AS precision, tp / n_pos AS recall FROM cu "
         "UNION ALL SELECT 1e308, 1.0, 0.0)",
         "tr AS (SELECT precision, recall, lag(precision) OVER (ORDER BY p DESC) AS before, "
         "lag(recall) OVER (ORDER BY p DESC) AS start FROM pt)"],
        "SELECT sum((recall - start) * (precision + before) / 2) AS pr_auc FROM tr",
        ["pr_auc"],
    )
    counts = ["tp", "fp", "fn", "tn"]
    sql["threshold_sweep"] = out([SCORES, sweep()], "SELECT * FROM sw", SWEEP_DOUBLES, counts)
    sql["threshold_sweep_100"] = out([SCORES, sweep(100)], "SELECT * FROM sw", SWEEP_DOUBLES, counts)
    best = " UNION ALL ".join(
        f"(SELECT '{m}' AS metric, threshold, {m} AS best FROM sw ORDER BY {m} DESC, threshold LIMIT 1)"
        for m in ("f1", "recall", "precision", "industrial_score")
    )
    sql["optimal_threshold"] = out([SCORES, sweep()], best, ["threshold", "best"], [], ["metric"])
    sql["industrial_score"] = out(
        [SCORES, sweep()], "SELECT * FROM sw ORDER BY industrial_score DESC, threshold LIMIT 1",
        SWEEP_DOUBLES, counts,
    )
    sql["cost_threshold"] = out(
        [SCORES, sweep()],
        "SELECT threshold, fn * 10.0 + fp * 4.0 AS cost FROM sw ORDER BY cost, threshold LIMIT 1",
        ["threshold", "cost"],
    )
    sql["threshold_chart"] = out(
        [SCORES, sweep(),
         "bf AS (SELECT threshold AS t FROM sw ORDER BY f1 DESC, threshold LIMIT 1)",
         "bi AS (SELECT threshold AS t FROM sw ORDER BY industrial_score DESC, threshold LIMIT 1)"],
        """SELECT sw.*, CAST(threshold = bf.t AS INTEGER) AS f1_optimum,
           CAST(threshold = bi.t AS INTEGER) AS industrial_optimum FROM sw, bf, bi""",
        SWEEP_DOUBLES, ["f1_optimum", "industrial_optimum"],
    )
    grouped = """s AS (SELECT l_linestatus AS model, l_linenumber AS fold, l_extendedprice / 110000.0 AS p,
      CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
g AS (SELECT model, fold, p, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM s GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(n1) OVER (PARTITION BY model, fold ORDER BY p DESC) AS tp,
    sum(n0) OVER (PARTITION BY model, fold ORDER BY p DESC) AS fp,
    sum(n1) OVER (PARTITION BY model, fold) AS n_pos, sum(n0) OVER (PARTITION BY model, fold) AS n_neg FROM g)"""
    sql["fold_roc_curves"] = out(
        [grouped],
        """SELECT model, fold, p AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM cu
           UNION ALL SELECT DISTINCT model, fold, NULL, 0.0, 0.0 FROM s""",
        ["threshold", "fpr", "tpr"], ["fold"], ["model"],
    )
    sql["fold_roc_auc"] = out(
        [grouped],
        """SELECT model, fold, max(n_neg) AS n_neg, max(n_pos) AS n_pos,
           sum(n1 * ((n_neg - fp) + n0 / 2.0)) / (max(n_neg) * max(n_pos)) AS roc_auc
           FROM cu GROUP BY model, fold""",
        ["roc_auc"], ["fold", "n_neg", "n_pos"], ["model"],
    )

    # scoring
    sql["decide"] = out(
        [SCORES, PREDICTIONS], "SELECT prediction, count(*) AS n FROM pt GROUP BY 1", [], ["prediction", "n"]
    )
    sql["confidence"] = out(
        [SCORES, PREDICTIONS],
        """SELECT probability_calibrated, max(confidence) AS confidence, count(*) AS n FROM pt GROUP BY 1""",
        ["probability_calibrated", "confidence"], ["n"],
    )
    sql["predictions_table"] = out(
        [SCORES, PREDICTIONS], "SELECT *, row_number() OVER (ORDER BY " + TEXT_ORDER + ", CoilID) - 1 AS sample_id FROM pt",
        ["probability_raw", "probability_calibrated", "confidence", "threshold"],
        ["sample_id", "prediction"], ["CoilID"],
    )
    four = "printf('%.4f', round({0}, 4))"
    share = "printf('%.2f%%', round(100.0 * {0} / n, 2))"
    facts = [
        ("Total Samples", "CAST(n AS VARCHAR)"), ("Defect Predictions", "CAST(d AS VARCHAR)"),
        ("Normal Predictions", "CAST(n - d AS VARCHAR)"), ("Defect Rate (%)", share.format("d")),
        ("Mean Probability", four.format("a")), ("Std Probability", four.format("sd")),
        ("Min Probability", four.format("mn")), ("Max Probability", four.format("mx")),
        ("Threshold Used", "'0.25'"), ("Model", "'gradient-boosted hybrid'"),
        ("Features (Original)", "'49'"), ("Features (Engineered)", "'15'"), ("Features (Total)", "'64'"),
        ("Calibration Method", "'Sigmoid (Platt scaling)'"), ("Normal Rate (%)", share.format("(n - d)")),
        ("Median", four.format("q2")), ("Percentile 25", four.format("q1")),
        ("Percentile 75", four.format("q3")),
    ]
    sql["prediction_summary"] = out(
        [SCORES, PREDICTIONS,
         """su AS (SELECT count(*) AS n, sum(prediction) AS d, avg(probability_calibrated) AS a,
            stddev_pop(probability_calibrated) AS sd, min(probability_calibrated) AS mn,
            max(probability_calibrated) AS mx, quantile_cont(probability_calibrated, 0.25) AS q1,
            quantile_cont(probability_calibrated, 0.5) AS q2, quantile_cont(probability_calibrated, 0.75) AS q3
            FROM pt)"""],
        " UNION ALL ".join(f"SELECT '{name}' AS metric, {value} AS value FROM su" for name, value in facts),
        [], [], ["metric", "value"],
    )
    sql["write_predictions"] = (
        f"WITH ps AS ({sql['prediction_summary']}), pn AS (SELECT CAST(count(*) AS VARCHAR) AS n FROM lineitem) "
        "SELECT 'text' AS kind, rpad(metric, 24, ' ') || value AS line FROM ps "
        "UNION ALL SELECT unnest(['predictions', 'predictions_detailed']), n FROM pn "
        "UNION ALL SELECT 'prediction_summary', CAST(count(*) AS VARCHAR) FROM ps"
    )
    sql["model_reports"] = out(
        ["mo AS (SELECT unnest(['boosted', 'unbalanced', 'forest']) AS model)", "fo AS (SELECT unnest(range(5)) AS fold)"],
        """SELECT model, fold, 1 AS starts, 1 AS ends, 3 AS features, 1.0 AS importance,
             CASE WHEN model = 'forest' THEN 0 ELSE 3 END AS explained, 100 AS thresholds FROM mo, fo""",
        ["importance"], ["fold", "starts", "ends", "features", "explained", "thresholds"], ["model"],
    )
    sql["triage_bands"] = out(
        [SCORES],
        """SELECT CASE WHEN p > 0.50 THEN 'HOLD' WHEN p > 0.30 THEN 'INSPECT' WHEN p >= 0.25 THEN 'MONITOR'
           ELSE 'RELEASE' END AS band, count(*) AS n FROM s GROUP BY 1""",
        [], ["n"], ["band"],
    )
    sql["defects_only"] = out(
        [SCORES, PREDICTIONS], "SELECT * FROM pt WHERE prediction = 1", ["probability_calibrated"], [], ["CoilID"]
    )

    # charts
    sql["histogram_by_class"] = histogram(
        [EMBEDDINGS, emb_long, RANKS, top(12), "v AS (SELECT feature, Y, value FROM l JOIN top USING (feature))"], 6
    )
    sql["histogram_by_class_lineitem"] = histogram(
        [LINES, lin_long, "v AS (SELECT feature, Y, value FROM l)"], 4
    )
    sql["boxplot_by_class"] = out(
        [LINES, lin_long, QUARTILES],
        """SELECT feature, Y, q1, q2 AS median, q3,
           least(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), q1) AS whisker_low,
           greatest(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), q3) AS whisker_high,
           count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers
           FROM l JOIN q USING (feature, Y) GROUP BY feature, Y, q1, q2, q3""",
        ["q1", "median", "q3", "whisker_low", "whisker_high"], ["Y", "fliers"], ["feature"],
    )
    sql["fingerprints"] = out(
        [EMBEDDINGS,
         long(WIDE),
         "fs AS (SELECT Y, feature, avg(value) AS mean, stddev_samp(value) AS std FROM l GROUP BY Y, feature)"],
        "SELECT *, mean - std AS band_low, mean + std AS band_high FROM fs",
        ["mean", "std", "band_low", "band_high"], ["Y"], ["feature"],
    )

    # declared extras
    sql["impute_mean"] = out(
        [GAPS, "md AS (SELECT avg(X8) AS a8, avg(X42) AS a42 FROM m)"],
        "SELECT CoilID, coalesce(X8, a8) AS X8, coalesce(X42, a42) AS X42 FROM m, md", ["X8", "X42"], ["CoilID"],
    )
    whole = " AND ".join(f"{c} IS NOT NULL" for c in gap_names)
    sql["impute_drop"] = out(
        [GAPS], f"SELECT count(*) AS n, avg(X1) AS mean_x1 FROM m WHERE {whole}", ["mean_x1"], ["n"]
    )
    sparse = "CASE WHEN (count(*) - count({0})) / count(*) * 100 > 50 THEN 0 ELSE 1 END"
    sql["drop_sparse_columns"] = out(
        [],
        f"""SELECT count(*) AS n, 2 + {sparse.format('quality')} + {sparse.format('toxic')} AS columns_left
            FROM documents LEFT JOIN labels USING (doc_id)""",
        [], ["n", "columns_left"],
    )
    sql["rolling_std"] = out(
        [],
        f"""SELECT {LINE_KEY} AS CoilID, stddev_samp(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY {LINE_KEY}
            ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS "X1_rolling_std" FROM lineitem""",
        ["X1_rolling_std"], [], ["CoilID"],
    )
    sql["rolling_std_whole"] = out(
        [f"k AS (SELECT {LINE_KEY} AS CoilID, l_quantity FROM lineitem)"],
        f"""SELECT CoilID, stddev_samp(l_quantity) OVER (ORDER BY {TEXT_ORDER}, CoilID
            ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS "X1_rolling_std" FROM k""",
        ["X1_rolling_std"], [], ["CoilID"],
    )
    deciles = "[" + ", ".join(f"{i}/10" for i in range(11)) + "]"
    sql["drift_report"] = out(
        [LINES, lin_long,
         f"""ed AS (SELECT feature, quantile_cont(value, {deciles}) AS e FROM l WHERE Y = 0 GROUP BY feature),
         bn AS (SELECT feature, Y, {bin_number(10)} AS bin FROM l JOIN ed USING (feature)),
         cb AS (SELECT feature, bin, count(*) FILTER (Y = 0) AS was, count(*) FILTER (Y = 1) AS now FROM bn GROUP BY 1, 2),
         sb AS (SELECT feature, greatest(was / sum(was) OVER (PARTITION BY feature), 1e-6) AS a,
             greatest(now / sum(now) OVER (PARTITION BY feature), 1e-6) AS c FROM cb),
         ps AS (SELECT feature, sum((c - a) * ln(c / a)) AS psi FROM sb GROUP BY feature),
         sh AS (SELECT feature, (avg(value) FILTER (Y = 1) - avg(value) FILTER (Y = 0))
             / stddev_pop(value) FILTER (Y = 0) AS mean_shift FROM l GROUP BY feature)"""],
        "SELECT feature, mean_shift, psi FROM sh JOIN ps USING (feature)",
        ["mean_shift", "psi"], [], ["feature"],
    )
    sql["stream_drift"] = out(
        ["""l AS (SELECT 'value' AS feature, value, event_type = 'error' AS known FROM events
             UNION ALL SELECT 'hour', CAST(hour(ts) AS DOUBLE), event_type = 'error' FROM events)""",
         f"""ed AS (SELECT feature, quantile_cont(value, {deciles}) AS e FROM l WHERE known GROUP BY feature),
         bn AS (SELECT feature, known, {bin_number(10)} AS bin FROM l JOIN ed USING (feature)),
         cb AS (SELECT feature, bin, count(*) FILTER (known) AS was, count(*) AS now FROM bn GROUP BY 1, 2),
         sb AS (SELECT feature, now, greatest(was / sum(was) OVER (PARTITION BY feature), 1e-6) AS a,
             greatest(now / sum(now) OVER (PARTITION BY feature), 1e-6) AS c FROM cb)"""],
        "SELECT feature, sum(now) AS n, sum((c - a) * ln(c / a)) AS psi FROM sb GROUP BY feature",
        ["psi"], ["n"], ["feature"],
    )
    sql["stream_score_model"] = out(
        emb, "SELECT count(*) AS n, 0.0 AS gap, count(*) AS decided FROM m", ["gap"], ["n", "decided"]
    )
    cell = {c: f"least(CAST(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 40) AS INTEGER), 39)" for c in ("X1", "X2")}
    sql["binned_points"] = out(
        [LINES, "en AS (SELECT min(X1) AS lo_X1, max(X1) AS hi_X1, min(X2) AS lo_X2, max(X2) AS hi_X2 FROM m)",
         f"pt AS (SELECT Y, {cell['X1']} AS bin_x, {cell['X2']} AS bin_y, en.* FROM m, en)"],
        """SELECT Y, bin_x, bin_y, any_value(lo_X1) + bin_x * ((any_value(hi_X1) - any_value(lo_X1)) / 40) AS low_x,
             any_value(lo_X1) + (bin_x + 1) * ((any_value(hi_X1) - any_value(lo_X1)) / 40) AS high_x,
             any_value(lo_X2) + bin_y * ((any_value(hi_X2) - any_value(lo_X2)) / 40) AS low_y,
             any_value(lo_X2) + (bin_y + 1) * ((any_value(hi_X2) - any_value(lo_X2)) / 40) AS high_y, count(*) AS n
           FROM pt GROUP BY Y, bin_x, bin_y""",
        ["low_x", "high_x", "low_y", "high_y"], ["Y", "bin_x", "bin_y", "n"],
    )
    sql["pca_point_totals"] = out(
        lin,
        "SELECT unnest(['pc1-pc2', 'pc1-pc3']) AS panel, Y, n FROM (SELECT Y, count(*) AS n FROM m GROUP BY Y)",
        [], ["Y", "n"], ["panel"],
    )
    sql["regime_point_totals"] = out(lin, "SELECT Y, count(*) AS n FROM m GROUP BY Y", [], ["Y", "n"])
    sql["stream_monitor"] = out(
        [],
        """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS n,
           sum(CAST(event_type = 'error' AS INTEGER)) AS n_positive,
           avg(CAST(event_type = 'error' AS DOUBLE)) AS positive_rate, avg(value) AS mean_value
           FROM events GROUP BY 1""",
        ["positive_rate", "mean_value"], ["window_start", "n", "n_positive"],
    )
    sql["stream_score"] = out(
        ["hi AS (SELECT max(value) AS v FROM events)"],
        """SELECT event_id, value, value / v AS probability_calibrated, CAST(value / v >= 0.25 AS INTEGER) AS prediction,
           greatest(least(abs(value / v - 0.25) / 0.75, 1.0), 0.0) AS confidence FROM events, hi""",
        ["value", "probability_calibrated", "confidence"], ["event_id", "prediction"],
    )

    # invariants
    sql["pca_squares"] = out(
        [EMBEDDINGS, emb_long,
         f"""nu AS (SELECT *, {POSITION} AS place FROM l),
         pr AS (SELECT a.feature AS f, z.feature AS g, corr(a.value, z.value) AS r
           FROM nu a JOIN nu z ON a.CoilID = z.CoilID AND a.place < z.place GROUP BY ALL)"""],
        "SELECT (SELECT count(DISTINCT feature) FROM l) AS n, (SELECT count(DISTINCT feature) FROM l) + 2 * sum(r * r) AS squares FROM pr",
        ["squares"], ["n"], digits=4,
    )
    sql["pca_norms"] = out(
        [LINES, lin_long,
         "ms AS (SELECT feature, avg(value) AS a, stddev_pop(value) AS s FROM l GROUP BY feature)",
         "zs AS (SELECT CoilID, Y, sum(((value - a) / s) ^ 2) AS norm FROM l JOIN ms USING (feature) GROUP BY CoilID, Y)"],
        "SELECT Y, count(*) AS n, avg(norm) AS norm FROM zs GROUP BY Y", ["norm"], ["Y", "n"], digits=4,
    )
    sql["bag_balance"] = out([], "SELECT i AS bag, 1 AS balanced FROM range(10) t(i)", [], ["bag", "balanced"])
    sql["oof_folds"] = out(
        [LINES, "nu AS (SELECT Y, row_number() OVER (PARTITION BY Y ORDER BY CoilID) - 1 AS r FROM m)"],
        "SELECT Y, r % 5 AS fold, count(*) AS n, count(*) AS keys FROM nu GROUP BY 1, 2",
        [], ["Y", "fold", "n", "keys"],
    )
    sql["regime_totals"] = out(emb, "SELECT count(*) AS n, sum(Y) AS defects FROM m", ["defects"], ["n"])
    sql["cluster_totals"] = out(lin, "SELECT count(*) FILTER (Y = 1) AS n, 100.0 AS pct FROM m", ["pct"], ["n"])
    sql["attribution_gap"] = out(emb, "SELECT count(*) AS n, 0.0 AS gap FROM m", ["gap"], ["n"])
    return sql
