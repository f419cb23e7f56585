"""The operators applied to whole tables, with production parameters, and the SQL of those that it can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight.llm import (
    counts,
    decontaminate,
    html,
    langid,
    licenses,
    negatives,
    neighbours,
    packing,
    simhash,
    spotsigs,
    toxicity,
    urls,
    whitening,
)
from procsight.session import shared_folder

#: File of the tokenizer that counts and packing use; it lies in the package of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), budget=2)
    return found.select("doc_id", "fingerprint", "component_id", "n_copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted through a digest cache that is empty at first."""
    cache = counts.new_cache(shared_folder(spark))
    return counts.token_counts(table(spark, sf_dir, "documents"), cache, tokenizer_path(), limit=1024)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with its significant passages."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.learn(pages))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that gives a license."""
    return licenses.scan(table(spark, sf_dir, "documents"))


#: (host, path, verdict) of the URL query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the rules on every page's URL."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules, default="allow")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every 20th vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, every window with the sources' shares of the corpus."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose passage it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs, rows=1000))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot signature fingerprints of every document and its edited text, and how alike they and the next document are."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=4)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(rows, every=50, positives=5, negatives=3, low=50, high=95)


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_simhash_near_dedup,
    op2_token_counts,
    op3_toxicity,
    op4_html_extraction,
    op5_license_scan,
    op6_url_filters,
    op7_nearest_neighbours,
    op8_packing,
    op9_decontamination,
    op10_language_id,
    op11_document_fingerprints,
    op12_embedding_whitening,
    op13_hard_negatives,
]

SQL: dict[str, str] = {
    "op6_url_filters": """
        WITH after AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM after),
        places AS (
            SELECT page_id,
                translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
            FROM hosts
        ),
        rules(rule_host, rule_path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ),
        urls AS (SELECT DISTINCT host, path FROM places),
        best AS (
            SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                max_by(verdict, length(rule_host || rule_path)) AS verdict
            FROM urls JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY host, path
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM places LEFT JOIN best USING (host, path)
    """,
    "op7_nearest_neighbours": """
        WITH vectors AS (
            SELECT row_number() OVER () AS uid, vec_id, embedding AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                AND len([x FOR x IN embedding IF x <> 0]) > 0
        ),
        scored AS (
            SELECT q.uid AS owner, q.vec_id AS query_id, c.vec_id,
                list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS score
            FROM vectors q JOIN vectors c ON q.uid <> c.uid AND len(q.v) = len(c.v)
            WHERE q.vec_id % 20 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_hard_negatives": """
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
                CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
            FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id AND len(a.x) = len(r.x)
            WHERE a.vec_id % 50 = 0
        ),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ),
        ranked AS (
            SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 3
    """,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def statements() -> dict[str, str]:
    return dict(SQL)
