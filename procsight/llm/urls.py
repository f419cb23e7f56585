"""URL filters: rules on hosts and paths, found by equi-joins on short hash prefixes.

Each URL is expanded into the expressions host suffix + path prefix, where
suffixes begin at a label and prefixes end with a slash (or are empty). A rule's
expression is its host and its path up to the last slash. Both sides are joined
on the first four bytes of the expressions' SHA-256; equal full digests and the
rest of the rule's path confirm a match, and the longest rule wins.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsight.llm.tables import kept


def host_and_path(url):
    """The two columns of a URL column: both empty for null and for URLs without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _suffixes(host):
    """The host and all that follows one of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def _prefixes(path):
    """The empty path and all beginnings of the path that end with a slash."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )


def _digest(host, path):
    # A host holds no slash and a path begins with one or is empty, so the line feed only marks the border.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with their digest; of rules on the same host and path the blocking one counts."""
    path = F.coalesce(F.col("path"), F.lit(""))
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    stem = F.regexp_extract(path, r"(?s)^.*/", 0)
    digest = _digest(host, stem)
    return (
        rules.where("host is not null")
        .select(
            F.concat(host, path).alias("rule"),
            path.alias("rule_path"),
            "verdict",
            F.substring(digest, 1, 8).alias("short"),
            digest.alias("full"),
        )
        .groupBy("rule", "rule_path", "short", "full")
        .agg(F.max("verdict").alias("verdict"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages`.

    A rule fits its host and all subdomains if the URL's path begins with the
    rule's; the longest rule wins; without one the verdict is `default`. Each
    distinct host and path is judged once, so a URL or host that many rows share
    costs one row for each map task. Null URLs and URLs without `://` have an
    empty host and path, which only a rule for the empty host could fit. Null
    keys and repeated rows keep their rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    places = rows.select("host", "path").distinct()
    expanded = places.select(
        "host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix")
    ).select("host", "path", "suffix", F.explode(_prefixes(F.col("path"))).alias("prefix"))
    wanted = expanded.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest")).withColumn(
        "short", F.substring("digest", 1, 8)
    )
    known = rule_table(rules)
    fits = wanted.join(known, "short").where("digest = full").where(F.startswith("path", "rule_path"))
    # A stored side has one row for each place, so Spark can split a place that very many rows share.
    best = kept(
        fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best")),
        "verdicts",
    )
    return rows.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
