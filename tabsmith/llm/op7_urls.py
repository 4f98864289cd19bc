"""URL filter: rules of host and path, and logistic regression on hashed character n-grams for all other URLs.

DataFrame expressions and MLlib's DataFrame estimators only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.url_labels import labelled_urls

ALLOW, BLOCK = "allow", "block"
#: Hashed features, lengths of the n-grams, and training URLs at most (by a hash of the URL).
FEATURES = 1 << 13
GRAMS = (3, 4)
SAMPLE_URLS = 4000
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of `rule` and `verdict`; NULL without.

    A rule fits its host and all subdomains, where the path starts with the rule's. Rules of one length: the later in code points.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """All character n-grams of a text; in time linear in its length."""
    letters = F.split(text, "")

    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.concat(*[F.get(letters, k - 1 + j) for j in range(n)]))

    return F.concat(*[of(n) for n in sizes])


def _features(rows: DataFrame, features: int, sizes: Sequence[int]) -> DataFrame:
    """`features` from the columns `host` and `path`."""
    shown = F.concat(F.lit("^"), "host", F.lit(" "), "path", F.lit("$"))
    return HashingTF(numFeatures=features, binary=True, inputCol="_grams", outputCol="features").transform(rows.withColumn("_grams", grams(shown, sizes)))


def train(labelled: DataFrame, features: int = FEATURES, sizes: Sequence[int] = GRAMS, sample: int = SAMPLE_URLS) -> LogisticRegressionModel | None:
    """A classifier from a small table of `host`, `path` and `label` (1: block); None if it does not hold both labels.

    Takes the first `sample` rows at most, by a hash of host and path; rows with a NULL label teach nothing.
    """
    small = labelled.where("label is not null").select("host", "path", F.col("label").cast("double").alias("label"))
    small = small.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample)
    rows = _features(small, features, sizes).select("label", "features").coalesce(2).cache()
    try:
        if len(rows.select("label").distinct().take(2)) < 2:
            return None
        return LogisticRegression(maxIter=30, regParam=1e-3, standardization=False, aggregationDepth=2).fit(rows)
    finally:
        rows.unpersist()


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    labelled: DataFrame | None = None,
    features: int = FEATURES,
    sizes: Sequence[int] = GRAMS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row: id, `host`, `path`, `rule`, `verdict`, `block_score` (of the classifier; NULL where a rule decided or nothing was learned).

    Without a `labelled` table (`host`, `path`, `label`), the classifier learns from the one of `url_labels`, never from what the
    rules say. Where it learned nothing, other URLs are allowed. NULL URLs and such without `://` have empty host and
    path and are judged like all others. Only the id and URL columns are read; an empty table gives no rows.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled, features, sizes)
    if model is None:
        scored = ruled.withColumn("_score", F.lit(None).cast("double"))
    else:
        model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_class")
        scored = model.transform(_features(ruled, features, sizes)).withColumn("_score", F.get(vector_to_array("_probability"), F.lit(1)))
    own = F.when(F.col("_score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        id_col,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.col("_score")).alias("block_score"),
    )
