"""URL filtering: host and path rules first, then logistic regression on hashed character n-grams.

The classifier is fitted on a small labelled URL table (at most ``max_labelled``
rows, those with the smallest hash of the URL; by default the table of
``url_labels``, which knows nothing of the rules) and scores every other URL in one
scan without a shuffle.  All of it runs in the JVM.

Defined cases: null URLs and URLs without ``://`` have an empty host and path and
get the classifier's verdict for the empty string; a labelled table with a single
class gives that class, an empty one ``allow``; repeated rows are judged each;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize
from .url_labels import labelled_urls

Rule = tuple[str, str]
FEATURES = 1 << 14
GRAM_SIZES = (2, 3, 4)
MAX_LABELLED = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule text that fits, or null.  A rule is (verdict, "host/path")."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def _verdict(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, verdict).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """Character n-grams of every size of ``GRAM_SIZES``."""
    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, GRAM_SIZES))


def _features(df: DataFrame) -> DataFrame:
    df = df.withColumn("_text", F.concat(F.lit("^"), F.col("host"), F.lit("|"), F.col("path"), F.lit("$")))
    df = df.withColumn("_grams", _grams(F.col("_text")))
    return HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="_vector").transform(df)


def url_filter(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, host, path, rule, verdict, p_block); ``labelled`` has ``url`` and ``block`` (0 or 1)."""
    url = F.col(url_col).cast("string")
    judged = pages.select(F.col(id_col), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("_by_rule", _verdict(F.col("rule"), rules))
    known = (labelled_urls(pages.sparkSession) if labelled is None else labelled).where("block is not null").orderBy(F.xxhash64("url"), "url", "block").limit(max_labelled)
    table = materialize(known.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("block").cast("double").alias("block")), "urls")
    classes = sorted(r[0] for r in table.select("block").distinct().collect())  # two rows at most
    if len(classes) < 2:
        out = judged.withColumn("p_block", F.lit(classes[0] if classes else 0.0))
    else:
        model = LogisticRegression(featuresCol="_vector", labelCol="block", regParam=0.001, maxIter=40, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class").fit(_features(table).select("_vector", "block"))
        out = model.transform(_features(judged)).withColumn("p_block", vector_to_array("_p")[1])
    return out.select(id_col, "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
