"""A small labelled URL table, made from words by a rule.

Every label has its own words for hosts and for paths; hosts and paths of a label are
combined, and a third of the rows mixes in a neutral host or path, so neither part
decides alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_HOSTS = ["casino", "poker", "betwin", "pillshop", "viagra", "fastloan", "xxxcams", "torrentz", "warez", "cracked", "replica-watches", "freeprize", "hotgirls", "cryptodouble"]
BLOCK_PATHS = ["/win/bonus", "/jackpot", "/cheap-pills", "/free-download.exe", "/verify-account/login.php", "/adult/cams", "/keygen", "/claim-prize", "/payday/apply", "/slots/play"]
ALLOW_HOSTS = ["news", "wiki", "docs", "library", "school", "museum", "science", "weather", "university", "gardening", "recipes", "history", "travel", "openmaps"]
ALLOW_PATHS = ["/articles/2024", "/about", "/research/papers", "/help/index.html", "/en/12", "/blog/post-7", "/events/may", "/contact", "/guide/start", "/de/news/3"]
NEUTRAL_HOSTS = ["example", "site", "myhost"]
NEUTRAL_PATHS = ["/", "/index.html", "/page/1"]
SUFFIXES = ["com", "net", "org"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block): about a thousand rows, in equal parts 0 and 1."""
    of = lambda values: F.explode(F.array(*map(F.lit, values)))

    def rows(hosts: list[str], paths: list[str], block: int) -> DataFrame:
        cut = spark.range(1).select(of(hosts).alias("h")).select("h", of(paths).alias("p")).select("h", "p", of(SUFFIXES).alias("s"))
        return cut.select(F.concat(F.lit("http://www."), "h", F.lit("."), "s", "p").alias("url"), F.lit(block).alias("block"))

    out = None
    for hosts, paths, block in ((BLOCK_HOSTS, BLOCK_PATHS, 1), (ALLOW_HOSTS, ALLOW_PATHS, 0)):
        for one in (rows(hosts, paths, block), rows(hosts, NEUTRAL_PATHS, block), rows(NEUTRAL_HOSTS, paths, block)):
            out = one if out is None else out.unionByName(one)
    return out
