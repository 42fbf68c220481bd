"""BM25 ranking over any text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case terms of two characters or more; hyphen, dot and underscore stay inside."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9._-]*[a-z0-9]"), 0)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, len)."""
    words = docs.select(id_col, tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return words.select(id_col, F.size("w").alias("len"), F.explode("w").alias("term")).groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def _counts(docs: DataFrame, asked: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, len, tf): number of terms, and how often each asked term occurs; written, so that texts are read once."""
    words = docs.select(id_col, tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    hits = words.select(id_col, F.size("w").alias("len"), F.filter("w", lambda t: t.isin(asked)).alias("h"))
    return materialize(hits.select(id_col, "len", *[F.size(F.filter("h", _is(t))).alias(f"tf{i}") for i, t in enumerate(asked)]), "bm25")


def _is(term: str):
    return lambda w: w == term


def _query_terms(docs: DataFrame, query: str) -> dict[str, int]:
    """The query's own terms and how often each is asked for (one row)."""
    asked = docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("w")).first()["w"]
    return {t: asked.count(t) for t in dict.fromkeys(asked)}


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, k: int | None = None) -> DataFrame:
    """(id, score) of the documents with a positive score; a term repeated in the query counts again.

    Texts are cut once; only lengths and counts of the asked terms are kept, the
    statistics are one small aggregate over them, and nothing is shuffled.
    """
    times = _query_terms(docs, query)
    counts = _counts(docs, list(times), id_col, text_col)
    stats = counts.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(times))])
    one = {c: stats.select(c).scalar() for c in stats.columns}
    score = F.lit(0.0)
    for i, n in enumerate(times.values()):
        tf = F.col(f"tf{i}")
        score = score + n * idf(one["N"], one[f"df{i}"]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / one["avgdl"]))
    scored = counts.select(id_col, score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), id_col).limit(k) if k else scored


def term_buckets(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, score): each query term goes to the document with its highest share; score sums idf.

    Terms without a document come with a null id.
    """
    asked = list(_query_terms(docs, query))
    counts = _counts(docs, asked, id_col, text_col)
    best = lambda i: F.min_by(id_col, F.when(F.col(f"tf{i}") > 0, F.struct(-F.col(f"tf{i}") / F.col("len"), F.col(id_col))))
    row = counts.agg(F.count("*").alias("N"), *[best(i).alias(f"id{i}") for i in range(len(asked))], *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"id{i}").alias(id_col), F.col(f"df{i}").alias("df")) for i, t in enumerate(asked)]))
    found = row.select("N", each.alias("x")).select("N", "x.*").withColumn("idf", F.when(F.col("df") > 0, idf(F.col("N"), F.col("df"))).otherwise(0.0))
    return found.groupBy(id_col).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.sum("idf").alias("score"))


def alert_text(alerts: DataFrame, parts: list[str], log: str | None = None) -> DataFrame:
    """Text of an alert for ranking: the parts and the first 500 characters of the log."""
    cols = [F.col(p).cast("string") for p in parts] + ([F.substring(log, 1, 500)] if log else [])
    return alerts.withColumn("alert_text", F.concat_ws(" ", *cols))
