"""Registered queries over the postings index: a table of queries against all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import r4
from ..operators import text_index
from .security import _W, query, table

_INDEX = f"""WITH x AS (SELECT doc_id, w, len(w) AS l FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(l) AS a FROM x),
t AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, l, unnest(w) AS term FROM x) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_W}) AS term FROM (SELECT item_id, text || ' no-such-term-' || item_id AS text FROM benchmark)) GROUP BY 1, 2)"""


@query("indexed_search", _INDEX + """, s AS (SELECT item_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score FROM q JOIN t USING (term) JOIN f USING (term), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT item_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10""")
def indexed_search(spark, sf_dir):
    """The ten best documents for every benchmark passage, each with one term that no document has."""
    index = text_index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = text_index.search(index, _passages(spark, sf_dir), "item_id", "text", 10)
    return found.select(F.col("query").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), r4("score").alias("score"))


@query("indexed_terms", _INDEX + """, best AS (SELECT term, arg_min(doc_id, (-tf / l, doc_id)) AS doc_id FROM t GROUP BY 1)
SELECT item_id, doc_id, string_agg(q.term, ' ' ORDER BY q.term) AS terms, round(sum(CASE WHEN df IS NULL THEN 0.0 ELSE ln((n - df + 0.5) / (df + 0.5) + 1) END), 4) AS score FROM q LEFT JOIN best ON q.term = best.term LEFT JOIN f ON q.term = f.term, st GROUP BY 1, 2""")
def indexed_terms(spark, sf_dir):
    """Every term of every passage goes to the document with its highest share; terms without one are listed too."""
    index = text_index.build(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = text_index.term_buckets(index, _passages(spark, sf_dir), "item_id", "text")
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.array_join("terms", " ").alias("terms"), r4("score").alias("score"))


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("no-such-term-"), F.col("item_id").cast("string"))))
