"""A postings index: texts are cut once, tables of queries are ranked from the index alone.

Documents are dealt into slots of about ``BLOCK_DOCS``; those of a slot that have similar length are a
block.  For each term and block there is a list (id, tf, len) and a head with what the list can
score at most: its largest tf and least length.  A query first scores the most promising blocks; the
k-th best score found there rules out every block whose heads cannot reach it, and the rest is scored exactly.

One task turns the texts of a slot into its lists, so only texts move.  The lists of a slot are
sorted by term, so those of a few terms are a few pages; heads are columns beside them.  A list holds
at most the documents of its block, so a term that every document has is spread over all blocks.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize, shared_dir
from .ranking import K1, B, idf, tokens

BLOCK_DOCS = 4096
#: Bytes of text in a slot, on average: of longer documents it holds fewer.
SLOT_BYTES = 32 << 20
#: Queries that are scored together in one task.
QUERIES = 1000
#: Asked terms up to which the lists are filtered before they are joined.
FEW_TERMS = 1000
#: The term that lists every document.
EVERY = ""


class Index(NamedTuple):
    """``lists``: (term, block, list of (id, tf, len)); ``heads``: (term, block, n, words, top_tf, least_len, same, best)."""

    lists: DataFrame
    heads: DataFrame


def build(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, block_docs: int = BLOCK_DOCS) -> Index:
    """Writes the index to ``path`` (by default into the shared folder).

    Documents without a term are left out; rows with the same id and number of words are one document.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("bytes")).first()
    slots = max(1, -(-size["n"] // block_docs), -(-size["bytes"] // SLOT_BYTES))
    words = docs.select(F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(slots)).alias("slot"), F.array_join(tokens(F.col(text_col)), " ").alias("words"))
    kind = words.schema["id"].dataType.simpleString()
    columns = f"term string, block long, n long, words long, top_tf int, least_len int, same int, best struct<share:double,id:{kind}>, list array<struct<id:{kind},tf:int,len:int>>"
    words.groupBy("slot").applyInArrow(_slot_lists(slots), columns).write.mode("overwrite").parquet(f"{path}/lists")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/lists")
    return Index(rows.select("term", "block", "list"), rows.drop("list"))


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Every value as its place among the distinct ones, and these in their order."""
    coded = values.dictionary_encode("encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def _array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _slot_lists(slots: int):
    """The lists of one slot with their heads, by term and block.

    A block is a slot and a power of two up to the length; texts of one id share the block of the shortest.
    """

    def run(group: pa.Table) -> pa.Table:
        slot = group["slot"][0].as_py()
        group = group.filter(pc.not_equal(group["words"], ""))
        cut = pc.split_pattern(_array(group["words"]), " ")
        size = pc.list_value_length(cut).to_numpy().astype(np.int64)
        who, ids = _codes(_array(group["id"]))
        what, terms = _codes(cut.flatten())
        terms = pa.concat_arrays([pa.array([EVERY], terms.type), terms])
        # Documents by class, id and length.
        shortest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(shortest, who, size)
        level = np.floor(np.log2(shortest)).astype(np.int64)
        triples, doc = np.unique(np.stack([level[who], who, size]), axis=1, return_inverse=True)
        level, own, length = triples
        doc, m = doc.reshape(-1), max(1, len(own))
        posting, tf = np.unique(np.concatenate([doc, (what + 1) * m + np.repeat(doc, size)]), return_counts=True)
        term, at = np.divmod(posting, m)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(term) != 0) | (np.diff(level[at]) != 0)
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(at)))
        reduced = lambda by, x: by.reduceat(x, start) if len(start) else x
        share = -tf / length[at]
        # Rows of a list are ordered by id: the first with the least share is the best.
        least = np.flatnonzero(share == np.repeat(reduced(np.minimum, share), n))
        best = least[np.searchsorted(least, start)]
        again = np.zeros(len(at), np.int64)
        again[1:] = ~new[1:] & (np.diff(own[at]) == 0)
        same = 1 + reduced(np.add, again)  # as many rows of one id as that, at most
        id_of = ids.take(pa.array(own[at]))
        rows = pa.StructArray.from_arrays([id_of, pa.array(tf, pa.int32()), pa.array(length[at], pa.int32())], ["id", "tf", "len"])
        return pa.table({
            "term": terms.take(pa.array(term[start])), "block": level[at][start] * slots + slot, "n": n, "words": reduced(np.add, length[at]),
            "top_tf": pa.array(reduced(np.maximum, tf), pa.int32()), "least_len": pa.array(reduced(np.minimum, length[at]), pa.int32()), "same": pa.array(same, pa.int32()),
            "best": pa.StructArray.from_arrays([pa.array(share[best]), id_of.take(pa.array(best))], ["share", "id"]),
            "list": pa.ListArray.from_arrays(pa.array(np.append(start, len(at)), pa.int32()), rows),
        })

    return run


def _asked(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """(query, term, times)."""
    each = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(text_col))).alias("term"))
    return each.groupBy("query", "term").agg(F.count("*").alias("times"))


def _impact(tf, length, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _weighted(index: Index, asked: DataFrame) -> tuple[DataFrame, Column]:
    """(query, term, weight) of the terms that the index has, and the mean length of documents."""
    every = index.heads.where(F.col("term") == EVERY).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    n, mean = every.select("n").scalar(), every.select(F.col("words") / F.col("n")).scalar()
    terms = index.heads.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    return asked.join(terms, "term").select("query", "term", (F.col("times") * idf(n, F.col("df"))).alias("weight")), mean


def bounds(index: Index, weighted: DataFrame, mean: Column, k: int) -> DataFrame:
    """(query, block, bound, first): what a block can score at most; ``first`` blocks hold k documents at least, by descending bound."""
    most = index.heads.join(weighted, "term").groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("same") * _impact(F.col("top_tf"), F.col("least_len"), mean)).alias("bound"), F.max("n").alias("n"))
    before = Window.partitionBy("query").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    return most.select("query", "block", "bound", (F.coalesce(F.sum("n").over(before), F.lit(0)) < k).alias("first"))


def _block_scores(k: int | None):
    """All asked lists of a block: the documents that can be among the ``k`` best of its queries, with their scores.

    Terms are added in their order, so that equal documents score equally.
    """

    def run(key, rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return pa.table({"query": pa.array([], wanted["query"].type), "id": pa.array([], rows.schema.field("list").type.value_type.field("id").type), "score": pa.array([], pa.float64())})
        rows = rows.sort_by("term")
        lists, asked = _array(rows["list"]), _array(rows["asked"])
        ends = lambda x: np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy())])
        of_list, of_asked = ends(lists), ends(asked)
        lists, asked = lists.flatten(), asked.flatten()
        column, ids = _codes(lists.field("id"))
        queries = _array(wanted["query"])
        line = pc.fill_null(pc.index_in(asked.field("query"), queries), -1).to_numpy()
        weight = asked.field("weight").to_numpy()
        impact = _impact(lists.field("tf").to_numpy(), lists.field("len").to_numpy(), rows["mean"][0].as_py())
        score = np.zeros((len(queries), len(ids)))
        repeated = bool((np.diff(column) == 0).any())  # several texts of one id, perhaps
        for a, b, c, d in zip(of_asked, of_asked[1:], of_list, of_list[1:], strict=False):
            here = line[a:b]
            w = weight[a:b][here >= 0]
            if len(w):
                place = np.ix_(here[here >= 0], column[c:d])
                if repeated:
                    np.add.at(score, place, w[:, None] * impact[c:d])
                else:
                    score[place] += w[:, None] * impact[c:d]
        enough = pc.fill_null(_array(wanted["least"]), 0.0).to_numpy() - 1e-6
        if k is not None and k < len(ids):
            # A little below, for ties by id.
            enough = np.maximum(enough, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-6)
        q, i = np.nonzero((score > 0) & (score >= enough[:, None]))
        return pa.table({"query": queries.take(pa.array(q)), "id": ids.take(pa.array(i)), "score": score[q, i]})

    return run


def _scores(index: Index, weighted: DataFrame, mean: Column, chosen: DataFrame, k: int | None) -> DataFrame:
    """(query, id, score) of the documents of the chosen (query, block, least) that can be among the ``k`` best, or of all; not below ``least``."""
    few = [r.term for r in weighted.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    lists = index.lists.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else index.lists
    parts = -(-max(1, weighted.select("query").distinct().count()) // QUERIES)
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part")
    asked = materialize(weighted.groupBy("term", part).agg(F.collect_list(F.struct("query", "weight")).alias("asked"), F.first(mean).alias("mean")), "query-lists")
    met = lists.join(chosen.select("block").distinct(), "block", "left_semi").join(asked, "term")
    wanted = chosen.select("query", "block", "least", part).groupBy("block", "part")
    kinds = f"query {weighted.schema['query'].dataType.simpleString()}, id {index.lists.schema['list'].dataType.elementType['id'].dataType.simpleString()}, score double"
    return met.select("block", "part", "term", "list", "asked", "mean").groupBy("block", "part").cogroup(wanted).applyInArrow(_block_scores(k), kinds)


def search(index: Index, queries: DataFrame, query_id: str, text_col: str, k: int | None = None) -> DataFrame:
    """(query, rank, id, score): the ``k`` best documents of every query, or all with a positive score.

    A term repeated in a query counts again.  Scores that agree to nine places go to the smaller id.
    """
    weighted, mean = _weighted(index, _asked(queries, query_id, text_col))
    weighted = materialize(weighted, "query-terms")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    blocks = materialize(bounds(index, weighted, mean, k or 1), "query-blocks")
    if k is None:
        return ranked(_scores(index, weighted, mean, blocks.withColumn("least", F.lit(0.0)), None)).select("query", "rank", "id", "score")
    seeds = materialize(_scores(index, weighted, mean, blocks.where("first").withColumn("least", F.lit(0.0)), k), "seed-scores")
    least = ranked(seeds).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    # A little below the k-th score, for sums in another order and for ties by id.
    rest = materialize(blocks.where("not first").join(least, "query", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-6), "query-rest")
    scored = seeds.unionByName(_scores(index, weighted, mean, rest, k))
    return ranked(scored).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def term_buckets(index: Index, queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """(query, id, terms, score): each term goes to the document with its highest share; the score sums idf.

    Terms without a document come with a null id.  Only the heads are read.
    """
    asked = _asked(queries, query_id, text_col).select("query", "term")
    n = index.heads.where(F.col("term") == EVERY).agg(F.sum("n").alias("n")).scalar()
    own = index.heads.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.min("best").alias("best"))
    found = asked.join(own, "term", "left").withColumn("idf", F.when(F.col("df") > 0, idf(n, F.col("df"))).otherwise(0.0))
    return found.groupBy("query", F.col("best.id").alias("id")).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.sum("idf").alias("score"))
