"""The postings index against brute force, and what its searches read."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from vigilore.functions.storage import shared_dir
from vigilore.operators import ranking, text_index


def documents(n, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["the", "of", "it", *[f"t{min(int(r.expovariate(0.05)), 200)}"] * 4]) for _ in range(r.choice([1, 5, 30, 120])))) for i in range(n)]
    return rows + [(n, None), (n + 1, "a , !"), (n + 2, "rare-one the the"), (n + 3, "rare-one the the"), (n + 4, "The rare-one; THE")]


def brute(rows, query, k):
    words = {i: [w for w in (t or "").lower().replace(",", " ").replace("!", " ").replace(";", " ").split() if len(w) > 1] for i, t in rows}
    words = {i: w for i, w in words.items() if w}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = collections.Counter(t for w in words.values() for t in set(w))
    out = {}
    for i, w in words.items():
        tf = collections.Counter(w)
        s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in query.split() if tf[t])
        if s > 0:
            out[i] = s
    return sorted(((i, round(s, 9)) for i, s in out.items()), key=lambda x: (-x[1], x[0]))[:k]


QUERIES = [(1, "the rare-one"), (2, "t3 t3 t100 of"), (3, "nothing"), (4, "the"), (5, "t1 t2 t3 t4 t5 it"), (6, None)]


@pytest.fixture(scope="module")
def built(spark):
    rows = documents(700, 3)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, len int, list string").repartition(3)
    path = f"{shared_dir(spark)}/index-test-{random.random()}"
    return rows, text_index.build(docs, "doc_id", "text", path, block_docs=40), path, spark.createDataFrame(QUERIES, "q int, text string")


@pytest.mark.parametrize("k", [1, 7, 10_000, None])
def test_search(spark, built, k):
    rows, index, _, queries = built
    got = collections.defaultdict(list)
    for r in text_index.search(index, queries, "q", "text", k).orderBy("query", "rank").collect():
        got[r.query].append((r["id"], round(r.score, 9)))
    assert dict(got) == {q: w for q, t in QUERIES if t and (w := brute(rows, t, k))}


def test_few_blocks_are_scored(spark, built):
    """A rare term leaves out the blocks that have only the common one; the index alone is read."""
    rows, index, path, queries = built
    weighted, mean = text_index._weighted(index, text_index._asked(queries.where("q = 1"), "q", "text"))
    blocks = text_index.bounds(index, weighted, mean, 3).collect()
    least = brute(rows, "the rare-one", 3)[-1][1]
    assert sum(b.first or b.bound >= least - 1e-6 for b in blocks) <= len(blocks) / 10 and len(blocks) > 40
    true = {i: s for i, s in brute(rows, "the rare-one", None)}
    of = {x["id"]: r.block for r in index.lists.where("term = ''").collect() for x in r.list}
    top = {b.block: b.bound for b in blocks}
    assert all(s <= top[of[i]] + 1e-9 for i, s in true.items())
    files = text_index.search(text_index.read(spark, path), queries, "q", "text").inputFiles()
    assert files and all("/index-test-" in f or "/query-" in f for f in files)
    assert max(len(r.list) for r in index.lists.collect()) < 100


def test_terms_to_documents(spark, built):
    rows, index, _, queries = built
    got = {(r.query, r["id"]): (r.terms, round(r.score, 9)) for r in text_index.term_buckets(index, queries, "q", "text").collect()}
    asked = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    for q, text in QUERIES[:5]:
        want = {(q, r.doc_id): (r.terms, round(r.score, 9)) for r in ranking.term_buckets(asked, text, "doc_id", "text").collect()}
        assert {k: v for k, v in got.items() if k[0] == q} == want
    assert got[3, None] == (["nothing"], 0.0)


def test_no_documents(spark, built):
    _, _, _, queries = built
    empty = text_index.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert text_index.search(empty, queries, "q", "text", 3).count() == 0
    assert text_index.term_buckets(empty, queries, "q", "text").where(F.col("id").isNotNull()).count() == 0


def shuffled_rows(spark, run):
    """What ``run`` returns, and the rows that its stages write for others."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def total():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    out = run()
    return out, sum(n for stage, n in total().items() if stage not in before)


def test_texts_move_instead_of_postings(spark):
    """a document is one row on its way into the index; blocks hold enough documents for lists of several."""
    rows = documents(3000, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index, moved = shuffled_rows(spark, lambda: text_index.build(docs, "doc_id", "text"))
    postings = index.heads.agg(F.sum("n")).first()[0]
    assert moved < postings / 4  # dealt out here, counted, dealt into slots
    assert index.heads.count() < postings / 10


def test_terms_are_cut_as_before(spark):
    """one expression finds the terms that two replacements, a split and a filter found."""
    r = random.Random(5)
    texts = ["".join(r.choice("ab1._- \t\n\x0b,;\u00e4\u0130\u212aA") for _ in range(r.randrange(40))) for _ in range(3000)] + [None, "", "._-", "a" * 5000 + "." * 5000]
    clean = F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"[^a-z0-9\s._-]", " ")
    before = F.filter(F.split(F.regexp_replace(clean, r"(?<!\S)[._-]++|[._-]++(?!\S)", ""), r"\s+"), lambda w: F.length(w) >= 2)
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(before.alias("a"), ranking.tokens(F.col("t")).alias("b"))
    assert found.where("not a <=> b").count() == 0


def test_lists_are_scored_where_their_block_is(spark):
    """lists move, and the best documents of every block, instead of one row for every query, term and document."""
    rows = documents(3000, 8)
    index = text_index.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    queries = spark.createDataFrame([(i, f"the of it t{i % 7} t{i % 5}") for i in range(60)], "q int, text string")
    got, moved = shuffled_rows(spark, lambda: text_index.search(index, queries, "q", "text", 5).collect())
    for q in (0, 33):
        want = brute(rows, f"the of it t{q % 7} t{q % 5}", 5)
        assert [(r["id"], round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == want
    assert len(got) == 300 and moved < 60 * len(rows) / 4


def test_texts_of_one_id(spark):
    """several texts of one id are one result, whatever their lengths; many queries are scored in parts."""
    rows = [(1, "aa bb"), (1, "aa " + "cc " * 40), (2, "aa bb dd"), (3, "dd dd")]
    index = text_index.build(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    queries = spark.createDataFrame([(i, "aa" if i % 2 else "dd") for i in range(2 * text_index.QUERIES + 1)], "q long, text string")
    for k in (1, 3, None):
        found = text_index.search(index, queries, "q", "text", k).groupBy((F.col("query") % 2).alias("odd"), "rank").agg(F.count("*").alias("n"), F.collect_set("id").alias("ids")).collect()
        got = {(r.odd, r["rank"]): (r.n, r.ids) for r in found}
        half = text_index.QUERIES
        want = {(1, 1): (half, [1]), (1, 2): (half, [2]), (0, 1): (half + 1, [3]), (0, 2): (half + 1, [2])}
        assert got == {key: v for key, v in want.items() if k != 1 or key[1] == 1}
