"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

The class is the outermost context of one Kneser-Ney hierarchy: a toxic and an
ordinary 5-gram model discount their own counts and back off to the shared lower
orders, which are estimated from continuation counts of both classes together, so
rare expressions cost both classes the same.  A word's log-likelihood ratio is the
sum over its characters.  A document's is the sum over its words of what each ratio
exceeds the noise margin by, normalised for length: divided by the root of the
number of words, as the noise of a sum grows.  A logistic curve through this one
number, fitted on a fold that the counts did not see, turns it into a score.

All labelled rows outside the held-out fold are counted (the counts grow with the
input); counting, smoothing and the joins between orders are Spark aggregations.
The model stays a Spark table and is never cut or gathered: documents are packed into
chunks of bounded size, each chunk names the distinct n-grams of its words, and a
shuffle join brings it the ratios of these, and of the contexts of unseen ones.

Defined cases: null text is empty; a text without words gets the score of a zero
comparison; rows that repeat an id are scored each; without both classes in the
labels every score is the share of the class present (0.5 without labels); null
labels are not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize
from .words import grams as hash_grams

ORDER = 5
DISCOUNT = 0.75
#: Bytes of text that fill a chunk.
CHUNK = 32 << 20
#: Log-likelihood ratio that a word of either class may have by chance.
MARGIN = 2.0
_START, _END = "^", "$"


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _letters(token: bytes) -> str:
    return "".join(c for c in token.decode().lower() if c.isalpha())


class _Ids(dict):
    """From token to the number of its word (letters only) in ``words``; -1 for a token without letters."""

    def __init__(self):
        self.words: dict[str, int] = {}

    def __missing__(self, token: bytes) -> int:
        word = _letters(token)
        value = self[token] = self.words.setdefault(word, len(self.words)) if word else -1
        return value


def _packed(numbers: np.ndarray) -> bytes:
    """Steps between the numbers, byte by byte, compressed."""
    steps = np.diff(numbers, prepend=0).astype(np.int64)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(steps) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    flat = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, n).T).view(np.int64).reshape(-1))


_CHUNKS = "chunk long, doc_ids array<long>, words array<string>, grams array<string>, n long, owner binary, word binary, times binary"


def _chunks(order: int, most: int):
    """Documents to chunks: the distinct words, their distinct n-grams, and how often each word is in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk() -> pa.RecordBatch:
            nonlocal number
            words = list(ids.words)
            padded = (_START * (order - 1) + w + _END for w in words)
            seen = {p[i : i + order] for p in padded for i in range(len(p) - order + 1)}
            owner, word, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True))
            row = [(TaskContext.get().partitionId() << 32) + number], [docs], [words], [list(seen)], [len(owner)], [_packed(owner)], [_packed(word)], [_packed(times)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["chunk", "doc_ids", "words", "grams", "n", "owner", "word", "times"])

        number, held, docs, parts, ids = 0, 0, [], [], _Ids()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                b = batch.slice(at, 200)
                tokens = [(x or b"").split() for x in b.column(1).cast(pa.binary()).to_pylist()]
                sizes = [len(t) for t in tokens]
                word = np.fromiter(map(ids.__getitem__, chain.from_iterable(tokens)), np.int64, sum(sizes))
                key = (np.repeat(np.arange(len(docs), len(docs) + len(tokens)), sizes) << 32) + word
                key, times = np.unique(key[word >= 0], return_counts=True)
                parts.append((key >> 32, key & 0xFFFFFFFF, times))
                docs += b.column(0).to_pylist()
                held += b.column(1).nbytes
                if held >= most:
                    yield chunk()
                    held, docs, parts, ids = 0, [], [], _Ids()
        if docs:
            yield chunk()

    return run


def _postings(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times) of the one row of ``chunk``."""
    n = chunk["n"][0].as_py()
    return tuple(_unpacked(chunk[c][0].as_py(), n) for c in ("owner", "word", "times"))


def _count_words(chunk: pa.Table, labels: pa.Table) -> pa.Table:
    words, n = np.zeros(0, object), np.zeros((2, 0), np.int64)
    if chunk.num_rows and labels.num_rows:
        owner, word, times = _postings(chunk)
        words = chunk["words"].chunk(0).values
        of = np.full(owner.max(initial=0) + 1 + max(labels["at"].to_pylist()), -1)
        of[labels["at"].to_numpy()] = labels["label"].to_numpy()
        n = np.array([np.bincount(word[of[owner] == c], times[of[owner] == c], len(words)) for c in (0, 1)]).astype(np.int64)
        seen = np.flatnonzero(n.sum(0))
        words, n = words.take(pa.array(seen)), n[:, seen]
    return pa.table({"word": pa.array(words, pa.string()), "n0": n[0], "n1": n[1]})


def kneser_ney(words: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """``words(word, n0, n1)`` to (gram, ratio) and (context, ratio)."""
    padded = F.concat(F.lit(_START * (order - 1)), F.col("word"), F.lit(_END))
    cut = words.select("n0", "n1", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(padded, i, F.lit(order)))).alias("gram"))
    top = materialize(cut.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    # Continuation counts of the lower orders: distinct left extensions.
    level = {order: top.select("gram", (F.col("n0") + F.col("n1")).cast("double").alias("n"))}
    for o in range(order - 1, 0, -1):
        level[o] = level[o + 1].groupBy(F.substring("gram", 2, o).alias("gram")).agg(F.count("*").cast("double").alias("n"))
    total = level[1].agg(F.sum("n").alias("t"))
    shared = level[1].select("gram", (F.col("n") / total.scalar()).alias("p"))
    for o in range(2, order + 1):
        context = F.substring("gram", 1, o - 1)
        sums = level[o].groupBy(context.alias("c")).agg(F.sum("n").alias("t"), F.count("*").alias("k"))
        down = shared.select(F.col("gram").alias("s"), F.col("p").alias("q"))
        shared = level[o].withColumn("c", context).withColumn("s", F.substring("gram", 2, o - 1)).join(sums, "c").join(down, "s")
        shared = shared.select("gram", (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("t") + discount * F.col("k") / F.col("t") * F.col("q")).alias("p"))
    context = F.substring("gram", 1, order - 1)
    by_class = top.groupBy(context.alias("context")).agg(*[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)])
    back = lambda c: F.when(F.col(f"t{c}") > 0, discount * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(1.0)
    own = lambda c: F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0) + back(c) * F.col("p")
    joined = top.withColumn("context", context).join(by_class, "context").join(shared, "gram")
    ratio = F.log(own(1)) - F.log(own(0))
    fallback = F.log(back(1)) - F.log(back(0))
    return joined.select("gram", ratio.alias("ratio")), by_class.select("context", fallback.alias("ratio"))


def _codes(strings: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.uint64)


def _hashed(strings: list[str], width: int) -> np.ndarray:
    codes = _codes(strings, width)
    return hash_grams(np.ascontiguousarray(codes).reshape(-1), width)[::width] if len(codes) else np.zeros(0, np.uint64)


def _table(grams: list[str], ratios: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the n-grams and their ratios."""
    h = _hashed(grams, width)
    order = np.argsort(h)
    return h[order], ratios[order]


def _look_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.float32), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return values[at], keys[at] == h


def word_ratios(words: list[str], model, order: int = ORDER) -> np.ndarray:
    """Log-likelihood ratio of each word (letters only)."""
    keys, values = model
    text = "".join(_START * (order - 1) + w + _END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 1 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    firsts = np.concatenate([[0], np.cumsum(sizes + order - 1)[:-1]])
    at = np.repeat(firsts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(owner))
    ratio, seen = _look_up(keys, values, hash_grams(codes, order)[at])
    return np.bincount(owner, np.where(seen, ratio, 0.0), len(words))


def _features(chunk: pa.Table, ratios: pa.Table) -> pa.Table:
    """Length-normalised comparison of the texts of one chunk from the ratios of its n-grams."""
    owner, word, times = _postings(chunk)
    docs, words = chunk["doc_ids"].chunk(0).values, chunk["words"][0].as_py()
    model = _table(ratios["gram"].to_pylist(), ratios["ratio"].to_numpy().astype(np.float32), ORDER)
    of = np.concatenate([np.zeros(0), *[word_ratios(words[i : i + 50_000], model) for i in range(0, len(words), 50_000)]])[word]
    n = np.bincount(owner, times, len(docs))
    normalised = np.bincount(owner, times * np.maximum(of - MARGIN, 0), len(docs)) / np.sqrt(np.maximum(n, 1))
    return pa.table([docs, pa.array(n.astype(np.float64)), pa.array(normalised)], names=["doc_id", "n_words", "comparison"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_fold: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, comparison) of every row of ``docs``.

    ``labels`` has ``id_col`` and ``label_col``; rows of the held-out fold are never
    read.  Fold 4 of the rest fits the curve, the others the counts; a class with all its rows
    on one side of this serves both with them.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold() != held_out_fold))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    curve_fold = fold() == 4
    # Two rows at most: how many labelled rows of each class are in the fold of the curve.
    sides = {r["label"]: (r["inside"], r["n"]) for r in known.groupBy("label").agg(F.count_if(curve_fold).alias("inside"), F.count("*").alias("n")).collect()}
    shared = F.col("label").isin([c for c, (inside, n) in sides.items() if inside in (0, n)])
    chunks = materialize(slim.mapInArrow(_chunks(ORDER, chunk_bytes), _CHUNKS), "chunks")
    postings = ["chunk", "n", "owner", "word", "times"]
    # Labels grow with the documents, so their join is a shuffle of both (ids only) at every size.
    places = chunks.select("chunk", F.posexplode("doc_ids").alias("at", "doc_id")).join(known.where(~curve_fold | shared).hint("merge"), "doc_id").select(F.col("chunk").alias("home"), "at", "label")
    counted = chunks.select(*postings, "words").groupBy("chunk").cogroup(places.groupBy("home")).applyInArrow(_count_words, "word string, n0 long, n1 long")
    words = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    grams, contexts = kneser_ney(words)
    needed = chunks.select("chunk", F.explode("grams").alias("gram"))
    # An n-gram that no class has seen falls back to its context.
    lower = contexts.select("context", F.col("ratio").alias("lower"))
    every = needed.select("gram").distinct().join(grams, "gram", "left").withColumn("context", F.substring("gram", 1, ORDER - 1)).join(lower, "context", "left")
    every = materialize(every.select("gram", F.coalesce("ratio", "lower", F.lit(0.0)).cast("float").alias("ratio")).where("ratio <> 0"), "ratios")
    ratios = needed.join(every.hint("merge"), "gram").select(F.col("chunk").alias("home"), "gram", "ratio")
    told = chunks.select(*postings, "words", "doc_ids").groupBy("chunk").cogroup(ratios.groupBy("home")).applyInArrow(_features, "doc_id long, n_words double, comparison double")
    told = materialize(told, "toxicity")
    fit = told.join(known.where(curve_fold | shared), "doc_id").where(F.col("label").isNotNull())
    classes = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}  # two rows at most
    if len(classes) < 2:
        score: Column = F.lit(0.5 if not classes else float(next(iter(classes))))
    else:
        curve = LogisticRegression(featuresCol="v", labelCol="label", regParam=1e-4, maxIter=50).fit(VectorAssembler(inputCols=["comparison"], outputCol="v").transform(fit))
        score = 1 / (1 + F.exp(-(float(curve.intercept) + F.col("comparison") * float(curve.coefficients[0]))))
    told = told.withColumn("score", score.cast("double"))
    return told.select("doc_id", (fold() == held_out_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "comparison")
