"""Removal of repeated passages: sampled prefixes split the suffixes, window hashes find the repeats.

The dealt method is a prefix-partitioned suffix tree over words.  It is not what runs
here: a subtree that finds repeats of 20 words must hold 20 words of every suffix
whose prefix repeats, and those are a third of all (27 million of the 0.5 GB of the
check tool, 2.7 GB even at five bytes a word, against a limit of four times the
input for everything).  Two levels of the tree are kept as groupings by hash:

1. Depth 8: only a sampled suffix of every window is looked at (the leftmost
   smallest 8-word hash of the 13 in the window, so two equal windows always sample
   the same one).  A prefix with a single suffix is a leaf and goes no further.
2. Depth 20: under the prefixes that occur twice or more, windows of 20 words are
   grouped by 95 bits of hash; every member of a group but the first (smallest
   document, then start) is a repeat.  Overlapping repeats join into maximal ones.

The texts are shuffled once by document; both joins with them use that exchange.
Both levels reduce inside the task before anything is shuffled: suffixes that meet
in one task are settled there and only one of them travels, so the rows that share
a passage number at most one per task however common it is, and no group has to be
held in memory.

Defined cases: null text has no words and an empty result text; a null document id
takes no part in the search and keeps all its words; rows that repeat an id count
as one document (equal starts are not earlier than each other); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import grams, mix, word_hashes

WINDOW = 20
PREFIX = 8
#: Suffixes that a task holds before it settles them; bounds its memory.
HELD = 1_500_000


def _texts(batch: pa.RecordBatch, at: int = 1) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column(at).cast(pa.binary()).to_pylist()]


def _sampled(words: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, prefix hashes, for each window the start of its sampled prefix)."""
    h = word_hashes(words)
    g = grams(h, prefix)
    views = np.lib.stride_tricks.sliding_window_view(g, window - prefix + 1)
    return h, g, views.argmin(1) + np.arange(len(views))


def _settle(columns: list[np.ndarray], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, document, start; flags of the first row of each key and of keys with several rows."""
    order = np.lexsort((starts, docs, *columns[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(order) else new
    return order, new, several


def _by_document(docs: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Starts of every document; ``docs`` and ``starts`` are ordered alike."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    at = np.flatnonzero(np.diff(docs)) + 1
    return (docs[np.concatenate([[0], at])].tolist(), np.split(starts, at)) if len(docs) else ([], [])


#: Bits of a hash that are left off when rows travel.  A prefix only has to tell most prefixes apart (equal ones
#: are looked at again at window length); the two parts of a window's key keep 95 bits together.
_PREFIX_KEY = ((16, np.int64),)
_WINDOW_KEY = ((0, np.int64), (33, np.int32))


def _rows(columns: list[np.ndarray], kinds, doc: np.ndarray, start: np.ndarray, flag: np.ndarray, settled: tuple[list[int], list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """Rows that travel, then one row per document for what the task has settled (its key is spread by document)."""
    own, lists = settled
    spread = np.array(own, np.int64)
    keys = [np.concatenate([c, mix((spread + i).view(np.uint64))]) >> np.uint64(shift) for i, (c, (shift, _)) in enumerate(zip(columns, kinds, strict=True))]
    keys = [pa.array(k.view(np.int64).astype(kind)) for k, (_, kind) in zip(keys, kinds, strict=True)]
    starts = pa.array([None] * len(doc) + [x.astype(np.int32) for x in lists], pa.list_(pa.int32()))
    start = pa.array(np.concatenate([start, np.zeros(len(own), np.int64)]).astype(np.int32), mask=np.arange(len(doc) + len(own)) >= len(doc))
    flags = pa.array(np.concatenate([flag, np.ones(len(own), bool)]))
    return pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate([doc, spread])), start, flags, starts], names=names)


def _prefixes(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            if not held:
                return
            key, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, new, several = _settle([key], doc, start)
            key, doc, start = key[order], doc[order], start[order]
            # One row of each key travels; the others of this task are known to repeat.
            yield _rows([key[new]], _PREFIX_KEY, doc[new], start[new], several[new], _by_document(doc[~new], start[~new]), ["key", "doc_id", "start", "known", "starts"])

        n = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                words = text.split()
                if doc is None or len(words) < window:
                    continue
                _, g, at = _sampled(words, window, prefix)
                at = np.unique(at)
                held.append((g[at], np.full(len(at), doc, np.int64), at))
                n += len(at)
                if n >= HELD:
                    yield from flush()
                    n = 0
        yield from flush()

    return run


def _deep(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            if not held:
                return
            a, b, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, new, _ = _settle([a, b], doc, start)
            first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            d, s = doc[order], start[order]
            later = (d != d[first]) | (s != s[first])  # an earlier equal window was met in this task
            go = ~later
            yield _rows([a[order][go], b[order][go]], _WINDOW_KEY, d[go], s[go], np.zeros(int(go.sum()), bool), _by_document(d[later], s[later]), ["a", "b", "doc_id", "start", "known", "starts"])

        n = 0
        for batch in batches:
            for doc, text, wanted in zip(batch["_id"].to_pylist(), batch["_text"], batch["starts"], strict=True):
                if not wanted.is_valid:
                    continue
                words = text.as_py().encode().split()
                h, _, at = _sampled(words, window, prefix)
                i = np.flatnonzero(np.isin(at, wanted.values.to_numpy()))
                held.append((grams(h, window, 1)[i], grams(h, window, 2)[i], np.full(len(i), doc, np.int64), i))
                n += len(i)
                if n >= HELD:
                    yield from flush()
                    n = 0
        yield from flush()

    return run


def _starts_of(rows: DataFrame) -> DataFrame:
    """Single starts and lists of starts (one of the two is null in a row), gathered per document."""
    got = rows.groupBy("doc_id").agg(F.collect_list("start").alias("_one"), F.flatten(F.collect_list("starts")).alias("_more"))
    return got.select("doc_id", F.concat("_one", "_more").alias("starts"))


def _repeats(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """(doc_id, starts) of the windows that also start earlier; ``rows`` has ``_id``, ``_text`` and others."""
    pre = rows.select("_id", "_text").mapInArrow(_prefixes(window, prefix), "key long, doc_id long, start int, known boolean, starts array<int>")
    # Rows of one key are at most one for each task.
    met = pre.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1 or known")
    wanted = _starts_of(met).withColumnRenamed("doc_id", "_w")
    # An outer join, so that its exchange of texts is the one that ``substring_dedup`` uses again.
    found = rows.join(wanted, F.col("_id") == F.col("_w"), "left").select(*rows.columns, "starts")
    deep = found.mapInArrow(_deep(window, prefix), "a long, b int, doc_id long, start int, known boolean, starts array<int>")
    by = Window.partitionBy("a", "b").orderBy("doc_id", "start")
    deep = deep.withColumn("d1", F.first("doc_id").over(by)).withColumn("s1", F.first("start").over(by))
    return _starts_of(deep.where("known or doc_id <> d1 or start <> s1"))


def _prepared(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, starts) of the windows of ``window`` words that also start earlier."""
    return _repeats(_prepared(docs, id_col, text_col, []), window, prefix)


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, starts in zip(_texts(batch, batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                if starts.is_valid:
                    at = np.unique(starts.values.to_numpy())
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                n = int(gone.sum())
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if n else b" ".join(words)
                ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
                out.append((len(words), n, hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in ends], (kept if n else text).decode() if with_text else None))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            added = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], spans), pa.array(cols[4], pa.string())]
            names = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names=[*names, "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with its word count, removed words, maximal repeats and the rest's hash.

    ``removed`` holds the maximal repeated word ranges (end exclusive).  With
    ``with_text`` the other columns of ``docs`` and ``kept_text`` are returned too
    (the text itself where nothing was removed).
    """
    others = [c for c in docs.columns if c not in (text_col, id_col)] if with_text else []
    own = _prepared(docs, id_col, text_col, others)
    found = _repeats(own, window, PREFIX)
    joined = own.join(found, F.col("_id") == F.col("doc_id"), "left").select(*[f"c{i}" for i in range(len(others))], "_id", F.col("_text").alias("text"), "starts")
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(others)] + ["_id long", "n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>, kept_text string"])
    cut = joined.mapInArrow(_cut(window, with_text), schema)
    extra = ["n_words", "n_removed", "kept_sha256", "removed"] + (["kept_text"] if with_text else [])
    return cut.select(F.col("_id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *[F.col(c) if c not in docs.columns else F.col(c).alias(f"dedup_{c}") for c in extra])
