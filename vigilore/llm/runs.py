"""Periodic runs of words in texts, by the grouping of suffixes that starts Baier's suffix sorter.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends and
that is at least ``max(LEAST, TIMES * q)`` words long.  Every run holds Lyndon words of length
``q`` under the order of words or its reverse, and from one of the two orders each of them is
the longest Lyndon word at its start.  So:

1. Words outside every stretch whose 5-grams all occur twice and whose 3-grams all occur three
   times in the text cannot belong to such a run; the stretches that remain are kept apart.
2. Phase one of the sorter groups their suffixes, highest group first, under both orders: when
   it ends, the length of a suffix's group is that of its longest Lyndon word.
3. Where three equally long ones follow each other, common extensions to both sides (compared
   in doubling steps) make the run.

All of it is linear but for the extensions, and happens inside one text; nothing is shuffled.
A text is read in slices of ``SLICE`` bytes, so a very long one needs its distinct words and a
few integers a word.

Defined cases: a null or blank text has no words and no runs; runs may overlap; a word goes if any
run holds it behind that run's first ``q`` words; repeated rows are documents of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty
from .words import grams, mix

LEAST = 6
TIMES = 4
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


class _Numbers(dict):
    """Words by number of first appearance."""

    most = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def _slices(data: bytes) -> Iterator[list[bytes]]:
    start = 0
    while start < len(data):
        space = _SPACE.search(data, start + SLICE)
        end = space.start() if space else len(data)
        yield data[start:end].split()
        start = end


def numbered(data: bytes, numbers: _Numbers) -> np.ndarray:
    parts = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in _slices(data)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _often(keys: np.ndarray, least: int) -> np.ndarray:
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at] >= least


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold a run of ``LEAST`` words or more with four periods.

    A run of L >= 4 q words has each of its 3-grams at least three times (L - 2 of them in q classes;
    four times for q = 1) and each of its 5-grams twice.
    """
    if len(codes) < LEAST:
        return []
    h = mix(codes.astype(np.uint64) + np.uint64(1))
    twice = _often(grams(h, 5), 2)
    if not twice.any():
        return []
    thrice = _often(grams(h, 3), 3)
    fine = twice & thrice[:-2] & thrice[1:-1] & thrice[2:]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], fine, [False]])))
    return [(a, b + 4) for a, b in edges.reshape(-1, 2).tolist() if b + 4 - a >= LEAST]


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every position; negative codes are separators, one of them is first.

    Groups of suffixes are taken from the highest down.  Each suffix of the group points to the nearest lower one
    on its left; what gets ``l`` pointers from a group with ``size`` letters moves to a new group right above
    its own, whose letters are its own group's followed by ``l`` times those.
    """
    n = len(codes)
    codes = np.maximum(codes, -1)
    order = np.argsort(codes, kind="stable")
    _, first, at = np.unique(codes, return_index=True, return_inverse=True)
    bounds = [*np.searchsorted(codes[order], codes[first]).tolist(), n]
    flat = order.tolist()
    members: list[list[int]] = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    group = at.tolist()
    groups = len(members)
    size, lower, upper = [1] * groups, list(range(-1, groups - 1)), list(range(1, groups + 1))
    upper[-1] = -1
    settled, left, out = bytearray(n), list(range(-1, n - 1)), [0] * n
    g = groups - 1
    while g > 0:  # group 0 holds the separators
        own, members[g] = members[g], []
        length = size[g]
        pointed: list[list[int]] = []
        last = -1
        for i in own:
            if group[i] != g:
                continue
            out[i] = length
            j = i - 1
            if settled[j]:
                k = j
                while settled[j]:
                    j = left[j]
                while k != j:
                    left[k], k = j, left[k]
                left[i] = j
            settled[i] = 1
            if j == last:
                pointed[-1][1] += 1
            else:
                pointed.append([j, 1])
                last = j
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed:
            if group[j]:
                moves.setdefault((times, group[j]), []).append(j)
        for (times, old), moved in sorted(moves.items(), key=lambda m: -m[0][0]) if len(moves) > 1 else moves.items():
            new = len(members)
            members.append(moved)
            size.append(size[old] + times * length)
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            lower[above] = new
            for j in moved:
                group[j] = new
        g = lower[g]
    return np.array(out, np.int64)


def _common(x: np.ndarray, i: int, j: int) -> int:
    """How far ``x`` from ``i`` and from ``j`` > ``i`` agree."""
    done, step = 0, 32
    while (m := min(step, len(x) - j - done)) > 0:
        differs = x[i + done : i + done + m] != x[j + done : j + done + m]
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done, step = done + m, step * 2
    return done


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    kept = stretches(codes)
    if not kept:
        return []
    parts, places = [], []
    for k, (a, b) in enumerate(kept):
        parts += [np.array([-1 - k], np.int64), codes[a:b].astype(np.int64)]
        places += [np.array([a]), np.arange(a, b)]
    x, place = np.concatenate(parts), np.concatenate(places)
    back, n, found = x[::-1].copy(), len(x), set()
    for order in (x, np.where(x < 0, x, x.max() - x)):
        q = lyndon_lengths(order)
        i = np.flatnonzero((q > 0) & (np.arange(n) + 3 * q <= n))
        p = q[i]
        i = i[(q[i + p] == p) & (q[i + 2 * p] == p) & (x[i] == x[i + p]) & (x[i] == x[i + 2 * p])]
        ends: dict[int, int] = {}
        for at, period in zip(i.tolist(), q[i].tolist(), strict=True):
            if at + period <= ends.get(period, 0):
                continue
            end = at + period + _common(x, at, at + period)
            start = at - _common(back, n - at - period, n - at)
            if end - start >= max(LEAST, TIMES * period):
                found.add((int(place[start]), end - start, period))
                ends[period] = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(codes: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The codes without the words that a run repeats."""
    if not runs:
        return codes
    depth = np.zeros(len(codes) + 1, np.int64)
    start, length, period = np.array(runs, np.int64).T
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return codes[np.cumsum(depth[:-1]) == 0]


def _joined(codes: np.ndarray, words: list[bytes]) -> str:
    parts = (b" ".join(map(words.__getitem__, codes[a : a + SLICE // 8].tolist())) for a in range(0, len(codes), SLICE // 8))
    return b" ".join(parts).decode("utf-8", "surrogatepass")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("text", pa.string())])


def _find(arrange: Callable[[int | None, int], np.ndarray | None] | None):
    def one(doc_id: int | None, text: str, numbers: _Numbers) -> dict:
        codes = numbered(text.encode("utf-8", "surrogatepass"), numbers)
        if arrange and (order := arrange(doc_id, len(codes))) is not None:
            codes = codes[order]
        runs = runs_of(codes)
        rows = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        best = min(rows, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
        return {"id": doc_id, "runs": rows, "best": best, "text": _joined(collapsed(codes, runs), numbers.words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        for batch in batches:
            ready, held = [], 0
            for i in range(batch.num_rows):
                if len(numbers) > numbers.most:
                    numbers = _Numbers()
                ready.append(one(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), numbers))
                held += len(ready[-1]["text"])
                if held > 4 * SLICE:
                    yield pa.RecordBatch.from_pylist(ready, _OUT)
                    ready, held = [], 0
            if ready:
                yield pa.RecordBatch.from_pylist(ready, _OUT)

    return run


def find_runs(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, runs, best, text): all runs of each text, the one with the greatest exponent, and the text without what they repeat.

    ``arrange(id, n)`` may give, for a text of n words, the numbers of the words to look at instead, in their order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty("text").alias("text"))
    run = "struct<start: long, length: long, period: long>"
    return rows.mapInArrow(_find(arrange), f"id long, runs array<{run}>, best {run}, text string").withColumnRenamed("id", id_col)


def tiled(doc_id: int | None, n: int) -> np.ndarray | None:
    """The arrangement of the registered query: one document in ten repeats a piece of itself to its end.

    Documents without an id stay as they are.
    """
    if doc_id is None or not n:
        return None
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + np.arange(n - a) % p
    return out


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of what ``find_runs`` found."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(id_col, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
