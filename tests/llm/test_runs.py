"""Periodic runs against brute-force versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilore.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every period by itself: maximal stretches in which words q apart are equal, without smaller period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def brute(doc_id, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    lost = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in lost)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 50), st.lists(st.integers(0, 2), max_size=30))
def test_runs_of_random_words(head, piece, more, tail):
    w = head + (piece * 60)[:more] + tail
    if w:
        assert runs.lyndon_lengths(np.array([-1, *w]))[1:].tolist() == brute_lyndon(w)
    assert runs.runs_of(np.array(w, np.int32)) == brute_runs(w)


def test_separators_end_lyndon_words():
    parts = [[1, 2, 1, 2], [2, 2], [1], [0, 5, 0, 5, 1]]
    joined = np.array([x for k, p in enumerate(parts) for x in [-1 - k, *p]])
    assert [x for x in runs.lyndon_lengths(joined).tolist() if x] == [x for p in parts for x in brute_lyndon(p)]


def documents():
    r = random.Random(5)
    word = lambda a: f"w{r.randrange(a)}"
    rows = [(1, None), (2, ""), (3, " \x0b\t\n"), (4, "a " * 6), (5, "a " * 5), (None, "b\x0cc " * 9), (None, None), (6, "x y x y x y x y tail tail tail tail tail tail"), (6, "x y x y x y x y tail tail tail tail tail tail"), (7, "é 𝒳\x1cz " * 8 + "é")]
    for i in range(10, 160):
        a, n = r.choice([2, 3, 40, 2000]), r.choice([3, 30, 300])
        rows.append((i, "\n".join(word(a) for _ in range(n))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, start int, runs string").repartition(4)


def test_digests_equal_brute_force(spark):
    rows = documents()
    got = runs.run_digests(runs.find_runs(frame(spark, rows), runs.tiled)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(i, t)) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    plain = runs.run_digests(runs.find_runs(frame(spark, rows))).collect()
    assert sorted(map(repr, map(tuple, plain))) == sorted(repr(brute(i, t, False)) for i, t in rows)
    assert runs.find_runs(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("period", [1, 7, 60_000])
def test_very_long_text(spark, period):
    """Read in slices; one run over all of it."""
    words = [f"word{i}" for i in range(period)]
    text = " ".join(words[i % period] for i in range(250_000))
    assert len(text) > runs.SLICE
    r = runs.find_runs(frame(spark, [(1, text)])).first()
    assert [tuple(x) for x in r.runs] == [(0, 250_000, period)] and r.text == " ".join(words)
