"""Source mixing against a brute-force version that lays out every word."""

import collections
import random
import re

import numpy as np
import pytest

from vigilore.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, share=1.5, most=2):
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 2.0 * most * (sum(sizes) + 1)
    for _ in range(300):  # the level at which capped shares add up
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, most * s) for w, s in zip(weight, sizes, strict=True)) < share * sum(sizes) else (lo, mid)
    return [min(hi * w, most * s) for w, s in zip(weight, sizes, strict=True)]


def streams(rows):
    """Source -> words with the row that each belongs to, in the order of the streams."""
    out = collections.defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, len(WORD.findall(rows[i][1] or ""))))
    for i in order:
        out[rows[i][2]] += [(i, w) for w in WORD.findall(rows[i][1] or "")]
    return out


def brute(rows, block, seed=mixing.SEED):
    """(blocks drawn by source with their words, taken by row, targets by source)."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    words = streams(rows)
    aims = dict(zip(names, brute_targets([len(words[s]) for s in names]), strict=True))
    took, drawn = collections.Counter(), collections.Counter()
    for s in names:
        left = round(round(aims[s], 6))
        n = -(-len(words[s]) // block)
        turn = 0
        while left > 0:
            p = mixing.Permutation.of(n, seed, s, turn).apply(np.arange(n)).tolist()
            assert sorted(p) == list(range(n))
            for b in p:
                part = words[s][b * block : (b + 1) * block][:left]
                left -= len(part)
                if part:
                    took.update(i for i, _ in part)
                    drawn[(s, b, " ".join(w for _, w in part))] += 1
            turn += 1
    return drawn, took, aims, {s: len(words[s]) for s in names}


def rows_of(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = r.choice(["", None, "\x0b \n"]) if i % 17 == 0 else " ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice([1, 3, 40, 200])))
        out.append((i, text, r.choice(["a", "a", "a", "b", "é", "𝒳", "～", "", None, f"s{i % 7}"])))
    return out + [(7, "x " * 5000, "a"), (None, "no id", "b"), (50, "repeated row", "z"), (50, "repeated row", "z"), (51, "", "empty source")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, source string, block int, size string").repartition(5)


@pytest.mark.parametrize(("n", "block"), [(0, 16), (60, 7), (300, 64)])
def test_takes_equal_brute_force(spark, n, block):
    rows = rows_of(n, n)
    got = sorted((tuple(r) for r in mixing.taken(frame(spark, rows), block=block, shard=8).collect()), key=repr)
    _, took, aims, sizes = brute(rows, block)
    want = sorted(((i, len(WORD.findall(t or "")), sizes[s], aims[s], took[k]) for k, (i, t, s) in enumerate(rows)), key=repr)
    drop = lambda rs: sorted((r[0] is None, r[0] or 0, r[1], r[2], r[4]) for r in rs)
    assert drop(got) == drop(want)
    assert sorted(round(r[3], 6) for r in got) == sorted(round(r[3], 6) for r in want)
    assert all(r[4] <= 2 * r[1] for r in got) and sum(r[4] for r in got) == pytest.approx(1.5 * sum(r[1] for r in got), abs=len(sizes))


def test_texts_of_the_mix(spark):
    """Every slot holds the words of its block; slots are gapless; reruns on other partitions agree."""
    rows = rows_of(200, 4)
    drawn, *_ = brute(rows, 32)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    read = lambda df: sorted(map(tuple, mixing.texts(df, block=32, shard=16).collect()))
    got = read(frame(spark, rows))
    assert collections.Counter((names[s], b, t) for _, _, s, b, _, t in got) == drawn and all(n == len(t.split(" ")) for *_, n, t in got)
    slots = sorted((a, b) for a, b, *_ in got)
    assert slots == [(i // 16, i % 16) for i in range(len(slots))]
    assert read(frame(spark, rows[::-1]).coalesce(1)) == got


def test_empty_table(spark):
    assert mixing.taken(frame(spark, rows_of(20, 1)).limit(0)).count() == 0


def test_shard_counts():
    """The counts of all shards add up to the totals, follow on each other, and differ between shards as draws do."""
    slots = np.array([0, 5000, 1, 2500, 777])
    at, seen = np.zeros(5, np.int64), []
    for i in range(-(-int(slots.sum()) // 100)):
        first, n = mixing.shard_counts(slots, i, 100, 3)
        assert (first == at).all() and n.sum() == min(100, slots.sum() - at.sum())
        at += n
        seen.append(n[1])
    assert (at == slots).all()
    p = 5000 / slots.sum()
    assert np.mean(seen[:-1]) == pytest.approx(100 * p, abs=2) and 0.5 < np.var(seen[:-1]) / (100 * p * (1 - p)) < 2
    huge = np.array([3 * 10**9, 10**9, 0])
    assert mixing._split(huge, 10**9, None).tolist() == [750_000_000, 250_000_000, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations(n):
    p = mixing.Permutation.of(n, 1, "s", 0)
    x = p.apply(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.apply(x, back=True) == np.arange(n)).all()
    if n >= 64:
        assert (x != mixing.Permutation.of(n, 1, "s", 1).apply(np.arange(n))).any() and (x != np.arange(n)).sum() > n * 0.8


def test_no_source_over_its_limit():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert mixing.targets([1, 1000]) == [2.0, 1499.5]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
