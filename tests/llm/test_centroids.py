"""Centroid clustering against a brute-force version."""

import hashlib
import math

import numpy as np
import pytest

from vigilore.llm import centroids


def brute(rows, k, rounds, dim=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(256 * x) <= centroids.MOST for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centres)):
            members = [v for (_, v), (_, a) in zip(kept, own, strict=True) if a == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assign()
    out = []
    for (i, _), (d, j) in zip(kept, own, strict=True):
        out.append((i, j, d, sum(e for e, a in own if a == j), sum(e for e, _ in own), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    return sorted((tuple(r)[:6] for r in centroids.cluster(df, **options).collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 150])
def test_clusters_equal_brute_force(spark, n):
    """Nulls, wrong lengths, non-finite and huge components, zero vectors, equal ids, copies and clashing columns."""
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=64) * rng.choice([0.01, 0.2, 3])]) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(500, 540)] + [(3, v) for _, v in rows[:3]] if n > 3 else []
    rows += [(9000, None), (9001, [1.0] * 63), (9002, [math.nan] + [1.0] * 63), (9003, [None] + [1.0] * 63), (9004, [math.inf] + [0.0] * 63), (9005, [1e300] * 64)]
    rows += [(9006, [0.0] * 64), (None, [-0.5] * 64), (9007, [-(2.0**19)] * 64)] if n else []
    assert run(spark, rows, k=12) == brute(rows, 12, 5)


def test_one_round_moves_by_exact_floor(spark):
    rows = [(i, [x]) for i, x in enumerate([0.0, -1 / 256, -2 / 256, 1.0])]
    assert run(spark, rows, k=1, rounds=1, dim=1) == brute(rows, 1, 1, 1)
    assert brute(rows, 1, 1, 1)[0][5] == hashlib.sha256(str((0 - 1 - 2 + 256) // 4).encode()).hexdigest()


def test_tables_equal_direct_differences():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-999, 999, (40, 64)), rng.integers(-999, 999, (7, 64))
    assert (centroids.squared_distances(x, c) == ((x[:, None] - c[None]) ** 2).sum(2)).all()
