"""Which sets meet in the Jaccard join, and what a meeting compares."""

import numpy as np
import pyarrow as pa
import pytest

from vigilore.llm import jaccard


def signatures(s, plan):
    return {x for c in plan.classes(len(s)) for x in jaccard._signatures(s, c, plan).tolist()}


def test_unrelated_sets_do_not_meet():
    """sets with a common empty fragment met, as many of them as the input has; 300 sets without a common element."""
    plan, rng = jaccard._Plan(80, 100), np.random.default_rng(2)
    seen = set()
    for n in rng.integers(300, 440, 300):
        own = signatures(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), plan)
        assert not own & seen
        seen |= own


@pytest.mark.parametrize("num", [50, 66, 80, 90, 95, 100])
def test_linked_sets_share_a_fragment(num):
    """Pairs right at the threshold of all sizes, elements in few ranges among them: what is not in a fragment counts where it must."""
    plan, rng = jaccard._Plan(num, 100), np.random.default_rng(num)
    for k in range(1500):
        a = int(rng.integers(1, 700))
        b = int(rng.integers(a, a * 100 // num + 1))
        common = -(-(a + b) * num // (num + 100))  # the least overlap of a linked pair
        if common > a:
            continue
        top = 2**64 if k % 3 else 2 ** int(rng.integers(58, 64))
        flat = rng.permutation(np.unique(rng.integers(0, top, a + b, dtype=np.uint64)))
        x, y = np.sort(flat[:a]), np.sort(np.concatenate([flat[:common], flat[a : a + b - common]]))
        if len(x) + len(y) == a + b:
            assert signatures(x, plan) & signatures(y, plan), (a, b, common)


@pytest.mark.parametrize("blocks", [1, 2])
def test_a_meeting_of_near_copies_is_not_compared_pair_by_pair(monkeypatch, blocks):
    """rows that are joined already are not compared again; all stay joined, and unrelated ones apart."""
    plan, rng = jaccard._Plan(80, 100), np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    sets = [np.sort(np.concatenate([rng.permutation(base)[6:], rng.integers(0, 2**64, 6, dtype=np.uint64)])) for _ in range(200)]
    sets += [np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(3)]
    compared, plain = [], jaccard._within

    def counted(one, other, n_one, n_other, plan):
        found = plain(one, other, n_one, n_other, plan)
        compared.append(len(found))
        return found

    monkeypatch.setattr(jaccard, "_within", counted)
    n = len(sets)
    table = {"sig": [7] * n, "lo": [0] * n, "hi": [blocks - 1] * n, "block": [i % blocks for i in range(n)], "doc_id": list(range(n)), "n": [len(s) for s in sets], "sketch": [jaccard.sketch_of(s, plan.per_fragment) for s in sets]}
    rows = pa.table(table).sort_by([("block", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    edges = [(a, b) for out in jaccard._bounded(plan)(iter(rows.to_batches())) for a, b in zip(*out.to_pydict().values(), strict=True)]
    assert len(edges) == 199  # a spanning tree of the copies
    joined = {0}
    for _ in range(n):
        joined |= {x for e in edges if set(e) & joined for x in e}
    assert joined == set(range(200))
    assert sum(compared) < 10 * n
