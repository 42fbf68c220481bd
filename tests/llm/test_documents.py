"""The document operators on edge cases, against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from vigilore.llm import jaccard, packing, pii, quality, segmentation, substring, toxicity
from vigilore.llm.queries import tokenizer_path


def words(text):
    return (text or "").encode().split()


def test_quality(spark, docs, empty):
    got = collections.defaultdict(list)
    for r in quality.quality_rules(docs).collect():
        got[r.doc_id].append(r)
    for row in docs.collect():
        w = words(row.text)
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[k] > 1 for j in (i, i + 1, i + 2)}
        r = got[row.doc_id][0]
        assert (r.q_words, r.q_word_chars, r.q_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(hit)), row.doc_id
        assert r.q_base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.q_base_failed and r.q_kept)
    assert got[1][0].q_kept
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r[0].q_kept}
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_repeated_rows_are_judged_each(spark, docs):
    twice = docs.unionAll(docs)
    assert quality.quality_rules(twice).count() == 2 * docs.count()
    assert substring.substring_dedup(twice).count() == 2 * docs.count()


def test_substring(docs, empty):
    got = {r.doc_id: r for r in substring.substring_dedup(docs, with_text=True).collect()}
    seen = set()
    for row in sorted((r for r in docs.collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        w, gone = words(row.text), set()
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone |= set(range(i, i + 20))
            seen.add(k)
        r = got[row.doc_id]
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.dedup_n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest()), row.doc_id
        assert sum(s.end - s.start for s in r.removed) == len(gone)
    assert got[5].n_removed == 30 and got[2].n_removed == 120 and got[None].n_removed == 0
    assert substring.substring_dedup(empty).count() == 0


def sets_of(docs):
    out = {}
    for r in docs.collect():
        w = words((r.text or "").encode().lower().decode())
        out[r.doc_id] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard(docs, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", block)
    monkeypatch.setattr(jaccard, "SET_BLOCK", block)
    got = {r.doc_id: r for r in jaccard.jaccard_components(docs).collect()}
    sets = {k: v for k, v in sets_of(docs).items() if k is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id) == (len(s), find(i)), i
    assert got[3].component_id == 1 and got[7].component_id == 7
    assert jaccard.jaccard_components(empty).count() == 0


def component_ids(sets_by_row, num, den):
    """Smallest id reachable, of every id; ``sets_by_row`` are (id, set), ids may repeat."""
    parent = {i: i for i, _ in sets_by_row}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, x) in enumerate(sets_by_row):
        for b, y in sets_by_row[:k]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Chains of near copies, far beyond one block; ids with two texts; null ids; repeated rows."""
    monkeypatch.setattr(jaccard, "SET_BLOCK", 16)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    num, den, r = 80, 100, random.Random(8)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    data = []
    for g in range(3):
        text = [*base[: 150 - 5 * g], *(f"g{g}x{k}" for k in range(4 * g))]
        for i in range(60):
            own = list(text)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = f"n{r.randrange(10**6)}"
            if i % 7 == 0:
                text = own  # drifts on
            data.append((1000 * g + i, " ".join(own)))
    data += [(5, "one other text of some few words"), (5000, "one other text of some few words"), (None, data[3][1]), data[10], data[10], (2001, data[4][1])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    shingles = [(i, set(zip(w, w[1:], w[2:], strict=False))) for i, t in data if i is not None for w in [t.split()]]
    want = component_ids(shingles, num, den)
    rows = jaccard.jaccard_components(df, num=num, den=den).collect()
    assert len(rows) == len(data) and {r.component_id for r in rows if r.doc_id is None} == {None}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want and want[5000] == want[5]


def test_repeated_ids_keep_all_links(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(5, a), (5, b), (6, b + " x"), (7, b + " y"), (1, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()} == {(5, 1), (6, 1), (7, 1), (1, 1)}


def test_sketches_of_very_long_texts():
    """Two sets of five million n-grams that nearly agree pass the bound of the coarse fragments, unlike two that do not."""
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 5_001_000).astype(np.uint64) * np.uint64(2))
    y, z, plan = x[1_000:], x[: len(x) - 1_000], jaccard._Plan(90, 100)
    far = np.unique(np.random.default_rng(2).integers(0, 2**63, len(y)).astype(np.uint64) * np.uint64(2))
    sketches = jaccard._Sketches([jaccard.sketch_of(v) for v in (y, z, far)])
    one = lambda i: sketches.at(np.array([i]), int(sketches.m[0]))
    assert one(0)[1].sum() == len(y)
    assert jaccard._within(one(0), one(1), len(y), len(z), plan).tolist() == [True]
    assert jaccard._within(one(0), one(2), len(y), len(far), plan).tolist() == [False]


def test_sketches_bound_every_linked_pair():
    """Sets on both sides of a doubling of the fragments; the bound never rules out a linked pair."""
    rng = np.random.default_rng(3)
    for num in (80, 90):
        plan = jaccard._Plan(num, 100)
        for n in (400, 505, 512, 520, 1030, 2100):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            y = np.unique(np.concatenate([rng.permutation(x)[int(n * 0.02) :], rng.integers(0, 2**63, int(n * (98 - num) / 100)).astype(np.uint64)]))
            if 100 * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y)):
                sketches = jaccard._Sketches([jaccard.sketch_of(x), jaccard.sketch_of(y)])
                m = int(sketches.m.min())
                at = [sketches.at(np.array([i]), m) for i in (0, 1)]
                assert sketches.m.max() <= 2 * m and jaccard._within(*at, len(x), len(y), plan).tolist() == [True]


def test_sketches_are_small_and_whole():
    """pipeline: a count takes one byte, or four where a fragment holds many; both meet with the same sums."""
    usual = np.unique(np.random.default_rng(4).integers(0, 2**63, 600).astype(np.uint64) * np.uint64(2))
    crowded = np.concatenate([np.arange(1, 401, dtype=np.uint64), usual[usual > 2**60]])  # four hundred in the first fragment
    raw = [jaccard.sketch_of(usual, 12), jaccard.sketch_of(crowded, 12), jaccard.sketch_of(usual[usual > 2**60][:300], 12)]
    assert len(raw[0]) <= 3 * jaccard.COARSE + 1
    sketches = jaccard._Sketches(raw)
    assert sketches.m.tolist() == [64, 128, 64] and sketches.wide.tolist() == [1, 4, 1]
    key, count = sketches.at(np.array([0, 1, 2]), 64)
    for k, c, own in zip(key, count, (usual, crowded, usual[usual > 2**60][:300]), strict=True):
        f = jaccard._ranges(own, 64).astype(np.int64)
        assert c.tolist() == np.bincount(f, minlength=64).tolist()
        sums = [int(np.add.reduce(jaccard.mix(own[f == i]), dtype=np.uint64) & np.uint64(0xFFFF)) for i in range(64)]
        assert k.tolist() == sums


def test_pigeonhole_never_loses_a_pair():
    """Sets at the edge of the threshold always share a fragment."""
    plan, rng = jaccard._Plan(90, 100), np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        gone, new = int(rng.integers(0, max(1, n // 12) + 1)), int(rng.integers(0, max(1, n // 12) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if len(y) and 100 * common >= 90 * union:
            of = lambda s: set(np.concatenate([jaccard._signatures(s, c, plan) for c in plan.classes(len(s))]).tolist())
            assert of(x) & of(y)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_pii(spark, docs, empty):
    odd = ["a@b.c%d@e.f x", "a@b.c@d.e..f@g-.h.i", "1.2.3.4.5.6.7.8 0000001.2.3.4 1000000000001.1.1.1", "4111-1111-1111-1111-1 " + "7" * 3000, "+1 555 123 4567+15551234567 +1(", "é@x.y 𝒳a@b.cc 4111111111111111𝒳", "a." * 3000 + "@b" + ".c" * 3000, "1-1 1-1" * 50]
    more = spark.createDataFrame([(1000 + i, t, None, None, 0, 0, None) for i, t in enumerate(odd)], docs.schema)
    all_ = docs.unionAll(more)
    got = {r.doc_id: r for r in pii.pii_spans(all_).collect()}
    for row in all_.collect():
        want = base_spans(row.text or "")
        assert got[row.doc_id].base_spans == ",".join(want), row.doc_id
        assert set(want) <= set(got[row.doc_id].spans.split(",")) | {""}
    assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (1, 1, 1, 1)
    shown = {r.doc_id: r.text for r in pii.redact(all_).collect()}
    assert shown[11] == "mail <EMAIL> or <PHONE>, <CARD> at <IP> and 300.1.1.1" and shown[6] is None and shown[1005].endswith("<CARD>𝒳")
    assert pii.pii_spans(empty).count() == 0 and pii.redact(empty).columns == docs.columns


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(docs, path, max_segments=8).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for row in docs.collect():
        ids, at = tok.encode(row.text or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(pieces[row.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for q in sequences.values():
        at = 0
        for p in sorted(q, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and len(q) <= 8
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padding < 0.02 * total
    assert packing.pack_documents(empty, path).count() == 0


def test_pack_examples(spark, empty):
    data = [(str(i), 100 + 37 * i % 900, 1 + i % 5, 50 + i % 400) for i in range(300)] + [("big", 5000, 1, 1), ("none", None, None, None)]
    df = spark.createDataFrame(data, "id string, t long, s long, l long")
    out = packing.pack_examples(df, "id", "t", "s", "l", (2048, 16, 1500)).join(df, "id").collect()
    assert len(out) == 302
    for q in {r.sequence_id for r in out}:
        own = [r for r in out if r.sequence_id == q]
        if not own[0].too_large:
            assert sum(r.t or 0 for r in own) <= 2048 and sum(r.s or 0 for r in own) <= 16 and sum(r.l or 0 for r in own) <= 1500
    assert [r.id for r in out if r.too_large] == ["big"]


def brute(model, text, n):
    text, out = segmentation.MARK + text.replace(" ", segmentation.MARK), []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            if (f := model.pieces.get(text[i:j])) is not None:
                single |= j == i + 1
                go(j, score + f[0], (*ids, f[1]))
        if not single:
            b = [model.bytes[x] for x in text[i].encode()]
            go(i + 1, score + model.byte_score * len(b), (*ids, *b))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])[:n]


def test_segmentation(spark, docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    model = segmentation.lattice(path, 4)
    for text in ("the cat", "a  b", "é€\n1.", "x_1 y", "ing", "…" * 2, " lead"):
        want, got = brute(model, text, 4), model.text(text)
        assert [round(s, 6) for s, _ in want] == [round(s, 6) for s, *_ in got], text
        assert all(model.decode(ids) == text for _, ids, _ in got) and len({tuple(ids) for _, ids, _ in got}) == len(got)
    out = segmentation.encode_nbest(docs, path, 2, with_ids=True)
    assert {r.round_trip for r in out.collect()} == {True}
    back = {r.doc_id: r.text for r in segmentation.decode(out.where("rank = 1"), path).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.collect() if r.doc_id is not None)
    assert segmentation.encode_nbest(empty, path).count() == 0


def test_toxicity(spark, docs, empty):
    bad = [(2000 + i, "plain words here and there " * 3 + ("vilescum trashy " if i % 3 == 0 else "gentle ") + "more of it " * (i % 4), None, None, 0, 0, None) for i in range(150)]
    all_ = docs.unionAll(spark.createDataFrame(bad, docs.schema))
    labels = spark.createDataFrame([(2000 + i, int(i % 3 == 0)) for i in range(150)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(all_, labels).collect()}
    assert len(got) == len({r.doc_id for r in all_.collect()}) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(150) if zlib.crc32(str(2000 + i).encode()) % 5 == 0]
    assert held and all(got[2000 + i].held_out for i in held)
    assert sum(got[2000 + i].predicted == int(i % 3 == 0) for i in held) >= 0.9 * len(held)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_keeps_rare_ngrams(spark):
    """One rare toxic word among more than 2^20 n-grams of greater weight is still known."""
    rng, rare = np.random.default_rng(2), "".join(chr(0xD7A3 - i) for i in range(30))
    letters = (0x4E00 + rng.integers(0, 20_000, (90_000, 24))).astype("<u4")
    common = [w.tobytes().decode("utf-32-le") for w in letters]
    label = {i: int(i % 9 == 0) for i in range(3000, 3180)}
    text = {i: " ".join(common[k * 500 : k * 500 + 500] * 2) for k, i in enumerate(label)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    taught = next(i for i in label if label[i] and fold(i) in (1, 2, 3))
    asked, first = [i for i in label if fold(i) == 0][:2]
    text[taught], text[asked], text[first] = text[taught] + " " + rare, rare, rare[0]
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == len(text) and got[asked].n_words == 1
    # Each of the 26 n-grams behind the first ones adds log(0.763 / 0.684) by hand.
    assert got[asked].comparison - got[first].comparison > 0.5


def brute_kneser_ney(counts, order, discount):
    """(ratios of n-grams, ratios of contexts) with dictionaries, from {word: (n0, n1)}."""
    top = collections.defaultdict(lambda: [0, 0])
    for w, n in counts.items():
        p = "^" * (order - 1) + w + "$"
        for i in range(len(p) - order + 1):
            for c in (0, 1):
                top[p[i : i + order]][c] += n[c]
    level = {order: {g: sum(n) for g, n in top.items()}}
    for o in range(order - 1, 0, -1):
        level[o] = collections.Counter(g[1:] for g in level[o + 1])

    def shared(g):
        o = len(g)
        if o == 1:
            return level[1][g] / sum(level[1].values())
        own = [n for x, n in level[o].items() if x[:-1] == g[:-1]]
        return max(level[o][g] - discount, 0) / sum(own) + discount * len(own) / sum(own) * shared(g[1:])

    def of_class(g, c):
        own = [n[c] for x, n in top.items() if x[:-1] == g[:-1] and n[c]]
        back = discount * len(own) / sum(own) if own else 1.0
        return (max(top[g][c] - discount, 0) / sum(own) if own else 0.0) + back * shared(g), back

    return {g: np.log(of_class(g, 1)[0] / of_class(g, 0)[0]) for g in top}, {g[:-1]: np.log(of_class(g, 1)[1] / of_class(g, 0)[1]) for g in top}


def test_kneser_ney_against_dictionaries(spark):
    r = random.Random(4)
    counts = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))): (r.randrange(6), r.randrange(3)) for _ in range(60)}
    counts = {w: n for w, n in counts.items() if sum(n)}
    grams, contexts = brute_kneser_ney(counts, 5, 0.75)
    g, c = toxicity.kneser_ney(spark.createDataFrame([(w, *n) for w, n in counts.items()], "word string, n0 long, n1 long"))
    got, low = {x.gram: x.ratio for x in g.collect()}, {x.context: x.ratio for x in c.collect()}
    assert got.keys() == grams.keys() and low.keys() == contexts.keys()
    assert max(abs(got[k] - grams[k]) for k in grams) < 1e-9 and max(abs(low[k] - contexts[k]) for k in contexts) < 1e-9


def test_toxicity_comparison_against_brute_force(spark):
    """Scores of whole texts: sums over words, normalised by the root of the length; repeated rows and a very long text."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    text = {i: " ".join([word() for _ in range(r.randint(3, 30))] + (["vile", "Vile!"] if i % 4 == 0 else [])) for i in range(400, 480)}
    text[900] = "plain vile " * 60_000
    label = {i: int(i % 4 == 0) for i in range(400, 480)}
    rows = [*text.items(), (401, text[401]), (901, None)]
    got = {x.doc_id: x for x in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(label.items()), "doc_id long, toxic int")).collect()}
    letters = lambda t: [w for x in t.lower().split() if (w := "".join(c for c in x if c.isalpha()))]
    counts = collections.defaultdict(lambda: [0, 0])
    for i, t in rows:
        if i in label and zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            for w in letters(t):
                counts[w][label[i]] += 1
    grams, contexts = brute_kneser_ney(counts, 5, 0.75)

    def ratio(w):
        p = "^^^^" + w + "$"
        return sum(grams.get(p[i : i + 5], contexts.get(p[i : i + 4], 0.0)) for i in range(len(p) - 4))

    known = {w: ratio(w) for w in {w for _, t in rows for w in letters(t or "")}}
    for i, t in rows:
        w = letters(t or "")
        want = sum(max(known[x] - 2, 0) for x in w) / max(len(w), 1) ** 0.5
        assert abs(got[i].comparison - want) < 1e-4 * max(1, want), i


#: text, what the method adds beside the base spans ("" for nothing).
DISGUISED = [
    ("write to jane.doe (at) example (dot) com soon", "email:9:40"), ("mail bob7 at corp dot org now", "email:5:25"), ("x kim[at]host[dot]net y", "email:2:21"), ("look at example.com please", ""), ("they arrive at noon.today we left", ""),
    ("host 10 . 7 . 5 . 9 up", "ip:5:19"), ("server at 10[.]2[.]3[.]4 fails", "ip:10:24"), ("from 2001:db8:85a3:0:0:8a2e:370:7334 came", "ip:5:36"), ("gateway fe80::1ff:fe23 up", "ip:8:22"), ("at 12:30:45 the train", ""), ("version 1 . 2 . 3 . 4 . 5 is out", ""),
    ("card 4111.1111.1111.1111 ok", "card:5:24"), ("visa 4111111111111112 ok", "card:5:21"), ("order 9807915762804490 raie", ""), ("leque 9807915762804490 raie", ""),
    ("call (212) 555-7788 now", "phone:5:19"), ("tel 0043 512 555 7788", "phone:4:21"), ("dial 212-555-7788 after", "phone:5:17"), ("years 1990 - 2000-2010 were", ""), ("isbn 978-316-1484 here", ""), ("sum 12 345 6789 units", ""),
    ('the token = "04dbebab91ab85687d33eeaaf9" x', "secret:4:39"), ("api_key: Zk3j9QpL0aXy77Bn go", "secret:0:25"), ("token: please ask", ""), ("commit 04dbebab91ab85687d33eeaaf904dbebab91ab85 done", ""),
]


def test_pii_adds_disguised_spans(spark):
    """Hand-written cases, found again in a table with many decoys; thresholds do not depend on how rare a kind is."""
    texts = [t for t, _ in DISGUISED] + [f"call +1 555 {100 + i % 900} {1000 + i} now" for i in range(1500)] + [f"host 10.{300 + i}.{i % 7}.{i % 250} up" for i in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    added = {i: ",".join(s for s in got[i].spans.split(",") if s and s not in got[i].base_spans.split(",")) for i in got}
    starts = lambda x: x.rsplit(":", 1)[0]
    right = sum(starts(added[i]) == starts(w) for i, (_, w) in enumerate(DISGUISED) if w)
    wrong = [t for i, (t, w) in enumerate(DISGUISED) if not w and added[i]]
    assert right >= 0.9 * sum(bool(w) for _, w in DISGUISED) and not wrong, {t: added[i] for i, (t, _) in enumerate(DISGUISED)}
    n = len(DISGUISED)
    assert all(not added[i] for i in range(n, len(texts))) and got[n].spans == "phone:5:20" and got[len(texts) - 3].spans == ""
    shown = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert shown[0] == "write to <EMAIL> soon" and shown[len(texts) - 2] is None


def test_pii_long_texts(spark):
    """Very many matches in one text take time in proportion to its length."""
    docs = spark.createDataFrame([(1, "a@b.cc 10.0.0.1 " * 20_000), (1, "a@b.cc 10.0.0.1 " * 20_000)], "doc_id long, text string")
    rows = pii.pii_spans(docs).collect()
    assert [(r.n_email, r.n_ip) for r in rows] == [(20_000, 20_000)] * 2
    assert {r.text for r in pii.redact(docs).collect()} == {"<EMAIL> <IP> " * 20_000}


@pytest.mark.parametrize("inside", [True, False])
def test_toxicity_of_a_class_on_one_side_of_the_curve_fold(spark, inside):
    """All toxic rows in the fold that fits the curve, or none of them: there is a model all the same."""
    at = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    bad = [i for i in at if (zlib.crc32(str(i).encode()) % 5 == 4) == inside][:50]
    good = [i for i in at if i not in set(bad)][:200]
    rows = [(i, f"plain words here and zzykx number{i % 7}") for i in bad] + [(i, f"plain words here and there number{i % 7}") for i in good]
    rows += [(5001, "a zzykx again"), (5004, "plain words again")]
    labels = spark.createDataFrame([(i, 1) for i in bad] + [(i, 0) for i in good], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[5001] > 0.5 > got[5004] and all(got[i] > 0.5 for i in bad) and all(got[i] < 0.5 for i in good)


@pytest.mark.parametrize("num", [50, 60, 66, 80])
def test_low_thresholds_keep_all_links(spark, monkeypatch, num):
    """Single words, pairs right at the threshold and sizes far apart; blocks cut by elements, not by rows only."""
    monkeypatch.setattr(jaccard, "SET_BLOCK", 4)
    monkeypatch.setattr(jaccard, "MEAN_SET", 20)
    r, data = random.Random(num), []
    for g in range(60):
        n = r.choice([1, 2, 3, 5, 8, 13, 40, 90, 200])
        own = [f"g{g}w{i}" for i in range(n)]
        least = -(-n * num // 100)  # a subset of so many words is linked, one word less is not
        data += [(10 * g, own), (10 * g + 1, own[:least]), (10 * g + 2, own[n - least + 1 :]), (10 * g + 3, own + [f"g{g}x{i}" for i in range(n * (100 - num) // num)])]
    want = component_ids([(i, set(w)) for i, w in data], num, 100)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_components(df, k=1, num=num).collect()} == want


def test_thresholds_below_a_half_are_refused(docs):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs, num=49)
