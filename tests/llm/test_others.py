"""Vectors, chats, URLs, components and the pipeline."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilore.llm import chat, components, neighbours, pii, urls
from vigilore.llm.queries import ORACLE, URL_RULES, tokenizer_path


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 10), (5, 5)] + [(20 + i, 21 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got[3] == 1 and got[11] == 10 and got[60] == 20 and 5 not in got and len(got) == 3 + 2 + 41
    assert components.connected_components(edges.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40:60] = x[40]  # a group of copies: ties go to the smaller id
    data = [(i, [float(v) for v in r], 1.0) for i, r in enumerate(x)] + [(9000, None, 1.0), (9001, [0.0] * 24, 1.0), (9002, [float("nan")] + [1.0] * 23, 1.0), (9003, [None] + [1.0] * 23, 1.0), (9004, [1.0] * 5, 1.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double").repartition(4)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 24, k=5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        s[q] = -9
        best = np.lexsort((np.arange(600), -s))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(v - s[i]) < 1e-12 for i, v in got[q].values())
        hits += len({i for i, _ in got[q].values()} & set(best.tolist()))
    assert hits >= 0.9 * 5 * 30 and [got[40][k][0] for k in range(1, 6)] == [41, 42, 43, 44, 45] and not [q for q in got if q >= 9000]
    assert neighbours.nearest(df.limit(0), df, 24).count() == 0


@pytest.mark.parametrize(("n", "spread"), [(1, 0), (5, 0), (15, 1), (21, 1), (30, 0), (1500, 1)])
def test_neighbours_of_few_or_unequal_vectors(spark, n, spread):
    """Small tables are searched exactly; with lengths that differ tenfold most of the largest inner products are found."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x *= (np.exp(spread * rng.normal(size=n)) / np.linalg.norm(x, axis=1))[:, None]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(data + data[:2], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, n, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[: min(20, n - 1)]
        rows = sorted(got.get(q, []))
        assert [r for r, *_ in rows] == list(range(1, len(best) + 1)) and all(abs(v - s[i]) <= 1e-12 * max(1, abs(v)) for _, i, v in rows)
        hits, total = hits + len({i for _, i, _ in rows} & set(best.tolist())), total + len(best)
        assert n > 100 or [i for _, i, _ in rows] == best.tolist()
    assert hits >= 0.9 * total


def test_chat(spark):
    convs = {1: "abc", 2: "ab", 3: "abcd", 4: "abcd", 5: "x", 6: "", 7: "abd", 8: None}
    data = [(c, t, "user" if t % 2 == 0 else "assistant", k, "v") for c, s in convs.items() for t, k in enumerate(s or "")] + [(9, 0, None, None, "v"), (None, 3, "user", "zz", "v"), (10, 0, "user", None, "v")] + [(11, t, "user", str(t), "v") for t in range(1500)] + [(12, t, "user", str(t), "v") for t in range(1200)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n_turns string").repartition(3)
    out = chat.collapse_and_render(df).collect()
    assert {r.conv_id for r in out} == {3, 5, 7, 9, 10, 11, None}
    assert "".join(r.rendered for r in sorted((r for r in out if r.conv_id == 7), key=lambda r: r.turn_index)) == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nd<|end|>\n"
    assert [r.turn_index for r in sorted((r for r in out if r.conv_id == 11), key=lambda r: r.turn_index)] == list(range(1, 1501))
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_chat_crowded_turns(spark, monkeypatch):
    """Turns without a number, or with the same one, are in order of role and text however many they are; a very long text."""
    monkeypatch.setattr(chat, "TURN_RANGE", 4)
    texts = [f"{chr(97 + i % 7)}{i:03}" for i in range(60)] + [None, "", "a", "é" * 20_000]
    data = [(1, None, "user", t) for t in texts] + [(1, 3, "user", "last")] + [(2, 9, r, t) for t in texts for r in ("user", None)] + [(3, None, "user", t) for t in sorted(t for t in texts if t is not None)[:30]]
    out = chat.collapse_and_render(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    got = {c: [r.rendered for r in sorted((r for r in out if r.conv_id == c), key=lambda r: r.turn_index)] for c in (1, 2, 3)}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())
    for c in (1, 2, 3):
        assert got[c] == [f"<|{r or ''}|>\n{t or ''}<|end|>\n" for _, _, r, t in sorted((x for x in data if x[0] == c), key=key)]


def test_urls(spark):
    data = [(1, "https://A.Example.org/es/1?q"), (2, "http://example.org/en/12"), (3, "http://x.example.org/de/1#t"), (4, "https://shop.com/fr/9"), (5, "ftp://shop.com/de/9"), (6, "https://shop.net/de/1"), (7, None), (8, "nothing"), (9, ""), (10, "http://badexample.org"), (11, "http://notorg/es/"), (12, "x://H"), (1, "https://A.Example.org/es/1?q")]
    df = spark.createDataFrame([(*r, "r") for r in data], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.url_filter(df, URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [got[i].rule for i in (2, 3, 4, 5, 6, 10, 11)] == ["example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None]
    assert (got[7].host, got[7].path, got[12].host, got[12].path) == ("", "", "h", "")
    assert all(r.verdict in ("allow", "block") for r in got.values()) and urls.url_filter(df, URL_RULES).count() == len(data)
    train = spark.createDataFrame([(f"http://good.net/news/{i}", 0) for i in range(30)] + [(f"http://casino{i}.net/win", 1) for i in range(30)], "url string, block int")
    more = spark.createDataFrame([(1, "http://casino77.net/win"), (2, "http://good.net/news/77")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_filter(more, [], train).collect()} == {1: "block", 2: "allow"}
    assert urls.url_filter(df.limit(0), URL_RULES).count() == 0


def test_url_classifier_on_held_out_urls(spark):
    """A fit on three quarters of the labelled table judges the rest; very long URLs are judged whole."""
    from vigilore.llm.url_labels import labelled_urls

    known = labelled_urls(spark).withColumn("h", F.pmod(F.xxhash64("url"), F.lit(4))).cache()
    assert {r["block"]: r["count"] for r in known.groupBy("block").count().collect()}[1] > 400
    asked = known.where("h = 0").select(F.monotonically_increasing_id().alias("page_id"), "url", F.col("block").alias("rule"))
    got = urls.url_filter(asked, [], known.where("h <> 0"), max_labelled=2_000).join(asked.select("page_id", F.col("rule").alias("block")), "page_id").collect()
    assert len(got) > 200 and sum((r.verdict == "block") == (r.block == 1) for r in got) >= 0.95 * len(got)
    long = spark.createDataFrame([(1, "http://casino.com/" + "win/" * 20_000), (2, "http://wiki.org/" + "about/" * 20_000)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.url_filter(long, []).collect()} == {1: "block", 2: "allow"}


def test_pipeline(spark):
    import corpus_pipeline

    sf, held = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        held.append({r.doc_id: r.text for r in docs.collect()})
    good, once, cut, _ = held
    sets = {}
    for i, t in good.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert set(once) == set(good) - gone
    seen = set()
    for i in sorted(once):
        w, off = once[i].encode().split(), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                off |= set(range(k, k + 20))
            seen.add(key)
        want = b" ".join(x for k, x in enumerate(w) if k not in off).decode() if off else once[i]
        assert hashlib.md5(cut[i].encode()).digest() == hashlib.md5(want.encode()).digest()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert set(good) == {i for i, kept in db.sql(ORACLE["op1_quality_rules"]).project("doc_id, kept").fetchall() if kept}
    spans = {r.doc_id: r.spans for r in pii.pii_spans(spark.createDataFrame(list(cut.items()), "doc_id long, text string")).collect()}
    for i, text in cut.items():
        shown, at = "", 0
        for kind, start, end in (x.split(":") for x in spans[i].split(",") if x):
            if int(start) >= at:
                shown += text[at : int(start)] + f"<{kind.upper()}>"
            at = max(at, int(end))
        assert held[3][i] == shown + text[at:]
    packed = collections.defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        packed[r.doc_id].append(r)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert packed.keys() == held[3].keys()
    for i, text in held[3].items():
        ids, at = tokenizer.encode(text, add_special_tokens=False).ids + [1], 0
        for r in sorted(packed[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
