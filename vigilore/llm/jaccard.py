"""Exact n-gram Jaccard join by vertical partitioning, and the components of its links.

The global order of n-grams is that of their 64-bit hashes.  It is cut into
fragments (ranges of the order), more of them than two linked sets can differ in
elements, so a linked pair agrees completely in at least one fragment.  Sizes fall
into classes; a class fixes its number of fragments, and sets close under a class
border also emit the fragments of the class below.

1. Equal sets collapse to their smallest document.
2. Sets that agree in a fragment meet.  Their overlap is bounded by summing the
   partial overlaps that coarse fragments allow; pairs whose bound is too small go.
   Each meeting returns a spanning forest of what is left, never its pairs.
3. The forest's components are clusters of possible partners.  Within a cluster the
   full sets meet; exact partial overlaps are counted fragment by fragment and
   summed per pair, and again only a spanning forest of the true links is returned.
4. A cluster of more than a block first meets ``PIVOTS`` of its own sets, which takes
   one pass over it and leaves few parts that a link could still join.  The distance
   1 - J is a metric: two sets whose distances to a pivot lie further apart than the
   threshold cannot be linked.  Only rows of the smaller parts go on, to the blocks
   of their cluster, and of these only pairs of different parts that no pivot rules
   out are counted.

Meetings of any size are cut into blocks of bounded size that are compared two by
two, so no task holds a whole group and nothing is capped.

Defined cases: null or empty text has an empty set and is linked with nothing; a
text of fewer words than the n-gram is one n-gram; rows that repeat an id are one
node with the links of all its texts; null ids get no class and no component; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import materialize, release
from .words import grams, mix, word_hashes

#: Coarse fragments of the overlap bound, and rows of a block in the two kinds of meetings.
COARSE = 64
SKETCH_BLOCK = 4096
SET_BLOCK = 512
#: Elements of a set in a block of them, on average: of larger sets a block holds fewer.
MEAN_SET = 40_000
#: Sets of a large cluster that all others are compared with first.
PIVOTS = 8
CLASS_STEP = 1.5


def ngram_set(words: list[bytes], k: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(grams(h, k)) if len(h) >= k else mix(grams(h, len(h), 1000 + len(h)))


def _ranges(s: np.ndarray, m: int) -> np.ndarray:
    """Fragment of each element when the order is cut into ``m`` equal ranges."""
    return ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


class _Plan:
    """Size classes and fragment counts for links at ``num`` / ``den``."""

    def __init__(self, num: int, den: int):
        if not den <= 2 * num <= 2 * den:
            raise ValueError("linked sets must share half of their elements at least")  # sketches meet at a size ratio of two at most
        self.num, self.den = num, den
        # Two unrelated sets with x elements in a fragment agree in about 1 - 0.56 / sqrt(x) of them by count alone;
        # linked ones of equal size in 2 * num / (num + den).  Half of the x at which the two meet.
        self.per_fragment = max(4, int(0.5 * (0.56 * (num + den) / (den - num)) ** 2)) if num < den else 64
        self.tops = [1]
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * CLASS_STEP)))

    def size_class(self, n: int) -> int:
        return int(np.searchsorted(self.tops, n))

    def differ(self, c: int) -> int:
        """Most elements that two linked sets differ in, the smaller one in class ``c``."""
        return self.differ_of(self.tops[c], c)

    def differ_of(self, n: int, c: int) -> int:
        """The same where one of the two has ``n`` elements."""
        other = n * self.den // self.num if n <= self.tops[c] else self.tops[c]
        return (self.den - self.num) * (n + other) // (self.den + self.num)

    def fragments(self, c: int) -> int:
        d = self.differ(c)
        return d + 1 if d < 3 else d + 3 + (d + 1) // 100

    def classes(self, n: int) -> list[int]:
        """All classes that the smaller set of a link with one of ``n`` elements can fall into."""
        return list(range(self.size_class(n), self.size_class(-(-n * self.num // self.den)) - 1, -1))

    def need(self, nx, ny):
        """Least overlap of a linked pair."""
        return -(-(nx + ny) * self.num // (self.num + self.den))


def _signatures(s: np.ndarray, c: int, plan: _Plan) -> np.ndarray:
    m, d = plan.fragments(c), plan.differ_of(len(s), c)
    f = _ranges(s, m).astype(np.int64)
    at = np.flatnonzero(np.diff(f, prepend=-1))
    sums = np.add.reduceat(mix(s), at)
    sig = mix(sums ^ mix(np.uint64(c * 1_000_003 + 17) + mix(f[at].astype(np.uint64))))
    if len(at) <= d:  # too few full fragments to be sure of an equal one: the empty ones count too
        empty = np.setdiff1d(np.arange(m), f[at]).astype(np.uint64)
        sig = np.concatenate([sig, mix(mix(np.uint64(c * 1_000_003 + 17) + mix(empty)) ^ np.uint64(0x5555))])
    return sig


def sketch_of(s: np.ndarray, per_fragment: int = 8) -> bytes:
    """Bytes of a count, then for every coarse fragment 16 bits of the sum of its elements' hashes, then their counts.

    There are ``COARSE`` times a power of two of them, so that a fragment has
    ``per_fragment`` elements or fewer on average: with more the bound would tell too little.
    Counts take one byte each unless one of them needs more, then four.
    """
    m = COARSE
    while len(s) > per_fragment * m:
        m *= 2
    f = _ranges(s, m).astype(np.int64)
    at = np.flatnonzero(np.diff(f, prepend=-1))
    key = np.zeros(m, np.uint16)
    key[f[at]] = (np.add.reduceat(mix(s), at) & np.uint64(0xFFFF)).astype(np.uint16)
    count = np.bincount(f, minlength=m)
    wide = 1 if count.max() < 256 else 4
    return bytes([wide]) + key.tobytes() + count.astype(f"u{wide}").tobytes()


class _Sketches:
    """Sketches of some rows, read at a number of fragments; one with twice as many is halved (both parts add up)."""

    def __init__(self, sketches: list[bytes]):
        self.raw = sketches
        self.wide = np.array([x[0] for x in sketches], np.int64)
        self.m = np.array([len(x) - 1 for x in sketches], np.int64) // (2 + self.wide)

    def at(self, rows: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) of ``rows``, all of which have ``m`` or ``2 * m`` fragments."""
        key, count = np.zeros((len(rows), m), np.uint16), np.zeros((len(rows), m), np.int64)
        for own, step in ((m, 1), (2 * m, 2)):
            for wide in (1, 4):
                here = np.flatnonzero((self.m[rows] == own) & (self.wide[rows] == wide))
                if len(here):
                    z = np.frombuffer(b"".join(self.raw[r] for r in rows[here]), np.uint8).reshape(len(here), 1 + (2 + wide) * own)
                    k = np.ascontiguousarray(z[:, 1 : 1 + 2 * own]).view(np.uint16).reshape(len(here), m, step)
                    c = np.ascontiguousarray(z[:, 1 + 2 * own :]).view(f"u{wide}").reshape(len(here), m, step)
                    key[here], count[here] = k.sum(2, dtype=np.uint16), c.sum(2, dtype=np.int64)
        return key, count


def _describe(plan: _Plan, k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                s = ngram_set((text.lower() if lower else text).split(), k)
                if not len(s):
                    out.append((doc, 0, 0, 0, b"", b""))
                    continue
                sig = np.concatenate([_signatures(s, c, plan) for c in plan.classes(len(s))])
                sketch = sketch_of(s, plan.per_fragment)
                out.append((doc, len(s), int(np.add.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0xABCDEF987654321))).view(np.int64)), sig.tobytes(), sketch))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n", "s1", "s2", "sigs", "sketch"])

    return run


#: Sets whose signatures a task remembers to have sent.
SENT = 1_000_000


def _explode_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, s1): equal sets that meet in one task send their signatures once."""
    sent: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            b = batch.slice(at, 1000)
            keys, sigs = [], []
            for key, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key not in sent:
                    sent.add(key)
                    keys.append(key)
                    sigs.append(np.frombuffer(sig, np.int64))
            if len(sent) > SENT:
                sent.clear()
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(keys, np.int64), [len(x) for x in sigs]))], names=["sig", "s1"])


def _forest(ids: np.ndarray, partners, asked: Iterable[int]) -> list[tuple[int, int]]:
    """Spanning forest of the links that ``partners(i, part)`` (indices) tells of the rows ``asked``.

    Rows of the same ``part`` are joined already and need not be told.
    """
    part, edges = np.arange(len(ids)), []
    for i in asked:
        js = partners(i, part)
        others, first = np.unique(part[js], return_index=True)
        first, others = first[others != part[i]], others[others != part[i]]
        if len(others):
            edges += [(int(ids[i]), int(j)) for j in ids[js[first]]]
            joined = np.zeros(len(ids), bool)
            joined[others] = True
            part[joined[part]] = part[i]
            if len(edges) == len(ids) - 1:
                break
    return edges


def _edges_table(edges: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _within(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], n_one, n_other, plan: _Plan) -> np.ndarray:
    """Whether the summed partial bounds of two (keys, counts) reach the needed overlap."""
    (key_a, count_a), (key_b, count_b) = one, other
    low = np.minimum(count_a, count_b)
    low = low - ((count_a == count_b) & (key_a != key_b))
    return low.sum(1) >= plan.need(n_one, n_other)


def _bounded(plan: _Plan):
    """Meetings of sketches, rows ordered by meeting, block and id: links that the bound allows.

    Meetings of two, by far the most, are settled together.
    """

    def settle(t: pa.Table) -> pa.RecordBatch:
        ids, n, block = (t[c].to_numpy() for c in ("doc_id", "n", "block"))
        sketches = _Sketches(t["sketch"].to_pylist())
        at = np.concatenate([_starts(t), [len(ids)]])
        size = np.diff(at)
        edges: list[tuple[int, int]] = []
        a = at[:-1][size == 2]
        level = np.minimum(sketches.m[a], sketches.m[a + 1])
        a, level = (x[np.maximum(sketches.m[a], sketches.m[a + 1]) <= 2 * level] for x in (a, level))  # else too unequal to be linked
        for m in np.unique(level).tolist():
            for part in np.array_split(a[level == m], max(1, int((level == m).sum() * m // 4_000_000))):
                near = part[_within(sketches.at(part, m), sketches.at(part + 1, m), n[part], n[part + 1], plan)]
                edges += zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True)
        for lo, hi in zip(at[:-1][size > 2], at[1:][size > 2], strict=True):
            edges += meeting(ids[lo:hi], n[lo:hi], block[lo:hi], _Sketches(sketches.raw[lo:hi]))
        found = np.unique(np.array(edges, np.int64).reshape(-1, 2), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def meeting(ids: np.ndarray, n: np.ndarray, block: np.ndarray, sketches: _Sketches) -> list[tuple[int, int]]:
        two = block[0] != block[-1]
        left = int(np.searchsorted(block, block[-1])) if two else len(ids)
        levels = {}
        for m in np.unique(sketches.m).tolist():
            rows = np.flatnonzero((sketches.m == m) | (sketches.m == 2 * m))
            levels[m] = rows, sketches.at(rows, m)

        def partners(i: int, part: np.ndarray) -> np.ndarray:
            found = [np.zeros(0, np.int64)]
            for m in (int(sketches.m[i]) // 2, int(sketches.m[i])):
                if m in levels:
                    rows, (key, count) = levels[m]
                    own = int(np.searchsorted(rows, i))
                    cut = int(np.searchsorted(rows, left if two else i + 1))
                    js = rows[:cut] if two and i >= left else rows[cut:]
                    js = js[part[js] != part[i]]
                    # At half the fragments only with those that have no more.
                    js = js[sketches.m[js] == m] if m < sketches.m[i] else js
                    p = np.searchsorted(rows, js)
                    found.append(js[_within((key[own : own + 1], count[own : own + 1]), (key[p], count[p]), n[i], n[js], plan)])
            return np.concatenate(found)

        # Rows of both blocks by turns: what one has joined need not be told by those of the other.
        turns = np.arange(min(left, len(ids) - left))
        return _forest(ids, partners, np.stack([turns, left + turns], 1).ravel().tolist() if two else range(left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(_starts(t)[-1])  # the last meeting may go on in the next batch
            if last:
                yield settle(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield settle(held)

    return run


def _starts(t: pa.Table) -> np.ndarray:
    """First row of every meeting."""
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([np.diff(t[c].to_numpy()) != 0 for c in ("sig", "lo", "hi")], axis=0)
    return np.flatnonzero(new)


#: Ranges of the n-gram order that are counted one after the other.
FRAGMENTS = 16


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` sets (with each other if None).

    Each fragment of the n-gram order is counted by itself; the partial counts are summed per pair.
    """
    sets = left if right is None else left + right
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets)
    part = _ranges(flat, FRAGMENTS)
    out = np.zeros((len(left), len(left) if right is None else len(right)), np.int64)
    for f in range(FRAGMENTS):
        here = np.flatnonzero(part == f)
        value, at = np.unique(flat[here], return_inverse=True)
        common = np.flatnonzero(np.bincount(at, minlength=len(value)) > 1)  # an n-gram of one set only adds nothing
        place = np.full(len(value), -1)
        place[common] = np.arange(len(common))
        who, at = owner[here][place[at] >= 0], place[at][place[at] >= 0]
        for lo in range(0, len(common), 4096):
            one = (at >= lo) & (at < lo + 4096)
            held = np.zeros((len(sets), min(4096, len(common) - lo)), np.float32)
            held[who[one], at[one] - lo] = 1
            out += np.rint(held @ held.T if right is None else held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def _exact(plan: _Plan):
    """A whole small cluster: forest of its links."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids = group["doc_id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        if len(ids) == 2:
            overlap = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return _edges_table([(int(ids[0]), int(ids[1]))] if overlap >= plan.need(n[0], n[1]) else [])
        overlap = _overlaps(sets)

        def partners(i: int, part: np.ndarray) -> np.ndarray:
            return i + 1 + np.flatnonzero(overlap[i, i + 1 :] >= plan.need(n[i + 1 :], n[i]))

        return _edges_table(_forest(ids, partners, range(len(ids))))

    return run


def _to_pivots(plan: _Plan):
    """A block of a large cluster and the cluster's pivots: the similarity of every row to each, and the first pivot it is linked with."""

    def run(key, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        ids = rows["doc_id"].to_numpy() if rows.num_rows else np.zeros(0, np.int64)
        kinds = pa.schema([("doc_id", pa.int64()), ("grp", pa.int64()), ("near", pa.int64()), ("far", pa.list_(pa.float64()))])
        if not len(ids):
            return pa.Table.from_pylist([], kinds)
        pivots = pivots.sort_by([("_doc_id", "ascending"), ("_grams", "ascending")])
        own, other = ([np.frombuffer(x, np.uint64) for x in c.to_pylist()] for c in (rows["grams"], pivots["_grams"]))
        n, m = (np.array([len(x) for x in z], np.int64) for z in (own, other))
        overlap = _overlaps(own, other)
        linked = overlap >= plan.need(n[:, None], m[None, :])
        near = np.where(linked.any(1), pivots["_doc_id"].to_numpy()[linked.argmax(1)], ids)
        far = 1 - overlap / (n[:, None] + m[None, :] - overlap)
        return pa.Table.from_arrays([pa.array(ids), rows["grp"].combine_chunks(), pa.array(near), pa.array(list(far), pa.list_(pa.float64()))], schema=kinds)

    return run


def _rest(plan: _Plan):
    """Rows of the smaller parts of a cluster and a block of all: forest of the links between different parts."""
    widest = 1 - plan.num / plan.den + 1e-9

    def run(key, rows: pa.Table, others: pa.Table) -> pa.Table:
        once: dict[tuple[int, int], tuple[int, int]] = {}  # one link joins two parts as well as many
        if rows.num_rows and others.num_rows:
            (a, part_a, far_a, sets_a), (b, part_b, far_b, sets_b) = ((t[f"{u}doc_id"].to_numpy(), t[f"{u}part"].to_numpy(), np.array(t[f"{u}far"].to_pylist()), [np.frombuffer(x, np.uint64) for x in t[f"{u}grams"].to_pylist()]) for t, u in ((rows, ""), (others, "_")))
            n_b = np.array([len(x) for x in sets_b], np.int64)
            for i in range(len(a)):
                open_ = np.flatnonzero((part_b != part_a[i]) & (np.abs(far_b - far_a[i]).max(1) <= widest))
                if len(open_):
                    overlap = _overlaps([sets_a[i]], [sets_b[j] for j in open_])[0]
                    for j in open_[overlap >= plan.need(n_b[open_], len(sets_a[i]))]:
                        once[int(part_a[i]), int(part_b[j])] = int(a[i]), int(b[j])
        return _edges_table(list(once.values()))

    return run


def _sets(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                texts = [(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
                found = [ngram_set((t.lower() if lower else t).split(), k).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], names=["doc_id", "grp", "grams"])

    return run


def _block(ids: str, n: Column) -> Column:
    """Number of the block of a row when its group is cut into ``n``."""
    return F.floor(F.pmod(F.xxhash64(ids, F.lit(7)), F.lit(1 << 20)) * n / (1 << 20)).cast("int")


def _meetings(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, s1, _n): sets that agree in a fragment, ``_n`` of them; and the table that this reads.

    The rows of a signature are ordered and counted where they are; they hold two
    numbers each.  Near copies agree in most of their fragments: of the signatures
    with the same members only one is kept.
    """
    by = Window.partitionBy("sig")
    rows = sets.select("s1", "sigs").mapInArrow(_explode_signatures, "sig long, s1 long")
    rows = rows.withColumn("_n", F.count("*").over(by)).where("_n > 1").select("sig", "s1").dropDuplicates(["sig", "s1"])
    members = {f"_h{i}": F.bit_xor(F.xxhash64("s1", F.lit(i))).over(by) for i in (1, 2)}
    rows = materialize(rows.withColumns({"_n": F.count("*").over(by), **members}).where("_n > 1"), "meetings")
    first = rows.groupBy("_n", *members).agg(F.min("sig").alias("sig")).select("sig")
    return rows.join(first.hint("merge"), "sig", "left_semi").drop(*members), rows


def _block_pairs(rows: DataFrame, size: int) -> DataFrame:
    """Cuts the ``_n`` rows of each key into blocks and sends each row to the pairs of its block."""
    blocks = F.ceil(F.col("_n") / size).cast("int")
    paired = rows.withColumn("block", _block("doc_id", blocks)).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
    return paired.withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o")).drop("_o", "_n")


def _renamed(df: DataFrame) -> DataFrame:
    """Columns of their own names, so that a frame can meet another one made from the same rows."""
    return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])


def _rows_or_elements(rows: Column, elements: Column) -> Column:
    """Number of sets, or of sets of ``MEAN_SET`` elements that would hold as much."""
    return F.greatest(rows, F.ceil(elements / MEAN_SET).cast("long"))


def _large_clusters(sets: DataFrame, large: DataFrame, plan: _Plan) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that join what is joined in the clusters ``large(grp, _n)``, and the tables that this reads.

    ``sets`` holds the rows of the clusters.
    """
    blocks = F.ceil(F.col("_n") / SET_BLOCK).cast("int")
    rows = sets.join(large.hint("merge"), "grp").withColumn("block", _block("doc_id", blocks))
    pivot = rows.groupBy("grp", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(PIVOTS))).agg(F.min("doc_id").alias("doc_id")).select("grp", "doc_id")
    pivots = rows.join(pivot, ["grp", "doc_id"]).select("grp", "doc_id", "grams", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    first = rows.select("grp", "block", "doc_id", "grams").groupBy("grp", "block").cogroup(_renamed(pivots).groupBy("_grp", "_block")).applyInArrow(_to_pivots(plan), "doc_id long, grp long, near long, far array<double>")
    first = materialize(first, "pivots")
    joined = first.where("near <> doc_id").select(F.col("doc_id").alias("a"), F.col("near").alias("b"))
    part = connected_components(joined)
    parted = first.join(part.select(F.col("node").alias("doc_id"), F.col("component").alias("part")).hint("merge"), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    pivoted, first = first, materialize(parted, "parts")
    sizes = first.groupBy("grp", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("grp", "main")
    split = first.join(main.hint("merge"), "grp").join(rows.select("grp", "doc_id", "grams", "block", "_n"), ["grp", "doc_id"])
    split = materialize(split.withColumn("other", F.col("part") != F.col("main")), "rest")
    left = split.where("other").withColumn("mine", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)))
    count = split.where("other").groupBy("grp").agg(F.ceil(_rows_or_elements(F.count("*"), F.sum(F.octet_length("grams") / 8)) / SET_BLOCK).cast("int").alias("_left"))
    left = left.join(count.hint("merge"), "grp").withColumn("mine", F.floor(F.col("mine") * F.col("_left") / (1 << 20)).cast("int"))
    left = left.select("grp", "mine", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "doc_id", "part", "far", "grams")
    right = split.join(count.hint("merge"), "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("_left") - 1)).alias("mine"), "block", "doc_id", "part", "far", "grams")
    by = ["grp", "mine", "block"]
    links = joined.unionByName(left.groupBy(*by).cogroup(_renamed(right).groupBy(*[f"_{c}" for c in by])).applyInArrow(_rest(plan), "a long, b long"))
    return links, [pivoted, first, split]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of ``docs``.

    ``class_id`` is the smallest document with an equal set; ``component_id`` the
    smallest reachable by links of Jaccard similarity of at least ``num / den``.
    """
    plan = _Plan(num, den)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = materialize(slim.mapInArrow(_describe(plan, k, lower), "doc_id long, n long, s1 long, s2 long, sigs binary, sketch binary"), "sets")
    known = F.expr("n > 0 and doc_id is not null")
    same = ["s1", "s2", "n"]
    reps = told.where(known).groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.any_value("sketch").alias("sketch"))
    reps = materialize(reps, "classes")
    drawn, meetings = _meetings(told.where(known))
    # Signatures and sketches are many times as large as the rest, so tables go as soon as nothing reads them.
    sizes = materialize(told.select("doc_id", "n", "s1", "s2"), "sizes")
    release(told)
    met = drawn.join(reps.select("s1", F.col("class_id").alias("doc_id"), "n", "sketch"), "s1")
    meeting = ["sig", "lo", "hi"]
    drawn = _block_pairs(met, SKETCH_BLOCK).repartition(*meeting).sortWithinPartitions(*meeting, "block", "doc_id")
    maybe = drawn.select(*meeting, "block", "doc_id", "n", "sketch").mapInArrow(_bounded(plan), "a long, b long").distinct()
    clusters = materialize(connected_components(maybe).select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "clusters")
    sketched, reps = reps, materialize(reps.drop("sketch"), "class-ids")
    release(sketched, meetings)
    # Clusters grow with the input, so this is a shuffle of both sides at every size.
    sets = slim.join(clusters.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"]).select("doc_id", "text", "grp").mapInArrow(_sets(k, lower), "doc_id long, grp long, grams binary")
    counts = clusters.join(reps.select(F.col("class_id").alias("doc_id"), F.col("n").alias("elements")).hint("merge"), "doc_id").groupBy("grp").agg(_rows_or_elements(F.count("*"), F.sum("elements")).alias("_n"))
    large = materialize(counts.where(F.col("_n") > SET_BLOCK), "large")
    done: list[DataFrame] = []
    if large.isEmpty():
        links = sets.groupBy("grp").applyInArrow(_exact(plan), "a long, b long")
    else:
        sets = materialize(sets, "cluster-sets")
        small = sets.join(large.select("grp").hint("merge"), "grp", "left_anti").groupBy("grp").applyInArrow(_exact(plan), "a long, b long")
        links, done = _large_clusters(sets, large, plan)
        links, done = small.unionByName(links), [*done, sets]
    # Texts of one id are one node: it belongs to the classes of all of them.
    pairs = sizes.where(known).join(reps, same).select("doc_id", "class_id").distinct()
    several = pairs.groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").select("doc_id")
    links = links.unionByName(pairs.join(several.hint("merge"), "doc_id").where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    linked = connected_components(links).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    release(*done)  # the components have read the links
    classes = reps.join(linked, "class_id", "left")
    mine = F.col("doc_id").isNotNull()
    return sizes.join(classes, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(mine, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(mine, F.coalesce("component_id", "class_id", "doc_id")).alias("component_id")
    )
