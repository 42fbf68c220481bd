"""N-best segmentation over a SentencePiece vocabulary, and decoding.

A forward Viterbi pass gives the best score of every prefix of a unit; these are
exact heuristics for an A* search from the end, which therefore yields whole
segmentations in order of score.  Units are maximal runs that no piece of the
vocabulary crosses (pieces hold the space mark only in front, and never mix letters
with other characters; both are checked when the model is loaded, else a unit is
the longest run that is safe).  Units are independent, so the best ``n``
segmentations of a text combine the best ``n`` of its units in order of score loss,
and only the ``n - 1`` units with the smallest first loss can take part.

The forward pass runs over all new units of some hundred texts at once.  A second
pass from the ends gives the best path through every arc; the best one that leaves
the Viterbi path is the unit's second best score.  So the first loss of every unit
is known without a search, and A* only runs for units that take part in a text.

Scores are those of the model file, as doubles.  Characters without a piece fall
back to their bytes, each at ``UNKNOWN_LOSS`` below the smallest proper score.
Of equal scores the one whose last piece is longest comes first, then the one before it, and so on.  Texts are encoded as
the model file says: a space mark in front, spaces turned to marks, nothing removed.

Defined cases: null text is empty, and the empty text has one segmentation without
pieces; fewer than ``n`` segmentations are all returned; repeated rows are encoded
each; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
N_BEST = 3
UNKNOWN_LOSS = 10.0
#: Longer units are searched one by one.
LONGEST_JOINT = 48
_STEP, _SPREAD, _ALL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), (1 << 64) - 1


class PieceLattice:
    """The vocabulary of a model file and cached n-best lists of its units."""

    most = 300_000

    def __init__(self, path: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        self.text_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text_of.append(b"")
            else:
                self.pieces[piece] = (float(model.get_score(i)), i)
                self.text_of.append(piece.replace(MARK, " ").encode())
        proper = [s for s, _ in self.pieces.values() if s > -1e8]
        self.byte_score = (min(proper) if proper else 0.0) - UNKNOWN_LOSS
        # Every prefix of a piece is a key, so a search stops where no longer piece can follow.
        self.trie: dict[str, tuple[float, int] | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.trie.update(self.pieces)
        body = [p.lstrip(MARK) for p in self.pieces]
        marked = not any(MARK in b for b in body)
        mixed = any(any(map(_is_letter, b)) and not all(map(_is_letter, b)) for b in body)
        run = rf"{MARK}+[^{MARK}]*|[^{MARK}]+" if marked else r"(?s).+"
        self.units = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}+(?:[^{MARK}\w]|[\d_])*|(?:[^{MARK}\w]|[\d_])+" if marked and not mixed else run)
        self._hash_pieces()
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.unit: list[str] = []
        self.best: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        self.first, self.loss = np.zeros(1024), np.full(1024, np.inf)
        self.size, self.start, self.whole = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.flat, self.used = np.zeros(8192, np.int32), 0

    def _hash_pieces(self) -> None:
        """Every prefix of a piece by a 64-bit hash: slots of an open table with number of the piece (-1: only a prefix) and score."""
        keys = list(self.trie)
        h = np.array([_rolled(k) for k in keys], np.uint64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.piece, self.score = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32), np.full(1 << bits, -np.inf)
        for k, x in zip(keys, h.tolist(), strict=True):
            at = ((x * int(_SPREAD)) & _ALL) >> int(self.shift)
            while self.piece[at] != -2:
                at = (at + 1) & ((1 << bits) - 1)
            found = self.trie[k]
            self.slots[at], self.piece[at] = x, -1 if found is None else found[1]
            if found is not None:
                self.score[at] = found[0]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, score) of every hash; piece -2 where nothing begins like that."""
        at = ((h * _SPREAD) >> self.shift).astype(np.int64)
        out = self.piece[at]
        open_ = np.flatnonzero((self.slots[at] != h) & (out != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            out[open_] = self.piece[at[open_]]
            open_ = open_[(self.slots[at[open_]] != h[open_]) & (out[open_] != -2)]
        return out, self.score[at]

    def segment(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        """The best ``n`` (score, ids) of one unit, best first."""
        size, trie = len(unit), self.trie
        forward = [0.0] + [-np.inf] * size
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            base = forward[i]
            single = False
            for j in range(i + 1, size + 1):
                found = trie.get(unit[i:j], 0)
                if found == 0:
                    break
                if found is not None:
                    single = single or j == i + 1
                    into[j].append((i, found[0], (found[1],)))
                    if base + found[0] > forward[j]:
                        forward[j] = base + found[0]
            if not single:
                ids = tuple(self.bytes[b] for b in unit[i].encode())
                score = self.byte_score * len(ids)
                into[i + 1].append((i, score, ids))
                if base + score > forward[i + 1]:
                    forward[i + 1] = base + score
        out: list[tuple[float, tuple[int, ...]]] = []
        # (negative of exact total, place, order of arrival, score from here to the end, arcs from here to the end)
        heap: list[tuple] = [(-forward[size], size, 0, 0.0, None)]
        # Open hypotheses stand for disjoint sets of segmentations, so one below the n-th best total cannot be needed.
        best, made, n = [-forward[size]], 0, self.n
        while heap and len(out) < n:
            total, place, _, score, tail = heapq.heappop(heap)
            if place == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((score, tuple(ids)))
                continue
            if total in best:
                best.remove(total)
            for i, s, own in into[place]:
                f = -(forward[i] + score + s)
                if len(best) < n or f <= best[-1]:
                    insort(best, f)
                    del best[n:]
                    made += 1
                    heapq.heappush(heap, (f, i, made, score + s, (own, tail)))
        return out

    def add(self, units: list[str]) -> None:
        """Best segmentation and first loss of new units."""
        k = len(self.unit)
        self.unit += units
        self.at.update(zip(units, range(k, k + len(units)), strict=True))
        while len(self.first) < len(self.unit):
            self.first, self.loss, self.size, self.start, self.whole = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.loss, self.size, self.start, self.whole))
        length = np.fromiter(map(len, units), np.int64, len(units))
        joint = np.flatnonzero(length <= LONGEST_JOINT)
        left = [np.setdiff1d(np.arange(len(units)), joint)]
        if len(joint):
            done, first, loss, sizes, ids = self._viterbi([units[i] for i in joint], length[joint])
            n = k + joint[done]
            self.first[n], self.loss[n], self.size[n], self.whole[n] = first, loss, sizes, True
            self.start[n] = self.used + np.cumsum(sizes) - sizes
            self._keep(ids)
            left.append(np.delete(joint, done))
        for i in np.concatenate(left).tolist():  # long units, and those with characters that fall back to bytes
            found = self.best[k + i] = self.segment(units[i])
            self.first[k + i], self.size[k + i], self.start[k + i] = found[0][0], len(found[0][1]), self.used
            self._keep(np.array(found[0][1], np.int32))
            self.loss[k + i] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
            back = units[i].replace(MARK, " ").encode()
            self.whole[k + i] = all(b"".join(map(self.text_of.__getitem__, x)) == back for _, x in found)

    def _keep(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _viterbi(self, units: list[str], length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the units that need no bytes: (number, best score, loss of the second best, pieces of the best, their ids)."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(units)), length)
        end = np.repeat(begin + length, length)
        # Arcs: a piece from each place, one more character in every turn, as long as some piece goes on.
        arcs, at, h = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        single = np.zeros(len(codes), bool)
        n = 0
        while len(at):
            h = h * _STEP + codes[at + n] + np.uint64(1)
            n += 1
            piece, score = self._find(h)
            here = piece >= 0
            arcs.append((at[here], np.full(int(here.sum()), n), piece[here], score[here]))
            if n == 1:
                single[at[here]] = True
            more = (piece != -2) & (at + n < end[at])
            at, h = at[more], h[more]
        fine = np.ones(len(units), bool)
        fine[owner[~single]] = False
        i, size, piece, score = (np.concatenate(x) for x in zip(*arcs, strict=True))
        keep = fine[owner[i]]
        i, size, piece, score = i[keep], size[keep], piece[keep], score[keep]
        # A node for every place and one for the end of every unit.
        i = i + owner[i]
        j = i + size
        unit = np.repeat(np.arange(len(units)), length + 1)
        zero = begin + np.arange(len(units))
        last = zero + length
        forward, back = np.full(len(unit), -np.inf), np.full(len(unit), -np.inf)
        forward[zero], back[last] = 0.0, 0.0
        into = np.full(len(unit), -1)
        local = np.arange(len(unit)) - zero[unit]

        def passes(node: np.ndarray, other: np.ndarray, depth: np.ndarray, best: np.ndarray, take) -> None:
            order = np.lexsort((i, node, depth))
            turn = np.flatnonzero(np.diff(depth[order], prepend=-1))
            for lo, hi in zip(turn, [*turn[1:], len(order)], strict=True):
                a = order[lo:hi]
                total = best[other[a]] + score[a]
                at = np.flatnonzero(np.diff(node[a], prepend=-1))
                most = np.maximum.reduceat(total, at)
                best[node[a[at]]] = most
                if take is not None:
                    equal = np.flatnonzero(total == np.repeat(most, np.diff(np.append(at, len(a)))))
                    first = equal[np.diff(node[a[equal]], prepend=-1) != 0]
                    take[node[a[first]]] = a[first]

        passes(j, i, local[j], forward, into)
        passes(i, j, (last[unit[i]] - i), back, None)
        done = np.flatnonzero(fine)
        on_path = np.zeros(len(i), bool)
        steps, place = [], last[done]
        while len(place):
            arc = into[place]
            on_path[arc] = True
            steps.append(arc)
            place = i[arc]
            place = place[local[place] > 0]
        path = np.sort(np.concatenate(steps)) if steps else np.zeros(0, np.int64)
        path = path[np.argsort(i[path], kind="stable")]
        sizes = np.bincount(unit[i[path]], minlength=len(units))[done]
        best = forward[last]
        off = ~on_path
        second = np.full(len(units), -np.inf)
        np.maximum.at(second, unit[i[off]], (forward[i] + score + back[j])[off])
        return done, best[done], best[done] - second[done], sizes, piece[path]

    def alternatives(self, k: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best ``n`` of unit ``k``, the one in ``flat`` first."""
        found = self.best.get(k)
        if found is None:
            own = tuple(self.flat[self.start[k] : self.start[k] + self.size[k]].tolist())
            found = [(float(self.first[k]), own), *(x for x in self.segment(self.unit[k]) if x[1] != own)][: self.n]
            self.best[k] = found
        return found

    def texts(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray, bool]]]:
        """The best ``n`` (score, ids, decodes to the text) of every text."""
        if len(self.unit) > self.most:
            self._clear()
        cut = [self.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = dict.fromkeys(u for c in cut for u in c if u not in self.at)
        if new:
            self.add(list(new))
        return (self._text(t, c) for t, c in zip(texts, cut, strict=True))

    def text(self, text: str) -> list[tuple[float, np.ndarray, bool]]:
        return next(self.texts([text]))

    def _text(self, text: str, units: list[str]) -> list[tuple[float, np.ndarray, bool]]:
        if not text:
            return [(0.0, np.zeros(0, np.int32), True)]
        k = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        ends = np.cumsum(self.size[k])
        base = self.flat[np.repeat(self.start[k] - ends + self.size[k], self.size[k]) + np.arange(ends[-1])]
        # A mark in the text itself decodes to a space.
        total, whole = float(self.first[k].sum()), bool(self.whole[k].all()) and MARK not in text
        out = [(total, base, whole)]
        if self.n == 1:
            return out
        loss = self.loss[k]
        few = np.argsort(loss, kind="stable")[: self.n - 1] if len(k) <= 64 else None
        if few is None:
            small = np.argpartition(loss, min(4 * self.n, len(k) - 1))[: 4 * self.n]
            edge = np.partition(loss, self.n - 1)[self.n - 1]
            small = np.flatnonzero(loss <= edge) if np.isfinite(edge) else small
            few = small[np.lexsort((small, loss[small]))][: self.n - 1]
        few = np.sort(few[np.isfinite(loss[few])])
        for lost, choice in self._combine([self.alternatives(int(k[i])) for i in few])[1:]:
            parts, last = [], 0
            for i, c in zip(few, choice, strict=True):
                if c:
                    parts += [base[last : ends[i] - self.size[k[i]]], np.array(self.best[int(k[i])][c][1], np.int32)]
                    last = ends[i]
            out.append((total - lost, np.concatenate([*parts, base[last:]]), whole))
        return out

    def _combine(self, lists: list[list[tuple[float, tuple[int, ...]]]]) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` choices of one entry from every list with the smallest summed losses."""
        start = (0,) * len(lists)
        heap, seen, out = [(0.0, start)], {start}, []
        while heap and len(out) < self.n:
            lost, choice = heapq.heappop(heap)
            out.append((lost, choice))
            for i, options in enumerate(lists):
                if choice[i] + 1 < len(options):
                    nxt = (*choice[:i], choice[i] + 1, *choice[i + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (sum(o[0][0] - o[c][0] for o, c in zip(lists, nxt, strict=True)), nxt))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _rolled(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_STEP) + ord(c) + 1) & _ALL
    return h


def _is_letter(c: str) -> bool:
    return c.isalpha()


_lattices: dict[tuple[str, int], PieceLattice] = {}


def lattice(path: str, n: int) -> PieceLattice:
    if (path, n) not in _lattices:
        _lattices[path, n] = PieceLattice(path, n)
    return _lattices[path, n]


def _encode(path: str, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, n)
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                b = batch.slice(part, 500)
                rows = []
                texts = [t or "" for t in b.column(1).to_pylist()]
                for doc, found in zip(b.column(0).to_pylist(), model.texts(texts), strict=True):
                    for rank, (score, ids, whole) in enumerate(found, 1):
                        rows.append((doc, rank, score, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, ids if with_ids else None))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids"])

    return run


def encode_nbest(docs: DataFrame, model: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids_crc32, round_trip[, ids]); one row per segmentation.

    ``round_trip`` tells that decoding the ids gives the text back.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(_encode(model, n, with_ids), "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>")
    return out if with_ids else out.drop("ids")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, 1)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null arrays stay null."""
    slim = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(_decode(model), "doc_id long, text string")
