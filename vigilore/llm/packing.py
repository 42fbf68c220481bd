"""Vector bin packing of token sequences by the dot-product heuristic.

Every example is a vector (tokens, segments, loss-bearing tokens).  A sequence is
open at a time; of the waiting examples that fit under all limits at once it takes
the one whose vector has the largest dot product with what is left of the limits
(both as shares of the limits), so large examples go first and the scarcest limit
weighs least.  Examples wait in a window of bounded size.

``pack_documents`` may cut: when nothing waiting fits, the longest waiting text is
cut to fill the sequence.  What a partition has left at its end is packed into
sequences whose lengths are powers of two, so padding only comes from the segment
limit.  Work stays inside the partitions of the input: there is no shuffle, hence
no hot key, and a lost task is repeated with the same outcome as long as its
partition is read in the same order (a scan of files).

Defined cases: null text is empty, which still has its end id; a null document id
is packed like any other; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
MAX_LOSS = 2048
END_ID = 1
#: Examples that wait in a task before a sequence is filled, and ids they may hold.
WAITING = 256
WAITING_IDS = 4_000_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _WordIds(dict):
    """Cache from a word to its ids (as bytes of 32-bit integers), for a tokenizer that never joins words across ASCII white space.

    A word of letters below U+0250 that is in composed form is one piece for the
    tokenizer's splitting rule, so it goes to its merges directly; every other word
    takes the tokenizer's whole path.  Words with a full stop or comma behind them
    are put together from their two parts and not kept.
    """

    most = 400_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.ends = {c: self._encode(c.decode()) for c in (b".", b",")}

    def _encode(self, word: str) -> bytes:
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1:] in self.ends and word[-2:-1].isalnum():
            return self[word[:-1]] + self.ends[word[-1:]]
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            shown = text.lower()
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(self.letters)
            value = array("i", [t.id for t in self.merges.tokenize(shown)]).tobytes()
        else:
            value = self._encode(text)
        self[word] = value
        return value


_ids: dict[str, _WordIds] = {}


def token_ids(text: bytes, path: str) -> np.ndarray:
    """Ids of a text.  Lower-casing first only saves cache entries: the tokenizer lower-cases itself,
    except in its special tokens, so texts with ``<|`` are left as they are."""
    cache = _ids.get(path)
    if cache is None:
        cache = _ids[path] = _WordIds(path)
    words = (text if b"<|" in text else text.lower()).split()
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32)


def _best(need: np.ndarray, left: np.ndarray, limits: np.ndarray) -> int:
    """Index of the row of ``need`` that fits ``left`` with the largest dot product, -1 if none fits."""
    fits = (need <= left).all(1)
    if not fits.any():
        return -1
    return int(np.argmax(np.where(fits, (need / limits) @ (left / limits), -1.0)))


class _Packer:
    """Waiting examples and the sequences they are put into; ``emit(example, start, length, sequence, offset)``."""

    def __init__(self, limits: tuple[int, int, int], emit):
        self.limits, self.emit = np.array(limits, np.int64), emit
        self.items: list[tuple[object, int]] = []  # example, ids already placed
        self.need = np.zeros((0, 3), np.int64)
        self.sequence = 0

    def add(self, example: object, length: int) -> None:
        top = int(min(self.limits[0], self.limits[2] + 1))
        start = 0
        while length - start > top:  # whole sequences of their own
            self.emit(example, start, top, self.sequence, 0)
            self.sequence += 1
            start += top
        self.items.append((example, start))
        self.need = np.vstack([self.need, [[length - start, 1, length - start - 1]]])

    def _take(self, i: int, length: int, offset: int) -> None:
        example, start = self.items[i]
        self.emit(example, start, length, self.sequence, offset)
        if length == self.need[i, 0]:
            self.items[i] = self.items[-1]
            self.need[i] = self.need[-1]
            self.items.pop()
            self.need = self.need[:-1]
        else:
            self.items[i] = (example, start + length)
            self.need[i] -= [length, 0, length]

    def fill(self) -> None:
        """One sequence."""
        total = int(self.need[:, 0].sum())
        left = self.limits.copy()
        if total < left[0]:
            left[0] = 1 << (total.bit_length() - 1)
        offset = 0
        while left.min() > 0 and self.items:
            last = left[1] == 1 and self.need[:, 0].max() >= left[0]
            i = -1 if last else _best(self.need, left, self.limits)
            length = int(self.need[i, 0]) if i >= 0 else 0
            if i < 0:
                i = int(np.argmax(self.need[:, 0]))
                length = int(min(left[0], left[2] + 1, self.need[i, 0]))
            self._take(i, length, offset)
            offset += length
            left -= [length, 1, length - 1]
        self.sequence += 1


def _documents(path: str, limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def emit(example, start, length, sequence, offset):
            doc, ids = example
            rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), first + sequence, offset))

        def out():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        packer = _Packer(limits, emit)
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = np.append(token_ids(text.as_py() or b"", path), np.int32(END_ID)).astype("<u4")
                packer.add((doc, ids), len(ids))
                held += len(ids)
                if len(packer.items) >= WAITING or held >= WAITING_IDS:
                    while len(packer.items) > WAITING // 2 or (held >= WAITING_IDS and len(packer.items) > 1):
                        packer.fill()
                    held = sum(len(e[1]) for e, _ in packer.items)
                if len(rows) >= 10_000:
                    yield out()
        while packer.items:
            packer.fill()
        if rows:
            yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS) -> DataFrame:
    """Pieces of all texts placed in sequences; ``tokenizer`` is the path of a tokenizers file.

    A piece's first token has nothing to be predicted from, so its loss-bearing
    tokens are one fewer than its tokens.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return slim.mapInArrow(_documents(tokenizer, (max_tokens, max_segments, max_loss)), schema)


def _whole(limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence = TaskContext.get().partitionId() << 40, 0
        top = np.array(limits, np.int64)
        ids: list = []
        need = np.zeros((0, 3), np.int64)

        def fill():
            nonlocal sequence, need
            left, offset, rows = top.copy(), 0, []
            while (i := _best(need, left, top)) >= 0:
                rows.append((ids[i], first + sequence, offset, False))
                left = left - need[i]
                offset += int(need[i, 0])
                ids[i] = ids[-1]
                ids.pop()
                need[i] = need[-1]
                need = need[:-1]
            sequence += 1
            return rows

        def table(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "sequence_id", "offset", "too_large"])

        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3)], 1).astype(np.int64)
            for example, row in zip(batch.column(0).to_pylist(), own, strict=True):
                if (row > top).any():  # told apart, never dropped: it cannot share a sequence
                    yield table([(example, first + sequence, 0, True)])
                    sequence += 1
                    continue
                ids.append(example)
                need = np.vstack([need, row])
                if len(ids) >= WAITING:
                    yield table(fill())
        while ids:
            yield table(fill())

    return run


def pack_examples(examples: DataFrame, id_col: str, tokens: str, segments: str, loss: str, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """Instruction data that may not be cut: (id, sequence_id, offset, too_large).

    An example beyond a limit gets a sequence of its own and ``too_large``; nulls
    in the three counts are zero.
    """
    slim = examples.select(F.col(id_col).cast("string").alias("id"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"v{i}") for i, c in enumerate((tokens, segments, loss))])
    return slim.mapInArrow(_whole(limits), "id string, sequence_id long, offset long, too_large boolean")
