"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokenising writes one small row for each piece to the shared folder; packing then deals pieces by
hash and row number, so that repeated rows part, to as many tasks as there are ``TASK_SEQUENCES`` sequences of tokens. Each task packs its
pieces as they come with a fixed number of open bins: a bitset over free space finds the bin that a
piece fits best in one shift; when all bins are open and none fits, the fullest is closed.

Defined results: null and empty texts are the one end id; documents longer than a sequence are cut
into whole sequences and a rest; repeated rows are packed each; an empty table gives no rows; extra
columns are dropped; a null doc_id stays null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shipped, stored, table

LENGTH = 4096  #: tokens of a sequence
END = 1  #: id after each document
OPEN_BINS = 256  #: bins that a task holds open
TASK_SEQUENCES = 20_000  #: sequences' worth of tokens that one packing task gets
MEMO, MEMO_CHARS = 250_000, 64  #: entries of either memo of a worker, and how long their keys may be


class WordIds:
    """The ids that a word-level byte BPE of the tokenizers library gives, as little-endian uint32.

    Its pre-tokenizer drops white space and no merge crosses a word, so ids are those of the parts
    between white space, which recur. Parts in plain Latin letters, digits and ASCII signs are cut
    into words by the pre-tokenizer's own rule; anything else goes to the library whole."""

    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    _ODD_SPACE = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        # the byte-level alphabet: printable Latin-1 as it is, the other bytes from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.alphabet = "".join(chr(b) if b in keep else chr(next(spare)) for b in range(256))
        probe = "It's THE naïve Çase's 2024!!! o'clock'd ▁x"
        self.direct = all(self._word(w) == self.whole(w) for w in ["straße", "don't", "ÇA", "café.", "a1b2", "'s", "***"] for w in self._WORDS.findall(w.lower()))
        if self(probe) != self.whole(probe):
            raise ValueError("this tokenizer is not made of words")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
        return np.array([t.id for t in self.library.model.tokenize(mapped)], "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not self._PLAIN.fullmatch(part) or "<|" in part:
            return self.whole(part)
        words, found = self.words, []
        for word in self._WORDS.findall(part.lower()):
            ids = words.get(word)
            if ids is None:
                ids = self._word(word) if self.direct else self.whole(word)
                if len(word) <= MEMO_CHARS:
                    if len(words) >= MEMO:
                        words.clear()
                    words[word] = ids
            found.append(ids)
        return b"".join(found)

    def __call__(self, text: str) -> bytes:
        if self._ODD_SPACE.search(text):
            return self.whole(text)
        parts, get = self.parts, self.parts.get
        found = text.split()
        out = [get(p) for p in found]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    ids = get(found[i])
                    if ids is None:
                        ids = self._part(found[i])
                        if len(found[i]) <= MEMO_CHARS:
                            if len(parts) >= MEMO:
                                parts.clear()
                            parts[found[i]] = ids
                    out[i] = ids
        return b"".join(out)


_IDS: dict[str, WordIds] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """A row of PIECES for each piece of each document."""
    shipped(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _IDS:
            _IDS[tokenizer] = WordIds(tokenizer)
        ids_of, last = _IDS[tokenizer], np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + last
                step = 4 * length
                rows += [(doc, i, at // 4, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step])) for i, at in enumerate(range(0, len(ids), step))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(cut, PIECES)


class BestFit:
    """Bounded-space online best fit. place() gives (bin, offset)."""

    def __init__(self, length: int, bins: int):
        self.length, self.bins, self.next = length, bins, 0
        self.free = 0  # bit f is set where an open bin has f places left
        self.open: dict[int, list[int]] = {}
        self.count = 0

    def _take(self, free: int) -> int:
        at = self.open[free]
        bin_ = at.pop()
        if not at:
            del self.open[free]
            self.free &= ~(1 << free)
        self.count -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            bin_, free = self.next, self.length
            self.next += 1
        left = free - size
        if left:
            self.open.setdefault(left, []).append(bin_)
            self.free |= 1 << left
            self.count += 1
        return bin_, self.length - free


def pack(cut: DataFrame, tokens: int, length: int = LENGTH, bins: int = OPEN_BINS, task_sequences: int = TASK_SEQUENCES) -> DataFrame:
    """PACKED rows; tokens is the sum of cut's lengths."""
    tasks = max(1, -(-tokens // (length * task_sequences)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = BestFit(length, bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(3).to_pylist()]
            kinds = zip(zip(*placed) if placed else [()] * 2, (base, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([x + more for x in c], pa.int64()) for c, more in kinds)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # an order that has nothing to do with lengths; rows that are equal are dealt by their number
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    columns = [*cut.columns, "__number"]
    numbered = cut.select(*cut.columns, F.monotonically_increasing_id().alias("__number"))
    dealt = numbered.repartition(tasks, order, "__number") if tasks > 1 else numbered.repartition(1)
    return dealt.sortWithinPartitions(order, *columns).mapInArrow(fill, PACKED)


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    cut = stored(pieces(docs, tokenizer, id_col, text_col, length), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    return pack(cut, tokens, length)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


ORACLES = {}
QUERIES = {"op8_packing": op8_packing}
