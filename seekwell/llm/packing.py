"""Packing token sequences by bounded-space online best fit.

Pieces of documents arrive in the order of a hash. A fixed number of bins is open; they
are kept by free space, and a bitset has a bit for every amount of free space that some
open bin has. The lowest bit at or above a piece's length is the best fit. If none fits, a
bin is opened; at the limit the fullest, the lowest bit, closes first. Each task packs its
own share of the pieces and holds its open bins only.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import read, task_count, written

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 1024
TOKENIZER = "word_bpe_49k.json"
#: Ids of the pieces that leave a task at once.
SENT = 1_000_000
#: Parts kept by a worker: this many met lately, and as many before them; longer ones are not kept.
_CACHED = 100_000
_LONGEST = 64
#: White space that ``str.split`` or the tokenizer may see otherwise than space, tab and line ends.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile("[^ \t\n\r]+")
#: Letters whose small form is one letter of this range again, and signs that never join them.
_SIGNS = ".,;:!?%$#&*|"
_SIMPLE = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{_SIGNS}]*)")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}


class Learned(dict):
    """A dictionary that finds out what it lacks, and holds ``most`` short keys and the ``most`` before them at the most."""

    def __init__(self, learn: Callable[[str], bytes], most: int) -> None:
        self.learn, self.most = learn, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.learn(key)
        if len(key) <= _LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never looks across it, so the ids of a text are
    those of its parts between spaces. It lowers letters and parts them from signs, so a part
    of simple letters with signs behind has the ids of one word of the model and of the signs.
    All other parts go through the whole tokenizer. Parts met lately are kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.letters = _byte_letters()
        self.known = Learned(self._part, _CACHED)
        self.signs = Learned(self._whole, _CACHED // 10)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = _PLAIN.findall(text) if _ODD.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, parts))

    def _part(self, part: str) -> bytes:
        word = part.rstrip(_SIGNS)
        if word.isascii() and word.isalpha():
            sign, word = part[len(word) :], word.lower()
        elif simple := _SIMPLE.fullmatch(part):
            word, sign = simple.groups()
            word = word.lower().encode().decode("latin-1").translate(self.letters)
        else:
            return self._whole(part)
        id_bytes = self.id_bytes
        return b"".join([id_bytes[t.id] for t in self.word(word)]) + self.signs[sign]

    def _whole(self, part: str) -> bytes:
        id_bytes = self.id_bytes
        return b"".join([id_bytes[i] for i in self.tokenizer.encode(part, add_special_tokens=False).ids])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, so that they share what it has met."""
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to pieces ``(doc_id, piece, start, length, ids_crc32[, ids])``.

    A document's ids end with ``END_ID``; a null or empty text has only that. Longer ones are
    cut every ``capacity`` ids. Repeated rows give repeated pieces. ``path`` names the
    tokenizer's file, which every worker must have; by default the public one's. A task has one
    text as a string at a time, and sends pieces of ``SENT`` ids or more at once.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, waiting = encoder(path or tokenizer_path()), [], 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                doc_id, ids = doc_id.as_py(), encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                    waiting += len(part) // 4
                    if waiting >= SENT:
                        yield sent(rows)
                        rows, waiting = [], 0
        if rows:
            yield sent(rows)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class BestFit:
    """Open bins by free space, at most ``limit`` of them."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin of the next piece, and its offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.limit and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def packed(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int = 1) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    Sequences are gapless from offset 0. Ids hold the task's number in the upper bits. The
    order of arrival is that of a hash of all columns but arrays, so reruns agree; rows that
    are alike in them are interchangeable. An empty table gives an empty table.
    """
    if tasks < 1 or open_bins < 1:
        raise ValueError("at least one task and one open bin are needed")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for pdf in parts:
            placed = np.array([bins.place(n) for n in pdf["length"].tolist()], np.int64).reshape(-1, 2)
            out = pdf.drop(columns="_order")
            out["sequence_id"], out["offset"] = placed[:, 0] + first, placed[:, 1]
            yield out.astype({c: "Int64" for c in out.columns if c == "doc_id"})

    plain = [c for c, kind in pieces.dtypes if not kind.startswith("array")]
    dealt = pieces.withColumn("_order", F.xxhash64(*plain)).repartition(tasks, "_order").sortWithinPartitions("_order", *plain)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInPandas(pack, schema)


def packed_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; a task packs the pieces of about 64 MB of input."""
    tasks = task_count(docs, 64)
    return packed(written(tokenized(docs, path, with_ids=with_ids)), tasks=tasks)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents"))
