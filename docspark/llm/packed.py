"""Chunks of documents as table rows, and questions and answers about their items between chunks and key ranges.

Statistics over all items of a corpus (windows, words) need each item to meet its equals. Instead of one row per item,
a chunk sends to each *slice* (a range of hash values) one blob with its distinct items, sorted and compressed; the
slice's owner looks at the blobs of all chunks and answers each chunk with one blob in the same order. An item that is
very common costs one entry per chunk, not one per occurrence, and slices are equally large as hashes are uniform.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.kernels import CHUNK_BYTES, chunks, give_back, pack, unpack
from docspark.llm.scratch import Scratch

#: Stands for a missing identifier; it is larger than all others.
NO_ID = np.iinfo(np.int64).max
#: Items that a slice's owner holds at once, on average.
SLICE_ITEMS = 1 << 21

CHUNK_SCHEMA = "chunk long, ids binary, sizes binary, words long, body binary"


class Piece:
    """Some whole texts: ids (NO_ID where missing), bytes and offsets."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offs: np.ndarray):
        self.ids, self.data, self.offs = ids, data, offs


class Chunk(Piece):
    """One row of a chunk table."""

    def __init__(self, row: dict):
        self.key = row["chunk"]
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        super().__init__(unpack(row["ids"], np.int64), data, np.concatenate([[0], np.cumsum(unpack(row["sizes"], np.int64))]))

    def pieces(self, size: int = CHUNK_BYTES) -> Iterator[Piece]:
        """The texts in pieces of about `size` bytes, for work that holds much more than the texts."""
        at = 0
        while at < len(self.ids):
            to = max(at + 1, int(np.searchsorted(self.offs, self.offs[at] + size, "right")) - 1)
            yield Piece(self.ids[at:to], self.data[self.offs[at] : self.offs[to]], self.offs[at : to + 1] - self.offs[at])
            at = to


def chunk_table(docs: DataFrame, scratch: Scratch, count: Callable, name: str = "chunks", size: int = CHUNK_BYTES) -> DataFrame:
    """Writes (id long, text string) as a table with a row per chunk of about `size` bytes; `words` has the sum of
    count(bytes, offsets) over parts of it.

    A chunk's key is the task and its place there; it is read back from the written table and never computed again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32

        def row(parts: list[tuple]) -> pa.RecordBatch:
            ids, sizes, counts, bodies = zip(*parts)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            cells = [key, pack(np.concatenate(ids)), pack(np.concatenate(sizes)), sum(counts), body]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))], names=["chunk", "ids", "sizes", "words", "body"])

        parts, held = [], 0
        for batch in batches:
            for rows, data, offs in chunks(batch, size=min(size, CHUNK_BYTES)):
                if parts and held + len(data) > size:
                    yield row(parts)
                    parts, held, key = [], 0, key + 1
                ids = rows.column("id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
                parts.append((ids, np.diff(offs).astype(np.int64), int(count(data, offs)), data.tobytes()))
                held += len(data)
        if parts:
            yield row(parts)
        give_back()

    return scratch.table(docs.select("id", "text").mapInArrow(run, CHUNK_SCHEMA), name)


def slice_bits(items: int) -> int:
    """Leading bits of a hash that name its slice."""
    return max(4, ceil(log2(max(2, items / SLICE_ITEMS))))


def cuts(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the slices in ascending 64-bit hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def send(chunk_rows: DataFrame, split: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs `split` on every chunk row; it yields tuples of `schema`, which are sent together per chunk."""
    names = [part.split()[0] for part in schema.split(",")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            if cells := list(split(row)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], names=names)
            give_back()

    return chunk_rows.mapInArrow(run, schema)


def answers(replies: DataFrame, name: str) -> DataFrame:
    """(chunk, name) with all answer cells of a chunk, one per slice; a chunk is bounded, and so are its answers."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct(*(c for c in replies.columns if c != "chunk"))).alias(name))


def by_slice(cells: list | None, field: str = "blob") -> list[bytes]:
    """A field of the answers in the order of their slices, which is the order of hashes."""
    return [c[field] for c in sorted(cells or (), key=lambda c: c["slice"])]
