"""Repeated passages: a count-min prefilter over all word windows, then exact grouping of those estimated repeated.

First pass: each chunk of documents adds its distinct windows to count-min rows. The rows are as wide as the corpus asks
for (four cells per window), so a chunk's share is sparse; it is sent as compressed cell numbers, one blob per slice of
a row. The owner of a slice merges the chunks' sketches by adding, and tells each chunk which of its cells hold a count
of two or more. A count-min estimate is never too low, so a repeated window always passes.

Second pass: windows that pass in every row are grouped exactly by a 96-bit fingerprint (64 bits where they are compared
inside one chunk too), again by slice: the owner finds the smallest document of each and tells each chunk which of its
windows start in a smaller document elsewhere. Windows that repeat inside a chunk are settled there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.kernels import Words, give_back, mix, pack, pack_sorted, unpack, unpack_sorted
from docspark.llm.packed import NO_ID, Chunk, answers, by_slice, chunk_table, cuts, rows_of, send, slice_bits
from docspark.llm.scratch import Scratch, integer_id

_U = np.uint64
_ROW_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 8, dtype=np.uint64)


def _news(sorted_values: np.ndarray) -> np.ndarray:
    """Where a value of an ascending array differs from the one before."""
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return new


def _grouped(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a group begins in it) of pairs; the second key is only sorted by where equal first ones have several."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    new = _news(a)
    new[1:] |= b[1:] != b[:-1]
    return order, new


class Windows:
    """Windows of a chunk, grouped by content: position, group, and per group two hashes and the smallest id."""

    def __init__(self, chunk: Chunk, size: int):
        self.words = Words(chunk.data, chunk.offs, families=2)
        self.at, one = self.words.windows(size, 0)
        two = self.words.windows(size, 1)[1] >> _U(32)
        order, new = _grouped(one, two)
        self.group = np.empty(len(one), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.one, self.two = one[order][new], two[order][new].astype(np.uint32)
        ids = chunk.ids[self.words.row[self.at]]
        self.ids = ids
        self.least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(one) else ids

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of one sketch row, sorted, and where each group's hash stands there."""
        if row:
            return np.unique(mix(self.one ^ _ROW_SEEDS[row]), return_inverse=True)
        new = _news(self.one)
        return self.one[new], np.cumsum(new) - 1


def _flags(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Joins the bits of answers whose lengths are given."""
    parts = [np.unpackbits(unpack(blob, np.uint8), count=int(n)).astype(bool) for blob, n in zip(blobs, sizes)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _sketched(cells: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, distinct cell numbers) of sorted hashes."""
    border = cuts(cells, bits)
    for part in np.flatnonzero(np.diff(border)):
        own = cells[border[part] : border[part + 1]] >> _U(64 - width)
        yield int(part), own[_news(own)]


def repeated_passages(docs: DataFrame, *, size: int = 13, depth: int = 2, cells_per_window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) of every row of `docs`.

    A word is removed if a window of `size` words that covers it also starts in a document with a smaller id; windows are
    those of the input. kept_text has the other words, unchanged, joined by one space. Defined results: null is a text
    without words; texts below `size` words have no window; a missing id counts as larger than all others, and rows that
    repeat an id don't remove each other's words; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(integer_id(docs, id_col), docs[text_col].cast("string").alias("text"))
    table = chunk_table(rows, scratch, lambda data, offs: int(np.maximum(Words(data, offs, families=0).counts - size + 1, 0).sum()))
    total = table.agg(F.sum("words")).first()[0] or 0
    bits = slice_bits(total)
    width = min(63, max(bits + 1, ceil(log2(max(2, cells_per_window * total)))))

    def sketch(row: dict) -> Iterator[tuple]:
        windows = Windows(Chunk(row), size)
        for k in range(depth):
            for part, cells in _sketched(windows.cells(k)[0], bits, width):
                yield (k << bits) + part, row["chunk"], pack_sorted(cells)

    def merged(group: pa.Table) -> pa.Table:
        give_back()
        parts = [unpack_sorted(blob.as_py()) for blob in group.column("blob")]
        cells = np.concatenate(parts)
        order = np.argsort(cells)
        same = ~_news(cells[order])
        often = np.empty(len(cells), bool)
        often[order] = same | np.append(same[1:], False)
        out = [pack(np.packbits(x)) for x in np.split(often, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"slice": group.column("slice"), "chunk": group.column("chunk"), "blob": pa.array(out, pa.binary())})

    cell = "slice int, chunk long, blob binary"
    first = scratch.table(answers(send(table.select("chunk", "ids", "sizes", "body"), sketch, cell).groupBy("slice").applyInArrow(merged, cell), "passed"), "passed")

    def passing(windows: Windows, row: dict) -> np.ndarray:
        """Which groups are estimated repeated by every row of the sketch."""
        blobs, good = by_slice(row["passed"]), np.ones(len(windows.one), bool)
        for k in range(depth):
            hashes, where = windows.cells(k)
            if len(hashes):
                sizes = np.array([len(cells) for _, cells in _sketched(hashes, bits, width)])
                flags = _flags(blobs[: len(sizes)], sizes)
                blobs = blobs[len(sizes) :]
                good &= flags[np.cumsum(_news(hashes >> _U(64 - width))) - 1][where]
        return good

    def exact(row: dict) -> Iterator[tuple]:
        windows = Windows(Chunk(row), size)
        good = np.flatnonzero(passing(windows, row))
        border = cuts(windows.one[good], bits)
        for part in np.flatnonzero(np.diff(border)):
            own = good[border[part] : border[part + 1]]
            yield int(part), row["chunk"], pack_sorted(windows.one[own]), pack(windows.two[own]), pack(windows.least[own])

    def smallest(group: pa.Table) -> pa.Table:
        give_back()
        one = [unpack_sorted(blob.as_py()) for blob in group.column("one")]
        lengths = [len(x) for x in one]
        one = np.concatenate(one)
        two = np.concatenate([unpack(blob.as_py(), np.uint32) for blob in group.column("two")])
        ids = np.concatenate([unpack(blob.as_py(), np.int64) for blob in group.column("least")])
        order, new = _grouped(one, two)
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        beaten = np.empty(len(one), bool)
        beaten[order] = least < ids[order]
        out = [pack(np.packbits(x)) for x in np.split(beaten, np.cumsum(lengths)[:-1])]
        return pa.table({"slice": group.column("slice"), "chunk": group.column("chunk"), "blob": pa.array(out, pa.binary())})

    asked = send(table.select("chunk", "ids", "sizes", "body").join(first, "chunk"), exact, "slice int, chunk long, one binary, two binary, least binary")
    second = scratch.table(answers(asked.groupBy("slice").applyInArrow(smallest, cell), "beaten"), "beaten")

    def left(chunk: Chunk, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, which words stay) of a chunk."""
        windows = Windows(chunk, size)
        gone = windows.ids > windows.least[windows.group]
        good = np.flatnonzero(passing(windows, row))
        sizes = np.diff(cuts(windows.one[good], bits))
        beaten = np.zeros(len(windows.one), bool)
        beaten[good] = _flags(by_slice(row["beaten"]), sizes[sizes > 0])
        gone |= beaten[windows.group]
        change = np.zeros(len(windows.words.row) + 1, np.int64)
        np.add.at(change, windows.at[gone], 1)
        np.add.at(change, windows.at[gone] + size, -1)
        return windows.words.counts, np.cumsum(change)[:-1] == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            counts, kept = left(chunk, row)
            give_back()  # the texts below are many small objects, which would keep the arrays' memory from the system
            border, raw, texts, removed = np.concatenate([[0], np.cumsum(counts)]), chunk.data.tobytes(), [], []
            for i, n in enumerate(counts.tolist()):
                own, mask = raw[chunk.offs[i] : chunk.offs[i + 1]].split(), kept[border[i] : border[i + 1]]
                removed.append(n - int(mask.sum()))
                texts.append(b" ".join(compress(own, mask) if removed[-1] else own).decode("utf-8", "replace"))
            ids = pa.array(chunk.ids, mask=chunk.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])
            del own, mask, raw, texts
            give_back()

    full = table.select("chunk", "ids", "sizes", "body").join(first, "chunk", "left").join(second, "chunk", "left")
    out = full.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


#: The rows of the query in DuckDB's SQL, for the table documents.
SQL = f"""
with split as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), 1) as pos from documents),
windows as (select doc_id, pos, {" || ' ' || ".join(["word", *(f"lead(word, {i}) over next" for i in range(1, 13))])} as words from split window next as (partition by doc_id order by pos)),
found as (select doc_id, pos, min(doc_id) over (partition by words) as least from windows where words is not null),
gone as (select distinct doc_id, pos + unnest(range(13)) as pos from found where least < doc_id),
marked as (select split.*, gone.pos is not null as gone from split left join gone using (doc_id, pos)),
kept as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as text from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from documents d left join kept using (doc_id)
"""
