"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

SuperMinHash (Ertl, 2017) gives each shingle a pseudo-random permutation of the signature's places and one uniform
number per place; place p of a document holds the smallest (rank of p + uniform) over its shingles. Ranks of one shingle
never repeat, so places are negatively correlated and the estimate varies less than with independent minima. Ranks are
drawn one by one; a document stops as soon as every place holds less than the next rank.

Links are found as follows. Documents with equal sets become one representative. Representatives that agree on all
rows of a band share a bucket; each is compared with its bucket's smallest member on full sets, and components of the
links are found. The members of buckets that still span several components are then joined exactly, across components:
shingles are ordered from rare to frequent, and two sets of the wanted similarity must share one among the first seventh
(at 0.75) of the smaller set and the first quarter of the larger one, early enough for the rest to make up the overlap.
So no pair within a bucket is listed for sharing the bucket alone, and components are those of all linked pairs that
share a bucket. With 128 places in 32 bands of 4 a pair of similarity 0.75 shares none with probability 5e-6, of 0.8
with 7e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.components import components
from docspark.llm.kernels import Words, chunks, give_back, mix, pack, pack_sorted, shingle_sets, unpack, unpack_sorted
from docspark.llm.packed import Chunk, answers, by_slice, chunk_table, cuts, send, slice_bits
from docspark.llm.scratch import Scratch, integer_id

_U = np.uint64
_STEP, _OTHER = _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def superminhash(row: np.ndarray, shingle: np.ndarray, rows: int, places: int = 128) -> np.ndarray:
    """Signatures (rows x places) of the sets given as (row, shingle) sorted by row: rank in the top byte, then 56 random
    bits. `places` is 255 at most. A row without shingles keeps the largest value everywhere."""
    out = np.full((rows, places), _NONE, _U)
    size = np.bincount(row, minlength=rows)
    border = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(border, border[at] + 200_000, "right")) - 1)
        _signatures(row[border[at] : border[to]] - at, shingle[border[at] : border[to]], out[at:to], places)
        at = to
    return out


def _signatures(row: np.ndarray, shingle: np.ndarray, out: np.ndarray, places: int) -> None:
    flat = out.reshape(-1)
    order = None
    for rank in range(places):
        drawn = mix(shingle + _U((rank + 1) * int(_STEP) % (1 << 64)))
        at = (rank + mix(drawn ^ _OTHER) % _U(places - rank)).astype(np.int64)
        if rank == 0:
            place, first = at, at
        else:
            if order is None:  # only rows that go on need the permutation's state
                order = np.tile(np.arange(places, dtype=np.uint8), (len(row), 1))
                own = np.arange(len(row))
                order[own, 0], order[own, first] = first, 0
            own = np.arange(len(row))
            place = order[own, at].astype(np.int64)
            order[own, at] = order[own, rank]
            order[own, rank] = place
        np.minimum.at(flat, row * places + place, (_U(rank) << _U(56)) | (drawn >> _U(8)))
        if rank + 1 == places:
            return
        going = out.max(axis=1) >= _U(rank + 1) << _U(56)
        keep = going[row]
        if not keep.any():
            return
        if rank == 0 or keep.sum() < 0.7 * len(keep):
            row, shingle = row[keep], shingle[keep]
            if order is None:
                first = first[keep]
            else:
                order = order[keep]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band (rows x bands); the band's number is part of the key."""
    rows, places = signature.shape
    cells = signature.reshape(rows, bands, places // bands)
    keys = np.tile(mix(np.arange(bands, dtype=_U) + _U(1)), (rows, 1))
    for i in range(places // bands):
        keys = mix(keys * _OTHER + cells[:, :, i])
    return keys


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.reshape(-1).view(np.int64))


def signatures(docs: DataFrame, *, size: int, places: int, bands: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands) of (id, text): two keys of the set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in chunks(batch):
                row, shingle = shingle_sets(Words(data, offs, lower=True), size)
                n = rows.num_rows
                held = np.bincount(row, minlength=n)
                full = held > 0
                set_a, set_b = np.zeros(n, _U), np.zeros(n, _U)
                if len(row):
                    starts = (np.cumsum(held) - held)[full]
                    set_a[full] = np.add.reduceat(mix(shingle ^ _STEP), starts)
                    set_b[full] = np.add.reduceat(mix(shingle ^ _OTHER), starts)
                keys = band_keys(superminhash(row, shingle, n, places), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), _signed(keys))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(held), _signed(set_a), _signed(set_b), lists], names=["id", "n_shingles", "set_a", "set_b", "bands"])
        give_back()

    return docs.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, *, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in chunks(batch, "text_b", 1 << 20):
                left = next(iter(chunks(rows, "text_a", 1 << 62)))
                sets = []
                for bytes_, edges in ((left[1], left[2]), (data, offs)):
                    row, shingle = shingle_sets(Words(bytes_, edges, lower=True), size)
                    border = np.searchsorted(row, np.arange(rows.num_rows + 1))
                    sets.append((shingle, border))
                (x, i), (y, j) = sets
                good = np.zeros(rows.num_rows, bool)
                for k in range(rows.num_rows):
                    n, m = i[k + 1] - i[k], j[k + 1] - j[k]
                    if 100 * min(n, m) >= percent * max(n, m):
                        both = len(np.intersect1d(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], assume_unique=True))
                        good[k] = 100 * both >= percent * (n + m - both)
                yield pa.RecordBatch.from_arrays([rows.column("a").filter(pa.array(good)), rows.column("b").filter(pa.array(good))], names=["a", "b"])
        give_back()

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def overlapping(texts: DataFrame, rest: DataFrame, scratch: Scratch, *, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids with different roots that may reach the similarity, by prefixes of rare shingles: all that do.

    texts: (id, text) of the rows of rest: (id, root). A chunk asks the owners of hash slices how many of the texts have
    each of its shingles, orders every set by that number, and sends the prefix; shingles of one text only can't be shared.
    """
    table = chunk_table(texts, scratch, lambda data, offs: len(Words(data, offs, families=0).row), "rest-chunks")
    bits = slice_bits(table.agg(F.sum("words")).first()[0] or 0)

    def ask(row: dict) -> Iterator[tuple]:
        chunk = Chunk(row)
        shingles, counts = np.unique(shingle_sets(Words(chunk.data, chunk.offs, lower=True), size)[1], return_counts=True)
        border = cuts(shingles, bits)
        for part in np.flatnonzero(np.diff(border)):
            own = slice(border[part], border[part + 1])
            yield int(part), chunk.key, pack_sorted(shingles[own]), pack(counts[own].astype(np.uint32))

    def added(group: pa.Table) -> pa.Table:
        give_back()
        shingles = [unpack_sorted(b.as_py()) for b in group.column("shingles")]
        counts = [unpack(b.as_py(), np.uint32) for b in group.column("counts")]
        _, where = np.unique(np.concatenate(shingles), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(_U)
        out = [pack(total[w]) for w in np.split(where, np.cumsum([len(x) for x in shingles])[:-1])]
        return pa.table({"slice": group.column("slice"), "chunk": group.column("chunk"), "blob": pa.array(out, pa.binary())})

    def prefixes(row: dict) -> Iterator[tuple]:
        chunk = Chunk(row)
        of, shingle = shingle_sets(Words(chunk.data, chunk.offs, lower=True), size)
        total = np.concatenate([unpack(b, _U) for b in by_slice(row["totals"])] or [np.zeros(0, _U)])
        total = total[np.unique(shingle, return_inverse=True)[1]]
        order = np.lexsort((shingle, total, of))
        of, shingle, total = of[order], shingle[order], total[order]
        held = np.bincount(of, minlength=len(chunk.ids))
        place = np.arange(len(of)) - (np.cumsum(held) - held)[of]
        size_of = held[of]
        sent = (100 * (size_of - place) >= percent * size_of) & (total > 1)
        return zip(shingle[sent].view(np.int64).tolist(), chunk.ids[of[sent]].tolist(), size_of[sent].tolist(), place[sent].tolist())

    texts = table.select("chunk", "ids", "sizes", "body")
    totals = answers(send(texts, ask, "slice int, chunk long, shingles binary, counts binary").groupBy("slice").applyInArrow(added, "slice int, chunk long, blob binary"), "totals")
    rows = send(texts.join(totals, "chunk"), prefixes, "shingle long, id long, n long, place long").join(rest, "id")
    rows = scratch.table(rows, "prefixes")
    small = rows.where(f"({100 + percent}) * (n - place) >= {2 * percent} * n").select("shingle", *(F.col(c).alias(f"{c}_s") for c in ("id", "n", "place", "root")))
    reach = f"{100 + percent} * least(n - place, n_s - place_s) >= {percent} * (n + n_s)"
    met = small.join(rows, "shingle").where(f"root <> root_s and (n_s < n or n_s = n and id_s < id) and 100 * n_s >= {percent} * n and {reach}")
    return met.select(F.greatest("id", "id_s").alias("a"), F.least("id", "id_s").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, places: int = 128, bands: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of `docs`.

    Linked are texts whose sets of `size`-word shingles (A-Z lower-cased) have a similarity of `percent`/100 or more;
    component_id is the smallest id reachable, kept is id = component_id. Defined results: a text without words, and
    null, has the empty set and is linked with nothing; fewer than `size` words form one shingle; rows that repeat an id
    are each returned, with the component of that id; a row without an id is linked with nothing and kept, with null as
    component_id; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(integer_id(docs, id_col), docs[text_col].cast("string").alias("text"))
    signed = scratch.table(signatures(texts, size=size, places=places, bands=bands), "signed")
    full = signed.where("n_shingles > 0 and id is not null")
    same = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("bands").alias("bands"))
    same = scratch.table(same, "same")
    copies = full.join(same.where("copies > 1").select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    cells = same.select("rep", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    cells = scratch.table(cells.join(shared, "key"), "cells")
    pairs = cells.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    tested = scratch.table(pairs, "pairs-0")
    some = texts.join(scratch.table(cells.select(F.col("rep").alias("id")).distinct(), "nodes"), "id")
    some = scratch.table(some.dropDuplicates(["id"]), "texts")
    links = scratch.table(verified(tested, some, size=size, percent=percent), "good-0")
    roots = components(links, scratch, "roots")
    marked = cells.join(roots, cells["rep"] == roots["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    marked = scratch.table(marked, "marked")
    split = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = scratch.table(marked.join(split, "key").select(F.col("rep").alias("id"), "root").distinct(), "rest")
    more = overlapping(some.join(rest.select("id"), "id"), rest, scratch, size=size, percent=percent).join(tested, ["a", "b"], "left_anti")
    more = scratch.table(more, "pairs-1")
    links = scratch.table(links.unionAll(verified(more, some, size=size, percent=percent)), "good-1")
    roots = components(links.unionAll(copies), scratch, "all")
    out = signed.select("id", "n_shingles").join(roots, signed["id"] == roots["node"], "left")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.coalesce("root", "id").cast(kind).alias("component_id"), F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"))
