"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m bytes that occurs in a text with at most k edits shares at least m + 1 - q * (k + 1) of its q-grams with the
occurrence, on diagonals (text place less item place) that differ by k at most. Bands are 2 * (k + 1) diagonals wide and
begin every k + 1, so one band holds them all. Bands with enough shared q-grams are aligned with the item, within
the band and k more diagonals to each side, unless the q-grams of the item that are on none of these diagonals take more
than k edits already. No occurrence within the budget is missed.

Texts and items are compared as UTF-8 bytes with A-Z lower-cased and 0x09-0x0D as blanks; k is `max_edits` times m, and
less where the lemma would ask for no q-gram. Items below q bytes match only texts that equal them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.kernels import _GOLD, _LOWER, _SPACE, Index, chunks, give_back

_U = np.uint64
_FOLD = _LOWER.copy()
_FOLD[_SPACE] = 0x20
#: Bytes of items that one broadcast model holds; more items are taken in so many passes over the texts.
BLOCK_BYTES = 2 << 20
#: Shared q-grams (a place in a text with one in an item) that are counted at once.
POSTINGS = 1 << 21
#: Cells of alignments (and q-grams of their texts), and bytes of their items, that are held at once.
CELLS, PATTERNS = 1 << 19, 1 << 24


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each place as a number above 0; beyond 8 bytes, a hash of them."""
    n = max(0, len(data) - q + 1)
    if q > 8:
        code = np.zeros(n, _U)
        for i in range(q):
            code = code * _U(257) + data[i : i + n].astype(_U) + _U(1)
        return code | (code == 0)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    code = np.empty(n, _U)
    for i in range(min(8, n)):  # every eighth place at once
        code[i::8] = padded[i : i + 8 * len(code[i::8])].view("<u8")
    code &= _U((1 << 8 * q) - 1)
    return code | (code == 0)  # eight NULs count as one 0x01: a needless candidate at worst


class Items:
    """A block of benchmark items with their q-grams."""

    def __init__(self, ids: list, texts: list[str], q: int, max_edits: float):
        self.q = q
        folded = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        self.short: dict[bytes, list] = {}
        for i, f in zip(ids, folded):
            if 0 < len(f) < q:
                self.short.setdefault(f.tobytes(), []).append(i)
        kept = [(i, f) for i, f in zip(ids, folded) if len(f) >= q]
        self.ids, self.texts = [i for i, _ in kept], [f for _, f in kept]
        self.size = np.array([len(f) for f in self.texts], np.int64)
        self.edits = np.minimum((self.size * max_edits).astype(np.int64), self.size // q - 1)
        self.least = self.size + 1 - q * (self.edits + 1)
        self.grams = grams = [_grams(f, q) for f in self.texts]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        grams = np.concatenate(grams or [np.zeros(0, _U)])
        order = np.argsort(grams, kind="stable")
        keys, first, self.many = np.unique(grams[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order], place[order]
        self.index = Index(keys, np.arange(len(keys), dtype=np.int32))
        self.shift = _U(64 - max(20, int(8 * len(keys)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)  # small enough for a processor's cache
        self.seen[(keys * _GOLD) >> self.shift] = True

    def candidates(self, grams: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first diagonal of the band) with enough shared q-grams."""
        none = np.zeros(0, np.int64)
        if not len(self.ids) or not len(grams):
            return none, none, none
        at = np.flatnonzero(self.seen[(grams * _GOLD) >> self.shift])
        hit, key = self.index.find(grams[at])
        at, key = at[hit], key[hit]
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + self.q <= offs[row + 1]  # not across two rows
        at, key, row = at[inside], key[inside], row[inside]
        # a gram that repeats in text and item is shared by all pairs of places, so these are counted in slices
        ends = np.cumsum(self.many[key])
        span = int(offs[-1]) + int(self.size.max()) + 2  # above all numbers of bands
        keys, counts, low, held = [], [], 0, 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + POSTINGS, "right")))
            bands = self._bands(at[low:high], key[low:high], row[low:high], span)
            keys.append(bands[0])
            counts.append(bands[1])
            held += len(bands[0])
            if held > 2 * POSTINGS or high == len(at):
                keys, where = np.unique(np.concatenate(keys), return_inverse=True)
                keys, counts = [keys], [np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)]
                held = 0
            low = high
        if not keys:
            return none, none, none
        keys, counts = keys[0], counts[0]
        pair, band = keys // span, keys % span - 1
        row, item = pair // len(self.ids), pair % len(self.ids)
        enough = counts >= self.least[item]
        row, item, band = row[enough], item[enough], band[enough]
        return row, item, band * (self.edits[item] + 1) - int(self.size.max())

    def _bands(self, at: np.ndarray, key: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, item and band as one number, shared q-grams) of some places of a text."""
        many = self.many[key]
        posting = np.repeat(self.first[key] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        item = self.item[posting]
        band = (np.repeat(at, many) - self.place[posting] + int(self.size.max())) // (self.edits[item] + 1) + 1
        number = (np.repeat(row, many) * len(self.ids) + item) * span + band
        return np.unique(np.concatenate([number, number - 1]), return_counts=True)

    def possible(self, grams: np.ndarray, offs: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether the q-grams of the item that no diagonal of the alignment shares can be explained by the budget.

        Each of them takes an edit in one of its bytes, and the fewest edits that reach all are those at the last byte of
        the first, of the first that begins after it, and so on. More than the budget can't become a match by alignment.
        """
        k, many = self.edits[item], self.size[item] - self.q + 1
        width, most = int(4 * k.max() + 3), int(many.max())
        mine = np.zeros((len(row), most), _U)  # 0 stands for no q-gram
        for i, x in enumerate(item):
            mine[i, : many[i]] = self.grams[x]
        cell = np.arange(most + width - 1)
        at = (low - k)[:, None] + cell
        there = (at >= offs[row][:, None]) & (at + self.q <= offs[row + 1][:, None]) & (cell < (many + 4 * k + 2)[:, None])
        text = np.where(there, grams[np.clip(at, 0, len(grams) - 1)], _U(0))
        shared = np.arange(most) >= many[:, None]
        for d in range(width):
            shared |= text[:, d : d + most] == mine
        needed, reached = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for p in range(most):
            new = ~shared[:, p] & (reached <= p)
            needed += new
            reached[new] = p + self.q
        return needed <= k

    def aligned(self, data: np.ndarray, offs: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fewest edits of each candidate, and where it begins and ends, by alignment within the band."""
        size, k = self.size[item], self.edits[item]
        width = int(4 * k.max() + 3)
        rows = int(size.max())
        pattern = np.zeros((len(row), rows), np.uint8)
        for i, x in enumerate(item):
            pattern[i, : size[i]] = self.texts[x]
        start = low - k
        cell = np.arange(width)
        unit = 1 << 32
        far = 1 << 60
        allowed = cell < (4 * k + 3)[:, None]
        begin, end = offs[row][:, None], offs[row + 1][:, None]
        at = start[:, None] + cell  # text place before the next item byte, per diagonal
        cost = np.where(allowed & (at >= begin) & (at <= end), at, far)  # edits * unit + begin
        padded = np.append(data, 0)
        best, ends = np.full(len(row), far), np.zeros(len(row), np.int64)
        for i in range(rows):
            here = at + i
            inside = (here >= begin) & (here < end)
            equal = inside & (padded[np.clip(here, 0, len(data))] == pattern[:, i : i + 1])
            step = np.where(inside, cost + np.where(equal, 0, unit), far)  # takes a text byte
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + unit)  # leaves the item byte out
            step = np.where(allowed & (here + 1 >= begin) & (here + 1 <= end), step, far)
            step = np.minimum.accumulate(step - cell * unit, axis=1) + cell * unit  # puts text bytes in
            cost = np.where(allowed & (here + 1 >= begin) & (here + 1 <= end), np.minimum(step, far), far)
            done = np.flatnonzero(size == i + 1)
            if len(done):
                where = cost[done].argmin(axis=1)
                best[done] = cost[done, where]
                ends[done] = here[done, where] + 1
        return best // unit, best % unit, ends

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, object, int, int, int]]:
        """(row, item id, begin, end, edits) of the occurrences within the budget; those of one item don't overlap."""
        data = _FOLD[data]
        grams = _grams(data, self.q)
        row, item, low = self.candidates(grams, offs)
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        order = np.argsort(self.size[item], kind="stable")
        may, at = np.zeros(len(order), bool), 0
        while at < len(order):
            ahead = item[order[at : at + CELLS]]
            spans = self.size[ahead] + 4 * np.maximum.accumulate(self.edits[ahead]) + 3
            own = order[at : at + max(1, int((np.arange(1, len(spans) + 1) * spans <= CELLS).sum()))]
            at += len(own)
            may[own] = self.possible(grams, offs, row[own], item[own], low[own])
        order = order[may[order]]
        at = 0
        while at < len(order):
            # candidates that are aligned at once: as many as memory allows with the width and length of the longest
            sizes, widths = self.size[item[order[at:]]], 4 * np.maximum.accumulate(self.edits[item[order[at:]]]) + 3
            nr = np.arange(1, len(sizes) + 1)
            own = order[at : at + max(1, int(((nr * widths <= CELLS) & (nr * sizes <= PATTERNS)).sum()))]
            at += len(own)
            edits, begin, end = self.aligned(data, offs, row[own], item[own], low[own])
            good = np.flatnonzero(edits <= self.edits[item[own]])
            for g in good:
                found.setdefault((int(row[own][g]), int(item[own][g])), []).append((int(edits[g]), int(begin[g]), int(end[g])))
        out = []
        for (r, i), spans in sorted(found.items()):
            kept: list[tuple[int, int, int]] = []
            for edits, begin, end in sorted(set(spans)):
                if all(end <= b or begin >= e for _, b, e in kept):
                    kept.append((edits, begin, end))
            out += [(r, self.ids[i], b, e, edits) for edits, b, e in sorted(kept, key=lambda s: s[1])]
        if self.short:
            sizes = np.diff(offs)
            for r in np.flatnonzero((sizes > 0) & (sizes < self.q)):
                out += [(int(r), i, int(offs[r]), int(offs[r + 1]), 0) for i in self.short.get(data[offs[r] : offs[r + 1]].tobytes(), ())]
        return out


def blocks(items: DataFrame, *, q: int, max_edits: float, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks of bounded size; items without text or id are left out."""
    items = items.select(items[id_col].cast("long").alias("id"), items[text_col].cast("string").alias("text")).where("id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()
        yield Items([r.id for r in rows], [r.text for r in rows], q, max_edits)


def contaminated(docs: DataFrame, items: DataFrame, *, q: int = 8, max_edits: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, begin, end, edits) of every occurrence of an item in a text: characters from 0, end excluded.

    Occurrences of one item in one text don't overlap; those with fewer edits, then the earlier, are kept. Defined
    results: null and empty texts, and items without text or id, match nothing; repeated rows are matched each; a missing
    document id stays missing; other columns are not read. `edits` counts bytes.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {kind}, item_id long, begin long, end long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, q=q, max_edits=max_edits, id_col=item_id, text_col=item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, data, offs in chunks(batch):
                    if found := shared.value.matches(data, offs):
                        row, item, begin, end, edits = map(list, zip(*found))
                        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
                        first = place[offs[row]]
                        yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(row)), pa.array(item, pa.int64()), pa.array(place[begin] - first), pa.array(place[end] - first), pa.array(edits, pa.int64())], names=["id", "item_id", "begin", "end", "edits"])

        out = out.unionAll(rows.mapInArrow(run, schema))
    return out.select(F.col("id").alias(id_col), F.col("item_id").cast(item_kind).alias(item_id), "begin", "end", "edits")


def decontaminated(docs: DataFrame, items: DataFrame, *, q: int = 8, max_edits: float = 0.1, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text has no occurrence of an item. Rows are not shuffled."""
    for block in blocks(items, q=q, max_edits=max_edits, id_col=item_id, text_col=item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, data, offs in chunks(batch, text_col):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[m[0] for m in shared.value.matches(data, offs)]] = False
                    yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
