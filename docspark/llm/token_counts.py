"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A text is cut at the special strings, then into words at ASCII white space, and each distinct word of a chunk is
normalised, split into pieces and merged once. The pieces of a word don't depend on its neighbours, so a text's count is
the sum over its words. Within a piece, a heap holds the adjacent pairs by (rank, position) and a doubly linked list the
symbols; the count is the number of initial symbols less the merges made.

Defined results: null and empty texts have 0 tokens; special strings inside a text count as one token each (the
library's default); repeated rows are counted each; columns besides the identifier and the text are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docspark.llm.kernels import Words, chunks

#: Distinct pieces and words whose counts a worker keeps; beyond it the store is emptied, which costs time only.
KEPT = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level merging."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens as a word-end byte-pair vocabulary file gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): rank for rank, pair in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        splits = [step for step in spec["pre_tokenizer"]["pretokenizers"] if step["type"] == "Split"]
        self.piece = regex.compile(splits[0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.pieces: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> int:
        """Symbols left after merging the lowest-ranked adjacent pair (leftmost first) until none has a rank."""
        n, ranks = len(symbols), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            left -= 1
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (rank := ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (rank, x, symbols[x], symbols[y]))
        return left

    def _piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            symbols = [self.symbols[b] for b in piece.encode()]
            symbols[-1] += self.end
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            found = self.pieces[piece] = self.merged(symbols)
        return found

    def count(self, text: str) -> int:
        """Tokens of a text."""
        total = 0
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                total += 1
            elif part:
                part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                for piece in self.piece.findall(part):
                    total += self._piece(piece)
        return total


@lru_cache(maxsize=2)
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(docs: DataFrame, vocabulary: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; `vocabulary` is a path that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(vocabulary)
        store: dict[int, int] = {}
        for batch in batches:
            for rows, data, offs in chunks(batch):
                words = Words(data, offs)
                hashed, first, inverse = np.unique(words.hashes[0], return_index=True, return_inverse=True)
                each, raw = np.empty(len(hashed), np.int64), data.tobytes()
                starts, ends = words.starts[first].tolist(), words.ends[first].tolist()
                for i, key in enumerate(hashed.tolist()):
                    known = store.get(key)
                    if known is None:
                        if len(store) >= KEPT:
                            store.clear()
                        known = store[key] = merger.count(raw[starts[i] : ends[i]].decode("utf-8", "replace"))
                    each[i] = known
                total = np.zeros(rows.num_rows, np.int64)
                np.add.at(total, words.row, each[inverse])
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(offs)), pa.array(total), pa.array(total > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
