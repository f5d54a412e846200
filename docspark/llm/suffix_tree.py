"""Language-model scores by a probabilistic suffix tree, beside exact add-0.1 word scores.

A text is the sequence of its words (A-Z lower-cased) and one end token. The tree models the bytes of each word and a
closing blank, and the end as one symbol. A symbol's context is what precedes it: the word so far, the blank before it,
and the last `CROSSED` symbols of the word before, but `depth` symbols at most. Counts cover all training documents.

A context of length l is retained if its next-symbol distribution diverges from that of its suffix of length l-1: its
count times the Kullback-Leibler divergence must reach `min_gain` nats. Suffixes of retained contexts are retained.
A state's distribution is smoothed by its suffix's, which counts as `weight` observations; below the empty context lies
the uniform one over 257 symbols. Each symbol is scored with the longest retained suffix of its context.

Texts are worked on in pieces of `PIECE_BYTES`, spelled as symbols in which each context with what follows is one 64-bit
key. For the word scores, chunks send their distinct words with counts to slices of the hash, whose owners answer with the
corpus counts.

The tree grows with the corpus and is never in one place. It is a table in slices by the last `STEM` symbols of a context,
so that a slice has whole branches; its owner adds up the counts and tests all contexts longer than that, which have their
suffix in the slice. The shorter ones, which the alphabet bounds, are tested over all slices: those below `STEM` symbols
are the *top*, and all slices share them. Chunks of `BLOCK_BYTES` ask the owners of slices for the log10 probabilities of
their distinct contexts with a symbol: most recur within a chunk, so that questions are few against the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.kernels import _LOWER, _SPACE, Index, Words, give_back, mix, pack, pack_sorted, unpack, unpack_sorted
from docspark.llm.packed import NO_ID, Chunk, Piece, chunk_table, cuts, send, slice_bits
from docspark.llm.scratch import Scratch, integer_id

_U = np.uint64
BLANK, END, SYMBOLS = 0x20, 0x0A, 257
#: Symbols of the word before that a context reaches, besides the blank.
CROSSED = 3
#: Symbols at the end of a context that name its slice.
STEM = 3
#: Entries of symbol counts that a slice's owner holds before it adds them up, and of questions that it answers at once.
FLUSHED = 1_000_000
#: Bytes of the texts of a chunk, about.
BLOCK_BYTES = 16 << 20
#: Bytes of the texts of a chunk that are worked on at once, about; whole texts are.
PIECE_BYTES = 1 << 19
#: Symbols that are scored at once.
SCORED = 1 << 18
#: Symbols of a piece that are counted or looked up at once.
SORTED = 1 << 18


def held_out(ids: np.ndarray, mod: int = 10, rest: int = 0) -> np.ndarray:
    """Whether crc32 of the decimal id leaves `rest`; a missing id is never held out."""
    return np.array([i != NO_ID and zlib.crc32(b"%d" % i) % mod == rest for i in ids.tolist()], bool)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)], _U)
_LEAD = np.array([1 << 8 * k for k in range(8)], _U)
_SPREAD = 2654435761


class Spelling:
    """The symbols of a piece's rows: a blank that isn't predicted, each word with its closing blank, and the end. `rows` has
    where each row begins and, last, the size; `_size` the length of each symbol's longest context, of `depth` (of 6) at most."""

    def __init__(self, piece: Piece, words: Words, depth: int):
        rows, length = len(piece.ids), words.ends - words.starts
        counts = words.counts
        after = np.concatenate([[0], np.cumsum(length + 1)])  # symbols of the words up to each
        self.rows = 2 * np.arange(rows + 1) + after[np.concatenate([[0], np.cumsum(counts)])]
        begin = after[:-1] + 2 * words.row + 1
        ends = self.rows[1:] - 1
        self._symbols = np.full(int(self.rows[-1]) + 7, BLANK, np.uint8)  # seven before the first, for the view below
        symbols = self._symbols[7:]
        own = np.ones(len(symbols), bool)
        own[begin + length] = own[ends] = own[self.rows[:-1]] = False
        symbols[own] = _LOWER[piece.data[~_SPACE[piece.data]]]
        symbols[ends] = END
        del own
        lead = np.zeros(len(length), np.uint8)  # symbols before the blank that a word's contexts reach
        lead[1:] = np.where(words.row[1:] == words.row[:-1], np.minimum(CROSSED, length[:-1] + 1), 0)
        last = np.zeros(rows, np.uint8)
        some = counts > 0
        last[some] = np.minimum(CROSSED, length[np.cumsum(counts)[some] - 1] + 1)
        self._size = np.full(len(symbols), depth, np.uint8)
        self._size[ends] = np.minimum(depth, last + 1)
        for j in range(depth - 1):
            there = length >= j
            self._size[begin[there] + j] = np.minimum(depth, lead[there] + (j + 1))
        # each symbol with the seven before it, as a number in base 256
        self._read = np.ndarray(len(symbols), ">u8", self._symbols, strides=(1,))

    def pairs(self, start: int, stop: int) -> np.ndarray:
        """Keys of the symbols' contexts, each with the symbol: in base 256, the nearest last, below a leading one."""
        size = self._size[start:stop]
        return self._read[start:stop].astype(_U) & _MASK[1:][size] | _LEAD[1:][size]


def _lengths(contexts: np.ndarray) -> np.ndarray:
    return sum((contexts >= lead).astype(np.int64) for lead in _LEAD[1:])


def _sliced(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by the slice of their context, and the borders of the slices in it."""
    slices = np.empty(len(pairs), np.uint16 if bits < 16 else np.uint32)
    for at in range(0, len(pairs), SCORED):
        slices[at : at + SCORED] = ((pairs[at : at + SCORED] >> _U(8) & _MASK[STEM]) * _U(_SPREAD) & _MASK[4]) >> _U(32 - bits)
    return np.argsort(slices, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(slices, minlength=1 << bits))])


class SuffixTree:
    """Retained contexts with smoothed next-symbol log10 probabilities."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, depth: int, weight: float):
        self.depth = depth
        self.keys, where = np.unique(contexts.astype(_U), return_inverse=True)
        totals = np.bincount(where, weights=counts, minlength=len(self.keys))
        self.lengths = _lengths(self.keys)
        shift = _U(8) * np.maximum(self.lengths - 1, 0).astype(_U)
        self.up = np.searchsorted(self.keys, (self.keys & ((_U(1) << shift) - _U(1))) | (_U(1) << shift)).astype(np.int64)
        self.back = np.log10(weight / (totals + weight))  # of a symbol not seen after the state: times the suffix's
        pairs = contexts.astype(_U) * _U(256) + symbols.astype(_U)
        self.states = Index(self.keys, np.arange(len(self.keys), dtype=np.int32))
        logs, known = np.zeros(len(pairs)), np.zeros(0, np.int64)
        for length in range(int(self.lengths.max(initial=0)) + 1):
            own = np.flatnonzero(self.lengths[where] == length)
            below = np.full(len(own), 1 / SYMBOLS)
            if length:
                self.pairs = Index(pairs[known], logs[known])
                below = 10 ** self._walk(self.up[where[own]], pairs[own] & _U(255))
            logs[own] = np.log10((counts[own] + weight * below) / (totals[where[own]] + weight))
            known = np.concatenate([known, own])
        self.pairs = Index(pairs, logs)

    def _walk(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of a symbol's probability after a state: from the nearest suffix that it was seen after."""
        out, left = np.zeros(len(state)), np.arange(len(state))
        while len(left):
            hit, logs = self.pairs.find(self.keys[state] * _U(256) + symbol)
            out[left[hit]] += logs[hit]
            out[left[~hit]] += self.back[state[~hit]]
            bottom = ~hit & (self.lengths[state] == 0)
            out[left[bottom]] -= np.log10(SYMBOLS)
            on = ~hit & ~bottom
            left, state, symbol = left[on], self.up[state[on]], symbol[on]
        return out

    def logs_of(self, pairs: np.ndarray) -> np.ndarray:
        """log10 probabilities of symbols after contexts, from keys of both."""
        logs, context = np.full(len(pairs), -np.log10(SYMBOLS)), pairs >> _U(8)
        if not len(self.keys):
            return logs
        size = sum((context >= lead).astype(np.int8) for lead in _LEAD[1 : self.depth + 1])
        for at in range(0, len(pairs), SCORED):
            part = slice(at, at + SCORED)
            logs[part] = self._walk(self._states(context[part], size[part]), pairs[part] & _U(255))
        return logs

    def _states(self, context: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The longest retained suffix of each context of the given size."""
        state, left = np.zeros(len(context), np.int64), np.arange(len(context))
        for length in range(self.depth, -1, -1):
            fits = size[left] >= length
            own = left[fits]
            hit, found = self.states.find(context[own] & _MASK[length] | _LEAD[length])
            state[own[hit]] = found[hit]
            left = np.concatenate([own[~hit], left[~fits]])
        return state


def _distinct(piece: Piece) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(piece.data, piece.offs, lower=True)
    return words, *np.unique(words.hashes[0], return_inverse=True)


def _added(keys: Sequence[np.ndarray], n: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of keys, each part sorted or nearly so, added up and sorted; the counts keep their type."""
    keys, n = np.concatenate(keys), np.concatenate(n)
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")  # merges runs
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first, dtype=n.dtype)


class Sums:
    """Counts of keys that come in sorted parts, added up whenever as many again are held, one range of keys at a time."""

    def __init__(self, ranges: int = 16):
        self._ranges, self._borders, self._held, self._known = [([], []) for _ in range(ranges)], None, 0, 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        if self._borders is None and len(keys):
            self._borders = keys[np.arange(1, len(self._ranges)) * len(keys) // len(self._ranges)]
        for own, k, x in zip(self._ranges, *(np.split(a, np.searchsorted(keys, self._borders)) for a in (keys, n))) if len(keys) else ():
            own[0].append(k.copy())
            own[1].append(x.copy())
        self._held += len(keys)
        if self._held > self._known:
            self._sum()

    def _sum(self) -> None:
        for own in self._ranges:
            if own[0]:
                own[0][:], own[1][:] = ([x] for x in _added(*own))
        self._held, self._known = 0, sum(len(k) for keys, _ in self._ranges for k in keys)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys with their counts; nothing is held any more."""
        self._sum()
        keys, n = ([x for own in self._ranges for x in own[i]] for i in (0, 1))
        self.__init__(len(self._ranges))
        return np.concatenate([np.zeros(0, _U), *keys]), np.concatenate([np.zeros(0, np.uint32), *n])


def _parts(spelling: Spelling) -> Iterator[tuple[slice, int, int]]:
    """Runs of about SORTED symbols of a piece, with the rows that they are of."""
    for start in range(0, int(spelling.rows[-1]), SORTED):
        stop = min(start + SORTED, int(spelling.rows[-1]))
        yield slice(int(np.searchsorted(spelling.rows, start, "right")) - 1, int(np.searchsorted(spelling.rows, stop))), start, stop


def _firsts(spelling: Spelling, rows: slice, start: int) -> np.ndarray:
    """Places of the rows' first blanks in the part that begins at `start`."""
    at = spelling.rows[rows] - start
    return at[at >= 0]


def _owner(group: pa.Table) -> pa.Table:
    """Adds up the counts of a slice's words: answers for its chunks, and totals in a row without a chunk."""
    give_back()
    hashed = [unpack_sorted(b.as_py()) for b in group.column("hashes")]
    counts = [unpack(b.as_py(), np.uint32).astype(np.int64) for b in group.column("counts")]
    words, total = _added(hashed, counts)
    out = [(s, c, pack(total[np.searchsorted(words, h)].astype(_U)), 0, 0) for s, c, h in zip(group.column("slice").to_pylist(), group.column("chunk").to_pylist(), hashed)]
    out.append((None, None, None, int(total.sum()), int((total > 0).sum())))
    kinds = {"slice": pa.int32(), "chunk": pa.int64(), "blob": pa.binary(), "a": pa.int64(), "b": pa.int64()}
    return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), zip(*out))})


def _with_suffixes(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of contexts with a symbol, as counts of each of their suffixes, by length from the empty one on."""
    length = _lengths(keys >> _U(8))
    out, longer = [], (keys[:0], n[:0])
    for k in range(int(length.max(initial=0)), -1, -1):
        own = length == k
        shorter = (longer[0] >> _U(8) & _MASK[k] | _LEAD[k]) * _U(256) + (longer[0] & _U(255))
        longer = _added([keys[own], shorter], [n[own], longer[1]])
        out.insert(0, longer)
    return out


def _suffix(contexts: np.ndarray, length: int) -> np.ndarray:
    return contexts & _MASK[length] | _LEAD[length]


def _retained(levels: list[tuple[np.ndarray, np.ndarray]], min_gain: float) -> list[np.ndarray]:
    """Which entries of each level belong to contexts that diverge from their suffixes, or are suffixes of such; only the
    levels above STEM are tested."""
    out = [np.zeros(len(keys), bool) for keys, _ in levels]
    needed = np.zeros(0, _U)  # suffixes of what was retained one level above
    for k in range(len(levels) - 1, STEM - 1, -1):
        keys, n = levels[k]
        contexts, where = np.unique(keys >> _U(8), return_inverse=True)
        good = np.isin(contexts, needed)
        if k > STEM:
            up_keys, up_n = levels[k - 1]
            up, up_where = np.unique(up_keys >> _U(8), return_inverse=True)
            up_total = np.bincount(up_where, weights=up_n)
            parent = np.searchsorted(up_keys, _suffix(keys >> _U(8), k - 1) * _U(256) + (keys & _U(255)))
            total = np.bincount(where, weights=n)
            share = (n / total[where]) / (up_n[parent] / up_total[up_where[parent]])
            good |= np.bincount(where, weights=n * np.log(share), minlength=len(contexts)) >= min_gain
        out[k] = good[where]
        needed = np.unique(_suffix(contexts[good], k - 1))
    return out


def _grown(group: pa.Table, min_gain: float) -> pa.Table:
    """(ctx, sym, n, kept) of a slice: its chunks' counts added up as counts of all suffixes, the contexts above STEM symbols
    only if they are retained; kept says of those of STEM symbols whether a longer one needs them."""
    give_back()
    keys, counts, held, most = [np.zeros(0, _U)], [np.zeros(0, np.int64)], 0, FLUSHED
    for hashes, blob in zip(group.column("hashes"), group.column("counts")):
        n = unpack(blob.as_py(), np.uint32).astype(np.int64)
        keys.append(unpack_sorted(hashes.as_py())[n > 0])
        counts.append(n[n > 0])
        held += len(keys[-1])
        if held > most:
            keys, counts = [[x] for x in _added(keys, counts)]
            held = len(keys[0])
            most = FLUSHED + 2 * held
    levels = _with_suffixes(*_added(keys, counts))
    kept = _retained(levels, min_gain)
    shown = [of | (length <= STEM) for length, of in enumerate(kept)]
    keys, n, kept = (np.concatenate([x[s] for x, s in zip(column, shown)]) for column in (*zip(*levels), kept))
    out = pa.table({"ctx": (keys >> _U(8)).astype(np.int64), "sym": (keys & _U(255)).astype(np.int32), "n": n, "kept": kept})
    give_back()
    return out


def grown_tree(counts: DataFrame, scratch: Scratch, *, min_gain: float) -> DataFrame:
    """The tree as a table (ctx, sym, n): all contexts that diverge and their suffixes. counts (slice, chunk, hashes, counts)
    are of the longest contexts with a symbol."""
    grown = counts.groupBy("slice").applyInArrow(lambda group: _grown(group, min_gain), "ctx long, sym int, n long, kept boolean")
    grown = scratch.table(grown, "grown")
    first, beyond = int(_LEAD[STEM]), int(_LEAD[STEM + 1])
    short = grown.where(F.col("ctx") < beyond).groupBy("ctx", "sym").agg(F.sum("n").alias("n"), F.max("kept").alias("kept"))
    short = scratch.table(short, "short")
    # a key in hexadecimal is a leading one and two digits per symbol
    suffix = "(ctx & (shiftleft(1L, 8 * {k}) - 1)) + shiftleft(1L, 8 * {k})"
    up = F.expr(suffix.format(k="cast(length(hex(ctx)) div 2 - 1 as int)"))
    own = short.join(short.groupBy("ctx").agg(F.sum("n").alias("t")), "ctx")
    parent = own.where(F.col("ctx") < first).select(F.col("ctx").alias("up"), "sym", F.col("n").alias("pn"), F.col("t").alias("pt"))
    gains = own.where("ctx > 1").withColumn("up", up).join(parent, ["up", "sym"])
    gains = gains.groupBy("ctx").agg(F.sum(F.expr("n * ln((n / t) / (pn / pt))")).alias("gain")).where(F.col("gain") >= min_gain)
    kept = gains.select("ctx").unionAll(short.where("kept").select("ctx")).unionAll(short.sparkSession.range(1, 2).select(F.col("id").alias("ctx")))
    shorter = F.expr(f"transform(sequence(0, cast(length(hex(ctx)) div 2 as int)), k -> {suffix.format(k='k')})")
    kept = kept.distinct().select(F.explode(shorter).alias("ctx")).distinct()
    tree = short.join(kept, "ctx", "left_semi").select("ctx", "sym", "n").unionAll(grown.where(F.col("ctx") >= beyond).select("ctx", "sym", "n"))
    return scratch.table(tree, "tree")


def answered(tree: DataFrame, asked: DataFrame, bits: int, *, depth: int, weight: float) -> DataFrame:
    """(slice, chunk, hashes, blob, places): log10 probabilities for the keys in `hashes` of (slice, chunk, hashes): the distinct
    ones in `blob` and which of them each key has in `places`, as many keys share one."""
    first = int(_LEAD[STEM])
    top = tree.where(F.col("ctx") < first).toArrow()
    names = ("ctx", "sym", "n")
    shared = tree.sparkSession.sparkContext.broadcast([top.column(c).to_numpy() for c in names])
    place = F.expr(f"cast(shiftright(((ctx & {first - 1}) * {_SPREAD}) % {1 << 32}, {32 - bits}) as int)")
    branches = tree.where(F.col("ctx") >= first).withColumn("slice", place)

    def run(branch: pa.Table, questions: pa.Table) -> pa.Table:
        give_back()
        own = SuffixTree(*(np.concatenate([t, branch.column(c).to_numpy()]) for t, c in zip(shared.value, names)), depth, weight)
        blobs, places, keys, held = [], [], [], 0
        for i, blob in enumerate(questions.column("hashes"), 1):
            keys.append(unpack_sorted(blob.as_py()))
            held += len(keys[-1])
            if held > FLUSHED or i == questions.num_rows:
                distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
                ends = np.cumsum([len(k) for k in keys])[:-1]
                logs = own.logs_of(distinct).view(_U)
                for asked_at in np.split(where, ends):
                    values, place = np.unique(logs[asked_at], return_inverse=True)
                    blobs.append(pack_sorted(values))
                    places.append(pack(place.astype(np.uint32)))
                keys, held = [], 0
        out = questions.select(["slice", "chunk", "hashes"]).append_column("blob", pa.array(blobs, pa.binary())).append_column("places", pa.array(places, pa.binary()))
        out = pa.Table.from_batches(out.to_batches(max_chunksize=4), out.schema)  # the JVM holds a batch whole
        give_back()
        return out

    return branches.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(run, "slice int, chunk long, hashes binary, blob binary, places binary")


def suffix_tree_scores(docs: DataFrame, *, depth: int = 6, min_gain: float = 2.0, weight: float = 8.0, mod: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    Training documents are those whose crc32 of the decimal id isn't 0 modulo `mod`. base_score adds
    log10((c + 0.1) / (N + 0.1 * (V + 1))) over tokens; score is the tree's log10 probability of the token sequence.
    Defined results: null and empty texts are one end token; a missing id is not held out; without training documents
    scores are uniform; repeated rows count each; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(integer_id(docs, id_col), docs[text_col].cast("string").alias("text"))
    ends = rows.where(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % mod, F.lit(1)) != 0).count()
    table = chunk_table(rows, scratch, lambda data, offs: len(Words(data, offs, families=0).row), size=BLOCK_BYTES)
    bits = slice_bits(table.agg(F.sum("words")).first()[0] or 0)
    tree_bits = max(4, bits - 2)  # a slice's owner holds its distinct contexts only
    texts = table.select("chunk", "ids", "sizes", "body")

    def ask(row: dict) -> Iterator[tuple]:
        chunk = Chunk(row)
        known = Sums(), Sums()  # words and pairs, with counts
        for piece in chunk.pieces(PIECE_BYTES):
            words, hashed, where = _distinct(piece)
            train = ~held_out(piece.ids, mod)
            counts = np.bincount(where, weights=train[words.row], minlength=len(hashed))
            del where
            known[0].add(hashed, counts.astype(np.uint32))
            spelling = Spelling(piece, words, depth)
            del words, hashed, counts
            for rows, start, stop in _parts(spelling):
                # a bit below the key tells rows that aren't learned from, so that numbers alone are sorted
                keys = spelling.pairs(start, stop) << _U(1)
                keys |= np.repeat(~train[rows], np.diff(np.clip(spelling.rows[rows.start : rows.stop + 1], start, stop))).astype(_U)
                keys = np.delete(keys, _firsts(spelling, rows, start))
                keys.sort()
                first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
                n = np.diff(first, append=len(keys))
                keys = keys[first]
                n[(keys & _U(1)) > 0] = 0
                known[1].add(keys >> _U(1), n.astype(np.uint32))
            del spelling, keys, first, n
            give_back()
        (hashed, counts), (pairs, pair_counts) = (of.total() for of in known)
        del known
        border = cuts(hashed, bits)
        for part in np.flatnonzero(np.diff(border)):
            own = slice(border[part], border[part + 1])
            yield int(part), chunk.key, pack_sorted(hashed[own]), pack(counts[own])
        order, border = _sliced(pairs, tree_bits)
        for part in np.flatnonzero(np.diff(border)):
            own = order[border[part] : border[part + 1]]
            yield -1 - int(part), chunk.key, pack_sorted(pairs[own]), pack(pair_counts[own])

    # slices of words from 0, slices of contexts with a symbol as -1 and below
    asked = scratch.table(send(texts, ask, "slice int, chunk long, hashes binary, counts binary"), "asked")
    about = asked.where("slice < 0").withColumn("slice", F.expr("-1 - slice"))
    told = scratch.table(asked.where("slice >= 0").groupBy("slice").applyInArrow(_owner, "slice int, chunk long, blob binary, a long, b long"), "told")
    sums = told.agg(F.sum("a"), F.sum("b")).first()
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    tree = grown_tree(about, scratch, min_gain=min_gain)
    scratch.drop("grown", "short")
    logs = answered(tree, about.select("slice", "chunk", "hashes"), tree_bits, depth=depth, weight=weight)

    def score(text: pa.Table, replies: pa.Table) -> pa.Table:
        log = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        give_back()
        chunk = Chunk({name: text.column(name)[0].as_py() for name in text.column_names})
        totals, asked, found = [np.zeros(0, _U)], [], []
        for i in np.argsort(replies.column("slice").to_numpy()).tolist():
            hashes, blob, places = (replies.column(c)[i].as_py() for c in ("hashes", "blob", "places"))
            if places is None:
                totals.append(unpack(blob, _U))  # in the order of slices, which is the order of hashes
            else:
                asked.append(unpack_sorted(hashes))
                found.append(unpack_sorted(blob).view(np.float64)[unpack(places, np.uint32)])
        totals, asked, found = (np.concatenate(x) for x in (totals, asked, found))
        order = np.argsort(asked)
        asked, found = asked[order], found[order]
        del text, replies, order
        give_back()
        done = []
        for piece in chunk.pieces(PIECE_BYTES):
            words, hashed, where = _distinct(piece)
            where, n_words = where.astype(np.int32), words.counts
            spelling = Spelling(piece, words, depth)
            del words
            scores = np.zeros(len(piece.ids))
            for rows, start, stop in _parts(spelling):
                pairs = spelling.pairs(start, stop)
                firsts = _firsts(spelling, rows, start)
                pairs[firsts] = asked[0]  # isn't predicted
                pairs, asked_at = np.unique(pairs, return_inverse=True)
                logs = found[np.searchsorted(asked, pairs)][asked_at]
                logs[firsts] = 0
                scores[rows] += np.add.reduceat(logs, np.maximum(spelling.rows[rows] - start, 0))
            done.append((piece.ids, hashed, where, n_words, scores))
            del spelling, pairs, asked_at, logs
            give_back()
        del chunk, piece, asked, found
        # words are few enough to be listed again, contexts with a symbol came back with their answers
        seen = np.unique(np.concatenate([hashed for _, hashed, *_ in done]))
        out = []
        for ids, hashed, where, n_words, scores in done:
            counts = totals[np.searchsorted(seen, hashed)].astype(np.float64)
            rows = np.repeat(np.arange(len(ids)), n_words)
            add = lambda x: np.bincount(rows, weights=x[where], minlength=len(ids))  # noqa: B023, E731
            columns = [pa.array(ids, mask=ids == NO_ID), pa.array(held_out(ids, mod)), pa.array(n_words + 1), pa.array((add(counts > 0) + (ends > 0)).astype(np.int64)), pa.array(np.full(len(ids), n, np.int64)), pa.array(add(log(counts)) + log(ends)), pa.array(scores)]
            out.append(pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)

    # replies stay rows of a slice each: gathered and joined to the texts, a chunk's would be rows that the JVM copies several times
    told = told.where("chunk is not null").selectExpr("slice", "chunk", "cast(null as binary) hashes", "blob", "cast(null as binary) places")
    full = texts.groupBy("chunk").cogroup(told.unionAll(logs).groupBy("chunk"))
    out = full.applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
