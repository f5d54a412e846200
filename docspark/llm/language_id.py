"""Language identification: known words first, then ever shorter character n-grams.

A known word adds, for each language, the log of its smoothed relative frequency there. A word that isn't known is tried
without its outer punctuation, and if that isn't known either it is cut from left to right into the longest known
character n-grams (of the word between blanks), from `order` characters down to one; each adds its smoothed log frequency
among n-grams of its length. The prediction is the language with the largest sum, the score its softmax share.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.kernels import Words, chunks, give_back
from docspark.llm.scratch import Scratch

UNKNOWN = "und"
#: Words whose sums a worker keeps, fewer if they have more than KEPT_SUMS sums; beyond it the store is emptied, which costs
#: time only.
KEPT, KEPT_SUMS = 100_000, 10_000_000


def _core(word: str) -> str:
    """The word without outer characters that are no letters, marks or digits."""
    inside = [i for i, c in enumerate(word) if unicodedata.category(c)[0] in "LMN"]
    return word[inside[0] : inside[-1] + 1] if inside else ""


def _grams(word: str, n: int) -> Iterator[str]:
    padded = f" {word} "
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


Counts = tuple[list[str], np.ndarray]


class LanguageModel:
    """Log frequencies by language of words and of n-grams of each length, from items and their counts (items x languages);
    `unseen` is added to all counts."""

    def __init__(self, languages: list[str], words: Counts, grams: list[Counts], *, unseen: float = 0.5):
        self.languages, self.order = languages, len(grams)
        # rows of `logs` by word and by n-gram; the first row says nothing
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        tables, at = [np.zeros((1, len(languages)))], 1
        for rows, (items, counts) in [(self.words, words), *((self.grams, table) for table in grams)]:
            if items:
                rows.update(zip(items, range(at, at + len(items))))
                tables.append(np.log((counts + unseen) / (counts + unseen).sum(axis=0)))
                at += len(items)
        self.logs = np.concatenate(tables)

    def word(self, word: str) -> np.ndarray:
        """Log frequencies of a word (A-Z lower-cased) in each language; words without a letter say nothing."""
        if not any(map(str.isalpha, word)):
            return self.logs[0]
        found = self.words.get(word)
        if found is None:
            word = _core(word).lower()
            found = self.words.get(word)
        if found is not None:
            return self.logs[found]
        total, padded, at = self.logs[0].copy(), f" {word} ", 0
        while at < len(padded):
            for n in range(min(self.order, len(padded) - at), 0, -1):
                gram = self.grams.get(padded[at : at + n])
                if gram is not None:
                    total += self.logs[gram]
                    break
            else:
                n = 1
            at += n
        return total


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a chunk of (text, lang)."""
    for batch in batches:
        for rows, data, offs in chunks(batch):
            words, raw = Words(data, offs, lower=True), data.tobytes()
            langs = np.array(rows.column("lang").to_pylist(), object)[words.row] if len(words.row) else np.zeros(0, object)
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                _, first, counts = np.unique(words.hashes[0][own], return_index=True, return_counts=True)
                spelled = [raw[words.starts[i] : words.ends[i]].lower().decode("utf-8", "replace") for i in own[first]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spelled), pa.string()), pa.array(spelled, pa.string()), pa.array(counts)], names=["lang", "word", "n"])


def learned(docs: DataFrame, scratch: Scratch, *, max_documents: int = 20_000, max_words: int = 100_000, max_grams: int = 60_000, order: int = 4) -> LanguageModel:
    """Learns from (id, text, lang): about `max_documents` of the labelled rows, chosen by a hash of the id, if there are
    more. The model is bounded: the `max_words` commonest words and `max_grams` commonest n-grams of each length."""
    docs = docs.where("lang is not null and text is not null")
    rows = docs.count()
    if rows > max_documents:
        docs = docs.where(F.pmod(F.xxhash64(F.col("id"), F.lit(6)), F.lit(1 << 30)) < F.lit(int(max_documents / rows * (1 << 30))))
    counts = scratch.table(docs.select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                if core := _core(word).lower() if any(map(str.isalpha, word)) else "":
                    for size in range(1, order + 1):
                        for gram in _grams(core, size):
                            found[lang, gram] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    def common(table: DataFrame, most: int) -> Counts:
        """The commonest items with their counts; at most `most` items, each with the languages that were learned."""
        best = table.groupBy("word").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "word").limit(most).select("word")
        rows = table.join(best, "word").toArrow()
        words = rows.column("word").combine_chunks().dictionary_encode()
        out = np.zeros((len(words.dictionary), len(languages)))
        place = np.searchsorted(np.array(languages, object), rows.column("lang").to_numpy().astype(object)) if len(rows) else np.zeros(0, np.int64)
        np.add.at(out, (words.indices.to_numpy(), place), rows.column("n").to_numpy())
        order = np.argsort(np.array(words.dictionary.to_pylist(), object)) if len(rows) else np.zeros(0, np.int64)
        return words.dictionary.take(pa.array(order)).to_pylist(), out[order]

    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    grams = counts.mapInArrow(gram_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = scratch.table(grams, "grams")
    tables = [common(grams.where(F.length("word") == size), max_grams) for size in range(1, order + 1)]
    while tables and not tables[-1][0]:
        tables.pop()
    model = LanguageModel(languages, common(counts.where(F.col("word").rlike(r"\p{L}") & (F.col("n") > 1)), max_words), tables)
    give_back()
    return model


class Identifier:
    """A model with the sums of words met so far."""

    def __init__(self, model: LanguageModel):
        self.model, self.names = model, np.array([*model.languages, UNKNOWN], object)
        self.rows: dict[int, int] = {}
        self.kept = max(1, min(KEPT, KEPT_SUMS // max(1, len(model.languages))))
        self.sums = np.zeros((self.kept, len(model.languages)))

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of the texts of a chunk."""
        words, raw, n = Words(data, offs, lower=True), data.tobytes(), len(offs) - 1
        hashed, first, where = np.unique(words.hashes[0], return_index=True, return_inverse=True)
        table = np.zeros((len(hashed), len(self.model.languages)))
        starts, ends = words.starts[first].tolist(), words.ends[first].tolist()
        for i, key in enumerate(hashed.tolist()):
            row = self.rows.get(key)
            if row is None:
                if len(self.rows) >= self.kept:
                    self.rows.clear()
                row = self.rows[key] = len(self.rows)
                self.sums[row] = self.model.word(raw[starts[i] : ends[i]].lower().decode("utf-8", "replace"))
            table[i] = self.sums[row]
        letters = np.concatenate([[0], np.cumsum((data | 32) - 97 < 26)])
        lettered = letters[offs[1:]] > letters[offs[:-1]]
        for i in np.flatnonzero(~lettered & (np.diff(offs) > 0)):
            lettered[i] = any(map(str.isalpha, raw[offs[i] : offs[i + 1]].decode("utf-8", "replace")))
        if not self.model.languages:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        sums = np.stack([np.bincount(words.row, weights=table[where, k], minlength=n) for k in range(table.shape[1])], axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return self.names[np.where(lettered, sums.argmax(axis=1), len(self.names) - 1)], np.where(lettered, share, 0.0)


def identified(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: `und` with score 0 for null, for texts without a letter, and for all texts if
    nothing was learned. Languages that tie: the first by name. Texts are read whole."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Identifier(shared.value)
        for batch in batches:
            for rows, data, offs in chunks(batch):
                name, score = found.predict(data, offs)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(name, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])
        give_back()

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, model: LanguageModel, least: float = 0.5, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose prediction isn't `und` and has a score of `least` or more. Rows
    are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Identifier(shared.value)
        for batch in batches:
            for rows, data, offs in chunks(batch, text_col):
                name, score = found.predict(data, offs)
                yield rows.filter(pa.array((name != UNKNOWN) & (score >= least)))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id_column, mod: int = 4, rest: int = 2):
    """crc32 of the decimal id leaves `rest`; a missing id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % mod == rest, F.lit(False))


def languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds: int) -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the labelled rows that are not held out, predicts all from the text."""
    train = docs.where(~is_held_out(docs[id_col])).select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    model = learned(train, Scratch(docs.sparkSession), **bounds)
    return identified(docs, model, id_col=id_col, text_col=text_col).select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
