"""Search of a batch of questions: one pass over the texts counts the terms asked for, passes over these counts score them.

Only what the questions ask for is kept of a chunk, so neither texts nor pairs of questions and chunks are shuffled. Each task
keeps the candidates that its chunks leave for a question; the exact order is settled among them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from docspark.functions import text as T
from docspark.functions.words import STOPWORDS
from docspark.operators.index import B, K1

#: T.TOKEN for Python, whose decimal digits include two blocks that Java 17 doesn't know yet.
_DIGIT = "[^\\D\U00011f50-\U00011f59\U0001e4f0-\U0001e4f9]"
TOKEN = re.compile(T.TOKEN.replace(r"\p{Nd}", _DIGIT))
_STOP = frozenset(STOPWORDS)
_STOPWORD, _OTHER = -2, -1
#: Tokens whose codes a task remembers, and the longest of them.
KEPT, LONGEST = 200_000, 40
#: Chunks taken at once, cells of chunks by questions, and cells of chunks by terms of questions.
ROWS, CELLS, PARTS = 1024, 1 << 21, 1 << 22
#: Scores closer than this may be equal when rounded to nine digits.
NEAR = 2e-9


class _Codes(dict):
    """Codes of tokens as they are written: of a term asked for from 0, of other tokens that count, of stopwords."""

    def __init__(self, terms: list[str]):
        self.terms = {term: code for code, term in enumerate(terms)}

    def __missing__(self, token: str) -> int:
        word = token.lower()
        code = _STOPWORD if word in _STOP else self.terms.get(T.stemmed(word), _OTHER)
        if len(token) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[token] = code
        return code


def _lists(rows: np.ndarray, values: np.ndarray, size: int) -> pa.ListArray:
    """One list for each of `size` rows; `rows` ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(size + 1)), pa.int32()), pa.array(values, pa.int32()))


def counted(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, idx, lens, codes, tfs): the number of a chunk's tokens that are no stopwords, as an array of one, and how
    often it has which of `terms`, named by their places."""
    ids = [chunks.schema["doc_id"], chunks.schema["idx"]]
    schema = StructType([*ids, StructField("lens", ArrayType(LongType())), StructField("codes", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(terms)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [[codes[t] for t in TOKEN.findall(text or "")] for text in batch.column(2).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = np.fromiter((c for f in found for c in f), np.int64, len(rows))
                lens = np.bincount(rows[flat != _STOPWORD], minlength=len(found))
                asked = flat >= 0
                keys, tfs = np.unique(rows[asked] * max(1, len(terms)) + flat[asked], return_counts=True)
                at_row, code = np.divmod(keys, max(1, len(terms)))
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1), pa.int32()), pa.array(lens, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), one, _lists(at_row, code, len(found)), _lists(at_row, tfs, len(found))], ["doc_id", "idx", "lens", "codes", "tfs"])

    return chunks.select("doc_id", "idx", "text").mapInArrow(run, schema)


def merged(counts: DataFrame) -> DataFrame:
    """Counts with one row for each (doc_id, idx): chunks that share both count as one, with the lengths of all."""
    lens = counts.groupBy("doc_id", "idx").agg(F.flatten(F.collect_list("lens")).alias("lens"))
    each = counts.select("doc_id", "idx", F.explode(F.arrays_zip("codes", "tfs")).alias("t"))
    each = each.groupBy("doc_id", "idx", F.col("t.codes").alias("code")).agg(F.sum("t.tfs").cast("int").alias("tf"))
    each = each.groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list(F.struct("code", "tf"))).alias("t"))
    out = lens.alias("l").join(each.alias("e"), F.expr("l.doc_id <=> e.doc_id and l.idx <=> e.idx"), "left")
    none = F.expr("cast(array() as array<int>)")
    return out.select("l.doc_id", "l.idx", "lens", F.coalesce("t.code", none).alias("codes"), F.coalesce("t.tf", none).alias("tfs"))


class Weights:
    """What scores need of a batch of questions, as arrays: code, question, pos, idf and avg of each term of a question that
    some chunk has; the scope of each question, None for all."""

    def __init__(self, parts: list[tuple[int, int, int, float, float]], scopes: list[str | None]):
        code, question, pos, idf, avg = (np.array(c) for c in zip(*parts)) if parts else (np.zeros(0, int),) * 5
        order = np.argsort(code, kind="stable")
        self.question, self.idf, self.avg = question[order], idf[order].astype(float), avg[order].astype(float)
        self.pos = pos[order].astype(np.uint16 if len(pos) == 0 or pos.max() < 1 << 16 else np.int64)
        self.starts = np.searchsorted(code[order], np.arange((code.max() if len(code) else -1) + 2))
        names = sorted({s for s in scopes if s is not None})
        self.scopes = {name: k for k, name in enumerate(names)}
        self.scope = np.array([-1 if s is None else self.scopes[s] for s in scopes], int)

    def scores(self, docs: np.ndarray, lens: np.ndarray, row: np.ndarray, code: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Scores of chunks by questions, 0 where nothing is shared. row, code, tf and lens: of each term of a chunk.

        Contributions are added in the order of a question's terms, as numpy.bincount adds in the order of its input.
        """
        size = len(self.scope)
        known = code < len(self.starts) - 1
        row, code, tf, lens = row[known], code[known], tf[known], lens[known]
        first, often = self.starts[code], self.starts[code + 1] - self.starts[code]
        each = np.repeat(np.arange(len(row)), often)
        part = np.arange(len(each)) - np.repeat(np.cumsum(often) - often, often) + first[each]
        if self.scopes:
            own = np.array([self.scopes.get(str(d), -2) for d in docs.tolist()], int)
            wanted = self.scope[self.question[part]]
            held = (wanted == -1) | (wanted == own[row[each]])
            each, part = each[held], part[held]
        order = np.argsort(self.pos[part], kind="stable")
        each, part = each[order], part[order]
        tf, avg = tf[each].astype(float), self.avg[part]
        value = self.idf[part] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[each] / np.where(avg == 0, 1, avg)))
        return np.bincount(row[each] * size + self.question[part], value, len(docs) * size).reshape(len(docs), size)


def _scored(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, idxs, scores) of blocks of chunks; those without an id aren't found."""
    most = int(max(1, min(ROWS, CELLS // max(1, len(weights.scope)), PARTS // max(1, len(weights.idf)))))
    for whole in batches:
        whole = whole.filter(pc.and_(whole.column(0).is_valid(), whole.column(1).is_valid()))
        for at in range(0, whole.num_rows, most):
            batch = whole.slice(at, most)
            docs, idxs, lens, codes, tfs = (batch.column(i) for i in range(5))
            docs, idxs = docs.to_numpy(zero_copy_only=False), idxs.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(docs)), codes.value_lengths().to_numpy(zero_copy_only=False))
            code, tf = codes.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
            many, lens = lens.value_lengths().to_numpy(zero_copy_only=False), lens.flatten().to_numpy(zero_copy_only=False)
            # a chunk of several lengths scores the sum over them
            often = many[row]
            each = np.repeat(np.arange(len(row)), often)
            of = np.arange(len(each)) - np.repeat(np.cumsum(often) - often, often) + (np.cumsum(many) - many)[row[each]]
            yield docs, idxs, weights.scores(docs, lens[of], row[each], code[each], tf[each])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns begins a new group."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _places(new: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(new) else at


class _Best:
    """The first `most` chunks of each question by rounded score, doc_id and idx, and those that may tie with them."""

    def __init__(self, most: int, size: int):
        self.most, self.least = most, np.full(size, 0.0)

    def wanted(self, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return (scores > 0) & (scores >= self.least - NEAR)

    def cut(self, q, doc, idx, score):
        order = np.lexsort((idx, doc, -score, q))
        q, doc, idx, score = q[order], doc[order], idx[order], score[order]
        few = _places(_starts(q, score)) < self.most  # equal scores: the first by id
        q, doc, idx, score = q[few], doc[few], idx[few], score[few]
        new = _starts(q)
        last = _places(new) == self.most - 1
        self.least[q[last]] = score[last]
        near = score >= self.least[q] - NEAR
        return q[near], doc[near], idx[near], score[near]


class _First:
    """The best chunks of the `most` lowest doc_ids of each question with a score that reaches its floor."""

    def __init__(self, most: int, floors: np.ndarray):
        self.most, self.floors = most, floors * (1 - 1e-12)
        self.last = np.full(len(floors), np.iinfo(np.int64).max)

    def wanted(self, docs: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return (scores > 0) & (scores >= self.floors) & (docs[:, None] <= self.last)

    def cut(self, q, doc, idx, score):
        order = np.lexsort((idx, -score, doc, q))
        q, doc, idx, score = q[order], doc[order], idx[order], score[order]
        new = _starts(q, doc)
        group = np.cumsum(new) - 1
        rank = (_places(_starts(q[new])))[group]
        full = new & (rank == self.most - 1)
        self.last[q[full]] = doc[full]
        kept = _starts(q, doc, score) & (score >= score[new][group] - NEAR) & (rank < self.most)
        return q[kept], doc[kept], idx[kept], score[kept]


def candidates(counts: DataFrame, weights: Weights, choice: Callable[[], _Best | _First]) -> DataFrame:
    """(q, doc_id, idx, score) of the chunks that a choice leaves in each task; q: the place of the question."""
    ids = [counts.schema["doc_id"], counts.schema["idx"]]
    schema = StructType([StructField("q", IntegerType()), *ids, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, held, size, kinds = choice(), [], 0, None
        bound = 1 << 16
        for doc, idx, scores in _scored(batches, weights):
            kinds = kinds or (pa.from_numpy_dtype(doc.dtype), pa.from_numpy_dtype(idx.dtype))
            row, q = np.nonzero(left.wanted(doc, scores))
            held.append((q, doc[row], idx[row], scores[row, q]))
            size += len(q)
            if size > bound:
                held = [left.cut(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                bound = max(bound, 2 * size)
        if held:
            q, doc, idx, score = left.cut(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(doc, kinds[0]), pa.array(idx, kinds[1]), pa.array(score)], ["q", "doc_id", "idx", "score"])

    return counts.mapInArrow(run, schema)


def best(counts: DataFrame, weights: Weights, most: int) -> DataFrame:
    """Candidates for the first `most` chunks of each question."""
    size = len(weights.scope)
    return candidates(counts, weights, lambda: _Best(most, size))


def first(counts: DataFrame, weights: Weights, most: int, floors: list[float]) -> DataFrame:
    """Candidates for the best chunks of the `most` documents of lowest id whose score reaches the question's floor."""
    return candidates(counts, weights, lambda: _First(most, np.array(floors, float)))
