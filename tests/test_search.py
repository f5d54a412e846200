import random

import pytest

from docspark import queries
from docspark.functions import text as T
from docspark.operators import retrieval, search

SF = "/root/testdata/sf0.001"


def rows(frame, *columns):
    value = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted((tuple(value(r[c]) for c in columns) for r in frame.collect()), key=str)


def read_by(spark, frame):
    """The frame and a counter of its rows that are computed."""
    counter = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(run, frame.schema), counter


def test_bm25_topk_reads_each_passage_once(spark, monkeypatch):
    passages = queries._passages(spark, SF)
    frame, counter = read_by(spark, passages)
    monkeypatch.setattr(queries, "_passages", lambda *_: frame)
    got = queries.bm25_topk(spark, SF).collect()
    assert got and counter.value == passages.count()


def test_document_answers_cuts_texts_once_and_those_of_passages_again(spark, monkeypatch):
    plan = queries.document_answers(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [row_number() windowspecdefinition(doc_id") :]
    assert "doc_id" in below and ("doc_id#" in below and (" INSET " in below or " IN (" in below))
    docs = queries._docs(spark, SF)
    frame, counter = read_by(spark, docs)
    monkeypatch.setattr(queries, "_docs", lambda *_: frame)
    assert queries.document_answers(spark, SF).collect() and counter.value <= 2 * docs.count()


@pytest.mark.parametrize("repeated", [False, True])
def test_search_is_the_ranking_of_the_plan(spark, monkeypatch, repeated):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["Radars", "radar's", "jamming", "the", "2,000", "x٣", "٣٤"]
    chunks = []
    for doc in range(60):
        for idx in range(rng.randint(1, 4)):
            # every third document repeats one text, so that many scores tie
            chunks.append((doc, idx, "radar w1 w2" if doc % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 9)))))
    chunks += [(None, 0, "w1 w2"), (99, 0, "")] + [(7, 0, "w1 radar w3"), (7, 0, "w4 w4 the")] * repeated
    chunks = spark.createDataFrame(chunks, "doc_id long, idx int, text string").repartition(3)
    asked = [(k, rng.choice(["all", "all", "all", "9", "10", "7", "777"]), " ".join(rng.sample(words, rng.randint(1, 8))) + rng.choice(["", " Unheard"]), None) for k in range(40)]
    asked = retrieval.understood(spark.createDataFrame(asked, "qid long, scope string, question string, previous string")).persist()
    monkeypatch.setattr(search, "ROWS", 16)
    got = retrieval.searched(asked, chunks)
    short = retrieval.searched(asked, chunks, fill=False)[0]
    monkeypatch.setattr(retrieval, "MOST_TERMS", 0)
    want = retrieval.searched(asked, chunks)
    places = ("qid", "n", "doc_id", "idx", "score")
    assert rows(got[0], *places) == rows(want[0], *places) and got[0].where("n > 6").count()
    assert rows(short, *places) == rows(got[0].where("n <= 6"), *places)
    assert rows(got[1], "qid", "pos", "term", "df", "idf") == rows(want[1], "qid", "pos", "term", "df", "idf")
    assert set(rows(got[2], "scope", "n", "avg")) <= set(rows(want[2], "scope", "n", "avg"))
    assert got[0].dtypes == want[0].dtypes and sorted(got[1].dtypes) == sorted(want[1].dtypes)
    assert retrieval.searched(asked.where("false"), chunks)[0].count() == 0


def test_tokens_in_python(spark):
    text = "'Tis isn't O'Neil's 1.5,6 ٣٤.٥ a1b2 é1x 𑽐5 \U0001e4f1 x-y İstanbul"
    want = spark.range(1).selectExpr(f"{T.raw_tokens(T.quoted(text))} as v").first().v
    assert search.TOKEN.findall(text) == want


def test_candidates_in_small_blocks(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    docs, idx = np.repeat(np.arange(500), 3), np.tile(np.arange(3), 500)
    scores = rng.integers(0, 6, 1500).astype(float)
    for choice, want in (
        (search._Best(6, 1), sorted(zip(-scores, docs, idx))[:6]),
        (search._First(6, np.array([4.0])), sorted((min((-s, d, i) for s, d, i in zip(scores, docs, idx) if d == doc) for doc in np.unique(docs[scores >= 4])[:6]), key=lambda r: r[1])),
    ):
        left = (np.zeros(0, int),) * 3 + (np.zeros(0),)
        for at in rng.permutation(30) * 50:
            part = scores[at : at + 50, None]
            row, q = np.nonzero(choice.wanted(docs[at : at + 50], part))
            left = choice.cut(*(np.concatenate(x) for x in zip(left, (q, docs[at : at + 50][row], idx[at : at + 50][row], part[row, q]))))
        assert [(-s, d, i) for _, d, i, s in zip(*left)] == want
