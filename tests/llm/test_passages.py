import random
import re

import duckdb

from docspark.llm import queries
from docspark.llm.passage_dedup import SQL, repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    """[(id, n_words, n_removed, kept)] by a table of all windows; a missing id is larger than all others."""
    order = lambda i: (i is None, i or 0)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - size + 1):
            key = tuple(words[k : k + size])
            least[key] = min(least.get(key, order(i)), order(i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - size + 1):
            if least[tuple(words[k : k + size])] < order(i):
                gone.update(range(k, k + size))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def same(spark, rows, docs=None):
    docs = docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeated_passages(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_equals_brute_force_on_mixed_passages(spark):
    rng = random.Random(5)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(10, 40))] for _ in range(15)]
    rows = []
    for i in rng.sample(range(1000), 90):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    same(spark, rows)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_query_equals_sql(spark):
    duckdb.sql("create or replace view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = queries.op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(duckdb.sql(SQL).fetchall())


def test_edge_rows(spark):
    long = " ".join(f"k{i}" for i in range(60000))
    rep = " ".join(f"r{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \n"), (9, rep), (9, rep), (4, long), (5, long), (None, rep), (None, rep), (7, "one two"), (8, "é " * 30), (6, rep.upper())]
    same(spark, rows)
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    some = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, kept_text string, chunk string")
    assert [tuple(r) for r in repeated_passages(some).collect()] == [(1, 1, 0, "a")]
