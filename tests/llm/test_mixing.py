import random

import duckdb
import pytest

from docspark.llm.mixing import SQL, mixed, mixed_rows


def filled(sizes, weights):
    """Targets by filling: cap those above, share the rest again."""
    total, capped = sum(sizes), {}
    while True:
        left, open_ = total - sum(capped.values()), [i for i in range(len(sizes)) if i not in capped]
        want = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if want[i] > 3 * sizes[i]]
        if not over:
            return [capped.get(i, want.get(i)) for i in range(len(sizes))]
        capped |= {i: 3 * sizes[i] for i in over}


def rows_of(n, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "c", "𝒳", "～", "tiny"]
    return [(i, "w " * rng.choice([0, 1, 5, 80, 3000]), "tiny" if i == 3 else rng.choice(sources[:8])) for i in range(n)]


def test_targets_and_words_taken(spark):
    rows = rows_of(300, 4)
    got = {r.doc_id: r for r in mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()}
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == name) for name in names]
    targets = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for i, text, source in rows:
        r, k = got[i], names.index(source)
        assert (r.size, r.source_size) == (len(text.split()), sizes[k]) and r.target == pytest.approx(targets[k])
        assert 0 <= r.taken <= 3 * r.size
    for name, target in zip(names, targets):
        taken = sum(got[i].taken for i, _, s in rows if s == name)
        assert abs(taken - target) <= 0.01 * target + 20
    again = mixed(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {i: r.taken for i, r in got.items()}


@pytest.mark.parametrize("slots", [64, 5000])
def test_few_slots_keep_the_bounds(spark, slots):
    rows = rows_of(200, 9)
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=slots).collect()
    block = max(1, sum(r.size for r in got) // slots)
    assert all(r.taken <= 3 * r.size for r in got)
    for source in {s for _, _, s in rows}:
        own = [r for r in got if dict((i, s) for i, _, s in rows)[r.doc_id] == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8 * block


def test_equals_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    duckdb.sql("create or replace view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(duckdb.sql(SQL).fetchall())
    got = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixed(docs).collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_edge_rows(spark):
    rows = [(1, None, "a", 1.0), (1, None, "a", 1.0), (2, "", None, 1.0), (3, "x y", None, 1.0), (3, "x y", None, 2.0), (None, "z", "a", 1.0), (4, "long " * 50000, "a", 1.0)]
    got = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, target double")).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size) for r in got) == sorted([("1", 0, 50001), ("1", 0, 50001), ("2", 0, 4), ("3", 2, 4), ("3", 2, 4), ("None", 1, 50001), ("4", 50000, 50001)])
    none = mixed(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0.0, 0)]
    assert mixed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_small_sources_come_near_their_targets_in_a_large_corpus(spark):
    # blocks of the whole corpus would have 4,700 words, as at 5e9 words with the usual number of slots
    rows = [(i, "w " * 20_000, "big") for i in range(24)] + [(100 + i, "w " * 100, "a tiny") for i in range(10)] + [(200 + i, "w " * 60, "small") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(docs, slots=104).collect()
    for first, last in ((0, 24), (100, 110), (200, 300)):
        own = [r for r in got if first <= r.doc_id < last]
        assert all(r.taken <= 3 * r.size for r in own) and sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)


def test_rows_have_a_decision_each(spark, tmp_path):
    rows = [(1, "a b c", "x", 9, 1), (1, "a b", "x", 9, 2), (1, "a b", "x", 9, 3), (None, "d", "x", 9, 4), (None, "e f", None, 9, 5), (2, None, "x", 9, 6), (2, "", "x", 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _file int").repartition(3)
    docs.write.parquet(f"file://{tmp_path}/docs")
    for table in (docs, spark.read.parquet(f"file://{tmp_path}/docs")):
        got = sorted((r._file, r.doc_id, r.text, r.source, r.size) for r in mixed_rows(table).collect())
        want = {n: (n, i, text, source, len(text.split())) for i, text, source, _, n in rows if text}
        assert len({g[0] for g in got}) == len(got) and all(want[g[0]] == g for g in got)
        full = {r._file: r.taken for r in mixed(table, carry=("_file",)).collect()}
        assert [g[0] for g in got] == sorted(n for n, taken in full.items() if taken > 0)
    assert set(mixed_rows(docs).columns) == {"doc_id", "text", "source", "_file", "size", "target", "taken"}
