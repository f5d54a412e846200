import regex
from test_near_dedup import brute as groups
from test_pii import replaced

import corpus_pipeline
from docspark.llm.language_id import languages
from docspark.llm.mixing import mixed
from docspark.llm.pii import PATTERN


def test_stages_equal_plain_steps_on_documents(spark, monkeypatch):
    import test_pii

    monkeypatch.setattr(test_pii, "KEY", corpus_pipeline.PII_KEY)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = {r.doc_id: r for r in languages(docs).collect()}  # held against its own tests
    kept = {r.doc_id: r for r in docs.collect() if named[r.doc_id].lang_pred != "und" and named[r.doc_id].score >= 0.5}
    near = groups([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    fold = lambda t: regex.sub(r"[\t-\r]", " ", t.lower())
    exact = {i for i, r in kept.items() if any(fold(item) in fold(r.text) for item in items)}
    kept = {i: r for i, r in kept.items() if i not in exact}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    rows = [(i, regex.sub(PATTERN, lambda m: replaced(m[0]), r.text), r.source) for i, r in kept.items()]
    taken = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()  # held against SQL in its own tests
    assert exact and {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in taken if r.taken > 0}
    for i, r in got.items():
        assert r.text == regex.sub(PATTERN, lambda m: replaced(m[0]), kept[i].text)
        assert (r.lang, r.source, r.n_chars) == (kept[i].lang, kept[i].source, kept[i].n_chars)
        assert 0 < r.taken <= 3 * r.size


def test_every_stage_keeps_the_columns_and_takes_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "the cat and the dog " * 9, "en", None, 5, 3), (3, "le chat et le chien " * 9, "fr", "b", 5, 4), (4, "The cat and the dog " * 9, "en", "b", 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "/root/testdata/sf0.001")
            assert now.columns == docs.columns
        assert sorted(r.doc_id for r in now.collect()) == ([] if empty else [2, 3])
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == (0 if empty else 2)
