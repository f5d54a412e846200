import zlib

import numpy as np

from docspark.llm.language_id import LanguageModel, languages


def test_backs_off_from_words_to_shorter_grams():
    grams = {g: {"aa": c, "bb": d} for g, c, d in [("k", 5, 1), ("ko", 9, 1), ("z", 1, 7), (" ", 3, 3), ("o", 2, 2)]}
    counts = lambda table: ([*table], np.array([[c.get(x, 0) for x in ("aa", "bb")] for c in table.values()], float))
    model = LanguageModel(["aa", "bb"], counts({"the": {"aa": 8}, "der": {"bb": 8}}), [counts({g: c for g, c in grams.items() if len(g) == n}) for n in (1, 2)])
    log = lambda table, key, k: np.log((table[key].get("ab"[k] * 2, 0) + 0.5) / sum(table[x].get("ab"[k] * 2, 0) + 0.5 for x in table if len(x) == len(key)))
    words = {"the": {"aa": 8}, "der": {"bb": 8}}
    assert model.languages == ["aa", "bb"]
    assert np.allclose(model.word("the"), [log(words, "the", 0), log(words, "the", 1)])
    assert np.allclose(model.word("(the),"), model.word("the"))
    assert np.allclose(model.word("koz"), [2 * log(grams, " ", k) + log(grams, "ko", k) + log(grams, "z", k) for k in (0, 1)])
    assert not model.word("12-34").any() and model.word("ko")[0] > model.word("ko")[1]


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = languages(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_predictions_use_text_only_and_a_bounded_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = {r.doc_id: r.lang_pred for r in languages(docs, max_documents=40, max_words=500, max_grams=500).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([few[i] == lang[i] for i in lang]) > 0.85
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    other = spark.createDataFrame([(r.doc_id, r.text, "xx" if r in held else r.lang) for r in docs.collect()], "doc_id long, text string, lang string")
    assert {tuple(r) for r in languages(other).collect()} == {tuple(r) for r in languages(docs).collect()}


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1.0), (3, "le chat et le chien", "fr", 1.0), (4, None, "en", 1.0), (5, "", None, 1.0), (6, "12 ?! \n", "en", 1.0), (None, "the", None, 1.0), (7, "the " * 90000, None, 1.0), (8, "漢字", None, 1.0), (8, "漢字", None, 1.0)]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()
    found = sorted((str(r.doc_id), r.lang_pred) for r in got)
    assert found == sorted([("1", "en"), ("3", "fr"), ("4", "und"), ("5", "und"), ("6", "und"), ("None", "en"), ("7", "en"), ("8", dict(found)["8"]), ("8", dict(found)["8"])])
    assert dict(found)["8"] in ("en", "fr")
    nothing = languages(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [tuple(r) for r in nothing] == [(1, False, "und", 0.0)]
    assert languages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_learns_all_labels(spark):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2][:1100]
    rows = [(i, f"w{i}x w{i}x", f"label {i}") for i in ids]
    got = languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: label for i, _, label in rows}


def test_learns_from_whole_words(spark):
    rows = [(1, "k" * 250 + "zq" * 50, "aa"), (3, "k" * 250 + "vw" * 50, "bb"), (4, "zqzq", None), (5, "vwvw", None)]
    got = {r.doc_id: r.lang_pred for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[4], got[5]) == ("aa", "bb")
