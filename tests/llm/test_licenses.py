import random

import regex

from docspark.llm.licenses import TEMPLATES, licenses


def shingles(text):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return [tuple(words[i : i + 3]) for i in range(len(words) - 2)]


def brute(rows, templates=TEMPLATES, least=0.75):
    """{(id, template): (first best word, containment)} over all windows of the template's class."""
    out = {}
    for i, text in rows:
        own = shingles(text)
        for name, form in templates.items():
            want = set(shingles(form))
            if not want:
                continue
            size = 8
            while size < len(shingles(form)) + 2:
                size *= 2
            step, length = size // 4, size + size // 4 - 2
            for start in range(0, max(1, len(own)), step):
                share = len(want & set(own[start : start + length])) / len(want)
                if share >= least and share > out.get((i, name), (0, 0))[1]:
                    out[i, name] = (start, share)
    return out


def found(frame, *args, **kw):
    rows = licenses(frame, *args, **kw).collect()
    out = {(r.doc_id, r.template): (r.word, r.containment) for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = found(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {t for _, t in got} >= {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"}


def test_edited_templates_anywhere_in_a_text(spark):
    rng, rows = random.Random(8), []
    for i in range(250):
        words = rng.choice(list(TEMPLATES.values())).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["the", "license", "zz"])
        lead = [rng.choice(["the", "of", "under", "software", "q"]) for _ in range(rng.randint(0, 70))]
        rows.append((i, " ".join([*lead, *words, *lead[:9]])))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), least=0.6) == brute(rows, least=0.6)


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the MIT", "x"), (4, "RELEASED\tunder--the (MIT) license", "x"), (5, "w " * 60000 + "Released under the MIT License." + " v" * 50000, "x"), (6, "Released under the MIT License.", "x"), (6, "Released under the MIT License.", "y"), (None, "Licensed under CC BY 4.0", "x")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string, template string"))
    assert {k: v[1] for k, v in got.items()} == {(i, "MIT"): 1.0 for i in (4, 5, 6)} | {(None, "CC-BY-4.0"): 1.0}
    assert found(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert found(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), {"x": "a b", "y": ""}) == {}
    assert found(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), {"x": "a b c", "y": None}) == {(1, "x"): (0, 1.0)}
