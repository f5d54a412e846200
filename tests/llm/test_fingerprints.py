import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from docspark.llm import fingerprints as module
from docspark.llm.fingerprints import PARTS, fingerprints, lexicon, ranged


def edited(rows):
    """{id: (n, sha256)} of rows in the order of ids."""
    out = {}
    for k, (i, text) in enumerate(rows):
        text, follower = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out[i] = (len(text), hashlib.sha256((text[: len(text) - half] + follower[:half]).encode()).hexdigest())
    return out


@pytest.mark.parametrize("range_rows", [7, 2000])
def test_documents(spark, monkeypatch, range_rows):
    monkeypatch.setattr(module, "RANGE_ROWS", range_rows)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints(docs.repartition(5)).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == edited(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        r = got[i]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint.split()) == 1 + 3 * PARTS
        for mine, other, near in ((r.fingerprint, r.edited_fingerprint, r.near_edited), (r.fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint, r.near_next)):
            pairs = [(a, b) for a, b in zip(mine.split(), other.split()) if (a, b) != ("-", "-")]
            assert near == pytest.approx(np.mean([a == b for a, b in pairs]) if pairs else 1.0)
    assert np.mean([r.near_edited for r in got.values()]) > 2 * np.mean([r.near_next for r in got.values()])


def test_lexicon_is_the_band_of_document_frequency(spark):
    texts = [" ".join(f"w{j}" for j in range(100) if i % (j + 1) == 0) + " W0 once%d" % i for i in range(200)]
    found = lexicon(spark.createDataFrame([(t,) for t in texts], "text string"), 0.05, 0.2)
    want = {w for w in {w.lower() for t in texts for w in t.split()} if 10 <= sum(w in t.lower().split() for t in texts) <= 40}
    hashes = spark.createDataFrame([(w,) for w in want], "w string").selectExpr("xxhash64(w) h").collect()
    assert sorted(r.h for r in hashes) == found


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é𝒳a"), (4, "long " * 60000), (5, "é𝒳a"), (None, "z")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fingerprint long")
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == edited(rows)
    assert got[3].fingerprint == got[5].fingerprint != got[4].fingerprint and got[1].near_next == 1.0 and got[2].near_next == 0.0
    twice = fingerprints(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 2
    one = fingerprints(spark.createDataFrame([(1, "abc d")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcab").hexdigest() and one.near_next == 1.0
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_id_that_repeats_fills_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE_ROWS", 10)
    rows = [(i, f"text {i}") for i in range(30)] + [(30, f"copy {k}") for k in range(120)] + [(None, f"none {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed = ranged(docs.selectExpr("doc_id id", "text"), len(rows) // 10).collect()
    parts = Counter(r.range for r in placed)
    assert max(parts.values()) < 40 and len(parts) > 8
    order = sorted(placed, key=lambda r: (r.key, r.tie))
    assert [r.range for r in order] == sorted(r.range for r in placed)
    got = Counter((r.n_chars, r.edited_sha256) for r in fingerprints(docs).collect())
    assert got == Counter(edited([(k, r.text) for k, r in enumerate(order)]).values())


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = {i: {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)} for i, t in texts.items()}
    counts = Counter(w for own in words.values() for w in own)
    n = len(texts)
    known = {w for w, c in counts.items() if max(1, 0.001 * n) <= c <= max(1, 0.1 * n)}
    # Spark's own hashes of words, of hashes with the number of a sub-lexicon, and of joined texts
    term = {r.w: r.h for r in spark.createDataFrame([(w,) for w in counts], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    bits = {r.h: r.b for r in spark.createDataFrame([(term[w],) for w in known], "h long").selectExpr("h", f"transform(sequence(0, {3 * PARTS - 1}), k -> xxhash64(h, k)) b").collect()}
    lists = {}
    for i, own in words.items():
        inside = sorted(term[w] for w in own if w in known) or sorted(term[w] for w in own)
        parts = [inside] + [[t for t in inside if t in bits and bits[t][level * PARTS + part] & ((1 << size) - 1) == 0] for level, size in enumerate((3, 5, 7)) for part in range(PARTS)]
        lists[i] = parts if any(t in bits for t in inside) else None  # texts without known terms are in another test
    joined = sorted({",".join(map(str, p)) for parts in lists.values() if parts for p in parts if p})
    shown = {r.t: r.h for r in spark.createDataFrame([(t,) for t in joined], "t string").selectExpr("t", "lower(hex(xxhash64(t))) h").collect()}
    got = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    checked = 0
    for i, parts in lists.items():
        if parts:
            checked += 1
            assert got[i] == " ".join(shown[",".join(map(str, p))] if p else "-" for p in parts)
    assert checked > 100
