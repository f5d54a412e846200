import random
import re
from itertools import combinations

import numpy as np
import pytest

from docspark.llm.near_dedup import near_duplicates, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """{id: (n, component)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def test_signatures_estimate_similarity_and_hold_each_rank_once():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = base[:600], base[150:750]  # 450 of 750
    row = np.repeat([0, 1, 2], [600, 600, 3])
    sig = superminhash(row, np.concatenate([a, b, base[:3]]), 4)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    assert (sig[3] == np.uint64(2**64 - 1)).all()
    assert len(set((superminhash(np.zeros(1, int), base[:1], 1)[0] >> np.uint64(56)).tolist())) == 128  # one element: a permutation
    assert (superminhash(np.zeros(600, int), a[::-1].copy(), 1)[0] == sig[0]).all()  # order doesn't matter


def test_equals_brute_force_with_chains_and_families(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 60, 200]))
        for _ in range(rng.randint(1, 12)):  # each a small step from the one before: chains of links
            rows.append((rng.randrange(10**6), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rows = list(dict(rows).items())
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equals_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    rows = [(5, None, "x"), (6, "", "x"), (7, " \n", "x"), (9, "A b", "x"), (8, "a  B", "x"), (2, "long " * 40000, "x"), (1, "Long " * 39999, "x"), (None, "a b", "x"), (3, "one two three four five six", "x"), (3, "one two three four five six", "y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got)
    assert found == sorted([("5", 0, "5", True), ("6", 0, "6", True), ("7", 0, "7", True), ("9", 1, "8", False), ("8", 1, "8", True), ("2", 1, "1", False), ("1", 1, "1", True), ("None", 1, "None", True), ("3", 2, "3", True), ("3", 2, "3", True)])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
