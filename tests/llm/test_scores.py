import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from docspark.llm import suffix_tree
from docspark.llm.suffix_tree import SYMBOLS, suffix_tree_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def units(words):
    """Symbols of each token with what precedes it, and where its own begin."""
    for before, word in zip([None, *words], words):
        lead = (b" " + before.encode())[-3:] + b" " if before is not None else b" "
        yield lead + (b"\n" if word is None else word.encode() + b" "), len(lead)


def brute(rows, depth=6, min_gain=2.0, weight=8.0):
    """Base and tree scores by plain dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    train = Counter(t for i, text in rows if not held[i] for t in tokens(text))
    n, v = sum(train.values()), len(train)
    following = defaultdict(Counter)
    for i, text in rows:
        for symbols, lead in () if held[i] else units(tokens(text)):
            for k in range(lead, len(symbols)):
                for length in range(min(k, depth) + 1):
                    following[symbols[k - length : k]][symbols[k]] += 1
    kept = {b""}
    for context, own in following.items():
        if context:
            up, t = following[context[1:]], sum(own.values())
            gain = sum(c * math.log((c / t) / (up[s] / sum(up.values()))) for s, c in own.items())
            if gain >= min_gain:
                kept |= {context[k:] for k in range(len(context))}
    def after(state, symbol):
        below = after(state[1:], symbol) if state else 1 / SYMBOLS
        return (following[state][symbol] + weight * below) / (sum(following[state].values()) + weight)

    out = {}
    for i, text in rows:
        base = sum(math.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))
        score = 0.0
        for symbols, lead in units(tokens(text)):
            for k in range(lead, len(symbols)):
                state = next(symbols[k - length : k] for length in range(min(k, depth), -1, -1) if symbols[k - length : k] in kept)
                score += math.log10(after(state, symbols[k]))
        out[i] = (held[i], len(tokens(text)), sum(train[t] > 0 for t in tokens(text)), n, base, score)
    return out


def check(rows, got, **how):
    want = brute(rows, **how)
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], rel=1e-9)


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, suffix_tree_scores(docs, depth=3).collect(), depth=3)


def test_beats_the_base_on_held_out_documents(spark):
    got = [r for r in suffix_tree_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert len(got) > 50 and np.sum([r.score for r in got]) > np.sum([r.base_score for r in got])


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a\x00b A\x00B é"), (5, "x" * 70000), (6, "w " * 50000), (7, "un seen"), (0, "a b a b")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string")
    check(rows, suffix_tree_scores(docs).collect())
    none = suffix_tree_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in none] == [(None, False, 3, 3)]
    assert suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = suffix_tree_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (alone.n_known, alone.train_tokens) == (0, 0) and alone.score == pytest.approx(-4 * math.log10(SYMBOLS))


def test_keeps_every_context_that_diverges(spark):
    rng = random.Random(5)
    signs = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
    words = ["".join(rng.choices(signs, k=8)) for _ in range(22_000)]
    rows = [(i, " ".join(words[k : k + 500])) for i, k in enumerate([*range(0, 22_000, 500)] * 2)]
    # more than 100,000 contexts of 3 symbols diverge
    found = suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=3).collect()
    check(rows, found, depth=3)


def test_workers_hold_little_besides_a_chunk(spark, monkeypatch):
    docs, steps = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1), []  # one chunk
    plain_send, plain_apply = suffix_tree.send, PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(suffix_tree, "send", lambda chunks, split, schema: steps.append((chunks, split)) or plain_send(chunks, split, schema))
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, run, schema: steps.append((self, run)) or plain_apply(self, run, schema))
    suffix_tree_scores(docs)
    (chunks, ask), (full, score) = steps[0], steps[-1]
    row = chunks.first().asDict()

    def peak(step):
        step()  # tables that stay
        tracemalloc.start()
        out = step()
        mb = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return mb, out

    ask_mb, asked = peak(lambda: sorted(ask(row)))
    assert ask_mb < 85
    text, replies = (side._df.toArrow() for side in (full._gd1, full._gd2))
    score_mb, scored = peak(lambda: score(text, replies).to_pydict())
    assert score_mb < 85
    # nothing depends on where pieces and parts end
    monkeypatch.setattr(suffix_tree, "PIECE_BYTES", 300_000)
    monkeypatch.setattr(suffix_tree, "SORTED", 70_001)
    parted = score(text, replies).to_pydict()
    assert parted.pop("score") == pytest.approx(scored.pop("score"), rel=1e-12)
    assert parted == scored and sorted(ask(row)) == asked
