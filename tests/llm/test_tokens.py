import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docspark.llm.token_counts import PairMerger, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_strings_count_as_in_the_library(library):
    merger, rng = PairMerger(PATH), random.Random(7)
    parts = [*"abcSTΣΣς'’   ́éİIßǅ1٣>>!?漢字😀‍﻿ ſK\n\t\x1c\x00", "<|endoftext|>", "<|startoftext|>", "'re", "'S", "ing", "the"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids), ascii(text)


def test_operator_and_edge_rows(spark, library):
    texts = [None, "", " \t\n", "a", "the the\x0bthe", "x" * 5000, "word " * 30000, "<|endoftext|>a<|startoftext|>"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "a", "y"), (None, "b c", "z")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, limit=3).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
