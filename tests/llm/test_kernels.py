import numpy as np
import pytest

from docspark.llm.kernels import _PRIMES, _TABLES, Words, mix
from docspark.llm.packed import Chunk, chunk_table
from docspark.llm.scratch import Scratch, integer_id


def hashes(text, **how):
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), **how).hashes


def test_hashes_are_the_polynomials():
    words = ["a", "zebra", "é", "zebra", "x" * 5000]
    for family, found in enumerate(hashes(" ".join(words), families=2)):
        for word, value in zip(words, found):
            key = 0
            for (prime, base), table in zip(_PRIMES, _TABLES[family]):
                key = key << 32 | sum(int(table[b]) * pow(base, k, prime) for k, b in enumerate(word.encode())) % prime
            length = np.uint64(len(word.encode()) * 0x9E3779B97F4A7C15 % (1 << 64))
            assert mix(np.array([key], np.uint64) + length)[0] == value


def test_regular_words_differ():
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
        other = one.translate(str.maketrans("ab", "ba"))
        for found in hashes(f"{one} {other}", families=2):
            assert found[0] != found[1]


def test_chunks_keep_the_rows(spark):
    rows = [(i, "w" * (i * 37 % 400)) for i in range(300)] + [(None, None)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    found = chunk_table(docs, Scratch(spark), lambda data, offs: len(data), size=5000).collect()
    chunks = [Chunk(r.asDict()) for r in found]
    assert all(r.words == len(c.data) <= 5000 for r, c in zip(found, chunks)) and len(chunks) > 10
    pieces = [p for c in sorted(chunks, key=lambda c: c.key) for p in c.pieces(700)]
    assert [int(i) for p in pieces for i in p.ids][:-1] == [i for i, _ in rows][:-1]
    assert [int(n) for p in pieces for n in np.diff(p.offs)] == [len(t or "") for _, t in rows]


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        integer_id(spark.createDataFrame([("a",)], "doc_id string"), "doc_id")
