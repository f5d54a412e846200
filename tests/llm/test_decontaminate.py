import random

import numpy as np

from docspark.llm import decontaminate
from docspark.llm.decontaminate import contaminated, decontaminated


def fold(text):
    return bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def least_edits(item, text):
    """Fewest edits of an occurrence of `item` anywhere in `text`, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, rng.choice("xyzé ")), lambda: out.pop(at), lambda: out.insert(at, rng.choice("qé"))])()
    return "".join(out)


def test_equals_the_whole_alignment(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "the", "of", "and", "to", "in"]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, phrase(rng.randint(5, 16))) for i in range(25)] + [(90, "tiny"), (91, ""), (92, None), (None, phrase(9))]
    docs = []
    for i in range(220):
        text = phrase(rng.randint(0, 12))
        if rng.random() < 0.7:
            item = rng.choice(items[:25])[1]
            text += rng.choice(["", "\n"]) + edited(rng, item, rng.choice([0, 1, 3, round(len(item) * 0.1), round(len(item) * 0.13), 30])) + phrase(rng.randint(0, 6))
        docs.append((i, text))
    docs += [(900, None), (901, ""), (902, "TINY"), (903, "tiny bit")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(frame, bench).collect()
    want = {}
    for d, text in docs:
        for i, item in items[:25]:
            p, t = fold(item), fold(text)
            k = min(int(len(p) * 0.1), len(p) // 8 - 1)
            edits = least_edits(p, t)
            if edits <= k:
                want[d, i] = edits
    want[902, 90] = 0
    best = {}
    for r in got:
        key = (r.doc_id, r.item_id)
        best[key] = min(best.get(key, 99), r.edits)
        assert least_edits(fold(dict(items)[r.item_id]), fold(dict(docs)[r.doc_id][r.begin : r.end])) == r.edits
    assert best == want
    clean = decontaminated(frame, bench).collect()
    assert sorted(r.doc_id for r in clean) == sorted(d for d, _ in docs if d not in {k[0] for k in want})


def test_passages_planted_in_documents_are_found_and_others_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {r.doc_id for r in contaminated(docs, bench).collect()}
    texts = {r.item_id: r.text for r in bench.collect()}
    exact = {r.doc_id for r in docs.collect() if any(t in r.text for t in texts.values())}
    assert exact and exact <= found and len(found - exact) <= 0.02 * docs.count()


def test_many_items_are_taken_in_blocks_and_columns_stay(spark, monkeypatch):
    rows = [(1, "one two three four five six seven", 0.5), (2, "eight nine ten eleven twelve thirteen", None), (2, None, 1.0), (None, "seven eight nine ten " * 20000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits double")
    bench = spark.createDataFrame([(i, f"{w} item number {i} with words of its own") for i, w in enumerate("abcdefgh")] + [(50, "two three four five six")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert [tuple(r) for r in contaminated(docs, bench).collect()] == [(1, 50, 4, 27, 0)]
    left = decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, none).count() == 0 and decontaminated(docs, none).count() == 4
    assert contaminated(docs.limit(0), bench).count() == 0


def test_finds_items_at_the_end_of_texts_above_16_mib(spark):
    docs = spark.createDataFrame([(1, "The rest. " * 1_800_000 + "abcdefgh"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "abcdefgh")], "item_id long, text string")
    assert [tuple(r) for r in contaminated(docs, items).collect()] == [(1, 7, 18_000_000, 18_000_008, 0)]


def test_repeating_texts_are_counted_in_slices(monkeypatch):
    text, item = "a" * 3000 + "b" + "a" * 40, "a" * 90 + "b" + "a" * 9
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    whole = decontaminate.Items([1], [item], 8, 0.1).matches(data, offs)
    for name, value in (("POSTINGS", 1000), ("CELLS", 500), ("PATTERNS", 300)):
        monkeypatch.setattr(decontaminate, name, value)
    assert decontaminate.Items([1], [item], 8, 0.1).matches(data, offs) == whole and (0, 1, 2910, 3010, 0) in whole


def test_bands_whose_shared_grams_leave_more_edits_than_allowed_are_not_aligned(monkeypatch):
    """A phrase that a text repeats shares many places with an item that has it once, but few of the item's q-grams."""
    phrase, rest = "as is well known to us ", "every other word of this one occurs nowhere else, so it never is a match at all "
    item = rest + phrase + rest[::-1]
    texts = [phrase * 40, "before " + item.replace("other", "othr").replace("drow", "dxrow") + phrase * 40, "nothing of that"]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    seen, whole = [], decontaminate.Items.aligned
    monkeypatch.setattr(decontaminate.Items, "aligned", lambda self, d, o, row, *rest: seen.extend(row.tolist()) or whole(self, d, o, row, *rest))
    (found,) = decontaminate.Items([5], [item], 8, 0.1).matches(data, offs)
    assert found[:2] == (1, 5) and found[4] == 2 and set(seen) == {1} and len(seen) <= 4


def test_nothing_is_lost_before_the_alignment(monkeypatch):
    rng, fewer = random.Random(5), 0
    for turn in range(60):
        letters, q, share = rng.choice(["ab", "abc ", "abcdefgh é"]), rng.choice([2, 3, 5, 8, 11]), rng.choice([0.0, 0.1, 0.3])
        make = lambda n: "".join(rng.choices(letters, k=n))
        items = [make(rng.randint(6, 60)) for _ in range(6)]
        texts = ["", make(200)] + [make(rng.randint(0, 9)) + edited(rng, rng.choice(items) * rng.randint(1, 3), rng.randint(0, 9)) + make(rng.randint(0, 9)) for _ in range(12)]
        data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
        block, asked, possible = decontaminate.Items(list(range(6)), items, q, share), [], decontaminate.Items.possible
        with monkeypatch.context() as m:
            m.setattr(decontaminate.Items, "possible", lambda *a: asked.append(possible(*a)) or asked[-1])
            if turn % 2:
                m.setattr(decontaminate, "CELLS", 700)
            got = block.matches(data, offs)
            fewer += sum(int((~a).sum()) for a in asked)
            m.setattr(decontaminate.Items, "possible", lambda self, grams, offs, row, *rest: np.ones(len(row), bool))
            assert got == block.matches(data, offs), turn
    assert fewer > 100
