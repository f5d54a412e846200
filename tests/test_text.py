import re

import pytest

from docspark.functions import text as T


def value(spark, sql, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.selectExpr(f"{sql} as v").first().v


@pytest.mark.parametrize(("word", "stem"), [("operations", "operate"), ("operation", "operate"), ("operates", "operat"), ("nation", "nation"), ("nations", "nation"), ("classes", "class"), ("jamming", "jamm"), ("jammed", "jamm"), ("jam", "jam"), ("planning", "plan"), ("2,000", "2,00"), ("10.55", "10.5"), ("1999", "1999"), ("it's", "it"), ("flies", "fli"), ("stories", "story"), ("glass", "glass"), ("summaris", "summari"), ("'tis'", "tis")])
def test_stems(spark, word, stem):
    assert value(spark, T.stem("w"), w=word) == stem


def test_clean(spark):
    dirty = "co-\nop [12] x[note 3] [Citation Needed]\x00see https://a.b/c?d www.x.y\t\tend A-\nB \n"
    assert value(spark, T.clean("w"), w=dirty) == "coop x see end A-\nB"


def test_terms_and_spans(spark):
    text = "𝒳 The operations, isn't Radar's 10.5% of café"
    assert value(spark, T.terms("w"), w=text) == ["operate", "isn't", "radar", "10.5", "caf"]
    got = [(r.stem, text[r.first : r.end]) for r in value(spark, T.spans("w"), w=text)]
    assert got == [("operate", "operations"), ("isn't", "isn't"), ("radar", "Radar's"), ("10.5", "10.5"), ("caf", "caf")]
    assert [(h.start, h.end) for h in value(spark, T.highlights("w", "array('operate', 'radar', '10.5')"), w=text)] == [(6, 16), (24, 36)]
    assert value(spark, T.query_terms("w"), w="List the main Radar uses and radar types in this document") == ["radar", "use", "typ"]
    assert value(spark, T.proper_terms("w"), w="What did Nato say about The EW Overview?") == ["nato", "ew", "overview"]


def test_sentences_and_marks(spark):
    assert value(spark, T.sentences("w"), w="One two. Three (x)! \"Four\" five? six. 7 eight. A") == ["One two.", "Three (x)!", '"Four" five? six.', "7 eight."]
    assert value(spark, T.citation_marks("w"), w="ISBN 1, doi: 2, Retrieved 3, retrieved") == 3
    assert value(spark, T.dedupe_key("w"), w="It's, É — ok!") == "itséok"
    assert value(spark, T.pages("w", 3), w="abcdefg") == ["abc", "def", "g"] and value(spark, T.pages("w"), w="") == [""]


def plain_chunks(text):
    """The windows of a text, step by step."""
    flat, out, pos = " ".join(text.split()), [], 0
    while pos < len(flat):
        end = min(pos + 1000, len(flat))
        if end < len(flat):
            places = [m.start() for m in re.finditer(r"[.?] ", flat[pos + 500 : end])] or [m.start() for m in re.finditer(" ", flat[pos + 500 : end])]
            end = pos + 500 + places[-1] + 1 if places else end
        if len(flat[pos:end].strip()) > 40:
            out.append(flat[pos:end].strip())
        if end == len(flat):
            return out
        pos = max(end - 180, pos + 1)
        blank = flat.find(" ", pos)
        pos = blank + 1 if 0 <= blank < end else pos
    return out


def test_chunks(spark):
    texts = ["", "x" * 40, "x" * 41, "x" * 1000, "x" * 1001, "x" * 5000, "ab? " * 700, "ab! " * 700, "One two three. Four five six " * 200, "word \n\n " * 900 + "z" * 3000]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + docs)], "i int, t string")
    got = [r.c for r in frame.selectExpr("i", f"{T.chunks('t')} as c").orderBy("i").collect()]
    assert got == [plain_chunks(t) for t in texts + docs]
