from docspark.operators import presentation as P


def test_marks_pages_and_labels(spark):
    rows = spark.createDataFrame([("ab cd ef", [(0, 2), (1, 4), (6, 8)], "x [P1] **b** [P9]", [("P1", 7)], "a (p.2)\nb (p.10)", "long.name.of.a.file.with.many.parts.pdf")], "t string, h array<struct<start:int,end:int>>, a string, s array<struct<id:string,page:int>>, m string, n string")
    got = rows.selectExpr(f"{P.marked('t', 'h', '<', '>')} as t", f"{P.with_pages('a', 's')} as a", f"{P.bold_parts('a')} as b", f"{P.summary_pages('m')} as m", f"{P.short_name('n')} as n", f"{P.keyword_question('t')} as q").first()
    assert tuple(got) == ("<ab> cd <ef>", "x [p.7] **b** [P9]", ["b"], [2, 10], "long.name.of.a.file.with.man", "What does the document say about ab cd ef?")
    cards = spark.createDataFrame([(1, 4.0, True, False), (1, 1.0, False, False), (2, 0.5, True, True)], "qid int, score double, cited boolean, weak boolean")
    assert sorted((r.badge, r.bar) for r in P.score_bars(P.badges(cards)).collect()) == [("cited", 90.0), ("closest match", 45.0), ("related", 22.5)]
