"""License scans: MinHash bands over overlapping word windows retrieve templates, shingle containment verifies them.

Words are runs of letters and digits, lower-cased; shingles are three words. Templates are put into classes of 8, 16, 32,
... words by their length; for each class, texts are cut into windows of 1.25 times as many words that begin every
quarter, so some window holds any passage of a template's length whole. A full copy then makes up a share of at least
0.3 of its window's shingles, and with BANDS bands of one row at least one minimum is the template's own with probability
1 - 0.7**32 = 0.99999.

A band can only agree if the window holds the very shingle that is the template's minimum. So windows without any of the
templates' minima (a literal set) can't be retrieved, and only windows with one are hashed. A retrieved template
is verified on exact shingle sets: containment is the share of the template's shingles in the window.

Only built-in functions of DataFrames are used. Templates are a parameter of bounded size.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANDS = 32
SIZE = 3
#: Shingles that are minima of templates: more are refused, as they are part of the plan.
MOST_MINIMA = 20_000
#: Statements and notices of common licenses. Fixed values.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_WORDS = r"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+', 0)"
_SHINGLES = f"case when size(w) >= {SIZE} then transform(sequence(0, size(w) - {SIZE}), i -> xxhash64({', '.join(f'get(w, i + {k})' for k in range(SIZE))})) else array() end"


def _shingled(rows: DataFrame) -> DataFrame:
    """Adds h, the hashed shingles in order, to rows with a column text; fewer than three words have none."""
    words = _WORDS.format(text="text")
    # bound by a lambda, so that a filter pushed below can't compute the words anew for each shingle
    return rows.withColumn("h", F.expr(f"cast(element_at(transform(array({words}), w -> {_SHINGLES}), 1) as array<bigint>)"))


def _minima(hashes: str) -> str:
    return f"transform(sequence(1, {BANDS}), j -> array_min(transform({hashes}, x -> xxhash64(x, j))))"


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, word, containment): a template that a text holds, where its best window begins (in words from 0), and
    the share of the template's shingles there, which is `least` or more. One row per text and template.

    Defined results: null, empty and short texts hold nothing; a template below three words is never found; rows that
    repeat an id give one row per template together; windows that tie: the first; a missing id stays missing; other
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    forms = _shingled(spark.createDataFrame([(name, text or "") for name, text in templates.items()], "template string, text string"))
    forms = forms.withColumn("n", F.size("h")).where("n > 0").withColumn("own", F.array_distinct("h")).withColumn("minima", F.expr(_minima("own")))
    known = [(r.template, r.n + SIZE - 1, r.own, r.minima) for r in forms.select("template", "n", "own", "minima").collect()]  # as many rows as the parameter has
    seeds = sorted({x for row in forms.select(F.expr(f"transform(sequence(1, {BANDS}), j -> array_min(transform(own, x -> struct(xxhash64(x, j) as m, x as x))).x) as s")).collect() for x in row.s})
    if len(seeds) > MOST_MINIMA:
        raise ValueError(f"templates have {len(seeds)} minima; {MOST_MINIMA} at most")
    kind = docs.schema[id_col].dataType.simpleString()
    if not seeds:
        return spark.createDataFrame([], f"{id_col} {kind}, template string, word long, containment double")
    groups: dict[int, list] = {}
    for name, words, own, minima in known:
        groups.setdefault(max(8, 1 << ceil(log2(words))), []).append((name, own, minima))
    held = ", ".join(f"{x}L" if x > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)" for x in seeds)
    rows = _shingled(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))).drop("text")
    rows = rows.withColumn("hits", F.expr(f"filter(transform(h, (x, i) -> if(x in ({held}), i, -1)), i -> i >= 0)")).where("size(hits) > 0")
    # windows of a class that hold a hit: those that begin at most its length before, on a multiple of the step
    spans = []
    for words in sorted(groups):
        step, length = words // 4, words + words // 4 - SIZE + 1
        starts = f"transform(hits, i -> sequence(greatest(0, i - {length - 1} + {step - 1}) div {step}, i div {step}))"
        spans.append(f"transform(array_distinct(flatten({starts})), s -> named_struct('class', {words}, 'word', s * {step}, 'own', array_distinct(slice(h, cast(s * {step} + 1 as int), {length}))))")
    windows = rows.select("id", F.explode(F.expr(f"concat({', '.join(spans)})")).alias("v")).select("id", "v.*").withColumn("minima", F.expr(_minima("own")))
    bands = windows.select("id", "class", "word", "own", F.posexplode("minima").alias("band", "least"))
    table = spark.createDataFrame([(words, name, own, j, m) for words, members in groups.items() for name, own, minima in members for j, m in enumerate(minima)], "class int, template string, shingles array<long>, band int, least long")
    met = bands.join(F.broadcast(table), ["class", "band", "least"])  # at most BANDS rows per template of the parameter
    share = F.expr("size(array_intersect(shingles, own)) / size(shingles)")
    found = met.select("id", "template", F.col("word").cast("long"), share.alias("containment")).where(F.col("containment") >= least)
    best = found.groupBy("id", "template").agg(F.max("containment").alias("containment"), F.min(F.struct((-F.col("containment")).alias("c"), "word")).alias("b"))
    return best.select(F.col("id").alias(id_col), "template", F.col("b.word").alias("word"), "containment")
