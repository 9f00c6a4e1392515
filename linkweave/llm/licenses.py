"""Licence notices in text: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines; a long one is cut into overlapping windows. As notices are often wrapped, overlapping windows over
the words of several lines are paragraphs too, wherever the lines break and blank ones stand. Those of their word n-grams
(one and two words) that occur in templates make a vector of indicators, for which a multinomial logistic regression gives
the probability of each licence family and of none. The regression is trained on templates of every family, varied by
leaving out and adding words, against shuffled templates and against all paragraphs of the scanned documents that share no
pair of words with a template. As all of those count, those with the same words of templates are one weighted row; together
they weigh at most as much as `negatives` paragraphs, so that many documents do not outweigh the templates. A family stands if its own probability is at least one half and a template of the family is
found in the paragraph: a share `least_overlap` of the template's pairs of words. Other paragraphs may be of the family
"unknown": they hold at least two pairs of words of any templates, or the only pair they have is one, and their probability
of "some licence" is above that of all but `false_share` of the weight of the held-out paragraphs without licence text, of both
kinds.
This cut depends on what is held out, so it decides on "unknown" alone.

A notice is reported once for a line and for the lines around it: a paragraph of several lines is left out where one of its
lines is of its family, and an "unknown" one where a line or paragraph that shares lines with it says more. Overlapping
windows may each report the same notice.

Everything here is DataFrame expressions and MLlib; no Python code runs on executors.

Defined cases: null and empty texts and lines without words have no paragraphs; equal rows give equal rows; an empty table
gives an empty result, with a classifier trained on templates alone. Other columns are ignored. Positions count lines and
windows from 0; `line` and `last` are the paragraph's first and last line, and the windows of several lines are counted by
themselves in each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.session import staged

# Wordings by which licences are named or granted, by family.
TEMPLATES = [
    ("agpl", "This program is licensed under the GNU Affero General Public License version 3"),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License"),
    ("bsd", "Licensed under the 3-clause BSD License"),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "Licensed under the GPL version 2 or later"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "Released under the ISC License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "Licensed under the Mozilla Public License 2.0"),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("public-domain", "This work has been dedicated to the public domain under CC0 1.0 Universal"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
]
# Further identifiers of SPDX lines, by family.
SPDX = {
    "agpl": "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later",
    "apache": "Apache-1.1",
    "bsd": "BSD-2-Clause 0BSD",
    "cc-by": "CC-BY-3.0 CC-BY-4.0",
    "cc-by-nc": "CC-BY-NC-3.0 CC-BY-NC-4.0",
    "cc-by-sa": "CC-BY-SA-3.0 CC-BY-SA-4.0",
    "gpl": "GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only",
    "isc": "ISC",
    "lgpl": "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later",
    "mit": "MIT-0",
    "mpl": "MPL-1.1 MPL-2.0",
    "public-domain": "CC0-1.0 Unlicense",
}
TEMPLATES += [(family, f"SPDX-License-Identifier: {name}") for family, names in SPDX.items() for name in names.split()]
NONE, UNKNOWN = "none", "unknown"
# Words that stand around notices and say nothing about the family.
FILLER = "copyright 2019 2021 2024 the authors and contributors project file see full text for details code content www org com a of in on by all".split()

# So many steps of a probability are told apart when the cut is found.
STEPS = 100_000
WINDOW, STEP = 120, 60
# Over several lines: two windows share more words than the longest template has.
WRAP_WINDOW, WRAP_STEP = 60, 30


def words(text: Column) -> Column:
    """Lower-case words and numbers of a text; full stops belong to them, but not before white space or at the end."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?:[\p{L}\p{N}+-]++|[.]++(?!\s|$))++"), 0)


def pairs(w: Column) -> Column:
    """Neighbouring words, a pair as one string."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


@dataclass(frozen=True)
class Wordings:
    """The fixed templates' pairs of words, those of each template, and the n-grams that the classifier sees."""

    pairs: list[str]
    each: list[list[str]]
    grams: list[str]


def wordings(spark: SparkSession) -> Wordings:
    rows = templates(spark).select("w", F.array_distinct(pairs(F.col("w"))).alias("g")).collect()  # of the fixed templates
    known = sorted({g for r in rows for g in r["g"]})
    return Wordings(known, [r["g"] for r in rows], sorted({w for r in rows for w in r["w"]} | set(FILLER)) + known)


def _spans(start: Column, size: Column, window: int, step: int, span) -> Column:
    """`span(part, first, length)` of each of the overlapping windows of `size` words from position `start`, one at least."""
    count = F.greatest(F.lit(1), F.ceil((size - window) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: span(i, start + i * step, F.least(F.lit(window), size - i * step)))


def paragraphs(docs: DataFrame, known: list[str], shared: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, doc, line, last, part, w, hits): the words of each line, in windows where there are many, and windows of words
    over several lines; `hits` are its pairs of words among `known`. Only paragraphs with such pairs (`shared`) or only
    those without; `doc` is a hash of the text."""
    text = F.col(text_col).cast("string")
    # every step reads the one before more than once, so that Spark keeps them apart; none of them runs twice
    lines = docs.select(F.col(id_col), F.xxhash64(text).alias("doc"), F.transform(F.split(text, "\n"), words).alias("_lines"))
    number = F.flatten(F.transform("_lines", lambda w, line: F.array_repeat(line, F.size(w))))
    placed = lines.select(id_col, "doc", F.flatten("_lines").alias("_all"), number.alias("_line"))
    first = sorted({p.split(" ")[0] for p in known})

    def mark(word: Column, at: Column) -> Column:
        both = F.concat(word, F.lit(" "), F.get("_all", at + 1))
        return F.when(word.isin(first), F.when(both.isin(known), both))

    begins = F.array_compact(F.transform("_line", lambda line, at: F.when((at == 0) | (line != F.get("_line", at - 1)), at)))
    marked = placed.select(id_col, "doc", "_all", "_line", F.transform("_all", mark).alias("_marks"), begins.alias("_begins"))

    def span(part: Column, at: Column, length: Column) -> Column:
        hits = F.array_compact(F.slice("_marks", at + 1, length - 1))
        ends = F.get("_line", at).alias("line"), F.get("_line", at + length - 1).alias("last")
        return F.struct(*ends, part.alias("part"), at.alias("at"), length.alias("length"), hits.alias("hits"))

    n = F.size("_all")
    single = F.flatten(F.transform("_begins", lambda at, k: _spans(at, F.coalesce(F.get("_begins", k + 1), n) - at, WINDOW, STEP, span)))
    wrapped = F.filter(_spans(F.lit(0), n, WRAP_WINDOW, WRAP_STEP, span), lambda s: s["line"] < s["last"])
    found = F.when(n > 0, F.filter(F.concat(single, wrapped), lambda s: (F.size(s["hits"]) > 0) == shared))
    read = F.transform(found, lambda s: F.struct(s["line"], s["last"], s["part"], F.slice("_all", s["at"] + 1, s["length"]).alias("w"), s["hits"]))
    # an outer explode: for an inner one Spark adds a filter that would form all windows once more
    return marked.select(id_col, "doc", F.explode_outer(read).alias("s")).filter("s IS NOT NULL").select(id_col, "doc", "s.*")


def _vectors(rows: DataFrame, known: Wordings) -> DataFrame:
    """`rows` with the indicators of the known n-grams among `grams`."""
    return CountVectorizerModel.from_vocabulary(known.grams, inputCol="grams", outputCol="features").setBinary(True).transform(rows).drop("grams")


def templates(spark: SparkSession) -> DataFrame:
    """(family, template, w)"""
    rows = spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(TEMPLATES)], "family string, template int, text string")
    return rows.withColumn("w", words(F.col("text")))


def _varied(base: DataFrame, variants: int) -> DataFrame:
    """Templates with some words left out and others around them; the first variant is the template itself."""
    turned = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    spot = lambda *x: F.pmod(F.xxhash64(*x, F.col("template"), F.col("i")), F.lit(100))
    kept = F.filter("w", lambda w, at: (F.col("i") % 3 == 0) | (spot(at, F.lit("keep")) >= 12))
    around = lambda side: F.filter(F.array(*[F.lit(f) for f in FILLER]), lambda f: (F.col("i") > 0) & (spot(f, F.lit(side)) < 12))
    return turned.withColumn("w", F.concat(around("before"), kept, around("behind"))).withColumn("held_out", F.col("i") % 4 == 3)


def _shuffled(base: DataFrame, variants: int) -> DataFrame:
    """The templates' words in another order and thinned out: no licence text."""
    turned = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    spot = lambda x: F.xxhash64(x, F.col("template"), F.col("i"))
    few = F.transform(F.array_sort(F.transform("w", lambda w: F.struct(spot(w).alias("h"), w.alias("w")))), lambda s: s["w"])
    return turned.withColumn("w", F.slice(few, 1, F.greatest(F.lit(1), (F.size("w") / 3).cast("int")))).withColumn("family", F.lit(NONE)).withColumn("held_out", F.col("i") % 4 == 3)


@dataclass(frozen=True)
class Classifier:
    model: LogisticRegressionModel
    families: list[str]
    least: float  # of the probability of some licence, for wordings that no template confirms


def train(docs: DataFrame, negatives: int = 4000, variants: int = 24, false_share: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit the classifier; `negatives` is what the documents' paragraphs weigh together, if there are as many."""
    spark = docs.sparkSession
    base, known = templates(spark), wordings(spark)
    seen = set(known.grams) - set(known.pairs)
    own = paragraphs(docs, known.pairs, False, id_col, text_col)
    own = own.select(F.array_sort(F.array_distinct(F.filter("w", lambda w: w.isin(sorted(seen))))).alias("grams"), (F.pmod(F.xxhash64("w"), F.lit(2)) == 1).alias("held_out"))
    own = staged(own.groupBy("grams", "held_out").agg(F.count("*").alias("n")))
    total = own.agg(F.sum("n")).first()[0] or 0
    others = own.select("grams", F.lit(NONE).alias("family"), "held_out", (F.col("n") * min(1.0, negatives / max(total, 1))).alias("weight"))
    made = _varied(base, variants).select("w", "family", "held_out").unionByName(_shuffled(base, 8).select("w", "family", "held_out"))
    rows = made.select(F.concat("w", pairs(F.col("w"))).alias("grams"), "family", "held_out", F.lit(1.0).alias("weight")).unionByName(others)
    families = sorted({f for f, _ in TEMPLATES}) + [NONE]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = _vectors(rows.withColumn("label", label), known)
    machine = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=40, featuresCol="features", labelCol="label", weightCol="weight")
    model = machine.fit(rows.filter("NOT held_out"))
    held = model.transform(rows.filter("held_out").filter(F.col("family") == NONE))
    held = held.select("weight", (1 - vector_to_array("probability")[len(families) - 1]).alias("p"))
    # at most STEPS + 1 rows, whatever the input
    steps = held.groupBy(F.floor(F.col("p") * STEPS).alias("step")).agg(F.sum("weight").alias("weight"), F.max("p").alias("p"))
    below = steps.select("p", F.sum("weight").over(Window.orderBy("step")).alias("below"), F.sum("weight").over(Window.partitionBy()).alias("all"))
    cut = below.filter(F.col("below") >= (1 - false_share) * F.col("all")).agg(F.min("p")).first()[0]
    return Classifier(model, families, max(0.5, cut or 0.0))


def scan(docs: DataFrame, classifier: Classifier, least_overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, part, family, probability, template, overlap, text, last) of each paragraph that is licence text."""
    n = len(classifier.families)
    spark = docs.sparkSession
    known = wordings(spark)
    # without any pair of a template a paragraph can neither be confirmed nor unknown; one pair confirms short templates only
    asked = F.greatest(F.lit(1), F.least(F.lit(2), F.size("w") - 1))
    enough = [g for each in known.each if 1 / len(each) >= least_overlap for g in each]
    possible = paragraphs(docs, known.pairs, True, id_col, text_col).withColumn("hits", F.array_distinct("hits"))
    possible = possible.filter((F.size("hits") >= asked) | F.exists("hits", lambda g: g.isin(enough)))
    scored = classifier.model.transform(_vectors(possible.withColumn("grams", F.concat("w", "hits")), known))
    scored = scored.select(id_col, "doc", "line", "last", "part", "w", "hits", vector_to_array("probability").alias("p"))
    best = F.array_max(F.transform(F.slice("p", 1, n - 1), lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    guess = F.element_at(F.array(*[F.lit(f) for f in classifier.families]), (1 - F.col("best.i")).cast("int"))
    found = scored.withColumn("best", best).withColumn("guess", guess)
    # the fixed templates of a family are one row
    entries = templates(spark).select(F.col("family").alias("guess"), F.struct("template", F.array_distinct(pairs(F.col("w"))).alias("g")).alias("e"))
    found = found.join(F.broadcast(entries.groupBy("guess").agg(F.collect_list("e").alias("own"))), "guess")
    overlap = F.transform("own", lambda e: F.struct((F.size(F.array_intersect(e["g"], F.col("hits"))) / F.size(e["g"])).alias("overlap"), (-e["template"]).alias("template")))
    found = found.withColumn("match", F.array_max(overlap))
    confirmed = (F.col("best.p") >= 0.5) & (F.col("match.overlap") >= least_overlap)
    licensed = 1 - F.col("p")[n - 1] >= classifier.least
    found = found.filter(confirmed | (licensed & (F.size("hits") >= asked)))
    found = found.select(
        id_col, "doc", "line", "last", "part", F.when(confirmed, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"), F.round("best.p", 6).alias("probability"),
        F.when(confirmed, -F.col("match.template")).alias("template"), F.col("match.overlap").alias("overlap"), F.concat_ws(" ", "w").alias("text"),
    )
    return _once(found, id_col).select(id_col, "line", "part", "family", "probability", "template", "overlap", "text", "last")


def _once(found: DataFrame, id_col: str) -> DataFrame:
    """Without the paragraphs of which other paragraphs over the same lines say as much. Equal documents fare alike."""
    at = found.withColumn("at", F.explode(F.sequence("line", "last")))
    here = Window.partitionBy(id_col, "doc", "at")
    alone, unknown = F.col("line") == F.col("last"), F.col("family") == UNKNOWN
    at = at.withColumn("said", F.collect_set(F.when(alone, F.col("family"))).over(here)).withColumn("named", F.max(~alone & ~unknown).over(here))
    less = F.when(alone, unknown & F.col("named")).otherwise(F.array_contains("said", F.col("family")) | (unknown & ((F.size("said") > 0) | F.col("named"))))
    each = Window.partitionBy(id_col, "doc", "line", "last", "part")
    return at.withColumn("less", F.max(less).over(each)).filter(~F.col("less") & (F.col("at") == F.col("line")))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
