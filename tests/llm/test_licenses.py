import re

import numpy as np
import pytest

from linkweave.llm import licenses


@pytest.fixture(scope="module")
def docs(spark):
    plain = "the quick river of stone walks over nine green hills while under the bridge all lamps are lit and no rights of way are free"
    words = plain.split()
    rows = [(i, "\n".join(" ".join(words[(i * 7 + j * 3 + k) % len(words)] for k in range(12)) for j in range(4)), "x") for i in range(80)]
    rows += [
        (100, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text", "line"),
        (101, "Copyright 2020 the authors. Released under the MIT License", None),
        (102, " ".join(words * 30) + " this work is licensed under the gnu general public license, version 3. " + " ".join(words * 30), "x"),
        (103, None, "x"),
        (104, "", "x"),
        (105, "\n \n", "x"),
        (106, "All rights reserved.", "x"),
        (106, "All rights reserved.", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, line string")


@pytest.fixture(scope="module")
def found(docs):
    return [r.asDict() for r in licenses.scan(docs, licenses.train(docs)).collect()]


def test_families_are_found_and_clean_text_is_left_alone(found):
    got = sorted((r["doc_id"], r["line"], r["family"]) for r in found)
    assert [g for g in got if g[0] != 102] == [(100, 1, "apache"), (101, 0, "mit"), (106, 0, "proprietary"), (106, 0, "proprietary")]
    assert {g[2] for g in got if g[0] == 102} == {"gpl"}  # in a window of a very long line


def test_no_python_on_the_main_path(docs):
    plan = licenses.scan(docs, licenses.train(docs, negatives=50, variants=4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_unknown_wording(spark, docs):
    rows = [(1, "Permission to use and distribute this software and associated documentation files under the license is hereby granted to all friends of the project")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.train(docs, negatives=200)).collect()
    assert [r["family"] for r in got] in (["unknown"], [])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty, licenses.train(empty, variants=4)).count() == 0


def test_each_template_alone_is_of_its_family(spark, docs):
    rows = [(i, mark + text) for i, (_, text) in enumerate(licenses.TEMPLATES) for mark in ("", "// ", "# ")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.train(docs)).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == sorted((i, licenses.TEMPLATES[i][0]) for i, _ in rows)


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation.\n */",
    "apache": "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\nnotice appears.",
}


def test_wrapped_notices(spark, docs):
    prose = "the quick river of stone walks over nine\ngreen hills while all lamps are lit"
    rows = [(family, notice) for family, notice in WRAPPED.items()] + [(f"{family} in prose", f"{prose}\n\n{notice}\n\n{prose}") for family, notice in WRAPPED.items()]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.train(docs)).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(i, i.split()[0]) for i, _ in rows}
    assert all(r["line"] < r["last"] for r in got)


def test_a_notice_on_one_line_is_reported_for_that_line_only(spark, docs):
    text = "green hills\nReleased under the MIT License\nLicensed under the Apache License, Version 2.0\nnine lamps"
    got = licenses.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), licenses.train(docs)).collect()
    assert sorted((r["line"], r["last"], r["family"]) for r in got) == [(1, 1, "mit")] * 2 + [(2, 2, "apache")] * 2


def test_a_family_does_not_depend_on_the_cut_for_unknown_wordings(spark, docs):
    """However surely shuffled templates pass for licences, a confirmed notice stands."""
    trained = licenses.train(docs)
    strict = licenses.Classifier(trained.model, trained.families, 1.1)
    rows = [(i, text) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), strict).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == [(i, f) for i, (f, _) in enumerate(licenses.TEMPLATES)]


def test_planted_notices_of_the_documents_are_all_found(spark):
    """Every line of the given documents that is a template's words alone is of its family, and no other line is named."""
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    split = lambda line: [w for w in re.split(r"[^\w.+-]+|[.]+(?=\s|$)", line.lower()) if w]
    wordings = {tuple(split(text)): family for family, text in licenses.TEMPLATES}
    lines = {(r["doc_id"], i): split(line) for r in texts.collect() for i, line in enumerate((r["text"] or "").split("\n"))}
    planted = {(*at, wordings[tuple(w)]) for at, w in lines.items() if tuple(w) in wordings}
    found = licenses.query(texts).filter("line = last AND family <> 'unknown'").collect()
    assert planted and planted <= {(r["doc_id"], r["line"], r["family"]) for r in found}
    # brute force of the confirmation: the pairs of words of some template of the family
    grams = lambda w: set(zip(w, w[1:]))
    for r in found:
        held = grams(r["text"].split(" "))
        assert max(len(held & grams(t)) / len(grams(t)) for t, f in wordings.items() if f == r["family"]) >= 0.6


def test_all_paragraphs_of_the_documents_count(spark, docs):
    """Of more paragraphs than `negatives`, each has its share: a table that comes twice gives the same classifier."""
    words = [f"{a}{b}" for a in ("sto", "ri", "lam", "gre", "hil") for b in ("ne", "ver", "ps", "en", "ls")] + ["the", "of", "and", "license", "software", "rights", "public"]
    lines = spark.createDataFrame([(i, " ".join(words[(i * i + j * (1 + i % 11)) % len(words)] for j in range(9))) for i in range(900)], "doc_id long, text string")
    once = licenses.train(lines, negatives=100, variants=4)
    twice = licenses.train(lines.union(lines.selectExpr("doc_id + 1000", "text")), negatives=100, variants=4)
    assert np.allclose(once.model.coefficientMatrix.toArray(), twice.model.coefficientMatrix.toArray(), atol=1e-3)
    assert once.least == pytest.approx(twice.least, abs=1e-3)


ODD = [
    "One line. Of words, v2.0 and C++... and -- more.)\n\n  \n.\nEnds... here. \nÄrger ΣΑΣ\r\nİstanbul a..b x.y. z .", "", "\n", "word", "a b\nc", None,
    "\n".join(" ".join(f"w{i * j % 17}." for j in range(i * 9 % 41)) for i in range(40)), " ".join(f"v{i}" for i in range(500)) + "\nthe end of the\nline",
    " ".join(f"v{i}" for i in range(60)), " ".join(f"v{i}" for i in range(120)) + "\n" + " ".join(f"v{i}" for i in range(121)),
]


def test_paragraphs_against_plain_python(spark):
    def cut(w, window, step):
        return [w[i * step : i * step + window] for i in range(max(1, -(-(len(w) - window) // step) + 1))]

    known = ["of the", "v3 v4", "w1 w2", "v119 v0", "c++... and"]
    want = []
    for n, text in enumerate(ODD):
        # white space and ends of lines as Java has them
        lines = [[w for w in re.split(r"[^\w.+-]+|_+|[.]+(?=[ \t\n\x0b\f\r]|[\r\u0085  ]?\Z)", line.lower()) if w] for line in (text or "").split("\n")]
        every = [(i, w) for i, line in enumerate(lines) for w in line]
        found = [(i, i, part, w) for i, line in enumerate(lines) if line for part, w in enumerate(cut(line, 120, 60))]
        found += [(w[0][0], w[-1][0], part, [x for _, x in w]) for part, w in enumerate(cut(every, 60, 30)) if w and w[0][0] < w[-1][0]]
        want += [(n, *p, [f"{a} {b}" for a, b in zip(p[-1], p[-1][1:]) if f"{a} {b}" in known]) for p in found]
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {s: [(r["doc_id"], r["line"], r["last"], r["part"], r["w"], r["hits"]) for r in licenses.paragraphs(docs, known, s).collect()] for s in (True, False)}
    assert sorted(got[True] + got[False]) == sorted(want)
    assert all(hits for *_, hits in got[True]) and not any(hits for *_, hits in got[False]) and got[True]


def test_a_text_is_read_once(docs):
    plan = licenses.scan(docs, licenses.train(docs, negatives=50, variants=4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") - plan.count("lower(text#") == 1  # of the documents; the other ones are the templates'
