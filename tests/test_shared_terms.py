"""Attributes behind pairs, whichever side makes fewer rows."""

from linkweave.operators import evidence as E


def _want(pairs, sets):
    held = {}
    for i, t in sets:
        if i is not None and t is not None:
            held.setdefault(i, set()).add(t)
    out = {(a, b): sorted(held.get(a, set()) & held.get(b, set())) for a, b in pairs if a is not None and b is not None}
    return {k: v for k, v in out.items() if v}


def _both(spark, pairs, sets):
    got = E.shared_terms(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sets, "id long, attr long"))
    return got, {(r["a"], r["b"]): list(r["terms"]) for r in got.collect()}


def test_attributes_of_many_pairs_come_from_the_members_of_an_attribute(spark):
    # 40 members hold 50 attributes each, two share each attribute of their own ten
    sets = [(i, 1000 * (i // 2) + t) for i in range(40) for t in range(50)] + [(3, 7), (3, 7), (None, 7), (5, None)]
    pairs = [(x, y) for x in range(40) for y in range(40)] + [(4, 5), (None, 3), (3, None)]
    got, rows = _both(spark, pairs, sets)
    assert rows == _want(pairs, sets)
    assert "_tile" in got._jdf.queryExecution().analyzed().toString()


def test_attributes_of_few_pairs_go_to_the_pairs(spark):
    sets = [(i, t) for i in range(60) for t in range(3)]
    pairs = [(5, 3), (3, 5), (8, 8), (70, 3)]
    got, rows = _both(spark, pairs, sets)
    assert rows == _want(pairs, sets)
    assert "_tile" not in got._jdf.queryExecution().analyzed().toString()
