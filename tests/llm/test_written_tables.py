"""Tables written on the way to a result are deleted once it is there; its own stays readable."""

import os

from hyperslice.llm import common, linededup, nearcopies


def _tables(spark, docs, step):
    at = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    out = step(docs)
    rows = sorted(map(str, out.collect()))
    return rows, sorted(x.split("-")[0] for x in set(os.listdir(at)) - before)


def test_steps_leave_only_their_results(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:39], "x"]), "a line of thirty letters or so\n" + " ".join(words[::-1]), "a line of thirty letters or so", "", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, n_chars long")
    rows, left = _tables(spark, docs, lambda d: linededup.dedup(d, min_chars=1))
    assert left == ["gone"] and len(rows) == 7
    rows, left = _tables(spark, docs, nearcopies.near_copies)
    assert left == ["classes"] and len(rows) == 12 and "Row(doc_id=6, component_id=0)" in rows


def test_drop_and_settled(spark):
    tables = []

    def make():
        tables.append(common.materialize(spark.range(5).toDF("a"), "inner"))
        return tables[0].selectExpr("a + 1 AS a")

    at = common.shared_dir(spark).removeprefix("file:")
    outer = common.settled(lambda: common.settled(make, "middle").filter("a > 2"), "outer")
    assert sorted(r["a"] for r in outer.collect()) == [3, 4, 5]
    assert not any(x.startswith(("inner-", "middle-")) for x in os.listdir(at))
    common.drop(outer)
    assert not any(x.startswith("outer-") for x in os.listdir(at))
    common.drop(spark.range(1))  # not a written table
