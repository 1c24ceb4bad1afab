"""Line keys are computed for a whole part of lines at once."""

import numpy as np

from hyperslice.llm import linededup


def test_line_keys_of_a_part_come_from_one_pass():
    lines = ["ab cd" * n + "é" * (n % 7) for n in range(1, 300)]
    lengths = np.array([len(x) for x in lines])
    no, key = linededup._part_keys(lines, lengths, np.flatnonzero(lengths >= linededup.EDITS_FROM))  # was one pass a length
    assert all(sorted(key.view(np.int64)[no == i].tolist()) == sorted(linededup.keys(x)) for i, x in enumerate(lines))
    assert (key.view(np.int64) == linededup.keys_of(lines)[1]).all()


def test_lines_meet_at_keys(spark):
    """Rows are those of a window by key, which sorted every key as a row of its own."""
    lines = [f"line number {i // 3} of some {'more ' * (i % 7)}words{'.' * (i % 3)}" for i in range(300)] + ["a" * 40, "a" * 40, "b" * 19, ""]
    table = spark.createDataFrame([(hash(x) >> 2, x) for x in lines], "h long, line string").repartition(3)
    rows = [(hash(x) >> 2, v >> 1, v & 1) for x in lines for v in linededup.keys(x)]
    at = {}
    for h, key, own in rows:
        at.setdefault(key, []).append((h, own))
    want = {(h, key, len(x), max(o for g, o in x if g == h)) for key, x in at.items() if len({h for h, _ in x}) > 1 and max(o for _, o in x) for h, _ in x}
    got = [tuple(r) for r in linededup._met(table).select("h", "key", "n", "mine").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert linededup._met(table.limit(0)).count() == 0
