"""Objects from mixed files against a sequential reader, whatever the ranges."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from hyperslice.sources import files, objects

SCHEMA = "packet_id long, s string"


def sequential(data):
    """(records, bad, cut) by one pass over the bytes."""
    records, bad, depth, quoted, escaped, begin = [], 0, 0, False, False, 0
    for i, c in enumerate(data):
        if depth == 0:
            if c == 123:
                depth, quoted, escaped, begin = 1, False, False, i
        elif quoted:
            quoted, escaped = (True, False) if escaped else (c != 34, c == 92)
        elif c == 34:
            quoted = True
        elif c in (123, 125):
            depth += 1 if c == 123 else -1
            if depth == 0:
                text = data[begin : i + 1].decode("utf-8", "ignore")
                try:
                    json.loads(text)
                    records.append((data[:begin].count(b"\n") + 1, begin, text))
                except ValueError:
                    bad += 1
    return records, bad, int(depth > 0)


def mixture(r, n):
    out = bytearray()
    for i in range(n):
        thing = {"packet_id": i, "s": r.choice(["", "a\"b", "{", "}}", "\\", "é\n", "x" * r.randint(0, 60)]), "deep": r.choice([1, {"a": [{"b": 1}, {"c": "}"}]}, [[{}]]])}
        text = json.dumps(thing, indent=r.choice([None, None, 1]), ensure_ascii=r.random() < 0.5)
        if r.random() < 0.1:
            text = r.choice(["{bad}", '{"a": }', "]", '"', "}", "junk", "{'x': {}}"])
        out += (text + r.choice(["\n", ",\n", ",", "", " ", "]\n[", "\r\n"])).encode()
    if r.random() < 0.3:
        out += b'{"cut": "' + b"y" * r.randint(0, 50)
    if r.random() < 0.2:
        out += b"\xff\xfe"
    return bytes(out)


def test_range_tables_compose():
    r = random.Random(2)
    for _ in range(400):
        data = mixture(r, r.randint(0, 12)) if r.random() < 0.7 else bytes(r.choice(b'{}"\\ a') for _ in range(80))
        cut = sorted(r.sample(range(len(data) + 1), min(len(data), r.randint(0, 9))))
        state = objects.OUTSIDE
        want = objects.OUTSIDE
        for a, b in zip([0, *cut], [*cut, len(data)]):
            state = objects.leaves(objects.RangeTable(data[a:b]).to_json(), state)
            at = a
            while at < b:  # the plain scanner over the same bytes
                if want[0] == 0:
                    at = data.find(b"{", at, b)
                    if at < 0:
                        break
                    want, at = (1, False, False), at + 1
                end, want = objects.inside(data[:b], at, want)
                at = end
            assert state == want


def test_reads_everything_whole(spark, tmp_path):
    r = random.Random(3)
    texts = {f"f{i}.json": mixture(r, r.choice([0, 1, 30, 120])) for i in range(8)}
    texts["one_line.json"] = b'{"packet_id": 1},{"packet_id": 2}'
    texts["over_lines.json"] = b'[{"packet_id":\n5},\n\n{"packet_id": 6}]\n'
    texts["empty.json"] = b""
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    for size in (17, 256, 1 << 20):
        rows = objects.read_objects(spark, str(tmp_path), SCHEMA, "*.json", size).collect()
        for name, data in texts.items():
            own = [x for x in rows if x["source_file"].endswith("/" + name)]
            want, bad, cut = sequential(data)
            good = sorted((x["line"], x["offset"], x["packet_id"], x["s"]) for x in own if x["outcome"] == "good")
            assert good == [(line, at, json.loads(t).get("packet_id"), json.loads(t).get("s")) for line, at, t in want]
            assert [sum(x["outcome"] == o for x in own) for o in ("bad", "cut", "truncated", "file")] == [bad, cut, 0, int(bool(data))]
            assert [x["line"] for x in own if x["outcome"] == "file"] == [data.count(b"\n") + (not data.endswith(b"\n"))] * bool(data)


def test_archives(spark, tmp_path):
    """Whole, cut and broken archives below a tree; several members; counts for each."""
    r = random.Random(4)
    data = mixture(r, 4000)
    packed = gzip.compress(data)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "whole.json.gz").write_bytes(packed)
    (tmp_path / "a" / "two.json.gz").write_bytes(gzip.compress(b'{"packet_id": 1}\n') + gzip.compress(b'{"packet_id": 2}\n'))
    (tmp_path / "cut.json.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "broken.json.gz").write_bytes(packed[: len(packed) // 2] + b"\0" * 400)
    (tmp_path / "other.txt").write_bytes(b"{}")
    rows = objects.read_objects(spark, str(tmp_path), SCHEMA, "*.json.gz")
    counts = {x["source_file"].rsplit("/", 1)[1]: x.asDict() for x in objects.outcome_counts(rows).collect()}
    want, bad, cut = sequential(data)
    assert (counts["whole.json.gz"]["good"], counts["whole.json.gz"]["bad"], counts["whole.json.gz"]["cut"], counts["whole.json.gz"]["truncated"]) == (len(want), bad, cut, 0)
    assert counts["two.json.gz"]["good"] == 2 and counts["two.json.gz"]["lines"] == 2
    assert counts["cut.json.gz"]["truncated"] == counts["broken.json.gz"]["truncated"] == 1 and set(counts) == {"whole.json.gz", "two.json.gz", "cut.json.gz", "broken.json.gz"}
    half = [x for x in rows.filter("outcome = 'good' and source_file like '%cut.json.gz'").orderBy("offset").collect()]
    assert 0.3 * len(want) < len(half) < 0.7 * len(want) and [x["packet_id"] for x in half] == [json.loads(t).get("packet_id") for _, _, t in want[: len(half)]]


def test_merged_days_number_lines(spark, tmp_path):
    """Records without a slice id get the number of their line in all files, read in the order of days."""
    (tmp_path / "x-friday.jsonl").write_text('{"slice_id": 7}\n{"slice_id": null}\n')
    (tmp_path / "b-Monday.jsonl").write_text('\n{"k": 1},\nbroken\n{"slice_id": 7}\n')
    (tmp_path / "a-monday.jsonl").write_text('{"k": 1}')
    (tmp_path / "other.jsonl").write_text('{"k": 2}\n')
    rows = objects.read_objects(spark, str(tmp_path), "slice_id long, k long", "*.jsonl")
    got = sorted((r["day_idx"], r["global_id"]) for r in files.merge_read_days(rows).collect())
    assert got == sorted([(0, "monday:NA:1"), (0, "monday:NA:3"), (0, "monday:7"), (4, "friday:7"), (4, "friday:NA:7"), (999, "unknown:NA:8")])
