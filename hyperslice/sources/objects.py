"""JSON objects out of any mixture: lines, arrays, objects joined by commas or by nothing, over lines, in cut archives.

An object begins at a brace outside all objects and ends where its braces close; braces in strings don't count. Plain files are
read in ranges. As a range can begin anywhere, a first pass writes down what each does to the scanner from any state it could
come in with (outside; inside, in a string, behind a backslash, at any depth), a file's ranges are put together in order, and a
second pass reads the objects that begin in each range, over its end where needed. Archives (gzip) are one range each and are
read as far as they can be.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

PLAIN, STRING = re.compile(rb'["{}]'), re.compile(rb'["\\]')
CHUNK = 1 << 20
FAR = 1 << 40  # a depth from which no range gets out
ROW = "source_file string, line long, offset long, record string, outcome string"
ENTRY = "path string, start long, length long, stop long, depth long, quoted boolean, escaped boolean, lines long"
State = tuple[int, bool, bool]  # depth, in a string, behind a backslash
OUTSIDE: State = (0, False, False)


def inside(data: bytes, at: int, state: State, lows: list[int] | None = None) -> tuple[int, State]:
    """Go on within an object from data[at] to its end (position behind it, OUTSIDE) or the data's. lows: positions behind each
    brace that goes below all depths before it."""
    depth, quoted, escaped = state
    low = depth
    if escaped and at < len(data):
        at, escaped = at + 1, False
    while True:
        found = (STRING if quoted else PLAIN).search(data, at)
        if not found:
            return len(data), (depth, quoted, escaped)
        at, c = found.end(), found[0]
        if c == b'"':
            quoted = not quoted
        elif c == b"\\":
            if at == len(data):
                return at, (depth, quoted, True)
            at += 1
        elif c == b"{":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return at, OUTSIDE
            if lows is not None and depth < low:
                low = depth
                lows.append(at)


class RangeTable:
    """The state in which a range leaves the scanner, for every state that it can come in with."""

    def __init__(self, data: bytes):
        self.data, self.ends = data, {}
        self.outside = self.from_outside(0)
        self.inside = {}
        for quoted, escaped in ((False, False), (True, False), (True, True)):
            lows: list[int] = []
            _, (depth, q, e) = inside(data, 0, (FAR, quoted, escaped), lows)
            self.inside[quoted, escaped] = (depth - FAR, q, e, [self.from_outside(p) for p in lows])

    def from_outside(self, at: int) -> State:
        """Where the scanner is at the range's end if it is outside at `at`; runs that meet at an object's beginning are walked once."""
        chain = []
        while True:
            at = self.data.find(b"{", at)
            if at < 0:
                state = OUTSIDE
                break
            if at in self.ends:
                state = self.ends[at]
                break
            chain.append(at)
            at, state = inside(self.data, at + 1, (1, False, False))
            if state != OUTSIDE:
                break
        self.ends.update(dict.fromkeys(chain, state))
        return state

    def to_json(self) -> str:
        return json.dumps([self.outside, [[q, e, *v] for (q, e), v in self.inside.items()]])


def leaves(table: str, state: State) -> State:
    """The state behind a range of this table (as JSON) that is entered in `state`."""
    outside, rows = json.loads(table)
    depth, quoted, escaped = state
    if depth == 0:
        return tuple(outside)
    for q, e, change, to_quoted, to_escaped, lows in rows:
        if (q, e) == (quoted, escaped):
            return tuple(lows[depth - 1]) if len(lows) >= depth else (depth + change, to_quoted, to_escaped)
    raise AssertionError("no such state")


def _open(path: str):
    """A random access file; the path is a URI of any file system that Arrow knows, or local."""
    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(name)


def _read(path: str, start: int, stop: int) -> bytes:
    with _open(path) as f:
        f.seek(start)
        return f.read(stop - start)


def _chunks(path: str, start: int, told: dict) -> Iterator[bytes]:
    """The file's bytes from start on; of a .gz file its contents (all members) as far as they can be read."""
    with _open(path) as f:
        if not path.endswith(".gz"):
            f.seek(start)
            while data := f.read(CHUNK):
                yield data
            return
        unzip, rest = zlib.decompressobj(31), b""
        begun = False
        while data := rest or f.read(CHUNK):
            rest = b""
            try:
                out = unzip.decompress(data, CHUNK)
            except zlib.error:
                told["truncated"] = True
                return
            begun = True
            if out:
                yield out
            if unzip.eof:
                rest, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
                if not rest.strip(b"\0"):
                    rest = b""
            else:
                rest = unzip.unconsumed_tail
        if begun:
            if out := unzip.flush():
                yield out
            told["truncated"] = not unzip.eof


def _whole(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except (ValueError, RecursionError):
        return False


def objects(path: str, start: int, stop: int | None, state: State = OUTSIDE, lines: int = 0) -> Iterator[tuple]:
    """(line, offset, record, outcome) of the objects that begin in [start, stop) of a file, scanned from start on in `state`.

    line counts from 1 at the file's first. outcome: good; bad (braces close, but it isn't JSON; the text is given); cut (the file
    ends within it). Bytes that aren't UTF-8 are left out of the record. The range that holds the file's end adds (lines, bytes,
    None, 'file'), and 'truncated' before it where an archive ends early.
    """
    told: dict = {}
    at, line = start, lines + 1
    record: bytearray | None = bytearray() if state[0] else None  # an object of an earlier range: its rest isn't told
    own, began = not state[0], (0, 0)
    last = b"\n"
    for data in _chunks(path, start, told):
        here = 0
        while here < len(data):
            if record is None:
                first = data.find(b"{", here)
                skipped = len(data) if first < 0 else first
                line += data.count(b"\n", here, skipped)
                here = skipped
                if stop is not None and at + here >= stop:
                    return
                if first < 0:
                    break
                record, own, began, state = bytearray(b"{"), True, (line, at + here), (1, False, False)
                here += 1
            end, state = inside(data, here, state)
            line += data.count(b"\n", here, end)
            if own:
                record += data[here:end]
            here = end
            if state == OUTSIDE:
                if own:
                    text = record.decode("utf-8", "ignore")
                    yield (*began, text, "good" if _whole(text) else "bad")
                record = None
        last = data[-1:]
        at += len(data)
        if record is None and stop is not None and at >= stop:
            # Only blanks may follow within the range; the file's end is told by the range that holds it.
            return
    if record is not None and own:
        yield (*began, None, "cut")
    if stop is not None:
        return
    if told.get("truncated"):
        yield (line, at, None, "truncated")
    yield (line - (last == b"\n"), at, None, "file")


def read_objects(spark: SparkSession, path: str | list[str], schema: str, pattern: str = "*", split_bytes: int = 64 << 20) -> DataFrame:
    """S4, S5, S9 over files below path: the schema's columns, source_file, line, offset, record (bad objects only) and outcome.

    A row for every object (good, bad, cut), for every archive that ends early (truncated), and for every file (file, with its
    number of lines in `line`). Files that end in .gz are archives. Files without objects have the last row only;
    files without bytes aren't listed by Spark and have none.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    archive = F.col("path").endswith(".gz") | (F.col("length") == 0)
    starts = F.when(archive, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = found.select("path", "length", F.explode(starts).alias("start"), (~archive & (F.col("length") > split_bytes)).alias("several"))
    # A null stop: to the file's end.
    ranges = ranges.withColumn("stop", F.when(F.col("several") & (F.col("start") + split_bytes < F.col("length")), F.col("start") + split_bytes)).repartition("path", "start")
    own = spark.sparkContext.defaultParallelism

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                data = _read(r.path, r.start, min(r.length, r.start + split_bytes))
                yield pd.DataFrame([(r.path, r.start, r.length, RangeTable(data).to_json(), data.count(b"\n"))], columns=["path", "start", "length", "table", "n"])

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        state, lines, out = OUTSIDE, 0, []
        for r in frame.sort_values("start").itertuples(index=False):
            stop = r.start + split_bytes if r.start + split_bytes < r.length else None
            out.append((r.path, r.start, r.length, stop, *state, lines))
            state, lines = leaves(r.table, state), lines + r.n
        return pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")]).astype({"stop": "Int64"})

    cut = ranges.filter("several").mapInPandas(scan, "path string, start long, length long, table string, n long").groupBy("path").applyInPandas(compose, ENTRY)
    whole = ranges.filter("not several").select("path", "start", "length", "stop", F.lit(0).cast("long").alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).cast("long").alias("lines"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")]
        for frame in frames:
            for r in frame.itertuples(index=False):
                rows, size = [], 0
                stop = None if pd.isna(r.stop) else int(r.stop)
                for row in objects(r.path, r.start, stop, (int(r.depth), bool(r.quoted), bool(r.escaped)), int(r.lines)):
                    rows.append((r.path, *row))
                    size += len(row[2] or "")
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    rows = whole.union(cut).repartition(max(own, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start").mapInPandas(parse, ROW)
    typed = rows.withColumn("_r", F.when(F.col("outcome") == "good", F.from_json("record", schema)))
    return typed.select("_r.*", "source_file", "line", "offset", F.when(F.col("outcome") == "bad", F.col("record")).alias("record"), "outcome")


def outcome_counts(rows: DataFrame) -> DataFrame:
    """(source_file, lines, good, bad, cut, truncated) of read_objects' rows."""
    one = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return rows.groupBy("source_file").agg(F.max(F.when(F.col("outcome") == "file", F.col("line"))).alias("lines"), one("good"), one("bad"), one("cut"), one("truncated"))
