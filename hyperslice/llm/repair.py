"""Repair of damaged conversations by the cheapest edits, found by iterative-deepening A*.

The role initials of a repaired conversation are (s?(ua)+)?: a state machine of START, SYSTEM (after s), ASKED (after u) and
ANSWERED (after a). Edits go through a conversation's rows in order: D deletes a row, I inserts an empty user or assistant
turn, K keeps a row, R gives it the role that the state calls for. In a state each edit leads to one state, so an audit (the
edits' initials) has one path, and depth-first search in the order D, I, K, R meets audits in ASCII order.

The search deepens a cost bound: a path is cut where its cost and a lower bound for the rest exceed the bound, and the
smallest excess is the next bound. The lower bound is the cheapest repair of the rest in a simpler machine, which lets a
conversation end after s; it is never too high and at most two inserted turns too low. The transposition table
raises it for (row, state) pairs that failed. The first path that ends in START or ANSWERED is the answer.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import unused

#: Costs of the edits; a truncated row that stays costs one more.
DELETE, INSERT, RENAME, CUT = 3, 2, 2, 1
START, SYSTEM, ASKED, ANSWERED = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER, S, U, A = range(4)
NEXT = (ASKED, ASKED, ANSWERED, ASKED)  # of an inserted or renamed turn
ROLES = ("user", "user", "assistant", "user")
KEPT = {(START, S): SYSTEM, (START, U): ASKED, (SYSTEM, U): ASKED, (ASKED, A): ANSWERED, (ANSWERED, U): ASKED}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def rest_costs(codes: bytes) -> tuple[array, array, array, array]:
    """Per state, for each row: the cheapest repair from there in the machine that may end after s. Codes are fault * 4 + initial."""
    n = len(codes)
    start, user, answer = (array("q", bytes(8 * (n + 1))) for _ in range(3))
    answer[n] = INSERT
    for i in range(n - 1, -1, -1):
        fault, initial = divmod(codes[i], 4)
        first, u, a = DELETE + start[i + 1], DELETE + user[i + 1], DELETE + answer[i + 1]
        if fault not in (BLANK, DUPLICATE):
            cut = CUT * (fault == TRUNCATED)
            asked = cut + answer[i + 1] + (0 if initial == U else RENAME)
            u = min(u, asked)
            a = min(a, cut + user[i + 1] + (0 if initial == A else RENAME))
            first = min(first, asked, cut + user[i + 1]) if initial == S else min(first, asked)
        user[i], answer[i] = min(u, INSERT + a), min(a, INSERT + u)
        start[i] = min(first, INSERT + a, 2 * INSERT + u)
    return start, user, answer, user


def cheapest(codes: bytes) -> tuple[int, str]:
    """The cost and audit of the cheapest repair, the ASCII-least audit on ties."""
    n, (start, system, asked, answered) = len(codes), rest_costs(codes)
    rest = (start, system, asked, answered)
    failed: dict[int, int] = {}  # row * 4 + state: the rest costs so much at least
    bound = start[0]
    while True:
        path = bytearray()
        stack = [[0, START, bound, 0, 1 << 62]]  # row, state, budget left, next edit, smallest excess below
        while stack:
            node = stack[-1]
            i, state, left, edit, _ = node
            if i == n and state in (START, ANSWERED):
                return bound - left, path.decode()
            if edit == 4:
                stack.pop()
                failed[i * 4 + state] = left + node[4]
                if stack:
                    path.pop()
                    stack[-1][4] = min(stack[-1][4], node[4])
                else:
                    bound += node[4]
                continue
            node[3] += 1
            if edit == 1:
                j, to, cost = i, NEXT[state], INSERT
            elif i == n:
                continue
            elif edit == 0:
                j, to, cost = i + 1, state, DELETE
            else:
                fault, initial = codes[i] >> 2, codes[i] & 3
                if fault == BLANK or fault == DUPLICATE:
                    continue
                to = KEPT.get((state, initial)) if edit == 2 else NEXT[state]
                if to is None:
                    continue
                j, cost = i + 1, (RENAME if edit == 3 else 0) + (CUT if fault == TRUNCATED else 0)
            over = cost + max(rest[to][j], failed.get(j * 4 + to, 0)) - left
            if over > 0:
                node[4] = min(node[4], over)
            else:
                path.append(b"DIKR"[edit])
                stack.append([j, to, left - cost, 0, 1 << 62])


class _Conversation:
    """What is known of the conversation being read: its codes first, then its repaired text, as it comes."""

    def __init__(self, ident):
        self.ident, self.codes, self.turn, self.low, self.distinct = ident, bytearray(), None, None, 0
        self.audit = None

    def code(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.distinct = turn, self.distinct + 1

    def decide(self) -> None:
        self.cost, self.audit = cheapest(self.codes)
        self.at, self.state, self.sha, self.any = 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) * self.any}{role}:{text}".encode())
        self.any = True

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._say(ROLES[self.state], "")
            self.state, self.at = NEXT[self.state], self.at + 1

    def row(self, role: str, text: str, initial: int) -> None:
        if self.audit is None:
            self.decide()
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role, text)
            self.state = KEPT[self.state, initial]
        elif edit == "R":
            self._say(ROLES[self.state], text)
            self.state = NEXT[self.state]

    def result(self) -> tuple:
        if self.audit is None:
            self.decide()
        self.inserts()
        faults = [c >> 2 for c in self.codes]
        initials = [c & 3 for c in self.codes]
        illegal = sum((x, y) not in ((S, U), (U, A), (A, U)) for x, y in zip(initials, initials[1:]))
        gaps = self.turn - self.low + 1 - self.distinct if self.distinct else 0
        return self.ident, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, self.cost, self.audit, self.sha.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with rows dropped, emptied, cut, repeated or renamed by the CRC-32 of conv_id:turn;
    nulls in role, text and in that key are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    told = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), told.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), without null roles and texts -> (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256), one row for each different conv_id of ids(conv_id), null included.

    A conversation's rows go by turn, null turns first, rows of one turn by the MD5 of role and text. Repeated rows are
    duplicates. A conversation without rows has zeros, an empty audit and the hash of nothing. Other columns are not read.
    Repeats are found by conversation and digest, so no task needs a conversation for that. Its rows then come to one task
    twice, in order: all without texts (a byte is kept of each), which decides the edits, and then with texts, which are
    hashed as they pass. So memory does not hold a conversation's texts, but the audit and the hash are made in one task.
    """
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary")))
    rows = rows.select("conv_id", "turn", "role", "text", digest.alias("digest"), letter.alias("initial"))
    light = rows.select("conv_id", "turn", "digest", "initial", fault.alias("fault"))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn")) > 1
    light = light.withColumn("fault", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    parts = [
        ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("step"), none("long", "turn"), none("binary", "digest"), F.lit(0).alias("code"), none("string", "role"), none("string", "text")),
        light.select("conv_id", F.lit(1), "turn", "digest", F.col("fault") * 4 + F.col("initial"), none("string", "role"), none("string", "text")),
        rows.select("conv_id", F.lit(2), "turn", "digest", F.col("initial"), "role", "text"),
    ]
    read = parts[0].union(parts[1]).union(parts[2]).repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "digest", F.floor(F.col("code") / 4) == DUPLICATE)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[c.split()[0] for c in RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            columns = [batch[c].to_pylist() for c in ("conv_id", "step", "turn", "code", "role", "text")]
            for ident, step, turn, code, role, text in zip(*columns):
                if step == 0:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(ident)
                elif step == 1:
                    now.code(turn, code)
                else:
                    now.row(role, text, code)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, now.result()))], schema=schema)

    schema = pa.schema([pa.field("conv_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), *[pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")]])
    return read.mapInArrow(run, f"conv_id {kind}, {RESULT}")
