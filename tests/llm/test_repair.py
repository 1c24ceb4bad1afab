"""Conversation repair against exhaustive search and a sequential restatement of the contract."""

import hashlib
import itertools
import random
import re
import zlib

from hyperslice.llm import queries, repair
from hyperslice.llm.common import table

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def best(rows):
    """(cost, audit, repaired) by relaxing (row, state) forward, with the state a role string that GOOD can begin with."""

    def begins(state):  # s, u, a so far, up to the last pair
        return re.fullmatch(r"s?(ua)*u?", state)

    def class_of(state):
        return 0 if state == "" else 1 if state == "s" else 2 if state.endswith("u") else 3

    front = {0: (0, "", (), "")}  # class: cost, audit, repaired, roles
    for role, text, fault in [*rows, (None, None, None)]:
        for _ in range(2):  # inserts
            for cost, audit, done, roles in list(front.values()):
                for new in "ua":
                    if begins(roles + new):
                        put(front, class_of(roles + new), (cost + 2, audit + "I", (*done, {"u": "user:", "a": "assistant:"}[new]), roles + new))
        if role is None:
            break
        after = {}
        for cost, audit, done, roles in front.values():
            put(after, class_of(roles), (cost + 3, audit + "D", done, roles))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if begins(roles + role[:1]) and role[:1]:
                    put(after, class_of(roles + role[0]), (cost + cut, audit + "K", (*done, f"{role}:{text}"), roles + role[0]))
                for name in ("user", "assistant"):
                    if begins(roles + name[0]):
                        put(after, class_of(roles + name[0]), (cost + cut + 2, audit + "R", (*done, f"{name}:{text}"), roles + name[0]))
        front = after
    return min((v for v in front.values() if GOOD.fullmatch(v[3])), key=lambda v: v[:2])


def put(front, key, value):
    if key not in front or value[:2] < front[key][:2]:
        front[key] = value


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def restated(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        digest = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
        seen, told = set(), []
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        cost, audit, repaired, _ = best(told)
        turns = {r[1] for r in own} - {None}
        faults = [f for _, _, f in told]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return found


def test_search_is_cheapest_and_first():
    """All conversations of up to 4 rows of some kinds, and random long ones."""
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in (None, "blank", "truncated")]
    number = {None: repair.FINE, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}
    code = lambda rows: bytes(number[f] * 4 + {"s": repair.S, "u": repair.U, "a": repair.A}.get(r[0], repair.OTHER) for r, f in rows)
    r = random.Random(7)
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)] + [r.choices(kinds, k=r.randint(4, 80)) for _ in range(400)]
    for rows in cases:
        assert repair.cheapest(code(rows)) == best([(a, "x", f) for a, f in rows])[:2]
    start = repair.rest_costs(code(cases[-1]))[0][0]
    assert start <= repair.cheapest(code(cases[-1]))[0] <= start + 4


def test_search_of_a_long_conversation():
    """A hundred thousand rows, with system rows throughout: the search stays linear."""
    r = random.Random(8)
    codes = bytes(r.choice((repair.S, repair.U, repair.U, repair.A, repair.A, repair.OTHER, 4, 12 + repair.U)) for _ in range(100_000))
    cost, audit = repair.cheapest(codes)
    assert cost > 50_000 and len(audit) >= 100_000


def test_op13_equals_restatement(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, SF).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == restated(rows) and len(got) == len({r[0] for r in rows})


def test_odd_conversations(spark):
    """Nulls everywhere, repeated rows and turns, rows that all go, other roles, long texts, clashing names, an empty table."""
    r = random.Random(9)
    texts = [None, "", " \t", "Yes.", "Yes", "No?", "\x0b!\n", "é", "word " * 50_000 + "."]
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts)) for _ in range(300)]
    rows += [(50, 1, "user", "Same."), (50, 1, "user", "Same."), (50, 2, "user", "Same."), (51, None, "assistant", "Hi."), (52, 0, "system", "Only this.")]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows += [(gone, 1, "user", "Lost.")]
    df = spark.createDataFrame([(*row, 1, "x", "y") for row in rows], "conv_id long, turn long, role string, text string, code int, digest string, step string")
    got = {x["conv_id"]: tuple(x)[1:] for x in repair.repair(repair.damage(df), df).collect()}
    assert got == restated(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(repair.damage(df.limit(0)), df.limit(0)).count() == 0
