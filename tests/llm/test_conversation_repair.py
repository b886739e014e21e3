"""Repair of conversations against a search over all edit scripts."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest
from haulage.llm import conversation_repair as cr
from haulage.llm.queries import QUERIES

PATTERN = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\v\f\r"


def first_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif bare[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def cheapest_by_rows(rows):
    """Least (cost, audit, roles and texts) per state after each row; plain dynamic programming
    over whole audits, with any number of insertions up to four at a place."""
    faults = first_faults(rows)

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for roles, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    put(ways, roles, cost + 2, audit + "I", out, role, "")
        return ways

    def put(ways, state, cost, audit, out, role, text):
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if role[:1] and role[0] in after:
            new = (cost, audit, out + [(role, text)])
            if role[0] not in ways or new[:2] < ways[role[0]][:2]:
                ways[role[0]] = new

    ways = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, out) in ways.items():
            new = (cost + 3, audit + "D", out)
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new
        for state, (cost, audit, out) in ways.items():
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                put(after, state, cost + extra, audit + "K", out, role, text)
                for name in ("user", "assistant"):
                    put(after, state, cost + 2 + extra, audit + "R", out, name, text)
        ways = inserted(after)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def test_cheapest_by_trying_all_audits():
    """Every audit up to a length, for tiny conversations: no dynamic programming at all."""
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "no", ""])) for _ in range(rng.randint(0, 3))]
        faults, best = first_faults(rows), None
        for size in range(len(rows), len(rows) + 3):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in audit) != len(rows):
                    continue
                options, at, cost = [], 0, 0
                for e in audit:
                    if e == "I":
                        options.append("ua")
                        cost += 2
                        continue
                    role, fault = rows[at][0], faults[at]
                    at += 1
                    if e == "D":
                        cost += 3
                        continue
                    if fault in ("blank", "duplicate"):
                        break
                    cost += (fault == "truncated") + (2 if e == "R" else 0)
                    options.append(role[0] if e == "K" else "ua")
                else:
                    if any(PATTERN.fullmatch("".join(x)) for x in itertools.product(*options)):
                        best = min(best or (99, ""), (cost, "".join(audit)))
        codes = bytes(cr.code(r, {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (r, _), f in zip(rows, faults))
        assert cr.cheapest(codes) == best == cheapest_by_rows(rows)[:2], rows


def test_cheapest_of_longer_conversations():
    rng = random.Random(2)
    for _ in range(300):
        rows = [
            (rng.choice(["system", "user", "user", "assistant", "assistant", "x", ""]), rng.choice(["a.", "b!", "c", " ", f"t{rng.random()}."]))
            for _ in range(rng.randint(0, 25))
        ]
        faults = first_faults(rows)
        codes = bytes(cr.code(r, {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for (r, _), f in zip(rows, faults))
        assert cr.cheapest(codes) == cheapest_by_rows(rows)[:2], rows


def test_long_conversations_take_linear_time():
    codes = bytes(cr.code("user" if i % 2 == 0 else "assistant", 0 if i % 7 else 3) for i in range(40_000))
    cost, audit = cr.cheapest(codes)
    assert audit == "K" * 40_000 and cost == sum(i % 7 == 0 for i in range(40_000))


def expected(rows):
    """``rows``: (turn, role, text) of one conversation."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order)
    named = [(r, x) for _, r, x in rows]
    faults = first_faults(named)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, out = cheapest_by_rows(named)
    initials = [r[:1] for r, _ in named]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, rows, shape=lambda d: d):
    frame = shape(spark.createDataFrame(rows, SCHEMA))
    plans = cr.plans(frame)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in cr.digests(cr.repaired(frame, plans)).collect()}
    return {
        r["conv_id"]: (*tuple(r)[1:], digests.get(r["conv_id"], cr.EMPTY_DIGEST)) for r in plans.collect()
    }


def test_edges(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."),
        (2, 5, "assistant", "  "), (2, None, None, None), (2, 9, "user", "open"),
        (3, None, "user", ""), (3, None, "tool", "x."),
        (None, 1, "user", "Who?"), (None, 2, "assistant", "I am."), (None, 2, "assistant", "It is I."),
        (4, 1, "assistant", "No end " * 60_000), (4, 0, "user", "Ünï cödé 日本?"),
        (5, 1, "", "empty role."), (6, 7, "user", " "),
    ]
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    wanted = {c: expected(group) for c, group in by.items()}
    assert repaired(spark, rows) == wanted
    clash = lambda d: d.selectExpr("*", "1 AS conv", "2 AS AUDIT", "3 AS digest", "'q' AS ROLE", "4 AS fault", "5 AS c0")
    assert repaired(spark, rows, clash) == wanted
    assert repaired(spark, rows, lambda d: d.repartition(7)) == wanted
    assert repaired(spark, [], lambda d: d) == {}


def test_repaired_rows_follow_the_pattern(spark):
    rng = random.Random(4)
    rows = [
        (rng.randint(0, 30), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", "c?"]))
        for _ in range(400)
    ]
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    assert repaired(spark, rows) == {c: expected(group) for c, group in by.items()}
    frame = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in cr.repaired(frame, cr.plans(frame)).collect():
        out.setdefault(r["conv_id"], []).append(r)
    for found in out.values():
        assert [r["place"] for r in found] == list(range(len(found)))
        assert PATTERN.fullmatch("".join(r["role"][0] for r in found))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_op12_by_rows(spark, folder):
    by, every = {}, set()
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        every.add(r["conv_id"])
        kind = crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"] or " ", " " if r["text"] is None else r["text"]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (r["turn"], "user" if kind == 4 else role, text)
        by.setdefault(r["conv_id"], []).extend([] if kind == 0 else [row] * (2 if kind == 3 else 1))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert set(got) == every
    assert got == {c: expected(group) for c, group in by.items()}
