"""Repair of the structure of conversations by the cheapest edits of their rows.

A repaired conversation reads `(s?(ua)+)?` by the initials of its roles. Rows are kept, given
another role, deleted, or new ones are inserted. The edits of a conversation are the ways
through a lattice of (rows read, state of the pattern); its cheapest ones are found by
Dijkstra's search from both ends, and of all that cost the same, the edits whose initials
(`D`, `I`, `K`, `R`) come first in ASCII are taken.

Rows are read in the order of turn (null first), role, and MD5 of the text.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulage.llm.common import exact

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NO_FAULT, BLANK, DUPLICATE, CUT_OFF = range(4)
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
# States by what was read last: nothing, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
ENDS = (START, ASSISTANT)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
# The state after a row of that role, where the pattern allows one.
AFTER = {
    (START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER,
    (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER,
}
# The only role besides system that may follow a state, which is also the state after it.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def code(role: str, fault: int) -> int:
    """A row as the search sees it: role (0: none that the pattern knows) and first fault."""
    return INITIALS.get(role[:1], 0) * 4 + fault


class Lattice:
    """Edits of a conversation; a node is ``rows read * STATES + state``."""

    def __init__(self, codes: bytes):
        self.codes, self.rows = codes, len(codes)
        self.source = START
        self.targets = [self.rows * STATES + state for state in ENDS]

    def ahead(self, node: int) -> Iterator[tuple[str, int, int]]:
        """Edits that lead on from a node: initial, cost, node behind it."""
        row, state = divmod(node, STATES)
        yield "I", INSERT, row * STATES + NEXT[state]
        if row == self.rows:
            return
        role, fault = divmod(self.codes[row], 4)
        below = (row + 1) * STATES
        yield "D", DELETE, below + state
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT_OFF else 0
        if (state, role) in AFTER:
            yield "K", KEEP + extra, below + AFTER[state, role]
        yield "R", REROLE + extra, below + NEXT[state]

    def back(self, node: int) -> Iterator[tuple[str, int, int]]:
        """Edits that lead to a node: initial, cost, node before it."""
        row, state = divmod(node, STATES)
        for before in range(STATES):
            if NEXT[before] == state:
                yield "I", INSERT, row * STATES + before
        if row == 0:
            return
        role, fault = divmod(self.codes[row - 1], 4)
        above = (row - 1) * STATES
        yield "D", DELETE, above + state
        if fault in (BLANK, DUPLICATE):
            return
        extra = TRUNCATED if fault == CUT_OFF else 0
        for before in range(STATES):
            if AFTER.get((before, role)) == state:
                yield "K", KEEP + extra, above + before
            if NEXT[before] == state:
                yield "R", REROLE + extra, above + before


class Half:
    """Dijkstra's search from one end. Edits that cost nothing read a row, so nodes of equal
    distance settle in the order of rows."""

    def __init__(self, begin: list[int], edges, size: int, sign: int):
        self.edges, self.sign = edges, sign
        self.reached = array("q", [-1]) * size  # least distance so far
        self.settled = bytearray(size)
        self.heap: list[tuple[int, int]] = []
        for node in begin:
            self.offer(node, 0)

    def offer(self, node: int, distance: int) -> None:
        if self.reached[node] < 0 or distance < self.reached[node]:
            self.reached[node] = distance
            heapq.heappush(self.heap, (distance, self.sign * node))

    def top(self) -> float:
        """Distance of the next node to settle."""
        while self.heap and self.settled[self.sign * self.heap[0][1]]:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> int:
        distance, node = heapq.heappop(self.heap)
        node *= self.sign
        self.settled[node] = 1
        for _, cost, other in self.edges(node):
            self.offer(other, distance + cost)
        return node


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation's least edits.

    The halves meet where a settled node of one is an edit away from a settled node of the
    other. They go on until nothing that costs the same can be missing, that is, until the
    next distances of both together exceed the best meeting. Memory: some dozen bytes a row.
    """
    lattice = Lattice(codes)
    size = (lattice.rows + 1) * STATES
    front = Half([lattice.source], lattice.ahead, size, 1)
    rear = Half(lattice.targets, lattice.back, size, -1)
    best = float("inf")
    while front.top() + rear.top() <= best and (front.heap or rear.heap):
        if front.top() <= rear.top():
            here, near, far = front.settle(), front, rear
        else:
            here, near, far = rear.settle(), rear, front
        done = near.reached[here]
        if far.settled[here] or (near is front and here in lattice.targets):
            best = min(best, done + far.reached[here])
        if near is rear and here == lattice.source:
            best = min(best, done)
        for _, cost, other in near.edges(here):
            if far.settled[other]:
                best = min(best, done + cost + far.reached[other])
    return int(best), _least_audit(lattice, front, rear, int(best))


def _least_audit(lattice: Lattice, front: Half, rear: Half, best: int) -> str:
    """The least audit over all crossings of the halves that cost ``best``.

    Nodes of the front half from which such a crossing can be reached are marked, last ones
    first. An edit's initial tells the node it leads to, so taking the least initial at every
    node gives the least concatenation.
    """
    ends = set(lattice.targets)

    def crosses(node: int) -> bool:
        if rear.settled[node] and front.reached[node] + rear.reached[node] == best:
            return True
        return node in ends and front.reached[node] == best

    marked = bytearray(len(front.settled))
    for row in range(lattice.rows, -1, -1):
        # Within a row only insertions lead on, from a smaller to a larger distance.
        states = [n for n in range(row * STATES, (row + 1) * STATES) if front.settled[n]]
        for node in sorted(states, key=lambda n: -front.reached[n]):
            marked[node] = crosses(node) or any(
                _on_way(front, rear, marked, front.reached[node] + cost, other, best)
                for _, cost, other in lattice.ahead(node)
            )
    audit, node, spent = [], lattice.source, 0
    while node not in ends or spent < best:
        if rear.settled[node] and spent + rear.reached[node] == best:
            fits = lambda other, now: rear.settled[other] and now + rear.reached[other] == best
        else:
            fits = lambda other, now: _on_way(front, rear, marked, now, other, best)
        initial, cost, node = min(
            (initial, cost, other) for initial, cost, other in lattice.ahead(node) if fits(other, spent + cost)
        )
        audit.append(initial)
        spent += cost
    return "".join(audit)


def _on_way(front: Half, rear: Half, marked: bytearray, now: int, other: int, best: int) -> bool:
    """Whether an edit that brings the cost to ``now`` at ``other`` is part of a least way."""
    if front.settled[other] and marked[other] and front.reached[other] == now:
        return True
    return bool(rear.settled[other]) and now + rear.reached[other] == best


def facts(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` with the row's ``digest`` and first ``fault``.

    A row repeats an earlier one if role and text (by MD5) are equal; rows that agree in all
    are copies, and the first of them counts. Hot groups are sorted by Spark, not collected.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    complete = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    again = F.row_number().over(
        W.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    ) > 1
    return rows.withColumn("digest", F.md5(F.encode("text", "UTF-8"))).withColumn(
        "fault",
        F.when(blank, BLANK).when(again, DUPLICATE).when(~complete, CUT_OFF).otherwise(NO_FAULT),
    )


def _planning(batches) -> Iterator:
    """For mapInArrow over sorted rows: a row per conversation, a byte per row in memory."""
    import pyarrow as pa

    def row() -> list:
        turns, seen = state["turns"], state["faults"]
        gaps = state["last"] - state["first"] + 1 - turns if turns else 0
        cost, audit = cheapest(bytes(state["codes"]))
        return [state["conv"], gaps, seen[BLANK], seen[DUPLICATE], seen[CUT_OFF], state["illegal"], cost, audit]

    def batch_of(found: list[list]):
        types = [conv_type, *[pa.int64()] * 6, pa.string()]
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*found), types)], names
        )

    state, out, conv_type = None, [], None
    for batch in batches:
        conv_type = batch.schema.field("conv").type
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv", "turn", "role", "fault")]
        for conv, turn, role, fault in zip(*columns):
            if state is None or conv != state["conv"]:
                if state is not None:
                    out.append(row())
                state = dict(
                    conv=conv, turns=0, first=None, last=None, faults=[0] * 4, illegal=0, codes=bytearray()
                )
            if turn is not None and turn != state["last"]:
                state["first"] = turn if state["first"] is None else state["first"]
                state["last"] = turn
                state["turns"] += 1
            state["faults"][fault] += 1
            codes = state["codes"]
            now = code(role, fault)
            state["illegal"] += bool(codes) and (codes[-1] // 4, now // 4) not in LEGAL
            codes.append(now)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if state is not None:
        out.append(row())
    if out:
        yield batch_of(out)


def plans(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``gaps`` counts turns missing between the least and the largest one, null turns aside;
    ``blank``, ``duplicate`` and ``truncated`` count rows by their first fault; ``illegal``
    counts neighbours whose roles' initials are not `su`, `ua` or `au`. A role's first letter
    counts; an empty or another role fits nowhere and can only be changed or deleted. Null
    roles and texts are one space; null identifiers are one conversation. Rows that agree in
    all are repeated rows of the conversation. An empty table gives no rows.

    Roles and faults of a conversation are gathered (a byte a row, as many as its audit has at
    least); texts are not.
    """
    kept = _named(rows, conversation, turn, role, text)
    narrow = facts(kept).select("conv", "turn", "role", "digest", "fault")
    kind = kept.schema["conv"].dataType.simpleString()
    return (
        _in_order(narrow, [], [F.col("fault") == DUPLICATE])  # of copies, the one that counts
        .mapInArrow(
            _planning,
            f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string",
        )
        .withColumnRenamed("conv", "conv_id")
    )


def _named(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    return exact(rows, conv=conversation, turn=turn, role=role, text=text).select(
        "conv", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def _in_order(rows: DataFrame, first: list, last: list) -> DataFrame:
    order = [*first, F.asc_nulls_first("turn"), "role", "digest", *last]
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _applying(batches) -> Iterator:
    """For mapInArrow over a conversation's plan followed by its rows in order."""
    import pyarrow as pa

    def insertions() -> None:
        while state["at"] < len(state["audit"]) and state["audit"][state["at"]] == "I":
            put("I", NAMES[NEXT[state["last"]]], "")
            state["at"] += 1

    def put(edit: str, role: str, text: str) -> None:
        out.append((state["conv"], state["place"], role, text, edit))
        state["last"] = INITIALS[role[0]]
        state["place"] += 1

    def flush():
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, t) for column, t in zip(zip(*out), types)],
            ["conv_id", "place", "role", "text", "edit"],
        )

    state, out, kind = None, [], None
    for batch in batches:
        kind = batch.schema.field("conv").type
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("conv", "audit", "role", "text")]
        for low in range(0, batch.num_rows, 256):
            for conv, audit, role, text in zip(*(c.slice(low, 256).to_pylist() for c in columns)):
                if audit is not None:
                    state = dict(conv=conv, audit=audit, at=0, place=0, last=START)
                    insertions()
                    continue
                edit = state["audit"][state["at"]]
                state["at"] += 1
                if edit == "K":
                    put("K", role, text)
                elif edit == "R":
                    put("R", NAMES[NEXT[state["last"]]], text)
                insertions()
            if out:
                yield flush()
                out = []


def repaired(
    rows: DataFrame, planned: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired rows: ``conv_id, place, role, text, edit``, places from 0 in each conversation.

    A plan goes to where its rows go and comes before them, so that rows stream past it;
    nothing of a conversation is held but its audit. The result lies conversation by
    conversation in the order of places.
    """
    kept = _named(rows, conversation, turn, role, text).withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    kind = kept.schema["conv"].dataType.simpleString()
    audits = planned.select(F.col("conv_id").alias("conv"), "audit")
    both = kept.unionByName(audits, allowMissingColumns=True)
    return _in_order(both, [F.col("audit").isNull()], []).select("conv", "audit", "role", "text").mapInArrow(
        _applying, f"conv_id {kind}, place long, role string, text string, edit string"
    )


def _hashing(batches) -> Iterator:
    import pyarrow as pa

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())],
            ["conv_id", "repaired_sha256"],
        )

    conv, running, out, kind = None, None, [], None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "place", "role", "text")]
        for key, place, role, text in zip(*columns):
            if place == 0:
                if running is not None:
                    out.append((conv, running.hexdigest()))
                conv, running = key, hashlib.sha256()
            line = f"{role}:{text}" if place == 0 else f"\n{role}:{text}"
            running.update(line.encode("utf-8", "surrogatepass"))
        if len(out) >= 1000:
            yield flush()
            out = []
    if running is not None:
        out.append((conv, running.hexdigest()))
    if out:
        yield flush()


def digests(result: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of what `repaired` returns as it lies: SHA-256 of the lines
    `role:text`. Conversations without rows have none."""
    kind = result.schema["conv_id"].dataType.simpleString()
    return result.mapInArrow(_hashing, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` (null role or text: one space) with faults put in by
    crc32 of `conv_id:turn` (nulls: one space) modulo 20: 0 drops a row, 1 empties its text, 2
    takes out its `.!?`, 3 repeats it, 4 makes the user its role."""
    named = exact(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chosen: Column = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(chosen == 1, "").when(chosen == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(chosen == 4, "user").otherwise(blank("role"))
    times = F.when(chosen == 3, 2).otherwise(1)
    return (
        named.where(chosen != 0)
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))
        .select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
        .drop("copy")
    )
