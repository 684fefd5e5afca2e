"""Repair of conversation structure by iterative-deepening A*.

A conversation's rows are read by turn.  Each row is kept (cost 0), given the
role user or assistant (2) or deleted (3); an empty user or assistant row may be
inserted anywhere (2).  A blank row and a row whose role and text stood earlier must be
deleted; a truncated row that stays adds 1.  The first letters of the roles that
result have to match ``(s?(ua)+)?``.  The answer is the cheapest list of edits, of equally
cheap ones the one that is least as a string of D, I, K, R.

``search`` finds it by iterative-deepening A*: depth-first in the order D, I,
K, R below a cost bound that grows by one, so the first accepting path is the
least of the cheapest.  A table of failed states (row, expected role) holds the greatest
remaining cost that did not suffice, and is kept over the bounds.  The lower bound of what
is left adds the forced deletions, the truncated rows, and 2 for every two
neighbours in a stretch of neighbours that cannot both stay as they are.

Conversations meet by a range exchange on (conv_id, turn), so one that holds a
third of all rows is spread over many tasks: it is cut into chunks of at most
``CHUNK`` rows.  A chunk is solved for each pair of expected roles at its ends (inserted
rows belong to the row after them), its costs and the order of its answers are all that
a pass over the chunks of a conversation needs to choose the pairs, and
only then are the chunks' rows read again, in order, for the digest.  A conversation's
answer and digest are one value each, so this last pass is one task's stream a conversation.

Defined results: nulls in role or text read as one space; a null turn stands before all others;
rows of one turn are ordered by role, then by the md5 of their text; the rows with a null conv_id
are one conversation; repeated rows are duplicates; an empty table gives an empty
table; further columns are ignored; a long text is held by one task as a whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from .groups import Scratch, bounded_batches
from .registry import register

#: rows of a chunk, and bytes of its texts
CHUNK, CHUNK_BYTES = 256, 4 << 20
#: answers of whole short conversations kept by a worker
REMEMBERED = 1 << 14

#: what the next row has to be: start, user after s, assistant after u, user (or the end) after a
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_KEEP: list[dict[str, int]] = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}, {}]
_NEW = [USER, USER, ASSISTANT, USER]
_END = [(0, ""), (4, "II"), (2, "I"), (0, "")]
ROLE = {USER: "user", ASSISTANT: "assistant"}
DUPLICATE, BLANK, TRUNCATED, FINE = "d", "b", "t", "."
_LAST = re.compile(r"[^\x20\x09-\x0D]")
_LEGAL = {"su", "ua", "au"}


def _bound(rows: str, goal: int | None) -> tuple[list[int], list[tuple]]:
    """(base, more): from row i and state q, what is left costs base[i] + more[i][q] at least.

    Rows that need not go, the state before them and the end are neighbours; each pair of them that cannot
    stay as it is needs an edit of one of the two or between them, no edit serves more than two
    pairs, and each costs 2 beyond ``base``: 2 for every two pairs of a stretch."""
    n = len(rows) // 2
    base: list[int] = [0] * (n + 1)
    more: list[tuple] = [()] * (n + 1)
    # per state, the last one for roles with any other letter: pairs of the stretch that begins here, cost of those after it
    here = [(0 if q in ((START, ASSISTANT) if goal is None else (goal,)) else 1, 0) for q in range(5)]
    for i in range(n, -1, -1):
        if i < n:
            letter, fault = rows[2 * i], rows[2 * i + 1]
            if fault in (BLANK, DUPLICATE):
                base[i] = base[i + 1] + 3
            else:
                base[i] = base[i + 1] + (fault == TRUNCATED)
                pairs, far = here[_AFTER.get(letter, 4)]
                here = [(0, far + 2 * ((pairs + 1) // 2)) if letter in _KEEP[q] else (pairs + 1, far) for q in range(5)]
        more[i] = tuple(2 * ((pairs + 1) // 2) + far for pairs, far in here[:4])
    return base, more


def search(rows: str, start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then least, edits of ``rows`` from state
    ``start`` to ``goal``; with goal None to an accepted end, where rows may be
    inserted after the last one too.  None: there are none."""
    n = len(rows) // 2
    if goal in (START, SYSTEM):
        return _few(rows, start, goal)
    if goal in (USER, ASSISTANT) and n == 0:
        return (0, "") if goal == start else None
    base, more = _bound(rows, goal)
    failed: dict[int, int] = {}
    bound = base[0] + more[0][start]
    while True:
        edits: list[str] = []
        # a node: row, state, cost that is left, next edit to try
        stack = [[0, start, bound, 0]]
        while stack:
            node = stack[-1]
            i, q, left, edit = node
            node[3] += 1
            if edit == 0 and i == n and (q == goal if goal is not None else q in (START, ASSISTANT)):
                return bound - left, "".join(edits)
            if edit == 4 or (i == n and edit > 1):
                key = i * 4 + q
                failed[key] = max(left, failed.get(key, -1))
                stack.pop()
                if edits:
                    edits.pop()
                continue
            if edit == 1:
                if i == n and goal is not None:
                    continue
                j, p, cost, letter = i, _NEW[q], 2, "I"
            elif i == n:
                continue
            else:
                fault = rows[2 * i + 1]
                if edit == 0:
                    j, p, cost, letter = i + 1, q, 3, "D"
                elif fault in (BLANK, DUPLICATE):
                    continue
                elif edit == 2:
                    p = _KEEP[q].get(rows[2 * i])
                    if p is None:
                        continue
                    j, cost, letter = i + 1, int(fault == TRUNCATED), "K"
                else:
                    j, p, cost, letter = i + 1, _NEW[q], 2 + (fault == TRUNCATED), "R"
            rest = left - cost
            if rest < base[j] + more[j][p] or rest <= failed.get(j * 4 + p, -1):
                continue
            stack.append([j, p, rest, 0])
            edits.append(letter)
        bound += 1


def _few(rows: str, start: int, goal: int) -> tuple[int, str] | None:
    """Edits after which nothing is left, or one kept row with s."""
    n = len(rows) // 2
    if start == goal:
        return 3 * n, "D" * n
    if start != START or goal != SYSTEM:
        return None
    kept = [(rows[2 * i + 1] == TRUNCATED, -i) for i in range(n) if rows[2 * i] == "s" and rows[2 * i + 1] in (TRUNCATED, FINE)]
    if not kept:
        return None
    more, at = min(kept)
    return 3 * (n - 1) + more, "D" * -at + "K" + "D" * (n - 1 + at)


_remembered = lru_cache(maxsize=REMEMBERED)(search)


def applied(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) rows after the edits, and the state at their end."""
    out, i = [], 0
    for e in edits:
        if e == "K":
            out.append((roles[i], texts[i]))
            state = _KEEP[state][roles[i][:1]]
        elif e != "D":
            state = _NEW[state]
            out.append((ROLE[state], texts[i] if e == "R" else ""))
        i += e != "I"
    return out, state


def fault_of(text: str, again: bool) -> str:
    found = _LAST.findall(text[-64:]) or _LAST.findall(text)
    if not found:
        return BLANK
    return DUPLICATE if again else FINE if found[-1] in ".!?" else TRUNCATED


_STATS = ["blank", "duplicate", "truncated", "illegal"]
_ARROW = [("part", pa.int32()), *[(c, pa.int64()) for c in ("chunk", *_STATS, "low", "high", "turns", "cost")], ("closed", pa.bool_()),
          *[(c, pa.string()) for c in ("head", "tail", "audit", "repaired_sha256")], ("costs", pa.list_(pa.int64())),
          *[(c, pa.list_(pa.string())) for c in ("answers", "roles", "texts")]]
_CHUNK = ", ".join(f"{c} " + {pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string",
                              pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}[t] for c, t in _ARROW)
RESULT = ["gaps", *_STATS, "cost", "audit", "repaired_sha256"]


class _Rows:
    """Rows of one chunk of a conversation, in order."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.bytes = [], [], [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str, again: bool) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault_of(text, again))
        self.bytes += len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def record(self) -> dict:
        first = [r[:1] for r in self.roles]
        return {"blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
                "illegal": sum(a + b not in _LEGAL for a, b in zip(first, first[1:])), "head": first[0], "tail": first[-1],
                "low": self.low, "high": self.high, "turns": self.turns}

    def shape(self) -> str:
        return "".join((r[:1] if r[:1] in _AFTER else "?") + f for r, f in zip(self.roles, self.faults))

    def whole(self, keep: bool) -> dict:
        """Answer of a conversation that is one chunk."""
        cost, audit = _remembered(self.shape())
        lines = applied(audit, START, self.roles, self.texts)[0]
        out = {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()}
        return out | ({"roles": self.roles, "texts": self.texts} if keep else {})

    def between(self) -> dict:
        """Costs and answers for every pair of states before and after the chunk."""
        shape = self.shape()
        found = [search(shape, q, p) or (-1, None) for q in range(4) for p in range(4)]
        return {"costs": [c for c, _ in found], "answers": [x for _, x in found], "roles": self.roles, "texts": self.texts}


def _chunks(rows: DataFrame, keep: bool) -> DataFrame:
    """One row a chunk of (conv, turn, role, text, name, salt): with its answer if it is a whole conversation (``closed``),
    else with its costs and answers for all pairs of states, and its rows."""
    # a mark stands where a role and text occur first; all keys of the exchange are those of the first row, so no
    # bound can part the two
    marks = (rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("conv", "role", "name")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "salt")).alias("first"))
             .select("conv", F.col("first.turn").alias("turn"), "role", "name", F.lit(0).alias("row"),
                     F.col("first.salt").alias("salt"), F.lit(None).cast("string").alias("text")))
    both = rows.select("conv", "turn", "role", "name", F.lit(1).alias("row"), "salt", "text").unionByName(marks)
    keys = ["conv", "turn", "role", "name", "salt"]
    names = ["conv", *[n for n, _ in _ARROW]]

    def run(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        kind = None
        conv, mark, rows, chunk = None, None, None, 0  # chunk: how many the conversation has given before
        out, first, size = [], True, 0

        def close(last: bool) -> None:
            nonlocal number, size
            whole = not first and not last and chunk == 0
            record = {"conv": conv, "part": part, "chunk": number, "closed": whole} | rows.record()
            out.append(record | (rows.whole(keep) if whole else rows.between()))
            number += 1
            size += rows.bytes if keep or not whole else 0

        def emit():
            return pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in out], schema=kind)

        for batch in batches:
            if kind is None:
                kind = pa.schema([("conv", batch.schema.field("conv").type), *_ARROW])
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "turn", "role", "name", "row", "text")]
            for c, turn, role, name, is_row, text in zip(*cols):
                if not is_row:
                    mark = (c, turn, role, name)
                    continue
                if rows is not None and c != conv:
                    close(False)
                    first, rows, chunk = False, None, 0
                elif rows is not None and (len(rows.roles) >= CHUNK or rows.bytes >= CHUNK_BYTES):
                    close(True)
                    rows, chunk = None, chunk + 1
                conv, rows = c, rows or _Rows()
                rows.add(turn, role, text, mark != (c, turn, role, name))
                mark = None
                if len(out) >= 1024 or size >= CHUNK_BYTES:
                    yield emit()
                    out.clear()
                    size = 0
        if rows is not None:
            close(True)
        if out:
            yield emit()

    schema = T.StructType([rows.schema["conv"], *T.DataType.fromDDL(_CHUNK).fields])
    return both.repartitionByRange(*keys).sortWithinPartitions(*keys, "row").mapInArrow(run, schema)


def _runs(batches):
    """(conversation, its Arrow type, rows as dicts) of neighbouring rows of one conversation."""
    batches = iter(batches)
    head = next(batches, None)
    if head is not None:
        kind = head.schema.field("conv").type
        rows = chain.from_iterable(b.to_pylist() for b in chain([head], batches))
        for conv, own in groupby(rows, key=lambda r: r["conv"]):
            yield conv, kind, own


def choose(chunks: list[tuple[list[int], list[str]]]) -> tuple[int, list[tuple[int, int]], int]:
    """(cost, (state before, state after) of each chunk, state at the end) of the cheapest, then least, edits.
    A chunk is its costs (-1: impossible) and answers for the pairs of states."""
    best: dict[int, tuple[int, int]] = {START: (0, 0)}  # state: cost, rank among the paths to here
    back = []
    for costs, answers in chunks:
        reach = {}
        for p in range(4):
            ways = [(best[q][0] + costs[4 * q + p], best[q][1], q) for q in best if costs[4 * q + p] >= 0]
            if ways:
                reach[p] = min(ways)
        order = sorted(reach, key=lambda p: (reach[p][1], answers[4 * reach[p][2] + p]))
        back.append({p: reach[p][2] for p in reach})
        best = {p: (reach[p][0], rank) for rank, p in enumerate(order)}
    cost, _, state = min((best[q][0] + _END[q][0], best[q][1], q) for q in best)
    at, path = state, []
    for came in reversed(back):
        path.append((came[at], at))
        at = came[at]
    return cost, path[::-1], state


def _choices(chunks: DataFrame) -> DataFrame:
    """(part, chunk, state, answer, end, cost, stats) for the chunks of conversations that have several;
    the columns from ``end`` on are the conversation's."""
    numbers = ["part", "chunk", "state", "answer", "end", "cost", "gaps", *_STATS]

    def run(batches):
        for _, _, rows in _runs(batches):
            rows = list(rows)  # summaries only: a cell of the result holds a letter for each of their rows
            cost, path, state = choose([(r["costs"], r["answers"]) for r in rows])
            total = {c: sum(r[c] for r in rows) for c in _STATS}
            total["illegal"] += sum(a["tail"] + b["head"] not in _LEGAL for a, b in zip(rows, rows[1:]))
            timed = [r for r in rows if r["low"] is not None]
            turns = sum(r["turns"] for r in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
            total["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
            out = [{"part": r["part"], "chunk": r["chunk"], "state": q, "answer": 4 * q + p, "final": r is rows[-1], "end": state, "cost": cost} | total
                   for r, (q, p) in zip(rows, path)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*[(c, pa.int64()) for c in numbers], ("final", pa.bool_())]))

    answers = F.transform("answers", lambda a: F.coalesce(a, F.lit("")))
    return (chunks.where("NOT closed").select("conv", "part", "chunk", "costs", answers.alias("answers"), "head", "tail", "low", "high", "turns", *_STATS)
            .repartition("conv").sortWithinPartitions("conv", "part", "chunk")
            .mapInArrow(run, ", ".join(f"{c} bigint" for c in numbers) + ", final boolean"))


def _prepared(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, name, salt); the salt parts copies of a row, and holds only in a written table."""
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).select(
        "*", F.md5(F.col("text").cast("binary")).alias("name"), F.spark_partition_id().alias("salt"))


def _solved(conversations: DataFrame, keep: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(closed chunks, other chunks joined to their choices)."""
    bounded_batches(conversations.sparkSession)
    chunks = scratch.put(_chunks(scratch.put(_prepared(conversations), "rows"), keep), "chunks")
    picked = chunks.where("NOT closed").select("conv", "part", "chunk", "answers", "roles", "texts").join(
        scratch.put(_choices(chunks), "choices"), ["part", "chunk"])
    return chunks.where("closed"), picked.withColumn("edits", F.element_at("answers", (F.col("answer") + 1).cast("int"))).drop("answers", "answer")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation that has rows."""
    scratch = Scratch(conversations.sparkSession)
    closed, picked = _solved(conversations, False, scratch)
    kind = T.StructType([closed.schema["conv"], *T.DataType.fromDDL("audit string, repaired_sha256 string").fields])
    stats = ["gaps", *_STATS, "cost"]

    def run(batches):
        for conv, conv_type, rows in _runs(batches):
            digest, audit, empty = hashlib.sha256(), [], True
            for r in rows:
                lines, state = applied(r["edits"], r["state"], r["roles"], r["texts"])
                audit.append(r["edits"])
                if r["final"]:
                    audit.append(_END[r["end"]][1])
                    lines += applied(_END[r["end"]][1], state, [], [])[0]
                for role, text in lines:
                    digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array(["".join(audit)], pa.string()),
                                              pa.array([digest.hexdigest()])], names=["conv", "audit", "repaired_sha256"])

    read = (picked.select("conv", "part", "chunk", "state", "edits", "roles", "texts", "final", "end")
            .repartition("conv").sortWithinPartitions("conv", "part", "chunk").mapInArrow(run, kind))
    opened = picked.where("final").select("conv", *stats).join(read.withColumnRenamed("conv", "same"), F.col("conv").eqNullSafe(F.col("same")))
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    names = ["conv", *RESULT]
    return closed.withColumn("gaps", gaps).select(*names).unionByName(opened.select(*names)).withColumnRenamed("conv", "conv_id")


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, place, role, text): the rows after repair, in the order of part, chunk and place."""
    scratch = Scratch(conversations.sparkSession)
    closed, picked = _solved(conversations, True, scratch)
    names = ["conv", "part", "chunk", "state", "edits", "roles", "texts", "final", "end"]
    every = closed.select("conv", "part", "chunk", F.lit(START).alias("state"), F.col("audit").alias("edits"), "roles", "texts",
                          F.lit(False).alias("final"), F.lit(START).alias("end")).unionByName(picked.select(*names))
    kind = T.StructType([*[every.schema[c] for c in ("conv", "part", "chunk")], *T.DataType.fromDDL("place bigint, role string, text string").fields])

    def run(batches):
        for batch in batches:
            out = {"place": [], "role": [], "text": []}
            source = []
            for k, r in enumerate(batch.select(names[3:]).to_pylist()):
                lines, state = applied(r["edits"], r["state"], r["roles"], r["texts"])
                if r["final"]:
                    lines += applied(_END[r["end"]][1], state, [], [])[0]
                for place, (role, text) in enumerate(lines):
                    source.append(k)
                    out["place"].append(place)
                    out["role"].append(role)
                    out["text"].append(text)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], pa.array(out["place"], pa.int64()),
                                              pa.array(out["role"], pa.string()), pa.array(out["text"], pa.string())],
                                             names=["conv", "part", "chunk", "place", "role", "text"])

    return every.select(*names).mapInArrow(run, kind).withColumnRenamed("conv", "conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32(conv_id:turn) % 20 (null: one space): 0 drops the row, 1 empties the
    text, 2 removes its ``[.!?]``, 3 repeats the row, 4 sets the role user."""
    def or_space(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), times.alias("copy")).drop("copy")


@register("op12_ida_repair")
def op12_ida_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "found")
    every = conversations.select("conv_id").distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id", *[F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in RESULT])
