"""Conversation structure repair: the cheapest edits that make turns alternate, by a run-length DP.

A row is a symbol: whether it must go, else its role and whether it is cut off.
An automaton of four states (nothing yet, after system, after user, after
assistant) reads the repaired roles, and the min-plus transition of a symbol says
what it costs to come from state to state over one row, insertions before it
included.

1. Rows are collapsed to entries (equal neighbours with a count), sorted by
   ranges of conversation and turn, and read in blocks of at most ``BLOCK``
   entries, so a conversation that holds a third of all rows is many blocks.
2. A block collapses equal consecutive symbols into runs; a run of n rows is the
   n-th min-plus power of its transition, from cached binary powers.
3. Costs to the end go backwards over the runs. Then the choices are unrolled
   forwards: at each row the least letter that keeps the cost. A conversation of
   one block is done there. For others the matrices of the blocks give each
   block its costs to the end, blocks are unrolled from every state, and one walk
   over blocks - no more than 2**31 / ``BLOCK``, as the audit is a string with
   a letter per row - picks the paths that fit together.
4. Texts are read again, meet their audit once, and are hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize

BLOCK = 4096
HEAD = 32

# fixed values: costs of the edits, and of leaving a row that is cut off
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
ROLES = {2: "user", 3: "assistant"}

INF = 1 << 60
STATES = range(4)
#: state after another user or assistant turn, from each state
NEXT = (2, 2, 3, 2)
#: (state, role class) of rows that may stay -> state; role classes are system, user, assistant, other
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
#: insertions that end a conversation, from each state
ENDING = (0, 2, 1, 0)
END = tuple(n * INSERT for n in ENDING)
#: symbols: role class times two, plus one if cut off; or a row that must go
GONE = 8
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _closed(options: list[tuple[int, int, int]]) -> tuple:
    """Matrix of single steps ``from, to, cost`` after any insertions."""
    step = [[INF] * 4 for _ in STATES]
    for a, b, cost in options:
        step[a][b] = min(step[a][b], cost)
    out = []
    for q in STATES:
        row, state, paid = list(step[q]), q, 0
        for _ in range(3):
            state, paid = NEXT[state], paid + INSERT
            row = [min(x, paid + y) for x, y in zip(row, step[state], strict=True)]
        out.append(tuple(row))
    return tuple(out)


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """``letter, next state, cost`` of the edits that use up a row."""
    out = [("D", state, DELETE)]
    if symbol != GONE:
        extra = CUT_OFF * (symbol % 2)
        if (state, symbol // 2) in KEEP:
            out.append(("K", KEEP[state, symbol // 2], extra))
        out.append(("R", NEXT[state], RENAME + extra))
    return out


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product."""
    return tuple(tuple(min(min(x + b[k][j] for k, x in enumerate(row)), INF) for j in STATES) for row in a)


def onto(a: tuple, v: tuple) -> tuple:
    """Costs to the end before a transition, from those after it."""
    return tuple(min(min(x + y for x, y in zip(row, v, strict=True)), INF) for row in a)


@lru_cache(maxsize=None)
def power_of_two(symbol: int, k: int) -> tuple:
    """Transition of ``2**k`` rows of a symbol; at most 32 powers of nine symbols are kept."""
    if k:
        half = power_of_two(symbol, k - 1)
        return times(half, half)
    return _closed([(q, to, cost) for q in STATES for _, to, cost in _options(symbol, q)])


def _powers(symbol: int, n: int) -> list[tuple]:
    return [power_of_two(symbol, k) for k in range(n.bit_length()) if n >> k & 1]


def advance(symbol: int, n: int, v: tuple) -> tuple:
    """Costs to the end before a run, from those after it."""
    for m in _powers(symbol, n):
        v = onto(m, v)
    return v


def run_matrix(runs: list[tuple[int, int]]) -> tuple:
    out = tuple(tuple(0 if i == j else INF for j in STATES) for i in STATES)
    for symbol, n in runs:
        for m in _powers(symbol, n):
            out = times(out, m)
    return out


@lru_cache(maxsize=100_000)
def _choice(symbol: int, state: int, after: tuple) -> tuple[str, int]:
    """Least letters of the cheapest way over one row, and the state behind it; ``after`` are costs to the end, least one 0."""
    here, letters = onto(power_of_two(symbol, 0), after), ""
    while True:
        for letter, to, cost in sorted([*_options(symbol, state), ("I", -1, INSERT)]):
            if cost + (here[NEXT[state]] if to < 0 else after[to]) == here[state]:
                break
        letters += letter
        if to >= 0:
            return letters, to
        state = NEXT[state]


def _level(v: tuple) -> tuple:
    low = min(v)
    return tuple(min(x - low, INF) for x in v)


def unroll(runs: list[tuple[int, int]], state: int, after: tuple) -> tuple[str, int]:
    """Letters of the cheapest way over runs from ``state``, least in ASCII order, and the state behind them."""
    if not runs:
        return "", state
    ends = [_level(after)]
    for symbol, n in reversed(runs[1:]):
        ends.append(_level(advance(symbol, n, ends[-1])))
    out = []
    for (symbol, n), end in zip(runs, reversed(ends), strict=True):
        if symbol == GONE:
            # going first costs the same as after any insertion, and D is the least letter
            out.append("D" * n)
            continue
        behind = [end]
        for _ in range(n - 1):
            behind.append(_level(onto(power_of_two(symbol, 0), behind[-1])))
        for v in reversed(behind):
            letters, state = _choice(symbol, state, v)
            out.append(letters)
    return "".join(out), state


@lru_cache(maxsize=50_000)
def solve(runs: tuple) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    cost = END
    for symbol, n in reversed(runs):
        cost = advance(symbol, n, cost)
    letters, state = unroll(list(runs), 0, END)
    return cost[0], letters + "I" * ENDING[state]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows broken by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 takes out ``.!?``, 3 has
    it twice, 4 makes it the user's. Null counts as one space in the key, the role
    and the text.
    """
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(code == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def _keys() -> list[Column]:
    """What rows of a conversation are ordered by: turn (null first), role, beginning of the text, digest of role and text."""
    role, text = F.col("role"), F.col("text")
    return [
        F.col("turn").isNotNull().cast("int").alias("dated"), F.coalesce("turn", F.lit(0)).alias("at"), F.substring(role, 1, HEAD).alias("who"), F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
    ]


ORDER = ["dated", "at", "who", "head", "digest"]


def _entries(rows: DataFrame) -> DataFrame:
    """One entry per distinct row of a conversation with its copies; whether it is blank, cut off, or all seen earlier."""
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    slim = rows.filter("copies > 0").select(
        "conv_id", *_keys(), F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role"),
        (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"), "copies",
    )
    entries = materialize(slim.groupBy("conv_id", *ORDER, "role", "blank", "cut").agg(F.sum("copies").alias("n")), "conversation-entries")
    time = F.struct("dated", "at")
    again = entries.groupBy("conv_id", "digest").agg(F.min(time).alias("_first"), F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    return entries.join(again, same, "left").withColumn("seen", F.coalesce(time > F.col("_first"), F.lit(False))).drop("_conv", "_digest", "_first")


class _Part:
    """Counts and runs of consecutive entries of one conversation."""

    def __init__(self, conv):
        self.conv, self.entries, self.runs = conv, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def _run(self, symbol: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + n)
        elif n:
            self.runs.append((symbol, n))

    def add(self, turn, role: int, blank: bool, cut: bool, seen: bool, n: int) -> None:
        self.entries += 1
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if self.last_role is not None and (self.last_role, role) not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1
        self.first_role, self.last_role = role if self.first_role is None else self.first_role, role
        if blank:
            self.blank += n
            self._run(GONE, n)
            return
        own = 0 if seen else 1
        self.duplicate += n - own
        self.truncated += own * cut
        self._run(2 * role + cut, own)
        self._run(GONE, n - own)

    def join(self, r: dict) -> None:
        """Take in the counts of the block that follows."""
        self.blank, self.duplicate, self.truncated = self.blank + r["blank"], self.duplicate + r["duplicate"], self.truncated + r["truncated"]
        self.illegal += r["illegal"] + (self.last_role is not None and (self.last_role, r["first_role"]) not in LEGAL)
        self.first_role, self.last_role = r["first_role"] if self.first_role is None else self.first_role, r["last_role"]
        if r["turns"]:
            self.turns += r["turns"] - (self.last_turn == r["first_turn"])
            self.first_turn = r["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["last_turn"]

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_BLOCK_DDL = (
    ", part int, number int, whole boolean, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", turns long, first_turn long, last_turn long, first_role int, last_role int, symbols binary, lengths array<long>, matrix array<long>, gaps long, cost long, audit string"
)
_DONE = ["gaps", *_COUNTS, "cost", "audit"]


def _blocks(names: list[str], conv_type: pa.DataType, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held = TaskContext.get().partitionId(), 0, None
        rows: list[list] = []

        def close(p: _Part, whole: bool) -> None:
            """A block is finished; a conversation that no other block can hold is solved."""
            nonlocal number
            runs = tuple(p.runs)
            done = [p.gaps(), *solve(runs)] if whole else [None, None, None]
            parts = [b"", [], []] if whole else [bytes(s for s, _ in runs), [n for _, n in runs], [x for row in run_matrix(p.runs) for x in row]]
            counts = [getattr(p, c) for c in [*_COUNTS, "turns", "first_turn", "last_turn", "first_role", "last_role"]]
            rows.append([p.conv, task, number, whole, *counts, *parts, *done])
            number += 1

        def out() -> pa.RecordBatch:
            types = [conv_type, pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        first, split = True, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "dated", "at", "role", "blank", "cut", "seen", "n")]
            for conv, dated, at, *entry in zip(*columns, strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        close(held, not first and not split)
                        first = False
                    held, split = _Part(conv), False
                elif held.entries == block:
                    close(held, False)
                    held, split = _Part(conv), True
                held.add(at if dated else None, *entry)
            if rows:
                yield out()
        if held is not None:
            close(held, False)
        if rows:
            yield out()

    return run


def _matrix(flat: list[int]) -> tuple:
    return tuple(tuple(flat[4 * i : 4 * i + 4]) for i in STATES)


def _costs_to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first: what the rest costs from each state behind the block."""
    conv, v, started = None, END, False
    for batch in batches:
        found = []
        for c, m in zip(batch.column("conv_id").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
            if not started or c != conv:
                conv, v, started = c, END, True
            found.append(list(v))
            v = onto(_matrix(m), v)
        if found:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "number")), pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "number", "after"])


def _from_every_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, exits = [], []
        for symbols, lengths, after in zip(*(batch.column(c).to_pylist() for c in ("symbols", "lengths", "after")), strict=True):
            ways = [unroll(list(zip(symbols, lengths, strict=True)), q, tuple(after)) for q in STATES]
            audits.append([a for a, _ in ways])
            exits.append([q for _, q in ways])
        if audits:
            names = [n for n in batch.schema.names if n not in ("symbols", "lengths", "after")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=[*names, "audits", "exits"]
            )


def _walk(names: list[str], conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a conversation in order: the path through them, and the counts of all."""
        held, letters, state, cost = None, [], 0, 0

        def done() -> list:
            return [held.conv, held.gaps(), *[getattr(held, c) for c in _COUNTS], cost, "".join(letters) + "I" * ENDING[state]]

        def out(rows: list) -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if held is None or held.conv != r["conv_id"]:
                    if held is not None:
                        rows.append(done())
                    held, letters, state = _Part(r["conv_id"]), [], 0
                    cost = onto(_matrix(r["matrix"]), tuple(r["end"]))[0]
                held.join(r)
                letters.append(r["audits"][state])
                state = r["exits"][state]
            if rows:
                yield out(rows)
        if held is not None:
            yield out([done()])

    return run


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of conversations with rows."""
    kind = dict(rows.dtypes)["conv_id"]
    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    names = [c.split()[0] for c in ("conv_id" + _BLOCK_DDL).split(", ")]
    entries = materialize(_entries(rows), "conversation-order")
    ordered = entries.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    blocks = materialize(ordered.mapInArrow(_blocks(names, conv_type, block), f"conv_id {kind}" + _BLOCK_DDL), "conversation-blocks")
    whole = blocks.filter("whole").select("conv_id", *_DONE)
    # blocks of conversations that go on, or may go on, in others
    open_ = blocks.filter("not whole").drop("whole", *[c for c in _DONE if c not in _COUNTS])
    backwards = open_.select("conv_id", "part", "number", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("number"))
    after = backwards.mapInArrow(_costs_to_the_end, f"conv_id {kind}, part int, number int, after array<long>")
    met = open_.join(after.drop("conv_id"), ["part", "number"])
    ddl = f"part int, number int, conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", turns long, first_turn long, last_turn long, first_role int, last_role int, matrix array<long>, end array<long>"
    columns = [c.split()[0] for c in ddl.split(", ")]
    ways = met.withColumn("end", F.col("after")).select(*columns, "symbols", "lengths", "after").mapInArrow(_from_every_state, ddl + ", audits array<string>, exits array<int>")
    walked = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(
        _walk(["conv_id", *_DONE], conv_type), f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string"
    )
    return whole.unionByName(walked)


def edited(audit: str, state: int, at: int, role: str, text: str) -> tuple[int, int, list[tuple[str, str, str]]]:
    """Follow an audit over one row: place in it, state and the turns ``edit, role, text`` that come out."""
    out = []
    while audit[at] == "I":
        state = NEXT[state]
        out.append(("I", ROLES[state], ""))
        at += 1
    letter = audit[at]
    if letter == "K":
        state = KEEP[state, "sua".index(role[0])]
        out.append(("K", role, text))
    elif letter == "R":
        state = NEXT[state]
        out.append(("R", ROLES[state], text))
    return at + 1, state, out


def _apply(names: list[str], types: list[pa.DataType], turns: bool):
    """Rows sorted by conversation, each conversation's audit before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = about = None
        started, at, state, count, sha = False, 0, 0, 0, None
        rows: list[list] = []

        def take(found) -> None:
            nonlocal count
            for edit, role, text in found:
                if turns:
                    rows.append([conv, count, edit, role, text])
                else:
                    sha.update((b"\n" if count else b"") + f"{role}:{text}".encode())
                count += 1

        def close() -> None:
            if about["audit"]:
                tail = about["audit"][at:]
                if tail.strip("I"):
                    raise RuntimeError(f"conversation {conv}: rows end before their audit")
                q = state
                for _ in tail:
                    q = NEXT[q]
                    take([("I", ROLES[q], "")])
            if not turns:
                rows.append([conv, *[about[c] for c in _DONE], sha.hexdigest()])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "copies", "role", "text", "about")]
            for c, copies, role, text, told in zip(*columns, strict=True):
                c = c.as_py()
                if not started or c != conv:
                    if started:
                        close()
                    conv, started, at, state, count, sha = c, True, 0, 0, 0, hashlib.sha256()
                    about = told.as_py() or dict.fromkeys(_DONE, 0) | {"audit": ""}
                for _ in range(copies.as_py()):
                    at, state, found = edited(about["audit"], state, at, role.as_py(), text.as_py())
                    take(found)
            if rows:
                yield out()
        if started:
            close()
        if rows:
            yield out()

    return run


def _applied(rows: DataFrame, block: int, turns: bool) -> DataFrame:
    found, kind = materialize(audits(rows, block), "conversation-audits"), dict(rows.dtypes)["conv_id"]
    about = F.struct(*_DONE)
    none = F.lit(None).cast(f"struct<gaps:long,{','.join(f'{c}:long' for c in _COUNTS)},cost:long,audit:string>")
    nothing = F.lit(None)
    heads = found.select("conv_id", F.lit(0).alias("copies"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), about.alias("about"))
    # a row that was dropped stays as a mark of its conversation
    here = F.col("copies") > 0
    texts = rows.select("conv_id", F.col("copies").cast("int").alias("copies"), "turn", F.when(here, F.col("role")).alias("role"), F.when(here, F.col("text")).alias("text"), none.alias("about"))
    dealt = heads.unionByName(texts).repartition("conv_id").select("*", F.col("about").isNull().alias("row"), *_keys())
    ordered = dealt.sortWithinPartitions("conv_id", "row", *ORDER).select("conv_id", "copies", "role", "text", "about")
    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if turns:
        return ordered.mapInArrow(
            _apply(["conv_id", "position", "edit", "role", "text"], [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()], True), f"conv_id {kind}, position long, edit string, role string, text string"
        )
    return ordered.mapInArrow(
        _apply(["conv_id", *_DONE, "repaired_sha256"], [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()], False),
        f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, repaired_sha256 string",
    )


def _plain(rows: DataFrame) -> DataFrame:
    if "copies" in rows.columns:
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    return _plain(rows.withColumn("copies", F.lit(1)))


def repair_conversations(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults of each conversation and the cheapest repair of its turns.

    ``rows`` has ``conv_id, turn, role, text`` and, if wanted, ``copies`` (0: a row
    that is gone but names its conversation). Returns one row per conversation:
    ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Rows come by turn, null first; rows of one turn by
    role, the first 32 characters of their text, then a digest. Null role or text
    counts as one space; a null ``conv_id`` is a conversation like others. Repeated
    rows are duplicates. Other columns don't matter; an empty table gives no rows.
    Letters of the audit: Keep, Rerole, Delete, Insert.
    """
    return _applied(_plain(rows), block, False)


def repaired_turns(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, position, edit, role, text`` of the turns after the repair; rows as for ``repair_conversations``."""
    return _applied(_plain(rows), block, True)


# the CRC bit by bit, the DP row by row with the least audit of each state, then the audit letter by letter
ORACLE_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR x IN range(8)]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 20 AS code
  FROM raw
), broken AS (
  SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS again,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS r FROM broken
), rows_ AS (
  SELECT *, NOT blank AND again > 1 AS dup, NOT blank AND again = 1 AND cut AS trunc, blank OR again > 1 AS gone, lag(r) OVER (PARTITION BY c ORDER BY i) AS r0 FROM placed
), ins AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (0, 3, 2), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (2, 0, 2), (2, 1, 3), (2, 2, 2), (2, 3, 3), (3, 0, 3), (3, 1, 2), (3, 2, 3), (3, 3, 2)) v(q, k, t)
), edits AS (
  SELECT * FROM (VALUES (0, 's', 'K', 1), (0, 'u', 'K', 2), (1, 'u', 'K', 2), (3, 'u', 'K', 2), (2, 'a', 'K', 3), (0, '', 'R', 2), (1, '', 'R', 2), (2, '', 'R', 3), (3, '', 'R', 2),
    (0, '', 'D', 0), (1, '', 'D', 1), (2, '', 'D', 2), (3, '', 'D', 3)) v(q, r, e, t)
), dp AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': CAST(0 AS BIGINT), 'audit': ''} AS best FROM rows_
  UNION ALL
  SELECT d.c, d.i + 1, e.t, min({'cost': d.best.cost + 3 * n.k + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN x.trunc AND e.e <> 'D' THEN 3 ELSE 0 END, 'audit': d.best.audit || repeat('I', n.k) || e.e})
  FROM dp d JOIN rows_ x ON x.c = d.c AND x.i = d.i + 1 JOIN ins n ON n.q = d.q JOIN edits e ON e.q = n.t AND (e.e = 'D' OR NOT x.gone) AND (e.e <> 'K' OR e.r = x.r)
  GROUP BY d.c, d.i, e.t
), sizes AS (SELECT c, max(i) AS n FROM rows_ GROUP BY c
), ended AS (
  SELECT d.c, min({'cost': d.best.cost + 3 * list_extract([0, 2, 1, 0], q + 1), 'audit': d.best.audit || repeat('I', list_extract([0, 2, 1, 0], q + 1))}) AS best
  FROM dp d JOIN sizes s ON s.c = d.c AND s.n = d.i GROUP BY d.c
), letters AS (
  SELECT c, p, substr(best.audit, p, 1) AS e, best.audit AS audit FROM (SELECT c, best, unnest(range(1, length(best.audit) + 1)) AS p FROM ended)
), counted AS (
  SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY p) AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY p) AS o,
    sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c) % 2 AS lead FROM letters
), repaired AS (
  SELECT l.c, string_agg(CASE WHEN e = 'K' THEN x.role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE x.text END, chr(10) ORDER BY p) AS t
  FROM counted l LEFT JOIN rows_ x ON x.c = l.c AND x.i = l.i AND l.e <> 'I' WHERE e <> 'D' GROUP BY l.c
), faults AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated,
    count(*) FILTER (WHERE r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM raw) v LEFT JOIN faults f USING (c) LEFT JOIN ended e USING (c) LEFT JOIN repaired p USING (c)
"""
