"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A conversation is an optional system turn and then user and assistant in turn, ended by the
assistant, or nothing. A turn may be kept (0), given another role (2) or deleted (3, the only
choice for a blank turn or one whose role and text were seen before); an empty user or assistant
turn may be inserted anywhere (2). A truncated turn that stays adds 1. Backwards over the turns,
the cost to go is worked out for the four states of the grammar (nothing yet, system, user and
assistant last); forwards, of the edits whose cost is tight the ASCII-least is taken (D, I, K, R).
State and letter settle the next state, so the letters are the least of all cheapest edits.

Places of turns come from a range shuffle, not from a window over a conversation. Turns are
gathered ``PART`` at a time as one row. The backward pass carries four costs from part to part
over two characters a turn; the forward pass reads the parts in order and carries the state and
the running hash. So a conversation of any length takes bounded memory: its parts pass through one
task one after the other (a hash of a whole text can't be split), but are never held together.

Null conv_id is a conversation of its own; null turns come first; null role and text count as one
space. Turns of equal number are ordered by role, the text's first 64 characters and its SHA-256,
equal rows stand side by side and all but the first are duplicates. A role is known by its first
letter (s, u, a); a kept turn keeps its role as written. Very long texts are carried whole, a
part at a time. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import SPACE, shuffle_partitions, stored

#: Turns that are gathered in one row at most.
PART = 256
#: States: nothing yet, system, user or assistant last. By state: the state after each role that may follow.
_AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after an inserted or another role, and that role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_LEGAL = ("su", "ua", "au")
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
Costs = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> Costs:
    """Costs to go where turns may be inserted first."""
    for _ in range(3):
        costs = [min(c, 2 + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


#: Costs to go behind the last turn: nothing or an assistant may come last.
LAST: Costs = _inserted([0, 99, 99, 0])


def _before(costs: Costs, role: str, fault: str) -> Costs:
    """Costs to go before a turn, from those behind it."""
    out = [3 + c for c in costs]
    if fault not in "bd":
        extra = fault == "t"
        for q in range(4):
            out[q] = min(out[q], 2 + extra + costs[_NEXT[q]])
            if role in _AFTER[q]:
                out[q] = min(out[q], extra + costs[_AFTER[q][role]])
    return _inserted(out)


def _walk(codes: str, state: int, behind: Costs) -> tuple[list[str], int]:
    """By turn of a part: the letters of its edits, inserts before it first; and the state then."""
    costs = [behind]
    for k in range(len(codes) - 2, -1, -2):
        costs.append(_before(costs[-1], codes[k], codes[k + 1]))
    costs.reverse()
    edits = []
    for k in range(0, len(codes), 2):
        role, fault, now, then, letters = codes[k], codes[k + 1], costs[k // 2], costs[k // 2 + 1], ""
        while not letters or letters[-1] == "I":
            if now[state] == 3 + then[state]:
                letters += "D"
            elif now[state] == 2 + now[_NEXT[state]]:
                letters, state = letters + "I", _NEXT[state]
            elif fault not in "bd" and role in _AFTER[state] and now[state] == (fault == "t") + then[_AFTER[state][role]]:
                letters, state = letters + "K", _AFTER[state][role]
            else:
                letters, state = letters + "R", _NEXT[state]
        edits.append(letters)
    return edits, state


def _tail(state: int) -> int:
    """Turns to insert behind the last one."""
    return LAST[state] // 2


def faults(text: Column, first: Column) -> Column:
    """b(lank), d(uplicate: not the first of its role and text), t(runcated) or a dot for none."""
    shown = F.rtrim(text, F.lit(SPACE))
    return F.when(F.length(shown) == 0, "b").when(~first, "d").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "t").otherwise(".")


def parts(messages: DataFrame, text: str = "text") -> DataFrame:
    """conv (a struct of conv_id), part, turns (turn, role, text) and codes (two letters a turn:
    role and fault), written to the shared folder."""
    space = F.lit(" ")
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce(F.col(text), space).alias("text"))
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    placed = ranked(rows, ["conv_id"], [F.asc("turn"), F.asc("role"), F.substring("text", 1, 64).asc(), sha.asc()]).withColumn("conv", F.struct("conv_id"))
    placed = stored(placed.select("conv", "place", "turn", "role", "text"), "placed")
    first = placed.groupBy("conv", "role", sha.alias("_sha")).agg(F.min("place").alias("_first")).select(F.col("conv").alias("_conv"), "_first")
    marked = placed.join(first.hint("merge"), placed["conv"].eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_first")), "left")
    code = F.concat(F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x"), faults(F.col("text"), F.col("_first").isNotNull()))
    each = marked.select("conv", F.expr(f"(place - 1) div {PART}").alias("part"), F.struct("place", "turn", "role", "text", code.alias("code")).alias("x"))
    held = each.groupBy("conv", "part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    turns = F.transform("x", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    return stored(held.select("conv", "part", turns.alias("turns"), F.array_join(F.transform("x", lambda x: x["code"]), "").alias("codes")), "parts")


def _in_order(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), "conv").sortWithinPartitions("conv", *order)


def costs_behind(held: DataFrame) -> DataFrame:
    """conv, part and behind: the costs to go where the part ends, by one backward pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, costs = None, LAST
        for batch in batches:
            out = []
            for c, codes in zip(batch.column("conv").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                conv, costs = c, LAST if c != conv else costs
                out.append([*costs])
                for k in range(len(codes) - 2, -1, -2):
                    costs = _before(costs, codes[k], codes[k + 1])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(out, pa.list_(pa.int64()))], names=["conv", "part", "behind"])

    narrow = _in_order(held.select("conv", "part", "codes"), F.desc("part"))
    kind = held.schema["conv"].dataType.simpleString()
    return narrow.mapInArrow(run, f"conv {kind}, part bigint, behind array<bigint>")


def _with_costs(held: DataFrame) -> DataFrame:
    behind = costs_behind(held).select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "behind")
    on = held["conv"].eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    return _in_order(held.join(behind.hint("merge"), on).select("conv", "part", "turns", "codes", "behind"), F.asc("part"))


class _Conversation:
    """What the forward pass carries from part to part."""

    def __init__(self, conv: dict, emit: Callable[[str, str, str], None]):
        self.conv, self.emit = conv, emit
        self.state, self.n, self.cost, self.illegal, self.role = 0, 0, 0, 0, None
        self.turns, self.least, self.most = 0, None, None
        self.faults = dict.fromkeys("bdt", 0)
        self.letters: list[str] = []

    def read(self, turns: list[dict], codes: str, behind: Costs) -> None:
        edits, state = _walk(codes, self.state, behind)
        for k, (turn, letters) in enumerate(zip(turns, edits, strict=True)):
            role, fault = codes[2 * k], codes[2 * k + 1]
            if fault in self.faults:
                self.faults[fault] += 1
            self.illegal += self.role is not None and self.role + role not in _LEGAL
            self.role = role
            if (t := turn["turn"]) is not None and t != self.most:
                self.turns, self.least, self.most = self.turns + 1, t if self.least is None else self.least, t
            for x in letters:
                self.edit(x, role, turn, fault)
        self.state = state

    def edit(self, letter: str, role: str = "", turn: dict | None = None, fault: str = ".") -> None:
        self.cost += {"D": 3, "I": 2, "K": 0, "R": 2}[letter] + (letter in "KR" and fault == "t")
        self.letters.append(letter)
        if letter == "D":
            return
        kept = letter == "K"
        self.emit(letter, turn["role"] if kept else _ROLE[self.state], "" if letter == "I" else turn["text"])
        self.state = _AFTER[self.state][role] if kept else _NEXT[self.state]

    def close(self) -> None:
        for _ in range(_tail(self.state)):
            self.edit("I")

    def counts(self) -> list[int]:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return [gaps, *self.faults.values(), self.illegal, self.cost]


def _read_through(batches: Iterator[pa.RecordBatch], begin: Callable[[dict], _Conversation], end: Callable[[_Conversation], None]) -> Iterator[None]:
    """Feed parts to their conversation; yields after each part, and once at the end."""
    now = None
    for batch in batches:
        columns = [batch.column(c) for c in ("conv", "turns", "codes", "behind")]
        for k in range(batch.num_rows):
            conv, turns, codes, behind = (c[k].as_py() for c in columns)
            if now is None or now.conv != conv:
                if now:
                    end(now)
                now = begin(conv)
            now.read(turns, codes, tuple(behind))
            yield
    if now:
        end(now)
    yield


def repair(messages: DataFrame, text: str = "text") -> DataFrame:
    """By conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits'
    letters) and repaired_sha256 (of the repaired ``role:text``, joined by newlines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        sha = None

        def emit(letter: str, role: str, body: str) -> None:
            sha.update(f"\n{role}:{body}".encode() if sha_at[0] else f"{role}:{body}".encode())
            sha_at[0] = True

        def begin(conv: dict) -> _Conversation:
            nonlocal sha
            sha, sha_at[0] = hashlib.sha256(), False
            return _Conversation(conv, emit)

        def end(c: _Conversation) -> None:
            c.close()
            rows.append([c.conv, *c.counts(), "".join(c.letters), sha.hexdigest()])

        sha_at = [False]
        for _ in _read_through(batches, begin, end):
            if len(rows) >= 1000:
                yield _batch(rows, schema)
                rows.clear()
        yield _batch(rows, schema)

    held = parts(messages, text)
    kind = held.schema["conv"].dataType.simpleString()
    spec = f"conv {kind}, {RESULT}"
    schema = _arrow(held, spec)
    return _with_costs(held).mapInArrow(run, spec).select("conv.conv_id", *[c.split(" ")[0] for c in RESULT.split(", ")])


def repaired_turns(messages: DataFrame, text: str = "text") -> DataFrame:
    """The turns after repair: conv_id, place (from 0), role, text and edit (I, K or R)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        at = [None, 0]

        def emit(letter: str, role: str, body: str) -> None:
            rows.append([at[0], at[1], role, body, letter])
            at[1] += 1

        def begin(conv: dict) -> _Conversation:
            at[:] = [conv, 0]
            return _Conversation(conv, emit)

        for _ in _read_through(batches, begin, _Conversation.close):
            if len(rows) >= 1000:
                yield _batch(rows, schema)
                rows.clear()
        yield _batch(rows, schema)

    held = parts(messages, text)
    spec = f"conv {held.schema['conv'].dataType.simpleString()}, place bigint, role string, text string, edit string"
    schema = _arrow(held, spec)
    return _with_costs(held).mapInArrow(run, spec).select("conv.conv_id", "place", "role", "text", "edit")


def _arrow(df: DataFrame, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spec))


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def damage(messages: DataFrame, text: str = "text") -> DataFrame:
    """Rows with faults that follow from crc32 of ``conv_id:turn``, one in twenty of each kind: dropped,
    emptied, without full stops, repeated, or given to the user. Nulls become one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = messages.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce(F.col(text), space).alias("text"), (F.crc32(F.encode(name, "UTF-8")) % 20).cast("int").alias("_kind")).where("_kind <> 0")
    body = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), twice).drop("_copy")


def repair_damaged(messages: DataFrame, text: str = "text") -> DataFrame:
    """``repair`` of ``damage``, with a row of zeros for conversations that lost every turn."""
    done = repair(damage(messages, text)).select(F.struct("conv_id").alias("_conv"), *[c.split(" ")[0] for c in RESULT.split(", ")])
    every = messages.select("conv_id").distinct().select("conv_id", F.struct("conv_id").alias("conv"))
    out = every.join(done.hint("merge"), F.col("conv").eqNullSafe(F.col("_conv")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select("conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0).cast("bigint"))).alias(c) for c, _ in (x.split(" ") for x in RESULT.split(", "))])
