"""Repair of conversation structure by the cheapest edits.

A repaired conversation's roles read (s?(ua)+)?: nothing, or an optional system
turn and then pairs of user and assistant. Edits are found by Dijkstra's
algorithm on the lattice of (row, grammar state), whose edges are made as they
are needed; the priority is (cost, audit), audit being the initials of the edits
so far, so the first accepting end node that is popped is the cheapest edit and
the ASCII-least of equal ones.

Rows are dealt by ranges of (conversation, turn), so a task holds many short
conversations or a piece of a long one. A conversation that lies inside one task
and one block is solved there. The others are cut into blocks, each with the best
(cost, audit) between every two states at its ends; these small tables are then
chained per conversation. Equal rows travel as one row with a number of copies."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.llm.common import bound_arrow, materialize, trimmed

#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
#: Costs of edits; a truncated row that stays costs one more (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: State of the grammar -> {initial of the next role: next state}. 0: nothing
#: yet, 1: a system turn, 2: a user turn is open, 3: it is answered.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
_ROLES = {"s": "system", "u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
_SPACES = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with the planted faults of a test of repair, in columns conv_id,
    turn, role, text, copies: crc32 of `conv:turn` modulo 20 drops the row (0),
    empties its text (1), takes . ! ? away (2), repeats it (3) or makes it the
    user's (4). Nulls count as one space, in the text and role too."""
    conv, turn = F.col(conv_col), F.col(turn_col).cast("long")
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), F.lit(" ")))
    copies = F.when(kind == 3, 2).otherwise(1).cast("long")
    return turns.where(kind != 0).select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


@dataclass
class Item:
    """A row, or `count` equal ones that must go: initial of the role, fault."""

    initial: str
    fault: str
    count: int = 1


def items_of(rows: Iterable[dict]) -> list[Item]:
    """Items of sorted rows (role, fault, copies): copies of a row that may stay
    are duplicates that follow it."""
    out = []
    for r in rows:
        initial = r["role"][:1]
        if r["fault"] in ("blank", "duplicate"):
            out.append(Item(initial, r["fault"], r["copies"]))
            continue
        out.append(Item(initial, r["fault"]))
        if r["copies"] > 1:
            out.append(Item(initial, "duplicate", r["copies"] - 1))
    return out


def cheapest(items: list[Item], start: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """End state -> (cost, audit) of the cheapest edits of all items from a
    state; if whole, only the first accepting end that is popped."""
    heap = [(0, "", 0, start)]
    done, ends = set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(items):
            if not whole:
                ends[state] = (cost, audit)
                if len(ends) == len(GRAMMAR):
                    break
            elif state in ACCEPTING:
                return {state: (cost, audit)}
        for role in "ua":
            if role in GRAMMAR[state]:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, GRAMMAR[state][role]))
        if i == len(items):
            continue
        item = items[i]
        heapq.heappush(heap, (cost + DELETE * item.count, audit + "D" * item.count, i + 1, state))
        if item.fault in ("blank", "duplicate"):
            continue
        stays = cost + (TRUNCATED if item.fault == "truncated" else 0)
        if item.initial in GRAMMAR[state]:
            heapq.heappush(heap, (stays, audit + "K", i + 1, GRAMMAR[state][item.initial]))
        for role in "ua":
            if role in GRAMMAR[state]:
                heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, GRAMMAR[state][role]))
    return ends


Table = dict[tuple[int, int], tuple[int, str]]


def chained(tables: list[Table]) -> Table:
    """Product of block tables {(state before, after): (cost, audit)}, pair by
    pair. Two audits of one cost between the same states never start one with
    the other, so the least parts make the least whole."""
    while len(tables) > 1:
        joined = []
        for k in range(0, len(tables) - 1, 2):
            out: Table = {}
            for (a, m), (c1, s1) in tables[k].items():
                for (n, b), (c2, s2) in tables[k + 1].items():
                    if m == n and ((a, b) not in out or c1 + c2 <= out[a, b][0]):
                        way = (c1 + c2, s1 + s2)
                        out[a, b] = min(out.get((a, b), way), way)
            joined.append(out)
        tables = joined + tables[len(tables) - len(tables) % 2 :]
    return tables[0]


def n_turns(audit: str) -> int:
    """Turns of the repaired conversation."""
    return len(audit) - audit.count("D")


def role_at(position: int, total: int) -> str:
    """Role that the grammar gives to a turn: an odd number of turns starts with
    the system's."""
    if total % 2:
        return "s" if position == 0 else "ua"[(position - 1) % 2]
    return "ua"[position % 2]


def apply_edits(rows: Iterable[dict], audit: str, position: int, total: int) -> list[dict]:
    """Repaired turns (edit, role, text) of rows under their part of the audit,
    the first being turn `position` of `total`."""
    out, at = [], 0

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            out.append({"edit": "insert", "role": _ROLES[role_at(position + len(out), total)], "text": ""})
            at += 1

    for r in rows:
        for _ in range(r["copies"]):
            inserted()
            letter = audit[at]
            at += 1
            if letter == "K":
                out.append({"edit": "keep", "role": r["role"], "text": r["text"]})
            elif letter == "R":
                out.append({"edit": "rerole", "role": _ROLES[role_at(position + len(out), total)], "text": r["text"]})
    inserted()
    return out


def cut_audit(audit: str, sizes: list[int]) -> list[str]:
    """Parts of an audit for blocks of so many rows each; what is inserted after
    a block's last row belongs to the next block, at the end to the last."""
    parts, at = [], 0
    for k, size in enumerate(sizes):
        start, left = at, size
        while left:
            left -= audit[at] != "I"
            at += 1
        if k == len(sizes) - 1:
            at = len(audit)
        parts.append(audit[start:at])
    return parts


@dataclass
class _Block:
    conv: str
    conv_id: object
    rows: list[dict] = field(default_factory=list)
    chars: int = 0


_COUNTS = "blank long, duplicate long, truncated long, illegal long, min_turn long, max_turn long, turns long"
_EDITS = "array<struct<source: int, target: int, cost: long, audit: string>>"
_TURNS = "array<struct<edit: string, role: string, text: string>>"


def _summary(rows: list[dict]) -> dict:
    """Counts of a block: faults, illegal neighbours, distinct turns."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for item in items_of(rows):
        if item.fault:
            out[item.fault] += item.count
    before = None
    for r in rows:
        initial = r["role"][:1]
        if before is not None and before + initial not in _LEGAL:
            out["illegal"] += 1
        out["illegal"] += r["copies"] - 1
        before = initial
    known = [r["turn"] for r in rows if r["turn"] is not None]
    return out | {"min_turn": min(known, default=None), "max_turn": max(known, default=None), "turns": len(set(known))}


def _blocks(batches: Iterable[pa.RecordBatch], schema: pa.Schema, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted rows. A conversation with others before and
    after it in the task is complete; the first and the last may go on in
    neighbouring tasks."""
    part, number, out, held = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()
        held = 0

    def close(b: _Block, alone: bool) -> None:
        nonlocal number, held
        items = items_of(b.rows)
        row = {"block": (part << 32) + number, "conv": b.conv, "conv_id": b.conv_id, "whole": alone, "size": sum(r["copies"] for r in b.rows)}
        row |= {"first": b.rows[0]["role"][:1], "last": b.rows[-1]["role"][:1]} | {k: b.rows[0][k] for k in ("known", "turn", "tie")} | _summary(b.rows)
        if alone:
            ((target, (cost, audit)),) = cheapest(items).items()
            row |= {"edits": [{"source": 0, "target": target, "cost": cost, "audit": audit}], "rows": [], "repaired": apply_edits(b.rows, audit, 0, n_turns(audit))}
        else:
            edits = [{"source": s, "target": t, "cost": c, "audit": a} for s in range(len(GRAMMAR)) for t, (c, a) in cheapest(items, s, whole=False).items()]
            row |= {"edits": edits, "rows": [{k: r[k] for k in ("role", "text", "fault", "copies")} for r in b.rows], "repaired": []}
        out.append(row)
        number, held = number + 1, held + b.chars

    block, first_conv, first_block = None, True, True
    for batch in batches:
        for r in batch.to_pylist():
            if block is not None and block.conv != r["conv"]:
                close(block, first_block and not first_conv)
                block, first_conv, first_block = None, False, True
            elif block is not None and (len(block.rows) >= block_rows or block.chars >= BLOCK_CHARS):
                close(block, False)
                block, first_block = None, False
            block = block or _Block(r["conv"], r["conv_id"])
            block.rows.append(r)
            block.chars += len(r["text"])
            if held >= BLOCK_CHARS:
                yield from flush()
    if block is not None:
        close(block, False)
    yield from flush()


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of conversations.

    report: conv_id, gaps (turn numbers missing between the least and the
    largest), blank, duplicate, truncated, illegal, cost, audit. Rows count in
    the order of turn (nulls first, ties by a hash of role and text). A row's
    first fault counts: blank (no character but ASCII white space), duplicate
    (role and text seen earlier in the conversation, told by two 64-bit hashes),
    truncated (the last such character is not . ! ?). illegal counts neighbours
    whose roles do not start with su, ua or au.

    repaired: conv_id, conv, block, whole, repaired: the turns (edit, role, text)
    of each block in order; whole is true where one block is the conversation.

    Blank and duplicate rows are always deleted. A null role or text is one
    space; a row of an empty role can only be given another role or be deleted.
    Null ids are one conversation; repeated rows are duplicates, counted by
    copies_col too; block_rows changes no result; texts of any length stay whole; extra columns are ignored;
    empty turns give no rows."""
    spark = turns.sparkSession
    bound_arrow(spark)
    id_type = turns.schema[conv_col].dataType.simpleString()
    conv = F.coalesce(F.concat(F.lit("s"), F.col(conv_col).cast("string")), F.lit("t"))
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit(" ")), F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    base = turns.select(conv.alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col(copies_col).cast("long") if copies_col else F.lit(1).cast("long")).alias("copies"))
    same = ["conv", "conv_id", "turn", "role", "text"]
    kept = base.groupBy(*same).agg(F.sum("copies").alias("copies"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(_SPACES)), -1, 1)
    rows = materialize(
        kept.select("*", F.col("turn").isNotNull().alias("known"), F.xxhash64("role", "text").alias("tie"), F.xxhash64("text", "role").alias("tie2"), last.alias("last")),
        "turn-rows",
    )
    # Texts of a conversation at more than one turn: few, so Spark can see that
    # they are small and broadcast them; it shuffles them where they are not.
    place = F.struct("known", "turn")
    again = rows.groupBy("conv", "tie", "tie2").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first != final").select("conv", "tie", "tie2", "first")
    again = materialize(again, "turn-repeats")
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNotNull() & (place != F.col("first")), "duplicate")
    fault = fault.when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    told = rows.join(again, ["conv", "tie", "tie2"], "left").select(*same, "copies", "known", "tie", fault.alias("fault"))
    order = ["conv", "known", "turn", "tie"]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    kind = f"block long, conv string, conv_id {id_type}, whole boolean, size long, first string, last string, known boolean, turn long, tie long, {_COUNTS}, edits {_EDITS}, rows array<struct<role: string, text: string, fault: string, copies: long>>, repaired {_TURNS}"
    schema = _arrow_schema(spark, kind)
    blocks = materialize(dealt.mapInArrow(trimmed(lambda batches: _blocks(batches, schema, block_rows)), kind), "turn-blocks")

    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0))
    edit = F.col("edits")[0]
    alone = blocks.where("whole")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    simple = alone.select("conv_id", "conv", gaps.alias("gaps"), *counts, edit["cost"].alias("cost"), edit["audit"].alias("audit"))
    cols = ["known", "turn", "tie", "block", "size", "first", "last", "min_turn", "max_turn", "turns", *counts, "edits"]
    lists = blocks.where("not whole").groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct(*cols))).alias("blocks"))
    report_kind = f"conv string, conv_id {id_type}, gaps long, {', '.join(c + ' long' for c in counts)}, cost long, audit string, parts array<struct<block: long, seq: int, part: string, position: long, total: long>>"
    report_schema = _arrow_schema(spark, report_kind)
    long = materialize(lists.mapInArrow(trimmed(lambda batches: _chain(batches, report_schema)), report_kind), "turn-chains")
    report = simple.unionByName(long.drop("parts"))

    parts = long.select(F.explode("parts").alias("p")).select("p.*")
    repaired_kind = f"conv_id {id_type}, conv string, block int, whole boolean, repaired {_TURNS}"
    repaired_schema = _arrow_schema(spark, repaired_kind)
    others = blocks.where("not whole").select("block", "conv", "conv_id", "rows").join(parts, "block")
    others = others.mapInArrow(trimmed(lambda batches: _replay(batches, repaired_schema)), repaired_kind)
    repaired = alone.select("conv_id", "conv", F.lit(0).alias("block"), "whole", "repaired").unionByName(others)
    return report, repaired


def _arrow_schema(spark: SparkSession, kind: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def _chain(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Report and each block's part of the audit, from a conversation's blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            blocks = row["blocks"]
            table = chained([{(e["source"], e["target"]): (e["cost"], e["audit"]) for e in b["edits"]} for b in blocks])
            cost, audit = min(way for (s, t), way in table.items() if s == 0 and t in ACCEPTING)
            out = {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")}
            out["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
            known = [b for b in blocks if b["max_turn"] is not None]
            turns = sum(b["turns"] for b in known) - sum(a["max_turn"] == b["min_turn"] for a, b in zip(known, known[1:], strict=False))
            out["gaps"] = known[-1]["max_turn"] - known[0]["min_turn"] + 1 - turns if known else 0
            parts, position, total = [], 0, n_turns(audit)
            for seq, (b, part) in enumerate(zip(blocks, cut_audit(audit, [b["size"] for b in blocks]), strict=True)):
                parts.append({"block": b["block"], "seq": seq, "part": part, "position": position, "total": total})
                position += n_turns(part)
            out |= {"conv": row["conv"], "conv_id": row["conv_id"], "cost": cost, "audit": audit, "parts": parts}
            yield pa.RecordBatch.from_pylist([out], schema)


def _replay(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            done = apply_edits(r["rows"], r["part"], r["position"], r["total"])
            yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "conv": r["conv"], "block": r["seq"], "whole": False, "repaired": done}], schema)


def joined_text(repaired: DataFrame) -> DataFrame:
    """(conv, text): `role:text` of all repaired turns, joined by newlines. Only
    conversations of several blocks are shuffled, by one row per block; the text
    of one conversation is one value."""
    line: Column = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    own = repaired.select("conv", "block", "whole", F.array_join(line, "\n").alias("body"), F.size("repaired").alias("n"))
    several = own.where("not whole").groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("block", "body")))).alias("bodies"))
    several = several.select("conv", F.array_join(F.transform("bodies", lambda b: b["body"]), "\n").alias("text"))
    return own.where("whole").select("conv", F.col("body").alias("text")).unionByName(several)
