"""Conversation repair against exhaustive search and a plain version."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from ledgerline.llm import turn_repair
from ledgerline.llm.queries import op12_turn_repair
from ledgerline.llm.turn_repair import Item, chained, cheapest, cut_audit, joined_text, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block int, size string"
SHAPE = re.compile(r"(s?(ua)+)?$")


def every_edit(items: list[Item]) -> tuple[int, str]:
    """Least (cost, audit) of all edits that leave a legal conversation, none of
    them dearer than deleting everything."""
    bound, best = 3 * len(items), [(3 * len(items), "D" * len(items))]

    def go(i, cost, audit, roles):
        if cost > bound:
            return
        if i == len(items) and SHAPE.match(roles):
            best.append((cost, audit))
        for r in "ua":
            go(i, cost + 2, audit + "I", roles + r)
        if i == len(items):
            return
        item = items[i]
        go(i + 1, cost + 3, audit + "D", roles)
        if item.fault in ("blank", "duplicate"):
            return
        more = cost + (item.fault == "truncated")
        go(i + 1, more, audit + "K", roles + item.initial)
        for r in "ua":
            go(i + 1, more + 2, audit + "R", roles + r)

    go(0, 0, "", "")
    return min(best)


def plain_repair(items: list[Item]) -> tuple[int, str]:
    """The same by relaxation over all (row, state) until nothing changes."""
    best = {(0, 0): (0, "")}
    for i in range(len(items) + 1):
        while True:
            before = dict(best)
            for s in range(4):
                if (i, s) in before:
                    cost, audit = before[i, s]
                    for r, t in turn_repair.GRAMMAR[s].items():
                        if r != "s":
                            best[i, t] = min(best.get((i, t), (1 << 60, "")), (cost + 2, audit + "I"))
            if best == before:
                break
        if i == len(items):
            break
        item = items[i]
        for s in range(4):
            if (i, s) not in best:
                continue
            cost, audit = best[i, s]
            ways = [(cost + 3, audit + "D", s)]
            if item.fault in ("", "truncated"):
                c = cost + (item.fault == "truncated")
                ways += [(c, audit + "K", t) for r, t in turn_repair.GRAMMAR[s].items() if r == item.initial]
                ways += [(c + 2, audit + "R", t) for r, t in turn_repair.GRAMMAR[s].items() if r != "s"]
            for c, a, t in ways:
                best[i + 1, t] = min(best.get((i + 1, t), (1 << 60, "")), (c, a))
    return min(best[len(items), s] for s in (0, 3) if (len(items), s) in best)


KINDS = [Item(i, f) for i in "suax" for f in ("", "truncated")] + [Item("u", "blank"), Item("a", "duplicate")]


def test_every_edit_of_short_conversations():
    for n in range(4):
        for items in itertools.product(KINDS, repeat=n):
            ((_, got),) = cheapest(list(items)).items()
            assert got == every_edit(list(items)), items


def test_blocks_chain_to_the_whole():
    r = random.Random(3)
    for _ in range(300):
        items = [r.choice(KINDS) for _ in range(r.randint(1, 14))]
        whole = plain_repair(items)
        ((_, got),) = cheapest(items).items()
        assert got == whole
        cuts = sorted(r.sample(range(1, len(items)), min(len(items) - 1, r.randint(0, 4)))) if len(items) > 1 else []
        blocks = [items[a:b] for a, b in zip([0, *cuts], [*cuts, len(items)], strict=True)]
        table = chained([{(s, t): way for s in range(4) for t, way in cheapest(b, s, whole=False).items()} for b in blocks])
        assert min(way for (s, t), way in table.items() if s == 0 and t in (0, 3)) == whole
        parts = cut_audit(whole[1], [len(b) for b in blocks])
        assert "".join(parts) == whole[1] and [len(p.replace("I", "")) for p in parts] == [len(b) for b in blocks]


def damage(rows):
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_query(rows):
    """The contract, conversation by conversation; rows of one turn must be equal."""
    hurt, out = list(damage(rows)), set()
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        items, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            items.append(Item(role[:1], fault))
            if fault:
                counts[fault] += 1
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in itertools.pairwise(items))
        known = [r[1] for r in mine if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = plain_repair(items)
        left, state, lines = iter(mine), 0, []
        total = len(audit) - audit.count("D")
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter == "D":
                continue
            if letter == "K":
                initial, line = row[2][:1], f"{row[2]}:{row[3]}"
            else:
                initial = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
                line = f"{'user' if initial == 'u' else 'assistant'}:{row[3] if row else ''}"
            state = turn_repair.GRAMMAR[state][initial]
            lines.append(line)
        assert len(lines) == total and state in (0, 3)
        out.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def written(spark, rows, folder):
    spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def made(seed, n):
    r = random.Random(seed)
    texts = ["Hi there.", "And then", "ok!", "really?", " ", "", None, "A ", "x.\n\t", "Why? ", "é😀."]
    rows = []
    for c in [None, *range(n)]:
        for t in sorted(r.sample(range(20), r.randint(1, 9))):
            rows.append((c, t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice([*texts, f"own {t} {c}."])))
    return rows


def test_query_against_plain_version(spark, tmp_path):
    rows = made(5, 150) + [(500, None, "user", "a."), (500, None, "user", "a."), (500, 7, "assistant", "b."), (501, None, None, None), (502, 1, "user", "z." * 700_000), (502, 2, "assistant", "z." * 700_000)]
    rows += [(600, t, "user" if t % 2 else "assistant", "again." if t % 3 else f"say {t}") for t in range(1500)]  # several blocks
    rows += [(601, 4, "user", "copy.")] * 400
    got = op12_turn_repair(spark, written(spark, rows, tmp_path))
    assert set(map(tuple, got.collect())) == plain_query(rows)
    assert got.count() == len({r[0] for r in rows})


def test_small_blocks_change_nothing(spark):
    rows = spark.createDataFrame([(*r, "x", 1, "y") for r in made(2, 60)], SCHEMA).repartition(3)
    want = None
    for size in (1, 2, 3, 256):
        report, repaired = repair_conversations(rows, block_rows=size)
        got = sorted(map(repr, report.collect())), sorted(map(repr, joined_text(repaired).collect()))
        want = want or got
        assert got == want


def test_empty_and_clashing_columns(spark):
    report, repaired = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and repaired.count() == 0
    report, repaired = repair_conversations(spark.createDataFrame([(1, 1, "user", "q?", "c", 2, "s")], SCHEMA))
    assert report.first().asDict() == {"conv_id": 1, "conv": "s1", "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 2, "audit": "KI"}
    assert [(t["edit"], t["role"], t["text"]) for t in repaired.first()["repaired"]] == [("keep", "user", "q?"), ("insert", "assistant", "")]
