"""Repair of conversations against an exhaustive search, and its damage against plain Python."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from packfold.llm import queries, repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Cost and edits from the last row backwards: the cheapest, then the least string."""

    @cache
    def best(i, last):
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if i < len(rows):
            initial, fault = rows[i]
            more = 5 if fault == "truncated" else 0
            ways.append((best(i + 1, last)[0] + 2, "D" + best(i + 1, last)[1]))
            if fault not in ("blank", "duplicate"):
                if initial in tuple(NEXT[last]):
                    cost, edits = best(i + 1, initial)
                    ways.append((cost + more, "K" + edits))
                role = NEXT[last][-1]
                cost, edits = best(i + 1, role)
                ways.append((cost + 1 + more, "R" + edits))
        if (i, last) not in busy:
            busy.add((i, last))
            # an insertion never leads back to where it began at less cost
            cost, edits = inserted(i, last, 0)
            ways.append((cost, edits))
            busy.discard((i, last))
        return min(ways) if ways else (10**9, "")

    def inserted(i, last, depth):
        role = NEXT[last][-1]
        ways = [(10**9, "")]
        initial, fault = rows[i] if i < len(rows) else (None, None)
        if i == len(rows):
            if role == "a":
                ways.append((5, "I"))
        else:
            more = 5 if fault == "truncated" else 0
            ways.append((best(i + 1, role)[0] + 7, "ID" + best(i + 1, role)[1]))
            if fault not in ("blank", "duplicate"):
                if initial in tuple(NEXT[role]):
                    ways.append((best(i + 1, initial)[0] + 5 + more, "IK" + best(i + 1, initial)[1]))
                after = NEXT[role][-1]
                ways.append((best(i + 1, after)[0] + 6 + more, "IR" + best(i + 1, after)[1]))
        if depth < 3:
            cost, edits = inserted(i, role, depth + 1)
            ways.append((cost + 5, "I" + edits))
        return min(ways)

    busy = set()
    return best(0, "")


def expected(rows):
    """Result of (turn, role, text) rows in order."""
    seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role[:1], fault))
        if fault:
            count[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit = cheapest(tuple(marked))
    out, last, left = [], "", list(rows)
    for edit in audit:
        _, role, text = left.pop(0) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        role = role if edit == "K" else {"u": "user", "a": "assistant"}[NEXT[last][-1]]
        last = role[:1]
        out.append(f"{role}:{text}")
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)


def damaged(rows):
    """(conv, turn, role, text) rows after damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def random_rows(seed, n, longest):
    rnd = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "aide"]
    texts = ["Yes.", "No!", "Why?", "cut", "", None, " \t", "Ünd.\n ", "half a", "x. y"]
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(0, longest)):
            shown = None if rnd.random() < 0.05 else turn if rnd.random() < 0.9 else turn + 3
            text = rnd.choice(texts) if rnd.random() < 0.5 else f"Line {conv} {turn}" + rnd.choice(["", ".", "?"])
            role = ["user", "assistant"][turn % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            rows.append((conv if conv else None, shown, role, text))
    return rows


def test_search_equals_exhaustive_search():
    rnd = random.Random(5)
    for _ in range(4000):
        rows = []
        for i in range(rnd.randint(0, 9)):
            rows.append((i, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b", "", f"{i}.", f"{i}.", f"{i}"])))
        seen, faulty = set(), []
        for turn, role, text in rows:
            fault = 1 if not text else 2 if (role, text) in seen else 3 if text[-1] != "." else 0
            seen.add((role, text))
            faulty.append((7, turn, role, text, fault))
        found = list(repair.conversations([*faulty, (8, None, "", "", None)]))
        if rows:
            assert found[0][1:] == expected(rows), rows
        assert found[-1] == (8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


@pytest.fixture(scope="module")
def rows():
    return random_rows(3, 150, 12)


def test_query_equals_brute_force(spark, rows, tmp_path):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumns({"audit": F.lit(1), "_text": F.lit("x"), "gaps": F.lit("y")}).repartition(5)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    want = {conv: expected(kept) for conv, kept in damaged(rows).items()}
    assert got == want and any(r[7] == hashlib.sha256().hexdigest() for r in want.values())


def test_repaired_turns_give_the_digest(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    audits = {r.conv_id: r for r in repair.audits(table).collect()}
    turns = {}
    for r in repair.repaired(table).orderBy("conv_id", "place").collect():
        assert r.place == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append(r)
    for conv, audit in audits.items():
        made = turns.get(conv, [])
        assert "".join(r.edit for r in made) == audit.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made).encode()).hexdigest() == audit.repaired_sha256


def test_unresolved_strings_stay_short():
    """Edits are put out as soon as survivors meet, and ways that cannot win are given up."""
    search, most = repair.Search(), 0
    for i in range(20_000):
        search.row(("user", "assistant")[i % 2] if i % 7 else "user", f"{i}.", 3 if i % 11 == 0 else 0)
        most = max(most, search.unresolved())
    assert most < 100 and len(search.audit) > 19_000
    # two ways that never meet are two nodes, whatever their length
    search = repair.Search()
    for i in range(20_000):
        search.row("tool", "x.", 0)
    nodes, open_nodes = 0, [search.root]
    while open_nodes:
        node = open_nodes.pop()
        nodes, open_nodes = nodes + 1, open_nodes + node.children
    assert nodes < 10 and search.end()[0] == 20_000


def test_empty_table_and_long_texts(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair.audits(spark.createDataFrame([], schema)).count() == 0
    assert repair.repaired(spark.createDataFrame([], schema)).count() == 0
    long = "word. " * 200_000
    one = repair.audits(spark.createDataFrame([("c", 0, "user", long), ("c", 1, "assistant", long)], schema)).first()
    assert one.audit == "KK" and one.cost == 0
    assert one.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
