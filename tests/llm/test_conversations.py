"""Repair of conversations against a plain search over all edits, and damage against its rule."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from govgraph.llm import conversations
from govgraph.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, codes string, _row int, cost double"
PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """``(cost, audit, lines)`` of ``(role, text, fault)`` rows, by trying every edit in every state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if (state, role[0]) in step:
                    cost, audit, lines = best(i, role[0], inserts + 1)
                    found.append((cost + 5, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (state, name[:1]) in step:
                        cost, audit, lines = best(i + 1, name[0], 0)
                        found.append((cost + price + extra, letter + audit, (f"{name}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


def plain(table):
    """The contract, conversation by conversation."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in rows:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, lines = cheapest(tuple(judged))
        assert not rows or PATTERN.fullmatch("".join(line[0] for line in lines))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(f == fault for _, _, f in judged) for fault in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(judged)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, table):
    frame = spark.createDataFrame([(*r, "x", 1, 0.5) for r in table], SCHEMA)
    return sorted((tuple(r) for r in conversations.audited(frame).collect()), key=repr)


def test_tables_equal_the_plain_search():
    tables = conversations.Tables()
    rng = random.Random(3)
    roles = ("system", "user", "assistant", "tool")
    faults = ("", "truncated", "blank", "duplicate")
    short = [codes for n in range(4) for codes in itertools.product(range(16), repeat=n)]
    for codes in short + [tuple(rng.choices(range(16), k=rng.randrange(4, 30))) for _ in range(600)]:
        rows = tuple((roles[c % 4], "t", faults[c // 4]) for c in codes)
        cost, audit, _ = cheapest(rows)
        got, script = tables.solve(bytes(codes))
        assert (got, script.translate(str.maketrans("UAua", "RRII"))) == (cost, audit), codes
    assert len(tables.vectors) < 200


def test_blocks_of_every_length_agree():
    rng = random.Random(9)
    one, three = conversations.Tables(1), conversations.Tables(3)
    for _ in range(200):
        codes = bytes(rng.choices(range(16), k=rng.randrange(0, 90)))
        assert one.solve(codes) == three.solve(codes) == conversations.Tables.solve(conversations._tables(), codes)


def odd_table():
    rng = random.Random(6)
    texts = ["Fine.", "Cut off", " \t", "", "Ask? ", "Wow!\n", "a.b", None, "é漢.", "x" * 50 + "."]
    roles = ["system", "user", "assistant", "tool", "", "User", None, "unknown"]
    table = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            regular = ["user", "assistant"][turn % 2]
            role = regular if rng.random() < 0.7 else rng.choice(roles)
            text = f"Text {conv} {turn}." if rng.random() < 0.5 else rng.choice(texts)
            table.append((conv, turn + (turn > 5) * rng.randrange(3), role, text))
    table += [(500, None, "user", "No turn."), (500, None, "assistant", "None."), (500, 3, "user", "Three.")]
    table += [(None, 1, "user", "Null."), (None, None, "assistant", "Null."), (None, 2, None, None)]
    table += [(501, 4, "user", "Same."), (501, 4, "user", "Same."), (501, 4, "assistant", "Other.")]
    table += [(502, 10**12, "user", "Far."), (502, -5, "system", "Low.")]
    table += [(2**60 + 1, t, "user", "Large id.") for t in range(3)]
    return table


def test_equals_the_plain_version(spark, monkeypatch):
    table = odd_table()
    expected = plain(table)
    assert run(spark, table) == expected
    monkeypatch.setattr(conversations, "CHUNK_BITS", 1)
    assert run(spark, table) == expected


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", 4)
    turns = [(1, t, ["user", "assistant"][t % 2 if t % 7 else 0], f"Row {t % 90}." if t % 5 else "cut") for t in range(300)]
    again = [(3, 7, "user", "Again and again.")] * 2_000
    long_text = [(2, t, "user" if t != 2 else "assistant", "long " * 200_000 + f"{t}.") for t in range(4)]
    got = {r[0]: r for r in run(spark, turns + again + long_text)}
    assert got[1] == plain(turns)[0]
    assert got[2] == plain(long_text)[0]
    assert got[3][7] == "D" * len(got[3][7]) and got[3][6] == 2 * len(got[3][7]) and got[3][3] == len(got[3][7]) - 1


@pytest.mark.parametrize("rows", [[], [(7, next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0), "user", "Gone.")]])
def test_nothing_left(spark, rows):
    assert run(spark, rows) == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())][: len(rows)]


def test_whole_table_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    result = con.execute(ORACLES["op12_repair_conversations"])
    names = [d[0] for d in result.description]
    expected = sorted(result.fetchall())
    got = QUERIES["op12_repair_conversations"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == expected
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got)) == sorted(plain(table))
