"""Conversation repair against all edits by brute force, against SQL, and with signatures cut short."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from loomwork.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def cheapest(sig):
    """All edits of a signature: the least (cost, edits) that gives s?(ua)+ or nothing."""
    best = None
    for ops in itertools.product("DKR", repeat=len(sig)):
        if any(c == "d" and o != "D" for c, o in zip(sig, ops)):
            continue
        for ins in itertools.product(range(3), repeat=len(sig) + 1):
            edits = "".join("I" * n + o for n, o in zip(ins, (*ops, "")))
            cost = 3 * sum(ins) + sum({"D": 4, "K": 0, "R": 3}[o] + 3 * (c.isupper() and o != "D") for c, o in zip(sig, ops))
            if best and (cost, edits) >= best:
                continue
            given, rows = "", iter(sig)
            for e in edits:
                c = next(rows).lower() if e != "I" else ""
                if e == "K":
                    given += c
                elif e in "IR":
                    given += "a" if given.endswith("u") else "u"
            if re.fullmatch("(s?(ua)+)?", given):
                best = cost, edits
    return best


@pytest.mark.parametrize("n", range(1, 5))
def test_all_edits(n):
    trie = dialogue.Trie()
    sigs = sorted({"".join(random.Random(i).choices("suaxdSUA", k=n)) for i in range(40 if n > 3 else 80)})
    for sig in sigs:
        held = dialogue.joined({dialogue.NOTHING: (0, 0, None)}, [dict(zip(("begin", "end", "cost", "edits"), x)) for x in trie.answers(sig, (0,))])
        assert dialogue.finished(held) == cheapest(sig), sig


def test_layers_are_shared():
    trie = dialogue.Trie()
    for sig in ("uauaua", "uauauad", "uauauu"):
        trie.answers(sig, (0,))
    assert trie.layers == 6 + 1 + 1


def test_parts_give_the_whole():
    rnd = random.Random(5)
    for _ in range(100):
        sig = "".join(rnd.choices("suaxdSUA", weights=[1, 6, 6, 1, 2, 1, 1, 1], k=30))
        answers = lambda s, b: [dict(zip(("begin", "end", "cost", "edits"), x)) for x in dialogue.Trie().answers(s, b)]
        whole = dialogue.finished(dialogue.joined({0: (0, 0, None)}, answers(sig, (0,))))
        held = {0: (0, 0, None)}
        for i in range(0, 30, 7):
            held = dialogue.joined(held, answers(sig[i:i + 7], (0, 1, 2, 3)))
        assert dialogue.finished(held) == whole


def made(spark, n=60, long=90):
    rnd, rows = random.Random(3), []
    for conv in range(n):
        for turn in range(long if conv == 7 else rnd.randint(1, 9)):
            text = rnd.choice(["Yes.", "No", "", " \t", "So it is!", "A long answer. ", None, "Cut off here", "é\n?"])
            role = rnd.choice(["user", "assistant", "system", "", None, "tool"]) if rnd.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv if conv else None, None if rnd.random() < 0.05 else turn + rnd.randint(0, 1), role, text))
    return spark.createDataFrame(rows + rows[:9], SCHEMA)


@pytest.mark.parametrize("most", [3, 4096])
def test_against_sql(spark, most):
    rows = made(spark)
    got = dialogue.repaired(rows, most)
    con = duckdb.connect()
    con.register("conversations", rows.toArrow())
    want = con.sql(dialogue.ORACLE).select("conv_id", *COLUMNS).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.select("conv_id", *COLUMNS).collect()), key=key) == sorted(want, key=key)


def test_odd_tables(spark):
    none = dialogue.repaired(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["conv_id", *COLUMNS] and none.count() == 0
    # 0:9 is dropped by the hash, so its conversation has no rows left
    gone = [(c, t) for c in range(400) for t in range(3) if __import__("zlib").crc32(f"{c}:{t}".encode()) % 20 == 0][0]
    row = dialogue.repaired(spark.createDataFrame([(*gone, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    extra = spark.createDataFrame([(1, 2, "user", "Hi.", 5, 6, "x")], SCHEMA + ", kind int, sig long, answers string")
    assert dialogue.repaired(extra).count() == 1


def test_copies_and_long_texts(spark):
    rows = spark.createDataFrame([(1, 1, "user", "word " * 200_000 + ".")] * 50 + [(1, 2, "assistant", "Ok.")] * 2, SCHEMA)
    row = dialogue.repaired(rows, 8).first()
    assert row["duplicate"] >= 49 and row["cost"] >= 4 * 49
