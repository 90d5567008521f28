"""Conversation repair against plain loops, and the search against all edits of short conversations."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlens.llm import conversation_repair as cr

sys.setrecursionlimit(50_000)
LEGAL = re.compile("(s?(ua)+)?")
WHITE = re.compile("[^ \t-\r]")


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        body = WHITE.findall(text)
        if not body:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif body[-1] not in ".!?":
            found.append("truncated")
        else:
            found.append("")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """(cost, audit, rows after) by a recursion from the end; states are the roles' initials that may come next."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for nxt in follow[state]:
                if nxt in names:
                    cost, audit, after = best(i, nxt, inserted + 1)
                    options.append((cost + 5, "I" + audit, ((names[nxt], ""), *after)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, after = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, after))
            if found[i] not in ("blank", "duplicate"):
                cut = 5 if found[i] == "truncated" else 0
                for nxt in follow[state]:
                    cost, audit, after = best(i + 1, nxt, 0)
                    if role[:1] == nxt:
                        options.append((cost + cut, "K" + audit, ((role, text), *after)))
                    if nxt in names:
                        options.append((cost + cut + 1, "R" + audit, ((names[nxt], text), *after)))
        return min(options) if options else (10**9, "", ())

    return best(0, "", 0)


def brute(rows):
    """conv -> summary of (turn, role, text) rows in order."""
    texts = [(role, text) for _, role, text in rows]
    found = faults(texts)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, after = cheapest(texts, found)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for role, _ in texts]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in after).encode()).hexdigest()
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha


def all_edits(rows, found, most=2):
    """The least (cost, audit) of every way to edit, up to ``most`` insertions in a row."""
    best = None

    def go(i, cost, audit, said, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and LEGAL.fullmatch(said) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < most:
            for role in "ua":
                go(i, cost + 5, audit + "I", said + role, inserted + 1)
        if i < len(rows):
            go(i + 1, cost + 2, audit + "D", said, 0)
            if found[i] not in ("blank", "duplicate"):
                cut = 5 if found[i] == "truncated" else 0
                go(i + 1, cost + cut, audit + "K", said + (rows[i][0][:1] or " "), 0)
                for role in "ua":
                    go(i + 1, cost + cut + 1, audit + "R", said + role, 0)

    go(0, 0, "", "", 0)
    return best


POOL = ["Fine.", "Fine.", "cut off", "", " \t", "Why?", "Yes! ", "no\n", "ä。", "other.", "more.", "less."]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "uncle"]


def conversation(rng, n):
    return [(rng.choice(ROLES), rng.choice(POOL) if rng.random() < 0.6 else f"{rng.random()}.") for _ in range(n)]


def test_brute_force_is_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = conversation(rng, rng.randint(0, 4))
        found = faults(rows)
        assert cheapest(rows, found)[:2] == all_edits(rows, found)


def coded(rows):
    codes = []
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        code = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
        codes.append(code | {"": 0, "truncated": 4, "blank": 8, "duplicate": 16}[fault])
    return bytes(codes)


def test_lanes_equal_brute_force():
    rng = random.Random(2)
    talks = [conversation(rng, n) for n in [0, 1, 2, 3, 40, 7, 0, 25] * 10]
    codes = [coded(t) for t in talks]
    costs, base, code = cr.backward(codes, np.tile(cr._END, (len(codes), 1)))
    states, spent, lane, letter, _, _ = cr.trace(
        codes, costs, base, code, np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    )
    for n, talk in enumerate(talks):
        cost, audit, _ = cheapest(talk, faults(talk))
        assert (spent[n], costs[base[n], 0]) == (cost, cost)
        assert bytes(letter[lane == n].tolist()).decode() == audit
        assert states[n] in (0, 3)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv string, turn long, role string, text string")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def summaries(repaired):
    return {r[0]: tuple(r)[1:] for r in repaired.conversations().collect()}


@pytest.mark.parametrize("chunk, fix_ups", [(cr.CHUNK, cr.FIX_UPS), (3, cr.FIX_UPS), (2, 0)])
def test_conversations_equal_brute_force(spark, chunk, fix_ups):
    rng = random.Random(3)
    talks = {str(n): conversation(rng, rng.choice([1, 2, 5, 9])) for n in range(40)}
    talks["long"] = conversation(rng, 250)
    talks["blank"] = [("user", "")] * 30
    talks["cut"] = [("user" if n % 2 else "assistant", f"{n} and") for n in range(31)]
    talks["same"] = [("user", "Again.")] * 40
    rows = []
    for conv, talk in talks.items():
        rows += [(conv, rng.choice([n, n, n + 3, None]), role, text) for n, (role, text) in enumerate(talk)]
    rng.shuffle(rows)
    expected = {
        conv: brute(ordered([r[1:] for r in rows if r[0] == conv])) for conv in talks
    }
    done = cr.repair(table(spark, rows).withColumn("codes", F.lit("x")).repartition(3), chunk, fix_ups)
    assert summaries(done) == expected


def test_speculation_and_composition_agree(spark):
    rng = random.Random(4)
    rows = [(str(c), n, role, text) for c in range(3) for n, (role, text) in enumerate(conversation(rng, 400))]
    for conv in range(3):
        rows += [(str(conv), 400 + n, "user", f"{n} and") for n in range(100)]  # differences of costs stay here
    turns = table(spark, rows)
    cut = [summaries(cr.repair(turns, 16, n)) for n in (0, 1, 50)]
    assert cut[0] == cut[1] == cut[2] == summaries(cr.repair(turns))
    assert cut[0]["1"] == brute([r[1:] for r in rows if r[0] == "1"])


def test_turns_are_the_repaired_rows(spark):
    rows = [("c", 0, "system", "Be kind."), ("c", 1, "assistant", "Hello."), ("c", 2, "assistant", "Hi."), ("c", 3, "user", " ")]
    done = cr.repair(table(spark, rows))
    got = [tuple(r)[3:] for r in done.turns().orderBy("conv", "chunk_no", "place").collect()]
    assert got == [("system", "Be kind.", "K"), ("user", "Hello.", "R"), ("assistant", "Hi.", "K")]
    assert summaries(done)["c"][5:7] == (3, "KRKD")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected_digest(rows):
    kept = damage(rows)
    return {c: brute(ordered([r[1:] for r in kept if r[0] == c])) for c in {r[0] for r in rows}}


def digest(spark, rows):
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "copy", "kind", "part", "codes", "entry", "name"):
        conversations = conversations.withColumn(name, F.lit(name))
    done = cr.digest(conversations, cr.repair(cr.damaged(conversations)))
    return {r[0]: tuple(r)[1:] for r in done.collect()}


def test_digest_with_nulls_ties_and_lost_conversations(spark):
    rng = random.Random(6)
    rows = [
        (rng.choice([None, 1, 2, 3]), rng.choice([None, *range(12)]), rng.choice([None, *ROLES]), rng.choice([None, *POOL]))
        for _ in range(150)
    ]
    lost = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    rows += [(7, n, "user", "long " * 5000 + ("." if n % 3 else "")) for n in range(5)]
    got = digest(spark, rows)
    assert got == expected_digest(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert digest(spark, []) == {}


def test_sample_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digest(spark, rows) == expected_digest(rows)
