"""Repair of conversations against its SQL and against all edits tried out."""

import hashlib
import random
import zlib

import pytest

from sievework.llm import conversation_repair as cr
from tests.conftest import SMALL, same

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, copies int, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 7) for r in rows], SCHEMA)


def plain_damaged(rows):
    out = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if fault == 2 else text
        out += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain(rows, ids):
    """Cheapest edits with the ASCII-least initials, from all prefixes kept by state."""
    out = {}
    for c in ids:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, marked = set(), []
        for _, t, role, text in own:
            end = text.rstrip(BLANKS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((t, role, text, fault))
        best = {"": (0, "", [])}  # by the initials kept so far, folded to the state
        legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        other = {"": "user", "s": "user", "u": "assistant", "a": "user"}

        def put(into, state, value):
            if state not in into or value < into[state]:
                into[state] = value

        def inserted(best):
            for _ in range(3):
                for state, (cost, audit, turns) in list(best.items()):
                    put(best, other[state][0], (cost + 5, audit + "I", [*turns, f"{other[state]}:"]))
            return best

        for _, role, text, fault in marked:
            after = {}
            for state, (cost, audit, turns) in inserted(best).items():
                put(after, state, (cost + 2, audit + "D", turns))
                if fault in ("", "truncated"):
                    more = 5 * (fault == "truncated")
                    if (state, role[:1]) in legal:
                        put(after, legal[state, role[:1]], (cost + more, audit + "K", [*turns, f"{role}:{text}"]))
                    put(after, other[state][0], (cost + more + 1, audit + "R", [*turns, f"{other[state]}:{text}"]))
            best = after
        cost, audit, turns = min(v for k, v in inserted(best).items() if k in ("", "a"))
        numbers = [t for t, *_ in marked if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or not b[1] or not a[1] for a, b in zip(marked, marked[1:], strict=False))
        count = lambda f: sum(m[3] == f for m in marked)
        out[c] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def given(df):
    return {r["conv_id"]: (*[r[c] for c in cr.COUNTS], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def random_rows(seed, ids, most):
    rng = random.Random(seed)
    texts = ["", " \t", "Yes.", "No", "What?", "So\n", "é!", "a. b", "Stop. ", "x" * 50]
    rows = []
    for c in ids:
        for t in range(rng.randrange(most)):
            turn = None if rng.random() < 0.05 else t + rng.randrange(2)
            text = rng.choice(texts) + rng.choice(["", "", str(rng.randrange(9)) + "."])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), None if rng.random() < 0.05 else text))
    return rows


def test_against_sql(spark, duck):
    assert same(cr.query(spark, SMALL), duck.execute(cr.ORACLE))


@pytest.mark.parametrize("block", [1000, 4, 1])
def test_random_conversations(spark, block):
    """Blocks of any size, the small ones through matrices and walks of runs."""
    rows = random_rows(block, [*range(60), None, -7], 14) + random_rows(3, [99], 120)
    rows += rows[:20]
    docs = table(spark, rows).repartition(3)
    got = given(cr.digests(cr.repair(cr.damaged(docs), "copies", block)))
    assert got == plain(plain_damaged(rows), {r[0] for r in rows})
    undamaged = given(cr.digests(cr.repair(docs, None, block)))
    assert undamaged == plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})


def test_awkward(spark):
    assert cr.digests(cr.repair(table(spark, []))).count() == 0
    gone = [(1, t, "user", "x.") for t in range(2000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0]
    assert given(cr.digests(cr.repair(cr.damaged(table(spark, gone)), "copies", 5))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long_ = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "word " * 60_000 + ".") for t in range(20)]
    assert given(cr.digests(cr.repair(table(spark, long_))))[1][6] == "K" * 20
    alike = [(1, 1, "user", "same.")] * 3000
    assert given(cr.digests(cr.repair(table(spark, alike).repartition(4), None, 100)))[1][5:7] == (6000, "D" * 3000)


def test_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "assistant", "That.")]
    alone, long_ = cr.repair(table(spark, rows))
    assert [(r["role"], r["text"]) for r in cr.turns(alone.unionByName(long_)).orderBy("part", "block", "place").collect()] == [("user", "What?"), ("assistant", "That.")]
