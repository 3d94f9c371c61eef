"""Repair of the structure of conversations: a system turn at most, then user and assistant in turn.

Rows of a conversation are edited at the least cost so that their role initials are `(s?(ua)+)?`: Keep, Rerole (to user
or assistant), Delete (blank rows and repeats must go) and Insert of an empty turn; a truncated row that stays costs
more.  The grammar has four states.  A backward pass gives the cost to go of each row and state, the forward walk takes
the ASCII-least edit among those that are tight, and the turns are rebuilt from the edits.

Rows are dealt by ranges of conversation, turn, role and digest of the text, so a conversation that holds most rows is
spread over many tasks, and each task cuts its rows into blocks of bounded size, which are stored.  A conversation of
one block is repaired where it lies.  Of the others, each task's run of rows becomes a 4 x 4 matrix of least costs
between states; matrices are multiplied (min, plus) from the end, which gives the cost to go behind each run; each run
is walked from all four states at once, and the walks are chained.  Repeats are found by the digest of their text.
What runs carry is a byte and a turn number for each row, and no more than a task's rows meet.

Defined cases: a null role or text is one space; the rows of a null conv_id are one conversation; null turns come first;
rows of equal turn are in the order of role and SHA-256 of the text, so equal rows are repeats of the first; an empty
role has no initial and must be reroled or deleted; a very long text is a block of its own; an empty table gives an
empty result; other columns are ignored.  A conversation of which no row is left has no edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.graph import only
from sievework.llm.store import stored

#: Rows and bytes of text in a block (a longer row is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 1000, 2 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row's symbol is its initial (0 for others than s, u, a) + 4 times its fault.
FINE, CUT_OFF, REPEAT, BLANK = range(4)
#: State behind a row with each initial, -1 where the grammar has none.
AFTER = [[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]]
#: The only state that a made turn can lead to.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60

Costs = tuple[int, int, int, int]


def with_inserts(b: Costs | list[int]) -> Costs:
    """Costs to go where turns may be inserted first; two are never better than none."""
    u, a = min(b[USER], INSERT + b[ASSISTANT]), min(b[ASSISTANT], INSERT + b[USER])
    return min(b[START], INSERT + u), min(b[SYSTEM], INSERT + u), u, a


#: Cost to go behind the last row.
END = with_inserts((0, _FAR, _FAR, 0))


def costs(symbols: list[int], end: Costs) -> list[Costs]:
    """Cost to go of each state before each row, and `end` behind the last one."""
    out = [end] * (len(symbols) + 1)
    nxt = end
    for i in range(len(symbols) - 1, -1, -1):
        initial, fault = symbols[i] & 3, symbols[i] >> 2
        b = [DELETE + c for c in nxt]
        if fault < REPEAT:
            more = TRUNCATED * fault
            for q in range(4):
                k = AFTER[q][initial]
                if k >= 0 and more + nxt[k] < b[q]:
                    b[q] = more + nxt[k]
                if REROLE + more + nxt[NEXT[q]] < b[q]:
                    b[q] = REROLE + more + nxt[NEXT[q]]
        out[i] = nxt = with_inserts(b)
    return out


def matrix(symbols: list[int]) -> list[list[int]]:
    """Least cost from each state before the rows to each state behind them."""
    ends = [costs(symbols, tuple(0 if q == end else _FAR for q in range(4)))[0] for end in range(4)]
    return [[min(ends[end][q], _FAR) for end in range(4)] for q in range(4)]


def walk(symbols: list[int], to_go: list[Costs], state: int, last: bool) -> tuple[str, list[int], list[int]]:
    """(edits, place of each row's first edit and their number, state before each row and behind the last one).  Inserts
    before a row are among its edits; those behind the last one are, too, if it is the conversation's last."""
    edits, at, states = [], [], []
    for i, symbol in enumerate(symbols):
        at.append(len(edits))
        states.append(state)
        nxt = to_go[i + 1]
        initial, fault = symbol & 3, symbol >> 2
        while True:
            c = to_go[i][state]
            if DELETE + nxt[state] == c:
                edits.append("D")
            elif INSERT + to_go[i][NEXT[state]] == c:
                edits.append("I")
                state = NEXT[state]
                continue
            elif fault < REPEAT and AFTER[state][initial] >= 0 and TRUNCATED * fault + nxt[AFTER[state][initial]] == c:
                edits.append("K")
                state = AFTER[state][initial]
            else:
                edits.append("R")
                state = NEXT[state]
            break
    at.append(len(edits))
    states.append(state)
    while last and to_go[-1][state]:
        edits.append("I")
        state = NEXT[state]
    at[-1] = len(edits)
    return "".join(edits), at, [*states[:-1], state]


def cost_of(edits: str, symbols: list[int]) -> int:
    rows, total = iter(symbols), 0
    for e in edits:
        if e == "I":
            total += INSERT
            continue
        more = TRUNCATED * (next(rows) >> 2 == CUT_OFF)
        total += {"D": DELETE, "K": more, "R": REROLE + more}[e]
    return total


def rebuilt(edits: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired turns of rows from a state on."""
    out, rows = [], iter(zip(roles, texts, strict=True))
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e == "K":
            state = AFTER[state]["sua".find(role[0]) + 1]
        else:
            state = NEXT[state]
            role = ROLE[state]
        out.append((role, text))
    return out


def faults(symbols: list[int], turns: list[int | None], before: int, turn_before: int | None) -> dict[str, int]:
    """Counts of rows; steps from the row and turn before them are counted here too (before: an initial, -1 if none)."""
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    names = {BLANK: "blank", REPEAT: "duplicate", CUT_OFF: "truncated"}
    for s, t in zip(symbols, turns, strict=True):
        if s >> 2:
            out[names[s >> 2]] += 1
        if before >= 0 and (before, s & 3) not in {(1, 2), (2, 3), (3, 2)}:
            out["illegal"] += 1
        before = s & 3
        if t is not None:
            if turn_before is not None and t > turn_before:
                out["gaps"] += t - turn_before - 1
            turn_before = t
    out["gaps"] = (out["gaps"] + (1 << 63)) % (1 << 64) - (1 << 63)  # as longs add up
    return out


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
BLOCKS = "key string, conv_id {id}, part int, block int, turns array<bigint>, roles array<string>, texts array<string>, digests array<string>, kinds array<int>, copies array<int>"
PIECES = "key string, conv_id {id}, part int, block int, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired array<struct<role:string,text:string>>"


def blocks(rows: DataFrame, copies: str | None = None, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in order, cut into blocks.  copies: how often a row stands there (0: it only names its conversation)."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    initial = F.substring(role, 1, 1)
    ends = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(ends == "", BLANK).when(F.substring(ends, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) + 4 * fault
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        F.col("turn").cast("bigint").alias("turns"),
        role.alias("roles"),
        text.alias("texts"),
        F.sha2(text, 256).alias("digests"),
        kind.cast("int").alias("kinds"),
        (F.lit(1) if copies is None else F.col(copies)).cast("int").alias("copies"),
        F.monotonically_increasing_id().alias("salt"),  # equal rows are alike, so any of them may come first
    )
    order = ["key", F.asc_nulls_first("turns"), "roles", "digests"]
    lists = ["turns", "roles", "texts", "digests", "kinds", "copies"]
    names = ["key", "conv_id", "part", "block", *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.concat_batches([held, batch])
            key = table.column("key")
            new = np.ones(len(key), bool)
            new[1:] = np.asarray(pc.not_equal(key[1:], key[:-1]))
            first = np.flatnonzero(new)
            place = np.arange(len(key))
            size = np.asarray(pc.binary_length(table.column("texts"))).astype(np.int64)
            ends = np.cumsum(size)
            run_of = np.cumsum(new) - 1
            inside = (ends - size) - (ends - size)[first][run_of]
            chunk = (place - first[run_of]) // most_rows + inside // most_bytes
            new[1:] |= chunk[1:] != chunk[:-1]
            starts = np.flatnonzero(new)
            whole, held = starts[-1], table.slice(starts[-1])
            if whole:
                yield made(table.slice(0, whole), starts, part, block)
                block += len(starts) - 1
        if held is not None:
            yield made(held, np.array([0, held.num_rows]), part, block)

    def made(table: pa.RecordBatch, starts: np.ndarray, part: int, block: int) -> pa.RecordBatch:
        n, at = len(starts) - 1, pa.array(starts, pa.int32())
        head = pa.array(starts[:-1])
        columns = [table.column("key").take(head), table.column("conv_id").take(head), pa.array([part] * n, pa.int32()), pa.array(np.arange(block, block + n), pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *[pa.ListArray.from_arrays(at, table.column(c)) for c in lists]], names=names)

    dealt = named.repartitionByRange(*order, "salt").sortWithinPartitions(*order).drop("salt")
    return stored(dealt.mapInArrow(run, BLOCKS.format(id=dict(rows.dtypes)["conv_id"])), "conversation-blocks")


def _spread(values: list, copies: list[int]) -> list:
    return [v for v, n in zip(values, copies, strict=True) for _ in range(n)]


def _symbols(kinds: list[int], copies: list[int], repeats: set[int]) -> list[int]:
    """A symbol for each copy of each row; repeats: places of rows that an earlier block or row has."""
    out = []
    for i, (kind, n) in enumerate(zip(kinds, copies, strict=True)):
        again = kind if kind >> 2 == BLANK else (kind & 3) + 4 * REPEAT
        if n > 0:
            out.append(again if i in repeats else kind)
            out.extend([again] * (n - 1))
    return out


def _pieces(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """rows: (key, conv_id, part, block, counts by name, audit, turns)."""
    flat = [turn for r in rows for turn in r[6]]
    turns = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], names=["role", "text"])
    ends = np.concatenate(([0], np.cumsum([len(r[6]) for r in rows]))).astype(np.int32)
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], id_type), *[pa.array([r[k] for r in rows], pa.int32()) for k in (2, 3)]]
    columns += [pa.array([r[4][c] for r in rows], pa.int64()) for c in COUNTS]
    columns += [pa.array([r[5] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), turns)]
    return pa.RecordBatch.from_arrays(columns, names=["key", "conv_id", "part", "block", *COUNTS, "audit", "repaired"])


def _small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations of one block."""
    for batch in (part for b in batches for part in _small(b)):
        out = []
        for r in batch.to_pylist():
            copies, seen, repeats = r["copies"], set(), set()
            for i, (role, digest, n) in enumerate(zip(r["roles"], r["digests"], copies, strict=True)):
                if n > 0:
                    if (role, digest) in seen:
                        repeats.add(i)
                    seen.add((role, digest))
            repeats = {i for i in repeats if r["kinds"][i] >> 2 != BLANK}
            symbols = _symbols(r["kinds"], copies, repeats)
            to_go = costs(symbols, END)
            edits, _, _ = walk(symbols, to_go, START, True)
            counts = faults(symbols, _spread(r["turns"], copies), -1, None) | {"cost": to_go[0][START]}
            out.append((r["key"], r["conv_id"], r["part"], r["block"], counts, edits, rebuilt(edits, START, _spread(r["roles"], copies), _spread(r["texts"], copies))))
        if out:
            yield _pieces(out, batch.schema.field("conv_id").type)


RUNS = "key string, part int, costs array<bigint>, first int, last int, first_turn bigint, last_turn bigint"
BEHIND = "key string, part int, behind array<bigint>, final boolean, before int, turn_before bigint"
WALKS = "key string, part int, block int, " + ", ".join(f"{c} bigint" for c in COUNTS[:-1]) + ", walks array<struct<state:int,edits:string,cost:bigint,behind:int>>"
CHAINED = "key string, part int, state int"


def _unfolded(g: pd.DataFrame) -> list[tuple[int, list[int], list]]:
    """(block, symbols, turns) of a run's blocks in order."""
    g = g.sort_values("block")
    out = []
    for r in g.itertuples():
        repeats = {int(i) for i in r.repeats} if r.repeats is not None else set()
        copies = [int(n) for n in r.copies]
        turns = [None if t is None or t != t else int(t) for t in r.turns]
        out.append((r.block, _symbols([int(k) for k in r.kinds], copies, repeats), _spread(turns, copies)))
    return out


def _run(g: pd.DataFrame) -> pd.DataFrame:
    symbols, turns = [], []
    for _, s, t in _unfolded(g):
        symbols += s
        turns += [x for x in t if x is not None]
    m = [c for row in matrix(symbols) for c in row]
    own = (symbols[0] & 3, symbols[-1] & 3) if symbols else (-1, -1)
    ends = pd.array([turns[0], turns[-1]] if turns else [None, None], dtype="Int64")
    return pd.DataFrame({"key": [g["key"].iloc[0]], "part": [g["part"].iloc[0]], "costs": [m], "first": own[0], "last": own[1], "first_turn": ends[:1], "last_turn": ends[1:]})


def _behind(g: pd.DataFrame) -> pd.DataFrame:
    """Cost to go behind each run, and the last row and turn before it: a row a task that had rows of the conversation."""
    g = g.sort_values("part")
    behind, go = [], END
    for m in g["costs"][::-1]:
        behind.append([int(min(c, _FAR)) for c in go])
        go = with_inserts([min(int(m[4 * q + k]) + go[k] for k in range(4)) for q in range(4)])
    before, turn, befores, turns_before = -1, None, [], []
    for r in g.itertuples():
        befores.append(before)
        turns_before.append(turn)
        before = r.last if r.last >= 0 else before
        turn = int(r.last_turn) if not pd.isna(r.last_turn) else turn
    final = [i == len(g) - 1 for i in range(len(g))]
    return pd.DataFrame({"key": g["key"], "part": g["part"], "behind": behind[::-1], "final": final, "before": befores, "turn_before": pd.array(turns_before, dtype="Int64")})


def _walked(g: pd.DataFrame) -> pd.DataFrame:
    """Each block's edits for each state that its run may begin in."""
    head = g.iloc[0]
    parts = _unfolded(g)
    symbols = [s for _, own, _ in parts for s in own]
    to_go = costs(symbols, tuple(int(c) for c in head["behind"]))
    walks = [walk(symbols, to_go, q, bool(head["final"])) for q in range(4)]
    before, turn = int(head["before"]), None if pd.isna(head["turn_before"]) else int(head["turn_before"])
    out, i = [], 0
    for k, (block, own, turns) in enumerate(parts):
        j = i + len(own)
        each = []
        for edits, at, states in walks:
            cut = edits[at[i] : len(edits) if k == len(parts) - 1 else at[j]]
            each.append({"state": states[i], "edits": cut, "cost": cost_of(cut, own), "behind": states[-1]})
        out.append({"key": head["key"], "part": head["part"], "block": block, **faults(own, turns, before, turn), "walks": each})
        before = own[-1] & 3 if own else before
        turn = next((t for t in reversed(turns) if t is not None), turn)
        i = j
    return pd.DataFrame(out)


def _chain(g: pd.DataFrame) -> pd.DataFrame:
    """The state that each run begins in."""
    g = g.sort_values("part")
    states, state = [], START
    for ends in g["ends"]:
        states.append(state)
        state = int(ends[state])
    return pd.DataFrame({"key": g["key"], "part": g["part"], "state": states})


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilds the blocks of long conversations from the edits of the state that their run begins in."""
    for batch in (part for b in batches for part in _small(b, 8)):
        out = []
        for r in batch.to_pylist():
            copies, own = r["copies"], r["walks"][r["state"]]
            turns = rebuilt(own["edits"], own["state"], _spread(r["roles"], copies), _spread(r["texts"], copies))
            out.append((r["key"], r["conv_id"], r["part"], r["block"], {c: r[c] for c in COUNTS[:-1]} | {"cost": own["cost"]}, own["edits"], turns))
        if out:
            yield _pieces(out, batch.schema.field("conv_id").type)


def _long(cut: DataFrame, pieces: str) -> DataFrame:
    """Pieces of conversations of several blocks."""
    at = ["key", "part", "block"]
    rows = cut.select(*at, F.posexplode(F.arrays_zip("roles", "digests", "kinds", "copies")).alias("pos", "r")).where(f"r.copies > 0 and r.kinds < {4 * BLANK}")
    rows = stored(rows.select(*at, "pos", F.col("r.roles").alias("role"), F.col("r.digests").alias("digest")), "conversation-rows")
    first = rows.groupBy("key", "role", "digest").agg(F.min(F.struct("part", "block", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = rows.join(first, ["key", "role", "digest"]).where(F.struct("part", "block", "pos") != F.col("first")).groupBy(*at).agg(F.collect_list("pos").alias("repeats"))
    slim = stored(cut.select(*at, "turns", "kinds", "copies").join(again, at, "left"), "conversation-symbols")
    runs = stored(slim.groupBy("key", "part").applyInPandas(_run, RUNS), "conversation-runs")
    behind = runs.groupBy("key").applyInPandas(_behind, BEHIND)
    walked = stored(slim.join(behind, ["key", "part"]).groupBy("key", "part").applyInPandas(_walked, WALKS), "conversation-walks")
    ends = walked.groupBy("key", "part").agg(F.any_value(F.transform("walks", lambda w: w["behind"])).alias("ends"))
    states = ends.groupBy("key").applyInPandas(_chain, CHAINED)
    chosen = cut.join(walked.join(states, ["key", "part"]), at)
    return chosen.select("key", "conv_id", "part", "block", "roles", "texts", "copies", *COUNTS[:-1], "walks", "state").mapInArrow(_chosen, pieces)


def repair(rows: DataFrame, copies: str | None = None, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations in pieces: those of conversations of one piece, and all others.

    key (names the conversation), conv_id, part, block (the pieces' order), counts of faults, gaps between turns and
    cost, audit (the edits' initials) and repaired (the turns).  All counts add up over a conversation's pieces."""
    cut = blocks(rows, copies, most_rows, most_bytes)
    pieces = PIECES.format(id=dict(rows.dtypes)["conv_id"])
    several = stored(cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "conversation-long")
    alone = only(cut, several, "left_anti", "key").mapInArrow(_alone, pieces)
    if several.isEmpty():
        return alone, alone.where("false")
    return alone, _long(stored(only(cut, several, "left_semi", "key"), "conversation-cut"), pieces)


def turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, block, place, role, text) of the repaired turns, ordered by part, block and place."""
    return pieces.select("conv_id", "part", "block", F.posexplode("repaired").alias("place", "r")).select("conv_id", "part", "block", "place", "r.role", "r.text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns, whose pieces come one after the other: a digest has no parallel form, so
    a conversation's text streams through one task, which holds a few pieces of it at a time."""
    key, digest, begun = None, None, False
    done: list[tuple[str, str]] = []
    for batch in (part for b in batches for part in _small(b, 8)):
        for r in batch.to_pylist():
            if r["key"] != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, begun = r["key"], hashlib.sha256(), False
            for turn in r["repaired"]:
                digest.update(f"{chr(10) if begun else ''}{turn['role']}:{turn['text']}".encode())
                begun = True
    if digest is not None:
        done.append((key, digest.hexdigest()))
    yield pa.RecordBatch.from_pylist([{"key": k, "repaired_sha256": h} for k, h in done], schema=pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32(`conv_id:turn`) % 20, and how often each stands there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    d = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return d.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def digests(pieces: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row a conversation: counts, audit and the digest of its repaired turns."""
    alone, long_ = pieces
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    out = alone.select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    held = stored(long_, "conversation-pieces")
    if held.isEmpty():
        return out
    ordered = F.array_sort(F.collect_list(F.struct("part", "block", "audit")))
    sums = held.groupBy("key").agg(F.any_value("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in COUNTS], F.array_join(F.transform(ordered, lambda x: x["audit"]), "").alias("audit"))
    hashed = held.repartition("key").sortWithinPartitions("key", "part", "block").select("key", "repaired").mapInArrow(_hashed, "key string, repaired_sha256 string")
    return out.unionByName(sums.join(hashed, "key").drop("key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "copies"))


ORACLE = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bits AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(n)),
crc_table AS (SELECT list(t ORDER BY n) AS t FROM bits),
f AS (SELECT o.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS fault FROM o, crc_table),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
 unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM f),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends,
 lag(role[1]) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
s AS (SELECT *, CASE WHEN ends = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
ids AS (SELECT DISTINCT conv_id FROM conversations),
step(state, made, made_role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins AS (SELECT state AS q, '' AS letters, 0 AS cost, state AS q2, CAST([] AS VARCHAR[]) AS turns FROM step UNION ALL SELECT state, 'I', 5, made, [made_role || ':'] FROM step
 UNION ALL SELECT a.state, 'II', 10, b.made, [a.made_role || ':', b.made_role || ':'] FROM step a JOIN step b ON b.state = a.made),
legal(state, initial, q3) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves AS (SELECT s.conv_id, s.i, ins.q, ins.cost + e.cost AS cost, ins.letters || e.letter AS letters, e.q3, list_concat(ins.turns, e.turns) AS turns FROM s, ins, LATERAL (
  SELECT 'D' AS letter, 2 AS cost, ins.q2 AS q3, CAST([] AS VARCHAR[]) AS turns
  UNION ALL SELECT 'K', CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, legal.q3, [s.role || ':' || s.text] FROM legal WHERE legal.state = ins.q2 AND legal.initial = s.role[1] AND s.fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT 'R', 1 + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, step.made, [step.made_role || ':' || s.text] FROM step WHERE step.state = ins.q2 AND s.fault NOT IN ('blank', 'duplicate')) e),
go AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM ids
 UNION ALL SELECT conv_id, i, q3, best.cost, best.audit, best.turns FROM (
  SELECT g.conv_id, m.i, m.q3, min({'cost': g.cost + m.cost, 'audit': g.audit || m.letters, 'turns': list_concat(g.turns, m.turns)}) AS best
  FROM go g JOIN moves m ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.i = g.i + 1 AND m.q = g.q GROUP BY 1, 2, 3)),
total AS (SELECT ids.conv_id, coalesce(max(s.turn) - min(s.turn) + 1 - count(DISTINCT s.turn), 0) AS gaps, count(s.i) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY 1),
ended AS (SELECT go.conv_id, min({'cost': go.cost + ins.cost, 'audit': go.audit || ins.letters, 'turns': list_concat(go.turns, ins.turns)}) AS best FROM go JOIN total t ON t.conv_id IS NOT DISTINCT FROM go.conv_id AND go.i = t.n JOIN ins ON ins.q = go.q WHERE ins.q2 IN (0, 3) GROUP BY 1)
SELECT t.conv_id, t.gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.turns, chr(10))) AS repaired_sha256 FROM total t JOIN ended e ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""
