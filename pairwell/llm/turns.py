"""Repair of the turns of conversations with Four-Russians block tables.

A conversation should have the role initials ``(s?(ua)+)?``. Rows are kept (0), given the role user or assistant (1),
deleted (2), or turns without text are inserted (5); blank and repeated rows have to go, and a truncated row that
stays costs 5 more. The cheapest edits are found, of equally cheap ones those whose initials come first in ASCII.

An automaton of four states reads the roles, and each state admits one role of user and assistant, so an edit's
initial and a state fix the next state. For every place the cost of all that follows is a vector with one number for
each state. Less its smallest number it is one of few vectors, so

1. Tables. For every block of ``BLOCK`` row symbols and every vector behind the block, a table has the vector before
   it (and what was taken off), the vectors inside it, and where its edits lead from each state.
2. Order. Rows are range-partitioned by conversation, turn, role and text, so a long conversation lies in several
   partitions. Repeats are marked from counts of equal texts, and each row gets its symbol in one pass.
3. Backward. A pass in descending order looks up whole blocks and expands them, which gives every row the vector
   behind it. Where a conversation goes on in the next partition, that partition's piece is first summarised for
   every vector and state; there are at most two such pieces in a partition, and only these summaries are collected.
4. Forward. A pass in ascending order chooses the edits: the first in ASCII that keeps to the cost behind it, which is
   tie-safe because the costs are of what follows. Both passes stream and hold one batch.

The digest of a conversation's repaired turns is one hash over all of them, so the last step of ``digests`` streams
the text of a conversation through one task; it holds a batch of it and one letter for each edit.

Defined cases: NULL roles and texts count as one space; rows are in the order of turn (NULL first), role and a hash of
the text, so rows of one turn have an order; equal rows of a conversation are duplicates but for the first; a NULL
conv_id is a conversation; texts of any length are passed on and hashed whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import join_facts
from pairwell.session import durable

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after system, after user, after assistant. What user or assistant may follow, and the state then.
EXPECTED = ("user", "user", "assistant", "user")
NEXT = np.array([2, 2, 3, 2])
#: Symbols: 0 has to go; 1 + 2 * role + truncated for the roles system, user, assistant, other; NO_ROW stands for nothing.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NO_ROW, SYMBOLS, BLOCK = 9, 10, 4
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Bytes of repaired text in a row on the way to the digest of a conversation that lies in several partitions.
PIECE_BYTES = 1 << 20

ROW = "conv_id long, turn long, role string, text string, head int, fault int, part int, seq long, symbol int"
EDIT = "conv_id long, part int, seq long, turn long, role string, text string, edit string, fault int, illegal int, new_turn int, done boolean"
PIECE = (
    "conv_id long, part int, seq long, blank long, duplicate long, truncated long, illegal long, cost long, low long, high long, turns long, "
    "audit string, body binary, begins boolean, ends boolean"
)
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs with insertions."""
    for _ in range(3):
        cost = np.minimum(cost, INSERT + cost[NEXT])
    return cost


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row in a state, in ASCII order: (initial, cost, next state)."""
    out = [("D", DELETE, state)]
    if symbol:
        role, extra = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        if role == SYSTEM and state == 0:
            out.append(("K", extra, 1))
        elif role in (USER, ASSISTANT) and (role == ASSISTANT) == (state == 2):
            out.append(("K", extra, int(NEXT[state])))
        out.append(("R", REROLE + extra, int(NEXT[state])))
    return out


def before(symbol: int, behind: np.ndarray) -> np.ndarray:
    """Costs before a row from those behind it."""
    if symbol == NO_ROW:
        return behind
    return closed(np.array([min(cost + behind[to] for _, cost, to in options(symbol, q)) for q in range(4)]))


class Tables:
    """All vectors that occur, and for blocks of symbols what becomes of them.

    ``step[symbol, v]`` and ``block[code, v]`` are vectors before a row or block, ``inside[code, v]`` those behind its
    rows, the last row's first; ``lead[code, v, state]`` is the state behind the block; ``trace[symbol][v][state]`` has
    the edits of a row, their cost and the next state.
    """

    def __init__(self) -> None:
        self.vectors = [tuple(closed(np.array([0, 99, 99, 0])).tolist())]
        self.last = 0
        index = {self.vectors[0]: 0}
        steps: list[list[int]] = []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                cost = before(symbol, np.array(vector))
                key = tuple((cost - cost.min()).tolist())
                if key not in index:
                    index[key] = len(self.vectors)
                    self.vectors.append(key)
                row.append(index[key])
            steps.append(row)
        n = len(self.vectors)
        self.step = np.array(steps).T.copy()
        self.trace = [[[self.edits(s, v, q) for q in range(4)] for v in range(n)] for s in range(SYMBOLS)]
        to = np.array([[[self.trace[s][v][q][2] for q in range(4)] for v in range(n)] for s in range(SYMBOLS)])
        every = np.arange(n)
        block, lead = every[None, :], np.broadcast_to(np.arange(4), (1, n, 4))
        inside = np.zeros((1, n, 0), np.int64)
        for _ in range(BLOCK):
            # One more symbol in front: from its next state go on with the rest of the block.
            first = to[:, block]
            lead = np.take_along_axis(np.broadcast_to(lead, (SYMBOLS, *lead.shape)), first, axis=3).reshape(-1, n, 4)
            inside = np.broadcast_to(np.concatenate([inside, block[:, :, None]], axis=2), (SYMBOLS, *block.shape, inside.shape[2] + 1)).reshape(-1, n, inside.shape[2] + 1)
            block = self.step[:, block].reshape(-1, n)
        self.block, self.lead, self.inside = block.astype(np.int16), lead.astype(np.int8), inside.astype(np.int16)

    def edits(self, symbol: int, v: int, state: int) -> tuple[str, int, int]:
        """Edits up to and with a row, when the costs behind it are vector v: (initials, cost, next state)."""
        if symbol == NO_ROW:
            return "", 0, state
        behind = np.array(self.vectors[v])
        now = before(symbol, behind)
        told, spent = "", 0
        while True:
            # Insertion comes between deletion and the others in ASCII.
            found = {e: (c, to) for e, c, to in options(symbol, state) if c + behind[to] == now[state]}
            if "D" not in found and INSERT + now[NEXT[state]] == now[state]:
                told, spent, state = told + "I", spent + INSERT, int(NEXT[state])
                continue
            edit = min(found)
            cost, to = found[edit]
            return told + edit, spent + cost, to

    def closing(self, state: int) -> tuple[str, int]:
        """Insertions at the end of a conversation."""
        n = {0: 0, 1: 2, 2: 1, 3: 0}[state]
        return "I" * n, INSERT * n


@cache
def tables() -> Tables:
    return Tables()


def codes(symbols: np.ndarray) -> np.ndarray:
    """Codes of the blocks of symbols in descending order of the rows; a short block is filled up in front."""
    padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NO_ROW, np.int64)
    padded[: len(symbols)] = symbols
    return padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK))


def runs(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[int, int, int | None]]:
    """(from, to, conversation) of the rows of each conversation in a batch."""
    if not batch.num_rows:
        return
    ids = batch.column(column)
    filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
    none = ids.is_null().to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((filled[1:] != filled[:-1]) | (none[1:] != none[:-1])) + 1
    bounds = [0, *edges.tolist(), batch.num_rows]
    for low, high in zip(bounds, bounds[1:], strict=False):
        yield low, high, None if none[low] else int(filled[low])


def numbered_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ROW) from sorted records: a row equal to the record before it, a mark or a row, is a duplicate."""
    last_key, last_turn, seq = None, None, 0
    names = [c.split()[0] for c in ROW.split(", ")]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, turn, role, text, head, flaw, part, kind, key, who = batch.columns
        same = np.zeros(n, dtype=bool)
        turns, there = turn.fill_null(0).to_numpy(zero_copy_only=False), turn.is_valid().to_numpy(zero_copy_only=False)
        if n > 1:
            keys = pc.equal(key.slice(1), key.slice(0, n - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            same[1:] = keys & (turns[1:] == turns[:-1]) & (there[1:] == there[:-1])
        first = key[0].as_py()
        same[0] = first is not None and first == last_key and turn[0].as_py() == last_turn
        last_key, last_turn = key[n - 1].as_py(), turn[n - 1].as_py()
        fault = flaw.to_numpy(zero_copy_only=False).copy()
        fault[same & (fault != BLANK)] = DUPLICATE
        symbol = np.where((fault == BLANK) | (fault == DUPLICATE), 0, 1 + 2 * who.to_numpy(zero_copy_only=False) + (fault == CUT))
        heads = head.to_numpy(zero_copy_only=False)
        symbol[heads == 0] = NO_ROW
        stay = np.flatnonzero(kind.to_numpy(zero_copy_only=False) == 1)
        take = pa.array(stay)
        columns = [c.take(take) for c in (conv, turn, role, text, head)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(fault[stay].astype(np.int32)), part.take(take), pa.array(seq + np.arange(len(stay))), pa.array(symbol[stay].astype(np.int32))], names=names
        )
        seq += len(stay)


def summaries(spanning: dict[int, set]):
    """For pieces of conversations in several partitions, rows in descending order: what each vector and state behind
    the piece becomes before it, and the roles and turns at its ends."""
    names = ["conv_id", "part", "vectors", "leads", "first_role", "last_role", "first_turn", "last_turn", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        rows: dict = {}
        for batch in batches:
            parts = batch.column(1)
            for low, high, conv in runs(batch):
                part = parts[low].as_py()
                if conv not in spanning.get(part, ()):
                    continue
                symbols = batch.column(2).slice(low, high - low).to_numpy(zero_copy_only=False)
                state = rows.setdefault(conv, {"part": part, "v": np.arange(len(t.vectors)), "lead": np.tile(np.arange(4), (len(t.vectors), 1)), "rows": 0})
                for code in codes(symbols):
                    state["lead"] = np.take_along_axis(state["lead"], t.lead[code][state["v"]].astype(np.int64), axis=1)
                    state["v"] = t.block[code][state["v"]]
                real = np.flatnonzero(symbols != NO_ROW)
                if len(real):
                    at = [low + int(real[0]), low + int(real[-1])]
                    if not state["rows"]:
                        state["last"] = (batch.column(3)[at[0]].as_py(), batch.column(4)[at[0]].as_py())
                    state["first"] = (batch.column(3)[at[1]].as_py(), batch.column(4)[at[1]].as_py())
                    state["rows"] += len(real)
        for conv, s in rows.items():
            first, last = s.get("first", (None, None)), s.get("last", (None, None))
            values = [[conv], [s["part"]], [s["v"].tolist()], [s["lead"].ravel().tolist()], [first[0]], [last[0]], [first[1]], [last[1]], [s["rows"]]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    return run


SUMMARY = "conv_id long, part int, vectors array<int>, leads array<int>, first_role string, last_role string, first_turn long, last_turn long, rows long"


def contexts(pieces: list) -> dict:
    """(part, conversation) -> (vector behind the piece, state before it, role and turn before it, if any, begins here, ends here)."""
    by: dict = {}
    for p in pieces:
        by.setdefault(p["conv_id"], []).append(p)
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda p: p["part"])
        behind = [0] * len(found)
        v = tables().last
        for i in range(len(found) - 1, -1, -1):
            behind[i] = v
            v = found[i]["vectors"][v]
        state, role, turn, any_row = 0, None, None, False
        for i, p in enumerate(found):
            out[p["part"], conv] = (behind[i], state, role, turn, any_row, i == 0, i == len(found) - 1)
            state = p["leads"][4 * behind[i] + state]
            if p["rows"]:
                role, turn, any_row = p["last_role"], p["last_turn"], True
    return out


def backward(known: dict):
    """Adds the vector behind each row; rows come in descending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        conv, v = object(), 0
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int32)
            symbols, parts = batch.column(8).to_numpy(zero_copy_only=False), batch.column(6)
            for low, high, now in runs(batch):
                if now != conv:
                    conv = now
                    v = known[parts[low].as_py(), now][0] if (parts[low].as_py(), now) in known else t.last
                for i, code in enumerate(codes(symbols[low:high]).tolist()):
                    at = low + i * BLOCK
                    end = min(at + BLOCK, high)
                    # A short block is filled up in front, behind which nothing changes.
                    out[at:end] = t.inside[code, v][: end - at]
                    v = t.block[code, v]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "behind"])

    return run


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def forward(known: dict):
    """Edits (EDIT) of the rows in ascending order; a row without an edit opens every conversation of a partition."""
    names = [c.split()[0] for c in EDIT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), None, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        conv, part, state, seen, role_before, turn_before, ends = object(), None, 0, False, None, None, True

        def closing(out: list, seq: int) -> None:
            if isinstance(conv, int | None):
                for i, edit in enumerate(t.closing(state)[0] if ends else ""):
                    out.append((conv, part, seq, None, EXPECTED[(2 if state == 2 else 0) if i == 0 else 2], None, edit, 0, 0, 0, False))
                out.append((conv, part, seq, None, None, None, None, 0, 0, 0, ends))

        last = 0
        for batch in batches:
            out: list[tuple] = []
            turns, roles, heads = (batch.column(i).to_pylist() for i in (1, 2, 4))
            faults, seqs, symbols, vectors = (batch.column(i).to_pylist() for i in (5, 7, 8, 9))
            for low, high, now in runs(batch):
                if now != conv or not isinstance(conv, int | None):
                    closing(out, last)
                    conv, part = now, batch.column(6)[low].as_py()
                    _, state, role_before, turn_before, seen, _, ends = known.get((part, now), (0, 0, None, None, False, True, True))
                for i in range(low, high):
                    last = seqs[i]
                    if not heads[i]:
                        continue
                    role, turn = roles[i], turns[i]
                    illegal = int(seen and not legal(role_before[:1] + role[:1]))
                    new = int(turn is not None and (not seen or turn != turn_before))
                    told, _, to = t.trace[symbols[i]][vectors[i]][state]
                    for edit in told:
                        if edit == "I":
                            out.append((conv, part, last, None, EXPECTED[state], None, edit, 0, 0, 0, False))
                            state = int(NEXT[state])
                        else:
                            out.append((conv, part, last, turn, EXPECTED[state] if edit == "R" else role, i, edit, faults[i], illegal, new, False))
                    state, seen, role_before, turn_before = to, True, role, turn
            yield rows_of(out, batch.column(3))
        out = []
        closing(out, last)
        if out:
            yield rows_of(out, pa.array([""], pa.string()))

    def rows_of(out: list[tuple], text: pa.Array) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        texts = text.take(pa.array(columns[5], pa.int64())).fill_null("")
        return pa.RecordBatch.from_arrays([texts if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


COST = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def pieces_of(known: dict):
    """Counts, audit and repaired text (PIECE) of the edits of a partition, in pieces of bounded size; a conversation
    that lies in one partition and one piece gets its digest in place of its text."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 9, pa.string(), pa.binary(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = object()
        new = lambda: {"n": [0] * 5, "low": None, "high": None, "turns": 0, "audit": [], "body": [], "size": 0}
        held, number, begins = new(), 0, True

        def row(conv, part: int, ends: bool) -> tuple:
            body = b"\n".join(held["body"]) if held["body"] else None
            if begins and ends:
                body = hashlib.sha256(body or b"").digest()
            return (conv, part, number, *held["n"], held["low"], held["high"], held["turns"], "".join(held["audit"]), body, begins, ends)

        for batch in batches:
            out = []
            for c, part, _, turn, role, text, edit, fault, illegal, fresh, done in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv or not isinstance(conv, int | None):
                    conv, held, number = c, new(), 0
                    begins = (part, c) not in known or known[part, c][5]
                if edit is None:
                    out.append(row(c, part, done))
                    held, number, begins, conv = new(), number + 1, False, object()
                    continue
                n = held["n"]
                n[0] += fault == BLANK
                n[1] += fault == DUPLICATE
                n[2] += fault == CUT
                n[3] += illegal
                n[4] += COST[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
                held["turns"] += fresh
                if turn is not None:
                    held["low"] = turn if held["low"] is None else min(turn, held["low"])
                    held["high"] = turn if held["high"] is None else max(turn, held["high"])
                held["audit"].append(edit)
                if edit != "D":
                    raw = f"{role}:{text}".encode()
                    held["body"].append(raw)
                    held["size"] += len(raw)
                if held["size"] > PIECE_BYTES:
                    out.append(row(c, part, False))
                    held, number, begins = new(), number + 1, False
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests (DIGEST) from pieces in order of conversation and place."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.string()]
    for_all: dict = {}
    for batch in batches:
        out = []
        for conv, _, _, *counts, low, high, turns, audit, body, begins, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begins:
                for_all = {"n": [0] * 5, "low": None, "high": None, "turns": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
            s = for_all
            s["n"] = [a + b for a, b in zip(s["n"], counts, strict=True)]
            for name, pick, value in (("low", min, low), ("high", max, high)):
                if value is not None:
                    s[name] = value if s[name] is None else pick(s[name], value)
            s["turns"] += turns
            s["audit"].append(audit)
            if body is not None and not (begins and ends):
                s["sha"].update(b"\n" + body if s["any"] else body)
                s["any"] = True
            if ends:
                blank, duplicate, truncated, illegal, cost = s["n"]
                gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
                out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, "".join(s["audit"]), body.hex() if begins else s["sha"].hexdigest()))
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def ordered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows (ROW) in range partitions by conversation and place, stored, with one opening row for each conversation."""
    filled = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    keyed = filled.withColumn("key", F.unhex(F.sha2(whole, 256)))
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    equal = keyed.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("_rows")).where("first != last").drop("last")
    later = join_facts(keyed.select("conv_id", "turn", "role", "key"), equal, "key", "turn", "inner").where(place > F.col("first"))
    none = lambda kind: F.lit(None).cast(kind)
    flaw = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)
    columns = ["conv_id", "turn", "role", "text", "head", "flaw", "kind", "key", "who"]
    plain = keyed.withColumns({"head": F.lit(1), "flaw": flaw, "kind": F.lit(1), "who": initial(F.col("role"))}).select(columns)
    marks = later.withColumns({"text": none("string"), "head": F.lit(1), "flaw": F.lit(0), "kind": F.lit(0), "who": F.lit(OTHER)}).select(columns)
    heads = ids.select(F.col("conv_id").cast("long").alias("conv_id")).groupBy("conv_id").agg(F.lit(0).alias("head"))
    heads = heads.withColumns({"turn": none("long"), "role": none("string"), "text": none("string"), "flaw": F.lit(0), "kind": F.lit(1), "key": none("binary"), "who": F.lit(OTHER)}).select(columns)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "head", "turn", "role", "key")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.unionByName(marks).unionByName(heads).repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("kind"))
    dealt = dealt.withColumn("part", F.spark_partition_id()).select("conv_id", "turn", "role", "text", "head", "flaw", "part", "kind", "key", "who")
    return durable(dealt.mapInArrow(numbered_symbols, ROW))


def pieces_in_several(rows: DataFrame) -> dict[int, set]:
    """Partition -> its conversations that lie in other partitions, too; one row for each partition is collected."""
    name = F.struct(F.col("conv_id").isNotNull().alias("there"), F.col("conv_id").alias("id"))
    ends = rows.groupBy("part").agg(F.min(name).alias("low"), F.max(name).alias("high")).orderBy("part").collect()
    out: dict[int, set] = {}
    for left, right in zip(ends, ends[1:], strict=False):
        if left["high"] == right["low"]:
            for r in (left, right):
                out.setdefault(r["part"], set()).add(left["high"]["id"])
    return out


class Repair:
    """The edits of all conversations. ``ids`` names conversations that may have no rows left."""

    def __init__(self, rows: DataFrame, ids: DataFrame | None = None):
        self.rows = ordered(rows, rows if ids is None else ids)
        several = pieces_in_several(self.rows)
        self.known: dict = {}
        if several:
            narrow = self.rows.sortWithinPartitions(F.desc("seq")).select("conv_id", "part", "symbol", "role", "turn")
            # At most two pieces in a partition.
            self.known = contexts(narrow.mapInArrow(summaries(several), SUMMARY).collect())

    def edits(self) -> DataFrame:
        """One row for each edit (EDIT), in order within ``part``; without ``edit`` where a piece of a conversation ends."""
        behind = self.rows.sortWithinPartitions(F.desc("seq")).mapInArrow(backward(self.known), ROW + ", behind int")
        return behind.sortWithinPartitions("seq").mapInArrow(forward(self.known), EDIT)

    def turns(self) -> DataFrame:
        """The repaired turns: ``conv_id, part, seq, turn, role, text, edit``; inserted turns have no number."""
        return self.edits().where("edit != 'D'").select("conv_id", "part", "seq", "turn", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """Faults, cost, audit and digest of every conversation (DIGEST)."""
        pieces = self.edits().mapInArrow(pieces_of(self.known), PIECE)
        dealt = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
        return dealt.mapInArrow(merged, DIGEST)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults, drawn by ``crc32(conv_id:turn) % 20``; a NULL counts as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", word("role").alias("role"), word("text").alias("text"),
        (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("draw"),
    )
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("draw != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs them: one row (DIGEST) for every original conversation."""
    return Repair(damaged(conversations), conversations.select("conv_id")).digests()
