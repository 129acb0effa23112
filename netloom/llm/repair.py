"""Conversation structure repair by a weighted automaton that is determinised lazily.

A repaired conversation's roles spell (s?(ua)+)?: at most one system turn, then user and assistant in turn.  A row may be
kept (0), given the role user or assistant (2), or deleted (3, the only edit of a blank or repeated row); an empty turn of
user or assistant may be inserted anywhere (2), and a truncated row that stays adds 1.  These edits make a weighted
automaton over four states of the target.  Rows are read from the last to the first.  What each of the four states would
still cost is a vector; with its least entry taken off, it is a state of a deterministic automaton, and vectors reached
are kept in a table by (state, symbol), filled only as conversations need them.  So one pass of table look-ups gives the
cost.  The trace goes back against that pass, from the first row on, along arcs whose cost is tight, and takes the edit
of the least letter (D, I, K, R) each time.  From one state each letter leads to one state, so the trace follows one
path, and the audit is the least of the cheapest ones.

Rows of one conversation are put in order by a sort over all rows, dealt by range, so that a long conversation is spread
over tasks; equal rows are counted before.  Of each row only one letter (its role's initial and its fault) goes to the
task that walks a conversation: never more than the audit that its result row holds.  The digest of the repaired text is
taken while rows pass in order, so no conversation's texts are held together.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
"""States of the target by what was said last."""
NEXT = (USER, USER, ASSISTANT, USER)
"""The state after the one role, user or assistant, that may follow in each state."""
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
"""Costs of edits, and of a truncated row that stays."""
OK, CUT, BLANK, REPEATED = range(4)
"""Faults of a row; symbols are 4 * fault + role, roles being s, u, a and any other."""


class Automaton:
    """States are normalised vectors; rows of the table are filled when they are first needed."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.arcs: list[list[tuple[int, int] | None]] = []
        self.tight: list[list[tuple | None]] = []
        self.final = self._state((0, 2 * INSERT, INSERT, 0))

    def _state(self, vector: tuple[int, ...]) -> int:
        k = self.number.get(vector)
        if k is None:
            k = self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.arcs.append([None] * 16)
            self.tight.append([None] * 16)
        return k

    @staticmethod
    def _edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state after) of each edit that uses up the row."""
        fault, role = divmod(symbol, 4)
        out = [("D", DELETE, state)]
        if fault in (OK, CUT):
            more = TRUNCATED if fault == CUT else 0
            if role == 0 and state == START:
                out.append(("K", KEEP + more, SYSTEM))
            if role in (1, 2) and NEXT[state] == (USER, ASSISTANT)[role - 1]:
                out.append(("K", KEEP + more, NEXT[state]))
            out.append(("R", REROLE + more, NEXT[state]))
        return out

    def arc(self, after: int, symbol: int) -> tuple[int, int]:
        """The state before a row, and its weight, from the state after it; tight arcs are noted on the way."""
        later = self.vectors[after]
        edits = [self._edits(q, symbol) for q in range(4)]
        cost = [min(c + later[t] for _, c, t in e) for e in edits]
        for _ in range(3):
            cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]
        least = min(cost)
        way = []
        for q in range(4):
            ways = [(letter, t) for letter, c, t in edits[q] if c + later[t] == cost[q]]
            if INSERT + cost[NEXT[q]] == cost[q]:
                ways.append(("I", NEXT[q]))
            way.append(min(ways))
        found = self.arcs[after][symbol] = (self._state(tuple(c - least for c in cost)), least)
        self.tight[after][symbol] = tuple(way)
        return found

    def repair(self, symbols: list[int]) -> tuple[int, str, list[str]]:
        """The cost, the audit and what each row becomes: u and a are inserted turns, K the row, U and A the row by another role.

        Turns inserted at the end stand at the last row.
        """
        n, state, cost = len(symbols), self.final, 0
        after = [0] * n
        arcs = self.arcs
        for i in range(n - 1, -1, -1):
            after[i] = state
            state, weight = arcs[state][symbols[i]] or self.arc(state, symbols[i])
            cost += weight
        cost += self.vectors[state][START]
        audit, made = [], []
        q = START
        for i in range(n):
            way, said = self.tight[after[i]][symbols[i]], ""
            while True:
                letter, to = way[q]
                audit.append(letter)
                if letter == "I":
                    said += "ua"[to - USER]
                elif letter == "R":
                    said += "UA"[to - USER]
                elif letter == "K":
                    said += "K"
                q = to
                if letter != "I":
                    break
            made.append(said)
        while q in (SYSTEM, USER):
            q = NEXT[q]
            audit.append("I")
            made[-1] += "ua"[q - USER]
        return cost, "".join(audit), made


def _walk(batches):
    automaton = Automaton()
    for batch in batches:
        out = {k: [] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "made")}
        for parts in batch.column("symbols").to_pylist():
            whole = "".join(parts)
            symbols = [ord(c) - 65 for c in whole]
            cost, audit, made = automaton.repair(symbols)
            roles = [x % 4 for x in symbols]
            out["illegal"].append(sum(1 for x, y in zip(roles, roles[1:], strict=False) if (x, y) not in ((0, 1), (1, 2), (2, 1))))
            for fault, name in ((BLANK, "blank"), (REPEATED, "duplicate"), (CUT, "truncated")):
                out[name].append(sum(1 for x in symbols if x // 4 == fault))
            out["cost"].append(cost)
            out["audit"].append(audit)
            at, own = 0, []
            for p in parts:
                own.append("".join(made[at : at + len(p)]))
                at += len(p)
            out["made"].append(own)
        kinds = {"audit": pa.string(), "made": pa.list_(pa.string())}
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("places"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], names=["conv_id", "places", *out])


def _lines(made: str, role: str, text: str) -> list[str]:
    named = {"u": "user:", "a": "assistant:", "K": f"{role}:{text}", "U": f"user:{text}", "A": f"assistant:{text}"}
    return [named[c] for c in made]


def _digests(batches):
    """Rows come in order of conversation and place; one running digest is held."""
    now, running, begun, kind = None, None, False, None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for conv, role, text, made in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "made")], strict=True):
            if not begun or conv != now:
                if begun:
                    out.append((now, running.hexdigest()))
                now, running, begun, first = conv, sha256(), True, True
            for line in _lines(made, role, text):
                running.update((line if first else "\n" + line).encode())
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([running.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of rows damaged by crc32(conv_id:turn) % 20, a null being one space there and in role and text."""
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    how = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("copies"))


def _judged(turns: DataFrame, copies: Column | None) -> DataFrame:
    """conv_id, turn, role, text and symbols of each distinct row, in order of place (a growing long); written."""
    space = F.lit(" ")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    bare = F.rtrim("text", F.lit(SPACES))
    present = rows.where("copies > 0")
    first = present.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("at"))  # nulls are least
    first = first.select(F.col("conv_id").alias("c"), F.col("at.turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"), F.lit(True).alias("new"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("x")), "left").drop("c", "t", "r", "x")
    fault = F.when(bare == "", BLANK).when(F.col("new").isNull(), REPEATED).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumn("fault", fault).withColumn("kind", role)
    letter = lambda fault: F.char(fault * 4 + F.col("kind") + 65)
    again = letter(F.when(F.col("fault") == BLANK, BLANK).otherwise(REPEATED))
    rows = rows.withColumn("symbols", F.when(F.col("copies") > 0, F.concat(letter(F.col("fault")), F.repeat(again, (F.col("copies") - 1).cast("int")))).otherwise(F.lit("")))
    return keep(rows.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text", "copies", "symbols", F.monotonically_increasing_id().alias("place")), "turns")


class Repaired:
    """The outcome for all conversations: a row for each, and the turns that they have after repair."""

    def __init__(self, turns: DataFrame, copies: Column | None = None):
        self.rows = _judged(turns, copies)
        gathered = self.rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "symbols"))).alias("all"))
        kind = turns.schema["conv_id"].dataType.simpleString()
        arrays = gathered.select("conv_id", F.col("all.place").alias("places"), F.col("all.symbols").alias("symbols"))
        numbers = ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal", "cost"))
        self.kind = kind
        self.walked = keep(arrays.mapInArrow(_walk, f"conv_id {kind}, places array<long>, {numbers}, audit string, made array<string>"), "repairs")

    def _made(self) -> DataFrame:
        said = self.walked.select(F.explode(F.arrays_zip("places", "made")).alias("x")).select(F.col("x.places").alias("place"), F.col("x.made").alias("made")).where("made <> ''")
        return self.rows.select("conv_id", "place", "role", "text").join(said, "place")

    def turns(self) -> DataFrame:
        """conv_id, place (order), step (order within), role and text of each turn after repair."""
        parts = F.posexplode(F.split("made", "")).alias("step", "how")
        out = self._made().select("conv_id", "place", "role", "text", parts).where("how <> ''")
        role = F.when(F.lower("how") == "u", "user").when(F.lower("how") == "a", "assistant").otherwise(F.col("role"))
        return out.select("conv_id", "place", "step", role.alias("role"), F.when(F.col("how").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
        turns = self.rows.where("copies > 0 and turn is not null").select("conv_id", "turn").distinct()
        gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")).withColumnRenamed("conv_id", "c1")
        ordered = self._made().repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text", "made")
        digests = ordered.mapInArrow(_digests, f"conv_id {self.kind}, repaired_sha256 string").withColumnRenamed("conv_id", "c2")
        out = self.walked.join(gaps, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
        return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def repair(turns: DataFrame, copies: Column | None = None) -> Repaired:
    """Repair the conversations in turns (conv_id, turn, role, text; other columns are left out, so no name can clash).

    Rows are in order of turn (nulls first), then role and text.  copies, a Column, says how often a row stands; a
    conversation whose rows stand no time at all has a result of zeros and an empty audit.  A null role or text is one
    space, so a blank row; a null conv_id is a conversation of its own.  Repeated rows are repeated turns, which are deleted.
    Texts of any length are looked at as a whole.  An empty table gives empty ones.
    """
    return Repaired(turns, copies)
