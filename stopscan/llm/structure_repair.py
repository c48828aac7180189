"""Repair of damaged conversations by iterative-deepening A*.

A conversation is read left to right; role initials must come out as `(s?(ua)+)?`. Each row is
deleted, kept or given the role that fits, and rows without text are inserted before it. Depth-first
search tries edits in ASCII order of their initials (D, I, K, R) under a cost bound; the bound then
rises to the least estimate that went beyond it. The estimate of what is left starts as two for every
row with a fault. A table keeps, for every (row, state) that failed, the bound proved for it, so no
state is searched twice under one bound. The bound that first succeeds is the least cost, and the
first accepting path of that search is the ASCII-least of the cheapest.

No task holds a conversation's texts. Rows are reduced to one byte each (fault and role initial), laid
out by range in order, and cut into blocks of `BLOCK` rows. Inserts stand before a row, so the edits
of a block end with an edit of its last row, and no block's edits begin another's: the blocks of one
conversation can be searched apart. A block that is not the last gives the least cost from each of four
entry states to each exit; from these the cost that follows each exit is added up backwards, all blocks
are searched with it at their end, and the entry states follow forwards. Most conversations are one
block, and then this is one search. The hash of a repaired conversation reads its rows in order as a
stream, since SHA-256 can only be taken in order; it holds the edits, of one byte each, and no text.

Defined results: null conv_id, turn, role and text read as one space in the damage, and null roles and
texts are one space from then on; a null conv_id is one conversation. Rows of one turn stand by role,
then by the SHA-256 of their text; equal rows of one turn stand together, all but one duplicates. Text
of any length passes as a stream. An empty table gives an empty result. Only conv_id, turn, role and
text are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from stopscan.llm.common import attach_groups, byte_slices, settle

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 256
TEXT_BYTES = 8 << 20
NEVER = 1 << 40
#: States of the wanted form: nothing yet, after the system row, after a user, after an assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Faults of a row, and role initials; a row's byte is `4 * fault + initial`.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
#: The role that an insert or a new role gives in each state, and the state it leads to.
WANTED = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Cost of the inserts that end a conversation from each state.
ENDING = (0, 10, 5, 0)
DELETE, INSERT, KEEP, REROLE = "DIKR"


def keeps(state: int, initial: int) -> int | None:
    """The state after a row is kept, or None where its role does not fit."""

    if state == EMPTY and initial == 0:
        return SYSTEM
    if state == USER:
        return ASSISTANT if initial == 2 else None
    return USER if initial == 1 else None


def _moves() -> list[list[list[tuple[str, int, int, int]]]]:
    """(edit, cost, rows passed, next state) by row byte and state, in ASCII order."""

    table = []
    for kind in range(16):
        fault, initial = divmod(kind, 4)
        extra = 5 if fault == TRUNCATED else 0
        by_state = []
        for state in range(4):
            to = WANTED[state][1]
            found = [(DELETE, 2, 1, state), (INSERT, 5, 0, to)]
            if fault < BLANK:
                kept = keeps(state, initial)
                if kept is not None:
                    found.append((KEEP, extra, 1, kept))
                found.append((REROLE, 1 + extra, 1, to))
            by_state.append(found)
        table.append(by_state)
    return table


MOVES = _moves()


class Search:
    """Cheapest edits of a block of rows towards given costs at its end."""

    def __init__(self, kinds: bytes, ending: tuple[int, ...], last: bool) -> None:
        self.kinds, self.ending, self.last = kinds, ending, last
        left = list(itertools.accumulate((2 if k >= 4 else 0 for k in reversed(kinds)), initial=0))
        # A user or assistant row is never unsaid, so earlier states are out of reach from there.
        least = [min(ending), min(ending[1:]), min(ending[2:]), min(ending[2:])]
        self.floor = [[v + w for w in least] for v in reversed(left[1:])] + [list(ending)]
        # All rows deleted and three inserts lead to any end that can be reached.
        self.limit = 2 * len(kinds) + 20 + min(ending)

    def cheapest(self, start: int) -> tuple[int, str, int] | None:
        """(cost, edits, state at the end) from `start`, or None where no edits reach an end."""

        while True:
            bound = self.floor[0][start]
            if bound > self.limit:
                return None
            found = self._descend(start, bound)
            if found is not None:
                return bound, *found

    def _descend(self, start: int, bound: int) -> tuple[str, int] | None:
        kinds, floor, size = self.kinds, self.floor, len(self.kinds)
        path: list[str] = []
        # row, state, cost left, moves to try, least estimate of those that failed
        open_: list[list] = [[0, start, bound, None, NEVER]]
        while open_:
            frame = open_[-1]
            row, state, rest, moves, low = frame
            if moves is None:
                if row == size:
                    if not self.last or state in (EMPTY, ASSISTANT):
                        return "".join(path), state
                    moves = iter(((INSERT, 5, 0, WANTED[state][1]),))
                else:
                    moves = iter(MOVES[kinds[row]][state])
                frame[3] = moves
            for edit, cost, passed, to in moves:
                need = cost + floor[row + passed][to]
                if need <= rest:
                    path.append(edit)
                    open_.append([row + passed, to, rest - cost, None, NEVER])
                    break
                if need < low:
                    low = need
            else:
                if low > floor[row][state]:
                    floor[row][state] = low
                open_.pop()
                if open_:
                    path.pop()
                    above = open_[-1]
                    # The table now holds more than the cost left, so the parent's next look fails.
                    cost = above[2] - rest
                    above[4] = min(above[4], cost + floor[row][state])
                continue
            frame[4] = low
        return None


def repaired(rows: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The rows (role, text) that `edits` leave."""

    out, at, state = [], 0, EMPTY
    for edit in edits:
        role, to = WANTED[state]
        if edit == INSERT:
            out.append((role, ""))
        else:
            if edit == KEEP:
                out.append(rows[at])
                to = keeps(state, INITIALS.find(rows[at][0][:1]) if rows[at][0] else -1)
            elif edit == REROLE:
                out.append((role, rows[at][1]))
            else:
                to = state
            at += 1
        state = to
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the checksum of each row deals."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", plain("role").alias("role"),
                                plain("text").alias("text"),
                                (F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20)
                                .alias("dealt"))
    return rows.where("dealt <> 0").select(
        "conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("dealt") == 1, "").when(
            F.col("dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("dealt") == 3, 2).otherwise(1).alias("copies"))


def _facts(rows: DataFrame) -> DataFrame:
    """Rows without their text: place in the order, digest, fault and initial; equal rows once."""

    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(
        ~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return rows.select(
        "conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", "role",
        F.sha2("text", 256).alias("digest"), fault.alias("fault"),
        initial.alias("initial"), "copies").groupBy(
        "conv_id", "has_turn", "turn", "role", "digest", "fault", "initial").agg(
        F.sum("copies").alias("copies"))


def _kinds(facts: DataFrame) -> DataFrame:
    """One row per damaged row with its byte; a row whose role and text came before is a duplicate."""

    same = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                              F.length("role").cast("string"), "role", "digest"), 256)
    marked = facts.withColumn("same", same)
    groups = marked.groupBy("same").agg(
        F.count(F.lit(1)).alias("turns"), F.min(F.struct("has_turn", "turn")).alias("first")).where(
        "turns > 1")
    found = attach_groups(marked, groups, "same", "turns", facts.count(), F.hash("turn", "conv_id"))
    later = F.col("turns").isNotNull() & ~F.struct("has_turn", "turn").eqNullSafe(F.col("first"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    fault = F.when((F.col("fault") != BLANK) & (later | (F.col("copy") > 1)), DUPLICATE).otherwise(
        F.col("fault"))
    return each.select("conv_id", "has_turn", "turn", "role", "digest", "copy",
                       (4 * fault + F.col("initial")).cast("int").alias("kind"))


def _blocks(kinds: DataFrame) -> DataFrame:
    """(conv_id, part, number, kinds) of at most BLOCK rows each, in order by part and number."""

    order = ("conv_id", "has_turn", "turn", "role", "digest", "copy")
    parts = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(kinds.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, now = bytearray(), None
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], types[0]), pa.array([part] * len(out), pa.int32()),
                 pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())],
                names=["conv_id", "part", "number", "kinds"])
            out.clear()
            return found

        types: list[pa.DataType] = []
        for batch in batches:
            types[:] = [batch.column(0).type]
            for conv, byte in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (conv != now or len(held) == BLOCK):
                    out.append((now, number, bytes(held)))
                    number += 1
                    held.clear()
                now = conv
                held.append(byte)
            if out:
                yield made()
        if held:
            out.append((now, number, bytes(held)))
            yield made()

    return kinds.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "conv_id", "kind").mapInArrow(
        run, f"conv_id {kind}, part int, number bigint, kinds binary")


def _mapped(df: DataFrame, given: list[str], dropped: list[str], fn, made: str,
            schema: str) -> DataFrame:
    """`df` with a column `made` that `fn` gives from the columns `given`, and without `dropped`."""

    kept = [c for c in df.columns if c not in dropped]
    rows = df.select(*kept, *[F.col(c).alias(f"__{k}") for k, c in enumerate(given)])
    spark = df.sparkSession
    kind = spark.createDataFrame([], f"{made} {schema}").schema
    arrow = to_arrow_schema(kind).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[len(kept):]
            found = [fn(*row) for row in zip(*[c.to_pylist() for c in columns])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(found, arrow)], names=[*kept, made])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:len(kept)], *kind.fields]))


def exits(kinds: bytes, last: bool) -> list[int]:
    """Least cost from each entry state to each exit state of a block, row by row; of the last block,
    from each entry state to the end of the conversation."""

    if last:
        search = Search(kinds, ENDING, True)
        return [search.cheapest(start)[0] for start in range(4)]
    found = [NEVER] * 16
    for out in range(4):
        search = Search(kinds, tuple(0 if k == out else NEVER for k in range(4)), False)
        for start in range(4):
            best = search.cheapest(start)
            if best is not None:
                found[4 * start + out] = best[0]
    return found


def endings(blocks: list[dict]) -> list[dict]:
    """The costs that follow each exit of each block of one conversation, from the last backwards."""

    after: list[int] = []
    found = []
    for block in reversed(blocks):
        found.append({"part": block["part"], "number": block["number"],
                      "ending": after or list(ENDING)})
        cost = block["exits"]
        after = [min(cost[4 * q + o] + after[o] for o in range(4)) for q in range(4)] \
            if after else cost
    return found


def edits_of(kinds: bytes, ending: list[int] | None, many: bool, last: bool) -> list[dict]:
    """Edits and exit state of a block from each entry state; of a lone block, from the first."""

    search = Search(kinds, tuple(ending or ENDING), last)
    found = [search.cheapest(start) for start in range(4 if many else 1)]
    return [{"edits": f[1], "out": f[2]} for f in found]


def entries(blocks: list[dict]) -> list[dict]:
    """The entry state of each block of one conversation, forwards."""

    state, found = EMPTY, []
    for block in blocks:
        found.append({"part": block["part"], "number": block["number"], "entry": state})
        state = block["outs"][state]
    return found


def _per_conversation(blocks: DataFrame, given: str, fn, schema: str) -> DataFrame:
    """`fn` over the blocks of each conversation in order: at most one number per BLOCK rows of a
    conversation whose edits, one byte per row, are one string of the result."""

    gathered = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("part", "number", given))).alias("blocks"))
    made = _mapped(gathered, ["blocks"], ["blocks", "conv_id"], fn, "made", f"array<struct<{schema}>>")
    return made.select(F.explode("made").alias("made")).select("made.*")


def _solved(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, number, kinds, edits) of every block of every conversation."""

    order = Window.partitionBy("conv_id").orderBy("part", "number")
    marked, _ = settle(blocks.withColumn("last", F.lead("part").over(order).isNull()).withColumn(
        "many", ~F.col("last") | F.lag("part").over(order).isNotNull()), "repair-blocks")
    at = ["part", "number"]
    costs = _mapped(marked.where("many"), ["kinds", "last"], ["kinds"], exits, "exits",
                    "array<bigint>")
    after = _per_conversation(costs, "exits", endings,
                              "part: int, number: bigint, ending: array<bigint>")
    searched, _ = settle(_mapped(
        marked.join(after, at, "left"), ["kinds", "ending", "many", "last"], ["ending"], edits_of,
        "found", "array<struct<edits: string, out: int>>"), "repair-edits")
    entry = _per_conversation(searched.where("many").withColumn("outs", F.col("found.out")), "outs",
                              entries, "part: int, number: bigint, entry: int")
    return searched.join(entry, at, "left").select(
        "conv_id", *at, "kinds", F.col("found")[F.coalesce("entry", F.lit(0))]["edits"].alias("edits"))


class Reader:
    """Results of one conversation from its blocks, then its rows in order."""

    def __init__(self, conv) -> None:
        self.conv, self.pieces, self.kinds = conv, [], []
        self.audit: str | None = None
        self.at, self.state, self.first = 0, EMPTY, True
        self.hash = hashlib.sha256()
        self.low = self.high = self.turn = None
        self.turns = 0

    def block(self, edits: str, kinds: bytes) -> None:
        self.pieces.append(edits)
        self.kinds.append(kinds)

    def _emit(self, role: str, text: str) -> None:
        if not self.first:
            self.hash.update(b"\n")
        self.first = False
        self.hash.update(f"{role}:{text}".encode())

    def _inserts(self) -> None:
        while self.audit.startswith(INSERT, self.at):
            role, self.state = WANTED[self.state]
            self._emit(role, "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str, copies: int) -> None:
        if self.audit is None:
            self.audit = "".join(self.pieces)
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = turn
            self.low, self.high = self.low if self.low is not None else turn, turn
        for _ in range(copies):
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == KEEP:
                self._emit(role, text)
                self.state = keeps(self.state, INITIALS.find(role[:1]) if role else 3)
            elif edit == REROLE:
                given, self.state = WANTED[self.state]
                self._emit(given, text)

    def result(self) -> tuple:
        if self.audit is None:
            self.audit = "".join(self.pieces)
        self._inserts()
        kinds = b"".join(self.kinds)
        initials = bytes(k & 3 for k in kinds)
        legal = sum((a, b) in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))
        faults = [k >> 2 for k in kinds]
        kept = (e for e in self.audit if e != INSERT)
        cost = 2 * self.audit.count(DELETE) + 5 * self.audit.count(INSERT) \
            + self.audit.count(REROLE) + 5 * sum(
                f == TRUNCATED and e != DELETE for f, e in zip(faults, kept))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, faults.count(BLANK), faults.count(DUPLICATE),
                faults.count(TRUNCATED), max(0, len(kinds) - 1) - legal, cost, self.audit,
                self.hash.hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conv_id, after the damage."""

    return audited(damaged(conversations), conversations.select("conv_id").distinct())


def audited(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The same for `rows` (conv_id, turn, role, text, copies) as they are; `conversations` names the
    ids, with or without rows."""

    facts, _ = settle(_facts(rows), "repair-facts")
    solved = _solved(_blocks(_kinds(facts)))
    kind = dict(conversations.dtypes)["conv_id"]
    heads = solved.unionByName(conversations.select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("number"),
        F.lit(b"").alias("kinds"), F.lit("").alias("edits")))
    stream = heads.withColumn("is_row", F.lit(False)).unionByName(rows.select(
        "conv_id", F.lit(True).alias("is_row"), F.col("turn").isNotNull().alias("has_turn"), "turn",
        "role", F.sha2("text", 256).alias("digest"), "text", "copies"), allowMissingColumns=True)
    order = ("conv_id", "is_row", "part", "number", "has_turn", "turn", "role", "digest")
    result = ", ".join([f"conv_id {kind}", *[f"{c} bigint" for c in COLUMNS], "audit string",
                        "repaired_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done = None, []

        def made(conv_type: pa.DataType) -> pa.RecordBatch:
            kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv_id", *COLUMNS, "audit", "repaired_sha256"]
            columns = list(zip(*done)) if done else [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        conv_type = None
        for batch in batches:
            conv_type = batch.column(0).type
            for part in byte_slices(batch, 6, TEXT_BYTES):
                for conv, is_row, kinds, edits, turn, role, text, copies in zip(
                        *[c.to_pylist() for c in part.columns]):
                    if reader is None or conv != reader.conv:
                        if reader is not None:
                            done.append(reader.result())
                        reader = Reader(conv)
                    if is_row:
                        reader.row(turn, role, text, copies)
                    else:
                        reader.block(edits, kinds)
                yield made(conv_type)
        if reader is not None:
            done.append(reader.result())
            yield made(conv_type)

    return stream.repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "is_row", "kinds", "edits", "turn", "role", "text", "copies").mapInArrow(run, result)
