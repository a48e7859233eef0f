"""Conversation structure repair by Four-Russians block tables.

A conversation is valid if its role initials are ``(s?(ua)+)?``. It is repaired by the cheapest edits: keep a turn (0), delete it (4; blank and
repeated turns must go), let user or assistant say it instead (3), insert an empty user or assistant turn (3); a truncated turn
that stays adds 3. Of equally cheap scripts the first by ASCII order of the edits' initials (D, I, K, R) is taken.

Each turn is one of nine symbols. The cost of repairing the rest of a conversation, from each of the four places in the pattern (start, after s,
after u, after a), is a vector; less its minimum it is one of a few. For every such vector and every block of ``BLOCK`` symbols a table
holds the vector before the block and what was taken off. A conversation goes through the table from its end to its start, a lookup per block.
Scripts are traced forwards: each block is expanded backwards from the vector after it, and every turn takes the first
letter that costs no more than the vector says.

Turns are taken by turn number (nulls first), role and text. They are dealt out by conversation and sorted; a task reads them as a stream and keeps
a byte for each turn of one conversation, and never a text: the script comes back as a row that sorts before its turns, which are
then edited, or hashed, one by one. So a conversation of any length is repaired exactly; its turns pass one task in order, as its hash and its script
need.

Defined results: a null role or text is one space, a null conv_id or turn is one in what decides the damage; a null conv_id is a conversation;
an empty conversation is valid; roles count by their first character and a kept turn keeps its role; rows repeated in one conversation are duplicates;
``gaps`` beyond 64 bits are the largest long; extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.common import keep

BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
STATES, FAR = 4, 10**6  # start, after s, after u, after a
NEXT = (2, 2, 3, 2)  # where a user or assistant turn leads
ROLE = ("user", "user", "assistant", "user")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
KINDS = ("s", "u", "a", "")  # initials; the last stands for all others
SYMBOLS = 1 + 2 * len(KINDS)  # must go; of each kind, whole or truncated
LONGEST = 2**63 - 1

Vector = tuple[int, ...]


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    return 0 if must_go else 1 + 2 * (KINDS.index(initial) if initial in KINDS else len(KINDS) - 1) + truncated


def with_inserts(v: list[int]) -> Vector:
    """Each place may be left by insertions first."""
    for state in (2, 3, 2, 0, 1):
        v[state] = min(v[state], INSERT + v[NEXT[state]])
    return tuple(v)


def edits(after: Vector, sym: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a turn: letter, cost with the rest, next state."""
    out = [("D", DELETE + after[state], state)]
    if sym:
        kind, late = KINDS[(sym - 1) // 2], TRUNCATED * ((sym - 1) % 2)
        if state in KEPT.get(kind, {}):
            to = KEPT[kind][state]
            out.append(("K", late + after[to], to))
        out.append(("R", REROLE + late + after[NEXT[state]], NEXT[state]))
    return out


def before(after: Vector, sym: int) -> Vector:
    return with_inserts([min(cost for _, cost, _ in edits(after, sym, s)) for s in range(STATES)])


END = with_inserts([0, FAR, FAR, 0])


class Tables:
    """``vectors``, and for a block of symbols (first symbol highest) and the vector after it, the vector before it and its cost."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block, self.vectors = block, [END]
        number, ones = {END: 0}, []
        for v in self.vectors:  # grows until no new vector appears
            row = []
            for s in range(SYMBOLS):
                raw = before(v, s)
                low = min(raw)
                normal = tuple(x - low for x in raw)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((number[normal], low))
            ones.append(row)
        first = np.array([[r[0] for r in row] for row in ones])
        cost = np.array([[r[1] for r in row] for row in ones])
        to, paid = first, cost
        for _ in range(block - 1):  # a symbol in front of all shorter blocks
            paid = (paid[:, None, :] + cost[to].transpose(0, 2, 1)).reshape(len(first), -1)
            to = first[to].transpose(0, 2, 1).reshape(len(first), -1)
        self.first, self.cost1 = first.tolist(), cost.tolist()
        self.size = SYMBOLS**block
        self.to, self.paid = to.astype(np.uint16).ravel(), paid.astype(np.uint16).ravel()
        self.powers = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.traced = [[[self._trace(v, s, q) for q in range(STATES)] for s in range(SYMBOLS)] for v in range(len(self.vectors))]

    def _trace(self, after: int, sym: int, state: int) -> tuple[str, int]:
        """The letters up to and with the turn's own, and the state behind it."""
        v, raw, letters = self.vectors[after], before(self.vectors[after], sym), ""
        while True:
            own = {letter: to for letter, cost, to in edits(v, sym, state) if cost == raw[state]}
            inserted = raw[state] == INSERT + raw[NEXT[state]]
            best = min([*own, *(["I"] if inserted else [])])
            letters += best
            if best != "I":
                return letters, own[best]
            state = NEXT[state]

    def script(self, symbols: bytes) -> tuple[int, str]:
        """Cost and letters of the cheapest edits."""
        n, b = len(symbols), self.block
        whole = n // b
        codes = (np.frombuffer(symbols, np.uint8)[: whole * b].reshape(whole, b).astype(np.int64) @ self.powers).tolist()
        after, cost = bytearray(2 * (whole + 1)), 0  # vectors at the ends of blocks, two bytes each
        v = 0
        for i in range(n - 1, whole * b - 1, -1):
            cost += self.cost1[v][symbols[i]]
            v = self.first[v][symbols[i]]
        after[2 * whole], after[2 * whole + 1] = v & 255, v >> 8
        for j in range(whole - 1, -1, -1):
            at = v * self.size + codes[j]
            cost += int(self.paid[at])
            v = int(self.to[at])
            after[2 * j], after[2 * j + 1] = v & 255, v >> 8
        cost += self.vectors[v][0]
        letters, state = [], 0
        for j in range(whole + 1):
            start, end = j * b, min(n, j * b + b)
            inside = [after[2 * j + 2] | after[2 * j + 3] << 8 if j < whole else 0]
            for i in range(end - 1, start, -1):
                inside.append(self.first[inside[-1]][symbols[i]])
            for i in range(start, end):
                text, state = self.traced[inside[end - 1 - i]][symbols[i]][state]
                letters.append(text)
        letters.append("I" * (END[state] // INSERT))
        return cost, "".join(letters)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``gone`` of damaged conversations: by ``crc32(conv_id:turn) % 20``, 0 drops a row (it is only marked
    ``gone``, as its conversation still counts), 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    told = rows.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (way == 0).alias("gone"), F.when(way == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    )
    return told.withColumn("times", F.explode("times")).drop("times")


def whole(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the columns of ``damaged``."""
    return rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("gone"))


def truncated(text: Column) -> Column:
    return ~F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1).isin(".", "!", "?")


def batches_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Seen:
    """What is kept of one conversation while its turns pass."""

    def __init__(self) -> None:
        self.counts, self.symbols = dict.fromkeys(FIGURES, 0), bytearray()
        self.low = self.high = self.last = None
        self.turns, self.initial = 0, None

    def add(self, turn: int | None, initial: str, is_blank: bool, again: bool, is_truncated: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        fault = "blank" if is_blank else "duplicate" if again else "truncated" if is_truncated else None
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        self.symbols.append(symbol(initial, is_blank or again, is_truncated))

    def done(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        cost, letters = tables().script(bytes(self.symbols))
        return tuple((self.counts | {"gaps": min(gaps, LONGEST), "cost": cost})[f] for f in FIGURES) + (letters,)


def planned(schema: pa.Schema):
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted turns to one row for each conversation: figures and script."""
        key, now, out = None, None, []
        for conv, turn, initial, is_blank, place, is_truncated, gone in streamed(batches):
            if now is None or conv != key:
                if now is not None:
                    out.append((key, *now.done()))
                key, now = conv, Seen()
                if len(out) >= 1000:
                    yield batches_of(out, schema)
                    out = []
            if not gone:
                now.add(turn, initial, is_blank, place > 1, is_truncated)
        if now is not None:
            out.append((key, *now.done()))
        yield batches_of(out, schema)

    return plan


def plans(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, cost and ``audit``, the initials of the cheapest edits."""
    id_type = turns.schema["conv_id"].dataType
    dealt = turns.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn"))  # in the same task, as a stream
    blank = F.rtrim("text", F.lit(SPACES)) == ""
    ordered = dealt.withColumn("place", again).sortWithinPartitions("conv_id", "turn", "role", "text", "place")
    seen = ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), "place", truncated(F.col("text")).alias("cut"), "gone")
    out = f"conv_id {id_type.simpleString()}, {', '.join(f'{f} long' for f in FIGURES)}, audit string"
    schema = pa.schema([("conv_id", arrow_type(id_type)), *[(f, pa.int64()) for f in FIGURES], ("audit", pa.string())])
    return seen.mapInArrow(planned(schema), out)


def arrow_type(id_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(id_type)


class Replay:
    """Applies a script to turns that come one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLE[self.state], ""
            self.state, self.at = NEXT[self.state], self.at + 1

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = KEPT[role[:1]][self.state]
            yield role, text
        elif letter == "R":
            yield ROLE[self.state], text
            self.state = NEXT[self.state]


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Scripts, each before its turns, to (conversation, None) where one starts and (conversation, (role, text)) for each repaired turn."""
    key, now = None, None
    for conv, audit, role, text in streamed(batches):
        if audit is not None:
            if now is not None:
                yield from ((key, t) for t in now.inserted())
            key, now = conv, Replay(audit)
            yield key, None
        else:
            yield from ((key, t) for t in now.turn(role, text))
    if now is not None:
        yield from ((key, t) for t in now.inserted())


def with_scripts(turns: DataFrame, scripts: DataFrame) -> DataFrame:
    """Turns behind the script of their conversation, as ``replayed`` reads them."""
    said = turns.where("NOT gone").select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("later"), "turn", "role", "text")
    both = scripts.select("conv_id", "audit", F.lit(0).alias("later")).unionByName(said, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "later", "turn", "role", "text").select("conv_id", "audit", "role", "text")


def repaired(turns: DataFrame, scripts: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``turn`` (from 0), ``role``, ``text``."""
    id_type = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", arrow_type(id_type)), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, out = 0, []
        for conv, said in replayed(batches):
            turn = 0 if said is None else turn
            if said is not None:
                out.append((conv, turn, *said))
                turn += 1
            if len(out) >= 500:
                yield batches_of(out, schema)
                out = []
        yield batches_of(out, schema)

    return with_scripts(turns, scripts).mapInArrow(edited, f"conv_id {id_type.simpleString()}, turn long, role string, text string")


def hashes(turns: DataFrame, scripts: DataFrame) -> DataFrame:
    """``conv_id``, ``repaired_sha256`` of the repaired turns as ``role:text``, joined by line feeds."""
    id_type = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", arrow_type(id_type)), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, first, out = None, None, True, []
        for conv, said in replayed(batches):
            if said is None:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, first = conv, hashlib.sha256(), True
                if len(out) >= 1000:
                    yield batches_of(out, schema)
                    out = []
            else:
                digest.update(("" if first else "\n").encode() + ":".join(said).encode("utf-8", "surrogatepass"))
                first = False
        if digest is not None:
            out.append((key, digest.hexdigest()))
        yield batches_of(out, schema)

    return with_scripts(turns, scripts).mapInArrow(hashed, f"conv_id {id_type.simpleString()}, repaired_sha256 string")


def digest(turns: DataFrame) -> DataFrame:
    """Faults, script and hash of every conversation."""
    scripts = keep(plans(turns), "turn-scripts")
    hashed = hashes(turns, scripts).withColumnRenamed("conv_id", "id")
    return scripts.join(hashed, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", *FIGURES, "audit", "repaired_sha256")


def report(rows: DataFrame) -> DataFrame:
    return digest(damaged(rows.select("conv_id", "turn", "role", "text")))
