"""Repair of the role structure of conversations at the least cost, decided by integers alone.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits of its rows, in order: keep (0),
rerole to user or assistant (1), delete (2; the only edit of a blank or duplicate row), insert an empty
user or assistant row anywhere (5); a truncated row that isn't deleted costs 5 more. The cheapest edits win, and
among them those whose initials (the audit) are least in ASCII.

Both are one number: the cost in the high digits, the letters of the audit in the low ones, in base
``1 << DIGIT`` at fixed places from the top and with zeros behind the last one. Of two such numbers the
smaller one is the cheaper, or the earlier in ASCII. The graph has a node for each row and state of the
pattern; from the last row backwards every node takes the smallest of its edges' numbers, an
edge adding its cost on top and its letter in front. The audit is read off the digits of the result, and
the repaired rows off the audit. Nothing else decides or is remembered.

Rows are dealt by ranges of (conversation, turn, role, digest of the text) and sorted, so a long
conversation lies in many tasks. Copies are counted before they are shuffled. Which row of a (role, text) comes
first is found by aggregation of narrow rows, which are dealt and sorted with the texts. A conversation in
one task and block is decided there. Of others every block of ``BLOCK`` items becomes the small table of its
numbers from each state to each other one: the costs and the order of the audits from one state are all
that the blocks' own DAG needs, which runs over a block a step, in one stream a conversation. Two paths through
a block that end in different states never have audits of which one begins the other, since only the end of the
conversation inserts behind its last row; so their order doesn't depend on what follows. Blocks
then decode their part, and one stream a conversation hashes the parts, since SHA-256 has no other way.

Defined cases: null values are one blank; a null conversation is one of its own; rows of equal turn are ordered by role,
then by a digest of the text; rows equal in all are copies, of which the first may stay; roles other
than system, user and assistant count by their initial, one without initial can't be kept; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirflow.llm.tables import stored

#: Bits of one audit letter, and the letters as digits (fixed values, in ASCII order).
DIGIT = 3
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Items (rows, or runs of copies) of a block, and the bytes of text after which it ends earlier.
BLOCK = 64
BLOCK_BYTES = 1 << 20

#: States: nothing yet, after s, after u, after a. Next state by the initial of an added row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role that an inserted or reroled row can have in each state.
ADDED = ("user", "user", "assistant", "user")
ACCEPTED = (START, ASSISTANT)

BLANKS = " \t\n\x0b\x0c\r"


@dataclass
class Item:
    """A row that may have edits; ``copies`` rows equal to it are deleted behind it."""

    role: str
    text: str
    fault: int
    copies: int = 0


def _width(items: int) -> int:
    return 3 * items + 2


def solve(items: list[Item], end: dict[int, int], width: int) -> list[int | None]:
    """The least number from each state to the end: ``end`` gives those behind the last row."""
    top = DIGIT * width
    low = (1 << top) - 1

    def behind(cost: int, letter: int, number: int | None) -> int | None:
        """The number of an edge in front of a path."""
        if number is None:
            return None
        return (((number >> top) + cost) << top) + (letter << (top - DIGIT)) + ((number & low) >> DIGIT)

    def least(*numbers: int | None) -> int | None:
        return min((n for n in numbers if n is not None), default=None)

    after = [end.get(s) for s in range(4)]
    for item in reversed(items):
        here: list[int | None] = []
        extra = TRUNCATED_COST if item.fault == TRUNCATED else 0
        for state in range(4):
            number = behind(COST[DELETE], DELETE, after[state])
            if item.fault not in (BLANK, DUPLICATE):
                kept = NEXT[state].get(item.role[:1])
                if kept is not None:
                    number = least(number, behind(COST[KEEP] + extra, KEEP, after[kept]))
                added = NEXT[state][ADDED[state][0]]
                number = least(number, behind(COST[REROLE] + extra, REROLE, after[added]))
            here.append(number)
        # up to two rows inserted in front: a third one would come back to the state after the first
        once = [behind(COST[INSERT], INSERT, here[NEXT[s][ADDED[s][0]]]) for s in range(4)]
        twice = [behind(COST[INSERT], INSERT, once[NEXT[s][ADDED[s][0]]]) for s in range(4)]
        after = [least(*numbers) for numbers in zip(here, once, twice)]
    return after


def endings(width: int) -> dict[int, int]:
    """Numbers of the rows that complete the pattern behind the last row."""
    top, one = DIGIT * width, COST[INSERT]
    first, second = INSERT << (top - DIGIT), INSERT << (top - 2 * DIGIT)
    return {START: 0, ASSISTANT: 0, USER: (one << top) + first, SYSTEM: (2 * one << top) + first + second}


def decode(number: int, width: int) -> list[int]:
    """The letters of the audit."""
    out, place = [], DIGIT * (width - 1)
    while place >= 0 and (letter := (number >> place) & ((1 << DIGIT) - 1)):
        out.append(letter)
        place -= DIGIT
    return out


def replay(items: list[Item], letters: list[int], state: int) -> tuple[str, list[str], int]:
    """(audit with the deleted copies, repaired lines, state at the end) of the edits from a state."""
    audit, lines, at = [], [], 0
    for letter in letters:
        audit.append(LETTERS[letter])
        if letter == INSERT:
            lines.append(ADDED[state] + ":")
            state = NEXT[state][ADDED[state][0]]
            continue
        item = items[at]
        if letter != DELETE:
            role = item.role if letter == KEEP else ADDED[state]
            lines.append(f"{role}:{item.text}")
            state = NEXT[state][role[:1]]
        audit.append("D" * item.copies)
        at += 1
    return "".join(audit), lines, state


def block_table(items: list[Item]) -> list[list[tuple[int, int] | None]]:
    """(cost, order of the audit among the ends) from each state to each other, nothing inserted at the end."""
    width = _width(len(items))
    columns = [solve(items, {end: 0}, width) for end in range(4)]
    copies = COST[DELETE] * sum(i.copies for i in items)
    low = (1 << DIGIT * width) - 1
    out = []
    for state in range(4):
        audits = sorted(columns[end][state] & low for end in range(4) if columns[end][state] is not None)
        out.append([
            None if n is None else ((n >> DIGIT * width) + copies, audits.index(n & low))
            for n in (columns[end][state] for end in range(4))
        ])
    return out


# ---------------------------------------------------------------- rows


@dataclass
class Tally:
    """Faults and turns of a stretch of rows in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first: str | None = None
    last: str | None = None

    NAMES = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last")

    def row(self, initial: str, turn: int | None, fault: int) -> None:
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self.join(Tally(turns=int(turn is not None), first_turn=turn, last_turn=turn, first=initial, last=initial))

    def join(self, other: Tally) -> None:
        """Add the tally of the rows that follow."""
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        self.first = other.first if self.first is None else self.first
        self.last = self.last if other.last is None else other.last
        self.turns += other.turns - int(other.first_turn is not None and self.last_turn == other.first_turn)
        self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
        self.last_turn = self.last_turn if other.last_turn is None else other.last_turn

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns

    def values(self) -> dict:
        return {name: getattr(self, name) for name in self.NAMES}


@dataclass
class Block:
    """Rows of one conversation that stand together in one task."""

    conv: int | None
    items: list[Item] = field(default_factory=list)
    tally: Tally = field(default_factory=Tally)
    size: int = 0
    ended: bool = False

    def add(self, role: str, text: str, turn: int | None, fault: int, copies: int, first: bool) -> None:
        if fault != BLANK and not first:
            fault = DUPLICATE
        rest = BLANK if fault == BLANK else DUPLICATE
        initial = role[:1]
        self.tally.row(initial, turn, fault)
        if copies > 1:
            self.tally.join(Tally(
                blank=(copies - 1) * (rest == BLANK), duplicate=(copies - 1) * (rest == DUPLICATE),
                illegal=(copies - 2), first=initial, last=initial, turns=int(turn is not None), first_turn=turn, last_turn=turn,
            ))
        self.items.append(Item(role, text, fault, copies - 1))
        self.size += len(text)


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)
TALLY = (
    "struct<blank: long, duplicate: long, truncated: long, illegal: long, turns: long, "
    "first_turn: long, last_turn: long, first: string, last: string>"
)
BLOCKS = (
    f"conv_id long, part int, number long, whole boolean, tally {TALLY}, cost long, audit string, digest string, lines array<string>, "
    "edges array<struct<cost: long, rank: int>>, items array<struct<role: string, text: string, fault: int, copies: long>>"
)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def marked_rows(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, fault, copies, first, h`` ready to be dealt and sorted.

    ``rows`` has conv_id, turn, role, text; ``gone`` marks rows that only say that their conversation exists. Rows with ``first``
    say at which place a (role, text) occurs first; they stand in front of that row.
    """
    one = rows.where("NOT gone").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    )
    h = F.unhex(F.sha2(F.col("text"), 256))
    one = one.select("conv_id", "turn", "role", h.alias("h"), "text", fault.alias("fault"), "copies")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = rows.where("NOT gone").groupBy("conv_id", "role", h.alias("h")).agg(F.min(place)["turn"].alias("turn"))
    exists = rows.groupBy("conv_id").agg(F.lit(1).alias("x"))
    return (
        one.withColumn("tag", F.lit(2))
        .unionByName(firsts.withColumn("tag", F.lit(1)), allowMissingColumns=True)
        .unionByName(exists.select("conv_id", F.lit(0).alias("tag")), allowMissingColumns=True)
    )


def blocks_of(rows: DataFrame, block: int = BLOCK, lines_wanted: bool = False) -> DataFrame:
    """Whole conversations with their repair (its digest, or its lines where wanted), and the blocks of those that lie in several tasks or blocks."""
    key = ["conv_id", "turn", "role", "h"]
    dealt = marked_rows(rows).repartitionByRange(*key).sortWithinPartitions(*key, "tag").withColumn("part", F.spark_partition_id())
    schema = _arrow(BLOCKS, rows.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        part, number, now, first_key = 0, 0, None, None

        def close(here: Block, conv_ends: bool, conv_began: bool) -> None:
            nonlocal number
            row = {"conv_id": here.conv, "part": part, "number": number, "whole": conv_began and conv_ends, "tally": here.tally.values()}
            number += 1
            if row["whole"]:
                width = _width(len(here.items))
                least = solve(here.items, endings(width), width)[START]
                audit, lines, _ = replay(here.items, decode(least, width), START)
                row |= {"cost": (least >> DIGIT * width) + COST[DELETE] * sum(i.copies for i in here.items), "audit": audit}
                if lines_wanted:
                    row["lines"] = lines
                else:
                    row["digest"] = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
            else:
                edges = [e for line in block_table(here.items) for e in line]
                row["edges"] = [None if e is None else {"cost": e[0], "rank": e[1]} for e in edges]
                row["items"] = [{"role": i.role, "text": i.text, "fault": i.fault, "copies": i.copies} for i in here.items]
            out.append(row)

        def flush() -> pa.RecordBatch:
            ready = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return ready

        began = False  # whether the conversation began in this task, in the open block, for certain
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                if now is None or row["conv_id"] != now.conv:
                    if now is not None:
                        close(now, True, began)
                    # only the row that says that a conversation exists is its first one
                    began = row["tag"] == 0
                    now, first_key = Block(row["conv_id"]), None
                if row["tag"] == 1:
                    first_key = (row["turn"], row["role"], row["h"])
                elif row["tag"] == 2:
                    if len(now.items) >= block or now.size > BLOCK_BYTES:
                        close(now, False, began)
                        began, now = False, Block(row["conv_id"])
                    at = (row["turn"], row["role"], row["h"])
                    now.add(row["role"], row["text"], row["turn"], row["fault"], row["copies"], at == first_key)
                if len(out) >= 256:
                    yield flush()
        if now is not None:
            close(now, False, began)  # it may go on in the next task
        yield flush()

    return dealt.mapInArrow(cut, BLOCKS)


def _streams(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")


def _chained(blocks: DataFrame) -> DataFrame:
    """``part, number, entry, leave`` of every block, the conversation's columns in its last block."""
    schema = (
        "conv_id long, part int, number long, entry int, leave int, last boolean, gaps long, blank long, duplicate long, "
        "truncated long, illegal long, cost long"
    )
    kind = _arrow(schema, blocks.sparkSession)

    def solve_chain(conv: int | None, chain: list[dict]) -> list[dict]:
        tally = Tally()
        for row in chain:
            tally.join(Tally(**row["tally"]))
        after: list[int | None] = [0, 2 * COST[INSERT], COST[INSERT], 0]
        choices = []
        for row in reversed(chain):
            here, chosen = [], []
            for state in range(4):
                ways = [
                    (e["cost"] + after[end], e["rank"], end)
                    for end, e in enumerate(row["edges"][4 * state : 4 * state + 4]) if e is not None and after[end] is not None
                ]
                best = min(ways, default=(None, None, None))
                here.append(best[0])
                chosen.append(best[2])
            after = here
            choices.append(chosen)
        state, out = START, []
        for row, chosen in zip(chain, reversed(choices)):
            leave = chosen[state]
            out.append({"conv_id": conv, "part": row["part"], "number": row["number"], "entry": state, "leave": leave, "last": False})
            state = leave
        out[-1] |= {
            "last": True, "gaps": tally.gaps, "blank": tally.blank, "duplicate": tally.duplicate,
            "truncated": tally.truncated, "illegal": tally.illegal, "cost": after[START],
        }
        return out

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if chain and chain[0]["conv_id"] != row["conv_id"]:
                    out += solve_chain(chain[0]["conv_id"], chain)
                    chain = []
                chain.append(row)
            yield pa.RecordBatch.from_pylist(out, kind)
        if chain:
            yield pa.RecordBatch.from_pylist(solve_chain(chain[0]["conv_id"], chain), kind)

    narrow = blocks.select("conv_id", "part", "number", "tally", "edges")
    return _streams(narrow).mapInArrow(chains, schema)


def _decoded(blocks: DataFrame, chained: DataFrame) -> DataFrame:
    """``audit`` and ``lines`` of every block of a chain, from the states it is entered and left in."""
    schema = (
        "conv_id long, part int, number long, last boolean, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, lines array<string>"
    )
    kind = _arrow(schema, blocks.sparkSession)
    joined = chained.join(blocks.select("part", "number", "items"), ["part", "number"])

    def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                items = [Item(**i) for i in row.pop("items")]
                width, leave = _width(len(items)), row.pop("leave")
                number = solve(items, {leave: 0}, width)[row["entry"]]
                audit, lines, _ = replay(items, decode(number, width), row.pop("entry"))
                if row["last"]:
                    for state in [leave] if leave == USER else [SYSTEM, USER] if leave == SYSTEM else []:
                        audit += LETTERS[INSERT]
                        lines.append(ADDED[state] + ":")
                out.append(row | {"audit": audit, "lines": lines})
            yield pa.RecordBatch.from_pylist(out, kind)

    return joined.mapInArrow(decode_blocks, schema)


def _hashed(decoded: DataFrame) -> DataFrame:
    """The result of every conversation in several blocks: parts in order, texts only streamed."""
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    kind = _arrow(RESULT, decoded.sparkSession)

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, begun = [], hashlib.sha256(), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit.append(row["audit"])
                for line in row["lines"]:
                    digest.update(("\n" * begun + line).encode("utf-8", "surrogatepass"))
                    begun = True
                if row["last"]:
                    row |= {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    out.append({name: row[name] for name in names})
                    audit, digest, begun = [], hashlib.sha256(), False
            yield pa.RecordBatch.from_pylist(out, kind)

    return _streams(decoded).mapInArrow(join_parts, RESULT)


def repair_report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows of every conversation.

    ``rows`` has conv_id, turn, role, text without nulls in the last two, and ``gone``.
    """
    cut = stored(blocks_of(rows, block), "repair-blocks")
    tally = F.col("tally")
    gaps = F.when(tally["first_turn"].isNull(), 0).otherwise(tally["last_turn"] - tally["first_turn"] + 1 - tally["turns"])
    whole = cut.where("whole").select(
        "conv_id", gaps.cast("long").alias("gaps"), *[tally[c].alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        "cost", "audit", F.col("digest").alias("repaired_sha256"),
    )
    open_ = cut.where("NOT whole")
    chained = stored(_chained(open_), "repair-chains")
    return whole.unionByName(_hashed(_decoded(open_, chained)))


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, part, number, lines``: the repaired rows as ``role:text``, in order of part and number."""
    cut = stored(blocks_of(rows, block, lines_wanted=True), "repair-blocks")
    open_ = cut.where("NOT whole")
    chained = stored(_chained(open_), "repair-chains")
    columns = ["conv_id", "part", "number", "lines"]
    return cut.where("whole").select(*columns).unionByName(_decoded(open_, chained).select(*columns))


def given(conversations: DataFrame) -> DataFrame:
    """``conversations`` as rows to repair, undamaged."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that the CRC of conversation and turn chooses: some dropped, emptied, cut, repeated, reroled."""
    rows = given(conversations)
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (kind == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
