"""Repair of conversation structure: messages become symbols, symbols a Re-Pair grammar, rules min-plus matrices.

1. Messages are put in order by range, so that a conversation of any length is spread over many
   tasks, and cut into blocks of bounded length. A block is a string of symbols (role and fault).
2. Re-Pair runs over the distinct blocks: in each round the most frequent pairs that do not overlap
   become new symbols. Only the best pairs of a round reach the driver.
3. Each rule's matrix is the product of its two symbols' matrices, made once and shared by all blocks.
4. A conversation of one block has its result by then. Blocks of longer ones are joined by a tree: costs
   go up, the cheapest costs to the end come down, then the states in which the blocks begin.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.llm.grammar import (
    ANSWER, FAULTS, FIRST, INITIALS, LEGAL, START, STATES, SYSTEM, TERMINALS, USER,
    Part, disjoint, ending, evaluate, folded, pair_counts, replaced,
)
from passages.operators.ordering import dense_position
from passages.session import broadcast_if_small
from passages.sources.tables import stage

BLOCK = 1_024  # messages in a block
FAN = 256  # blocks or groups of blocks joined at once
RULES = 1_024  # rules of the grammar; what is left over is multiplied block by block
BATCH = 64  # pairs that a round considers
GAIN = 0.02  # rounds go on while they shorten the blocks by this share

BLANKS = " \t\n\x0b\x0c\r"
NONE = 1 << 40  # cost of what can't be


@dataclass(frozen=True)
class Repairs:
    """What to do: ``blocks`` (id, no, at, role, tie, edits) in order of ``no`` and ``totals`` by conversation."""

    messages: DataFrame
    blocks: DataFrame
    totals: DataFrame


def read_messages(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(id, at, role, text) of ``rows`` (conversation, turn, role, text). Null roles and texts are one blank."""
    return rows.select(
        F.struct(F.col(conversation).alias("key")).alias("id"), F.struct("turn").alias("at"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )


def _letter(initial: Column, fault: Column) -> Column:
    """Letter of a message's symbol."""
    place = F.instr(F.lit(INITIALS), initial)
    place = F.when((F.length(initial) == 1) & (place > 0), place - 1).otherwise(len(INITIALS) - 1)
    return F.char(F.lit(FIRST) + place * len(FAULTS) + F.array_position(F.lit(FAULTS), fault).cast("int") - 1)


def _ordered(messages: DataFrame) -> DataFrame:
    """(id, at, role, tie, head, rest, n): equal messages of a turn as one row, with the first one's letter and the others'.

    ``tie`` holds the text where several texts of one turn have one role, and is null elsewhere.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(trimmed == "", "blank").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    digest = F.unhex(F.sha2("text", 256))
    grouped = stage(
        messages.groupBy("id", "at", "role", digest.alias("digest"), fault.alias("fault")).agg(F.count(F.lit(1)).alias("n")),
        "messages",
    )
    again = (
        grouped.groupBy("id", "role", "digest")
        .agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("turns"))
        .where("turns > 1").drop("turns")
    )
    tied = stage(grouped.groupBy("id", "at", "role").count().where("count > 1").drop("count"), "tied")
    rows = grouped.join(again, ["id", "role", "digest"], "left")
    if tied.isEmpty():
        rows = rows.withColumn("tie", F.lit(None).cast("string"))
    else:
        texts = messages.join(tied, ["id", "at", "role"], "left_semi").groupBy("id", "at", "role", digest.alias("digest"))
        rows = rows.join(texts.agg(F.min("text").alias("tie")), ["id", "at", "role", "digest"], "left")
    initial = F.substring("role", 1, 1)
    blank, later = F.col("fault") == "blank", F.coalesce(F.col("first_at") != F.col("at"), F.lit(False))
    repeated = F.when(blank, "blank").otherwise("duplicate")
    head = F.when(~blank & later, "duplicate").otherwise(F.col("fault"))
    return rows.select(
        "id", "at", "role", "tie", _letter(initial, head).alias("head"), _letter(initial, repeated).alias("rest"), "n"
    )


def _blocks(ordered: DataFrame, block: int) -> DataFrame:
    """(id, part, piece, at, role, tie, letters): runs of at most ``block`` messages, with their first message's place.

    Rows are dealt by ranges of their place, so a long conversation lies in several parts, in order.
    """
    place = ["id", "at", "role", "tie"]
    schema = _with(ordered.select(*place), "part int, piece bigint, letters string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        first, letters, size = None, [], 0
        for batch in batches:
            out: list[tuple] = []
            heads, rests, counts = (batch.column(c).to_pylist() for c in ("head", "rest", "n"))
            rows = list(zip(*(batch.column(c).to_pylist() for c in place), strict=True))
            for row, head, rest, n in zip(rows, heads, rests, counts, strict=True):
                if first is not None and (first[0] != row[0] or size == block):
                    out.append((*first, part, piece, "".join(letters)))
                    first, letters, size, piece = None, [], 0, piece + 1
                while n:
                    if size == block:
                        out.append((*first, part, piece, "".join(letters)))
                        first, letters, size, piece = None, [], 0, piece + 1
                    first = first or row
                    some = 1 if head else min(n, block - size)
                    letters.append(head or rest * some)
                    head, size, n = "", size + some, n - some
                    if len(out) >= 4096:
                        yield _batch(out, batch.schema, place)
                        out = []
            if out:
                yield _batch(out, batch.schema, place)
        if first is not None:
            yield _batch([(*first, part, piece, "".join(letters))], batch.schema, place)

    spread = ordered.repartitionByRange(*place).sortWithinPartitions(*place)
    return stage(spread.mapInArrow(cut, schema), "blocks")


def _with(df: DataFrame, columns: str) -> T.StructType:
    """Schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])


def _batch(rows: list[tuple], schema: pa.Schema, place: list[str]) -> pa.RecordBatch:
    kinds = [schema.field(c).type for c in place] + [pa.int32(), pa.int64(), pa.string()]
    columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [*place, "part", "piece", "letters"])


def learn_rules(shapes: DataFrame, rules: int = RULES, batch: int = BATCH) -> tuple[list[tuple[int, int]], DataFrame]:
    """Re-Pair over distinct blocks ``shapes`` (letters): the rules, and (letters, codes) rewritten by them.

    A round counts all pairs of all blocks, takes the most frequent ones that occur at least twice and can
    be replaced together, and rewrites the blocks. Results do not depend on where it stops, only work does.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            codes = [[ord(c) - FIRST for c in text] for text in rows.column("letters").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("letters"), pa.array(codes, pa.list_(pa.int32()))], ["letters", "codes"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            pairs = pair_counts([])
            for codes in rows.column("codes").to_pylist():
                pairs.update(pair_counts(codes))
            yield pa.RecordBatch.from_pylist(
                [{"a": a, "b": b, "n": n} for (a, b), n in pairs.items()],
                pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]),
            )

    learnt: list[tuple[int, int]] = []
    now = stage(shapes.mapInArrow(coded, "letters string, codes array<int>"), "shapes")
    size = now.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    while len(learnt) < rules:
        pairs = now.where(F.size("codes") > 1).mapInArrow(counted, "a int, b int, n bigint")
        best = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "a", "b").limit(batch).collect()
        chosen = disjoint((r.a, r.b) for r in best)[: rules - len(learnt)]
        if not chosen:
            break
        named = {pair: TERMINALS + len(learnt) + i for i, pair in enumerate(chosen)}
        learnt += chosen

        def rewrite(batches: Iterator[pa.RecordBatch], named: dict = named) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                codes = [replaced(c, named) for c in rows.column("codes").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("letters"), pa.array(codes, pa.list_(pa.int32()))], ["letters", "codes"])

        now = stage(now.mapInArrow(rewrite, "letters string, codes array<int>"), "shapes")
        before, size = size, now.agg(F.sum(F.size("codes"))).first()[0]
        if before - size < GAIN * before:
            break
    return learnt, now


def _whole(part: Part) -> tuple[int, str]:
    """Cost and edits of a conversation that is this one part."""
    found = []
    for state in (START, SYSTEM, USER, ANSWER):
        cell = part.cells[4 * START + state]
        if cell is not None:
            cost, edits = ending(state)
            found.append((cell[0] + cost, str(cell[1]) + edits))
    return min(found)


SHAPE = (
    "letters string, first string, last string, illegal bigint, truncated bigint, blank bigint, duplicate bigint, "
    "costs array<bigint>, cell_edits array<string>, cost bigint, audit string"
)


def _evaluated(coded: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Counts, matrix and, taken as a whole conversation, cost and edits of every distinct block."""
    parts = evaluate(rules)

    def evaluate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for letters, codes in zip(rows.column("letters").to_pylist(), rows.column("codes").to_pylist(), strict=True):
                p = folded(codes, parts)
                cost, audit = _whole(p)
                costs = [NONE if c is None else c[0] for c in p.cells]
                edits = [None if c is None else str(c[1]) for c in p.cells]
                out.append((letters, p.first, p.last, p.illegal, p.truncated, p.blank, p.duplicate, costs, edits, cost, audit))
            kinds = [pa.string()] * 3 + [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHAPE.split(", ")])

    return stage(coded.mapInArrow(evaluate_rows, SHAPE), "shape-parts")


def _up(nodes: DataFrame, join: Callable[[list], list], fan: int) -> list[DataFrame]:
    """Levels of (id, no, value), each the last one's values joined ``fan`` by ``fan``, up to one per id."""
    levels = [nodes]
    schema = nodes.schema

    def joined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("no")
        value = join(rows["value"].to_pylist())
        kinds = [rows.schema.field(c).type for c in ("id", "no", "value")]
        cells = zip((rows["id"][0].as_py(), key[1].as_py(), value), kinds, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in cells], ["id", "no", "value"])

    while levels[-1].agg(F.max("no")).first()[0]:
        above = levels[-1].withColumn("above", F.expr(f"no DIV {fan}"))
        levels.append(stage(above.groupBy("id", "above").applyInArrow(joined, schema), "level"))
    return levels


def _down(levels: list[DataFrame], given: list[int], push: Callable[[list, list], list], fan: int) -> DataFrame:
    """(id, no, given) of the lowest level: ``push`` deals a node's value out to those below it, from the top's."""
    now = levels[-1].select("id", "no", F.lit(given).cast("array<bigint>").alias("given"))
    schema = now.schema

    def dealt(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("no")
        values = push(rows["given"][0].as_py(), rows["value"].to_pylist())
        yield from pa.table({"id": rows["id"], "no": rows["no"], "given": pa.array(values, pa.list_(pa.int64()))}).to_batches()

    for level in levels[-2::-1]:
        above = level.withColumn("above", F.expr(f"no DIV {fan}")).join(now.withColumnRenamed("no", "above"), ["id", "above"])
        now = stage(above.groupBy("id", "above").applyInArrow(dealt, schema), "given")
    return now


def _product(left: list[int], right: list[int]) -> list[int]:
    return [min(min(left[4 * a + b] + right[4 * b + c] for b in STATES), NONE) for a in STATES for c in STATES]


def _joined_costs(values: list[list[int]]) -> list[int]:
    out = values[0]
    for v in values[1:]:
        out = _product(out, v)
    return out


def _costs_after(given: list[int], values: list[list[int]]) -> list[list[int]]:
    """Cheapest costs from the end of each block on, by the state there."""
    out = [given]
    for v in values[:0:-1]:
        out.append([min(min(v[4 * a + b] + out[-1][b] for b in STATES), NONE) for a in STATES])
    return out[::-1]


def _joined_moves(values: list[list[int]]) -> list[int]:
    out = list(STATES)
    for v in values:
        out = [v[s] for s in out]
    return out


def _states_before(given: list[int], values: list[list[int]]) -> list[list[int]]:
    out = [given]
    for v in values[:-1]:
        out.append([v[out[-1][0]]])
    return out


def _choose(costs: Column, edits: Column, after: Column, last: Column) -> Column:
    """By state before a block: the cheapest way's state after it and edits, ties by the edits."""
    ends = [ending(s) for s in STATES]
    ways = [
        F.array_min(F.array(*[
            F.struct(
                (F.get(costs, F.lit(4 * a + b)) + F.get(after, F.lit(b))).alias("cost"),
                F.concat(F.coalesce(F.get(edits, F.lit(4 * a + b)), F.lit("")), F.when(last, ends[b][1]).otherwise("")).alias("edits"),
                F.lit(b).cast("bigint").alias("state"),
            )
            for b in STATES
        ]))
        for a in STATES
    ]
    return F.array(*ways)


def _long(blocks: DataFrame, shapes: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with edits, and totals, of conversations of several blocks (id, no, ..., letters)."""
    rows = stage(blocks.join(broadcast_if_small(shapes.drop("cost", "audit")), "letters"), "long-blocks")
    lasts = rows.groupBy("id").agg(F.max("no").alias("last_no"))
    levels = _up(rows.select("id", "no", F.col("costs").alias("value")), _joined_costs, fan)
    after = _down(levels, [ending(s)[0] for s in STATES], _costs_after, fan)
    ways = _choose(F.col("costs"), F.col("cell_edits"), F.col("given"), F.col("no") == F.col("last_no"))
    ways = stage(rows.join(after, ["id", "no"]).join(lasts, "id").withColumn("ways", ways), "ways")
    moves = ways.select("id", "no", F.transform("ways", lambda w: w["state"]).alias("value"))
    before = _down(_up(moves, _joined_moves, fan), [START], _states_before, fan)
    way = F.get("ways", F.get("given", F.lit(0)).cast("int"))
    done = ways.drop("given").join(before, ["id", "no"]).select("id", "no", "at", "role", "tie", way["edits"].alias("edits"))
    best = levels[-1].select(
        "id", F.array_min(F.array(*[F.get("value", F.lit(b)) + ending(b)[0] for b in STATES])).alias("cost")
    )
    borders = rows.select("id", "no", "first").join(
        rows.select("id", (F.col("no") + 1).alias("no"), "last"), ["id", "no"]
    ).where(~F.concat("last", "first").isin(sorted(LEGAL))).groupBy("id").agg(F.count(F.lit(1)).alias("borders"))
    counts = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    totals = counts.join(best, "id").join(borders, "id", "left").withColumn("illegal", F.col("illegal") + F.coalesce("borders", F.lit(0)))
    return done, totals.select("id", "blank", "duplicate", "truncated", "illegal", "cost")


def plan_repairs(
    rows: DataFrame, conversation: str = "conv_id", block: int = BLOCK, rules: int = RULES, fan: int = FAN
) -> Repairs:
    """Cheapest edits that give every conversation of ``rows`` (conversation, turn, role, text) a legal order of roles.

    Messages are taken by turn (nulls first), then role, then text; repeated rows follow each other. Null
    roles and texts count as one blank, null conversations are one conversation. Legal are no messages, or
    an optional system message and then pairs of user and assistant, judged by the roles' first letters;
    an empty role has none. Blank messages (white space only) and duplicates (role and text seen earlier)
    are deleted at 4; others may be kept at 0, given the role user or assistant at 3 or deleted at 4;
    empty messages are inserted at 3; a message kept or given a role costs 3 more if its last character
    is none of ``.!?``. Edits are a string of K, R, D and I; of the cheapest the least in ASCII.

    ``totals`` has id, blank, duplicate, truncated and illegal counts (first fault each; neighbours with
    illegal initials), cost, and gaps: missing turns between the least and the largest, 0 if all are null.
    An empty table has no conversations. Other columns are ignored.
    """
    messages = read_messages(rows, conversation)
    blocks = _blocks(_ordered(messages), block)
    learnt, coded = learn_rules(blocks.select("letters").distinct(), rules)
    shapes = _evaluated(coded, learnt)
    many = stage(blocks.groupBy("id").count().where("count > 1").drop("count"), "long-ids")
    counted = ["blank", "duplicate", "truncated", "illegal", "cost"]
    place = ["id", "at", "role", "tie"]
    short = blocks if many.isEmpty() else blocks.join(broadcast_if_small(many), "id", "left_anti")
    parts = short.join(broadcast_if_small(shapes.select("letters", *counted, "audit")), "letters")
    done = parts.select("id", F.lit(0).cast("bigint").alias("no"), "at", "role", "tie", F.col("audit").alias("edits"))
    totals = parts.select("id", *counted)
    if not many.isEmpty():
        # Parts and pieces follow the order, so a block's place counts blocks, part by part.
        long = dense_position(
            blocks.join(broadcast_if_small(many), "id", "left_semi"), ["id"], {"own_part": F.col("part")}, ["piece"], "no"
        )
        more, sums = _long(long.select("no", *place, "letters"), shapes, fan)
        done, totals = done.unionByName(more), totals.unionByName(sums)
    turn = F.col("at")["turn"]
    span = messages.groupBy("id").agg(F.max(turn).alias("high"), F.min(turn).alias("low"), F.countDistinct(turn).alias("turns"))
    wide = F.col("high").cast("decimal(38,0)") - F.col("low") + 1 - F.col("turns")
    gaps = span.select("id", F.coalesce(wide, F.lit(0)).try_cast("bigint").alias("gaps"))
    return Repairs(messages, stage(done, "repairs"), stage(totals.join(gaps, "id"), "repair-totals"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, edit, role, text) of every message left or inserted, from messages and edits sorted together.

    A block's edits come before its first message, so those at hand are always enough.
    """
    own: object = None
    state, edits, started = START, deque(), False
    inserted = {START: "user", SYSTEM: "user", USER: "assistant", ANSWER: "user"}
    after = {"s": SYSTEM, "u": USER, "a": ANSWER}

    def insertions() -> Iterator[tuple]:
        nonlocal state
        while edits and edits[0] == "I":
            edits.popleft()
            role = inserted[state]
            state = after[role[0]]
            yield own, "I", role, ""

    for batch in batches:
        columns = [batch.column(c) for c in ("id", "role", "text", "edits")]
        ids, roles, marks = columns[0].to_pylist(), columns[1], columns[3].to_pylist()
        for i, (key, mark) in enumerate(zip(ids, marks, strict=True)):
            if not started or key != own:
                yield from insertions()
                own, state, started = key, START, True
                edits.clear()
            if mark is not None:
                edits.extend(mark)
                continue
            yield from insertions()
            edit = edits.popleft()
            if edit == "D":
                continue
            role = roles[i].as_py() if edit == "K" else inserted[state]
            state = after[role[0]]
            yield own, edit, role, columns[2][i].as_py()
    yield from insertions()


def _in_order(repairs: Repairs) -> DataFrame:
    messages = repairs.messages.select("id", "at", "role", "text", F.lit(None).cast("bigint").alias("no"), F.lit(None).cast("string").alias("edits"))
    blocks = repairs.blocks.select("id", "at", "role", F.col("tie").alias("text"), "no", "edits")
    both = messages.unionByName(blocks).withColumn("kind", F.col("edits").isNull())
    return both.repartition("id").sortWithinPartitions("id", "at", "role", "text", "kind", "no").select("id", "role", "text", "edits")


def repaired_messages(repairs: Repairs) -> DataFrame:
    """(id, position, edit, role, text) of every message of the repaired conversations, in order within a partition."""
    whole = _with(repairs.messages.select("id"), "position bigint, edit string, role string, text string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, size, own, position = None, [], 0, None, 0

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema.field("id").type
                yield batch

        def packed() -> pa.RecordBatch:
            kinds = [schema, pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["id", "position", "edit", "role", "text"])

        for key, edit, role, text in _edited(watched()):
            position = position + 1 if key == own else 0
            own = key
            out.append((key, position, edit, role, text))
            size += len(text) + 64
            if size > 1 << 22:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    return _in_order(repairs).mapInArrow(rows, whole)


def repaired_digests(repairs: Repairs) -> DataFrame:
    """(id, sha256) of the lines ``role:text`` of every repaired conversation that has any messages left.

    A digest has to read a conversation from first to last; it is fed message by message, so the longest
    conversation takes one task's time, but no more memory than any other.
    """
    whole = _with(repairs.messages.select("id"), "sha256 string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, own, digest = [], [], None, None

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field("id").type]
                yield batch

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kinds[0]), pa.array([o[1] for o in out])], ["id", "sha256"])

        for key, _, role, text in _edited(watched()):
            if digest is None or key != own:
                if digest is not None:
                    out.append((own, digest.hexdigest()))
                own, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
            if len(out) >= 4096:
                yield packed()
                out = []
        if digest is not None:
            out.append((own, digest.hexdigest()))
        if out:
            yield packed()

    return _in_order(repairs).mapInArrow(rows, whole)
