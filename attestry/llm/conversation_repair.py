"""Repair of the turn structure of conversations: the cheapest edits that give the roles `(s?(ua)+)?`, by Hirschberg's division.

A conversation is a walk through four states (nothing yet, after system, after user, after assistant); each row moves it by an
edit, with inserts before. What a run of rows does is a 4 x 4 table: the least cost from state to state and, among the cheapest
audits that start in one state, their order. Audits of as many rows that end in an edit of a row are never prefixes of each
other, so that the least audit of a whole is the least one before any crossing, then the least behind it. So forward vectors
(cost and place of the four states) and backward vectors (cost) meet in the middle, the audit-least optimal crossing is kept and
both halves are worked off alike, in linear space.

At scale a conversation is cut into blocks of bounded rows and bytes. Blocks give their tables, the tables of one conversation
are divided first (32 numbers for each of its blocks in one task), then the blocks are, all apart. Blank and repeated rows are
deleted whatever the state, so they take no part in the division.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from attestry.llm.common import prepare, written
from attestry.llm.ordering import in_order

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
# State after a row of the role with that initial; where there is none, the row can't stand there.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE_INTO = {USER: "user", ASSISTANT: "assistant"}
#: What inserts at the end cost from each state.
ENDING = (0, 2 * COST[INSERT], COST[INSERT], 0)
LEGAL = ("su", "ua", "au")
FORCED = 255
NEVER = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the crc32 of `conv_id:turn` says; null parts count as one space."""
    blank = F.lit(" ")
    part = lambda c: F.coalesce(conversations[c].cast("string"), blank)
    fate = F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn)).cast("binary")) % 20
    rows = conversations.select(conversations[conv_id].alias("conv_id"), conversations[turn].cast("long").alias("turn"), part(role).alias("role"), part(text).alias("text"), fate.alias("fate"))
    return rows.filter("fate <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _lines(rows: DataFrame) -> DataFrame:
    """One row for all copies of a turn: (conv_id, turn, line, role_chars, copies, fault), the line being `role:text`.

    `fault` is `blank`, `duplicate`, `truncated` or null, of the first copy. An earlier turn with the same line is found by the
    least turn of each line that stands in several, not by gathering a conversation.
    """
    line = F.concat("role", F.lit(":"), "text")
    grouped = rows.select("conv_id", "turn", line.alias("line"), F.length("role").alias("role_chars"), "copies").groupBy("conv_id", "turn", "line", "role_chars").agg(F.sum("copies").alias("copies"))
    grouped = written(grouped.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", "role_chars", "line"), 256))))
    often = grouped.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    often = often.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    joined = grouped.join(often, grouped["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    body = F.rtrim(F.expr("substring(line, role_chars + 2)"), F.lit(WHITE))
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(body == "", "blank").when(again, "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    return joined.select("conv_id", "turn", "line", "role_chars", "copies", fault.alias("fault"))


def step(initial: str, truncated: bool) -> tuple:
    """What one row does: the audits of the cheapest ways from state to state, and the element (costs, places of the audits)."""
    best = {}
    for came in range(4):
        state = came
        for inserts in range(3):
            if inserts:
                state = ASSISTANT if state == USER else USER
            edits = [(DELETE, state, COST[DELETE])]
            late = TRUNCATED_COST if truncated else 0
            if initial in NEXT[state]:
                edits.append((KEEP, NEXT[state][initial], COST[KEEP] + late))
            edits.append((REROLE, ASSISTANT if state == USER else USER, COST[REROLE] + late))
            for edit, to, cost in edits:
                found = (cost + inserts * COST[INSERT], INSERT * inserts + edit)
                best[came, to] = min(best.get((came, to), found), found)
    audits = {k: v[1] for k, v in best.items()}
    costs = tuple(tuple(best.get((x, y), (NEVER,))[0] for y in range(4)) for x in range(4))
    return audits, (costs, tuple(_places([audits.get((x, y), "~") for y in range(4)]) for x in range(4)))


def _places(keys: list) -> tuple:
    order = sorted(set(keys))
    return tuple(order.index(k) for k in keys)


class Division:
    """Hirschberg's division over elements (costs, places). Vectors recur, so each move of a vector is worked out once."""

    def __init__(self):
        self.ahead, self.behind = {}, {}

    def forward(self, costs: tuple, places: tuple, elements: list) -> tuple[int, tuple, tuple]:
        """Base cost, costs above it and places of the four states behind `elements`."""
        base = 0
        for element in elements:
            key = (costs, places, element)
            if key not in self.ahead:
                if len(self.ahead) > 1 << 16:
                    self.ahead.clear()
                steps, ranks = element
                came = [min(range(4), key=lambda s: (min(NEVER, costs[s] + steps[s][t]), places[s])) for t in range(4)]
                now = [min(NEVER, costs[s] + steps[s][t]) for t, s in enumerate(came)]
                least = min(now)
                moved = tuple(NEVER if c == NEVER else c - least for c in now)
                self.ahead[key] = (least, moved, _places([(c == NEVER, places[s], ranks[s][t]) for t, (s, c) in enumerate(zip(came, now))]))
            least, costs, places = self.ahead[key]
            base += least
        return base, costs, places

    def backward(self, costs: tuple, elements: list) -> tuple:
        """Costs of the four states before `elements`, above the least of them."""
        for element in reversed(elements):
            key = (costs, element)
            if key not in self.behind:
                if len(self.behind) > 1 << 16:
                    self.behind.clear()
                now = [min(min(NEVER, element[0][s][t] + costs[t]) for t in range(4)) for s in range(4)]
                least = min(now)
                self.behind[key] = tuple(NEVER if c == NEVER else c - least for c in now)
            costs = self.behind[key]
        return costs

    def table(self, elements: list) -> tuple:
        """The elements as one element."""
        rows = []
        for came in range(4):
            base, costs, places = self.forward(_only(came), (0, 0, 0, 0), elements)
            rows.append((tuple(NEVER if c == NEVER else base + c for c in costs), places))
        return tuple(r[0] for r in rows), tuple(r[1] for r in rows)

    def borders(self, elements: list, came: int, to: int) -> list[int]:
        """The states before, between and behind the elements on the audit-least of the cheapest ways from `came` to `to`."""
        states = [came] + [to] * len(elements)
        stack = [(0, len(elements))]
        while stack:
            low, high = stack.pop()
            if high - low < 2:
                continue
            middle = (low + high) // 2
            _, costs, places = self.forward(_only(states[low]), (0, 0, 0, 0), elements[low:middle])
            behind = self.backward(_only(states[high]), elements[middle:high])
            states[middle] = min(range(4), key=lambda s: (min(NEVER, costs[s] + behind[s]), places[s]))
            stack += [(low, middle), (middle, high)]
        return states

    def ending(self, elements: list) -> tuple[int, int]:
        """Least cost of the whole from the start, and the state before the inserts at the end."""
        base, costs, places = self.forward(_only(START), (0, 0, 0, 0), elements)
        last = min(range(4), key=lambda s: (costs[s] + ENDING[s], places[s]))
        return base + costs[last] + ENDING[last], last


def _only(state: int) -> tuple:
    return tuple(0 if s == state else NEVER for s in range(4))


def _codes() -> list[tuple]:
    """Audits and element of each code: initial, and 4 more for truncated rows."""
    return [step(initial, cut) for cut in (False, True) for initial in (*INITIALS, "")]


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _blocks(conv_type: pa.DataType):
    """Sorted lines to blocks: codes, lines and copies of up to so many rows of a conversation, with their table and counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        division, codes = Division(), _codes()
        number = TaskContext.get().partitionId() << 33
        block = None

        def closed(b: dict) -> dict:
            elements = [codes[c][1] for c in b["codes"] if c != FORCED]
            costs, places = division.table(elements)
            return b | {"codes": bytes(b["codes"]), "costs": sum(costs, ()), "places": sum(places, ())}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if block is None or block["conv_id"] != r["conv_id"] or len(block["codes"]) >= BLOCK_ROWS or block["chars"] >= BLOCK_CHARS:
                    if block:
                        out.append(closed(block))
                    number += 1
                    block = {"conv_id": r["conv_id"], "block": number, "codes": [], "lines": [], "role_chars": [], "copies": [], "chars": 0, "first": None, "last": None, "turns": 0, "low": None, "high": None} | dict.fromkeys(COUNTS, 0)
                role, copies, fault, turn = r["line"][: r["role_chars"]], r["copies"], r["fault"], r["turn"]
                initial = role[:1] if role[:1] and role[:1] in INITIALS else ""
                forced = fault in ("blank", "duplicate")
                block["codes"].append(FORCED if forced else len(INITIALS) if not initial else INITIALS.index(initial))
                if fault == "truncated":
                    block["codes"][-1] += 4
                block["lines"].append("" if forced else r["line"])
                block["role_chars"].append(r["role_chars"])
                block["copies"].append(copies)
                block["chars"] += len(block["lines"][-1])
                if fault:
                    block[fault] += copies if forced else 1
                block["duplicate"] += 0 if forced else copies - 1
                pair = (block["last"] or "") + (initial or "?")
                block["illegal"] += copies - 1 + (block["last"] is not None and pair not in LEGAL)
                block["first"], block["last"] = block["first"] or initial or "?", initial or "?"
                if turn is not None:
                    block["turns"] += turn != block["high"]
                    block["low"], block["high"] = turn if block["low"] is None else block["low"], turn
            if out:
                yield _batch(out, blocks_schema(conv_type))
        if block:
            yield _batch([closed(block)], blocks_schema(conv_type))

    return rows


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def blocks_schema(conv_type: pa.DataType) -> pa.Schema:
    long, longs, text = pa.int64(), pa.list_(pa.int64()), pa.string()
    fields = {"conv_id": conv_type, "block": long, "codes": pa.binary(), "lines": pa.list_(text), "role_chars": longs, "copies": longs, "costs": longs, "places": longs, "first": text, "last": text, "turns": long, "low": long, "high": long}
    return pa.schema([*fields.items(), *[(c, long) for c in COUNTS]])


TOTALS = ["gaps", *COUNTS, "cost"]
STATES = "block long, came long, went long, inserts long, " + ", ".join(f"{c} long" for c in TOTALS)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block tables, by conversation and block, to the states at their borders; the totals go with a conversation's first block."""
    division = Division()
    schema = pa.schema([(c, pa.int64()) for c in ["block", "came", "went", "inserts", *TOTALS]])
    four = lambda flat: tuple(tuple(flat[4 * s : 4 * s + 4]) for s in range(4))

    def worked(blocks: list[dict]) -> list[dict]:
        elements = [(four(b["costs"]), four(b["places"])) for b in blocks]
        cost, last = division.ending(elements)
        states = division.borders(elements, START, last)
        total = {c: sum(b[c] for b in blocks) for c in COUNTS}
        total["cost"] = cost + COST[DELETE] * (total["blank"] + total["duplicate"])
        total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
        timed = [b for b in blocks if b["low"] is not None]
        turns = sum(b["turns"] for b in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        total["gaps"] = min(2**63 - 1, timed[-1]["high"] - timed[0]["low"] + 1 - turns) if timed else 0
        out = [{"block": b["block"], "came": states[i], "went": states[i + 1], "inserts": 0} | dict.fromkeys(TOTALS) for i, b in enumerate(blocks)]
        out[0] |= total
        out[-1]["inserts"] = ENDING[last] // COST[INSERT]
        return out

    held: list[dict] = []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and held[0]["conv_id"] != r["conv_id"]:
                out += worked(held)
                held = []
            held.append(r)
        if out:
            yield _batch(out, schema)
    if held:
        yield _batch(worked(held), schema)


def _edited(conv_type: pa.DataType):
    """Blocks with the states at their borders to their audit and repaired lines."""
    schema = pa.schema([("conv_id", conv_type), ("block", pa.int64()), ("audit", pa.string()), ("repaired", pa.string()), *[(c, pa.int64()) for c in TOTALS]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        division, codes = Division(), _codes()
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                free = [codes[c][1] for c in b["codes"] if c != FORCED]
                states = iter(division.borders(free, b["came"], b["went"]))
                state, audit, lines = next(states), [], []
                for code, line, role_chars, copies in zip(b["codes"], b["lines"], b["role_chars"], b["copies"]):
                    if code != FORCED:
                        to = next(states)
                        edits, copies = codes[code][0][state, to], copies - 1
                        audit.append(edits)
                        for edit in edits:
                            if edit in (INSERT, REROLE):
                                state = ASSISTANT if state == USER else USER
                                lines.append(ROLE_INTO[state] + ":" + (line[role_chars + 1 :] if edit == REROLE else ""))
                            elif edit == KEEP:
                                lines.append(line)
                        state = to
                    audit.append(DELETE * copies)
                for _ in range(b["inserts"]):
                    state = ASSISTANT if state == USER else USER
                    audit.append(INSERT)
                    lines.append(ROLE_INTO[state] + ":")
                out.append({c: b[c] for c in ("conv_id", "block", *TOTALS)} | {"audit": "".join(audit), "repaired": "\n".join(lines) if lines else None})
            if out:
                yield _batch(out, schema)

    return rows


def _whole(conv_type: pa.DataType):
    """Edited blocks, by conversation and block, to one row for each conversation; lines go through a running hash."""
    schema = pa.schema([("conv_id", conv_type), *[(c, pa.int64()) for c in TOTALS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, lines, digest = None, [], 0, None

        def done() -> dict:
            return now | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            out = []
            for b in batch.to_pylist():
                if now is None or now["conv_id"] != b["conv_id"]:
                    if now:
                        out.append(done())
                    now, audit, lines, digest = {c: b[c] for c in ("conv_id", *TOTALS)}, [], 0, hashlib.sha256()
                audit.append(b["audit"])
                if b["repaired"] is not None:
                    digest.update((("\n" if lines else "") + b["repaired"]).encode())
                    lines += 1
            if out:
                yield _batch(out, schema)
        if now:
            yield _batch([done()], schema)

    return rows


def _schema(conv: T.DataType, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *[T.StructField(n, t) for n, t in fields.items()]])


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "block")


def repaired_blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, audit, repaired, gaps, blank, duplicate, truncated, illegal, cost) of rows (conv_id, turn, role, text, copies).

    `repaired` holds the repaired lines of the block, null where none is left; the totals stand with the first block.
    """
    spark = prepare(rows.sparkSession)
    conv = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(conv)
    lines = written(_lines(rows))
    # Ranges are drawn from the head of a line only, so that the driver's sample stays small.
    ordered = in_order(lines, ["conv_id", "turn", "line", "role_chars"], ["conv_id", "turn", F.left("line", F.lit(64))])
    blocks = written(ordered.mapInArrow(_blocks(arrow), from_arrow_schema(blocks_schema(arrow))))
    tables = blocks.select("conv_id", "block", "costs", "places", "first", "last", "turns", "low", "high", *COUNTS)
    states = written(_sorted(tables).mapInArrow(_divided, STATES))
    schema = _schema(conv, block=T.LongType(), audit=T.StringType(), repaired=T.StringType(), **dict.fromkeys(TOTALS, T.LongType()))
    both = blocks.select("conv_id", "block", "codes", "lines", "role_chars", "copies").join(states, "block")
    return both.mapInArrow(_edited(arrow), schema)


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conv_id of the table.

    The rows are damaged first (`damaged`). Rows of one turn stand in the order of `role:text`, copies of a row side by side; a
    null turn comes first, a null conv_id is a conversation of its own. A null role or text counts as one space, in the damage
    too. A conversation without rows after damage has zeros, an empty audit and the hash of the empty string. Gaps beyond a long
    are the largest long. An empty table gives an empty result; of extra columns none is read. A long text is one cell of a block
    and is hashed as it streams; the audit of a conversation has a letter for each of its rows and is one cell by contract.
    """
    prepare(conversations.sparkSession)
    rows = damaged(conversations, conv_id, turn, role, text)
    conv = rows.schema["conv_id"].dataType
    schema = _schema(conv, **dict.fromkeys(TOTALS, T.LongType()), audit=T.StringType(), repaired_sha256=T.StringType())
    found = _sorted(repaired_blocks(rows)).mapInArrow(_whole(to_arrow_type(conv)), schema).withColumnRenamed("conv_id", "_conv")
    every = conversations.select(conversations[conv_id].alias("conv_id")).distinct()
    none: dict[str, Column] = {c: F.coalesce(c, F.lit(0)).alias(c) for c in TOTALS}
    return every.join(found, every["conv_id"].eqNullSafe(found["_conv"]), "left").select(
        "conv_id", *none.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
