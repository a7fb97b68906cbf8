"""Conversation structure repair: the auction algorithm for shortest paths over a lattice of edits.

A conversation's rows after damage, in order, and the four states that its roles so far can be in (nothing yet, after system, after user, after
assistant) are the nodes of a lattice. Arcs are edits: Keep, Rerole and Delete lead past a row, Insert to another state at the same
place. Roles must read ``(s?(ua)+)?``, so an edit and a state leave one next state at most. A path is extended from its last node along the cheapest arc (arc's cost and the
price of its end) if the node's price covers that, and otherwise the price is raised to it and the path contracts by a node. When a path has reached the end, or a node settled before, its nodes' prices are
distances, and all arcs on cheapest paths are tight. Origins are taken from the end of the rows to their beginning in strides. Prices of a stride
begin with the least price behind it and what its rows must cost at least, so a path is short, contracts over a stride at most, and prices rise by a few units. The result is traced from the first node along the tight arc of the least letter.

Rows are put in one order over all conversations by a range sort, numbered, and cut into blocks of ``BLOCK`` numbers; a block's
task sees light rows (ids, role, flags, digests) and no text. Conversations inside one block are solved there. Of one that goes on over blocks, each
block's part gives the cheapest costs from each state to each state; one pass from the last block to the first adds these up to prices at the parts' ends, each part
then is solved for each state that it can be entered in, and one pass forward picks the ways that meet. Texts are shuffled by their
digest to meet the edits, and by block to be hashed; only conversations over several blocks send their texts on, in runs of ``RUN`` bytes, for a digest of a text
is sequential by nature. No task holds more than a block of light rows or a batch of texts.

Damage: remainder 0 to 4 of crc32 of ``conv_id:turn`` by 20 drops the row, empties its text, takes out ``.!?``, repeats the row, or makes its role user. Null ids, turns,
roles and texts read as one space there; a null id is a conversation of its own, and null turns come first. Rows of the same turn
are ordered by role, then by digest of their text, so that equal rows are adjacent and all but the first are duplicates. A role's
initial is its first character, whatever follows, and an empty role has none; other initials than s, u and a are never kept. Conversations without rows after the damage have zeros, an empty audit and the digest
of nothing. An empty table gives an empty one. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from foldline.session import stored

from .common import small

BLOCK_BITS = 12
STRIDE = 8
RUN = 1 << 20
NEVER = 1 << 60

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
OTHER = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}  # the role that can be put anew
ENDS = (0, NEVER, NEVER, 0)
AT_END = (0, 4, 2, 0)  # with the rows that have to be inserted there
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1


class Step(NamedTuple):
    letter: str
    cost: int
    place: int
    state: int


class Row(NamedTuple):
    """A row of the lattice: its role's initial, its first fault, and how many equal rows in a row it stands for, if it has to go."""

    initial: str
    fault: int
    weight: int


def least_cost(row: Row) -> int:
    """What getting past a row costs at least, in any state."""
    if row.fault in (BLANK, DUPLICATE):
        return DELETE_COST * row.weight
    more = TRUNCATED_COST if row.fault == TRUNCATED else 0
    return more + (KEEP_COST if row.initial and row.initial in "sua" else REROLE_COST)


class Lattice:
    """Prices of the nodes (place, state), given the prices behind the last row. Only at a conversation's end are rows inserted behind the last one."""

    def __init__(self, rows: list[Row], ends: tuple[int, ...], at_end: bool) -> None:
        self.rows, self.ends, self.at_end = rows, ends, at_end
        size = len(rows)
        self.prices = [[min(ends)] * 4 for _ in range(size + 1)]
        self.settled = [[False] * 4 for _ in range(size + 1)]
        self.work = 0
        self._shut()
        for state in range(4):
            self.auction(size, state)
        for place in range(size, 0, -STRIDE):
            # every path runs over this place, so its least price and the rows before it bound the prices there from below,
            # and no arc leads to a node whose price is lower by more than the arc's cost
            bound = min(self.prices[place])
            to = max(0, place - STRIDE)
            for i in range(place - 1, to - 1, -1):
                bound += least_cost(rows[i])
                self.prices[i] = [NEVER if p == NEVER else bound for p in self.prices[i]]
            for state in range(4):
                self.auction(to, state)

    def _shut(self) -> None:
        """Nodes from which no way leads to an end have no price."""
        dialogue = min(self.ends[USER], self.ends[ASSISTANT]) < NEVER
        if dialogue and len(self.rows) and not self.at_end:
            open_ends = [e < NEVER for e in self.ends]
            for state in range(4):  # behind the last row nothing is inserted
                if not open_ends[state]:
                    self.prices[-1][state], self.settled[-1][state] = NEVER, True
            # in front of the last row, any state leads to user and assistant
            return
        if dialogue or self.at_end:
            return
        system = self.ends[SYSTEM] < NEVER
        from_start = self.ends[START] < NEVER
        for place in range(len(self.rows), -1, -1):
            if place < len(self.rows) and system:
                row = self.rows[place]
                from_start |= row.initial == "s" and row.fault in (FINE, TRUNCATED)
            for state, way in enumerate((from_start, system, False, False)):
                if not way:
                    self.prices[place][state], self.settled[place][state] = NEVER, True

    def steps(self, place: int, state: int) -> list[Step]:
        """The arcs of a node in the order of their letters."""
        role, then = OTHER[state]
        if place == len(self.rows):
            return [Step("I", INSERT_COST, place, then)] if self.at_end else []
        row = self.rows[place]
        found = [Step("D", DELETE_COST * row.weight, place + 1, state), Step("I", INSERT_COST, place, then)]
        if row.fault in (FINE, TRUNCATED):
            more = TRUNCATED_COST if row.fault == TRUNCATED else 0
            if (state, row.initial) in NEXT:
                found.append(Step("K", KEEP_COST + more, place + 1, NEXT[state, row.initial]))
            found.append(Step("R", REROLE_COST + more, place + 1, then))
        return found

    def best(self, place: int, state: int) -> tuple[int, Step | None]:
        """The cheapest way on, of equal ones the least letter; None where the rows end."""
        cost, best = NEVER, None
        if place == len(self.rows):
            cost = self.ends[state]
        for step in self.steps(place, state):
            way = step.cost + self.prices[step.place][step.state]
            if way < cost:
                cost, best = way, step
        return cost, best

    def auction(self, place: int, state: int) -> None:
        """The cheapest path from a node; its nodes are settled afterwards."""
        path = [(place, state)]
        while True:
            place, state = path[-1]
            if self.settled[place][state]:
                break
            self.work += 1
            cost, best = self.best(place, state)
            if self.prices[place][state] < cost:
                self.prices[place][state] = cost
                if len(path) > 1:
                    path.pop()
            elif best is None:
                break
            else:
                path.append((best.place, best.state))
        for place, state in path:
            self.settled[place][state] = True

    def trace(self, state: int) -> tuple[list[Step], int]:
        """The steps from the first row in a state along tight arcs, the least letters, and the state behind the last row."""
        found, place = [], 0
        while True:
            self.auction(place, state)
            _, best = self.best(place, state)
            if best is None:
                return found, state
            found.append(best)
            place, state = best.place, best.state


def between(rows: list[Row]) -> list[int]:
    """The cheapest costs from each state before the rows to each state behind them, row by row; NEVER where there is no way."""
    costs = [[NEVER] * 4 for _ in range(4)]
    for end in range(4):
        lattice = Lattice(rows, tuple(0 if s == end else NEVER for s in range(4)), False)
        for state in range(4):
            lattice.auction(0, state)
            costs[state][end] = lattice.prices[0][state]
    return [c for row in costs for c in row]


class Unit(NamedTuple):
    """Equal rows of a turn: what is known of them without their text."""

    turn: int | None
    role: str
    key: bytes
    copies: int
    blank: bool
    truncated: bool
    first: bool


def lattice_rows(units: list[Unit]) -> tuple[list[Row], list[int]]:
    """The rows of the lattice, and the unit of each."""
    rows, owners = [], []
    for i, u in enumerate(units):
        initial = u.role[:1]
        if u.blank or not u.first:
            parts = [(BLANK if u.blank else DUPLICATE, u.copies)]
        else:
            parts = [(TRUNCATED if u.truncated else FINE, 1)] + [(DUPLICATE, u.copies - 1)] * (u.copies > 1)
        for fault, weight in parts:
            rows.append(Row(initial, fault, weight))
            owners.append(i)
    return rows, owners


def edited(rows: list[Row], owners: list[int], units: list[Unit], steps: list[Step]) -> tuple[int, str, list[dict]]:
    """Cost, audit and the rows of the repaired conversation, with the key of a kept row's text."""
    place, cost, letters, out = 0, 0, [], []
    for step in steps:
        cost += step.cost
        if step.letter == "I":
            letters.append("I")
            out.append((None, ROLES[step.state]))
            continue
        letters.append(step.letter * rows[place].weight)
        unit = units[owners[place]]
        if step.letter == "K":
            out.append((unit.key, unit.role))
        elif step.letter == "R":
            out.append((unit.key, ROLES[step.state]))
        place = step.place
    return cost, "".join(letters), [{"at": i, "key": key, "role": role} for i, (key, role) in enumerate(out)]


def summary(units: list[Unit]) -> dict:
    """Counts over a stretch of units, and what the next stretch has to know."""
    rows, _ = lattice_rows(units)
    turns = [u.turn for u in units if u.turn is not None]
    illegal = sum(u.copies - 1 for u in units)
    illegal += sum(a.role[:1] + b.role[:1] not in LEGAL for a, b in zip(units, units[1:]))
    counts = {name: sum(r.weight for r in rows if r.fault == fault)
              for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    return {**counts, "illegal": illegal, "least_turn": min(turns, default=None), "most_turn": max(turns, default=None),
            "turns": len(set(turns)), "first_initial": units[0].role[:1], "last_initial": units[-1].role[:1],
            "first_turn": units[0].turn, "last_turn": units[-1].turn}


# --- the rows in Spark

EDITS = pa.list_(pa.struct([("at", pa.int32()), ("key", pa.binary()), ("role", pa.string())]))
UNITS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary()), ("copies", pa.int64()),
                            ("blank", pa.bool_()), ("truncated", pa.bool_()), ("first", pa.bool_())]))
COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
          ("least_turn", pa.int64()), ("most_turn", pa.int64()), ("turns", pa.int64())]
SEAMS = [("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("closed", pa.bool_()), *COUNTS, *SEAMS, ("cost", pa.int64()),
                      ("audit", pa.string()), ("edits", EDITS), ("units", UNITS), ("between", pa.list_(pa.int64()))])
BEHIND = pa.schema([("segment", pa.int64()), ("ends", pa.list_(pa.int64())), ("at_end", pa.bool_())])
WAYS = pa.schema([("segment", pa.int64()), ("ways", pa.list_(pa.struct([
    ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", EDITS)])))])
ENTRIES = pa.schema([("segment", pa.int64()), ("entry", pa.int32()), ("seam_illegal", pa.int64()), ("seam_turn", pa.int64())])
RUNS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("at", pa.int32()), ("text", pa.string())])
HASHES = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
SPACES = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with how many copies of each there are, digests and flags."""
    named = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = named.withColumn("_fate", F.crc32(F.concat_ws(":", *as_text).cast("binary")) % 20).where("_fate <> 0").select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_fate") == 3, 2).otherwise(1).cast("long").alias("copies"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    return rows.withColumns({
        "body": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)),
        "blank": trimmed == "", "truncated": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
    }).withColumn("key", F.unhex(F.sha2(F.concat_ws(":", *as_text, F.hex("body")), 256)))


def numbered(rows: DataFrame) -> DataFrame:
    """Equal rows as one, in the order of conversation, turn, role and digest, with their numbers in it and their blocks."""
    order = ["conv_id", "turn", "role", "body"]
    units = rows.groupBy(*order, "key", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    kept = stored(units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    sizes = sorted(tuple(r) for r in kept.groupBy(part.alias("part")).count().collect())  # a row for each task of the sort
    begins, at = [], 0
    for number, size in sizes:
        begins.append((number, at))
        at += size
    offsets = kept.sparkSession.createDataFrame(begins, "_part long, _begin long")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(offsets), part == F.col("_part")).withColumn("pos", F.col("_begin") + inside).withColumn(
        "block", F.shiftright("pos", BLOCK_BITS)).drop("_place", "_part", "_begin")


def _block(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """A record for each conversation's part in a block; those that touch its edges may go on beyond it and stay unsolved."""
    found: list[dict] = []
    first = set(firsts.column("pos").to_pylist())
    rows = rows.sort_by("pos").to_pylist()
    begin = 0
    while begin < len(rows):
        stop = begin
        while stop < len(rows) and rows[stop]["conv_id"] == rows[begin]["conv_id"]:
            stop += 1
        units = [Unit(r["turn"], r["role"], r["key"], r["copies"], r["blank"], r["truncated"], r["pos"] in first) for r in rows[begin:stop]]
        own, owners = lattice_rows(units)
        record = {"conv_id": rows[begin]["conv_id"], "segment": rows[begin]["pos"], "closed": begin > 0 and stop < len(rows), **summary(units)}
        if record["closed"]:
            cost, audit, edits = edited(own, owners, units, Lattice(own, ENDS, True).trace(START)[0])
            record |= {"cost": cost, "audit": audit, "edits": edits}
        else:
            record |= {"units": [u._asdict() for u in units], "between": between(own)}
        found.append(record)
        begin = stop
    return pa.Table.from_pylist(found, schema=SEGMENTS)


def _by_record(batches: Iterator[pa.RecordBatch], work: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema,
               at_once: int = 64) -> Iterator[pa.RecordBatch]:
    """``work`` on the records of a whole partition, a few at a time in Python."""
    found: list[dict] = []
    for record in work(r for batch in small(batches, at_once) for r in batch.to_pylist()):
        found.append(record)
        if len(found) >= at_once:
            yield pa.RecordBatch.from_pylist(found, schema=schema)
            found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, schema=schema)


def _mapped(rows: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema) -> DataFrame:
    return rows.mapInArrow(lambda batches: _by_record(batches, work, schema), from_arrow_schema(schema))


def _backward(parts: Iterator[dict]) -> Iterator[dict]:
    """Parts of conversations from the last to the first: the prices of the states behind each."""
    before, ends = None, AT_END
    for r in parts:
        at_end = before is None or before[0] != r["conv_id"]
        if at_end:
            ends = AT_END
        yield {"segment": r["segment"], "ends": list(ENDS if at_end else ends), "at_end": at_end}
        ends = tuple(min(r["between"][4 * s + e] + ends[e] for e in range(4)) for s in range(4))
        before = (r["conv_id"],)


def _ways(parts: Iterator[dict]) -> Iterator[dict]:
    """Each part solved for each state that it can be entered in."""
    for r in parts:
        units = [Unit(**u) for u in r["units"]]
        rows, owners = lattice_rows(units)
        lattice = Lattice(rows, tuple(r["ends"]), r["at_end"])
        ways = []
        for state in range(4):
            steps, then = lattice.trace(state)
            cost, audit, edits = edited(rows, owners, units, steps)
            ways.append({"state": then, "cost": cost, "audit": audit, "edits": edits})
        yield {"segment": r["segment"], "ways": ways}


def _forward(parts: Iterator[dict]) -> Iterator[dict]:
    """Parts of conversations from the first to the last: the state in which each is entered, and what lies on its seam."""
    before = None
    for r in parts:
        goes_on = before is not None and before["conv_id"] == r["conv_id"]
        state = before["states"][state] if goes_on else START
        yield {"segment": r["segment"], "entry": state,
               "seam_illegal": int(goes_on and before["last_initial"] + r["first_initial"] not in LEGAL),
               "seam_turn": int(goes_on and r["first_turn"] is not None and before["last_turn"] == r["first_turn"])}
        before = r


def _hashed(lines: Iterator[dict]) -> Iterator[dict]:
    """Lines in the order of conversations: the digest of each conversation's."""
    now, digest = None, None
    for r in lines:
        if now is None or now != (r["conv_id"],):
            if now is not None:
                yield {"conv_id": now[0], "repaired_sha256": digest.hexdigest()}
            now, digest = (r["conv_id"],), hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(r["text"].encode())
    if now is not None:
        yield {"conv_id": now[0], "repaired_sha256": digest.hexdigest()}


def _runs(lines: Iterator[dict]) -> Iterator[dict]:
    """Lines of a segment joined to runs of about ``RUN`` characters."""
    first, kept, size = None, [], 0
    for r in lines:
        if kept and (first["segment"] != r["segment"] or size >= RUN):
            yield {**first, "text": "\n".join(kept)}
            kept, size = [], 0
        if not kept:
            first = r
        kept.append(r["text"])
        size += len(r["text"])
    if kept:
        yield {**first, "text": "\n".join(kept)}


def solved(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stretches, edits): counts, cost and audit of each stretch of a conversation; and the rows of the repaired conversations,
    (conv_id, segment, at, key, role, closed), with the key of a kept row's text. Both are stored."""
    rows = numbered(damaged(conversations))
    firsts = rows.groupBy("conv_id", "body").agg(F.min("pos").alias("pos")).select("pos", F.shiftright("pos", BLOCK_BITS).alias("block"))
    light = rows.select("pos", "block", "conv_id", "turn", "role", "key", "copies", "blank", "truncated")
    segments = stored(light.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_block, from_arrow_schema(SEGMENTS)), "segments")
    going_on = segments.where("not closed")
    behind = _mapped(going_on.select("conv_id", "segment", "between").repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("segment")), _backward, BEHIND)
    parts = going_on.select("segment", "units").join(behind, "segment")
    ways = stored(_mapped(parts.repartition("segment"), _ways, WAYS), "ways")
    light_ways = going_on.select("conv_id", "segment", *[n for n, _ in SEAMS]).join(ways.select("segment", "ways.state"), "segment")
    entries = _mapped(light_ways.withColumnRenamed("state", "states").repartition("conv_id").sortWithinPartitions("conv_id", "segment"),
                      _forward, ENTRIES)
    taken = ways.join(entries, "segment").select(
        "segment", "seam_illegal", "seam_turn", F.element_at("ways", F.col("entry") + 1).alias("way")).select(
        "segment", "seam_illegal", "seam_turn", "way.cost", "way.audit", "way.edits")
    kept = ["conv_id", "closed", *[n for n, _ in COUNTS]]
    both = segments.where("closed").select("segment", F.lit(0).cast("long").alias("seam_illegal"), F.lit(0).cast("long").alias("seam_turn"),
                                           "cost", "audit", "edits", *kept).unionByName(
        going_on.select("segment", *kept).join(taken, "segment"))
    both = stored(both, "repaired")
    edits = both.select("conv_id", "segment", "closed", F.explode("edits").alias("edit")).select(
        "conv_id", "segment", "closed", "edit.at", "edit.key", "edit.role")
    return both.drop("edits"), edits


def repaired_rows(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, segment, at, closed, role, text): the rows of the repaired conversations, ordered by (segment, at)."""
    texts = damaged(conversations).where("not blank").groupBy("key").agg(F.first("text").alias("text"))
    kept = edits.where("key is not null").join(texts, "key").drop("key")
    return kept.unionByName(edits.where("key is null").drop("key").withColumn("text", F.lit("")))


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cost of the cheapest repair, its audit, and the digest of the repaired conversation."""
    stretches, edits = solved(conversations)
    lines = repaired_rows(conversations, edits).select(
        "conv_id", "segment", "at", "closed", F.concat("role", F.lit(":"), "text").alias("text"))
    by_block = lines.withColumn("_block", F.shiftright("segment", BLOCK_BITS)).repartition("closed", "_block").sortWithinPartitions("segment", "at")
    by_block = by_block.select("conv_id", "segment", "at", "text", "closed")
    own = _mapped(by_block.where("closed").drop("closed"), _hashed, HASHES)
    runs = _mapped(by_block.where("not closed").drop("closed"), _runs, RUNS)
    over = _mapped(runs.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "at"), _hashed, HASHES)
    counts = stretches.groupBy("conv_id").agg(
        (F.max("most_turn") - F.min("least_turn") + 1 - F.sum("turns") + F.sum("seam_turn")).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.sum("illegal") + F.sum("seam_illegal")).alias("illegal"), F.sum("cost").alias("cost"),
        F.expr("listagg(audit, '') within group (order by segment)").alias("audit"))
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # null ids meet in a group, as they wouldn't in a join
    whole = named.unionByName(counts, allowMissingColumns=True).unionByName(own.unionByName(over), allowMissingColumns=True)
    return whole.groupBy("conv_id").agg(
        *[F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
