"""Repair of a conversation's structure: the cheapest edits that give the role initials ``(s?(ua)+)?``.

Edits are Keep (0), Rerole to user or assistant (3), Delete (4) and Insert an empty user or assistant turn (3); a truncated
turn that stays adds 3, and blank or repeated turns must go.  Of equally cheap edits those whose initials, in order, come
first in ASCII are taken.

A macro edit is a run of at most two inserts and then the edit of one turn, written as a code: D, ID, IID, IIK, IIR, IK,
IR, K, R.  (Three inserts in a row hold a pair that can go.)  No code is another's beginning, so of two sequences for the
same turns the first code that differs decides, whatever follows; a layer of the dynamic programme, what is known after
one more turn, therefore needs no strings: each of its states has its cost, the rank of its sequence among the layer's, and
a pointer to its parent and code.  The audit is rebuilt from the pointers at the end.

The turns are sorted over all conversations by ranges, so that a long conversation lies in many partitions.  A task solves
each conversation that begins and ends within its partition and has at most ``TURNS`` turns and ``BYTES`` of text.  The
others, at most two a partition but for long ones, are cut into blocks of 2 ** ``BLOCK_BITS`` turns.  A block is solved from each of
the four states to each other one; its costs and ranks are all that a fold along the conversation needs to choose the states
between blocks, and then each block rebuilds its own edits.  Only the hash of a repaired conversation takes its turns
one after another, as a stream of batches.

Defined cases: turns of a conversation go by their number, nulls first; those of equal number by a hash of role and
text, so equal ones are adjacent; a null role or text is one space; a role whose initial is not s, u or a, an empty one
too, can't be kept; a null conversation id is an id of its own; a conversation of which no turn is left has no edit;
repeated rows are repeated turns, all but the first to be deleted; very long texts only move through Arrow batches; an
empty table gives no row; extra columns are ignored, whatever their names; gaps that are no long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.common import BOOL, INT, LONG, STR, durable, map_rows, stored, struct

TURNS, BYTES, BLOCK_BITS = 4096, 8 << 20, 12
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

#: States: nothing yet, after the system's turn, after a user's, after an assistant's.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that an inserted or renamed turn leads to, its role, and the inserts that end a conversation.
FILL, NAME, FINISH = (2, 2, 3, 2), {2: "user", 3: "assistant"}, (0, 2, 1, 0)
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
LEGAL = ("su", "ua", "au")

EDIT = struct(edit=STR, turn=LONG, was=STR, fault=STR, illegal=BOOL, role=STR, text=STR)


@cache
def moves(initial: str, fault: str | None) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, place in CODES) of the best macro edit of a turn between two states."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        at = state
        for run in range(3):
            offers = [("D", at, DELETE)]
            if fault in (None, "truncated"):
                more = CUT if fault else 0
                offers += [("R", FILL[at], REROLE + more)] + ([("K", NEXT[at][initial], KEEP + more)] if initial in NEXT[at] else [])
            for edit, to, cost in offers:
                offer = (cost + run * INSERT, CODES.index("I" * run + edit))
                best[state, to] = min(best.get((state, to), offer), offer)
            at = FILL[at]
    return [(*k, *v) for k, v in sorted(best.items())]


class Layers:
    """The programme over some turns from several starting states at once; cells are 4 * (place of the start) + state."""

    def __init__(self, turns: Iterable[tuple[str, str | None]], starts: tuple[int, ...] = (0,)):
        self.starts = starts
        self.cells: dict[int, tuple[int, int]] = {4 * i + s: (0, 0) for i, s in enumerate(starts)}
        self.parents: list[dict[int, tuple[int, int]]] = []
        for initial, fault in turns:
            new: dict[int, tuple[int, int, int, int]] = {}
            for base in range(0, 4 * len(starts), 4):
                for start, to, more, code in moves(initial, fault):
                    known = self.cells.get(base + start)
                    if known is not None:
                        offer = (known[0] + more, known[1] * len(CODES) + code, start, code)
                        if base + to not in new or offer < new[base + to]:
                            new[base + to] = offer
            ranks = {key: i for i, key in enumerate(sorted({v[1] for v in new.values()}))}
            self.cells = {cell: (v[0], ranks[v[1]]) for cell, v in new.items()}
            self.parents.append({cell: v[2:] for cell, v in new.items()})

    def codes(self, start: int, end: int) -> list[str]:
        base, at, out = 4 * self.starts.index(start), end, []
        for layer in reversed(self.parents):
            at, code = layer[base + at]
            out.append(CODES[code])
        return out[::-1]


def finish(cells: dict[int, tuple[int, int]]) -> int:
    """The state in which the best sequence leaves the last turn."""
    return min(cells, key=lambda s: (cells[s][0] + INSERT * FINISH[s], cells[s][1], FINISH[s]))


def played(codes: Iterable[str], turns: Iterable[tuple[str, str]], state: int, tail: int) -> Iterator[list[tuple[str, str | None]]]:
    """For each turn (role, initial), and for the end: (edit, role that it leaves) of its inserts and its own edit."""
    for code, (role, initial) in zip(codes, turns, strict=True):
        out: list[tuple[str, str | None]] = []
        for edit in code:
            if edit == "K":
                state = NEXT[state][initial]
            elif edit != "D":
                state = FILL[state]
            out.append((edit, role if edit == "K" else None if edit == "D" else NAME[state]))
        yield out
    out = []
    for _ in range(tail):
        state = FILL[state]
        out.append(("I", NAME[state]))
    yield out


def fault_of(role: str, text: str, seen: set[tuple[str, str]]) -> str | None:
    core, known = text.rstrip(SPACE), (role, text) in seen
    seen.add((role, text))
    return "blank" if not core else "duplicate" if known else None if core[-1] in ENDS else "truncated"


def solved(turns: list[tuple[int | None, str, str]]) -> list[tuple]:
    """The edits of a whole conversation, (turn, role, text) in order: fields of EDIT."""
    seen: set[tuple[str, str]] = set()
    faults = [fault_of(role, text, seen) for _, role, text in turns]
    layers = Layers((role[:1], fault) for (_, role, _), fault in zip(turns, faults, strict=True))
    end, out, before = finish(layers.cells), [], None
    steps = played(layers.codes(0, end), [(role, role[:1]) for _, role, _ in turns], 0, FINISH[end])
    for (turn, role, text), fault, step in zip(turns, faults, steps, strict=False):
        out += [("I", None, None, None, None, new, "") for _, new in step[:-1]]
        out.append((step[-1][0], turn, role, fault, before is not None and before + role[:1] not in LEGAL, step[-1][1], text))
        before = role[:1]
    return out + [("I", None, None, None, None, new, "") for _, new in next(steps, [])]


# ---- sorted ranges: what lies within a partition is solved there, the rest is left open

STAGED = struct(conv_id=LONG, turns=T.ArrayType(EDIT), position=LONG, turn=LONG, copies=INT, role=STR, text=STR)


def _within(rows: Iterator[tuple], most: int, most_bytes: int, block: int) -> Iterator[tuple]:
    """Rows (conv_id, turn, copies, role, text) of a sorted partition: conversations with their edits, or open turns with a position in it.

    The first and the last conversation may go on in another partition and stay open.  An open conversation starts at a
    multiple of the block, so that a block has turns of one conversation only."""
    place = TaskContext.get().partitionId() << 33
    current: tuple | None = None
    held: list[tuple] = []
    size, is_open = 0, True

    def opened(conv, some: list[tuple]) -> Iterator[tuple]:
        nonlocal place
        for turn, copies, role, text in some:
            for _ in range(max(1, copies)):
                yield (conv, None, place, turn, min(1, copies), role, text)
                place += 1

    for conv, *row in rows:
        if current is None or (conv,) != current:
            if current is not None and not is_open:
                yield (current[0], solved([(t, role, text) for t, copies, role, text in held for _ in range(copies)]), None, None, None, None, None)
            is_open, current, held, size = current is None, (conv,), [], 0
            place = -(-place // block) * block
        held.append(row)
        size += len(row[3])
        is_open = is_open or len(held) > most or size > most_bytes
        if is_open:
            yield from opened(conv, held)
            held = []
    if current is not None:
        yield from opened(current[0], held)


def _summary(table: pa.Table) -> pa.Table:
    """One row for a block: its first and last initial, and cost and rank between any two states."""
    table = table.sort_by("position")
    initials, faults = table["initial"].to_pylist(), table["fault"].to_pylist()
    cells = Layers(zip(initials, faults, strict=True), (0, 1, 2, 3)).cells
    at = sorted(cells)
    out = (table["block"][0].as_py(), table["conv_id"][0].as_py(), initials[0], initials[-1], at, [cells[c][0] for c in at], [cells[c][1] for c in at])
    return pa.Table.from_pylist([dict(zip(SUMMARY.fieldNames(), out, strict=True))], schema=to_arrow_schema(SUMMARY))


SUMMARY = struct(block=LONG, conv_id=LONG, first=STR, last=STR, cells=T.ArrayType(INT), costs=T.ArrayType(LONG), ranks=T.ArrayType(INT))
CHOSEN = struct(block=LONG, start=INT, end=INT, before=STR, tail=INT)


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted block summaries: the states in which the best sequence enters and leaves each block."""
    for _, blocks in groupby(rows, key=itemgetter(1)):
        state, parents, names, befores, before = {0: (0, 0)}, [], [], [], None
        for block, _, first, last, cells, costs, ranks in blocks:
            width = max(ranks) + 1
            new: dict[int, tuple[int, int, int]] = {}
            for cell, cost, rank in zip(cells, costs, ranks, strict=True):
                start, end = divmod(cell, 4)
                if start in state:
                    offer = (state[start][0] + cost, state[start][1] * width + rank, start)
                    new[end] = min(new.get(end, offer), offer)
            order = {key: i for i, key in enumerate(sorted({v[1] for v in new.values()}))}
            state = {s: (v[0], order[v[1]]) for s, v in new.items()}
            parents.append(bytes(new[s][2] if s in new else 9 for s in range(4)))
            names.append(block)
            befores.append(before)
            before = last
        end = finish(state)
        tail, out = FINISH[end], []
        for block, parent, before in zip(reversed(names), reversed(parents), reversed(befores), strict=True):
            out.append((block, parent[end], end, before, tail))
            end, tail = parent[end], 0
        yield from out


EDITED = struct(conv_id=LONG, position=LONG, sub=INT, edit=STR, illegal=BOOL, new=STR)


def _rebuilt(_key: tuple, table: pa.Table, chosen: pa.Table) -> pa.Table:
    """The edits of a block between its chosen states."""
    schema = to_arrow_schema(EDITED)
    if not table.num_rows or not chosen.num_rows:
        return schema.empty_table()
    table, choice = table.sort_by("position"), chosen.to_pylist()[0]
    initials, faults, positions = (table[c].to_pylist() for c in ("initial", "fault", "position"))
    conv, start, before, out = table["conv_id"][0].as_py(), choice["start"], choice["before"], []
    codes = Layers(zip(initials, faults, strict=True), (start,)).codes(start, choice["end"])
    steps = list(played(codes, [("", i) for i in initials], start, choice["tail"]))
    for position, initial, step in zip(positions, initials, steps, strict=False):
        for sub, (edit, new) in enumerate(step):
            own = sub == len(step) - 1
            out.append((conv, position, sub, edit, (before is not None and before + initial not in LEGAL) if own else None, new))
        before = initial
    out += [(conv, positions[-1], 9 + i, "I", None, new) for i, (_, new) in enumerate(steps[-1])]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


FLAT = struct(conv_id=LONG, position=LONG, sub=INT, edit=STR, turn=LONG, was=STR, fault=STR, illegal=BOOL, role=STR, text=STR)


def _long(opened: DataFrame, block_bits: int) -> DataFrame:
    """The edits of open conversations, a row each (FLAT)."""
    rows = opened.where("copies > 0")
    # the first of equal turns by its position: no group is gathered, and positions are unique, so the join has no hot key
    digest = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    first = rows.groupBy("conv_id", digest.alias("digest")).agg(F.min("position").alias("position")).select("position", F.lit(True).alias("is_first"))
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    ended = F.substring(core, -1, 1).isin(*ENDS)
    fault = F.when(core == "", "blank").when(F.col("is_first").isNull(), "duplicate").when(~ended, "truncated")
    block = F.shiftright("position", block_bits).alias("block")
    marked = durable(rows.select("conv_id", "position", F.substring("role", 1, 1).alias("initial"), "text", block).join(first, "position", "left").select("conv_id", "position", "initial", "block", fault.alias("fault")))
    summary = marked.groupBy("block").applyInArrow(_summary, SUMMARY)
    chosen = durable(map_rows(summary.repartition("conv_id").sortWithinPartitions("conv_id", "block"), _fold, CHOSEN))
    edits = marked.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_rebuilt, EDITED)
    known = marked.select(F.col("position").alias("at"), "fault").join(rows.select(F.col("position").alias("at"), "turn", F.col("role").alias("was"), "text"), "at")
    joined = edits.join(known, (F.col("position") == F.col("at")) & F.col("illegal").isNotNull(), "left")  # an inserted turn has no illegal
    role = F.when(F.col("edit") == "K", F.col("was")).otherwise(F.col("new"))
    return joined.select("conv_id", "position", "sub", "edit", "turn", "was", "fault", "illegal", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


class Repair:
    """short: conv_id and turns, the edits of a conversation (array of EDIT).  long: FLAT, those of conversations at a partition's edges or too large for one task; long_ids: their conv_id, also where no turn is left."""

    def __init__(self, short: DataFrame, long: DataFrame, long_ids: DataFrame):
        self.short, self.long, self.long_ids = short, long, long_ids

    def turns(self) -> DataFrame:
        """conv_id, place (order within the conversation), edit, turn, was, fault, illegal, role, text: all edits, the deleted turns among them."""
        short = self.short.select("conv_id", F.posexplode("turns").alias("place", "e")).select("conv_id", F.col("place").cast("long"), "e.*")
        return short.unionByName(self.long.withColumn("place", F.col("position") * 16 + F.col("sub")).drop("position", "sub"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, copies (0: the turn is dropped, 2: repeated), role, text: damage by crc32 of conv_id:turn modulo 20."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(part("text"), ENDS, "")).when(case > 0, part("text")).otherwise("")
    return conversations.select("conv_id", "turn", F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"), F.when(case == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"))


def repair(turns: DataFrame, most: int = TURNS, most_bytes: int = BYTES, block_bits: int = BLOCK_BITS) -> Repair:
    """turns: conv_id, turn, role, text, and copies if there are such as ``damaged`` gives."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), copies.cast("int").alias("copies"), part("role").alias("role"), part("text").alias("text"))
    # equal turns are spread by their row, which orders nothing else
    keyed = rows.withColumns({"tie": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "tie", "row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "copies", "role", "text")
    staged = stored(map_rows(ranged, lambda it: _within(it, most, most_bytes, 1 << block_bits), STAGED))
    opened = staged.where("position IS NOT NULL")
    return Repair(staged.where("position IS NULL").select("conv_id", "turns"), _long(opened, block_bits), opened.select("conv_id").distinct())


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
DIGEST = T.StructType([T.StructField(c, STR if c in ("audit", "repaired_sha256") else LONG) for c in COLUMNS])
COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def _short_digest(short: DataFrame) -> DataFrame:
    turns = F.col("turns")
    count = lambda keep: F.size(F.filter(turns, keep)).cast("long")
    fault = lambda name: count(lambda t: t["fault"] == name)
    edits = lambda initial: count(lambda t: t["edit"] == initial)
    numbers = F.array_compact(F.transform(turns, lambda t: t["turn"]))
    span = F.try_subtract(F.array_max(numbers), F.array_min(numbers) + F.size(F.array_distinct(numbers)) - 1)
    gaps = F.when(F.size(numbers) > 0, span).otherwise(0).cast("long")
    cost = REROLE * edits("R") + DELETE * edits("D") + INSERT * edits("I")
    cut = CUT * count(lambda t: (t["fault"] == "truncated") & (t["edit"] != "D"))
    kept = F.transform(F.filter(turns, lambda t: t["edit"] != "D"), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return short.select(
        "conv_id", gaps.alias("gaps"), fault("blank").alias("blank"), fault("duplicate").alias("duplicate"), fault("truncated").alias("truncated"), count(lambda t: t["illegal"]).alias("illegal"),
        (cost + cut).cast("long").alias("cost"), F.array_join(F.transform(turns, lambda t: t["edit"]), "").alias("audit"), F.sha2(F.array_join(kept, "\n"), 256).alias("repaired_sha256"))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted edits (FLAT, a first row without an edit for each conversation): one row each, with no turn held."""
    for conv, edits in groupby(rows, key=itemgetter(0)):
        least = last = None
        distinct, faults, illegal, cost, audit, sha, begun = 0, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, [], hashlib.sha256(), False
        for _, _, _, edit, turn, _, fault, bad, role, text in edits:
            if edit is None:
                continue
            audit.append(edit)
            cost += COSTS[edit] + (CUT if fault == "truncated" and edit != "D" else 0)
            illegal += bool(bad)
            if fault:
                faults[fault] += 1
            if turn is not None:
                least = turn if least is None else least
                distinct += turn != last
                last = turn
            if edit != "D":
                sha.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                begun = True
        gaps = 0 if least is None else last - least + 1 - distinct
        yield (conv, gaps if gaps < 1 << 63 else None, *faults.values(), illegal, cost, "".join(audit), sha.hexdigest())


def digest(repaired: Repair) -> DataFrame:
    """The contract's columns for each conversation."""
    begin = repaired.long_ids.select("conv_id", *(F.lit(-1 if f.name == "position" else None).cast(f.dataType).alias(f.name) for f in FLAT.fields[1:]))
    flat = begin.unionByName(repaired.long)
    ordered = flat.repartition("conv_id").sortWithinPartitions("conv_id", "position", "sub")
    return _short_digest(repaired.short).unionByName(map_rows(ordered.select(*FLAT.fieldNames()), _digests, DIGEST))


def op12_repair(conversations: DataFrame) -> DataFrame:
    return digest(repair(damaged(conversations)))
