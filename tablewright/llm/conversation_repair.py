"""Conversation structure repair by the auction shortest-path algorithm.

A conversation is a lattice: a layer between any two rows, four states a layer (nothing
said yet, system, user, assistant spoke last), and an arc for each edit with its integer
cost.  A node's price is a bound of the cost from it to the end.  The auction keeps one
path from the origin: the path's last node either bids its price up to its cheapest arc
and is taken off the path (contraction), or, where its price equals that arc, the path grows by
it (extension).  At the end prices differ from the arcs' costs nowhere on a cheapest path,
so the tight arcs hold all cheapest repairs, and the one with the least letters is read
off them.  Long lattices are settled in blocks of ``BLOCK`` rows, last block first: exact
prices at a block's end are the costs of leaving it.

Rows are sorted by range, so that a conversation of any size spreads over tasks; what a
task has of it is cut into segments of bounded size.  Most conversations lie in one
segment and are done there.  Of the others each segment yields its 4 x 4 costs from state to
state; products of these, by partition and then by conversation, give every segment its
prices at the end, and the segments' maps of states, composed the same way, its state at
the beginning.  Then all segments are repaired independently.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import settle

#: Costs of the edits, by letter, and what keeping a truncated row adds.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
SEGMENT_ROWS = 1024
SEGMENT_CHARS = 4 << 20
BLOCK = 24
BATCH_CHARS = 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after speaking: users speak after all but a user, assistants after a user.
SPOKEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cost of ending a conversation in each state, by insertions.
FINAL = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
#: States from which a segment can be left in a state.
REACHING = {NOTHING: (NOTHING,), SYSTEM: (NOTHING, SYSTEM), USER: tuple(STATES), ASSISTANT: tuple(STATES)}


def _arcs(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row.

    Symbols: x must be deleted; s, u, a, o (other) is the role's initial; upper case: truncated.
    """
    found = [("D", DELETE, state)]
    if symbol != "x":
        extra, initial = TRUNCATED * symbol.isupper(), symbol.lower()
        if initial == "s" and state == NOTHING:
            found.append(("K", KEEP + extra, SYSTEM))
        elif (initial, SPOKEN[state]) in (("u", USER), ("a", ASSISTANT)):
            found.append(("K", KEEP + extra, SPOKEN[state]))
        found.append(("R", REROLE + extra, SPOKEN[state]))
    return found


ARCS = {symbol: [_arcs(symbol, state) for state in STATES] for symbol in "xsuaoSUAO"}
LEAST = {symbol: min(cost for arcs in by_state for _, cost, _ in arcs) for symbol, by_state in ARCS.items()}


def _auction(block: str, right: list[float], origins: tuple[int, ...]) -> list[list[float]]:
    """Prices of the layers before each row of ``block``, exact at the first for ``origins``.

    ``right`` are the costs of leaving in each state; a state without way out has infinite prices.
    """
    bounds = [min(right)]
    for symbol in reversed(block):
        bounds.append(bounds[-1] + LEAST[symbol])
    prices = [[bound if q in origins else inf for q in STATES] for bound in reversed(bounds)]
    prices[-1] = list(right)
    for origin in origins:
        path = [(0, origin)]
        while path[-1][0] < len(block):
            layer, state = path[-1]
            here, ahead = prices[layer], prices[layer + 1]
            best, to = INSERT + here[SPOKEN[state]], (layer, SPOKEN[state])
            for _, cost, after in ARCS[block[layer]][state]:
                if cost + ahead[after] < best:
                    best, to = cost + ahead[after], (layer + 1, after)
            if here[state] < best or best == inf:
                here[state] = best
                if len(path) > 1:
                    path.pop()
                elif best == inf:
                    break
            else:
                path.append(to)
    return prices


def _prices(symbols: str, right: list[float], origins: tuple[int, ...] = tuple(STATES)) -> list[list[float]]:
    """Prices of all layers; blocks are settled from the last to the first."""
    layers = [list(right)]
    for end in range(len(symbols), 0, -BLOCK):
        layers[:1] = _auction(symbols[max(0, end - BLOCK) : end], layers[0], origins)
    return layers


def _good(symbol: str, here: list[float], ahead: list[float], ending: list[bool]) -> list[bool]:
    """States of a layer that tight arcs lead to the end from."""
    found = [any(ending[after] and here[state] == cost + ahead[after] for _, cost, after in ARCS[symbol][state]) for state in STATES]
    for _ in range(2):
        found = [found[q] or (found[SPOKEN[q]] and here[q] == INSERT + here[SPOKEN[q]]) for q in STATES]
    return found


def _traced(symbols: str, layers: list[list[float]], entry: int) -> tuple[str, int]:
    """The least letters along tight arcs, and the state they end in."""
    good = [[price < inf for price in layers[-1]]]
    for layer in range(len(symbols) - 1, -1, -1):
        good.append(_good(symbols[layer], layers[layer], layers[layer + 1], good[-1]))
    good.reverse()
    letters, layer, state = [], 0, entry
    while layer < len(symbols):
        here, ahead = layers[layer], layers[layer + 1]
        arcs = [(letter, layer + 1, after) for letter, cost, after in ARCS[symbols[layer]][state]
                if good[layer + 1][after] and here[state] == cost + ahead[after]]
        if good[layer][SPOKEN[state]] and here[state] == INSERT + here[SPOKEN[state]]:
            arcs.append(("I", layer, SPOKEN[state]))
        letter, layer, state = min(arcs)
        letters.append(letter)
    return "".join(letters), state


def _solved(symbols: str, right: tuple[float, ...], entry: int) -> tuple[str, int, int]:
    """Letters, state at the end and cost of the cheapest repair."""
    layers = _prices(symbols, list(right))
    letters, state = _traced(symbols, layers, entry)
    return letters, state, int(layers[0][entry] - right[state])


_solved_often = lru_cache(maxsize=20_000)(_solved)


def cheapest_repair(symbols: str) -> tuple[str, int]:
    """Letters (D, I, K, R) and cost of the cheapest repair of a whole conversation; of equal ones the ASCII-least."""
    letters, state, cost = _solved(symbols, FINAL, NOTHING)
    return letters + "I" * (FINAL[state] // INSERT), cost + FINAL[state]


def _transfer(symbols: str) -> list[int | None]:
    """Cost from each state (rows) to each (columns); None where there is no way."""
    if not symbols:
        return [0 if a == b else None for a in STATES for b in STATES]
    costs: list[int | None] = [None] * 16
    for to in STATES:
        first = _prices(symbols, [0 if q == to else inf for q in STATES], REACHING[to])[0]
        for q in REACHING[to]:
            costs[4 * q + to] = int(first[q]) if first[q] < inf else None
    return costs


def _joined(a: list, b: list) -> list:
    """Min-plus product of two transfers, ``a`` before ``b``."""
    return [min((a[4 * i + k] + b[4 * k + j] for k in STATES if a[4 * i + k] is not None and b[4 * k + j] is not None),
                default=None) for i in STATES for j in STATES]


def _priced(costs: list, right: list) -> list:
    """Prices before a transfer, from those after it; the fifth entry marks the end of the conversation."""
    return [min(costs[4 * q + k] + right[k] for k in STATES if costs[4 * q + k] is not None) for q in STATES] + [0]


# Damage and segments


def damaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text, at and gone; a dropped row stays as a mark of its conversation."""
    space = F.lit(" ")
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), space) for c in (conv_col, turn_col)]
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), space) for c in (role_col, text_col))
    rows = df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.crc32(F.concat_ws(":", *shown)) % 20).alias("fate"), F.monotonically_increasing_id().alias("at"),
    )
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        "at", (F.col("fate") == 0).alias("gone"),
    )


def undamaged(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """As ``damaged``, without damage."""
    space = F.lit(" ")
    return df.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), space).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))],
        F.monotonically_increasing_id().alias("at"), F.lit(False).alias("gone"),
    )


def _alike(a: object, b: object) -> bool:
    return a == b or (a != a and b != b)


class _Segment:
    """Consecutive rows of a conversation inside one partition."""

    def __init__(self, conv: object, number: int, seen: set[bytes]):
        self.conv, self.number, self.seen, self.chars, self.marks = conv, number, seen, 0, 0
        self.roles, self.texts, self.digests, self.fresh = [], [], [], []
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, gone: bool) -> None:
        self.marks += 1
        if gone:
            return
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        self.fresh.append(digest not in self.seen)
        self.seen.add(digest)
        self.digests.append(digest)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)
        if turn is not None:
            if self.last_turn != turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    @property
    def full(self) -> bool:
        return self.marks >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS


SEGMENT_FIELDS = ("pid int, seg int, open boolean, roles array<string>, texts array<string>, fresh array<boolean>, "
                  "digests array<binary>, first_turn long, last_turn long, turns long")


def _segments(rows: DataFrame) -> DataFrame:
    """Rows in order, cut into segments; ``open`` ones may be parts of a longer conversation."""
    ordered = rows.withColumn("digest", F.md5("text"))
    ordered = ordered.repartitionByRange(*_order(), F.asc("at")).sortWithinPartitions(*_order(), F.asc("at"))
    conv_type = rows.schema["conv"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, held_chars = TaskContext.get().partitionId(), [], 0
        now, first, split, conv_kind = None, True, False, None

        def batch() -> pa.RecordBatch:
            return pa.record_batch({
                "conv": pa.array([s.conv for s, _ in held], conv_kind), "pid": pa.array([pid] * len(held), pa.int32()),
                "seg": pa.array([s.number for s, _ in held], pa.int32()), "open": pa.array([o for _, o in held]),
                "roles": pa.array([s.roles for s, _ in held], pa.list_(pa.string())),
                "texts": pa.array([s.texts for s, _ in held], pa.list_(pa.string())),
                "fresh": pa.array([s.fresh for s, _ in held], pa.list_(pa.bool_())),
                "digests": pa.array([s.digests if o else None for s, o in held], pa.list_(pa.binary())),
                "first_turn": pa.array([s.first_turn for s, _ in held], pa.int64()),
                "last_turn": pa.array([s.last_turn for s, _ in held], pa.int64()),
                "turns": pa.array([s.turns for s, _ in held], pa.int64()),
            })

        for rows in batches:
            conv_kind = rows.schema.field("conv").type
            for conv, turn, role, text, gone in zip(*(rows.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone")), strict=True):
                if now is None or not _alike(now.conv, conv):
                    if now is not None:
                        held.append((now, first or split))
                        held_chars += now.chars
                        first = False
                    now, split = _Segment(conv, 0, set()), False
                elif now.full:
                    held.append((now, True))
                    held_chars += now.chars
                    now, split = _Segment(conv, now.number + 1, now.seen), True
                now.add(turn, role, text, gone)
                if held_chars >= BATCH_CHARS or len(held) >= 1000:
                    yield batch()
                    held, held_chars = [], 0
        if now is not None:
            held.append((now, True))
            yield batch()

    found = ordered.select("conv", "turn", "role", "text", "gone").mapInArrow(cut, f"conv {conv_type}, {SEGMENT_FIELDS}")
    return settle(found, "segments")


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _seen_before(opened: DataFrame) -> DataFrame:
    """Adds ``later``: positions whose role and text an earlier partition has in the same conversation."""
    at = ["conv", "pid", "seg"]
    fresh = opened.select(*at, F.posexplode(F.arrays_zip("digests", "fresh")).alias("pos", "row")).where("row.fresh")
    fresh = fresh.select(*at, "pos", F.col("row.digests").alias("digest"))
    first = fresh.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("pid").alias("origin"), F.max("pid").alias("last"))
    first = first.where("origin < last")
    known = fresh.join(first, fresh["conv"].eqNullSafe(first["c"]) & (fresh["digest"] == first["d"])).where("pid > origin")
    later = known.groupBy(*at).agg(F.collect_list("pos").alias("later"))
    return _with(opened, later)


def _with(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("conv", "pid", "seg")) -> DataFrame:
    """Left join on columns that may be null."""
    names = {c: F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns}
    other = right.select(*names.values())
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[f"_{c}"]) for c in on])
    return left.join(other, same, "left").drop(*[f"_{c}" for c in on])


def _symbols(roles: list[str], texts: list[str], fresh: list[bool], later: list[int] | None) -> tuple[str, dict[str, int]]:
    """A symbol a row, and how many rows have which first fault."""
    later, found, faults = set(later or ()), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for at, (role, text) in enumerate(zip(roles, texts, strict=True)):
        said = text.rstrip(BLANKS)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not said:
            faults["blank"] += 1
            found.append("x")
        elif not fresh[at] or at in later:
            faults["duplicate"] += 1
            found.append("x")
        elif said[-1] not in ENDS:
            faults["truncated"] += 1
            found.append(initial.upper())
        else:
            found.append(initial)
    return "".join(found), faults


def _per_segment(segments: DataFrame, columns: list[str], name: str, work: Callable[..., list]) -> DataFrame:
    """(conv, pid, seg, name): work(symbols, other columns) of each segment, a list of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("roles", "texts", "fresh", "later", *columns)]
            values = [work(_symbols(*row[:4])[0], *row[4:]) for row in zip(*lists, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("conv", "pid", "seg")), pa.array(values, pa.list_(pa.int64()))],
                                  names=["conv", "pid", "seg", name])

    kind = segments.schema["conv"].dataType.simpleString()
    picked = segments.select("conv", "pid", "seg", "roles", "texts", "fresh", "later", *columns)
    return picked.mapInArrow(run, f"conv {kind}, pid int, seg int, {name} array<long>")


def _scanned(
    table: DataFrame, value: str, name: str, start: list[int], join: Callable[[list, list], list],
    act: Callable[[list, list], list], backward: bool,
) -> DataFrame:
    """(conv, pid, seg, name): the state that each segment meets, all others before it applied to ``start``.

    Values are joined within partitions, the states run over a conversation's partitions (a row
    each), and then over the segments of each partition: no task holds more of a
    conversation than one partition's segments or one row a partition.
    """
    kind = table.schema["conv"].dataType.simpleString()

    def rows_of(found: pa.Table, order: str) -> list[dict]:
        return sorted(found.to_pylist(), key=lambda r: r[order], reverse=backward)

    def total(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["seg"])
        return pa.table({"conv": found["conv"][:1], "pid": found["pid"][:1],
                         value: pa.array([reduce(join, [r[value] for r in rows])], pa.list_(pa.int64()))})

    def run(order: str, begin: str | None) -> Callable[[pa.Table], pa.Table]:
        def over(found: pa.Table) -> pa.Table:
            rows = rows_of(found, order)
            state, states = rows[0][begin] if begin else start, []
            for row in rows:
                states.append(state)
                state = act(row[value], state)
            columns = {"conv": pa.array([r["conv"] for r in rows], found.schema.field("conv").type),
                       "pid": pa.array([r["pid"] for r in rows], pa.int32())}
            if order == "seg":
                columns["seg"] = pa.array([r["seg"] for r in rows], pa.int32())
            return pa.table(columns | {name: pa.array(states, pa.list_(pa.int64()))})

        return over

    totals = table.groupBy("conv", "pid").applyInArrow(total, f"conv {kind}, pid int, {value} array<long>")
    outer = totals.groupBy("conv").applyInArrow(run("pid", None), f"conv {kind}, pid int, {name} array<long>")
    inner = _with(table, outer.withColumnRenamed(name, "begin"), ("conv", "pid"))
    return inner.groupBy("conv", "pid").applyInArrow(run("seg", "begin"), f"conv {kind}, pid int, seg int, {name} array<long>")


def _exits(symbols: str, prices: list[int]) -> list[int]:
    """The state in which each state's repair leaves the segment."""
    layers = _prices(symbols, prices[:4])
    return [_traced(symbols, layers, q)[1] for q in STATES]


def _bounded(opened: DataFrame) -> DataFrame:
    """Adds prices (at the end, and whether that is the conversation's) and entry (state at the beginning)."""
    transfers = settle(_per_segment(opened, [], "costs", _transfer), "transfers")
    prices = settle(_scanned(transfers, "costs", "prices", [*FINAL, 1], _joined, _priced, True), "prices")
    priced = _with(opened, prices)
    exits = settle(_per_segment(priced, ["prices"], "exits", _exits), "exits")
    compose = lambda a, b: [b[q] for q in a]
    entries = _scanned(exits, "exits", "entry", [NOTHING], compose, lambda found, state: [found[state[0]]], False)
    return _with(priced, entries)


REPAIR_FIELDS = (
    "pid int, seg int, open boolean, audit string, messages array<struct<role:string,text:string>>, blank long, "
    "duplicate long, truncated long, illegal long, cost long, first_initial string, last_initial string, "
    "first_turn long, last_turn long, turns long"
)


def _repaired(row: dict) -> dict:
    """One segment's repair."""
    roles, texts = row["roles"], row["texts"]
    symbols, faults = _symbols(roles, texts, row["fresh"], row["later"])
    *right, last = row["prices"] or [*FINAL, 1]
    entry = (row["entry"] or [NOTHING])[0]
    solve = _solved_often if len(symbols) <= 64 else _solved
    letters, state, cost = solve(symbols, tuple(right), entry)
    if last:
        letters, cost = letters + "I" * (FINAL[state] // INSERT), cost + FINAL[state]
    messages, at, state = [], 0, entry
    for letter in letters:
        if letter == "I":
            state = SPOKEN[state]
            messages.append({"role": ROLES[state], "text": ""})
            continue
        if letter == "K":
            state = SYSTEM if symbols[at] in "sS" else SPOKEN[state]
            messages.append({"role": roles[at], "text": texts[at]})
        elif letter == "R":
            state = SPOKEN[state]
            messages.append({"role": ROLES[state], "text": texts[at]})
        at += 1
    illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
    return faults | {
        "audit": letters, "messages": messages, "illegal": illegal, "cost": cost,
        "first_initial": roles[0][:1] if roles else None, "last_initial": roles[-1][:1] if roles else None,
    }


def repaired(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    damage: bool = False,
) -> DataFrame:
    """Conversations repaired at least cost: one row a segment, ordered by pid and seg within ``conv``.

    ``messages`` are the repaired rows and ``audit`` the edits (Keep, Rerole, Delete, Insert)
    of the segment; blank, duplicate, truncated, illegal and cost are its counts, where illegal
    pairs and turns across segments follow from first_initial, last_initial, first_turn and
    last_turn.  ``open`` is false where the segment is a whole conversation.

    * Rows go by turn (null first), then role, then the MD5 of the text, so that rows of one
      turn have an order too; a null role or text is one space (a blank row).  Equal rows are duplicates.
    * A null conversation id is a conversation of its own.
    * Every conversation is there, one without rows after damage with no messages.
    * Only the four columns are read; others may have any name.  An empty table gives an empty result.
    * ``damage`` first applies the deterministic damage of the tests to each row.
    """
    rows = (damaged if damage else undamaged)(df, conv_col, turn_col, role_col, text_col)
    kind = rows.schema["conv"].dataType
    segments = _segments(rows)
    segments = segments.withColumn("later", F.lit(None).cast("array<int>"))
    opened = _bounded(_seen_before(segments.where("open").drop("later")))
    none = F.lit(None).cast("array<long>")
    closed = segments.where("not open").withColumns({"prices": none, "entry": none})
    both = closed.unionByName(opened.select(*closed.columns))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                found = [_repaired(r) for r in part.select(["roles", "texts", "fresh", "later", "prices", "entry"]).to_pylist()]
                columns = {c: part.column(c) for c in ("conv", "pid", "seg", "open")}
                said = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                for name, t in (("audit", pa.string()), ("messages", said), ("blank", pa.int64()), ("duplicate", pa.int64()),
                                ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                                ("first_initial", pa.string()), ("last_initial", pa.string())):
                    columns[name] = pa.array([r[name] for r in found], t)
                yield pa.record_batch(columns | {c: part.column(c) for c in ("first_turn", "last_turn", "turns")})

    return both.drop("digests").mapInArrow(repair, f"conv {kind.simpleString()}, {REPAIR_FIELDS}")


def messages(repairs: DataFrame) -> DataFrame:
    """conv, pid, seg, position, role and text of each repaired row."""
    return repairs.select("conv", "pid", "seg", F.posexplode("messages").alias("position", "message")).select(
        "conv", "pid", "seg", "position", "message.role", "message.text")


def audited(repairs: DataFrame) -> DataFrame:
    """One row a conversation: gaps, counts, cost, audit and the SHA-256 of the repaired rows.

    Whole conversations are digested where they are.  Parts of others meet in order in one
    task, which a hash of the whole asks for; it is fed part by part, so the task's memory does
    not grow with the texts (the audit, a letter a row, is the one thing it gathers).
    """
    kind = repairs.schema["conv"].dataType.simpleString()
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    fields = f"conv {kind}, gaps long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_kind, now, done = None, None, []

        def batch() -> pa.RecordBatch:
            columns = {"conv": pa.array([d["conv"] for d in done], conv_kind), "gaps": pa.array([
                d["last"] - d["first"] + 1 - d["turns"] if d["first"] is not None else 0 for d in done], pa.int64())}
            columns |= {c: pa.array([d[c] for d in done], pa.int64()) for c in counts}
            return pa.record_batch(columns | {"audit": pa.array(["".join(d["audit"]) for d in done], pa.string()),
                                              "repaired_sha256": pa.array([d["sha"].hexdigest() for d in done])})

        for rows in batches:
            conv_kind = rows.schema.field("conv").type
            for at in range(len(rows)):
                row = rows.slice(at, 1).to_pylist()[0]
                if now is None or not _alike(now["conv"], row["conv"]):
                    if now is not None:
                        done.append(now)
                    now = dict.fromkeys(counts, 0) | {"conv": row["conv"], "sha": hashlib.sha256(), "audit": [], "said": False,
                                                      "first": None, "last": None, "turns": 0, "initial": None}
                for c in counts:
                    now[c] += row[c]
                now["audit"].append(row["audit"])
                for message in row["messages"]:
                    line = f"{message['role']}:{message['text']}".encode("utf-8", "surrogatepass")
                    now["sha"].update(b"\n" + line if now["said"] else line)
                    now["said"] = True
                if row["first_initial"] is not None:
                    now["illegal"] += now["initial"] is not None and now["initial"] + row["first_initial"] not in LEGAL
                    now["initial"] = row["last_initial"]
                if row["first_turn"] is not None:
                    now["turns"] += row["turns"] - (now["last"] == row["first_turn"])
                    now["first"] = row["first_turn"] if now["first"] is None else now["first"]
                    now["last"] = row["last_turn"]
                if len(done) >= 1000:
                    yield batch()
                    done = []
        if now is not None:
            done.append(now)
            yield batch()

    whole = repairs.where("not open").mapInArrow(digest, fields)
    parts = repairs.where("open").repartition("conv").sortWithinPartitions("conv", "pid", "seg").mapInArrow(digest, fields)
    return whole.unionByName(parts)
