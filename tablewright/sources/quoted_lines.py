"""Records of delimited text whose quoted cells span lines, read by as many tasks as the size asks for.

Whether a line begins inside a quoted cell depends on all text before it, so a reader of
one file from its start is the obvious way, and one task per file its price.  Here every
line says how it would end if it began outside and if it began inside quotes: a function
of two states, of which there are four kinds (it keeps the state, swaps it, or always
ends outside or inside).  Such functions are composed in any grouping:

1. every split of a file composes its lines, each with one state unknown (one narrow row
   a split);
2. a window over the splits of a file gives each its true first state;
3. a second pass, which knows it, puts the lines of a split together to records.  Only a
   record that crosses the border of splits is in pieces; at most two pieces a split meet
   in a shuffle keyed by the split that the record began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

# Doubled quotes keep the state whether they are an escape or an empty cell; the rest is
# judged without them.  A closed cell becomes a letter, so that nothing new begins after it.
DOUBLED = '""'
CLOSED = '(^|,)"[^"]*+"'
OPENING = '(^|,)"'
# What a line that begins inside quotes has before it.
INSIDE = '"x'


class Border(NamedTuple):
    """What a split has to know of the splits before it."""

    begun: int | None  # block that the record in progress began in, None outside quotes
    header: int | None  # number of the line that begins the file's header, if it is here


def single_quotes(line: Column) -> Column:
    """The line without its doubled quotes."""
    return F.replace(line, F.lit(DOUBLED), F.lit(""))


def outside_quotes(line: Column) -> Column:
    """The line with every closed quoted cell replaced by a letter."""
    rest = single_quotes(line)
    return F.when(F.contains(rest, F.lit('"')), F.regexp_replace(rest, CLOSED, "$1x")).otherwise(rest)


def left_open(line: Column) -> Column:
    """Whether a line that begins outside quotes ends inside."""
    rest = single_quotes(line)
    return F.contains(rest, F.lit('"')) & F.regexp_replace(rest, CLOSED, "$1x").rlike(OPENING)


def is_left_open(line: str) -> bool:
    """The same for a single line on the driver."""
    return re.search(OPENING, re.sub(CLOSED, r"\1x", line.replace(DOUBLED, ""))) is not None


def _numbered(lines: DataFrame, encoding: str) -> DataFrame:
    """file, block, text and its ends: bit 0 if it began outside, bit 1 if inside quotes."""
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    text = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("text"))
    # Most lines inside a long cell have no single quote and keep either state; only the
    # others are searched.
    ends = F.when(
        F.contains(single_quotes(F.col("text")), F.lit('"')),
        left_open(F.col("text")).cast("int") + 2 * left_open(F.concat(F.lit(INSIDE), "text")).cast("int")).otherwise(2)
    return placed.select("file", "block", "text", ends.cast("tinyint").alias("ends"), (F.trim("text") == "").alias("blank"))


def _stretches(batches: Iterator[pa.RecordBatch]):
    """(file, block, rows) in the order of the scan, each of one split or a part of it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        last = batch.num_rows - 1
        change = pc.or_(pc.not_equal(file.slice(1), file.slice(0, last)), pc.not_equal(block.slice(1), block.slice(0, last)))
        cuts = [0, *(np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            yield file[begin].as_py(), block[begin].as_py(), batch.slice(begin, end - begin)


def _inside_after(ends: np.ndarray, first: bool) -> np.ndarray:
    """Per line whether it ends inside quotes, given the state before the first one."""
    outside, inside = (ends & 1).astype(bool), (ends & 2).astype(bool)
    places = np.arange(len(ends))
    fixed = np.maximum.accumulate(np.where(outside == inside, places, -1))
    swaps = np.cumsum(outside & ~inside)
    known = fixed >= 0
    state = np.where(known, outside[fixed], first)
    return state ^ ((swaps - np.where(known, swaps[fixed], 0)) % 2).astype(bool)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: its end from either first state, where it opened a record last, its first text."""
    split, state, opened, line, header = None, [False, True], [False, False], 0, None

    def row() -> pa.RecordBatch:
        values = (*split, *state, *opened, header)
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _SPLITS)], schema=_SPLITS)

    for file, block, rows in _stretches(batches):
        if split != (file, block):
            if split is not None:
                yield row()
            split, state, opened, line, header = (file, block), [False, True], [False, False], 0, None
        ends = rows.column("ends").to_numpy()
        for first in (0, 1):
            after = _inside_after(ends, state[first])
            before = np.concatenate([[state[first]], after[:-1]])
            # A record that began here and is still open: the state was outside at some line.
            opened[first] = opened[first] or bool((~before).any())
            state[first] = bool(after[-1])
        if header is None:
            texts = np.flatnonzero(~rows.column("blank").to_numpy(zero_copy_only=False))
            header = line + int(texts[0]) if len(texts) else None
        line += rows.num_rows
    if split is not None:
        yield row()


_SPLITS = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("end0", pa.bool_()), ("end1", pa.bool_()),
    ("began0", pa.bool_()), ("began1", pa.bool_()), ("header", pa.int64()),
])
_SPLITS_DDL = "file string, block long, end0 boolean, end1 boolean, began0 boolean, began1 boolean, header long"


def _true_states(splits: DataFrame) -> DataFrame:
    """Adds inside (the true state before a split), begun (where its record began) and last (of its file)."""
    along = Window.partitionBy("file").orderBy("block")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    fixed, swap = F.col("end0") == F.col("end1"), F.col("end0") & ~F.col("end1")
    turns = splits.withColumn("swaps", F.sum(swap.cast("int")).over(so_far))
    anchor = F.last(F.when(fixed, F.struct("end0", "swaps")), ignorenulls=True).over(earlier)
    passed = F.coalesce(F.lag("swaps").over(along), F.lit(0)) - F.coalesce(anchor["swaps"], F.lit(0))
    turns = turns.withColumn("inside", F.coalesce(anchor["end0"], F.lit(False)) != (passed % 2 == 1))
    began = F.when(F.col("inside"), F.col("began1")).otherwise(F.col("began0"))
    return turns.withColumns({
        "begun": F.when(F.col("inside"), F.last(F.when(began, F.col("block")), ignorenulls=True).over(earlier)),
        "end": F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0")),
        "last": F.lead("block").over(along).isNull(),
        "head": F.min(F.when(F.col("header").isNotNull(), F.col("block"))).over(Window.partitionBy("file")) == F.col("block"),
    })


def borders(lines: DataFrame, encoding: str) -> dict[tuple[str, int], Border]:
    """The splits that begin inside a record or hold a header; all others begin outside.

    At most a row a split reaches the driver, which holds the list of splits anyway.
    """
    splits = _numbered(lines, encoding).mapInArrow(_composed, _SPLITS_DDL)
    told = _true_states(splits).where("inside or head or (last and end)").collect()
    if any(row["last"] and row["end"] for row in told):
        raise ValueError("A quoted cell is never closed.")
    return {(r["file"], r["block"]): Border(r["begun"], r["header"] if r["head"] else None) for r in told}


_RECORDS = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("part", pa.int64()),
    ("head", pa.bool_()), ("piece", pa.bool_()), ("text", pa.string()),
])
_RECORDS_DDL = "file string, block long, line long, part long, head boolean, piece boolean, text string"


def records(lines: DataFrame, encoding: str, known: dict[tuple[str, int], Border]) -> DataFrame:
    """file, block and line (where a record begins), head (of its file) and text, one row a record.

    Line ends inside a cell read as ``\\n``; blank lines between records are left out.
    """
    none = Border(None, None)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, line, begun, begin, head, kept = None, 0, None, 0, False, []

        def unfinished():
            # A record goes on in the next split: its lines here are one piece.
            return [(split[0], begun, begin, split[1], head, True, "\n".join(kept))]

        for file, block, rows in _stretches(batches):
            if split != (file, block):
                if kept:
                    yield _batch(unfinished())
                split, line, kept, head = (file, block), 0, [], False
                begun, begin = known.get(split, none).begun, -1
            header = known.get(split, none).header
            after = _inside_after(rows.column("ends").to_numpy(), begun is not None)
            before = np.concatenate([[begun is not None], after[:-1]])
            alone = ~(before | after)
            # Records of one line stay in Arrow; the others are few and put together here.
            plain = pa.array(alone & ~rows.column("blank").to_numpy(zero_copy_only=False))
            numbers = pa.array(np.arange(line, line + rows.num_rows))
            whole = rows.append_column("line", numbers).filter(plain)
            blocks, no = pa.array(np.full(whole.num_rows, block)), pa.array(np.zeros(whole.num_rows, dtype=bool))
            heads = pc.equal(whole.column("line"), pa.scalar(-1 if header is None else header, pa.int64()))
            short = pa.record_batch(
                [whole.column("file"), blocks, whole.column("line"), blocks, heads, no, whole.column("text")], schema=_RECORDS)
            found, closed = [], []
            spans = np.flatnonzero(~alone)
            for place, text in zip(spans.tolist(), rows.column("text").take(pa.array(spans)).to_pylist()):
                if not before[place]:
                    begun, begin, head, kept = block, line + place, line + place == header, []
                kept.append(text)
                if not after[place]:
                    found.append((file, begun, begin, block, head, begun != block, "\n".join(kept)))
                    closed.append(line + place)
                    begun, kept, head = None, [], False
            line += rows.num_rows
            if found:  # back in the order of the file
                order = np.argsort(np.concatenate([whole.column("line").to_numpy(), closed]), kind="stable")
                short = pa.concat_batches([short, _batch(found)]).take(pa.array(order))
            if short.num_rows:
                yield short
        if kept:
            yield _batch(unfinished())

    def _batch(found) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*found), _RECORDS)], schema=_RECORDS)

    put_together = _numbered(lines, encoding).mapInArrow(assemble, _RECORDS_DDL)
    columns = ["file", "block", "line", "head", "text"]
    whole = put_together.where(~F.col("piece")).select(*columns)
    if all(border.begun is None for border in known.values()):
        return whole
    piece = F.struct("part", "text", "line", "head")
    joined = put_together.where("piece").groupBy("file", "block").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    first = F.get("pieces", F.lit(0))
    crossing = joined.select(
        "file", "block", first["line"].alias("line"), first["head"].alias("head"),
        F.array_join(F.col("pieces.text"), "\n").alias("text"))
    return whole.unionByName(crossing)
