"""Repeated passages: Rabin-Karp hashes of every 20-word window, counted over all documents.

Every window of 20 consecutive words gets a polynomial rolling hash.  A window is repeated
when the same hash starts earlier: in a document of smaller id, or earlier in its own.
Words that repeated windows cover are removed; overlapping windows merge into maximal
intervals.

The windows outnumber everything else, so they travel packed: a task sorts the windows of
a block of documents into ranges of hashes and ships, for each range, one binary row with
the low bytes of the hashes and differences of positions (about 8 bytes a window).  Inside
a block only the first window of a hash goes on, the others are known to be repeated.  So
a passage shared by a third of all documents reaches the task that counts it once a block.
Repeated windows travel on to their documents in the same form.  A range is a bounded
share of the windows: their number follows the size of the texts, and windows known to be
repeated are dealt to the ranges by a hash of their document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WordHashes, as_bytes, blocks, mixed, settle

WINDOW = 20
#: Text whose windows one counting task holds, about; the number of ranges is a power of two.
RANGE_BYTES = 4 << 20
#: Text of a block: what is resolved before the shuffle.
PACK_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15

_WORDS = WordHashes()


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the sum of hash[i + k] * base ** (width - 1 - k), modulo 2 ** 64, for every i.

    Windows of a power of two words come from pairs of half their size; those that make up
    ``width`` are joined, so a window costs a few multiplications whatever its width.
    """
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    total, span = np.zeros(len(hashes) + 1, np.uint64), 0
    doubled, size, power = hashes, 1, _BASE
    while size <= width:
        if width & size:
            count = len(hashes) - span - size + 1
            total = total[:count] * np.uint64(power) + doubled[span : span + count]
            span += size
        count = max(len(doubled) - size, 0)
        doubled = doubled[:count] * np.uint64(power) + doubled[size : size + count]
        size, power = size * 2, power * power % 2**64
    return total


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, one plane after another: equal high bytes compress."""
    little = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(little[:, :width].T).tobytes()


def _from_planes(data: bytes, count: int, width: int) -> np.ndarray:
    full = np.zeros((count, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8).reshape(width, count).T
    return full.view("<u8").ravel()


def _pack(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray, positions: np.ndarray, width: int) -> bytes:
    """Windows in order of (id, position): ids with their number of windows, hashes, positions as differences."""
    steps = np.diff(positions, prepend=0)
    steps[np.cumsum(counts)[:-1]] = positions[np.cumsum(counts)[:-1]]
    head = struct.pack("<II", len(ids), len(hashes))
    return (head + ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
            + _planes(steps.astype(np.uint64), 4) + _planes(hashes, width))


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, positions, hashes), a value for each window."""
    n_ids, n = struct.unpack_from("<II", data)
    at = 8
    ids = np.frombuffer(data, "<i8", n_ids, at)
    counts = np.frombuffer(data, "<u4", n_ids, at := at + 8 * n_ids)
    steps = _from_planes(data[(at := at + 4 * n_ids) : at + 4 * n], n, 4).astype(np.int64)
    hashes = _from_planes(data[(at := at + 4 * n) : at + width * n], n, width)
    starts = np.cumsum(counts) - counts
    sums = np.cumsum(steps)
    return np.repeat(ids, counts), sums - np.repeat(sums[starts] - steps[starts], counts), hashes


def _packed_by(groups: np.ndarray, ids: np.ndarray, positions: np.ndarray, hashes: np.ndarray, width: int):
    """(group, packed windows) of each group; windows come in order of (id, position) or get it."""
    order = np.lexsort((positions, ids, groups))
    groups, ids, positions, hashes = groups[order], ids[order], positions[order], hashes[order]
    cuts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])
    for start, stop in zip(cuts, cuts[1:]):
        if start < stop:
            own = ids[start:stop]
            first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            counts = np.diff(first, append=len(own))
            yield int(groups[start]), _pack(own[first], counts, hashes[start:stop], positions[start:stop], width)


def _windows(texts: DataFrame, window: int, range_bits: int) -> DataFrame:
    """(range, packed, known): windows of a range of hashes; windows known to be repeated, by their documents."""
    width = 8 - range_bits // 8

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            all_texts = as_bytes(batch.column(1))
            for begin, stop in blocks(all_texts, PACK_BYTES):
                ids, positions, hashes = [], [], []
                for at in begin + np.argsort(all_ids[begin:stop], kind="stable"):
                    rolled = _rolled(_WORDS.of(all_texts[at].split()), window)
                    hashes.append(rolled)
                    ids.append(np.full(len(rolled), all_ids[at]))
                    positions.append(np.arange(len(rolled), dtype=np.uint32))
                yield _sorted_out(*map(np.concatenate, (ids, positions, hashes)))

    def _sorted_out(ids, positions, hashes) -> pa.RecordBatch:
        hashes = mixed(hashes)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = ordered[1:] == ordered[:-1]
        del order, ordered
        fresh = ~again
        ranges = (hashes[fresh] >> np.uint64(64 - range_bits)).astype(np.int64)
        rows = [(k, data, None) for k, data in _packed_by(ranges, ids[fresh], positions[fresh], hashes[fresh], width)]
        dealt = (mixed(ids[again].view(np.uint64)) >> np.uint64(64 - range_bits)).astype(np.int64)
        rows += [(k, None, data) for k, data in _packed_by(dealt, ids[again], positions[again], hashes[again], 0)]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch(
            [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["range", "packed", "known"])

    return texts.mapInArrow(work, "range long, packed binary, known binary")


def _all_of(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_unpack(data, width) for data in column.drop_null().to_pylist()]
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else none


def _repeated(range_bits: int, target_bits: int):
    """Counts the windows of one range; all but the earliest of a hash go on, packed by targets of ids."""
    width = 8 - range_bits // 8

    def work(table: pa.Table) -> pa.Table:
        ids, positions, hashes = _all_of(table["packed"], width)
        order = np.lexsort((positions, ids, hashes))
        ordered = hashes[order]
        later = order[1:][ordered[1:] == ordered[:-1]]
        known = _all_of(table["known"], 0)
        ids, positions = np.concatenate([ids[later], known[0]]), np.concatenate([positions[later], known[1]])
        targets = (mixed(ids.view(np.uint64)) >> np.uint64(64 - target_bits)).astype(np.int64)
        rows = list(_packed_by(targets, ids, positions, np.zeros(len(ids), np.uint64), 0))
        return pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())],
                        ["target", "packed"])

    return work


def _starts(table: pa.Table) -> pa.Table:
    """(id, starts) of the documents of one target."""
    ids, positions, _ = _all_of(table["packed"], 0)
    order = np.lexsort((positions, ids))
    ids, positions = ids[order], positions[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    offsets = pa.array(np.append(first, len(ids)), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(positions, pa.int32()))
    return pa.table([pa.array(ids[first], pa.int64()), lists], ["id", "starts"])


def _covered(starts: list[int], window: int) -> list[list[int]]:
    """Maximal word intervals [begin, end) that the windows cover."""
    spans: list[list[int]] = []
    for start in sorted(starts):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = start + window
        else:
            spans.append([start, start + window])
    return spans


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, starts): the starts of all repeated windows of each document that has any.

    A window is repeated when the same words start earlier: in a document of smaller id, or
    before it in the same document.  A null id takes no part.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = max(6, int(size // RANGE_BYTES).bit_length())
    target_bits = range_bits - 3
    found = _windows(texts, window, range_bits).groupBy("range").applyInArrow(
        _repeated(range_bits, target_bits), "target long, packed binary")
    return found.groupBy("target").applyInArrow(_starts, "id long, starts array<int>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, intervals, kept_text) of every row.

    intervals are the maximal [begin, end) runs of words that repeated windows cover;
    kept_text holds the other words, joined by one space.

    * A null text has no words and an empty kept_text; texts shorter than a window stay.
    * A null id takes no part in the search and keeps all its words.
    * Ids must be integers and unique; of rows with one id, windows at the same position
      count as one window, and all of the rows lose the words found for the id.
    """
    starts = settle(repeated_passages(docs, id_col, text_col, window), "repeated").withColumnRenamed("id", "_id")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()))
            for begin, stop in blocks([text for text, _ in rows]):
                counts, spans, kept = [], [], []
                for text, starts in rows[begin:stop]:
                    words = text.split()
                    covered = _covered(starts or [], window)
                    counts.append(len(words))
                    spans.append([{"begin": a, "end": b} for a, b in covered])
                    for a, b in reversed(covered):
                        del words[a:b]
                    kept.append(b" ".join(words))
                yield pa.record_batch([
                    batch.column(0).slice(begin, stop - begin), pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], ["id", "n_words", "intervals", "kept_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = texts.join(starts, texts["id"].cast("long") == starts["_id"], "left").select("id", "text", "starts")
    schema = f"id {kind}, n_words long, intervals array<struct<begin:int,end:int>>, kept_text string"
    return joined.mapInArrow(work, schema).withColumnRenamed("id", id_col)
