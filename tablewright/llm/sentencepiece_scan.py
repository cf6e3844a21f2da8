"""SentencePiece encoding and decoding, giant documents by a parallel max-plus scan.

The model is a byte-pair vocabulary with byte fallback.  A sequence of its pieces is the
encoding of a text exactly when each piece and each pair of neighbours encode to
themselves.  So the encoding is the best path of a lattice whose edges weigh 0 where two
neighbours agree and minus infinity where they do not; exactly one path of weight 0 spans
the text.

A document of ordinary length is encoded where it is, by the library.  A giant one is cut
into chunks at fixed distances:

1. every chunk yields its transfer matrix: which state at its left boundary leads to which
   state at its right one (a state is the piece that ends at or reaches over the boundary);
2. matrices are multiplied in the max-plus semiring, by blocks, then over the blocks of a
   document, which gives the one state at every boundary that lies on the path;
3. with both states known, every chunk traces its own pieces, independently of the others.

No piece holds a space after another character, so between the first and the last begin
of a word a chunk's pieces don't depend on its boundaries; the lattice is walked at the
boundaries, or throughout where a chunk has no such place.  Matrices hold the entries of weight 0 only, as a map from left to right states.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import as_bytes, settle, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more characters are encoded in chunks of CHUNK_CHARS.
GIANT_CHARS = 20_000
CHUNK_CHARS = 5_000
#: Matrices multiplied by one task before those of a document meet.
BLOCK_PARTS = 64
#: Text encoded at once inside a task: ids as Python lists take some 20 times the text.
ENCODED_BYTES = 1 << 20
#: Pieces and pairs remembered by a worker before it starts anew.
REMEMBERED = 300_000

SPACE = "▁"
_EDGE = 0  # the state before the first and after the last character


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Pieces:
    """The vocabulary as a task needs it."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        count = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(count)]
        plain = [not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) for i in range(count)]
        self.ids = {name: i for i, name in enumerate(names) if plain[i]}
        self.scores = {name: self.model.get_score(i) for i, name in enumerate(names) if plain[i]}
        self.longest = max(map(len, self.ids))
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("a piece holds a space after another character: words can't be told apart")
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelled = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() if plain[i] else b""
            for i, n in enumerate(names)
        ]
        self.spelled[self.model.unk_id()] = " ⁇ ".encode()
        self.agrees = _Memo(lambda pair: self._merged(pair[0] + pair[1]) == list(pair))
        self.stands = _Memo(lambda piece: self._merged(piece) == [piece])

    def words(self, y: str) -> list[int]:
        """Ids of whole words; ``y`` begins with the sign of a space, as the library does by itself."""
        return self.model.encode(y[1:]) if len(y) > 1 else list(itertools.chain.from_iterable(map(self.of, y)))

    def of(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, or of the bytes of a character that the vocabulary lacks."""
        found = self.ids.get(piece)
        return (found,) if found is not None else tuple(self.byte[b] for b in piece.encode())

    def _merged(self, text: str) -> list[str]:
        """The pair of best score joins first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.scores.get(a + b, -np.inf) for a, b in itertools.pairwise(parts)]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def decode(self, ids: list[int]) -> bytes:
        text = b"".join(map(self.spelled.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text

    # Chunks.  ``z`` is a chunk with its surroundings; ``stop`` bounds the ends of pieces.

    def path(self, z: str, start: int, before: str | None, stop: int) -> dict[int, int]:
        """For each end that a valid sequence from ``start`` reaches: the length of its last piece."""
        last: dict[int, int] = {}
        for end in range(start + 1, stop + 1):
            for length in range(1, min(self.longest, end - start) + 1):
                piece = z[end - length : end]
                if length > 1 and piece not in self.ids:
                    continue
                begin = end - length
                if begin == start:
                    fits = self.agrees[before, piece] if before is not None else self.stands[piece]
                else:
                    fits = begin in last and self.agrees[z[begin - last[begin] : begin], piece]
                if fits:
                    last[end] = length
                    break
        return last

    def states(self, z: str, at: int) -> list[int]:
        """Pieces that begin before ``at`` and end there or up to a piece's length behind."""
        found = []
        for over in range(min(self.longest, len(z) - at + 1)):
            for length in range(over + 1, min(self.longest, at + over) + 1):
                piece = z[at + over - length : at + over]
                if (length == 1 or piece in self.ids) and self.stands[piece]:
                    found.append(_state(over, length))
        return found


def _state(over: int, length: int) -> int:
    return over * 256 + length


def _breaks(z: str, since: int, till: int) -> list[int]:
    """Where a word begins, in [since, till]: a space after another character."""
    return [i for i in range(max(since, 1), min(till, len(z) - 1) + 1) if z[i] == SPACE and z[i - 1] != SPACE]


class Chunk:
    """One chunk between two boundaries, with up to a piece's length of text on either side."""

    def __init__(self, pieces: Pieces, left: str, body: str, right: str, first: bool, last: bool):
        self.pieces, self.first, self.last = pieces, first, last
        self.z, self.begin, self.end = left + body + right, len(left), len(left) + len(body)
        self.breaks = _breaks(self.z, self.begin, self.end)

    def _entry(self, state: int) -> tuple[int, str | None]:
        if state == _EDGE:
            return self.begin, None
        at = self.begin + state // 256
        return at, self.z[at - state % 256 : at]

    def _exits(self, start: int, before: str | None) -> dict[int, int]:
        """Right states that a sequence from ``start`` reaches without a word's end between."""
        if self.last:
            reached = start == self.end or self.end in self.pieces.path(self.z, start, before, self.end)
            return {_EDGE: self.end} if reached else {}
        behind = next(iter(_breaks(self.z, self.end, self.end + self.pieces.longest)), len(self.z))
        last = self.pieces.path(self.z, start, before, min(behind, self.end + self.pieces.longest - 1))
        return {_state(at - self.end, last[at]): at for at in last if at >= self.end and at - last[at] < self.end}

    def _tail(self) -> int | None:
        """The last word's begin before the right boundary, if a word begins in the chunk."""
        inner = [b for b in self.breaks if b < self.end]
        return inner[-1] if inner else None

    def matrix(self) -> dict[int, list[int]]:
        tail = self._tail()
        shared = list(self._exits(tail, None)) if tail is not None else []
        rows = {}
        for state in [_EDGE] if self.first else self.pieces.states(self.z, self.begin):
            start, before = self._entry(state)
            stop = next((b for b in self.breaks if start <= b < self.end), None)
            if start > self.end:
                continue
            if stop is None:
                out = list(self._exits(start, before))
            else:
                out = shared if stop == start or stop in self.pieces.path(self.z, start, before, stop) else []
            if out:
                rows[state] = out
        return rows

    def trace(self, state: int, until: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the path between two states."""
        start, before = self._entry(state)
        stop = next((b for b in self.breaks if start <= b < self.end), None)
        if stop is None:
            return self._spell(start, before, self._exits(start, before)[until])
        tail = self._tail()
        ids = self._spell(start, before, stop)
        return ids + self.pieces.words(self.z[stop:tail]) + self._spell(tail, None, self._exits(tail, None)[until])

    def _spell(self, start: int, before: str | None, end: int) -> list[int]:
        if start == end:
            return []
        last, cuts = self.pieces.path(self.z, start, before, end), [end]
        while cuts[-1] > start:
            cuts.append(cuts[-1] - last[cuts[-1]])
        spans = itertools.pairwise(reversed(cuts))
        return [i for a, b in spans for i in self.pieces.of(self.z[a:b])]


def product(left: dict[int, list[int]], right: dict[int, list[int]]) -> dict[int, list[int]]:
    """Max-plus product of two matrices of weights 0 and minus infinity."""
    joined = {a: sorted({c for b in row for c in right.get(b, ())}) for a, row in left.items()}
    return {a: row for a, row in joined.items() if row}


def resolve(matrices: list[dict[int, list[int]]], first: int, last: int) -> list[int]:
    """The states at all boundaries on the path from ``first`` to ``last``: forward, then backward."""
    reached = [{first}]
    for matrix in matrices:
        reached.append({c for b in reached[-1] for c in matrix.get(b, ())})
    states = [last]
    for matrix, before in zip(reversed(matrices), reversed(reached[:-1])):
        leading = [a for a in before if states[-1] in matrix.get(a, ())]
        if len(leading) != 1:
            raise ValueError(f"{len(leading)} paths lead on from a chunk's boundary, not one")
        states.append(leading[0])
    return states[::-1]


_LOADED: dict[str, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.fromiter(itertools.chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def _from_pairs(pairs) -> dict[int, list[int]]:
    rows: dict[int, list[int]] = {}
    for pair in pairs:
        rows.setdefault(int(pair) // 65536, []).append(int(pair) % 65536)
    return rows


def _to_pairs(rows: dict[int, list[int]]) -> list[int]:
    return [a * 65536 + b for a, row in rows.items() for b in row]


def _encode(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ids, round_trip) of batches of (id, text), a slice at a time."""
    for batch in sliced(batches, 1, ENCODED_BYTES):
        texts = as_bytes(batch.column(1))
        found = pieces.model.encode([t.decode() for t in texts], num_threads=1)
        fits = [pieces.decode(ids) == t for ids, t in zip(found, texts)]
        yield pa.record_batch([batch.column(0), _lists(found), pa.array(fits)], ["id", "ids", "round_trip"])


def _chunk(pieces: Pieces, row: dict) -> Chunk:
    ends = row["part"] == 0, row["part"] == row["parts"] - 1
    return Chunk(pieces, row["before"], row["body"], row["after"], *ends)


def _trace(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, part, ids) of batches of chunks with both states, a slice at a time."""
    for batch in _chunk_slices(batches):
        found = [_chunk(pieces, r).trace(r["first"], r["last"]) for r in batch.to_pylist()]
        yield pa.record_batch([batch.column("digest"), batch.column("part"), _lists(found)], ["digest", "part", "ids"])


def _chunk_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from sliced(iter([batch]), batch.schema.get_field_index("body"), ENCODED_BYTES)


def encoded(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = MODEL,
    giant_chars: int = GIANT_CHARS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """(id, ids, n_tokens, round_trip) of every row; equal to the library's own encoding.

    round_trip tells whether decoding gives the text again (false for texts that hold
    U+2581, the sign that stands for a space).

    * A null or empty text has no tokens; its round trip holds for the empty text.
    * Repeated rows and equal ids are encoded each for itself; a giant text that occurs
      often is encoded once.  A null id is carried along.  Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(model, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # the model file: some hundred KB
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    giant = F.char_length("text") > giant_chars

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode(_pieces(vocabulary.value), batches)

    schema = T.StructType([
        T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType()),
    ])
    short = rows.where(~giant).mapInArrow(ordinary, schema)
    long = rows.where(giant).withColumn("digest", F.sha2("text", 256))
    found = _giants(long.groupBy("digest").agg(F.first("text").alias("text")), vocabulary, chunk_chars)
    far = long.select("id", "digest").join(settle(found, "giants"), "digest").select("id", "ids", "round_trip")
    return short.unionByName(far).select(
        F.col("id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip"
    )


def _giants(texts: DataFrame, vocabulary, chunk_chars: int) -> DataFrame:
    """(digest, ids, round_trip) of distinct giant texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = _pieces(vocabulary.value).longest
        for batch in sliced(batches, 1, ENCODED_BYTES):
            for digest, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                y = SPACE + text.decode().replace(" ", SPACE)
                starts = list(range(0, len(y), chunk_chars))
                # A last chunk shorter than a piece would not hold the pieces that reach into it.
                if len(starts) > 1 and len(y) - starts[-1] < 2 * around:
                    starts.pop()
                ends = [*starts[1:], len(y)]
                yield pa.record_batch([
                    pa.array([digest] * len(starts)), pa.array(range(len(starts)), pa.int32()),
                    pa.array([len(starts)] * len(starts), pa.int32()),
                    pa.array([y[max(0, a - around) : a] for a in starts]),
                    pa.array([y[a:b] for a, b in zip(starts, ends)]),
                    pa.array([y[b : b + around] for b in ends]),
                ], ["digest", "part", "parts", "before", "body", "after"])

    columns = "digest string, part int, parts int, before string, body string, after string"
    parts = settle(texts.mapInArrow(cut, columns).repartition("digest", "part"), "chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary.value)
        for batch in _chunk_slices(batches):
            table = batch.to_pylist()
            yield pa.record_batch([
                batch.column("digest"), batch.column("part"),
                pa.array([r["part"] // BLOCK_PARTS for r in table], pa.int32()),
                _lists([_to_pairs(_chunk(pieces, r).matrix()) for r in table]),
            ], ["digest", "part", "block", "pairs"])

    matrices = settle(parts.mapInArrow(transfers, "digest string, part int, block int, pairs array<int>"), "matrices")

    def multiply(key, frame: pd.DataFrame) -> pd.DataFrame:
        whole, *rest = map(_from_pairs, frame.sort_values("part")["pairs"])
        for matrix in rest:
            whole = product(whole, matrix)
        return pd.DataFrame({"digest": [key[0]], "block": [key[1]], "pairs": [_to_pairs(whole)]})

    def outer(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        states = resolve([_from_pairs(p) for p in frame["pairs"]], _EDGE, _EDGE)
        return pd.DataFrame({"digest": key[0], "block": frame["block"], "first": states[:-1], "last": states[1:]})

    def inner(key, frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        states = resolve([_from_pairs(p) for p in frame["pairs"]], int(ends["first"].iloc[0]), int(ends["last"].iloc[0]))
        return pd.DataFrame({"digest": key[0], "part": frame["part"], "first": states[:-1], "last": states[1:]})

    bounds = "first int, last int"
    products = matrices.groupBy("digest", "block").applyInPandas(multiply, "digest string, block int, pairs array<int>")
    ends = products.groupBy("digest").applyInPandas(outer, f"digest string, block int, {bounds}")
    states = matrices.groupBy("digest", "block").cogroup(ends.groupBy("digest", "block")).applyInPandas(
        inner, f"digest string, part int, {bounds}"
    )

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _trace(_pieces(vocabulary.value), batches)

    traced = parts.join(states, ["digest", "part"]).mapInArrow(trace, "digest string, part int, ids array<int>")
    whole = traced.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("all"))
    whole = whole.select("digest", F.flatten(F.transform("all", lambda p: p["ids"])).alias("ids"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary.value)
        for batch in batches:
            # The lists of one text at a time: as Python objects they take nine times their room.
            decoded = (hashlib.sha256(pieces.decode(ids.as_py())).hexdigest() for ids in batch.column(1))
            fits = pa.array([a == b for a, b in zip(batch.column(0).to_pylist(), decoded)], pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1), fits], ["digest", "ids", "round_trip"])

    return whole.mapInArrow(check, "digest string, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text that its ids spell; a null array gives a null text.

    Bytes that form no valid UTF-8 become U+FFFD.  A column named as ``text_col`` is replaced.
    """
    with open(model, "rb") as file:
        vocabulary = tokens.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def spell(column: pd.Series) -> pd.Series:
        pieces = _pieces(vocabulary.value)
        return column.map(lambda ids: None if ids is None else pieces.decode([int(i) for i in ids]).decode(errors="replace"))

    return tokens.withColumn(text_col, spell(F.col(ids_col)))
