"""Language identification by language-bitmask n-gram filters.

Training counts the character 4-grams of every language and keeps those that make up at
least a certain share of it.  They go into one bit-sliced Bloom filter: a table of slots,
each of which holds one bit for every language.  An n-gram sets its language's bit in three
slots; asking takes the same three slots and ANDs them, which tells at once all languages
that contain it.  A text's language is the one whose bit is set for the largest share of
its n-grams, after each share is corrected for the filter's false positives of that
language.

The filter has a fixed number of slots, so what is built by the driver and broadcast is
bounded whatever the size of the corpus: 2 MB for each eight languages.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import as_bytes, blocks, mixed, settle

GRAM = 4
PROBES = 3
SLOT_BITS = 21
#: An n-gram belongs to a language that it makes up this share of, at least.
MIN_SHARE = 1e-5
UNKNOWN = "und"
_BLOCK = 2 << 20
#: Distinct n-grams a counting task holds before it hands its counts on.
_HELD = 2_000_000
_SPACE = np.uint32(32)


class _Letters:
    """Which code points are letters, asked once for each."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of all texts as hashes, text number of each, whether a text has a letter).

    Texts are lower-cased; what is no letter separates words; a word's begin and end count
    as one space.
    """
    letters = _Letters.get()
    points = [np.frombuffer(f"  {t.decode().lower()}  ".encode("utf-32-le"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(points), dtype=np.int32), [len(p) for p in points])
    code = np.concatenate(points)
    is_letter = letters[code]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[is_letter]] = True
    code = np.where(is_letter, code, _SPACE)
    # Of several spaces one stays.
    keep = is_letter | np.concatenate([[True], is_letter[:-1]]) | np.concatenate([[True], owner[1:] != owner[:-1]])
    code, owner = code[keep].astype(np.uint64), owner[keep]
    count = max(len(code) - GRAM + 1, 0)
    gram = np.zeros(count, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x1000193) * np.uint64(0x10001) + code[k : count + k]
    inside = owner[:count] == owner[GRAM - 1 :]
    return mixed(gram[inside]), owner[:count][inside], has_letter


def _training_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n): each task sums what it has read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def given() -> pa.RecordBatch:
            names = itertools.chain.from_iterable([lang] * len(grams) for lang, (grams, _) in held.items())
            return pa.record_batch([
                pa.array(names, pa.string()),
                pa.array(np.concatenate([g for g, _ in held.values()]).view(np.int64)),
                pa.array(np.concatenate([n for _, n in held.values()])),
            ], ["lang", "gram", "n"])

        for batch in batches:
            langs, all_texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for lang in dict.fromkeys(langs):
                own = [t for t, other in zip(all_texts, langs) if other == lang]
                for start, stop in blocks(own, _BLOCK):
                    grams, counts = np.unique(_grams(own[start:stop])[0], return_counts=True)
                    if lang in held:
                        grams, at = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([held[lang][1], counts])).astype(np.int64)
                    held[lang] = grams, counts
            if sum(len(g) for g, _ in held.values()) > _HELD:
                yield given()
                held.clear()
        if held:
            yield given()

    return texts.mapInArrow(work, "lang string, gram long, n long")


class Model:
    """Languages, their bits in every slot and the false-positive rate of each."""

    def __init__(self, languages: list[str], default: str | None, slots: np.ndarray):
        self.languages, self.default, self.slots = languages, default, slots
        fill = [np.count_nonzero(slots[k // 8] >> np.uint8(k % 8) & np.uint8(1)) / slots.shape[1] for k in range(len(languages))]
        self.false_positive = np.array(fill) ** PROBES

    def shares(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected share of n-grams of each text in each language, whether a text has a letter)."""
        grams, owner, has_letter = _grams(texts)
        total = np.bincount(owner, minlength=len(texts))
        found = np.empty((len(texts), len(self.languages)))
        at = [(grams >> np.uint64(SLOT_BITS * p) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32) for p in range(PROBES)]
        for part in range(self.slots.shape[0]):
            bits = self.slots[part][at[0]]
            for probe in at[1:]:
                bits &= self.slots[part][probe]
            for k in range(8 * part, min(8 * part + 8, len(self.languages))):
                found[:, k] = np.bincount(owner, bits >> np.uint8(k % 8) & np.uint8(1), minlength=len(texts))
        found /= np.maximum(total, 1)[:, None]
        return np.clip((found - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1), has_letter


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> Model:
    """The filter of all rows with a text and a language.

    The driver gets one row for each slot that has a bit, at most 2 ** 21 for eight
    languages, and one row for each language.
    """
    texts = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = _training_counts(texts).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = settle(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = totals.orderBy("lang").collect()
    languages = [row["lang"] for row in known]
    slots = np.zeros(((len(languages) + 7) // 8, 1 << SLOT_BITS), np.uint8)
    if languages:
        number = F.create_map(*itertools.chain.from_iterable((F.lit(lang), F.lit(k)) for k, lang in enumerate(languages)))
        least = F.create_map(*itertools.chain.from_iterable(
            (F.lit(r["lang"]), F.lit(max(2, min_share * r["total"]))) for r in known))
        probes = F.array(*[
            F.shiftrightunsigned("gram", SLOT_BITS * p).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for p in range(PROBES)])
        rows = counts.where(F.col("n") >= least[F.col("lang")]).select(
            number[F.col("lang")].alias("k"), F.explode(probes).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1), F.col("k") % 8)
        found = rows.groupBy(F.floor(F.col("k") / 8).cast("int").alias("part"), F.col("slot").cast("int").alias("slot")).agg(
            F.bit_or(bit).alias("bits")).toArrow()
        slots[found["part"].to_numpy(), found["slot"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    default = max(known, key=lambda r: (r["total"], r["lang"]))["lang"] if known else None
    return Model(languages, default, slots)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone.

    score is the corrected share of n-grams that the language contains.  Of equal languages
    the first by name is taken; where no n-gram is known, the language with most training
    text at score 0.

    * A null or empty text, or one without letters, is ``und`` with score 0, as is every
      text when nothing was learned.
    * Repeated rows and null ids are judged like others; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2 MB for each eight languages
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for start, stop in blocks(texts, _BLOCK):
                shares, has_letter = learned.shares(texts[start:stop])
                names, scores = [], []
                for row, letter in zip(shares, has_letter):
                    best = int(row.argmax()) if len(row) else -1
                    judged = letter and best >= 0
                    score = float(row[best]) if judged else 0.0
                    names.append(UNKNOWN if not judged else learned.languages[best] if score > 0 else learned.default)
                    scores.append(score)
                yield pa.record_batch(
                    [batch.column(0).slice(start, stop - start), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["id", "lang_pred", "score"],
                )

    schema = T.StructType([
        T.StructField("id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
