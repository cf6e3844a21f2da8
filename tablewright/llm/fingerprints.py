"""I-Match fingerprints over several randomised lexicon subsets.

The lexicon holds the words whose share of documents lies within a band: words that are
too common say nothing, words that are too rare are noise.  A document's distinct words in
the lexicon are sorted; each randomised subset of the lexicon keeps some of them, and these
are hashed in order.  Texts that agree on all words of a subset agree on its hash.

One subset density can't serve texts of all lengths, so subsets come in levels: level v
keeps one word in 4 ** v.  A text with n words is hashed at the level where about one to
four of its words stay, and at the next, sparser one.  A fingerprint is the set of its
non-empty hashes, each with level and subset; likeness is the number of equal hashes over
the number of subsets that either text fills.

The lexicon is bounded whatever the size of the corpus: words that occur in a share
``min_share`` of documents number at most (mean distinct words of a document) / min_share,
some ten thousands.  It becomes a constant of the plan, and every text is fingerprinted
where it is, by column expressions.
"""

from __future__ import annotations

import json
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import SPACES

MIN_SHARE = 0.005
MAX_SHARE = 0.1
#: Words in fewer documents are left out, however small the table.
MIN_DOCUMENTS = 2
#: Texts with fewer words in the lexicon are fingerprinted by all their words.
MIN_TERMS = 4
SUBSETS = 16
LEVELS = 2
_BUCKETS = 1 << 13
_HASH_BITS = 56
#: Rows of a range that the order of documents is cut into; number of ranges.
RANGE_ROWS = 4000
MOST_RANGES = 4096


def _words(text: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_distinct(F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> Column:
    """A constant: for each bucket the hashes of its words within the band.

    All words of all documents are counted; the driver gets those within the band.
    """
    total = docs.count()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.explode(_words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    within = counted.where(F.col("n").between(max(MIN_DOCUMENTS, min_share * total), max(MIN_DOCUMENTS, max_share * total)))
    buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
    for word in sorted(within.select("word").toArrow()["word"].to_pylist()):
        buckets[word % _BUCKETS].append(word)
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")


def _with_fingerprint(rows: DataFrame, text: str, name: str, buckets: Column) -> DataFrame:
    """Adds ``name``: array<long>, each with level and subset in the upper 8 bits and a hash in the others."""
    words, terms, hashed, level = (f"{name}_{part}" for part in ("words", "terms", "hashed", "level"))
    rows = rows.withColumn(words, _words(F.col(text)))
    rows = rows.withColumn(terms, F.filter(
        words, lambda h: F.array_contains(F.get(buckets, F.pmod(h, F.lit(_BUCKETS)).cast("int")), h)))
    rows = rows.withColumn(hashed, F.sort_array(
        F.when(F.size(terms) >= MIN_TERMS, F.col(terms)).otherwise(F.col(words))))
    rows = rows.withColumn(level, F.floor(F.log2(F.greatest(F.size(hashed), F.lit(1))) / log2(4)).cast("int"))

    # Subset number and mask first, then one pass over the terms for each subset.
    shift = lambda value, bits: F.call_function("shiftleft", value.cast("long"), bits.cast("int"))
    subsets = F.transform(F.sequence(F.lit(0), F.lit(LEVELS * SUBSETS - 1)), lambda k: F.struct(
        (F.col(level) * SUBSETS + k).alias("number"),
        (shift(F.lit(1), 2 * (F.col(level) + F.floor(k / SUBSETS))) - 1).alias("mask"),
    ))
    read = F.transform(subsets, lambda e: F.struct(e["number"].alias("number"), F.aggregate(
        hashed, F.lit(0).cast("long"),
        lambda a, h: F.when(F.xxhash64(h, e["number"]).bitwiseAND(e["mask"]) == 0, F.xxhash64(a, h)).otherwise(a),
    ).alias("hash")))
    low = F.lit((1 << _HASH_BITS) - 1)
    entries = F.transform(F.filter(read, lambda e: e["hash"] != 0), lambda e: (
        e["hash"].bitwiseAND(low).bitwiseOR(shift(e["number"], F.lit(_HASH_BITS)))))
    return rows.withColumn(name, entries).drop(words, terms, hashed, level)


def likeness(a: str, b: str) -> Column:
    """Equal hashes over filled subsets, 0 to 1; equal fingerprints, empty ones too, have 1."""
    place = lambda column: F.transform(column, lambda x: F.shiftrightunsigned(x, _HASH_BITS))
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(place(a), place(b)))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(shared).cast("double")


def shown(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.hex(x)), ",")


def fingerprints(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """Every row as struct ``row`` with its ``text`` and ``fingerprint``.

    A null text is empty; texts without words have an empty fingerprint.  Texts with few
    words in the band use all their words.  Equal texts have equal fingerprints.
    """
    buckets = lexicon(docs, text_col, min_share, max_share)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return _with_fingerprint(rows, "text", "fingerprint", buckets)


def _ranges(docs: DataFrame, id_col: str) -> Column:
    """The number of the range that an id lies in; ranges hold about equally many rows.

    Cuts are quantiles of the ids, found in two steps of at most 64 comparisons.
    """
    wanted = min(MOST_RANGES, max(64, docs.count() // RANGE_ROWS))
    shares = [k / wanted for k in range(1, wanted)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, 10 * wanted).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    parts = [cuts[k : k + 64] for k in range(0, len(cuts), 64)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col("id")))
    firsts = F.from_json(F.lit(json.dumps([p[0] for p in parts])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    part = below(firsts) - 1
    return F.when(part >= 0, part * 64 + below(F.get(inner, part))).otherwise(-1)


def edited_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_share: float = MIN_SHARE, max_share: float = MAX_SHARE,
) -> DataFrame:
    """Per row: id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the begin of the next document's text, by ascending id, the
    first one after the last: a quarter of its code points, rounded down, is replaced.

    * A null text is empty.  Null ids come first; equal ids follow by text.
    * A table of one row is its own next document; an empty table gives no rows.

    Documents are put in order within ranges of ids; only the first text of each of at most
    4,096 ranges is looked at beyond its range.
    """
    buckets = lexicon(docs, text_col, min_share, max_share)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("range", F.coalesce(_ranges(docs, id_col), F.lit(-2)))
    marked = _with_fingerprint(rows, "text", "fingerprint", buckets)

    heads = rows.groupBy(F.col("range").alias("head_range")).agg(F.min("id").alias("head"))  # one row a range
    first = (F.col("range") == F.col("head_range")) & F.col("id").eqNullSafe(F.col("head"))
    firsts = rows.join(F.broadcast(heads), first).groupBy("range").agg(F.min("text").alias("text"))
    around = Window.orderBy("range")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("text").over(around), F.first("text").over(whole))
    borders = _with_fingerprint(firsts.select("range", after.alias("border")), "border", "border_fingerprint", buckets)

    order = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "text")
    rows = marked.withColumns({
        "next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order),
    }).join(borders, "range")
    length = F.char_length("text")
    moved = F.floor(length / 4).cast("int")
    rows = rows.select(
        "id", "text", "fingerprint", F.coalesce("next_fingerprint", "border_fingerprint").alias("next_fingerprint"),
        F.concat(F.substr("text", F.lit(1), length - moved), F.substr(F.coalesce("next_text", "border"), F.lit(1), moved)).alias("edited"),
    )
    rows = _with_fingerprint(rows, "edited", "edited_fingerprint", buckets)
    return rows.select(
        F.col("id").alias(id_col), "text", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
