"""Near duplicates by MinHash with tensored banding.

Plain banding with 196 tables of 6 values each computes 1,176 MinHash values a document.
Here two collections of 14 short keys (3 values each, 84 in all) are computed, and table
(i, j) is keyed by the pair (left[i], right[j]): 196 tables from 28 keys, about the
square root of the work.  Two documents of similarity s meet in a table with probability
(1 - (1 - s^3)^14)^2: 0.99991 at 0.8, 0.9999996 at 0.9.  Every link is then confirmed on
the full sets of shingles.

How the work stays bounded:

* Documents with equal sets are one class, found by a digest of the set; only a class's
  smallest document goes on.
* In a table, documents are linked to the smallest one of their bucket, first within a
  block of rows, so that a bucket reaches the shuffle as one row per block, however many
  documents share it.  No bucket is held in memory or expanded into pairs.
* Confirmed links are merged into components in three steps: the link of each document to
  its smallest partner; the other links that still lead to another component; at last, for
  components with unconfirmed links between them only, all pairs of a bucket across
  components.  After the third step every pair that shares a table is either within one
  component or was compared, so merging loses nothing that the tables have found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.llm.common import WordHashes, as_bytes, mixed, settle, sliced
from tablewright.llm.components import components

SIMILARITY_PERCENT = 80
SHINGLE_WORDS = 2
KEYS = 14
VALUES = 3
#: Documents whose buckets are merged before the shuffle.
BLOCK_ROWS = 4096
#: Bits of the map of documents that must be compared.
BITMAP_BITS = 1 << 24
#: A bucket of so many documents may hold a pair that neither is the smallest of.
CROWD = 3

_WORDS = WordHashes()


def _salts(count: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes.

    Words are cut at white space after lower-casing A-Z; a text of fewer words than a
    shingle holds is one shingle; a text without words has none.
    """
    found = []
    for text in texts:
        words = text.lower().split()
        if not words:
            found.append(np.empty(0, np.uint64))
            continue
        hashes = _WORDS.of(words)
        span = min(width, len(words))
        rolled = np.full(len(words) - span + 1, span, np.uint64)
        for k in range(span):
            rolled = mixed(rolled ^ hashes[k : len(words) - span + 1 + k])
        found.append(np.unique(rolled))
    return found


def _bands(sets: list[np.ndarray], keys: int, values: int) -> np.ndarray:
    """A row of 2 * keys hashes for each non-empty set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    salts, odd = _salts(2 * keys * values, 1), _salts(2 * keys * values, 2) | np.uint64(1)
    out = np.empty((len(sets), 2 * keys), np.uint64)
    for band in range(2 * keys):
        key = np.full(len(sets), band, np.uint64)
        for k in range(band * values, (band + 1) * values):
            key = mixed(key ^ np.minimum.reduceat(joined * odd[k] + salts[k], starts))
        out[:, band] = key
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, keys: int, values: int) -> DataFrame:
    """(id, n_shingles, digest, bands) of every document; digest and bands are null for empty sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sets = _shingles(as_bytes(batch.column(1)), width)
            full = [s for s in sets if len(s)]
            rows = iter(_bands(full, keys, values).view(np.int64).tolist() if full else [])
            yield pa.record_batch([
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], ["id", "n_shingles", "digest", "bands"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)


def _cells(ids: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Keys of all tables: one column for each pair of a left and a right band."""
    half = bands.shape[1] // 2
    left, right = bands[:, :half, None], bands[:, None, half:]
    return mixed(left ^ mixed(right + np.uint64(0x51ED270B))).reshape(len(ids), half * half)


def _block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    bands = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], bands[order]


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket in a block: (key, smallest document, null), twice if the block holds more
    of the bucket, and (a key of its own, document, smallest one) of the others."""
    parts = (batch.slice(start, BLOCK_ROWS) for batch in batches for start in range(0, batch.num_rows, BLOCK_ROWS))
    for ids, bands in map(_block, parts):
        keys = _cells(ids, bands).ravel()
        owners = np.repeat(np.arange(len(ids)), keys.size // len(ids))
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        held = np.diff(first, append=len(keys))
        head = np.repeat(owners[first], held)
        pairs = np.unique(np.stack([owners, head])[:, owners != head], axis=1)
        member, leader = pairs[:, ids[pairs[0]] != ids[pairs[1]]]
        spread = mixed(ids[member].view(np.uint64) ^ mixed(ids[leader].view(np.uint64)))
        lead = np.repeat(first, np.minimum(held, 2))
        known = np.repeat([False, True], [len(lead), len(member)])
        yield pa.record_batch([
            pa.array(np.concatenate([keys[lead], spread]).view(np.int64)),
            pa.array(ids[np.concatenate([owners[lead], member])]),
            pa.array(np.concatenate([np.zeros(len(lead), np.int64), ids[leader]]), mask=~known),
        ], ["key", "id", "head"])


def _links(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (id, head, fits, crowded): every class with the smaller leaders of its buckets.

    fits: the sizes allow the similarity; crowded: a bucket of both may hold a third document.
    """
    rows = classes.select("rep", "bands").mapInArrow(_table_rows, "key long, id long, head long")
    bucket = Window.partitionBy("key")
    many = F.col("head").isNotNull() | (F.count("*").over(bucket) >= CROWD)
    links = (
        rows.withColumns({"leader": F.coalesce("head", F.min("id").over(bucket)), "crowded": many})
        .where("leader < id").groupBy("id", F.col("leader").alias("head")).agg(F.max("crowded").alias("crowded"))
    )
    sizes = classes.select(F.col("rep").alias("id"), "n")
    other = classes.select(F.col("rep").alias("head"), F.col("n").alias("m"))
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return links.join(sizes, "id").join(other, "head").select("id", "head", fits.alias("fits"), "crowded")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, head) whose full sets are similar enough."""
    own = sets.select(F.col("id"), F.col("shingles").alias("own"))
    other = sets.select(F.col("id").alias("head"), F.col("shingles").alias("other"))
    common = F.size(F.array_intersect("own", "other")).cast("long")
    union = F.size("own") + F.size("other") - F.col("common")
    return (
        pairs.join(own, "id").join(other, "head")
        .select("id", "head", common.alias("common"), "own", "other")
        .where(100 * F.col("common") >= percent * union).select("id", "head")
    )


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles) of the wanted documents.

    Texts are not shuffled: a bitmap of the wanted ids, of a fixed size, goes to all tasks,
    which pass the sets of the ids that it holds; an exact join leaves out what it holds by
    chance.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    marks = wanted.select((bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mark"))
    found = marks.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    bitmap[found["word"].to_numpy()] = found["mark"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)  # 2 MB, whatever the number of documents

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in sliced(batches, 1):
            at = batch.column(2).to_numpy().astype(np.uint64)
            passes = marked[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            batch = batch.filter(pa.array(passes.astype(bool)))
            if not batch.num_rows:
                continue
            sets = _shingles(as_bytes(batch.column(1)), width)
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["id", "shingles"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = texts.withColumn("bit", bit).mapInArrow(work, "id long, shingles array<long>")
    return sets.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("shingles").alias("shingles"))


#: Sizes in the band that begins at a size: one below 128, then a 64th to a 128th of the size.
_BAND_WIDTH = "shiftleft(1L, greatest(length(bin({0})) - 7, 0))"


def _band(size: str) -> Column:
    """The smallest size in the band of a size."""
    return F.expr(f"{size} - {size} % {_BAND_WIDTH.format(size)}")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the component of either side, those within one component left out."""
    for side, name in (("id", "own_label"), ("head", "head_label")):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(name)), side, "left")
        pairs = pairs.withColumn(name, F.coalesce(name, side))
    return pairs.where("own_label <> head_label")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = SIMILARITY_PERCENT,
    width: int = SHINGLE_WORDS,
    keys: int = KEYS,
    values: int = VALUES,
) -> DataFrame:
    """Per document: id, n_shingles, component_id and kept.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| for their sets of
    ``width``-word shingles; component_id is the smallest id reachable over links.

    * A null or empty text, or one without words, has an empty set and is linked with nothing.
    * A null id is linked with nothing and kept, its component_id is null.
    * Every row is returned.  Rows of one id are one document; when their texts differ, the
      smallest of their sets (in array order) is the one its links are confirmed on.
    * Ids must be integers (byte to long).  Other columns are ignored.
    """
    shaped = docs.withColumn(id_col, F.col(id_col).cast("long"))
    rows = settle(signatures(shaped, id_col, text_col, width, keys, values), "signatures")
    classes = settle(
        rows.where("n_shingles > 0 and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    links = settle(_links(classes, percent), "links")
    fitting = links.where("fits").select("id", "head")
    nearest = settle(fitting.groupBy("id").agg(F.min("head").alias("head")), "nearest")
    wanted = links.where("fits or crowded")
    involved = wanted.select("id").unionByName(wanted.select(F.col("head").alias("id"))).distinct()
    sets = settle(_sets(shaped, involved, id_col, text_col, width), "sets")

    certain = settle(_confirmed(nearest, sets, percent), "confirmed")
    labels = components(certain.select(F.col("id").alias("a"), F.col("head").alias("b")))
    rest = fitting.join(nearest, ["id", "head"], "left_anti")
    open_links = _labelled(rest, labels).select("id", "head")
    certain = settle(certain.unionByName(_confirmed(open_links, sets, percent)), "confirmed")
    labels = settle(components(certain.select(F.col("id").alias("a"), F.col("head").alias("b"))), "labels")

    crowded = links.where("crowded").select("id", "head")
    apart = settle(_labelled(crowded, labels).select("own_label", "head_label"), "apart")
    if not apart.isEmpty():
        more = _across(sets, labels, apart, percent).join(links, ["id", "head"], "left_anti")
        certain = certain.unionByName(_confirmed(more, sets, percent))
        labels = settle(components(certain.select(F.col("id").alias("a"), F.col("head").alias("b"))), "labels")

    found = classes.select("digest", "rep").join(
        labels.select(F.col("node").alias("rep"), "component"), "rep", "left"
    ).select("digest", F.coalesce("component", "rep").alias("component"))
    found = settle(found, "found")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (
        rows.select("id", "n_shingles", "digest").join(found, "digest", "left")
        .select("id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
        .withColumnRenamed("id", id_col)
    )


def _across(sets: DataFrame, labels: DataFrame, apart: DataFrame, percent: int) -> DataFrame:
    """Pairs that can be similar enough and join two components, among those with open links.

    Shingles are put in order of their number of documents, rare ones first.  Two similar
    sets share one among the first few of either, and what is behind the first common one
    must suffice for the overlap.  How few depends on both sizes, so documents meet by
    shingle and size bands: for each band that a document can match it gives only the
    shingles that still suffice there (for equal sizes of n the first n / 9 at 80 %).  Copies
    that were edited too much to be linked have as many of their own in front and meet
    nothing, however large the group, but for those short of it by less than a band is wide.

    Where documents meet, those of the largest component are not paired with one another.
    """
    touched = apart.select(F.col("own_label").alias("label")).unionByName(
        apart.select(F.col("head_label").alias("label"))
    ).distinct()
    of = labels.select(F.col("node").alias("id"), "component")
    members = (
        sets.join(of, "id", "left").withColumn("label", F.coalesce("component", "id"))
        .join(touched, "label", "left_semi").select("id", "label", F.size("shingles").alias("n"), "shingles")
    )
    rows = settle(members.select("id", "label", "n", F.explode("shingles").alias("shingle")), "members")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("documents"))
    ordered = rows.join(shared, "shingle").groupBy("id", "label", "n").agg(
        F.sort_array(F.collect_list(F.struct("documents", "shingle"))).alias("ordered"))
    few = F.expr(f"slice(ordered, 1, n - ({percent} * n + 99) div 100 + 1)")
    fronts = settle(
        ordered.select("id", "label", F.col("n").cast("long").alias("n"), F.posexplode(few).alias("at", "entry"))
        .where("entry.documents > 1").select(F.col("entry.shingle").alias("shingle"), "id", "label", "n", "at")
        .withColumn("band", _band("n")),
        "fronts",
    )
    # Of a shingle at most 64 bands for each doubling of the size.
    held = fronts.groupBy("shingle").agg(
        F.collect_set("band").alias("bands"), F.min("label").alias("least"), F.max("label").alias("most"),
    ).where("least < most").select("shingle", "bands")
    smallest = F.greatest("other", F.expr(f"({percent} * n + 99) div 100"))
    reaches = fronts.join(held, "shingle").select(
        "shingle", "id", "label", "n", "at", "band", F.explode("bands").alias("other")
    ).withColumn("smallest", smallest).where(
        f"""smallest < other + {_BAND_WIDTH.format("other")} and 100 * n >= {percent} * smallest
        and {100 + percent} * (n - at) >= {percent} * (n + smallest)"""
    ).drop("smallest")
    place = ["shingle", "low", "high"]
    reaches = settle(
        reaches.withColumns({"low": F.least("band", "other"), "high": F.greatest("band", "other")}), "reaches")
    largest = (
        reaches.groupBy(*place, "label").agg(F.count("*").alias("rows"))
        .groupBy(*place).agg(F.max_by("label", F.struct("rows", "label")).alias("largest"), F.count("*").alias("labels"))
        .where("labels > 1").drop("labels")
    )
    firsts = settle(
        reaches.join(largest, place).select("shingle", "band", "other", "id", "label", "n", "at",
                                            (F.col("label") == F.col("largest")).alias("of_largest")),
        "firsts",
    )
    partner = firsts.select("shingle", F.col("band").alias("other"), F.col("other").alias("band"), F.col("id").alias("head"),
                            F.col("label").alias("head_label"), F.col("n").alias("m"), F.col("at").alias("head_at"))
    return firsts.where("not of_largest").join(partner, ["shingle", "band", "other"]).where(
        f"""label <> head_label and 100 * n >= {percent} * m and 100 * m >= {percent} * n
        and {100 + percent} * least(n - at, m - head_at) >= {percent} * (n + m)"""
    ).select(F.greatest("id", "head").alias("id"), F.least("id", "head").alias("head")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id.

    Documents without an id or without words stay.
    """
    kept = settle(near_duplicates(docs, id_col, text_col, **parameters).where("kept").select(
        F.col(id_col).alias("_kept_id")).distinct(), "kept")
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")
