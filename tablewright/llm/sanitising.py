"""Information-theoretic sanitising of personal data.

Protected entities (addresses and numbers) are found by pattern.  A term near an entity may
tell who is meant although the entity itself is gone, so the corpus is asked: with the shares
of documents that hold the entity e, the term t, and t near e, the pointwise mutual
information log2(P(t, e) / (P(t) P(e))) is what the term tells of the entity, and log2(1 / P(e)) all
there is to tell.  Terms that tell nearly all of it are spans of their own, near the
entity they disclose, and are generalised (numbers) or removed (words).

One pass over the texts finds entities, the terms around them and the number of documents
of every term, summed in the task.  What follows holds rows of texts with entities and sums
only.  Texts are shuffled only where the result keeps them: rows meet their spans by the
MD5 of the text, and only the columns asked for travel.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import settle

KINDS = ("email", "ip", "card", "phone", "term")
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term is a run of three or more characters that are ASCII letters or digits or beyond ASCII.
TERM = re.compile(r"[^\x00-/:-@\[-`{-\x7f]{3,}")

#: Terms on either side of an entity that may disclose it.
WINDOW = 8
#: Share of an entity's information that a disclosing term tells, and the least bits.
DISCLOSURE = 0.9
LEAST_BITS = 5.0
#: Differing texts in which a term stands near an entity before that counts as a pattern.
LEAST_TEXTS = 3
LONG_TERM = 64
COUNTED_TERMS = 400_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of each run of numbers joined by points, four at a time."""
    for run in NUMBERS.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in DIGITS.finditer(text):
        digits = re.sub("[^0-9]", "", found.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", found.group())) <= 15:
            yield found.span()


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities found by pattern, by start, then kind; in time linear in the text."""
    return sorted((start, kind, end) for kind, find in enumerate((_emails, _addresses, _cards, _phones)) for start, end in find(text))


def _lowered(text: str) -> str:
    """A-Z in lower case; no other character changes, so positions stay."""
    return text.encode("utf-8").lower().decode("utf-8")


def _short(term: str) -> str:
    return term if len(term) <= LONG_TERM else hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()


def _around(text: str, spans: list[tuple[int, int, int]], window: int) -> list[dict]:
    """The terms beside each entity that lie in no entity."""
    begins, ends, reach = [s[0] for s in spans], [], 0
    for s in spans:
        reach = max(reach, s[2])
        ends.append(reach)
    terms = []
    for found in TERM.finditer(text):
        before = bisect_left(begins, found.end())
        if not before or ends[before - 1] <= found.start():
            terms.append((found.start(), found.end(), _short(found.group())))
    starts, stops = [t[0] for t in terms], [t[1] for t in terms]
    near = []
    for start, kind, end in spans:
        value = re.sub("[^0-9]", "", text[start:end]) if kind > 1 else text[start:end]
        name = f"{kind}:" + hashlib.md5(value.encode(), usedforsecurity=False).hexdigest()
        before, after = bisect_right(stops, start), bisect_left(starts, end)
        for a, b, term in terms[max(0, before - window) : before] + terms[after : after + window]:
            near.append({"entity": name, "term": term, "start": a, "end": b})
    return near


OBSERVED = (
    "digest string, spans array<struct<start:int,kind:int,end:int>>, "
    "near array<struct<entity:string,term:string,start:int,end:int>>, term string, n long"
)
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _observed(rows: DataFrame, window: int) -> DataFrame:
    """A row for each text with entities, and rows (term, n): documents with the term; a null term counts all."""

    def batch(found: list[tuple], counts: Counter) -> pa.RecordBatch:
        many, few = len(counts), len(found)
        return pa.record_batch({
            "digest": pa.array([f[0] for f in found] + [None] * many, pa.string()),
            "spans": pa.array([f[1] for f in found] + [None] * many, SPANS),
            "near": pa.array([f[2] for f in found] + [None] * many, NEAR),
            "term": pa.array([None] * few + list(counts), pa.string()),
            "n": pa.array([None] * few + list(counts.values()), pa.int64()),
        })

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in batches:
            found, held = [], 0
            for digest, text in zip(rows.column(0), rows.column(1), strict=True):
                text = text.as_py()
                low = _lowered(text)
                counts.update({_short(t) for t in TERM.findall(low)})
                counts[None] += 1
                if spans := entities(text):
                    named = [{"start": s, "kind": k, "end": e} for s, k, e in spans]
                    found.append((digest.as_py(), named, _around(low, spans, window)))
                    held += len(spans)
                if held >= 20_000:
                    yield batch(found, Counter())
                    found, held = [], 0
                if len(counts) >= COUNTED_TERMS:
                    yield batch([], counts)
                    counts = Counter()
            if found:
                yield batch(found, Counter())
        yield batch([], counts)

    return settle(rows.select("digest", "text").mapInArrow(observe, OBSERVED), "entities")


def _disclosing(texts: DataFrame, observed: DataFrame, disclosure: float, least_bits: float, least_texts: int) -> DataFrame:
    """(entity, term) where the term tells at least ``disclosure`` of the entity's information."""
    documents = observed.where("n is not null and term is null").agg(F.sum("n")).first()[0] or 0
    pairs = texts.select("copies", F.explode(F.array_distinct(F.transform(
        "near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("pair"))
    joint = pairs.groupBy("pair.entity", "pair.term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
    joint = joint.where(F.col("texts") >= least_texts)
    held = texts.select("copies", F.explode(F.array_distinct("near.entity")).alias("entity"))
    held = held.groupBy("entity").agg(F.sum("copies").alias("with_entity"))
    terms = observed.where("term is not null").groupBy("term").agg(F.sum("n").alias("with_term"))
    told = F.log2(F.col("both") * F.lit(float(documents)) / (F.col("with_term") * F.col("with_entity")))
    whole = F.log2(F.lit(float(documents)) / F.col("with_entity"))
    found = joint.join(terms, "term").join(held, "entity")
    return found.where((told >= least_bits) & (told >= disclosure * whole)).select("entity", "term")


def found_spans(
    docs: DataFrame, text_col: str = "text", window: int = WINDOW, disclosure: float = DISCLOSURE,
    least_bits: float = LEAST_BITS, least_texts: int = LEAST_TEXTS, keep: list[str] | None = None,
) -> DataFrame:
    """Every row as struct ``row`` (of the columns ``keep``, else all) with its ``text`` and ``spans``: array<struct<start,kind,end>> by start, then kind.

    Kind is an index of ``KINDS``; positions are code points, end exclusive.  Spans by pattern
    are always there; spans of kind term are terms within ``window`` terms of an entity that
    they disclose, and overlap no other span.

    * A null text is empty and has no spans.  Copies are documents each, but one text: a term
      near an entity in fewer than ``least_texts`` differing texts is no pattern.
    * Repeated rows each have the same spans; extra columns stay inside ``row``.
    * Terms above 64 characters are told apart by MD5; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.md5(text).alias("digest"), text.alias("text"))
    observed = _observed(rows, window)
    texts = observed.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.any_value(F.struct("spans", "near")).alias("kept"))
    texts = settle(texts.select("digest", "copies", "kept.spans", "kept.near"), "texts")
    telling = settle(_disclosing(texts, observed, disclosure, least_bits, least_texts), "terms")
    near = texts.select("digest", F.explode("near").alias("x")).select("digest", "x.*")
    told = near.join(telling, ["entity", "term"]).groupBy("digest").agg(
        F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("told"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    both = texts.select("digest", "spans").join(told, "digest", "left").select(
        "digest", F.sort_array(F.concat("spans", F.coalesce("told", none))).alias("spans"))
    return rows.join(both, "digest", "left").select("row", "text", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def sanitised(docs: DataFrame, text_col: str = "text", **options: float) -> DataFrame:
    """All rows and columns of ``docs``; entities are replaced by their kind, words that disclose one removed.

    A disclosing number is generalised: its first digit stays, the others become 0.  Of
    overlapping spans the first decides.  Texts without any span stay as they are, null too.
    """
    found = found_spans(docs, text_col, **options)

    def shown(s: Column) -> Column:
        said = F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        number = (s["kind"] == KINDS.index("term")) & said.rlike("^[0-9]+$")
        return F.when(number, F.rpad(F.substr(said, F.lit(1), F.lit(1)), F.length(said), F.lit("0"))).otherwise(
            F.get(F.array(*map(F.lit, TAGS)), s["kind"]))

    rebuilt = F.aggregate(
        "spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(
                acc["done"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), shown(s))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at")),
        lambda acc: F.concat(acc["done"], F.substr(F.col("text"), acc["at"] + 1)),
    )
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text_col] = F.when(F.size("spans") > 0, rebuilt).otherwise(columns[text_col])
    return found.select(*[column.alias(name) for name, column in columns.items()])
