"""Secret scans by sliding-window entropy.

Candidate strings (runs of 20 or more token characters) are read by a window of 20
characters.  The counts of the window's characters are kept while it slides, one enters
and one leaves, and the Shannon entropy follows from two table look-ups a step.  A
window above the limit of its character class (hexadecimal or Base64) is a finding;
overlapping findings merge.  Strings that an allow-list names are left out.  Three fixed
kinds (assignments, access keys, long hexadecimal strings) are found by pattern beside it
and are never suppressed.

All of it is column expressions over the row, so no table is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order of their listing.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character: random hexadecimal windows have about 3.45, random Base64 ones about 4.1.
HEX_BITS = 3.01
BASE64_BITS = 3.71
#: Strings that look random and are no secrets: UUIDs, plain numbers, words without digits, examples.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[0-9_+/=-]+$",
    r"^[a-z_+/=-]+$",
    r"^[A-Za-z]+([_/+=-]+[A-Za-z]*)*$",
    r"(?i)example|placeholder|sample|dummy",
)

MASK = "[SECRET]"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of all matches, in code points, end exclusive.

    The text is cut at the matches; a match starts after all cuts and matches before it.
    """
    parts = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    placed = F.aggregate(
        F.filter(parts, lambda p: p["found"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["gap"]) + F.char_length(p["found"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.char_length(p["gap"])).alias("start"),
                (acc["at"] + F.char_length(p["gap"]) + F.char_length(p["found"])).alias("end"),
                p["found"].alias("found"),
            ))).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def _gains(window: int) -> Column:
    """What a character's c-th occurrence adds to the sum of c * log2(c); index c."""
    weight = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    return F.array(F.lit(0.0), *[F.lit(weight[c] - weight[c - 1]) for c in range(1, window + 1)])


def _hot_windows(codes: Column, bits: Column, window: int) -> Column:
    """Merged [start, end) ranges of windows whose entropy is at least ``bits``."""
    gains = _gains(window)
    spans = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    nothing = F.lit(-1)

    def step(acc: Column, i: Column) -> Column:
        entering = F.get(codes, i)
        leaving = F.when(i >= window, F.get(codes, i - window)).otherwise(nothing)
        had_left = F.when(i >= window, F.get(acc["counts"], leaving)).otherwise(0)
        had_entered = F.get(acc["counts"], entering) - F.when(entering == leaving, 1).otherwise(0)
        total = acc["total"] - F.get(gains, had_left) + F.get(gains, had_entered + 1)
        hot = (i >= window - 1) & (F.lit(log2(window)) - total / window >= bits)
        start = i - (window - 1)
        apart = acc["till"] < start
        closed = F.concat(acc["spans"], F.array(F.struct(acc["since"].alias("start"), acc["till"].alias("end"))))
        return F.struct(
            F.transform(acc["counts"], lambda c, j: c + F.when(j == entering, 1).otherwise(0)
                        - F.when(j == leaving, 1).otherwise(0)).alias("counts"),
            total.alias("total"),
            F.when(hot & apart, start).otherwise(acc["since"]).alias("since"),
            F.when(hot, i + 1).otherwise(acc["till"]).alias("till"),
            F.when(hot & apart & (acc["till"] > 0), closed).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(codes) - 1),
        F.struct(
            F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"),
            F.lit(0).alias("since"), F.lit(-1).alias("till"), spans.alias("spans"),
        ),
        step,
        lambda acc: F.when(acc["till"] > 0, F.concat(acc["spans"], F.array(F.struct(
            acc["since"].alias("start"), acc["till"].alias("end"))))).otherwise(acc["spans"]),
    )


def _entropy_spans(text: Column, window: int, hex_bits: float, base64_bits: float, allowed: Sequence[str]) -> Column:
    def suspicious(found: Column) -> Column:
        wanted = found.rlike("[0-9]") & found.rlike("[A-Za-z]")
        for pattern in allowed:
            wanted = wanted & ~found.rlike(pattern)
        return wanted

    bits = lambda found: F.when(found.rlike("^([0-9a-f]+|[0-9A-F]+)$"), hex_bits).otherwise(base64_bits)
    candidates = F.filter(_matches(text, CANDIDATE), lambda m: suspicious(m["found"]))
    read = F.transform(candidates, lambda m: F.struct(
        m["start"].alias("start"), bits(m["found"]).alias("bits"),
        F.transform(F.filter(F.split(m["found"], ""), lambda c: c != ""), lambda c: F.ascii(c)).alias("codes"),
    ))
    return F.flatten(F.transform(read, lambda m: F.transform(
        _hot_windows(m["codes"], m["bits"], window),
        lambda s: F.struct((m["start"] + s["start"]).alias("start"), (m["start"] + s["end"]).alias("end")),
    )))


def scanned(
    docs: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    base64_bits: float = BASE64_BITS,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """Every row as struct ``row`` with its ``text`` and ``spans``.

    ``spans`` is array<struct<start,kind,end>> ordered by start, then kind; kind is an
    index of ``KINDS``; positions are code points, end exclusive.  A finding by entropy
    that lies within one by pattern is the same secret and not listed again.

    * A null text is empty and has no spans.
    * Repeated rows each have the same spans; extra columns stay inside ``row``.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")

    def kind(found: Column, index: int) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(index).alias("kind"), m["end"].alias("end")))

    long_value = lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= ASSIGN_VALUE
    rows = rows.withColumns({
        "base": F.concat(
            kind(F.filter(_matches(text, ASSIGN), long_value), 0),
            kind(_matches(text, ACCESS), 1), kind(_matches(text, HEX), 2),
        ),
        "dense": _entropy_spans(text, window, hex_bits, base64_bits, allowed),
    })
    fresh = F.filter("dense", lambda d: ~F.exists(
        "base", lambda b: (b["start"] <= d["start"]) & (d["end"] <= b["end"])))
    return rows.withColumn("spans", F.sort_array(F.concat(F.col("base"), kind(fresh, 3)))).select("row", "text", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def masked(docs: DataFrame, text_col: str = "text", mask: str = MASK, count_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``; every secret in the text is replaced by ``mask``.

    Overlapping secrets become one mask.  Texts without any stay as they are, null too.
    ``count_col`` names a column that holds the text's length; it follows a change.
    """
    rows = scanned(docs, text_col)
    rebuilt = F.aggregate(
        "spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(
                acc["done"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)
            )).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substr(F.col("text"), acc["at"] + 1)),
    )
    found = F.size("spans") > 0
    rows = rows.withColumn("clean", F.when(found, rebuilt))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text_col] = F.coalesce(F.col("clean"), columns[text_col])
    if count_col in columns:
        length = F.char_length("clean").cast(docs.schema[count_col].dataType)
        columns[count_col] = F.coalesce(length, columns[count_col])
    return rows.select(*[column.alias(name) for name, column in columns.items()])
