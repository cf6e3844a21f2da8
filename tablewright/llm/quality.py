"""Quality rules by distribution divergence.

A document is compared with language references: the shares of character classes, and
the shares of common words, over all documents of a language.  The measure is the
Jensen-Shannon distance (base 2, 0 to 1).  Short texts have too few characters or words
for a share to mean much, so guards leave them to the base rules.

Everything is a column expression.  One pass splits every text into words and settles its
counts; the references are sums of these counts by language (a handful of rows), and the
verdicts are made of them too, so no text is split twice.  Nothing is joined or shuffled
but those sums.  Languages of the table without a fixed list of common words get theirs
first, from their clean documents, by counts of words that are summed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import SPACES, settle

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the languages that have a reference.
COMMON_WORDS = {
    "de": ("der", "die", "und", "ist", "das", "von", "zu", "den", "für", "eine"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "with", "was", "it"),
    "es": ("de", "la", "que", "el", "los", "del", "las", "por", "con", "para"),
    "fr": ("le", "la", "et", "les", "des", "est", "dans", "pour", "que", "une"),
}
#: Common words that are learned for another language, and the least share of its words that one makes up.
LEARNED_WORDS = 10
LEARNED_SHARE = 0.005
#: Letters and digits are one class: numbers in a short text are no sign of poor quality.
LETTERS = r"[\p{L}\p{M}\p{Nd}]+"
#: Character classes apart from letters; what is in none is "other".
CLASSES = {
    "space": SPACES,
    "sentence": r"[.,;:!?'\"()-]+",
    "symbol": r"[#*$%&|<>]+",
}
MAX_CHAR_DISTANCE = 0.15
MAX_WORD_DISTANCE = 0.3
#: Documents with a larger share of symbols do not shape the references.
REFERENCE_SYMBOL_PERCENT = 2
GUARD_CHARS = 200
GUARD_WORDS = 50


def _vocabulary(common: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({word for words in common.values() for word in words})


def _rows(docs: DataFrame, text_col: str, lang_col: str | None, carry: Sequence[str]) -> DataFrame:
    """The carried columns as one struct, next to the text and the language; no name can clash."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        lang.alias("lang"),
    )


def _histograms(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """Adds words, n_words, n_chars, chars (counts by class) and commons (counts by word of the vocabulary)."""

    def left_out(column: str, pattern: str) -> Column:
        return F.char_length(column) - F.char_length(F.regexp_replace(column, pattern, ""))

    rows = rows.withColumn("rest", F.regexp_replace("text", LETTERS, ""))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_chars": F.char_length("text").cast("long"),
        "counted": F.array(*[left_out("rest", p).cast("long") for p in CLASSES.values()]),
        "found": F.filter(F.transform("words", F.lower), lambda w: w.isin(list(vocabulary))),
    })
    counted = [F.get("counted", F.lit(k)) for k in range(len(CLASSES))]
    letters = F.col("n_chars") - F.char_length("rest")
    other = F.char_length("rest") - sum(counted, F.lit(0))
    commons = [(F.size("found") - F.size(F.array_remove("found", word))).cast("long") for word in vocabulary]
    return rows.withColumns({
        "chars": F.array(letters, *counted, other.cast("long")),
        "commons": F.array(*commons),
    }).drop("rest", "counted", "found")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def _distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance."""

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(
        shares, reference,
        lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2,
    )
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*map(F.lit, values))


def _shaping() -> Column:
    """Whether a document shapes the references."""
    few = 100 * F.get("chars", F.lit(3)) <= REFERENCE_SYMBOL_PERCENT * F.col("n_chars")
    return (F.col("n_words") >= MIN_WORDS) & few


def learned_references(
    docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang",
    common: Mapping[str, Sequence[str]] = COMMON_WORDS,
) -> list[tuple[list[float], list[str], list[float]]]:
    """Shares of character classes, common words and their shares (the rest last) of each language not in ``common``.

    Common words are the most frequent ones, of those that make up 0.5 % of the words of
    the language's clean documents: at most 200 a language are ranked and 10 are taken.
    """
    if lang_col is None:
        return []
    rows = _rows(docs, text_col, lang_col, [lang_col])
    rows = rows.where(F.col("lang").isNotNull() & ~F.col("lang").isin(sorted(common)))
    if rows.select("lang").isEmpty():
        return []
    # The filter stays above a column that is not deterministic, else it would be moved below
    # the histograms with a copy of them.
    shapes = F.when(F.monotonically_increasing_id() >= 0, _shaping()).otherwise(False)
    clean = _histograms(rows, []).withColumn("shapes", shapes).where("shapes")
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 2)]
    totals = {r["lang"]: r for r in clean.groupBy("lang").agg(*sums, F.sum("n_words").alias("n_words")).orderBy("lang").collect()}
    if not totals:
        return []
    counts = clean.select("lang", F.explode("words").alias("word")).groupBy("lang", F.lower("word").alias("word")).count()
    total = F.create_map(*[F.lit(x) for lang, r in totals.items() for x in (lang, r["n_words"])])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    ranked = counts.where(F.col("count") >= LEARNED_SHARE * total[F.col("lang")]).withColumn("rank", rank)
    words: dict[str, dict[str, float]] = {lang: {} for lang in totals}
    for r in ranked.where(F.col("rank") <= LEARNED_WORDS).orderBy("lang", "rank").collect():
        words[r["lang"]][r["word"]] = r["count"] / totals[r["lang"]]["n_words"]
    found = []
    for lang, r in totals.items():
        chars = [r[f"c{k}"] for k in range(len(CLASSES) + 2)]
        shares = list(words[lang].values())
        found.append(([c / max(sum(chars), 1) for c in chars], list(words[lang]), [*shares, max(1 - sum(shares), 0.0)]))
    return found


def references(measured: DataFrame, common: Mapping[str, Sequence[str]] = COMMON_WORDS) -> list[tuple[list[float], list[float]]]:
    """Shares of character classes and of common words of each language in ``common``.

    Summed over measured documents of at least 20 words and at most 2 % symbols: one pair
    for each language that such documents have, or one pair over all of them where none
    has.  At most ``len(common) + 1`` rows reach the driver.  ``commons`` begins with the
    counts of the words of ``common``.
    """
    vocabulary = _vocabulary(common)
    known = F.when(F.col("lang").isin(sorted(common)), F.col("lang"))
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 2)]
    sums += [F.sum(F.get("commons", F.lit(k))).alias(f"w{k}") for k in range(len(vocabulary))]
    found = measured.where(_shaping()).groupBy(known.alias("lang")).agg(*sums, F.sum("n_words").alias("words")).orderBy("lang").collect()
    named = [row for row in found if row["lang"] is not None] or found

    def shares(values: list[int]) -> list[float]:
        return [v / max(sum(values), 1) for v in values]

    pairs = []
    for row in named:
        words = [row[f"w{k}"] for k in range(len(vocabulary))]
        pairs.append((shares([row[f"c{k}"] for k in range(len(CLASSES) + 2)]), shares([*words, row["words"] - sum(words)])))
    return pairs


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 8-word windows that the text has more than once."""

    def joined(left: str, gap: int) -> Column:
        length = F.greatest(F.size(left) - gap, F.lit(0))
        return F.zip_with(
            F.slice(left, F.lit(1), length), F.slice(left, F.lit(1 + gap), length), lambda a, b: F.xxhash64(a, b)
        )

    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("h2", joined("h1", 1)).withColumn("h4", joined("h2", 2)).withColumn("h8", joined("h4", 4))
    many = F.size(F.array_distinct("h8")) < F.size("h8")
    rows = rows.withColumn("placed", F.when(many, F.sort_array(F.transform(
        "h8", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, k: F.coalesce(F.get("placed", k)["x"] == e["x"], F.lit(False))
    rows = rows.withColumn("starts", F.when(many, F.sort_array(F.filter(F.transform(
        "placed", lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"])), lambda i: i.isNotNull()))))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("words"), F.lit(-WINDOW_WORDS).alias("last")),
        lambda acc, i: F.struct(
            (acc["words"] + F.least(F.lit(WINDOW_WORDS), i - acc["last"])).alias("words"), i.alias("last")),
        lambda acc: acc["words"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "h1", "h2", "h4", "h8", "placed", "starts")


def _measured(docs: DataFrame, text_col: str, lang_col: str | None, vocabulary: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Every row with its counts; the only pass that reads all texts."""
    rows = _repeat_words(_histograms(_rows(docs, text_col, lang_col, carry), vocabulary))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("lines", lines).withColumns({
        "word_chars": F.col("n_chars") - F.get("chars", F.lit(1)),
        "n_symbols": F.get("chars", F.lit(3)),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    }).drop("text", "words", "lines")


def judged(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    common: Mapping[str, Sequence[str]] = COMMON_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every row as struct ``row`` with its measures, base_failed, distances and kept.

    A document is kept when the base rules pass and, for at least one language, both
    distances are within their limits; below 200 characters the first, below 50 words the
    second is not judged.  The label of a document's language plays no part in its own
    verdict, so a wrong or missing one costs nothing.

    * Languages of the table that are not in ``common`` have references on words of their
      own.  One that only a few documents are labelled with is shaped by these few, so a
      label given to nothing but junk without symbols vouches for that junk.
    * A null text counts as empty: 0 words, base_failed.  A null language is in no reference.
    * Without any language reference (empty table) the base rules decide alone.
    * Repeated rows are judged one by one, all equal; extra columns stay inside ``row``.
    * ``carry`` names the columns of ``row``, all by default.  They are written with the
      counts, to the shared folder, so a caller that needs an id asks for no more.
    """
    learned = learned_references(docs, text_col, lang_col, common)
    vocabulary = _vocabulary(common)
    vocabulary += sorted({word for _, words, _ in learned for word in words} - set(vocabulary))
    carried = docs.columns if carry is None else list(carry)
    rows = settle(_measured(docs, text_col, lang_col, vocabulary, carried), "measures")
    held = {word: F.get("commons", F.lit(k)) for k, word in enumerate(vocabulary)}

    def word_shares(words: Sequence[str]) -> Column:
        return _shares(F.array(*[held[w] for w in words], F.col("n_words") - sum((held[w] for w in words), F.lit(0).cast("long"))))

    rows = rows.withColumn("char_shares", _shares(F.col("chars"))).withColumn("word_shares", word_shares(_vocabulary(common)))
    far = [(chars, F.col("word_shares"), words) for chars, words in references(rows, common)]
    far += [(chars, word_shares(words), shares) for chars, words, shares in learned]
    far = F.array(*[
        F.struct(_distance(F.col("char_shares"), _numbers(chars)).alias("chars"), _distance(shown, _numbers(shares)).alias("words"))
        for chars, shown, shares in far
    ]) if far else F.expr("cast(array() as array<struct<chars:double,words:double>>)")
    fits = F.exists("distances", lambda d: (
        ((d["chars"] <= max_char_distance) | (F.col("n_chars") < GUARD_CHARS))
        & ((d["words"] <= max_word_distance) | (F.col("n_words") < GUARD_WORDS))))
    rows = rows.withColumn("distances", F.when(~F.col("base_failed"), far))
    kept = ~F.col("base_failed") & (fits | (F.size("distances") == 0))
    # A filter on plain expressions would be moved below them, with copies of them all; it
    # stays above a column that is not deterministic.  The condition always holds.
    kept = F.when(F.monotonically_increasing_id() >= 0, F.coalesce(kept, F.lit(False))).otherwise(False)
    return rows.withColumn("kept", kept).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distances", "kept"
    )


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with."""
    return judged(docs, text_col, lang_col).where("kept").select("row.*")
