from tablewright.llm.quality import drop_low_quality, judged

PROSE = "the cat and the dog walk to the house in the evening, and it is late. " * 3
CLEAN = " ".join(f"the w{k} and v{k} of u{k}, in t{k} is s{k}." for k in range(12))


def measures(docs):
    return {r.row.doc_id: r for r in judged(docs).collect()}


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op5_divergence_quality")


def test_base_counts(spark, documents):
    eight = "a b c d e f g h"
    found = measures(documents(
        (1, f"{eight} x {eight} y"), (2, None), (3, ""), (4, "one\none\n\n \n|x"), (5, " ".join(["w"] * 30)), (6, "é ß　x é"),
    ))
    assert (found[1].n_words, found[1].n_repeat_words) == (18, 16)
    assert found[1].base_failed and not found[1].kept
    assert (found[2].n_words, found[2].kept) == (0, False) and found[3].word_chars == 0
    assert (found[4].n_dup_lines, found[4].n_symbols, found[4].word_chars) == (1, 1, 8)
    assert found[5].n_repeat_words == 30
    assert found[6].n_words == 2 and found[6].word_chars == 6


def test_repeats_are_united_not_added(spark, documents):
    text = " ".join([*"abcdefghij", "x", *"abcdefghij", "y", *"bcdefghij"])
    words = text.split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    assert measures(documents((1, text)))[1].n_repeat_words == len(covered)


def test_symbols_are_rejected_and_prose_stays(spark, documents):
    junk = " ".join(f"{w}***" for w in CLEAN.split())
    docs = documents(*[(k, CLEAN + f" number {k}") for k in range(8)], (50, junk), (51, CLEAN, None))
    kept = drop_low_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(8), 51]


def test_repeated_rows_and_empty_table(spark, documents):
    docs = documents((1, CLEAN), (1, CLEAN), (None, CLEAN))
    assert drop_low_quality(docs).count() == 3
    assert drop_low_quality(docs.where("false")).collect() == []


def test_long_text(spark, documents):
    words = [f"the w{k}" for k in range(40_000)]
    found = measures(documents((1, " ".join(words))))[1]
    assert found.n_words == 80_000 and found.n_repeat_words == 0 and not found.base_failed


def test_clean_documents_of_a_fifth_language_stay(spark, documents):
    dutch = [" ".join(f"het w{k}x{d} van een v{k}x{d} wordt u{k}x{d}, niet t{k}x{d} voor s{k}x{d}." for k in range(8)) for d in range(6)]
    english = [(k, CLEAN + f" number {k}") for k in range(8)]
    salad = " ".join(f"q{k}z" for k in range(90)) + "."
    docs = documents(*english, *[(20 + d, text, "nl") for d, text in enumerate(dutch)], (40, dutch[0] + " wordt", None), (50, salad, "en"))
    found = measures(docs)
    assert all(found[k].kept for k in [*range(8), *range(20, 26), 40])
    assert not found[50].kept
    alone = measures(documents(*english, (50, salad, "en")))
    assert all(found[k].distances[0] == alone[k].distances[0] for k in range(8))


def test_a_filter_does_not_copy_the_plan(spark, documents):
    found = judged(documents(*[(k, CLEAN + f" number {k}") for k in range(4)]))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(found.where("kept")) < 1.2 * size(found)
