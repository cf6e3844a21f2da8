import hashlib
import random
import zlib

import pytest

from tablewright.llm import conversation_repair as repair
from tablewright.llm import oracles
from tablewright.llm.conversation_repair import audited, cheapest_repair, messages, repaired


def by_dynamic_programming(symbols):
    """(letters, cost) of the cheapest repair, least letters first."""

    def inserted(best):
        for _ in range(2):
            for state, (cost, letters) in list(best.items()):
                to, value = repair.SPOKEN[state], (cost + repair.INSERT, letters + "I")
                best[to] = min(best.get(to, value), value)
        return best

    best = inserted({repair.NOTHING: (0, "")})
    for symbol in symbols:
        ahead = {}
        for state, (cost, letters) in best.items():
            for letter, price, to in repair.ARCS[symbol][state]:
                value = (cost + price, letters + letter)
                ahead[to] = min(ahead.get(to, value), value)
        best = inserted(ahead)
    cost, letters = min(best[q] for q in (repair.NOTHING, repair.ASSISTANT) if q in best)
    return letters, cost


def brute(rows, damage=True):
    """The contract over (conv, turn, role, text) rows, one conversation at a time."""
    found = {}
    for conv in {r[0] for r in rows}:
        said = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            said += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        symbols, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in said:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        letters, cost = by_dynamic_programming(symbols)
        lines, at, state = [], 0, repair.NOTHING
        for letter in letters:
            if letter != "I":
                _, role, text = said[at]
                at += 1
            if letter == "D":
                continue
            state = repair.SYSTEM if letter == "K" and role[0] == "s" else repair.SPOKEN[state]
            lines.append({"K": f"{role}:{text}" if letter == "K" else "", "R": f"{repair.ROLES.get(state)}:{text}" if letter == "R" else "",
                          "I": f"{repair.ROLES.get(state)}:"}[letter])
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, sha)
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pid int")


def result(df, **options):
    return {r[0]: tuple(r)[1:] for r in audited(repaired(df, **options)).collect()}


def conversation(conv, count, seed=0):
    rng = random.Random(seed + conv)
    roles = ["system", "user", "assistant", "tool", "user", "assistant"]
    texts = ["Fine.", "Open", "", " \n", "Why?", "Good. ", None]
    return [(conv, t if rng.random() > 0.05 else None, rng.choice(roles), f"{rng.choice(texts) or ''}" if rng.random() < 0.2 else f"{t} said.")
            for t in range(count)]


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op13_auction_conversation_repair")


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4, 5, 6, 7, 8, 23, 24, 25, 60])
def test_auction_equals_dynamic_programming(length):
    rng = random.Random(length)
    for _ in range(80):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(length))
        assert cheapest_repair(symbols) == by_dynamic_programming(symbols)


def test_known_repairs():
    assert cheapest_repair("sua") == ("KKK", 0)
    assert cheapest_repair("u") == ("D", 2) and cheapest_repair("") == ("", 0)
    assert cheapest_repair("uu") == ("KR", 1)
    assert cheapest_repair("uaxua") == ("KKDKK", 2)
    assert cheapest_repair("uA") == ("DD", 4)


def test_segments_and_partitions_do_not_matter(spark, monkeypatch):
    rows = [r for conv in range(30) for r in conversation(conv, 1 + conv % 7)] + conversation(99, 400) + conversation(98, 90, 5)
    rows += [(99, 400 + k, "user", "Again.") for k in range(60)]
    expected = brute(rows)
    assert result(frame(spark, rows), damage=True) == expected
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = repaired(frame(spark, rows).repartition(5), damage=True)
        assert found.where("conv = 99").select("pid").distinct().count() > 1
        assert {r[0]: tuple(r)[1:] for r in audited(found).collect()} == expected
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 1, "user", "A."), (1, 1, "user", "A."), (1, 1, "user", "B."),
            (2, None, "", "x"), (2, -3, "assistant", "Über。 "), (3, 5, "user", "a\tb!\x0b"), (3, 900, "assistant", "Ja.")]
    assert result(frame(spark, rows)) == brute(rows, damage=False)
    assert result(frame(spark, rows), damage=True) == brute(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "y" * 5_000_000 + "!"), (2, 0, "user", "q" * 5_000_000)]
    assert result(frame(spark, rows)) == brute(rows, damage=False)
    assert result(frame(spark, rows).where("false")) == {}


def test_messages_keep_the_grammar(spark):
    rows = [r for conv in range(20) for r in conversation(conv, 12, 3)]
    said = messages(repaired(frame(spark, rows))).orderBy("conv", "pid", "seg", "position").collect()
    for conv in range(20):
        initials = "".join(r.role[:1] for r in said if r.conv == conv)
        assert __import__("re").fullmatch("(s?(ua)+)?", initials)


def test_sql_on_odd_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [r for conv in range(15) for r in conversation(conv, 6, 9)] + [(None, 1, "user", None), (77, None, None, "x.")]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert {r[0]: r[1:] for r in db.execute(oracles.conversation_repair_sql()).fetchall()} == brute(rows)
