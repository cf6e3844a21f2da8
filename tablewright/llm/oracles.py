"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from tablewright.llm import conversation_repair as repair
from tablewright.llm import quality, secret_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def mixing_sql(weights=(1, 2, 3), rounds: int = 3, seed: int = 0) -> str:
    return rf"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, {list(weights)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS weight
            FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({rounds} * source_size) OVER w, 0))::DOUBLE
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM weighed
           WINDOW w AS (ORDER BY {rounds} * source_size / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT source, source_size,
                  least(({rounds} * source_size)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
queued AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', doc_id, '{seed}')), doc_id, size
                                     ROWS UNBOUNDED PRECEDING) - size AS begun FROM sized)
SELECT doc_id, size, source_size, target,
       list_sum(list_transform(range({rounds}), lambda r: greatest(0, least(size, round(target)::BIGINT
                                                   - (r * source_size + begun)))))::BIGINT AS taken
FROM queued JOIN shared ON queued.source IS NOT DISTINCT FROM shared.source"""


def quality_sql() -> str:
    vocabulary = sorted({w for words in quality.COMMON_WORDS.values() for w in words})
    languages = ", ".join(f"'{lang}'" for lang in sorted(quality.COMMON_WORDS))
    classes = [f"len(rest) - len(regexp_replace(rest, {_quoted(p)}, '', 'g'))" for p in quality.CLASSES.values()]
    commons = [f"len(list_filter(lowered, lambda x: x = {_quoted(v)}))" for v in vocabulary]

    def summed(column: str, count: int) -> str:
        return "[" + ", ".join(f"sum({column}[{k + 1}])" for k in range(count)) + "]"

    def distance(p: str, q: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return (f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: "
                f"({part.format('z[1]')} + {part.format('z[2]')}) / 2)), 0))")

    share = "list_transform({0}, lambda x: x / greatest(list_sum({0}), 1))"
    return rf"""
WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
parts AS (SELECT *, regexp_replace(t, {_quoted(quality.LETTERS)}, '', 'g') AS rest, list_transform(w, lambda x: lower(x)) AS lowered,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words),
counted AS (SELECT *, [{", ".join(classes)}] AS c, [{", ".join(commons)}] AS f FROM parts),
measured AS (SELECT *, list_concat([len(t) - len(rest)], c, [len(rest) - list_sum(c)]) AS chars,
                    list_concat(f, [len(w) - list_sum(f)]) AS commons FROM counted),
sums AS (SELECT lang, {summed("chars", len(classes) + 2)} AS c, {summed("commons", len(commons) + 1)} AS f
         FROM measured WHERE len(w) >= {quality.MIN_WORDS} AND 100 * chars[4] <= {quality.REFERENCE_SYMBOL_PERCENT} * len(t) AND lang IN ({languages}) GROUP BY lang),
learned AS (SELECT {share.format("c")} AS qc, {share.format("f")} AS qf FROM sums),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW_WORDS - 2})) AS i FROM words),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {quality.WINDOW_WORDS - 1}], ' ')) AS n
            FROM starts),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range({quality.WINDOW_WORDS}) r(k)
            WHERE n > 1 GROUP BY doc_id),
based AS (SELECT m.doc_id, len(w)::BIGINT AS n_words, (len(t) - chars[2])::BIGINT AS word_chars,
                 chars[4]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(n, 0)::BIGINT AS n_repeat_words, len(t) AS n_chars,
                 {share.format("chars")} AS pc, {share.format("commons")} AS pf
          FROM measured m LEFT JOIN covered USING (doc_id)),
failed AS (SELECT *, n_words < {quality.MIN_WORDS}
                     OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM based),
fits AS (SELECT doc_id, bool_or((n_chars < {quality.GUARD_CHARS} OR {distance("pc", "qc")} <= {quality.MAX_CHAR_DISTANCE})
                           AND (n_words < {quality.GUARD_WORDS} OR {distance("pf", "qf")} <= {quality.MAX_WORD_DISTANCE})) AS fit
         FROM failed, learned GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(fit, true) AS kept
FROM failed LEFT JOIN fits USING (doc_id)"""


def secrets_sql() -> str:
    def matches(name: str, pattern: str, wanted: str) -> str:
        quoted = _quoted(pattern)
        return f"""
{name}_cut AS (SELECT doc_id, regexp_extract_all(t, {quoted}) AS f, string_split_regex(t, {quoted}) AS g FROM texts
          WHERE regexp_matches(t, {quoted})),
{name}_at AS (SELECT doc_id, f[k] AS found, list_sum(list_transform(g[1:k], lambda x: len(x)))::BIGINT
              + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: len(x))), 0)::BIGINT AS a
          FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM {name}_cut)),
{name} AS (SELECT doc_id, a, a + len(found) AS e, found FROM {name}_at WHERE {wanted})"""

    allowed = " AND ".join(f"NOT regexp_matches(found, {_quoted(p)})" for p in secret_scan.ALLOWED)
    w = secret_scan.WINDOW
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{matches("assign", secret_scan.ASSIGN, f"len(regexp_extract(found, {_quoted(secret_scan.ASSIGN)}, 2)) >= {secret_scan.ASSIGN_VALUE}")},
{matches("access", secret_scan.ACCESS, "true")},
{matches("hex", secret_scan.HEX, "true")},
{matches("candidate", secret_scan.CANDIDATE, f"regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]') AND {allowed}")},
base AS (SELECT doc_id, a, e, 0 AS k FROM assign UNION ALL SELECT doc_id, a, e, 1 FROM access
         UNION ALL SELECT doc_id, a, e, 2 FROM hex),
slides AS (SELECT doc_id, a, found, unnest(range(1, len(found) - {w - 2})) AS i FROM candidate),
entropies AS (SELECT doc_id, a, i, found, list_sum(list_transform(list_distinct(string_split(substr(found, i, {w}), '')),
                 lambda c: -(({w} - len(replace(substr(found, i, {w}), c, ''))) / {w}.0)
                      * log2(({w} - len(replace(substr(found, i, {w}), c, ''))) / {w}.0))) AS h FROM slides),
hot AS (SELECT doc_id, a, i FROM entropies
        WHERE h >= CASE WHEN regexp_matches(found, '^([0-9a-f]+|[0-9A-F]+)$') THEN {secret_scan.HEX_BITS} ELSE {secret_scan.BASE64_BITS} END),
gaps AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, a ORDER BY i) <= {w} THEN 0 ELSE 1 END AS fresh FROM hot),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, a ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM gaps),
dense AS (SELECT doc_id, a + min(i) - 1 AS s, a + max(i) - 1 + {w} AS e FROM islands GROUP BY doc_id, a, island),
spans AS (SELECT * FROM base UNION ALL
          SELECT doc_id, s, e, 3 FROM dense d WHERE NOT EXISTS (
              SELECT 1 FROM base b WHERE b.doc_id = d.doc_id AND b.a <= d.s AND d.e <= b.e)),
named AS (SELECT *, {list(secret_scan.KINDS)}[k + 1] || ':' || a || ':' || e AS said FROM spans),
listed AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
                  count(*) FILTER (k = 2) AS n_hex, string_agg(said, ',' ORDER BY a, k) FILTER (k < 3) AS based,
                  string_agg(said, ',' ORDER BY a, k) AS said FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(based, '')) AS base_sha256, coalesce(said, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)"""


def near_dedup_sql(percent: int = 80) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN [w[1]]
              ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS met
           FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
                AND 100 * b.n >= {percent} * a.n AND 100 * a.n >= {percent} * b.n GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * met >= {percent} * (nx + ny - met)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""


def warc_sql(least_bytes: int = 1000) -> str:
    return f"""
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
                  FROM pages),
largest AS (SELECT payload_digest, max(page_id) AS origin FROM payloads WHERE payload_bytes >= {least_bytes} GROUP BY 1),
placed AS (SELECT p.*, CASE WHEN origin > page_id THEN origin END AS refers_to FROM payloads p
           LEFT JOIN largest l ON p.payload_digest = l.payload_digest AND payload_bytes >= {least_bytes})
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       refers_to FROM placed"""


def substring_dedup_sql(window: int = 20) -> str:
    return rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM words),
numbered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + {window - 1}], ' ')
                                                  ORDER BY doc_id, i) AS turn FROM starts),
covered AS (SELECT DISTINCT doc_id, i + k AS pos FROM numbered, range({window}) r(k) WHERE turn > 1),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
         FROM placed p WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = p.doc_id AND c.pos = p.pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


def conversation_repair_sql() -> str:
    spoken = {0: 2, 1: 2, 2: 3, 3: 2}
    edits = [("D", q, q, "NULL", repair.DELETE) for q in spoken] + [("R", q, to, "NULL", repair.REROLE) for q, to in spoken.items()]
    edits += [("K", 0, 1, "'s'", repair.KEEP)] + [("K", q, to, "'u'" if to == 2 else "'a'", repair.KEEP) for q, to in spoken.items()]
    arcs = ", ".join(f"('{letter}', {q}, {to}, {initial}, {cost})" for letter, q, to, initial, cost in edits)
    reached = f"""[{{'q': q, 'v': v}},
        {{'q': CASE q WHEN 2 THEN 3 ELSE 2 END, 'v': {{'cost': v.cost + {repair.INSERT}, 'audit': v.audit || 'I',
          'lines': list_append(v.lines, CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END)}}}},
        {{'q': CASE q WHEN 2 THEN 2 ELSE 3 END, 'v': {{'cost': v.cost + {2 * repair.INSERT}, 'audit': v.audit || 'II',
          'lines': v.lines || CASE q WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END}}}}]"""
    return rf"""
WITH RECURSIVE bits AS (
    SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
              list_prepend(4294967295::UBIGINT, list_transform(string_split(
                  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT)),
              lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255)::INT + 1])), 4294967295) % 20 AS fate FROM conversations, crcs),
said AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
                CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
                  regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS ending FROM said),
faulty AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, CASE
               WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
               WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
edits(letter, q, next, initial, cost) AS (VALUES {arcs}),
walk AS (
    SELECT conv_id, 0::BIGINT AS i, o.q AS q, o.v AS v
    FROM (SELECT conv_id, unnest({reached.replace("q WHEN", "0 WHEN").replace("'q': q", "'q': 0")}) AS o
          FROM (SELECT conv_id, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS v FROM counted))
    UNION ALL
    SELECT conv_id, i, o.q, min(o.v) FROM (
        SELECT conv_id, i, unnest({reached}) AS o FROM (
            SELECT w.conv_id, f.i, e.next AS q, {{
                'cost': (w.v.cost + e.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN {repair.TRUNCATED} ELSE 0 END)::BIGINT,
                'audit': w.v.audit || letter, 'lines': CASE letter WHEN 'D' THEN w.v.lines WHEN 'K' THEN list_append(w.v.lines, role || ':' || text)
                    ELSE list_append(w.v.lines, CASE e.next WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) END}} AS v
            FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1
            JOIN edits e ON e.q = w.q AND (letter = 'D' OR fault IN ('', 'truncated')) AND coalesce(e.initial = f.initial, true)))
    GROUP BY conv_id, i, o.q),
least AS (SELECT w.conv_id, min(v) AS v FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND i = n
          WHERE q IN (0, 3) GROUP BY w.conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.cost, 0) AS cost, coalesce(v.audit, '') AS audit,
       sha256(coalesce(array_to_string(v.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN least l ON d.conv_id IS NOT DISTINCT FROM l.conv_id"""


ORACLES = {
    "op2_weighted_fair_mixing": mixing_sql(),
    "op4_seekable_warc": warc_sql(),
    "op5_divergence_quality": quality_sql(),
    "op7_rolling_substring_dedup": substring_dedup_sql(),
    "op13_auction_conversation_repair": conversation_repair_sql(),
    "op9_entropy_secrets": secrets_sql(),
    "op10_minhash_near_dedup": near_dedup_sql(),
}
