"""DuckDB SQL of the operators that SQL can express in full."""

from __future__ import annotations

from tessella.llm import jaccard_join, quality, spelling, substrings, url_filters

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def words(text: str) -> str:
    """CTEs l(rid, doc_id, ws), w(rid, doc_id, p, word) of every document's words."""
    return f"""l AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format(text)} AS ws FROM documents),
w AS (SELECT rid, doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM l)"""


def op5() -> str:
    t = substrings.THRESHOLD
    return f"""WITH {words("coalesce(text, '')")},
g AS (SELECT rid, doc_id, p, word, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS n FROM w
    WINDOW o AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND {t - 1} FOLLOWING)),
f AS (SELECT g, min(doc_id) AS first FROM g WHERE n = {t} GROUP BY g),
c AS (SELECT DISTINCT rid, p + unnest(range(0, {t})) AS p FROM g JOIN f USING (g) WHERE n = {t} AND first < doc_id),
k AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w ANTI JOIN c ON w.rid = c.rid AND w.p = c.p GROUP BY w.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN k USING (rid)"""


def op8() -> str:
    k = jaccard_join.WORDS
    return f"""WITH RECURSIVE {words(LOWER.format("coalesce(text, '')"))},
g AS (SELECT rid, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS n, p FROM w
    WINDOW o AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
s AS (SELECT DISTINCT rid, g FROM g WHERE n = {k} OR p = 1),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN z x ON x.rid = i.a JOIN z y ON y.rid = i.b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)),
r(a, b) AS (SELECT rid, rid FROM l UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT l.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(m.doc_id) AS component_id
FROM l JOIN r ON r.a = l.rid JOIN l m ON m.rid = r.b LEFT JOIN z ON z.rid = l.rid GROUP BY l.rid, l.doc_id"""


def op3() -> str:
    normal = f"array_to_string({WORDS.format(f'regexp_replace({LOWER.format("line")}, {chr(39)}[0-9]{chr(39)}, {chr(39)}0{chr(39)}, {chr(39)}g{chr(39)})')}, ' ')"
    return f"""WITH l AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '\\N') AS host, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM l),
g AS (SELECT rid, p, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
twice AS (SELECT rid, g FROM g WHERE n = 3 GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, p + unnest(range(0, 3)) AS p FROM g JOIN twice USING (rid, g) WHERE n = 3) GROUP BY rid),
raw AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM l),
lines AS (SELECT *, {normal} AS norm, len({WORDS.format("line")}) AS words FROM raw WHERE len({WORDS.format("line")}) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
per AS (SELECT rid, host, any_value(text) AS text, norm, sum(words) AS words FROM lines GROUP BY rid, host, norm),
frequent AS (SELECT host, norm FROM per GROUP BY host, norm HAVING count(DISTINCT text) > {quality.MAX_DOCUMENTS}),
gone AS (SELECT rid, sum(words)::BIGINT AS n FROM per JOIN frequent USING (host, norm) GROUP BY rid),
full_ AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
    FROM l LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM full_)
SELECT *, NOT base_failed AND n_words - removed_words >= {quality.LEAST_LEFT} * n_words AS kept FROM judged"""


def op13() -> str:
    # crc32 by its table: letters below 128 are one byte of UTF-8, the others 195 and their code less 64.
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    size, every = spelling.LEAST_LENGTH, spelling.EVERY
    return f"""WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda c, x: {step}) AS v FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, unnest(regexp_extract_all({LOWER.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
each AS (SELECT k, w, count(*) AS c FROM runs WHERE length(w) >= {size} GROUP BY k, w),
coded AS (SELECT w, c, flatten(list_transform(string_split(k || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))::UBIGINT[] AS b FROM each),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) % 256)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM coded, crc_table),
lost AS (SELECT c, CASE WHEN h % {every} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM lost WHERE length(word) >= {size} GROUP BY word HAVING sum(c) >= {spelling.LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM places),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.v = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.v = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS form_n, arg_max(other, (other_n, -r)) AS form
    FROM near JOIN (SELECT word AS other, row_number() OVER (ORDER BY encode(word)) AS r FROM words) USING (other) GROUP BY word),
linked AS (SELECT word, form, form_n FROM best WHERE form_n >= {spelling.FACTOR} * n),
chain(word, tip) AS (SELECT word, form FROM linked UNION ALL SELECT c.word, l.form FROM chain c JOIN linked l ON l.word = c.tip),
root AS (SELECT word, tip FROM chain WHERE tip NOT IN (SELECT word FROM linked))
SELECT w.word, l.form, coalesce(r.tip, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, l.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN linked l USING (word) LEFT JOIN root r USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op13_spelling_variants": op13(), "op3_quality_rules": op3(), "op5_substring_dedup": op5(), "op8_jaccard_join": op8(), "op9_url_filters": url_filters.oracle()}
