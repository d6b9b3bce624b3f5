"""SQL of the operators whose whole result SQL can express."""

from __future__ import annotations

from textloom.llm import divergence as D
from textloom.llm import quality_rules as Q

_WORD = r"[^\x20\x09-\x0D]+"


def jaccard(width: int, percent: int) -> str:
    """Shingle sets, all pairs that share a shingle, and reachability."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: {gram}) END) AS s FROM w),
    x AS (SELECT doc_id, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * c >= {percent} * (len(sa.s) + len(sb.s) - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s"""


def line_frequency() -> str:
    """Base counts by word windows; boilerplate lines by distinct texts per host; all by row, as ids can repeat."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(Q.WINDOW))
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    i AS (SELECT r, w, unnest(range(1, len(w) - {Q.WINDOW - 2})) AS i FROM w WHERE len(w) >= {Q.WINDOW}),
    g AS (SELECT r, i FROM (SELECT r, i, {gram} AS g FROM i) QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, range({Q.WINDOW}) t(k) GROUP BY r),
    y AS (SELECT r, source, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM w),
    b AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
    z AS (SELECT r, source, text, unnest(l) AS line FROM y),
    n AS (SELECT r, source, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(line, '{_WORD}')) AS k FROM z),
    h AS (SELECT source, count(DISTINCT text) AS docs FROM w GROUP BY source),
    f AS (SELECT n.source, line FROM n JOIN h ON h.source IS NOT DISTINCT FROM n.source GROUP BY n.source, line, docs HAVING count(DISTINCT text) > greatest({Q.MIN_DOCS}, least({Q.MAX_DOCS}, {Q.HOST_SHARE} * docs))),
    o AS (SELECT r, count(*) AS lost_lines, sum(k) AS lost_words FROM n JOIN f ON f.line = n.line AND f.source IS NOT DISTINCT FROM n.source GROUP BY r),
    a AS (SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
      coalesce(lost_lines, 0)::BIGINT AS lost_lines, coalesce(lost_words, 0)::BIGINT AS lost_words FROM b JOIN y USING (r) LEFT JOIN c USING (r) LEFT JOIN o USING (r))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (lost_words > 0 AND n_words - lost_words <= {Q.LEFT_SHARE} * n_words) AS kept FROM a"""


def divergence() -> str:
    """Every kept term in every source of its language, and all pairs of sources over all kept terms."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda n, total: f"1 + ({D.UNIT}::HUGEINT * ({n} + 2)) // ({total} + 2 * v)"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {D.MIN_DOCS}), s AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
    c AS MATERIALIZED (SELECT w.lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
    x AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c, {p("coalesce(c.c, 0)", "t.n")} AS p, {p("k.n", "s.n")} AS q FROM t JOIN s ON s.lang = t.lang JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
    y AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")}) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(y.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ({f("p", "q")})::BIGINT FROM x WHERE c > 0 AND p > q),
    o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM z)
    SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {D.TOP}"""


def dialogue() -> str:
    """The checksum bit by bit, costs to go turn by turn from the end, then the walk edit by edit."""
    blank = r"\x20\x09-\x0D"
    bits = "flatten(list_transform(string_split(key, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {bits}), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"
    raw = lambda q, keeps: f"least(c[{q + 1}] + 3, CASE WHEN kind IN (0, 3) THEN c[{(2, 2, 3, 2)[q] + 1}] + 2 + kind // 3 END{''.join(f", CASE WHEN kind IN (0, 3) AND initial = '{i}' THEN c[{to + 1}] + kind // 3 END" for i, to in keeps)})"
    settle = "[least(v[1], v[3] + 2), least(v[2], v[3] + 2), least(v[3], v[4] + 2), least(v[4], v[3] + 2)]"
    to = "CASE q WHEN 2 THEN 3 ELSE 2 END"
    stays = "CASE WHEN initial = 's' AND q = 0 THEN 1 WHEN initial = 'u' AND q <> 2 THEN 2 WHEN initial = 'a' AND q = 2 THEN 3 END"
    role = "CASE q WHEN 2 THEN 'assistant' ELSE 'user' END"
    return f"""WITH RECURSIVE k AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    w AS (SELECT *, {crc} % 20 AS what FROM k),
    d AS (SELECT r, conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE what WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM w WHERE what <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy) AS i FROM d),
    t AS MATERIALIZED (SELECT conv_id, turn, role, text, i, role[1] AS initial, CASE WHEN NOT regexp_matches(text, '[^{blank}]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][{blank}]*$') THEN 3 ELSE 0 END AS kind,
      lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM o),
    a AS (SELECT DISTINCT conv_id FROM k),
    n AS MATERIALIZED (SELECT a.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
      FROM a LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id GROUP BY a.conv_id),
    b(conv_id, i, c) AS (SELECT conv_id, n + 1, [0, 4, 2, 0]::BIGINT[] FROM n UNION ALL
      SELECT conv_id, i, {settle} FROM (SELECT conv_id, i, {settle} AS v FROM (SELECT t.conv_id, t.i, [{raw(0, [("s", 1), ("u", 2)])}, {raw(1, [("u", 2)])}, {raw(2, [("a", 3)])}, {raw(3, [("u", 2)])}] AS v FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1))),
    s AS MATERIALIZED (SELECT b.conv_id, b.i, b.c, e.c AS c_after, kind, initial, role, text FROM b LEFT JOIN b e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i),
    f(conv_id, i, q, audit, out) AS (SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM a UNION ALL
      SELECT conv_id, i + (letter <> 'I')::INT, CASE letter WHEN 'D' THEN q WHEN 'K' THEN {stays} ELSE {to} END, audit || letter, CASE letter WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || text) WHEN 'R' THEN list_append(out, {role} || ':' || text) ELSE list_append(out, {role} || ':') END
      FROM (SELECT f.*, s.role, s.text, s.initial, CASE WHEN kind IS NULL THEN 'I' WHEN c_after[q + 1] + 3 = c[q + 1] THEN 'D' WHEN c[{to} + 1] + 2 = c[q + 1] THEN 'I' WHEN kind IN (0, 3) AND c_after[{stays} + 1] + kind // 3 = c[q + 1] THEN 'K' ELSE 'R' END AS letter
        FROM f JOIN s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.i WHERE kind IS NOT NULL OR q IN (1, 2)))
    SELECT n.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, s.c[1]::BIGINT AS cost, audit, sha256(array_to_string(out, chr(10))) AS repaired_sha256
    FROM n JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.n + 1 AND q IN (0, 3) JOIN s ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = 1"""
