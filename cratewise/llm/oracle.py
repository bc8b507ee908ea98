"""SQL for the registered queries of this subpackage that SQL can express."""

ORACLE: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE["op3_decontaminate"] = rf"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS w, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM item, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
runs AS (
  SELECT doc_id, i, s.w, array_to_string(ws[i : i + s.w - 1], ' ') AS win
  FROM doc, (SELECT DISTINCT w FROM wins) AS s, unnest(range(1, len(ws) - s.w + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, runs.w FROM runs JOIN wins USING (w, win)),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, w)) AS t(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

_SPACED = r"[^\x20\x09-\x0D]+"

ORACLE["op4_jaccard_join"] = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM doc, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) - 1 AS n_links FROM link GROUP BY x)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc.doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id LEFT JOIN low ON low.x = doc.doc_id LEFT JOIN degree ON degree.x = doc.doc_id
"""


def _edit(state: str, cost: str, letter: str, row: str | None) -> str:
    """The state after one edit; null where the state cannot be reached."""
    out = f"list_append({state}.r, {row})" if row else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {out}}} END"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN fault < 2 AND initial = '{initial}' THEN {_edit(state, 'extra', 'K', 'content')} END"


def _reroled(state: str, role: str) -> str:
    return f"CASE WHEN fault < 2 THEN {_edit(state, '3 + extra', 'R', f"'{role}:' || text")} END"


def _inserted(state: str, role: str) -> str:
    return _edit(state, "3", "I", f"'{role}:'")


_AFTER_ROW = f"""
    {_edit('k0', '4', 'D', None)} AS n0,
    least({_edit('k1', '4', 'D', None)}, {_kept('k0', 's')}) AS n1,
    least({_edit('k2', '4', 'D', None)}, {', '.join(f(k, x) for k in ('k0', 'k1', 'k3') for f, x in ((_kept, 'u'), (_reroled, 'user')))}) AS n2,
    least({_edit('k3', '4', 'D', None)}, {_kept('k2', 'a')}, {_reroled('k2', 'assistant')}) AS n3"""
_WITH_USER = f"n0, n1, least(n2, {', '.join(_inserted(k, 'user') for k in ('n0', 'n1', 'n3'))}) AS m2, n3"
_WITH_ASSISTANT = f"n0 AS k0, n1 AS k1, m2 AS k2, least(n3, {_inserted('m2', 'assistant')}) AS k3"
_NOTHING = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]))"

# The crc32 of a text by its table; then the least (cost, letters) of each state, row by row.
ORACLE["op11_conversation_repair"] = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
checked AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(range(1, len(name) + 1), lambda c, k: xor(c >> 8, t[CAST(xor(c, CAST(ascii(name[k]) AS BIGINT)) % 256 AS INTEGER) + 1]), 4294967295), 4294967295) % 20 AS f
  FROM named, crc),
turns AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM checked, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM turns),
judged AS (
  SELECT conv_id, turn, i, role[1] AS initial, text, role || ':' || text AS content,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 2
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
              WHEN regexp_matches(text, '[.!?][ 	-
]*\z') THEN 0 ELSE 1 END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
rows AS (SELECT *, CASE WHEN fault = 1 THEN 3 ELSE 0 END AS extra FROM judged),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {_WITH_ASSISTANT} FROM (
    SELECT conv_id, {_WITH_USER} FROM (
      SELECT DISTINCT conv_id, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS n0, {_NOTHING} AS n1, {_NOTHING} AS n2, {_NOTHING} AS n3 FROM conversations))
  UNION ALL
  SELECT conv_id, i, {_WITH_ASSISTANT} FROM (
    SELECT conv_id, i, {_WITH_USER} FROM (
      SELECT dp.conv_id, rows.i, {_AFTER_ROW} FROM dp JOIN rows ON rows.conv_id IS NOT DISTINCT FROM dp.conv_id AND rows.i = dp.i + 1))),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
         count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
best AS (
  SELECT dp.conv_id, least(k0, k3) AS best, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
         coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM dp LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE i = coalesce(n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.r, chr(10))) AS repaired_sha256 FROM best
"""

ORACLE["op12_collocations"] = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
listed AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM piece),
total AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM listed GROUP BY lang),
f AS (
  SELECT lang, ws[i : i + m - 1] AS p, count(*) AS a FROM listed, unnest(range(1, 6)) AS s(m), unnest(range(1, len(ws) - m + 2)) AS t(i)
  GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, p, a, len(p) AS m FROM f WHERE len(p) > 1),
dropped AS (
  SELECT DISTINCT x.lang, x.p FROM cand c, unnest(range(1, c.m + 1)) AS s(b), unnest(range(b + 1, c.m + 1)) AS t(e), cand x
  WHERE x.lang = c.lang AND x.p = c.p[b:e] AND e - b + 1 < c.m AND 100 * c.a >= 100 * x.a),
cut AS (
  SELECT c.lang, c.p, c.a, k, l.a AS l, r.a AS r, n, CAST(1000 AS HUGEINT) * c.a * n // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT * FROM cand ANTI JOIN dropped USING (lang, p)) c CROSS JOIN LATERAL unnest(range(1, c.m)) AS s(k)
  JOIN total USING (lang) JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1 : c.m]),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
