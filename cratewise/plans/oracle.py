"""SQL that the registered queries are compared with, written for the checking engine."""

from __future__ import annotations

import re

from cratewise.functions import category as C
from cratewise.plans import standins as D
from cratewise.plans.queries import SAMPLE_SIZE, SEED, TARGET

ORACLE: dict[str, str] = {}


def with_parts(parts: dict[str, str], select: str, recursive: bool = False) -> str:
    word = "WITH RECURSIVE " if recursive else "WITH "
    return word + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + " " + select


# --- text search ------------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"

CORPUS = {
    "corpus": """
        SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS name, text AS description, lang AS category,
               coalesce(toxic = 1, false) AS broken, coalesce(quality = 0, false) AS unfree
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "lists": " UNION ALL ".join(
        f"SELECT id, '{c}' AS col, {_TOKENS.format(c)} AS l FROM corpus" for c in ["id", "name", "description"]
    ),
    "tok": "SELECT id, col, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM lists",
    "dl": "SELECT id, sum(len(l))::BIGINT AS dl FROM lists GROUP BY id",
    "totals": "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl",
}


def unit_sql(unit: str, column: str | None = None) -> str:
    """Occurrences of a word, a ``prefix*`` or a two-word phrase per document."""
    where = "" if column is None else f" AND a.col = '{column}'"
    words = unit.split()
    if len(words) == 2:
        return (
            "SELECT a.id, count(*) AS f FROM tok a JOIN tok b ON a.id = b.id AND a.col = b.col AND a.pos + 1 = b.pos "
            f"WHERE a.term = '{words[0]}' AND b.term = '{words[1]}'{where} GROUP BY a.id"
        )
    test = f"starts_with(a.term, '{unit[:-1]}')" if unit.endswith("*") else f"a.term = '{unit}'"
    return f"SELECT a.id, count(*) AS f FROM tok a WHERE {test}{where} GROUP BY a.id"


_IDF = (
    "CASE WHEN ln((n - {0} + 0.5) / ({0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - {0} + 0.5) / ({0} + 0.5)) END"
)
_SATURATION = "{0} * 2.2 / ({0} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


def hits_parts(required: list[str], any_of: list[str] = (), none_of: list[str] = (), columns: dict[str, str] | None = None) -> dict[str, str]:
    """``hits(doc_id, score, broken, unfree, category)`` for all matches."""
    units = [*required, *any_of, *none_of]
    parts = dict(CORPUS)
    for i, unit in enumerate(units):
        parts[f"u{i}"] = unit_sql(unit, (columns or {}).get(unit))
    scored = len(required) + len(any_of)
    score = " + ".join(
        f"coalesce({_IDF.format(f'(SELECT count(*) FROM u{i})')} * {_SATURATION.format(f'u{i}.f')}, 0)" for i in range(scored)
    )
    tests = [f"u{i}.f IS NOT NULL" for i in range(len(required))]
    if any_of:
        tests.append("(" + " OR ".join(f"u{i}.f IS NOT NULL" for i in range(len(required), scored)) + ")")
    tests += [f"u{i}.f IS NULL" for i in range(scored, len(units))]
    joins = " ".join(f"LEFT JOIN u{i} ON u{i}.id = c.id" for i in range(len(units)))
    parts["hits"] = (
        f"SELECT c.id AS doc_id, {score} AS score, broken, unfree, category "
        f"FROM corpus c JOIN dl ON dl.id = c.id CROSS JOIN totals {joins} WHERE {' AND '.join(tests)}"
    )
    return parts


def page_sql(parts: dict[str, str], limit: int, offset: int = 0) -> str:
    return with_parts(
        parts,
        "SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM hits) AS total_count "
        f"FROM (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT {limit} OFFSET {offset})",
    )


_ALL_HITS = "SELECT doc_id, round(score, 6) AS score FROM hits"

ORACLE["bm25_topk"] = page_sql(hits_parts(["in", "the"]), 10)
ORACLE["bm25_page2"] = page_sql(hits_parts(["in", "the"]), 10, 10)
ORACLE["bm25_by_maxima"] = page_sql(hits_parts(["that"], ["in", "license"]), 20, 5)
_RANKED = "SELECT l_orderkey || '-' || l_linenumber AS doc_id, round(l_extendedprice, 0)::DOUBLE AS score FROM lineitem ORDER BY score DESC, doc_id"
ORACLE["deep_page"] = f"{_RANKED} OFFSET 20000"
ORACLE["deep_page_window"] = f"{_RANKED} LIMIT 500 OFFSET 30000"
ORACLE["bm25_phrase"] = page_sql(hits_parts(["the and", "of"]), 25)
_filtered = hits_parts(["of"])
_filtered["hits"] = (
    f"SELECT * FROM ({_filtered['hits']}) WHERE NOT broken AND NOT unfree AND category = 'en' "
    "AND doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)"
)
ORACLE["bm25_filtered"] = page_sql(_filtered, 30)
ORACLE["bm25_with_documents"] = with_parts(
    hits_parts(["on"]),
    """SELECT h.doc_id AS id, round(score, 6) AS score, h.doc_id AS package_id,
              CASE WHEN c.category <> 'fr' THEN c.name ELSE '' END AS package_name,
              md5(CASE WHEN c.category <> 'fr' THEN c.description ELSE '' END) AS description_md5,
              CASE WHEN c.category <> 'fr' THEN c.category ELSE '' END AS category,
              true AS available, c.category = 'fr' AS is_stub
       FROM (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 40) h JOIN corpus c ON c.id = h.doc_id""",
)
ORACLE["match_all"] = with_parts(hits_parts(["that", "is"]), _ALL_HITS)
ORACLE["match_count"] = with_parts(hits_parts(["and"]), "SELECT count(*) AS total_count FROM hits WHERE NOT broken AND NOT unfree")
ORACLE["empty_search"] = "SELECT '' AS doc_id, 0.0::DOUBLE AS score, 0::BIGINT AS total_count WHERE false"
ORACLE["term_options"] = with_parts(hits_parts(["the", "wh*"], ["einlich", "license"], ["cionado"]), _ALL_HITS)
ORACLE["column_search"] = with_parts(hits_parts(["of", "src3"], columns={"src3": "name"}), _ALL_HITS)
ORACLE["term_stats"] = with_parts(CORPUS, "SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM tok GROUP BY term")
_CHANGED = {
    "given": CORPUS["corpus"],
    "corpus": """
        SELECT id, name, CASE WHEN new THEN 'Revised in part ' || description[CAST(floor(len(description) / 2) AS INTEGER) + 1 :] ELSE description END AS description,
               category, CASE WHEN new THEN NOT broken ELSE broken END AS broken, unfree
        FROM (SELECT *, CAST(id AS BIGINT) % 9 = 1 AS new FROM given WHERE CAST(id AS BIGINT) % 9 <> 4)
        UNION ALL SELECT 'new' || id, name, description, category, broken, unfree FROM given WHERE CAST(id AS BIGINT) % 9 = 7""",
}
ORACLE["segment_terms"] = with_parts(
    {**_CHANGED, **{k: v for k, v in CORPUS.items() if k != "corpus"}}, "SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM tok GROUP BY term"
)
ORACLE["segment_search"] = page_sql({**_CHANGED, **{k: v for k, v in hits_parts(["revised", "in"]).items() if k != "corpus"}}, 40)
ORACLE["postings_top"] = with_parts(
    CORPUS,
    "SELECT term, count(*) AS cf, count(DISTINCT (id, col)) AS postings, sum(pos)::BIGINT AS position_sum "
    "FROM tok GROUP BY term ORDER BY cf DESC, term LIMIT 100",
)
ORACLE["index_written"] = with_parts(
    CORPUS,
    """SELECT count(DISTINCT (term, id, col)) AS postings, count(*) AS tokens, (SELECT count(*) FROM documents) AS documents,
              (SELECT sum(dl)::BIGINT FROM dl) AS lengths FROM tok""",
)
ORACLE["document_lengths"] = with_parts(CORPUS, "SELECT id AS doc_id, dl, round(avgdl, 6) AS avgdl FROM dl CROSS JOIN totals")

REQUESTS = """
SELECT event_id AS request_id,
       CASE WHEN event_id % 17 <> 0 THEN user_id % 8 END AS text_no,
       CASE WHEN event_id % 17 <> 0 THEN CASE user_id % 8 WHEN 0 THEN 'in the' WHEN 1 THEN 'license' WHEN 2 THEN '"the and" of'
            WHEN 3 THEN 'einlich oder' WHEN 4 THEN 'Thé OF' WHEN 5 THEN '' WHEN 6 THEN 'cionado "de de"' ELSE 'c++/c#' END
            ELSE '' END AS q,
       CASE event_id % 5 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 50 END::INTEGER AS "limit",
       CASE event_id % 7 WHEN 1 THEN 2 WHEN 2 THEN -10 ELSE 0 END::INTEGER AS "offset",
       CASE WHEN user_id % 10 = 3 THEN 'GOOD-1.0' END AS license,
       CASE user_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'devel/libs' END AS category,
       event_id % 3 = 0 AS include_broken,
       event_id % 2 = 0 OR event_id % 4 = 1 AS include_unfree
FROM events
"""
ORACLE["request_params"] = f"SELECT * EXCLUDE (text_no) FROM ({REQUESTS})"

_TEXT_UNITS = [(0, "in"), (0, "the"), (1, "license"), (2, "the and"), (2, "of"), (3, "einlich"), (3, "oder"), (4, "the"), (4, "of"), (6, "cionado"), (6, "de de"), (7, "c")]
_units = sorted({u for _, u in _TEXT_UNITS})
ORACLE["batch_search"] = with_parts(
    {
        **CORPUS,
        "requests": REQUESTS,
        "wants": "SELECT * FROM (VALUES " + ", ".join(f"({t}, '{u}')" for t, u in _TEXT_UNITS) + ") v(text_no, unit)",
        "freq": " UNION ALL ".join(f"SELECT '{u}' AS unit, id, f FROM ({unit_sql(u)})" for u in _units),
        "weights": f"SELECT unit, {_IDF.format('m')} AS w FROM (SELECT unit, count(*) AS m FROM freq GROUP BY unit) CROSS JOIN totals",
        "scored": f"""SELECT text_no, freq.id, sum(w * {_SATURATION.format('f')}) AS score, count(*) AS got
                      FROM wants JOIN weights USING (unit) JOIN freq USING (unit) JOIN dl ON dl.id = freq.id CROSS JOIN totals
                      GROUP BY text_no, freq.id""",
        "full_hits": "SELECT * FROM scored WHERE got = (SELECT count(*) FROM wants w WHERE w.text_no = scored.text_no)",
        "found": """SELECT r.request_id, r."limit" AS lim, greatest(r."offset", 0) AS off, h.id, h.score,
                           row_number() OVER (PARTITION BY r.request_id ORDER BY h.score DESC, h.id) AS rank,
                           count(*) OVER (PARTITION BY r.request_id) AS total_count
                    FROM requests r JOIN full_hits h ON h.text_no = r.text_no JOIN corpus c ON c.id = h.id
                    WHERE (r.include_broken OR NOT c.broken) AND (r.include_unfree OR NOT c.unfree)
                      AND (r.category IS NULL OR r.category = c.category)
                      AND (r.license IS NULL OR h.id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1))""",
    },
    "SELECT request_id, rank, id AS doc_id, round(score, 6) AS score, total_count FROM found WHERE rank > off AND rank <= off + lim",
)



def _optioned() -> str:
    """Hits of every text with options, by the plain rules of one search."""
    found = []
    for i, (q, any_of, none_of, prefix) in enumerate(D.OPTION_TEXTS):
        required = [u for u in re.findall(r'"([^"]+)"|(\S+)', q) for u in u if u] + ([f"{prefix}*"] if prefix else [])
        if required or any_of:
            hits = with_parts(hits_parts(required, any_of.split(), none_of.split()), "SELECT doc_id, score, broken, category FROM hits")
            found.append(f"SELECT {i} AS text_no, * FROM ({hits})")
    return " UNION ALL ".join(found)


ORACLE["batch_options"] = with_parts(
    {
        "requests": f"""SELECT event_id AS request_id, user_id % {len(D.OPTION_TEXTS)} AS text_no, event_id % 4 + 1 AS lim,
                               CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS off, CASE WHEN event_id % 5 = 0 THEN 'en' END AS wanted,
                               event_id % 2 = 0 AS include_broken FROM events""",
        "hits_of_texts": _optioned(),
        "found": """SELECT request_id, lim, off, doc_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS rank,
                           count(*) OVER (PARTITION BY request_id) AS total_count
                    FROM requests JOIN hits_of_texts USING (text_no)
                    WHERE (include_broken OR NOT broken) AND (wanted IS NULL OR wanted = category)""",
    },
    "SELECT request_id, rank, doc_id, round(score, 6) AS score, total_count FROM found WHERE rank > off AND rank <= off + lim",
)

# --- dependency graph ---------------------------------------------------------------------------

NODES = "SELECT CAST(p_partkey AS VARCHAR) AS node_id, p_name, p_size FROM part"


GRAPH = {"edges": D.EDGES.format(text="VARCHAR"), "nodes": NODES}
PARTNERS = {"edges": D.PARTNERS.format(text="VARCHAR"), "nodes": NODES}
REACH = {
    "reach": "SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src",
}
# Shortest distances: breadth-first rounds, each pair once per distance, the minimum at the end.
_STEPS = "SELECT src, dst, {h} AS hops FROM edges {w} UNION SELECT s.src, e.dst, s.hops + 1 FROM steps s JOIN edges e ON s.dst = e.src WHERE s.hops < {m}"


def _lists(key: str, item: str) -> str:
    return with_parts(
        GRAPH,
        f"SELECT {key} AS node_id, 0::BIGINT AS page, count(*)::INTEGER AS n, string_agg({item}, '|' ORDER BY {item}) AS items FROM edges GROUP BY {key}",
    )


ORACLE["direct_deps"] = _lists("src", "dst")
ORACLE["direct_dependents"] = _lists("dst", "src")
_DEGREES = """SELECT node_id, (SELECT count(*) FROM edges WHERE src = node_id) AS out_degree,
                     (SELECT count(*) FROM edges WHERE dst = node_id) AS in_degree FROM nodes"""
ORACLE["degree_stats"] = with_parts(GRAPH, _DEGREES)
_SUMMARY = """count(*) AS total_packages, sum(out_degree)::BIGINT AS total_dependencies,
              round(sum(out_degree) / count(*), 6) AS average_dependencies_per_package,
              round(sum(out_degree) / count(*), 6) AS average_dependents_per_package,
              max(out_degree) AS max_dependencies, max(in_degree) AS max_dependents,
              count(*) FILTER (WHERE out_degree = 0) AS packages_with_no_dependencies,
              count(*) FILTER (WHERE in_degree = 0) AS packages_with_no_dependents"""
ORACLE["degree_extremes"] = with_parts({**GRAPH, "deg": _DEGREES}, f"SELECT {_SUMMARY} FROM deg")
for _name, _column in [("leaderboard_out", "out_degree"), ("leaderboard_in", "in_degree")]:
    ORACLE[_name] = with_parts(
        {**GRAPH, "deg": _DEGREES}, f"SELECT node_id, {_column} FROM deg ORDER BY {_column} DESC, node_id LIMIT 100"
    )
ORACLE["multigraph_degrees"] = with_parts(
    {"edges": GRAPH["edges"].replace("SELECT DISTINCT", "SELECT"), "nodes": NODES}, _DEGREES
)
_COUNTS = """SELECT node_id, coalesce(a.n, 0) AS dependency_count, coalesce(b.n, 0) AS dependent_count,
                    coalesce(c.n, 0) AS total_dependency_count, coalesce(d.n, 0) AS total_dependent_count,
                    coalesce(a.n, 0) > 0 AS has_dependencies, coalesce(b.n, 0) > 0 AS has_dependents{more}
             FROM nodes
             LEFT JOIN (SELECT src, count(*) AS n, string_agg(dst, '|' ORDER BY dst) AS l FROM edges GROUP BY src) a ON a.src = node_id
             LEFT JOIN (SELECT dst, count(*) AS n, string_agg(src, '|' ORDER BY src) AS l FROM edges GROUP BY dst) b ON b.dst = node_id
             LEFT JOIN (SELECT src, count(*) AS n, string_agg(dst, '|' ORDER BY dst) AS l FROM reach GROUP BY src) c ON c.src = node_id
             LEFT JOIN (SELECT dst, count(*) AS n, string_agg(src, '|' ORDER BY src) AS l FROM reach GROUP BY dst) d ON d.dst = node_id"""
_LISTS = """, coalesce(a.l, '') AS direct_dependencies, coalesce(b.l, '') AS direct_dependents,
              coalesce(c.l, '') AS all_dependencies, coalesce(d.l, '') AS all_dependents"""
ORACLE["closure_counts"] = with_parts({**PARTNERS, **REACH}, _COUNTS.format(more=""), recursive=True)
ORACLE["dependency_facts"] = with_parts({**PARTNERS, **REACH}, _COUNTS.format(more=_LISTS), recursive=True)
ORACLE["closure_pairs"] = with_parts(
    {**PARTNERS, "steps": _STEPS.format(h=1, w="", m=600), "best": "SELECT src, dst, min(hops) AS hops FROM steps GROUP BY src, dst"},
    "SELECT src, count(*) AS reached, max(hops) AS farthest, sum(hops)::BIGINT AS hop_sum FROM best GROUP BY src",
    recursive=True,
)
ORACLE["reach_from_seed"] = with_parts(
    {**GRAPH, "steps": _STEPS.format(h=1, w=f"WHERE src IN ('{SEED}', '{TARGET}')", m=40)},
    "SELECT src, dst, min(hops) AS hops FROM steps GROUP BY src, dst",
    recursive=True,
)
ORACLE["reach_into_seed"] = with_parts(
    {
        **GRAPH,
        "steps": f"""SELECT dst AS src, src AS dst, 1 AS hops FROM edges WHERE dst IN ('{SEED}', '{TARGET}')
                     UNION SELECT s.src, e.src, s.hops + 1 FROM steps s JOIN edges e ON s.dst = e.dst WHERE s.hops < 40""",
    },
    "SELECT src, dst, min(hops) AS hops FROM steps GROUP BY src, dst",
    recursive=True,
)
ORACLE["shortest_path"] = with_parts(
    {
        **GRAPH,
        "steps": _STEPS.format(h=1, w=f"WHERE src = '{SEED}'", m=40),
        "best": "SELECT dst, min(hops) AS hops FROM steps GROUP BY dst",
        "goal": f"SELECT dst, hops FROM best WHERE dst <> '{SEED}' ORDER BY hops DESC, dst LIMIT 1",
        "paths": f"""SELECT '{SEED}' AS place, ['{SEED}'] AS path, 0 AS hops
                     UNION ALL SELECT e.dst, list_append(p.path, e.dst), p.hops + 1
                     FROM paths p JOIN edges e ON e.src = p.place JOIN best b ON b.dst = e.dst AND b.hops = p.hops + 1""",
        "found": "SELECT min(path) AS path FROM paths WHERE place = (SELECT dst FROM goal)",
    },
    "SELECT (i - 1)::INTEGER AS position, node_id FROM (SELECT unnest(path) AS node_id, generate_subscripts(path, 1) AS i FROM found)",
    recursive=True,
)
_WCC = {
    "either": "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges",
    # A component's smallest member reaches every member over any neighbours.
    "spread": "SELECT node_id AS root, node_id AS b FROM nodes UNION SELECT s.root, e.b FROM spread s JOIN either e ON e.a = s.b",
    "weak": "SELECT b AS node_id, min(root) AS component FROM spread GROUP BY b",
}
_MUTUAL = {
    "mutual": "SELECT r.src AS node_id, min(r.dst) AS low FROM reach r JOIN reach q ON q.src = r.dst AND q.dst = r.src GROUP BY r.src",
    "strong": "SELECT n.node_id, coalesce(least(low, n.node_id), n.node_id) AS component FROM nodes n LEFT JOIN mutual m ON m.node_id = n.node_id",
}
ORACLE["scc_sizes"] = with_parts(
    {**PARTNERS, **REACH, **_MUTUAL}, "SELECT component, count(*) AS size FROM strong GROUP BY component", recursive=True
)
_CYCLE_EDGES = "SELECT src, dst, a.component FROM edges JOIN strong a ON a.node_id = src JOIN strong b ON b.node_id = dst WHERE a.component = b.component"
ORACLE["cycle_edges"] = with_parts({**GRAPH, **REACH, **_MUTUAL}, _CYCLE_EDGES, recursive=True)
ORACLE["cycle_witnesses"] = with_parts(
    {
        **PARTNERS,
        **REACH,
        **_MUTUAL,
        "inner_edges": _CYCLE_EDGES,
        "walk": """SELECT component, dst AS place, 1 AS hops FROM inner_edges WHERE src = component
                   UNION SELECT w.component, e.dst, w.hops + 1 FROM walk w JOIN inner_edges e ON e.component = w.component AND e.src = w.place
                   WHERE w.hops < 400 AND w.place <> w.component""",
    },
    """SELECT component, (min(hops) + 1)::INTEGER AS length FROM walk WHERE place = component
       GROUP BY component""",
    recursive=True,
)
LAYERED = {"edges": D.LAYERED.format(text="VARCHAR"), "nodes": NODES}
ORACLE["layered_closure_counts"] = with_parts({**LAYERED, **REACH}, _COUNTS.format(more=""), recursive=True)


def _reach_pages(key: str, item: str) -> str:
    return with_parts(
        {**LAYERED, **REACH, "placed": "SELECT node_id AS member, (row_number() OVER (ORDER BY node_id) - 1) // 512 AS page FROM nodes"},
        f"""SELECT {key} AS node_id, page, count(*)::INTEGER AS n, md5(string_agg({item}, '|' ORDER BY {item})) AS items_md5
            FROM reach JOIN placed ON member = {item} GROUP BY {key}, page""",
        recursive=True,
    )


ORACLE["paged_nodes_written"] = with_parts(
    {
        **LAYERED,
        **REACH,
        "placed": "SELECT node_id AS member, (row_number() OVER (ORDER BY node_id) - 1) // 512 AS page FROM nodes",
        "related": """SELECT src AS node_id, 'direct_dependencies' AS relation, dst AS item FROM edges UNION ALL SELECT dst, 'direct_dependents', src FROM edges
                      UNION ALL SELECT src, 'all_dependencies', dst FROM reach UNION ALL SELECT dst, 'all_dependents', src FROM reach""",
    },
    """SELECT node_id, p_name, relation, count(*) AS count, count(DISTINCT page) AS pages, md5(string_agg(item, '|' ORDER BY item)) AS items_md5
       FROM related JOIN placed ON member = item JOIN nodes USING (node_id) WHERE p_size = 15 GROUP BY node_id, p_name, relation""",
    recursive=True,
)
ORACLE["layered_scc_members"] = with_parts({**LAYERED, **REACH, **_MUTUAL}, "SELECT node_id, component FROM strong", recursive=True)
_NEAR = {"far_edges": LAYERED["edges"], "edges": "SELECT * FROM far_edges WHERE abs(CAST(src AS BIGINT) - CAST(dst AS BIGINT)) <= 20", "nodes": NODES}
ORACLE["edge_cycles"] = with_parts(
    {
        **_NEAR,
        **REACH,
        **_MUTUAL,
        "inside": _CYCLE_EDGES,
        "steps": """SELECT src, dst, 1 AS hops FROM inside
                    UNION SELECT s.src, e.dst, s.hops + 1 FROM steps s JOIN inside e ON s.dst = e.src WHERE s.hops < 40""",
        "best": "SELECT src, dst, min(hops) AS hops FROM steps GROUP BY src, dst",
        "paths": """SELECT i.src AS goal, i.dst AS first, i.component, i.dst AS place, [i.dst] AS path, b.hops AS rest FROM inside i JOIN best b ON b.src = i.dst AND b.dst = i.src
                    UNION ALL SELECT p.goal, p.first, p.component, e.dst, list_append(p.path, e.dst), p.rest - 1
                    FROM paths p JOIN inside e ON e.src = p.place LEFT JOIN best b ON b.src = e.dst AND b.dst = p.goal
                    WHERE p.rest > 0 AND (e.dst = p.goal AND p.rest = 1 OR b.hops = p.rest - 1)""",
        "back": "SELECT goal, first, component, min(path) AS path FROM paths WHERE rest = 0 GROUP BY goal, first, component",
        "turned": "SELECT component, path, list_position(path, list_min(path)) AS k FROM back",
    },
    "SELECT DISTINCT component, array_to_string(list_concat(path[k:], path[1:k]), '|') AS cycle FROM turned",
    recursive=True,
)
ORACLE["layered_dependency_pages"] = _reach_pages("src", "dst")
ORACLE["layered_dependent_pages"] = _reach_pages("dst", "src")
# The same over all lines.
_FULL = {**GRAPH, **REACH, **_MUTUAL}
ORACLE["full_closure_counts"] = with_parts({**GRAPH, **REACH}, _COUNTS.format(more=""), recursive=True)
ORACLE["full_component_reach"] = with_parts(
    {**_FULL, "sizes": "SELECT component, count(*) AS size FROM strong GROUP BY component"},
    """SELECT DISTINCT a.component, s.size, b.component AS reached, t.size AS reached_size FROM reach
       JOIN strong a ON a.node_id = src JOIN strong b ON b.node_id = dst
       JOIN sizes s ON s.component = a.component JOIN sizes t ON t.component = b.component""",
    recursive=True,
)
ORACLE["full_scc_members"] = with_parts(_FULL, "SELECT node_id, component FROM strong", recursive=True)
ORACLE["full_cycle_edges"] = with_parts(_FULL, _CYCLE_EDGES, recursive=True)
ORACLE["full_cycle_witnesses"] = with_parts(
    {
        **_FULL,
        "inner_edges": _CYCLE_EDGES,
        "walk": """SELECT component, dst AS place, 1 AS hops FROM inner_edges WHERE src = component
                   UNION SELECT w.component, e.dst, w.hops + 1 FROM walk w JOIN inner_edges e ON e.component = w.component AND e.src = w.place
                   WHERE w.hops < 400 AND w.place <> w.component""",
    },
    """SELECT component, (min(hops) + 1)::INTEGER AS length FROM walk WHERE place = component
       GROUP BY component""",
    recursive=True,
)
ORACLE["full_graph_summary"] = with_parts(
    {**_FULL, **_WCC, "deg": _DEGREES},
    f"""SELECT {_SUMMARY}, (SELECT count(DISTINCT component) FROM strong) AS strongly_connected_components,
               (SELECT count(DISTINCT component) FROM weak) AS weakly_connected_components FROM deg""",
    recursive=True,
)
ORACLE["wcc_sizes"] = with_parts(
    {**GRAPH, **_WCC}, "SELECT component, count(*) AS size FROM weak GROUP BY component", recursive=True
)
ORACLE["graph_summary"] = with_parts(
    {**PARTNERS, **REACH, **_MUTUAL, **_WCC, "deg": _DEGREES},
    f"""SELECT {_SUMMARY}, (SELECT count(DISTINCT component) FROM strong) AS strongly_connected_components,
               (SELECT count(DISTINCT component) FROM weak) AS weakly_connected_components FROM deg""",
    recursive=True,
)


def _around(node: str) -> dict[str, str]:
    """Nodes and links around a node given as an SQL expression."""
    return {
        "links": f"""SELECT src AS source, dst AS target, 'dependency' AS type FROM edges WHERE src = {node}
                     UNION ALL SELECT src, dst, 'dependent' FROM edges WHERE dst = {node}""",
        "around": f"""SELECT node_id, CASE min(k) WHEN 0 THEN 'main' WHEN 1 THEN 'dependency' ELSE 'dependent' END AS role FROM (
                        SELECT node_id, 0 AS k FROM nodes WHERE node_id = {node}
                        UNION ALL SELECT dst, 1 FROM edges WHERE src = {node}
                        UNION ALL SELECT src, 2 FROM edges WHERE dst = {node}) GROUP BY node_id""",
    }


_EGO = {**GRAPH, **_around(f"'{SEED}'")}
_NEXT = "(SELECT coalesce(min(node_id), '" + SEED + "') FROM around WHERE role <> 'main')"
_OPENED = {**_EGO, **{f"next_{k}": v for k, v in _around(_NEXT).items()}}
ORACLE["ego_graph"] = with_parts(_EGO, "SELECT node_id, role, false AS expanded FROM around")
ORACLE["ego_links"] = with_parts(_EGO, "SELECT * FROM links")
ORACLE["expand_node"] = with_parts(
    _OPENED,
    f"""SELECT node_id, role, node_id = {_NEXT} AS expanded FROM around
        UNION ALL SELECT node_id, role, false FROM next_around WHERE role <> 'main' AND node_id NOT IN (SELECT node_id FROM around)""",
)
ORACLE["expand_links"] = with_parts(
    _OPENED,
    "SELECT * FROM links UNION ALL SELECT * FROM next_links n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source = n.source AND l.target = n.target)",
)
ORACLE["node_metadata"] = with_parts(
    GRAPH, "SELECT * FROM nodes WHERE node_id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem)"
)
ORACLE["edge_list"] = with_parts(GRAPH, "SELECT src || ' ' || dst AS line FROM edges UNION ALL SELECT '# source target'")

# --- normalization ------------------------------------------------------------------------------


def category_sql(path: str) -> str:
    rules = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({path}), '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in C.PATH_RULES.items()
    )
    return f"CASE {rules} ELSE 'misc' END"


NAMED = {
    "facts": D.VARIANT_FACTS,
    "cut": r"""SELECT *, string_split(full_name, '-') AS np,
                      nullif(list_position(list_transform(string_split(full_name, '-'), lambda x: regexp_matches(x, '^([0-9]|v)')), true), 0) AS vi
               FROM facts""",
    "named": """SELECT *,
        CASE WHEN full_name = '' THEN 'unknown' WHEN len(np) < 2 OR vi = 1 THEN full_name
             WHEN vi IS NULL THEN array_to_string(np[1:len(np) - 1], '-') ELSE array_to_string(np[1:vi - 1], '-') END AS package_name,
        CASE WHEN full_name = '' OR len(np) < 2 THEN 'unknown' WHEN vi IS NULL THEN np[len(np)]
             ELSE array_to_string(np[vi:len(np)], '-') END AS version
        FROM cut""",
}
CLEAN = {
    **NAMED,
    "clean": f"""SELECT *, concat(attr_path, chr(1), drv_path) AS o, attr_path AS attribute_path,
        CASE WHEN attr_path = '' THEN package_name || '@' || version
             WHEN contains(string_split(attr_path, '.')[-1], 'linux') THEN array_to_string(string_split(attr_path, '.')[1:-2], '.')
             ELSE attr_path END AS package_id,
        l_partkey % 31 <> 0 AS has_meta,
        CASE WHEN l_partkey % 31 <> 0 AND l_linenumber = 1 THEN concat('A ', p_name, ' from ', s_name) ELSE '' END AS description,
        CASE WHEN l_partkey % 31 <> 0 AND l_linenumber % 2 = 0 THEN concat('https://example.org/', l_partkey) ELSE '' END AS homepage,
        CASE WHEN l_partkey % 31 <> 0 AND l_partkey % 3 = 0 THEN concat('run-', l_partkey) ELSE '' END AS main_program,
        CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'string' WHEN l_partkey % 5 = 1 THEN 'object'
             WHEN l_partkey % 5 = 2 THEN 'array' WHEN l_partkey % 5 = 4 AND p_size <> 0 THEN 'string' END AS license_kind,
        CASE WHEN l_partkey % 31 = 0 OR l_partkey % 5 = 3 THEN NULL WHEN l_partkey % 5 = 2 THEN [p_brand, 'MIT']
             WHEN l_partkey % 5 = 4 THEN [CAST(p_size AS VARCHAR)] ELSE [p_brand] END AS licenses,
        CASE WHEN l_partkey % 31 <> 0 AND l_linenumber <> 3 THEN [system, nation] ELSE [] END AS platforms,
        CASE WHEN l_suppkey % 4 = 3 THEN concat('Team ', l_suppkey % 3) ELSE s_name END AS m_name,
        CASE WHEN l_suppkey % 4 = 0 THEN concat('s', l_suppkey, '@example.org') ELSE '' END AS m_email,
        CASE WHEN l_suppkey % 4 = 0 THEN concat('gh', l_suppkey) WHEN l_suppkey % 4 = 3 THEN concat('gh', l_suppkey % 8) ELSE '' END AS m_github,
        CASE WHEN l_suppkey % 4 = 0 AND l_linenumber % 2 = 0 THEN l_suppkey END AS m_id,
        CASE WHEN l_partkey % 31 <> 0 AND l_partkey % 6 = 0 THEN 'text-tools' WHEN l_partkey % 31 <> 0 AND l_partkey % 6 = 1 THEN 'misc.other'
             ELSE {category_sql('attr_path')} END AS category,
        l_partkey % 31 <> 0 AND l_returnflag = 'R' AS broken,
        l_partkey % 31 <> 0 AND l_partkey % 9 IN (0, 2) AS unfree,
        l_partkey % 31 <> 0 AND l_partkey % 40 = 0 AS insecure,
        false AS unsupported,
        l_partkey % 31 = 0 OR l_linenumber NOT IN (6, 7) AS available,
        CASE WHEN l_partkey % 31 <> 0 AND l_partkey % 2 = 0 THEN 'out|dev' ELSE '' END AS outputs_to_install,
        CASE WHEN l_linenumber % 2 = 0 THEN concat('{{"out":"', drv_path, '"}}') ELSE '{{}}' END AS outputs
        FROM named WHERE package_name NOT IN ('', 'unknown')""",
}


def clean_sql(select: str) -> str:
    return with_parts(CLEAN, select)


ORACLE["name_version"] = with_parts(NAMED, "SELECT drv_path, full_name, package_name, version FROM named")
ORACLE["store_path_name"] = with_parts(NAMED, "SELECT drv_path, package_name AS name FROM named")
ORACLE["normalize_counts"] = clean_sql(
    "SELECT (SELECT count(*) FROM named) AS records, (SELECT count(*) FROM clean) AS kept, (SELECT count(*) FROM named) - (SELECT count(*) FROM clean) AS dropped"
)
ORACLE["package_id"] = clean_sql(
    "SELECT drv_path, package_id, attribute_path, CASE WHEN attr_path = '' THEN '' ELSE system END AS system, package_name || '-' || version AS node_id FROM clean"
)
ORACLE["sanitize"] = clean_sql(
    f"""SELECT drv_path, description, homepage, main_program, '{D.RUN_TS}' AS last_updated,
               concat_ws(' ', package_name, nullif(description, ''), nullif(attribute_path, ''), nullif(main_program, '')) AS search_text FROM clean"""
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(12288)"
ORACLE["sanitize_texts"] = f"SELECT doc_id, md5(trim(text, {_BLANKS})) AS clean_md5 FROM documents"
_words = [w for ws in C.PATH_RULES.values() for w in ws] + ["plain"]
_word_list = "[" + ", ".join(f"'{w}'" for w in _words) + "]"
ORACLE["category_rules"] = f"""
    SELECT p_partkey, attr_path, {category_sql('attr_path')} AS category FROM (
        SELECT p_partkey, concat('Top.', upper(w[1]), lower(w[2:]), '.', replace(p_name, ' ', '.')) AS attr_path
        FROM (SELECT *, {_word_list}[p_partkey % {len(_words)} + 1] AS w FROM part))"""
_names = [*C.CATEGORY_NAMES, "other.things", ""]
_shown = [*C.CATEGORY_NAMES.values(), "other.things", "misc"]
ORACLE["category_map"] = (
    "SELECT p_partkey, [" + ", ".join(f"'{s}'" for s in _shown) + f"][p_partkey % {len(_names)} + 1] AS category FROM part"
)
ORACLE["package_category"] = clean_sql("SELECT drv_path, category FROM clean")
ORACLE["license_norm"] = clean_sql(
    """SELECT drv_path, license_kind, (i - 1)::INTEGER AS pos, short_name,
              CASE WHEN license_kind = 'object' THEN concat(p_brand, ' License') ELSE '' END AS full_name,
              CASE WHEN license_kind = 'object' THEN l_linenumber % 2 = 0 WHEN license_kind = 'array' AND i = 2 THEN true END AS free,
              CAST(NULL AS BOOLEAN) AS redistributable
       FROM (SELECT *, unnest(licenses) AS short_name, generate_subscripts(licenses, 1) AS i FROM clean WHERE license_kind IS NOT NULL)"""
)
ORACLE["platforms_norm"] = clean_sql("SELECT drv_path, array_to_string(platforms, '|') AS platforms, outputs_to_install FROM clean")
ORACLE["maintainer_norm"] = clean_sql(
    "SELECT drv_path, m_name AS name, m_email AS email, m_github AS github, m_id AS github_id FROM clean WHERE has_meta"
)
ORACLE["flags"] = clean_sql("SELECT drv_path, broken, unfree, insecure, unsupported, available FROM clean")
ORACLE["map_snapshot"] = with_parts(
    {
        "facts": D.VARIANT_FACTS,
        "entries": """SELECT *, concat(attr_path, '/', drv_path) AS attribute_path,
                             CASE WHEN l_partkey % 3 = 0 THEN concat('n', l_partkey) ELSE 'drv' END AS package_name
                      FROM facts WHERE attr_path <> ''""",
    },
    """SELECT attribute_path, package_name, CASE WHEN l_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END AS version,
              CASE WHEN l_partkey % 5 = 0 THEN 'inner' ELSE 'top' END AS description, 'L1' AS license, true AS broken FROM entries""",
)
ORACLE["snapshot_lines"] = """
    SELECT 'header' AS part, 7::BIGINT AS rows FROM events WHERE event_id = 0
    UNION ALL SELECT 'bad', count(*) FROM events WHERE event_id % 10 = 1
    UNION ALL SELECT 'records', count(*) FROM events WHERE event_id <> 0 AND event_id % 10 NOT IN (1, 2)"""

_PARENTS = {
    **NAMED,
    "live": "SELECT *, package_name || '-' || version AS node_id FROM named WHERE package_name NOT IN ('', 'unknown')",
}
ORACLE["graph_from_records"] = with_parts(
    _PARENTS,
    """SELECT DISTINCT a.node_id AS src, b.node_id AS dst FROM live a JOIN live b
         ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
       WHERE a.node_id <> b.node_id""",
)
ORACLE["vertices_from_records"] = with_parts(
    _PARENTS,
    """SELECT node_id, any_value(package_name) AS package_name, any_value(version) AS version,
              arg_max(attr_path, concat(attr_path, chr(1), drv_path)) AS attr_path,
              arg_max(drv_path, concat(attr_path, chr(1), drv_path)) AS drv_path FROM live GROUP BY node_id""",
)

# --- merge and star schema ------------------------------------------------------------------------

MERGED = {
    **CLEAN,
    "people": """SELECT package_id, m_name AS name, m_email AS email, m_github AS github, arg_max(m_id, o) FILTER (WHERE m_id IS NOT NULL) AS any_id,
                        max_by({'id': m_id}, o).id AS github_id
                 FROM clean WHERE has_meta GROUP BY ALL""",
    "systems": "SELECT DISTINCT package_id, unnest(platforms) AS platform FROM clean",
    "person_lists": """SELECT package_id, string_agg(concat_ws('/', name, email, github, CAST(github_id AS VARCHAR)), '|' ORDER BY name, email, github) AS maintainers
                       FROM people GROUP BY package_id""",
    "system_lists": "SELECT package_id, string_agg(platform, '|' ORDER BY platform) AS platforms FROM systems GROUP BY package_id",
    "scalars": """SELECT package_id, arg_min(package_name, o) AS package_name, arg_min(version, o) AS version, arg_min(attribute_path, o) AS attribute_path,
                         coalesce(arg_min(description, o) FILTER (WHERE description <> ''), '') AS description,
                         coalesce(arg_min(homepage, o) FILTER (WHERE homepage <> ''), '') AS homepage,
                         coalesce(arg_min(category, o) FILTER (WHERE category <> ''), '') AS category,
                         coalesce(arg_min(main_program, o) FILTER (WHERE main_program <> ''), '') AS main_program,
                         arg_min(outputs_to_install, o) AS outputs_to_install,
                         arg_min({'k': license_kind, 'l': licenses}, o) FILTER (WHERE license_kind IS NOT NULL) AS lic,
                         bool_or(broken) AS broken, bool_or(unfree) AS unfree, bool_or(insecure) AS insecure, bool_or(unsupported) AS unsupported,
                         bool_and(available) AS available
                  FROM clean GROUP BY package_id""",
    "merged": """SELECT s.*, lic.k AS license_kind, lic.l AS licenses, maintainers, platforms
                 FROM scalars s LEFT JOIN person_lists USING (package_id) LEFT JOIN system_lists USING (package_id)""",
}


def merged_sql(select: str) -> str:
    return with_parts(MERGED, select)


ORACLE["merge_variants"] = merged_sql(
    """SELECT package_id, package_name, version, attribute_path, description, homepage, category, main_program,
              coalesce(license_kind, '') AS license_kind, coalesce(array_to_string(licenses, '|'), '') AS licenses,
              coalesce(platforms, '') AS platforms, coalesce(maintainers, '') AS maintainers, broken, unfree, insecure, unsupported, available
       FROM merged"""
)
_EACH_LICENSE = """SELECT *, unnest(licenses) AS short_name, generate_subscripts(licenses, 1) AS i FROM clean WHERE license_kind IS NOT NULL"""
ORACLE["dim_license"] = with_parts(
    {
        **CLEAN,
        "each_one": _EACH_LICENSE,
        "last_one": """SELECT short_name, arg_max({'k': license_kind, 'b': p_brand, 'e': l_linenumber % 2 = 0, 'i': i}, o) AS r FROM each_one GROUP BY short_name""",
    },
    """SELECT short_name, CASE WHEN r.k = 'object' THEN concat(r.b, ' License') ELSE '' END AS full_name, '' AS spdx_id, '' AS url,
              CASE WHEN r.k = 'object' THEN r.e WHEN r.k = 'array' AND r.i = 2 THEN true END AS is_free,
              CAST(NULL AS BOOLEAN) AS is_redistributable, CAST(NULL AS BOOLEAN) AS is_deprecated,
              row_number() OVER (ORDER BY short_name) AS license_id FROM last_one""",
)
ORACLE["dim_arch"] = clean_sql(
    "SELECT name, row_number() OVER (ORDER BY name) AS arch_id FROM (SELECT DISTINCT unnest(platforms) AS name FROM clean)"
)
_PEOPLE = """SELECT m_name AS name, m_email AS email, m_github AS github, min_by({'id': m_id}, o).id AS github_id FROM clean WHERE has_meta GROUP BY ALL"""
ORACLE["dim_maintainer"] = clean_sql(
    f"SELECT *, row_number() OVER (ORDER BY name, email, github) AS maintainer_id FROM ({_PEOPLE})"
)
ORACLE["bridge_license"] = merged_sql("SELECT DISTINCT package_id, unnest(licenses) AS short_name FROM merged")
ORACLE["bridge_arch"] = merged_sql("SELECT package_id, platform AS name FROM systems")
ORACLE["bridge_maintainer_exact"] = merged_sql("SELECT package_id, name, email, github FROM people")
ORACLE["bridge_maintainer_any"] = merged_sql(
    """SELECT DISTINCT p.package_id, m.name, m.email, m.github FROM people p JOIN (SELECT DISTINCT name, email, github FROM people) m
         ON (p.name = m.name AND p.name <> '') OR (p.email = m.email AND p.email <> '') OR (p.github = m.github AND p.github <> '')"""
)
ORACLE["variations"] = clean_sql(
    """SELECT package_id || '.' || system AS variation_id, package_id, system, arg_max(drv_path, o) AS drv_path, arg_max(outputs, o) AS outputs
       FROM clean WHERE attr_path <> '' GROUP BY package_id, system"""
)
_TABLE_TEXTS = "package_id, package_name, version, attribute_path, description"
ORACLE["package_table"] = merged_sql(
    f"""SELECT {_TABLE_TEXTS}, '' AS long_description,
               concat_ws(' ', package_name, nullif(description, ''), nullif(attribute_path, ''), nullif(main_program, '')) AS search_text,
               homepage, category, broken, unfree, available, insecure, unsupported, main_program, '' AS position,
               CASE WHEN outputs_to_install <> '' THEN '["out","dev"]' ELSE '' END AS outputs_to_install, '{D.RUN_TS}' AS last_updated FROM merged"""
)
# Links are distinct, and a document gets each maintainer's id from the lookup.
_DENORMALIZED = {
    **MERGED,
    "lookup": _PEOPLE,
    "doc_people": """SELECT package_id, string_agg(concat_ws('/', name, nullif(email, ''), nullif(github, ''), CAST(l.github_id AS VARCHAR)), '|'
                                                    ORDER BY name, nullif(email, '') NULLS FIRST, nullif(github, '') NULLS FIRST) AS maintainers
                     FROM people p JOIN lookup l USING (name, email, github) GROUP BY package_id""",
    "doc_licenses": """SELECT package_id, string_agg(short_name, '|' ORDER BY short_name) AS licenses, count(*) AS n
                       FROM (SELECT DISTINCT package_id, unnest(licenses) AS short_name FROM merged) GROUP BY package_id""",
}
ORACLE["denormalized"] = with_parts(
    _DENORMALIZED,
    """SELECT m.package_id, CASE WHEN d.n > 1 THEN 'array' ELSE '' END AS license_type, coalesce(d.licenses, '') AS licenses,
              coalesce(p.maintainers, '') AS maintainers, coalesce(m.platforms, '') AS platforms, m.outputs_to_install
       FROM merged m LEFT JOIN doc_people p USING (package_id) LEFT JOIN doc_licenses d USING (package_id)""",
)
ORACLE["refreshed_packages"] = ORACLE["package_table"]
ORACLE["refreshed_documents"] = ORACLE["denormalized"]
ORACLE["refresh_counts"] = clean_sql(
    """SELECT count(*) FILTER (kind = 1) AS changed, count(*) FILTER (kind = 2) AS removed, count(DISTINCT part) FILTER (kind > 0) AS touched,
              count(DISTINCT part) - count(DISTINCT part) FILTER (kind > 0) AS untouched
       FROM (SELECT package_id, max(CASE WHEN l_orderkey % 20011 IN (7, 9) THEN 1 ELSE 0 END) AS kind, left(md5(package_id), 1) AS part FROM clean GROUP BY package_id
             UNION ALL SELECT DISTINCT 'old-' || package_id, 2, left(md5('old-' || package_id), 1) FROM clean WHERE l_orderkey % 20011 = 11)"""
)
ORACLE["coverage"] = merged_sql(
    """SELECT count(*) AS packages, count(*) FILTER (WHERE len(licenses) > 0) AS with_license,
              count(*) FILTER (WHERE maintainers IS NOT NULL) AS with_maintainers,
              count(*) FILTER (WHERE platforms IS NOT NULL) AS with_platforms FROM merged"""
)
_RULES = [
    "primary key packages(package_id)",
    "primary key licenses(license_id)",
    "primary key architectures(arch_id)",
    "primary key maintainers(maintainer_id)",
    "primary key package_licenses(package_id, license_id)",
    "primary key package_architectures(package_id, arch_id)",
    "primary key package_maintainers(package_id, maintainer_id)",
    "primary key package_variations(variation_id)",
    "unique key licenses(short_name)",
    "unique key architectures(name)",
    "unique key maintainers(name, email, github)",
    "unique key package_variations(package_id, system)",
    "reference package_licenses.package_id",
    "reference package_licenses.license_id",
    "reference package_architectures.package_id",
    "reference package_architectures.arch_id",
    "reference package_maintainers.package_id",
    "reference package_maintainers.maintainer_id",
    "reference package_variations.package_id",
]
ORACLE["integrity"] = "SELECT rule, 0::BIGINT AS violations FROM (VALUES " + ", ".join(f"('{r}')" for r in _RULES) + ") v(rule)"

# --- documents --------------------------------------------------------------------------------------

ORACLE["node_documents"] = with_parts(
    {
        **PARTNERS,
        **REACH,
        **CLEAN,
        "last_one": """SELECT CAST(l_partkey AS VARCHAR) AS k, arg_max(attribute_path, o) AS attribute_path,
                              arg_max({'t': license_kind, 'l': licenses}, o) AS lic FROM clean GROUP BY l_partkey""",
        "counts": _COUNTS.format(more=_LISTS),
    },
    """SELECT 'p-' || k AS node_id, 'p-' || k AS id_in_doc, attribute_path, lic.t AS license_type,
              CASE WHEN lic.t = 'string' THEN lic.l[1] END AS license_value,
              dependency_count::INTEGER AS dependencies, total_dependency_count::INTEGER AS all_dependencies,
              dependent_count::INTEGER AS dependents, total_dependent_count::INTEGER AS all_dependents,
              CASE WHEN direct_dependencies = '' THEN '' ELSE 'p-' || replace(direct_dependencies, '|', '|p-') END AS direct,
              has_dependents, 'main' AS branch
       FROM last_one JOIN counts ON counts.node_id = k""",
    recursive=True,
)
ORACLE["index_slim"] = merged_sql(
    "SELECT package_name || '-' || version AS node_id, package_name, version, attribute_path, description, category, broken, unfree FROM merged"
)
ORACLE["store_documents"] = merged_sql(
    f"""SELECT package_id, package_name, version, description, homepage, category, broken, unfree, available,
               coalesce(platforms, '') AS platforms, outputs_to_install,
               CASE WHEN license_kind = 'object' THEN licenses[1] ELSE 'Unknown' END AS license_name, main_program, '{D.RUN_TS}' AS last_updated, false AS is_stub
        FROM merged"""
)
ORACLE["fetch_documents"] = """
    SELECT CAST(l.doc_id AS VARCHAR) AS id, coalesce(d.lang, '') AS category, true AS available, d.doc_id IS NULL AS is_stub
    FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT * FROM documents WHERE source <> 'src3') d USING (doc_id)"""
ORACLE["sample_docs"] = f"""
    SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents
    ORDER BY md5(concat('7:', doc_id)), CAST(doc_id AS VARCHAR) LIMIT {SAMPLE_SIZE}"""
ORACLE["storage_stats"] = """
    SELECT *, round((1 - stored_bytes / raw_bytes) * 100, 4) AS saving_percent FROM (
        SELECT count(*) AS total_documents, sum(strlen(text))::BIGINT AS raw_bytes, floor(sum(n_chars) / 4)::BIGINT AS stored_bytes FROM documents)"""
ORACLE["store_written"] = "SELECT count(*) AS total_documents, 0::BIGINT AS differing, 0::BIGINT AS stubs, true AS saves FROM documents"
ORACLE["output_check"] = """SELECT * FROM (VALUES ('tables_present', true), ('document_decodes', true), ('index_matches_store', true)) v("check", good)"""
ORACLE["write_counts"] = """
    SELECT count(*) FILTER (WHERE lang <> 'fr') AS stored, count(*) FILTER (WHERE lang <> 'fr') AS success,
           count(*) FILTER (WHERE lang IS NULL OR lang = 'fr') AS errors, count(*) AS total FROM documents"""
ORACLE["snapshot_written"] = with_parts(
    {"facts": D.VARIANT_FACTS}, "SELECT count(*) AS records, count(*) AS in_header, 0::BIGINT AS bad, true AS saves FROM facts"
)
ORACLE["catalog_written"] = merged_sql(
    """SELECT * FROM (
         SELECT 'primary key packages(package_id)' AS rule, count(*) FILTER (WHERE broken) AS violations FROM merged
         UNION ALL SELECT 'primary key licenses(license_id)', count(DISTINCT l) FROM (SELECT unnest(licenses) AS l FROM merged) WHERE l LIKE 'Brand#1%'
         UNION ALL SELECT 'unique key licenses(short_name)', count(DISTINCT l) FROM (SELECT unnest(licenses) AS l FROM merged) WHERE l LIKE 'Brand#1%'
         UNION ALL SELECT 'reference package_licenses.license_id', count(*) FROM merged WHERE list_contains(licenses, 'MIT'))
       WHERE violations > 0"""
)
ORACLE["roundtrip"] = "SELECT '' AS id, '' AS before, '' AS after WHERE false"
ORACLE["index_store_match"] = """
    SELECT count(*) AS index_rows, count(*) FILTER (WHERE lang <> 'fr') AS store_rows,
           count(*) FILTER (WHERE lang = 'fr') AS only_in_index, 0::BIGINT AS only_in_store FROM documents"""
ORACLE["stats_document"] = with_parts(
    {**GRAPH, "deg": _DEGREES}, "SELECT 'main' AS branch, count(*) AS total_packages, max(in_degree) AS max_dependents FROM deg"
)

# --- presentation and requests ----------------------------------------------------------------------

ORACLE["license_family"] = """
    SELECT p_partkey, CASE WHEN regexp_matches(a || ' ' || b, 'mit|bsd') THEN 'permissive' WHEN contains(a || ' ' || b, 'gpl') THEN 'copyleft'
                           WHEN contains(a || ' ' || b, 'apache') THEN 'apache' ELSE 'other' END AS family
    FROM (SELECT p_partkey, l[p_partkey % 6 + 1] AS a, l[p_size % 6 + 1] AS b
          FROM (SELECT *, ['mit', 'bsd-3', 'lgpl-2', 'apache-2.0', 'zlib', 'summit'] AS l FROM part))"""
ORACLE["license_display"] = """
    SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN p_brand ELSE 'Unknown' END AS name, p_partkey % 5 = 0 AS is_free FROM part"""
ORACLE["enriched_results"] = """
    SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN p_brand WHEN p_partkey % 5 = 2 THEN '' ELSE 'Unknown' END AS license_list,
           p_partkey % 5 IN (1, 2) AS unfree, CASE WHEN p_partkey % 2 = 0 THEN 'tools' ELSE 'misc' END AS category,
           p_partkey % 3 = 0 AS broken, 0::INTEGER AS n_maintainers,
           CASE WHEN p_partkey % 2 = 0 THEN concat('p', p_partkey) ELSE concat('other.p', p_partkey) END AS display_name FROM part"""
_PACKAGE = """concat('{"packageId":"p', p_partkey, '","packageName":', to_json(p_name), ',"version":"', p_size,
    '","description":', CASE WHEN p_size > 25 THEN to_json('A "' || p_type || '"') ELSE 'null' END, ',"homepage":', CASE WHEN p_size % 2 = 0 THEN to_json('https://e.org/' || p_partkey) ELSE 'null' END,
    ',"license":"', p_brand, '","attributePath":"pkgs.p', p_partkey, '","category":', CASE WHEN p_size % 3 = 0 THEN '"tools"' ELSE 'null' END,
    ',"broken":', l_returnflag = 'R', ',"unfree":', l_linenumber = 2, ',"available":true,"relevanceScore":', to_json(CAST(l_quantity AS INTEGER) / 4),
    CASE WHEN p_size % 5 = 0 THEN concat(',"maintainers":[{"name":"', p_brand, '"}]') END, CASE WHEN p_size % 7 = 0 THEN ',"platforms":["a-linux","b-linux"]' END,
    CASE WHEN p_size % 4 = 1 THEN ',"longDescription":"long"' END, CASE WHEN p_size % 4 = 2 THEN concat(',"mainProgram":"run-', p_partkey, '"') END,
    CASE WHEN p_size % 4 = 3 THEN ',"position":"f.nix:1"' END, CASE WHEN p_size % 6 = 0 THEN ',"outputsToInstall":["out"]' END,
    CASE WHEN p_size % 8 = 0 THEN ',"lastUpdated":"2024"' END, '}')"""
ORACLE["search_answers"] = f"""
    WITH hits AS (
        SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS total, {_PACKAGE} AS json
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 25),
    pages AS (SELECT l_orderkey, max(total) AS total, string_agg(json, ',' ORDER BY l_linenumber, json) AS list FROM hits WHERE l_linenumber <= 3 GROUP BY l_orderkey)
    SELECT o_orderkey AS request_id, concat('{{"message":"Search completed","query":', to_json(o_orderpriority), ',"total_count":', coalesce(total, 0),
           ',"query_time_ms":', to_json(o_orderkey % 40 / 4), ',"search_type":"fts","packages":[', coalesce(list, ''), ']}}') AS body
    FROM orders LEFT JOIN pages ON l_orderkey = o_orderkey"""
ORACLE["list_caps"] = """
    SELECT l_orderkey, coalesce(string_agg('s' || l_suppkey, '|' ORDER BY l_linenumber, l_suppkey) FILTER (i <= 3 AND l_linenumber % 3 <> 0), '') AS platforms,
           coalesce(string_agg('s' || l_suppkey, '|' ORDER BY l_linenumber, l_suppkey) FILTER (k <= 2 AND l_linenumber % 3 <> 1), '') AS maintainers
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS i,
                 count(*) FILTER (l_linenumber % 3 <> 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey ROWS UNBOUNDED PRECEDING) AS k FROM lineitem)
    GROUP BY l_orderkey"""
ORACLE["result_envelope"] = """
    SELECT concat('p', p_partkey) AS package_id,
           concat('{"packageId":"p', p_partkey, '","packageName":"', p_name, '","broken":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END,
                  CASE WHEN p_size > 20 THEN concat(',"mainProgram":"', p_brand, '"') ELSE '' END, '}') AS json FROM part"""
_ESTIMATE = r"greatest(length(text) // 4, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))"
ORACLE["exact_slots"] = f"""
    WITH RECURSIVE texts AS (SELECT doc_id, ({_ESTIMATE})::BIGINT AS tokens, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
    filled AS (
        SELECT doc_id, tokens, i, 0::BIGINT AS slot, 1 AS n, tokens AS used FROM texts WHERE i = 1
        UNION ALL
        SELECT t.doc_id, t.tokens, t.i, f.slot + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN 1 ELSE f.n + 1 END, CASE WHEN fresh THEN t.tokens ELSE f.used + t.tokens END
        FROM filled f JOIN texts t ON t.i = f.i + 1, LATERAL (SELECT f.n + 1 > 7 OR f.used + t.tokens > 4000 AS fresh))
    SELECT doc_id, tokens, slot FROM filled"""
ORACLE["token_estimate"] = f"SELECT doc_id, ({_ESTIMATE})::BIGINT AS tokens FROM documents"


def _rolling(key: str, tokens: str, requests: int, budget: int) -> str:
    return f"""
    SELECT event_id, n AS requests_in_minute, t::BIGINT AS tokens_in_minute, n > {requests} OR t > {budget} AS over_budget FROM (
        SELECT event_id, count(*) OVER w AS n, sum({tokens}) OVER w AS t FROM events
        WINDOW w AS (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW))"""


ORACLE["rolling_quota"] = _rolling("user_id", "floor(value * 100)", 1, 5000)
ORACLE["rolling_quota_by_type"] = _rolling("event_type", "floor(value)", 2, 60)
ORACLE["rolling_quota_banded"] = ORACLE["rolling_quota_by_type"]
ORACLE["batch_slots"] = f"""
    SELECT doc_id, cum_requests, cum_tokens, ((cum_requests * 300000 + cum_tokens * 600) // 180000000)::BIGINT AS slot FROM (
        SELECT doc_id, count(*) OVER w AS cum_requests, (sum({_ESTIMATE}) OVER w)::BIGINT AS cum_tokens
        FROM documents WINDOW w AS (ORDER BY doc_id))"""
