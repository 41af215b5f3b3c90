"""The ratio of matching blocks and the best order of pieces in SQL, for texts of under 200 characters."""

from __future__ import annotations


def ratio_sql(pairs: str, name: str = "ratio") -> str:
    """CTEs that end in ``name`` (a, b, r) for the rows (a, b) of ``pairs``; they need WITH RECURSIVE.

    ``run`` has the length of the common run that starts at each pair of equal
    characters. A part of both texts is cut by its longest run, and what lies
    before and after it are parts, too.
    """
    inside = f"{name}_run r ON r.id = p.id AND i >= alo AND i < ahi AND j >= blo AND j < bhi"
    length = "least(l, ahi - i, bhi - j)"
    return f"""{name}_text AS MATERIALIZED (SELECT a, b, row_number() OVER (ORDER BY a, b) AS id FROM (SELECT DISTINCT a, b FROM {pairs})),
{name}_a AS (SELECT id, i, substr(a, i, 1) AS c FROM (SELECT id, a, unnest(range(1, length(a) + 1)) AS i FROM {name}_text)),
{name}_b AS (SELECT id, j, substr(b, j, 1) AS c FROM (SELECT id, b, unnest(range(1, length(b) + 1)) AS j FROM {name}_text)),
{name}_island AS (SELECT id, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM {name}_a JOIN {name}_b USING (id, c)),
{name}_run AS MATERIALIZED (SELECT id, i, j, max(i) OVER (PARTITION BY id, i - j, g) - i + 1 AS l FROM {name}_island),
{name}_part AS (
  SELECT id, CAST(1 AS BIGINT) AS alo, length(a) + 1 AS ahi, CAST(1 AS BIGINT) AS blo, length(b) + 1 AS bhi FROM {name}_text
  UNION ALL
  SELECT id, CASE WHEN s = 0 THEN alo ELSE m.k - m.i END, CASE WHEN s = 0 THEN -m.i ELSE ahi END, CASE WHEN s = 0 THEN blo ELSE m.k - m.j END, CASE WHEN s = 0 THEN -m.j ELSE bhi END
  FROM (SELECT p.id, alo, ahi, blo, bhi, max({{'k': {length}, 'i': -i, 'j': -j}}) AS m FROM {name}_part p JOIN {inside} GROUP BY ALL), (SELECT unnest([0, 1]) AS s)),
{name}_sum AS (SELECT id, sum(k) AS k FROM (SELECT p.id, alo, ahi, blo, bhi, max({length}) AS k FROM {name}_part p JOIN {inside} GROUP BY ALL) GROUP BY id),
{name} AS MATERIALIZED (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE CAST(2 * coalesce(k, 0) AS DOUBLE) / (length(a) + length(b)) END AS r FROM {name}_text LEFT JOIN {name}_sum USING (id))"""


def best_order_sql(groups: str, name: str = "best") -> str:
    """CTEs that end in ``name`` (target, pieces, joined, score) for the rows (target, pieces) of ``groups``; pieces are not empty."""
    return f"""{name}_group AS MATERIALIZED (SELECT DISTINCT target, pieces FROM {groups}),
{name}_order AS (
  SELECT target, pieces, CAST([] AS BIGINT[]) AS used, '' AS joined FROM {name}_group WHERE len(pieces) <= 6
  UNION ALL
  SELECT target, pieces, list_append(used, k), joined || pieces[k] FROM {name}_order, range(1, 7) t(k) WHERE k <= len(pieces) AND NOT list_contains(used, k)),
{name}_tried AS MATERIALIZED (
  SELECT target, pieces, used, joined FROM {name}_order WHERE len(used) = len(pieces) AND len(pieces) > 0
  UNION ALL SELECT target, pieces, CAST([1] AS BIGINT[]), array_to_string(pieces, '') FROM {name}_group WHERE len(pieces) > 6),
{name}_pair AS (SELECT target AS a, joined AS b FROM {name}_tried),
{ratio_sql(f"{name}_pair", f"{name}_ratio")},
{name} AS MATERIALIZED (
  SELECT g.target, g.pieces, coalesce(t.joined, '') AS joined, coalesce(t.r, 0.0) AS score FROM {name}_group g LEFT JOIN (
    SELECT target, pieces, joined, r, row_number() OVER (PARTITION BY target, pieces ORDER BY r DESC, used) AS place FROM {name}_tried t JOIN {name}_ratio x ON x.a = t.target AND x.b = t.joined) t
  ON t.target = g.target AND t.pieces = g.pieces AND place = 1)"""


#: A text without white space, punctuation and symbols; the given names have no compatibility characters.
CORE = r"regexp_replace({}, '[\s\p{{P}}\p{{S}}]', '', 'g')"
SIMILARITY_SQL = f"""WITH RECURSIVE n AS (
  SELECT a.p_partkey, {CORE.format("a.p_name")} AS x, {CORE.format("b.p_name")} AS y, regexp_replace(a.p_name, '\\s+', '', 'g') AS s, regexp_replace(b.p_name, '\\s+', '', 'g') AS t,
    list_filter(string_split(b.p_name, ' '), lambda p: p <> '') AS pieces FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
pairs AS (SELECT x AS a, y AS b FROM n UNION ALL SELECT s, t FROM n), groups AS (SELECT x AS target, pieces FROM n),
{ratio_sql("pairs")}, {best_order_sql("groups")}
SELECT p_partkey, x, round(c.r, 6) AS similarity, round(CASE WHEN s = '' AND t = '' THEN 1 WHEN s = '' OR t = '' THEN 0 ELSE g.r END, 6) AS guarded, joined, round(score, 6) AS score
FROM n JOIN ratio c ON c.a = x AND c.b = y JOIN ratio g ON g.a = s AND g.b = t JOIN best ON target = x AND best.pieces = n.pieces"""


def components_sql(pair_sql: str, overlaps: str) -> str:
    """CTEs that end in ``classed`` (page_id, root, a_ids, b_ids, category, similarity) of the overlap components; ``overlaps`` is the condition on a pair."""
    contains = "({0} <> '' AND {1} <> '' AND (contains({0}, {1}) OR contains({1}, {0})))"
    return f"""{pair_sql}, e AS (SELECT page_id, t_region_id AS a, b_region_id AS b FROM pair WHERE {overlaps}),
s AS (SELECT page_id, a, b FROM e UNION ALL SELECT page_id, b, a FROM e),
reach AS (SELECT DISTINCT page_id, a AS node, a AS root FROM s UNION SELECT s.page_id, s.b, r.root FROM reach r JOIN s ON s.a = r.node),
lab AS MATERIALIZED (SELECT page_id, node, min(root) AS root FROM reach GROUP BY ALL),
member AS (SELECT l.page_id, root, node, r.cls = 'text' AS first, {CORE.format("p_name")} AS core FROM lab l JOIN region r ON r.region_id = l.node JOIN part ON p_partkey = part_key),
comp AS MATERIALIZED (
  SELECT page_id, root, coalesce(list(core ORDER BY node) FILTER (first), []) AS a, coalesce(list(core ORDER BY node) FILTER (NOT first), []) AS b,
    coalesce(list(node ORDER BY node) FILTER (first), []) AS a_ids, coalesce(list(node ORDER BY node) FILTER (NOT first), []) AS b_ids FROM member GROUP BY page_id, root),
shape AS MATERIALIZED (
  SELECT *, len(a) = 1 AND len(b) = 1 AS one, len(a) = 1 AND len(b) > 1 OR len(a) > 1 AND len(b) = 1 AS many,
    CASE WHEN len(a) = 1 AND len(b) > 1 THEN a[1] WHEN len(a) > 1 AND len(b) = 1 THEN b[1] ELSE '' END AS target,
    list_filter(CASE WHEN len(a) = 1 AND len(b) > 1 THEN b WHEN len(a) > 1 AND len(b) = 1 THEN a ELSE [] END, lambda p: p <> '') AS pieces FROM comp),
pairs AS (SELECT a[1] AS a, b[1] AS b FROM shape WHERE one), groups AS (SELECT target, pieces FROM shape WHERE many),
{ratio_sql("pairs")}, {best_order_sql("groups")},
scored AS (
  SELECT page_id, root, a_ids, b_ids, one, many, shape.a[1] AS a_core, shape.b[1] AS b_core, shape.target, CASE WHEN one THEN shape.b[1] ELSE coalesce(joined, '') END AS joined,
    CASE WHEN one THEN r WHEN many THEN score ELSE 0.0 END AS near
  FROM shape LEFT JOIN ratio ON one AND ratio.a = shape.a[1] AND ratio.b = shape.b[1] LEFT JOIN best ON many AND best.target = shape.target AND best.pieces = shape.pieces),
named AS (
  SELECT *, CASE WHEN one AND a_core <> '' AND a_core = b_core THEN 'exact_duplicate' WHEN one AND near >= 0.85 THEN 'near_duplicate' WHEN one AND {contains.format("a_core", "b_core")} THEN 'partial_overlap'
    WHEN one THEN 'different_overlap' WHEN many AND joined <> '' AND joined = target THEN 'group_duplicate' WHEN many AND near >= 0.85 THEN 'near_group_duplicate'
    WHEN many AND {contains.format("joined", "target")} THEN 'partial_overlap' WHEN many THEN 'complex_overlap' ELSE 'many_to_many' END AS category FROM scored),
classed AS MATERIALIZED (SELECT page_id, root, a_ids, b_ids, category, CASE WHEN category IN ('exact_duplicate', 'group_duplicate') THEN 1.0 ELSE near END AS similarity FROM named)"""
