"""DuckDB SQL for the queries of the catalog, over views of the same tables."""

from __future__ import annotations

from graphloom.functions.strings import ESCAPES

LINES = """lines AS MATERIALIZED (SELECT l_orderkey AS query_id, l_returnflag AS flag, p_brand AS brand, p_name AS name,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INT) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)"""

INST = """inst AS MATERIALIZED (SELECT r.query_id, r.node_a, r.node_b, r.rel, x.label AS label_a, y.label AS label_b, x.given AS given_a, y.given AS given_b FROM arcs r
  JOIN nodes x ON r.query_id = x.query_id AND r.node_a = x.node JOIN nodes y ON r.query_id = y.query_id AND r.node_b = y.node),
feat AS MATERIALIZED (SELECT label_a, label_b, rel, count(*) AS n FROM inst GROUP BY ALL),
freq AS MATERIALIZED (SELECT label, count(DISTINCT query_id) AS n_queries FROM nodes WHERE label IS NOT NULL GROUP BY label),
adj AS MATERIALIZED (SELECT DISTINCT query_id, node_a AS node, given_a AS given, node_b AS other, rel, 'a' AS side, label_b AS olabel FROM inst
  UNION ALL SELECT DISTINCT query_id, node_b, given_b, node_a, rel, 'b', label_a FROM inst WHERE node_a <> node_b)"""

ORDERS = f"""{LINES},
nodes AS MATERIALIZED (SELECT o_orderkey AS query_id, 0 AS node, o_orderpriority AS label, false AS given FROM orders WHERE o_orderkey IN (SELECT query_id FROM lines)
  UNION ALL SELECT o_orderkey, 1, o_orderstatus, true FROM orders WHERE o_orderkey IN (SELECT query_id FROM lines)
  UNION ALL SELECT query_id, 2 * k, flag, false FROM lines UNION ALL SELECT query_id, 2 * k + 1, brand, true FROM lines),
arcs AS MATERIALIZED (SELECT query_id, 0 AS node_a, 1 AS node_b, 'prio_status' AS rel FROM nodes WHERE node = 0
  UNION ALL SELECT query_id, 2 * k, 0, 'flag_prio' FROM lines UNION ALL SELECT query_id, 2 * k, 2 * k + 1, 'flag_brand' FROM lines
  UNION ALL SELECT x.query_id, 2 * x.k, 2 * x.k + 2, 'next_flag' FROM lines x JOIN lines y ON x.query_id = y.query_id AND y.k = x.k + 1),
{INST},
fi AS MATERIALIZED (SELECT l.query_id, l.k AS factor_id, p.label AS l0, s.label AS l1, l.flag AS l2 FROM lines l
  JOIN nodes p ON p.query_id = l.query_id AND p.node = 0 JOIN nodes s ON s.query_id = l.query_id AND s.node = 1),
ffeat AS MATERIALIZED (SELECT list_sort([l0, l1, l2]) AS bag, count(*) AS n FROM fi GROUP BY 1),
fadj AS (SELECT query_id, 0 AS node, l1 AS x, l2 AS y FROM fi UNION ALL SELECT query_id, 2 * factor_id, l0, l1 FROM fi)"""

PARTS = f"""{LINES}, nodes AS MATERIALIZED (SELECT query_id, 2 * k AS node, name AS label, false AS given FROM lines UNION ALL SELECT query_id, 2 * k + 1, brand, true FROM lines)"""

SESSIONS = f"""e AS MATERIALIZED (SELECT user_id AS query_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events),
nodes AS MATERIALIZED (SELECT query_id, CAST(k AS INT) AS node, event_type AS label, k % 3 <> 0 AS given FROM e UNION ALL SELECT query_id, 0, event_type, false FROM e WHERE k = 1),
arcs AS MATERIALIZED (SELECT query_id, CAST(k AS INT) AS node_a, 0 AS node_b, 'in_session' AS rel FROM e UNION ALL SELECT query_id, k, k + 1, 'next' FROM e WHERE k + 1 <= c
  UNION ALL SELECT query_id, k, k + 2, 'skip' FROM e WHERE k + 2 <= c),
{INST}, deg AS MATERIALIZED (SELECT query_id, CAST(node AS INT) AS node, count(*) AS degree FROM adj GROUP BY 1, 2)"""

DIALOGS = f"""t AS MATERIALIZED (SELECT conv_id AS query_id, role, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 300 THEN 'middle' ELSE 'long' END AS size,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INT) AS k, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
nodes AS MATERIALIZED (SELECT query_id, 2 * k AS node, role AS label, false AS given FROM t UNION ALL SELECT query_id, 2 * k + 1, size, true FROM t),
arcs AS MATERIALIZED (SELECT query_id, 2 * k AS node_a, 2 * k + 1 AS node_b, 'length' AS rel FROM t UNION ALL SELECT query_id, 2 * k, 2 * k + 2, 'turn' FROM t WHERE k < c),
{INST}, deg AS MATERIALIZED (SELECT query_id, node, count(*) AS degree FROM adj GROUP BY 1, 2)"""

VALID = """CASE WHEN regexp_full_match(label, '[0-9]-.*') THEN false WHEN label = 'R' THEN false WHEN label = 'Brand#13' THEN true
  WHEN regexp_full_match(label, 'Brand#1.*') THEN false WHEN regexp_full_match(label, '.+') THEN true ELSE false END"""


def candidates(beam: int) -> str:
    """CTEs ca, cb and cand: ranked labels in context, and the distinct candidates of each node."""
    return f"""ca AS (SELECT label_b AS ctx, rel, label_a AS cand, n, row_number() OVER (PARTITION BY label_b, rel ORDER BY n DESC, label_a DESC) AS rn FROM feat),
cb AS (SELECT label_a AS ctx, rel, label_b AS cand, n, row_number() OVER (PARTITION BY label_a, rel ORDER BY n DESC, label_b DESC) AS rn FROM feat),
cand AS MATERIALIZED (SELECT DISTINCT query_id, node, cand FROM (
  SELECT j.query_id, j.node, x.cand FROM adj j JOIN ca x ON j.side = 'a' AND x.ctx = j.olabel AND x.rel = j.rel AND x.rn <= {beam} WHERE NOT j.given
  UNION ALL SELECT j.query_id, j.node, x.cand FROM adj j JOIN cb x ON j.side = 'b' AND x.ctx = j.olabel AND x.rel = j.rel AND x.rn <= {beam} WHERE NOT j.given))"""


def under(labels: str, weight: str = "coalesce(f.n, 0)", factors: bool = True) -> str:
    """A query (query_id, node, cand, score) over a CTE of labels."""
    pairs = f"""SELECT k.query_id, k.node, k.cand, sum({weight}) AS s FROM {labels} k JOIN adj j ON k.query_id = j.query_id AND k.node = j.node
      LEFT JOIN feat f ON f.rel = j.rel AND f.label_a = CASE WHEN j.side = 'a' THEN k.cand ELSE j.olabel END AND f.label_b = CASE WHEN j.side = 'a' THEN j.olabel ELSE k.cand END GROUP BY ALL"""
    if not factors:
        return f"SELECT query_id, node, cand, s AS score FROM ({pairs})"
    bags = f"""SELECT k.query_id, k.node, k.cand, sum(b.n) AS s FROM {labels} k JOIN fadj j ON k.query_id = j.query_id AND k.node = j.node JOIN ffeat b ON b.bag = list_sort([k.cand, j.x, j.y]) GROUP BY ALL"""
    return f"SELECT query_id, node, cand, CAST(sum(s) AS BIGINT) AS score FROM ({pairs} UNION ALL {bags}) GROUP BY ALL"


PRESENT = "present AS (SELECT query_id, node, label AS cand FROM nodes WHERE NOT given)"
SWEEP = f"""{ORDERS}, {candidates(64)}, {PRESENT},
offer AS MATERIALIZED (SELECT query_id, node, cand, max(kept) AS kept FROM (SELECT *, 0 AS kept FROM cand UNION ALL SELECT *, 1 FROM present) GROUP BY ALL),
sc AS ({under("offer")}),
best AS MATERIALIZED (SELECT o.query_id, o.node, o.cand AS label, coalesce(s.score, 0) AS score FROM offer o LEFT JOIN sc s USING (query_id, node, cand)
  QUALIFY row_number() OVER (PARTITION BY o.query_id, o.node ORDER BY coalesce(s.score, 0) DESC, kept DESC, o.cand ASC) = 1),
cmp AS MATERIALIZED (SELECT n.label AS expected, b.label AS predicted FROM nodes n LEFT JOIN best b USING (query_id, node) WHERE NOT n.given)"""

PL = f"""{ORDERS}, {candidates(16)},
cg AS MATERIALIZED (SELECT query_id, node, cand, count(*) AS times FROM (SELECT * FROM cand UNION ALL SELECT query_id, node, label FROM nodes WHERE NOT given) GROUP BY ALL),
sc AS ({under("cg", "CASE WHEN f.n IS NULL THEN 0.0 ELSE CAST(0.25 AS DOUBLE) END", factors=False)}),
ex AS (SELECT c.query_id, c.node, c.cand, times, times * exp(coalesce(s.score, 0) - max(coalesce(s.score, 0)) OVER (PARTITION BY c.query_id, c.node)) AS e FROM cg c LEFT JOIN sc s USING (query_id, node, cand)),
pr AS MATERIALIZED (SELECT *, e / sum(e) OVER (PARTITION BY query_id, node) AS p FROM ex)"""


def gradient(rate: str) -> str:
    return f"""grad AS (SELECT label_a, label_b, rel, sum(g) AS g FROM (
  SELECT CASE WHEN j.side = 'a' THEN k.cand ELSE j.olabel END AS label_a, CASE WHEN j.side = 'a' THEN j.olabel ELSE k.cand END AS label_b, j.rel, -{rate} * k.p AS g
    FROM pr k JOIN adj j ON k.query_id = j.query_id AND k.node = j.node
  UNION ALL SELECT label_a, label_b, rel, n * ({rate} * 16) FROM feat) GROUP BY ALL)"""


def pl_weights(weights: str, rate: str, made: str) -> str:
    """CTEs of a pseudo-likelihood pass: from the pair features in ``weights`` to those in ``made``.  No
    context has more labels than the beam, so which are candidates doesn't depend on the weights."""
    scored = f"""SELECT k.query_id, k.node, k.cand, sum(coalesce(f.w, 0)) AS score FROM cg k JOIN adj j ON k.query_id = j.query_id AND k.node = j.node
      LEFT JOIN {weights} f ON f.rel = j.rel AND f.label_a = CASE WHEN j.side = 'a' THEN k.cand ELSE j.olabel END AND f.label_b = CASE WHEN j.side = 'a' THEN j.olabel ELSE k.cand END GROUP BY ALL"""
    return f"""sc{made} AS ({scored}),
ex{made} AS (SELECT c.query_id, c.node, c.cand, times * exp(coalesce(s.score, 0) - max(coalesce(s.score, 0)) OVER (PARTITION BY c.query_id, c.node)) AS e FROM cg c LEFT JOIN sc{made} s USING (query_id, node, cand)),
pr{made} AS MATERIALIZED (SELECT *, e / sum(e) OVER (PARTITION BY query_id, node) AS p FROM ex{made}),
gr{made} AS (SELECT label_a, label_b, rel, sum(g) AS g FROM (
  SELECT CASE WHEN j.side = 'a' THEN k.cand ELSE j.olabel END AS label_a, CASE WHEN j.side = 'a' THEN j.olabel ELSE k.cand END AS label_b, j.rel, -{rate} * k.p AS g
    FROM pr{made} k JOIN adj j ON k.query_id = j.query_id AND k.node = j.node
  UNION ALL SELECT label_a, label_b, rel, n * ({rate} * 16) FROM feat) GROUP BY ALL),
{made} AS MATERIALIZED (SELECT label_a, label_b, rel, least(greatest(f.w + CASE WHEN abs(coalesce(g, 0)) > 1e-9 THEN g ELSE 0 END, 0), 0.5) AS w FROM {weights} f LEFT JOIN gr{made} USING (label_a, label_b, rel))"""


START = "(SELECT CAST(0.01 AS DOUBLE) / count(DISTINCT query_id) FROM nodes)"
TRAIN_PL = f"""WITH {ORDERS}, {candidates(16)},
cg AS MATERIALIZED (SELECT query_id, node, cand, count(*) AS times FROM (SELECT * FROM cand UNION ALL SELECT query_id, node, label FROM nodes WHERE NOT given) GROUP BY ALL),
w0 AS (SELECT label_a, label_b, rel, CAST(0.25 AS DOUBLE) AS w FROM feat),
{pl_weights("w0", START, "w1")}, {pl_weights("w1", f"({START} / sqrt(2))", "w2")} SELECT label_a, label_b, rel, round(w, 6) AS weight FROM w2"""


def round_of_moves(proposals: str, factors: bool = True, scopes: bool = False) -> str:
    """CTEs after prop (query_id, owner, changes) and ch (the same with each node and label): gains, each
    owner's best proposal, draws, and the query.  ``ties`` are the arcs, factors and scopes of nodes."""
    bag_gain = """UNION ALL SELECT query_id, owner, changes, coalesce(f.n, 0) - coalesce(o.n, 0) FROM (
    SELECT DISTINCT p.query_id, p.owner, p.changes, fi.factor_id, list_sort([coalesce(x.label, l0), l1, coalesce(y.label, l2)]) AS bag, list_sort([l0, l1, l2]) AS old FROM ch p
    JOIN fi ON fi.query_id = p.query_id AND p.node IN (0, 2 * fi.factor_id) LEFT JOIN ch x ON x.query_id = p.query_id AND x.owner = p.owner AND x.changes = p.changes AND x.node = 0
    LEFT JOIN ch y ON y.query_id = p.query_id AND y.owner = p.owner AND y.changes = p.changes AND y.node = 2 * fi.factor_id) LEFT JOIN ffeat f USING (bag) LEFT JOIN ffeat o ON o.bag = old"""
    bag_ties = """UNION ALL SELECT query_id, 0, 'factor', factor_id, factor_id FROM fi UNION ALL SELECT query_id, 2 * factor_id, 'factor', factor_id, factor_id FROM fi"""
    return f"""{proposals},
ch AS MATERIALIZED (SELECT query_id, owner, changes, CAST(string_split(c, '=')[1] AS INT) AS node, c[position('=' IN c) + 1:] AS label FROM (SELECT *, unnest(string_split(changes, '|')) AS c FROM prop)),
dist AS MATERIALIZED (SELECT DISTINCT query_id, node_a, node_b, rel, label_a, label_b FROM inst),
hit AS (SELECT DISTINCT p.query_id, p.owner, p.changes, d.* EXCLUDE (query_id) FROM ch p JOIN dist d ON d.query_id = p.query_id AND p.node = d.node_a
  UNION SELECT p.query_id, p.owner, p.changes, d.* EXCLUDE (query_id) FROM ch p JOIN dist d ON d.query_id = p.query_id AND p.node = d.node_b),
ga AS (SELECT h.query_id, h.owner, h.changes, coalesce(f.n, 0) - coalesce(o.n, 0) AS g FROM hit h LEFT JOIN ch x ON x.query_id = h.query_id AND x.owner = h.owner AND x.changes = h.changes AND x.node = h.node_a
  LEFT JOIN ch y ON y.query_id = h.query_id AND y.owner = h.owner AND y.changes = h.changes AND y.node = h.node_b
  LEFT JOIN feat f ON f.rel = h.rel AND f.label_a = coalesce(x.label, h.label_a) AND f.label_b = coalesce(y.label, h.label_b) LEFT JOIN feat o ON o.rel = h.rel AND o.label_a = h.label_a AND o.label_b = h.label_b
  {bag_gain if factors else ""}),
each_gain AS (SELECT query_id, owner, changes, CAST(sum(g) AS BIGINT) AS gain FROM ga GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM each_gain WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY query_id, owner ORDER BY gain DESC, changes) = 1),
ties AS (SELECT DISTINCT query_id, unnest([node_a, node_b]) AS node, 'arc' AS kind, least(node_a, node_b) AS x, greatest(node_a, node_b) AS y FROM arcs WHERE node_a <> node_b {bag_ties if factors else ""}),
claims AS (SELECT b.query_id, b.owner, t.kind, t.x, t.y, '' AS label FROM best b JOIN ch c USING (query_id, owner, changes) JOIN ties t ON t.query_id = c.query_id AND t.node = c.node
  UNION ALL SELECT b.query_id, b.owner, 'node', c.node, c.node, '' FROM best b JOIN ch c USING (query_id, owner, changes)
  {"UNION ALL SELECT b.query_id, b.owner, 'scope', 0, 0, c.label FROM best b JOIN ch c USING (query_id, owner, changes)" if scopes else ""}),
tops AS (SELECT query_id, owner, owner = arg_max(owner, md5('0:' || query_id || ':' || owner)) OVER (PARTITION BY query_id, kind, x, y, label) AS top FROM claims),
won AS (SELECT query_id, owner, bool_and(top) AS wins FROM tops GROUP BY ALL)
SELECT query_id, owner, changes, gain, wins FROM best JOIN won USING (query_id, owner)"""


NODE_PROPOSALS = "prop AS MATERIALIZED (SELECT c.query_id, CAST(c.node AS VARCHAR) AS owner, c.node || '=' || c.cand AS changes FROM cand c JOIN nodes n USING (query_id, node) WHERE c.cand IS DISTINCT FROM n.label)"
ARC_PROPOSALS = """deg AS (SELECT query_id, node, count(*) AS degree FROM adj GROUP BY ALL), low AS (SELECT n.query_id, n.node, n.label FROM nodes n JOIN deg USING (query_id, node) WHERE degree <= 32 AND NOT given),
rk AS (SELECT rel, label_a, label_b FROM feat QUALIFY row_number() OVER (PARTITION BY rel ORDER BY n DESC, label_a DESC, label_b DESC) <= 4),
pr AS (SELECT DISTINCT r.query_id, r.node_a, r.node_b, r.rel, k.label_a AS x, k.label_b AS y, a.label AS la, b.label AS lb FROM arcs r JOIN low a ON a.query_id = r.query_id AND a.node = r.node_a
  JOIN low b ON b.query_id = r.query_id AND b.node = r.node_b JOIN rk k ON k.rel = r.rel WHERE r.node_a <> r.node_b AND (k.label_a <> a.label OR k.label_b <> b.label)),
prop AS MATERIALIZED (SELECT query_id, node_a || '-' || node_b || '-' || rel AS owner, CASE WHEN x = la THEN node_b || '=' || y WHEN y = lb THEN node_a || '=' || x
  WHEN node_a < node_b THEN node_a || '=' || x || '|' || node_b || '=' || y ELSE node_b || '=' || y || '|' || node_a || '=' || x END AS changes FROM pr)"""
FACTOR_PROPOSALS = """asked AS (SELECT DISTINCT l1 FROM fi), fc AS (SELECT l1, bag FROM asked JOIN ffeat ON list_contains(bag, l1) QUALIFY row_number() OVER (PARTITION BY l1 ORDER BY n DESC, bag ASC) <= 8),
rest AS (SELECT query_id, factor_id, l0, l2, list_concat(bag[:list_position(bag, l1) - 1], bag[list_position(bag, l1) + 1:]) AS r FROM fi JOIN fc USING (l1)),
laid AS (SELECT query_id, factor_id, l0, l2, r[1] AS x, r[2] AS y FROM rest UNION SELECT query_id, factor_id, l0, l2, r[2], r[1] FROM rest),
prop AS MATERIALIZED (SELECT DISTINCT query_id, 'f' || factor_id AS owner, CASE WHEN x = l0 THEN 2 * factor_id || '=' || y WHEN y = l2 THEN '0=' || x ELSE '0=' || x || '|' || 2 * factor_id || '=' || y END AS changes
  FROM laid WHERE x <> l0 OR y <> l2)"""
SWAPS = f"""WITH {PARTS},
arcs AS MATERIALIZED (SELECT query_id, 2 * k AS node_a, 2 * k + 1 AS node_b, 'name_brand' AS rel FROM lines), {INST}, {candidates(8)},
c AS (SELECT c.query_id, c.node, c.cand, n.label FROM cand c JOIN nodes n USING (query_id, node) WHERE c.cand IS DISTINCT FROM n.label),
held AS MATERIALIZED (SELECT query_id, node AS holder, label FROM nodes WHERE NOT given),
cl AS (SELECT c.query_id, c.node, c.cand, c.label, count(h.holder) AS n, min(h.holder) AS holder FROM c LEFT JOIN held h ON h.query_id = c.query_id AND h.label = c.cand AND h.holder <> c.node GROUP BY ALL),
bad AS (SELECT DISTINCT cl.query_id, cl.node, cl.cand FROM cl JOIN held h ON h.query_id = cl.query_id AND h.label = cl.label AND h.holder <> cl.node AND h.holder <> cl.holder WHERE n = 1),
prop AS MATERIALIZED (SELECT query_id, CAST(node AS VARCHAR) AS owner, CASE WHEN n = 0 THEN node || '=' || cand WHEN node < holder THEN node || '=' || cand || '|' || holder || '=' || label
  ELSE holder || '=' || label || '|' || node || '=' || cand END AS changes FROM cl ANTI JOIN bad USING (query_id, node, cand) WHERE n <= 1)"""
LAYERS = f"""WITH {SESSIONS}, u AS MATERIALIZED (SELECT DISTINCT * FROM arcs), rest AS MATERIALIZED (SELECT query_id, node FROM nodes WHERE NOT given), done AS (SELECT query_id, node FROM nodes WHERE given),
b AS MATERIALIZED (SELECT query_id, node_a AS node, node_b AS other FROM u WHERE node_a <> node_b UNION ALL SELECT query_id, node_b, node_a FROM u WHERE node_a <> node_b),
one AS MATERIALIZED (SELECT query_id, node FROM (SELECT b.query_id, b.node, count(*) AS n FROM b SEMI JOIN rest r ON r.query_id = b.query_id AND r.node = b.node SEMI JOIN done d ON d.query_id = b.query_id AND d.node = b.other GROUP BY ALL)
  QUALIFY n = max(n) OVER (PARTITION BY query_id)),
left_over AS (SELECT query_id, node FROM rest ANTI JOIN one USING (query_id, node)), more AS (SELECT * FROM done UNION ALL SELECT * FROM one),
two AS (SELECT query_id, node FROM (SELECT b.query_id, b.node, count(*) AS n FROM b SEMI JOIN left_over r ON r.query_id = b.query_id AND r.node = b.node SEMI JOIN more d ON d.query_id = b.query_id AND d.node = b.other GROUP BY ALL)
  QUALIFY n = max(n) OVER (PARTITION BY query_id))
SELECT query_id, CAST(node AS INT) AS node, 1 AS layer FROM one UNION ALL SELECT query_id, CAST(node AS INT), 2 FROM two"""


def escaped(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'" if s not in "\n\r\t" else f"chr({ord(s)})"
    for c, e in ESCAPES.items():
        text = f"replace({text}, {quote(c)}, {quote(chr(92) + e)})"
    return text


SQL: dict[str, str] = {
    "pair_feature_counts": f"WITH {ORDERS} SELECT * FROM feat",
    "factor_feature_counts": f"WITH {ORDERS} SELECT array_to_string(bag, '|') AS labels, n FROM ffeat",
    "label_frequency": f"WITH {ORDERS} SELECT * FROM freq",
    "rare_label_collapse": f"""WITH {ORDERS}, cut AS (SELECT floor(quantile_cont(n_queries, 0.5)) AS c FROM freq), known AS (SELECT label FROM freq, cut WHERE n_queries >= c),
        m AS (SELECT CASE WHEN label_a IN (SELECT label FROM known) THEN label_a ELSE '<unknown>' END AS label_a, CASE WHEN label_b IN (SELECT label FROM known) THEN label_b ELSE '<unknown>' END AS label_b, rel, n FROM feat)
        SELECT label_a, label_b, rel, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL""",
    "unknown_labels": f"""WITH {PARTS}, freq AS (SELECT label, count(DISTINCT query_id) AS c FROM nodes GROUP BY label), seen AS (SELECT label FROM freq WHERE c > (SELECT floor(quantile_cont(c, 0.5)) FROM freq))
        SELECT CASE WHEN label IN (SELECT label FROM seen) THEN label ELSE '<unknown>' END AS label, count(*) AS n FROM nodes WHERE NOT given GROUP BY 1""",
    "valid_labels": f"WITH {ORDERS} SELECT label, {VALID} AS valid FROM freq",
    "dictionary": f"WITH {ORDERS}, l AS (SELECT label FROM nodes UNION SELECT rel FROM arcs) SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM l",
    "growing_dictionary": f"""WITH {ORDERS}, a AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM nodes)),
        b AS (SELECT rel AS label FROM arcs UNION SELECT name FROM lines UNION SELECT brand FROM lines), c AS (SELECT label FROM b WHERE label NOT IN (SELECT label FROM a))
        SELECT * FROM a UNION ALL SELECT label, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY label) - 1 FROM c""",
    "candidates_by_b": f"WITH {ORDERS}, {candidates(4)} SELECT * FROM ca WHERE rn <= 4",
    "candidates_by_a": f"WITH {ORDERS}, {candidates(4)} SELECT * FROM cb WHERE rn <= 4",
    "candidates_by_rel": f"WITH {ORDERS} SELECT rel, label_a, label_b, n, row_number() OVER (PARTITION BY rel ORDER BY n DESC, label_a DESC, label_b DESC) AS rn FROM feat QUALIFY rn <= 8",
    "factor_candidates": f"""WITH {ORDERS}, a AS (SELECT DISTINCT l1 FROM fi), c AS (SELECT l1, bag, n, row_number() OVER (PARTITION BY l1 ORDER BY n DESC, bag ASC) AS rn FROM a JOIN ffeat ON list_contains(bag, l1))
        SELECT query_id, factor_id, array_to_string(bag, '|') AS labels, n, rn FROM fi JOIN c USING (l1) WHERE rn <= 3""",
    "total_score": f"WITH {ORDERS} SELECT query_id, CAST(sum(n) AS BIGINT) AS score FROM inst JOIN feat USING (label_a, label_b, rel) GROUP BY query_id",
    "pair_score": f"WITH {ORDERS} SELECT query_id, least(node_a, node_b) AS low, greatest(node_a, node_b) AS high, CAST(sum(n) AS BIGINT) AS score FROM inst JOIN feat USING (label_a, label_b, rel) GROUP BY ALL",
    "node_score": f"WITH {ORDERS}, {PRESENT}, sc AS ({under('present')}) SELECT p.query_id, p.node, coalesce(score, 0) AS score FROM present p LEFT JOIN sc USING (query_id, node)",
    "nbest": f"WITH {ORDERS}, {candidates(64)}, sc AS ({under('cand')}) SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, cand DESC) AS rank FROM sc QUALIFY rank <= 3",
    "nbest_valid": f"""WITH {ORDERS}, {candidates(64)}, ok AS (SELECT c.* FROM cand c JOIN freq f ON f.label = c.cand WHERE {VALID}), sc AS ({under("ok")})
        SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, cand DESC) = 1""",
    "node_degree": f"WITH {SESSIONS} SELECT * FROM deg",
    "arc_pass_eligible": f"""WITH {ORDERS}, deg AS MATERIALIZED (SELECT query_id, node, count(*) AS degree FROM adj GROUP BY ALL)
        SELECT i.query_id, node_a, node_b, rel FROM inst i JOIN deg x ON x.query_id = i.query_id AND x.node = node_a JOIN deg y ON y.query_id = i.query_id AND y.node = node_b
        WHERE NOT given_a AND NOT given_b AND node_a <> node_b AND x.degree <= 5 AND y.degree <= 5""",
    "known_relation_degree": f"""WITH {SESSIONS}, rels AS (SELECT DISTINCT rel FROM inst WHERE given_a AND given_b)
        SELECT query_id, CAST(node AS INT) AS node, count(*) AS degree FROM adj WHERE rel IN (SELECT rel FROM rels) GROUP BY 1, 2""",
    "histogram_degree": f"WITH {SESSIONS}, h AS (SELECT CAST(least(degree, 32) AS BIGINT) AS bucket, count(*) AS n FROM deg GROUP BY 1) SELECT bucket, n, round(n / sum(n) OVER (), 6) AS share FROM h",
    "scope_conflicts": f"WITH {LINES} SELECT DISTINCT x.query_id, 2 * x.k AS node, 2 * y.k AS other FROM lines x JOIN lines y ON x.query_id = y.query_id AND x.name = y.name AND x.k <> y.k",
    "unique_conflict_node": f"""WITH {LINES}, c AS (SELECT DISTINCT x.query_id, 2 * x.k AS node, 2 * y.k AS other FROM lines x JOIN lines y ON x.query_id = y.query_id AND x.name = y.name AND x.k <> y.k)
        SELECT query_id, node, CAST(CASE WHEN count(*) = 1 THEN min(other) ELSE -1 END AS INT) AS other FROM c GROUP BY query_id, node""",
    "confusion_stats": f"""WITH {DIALOGS}, seen AS (SELECT query_id, node_a AS node, '<X>|' || label_b || '|' || rel AS arc FROM inst UNION SELECT query_id, node_b, label_a || '|<X>|' || rel FROM inst),
        sig AS (SELECT query_id, node, string_agg(arc, ';' ORDER BY arc) AS s FROM seen GROUP BY ALL),
        o AS (SELECT n.query_id, coalesce(s, '') AS s, n.label FROM nodes n LEFT JOIN sig USING (query_id, node) WHERE NOT given),
        g AS (SELECT query_id, s, sum(c) AS n, count(*) AS labels, max(c) AS most FROM (SELECT query_id, s, label, count(*) AS c FROM o GROUP BY ALL) GROUP BY ALL)
        SELECT CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(CASE WHEN labels > 1 THEN n ELSE 0 END) AS BIGINT) AS confusable, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS alike, CAST(sum(most) AS BIGINT) AS best_correct FROM g""",
    "showgraph_nodes": f"""WITH {DIALOGS} SELECT query_id, n.node AS id, coalesce(label, '-1') AS label, CASE WHEN given THEN '#96816a' ELSE '#6c9ba4' END AS color
        FROM nodes n LEFT JOIN deg USING (query_id, node) WHERE NOT given OR degree > 0""",
    "showgraph_edges": f"""WITH {DIALOGS}, p AS (SELECT query_id, least(node_a, node_b) AS source, greatest(node_a, node_b) AS target, rel, n FROM inst JOIN feat USING (label_a, label_b, rel)),
        s AS (SELECT query_id, source, target, CAST(sum(n) AS DOUBLE) AS score FROM p GROUP BY ALL)
        SELECT query_id, source, target, string_agg(rel || ' - ' || printf('%.2f', score), ', ' ORDER BY rel) AS label FROM p JOIN s USING (query_id, source, target) GROUP BY ALL""",
    "model_top_labels": f"""WITH {ORDERS}, best AS (SELECT label FROM freq ORDER BY n_queries DESC, label DESC LIMIT 96), o AS (SELECT label_a AS label, rel, label_b AS partner, n FROM feat WHERE label_a IN (SELECT label FROM best)),
        t AS (SELECT label, rel, CAST(sum(n) AS BIGINT) AS total FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY total DESC, rel DESC) AS rel_rank FROM t QUALIFY rel_rank <= 3)
        SELECT label, rel, partner, n, total, rel_rank, row_number() OVER (PARTITION BY label, rel ORDER BY n DESC, partner DESC) AS partner_rank FROM o JOIN r USING (label, rel) QUALIFY partner_rank <= 3""",
    "kfold_assignment": f"WITH {LINES} SELECT query_id, row_number() OVER (ORDER BY query_id) % 5 AS fold FROM (SELECT DISTINCT query_id FROM lines)",
    "reshuffled_passes": f"""WITH {LINES} SELECT query_id, CAST(pass AS INT) AS pass, row_number() OVER (PARTITION BY pass ORDER BY md5('1:' || pass || ':' || query_id)) AS position
        FROM (SELECT DISTINCT query_id FROM lines), (SELECT unnest([1, 2]) AS pass)""",
    "fold_models": f"""WITH {ORDERS}, ids AS (SELECT query_id, row_number() OVER (ORDER BY query_id) % 5 AS fold FROM (SELECT DISTINCT query_id FROM nodes)), k AS (SELECT unnest(range(0, 5)) AS fold),
        r AS (SELECT k.fold, label_a, label_b, rel, count(*) AS n FROM inst JOIN ids USING (query_id) JOIN k ON k.fold <> ids.fold GROUP BY ALL)
        SELECT fold, label_b AS ctx, rel, label_a AS cand, n, row_number() OVER (PARTITION BY fold, label_b, rel ORDER BY n DESC, label_a DESC) AS rn FROM r QUALIFY rn <= 4""",
    "maintained_candidates": f"""WITH {ORDERS}, r AS (SELECT label_a, label_b, rel, count(*) AS n FROM inst WHERE query_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL)
        SELECT label_b AS ctx, rel, label_a AS cand, n, row_number() OVER (PARTITION BY label_b, rel ORDER BY n DESC, label_a DESC) AS rn FROM r QUALIFY rn <= 4""",
    "pl_partition_function": f"WITH {PL} SELECT query_id, node, CAST(sum(times) AS BIGINT) AS n, round(max(p), 6) AS top_p FROM pr GROUP BY ALL",
    "pl_gradient_pass1": f"WITH {PL}, {gradient('CAST(0.1 AS DOUBLE)')} SELECT label_a, label_b, rel, round(g, 4) AS g FROM grad",
    "pl_weights_after_pass1": f"""WITH {PL}, {gradient("(SELECT CAST(0.01 AS DOUBLE) / count(DISTINCT query_id) FROM nodes)")}
        SELECT label_a, label_b, rel, round(least(greatest(0.25 + CASE WHEN abs(coalesce(g, 0)) > 1e-9 THEN g ELSE 0 END, 0), 0.5), 6) AS weight FROM feat LEFT JOIN grad USING (label_a, label_b, rel)""",
    "train_pl": TRAIN_PL,
    "one_sweep_argmax": f"WITH {SWEEP} SELECT * FROM best",
    "precision_stats": f"""WITH {SWEEP}, c AS (SELECT count(*) FILTER (WHERE expected = predicted) AS correct, count(*) FILTER (WHERE expected IS DISTINCT FROM predicted) AS incorrect, count(predicted) AS known FROM cmp)
        SELECT correct, incorrect, known, round(incorrect / (correct + incorrect), 6) AS error_rate, round(known / (correct + incorrect), 6) AS recall FROM c""",
    "label_error_report": f"""WITH {SWEEP}, e AS (SELECT coalesce(expected, '[none]') || ' -> ' || coalesce(predicted, '[none]') AS what, count(*) AS n FROM cmp WHERE expected IS DISTINCT FROM predicted GROUP BY 1)
        SELECT printf('%8d : %s', n, what) AS value FROM (SELECT * FROM e ORDER BY n DESC, what DESC LIMIT 32)""",
    "node_moves_round": f"WITH {ORDERS}, {candidates(64)}, {round_of_moves(NODE_PROPOSALS)}",
    "arc_moves_round": f"WITH {ORDERS}, {round_of_moves(ARC_PROPOSALS)}",
    "factor_moves_round": f"WITH {ORDERS}, {round_of_moves(FACTOR_PROPOSALS)}",
    "swap_moves_round": round_of_moves(SWAPS, factors=False, scopes=True),
    "greedy_layers": LAYERS,
    "json_round_trip": f"WITH {DIALOGS} SELECT * FROM feat",
    "string_functions": f"""WITH t AS (SELECT p_partkey, ' ' || chr(9) || p_name || ' | a,b;c\\d ' || chr(10) AS s, CAST(p_size * 17 AS VARCHAR) AS size FROM part), u AS (SELECT *, trim(s, ' ' || chr(10) || chr(13) || chr(9)) AS trimmed FROM t)
        SELECT p_partkey, trimmed, CASE WHEN length(trimmed) > 12 THEN trimmed[1:9] || '...' ELSE trimmed END AS short, {escaped("s")} AS escaped, true AS same, len(string_split(s, ' ')) AS parts,
        regexp_extract(s, '^([^,;|]*)[,;|]', 1) AS before, regexp_extract(s, '[,;|]') AS sep, CAST('0x' || size AS BIGINT) AS hex, CAST(size AS BIGINT) AS dec, size || '-' || p_partkey AS joined FROM u""",
    "rpc_dispatch": """WITH m AS (SELECT event_id, event_id % 7 = 0 AS broken, ['infer', 'nbest', 'showgraph', 'drop'][event_id % 4 + 1] AS method FROM events)
        SELECT event_id AS request_id, CASE WHEN NOT broken THEN CAST(event_id AS VARCHAR) END AS id, CASE WHEN NOT broken THEN method END AS method,
        CAST(CASE WHEN broken THEN -32700 WHEN method = 'drop' THEN -32601 WHEN method = 'nbest' AND event_id % 5 = 0 THEN -32602 ELSE 0 END AS BIGINT) AS code FROM m""",
}
