"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from graphloom.llm.license_scan import scan_sql

WORDS = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def shingles(words: str, k: int) -> str:
    """Distinct shingles of a list of words; a shorter non-empty list is one."""
    return f"list_distinct(CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {k} THEN [array_to_string({words}, ' ')] ELSE list_transform(range(1, len({words}) - {k - 2}), lambda j: array_to_string({words}[j:j + {k - 1}], ' ')) END)"


OP4 = f"""
WITH c AS (SELECT doc_id, source, lang, len({WORDS.format("coalesce(text, '')")}) AS words, strlen(coalesce(text, '')) AS bytes FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, source, lang, 'words_v1' AS tokenizer, words AS n FROM c UNION ALL SELECT doc_id, source, lang, 'bytes_v1', bytes FROM c),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, tokenizer ORDER BY n DESC, source DESC NULLS LAST, lang DESC NULLS LAST) = 1)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM o WHERE n > 0 GROUP BY source, lang, tokenizer"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, {shingles("w", 4)} AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * c >= 85 * (na + nb - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id"""

OP10 = f"""
WITH i AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
d AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
q AS MATERIALIZED (SELECT item_id, k, len(s) AS n, unnest(s) AS g FROM (SELECT item_id, least(5, len(w)) AS k, {shingles("w", 5)} AS s FROM i)),
x AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')))) AS g FROM d JOIN (SELECT DISTINCT k FROM q) ON len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item FROM x JOIN q ON x.g = q.g AND x.k = q.k GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item, n_shared / n_item AS containment FROM c WHERE 100 * n_shared >= 80 * n_item"""

OP13 = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

SQL: dict[str, str] = {
    "rollup_words_and_bytes": OP4,
    "op6_ngram_jaccard_join": OP6,
    "op7_license_scans": scan_sql(),
    "op10_benchmark_decontamination": OP10,
    "op13_hard_negative_mining": OP13,
}
