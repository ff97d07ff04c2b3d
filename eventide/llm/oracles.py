"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from eventide.llm.secret_scan import BASE, RULES, Rule

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_rows(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
  regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS vs,
  string_split_regex(t, '{pattern}') AS gs FROM d"""


def secrets_sql() -> str:
    """Matches and the gaps between them alternate; sums of their lengths are the places."""
    counts = ",\n  ".join(f"count(*) FILTER (WHERE kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_rule_rows(i, r) for i, r in enumerate(RULES))}),
p AS (SELECT *, list_sum(list_transform(gs[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
o AS (SELECT doc_id, rank, kind, s::BIGINT AS s, (s + length(ms[i]))::BIGINT AS e FROM p WHERE length(vs[i]) >= least),
c AS (SELECT doc_id, {counts},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM o GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (doc_id)"""


_COMPONENTS = """
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS label FROM reach GROUP BY 1)"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
  AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
both_ways AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
  AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.98),
{_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(label_, vec_id) AS component_id, coalesce(label_, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN (SELECT node, label AS label_ FROM comp) ON node = vec_id"""

PASSAGES = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
e AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN array_to_string(ws[i:i + 34], ' ') END AS win
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
c AS (SELECT win, count(*) AS n FROM e WHERE win IS NOT NULL GROUP BY 1),
g AS (SELECT e.doc_id, i, word, coalesce(max(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (
    PARTITION BY e.doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM e LEFT JOIN c ON c.win = e.win),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(label, d.doc_id) AS component_id, coalesce(label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN comp ON node = d.doc_id"""


def _crc32(number: str) -> str:
    """CRC-32 of an integer's decimal digits, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: {step})"
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, c: {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """All nodes of trees over leaves (tree, pos, n, h), and the siblings of each leaf's ancestors."""
    return f"""
{name} AS (SELECT tree, 0 AS lvl, pos, n, h FROM {leaves} UNION ALL
  SELECT tree, lvl + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, pos // 3),
{name}_steps AS (SELECT l.tree, l.pos, s.lvl,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < l.pos // (3 ** s.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > l.pos // (3 ** s.lvl)::BIGINT), '') AS after
  FROM {leaves} l JOIN {name} s ON s.tree = l.tree AND s.n > 1 AND s.pos // 3 = l.pos // (3 ** (s.lvl + 1))::BIGINT GROUP BY ALL)"""


MERKLE = f"""
WITH RECURSIVE d AS (SELECT *, {_leaf('text')} AS leaf,
    CASE WHEN {_crc32('doc_id')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS bent FROM documents),
leaves AS (SELECT coalesce('=' || source, '') AS tree, doc_id, leaf, leaf AS h, bent, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_tree('low', 'leaves')},
subroots AS (SELECT 'all' AS tree, tree AS source, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree('top', 'subroots')},
steps AS (SELECT tree, pos, lvl AS seq, before, after FROM low_steps UNION ALL
  SELECT l.tree, l.pos, 100 + t.lvl, t.before, t.after FROM leaves l JOIN subroots s ON s.source = l.tree JOIN top_steps t ON t.pos = s.pos),
way AS (SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY seq) AS i FROM steps),
proof AS (SELECT tree, pos, sha256(string_agg(before || after, '' ORDER BY i)) AS proof FROM way GROUP BY 1, 2),
fold AS (SELECT tree, pos, 0 AS i, bent AS h FROM leaves UNION ALL
  SELECT w.tree, w.pos, w.i, sha256(w.before || f.h || w.after) FROM fold f JOIN way w ON w.tree = f.tree AND w.pos = f.pos AND w.i = f.i + 1),
ends AS (SELECT tree, pos, arg_max(h, i) AS folded_root FROM fold GROUP BY 1, 2),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.source = l.tree JOIN ends e ON e.tree = l.tree AND e.pos = l.pos
LEFT JOIN proof p ON p.tree = l.tree AND p.pos = l.pos CROSS JOIN root"""

TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS name, strlen(text) AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM t),
c AS (SELECT conv_id, {_crc32('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, i, name, bytes FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, name, bytes FROM c JOIN o USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, bytes, sha256(string_agg(name, '') OVER w) AS node FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, (count(*) - 1) * max(bytes) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends = depth), '')) AS ends_sha256 FROM q GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
s AS (SELECT q.depth, q.node, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM x JOIN q ON q.conv_id = x.conv_id AND q.depth <= x.depth GROUP BY 1, 2)
SELECT x.conv_id::BIGINT AS conv_id, x.depth::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (depth, node) LEFT JOIN n up ON up.depth = x.depth - 1 AND up.node = x.above"""
