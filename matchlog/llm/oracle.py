"""DuckDB SQL with the results of the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc32(text: str) -> str:
    """The CRC-32 of a short ASCII text, which DuckDB has no function for."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),"
        f" lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {step})), 4294967295)"
    )


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


_KEPT = "'(</?s>|\\[/?INST\\])', '\\\\\\1', 'g'"

ORACLE = {
    "op1_minhash_tensored": rf"""
WITH RECURSIVE d AS (
 SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
 SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5
   THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10)))
   WHEN len(w) > 0 THEN [array_to_string(w, chr(10))] ELSE [] END)) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, y FROM r JOIN l ON r.reached = l.x),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op2_suffix_array_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM t),
o AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d JOIN lens ON len(w) >= k),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM o),
m AS (SELECT doc_id, i, g.k, item_id FROM g JOIN t ON g.k = t.k AND g.win = t.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op4_columnwise_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(x[2 * p + 1:2 * p + 800]) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS p FROM d)),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY h) > 1),
b AS (SELECT doc_id, p, max(s) OVER (PARTITION BY doc_id ORDER BY p) AS last
 FROM (SELECT doc_id, unnest(range(0, len(x) // 2)) AS p FROM d) LEFT JOIN (SELECT doc_id, p, p AS s FROM r) USING (doc_id, p)),
g AS (SELECT doc_id, p, coalesce(last >= p - 399, false) AS gone FROM b),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
 string_agg(x[2 * p + 1:2 * p + 2], '' ORDER BY p) FILTER (NOT gone) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_seekable_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> owner THEN owner END AS refers_to FROM o""",
    "op11_contracted_prefix_trie": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS idx,
  sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said, octet_length(encode(coalesce(text, ''))) AS size
 FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
j AS (SELECT c.conv_id, 0 AS own, t.idx, said, size FROM c JOIN t ON t.conv_id = base AND t.idx < h
 UNION ALL SELECT c.conv_id, 1, t.idx, said, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.idx >= h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, idx) AS depth, said, size FROM j),
p AS (SELECT conv_id, depth, size, string_agg(said, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
 UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS final FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '') AS ends FROM q GROUP BY path, depth),
k AS (SELECT left(path, len(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT a.path, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens, count(*) FILTER (k.path IS NULL) AS n_leaves
 FROM n b JOIN p ON p.conv_id = b.conv_id AND p.depth <= b.depth JOIN n a ON a.path = p.path LEFT JOIN k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n u ON n.depth > 0 AND u.path = left(n.path, len(n.path) - 64)""",
    "op12_interval_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, row_number() OVER () AS row,
  sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 2 = 0
   THEN sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')"))}) END AS held
 FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
t AS (SELECT '=' || source AS tree, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM l GROUP BY source
 UNION ALL SELECT tree, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM t WHERE len(nodes) > 1),
o AS (SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY idx) AS nodes FROM o
 UNION ALL SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], ''))) FROM u WHERE len(nodes) > 1),
f AS (SELECT l.row, l.doc_id, l.leaf, '=' || l.source AS tree, l.idx, 0 AS level, false AS over, '' AS proof, coalesce(l.held, l.leaf) AS digest FROM l
 UNION ALL SELECT f.row, f.doc_id, f.leaf, f.tree,
  CASE WHEN NOT over AND len(t.nodes) = 1 THEN o.idx ELSE f.idx // 3 END,
  CASE WHEN NOT over AND len(t.nodes) = 1 THEN 0 ELSE f.level + 1 END, over OR len(t.nodes) = 1,
  CASE WHEN NOT over AND len(t.nodes) = 1 THEN proof ELSE proof || array_to_string(list_concat(coalesce(u.nodes, t.nodes)[f.idx // 3 * 3 + 1:f.idx], coalesce(u.nodes, t.nodes)[f.idx + 2:f.idx // 3 * 3 + 3]), '') END,
  CASE WHEN NOT over AND len(t.nodes) = 1 THEN digest ELSE sha256(array_to_string(coalesce(u.nodes, t.nodes)[f.idx // 3 * 3 + 1:f.idx], '') || digest || array_to_string(coalesce(u.nodes, t.nodes)[f.idx + 2:f.idx // 3 * 3 + 3], '')) END
 FROM f JOIN o ON f.tree IS NOT DISTINCT FROM o.tree LEFT JOIN t ON NOT over AND t.tree IS NOT DISTINCT FROM f.tree AND t.level = f.level
 LEFT JOIN u ON over AND u.level = f.level WHERE NOT over OR len(u.nodes) > 1),
g AS (SELECT * FROM f WHERE over AND level = (SELECT max(level) FROM u))
SELECT g.doc_id, leaf, subroot, r.root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = r.root AS verified
FROM g JOIN o ON g.tree IS NOT DISTINCT FROM o.tree, (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) r""",
    "op13_offset_chat_masks": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<s>[INST] ' || regexp_replace(role, {_KEPT}) || ' [/INST] ' || regexp_replace(text, {_KEPT}) || ' </s>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
}
