"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

import importlib

#: query: (module, function), imported when the query is first called.
WHERE = {
    "op1_substrings": ("recallery.llm.substrings", "op1_substrings"),
    "op2_lines": ("recallery.llm.lines", "op2_lines"),
    "op2_lines_whole": ("recallery.llm.lines", "op2_lines_whole"),
    "op3_sharding": ("recallery.llm.sharding", "op3_sharding"),
    "op4_mixing": ("recallery.llm.mixing", "op4_mixing"),
    "op5_pii": ("recallery.llm.pii", "op5_pii"),
    "op6_decontamination": ("recallery.llm.decontaminate", "op6_decontamination"),
    "op7_toxicity": ("recallery.llm.toxicity", "op7_toxicity"),
    "op8_quality": ("recallery.llm.quality", "op8_quality"),
    "op9_jaccard": ("recallery.llm.jaccard", "op9_jaccard"),
    "op10_embeddings": ("recallery.llm.embeddings", "op10_embeddings"),
    "op11_sentencepiece": ("recallery.llm.pieces", "op11_sentencepiece"),
    "op12_periods": ("recallery.llm.periods", "op12_periods"),
    "op13_middle": ("recallery.llm.middle", "op13_middle"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(module), function) for name, (module, function) in WHERE.items()}


#: Components by reachability; the tables docs (id) and links (x, y, both ways) are to be given.
_REACH = """reach(id, c) AS (SELECT id, id FROM docs UNION SELECT r.id, l.y FROM reach r JOIN links l ON r.c = l.x),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

SQL = {
    "op1_substrings": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS nth
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 18)) AS i)
), gone AS (
  SELECT DISTINCT doc_id, j AS i FROM windows, LATERAL (SELECT unnest(range(i, i + 20)) AS j) WHERE nth > 1
), each AS (
  SELECT doc_id, i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)
), kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op9_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)
), docs AS (
  SELECT doc_id AS id FROM documents
), {_REACH}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM comp LEFT JOIN sizes ON id = doc_id
""",
    "op10_embeddings": f"""
WITH RECURSIVE good AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
  SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM good
), links AS (
  SELECT a.id AS x, b.id AS y FROM unit a JOIN unit b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.9
), docs AS (
  SELECT vec_id AS id FROM embeddings
), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE x = id) AS n_links, component_id, id = component_id AS kept FROM comp
""",
    "op2_lines": """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL
), each AS (
  SELECT doc_id, i, ls[i] AS line, len(ls) AS n, ('0x' || substr(md5(ls[i]), 1, 7))::BIGINT AS h
  FROM lines, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
), rolled AS (
  SELECT *, (h + 131 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 1000003 % 3 = 0 OR i = n AS ends FROM each
), dealt AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled
), chunks AS (
  SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM dealt GROUP BY 1, 2
), marked AS (
  SELECT *, n >= 2 AND regexp_matches(body, '[^\\s]') AND row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) > 1 AS gone FROM chunks
), kept AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS n_removed,
         coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op2_lines_whole": """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] AS body FROM lines, LATERAL (SELECT unnest(range(1, len(ls))) AS i)
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) > 1 AS again FROM windows WHERE regexp_matches(body, '[^\\s]')
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM marked WHERE again
), each AS (
  SELECT doc_id, i, ls[i] AS line FROM lines, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
), kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op3_sharding": """
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))
), sized AS (
  SELECT row_number() OVER () AS nr, doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), summed AS (
  SELECT nr, doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM sized, crc_table
), draws AS (
  SELECT nr, s, ('0x' || substr(md5(doc_id || '/' || s || '/0'), 1, 12))::BIGINT AS draw FROM summed, (SELECT unnest(range(25)) AS s)
), best AS (
  SELECT nr, arg_max(s, (draw, -s)) FILTER (WHERE s < 24) AS shard, arg_max(s, (draw, -s)) AS grown FROM draws GROUP BY nr
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id || '/' || text_crc32 || '/' || size), 1, 8))::BIGINT % 256, doc_id, text_crc32, size) - 1 AS slot, grown::INT AS grown_shard
FROM summed JOIN best USING (nr)
""",
    "op4_mixing": """
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), w AS (
  SELECT *, (rank - 1) % 3 + 1 AS w FROM s
), fills AS (
  SELECT *, (SELECT sum(n) FROM w) - 3 * coalesce(sum(n) OVER (ORDER BY n::DOUBLE * 3 / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (ORDER BY n::DOUBLE * 3 / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w
), lvl AS (
  SELECT lft AS al, weights AS aw FROM fills WHERE lft * w < 3 * n * weights ORDER BY n::DOUBLE * 3 / w, rank LIMIT 1
), votes AS (
  SELECT source, n, rank, coalesce(least(al::DOUBLE * w / aw::DOUBLE, (3 * n)::DOUBLE), (3 * n)::DOUBLE) AS target FROM w LEFT JOIN lvl ON true
), unit AS (
  SELECT *, CASE WHEN n < 2048 THEN 1 ELSE 32 END AS unit, greatest(ceil(n / CASE WHEN n < 2048 THEN 1 ELSE 32 END), 1)::HUGEINT AS b FROM votes
), quotients AS (
  SELECT rank, unit, row_number() OVER (PARTITION BY unit ORDER BY target / (2 * k + 1) DESC, rank) AS place
  FROM unit, LATERAL (SELECT unnest(range(0, 3 * ceil(n / unit)::BIGINT)) AS k) WHERE target > 0
), houses AS (
  SELECT unit, house, floor(sum(target) / unit * house / 16 + 0.5) AS seats FROM unit, (SELECT unnest(range(0, 17)) AS house) GROUP BY unit, house
), quota AS (
  SELECT rank, house, count(place) AS upto FROM (SELECT rank, house, seats FROM unit JOIN houses USING (unit)) LEFT JOIN quotients USING (rank) WHERE place <= seats GROUP BY rank, house
), plan AS (
  SELECT v.source, v.n, v.target, v.unit, v.rank, coalesce(u.upto, 0)::HUGEINT AS q, b, coalesce(u.upto, 0)::HUGEINT // b AS passes, coalesce(u.upto, 0)::HUGEINT % b AS extra,
         ('0x' || substr(md5('mix-0/' || coalesce(v.source, '')), 1, 8))::BIGINT % b AS seed
  FROM unit v LEFT JOIN quota u ON u.rank = v.rank AND u.house = 16
), placed AS (
  SELECT *, row_number() OVER () AS nr, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix-0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS x0 FROM sized
), spots AS (
  SELECT p.nr, p.doc_id, p.size, plan.n AS source_size, plan.target, plan.rank, unit, b, passes, x, which,
         ((x // unit * extra + seed) // b) * unit + x % unit * (((x // unit + 1) * extra + seed) // b - (x // unit * extra + seed) // b) AS rest
  FROM (SELECT *, x0 AS x, 0 AS which FROM placed UNION ALL SELECT *, x0 + size AS x, 1 AS which FROM placed) p JOIN plan ON p.source IS NOT DISTINCT FROM plan.source
), shards AS (
  SELECT s.*, h.house, coalesce(u.upto, 0)::HUGEINT AS e FROM spots s CROSS JOIN (SELECT unnest(range(0, 17)) AS house) h LEFT JOIN quota u ON u.rank = s.rank AND u.house = h.house
), sums AS (
  SELECT nr, doc_id, size, source_size, target, house,
         sum((CASE WHEN which = 1 THEN 1 ELSE -1 END) * (list_sum(list_transform(range(0, 3), lambda p: CASE WHEN p < passes THEN least(x, unit * least(greatest(e - b * p, 0), b)) ELSE 0 END)) + least(rest, unit * greatest(e - b * passes, 0))))::BIGINT AS upto
  FROM shards GROUP BY ALL
), parts AS (
  SELECT *, upto - coalesce(lag(upto) OVER (PARTITION BY nr ORDER BY house), 0) AS words FROM sums
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, sum(words)::BIGINT AS taken,
       coalesce(string_agg(house || ':' || words, ',' ORDER BY house) FILTER (WHERE words > 0), '') AS shard_words
FROM parts GROUP BY nr, doc_id, size, source_size, target
""",
    "op13_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""",
    "op6_decontamination": """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[i : i + least(len(ws), 10) - 1] AS win
  FROM items, LATERAL (SELECT unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i) WHERE len(ws) > 0
), lengths AS (
  SELECT DISTINCT n FROM windows
), found AS (
  SELECT d.doc_id, d.i, w.n, w.item_id
  FROM (SELECT doc_id, i, n, ws[i : i + n - 1] AS win FROM split, lengths, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS i)) d
  JOIN windows w ON d.n = w.n AND d.win = w.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT s.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
