"""DuckDB SQL for the queries that SQL can express on whole tables."""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 13) AS n, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i
  FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM grams),
dw AS (
  SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i
  FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT doc_id, dw.n, i, item_id
  FROM dw JOIN grams ON grams.n = dw.n AND grams.g = array_to_string(w[i:i + dw.n - 1], ' ')),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20
"""

_PREFIX = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"
_TRACKING = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'"

OP8 = f"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS d1 FROM pages),
q AS (SELECT *, md5(d1 || 'changed') AS d2, regexp_replace(url, '[?#].*$', '') || '#again' AS other FROM p),
r AS (
  SELECT page_id * 10 AS id, url, 'revisit' AS kind, NULL AS etag, NULL AS digest, NULL AS modified FROM q WHERE page_id % 4 = 0
  UNION ALL SELECT page_id * 10 + 1, url, 'response', '"' || substr(d1, 1, 16) || '"', d1, 'day ' || (page_id * 10 + 1) FROM q
  UNION ALL SELECT page_id * 10 + 2, other, 'revisit', '"' || substr(d1, 1, 16) || '"', NULL, NULL FROM q
  UNION ALL SELECT page_id * 10 + 4, other, 'response', '"' || substr(d2, 1, 16) || '"', d2, 'day ' || (page_id * 10 + 4)
            FROM q WHERE page_id % 3 = 0
  UNION ALL SELECT page_id * 10 + 5, url, 'revisit', '"' || substr(d1, 1, 16) || '"', NULL, NULL FROM q WHERE page_id % 2 = 0
  UNION ALL SELECT page_id * 10 + 6, other, 'revisit', NULL, d2, NULL FROM q WHERE page_id % 5 = 0
  UNION ALL SELECT page_id * 10 + 7, url, 'revisit', NULL, NULL, 'day ' || (page_id * 10 + 1) FROM q WHERE page_id % 7 = 0
  UNION ALL SELECT page_id * 10 + 8, url, 'revisit', NULL, NULL, NULL FROM q WHERE page_id % 7 = 1),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM r),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '{_PREFIX}([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '{_PREFIX}[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
                   lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({_TRACKING}))) AS params
  FROM u),
c AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM parts),
w AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN id END IGNORE NULLS) OVER (
    PARTITION BY canonical ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM c),
j AS (
  SELECT w.id, w.canonical, w.target, t.digest AS t_digest, t.etag AS t_etag,
         CASE WHEN w.target IS NULL THEN 'orphan'
              WHEN w.etag IS NOT NULL THEN CASE WHEN w.etag = t.etag THEN 'resolved' ELSE 'mismatch' END
              WHEN w.digest IS NOT NULL THEN CASE WHEN w.digest = t.digest THEN 'resolved' ELSE 'mismatch' END
              WHEN w.modified IS NOT NULL THEN CASE WHEN w.modified = t.modified THEN 'resolved' ELSE 'mismatch' END
              ELSE 'resolved' END AS status
  FROM w LEFT JOIN c t ON t.id = w.target WHERE w.kind = 'revisit')
SELECT id AS record_id, canonical, status, CASE WHEN status = 'resolved' THEN target END AS target_id,
       CASE WHEN status = 'resolved' THEN t_digest END AS digest,
       'cache-control: max-age=60' || chr(10) || 'content-type: '
         || CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'none' END || chr(10) || 'date: day ' || id
         || CASE WHEN status = 'resolved' THEN chr(10) || 'etag: ' || t_etag ELSE '' END AS headers
FROM j
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g),
hits AS (SELECT w.doc_id, i FROM w JOIN f USING (g) WHERE m < w.doc_id),
marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM hits),
runs AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop,
         string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: A field of the manifest's leaves, and a leaf.
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

OP13 = f"""
WITH RECURSIVE even AS (
  SELECT *, list_reduce(list_prepend(4294967295, flatten(list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) & 1 = 1 AS cut
  FROM documents),
leaves AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
         {_LEAF.format("CASE WHEN cut THEN replace(text, chr(10), '') ELSE text END")} AS seen FROM even),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS slot FROM leaves),
low(g, level, slot, n, digest) AS (
  SELECT g, 0, slot, count(*) OVER (PARTITION BY g), leaf FROM placed
  UNION ALL
  SELECT g, level + 1, slot // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY slot)) FROM low WHERE n > 1
  GROUP BY g, level, n, slot // 3),
high(g, level, slot, n, digest) AS (
  SELECT -1, 0, g, count(*) OVER (), digest FROM low WHERE n = 1
  UNION ALL
  SELECT g, level + 1, slot // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY slot)) FROM high WHERE n > 1
  GROUP BY g, level, n, slot // 3),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
steps AS (
  SELECT a.g, a.level, a.slot, coalesce(string_agg(b.digest, '' ORDER BY b.slot) FILTER (b.slot < a.slot), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.slot) FILTER (b.slot > a.slot), '') AS r
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.level = b.level AND a.slot // 3 = b.slot // 3
  WHERE a.n > 1 GROUP BY a.g, a.level, a.slot),
tall AS (SELECT g, max(level) AS h FROM nodes GROUP BY g),
paths(id, home, h, g, level, slot, digest, proof) AS (
  SELECT row_number() OVER (ORDER BY p.g, p.slot), p.g, h, CASE WHEN h = 0 THEN -1 ELSE p.g END, 0,
         CASE WHEN h = 0 THEN p.g ELSE p.slot END, seen, '' FROM placed p JOIN tall USING (g)
  UNION ALL
  SELECT p.id, home, h, CASE WHEN p.level + 1 = h THEN -1 ELSE p.g END,
         CASE WHEN p.level + 1 = h AND p.g >= 0 THEN 0 ELSE p.level + 1 END,
         CASE WHEN p.level + 1 = h AND p.g >= 0 THEN home ELSE p.slot // 3 END,
         sha256(l || digest || r), proof || l || r
  FROM paths p JOIN steps s ON p.g = s.g AND p.level = s.level AND p.slot = s.slot),
done AS (SELECT id, arg_max(digest, strlen(proof)) AS folded, max_by(proof, strlen(proof)) AS proof FROM paths GROUP BY id),
ids AS (SELECT *, row_number() OVER (ORDER BY g, slot) AS id FROM placed),
root AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, low.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = root AS verified
FROM ids JOIN done USING (id) JOIN low ON low.g = ids.g AND low.n = 1 JOIN root ON true
"""

OP12 = f"""
WITH pieces AS (
  SELECT rid, coalesce(lang, 'und') AS lang, unnest(range(len(p))) AS pid, unnest(p) AS piece
  FROM (SELECT row_number() OVER () AS rid, lang, string_split_regex({_LOWERED}, '[.,;:!?\\x0A-\\x0D]') AS p FROM documents)),
split AS (SELECT rid, pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 6) AS t(k) WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
cands AS (SELECT * FROM grams WHERE k >= 2 AND f >= 100),
cuts AS (SELECT lang, k, g, f, unnest(range(1, k)) AS c FROM cands),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.g, cuts.f AS a, x.f AS l, y.f AS r, n, c,
         CAST((CAST(1000 AS HUGEINT) * cuts.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN total ON total.lang = cuts.lang
  JOIN grams x ON x.lang = cuts.lang AND x.k = c AND x.g = cuts.g[1:c]
  JOIN grams y ON y.lang = cuts.lang AND y.k = cuts.k - c AND y.g = cuts.g[c + 1:]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT DISTINCT w.lang, w.g FROM worst w JOIN cands b ON b.lang = w.lang AND b.k > w.k AND b.f >= w.a
    AND contains(' ' || array_to_string(b.g, ' ') || ' ', ' ' || array_to_string(w.g, ' ') || ' ')),
kept AS (SELECT * FROM worst ANTI JOIN inside USING (lang, g)),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {
    "op2_top_k_search": OP2,
    "op7_benchmark_decontamination": OP7,
    "op8_warc_revisits": OP8,
    "op9_suffix_array_dedup": OP9,
    "op12_phrase_mining": OP12,
    "op13_merkle_manifest": OP13,
}
