"""SQL for the queries that SQL can express in reasonable time on whole tables."""

#: Components of links(a, b) over all(id): smallest reachable id.
_COMPONENTS = """reach(id, r) AS (SELECT id, id FROM everyone UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id)"""

OP3 = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
everyone AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT e.id AS vec_id, (SELECT count(*) FROM links WHERE a = e.id) AS n_links, (SELECT min(r) FROM reach WHERE reach.id = e.id) AS component_id, e.id = (SELECT min(r) FROM reach WHERE reach.id = e.id) AS kept FROM everyone e"""

OP7 = r"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p > 100 + lag(p) OVER (PARTITION BY doc_id ORDER BY p) OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh FROM again)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, a AS to_ FROM runs UNION ALL SELECT d.doc_id, 1000000000, coalesce(max(b), 0), any_value(length(h) // 2) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY a) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256 FROM d JOIN rest USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM runs GROUP BY doc_id) USING (doc_id)"""

OP9 = rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, list_aggregate(w[i + 1 : i + 5], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM t WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * c.k >= 75 * (p.n + q.n - c.k)),
everyone AS (SELECT doc_id AS id FROM documents), {_COMPONENTS},
low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT e.id AS doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id FROM everyone e JOIN low ON low.id = e.id LEFT JOIN n ON n.doc_id = e.id"""

#: crc32 of the bytes of every distinct feature, by its table of 256 entries.
OP11 = r"""WITH RECURSIVE d AS MATERIALIZED (SELECT id, doc, w FROM (SELECT doc_id AS id, true AS doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark) t,
  LATERAL (SELECT list_filter(string_split_regex(translate(coalesce(t.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w)),
f AS MATERIALIZED (SELECT doc, id, g, count(*) AS n FROM (SELECT doc, id, unnest(w) AS g FROM d UNION ALL SELECT doc, id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)) GROUP BY ALL),
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
b AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f)), tab),
k AS MATERIALIZED (SELECT r.b, coalesce(sum(n) FILTER (doc), 0) AS s, coalesce(sum(n) FILTER (NOT doc), 0) AS t FROM range(10000) r(b) LEFT JOIN b ON b.b = r.b LEFT JOIN f ON f.g = b.g GROUP BY r.b),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM k) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM k) + 10000)::DOUBLE)))::BIGINT AS gain FROM k),
w AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM f JOIN b USING (g) JOIN gain USING (b) WHERE doc GROUP BY id),
s AS (SELECT id AS doc_id, len(d.w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - (total % n + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (id) WHERE doc),
c AS (SELECT doc_id, words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE words >= 20)
SELECT c.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""

OP13 = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS ln FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
k AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, ln FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p, 1 + 1000000000::HUGEINT * (ln + 1) // (sum(ln) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q FROM k),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, h.source AS item, sum((p.p - h.p) * (p.p - h.p) // h.p) AS value FROM p JOIN p h ON p.lang = h.lang AND p.term = h.term AND p.source <> h.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM t UNION ALL FROM s)) WHERE part = 'pair' OR rank <= 200"""
