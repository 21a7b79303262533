"""DuckDB SQL with the results of the queries that SQL can express."""

#: Chunks and pairs of lines, their grouping over all documents and what is left.
LINE_DEDUP = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
r AS (SELECT *, (h + 31 * coalesce(lag(h, 1) OVER d, 0) + 961 * coalesce(lag(h, 2) OVER d, 0)) % 2147483647 AS r,
      lead(i) OVER d IS NULL AS last FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, last OR coalesce(r < lag(r) OVER d AND r < lead(r) OVER d, false) AS cut FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM b),
g AS (SELECT doc_id, min(i) AS first, max(i) AS finish, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, chunk HAVING count(*) >= 2 AND count(*) FILTER (WHERE words > 0) >= 2),
w AS (SELECT doc_id, i AS first, lead(i) OVER d AS finish, words + lead(words) OVER d AS n FROM h WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT w.doc_id, first, finish, string_agg(line, chr(10) ORDER BY i) AS body FROM w JOIN h ON h.doc_id = w.doc_id AND h.i BETWEEN first AND finish WHERE n >= 6 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, body ORDER BY doc_id, first) > 1 AS gone FROM (SELECT 'chunk' AS kind, * FROM g UNION ALL SELECT 'pair', * FROM p)),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(first, finish)) AS i FROM k WHERE gone),
s AS (SELECT h.doc_id, string_agg(line, chr(10) ORDER BY h.i) FILTER (WHERE x.i IS NULL) AS body, count(x.i) AS removed, count(*) AS lines FROM h LEFT JOIN x ON x.doc_id = h.doc_id AND x.i = h.i GROUP BY h.doc_id),
n AS (SELECT doc_id, count(*) AS chunks FROM k WHERE gone AND kind = 'chunk' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.body, '') END AS text,
  CAST(coalesce(s.lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.removed, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(n.chunks, 0) AS BIGINT) AS n_removed_chunks
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Bisected exponents, quotas and the prefix of each source's permutations.
MIXING = r"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS docs FROM n GROUP BY source),
one AS (SELECT list(source ORDER BY source NULLS FIRST) AS s, list(tokens::DOUBLE ORDER BY source NULLS FIRST) AS t, sum(tokens)::DOUBLE AS total,
        floor(sum(tokens) * 0.5) AS budget, ln(count(*)::DOUBLE) * 0.95 AS goal FROM t WHERE tokens > 0),
step AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT k + 1, CASE WHEN h >= goal THEN m ELSE lo END, CASE WHEN h >= goal THEN hi ELSE m END,
         CASE WHEN r <= 4.0 THEN lo2 ELSE m2 END, CASE WHEN r <= 4.0 THEN m2 ELSE hi2 END
  FROM (SELECT k, lo, hi, lo2, hi2, goal, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2,
      (SELECT -sum(w * ln(w)) FROM (SELECT x / sum(x) OVER () AS w FROM (SELECT unnest(list_transform(t, lambda v: pow(v / total, (lo + hi) / 2))) AS x))) AS h,
      (SELECT max(w * budget / tt) FROM (SELECT x / sum(x) OVER () AS w, tt FROM (SELECT unnest(list_transform(t, lambda v: pow(v / total, (lo2 + hi2) / 2))) AS x, unnest(t) AS tt))) AS r
    FROM step, one WHERE k < 50)),
ends AS (
  SELECT one.*, lo, hi2,
    (SELECT -sum(x / total * ln(x / total)) FROM (SELECT unnest(t) AS x)) AS h1, budget / len(t) / list_min(t) AS r0
  FROM one, step WHERE k = 50),
e AS (SELECT *, greatest(CASE WHEN h1 >= goal THEN 1.0 ELSE lo END, CASE WHEN r0 <= 4.0 THEN 0.0 ELSE hi2 END) AS a FROM ends),
w AS (SELECT source, tokens, budget, x / sum(x) OVER () AS w FROM (
  SELECT unnest(s) AS source, unnest(t) AS tokens, budget, unnest(list_transform(t, lambda v: pow(v / total, a))) AS x FROM e)),
q AS (SELECT w.source, w.tokens, round(w, 9) AS weight, CAST(round(w * budget) AS BIGINT) AS quota, CAST(greatest(1, ceil(t.docs / 1024)) AS BIGINT) AS blocks,
      CAST(ceil(round(w * budget) / w.tokens) AS BIGINT) AS epochs FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
d AS (SELECT n.doc_id, n.source, n.n, weight, quota, tokens, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block,
      unnest(generate_series(0, epochs - 1)) AS epoch FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source WHERE quota > 0),
p AS (SELECT *, epoch * tokens + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY md5(epoch || '|' || coalesce(source, '') || '|' || block), block,
      md5(epoch || '|' || coalesce(doc_id::VARCHAR, '')), doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, source, weight, n AS n_tokens, epoch, CAST(start AS BIGINT) AS start FROM p WHERE start + n <= quota
"""

#: Passages of 25 words or more, of whole lines and clauses, that an earlier place has, and the equal words beside them.
SUBSTRING_DEDUP = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(text, '[^.,;:!?。，、；：！？\n]+[.,;:!?。，、；：！？\n]*|[.,;:!?。，、；：！？\n]+') AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS own, generate_subscripts(l, 1) AS i FROM x),
o AS (SELECT doc_id, i, coalesce(sum(length(own)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(own) AS size,
      regexp_extract_all(lower(own), '[^\x20\x09-\x0D]+') AS w, CASE WHEN len(regexp_extract_all(own, '[^\x20\x09-\x0D]+')) > 20 THEN regexp_extract_all(own, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') END AS z FROM u),
c AS (SELECT doc_id, i, start, size, w, z, unnest(CASE WHEN z IS NULL THEN [0] ELSE range(0, len(w), 12) END) AS j FROM o WHERE len(w) > 0),
e AS (SELECT doc_id, i, j, start + CASE WHEN j = 0 THEN 0 ELSE list_sum(list_transform(z[1:j + 1], lambda v: length(v))) - length(w[j + 1]) END AS start, start + size AS finish, CASE WHEN z IS NULL THEN w ELSE w[j + 1:j + 12] END AS w FROM c),
f AS (SELECT doc_id, start, coalesce(CASE WHEN lead(i) OVER d = i THEN lead(start) OVER d END, finish) AS finish, array_to_string(w, ' ') AS body, row_number() OVER d AS unit, len(w) AS n,
      sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i, j) AS so_far FROM e WINDOW d AS (PARTITION BY doc_id ORDER BY i, j)),
s AS (SELECT a.doc_id, a.unit, a.start, min(b.unit) AS last FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.unit BETWEEN a.unit AND a.unit + 24 AND b.so_far - a.so_far + a.n >= 25 GROUP BY ALL),
m AS (SELECT doc_id, unit, start, unnest(generate_series(unit, last)) AS part FROM s),
p AS (SELECT m.doc_id, m.unit, m.start, max(f.finish) AS finish, string_agg(f.body, ' ' ORDER BY part) AS body FROM m JOIN f ON f.doc_id = m.doc_id AND f.unit = m.part GROUP BY ALL),
g AS (SELECT *, first_value(doc_id) OVER k AS kept, first_value(unit) OVER k AS kept_unit, first_value(start) OVER k AS kept_start, first_value(finish) OVER k AS kept_finish FROM p WINDOW k AS (PARTITION BY body ORDER BY doc_id, unit)),
r AS (SELECT *, start >= coalesce(max(finish) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM g WHERE kept <> doc_id OR kept_unit <> unit),
t AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM r),
y AS (SELECT doc_id, span, CAST(min(start) AS BIGINT) AS s, CAST(max(finish) AS BIGINT) AS e, arg_min(kept, unit) AS kept, CAST(arg_min(kept_start, unit) AS BIGINT) AS ks, arg_max(kept, unit) AS kept2, CAST(arg_max(kept_finish, unit) AS BIGINT) AS ke FROM t GROUP BY doc_id, span),
h AS (SELECT y.*, substr(a.text, 1, s) AS al, substr(b.text, 1, ks) AS bl, substr(a.text, e + 1) AS ar, substr(k.text, ke + 1) AS br
      FROM y JOIN documents a USING (doc_id) JOIN documents b ON b.doc_id = y.kept JOIN documents k ON k.doc_id = y.kept2),
v AS (SELECT *, list_reverse(regexp_extract_all(lower(al), '[^\x20\x09-\x0D]+'))[1:40] AS a1, list_reverse(regexp_extract_all(lower(bl), '[^\x20\x09-\x0D]+'))[1:40] AS b1,
      regexp_extract_all(lower(ar), '[^\x20\x09-\x0D]+')[1:40] AS a2, regexp_extract_all(lower(br), '[^\x20\x09-\x0D]+')[1:40] AS b2 FROM h),
q AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a1), len(b1)) + 1), lambda i: a1[i] <> b1[i]), true) - 1, least(len(a1), len(b1))) AS n,
      coalesce(list_position(list_transform(range(1, least(len(a2), len(b2)) + 1), lambda i: a2[i] <> b2[i]), true) - 1, least(len(a2), len(b2))) AS m FROM v),
w AS (SELECT doc_id, s AS old, kept, s - length(regexp_extract(al, concat('(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){', n, '}$'))) AS start, ks - length(regexp_extract(bl, concat('(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){', n, '}$'))) AS kept_start,
      e + length(regexp_extract(ar, concat('^(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){', m, '}'))) AS finish FROM q),
w2 AS (SELECT *, start >= coalesce(max(finish) OVER (PARTITION BY doc_id ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new FROM w),
w3 AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY old) AS span FROM w2),
z AS (SELECT doc_id, min(start) AS start, max(finish) AS finish, arg_min(kept, ROW(start, old)) AS kept, arg_min(kept_start, ROW(start, old)) AS kept_start FROM w3 GROUP BY doc_id, span),
cuts AS (SELECT z.*, text, substr(text, 1 + coalesce(lag(finish) OVER d, 0), z.start - coalesce(lag(finish) OVER d, 0)) AS before,
      len(regexp_extract_all(substr(text, 1 + z.start, finish - z.start), '[^\x20\x09-\x0D]+')) AS n FROM z JOIN documents USING (doc_id) WINDOW d AS (PARTITION BY doc_id ORDER BY z.start)),
done AS (SELECT doc_id, string_agg(before, '' ORDER BY start) || substr(any_value(text), 1 + max(finish)) AS text, count(*) AS spans, sum(n) AS n,
      string_agg(concat(start, '-', finish, ':', kept, '+', kept_start), ' ' ORDER BY start) AS removed FROM cuts GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.text, d.text) AS text, CAST(coalesce(m.spans, 0) AS BIGINT) AS n_removed_spans, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed_words, coalesce(m.removed, '') AS removed_spans
FROM documents d LEFT JOIN done m USING (doc_id)
"""

#: Brute force over sign bits: every query against all other vectors.
TOP_K = r"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
      CAST(list_sum(list_transform(list_zip(q.bits, v.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
      FROM c q JOIN c v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

#: Statistics of words and lines, and all rules at once.
QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT k, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM m WINDOW o AS (PARTITION BY k ORDER BY i)),
q AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM p WHERE c IS NOT NULL) WHERE n > 1),
r AS (SELECT k, count(DISTINCT j) AS n_repeat FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM q) GROUP BY k),
s AS (SELECT k, count(*) FILTER (WHERE a = b) AS n_same, sum(length(a)) AS chars FROM p GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(n_same, 0) AS n_same, coalesce(n_lines, 0) AS n_lines,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs
      FROM d LEFT JOIN r USING (k) LEFT JOIN s USING (k) LEFT JOIN l USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR upper > lower OR 10 * bangs > 3 * n_words OR 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words
    OR 5 * n_same > n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""

#: Words by CRC-32 bucket, gains, noise and the highest tenth.
RESAMPLING = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
n AS (SELECT r, unnest(w) AS w FROM d),
h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM n UNION SELECT w FROM b)),
c AS (SELECT w, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT), lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]))) % 10000 AS bucket FROM h, t),
s AS (SELECT bucket, count(*) AS s FROM n JOIN c USING (w) GROUP BY bucket),
u AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM u) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM (SELECT DISTINCT bucket FROM c) LEFT JOIN s USING (bucket) LEFT JOIN u USING (bucket)),
m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM n JOIN c USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
      ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) * 10 // 100 FROM y WHERE n_features >= 20) THEN place END AS rank FROM z
"""

#: Equal payloads, the first page of each, and SHA-1 in base 32 by groups of 20 bits.
WARC = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, upper(sha1(b)) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p),
d AS (SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
      lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(h, CAST(1 + 5 * i AS BIGINT), 5))::BIGINT >> k) & 31) AS BIGINT), 1)), '')), '') AS payload_digest FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

_ROUND = r"""
a{i} AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
  SELECT r, c, CAST(list_sum(list_transform(list_zip(x.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, k{i} k)) WHERE place = 1),
s{i} AS (SELECT c, j, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS v, generate_subscripts(v, 1) AS j FROM a{i} JOIN x USING (r)) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c),
k{j} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM k{i} k LEFT JOIN m{i} m USING (c)),"""

#: Three rounds of exact means, then the last assignment.
CENTROIDS = (
    r"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * e::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id) - 1 AS c, v FROM x QUALIFY c < 16),"""
    + "".join(_ROUND.format(i=i, j=i + 1) for i in range(3))
    + r"""
a AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
  SELECT r, c, CAST(list_sum(list_transform(list_zip(x.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, k3 k)) WHERE place = 1)
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM a JOIN x USING (r) JOIN k3 k USING (c)
"""
)
