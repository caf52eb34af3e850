"""DuckDB SQL for the numbered queries that SQL can express, over the same Parquet tables."""

OP5_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) o(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
             len(regexp_extract_all(text, '[!?]')) AS n_marks
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
              + CASE WHEN 10 * n_upper > 7 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_marks > n_words THEN 32 ELSE 0 END
              + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 64 ELSE 0 END AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(failed AS BIGINT) AS failed,
       failed & 3 > 0 AS base_failed, failed = 0 AS kept FROM f
"""

OP7_WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
             4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '') AS bits FROM h),
d AS (SELECT page_id, html, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
                  + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest FROM b),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS f FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to, true AS verified FROM r
"""

OP10_DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, n FROM dw JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, array_to_string(list_sort(list(CAST(item_id AS VARCHAR))), ',') AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: CRC-32 of the bytes of a text x, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen({x}) + 1), lambda i: [CAST('0x' || substr(hex(encode({x})), CAST(2 * i - 1 AS INT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, e: xor(xor(s, e) >> 1, 3988292384 * (xor(s, e) & 1))), 4294967295::BIGINT)"""

OP11_TRIE = rf"""
WITH t AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_CRC32.format(x="CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT ids.c, 0 AS part, t.p, t.g, t.chars FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND t.p <= h
      UNION ALL SELECT ids.c, 1, t.p, t.g, t.chars FROM ids JOIN t ON t.c = ids.c AND t.p > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, g, chars FROM r),
m AS (SELECT c, d, chars, string_agg(g, ',') OVER (PARTITION BY c ORDER BY d) AS k FROM q UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT d, k, CASE WHEN d = 1 THEN '' WHEN d > 1 THEN left(k, length(k) - 33) END AS pk, min(c) AS c, count(*) AS n, max(chars) AS chars FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (d, k)),
below AS (SELECT m.d, m.k, sum(CASE WHEN x.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.chars) AS saved FROM x JOIN m ON m.c = x.c AND m.d <= x.d GROUP BY 1, 2),
ends AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM m) WHERE d = last GROUP BY 1, 2)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs, CAST(x.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN below USING (d, k) LEFT JOIN n up ON up.d = x.d - 1 AND up.k = x.pk LEFT JOIN ends ON ends.d = x.d AND ends.k = x.k
"""

OP12_RESAMPLING = rf"""
WITH w AS (SELECT 0 AS target, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
           UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (SELECT target, id, array_to_string(w[p : p + k - 1], ' ') AS f FROM (SELECT target, id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (VALUES (1), (2), (3)) v(k))),
crc AS (SELECT f, {_CRC32.format(x="f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs)),
f AS (SELECT target, id, bucket, count(*) AS n FROM runs JOIN crc USING (f) GROUP BY 1, 2, 3),
total AS (SELECT coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM f),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((any_value(hist.t) + 1) * (any_value(total.s) + 10000) AS DOUBLE) / CAST((any_value(hist.s) + 1) * (any_value(total.t) + 10000) AS DOUBLE))) AS BIGINT) AS gain
         FROM (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0) AS s, coalesce(sum(n) FILTER (target = 1), 0) AS t FROM f GROUP BY 1) hist, total GROUP BY bucket),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE target = 0 GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM (SELECT id AS doc_id, w FROM w WHERE target = 0) x LEFT JOIN d ON d.id = x.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM s WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= n * 5 // 100 THEN place END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
