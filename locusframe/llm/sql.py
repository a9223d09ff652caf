"""SQL of the numbered operators whose whole result SQL can express, independent of their code (DuckDB, on the whole tables)."""

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({LOWER}, '{SPACE}+'), lambda x: x <> '') AS ws FROM documents),
 s AS (SELECT rid, doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))
   WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
 k AS (SELECT rid, doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 AND doc_id IS NOT NULL THEN md5(array_to_string(sh, chr(10))) END AS cls, sh FROM s),
 c AS MATERIALIZED (SELECT cls, MIN(doc_id) AS rep, ANY_VALUE(n) AS n, ANY_VALUE(sh) AS sh FROM k WHERE cls IS NOT NULL GROUP BY cls),
 x AS MATERIALIZED (SELECT rep, n, UNNEST(sh) AS g FROM c),
 e AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * COUNT(*) >= 85 * (a.n + b.n - COUNT(*))),
 both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
 reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON t.a = r.b),
 o AS (SELECT a AS rep, LEAST(a, MIN(b)) AS root FROM reach GROUP BY a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, COALESCE(o.root, c.rep, k.doc_id) AS component_id, COALESCE(COALESCE(o.root, c.rep, k.doc_id) = k.doc_id, TRUE) AS kept
FROM k LEFT JOIN c USING (cls) LEFT JOIN o USING (rep)
"""

# The text in hex: byte p (from 0) is the two digits from 2p + 1 on; cut into overlapping pieces of 256 starts, so that a slice is cheap.
SUFFIX_DEDUP = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
 b AS (SELECT rid, b, h[2 * b + 1 : 2 * b + 2 * (256 + 199)] AS h FROM (SELECT rid, h, UNNEST(range(0, length(h) // 2, 256)) AS b FROM d WHERE length(h) >= 400) u),
 p AS (SELECT rid, b, h, UNNEST(range(0, least(256, length(h) // 2 - 199))) AS p FROM b WHERE length(h) >= 400),
 m AS MATERIALIZED (SELECT rid, b + p AS p, md5_number(h[2 * p + 1 : 2 * p + 400]) AS x FROM p),
 t AS (SELECT rid, p FROM m WHERE x IN (SELECT x FROM m GROUP BY x HAVING COUNT(*) > 1)),
 g AS (SELECT rid, p, CASE WHEN p <= LAG(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS starts FROM t),
 r AS (SELECT rid, p, SUM(starts) OVER (PARTITION BY rid ORDER BY p) AS run FROM g),
 s AS (SELECT rid, MIN(p) AS lo, MAX(p) + 200 AS hi FROM r GROUP BY rid, run),
 q AS (SELECT rid, lo, hi, LAG(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS was FROM s),
 n AS (SELECT rid, SUM(hi - lo) AS n_removed, COUNT(*) AS n_spans, string_agg(h[2 * was + 1 : 2 * lo], '' ORDER BY lo) || ANY_VALUE(h)[2 * MAX(hi) + 1 :] AS kept FROM q JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(COALESCE(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (rid)
"""

NEAR_VECTORS = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 ok AS MATERIALIZED (SELECT rid, vec_id, label, v, list_dot_product(v, v) AS vv FROM d WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
   AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 e AS MATERIALIZED (SELECT a.rid, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v)
   WHERE list_dot_product(a.v, b.v) / sqrt(a.vv * b.vv) >= 0.98),
 reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
 o AS (SELECT a AS vec_id, LEAST(a, MIN(b)) AS root FROM reach GROUP BY a),
 n AS (SELECT rid, COUNT(*) AS n FROM e GROUP BY rid)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, COALESCE(root, vec_id) AS component_id, COALESCE(COALESCE(root, vec_id) = vec_id, TRUE) AS kept, CAST(label AS VARCHAR) AS label
FROM d LEFT JOIN n USING (rid) LEFT JOIN o USING (vec_id)
"""

# crc32 a bit at a time: every byte comes in before eight shifts. After a row: state 0 nothing yet, then 1, 2, 3 after s, u, a; an
# inserted or re-roled row leads to user but after a user. The least (cost, audit) a state decides, as text of fixed width.
DIALOGUE_REPAIR = f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS said, COALESCE(CAST(conv_id AS VARCHAR), ' ') AS conv, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
 crc AS (SELECT *, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(name, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
   lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) AS r FROM src),
 dmg AS (SELECT conv, turn, xor(r, 4294967295) % 20 AS k, role, said FROM crc),
 rep AS (SELECT conv, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said,
   UNNEST(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dmg WHERE k <> 0),
 pos AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, said, copy) AS nth FROM rep),
 dup AS (SELECT *, row_number() OVER (PARTITION BY conv, role, said ORDER BY nth) > 1 AS again, LEAD(role[1:1]) OVER (PARTITION BY conv ORDER BY nth) AS after FROM pos),
 f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(said, '{WORD}') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(said, '[.!?]{SPACE}*$') THEN 'truncated' ELSE '' END AS fault FROM dup),
 ins AS (SELECT s AS q, n, CASE n WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 2 THEN 3 ELSE 2 END ELSE CASE s WHEN 2 THEN 2 ELSE 3 END END AS p,
   list_transform(range(0, n), lambda i: CASE WHEN (s = 2) = (i % 2 = 0) THEN 'assistant:' ELSE 'user:' END) AS lines FROM range(0, 4) a(s), range(0, 3) b(n)),
 dp AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS q, '000000000000' AS best, CAST([] AS VARCHAR[]) AS lines FROM f
  UNION ALL
  SELECT conv, nth, q, MIN(best), arg_min(lines, best) FROM (
   SELECT f.conv, f.nth, CASE op WHEN 'D' THEN i.p WHEN 'R' THEN CASE i.p WHEN 2 THEN 3 ELSE 2 END ELSE CASE f.role[1:1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
    lpad(CAST(CAST(dp.best[1:12] AS BIGINT) + 5 * i.n + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS VARCHAR), 12, '0')
     || dp.best[13:] || repeat('I', CAST(i.n AS INT)) || op AS best,
    dp.lines || i.lines || CASE op WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.said] ELSE [CASE i.p WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.said] END AS lines
   FROM dp JOIN f ON f.conv = dp.conv AND f.nth = dp.nth + 1 JOIN ins i ON i.q = dp.q, (VALUES ('D'), ('K'), ('R')) ops(op)
   WHERE op = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR f.role[1:1] = 's' AND i.p = 0 OR f.role[1:1] = 'u' AND i.p <> 2 OR f.role[1:1] = 'a' AND i.p = 2)) y GROUP BY conv, nth, q),
 ends AS (SELECT conv, lpad(CAST(CAST(best[1:12] AS BIGINT) + CASE q WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS VARCHAR), 12, '0') || best[13:] || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS best,
   lines || CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS lines FROM dp WHERE nth = (SELECT MAX(f.nth) FROM f WHERE f.conv = dp.conv)),
 fin AS (SELECT conv, MIN(best) AS best, sha256(array_to_string(arg_min(lines, best), chr(10))) AS sha FROM ends GROUP BY conv),
 n AS (SELECT conv, CAST(MAX(turn) AS HUGEINT) - MIN(turn) + 1 - COUNT(DISTINCT turn) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
   COUNT(*) FILTER (after IS NOT NULL AND role[1:1] || after NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, CAST(COALESCE(blank, 0) AS BIGINT) AS blank, CAST(COALESCE(duplicate, 0) AS BIGINT) AS duplicate, CAST(COALESCE(truncated, 0) AS BIGINT) AS truncated,
 CAST(COALESCE(illegal, 0) AS BIGINT) AS illegal, CAST(COALESCE(fin.best[1:12], '0') AS BIGINT) AS cost, COALESCE(fin.best[13:], '') AS audit, COALESCE(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM src) o LEFT JOIN n USING (conv) LEFT JOIN fin USING (conv)
"""
