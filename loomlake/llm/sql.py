"""The results of the queries that SQL can express, in DuckDB's SQL."""

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(url, ''), '^[^:/?#]*://([^/?#]*)(.*)$', ['host', 'rest'], 's') AS u, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, [to_base(('0x' || substr(h, 1 + 10 * k, 10))::BIGINT, 32, 8) FOR k IN [0, 1, 2, 3]] AS parts FROM f)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       translate(array_to_string(parts, ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to, url_key, captured_at,
       row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST) - 1 AS position
FROM (
  SELECT *, CASE WHEN regexp_matches(coalesce(url, ''), '^[^:/?#]*://') THEN concat(array_to_string(list_reverse(string_split(lower(u.host), '.')), ','), ')', lower(u.rest)) ELSE lower(coalesce(url, '')) END AS url_key,
         strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM d)
"""

OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, unnest(range(0, 5)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN least((200 * n_symbols) // word_chars, 200) END AS sym,
         CASE WHEN n_lines > 0 THEN least((50 * n_dup_lines) // n_lines, 50) END AS dup,
         least((10 * (word_chars + 100)) // (n_words + 20), 255) AS wlen FROM c),
m AS (
  SELECT lang, source, unnest(['sym', 'dup', 'wlen']) AS measure, unnest([sym, dup, wlen]) AS x FROM b WHERE NOT base_failed),
h AS (SELECT * FROM m WHERE x IS NOT NULL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY lang, source, measure) AS total FROM h),
q AS (
  SELECT lang, source, measure, min(CASE WHEN 100 * rn >= 50 * total THEN x END) AS q50, min(CASE WHEN 100 * rn >= 10 * total THEN x END) AS q10
  FROM r GROUP BY ALL),
fence AS (
  SELECT lang, source, measure, q50 + greatest(CASE measure WHEN 'sym' THEN 6 WHEN 'dup' THEN 20 ELSE 15 END, 4 * (q50 - q10)) AS f FROM q),
wide AS (
  SELECT lang, source, max(f) FILTER (measure = 'sym') AS fs, max(f) FILTER (measure = 'dup') AS fd, max(f) FILTER (measure = 'wlen') AS fw FROM fence GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(sym > fs, false) AND NOT coalesce(dup > fd, false) AND NOT coalesce(wlen > fw, false) AS kept
FROM b LEFT JOIN wide ON b.lang IS NOT DISTINCT FROM wide.lang AND b.source IS NOT DISTINCT FROM wide.source
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () AS everything,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capsum,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wsum FROM s),
k AS (SELECT *, 3 * everything - 2 * capsum AS num, cap * wsum * 2 <= (3 * everything - 2 * capsum) * w AS capped FROM o),
rate AS (SELECT num, wsum FROM k WHERE NOT capped ORDER BY cap / w, num LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST((SELECT num FROM rate) AS DOUBLE) / CAST(2 * (SELECT wsum FROM rate) AS DOUBLE) END AS target FROM k),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
e AS (SELECT *, target - copies * source_size AS rest FROM c),
p AS (
  SELECT d.*, e.source_size, e.target, e.copies, e.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tie
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN rest > 0 AND (upto <= rest OR (upto - tie <= rest AND tie < 2 * (rest - (upto - tie)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""

#: crc32 of the hexadecimal text x, by its usual table of 256 remainders, which the statement makes itself.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(len({0}) // 2), lambda k: CAST('0x' || substr({0}, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_TREE = """
{name} AS (
  SELECT {key}, 0 AS level, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
  UNION ALL
  SELECT {key}, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY {key}, pos // 8)"""
_SIBLINGS = """
{name}_sides AS (
  SELECT a.{key}, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.{key} = b.{key} AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL)"""
_FOLD = """
{name}_fold AS (
  SELECT id, {key}, 0 AS level, pos, '' AS proof, h FROM {start}
  UNION ALL
  SELECT f.id, f.{key}, f.level + 1, f.pos // 8, proof || l || r, sha256(l || h || r) FROM {name}_fold f JOIN {name}_sides s ON f.{key} = s.{key} AND f.level = s.level AND f.pos = s.pos)"""

OP12 = (
    "WITH RECURSIVE " + CRC_TABLE + ", d AS (SELECT doc_id, lang, " + _LEAF.format(text="text") + " AS leaf, hex(CAST(doc_id AS VARCHAR)) AS x, "
    + _LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + " AS other FROM documents),\n"
    "p AS (SELECT row_number() OVER () AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, doc_id, leaf, "
    "CASE WHEN (SELECT " + CRC.format("x") + " FROM crc) % 3 = 0 THEN other ELSE leaf END AS changed, "
    "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),\n"
    "leaves AS (SELECT tree, pos, leaf AS h FROM p),"
    + _TREE.format(name="own", key="tree", leaves="leaves") + ", subroots AS (SELECT 0 AS top, tree AS pos, h FROM own WHERE n = 1),"
    + _TREE.format(name="high", key="top", leaves="subroots") + ", root AS (SELECT h FROM high WHERE n = 1),"
    + _SIBLINGS.format(name="own", key="tree") + "," + _SIBLINGS.format(name="high", key="top")
    + ", own_start AS (SELECT id, tree, pos, changed AS h FROM p),"
    + _FOLD.format(name="own", key="tree", start="own_start")
    + ", done AS (SELECT id, tree, arg_max(proof, level) AS proof, arg_max(h, level) AS h FROM own_fold GROUP BY id, tree), high_start AS (SELECT id, 0 AS top, tree AS pos, h FROM done),"
    + _FOLD.format(name="high", key="top", start="high_start")
    + ", over AS (SELECT id, arg_max(proof, level) AS proof, arg_max(h, level) AS h FROM high_fold GROUP BY id)\n"
    "SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(done.proof || over.proof) AS proof_sha256, over.h AS folded_root, over.h = root.h AS verified\n"
    "FROM p JOIN done USING (id) JOIN over USING (id) JOIN subroots s ON s.pos = p.tree CROSS JOIN root"
)

OP13 = (
    "WITH RECURSIVE " + CRC_TABLE + ",\n"
    "e AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),\n"
    "r AS (SELECT run, count(*) AS m, hex(concat(doc_id, ':', run)) AS x FROM e WHERE length(run) >= 6 GROUP BY doc_id, run),\n"
    "h AS (SELECT run, m, " + CRC.format("x") + " AS h FROM r CROSS JOIN crc),\n"
    "w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, m FROM h),\n"
    "v AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),\n"
    "cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(CAST(length(word) AS INTEGER))) AS i FROM v)),\n"
    "one AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word\n"
    "        UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),\n"
    "best AS (SELECT a, count(*) AS n_near, max(n) AS m FROM one GROUP BY a),\n"
    "f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN (SELECT min(b) FROM one WHERE one.a = v.word AND one.n = m) END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON a = word),\n"
    "way AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON way.here = f.word WHERE f.form IS NOT NULL),\n"
    "ends AS (SELECT word, arg_max(here, k) AS root FROM way GROUP BY word)\n"
    "SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"
)

ORACLE_SQL = {"op3_warc_index": OP3, "op4_exact_top_k": OP4, "op5_quality_rules": OP5, "op6_mix_sources": OP6, "op12_merkle_manifest": OP12, "op13_spelling_variants": OP13}
