"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM totals),
weighted AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS full_at, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM weighted),
plan AS (
  SELECT source AS s, source_size, w, budget,
         least(CAST(cap AS DOUBLE), (SELECT arg_min(lvl, (full_at, rk)) FROM levels WHERE lvl <= full_at) * w) AS target
  FROM levels),
served AS (
  SELECT z.*, p.*, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sized z JOIN plan p ON z.source IS NOT DISTINCT FROM p.s),
copies AS (SELECT *, CAST(e * source_size + done AS DOUBLE) / w AS finish FROM served, (SELECT unnest([0, 1, 2]) AS e)),
cut AS (
  SELECT max(finish) AS v FROM (
    SELECT finish, budget, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS upto FROM copies) WHERE upto <= budget)
SELECT doc_id, size, source_size, target,
       size * (CAST(CAST(done AS DOUBLE) / w <= v AS BIGINT) + CAST(CAST(source_size + done AS DOUBLE) / w <= v AS BIGINT)
         + CAST(CAST(2 * source_size + done AS DOUBLE) / w <= v AS BIGINT)) AS taken
FROM served, cut
"""

_OP3 = r"""
WITH lines AS (
  SELECT rid, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line FROM (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

_OP6 = """
WITH RECURSIVE unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS c FROM embeddings UNION SELECT p.u, r.c FROM reach r JOIN pairs p ON r.u = p.v)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.u = e.vec_id) AS n_links, (SELECT min(c) FROM reach r WHERE r.u = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(c) FROM reach r WHERE r.u = e.vec_id) AS kept
FROM embeddings e
"""

_OP7 = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
hits AS (
  SELECT rid, i, n, item FROM (
    SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n) t
  JOIN grams USING (n) WHERE array_to_string(w[i : i + n - 1], ' ') = g),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOLD = "coalesce(concat(octet_length(encode(CAST({x} AS VARCHAR))), ':', {x}), '-')"
_LEAF = "sha256(concat(" + ", ".join(_TOLD.format(x=x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
#: crc32 (unsigned, reflected) of the decimal digits of doc_id, bit by bit.
_CRC = """list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c : CAST(ascii(c) AS UBIGINT))), lambda s, b :
  list_reduce(list_concat([xor(s, b)], [CAST(0 AS UBIGINT) for z in range(8)]), lambda v, z : CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS UBIGINT)) ELSE v // 2 END))"""

_OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN xor({_CRC}, CAST(4294967295 AS UBIGINT)) % 3 = 0 THEN {_LEAF.format(text=_LOWER.format(x="text"))} ELSE {_LEAF.format(text="text")} END AS told FROM documents),
placed AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, level, pos // 8 * 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM low WHERE m > 1 GROUP BY tree, level, pos // 8 * 8)),
subroots AS (SELECT tree, h AS subroot, level AS height FROM low WHERE m = 1),
high AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, subroot AS h, count(*) OVER () AS m FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, h, count(*) OVER () FROM (SELECT level, pos // 8 * 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM high WHERE m > 1 GROUP BY level, pos // 8 * 8)),
top AS (SELECT h AS root FROM high WHERE m = 1),
tops AS (SELECT tree, subroot, height, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM subroots),
nodes AS (SELECT tree, level, pos, h FROM low WHERE m > 1 UNION ALL SELECT t.tree, t.height + h.level, h.pos, h.h FROM tops t, high h WHERE h.m > 1 AND h.pos // 8 = t.pos // CAST(pow(8, h.level + 1) AS BIGINT)),
sided AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY ALL),
ways AS (
  SELECT p.tree, p.pos, list(s.l ORDER BY s.level) AS ls, list(s.r ORDER BY s.level) AS rs
  FROM placed p JOIN tops t USING (tree) JOIN sided s ON s.tree = p.tree
    AND s.pos = CASE WHEN s.level < t.height THEN p.pos // CAST(pow(8, s.level) AS BIGINT) ELSE t.pos // CAST(pow(8, s.level - t.height) AS BIGINT) END GROUP BY ALL),
told AS (
  SELECT p.*, t.subroot, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs FROM placed p JOIN tops t USING (tree) LEFT JOIN ways w ON w.tree = p.tree AND w.pos = p.pos),
folds AS (SELECT *, list_reduce(list_concat([told], list_zip_text), lambda a, b : sha256(concat(split_part(b, '|', 1), a, split_part(b, '|', 2)))) AS folded_root
  FROM (SELECT *, list_transform(range(1, len(ls) + 1), lambda i : concat(ls[i], '|', rs[i])) AS list_zip_text FROM told))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(1, len(ls) + 1), lambda i : concat(ls[i], rs[i])), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folds, top
"""

_OP12 = """
WITH facts AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, coalesce(html, '') AS payload FROM pages),
kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS last FROM facts)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN last IS NOT NULL AND (page_id IS NULL OR page_id < last) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to
FROM kept
"""

_OP13 = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format(x="coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (
    SELECT lang, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS n) WHERE len(w) >= n)),
f AS (SELECT lang, n, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
words AS (SELECT lang, count(*) AS total FROM grams WHERE n = 1 GROUP BY 1),
cuts AS (
  SELECT lang, phrase, n, c AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, n)) AS k FROM f WHERE n > 1)),
scored AS (
  SELECT lang, cuts.phrase, a, l.c AS l, r.c AS r, total, k, CAST((CAST(1000 AS HUGEINT) * a * total) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM cuts JOIN f l USING (lang) JOIN f r USING (lang) JOIN words USING (lang) WHERE l.phrase = head AND r.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(c) AS most FROM (
    SELECT lang, c, m, w, unnest(range(1, n - m + 2)) AS i FROM (SELECT lang, n, c, string_split(phrase, ' ') AS w, unnest(range(2, n)) AS m FROM f WHERE n > 2)) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.most IS NULL OR 100 * i.most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, total AS n, score
FROM kept QUALIFY rank <= 2000
"""

ORACLES = {"op2_mix_sources": _OP2, "op3_line_dedup": _OP3, "op6_embedding_dedup": _OP6, "op7_decontaminate": _OP7, "op11_merkle_manifest": _OP11, "op12_warc": _OP12, "op13_collocations": _OP13}
