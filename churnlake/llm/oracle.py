"""DuckDB SQL for the operators that SQL can express, written from their contracts and not from their code."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
TOKENS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Label spreading over ``edge`` (a, b, both ways) from ``node`` (id): reach (id, comp), comp the least id reached.
REACH = """walk(id, comp) AS (SELECT id, id FROM node UNION SELECT e.b, w.comp FROM walk w JOIN edge e ON e.a = w.id WHERE w.comp < e.b),
reach AS (SELECT id, min(comp) AS comp FROM walk GROUP BY id)"""

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
WITH text_lines AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
masked AS (SELECT *, regexp_replace(trim(line), '[0-9]+', '<*>', 'g') AS m FROM text_lines),
toks AS (SELECT *, list_filter(regexp_split_to_array(m, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS tk FROM masked WHERE m <> ''),
lined AS (SELECT *, len(tk)::VARCHAR || chr(10) || array_to_string(tk[1:3], chr(10)) AS leaf FROM toks),
per_text AS (SELECT leaf, m, text, any_value(tk) AS tk, min(doc_id) AS doc_id FROM lined GROUP BY leaf, m, text),
lines AS (SELECT leaf, m, any_value(tk) AS tk, count(*) AS n FROM per_text GROUP BY leaf, m),
leaves AS (SELECT leaf, count(*) AS n_lines FROM lines GROUP BY leaf HAVING sum(n) >= 10),
live AS (SELECT l.* FROM lines l JOIN leaves v USING (leaf)),
words AS (SELECT leaf, m, n, unnest(range(4, len(tk) + 1)) AS pos, unnest(tk[4:]) AS token FROM live WHERE len(tk) > 3),
common AS (SELECT leaf, pos, token FROM words GROUP BY leaf, pos, token HAVING sum(n) >= 10),
split AS (SELECT w.leaf, w.m, list((w.pos, w.token) ORDER BY w.pos) FILTER (WHERE c.pos IS NOT NULL) AS pattern FROM words w LEFT JOIN common c USING (leaf, pos, token)
  GROUP BY w.leaf, w.m HAVING count(c.pos) >= count(*) * 0.5),
template AS (SELECT l.m, l.leaf, CASE WHEN s.m IS NULL THEN 'line' || chr(10) || l.m ELSE 'leaf' || chr(10) || l.leaf || chr(10) || s.pattern::VARCHAR END AS template FROM live l LEFT JOIN split s ON s.leaf = l.leaf AND s.m = l.m),
places AS (SELECT template, text, min(doc_id) AS doc_id FROM per_text p JOIN template t ON t.leaf = p.leaf AND t.m = p.m GROUP BY template, text),
support AS (SELECT template, arg_min(text, doc_id) AS keep FROM places GROUP BY template HAVING count(*) >= 10),
gone AS (SELECT l.doc_id, l.i FROM lined l JOIN template t ON t.leaf = l.leaf AND t.m = l.m JOIN support s USING (template) WHERE l.text <> s.keep),
kept AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS text FROM text_lines x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS n_chars,
  coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(c.n, 0) AS n_dropped
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)"""

ORACLES["op2_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
hashed AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM win),
twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM hashed JOIN twice USING (h)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

ORACLES["op3_mix_sources"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights, sum(cap) OVER o AS caps_to, sum(weight) OVER o AS weights_to FROM w
  WINDOW o AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, caps_to + cap / weight * (weights - weights_to) < total AS is_full FROM c),
g AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0::DOUBLE) AS caps_full, coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0.0::DOUBLE) AS weights_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, coalesce((total - caps_full) / nullif(weights - weights_full, 0), 0) * weight) END AS target FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0::DOUBLE) AS rate,
  ('0x' || substr(md5('20240601:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

ORACLES["op5_ngram_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) AS w FROM documents),
raw AS (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) >= 5 THEN len(w) - 3 WHEN len(w) > 0 THEN 2 ELSE 1 END)) AS i FROM d),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM raw),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
edge AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  WHERE 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
node AS (SELECT doc_id AS id FROM documents),
{REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, comp AS component_id FROM d LEFT JOIN size USING (doc_id) JOIN reach ON reach.id = d.doc_id"""

ORACLES["op6_chat_format"] = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
seq AS (SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
  length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE prev WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
FROM seq GROUP BY conv_id"""

ORACLES["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {TOKENS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {TOKENS}) AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)),
found AS (SELECT doc_id, s, n, win FROM place SEMI JOIN item USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found JOIN item USING (n, win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)"""

ORACLES["op8_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edge AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
node AS (SELECT vec_id AS id FROM embeddings),
{REACH}, degree AS (SELECT a AS id, count(*) AS n FROM edge GROUP BY a)
SELECT node.id AS vec_id, coalesce(n, 0) AS n_links, comp AS component_id, node.id = comp AS kept FROM node JOIN reach USING (id) LEFT JOIN degree USING (id)"""

#: Unsigned crc32 (reflected, 0xEDB88320) of an ASCII string expression: one list element a bit, the byte on its first.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * len({0})), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr({0}, (k // 8 + 1)::BIGINT, 1)) ELSE 0 END::UBIGINT)),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384::UBIGINT * (xor(c, x) & 1))), 4294967295::UBIGINT)"""


def _framed(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"({_framed(c)})" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN ({CRC32.format("doc_id::VARCHAR")}) % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} END AS changed FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM d),
tree AS (SELECT lang, 0 AS l, r AS i, leaf AS h, n FROM base
  UNION ALL SELECT lang, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, l, i // 2, n),
subroot AS (SELECT lang, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS l, r AS i, h, n FROM subroot
  UNION ALL SELECT l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY l, i // 2, n),
low AS (SELECT b.id, t.l, CASE WHEN t.i % 2 = 0 THEN coalesce(s.h, '') ELSE '' END AS post, CASE WHEN t.i % 2 = 1 THEN s.h ELSE '' END AS pre
  FROM base b JOIN tree t ON t.lang IS NOT DISTINCT FROM b.lang AND t.i = b.r >> t.l AND t.n > 1 LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM b.lang AND s.l = t.l AND s.i = xor(t.i, 1)),
high AS (SELECT b.id, 1000 + t.l AS l, CASE WHEN t.i % 2 = 0 THEN coalesce(s.h, '') ELSE '' END AS post, CASE WHEN t.i % 2 = 1 THEN s.h ELSE '' END AS pre
  FROM base b JOIN subroot u ON u.lang IS NOT DISTINCT FROM b.lang JOIN top t ON t.i = u.r >> t.l AND t.n > 1 LEFT JOIN top s ON s.l = t.l AND s.i = xor(t.i, 1)),
step AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l) AS k FROM (SELECT * FROM low UNION ALL SELECT * FROM high)),
fold AS (SELECT id, 1 AS k, coalesce(changed, leaf) AS h FROM base UNION ALL SELECT f.id, f.k + 1, sha256(s.pre || f.h || s.post) FROM fold f JOIN step s ON s.id = f.id AND s.k = f.k),
done AS (SELECT id, arg_max(h, k) AS h FROM fold GROUP BY id),
proof AS (SELECT id, sha256(string_agg(pre || post, '' ORDER BY k)) AS p FROM step GROUP BY id)
SELECT b.doc_id, b.leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, done.h AS folded_root,
  done.h = (SELECT h FROM top WHERE n = 1) AS verified FROM base b JOIN subroot u ON u.lang IS NOT DISTINCT FROM b.lang JOIN done USING (id) LEFT JOIN proof USING (id)"""

ORACLES["op13_periodic_runs"] = f"""
WITH h AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w0, ({CRC32.format("doc_id::VARCHAR")})::BIGINT AS h FROM documents),
cut AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM h),
d AS (SELECT id, doc_id, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(len(w0)), lambda i: w0[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w0) - a) // (3 + g % 8)) END + 1)::BIGINT]) END AS w FROM cut),
gram AS (SELECT id, i, hash(w[i + 1:i + 5]) AS f FROM (SELECT id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
pair AS (SELECT x.id, x.i, y.i - x.i AS p FROM gram x JOIN gram y ON x.id = y.id AND x.f = y.f AND x.i < y.i),
island AS (SELECT id, p, i, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS k FROM pair),
stretch AS (SELECT id, p, min(i) AS s, count(*) + 4 + p AS n FROM island GROUP BY id, p, k HAVING count(*) + 4 + p >= greatest(6, 4 * p)),
run AS (SELECT * FROM stretch r ANTI JOIN stretch q ON q.id = r.id AND q.p < r.p AND q.s <= r.s AND q.s + q.n >= r.s + r.n),
best AS (SELECT id, s, n, p FROM run QUALIFY row_number() OVER (PARTITION BY id ORDER BY n::DOUBLE / p DESC, s, p) = 1),
listed AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || p || chr(10), '' ORDER BY s, p) AS said FROM run GROUP BY id),
gone AS (SELECT DISTINCT id, unnest(range(s + p, s + n)) AS i FROM run),
kept AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d) ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, p AS period, 1000 * n // p AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (id) LEFT JOIN best USING (id) LEFT JOIN kept USING (id)"""
