"""DuckDB SQL for the queries that SQL can express on whole tables."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), t AS (
  SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)
), f AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM t WHERE g IS NOT NULL) WHERE c > 1
), n AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY r
), s AS (
  SELECT r, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY r
), l AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS kinds
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n - l.kinds, 0)::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
    coalesce(l.n, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM d LEFT JOIN s USING (r) LEFT JOIN l USING (r) LEFT JOIN n USING (r)
), b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (n_repeat_words * 2 > n_words)::INT + 4 * (n_symbols * 2 > n_words)::INT + 8 * (n_dup_lines * 2 > n_lines)::INT
    + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 32 * (n_capitals * 2 > word_chars)::INT)::BIGINT AS failed
  FROM m
)
SELECT *, failed % 4 <> 0 AS base_failed, failed = 0 AS kept FROM b
"""

ABLATION = f"""
WITH book AS ({OP1}), rules(rule, bit) AS (
  VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32)
)
SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed = bit) AS n_only,
  count(*) FILTER (WHERE failed = 0) AS n_kept, count(*) FILTER (WHERE failed = 0 OR failed = bit) AS n_kept_without
FROM book, rules GROUP BY rule
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, size, array_to_string(ws[p : p + size - 1], ' ') AS key
  FROM (SELECT item, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)
), places AS (
  SELECT r, size, unnest(range(1, len(ws) - size + 2)) AS p, ws FROM d, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size
), found AS (
  SELECT DISTINCT r, p, size, item FROM (SELECT r, p, size, array_to_string(ws[p : p + size - 1], ' ') AS key FROM places) JOIN windows USING (size, key)
), hit AS (
  SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(p, p + size)) AS w FROM (SELECT DISTINCT r, p, size FROM found)) GROUP BY r
), held AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n > 0 AND 20 * hit.n >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
), lowest AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, lowest.y), d.doc_id) AS component_id,
  d.doc_id <= coalesce(lowest.y, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest ON lowest.x = d.doc_id
"""


def _crc_step(i: int) -> int:
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text, four bits at a time."""
    table = ", ".join(f"{_crc_step(i)}::BIGINT" for i in range(16))
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [(ascii(ch) & 15)::BIGINT, (ascii(ch) >> 4)::BIGINT]))"
    step = f"lambda a, x: xor(([{table}])[(xor(a, x) & 15) + 1], a >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295::BIGINT)"


OP11 = rf"""
WITH t AS (
  SELECT conv_id::BIGINT AS c, turn, md5(length(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM t
), convs AS (
  SELECT c, c - c % 20 AS b, ({crc32_sql("c::VARCHAR")}) % 4 AS h, n FROM (SELECT c, count(*) AS n FROM own GROUP BY c)
), turns AS (
  SELECT v.c, o.p AS i, o.k, o.w FROM convs v JOIN own o ON o.c = v.b AND o.p <= v.h
  UNION ALL
  SELECT v.c, v.h + o.p AS i, o.k, o.w FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h
), lists AS (
  SELECT v.c, coalesce(l.ks, []) AS ks, coalesce(l.ws, []) AS ws
  FROM convs v LEFT JOIN (SELECT c, list(k ORDER BY i) AS ks, list(w ORDER BY i) AS ws FROM turns GROUP BY c) l USING (c)
), paths AS (
  SELECT c, len(ks) AS n, ks, ws, unnest(range(0, len(ks) + 1)) AS d FROM lists
), nodes AS (
  SELECT d, list_slice(ks, 1, d) AS key, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(ws[d]), 0) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM paths GROUP BY d, list_slice(ks, 1, d)
), family AS (
  SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.key = list_slice(n.key, 1, n.d - 1)
  LEFT JOIN (SELECT d - 1 AS d, list_slice(key, 1, d - 1) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL) k ON k.d = n.d AND k.key = n.key
), below AS (
  SELECT up, list_slice(key, 1, up) AS key, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM family) GROUP BY up, list_slice(key, 1, up)
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM family f JOIN below b ON b.up = f.d AND b.key = f.key
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), sizes AS (
  SELECT doc_id, r, len(ws) AS n, sum(len(ws)) OVER ()::BIGINT AS l, count(*) OVER () AS nn FROM d WHERE len(ws) > 0
), tf AS (
  SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark WHERE item_id IS NOT NULL
), df AS (
  SELECT w, count(*) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY w
), impacts AS (
  SELECT doc_id, r, w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))) AS part
  FROM tf JOIN df USING (w) JOIN sizes USING (r)
), scores AS (
  SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM q JOIN impacts USING (w) WHERE doc_id IS NOT NULL GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op1_quality_rules": OP1, "rule_ablation": ABLATION, "op4_decontamination": OP4, "op5_near_duplicates": OP5,
    "op11_prefix_tree": OP11, "op12_ranked_search": OP12,
}
