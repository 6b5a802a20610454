"""DuckDB SQL for the registered queries that SQL can express."""

from ticksmith.llm import conversation_trie, decontaminate, mixing, spelling, substring_dedup, topk, warc

_OP7 = f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce('s' || source, 'n') AS k, sum(coalesce(length(text), 0)) AS chars
  FROM documents GROUP BY 1 HAVING sum(coalesce(length(text), 0)) > 0),
total AS (SELECT sum(chars)::DOUBLE AS total, sum(pow(chars, {mixing.TEMPERATURE})) AS weights FROM sizes),
rates AS (SELECT k, pow(chars, {mixing.TEMPERATURE}) / weights * total / chars AS rate FROM sizes, total),
means AS (SELECT k, greatest(1, ceil(rate / {mixing.PIECE}))::INT AS pieces,
                 rate / greatest(1, ceil(rate / {mixing.PIECE})) AS mean FROM rates),
steps(k, mean, i, p, c) AS (
  SELECT k, mean, 0, exp(-mean), exp(-mean) FROM means
  UNION ALL
  SELECT k, mean, i + 1, p * mean / (i + 1), c + p * mean / (i + 1) FROM steps WHERE i + 1 < {mixing.PLACES}),
cdfs AS (SELECT k, list(c ORDER BY i) AS cdf FROM steps GROUP BY k),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, pieces + 1), lambda j: len(list_filter(cdf, lambda c: c <
    (('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) || ':' || j)[1:13])::BIGINT::DOUBLE + 0.5)
    / {2**52}.0::DOUBLE)))) AS n
  FROM documents d JOIN means m ON m.k = coalesce('s' || source, 'n') JOIN cdfs USING (k)),
copies AS (SELECT *, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, copy,
       ('0x' || md5('{mixing.SEED}:order:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) || ':' || copy)[1:13])::BIGINT AS shuffle_key
FROM copies
"""

_OP1 = f"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS code FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.code, c.code)::BIGINT AS score
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_OP4 = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY html) END AS first FROM payloads)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
"""

_OP9 = f"""
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, b, unnest(range(0, n - {substring_dedup.MIN_BYTES - 1})) AS pos FROM texts WHERE n >= {substring_dedup.MIN_BYTES}),
windows AS (SELECT doc_id, pos, md5(array_slice(b, pos + 1, pos + {substring_dedup.MIN_BYTES})) AS s FROM places),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS nth FROM windows) x WHERE nth > 1),
marked AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {substring_dedup.MIN_BYTES} THEN 0 ELSE 1 END AS new FROM later),
numbered AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked),
spans AS (SELECT doc_id, min(pos) AS lo, max(pos) + {substring_dedup.MIN_BYTES} AS hi FROM numbered GROUP BY doc_id, span),
edges AS (SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, n, n FROM texts),
pieces AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo, hi) AS kept_from FROM edges),
kept AS (
  SELECT p.doc_id, sum(hi - lo)::BIGINT AS n_removed, (count(*) - 1)::BIGINT AS n_spans,
         string_agg(hex(array_slice(b, kept_from + 1, lo)), '' ORDER BY lo, hi) AS hexed
  FROM pieces p JOIN texts t USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(hexed)) AS kept_sha256 FROM kept JOIN texts USING (doc_id)
"""

ORACLE: dict[str, str] = {"op1_segment_bounds": _OP1, "op4_warc_salvage": _OP4, "op7_poisson_mix": _OP7,
                          "op9_interval_tree_dedup": _OP9}

# CRC-32 (polynomial 0xEDB88320) byte by byte: a table of 256 entries, then one step a byte.
def _crc_table() -> str:
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: xor(x >> 1, (x & 1) * 3988292384))"
    return table


def _crc32(octets: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
            "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")


_OP11 = f"""
WITH crc AS (SELECT {_crc_table()} AS tab),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(t ORDER BY i) AS l FROM own GROUP BY c),
heads AS (SELECT c, l, {_crc32("list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % {conversation_trie.SHARED} AS h FROM lists, crc),
convs AS (
  SELECT a.c, list_concat(coalesce(b.l[1:a.h::INT], []), a.l[a.h::INT + 1:]) AS l
  FROM heads a LEFT JOIN lists b ON b.c = a.c - a.c % {conversation_trie.GROUP}),
through AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM convs),
members AS (SELECT c, d, l[1:d::INT] AS node, len(l) = d AS ends FROM through),
nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(any_value(node[d].text)) END AS saved
  FROM members GROUP BY node, d),
children AS (SELECT node[1:d::INT - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (node)),
above AS (SELECT node, saved, n_children, unnest(range(0, d + 1)) AS up FROM full_nodes),
sums AS (SELECT node[1:up::INT] AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (node) LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[1:n.d::INT - 1]
"""

_UPPER_TO_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP12 = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_crc_table()} AS tab),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, {_UPPER_TO_LOWER}), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r
  FROM documents),
counted AS (SELECT d, r, count(*) AS n, string_split(r, '') AS cs FROM runs WHERE length(r) >= {spelling.MIN_CHARS} GROUP BY d, r),
hashed AS (
  SELECT r, n, cs, {_crc32("flatten(list_transform(list_concat(string_split(d, ''), [':'], cs), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))")} AS h
  FROM counted, crc),
typed AS (
  SELECT CASE WHEN h % {spelling.TYPO_EVERY} = 0 THEN list_aggregate(list_concat(cs[1:(h % length(r))::INT], cs[(h % length(r))::INT + 2:]), 'string_agg', '') ELSE r END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
cuts AS MATERIALIZED (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
linked AS (
  SELECT a.word AS x, b.word AS y FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.cut),
seen AS (
  SELECT x, count(*) AS n_near, first(y ORDER BY n DESC, y) AS best, max(n) AS m
  FROM (SELECT DISTINCT x, y FROM linked) JOIN words ON word = y GROUP BY x),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * n THEN best END AS form, CASE WHEN m >= {spelling.RATIO} * n THEN m END AS form_n
  FROM words LEFT JOIN seen ON x = word),
steps AS (
  SELECT word, word AS here, 0 AS k FROM formed
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN formed f ON f.word = s.here WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM formed f JOIN (SELECT word, max_by(here, k) AS root FROM steps GROUP BY word) r ON r.word = f.word
"""

_OP13 = f"""
WITH doc_words AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, doc_id,
         coalesce(regexp_extract_all(translate(text, {_UPPER_TO_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
item_words AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, {_UPPER_TO_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
wins AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i::INT:(i + n - 1)::INT], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least({decontaminate.WINDOW}, len(w)) AS n FROM item_words) WHERE n > 0)),
places AS (
  SELECT uid, n, i, array_to_string(w[i::INT:(i + n - 1)::INT], ' ') AS win
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
occurs AS MATERIALIZED (SELECT DISTINCT p.uid, p.i, p.n, k.item_id FROM places p JOIN wins k ON k.win = p.win AND k.n = p.n),
hits AS (SELECT uid, count(DISTINCT place) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS place FROM occurs) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT uid, item_id::VARCHAR AS id FROM occurs WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (uid) LEFT JOIN items USING (uid)
"""

ORACLE |= {"op11_prefix_trie": _OP11, "op12_spelling_chunks": _OP12, "op13_prefix_decontamination": _OP13}
