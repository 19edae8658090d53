"""DuckDB SQL of the queries that SQL can express."""

# Words are numbered, every run of 20 gets its text, and a run is removed if the same text
# starts at a smaller (doc_id, start).
BLOCK_ANCHORS = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), runs AS (
  SELECT r, doc_id, k, hash(list_slice(words, k, k + 19)) AS a, md5(array_to_string(list_slice(words, k, k + 19), ' ')) AS b
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM split)
), judged AS (
  SELECT r, k, min(doc_id) OVER (PARTITION BY a, b) < doc_id
      OR min(k) OVER (PARTITION BY a, b, r) < k AS again
  FROM runs
), gone AS (
  SELECT DISTINCT r, unnest(range(k, k + 20)) AS k FROM judged WHERE again
), words AS (
  SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS k FROM split
), kept AS (
  SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS text
  FROM words ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""

# Keys found in three documents or more go, except in the largest id that holds them.
BLOOM_LINES = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM split
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS text
  FROM keyed LEFT JOIN shared USING (key)
  WHERE shared.last IS NULL OR shared.last = doc_id GROUP BY r
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""

SORTED_LISTS = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM whole WHERE vec_id % 20 = 0) q JOIN whole c
    ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

BLOCK_NAMING = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), grouped AS (
  SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept FROM texts
)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM grouped
"""

# CRC-32, byte by byte over a table of 256 values, of the UTF-8 bytes of a text.
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t
)"""


def crc(text: str) -> str:
    bytes_ = (f"list_transform(range(0, octet_length(encode({text}))), "
              f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)")
    return (f"xor(list_reduce({bytes_}, lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1]), "
            "4294967295), 4294967295)")


# Every prefix of every rebuilt conversation; subtrees by listing each node's prefixes.
EULER_TRIE = rf"""
WITH {CRC_TABLE}, own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM (SELECT *, {crc("conv_id::VARCHAR")} % 4 AS h FROM own, crc_table) c
  LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), begun AS (
  SELECT conv_id, d, list_slice(turns, 1, d) AS p, d = len(turns) AS at_end
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '') AS ids
  FROM begun GROUP BY p, d
), weighed AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].t, '[^ 	-
]+')) END AS saved
  FROM nodes
), families AS (
  SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), parents AS (
  SELECT weighed.*, coalesce(n_children, 0) AS n_children FROM weighed LEFT JOIN families USING (p)
), subtrees AS (
  SELECT list_slice(p, 1, k) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM parents) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
       sha256(n.ids) AS ends_sha256
FROM parents n JOIN subtrees s USING (p) LEFT JOIN nodes u ON n.d > 0 AND u.p = list_slice(n.p, 1, n.d - 1)
"""

# Near words are equal less one letter each at the same place, or one less a letter is the other;
# letters are code points (the engine's own edit distance counts bytes).  Forms are followed to their end.
PARTENUM_SPELLING = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS told, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL
), told AS (
  SELECT run, k, {crc("told")} AS h FROM counted, crc_table
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(k)::BIGINT AS n
  FROM told GROUP BY 1 HAVING sum(k) >= 5 AND length(word) >= 6
), cuts AS (
  SELECT word, n, -1 AS k, word AS c FROM words
  UNION ALL SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) FROM (SELECT *, unnest(range(0, length(word))) AS k FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n
  FROM cuts a JOIN cuts b ON a.c = b.c AND a.word <> b.word AND (a.k = b.k OR a.k = -1 OR b.k = -1)
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS m, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS ahead FROM judged
  UNION ALL SELECT w.word, j.word, j.form FROM walk w JOIN judged j ON j.word = w.ahead
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, root FROM walk WHERE ahead IS NULL) USING (word)
"""

ORACLE: dict[str, str] = {
    "op4_block_anchors": BLOCK_ANCHORS,
    "op8_bloom_lines": BLOOM_LINES,
    "op10_sorted_lists": SORTED_LISTS,
    "op11_partenum_spelling": PARTENUM_SPELLING,
    "op12_block_naming": BLOCK_NAMING,
    "op13_euler_trie": EULER_TRIE,
}
