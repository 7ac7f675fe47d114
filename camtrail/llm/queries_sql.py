"""SQL for DuckDB that gives the rows of those queries which SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Texts are told apart by their sorted shingles; pairs of such sets are joined by shingle; components by reachability.
NGRAM_JACCARD = rf"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))))
  END AS shingles FROM texts
), classes AS MATERIALIZED (
  SELECT row_number() OVER () AS class, shingles, len(shingles) AS n, least FROM (
    SELECT shingles, min(doc_id) AS least FROM sets WHERE len(shingles) > 0 GROUP BY shingles
  )
), entries AS MATERIALIZED (
  SELECT class, n, unnest(shingles) AS shingle FROM classes
), links AS MATERIALIZED (
  SELECT a.class AS one, b.class AS other FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.class <> b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT class, class AS other FROM classes
  UNION SELECT reached.class, links.other FROM reached JOIN links ON reached.other = links.one
), components AS (
  SELECT reached.class, min(c.least) AS least FROM reached JOIN classes c ON c.class = reached.other GROUP BY reached.class
)
SELECT doc_id, CAST(len(sets.shingles) AS BIGINT) AS n_shingles, coalesce(components.least, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.shingles = classes.shingles LEFT JOIN components ON components.class = classes.class
"""

#: Windows of items and of documents, of 13 words or an item's fewer, are joined whole.
DECONTAMINATE = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS MATERIALIZED (
  SELECT CAST(item_id AS VARCHAR) AS item, words, least(len(words), 13) AS size FROM (
    SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL
  ) WHERE len(words) > 0
), windows AS MATERIALIZED (
  SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS part FROM (
    SELECT item, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM items
  )
), places AS (
  SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
), hits AS MATERIALIZED (
  SELECT row_id, i, p.size, item FROM (SELECT row_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS part FROM places) p
  JOIN windows USING (size, part)
), covered AS (
  SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row_id
), named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)
"""

#: Bytes are written as two digits each, so that strings of 100 bytes are substrings of 200 characters.
REPEATED_BYTES = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), strings AS (
  SELECT row_id, doc_id, i, substr(digits, 2 * i + 1, 200) AS string FROM (
    SELECT row_id, doc_id, digits, unnest(range(0, length(digits) // 2 - 99)) AS i FROM docs
  )
), repeats AS (
  SELECT row_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, row_id, i) > 1
), marked AS (
  SELECT row_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM repeats
), numbered AS (
  SELECT row_id, i, sum(opens) OVER (PARTITION BY row_id ORDER BY i) AS run FROM marked
), runs AS MATERIALIZED (
  SELECT row_id, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY row_id, run
), pieces AS (
  SELECT row_id, a, z, coalesce(lag(z) OVER (PARTITION BY row_id ORDER BY a), 0) AS after FROM runs
), removed AS (
  SELECT row_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(digits, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS kept
  FROM pieces JOIN docs USING (row_id) GROUP BY row_id
)
SELECT doc_id, CAST(length(digits) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(digits, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN removed USING (row_id)
"""

EXACT_TOP_K = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

WEB_ARCHIVES = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), placed AS (
  SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS first_id FROM payloads WINDOW same AS (PARTITION BY html ORDER BY page_id NULLS LAST)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND place > 1 THEN first_id END AS refers_to
FROM placed
"""

LEXICAL_SEARCH = rf"""
WITH words AS MATERIALIZED (
  SELECT row_id, doc_id, unnest(words) AS term, len(words) AS n FROM (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
  )
), postings AS MATERIALIZED (
  SELECT row_id, doc_id, term, n, count(*) AS tf FROM words GROUP BY ALL
), collection AS (
  SELECT count(DISTINCT row_id) AS docs, count(*) AS terms FROM words
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), collection
), impacts AS (
  SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact FROM postings JOIN weights USING (term), collection
), items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark
), wanted AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(words) AS term FROM items) GROUP BY ALL
), scored AS (
  SELECT item, item_id, row_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL HAVING sum(times * impact) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored
QUALIFY rank <= 20
"""

#: The CRC is taken bit by bit; a prefix is its turns' digests, of 32 digits each.
PREFIX_TRIE = """
WITH marked AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(mark := mark, size := size) ORDER BY turn NULLS FIRST, mark) AS turns,
    CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS BIGINT) AS h
  FROM marked GROUP BY conv_id
), sequences AS MATERIALIZED (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), members AS (
  SELECT conv_id, depth, array_to_string(list_transform(turns[1:depth], lambda t: t.mark), '') AS prefix, len(turns) = depth AS ending, CASE WHEN depth > 0 THEN turns[depth].size ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM sequences)
), nodes AS MATERIALIZED (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own_saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix
), children AS MATERIALIZED (
  SELECT depth - 1 AS depth, left(prefix, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), summed AS (
  SELECT up AS depth, left(prefix, 32 * up) AS prefix, sum(own_saved) AS saved, sum(leaf) AS n_leaves FROM (
    SELECT n.prefix, n.own_saved, CASE WHEN c.depth IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, n.depth + 1)) AS up FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.prefix = c.prefix
  ) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s ON n.depth = s.depth AND n.prefix = s.prefix LEFT JOIN children c ON n.depth = c.depth AND n.prefix = c.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = left(n.prefix, 32 * (n.depth - 1))
"""

ORACLE_SQL = {
    "op1_ngram_jaccard": NGRAM_JACCARD,
    "op6_decontaminate": DECONTAMINATE,
    "op7_exact_top_k": EXACT_TOP_K,
    "op8_repeated_bytes": REPEATED_BYTES,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_web_archives": WEB_ARCHIVES,
    "op13_prefix_trie": PREFIX_TRIE,
}
