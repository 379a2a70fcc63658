"""SQL for the queries whose results SQL can express over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    "op8_benchmark_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
known AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, w[p:p + least(10, len(w)) - 1] AS words
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)
),
texts AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM known),
places AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM texts, sizes WHERE len(w) >= size),
hits AS (
    SELECT r, p, known.size, item_id FROM places JOIN known ON known.size = places.size AND known.words = w[p:p + places.size - 1]
),
per_row AS (
    SELECT r, count(DISTINCT word) AS n_hit, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
    FROM (SELECT r, item_id, unnest(range(p, p + size)) AS word FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN per_row USING (r)
""",
    "op9_warc_salvage": """
WITH rows AS (
    SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS digest FROM pages
),
largest AS (SELECT digest, max(page_id) AS top FROM rows WHERE octet_length(payload) >= 1000 GROUP BY digest),
told AS (
    SELECT rows.*, top, octet_length(payload) >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS again
    FROM rows LEFT JOIN largest USING (digest)
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN top END AS refers_to, url
FROM told
""",
    "op10_reply_trees": r"""
WITH marks AS (SELECT '</s>[INST] ok [/INST]' AS text),
turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', text FROM marks
    UNION ALL SELECT -7, 1, 'assistant', text FROM marks
),
parts AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS body, text,
           10 + 9 + 5 + length(regexp_replace(coalesce(text, ''), '[<\[\\]', 'xx', 'g'))
           + CASE WHEN role IS NULL THEN 2 ELSE length(regexp_replace(role, '[<\[\\\n]', 'xx', 'g')) END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || body || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(body)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
""",
    "op11_ranked_search": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
sized AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
asked AS (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark),
questions AS (SELECT q, item_id, term, count(*) AS times FROM asked GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM questions),
tf AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM sized) SEMI JOIN vocabulary USING (term)
    GROUP BY ALL
),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
    FROM tf, totals GROUP BY term, n_docs
),
parts AS (
    SELECT r, doc_id, term,
           (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS impact
    FROM tf, totals
),
scores AS (
    SELECT q, item_id, r, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score
    FROM questions JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
""",
    "op12_exact_dedup": """
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER same = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
""",
    "op13_prefix_trie": """
WITH ordered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
           octet_length(encode(coalesce(text, ''))) AS size
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, list(key ORDER BY place) AS keys, list(size ORDER BY place) AS sizes FROM ordered GROUP BY conv_id),
digits AS (SELECT conv_id, unnest(range(1, length(CAST(conv_id AS VARCHAR)) + 1)) AS i FROM convs),
bytes AS (
    SELECT conv_id, list(CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT) ORDER BY i) AS b FROM digits GROUP BY conv_id
),
taken AS (
    SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda crc, x:
        list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    )) % 9 AS h
    FROM bytes
),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(o.keys, [])[1:h], c.keys[h + 1:]) AS keys,
           list_concat(coalesce(o.sizes, [])[1:h], c.sizes[h + 1:]) AS sizes
    FROM convs c JOIN taken USING (conv_id) LEFT JOIN convs o ON o.conv_id = c.conv_id - c.conv_id % 5
),
steps AS (SELECT conv_id, keys, sizes, unnest(range(0, len(keys) + 1)) AS depth FROM rebuilt),
prefixes AS (
    SELECT conv_id, depth, sha256(array_to_string(keys[1:depth], ',')) AS node, sizes[depth] AS size, depth = len(keys) AS last FROM steps
),
nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth
),
placed AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM placed GROUP BY parent),
counted AS (SELECT placed.*, coalesce(n_children, 0) AS n_children FROM placed LEFT JOIN kids USING (node)),
below AS (
    SELECT p.node, count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum((c.n_convs - 1) * c.size) AS BIGINT) AS saved_tokens
    FROM counted c JOIN prefixes p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.node
)
SELECT c.conv_id, c.depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (node) LEFT JOIN nodes up ON up.node = c.parent
""",
}
