"""The text operators' registered queries, and SQL for those that SQL can express."""

from tallyreel.llm import storage
from tallyreel.llm.credentials import op12_secret_scan
from tallyreel.llm.languages import op10_language_id
from tallyreel.llm.licenses import op3_license_scan
from tallyreel.llm.merkle import op6_document_fingerprints
from tallyreel.llm.near import op8_near_duplicates
from tallyreel.llm.passages import op2_substring_dedup
from tallyreel.llm.periods import op11_periodic_runs
from tallyreel.llm.pieces import op1_sentencepiece
from tallyreel.llm.ranking import op13_ranked_search
from tallyreel.llm.suffixes import op4_suffix_array_dedup
from tallyreel.llm.tiling import op9_decontaminate
from tallyreel.llm.toolcalls import op5_chat_format
from tallyreel.llm.urls import op7_url_filter

LLM_QUERIES = {
    query.__name__: storage.with_package(query)
    for query in (
        op1_sentencepiece,
        op2_substring_dedup,
        op3_license_scan,
        op4_suffix_array_dedup,
        op5_chat_format,
        op6_document_fingerprints,
        op7_url_filter,
        op8_near_duplicates,
        op9_decontaminate,
        op10_language_id,
        op11_periodic_runs,
        op12_secret_scan,
        op13_ranked_search,
    )
}

LLM_ORACLES = {
    "op2_substring_dedup": """
WITH words AS (
    SELECT doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS p FROM places WHERE i + 12 <= len(w)
), firsts AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) < doc_id AS old FROM windows
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM firsts WHERE old
), kept AS (
    SELECT p.doc_id, count(*) AS n_words, count(g.i) AS n_removed,
           string_agg(CASE WHEN g.i IS NULL THEN p.w[p.i] END, ' ' ORDER BY p.i) AS kept
    FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY 1
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op4_suffix_array_dedup": """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
    SELECT doc_id, unnest(range(0, length(h) // 2, 200)) AS o, h FROM texts
), cuts AS (
    SELECT doc_id, o, substr(h, 2 * o + 1, 498) AS h FROM blocks
), places AS (
    SELECT doc_id, o + j AS i, substr(h, 2 * j + 1, 100) AS s, substr(h, 2 * j + 1, 2) AS b
    FROM (SELECT doc_id, o, h, unnest(range(0, least(200, length(h) // 2))) AS j FROM cuts)
), strings AS (
    SELECT doc_id, i, s FROM places WHERE length(s) = 100
), olds AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM strings) WHERE f < doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM olds
), bytes AS (
    SELECT p.doc_id, p.i, p.b, g.i IS NOT NULL AS gone,
           lag(g.i IS NOT NULL, 1, false) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS before
    FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
), kept AS (
    SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed,
           count(*) FILTER (gone AND NOT before) AS n_spans,
           string_agg(CASE WHEN NOT gone THEN b END, '' ORDER BY i) AS kept
    FROM bytes GROUP BY 1
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op8_near_duplicates": """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
               lambda w: w <> '') AS w
    FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM places
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(doc_id, r) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON a = r
), roots AS (
    SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
""",
    "op6_document_fingerprints": """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) // 3 AS third,
           coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
                    first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text
    FROM documents
), kinds AS (
    SELECT doc_id, 0 AS kind, text AS t FROM texts
    UNION ALL SELECT doc_id, 1, substr(text, 1, length(text) - third) || substr(next_text, 1, third) FROM texts
    UNION ALL SELECT doc_id, 2, next_text FROM texts
), trees AS (
    SELECT doc_id, kind, t,
           list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
               lambda p: regexp_extract_all(p,
                   '[ \t\x0B\f\r]*(?:[^ \t\x0B\f\r]+[ \t\x0B\f\r]*){1,4}|[ \t\x0B\f\r]+'))) AS leaves
    FROM kinds
), nodes AS (
    SELECT doc_id, kind, t, list_distinct(flatten(flatten(leaves))) AS blocks,
           list_transform(leaves, lambda s: list_transform(s, lambda p:
               sha256(coalesce(array_to_string(list_transform(p, lambda b: sha256(b)), ''), '')))) AS nodes
    FROM trees
), roots AS (
    SELECT *, sha256(array_to_string(list_transform(nodes,
               lambda n: sha256(array_to_string(n, ''))), '')) AS root, flatten(nodes) AS flat,
           coalesce(list_sum(list_transform(blocks, lambda b: length(b))), 0) AS chars
    FROM nodes
), near AS (
    SELECT a.doc_id, b.kind, a.t, b.t AS other, a.root, b.root AS other_root,
           CASE WHEN a.root = b.root THEN 1.0::DOUBLE
                WHEN a.chars + b.chars = 0 THEN 0.0::DOUBLE
                ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(a.blocks, b.blocks),
                         lambda x: length(x))), 0) / (a.chars + b.chars)
           END AS near,
           list_filter(range(1, greatest(len(a.flat), len(b.flat)) + 1),
               lambda i: a.flat[i] IS DISTINCT FROM b.flat[i]) AS edited
    FROM roots a JOIN roots b ON a.doc_id = b.doc_id AND a.kind = 0 AND b.kind > 0
)
SELECT e.doc_id, length(e.t) AS n_chars, sha256(e.other) AS edited_sha256, e.root AS fingerprint,
       e.other_root AS edited_fingerprint, e.near AS near_edited, n.near AS near_next,
       CAST(len(e.edited) AS BIGINT) AS n_edited, coalesce(e.edited[1], 0)::BIGINT AS edited_from
FROM near e JOIN near n ON e.doc_id = n.doc_id AND e.kind = 1 AND n.kind = 2
""",
    "op5_chat_format": """
WITH RECURSIVE named AS (
    SELECT conv_id, turn, role, text, split_part(text, chr(10), 1) AS line,
           conv_id % 3 AS tool, conv_id % 7 = 0 AS wrong, conv_id % 11 = 0 AS more,
           conv_id || '-' || CASE WHEN conv_id % 5 = 3 AND (turn // 2) % 2 = 1 THEN turn - 2 ELSE turn END AS own,
           conv_id || '-' || CASE WHEN conv_id % 5 = 3 AND ((turn - 1) // 2) % 2 = 1 THEN turn - 3
                                  ELSE turn - 1 END AS before,
           CASE conv_id % 5 WHEN 0 THEN turn - 2 WHEN 1 THEN turn + 2
                            WHEN 2 THEN CASE WHEN (turn // 2) % 2 = 1 THEN turn - 2 ELSE turn + 2 END
                            WHEN 3 THEN turn + 4
                            ELSE CASE WHEN (turn // 2) % 2 = 1 THEN turn ELSE turn + 2 END END AS referred
    FROM conversations
), turns AS (
    SELECT *, role = 'assistant' AS is_call, role = 'user' AND turn > 0 AS is_result,
           CASE WHEN referred >= 0 THEN conv_id || '-' || referred END AS after,
           CASE WHEN role = 'assistant' THEN own WHEN role = 'user' AND turn > 0 THEN before END AS call_id
    FROM named
), firsts AS (
    SELECT call_id, min(turn) AS turn, arg_min(after, turn) AS after FROM turns WHERE is_call GROUP BY 1
), results AS (
    SELECT call_id, max(turn) AS turn FROM turns WHERE is_result GROUP BY 1
), edges AS (
    SELECT c.call_id, c.turn, r.call_id AS needed, r.turn AS result_turn
    FROM firsts c JOIN firsts d ON d.call_id = c.after JOIN results r ON r.call_id = c.after
), placed AS (
    SELECT call_id, turn AS at, 0 AS depth FROM firsts WHERE call_id NOT IN (SELECT call_id FROM edges)
    UNION ALL
    SELECT e.call_id, greatest(p.at, e.result_turn, e.turn),
           CASE WHEN greatest(p.at, e.result_turn) < e.turn THEN 0
                WHEN p.at >= e.result_turn THEN p.depth + 2 ELSE 1 END
    FROM placed p JOIN edges e ON e.needed = p.call_id
), known AS (
    SELECT f.call_id, f.turn, coalesce(p.at, f.turn) AS at, coalesce(p.depth, 0) AS depth,
           p.call_id IS NULL AS cyclic, r.call_id IS NOT NULL AS answered
    FROM firsts f LEFT JOIN placed p ON p.call_id = f.call_id LEFT JOIN results r ON r.call_id = f.call_id
), made AS (
    SELECT conv_id, turn,
           '{' || concat_ws(',',
               CASE WHEN tool = 0 AND wrong THEN '"Limit":"ten"' END,
               CASE WHEN after IS NOT NULL THEN '"after":{"$ref":"' || after || '"}' END,
               CASE WHEN more THEN '"extra":true' END,
               CASE WHEN tool = 0 AND NOT wrong THEN '"limit":' || turn END,
               CASE WHEN tool = 1 THEN '"mode":"' || CASE WHEN wrong THEN 'pdf' ELSE 'text' END || '"' END,
               CASE WHEN tool = 1 THEN '"page":' || to_json(line) END,
               CASE WHEN tool = 0 THEN '"query":' || to_json(line) END,
               CASE WHEN tool = 2 AND NOT wrong THEN '"scale":' || CAST(turn / 2.0::DOUBLE AS VARCHAR) END,
               CASE WHEN tool = 2 THEN '"text":' || to_json(line) END) || '}' AS arguments,
           concat_ws('; ',
               CASE WHEN wrong THEN ['Limit: unknown', 'mode: not a listed value', 'scale: missing'][tool + 1] END,
               CASE WHEN more THEN 'extra: unknown' END) AS faults
    FROM turns WHERE is_call
)
SELECT t.conv_id, t.turn, CASE WHEN t.is_result THEN 'tool' ELSE t.role END AS role, t.call_id, t.is_call,
       CASE WHEN t.is_call AND k.turn = t.turn THEN k.at
            WHEN t.is_result AND k.turn IS NOT NULL THEN greatest(t.turn, k.at) ELSE t.turn END AS at,
       CAST(CASE WHEN t.is_call AND k.turn = t.turn THEN k.depth
                 WHEN t.is_result AND k.at >= t.turn THEN k.depth + 1 ELSE 0 END AS BIGINT) AS depth,
       CASE WHEN t.call_id IS NULL THEN 'plain'
            WHEN t.is_result THEN CASE WHEN k.turn IS NULL THEN 'orphan' ELSE 'linked' END
            WHEN k.turn < t.turn THEN 'repeated'
            WHEN k.cyclic THEN 'cycle'
            WHEN k.answered THEN 'answered' ELSE 'unanswered' END AS status,
       '{"content":' || to_json(t.text) || ',"role":"' || CASE WHEN t.is_result THEN 'tool' ELSE t.role END || '"'
           || CASE WHEN t.is_call
                   THEN ',"tool_calls":[{"arguments":' || m.arguments || ',"id":"' || t.own || '","name":"'
                        || ['search', 'open', 'measure'][t.tool + 1] || '"}]'
                   WHEN t.is_result THEN ',"tool_call_id":"' || t.before || '"'
                   ELSE '' END || '}' AS message,
       coalesce(m.faults, '') AS faults
FROM turns t
LEFT JOIN known k ON k.call_id = t.call_id
LEFT JOIN made m ON t.is_call AND m.conv_id = t.conv_id AND m.turn = t.turn
""",
    "op11_periodic_runs": """
WITH texts AS (
    SELECT row_number() OVER () AS id, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
           list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda crc, c: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)),
               4294967295) AS crc
    FROM documents
), placed AS (
    SELECT id, doc_id, w, len(w) AS n, xor(crc, 4294967295) // 10 AS g,
           len(w) > 0 AND xor(crc, 4294967295) % 10 = 0 AS chosen
    FROM texts
), planted AS (
    SELECT id, doc_id, n,
           CASE WHEN chosen THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < g % n THEN i
                ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END]) ELSE w END AS w
    FROM placed
), places AS (
    SELECT id, unnest(range(0, n - 5)) AS i, w FROM planted WHERE n >= 12
), grams AS (
    SELECT id, i, array_to_string(list_slice(w, i + 1, i + 6), ' ') AS s FROM places
), pairs AS (
    SELECT x.id, y.i - x.i AS q, x.i FROM grams x JOIN grams y ON x.id = y.id AND x.s = y.s AND x.i < y.i
), diagonals AS (
    SELECT id, q, min(i) AS start, count(*) + 5 AS matched
    FROM (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS d FROM pairs)
    GROUP BY id, q, d HAVING count(*) + 5 >= q
), runs AS (
    SELECT id, start, matched + q AS length, min(q) AS period
    FROM diagonals WHERE matched + q >= 12 GROUP BY 1, 2, 3
), lists AS (
    SELECT id, count(*) AS n_runs,
           arg_max({'s': start, 'n': length, 'q': period}, [length, -start, -period]) AS best,
           string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY id
), gone AS (
    SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs
), words AS (
    SELECT id, unnest(range(0, n)) AS i, unnest(w) AS word FROM planted
), kept AS (
    SELECT id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (id, i) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period,
       1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM planted LEFT JOIN lists USING (id) LEFT JOIN kept USING (id)
""",
    "op13_ranked_search": """
WITH texts AS (
    SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), sizes AS (
    SELECT id, doc_id, len(w) AS n, count(*) FILTER (len(w) > 0) OVER () AS docs, sum(len(w)) OVER () AS terms
    FROM texts
), counts AS (
    SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(w) AS t FROM texts) GROUP BY 1, 2
), wanted AS (
    SELECT item, item_id, t, count(*) AS q
    FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)
    GROUP BY 1, 2, 3
), impacts AS (
    SELECT c.t, s.doc_id, s.id, s.docs, count(*) OVER (PARTITION BY c.t) AS df,
           (1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + CAST((25 * s.n * s.docs) // s.terms AS BIGINT))) AS impact
    FROM counts c JOIN sizes s USING (id)
), scores AS (
    SELECT item, item_id, doc_id, id,
           sum(q * CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * impact) AS score
    FROM wanted JOIN impacts USING (t) WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3, 4
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
""",
}
