"""DuckDB SQL for the queries whose results SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest reachable id over links l(x, y): only ids above the start are walked through.
_REACH = """e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, c) AS (SELECT id, id FROM ids UNION SELECT e.y, r.c FROM r JOIN e ON r.id = e.x WHERE r.c < e.y),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"""

OP4 = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93e0),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE e.x = m.id) AS n_links, component_id, component_id = id AS kept FROM m"""

OP5 = """WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, strlen(d.h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * i::INT + 1, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON d.h = f.h"""

OP9 = f"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
{_REACH}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = id AS kept FROM m LEFT JOIN n ON n.doc_id = m.id"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM s),
m AS (SELECT r, doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM s, g),
c AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50"""


def op10(controls: tuple[str, ...], mark: str, around: int) -> str:
    """With the template's control strings and the characters it puts around role and text."""
    escaped = "text"
    for c in controls:
        escaped = f"replace({escaped}, '{c}', '{c[0]}{mark}{c[1:]}')"
    said = "</s>[INST] ok [/INST]"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
u AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({around} + length(role) + length({escaped}))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM u GROUP BY conv_id"""


def _assigned(n: int) -> str:
    """a<n>: each part's entry of the codebook b<n>, and the distance."""
    return f"""d{n} AS (SELECT r, part, min({{'d': list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS m
  FROM p JOIN b{n} USING (part) GROUP BY r, part), a{n} AS (SELECT r, part, m.d AS d, m.e AS e FROM d{n})"""


def _means(n: int) -> str:
    """b<n + 1>: the floored means of the parts, or the entry before where it has none."""
    return f"""t{n} AS (SELECT part, e, j, sum(y[j])::BIGINT AS s, count(*) AS n FROM a{n} JOIN p USING (r, part), range(1, len(y) + 1) u(j) GROUP BY part, e, j),
u{n} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM t{n} GROUP BY part, e),
b{n + 1} AS (SELECT part, e, coalesce(u.c, b.c) AS c FROM b{n} b LEFT JOIN u{n} u USING (part, e))"""


#: Vectors that are shorter than the longest, or than a multiple of 16, are filled up with zeros.
OP13 = f"""WITH g AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
w AS (SELECT (max(len(embedding)) + 15) // 16 AS w FROM g),
k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, w, list_resize(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT), 16 * w, 0) AS x FROM g, w),
p AS (SELECT r, part, x[part * w + 1 : (part + 1) * w] AS y FROM k, range(16) q(part)),
b0 AS (SELECT part, r - 1 AS e, y AS c FROM p WHERE r <= 64),
{_assigned(0)},
{_means(0)},
{_assigned(1)},
{_means(1)},
{_assigned(2)},
f AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS z, unnest(range(1, len(c) + 1)) AS j FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h"""
