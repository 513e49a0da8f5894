"""DuckDB SQL for the results of the queries that SQL can express."""

# Shared words of the texts, with A-Z lowered.
_LOWERED = (
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

_NEAR_DUP = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) >= 4
      THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END)) AS s
  FROM worded WHERE w IS NOT NULL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT met.a, met.b FROM met JOIN sizes x ON x.doc_id = met.a JOIN sizes y ON y.doc_id = met.b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN component USING (doc_id)
"""

_TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def _uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


_OWN = "coalesce(t.doc_id::VARCHAR, CASE WHEN b.several THEN t.content ELSE t.source END, '')"

_MIXING = f"""
WITH sizes AS (
  SELECT source, count(*) AS n, count(*) FILTER (doc_id IS NULL) > 1 AS several FROM documents GROUP BY source
), rates AS (
  SELECT source, several, sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate
  FROM sizes
), bounds AS (
  SELECT *, greatest(0, floor(rate - 9 * sqrt(rate) - 12))::BIGINT AS least,
    ceil(rate + 9 * sqrt(rate) + 12)::BIGINT AS most FROM rates
), terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, unnest(range(least, most + 1)) AS k FROM bounds)
), cumulative AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), listed AS (
  SELECT source, list(c) AS cs FROM cumulative GROUP BY source
), told AS (
  SELECT *, md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(2)), coalesce(text, chr(2)), coalesce(lang, chr(2)),
    coalesce(source, chr(2)), coalesce(n_chars::VARCHAR, chr(2)))) AS content FROM documents
), keyed AS (
  SELECT t.*, {_OWN} AS own, b.least, l.cs
  FROM told t JOIN bounds b ON t.source IS NOT DISTINCT FROM b.source
    JOIN listed l ON t.source IS NOT DISTINCT FROM l.source
), drawn AS (
  SELECT *, (least + len(list_filter(cs, lambda c: c <= {_uniform("'mix:' || own")})))::INTEGER AS copies FROM keyed
), copied AS (
  SELECT *, unnest(range(0, copies))::INTEGER AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copies, copy,
  {_uniform("'mix-order:' || own || ':' || copy")} AS shuffle_key
FROM copied
"""

_SUFFIX_DEDUP = """
WITH texts AS (
  SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents
), starts AS (
  SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS t FROM texts WHERE length(h) >= 200
), windows AS (
  SELECT doc_id, t, md5(substr(h, 2 * t + 1, 200)) AS w FROM starts
), late AS (
  SELECT doc_id, t FROM (
    SELECT doc_id, t, row_number() OVER (PARTITION BY w ORDER BY doc_id, t) AS r FROM windows
  ) WHERE r > 1
), edges AS (
  SELECT doc_id, t,
    CASE WHEN t <= lag(t) OVER (PARTITION BY doc_id ORDER BY t) + 100 THEN 0 ELSE 1 END AS new
  FROM late
), islands AS (
  SELECT doc_id, t, sum(new) OVER (PARTITION BY doc_id ORDER BY t) AS i FROM edges
), spans AS (
  SELECT doc_id, i, min(t) AS a, max(t) + 100 AS b FROM islands GROUP BY doc_id, i
), pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start, a AS stop FROM spans
  UNION ALL
  SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id,
    string_agg(substr(h, 2 * start + 1, 2 * (coalesce(stop, length(h) // 2) - start)), '' ORDER BY start) AS k
  FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
), totals AS (
  SELECT doc_id, count(*) AS n, sum(b - a) AS removed FROM spans GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_HARD_NEGATIVES = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

_REPEATED_WORDS = """
WITH worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS t FROM worded WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, t, md5(array_to_string(w[t:t + 49], ' ')) AS h FROM starts
), late AS (
  SELECT doc_id, t FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(t, t + 50)) AS i FROM late
), counted AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded WHERE doc_id IN (SELECT doc_id FROM counted)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k
  FROM placed p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w.w, ' ') ELSE coalesce(k, '') END) AS kept_sha256
FROM worded w LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang
), lengths AS (
  SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS words FROM worded WHERE len(w) > 0
), starts AS (
  SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) AS i FROM lengths
), found AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM starts GROUP BY 1, 2, 3 HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k
  FROM found WHERE words > 1
), scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.f AS l, y.f AS r, n, 1000 * c.a * n // (x.f * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, f, string_split(phrase, ' ') AS w, words, unnest(range(1, words + 1)) AS i FROM found WHERE words > 2
), parts AS (
  SELECT lang, f, array_to_string(w[i:j], ' ') AS phrase
  FROM (SELECT *, unnest(range(i + 1, words + 1)) AS j FROM inside) WHERE j - i + 1 < words
), left_over AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM parts p WHERE p.lang = b.lang AND p.phrase = b.phrase AND 100 * p.f >= 100 * b.a
  )
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op3_near_dup": _NEAR_DUP,
    "op5_topk": _TOP_K,
    "op6_mixing": _MIXING,
    "op10_suffix_dedup": _SUFFIX_DEDUP,
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_recompression": _REPEATED_WORDS,
    "op13_collocations": _COLLOCATIONS,
}
